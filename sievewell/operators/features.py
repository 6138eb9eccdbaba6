"""Feature columns of standardised tables."""

from __future__ import annotations

from pyspark.ml.feature import IDF, HashingTF, RegexTokenizer, StopWordsRemover
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from sievewell.functions import patterns as P
from sievewell.functions.patterns import MECHANISM_KEYWORDS
from sievewell.operators.profile import date_ordinal, z_score
from sievewell.session import broadcast_if_small, written_once


def engineered(
    df: DataFrame,
    name: str = "drug_name",
    text: str = "description",
    presence: str = "toxicity",
    keyword_text: str = "mechanism",
    keywords: list[str] = MECHANISM_KEYWORDS,
) -> DataFrame:
    """Lengths, a presence flag and keyword flags (a null text has no keyword)."""
    flags = {
        f"mech_{kw}": F.when(F.contains(F.lower(keyword_text), F.lit(kw)), 1).otherwise(0) for kw in keywords
    }
    return df.withColumns(
        {
            "name_length": F.length(name),
            "desc_length": F.size(F.split(F.col(text), r"\s+")),
            f"has_{presence}_info": F.when(F.col(presence).isNotNull(), 1).otherwise(0),
            **flags,
        }
    )


def numeric_features(df: DataFrame, texts: tuple = ("description", "indication", "mechanism")) -> DataFrame:
    """Z-score, ordinal date and text lengths; a null text measures as the word None."""
    lengths = {f"{c}_len": F.length(F.coalesce(F.col(c), F.lit("None"))) for c in texts}
    return df.withColumns(
        {"avg_mass_norm": z_score(df, "avg_mass"), "ingest_dt_ordinal": date_ordinal(F.col("ingest_dt")), **lengths}
    )


def label_index(df: DataFrame, label: str) -> DataFrame:
    """(label, label_index): 0 for the most frequent label, ties alphabetical.

    The labels are sorted by ranges and stored with their place in the range; one row per
    range tells how many labels lie before it. No task sees all labels.
    """
    counts = df.where(F.col(label).isNotNull()).groupBy(label).agg(F.count("*").alias("n"))
    placed = counts.orderBy(F.desc("n"), F.asc(label)).select(label, F.monotonically_increasing_id().alias("_place"))
    placed = written_once(placed, "label-order").withColumn("_range", F.shiftrightunsigned("_place", 33))
    sizes = placed.groupBy("_range").agg(F.count("*").alias("_n"))
    earlier = W.orderBy("_range").rowsBetween(W.unboundedPreceding, -1)
    offsets = sizes.select("_range", F.coalesce(F.sum("_n").over(earlier), F.lit(0)).alias("_before"))
    place = F.col("_place").bitwiseAND((1 << 33) - 1) + F.col("_before")
    return placed.join(F.broadcast(offsets), "_range").select(label, place.cast("double").alias("label_index"))


def with_label_index(df: DataFrame, label: str, out: str) -> DataFrame:
    """Join the index; a null or unseen label gets the number of labels."""
    index = written_once(label_index(df, label), "label-index")
    size = index.agg(F.count("*").cast("double")).scalar()
    return (
        df.join(broadcast_if_small(index), label, "left")
        .withColumn(out, F.coalesce("label_index", size))
        .drop("label_index")
        .select(*df.columns, out)
    )


def stop_word_tokens(df: DataFrame, text: str) -> DataFrame:
    """Lower-case ``\\W+`` tokens without English stop words, as ``<text>_tokens``."""
    lowered = df.withColumn(text, F.lower(F.coalesce(F.col(text), F.lit(""))))
    raw = RegexTokenizer(inputCol=text, outputCol=f"{text}_tok", pattern="\\W+").transform(lowered)
    remover = StopWordsRemover(inputCol=f"{text}_tok", outputCol=f"{text}_tokens", stopWords=P.ENGLISH_STOP_WORDS, locale="en_US")
    return remover.transform(raw).drop(f"{text}_tok")


def hashed_tfidf(df: DataFrame, tokens: str, out: str, num_features: int = 65536) -> DataFrame:
    """Hashing term frequencies weighted by idf, a sparse vector column."""
    tf = HashingTF(inputCol=tokens, outputCol="_tf", numFeatures=num_features).transform(df)
    return IDF(inputCol="_tf", outputCol=out).fit(tf).transform(tf).drop("_tf")
