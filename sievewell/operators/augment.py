"""Class balancing: which classes are small, how often to copy, how to perturb."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sievewell.functions import patterns as P
from sievewell.operators.ranking import discrete_quantile
from sievewell.session import broadcast_if_small, written_once


def labelled(df: DataFrame, label: str, text_cols: list[str]) -> DataFrame:
    """Rows with a non-empty label, texts lower-cased and never null."""
    kept = df.where(F.length(label) > 0)
    return kept.withColumns({c: F.lower(F.coalesce(F.col(c), F.lit(""))) for c in text_cols})


def class_counts(df: DataFrame, label: str) -> DataFrame:
    return df.groupBy(label).agg(F.count("*").alias("count"))


def minority_classes(counts: DataFrame, label: str, fallback: int = P.BALANCE_FALLBACK_CLASSES) -> DataFrame:
    """Classes at or below the first quartile of class sizes, else the ``fallback`` smallest."""
    q25 = discrete_quantile(counts, "count", 0.25)
    small = counts.where(F.col("count") <= F.lit(q25))
    return small if q25 is not None else counts.orderBy("count", label).limit(fallback)


def replication_plan(
    df: DataFrame, label: str, share: float = P.BALANCE_TARGET_SHARE, cap: int = P.BALANCE_MAX_COPIES
) -> DataFrame:
    """(label, count, need, copies) of the minority classes.

    They are lifted towards ``share`` of the largest class, with at most ``cap``
    copies per row.
    """
    counts = written_once(class_counts(df, label), "class-counts")
    target = F.floor(counts.agg(F.max("count")).scalar() * F.lit(share)).cast("bigint")
    need = F.greatest(F.lit(0).cast("bigint"), target - F.col("count"))
    planned = minority_classes(counts, label).select(label, "count", need.alias("need"))
    return planned.withColumn("copies", F.least(F.ceil(F.col("need") / F.col("count")), F.lit(cap)).cast("int"))


def replicate(df: DataFrame, plan: DataFrame, label: str) -> DataFrame:
    """Every row of a planned class once per copy, numbered by ``rep`` from 1."""
    wanted = broadcast_if_small(written_once(plan.where("copies > 0").select(label, "copies"), "replication-plan"))
    joined = df.join(wanted, label)
    return joined.withColumn("rep", F.explode(F.sequence(F.lit(1), F.col("copies")))).drop("copies")


def uniform(*parts) -> Column:
    """A number in [0, 1) from 60 bits of the md5 of the parts."""
    text = F.concat_ws("|", *[p if isinstance(p, Column) else F.lit(p) for p in parts])
    return F.conv(F.substring(F.md5(text), 1, 15), 16, 10).cast("bigint") / F.lit(float(1 << 60))


def perturb(text: Column, seed: Column) -> Column:
    """Drop some words, or swap two, decided by hashes of ``seed``.

    Half the rows lose each word with a fixed probability but never all of them;
    the other half have two positions swapped, which may coincide.
    """
    tokens = F.filter(F.split(text, r"\s+"), lambda t: t != "")

    def changed(w: Column) -> Column:
        kept = F.filter(w, lambda t, i: uniform(seed, "d", i.cast("string")) > P.DELETE_PROBABILITY)
        n = F.size(w)
        a = F.floor(uniform(seed, "i") * n).cast("int")
        b = F.floor(uniform(seed, "j") * n).cast("int")
        swapped = F.transform(
            w, lambda t, i: F.when(i == a, F.get(w, b)).when(i == b, F.get(w, a)).otherwise(t)
        )
        deleted = F.when(F.size(kept) > 0, kept).otherwise(w)
        return F.when(n == 0, text).otherwise(
            F.array_join(F.when(uniform(seed, "c") < 0.5, deleted).otherwise(swapped), " ")
        )

    from sievewell.functions.text import bind

    return bind(tokens, changed)


def balance(
    df: DataFrame,
    label: str,
    id_col: str,
    text_cols: list[str],
    seed: int = 42,
    share: float = P.BALANCE_TARGET_SHARE,
    cap: int = P.BALANCE_MAX_COPIES,
) -> DataFrame:
    """The labelled rows and the perturbed copies of the small classes, marked by ``rep`` (0 = original)."""
    base = labelled(df, label, text_cols)
    copies = replicate(base, replication_plan(base, label, share, cap), label)
    for c in text_cols:
        key = F.concat_ws("|", F.lit(str(seed)), F.col(id_col).cast("string"), F.col("rep").cast("string"), F.lit(c))
        copies = copies.withColumn(c, perturb(F.col(c), key))
    return base.withColumn("rep", F.lit(0)).unionByName(copies)


def balance_report(balanced: DataFrame, label: str) -> DataFrame:
    """(label, before, after) row counts."""
    return balanced.groupBy(label).agg(
        F.count_if(F.col("rep") == 0).alias("before"), F.count("*").alias("after")
    )
