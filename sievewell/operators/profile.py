"""Profiles of tables: bins, frequencies, rates, percentiles, correlations."""

from __future__ import annotations

from functools import reduce
from itertools import combinations_with_replacement

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sievewell.operators.ranking import exact_quantiles


def mass_bin(c: Column) -> Column:
    """Below 100, 100 to 500, above 500; a null falls through to the last bin."""
    return F.when(c < 100, "<100").when((c >= 100) & (c <= 500), "100-500").otherwise(">500")


def bin_counts(df: DataFrame, col: str, bin_col: str = "mass_bin", bins=mass_bin) -> DataFrame:
    return df.groupBy(bins(F.col(col)).alias(bin_col)).agg(F.count("*").alias("row_count"))


def top_k(df: DataFrame, col: str, k: int, null_label: str | None = None, null_words: tuple = ()) -> DataFrame:
    """The ``k`` most frequent values; equal counts are ordered by value, null first.

    With a label, null (and any of ``null_words``) is counted under it.
    """
    value = F.col(col)
    if null_label is not None:
        absent = value.isNull()
        if null_words:
            absent = absent | value.isin(*null_words)
        value = F.when(absent, F.lit(null_label)).otherwise(value)
    counts = df.groupBy(value.alias(col)).agg(F.count("*").alias("row_count"))
    return counts.orderBy(F.desc("row_count"), F.asc_nulls_first(col)).limit(k)


def daily_stats(df: DataFrame, ts: str, value: str) -> DataFrame:
    return df.groupBy(F.to_date(ts).alias("day")).agg(
        F.count("*").alias("row_count"),
        F.avg(value).alias("mean_value"),
        F.stddev_samp(value).alias("std_value"),
    )


def percentiles(df: DataFrame, col: str, ps: list[float], exact: bool = True) -> DataFrame:
    """Rows (p, value). Exact by rank selection, or approximate by one sketch pass."""
    spark = df.sparkSession
    if exact:
        rows = list(zip(ps, exact_quantiles(df, col, ps)))
        return spark.createDataFrame(rows, "p double, value double")
    sketch = df.agg(F.percentile_approx(col, ps, 10_000).alias("v"))
    return sketch.select(
        F.explode(F.arrays_zip(F.array(*[F.lit(p) for p in ps]).alias("p"), F.col("v").alias("value"))).alias("x")
    ).select(F.col("x.p").alias("p"), F.col("x.value").cast("double").alias("value"))


def null_rates(df: DataFrame, cols: list[str] | None = None) -> DataFrame:
    """Rows (column_name, null_rate) from one pass over the table."""
    cols = cols or df.columns
    one = df.agg(*[(F.count_if(F.col(c).isNull()) / F.count("*")).alias(c) for c in cols])
    return one.unpivot([], cols, "column_name", "null_rate")


def coverage(df: DataFrame, col: str, present: str = "With", missing: str = "Missing") -> DataFrame:
    """Rows (bucket, row_count, share) for present and missing values."""
    counts = df.groupBy(
        F.when(F.col(col).isNull(), F.lit(missing)).otherwise(F.lit(present)).alias("bucket")
    ).agg(F.count("*").alias("row_count"))
    total = df.agg(F.count("*")).scalar()
    return counts.select("bucket", "row_count", (F.col("row_count") / total).alias("share"))


def duplicate_keys(df: DataFrame, key: str) -> DataFrame:
    return df.groupBy(key).agg(F.count("*").alias("row_count")).where("row_count > 1")


def feature_summary(df: DataFrame, means: list[str], sums: list[str]) -> DataFrame:
    return df.agg(
        *[F.avg(c).alias(f"avg_{c}") for c in means],
        *[F.sum(c).alias(f"sum_{c}") for c in sums],
        F.count("*").alias("total"),
    )


def mean_token_counts(df: DataFrame, token_cols: list[str]) -> DataFrame:
    return df.agg(*[F.avg(F.size(c)).alias(f"avg_{c}") for c in token_cols])


def z_score(df: DataFrame, col: str) -> Column:
    """(x - mean) / sample standard deviation over the whole table."""
    mean = df.agg(F.avg(col)).scalar()
    std = df.agg(F.stddev_samp(col)).scalar()
    return (F.col(col) - mean) / F.nullif(std, F.lit(0.0))


def date_ordinal(c: Column) -> Column:
    """Days since 0001-01-01 counted from 1; an unreadable date gives null."""
    return F.unix_date(F.try_to_timestamp(c.cast("string")).cast("date")) + 719163


def correlation(df: DataFrame, cols: list[str]) -> DataFrame:
    """Pearson correlations of every pair of columns, from one pass.

    Each pair uses the rows where both are known. Output is long:
    (left_column, right_column, correlation), both orders of a pair.
    """
    pairs = list(combinations_with_replacement(cols, 2))
    one = df.agg(*[F.corr(a, b).alias(f"c{i}") for i, (a, b) in enumerate(pairs)])
    rows = []
    for i, (a, b) in enumerate(pairs):
        for x, y in {(a, b), (b, a)}:
            rows.append(
                F.struct(
                    F.lit(x).alias("left_column"), F.lit(y).alias("right_column"), F.col(f"c{i}").alias("correlation")
                )
            )
    return one.select(F.inline(F.array(*rows)))


def histogram(df: DataFrame, col: str, bins: int) -> DataFrame:
    """Equal-width bins over min..max, the last one closed, empty bins kept."""
    known = df.where(F.col(col).isNotNull())
    ends = known.agg(
        F.struct(F.min(col).cast("double").alias("lo"), F.max(col).cast("double").alias("hi")).alias("e")
    )
    x = known.select(F.col(col).cast("double").alias("v"), ends.scalar().alias("e"))
    # One value only: the range is widened by one half to each side.
    flat = F.col("e.lo") == F.col("e.hi")
    lo = F.when(flat, F.col("e.lo") - 0.5).otherwise(F.col("e.lo"))
    width = F.when(flat, F.lit(1.0)).otherwise(F.col("e.hi") - F.col("e.lo"))
    slot = F.least(F.floor((F.col("v") - lo) / width * bins), F.lit(bins - 1)).cast("bigint")
    counts = x.groupBy(slot.alias("bin")).agg(F.count("*").alias("row_count"))
    frame = df.sparkSession.range(bins).select(F.col("id").alias("bin"), ends.scalar().alias("e"))
    frame = frame.select(
        "bin",
        (lo + width * F.col("bin") / bins).alias("lower"),
        (lo + width * (F.col("bin") + 1) / bins).alias("upper"),
    )
    return frame.join(counts, "bin", "left").na.fill({"row_count": 0})


def insights(df: DataFrame, number: str, text: str, label: str) -> DataFrame:
    """Rows (insight, subject, value): worst null column, percentiles, missing share, commonest label."""
    rates = null_rates(df)
    worst = rates.agg(
        F.max_by(F.struct("column_name", "null_rate"), F.struct("null_rate", "column_name")).alias("w")
    ).select(
        F.lit("highest_null_pct").alias("insight"),
        F.col("w.column_name").alias("subject"),
        F.round(F.col("w.null_rate") * 100, 2).alias("value"),
    )
    spread = percentiles(df, number, [0.5, 0.9, 0.99]).select(
        F.concat(F.lit("p"), F.round(F.col("p") * 100).cast("int").cast("string")).alias("insight"),
        F.lit(number).alias("subject"),
        "value",
    )
    missing = df.select(
        F.lit("missing_pct").alias("insight"),
        F.lit(text).alias("subject"),
        F.col(text).isNull().alias("m"),
    ).groupBy("insight", "subject").agg(F.round(100 * F.avg(F.col("m").cast("double")), 1).alias("value"))
    common = top_k(df, label, 1, "[NULL]", ("NULL",)).select(
        F.lit("most_common").alias("insight"),
        F.col(label).alias("subject"),
        F.col("row_count").cast("double").alias("value"),
    )
    return reduce(DataFrame.unionByName, [worst, spread, missing, common])


def table_summary(df: DataFrame, name: str) -> DataFrame:
    """One row: table name, row count, column count, schema string."""
    return df.agg(F.count("*").alias("row_count")).select(
        F.lit(name).alias("table_name"),
        "row_count",
        F.lit(len(df.columns)).alias("column_count"),
        F.lit(df.schema.simpleString()).alias("schema"),
    )


def stratified_sample(df: DataFrame, stratum: Column, share: float, seed: int, key: str) -> DataFrame:
    """Bernoulli sample per stratum decided by a hash of the key: the same rows on any layout."""
    from sievewell.operators.ranking import hash_rank_key

    limit = int(share * (1 << 60))
    return df.withColumn("stratum", stratum).where(hash_rank_key(seed, key) < F.lit(limit))


def seeded_sample_by(df: DataFrame, col: str, shares: dict, seed: int) -> DataFrame:
    """Spark's own stratified sampler; the rows chosen depend on the partitioning."""
    return df.sampleBy(col, shares, seed)
