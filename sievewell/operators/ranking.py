"""Exact order statistics and running totals without a one-task sort."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from sievewell.session import broadcast_if_small, written_once

# A band this small is finished by listing its distinct values with counts.
_BAND_ROWS = 2_000
_ACCURACY = 10_000
_SLACK = 2.0 / _ACCURACY


def values_at_ranks(df: DataFrame, col: str, ranks: list[int], n: int | None = None) -> list:
    """The values at the given 0-based ranks of ``col`` in ascending order, nulls left out.

    ``n`` is the number of known values, when the caller has counted them.

    Each round asks a mergeable quantile sketch for values that bracket the
    wanted ranks, counts exactly how many rows lie below them, and goes on
    inside the bracket. Rounds are plain aggregations over one column, so no
    row is shuffled or sorted and the driver sees a few numbers per rank.
    """
    if not ranks:
        return []
    values = df.select(F.col(col).alias("v")).where(F.col(col).isNotNull())
    n = values.count() if n is None else n
    wanted = sorted(set(ranks))
    if wanted[0] < 0 or wanted[-1] >= n:
        raise ValueError(f"rank out of range for {n} values")
    found = _select(values, n, wanted)
    return [found[r] for r in ranks]


def _select(values: DataFrame, n: int, ranks: list[int]) -> dict:
    if n <= _BAND_ROWS:
        return _from_counts(values, ranks)
    row = values.agg(*_sketch([(r + 0.5) / n for r in ranks])).first()
    return _narrow(values, _bounds(row), ranks)


def _sketch(ps: list[float]) -> list[Column]:
    around = sorted({min(1.0, max(0.0, p + d)) for p in ps for d in (-_SLACK, _SLACK)})
    return [F.percentile_approx("v", around, _ACCURACY).alias("b"), F.min("v").alias("lo"), F.max("v").alias("hi")]


def _bounds(row) -> list:
    return sorted({*row["b"], row["lo"], row["hi"]})


def _narrow(values: DataFrame, bounds: list, ranks: list[int]) -> dict:
    """Exact counts around the bounds decide, per rank, a value or a narrower band."""
    counts = values.agg(
        *[F.count_if(F.col("v") < F.lit(b)).alias(f"below{i}") for i, b in enumerate(bounds)],
        *[F.count_if(F.col("v") <= F.lit(b)).alias(f"upto{i}") for i, b in enumerate(bounds)],
    ).first()
    out: dict = {}
    bands: dict = {}
    for r in ranks:
        lo = max(i for i in range(len(bounds)) if counts[f"below{i}"] <= r)
        hi = min(i for i in range(len(bounds)) if counts[f"upto{i}"] > r)
        if lo >= hi:
            out[r] = bounds[hi]
        elif r < counts[f"upto{lo}"]:
            out[r] = bounds[lo]
        else:
            bands.setdefault((lo, hi), []).append(r)
    small = F.lit(False)
    for (lo, hi), inside in bands.items():
        # The rank lies strictly above the lower bound.
        below, upto = counts[f"upto{lo}"], counts[f"upto{hi}"]
        within = (F.col("v") > F.lit(bounds[lo])) & (F.col("v") <= F.lit(bounds[hi]))
        if upto - below <= _BAND_ROWS:
            small = small | within
        else:
            got = _select(values.where(within), upto - below, [r - below for r in inside])
            out.update({r: got[r - below] for r in inside})
    if len(out) < len(ranks):
        # All narrow bands are read in one scan; their sizes are known to be small.
        listed = [row["v"] for row in values.where(small).collect()]
        for (lo, hi), inside in bands.items():
            if inside[0] not in out:
                band = sorted(v for v in listed if bounds[lo] < v <= bounds[hi])
                out.update({r: band[r - counts[f"upto{lo}"]] for r in inside})
    return out


def _from_counts(values: DataFrame, ranks: list[int]) -> dict:
    """At most ``_BAND_ROWS`` rows: list them in order."""
    listed = sorted(row["v"] for row in values.collect())
    return {r: listed[r] for r in ranks}


def count_and_quantiles(df: DataFrame, col: str, ps: list[float]) -> tuple[int, list[float | None]]:
    """Number of known values and their linearly interpolated quantiles.

    This is the ``percentile`` definition, without its buffer of all distinct
    values: one sketch pass, one counting pass, one listing of a narrow band.
    """
    values = df.select(F.col(col).alias("v")).where(F.col(col).isNotNull())
    row = values.agg(F.count("*").alias("n"), *_sketch(ps)).first()
    n = row["n"]
    if n == 0:
        return 0, [None for _ in ps]
    spots = [p * (n - 1) for p in ps]
    ranks = sorted({r for s in spots for r in (math.floor(s), math.ceil(s))})
    at = _narrow(values, _bounds(row), ranks)
    return n, [
        float(at[math.floor(s)] + (at[math.ceil(s)] - at[math.floor(s)]) * (s - math.floor(s)))
        for s in spots
    ]


def exact_quantiles(df: DataFrame, col: str, ps: list[float]) -> list[float | None]:
    return count_and_quantiles(df, col, ps)[1]


def grouped_quantiles(df: DataFrame, by: str, col: str, ps: dict[str, float], band_rows: int = 1_000_000) -> DataFrame:
    """(by, n, one column for each of ``ps``): exact, linearly interpolated quantiles of every group at once.

    One aggregation gives each group's number of values and, from a mergeable sketch, a band for
    each wanted rank; a second counts what lies below the band and lists the distinct values inside it. While the
    largest band holds more than ``band_rows`` rows, bands are sketched again. Nothing but that size comes to
    the driver, however many groups there are, and a group of any size is counted before it is moved. Null values
    are left out; a group without any has n = 0 and nulls. A null group is a group.
    """
    names = list(ps)
    keyed = df.select(F.col(by).alias("g"), F.col(col).cast("double").alias("v"))
    values = keyed.where("v IS NOT NULL")
    groups = keyed.groupBy("g").agg(F.count("v").alias("n"))
    spot = lambda p: F.lit(p) * (F.col("n") - 1)
    parts = [F.struct(F.lit(f"{k}|{edge}").alias("want"), rank(spot(p)).cast("long").alias("r")) for k, p in ps.items() for edge, rank in (("lo", F.floor), ("hi", F.ceil))]
    wanted = groups.where("n > 0").select("g", "n", F.explode(F.array(*parts)).alias("x")).select("g", "n", "x.want", "x.r")
    # the band in which a rank is looked for: above ``low``, up to ``high``; null for no end
    whole = {"low": F.lit(None).cast("double"), "high": F.lit(None).cast("double"), "below": F.lit(0).cast("long"), "m": F.col("n")}
    bands = written_once(wanted.withColumns(whole).select("g", "r", "low", "high", "below", "m").distinct(), "rank-bands")
    most = bands.agg(F.max("m")).first()[0] or 0
    while most > band_rows:
        bands, before = written_once(_narrowed(values, bands), "rank-bands"), most
        most = bands.agg(F.max("m")).first()[0]
        if most >= before:
            break  # the largest bands hold one value that repeats
    distinct = _in_bands(values, bands).groupBy("g", "r", "below", "v").agg(F.count("*").alias("c"))
    upto = F.col("below") + F.sum("c").over(W.partitionBy("g", "r").orderBy("v").rowsBetween(W.unboundedPreceding, 0))
    found = distinct.select("g", "r", "v", upto.alias("upto")).where(F.col("upto") > F.col("r")).groupBy("g", "r").agg(F.min("v").alias("v"))
    found = wanted.select(F.col("g").alias("wg"), F.col("r").alias("wr"), "want").join(found, F.col("wg").eqNullSafe(F.col("g")) & (F.col("wr") == F.col("r")))
    ends = found.groupBy(F.col("wg").alias("fg")).agg(*(F.max(F.when(F.col("want") == f"{k}|{e}", F.col("v"))).alias(f"{k}|{e}") for k in names for e in ("lo", "hi")))
    out = groups.join(ends, F.col("g").eqNullSafe(F.col("fg")), "left")
    between = lambda k, p: F.col(f"{k}|lo") + (F.col(f"{k}|hi") - F.col(f"{k}|lo")) * (spot(p) - F.floor(spot(p)))
    return out.select(F.col("g").alias(by), "n", *(between(k, p).alias(k) for k, p in ps.items()))


_SPOTS = [i / 200 for i in range(1, 200)]


def _in_bands(values: DataFrame, bands: DataFrame) -> DataFrame:
    """The values (g, v) in the band of each wanted rank of their group, with the band's columns."""
    met = values.join(broadcast_if_small(bands.withColumnRenamed("g", "of")), F.col("g").eqNullSafe(F.col("of"))).drop("of")
    return met.where((F.col("low").isNull() | (F.col("v") > F.col("low"))) & (F.col("high").isNull() | (F.col("v") <= F.col("high"))))


def _narrowed(values: DataFrame, bands: DataFrame) -> DataFrame:
    """Each band cut to the values of its sketch around the rank; one that would miss its rank stays as it is."""
    band = ["g", "r", "low", "high", "below", "m"]
    spots = _in_bands(values, bands).groupBy(*band).agg(F.percentile_approx("v", _SPOTS, _ACCURACY).alias("spots"))
    step = F.floor((F.col("r") - F.col("below")) / F.col("m") * (len(_SPOTS) + 1)).cast("int")
    closer = spots.withColumns({"_low": F.coalesce(F.get("spots", step - 2), F.col("low")), "_high": F.coalesce(F.get("spots", step + 1), F.col("high"))}).drop("spots")
    closer = written_once(closer, "rank-spots")
    inner = F.col("_low").isNull() | (F.col("v") > F.col("_low"))
    outer = F.col("_high").isNull() | (F.col("v") <= F.col("_high"))
    counts = _in_bands(values, closer).groupBy(*band, "_low", "_high").agg(F.count_if(~inner).alias("under"), F.count_if(inner & outer).alias("held"))
    start = F.col("below") + F.col("under")
    hit = (start <= F.col("r")) & (F.col("r") < start + F.col("held"))
    keep = lambda new, old: F.when(hit, new).otherwise(F.col(old)).alias(old)
    return counts.select("g", "r", keep(F.col("_low"), "low"), keep(F.col("_high"), "high"), keep(start, "below"), keep(F.col("held"), "m"))


def certified_quantiles(df: DataFrame, col: str, ps: list[float], accuracy: int = _ACCURACY) -> DataFrame:
    """(p, n, value, below, upto, certified): sketched quantiles with their exact ranks.

    ``below`` values are smaller than ``value`` and ``upto`` are not larger. It is certified where the rank
    p n lies between them, or no further off than the sketch's error, n / ``accuracy``. Two aggregations; the
    driver sees a number for each of ``ps``.
    """
    values = df.select(F.col(col).alias("v")).where(F.col(col).isNotNull())
    row = values.agg(F.count("*").alias("n"), F.percentile_approx("v", ps, accuracy).alias("b")).first()
    found = list(zip(ps, row["b"] or [None] * len(ps), strict=True))
    counts = [F.struct(F.lit(p).alias("p"), F.lit(v).cast("double").alias("value"), F.count_if(F.col("v") < F.lit(v)).alias("below"), F.count_if(F.col("v") <= F.lit(v)).alias("upto")) for p, v in found]
    rows = values.agg(F.count("*").alias("n"), F.array(*counts).alias("x")).select("n", F.inline("x"))
    rank, off = F.col("p") * F.col("n"), F.col("n") / accuracy + 1
    return rows.select("p", "n", "value", "below", "upto", ((F.col("below") - off <= rank) & (rank <= F.col("upto") + off)).alias("certified"))


def discrete_quantile(df: DataFrame, col: str, p: float):
    """The smallest value whose cumulative share reaches ``p``; null on no rows."""
    n = df.where(F.col(col).isNotNull()).count()
    if n == 0:
        return None
    return values_at_ranks(df, col, [max(math.ceil(p * n), 1) - 1])[0]


def hash_rank_key(seed: int, *cols) -> Column:
    """A 60-bit number from md5(seed, cols): a shuffle order any engine can recompute."""
    text = F.concat_ws("|", F.lit(str(seed)), *[F.col(c).cast("string") for c in cols])
    return F.conv(F.substring(F.md5(text), 1, 15), 16, 10).cast("bigint")


def cut_points(df: DataFrame, order_cols: list[str], ranks: list[int], n: int | None = None) -> list[tuple]:
    """Keys of the rows at the given 0-based ranks under ``order_cols``, for :func:`before`.

    The first column is cut exactly; where its value is tied, the search goes on
    among the tied rows with the next column. All columns but the last must be
    numbers or times; the last must make rows distinct.
    """
    first, rest = order_cols[0], order_cols[1:]
    if not ranks:
        return []
    heads = values_at_ranks(df, first, ranks, n)
    if not rest:
        return [(h,) for h in heads]
    counts = df.agg(
        *[F.count_if(F.col(first) < F.lit(h)).alias(f"b{i}") for i, h in enumerate(heads)],
        *[F.count_if(F.col(first) == F.lit(h)).alias(f"t{i}") for i, h in enumerate(heads)],
    ).first()
    out = []
    for i, (rank, head) in enumerate(zip(ranks, heads)):
        inside, n_tied = rank - counts[f"b{i}"], counts[f"t{i}"]
        if n_tied == 1:
            out.append((head,))
            continue
        tied = df.where(F.col(first) == F.lit(head)).select(*rest)
        if n_tied <= _BAND_ROWS:
            out.append((head, *sorted(tuple(r) for r in tied.collect())[inside]))
        else:
            out.append((head, *cut_points(tied, rest, [inside], n_tied)[0]))
    return out


def before(order_cols: list[str], point: tuple) -> Column:
    """True for rows that sort strictly before ``point``."""
    cond = F.lit(False)
    for c, v in reversed(list(zip(order_cols, point))):
        cond = (F.col(c) < F.lit(v)) | ((F.col(c) == F.lit(v)) & cond)
    return cond


def with_order_blocks(df: DataFrame, col: str, out: str, blocks: int = 64, block_rows: int = 1_000_000) -> DataFrame:
    """Add a block number that grows with ``col``; blocks hold about equal numbers of rows.

    Bounds come from a quantile sketch. Where blocks would be larger than
    ``block_rows``, each is cut once more by its own sketch, which gives up to
    ``blocks`` squared. The bounds are literals and a table of at most
    ``blocks`` rows, so a re-run task computes the same block for the same row.
    """
    ps = [i / blocks for i in range(1, blocks)]
    row = df.agg(F.count(col).alias("n"), F.percentile_approx(col, ps, _ACCURACY).alias("b")).first()
    bounds = sorted(set(row["b"] or []))
    if not bounds:
        return df.withColumn(out, F.lit(0))
    first = F.size(F.filter(F.array(*[F.lit(b) for b in bounds]), lambda b: b <= F.col(col)))
    tagged = df.withColumn(out, first)
    if row["n"] <= blocks * block_rows:
        return tagged
    finer = tagged.groupBy(out).agg(F.percentile_approx(col, ps, _ACCURACY).alias("_finer"))
    second = F.size(F.filter(F.array_distinct("_finer"), lambda b: b <= F.col(col)))
    return tagged.join(F.broadcast(finer), out).withColumn(out, F.col(out) * blocks + second).drop("_finer")


def running_totals(
    df: DataFrame, order_col: str, totals: dict[str, Column], blocks: int = 64, block_rows: int = 1_000_000
) -> DataFrame:
    """Running sums over the whole frame in ``order_col`` order; the column must make rows distinct.

    Each block is summed by its own task; the totals of the blocks before it
    (a row per block) are added from a broadcast.
    """
    tagged = with_order_blocks(df, order_col, "_block", blocks, block_rows).withColumns(totals)
    sums = tagged.groupBy("_block").agg(*[F.sum(n).alias(n) for n in totals])
    earlier = W.orderBy("_block").rowsBetween(W.unboundedPreceding, -1)
    offsets = sums.select(
        "_block", *[F.coalesce(F.sum(n).over(earlier), F.lit(0)).alias(f"_off_{n}") for n in totals]
    )
    within = W.partitionBy("_block").orderBy(order_col).rowsBetween(W.unboundedPreceding, 0)
    out = tagged.join(F.broadcast(offsets), "_block")
    for n in totals:
        out = out.withColumn(n, F.sum(n).over(within) + F.col(f"_off_{n}"))
    return out.drop("_block", *[f"_off_{n}" for n in totals])


def hash_row_numbers(df: DataFrame, id_col: str, seed: int, bits: int = 12) -> DataFrame:
    """Number rows from 0 in the order of a seeded hash of the id.

    Rows are numbered within 2^bits hash buckets, and the sizes of the buckets
    before are added from a broadcast of at most that many rows.
    """
    keyed = df.withColumn("_h", hash_rank_key(seed, id_col)).withColumn("_b", F.shiftright("_h", 60 - bits))
    sizes = keyed.groupBy("_b").agg(F.count("*").alias("_n"))
    earlier = W.orderBy("_b").rowsBetween(W.unboundedPreceding, -1)
    offsets = sizes.select("_b", F.coalesce(F.sum("_n").over(earlier), F.lit(0)).alias("_off"))
    within = F.row_number().over(W.partitionBy("_b").orderBy("_h", id_col)) - 1
    return keyed.join(F.broadcast(offsets), "_b").withColumn("row_number", within + F.col("_off")).drop("_h", "_b", "_off")
