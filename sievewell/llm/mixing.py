"""Mixing sources to target weights, by fitting whole documents to word budgets.

1. Words are counted in each document; documents are counted by source and exact
   length. Only these counts are used for planning.
2. Targets of sources: shares by weight with a ceiling, the excess shared again; solved
   in closed form over one row per source.
3. A source takes all its documents as many whole times as the target holds. What is
   left is fitted: every length gives its proportional part, single documents follow
   while more than the longest text is missing, and a bounded-knapsack dynamic program
   over reachable sums closes the rest, each length at most as often as it is there.
4. Inside a length, documents are taken by the order of a seeded hash. Counts by hash
   bucket tell which buckets are taken whole, so only one bucket of each length is ranked.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from sievewell.session import broadcast_if_small, written_once

WEIGHTS = (5, 2, 1)
WORD = r"[^\x20\x09-\x0D]+"
_BUCKETS = 4096


def source_targets(sizes: DataFrame, share: float = 1.5, ceiling: float = 2.0, weights: tuple[int, ...] = WEIGHTS) -> DataFrame:
    """(source, source_size, target) from (source, source_size).

    Sources in the order of their code points, null last, get ``weights`` in turn. The
    smallest ceilings per weight are met first; the others share what is left. One row
    per source is ordered here, and nothing else is.
    """
    by_name, by_ratio = W.orderBy(F.col("source").asc_nulls_last()), W.orderBy("ratio", "place")
    cycle = F.array(*(F.lit(float(w)) for w in weights))
    rows = sizes.withColumn("place", F.row_number().over(by_name))
    rows = rows.withColumn("weight", F.element_at(cycle, (F.pmod(F.col("place") - 1, F.lit(len(weights))) + 1).cast("int")))
    rows = rows.withColumn("cap", F.col("source_size") * F.lit(float(ceiling))).withColumn("ratio", F.col("cap") / F.col("weight"))
    upto = by_ratio.rowsBetween(W.unboundedPreceding, W.currentRow)
    rows = rows.withColumn("caps", F.sum("cap").over(upto)).withColumn("gone", F.sum("weight").over(upto))
    whole = W.partitionBy()
    rows = rows.withColumn("budget", F.sum("source_size").over(whole) * F.lit(float(share))).withColumn("all_weights", F.sum("weight").over(whole))
    # the level that the sources from here on would get, were all smaller ceilings met
    rows = rows.withColumn("level", (F.col("budget") - F.col("caps") + F.col("cap")) / (F.col("all_weights") - F.col("gone") + F.col("weight")))
    rows = rows.withColumn("final", F.max(F.when(F.col("level") <= F.col("ratio"), F.col("level"))).over(whole))
    target = F.least("cap", F.coalesce(F.col("final") * F.col("weight"), F.col("cap")))
    return rows.select("source", "source_size", F.greatest(target, F.lit(0.0)).alias("target"))


def fitted_counts(lengths: np.ndarray, counts: np.ndarray, budget: int) -> np.ndarray:
    """How many texts of each length to take so that their words come near to ``budget`` and not above it.

    All but a few of the longest texts' words are shared out in proportion; over the rest
    the program finds the best sum there is.
    """
    lengths, counts = lengths.astype(object), counts.astype(object)
    whole = int((lengths * counts).sum())
    taken = np.zeros(len(lengths), object)
    if not len(lengths) or budget <= 0 or not whole:
        return taken.astype(np.int64)
    if budget >= whole:
        return counts.astype(np.int64)
    taken[:] = [int(c) * budget // whole for c in counts]
    left = budget - int((taken * lengths).sum())
    room = 8 * int(lengths.max())  # the program's budget, at most
    for i in range(len(lengths)):
        back = min(int(taken[i]), max(0, room - left) // max(1, int(lengths[i])))
        taken[i] -= back
        left += back * int(lengths[i])
    for i in range(len(lengths)):
        if left <= room:
            break
        size = max(1, int(lengths[i]))
        more = min(int(counts[i] - taken[i]), (left - room) // size + 1, left // size)
        taken[i] += more
        left -= more * int(lengths[i])
    # reachable sums as the bits of one number; the steps that changed it are kept to walk back
    reach, mask, steps = 1, (1 << (left + 1)) - 1, []
    for i in range(len(lengths)):
        if reach >> left & 1:
            break
        free, size, lot = int(counts[i] - taken[i]), int(lengths[i]), 1
        while size and free and lot * size <= left:
            lot = min(lot, free)
            wider = (reach | reach << (lot * size)) & mask
            if wider != reach:
                steps.append((reach, i, lot))
                reach = wider
            free -= lot
            lot *= 2
    total = reach.bit_length() - 1
    for before, i, lot in reversed(steps):
        if not before >> total & 1:
            taken[i] += lot
            total -= lot * int(lengths[i])
    return taken.astype(np.int64)


def _plan(frame: pd.DataFrame) -> pd.DataFrame:
    frame = frame.sort_values("size", ascending=False)
    whole, target = int(frame["source_size"].iloc[0]), float(frame["target"].iloc[0])
    base = int(target // whole) if whole else 0
    extra = fitted_counts(frame["size"].to_numpy(), frame["n"].to_numpy(), int(round(target - base * whole)))
    return pd.DataFrame({"source": frame["source"], "size": frame["size"], "n": frame["n"], "base": base, "extra": extra, "source_size": whole, "target": target})


def _sized(docs: DataFrame, seed: int) -> DataFrame:
    """(row, doc_id) with the words, the seeded place and the source of each row; ``row`` holds all columns of ``docs``."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    place = F.pmod(F.xxhash64(F.lit(seed), F.col("doc_id"), F.xxhash64(text)), F.lit(1 << 40))
    return docs.select(
        F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("row"), F.col("doc_id").cast("long").alias("doc_id"),
        F.regexp_count(text, F.lit(WORD)).cast("long").alias("__size"), place.alias("__place"), F.col("source").cast("string").alias("__source"),
    )


def _same(a: str, b: str) -> Column:
    return F.col(a).eqNullSafe(F.col(b))


def taken_copies(docs: DataFrame, seed: int = 17, **shares) -> DataFrame:
    """(row, doc_id, __size, __source_size, __target, __copies): how often the mix takes each row."""
    rows = _sized(docs, seed)
    facts = written_once(rows.select("__source", "__size", "__place", "doc_id"), "mix-sizes")
    histogram = written_once(facts.groupBy(F.col("__source").alias("source"), F.col("__size").alias("size")).agg(F.count("*").alias("n")), "mix-lengths")
    targets = source_targets(histogram.groupBy("source").agg(F.sum(F.col("size") * F.col("n")).alias("source_size")), **shares)
    named = histogram.join(broadcast_if_small(written_once(targets, "mix-targets")).withColumnRenamed("source", "of"), F.col("source").eqNullSafe(F.col("of"))).drop("of")
    plan = named.groupBy("source").applyInPandas(_plan, "source string, size long, n long, base int, extra long, source_size long, target double")
    plan = written_once(plan, "mix-plan")

    # the bucket of places in which each partly taken length ends, and how many rows of it are taken
    part = plan.where("extra > 0 AND extra < n").select(F.col("source").alias("p_source"), F.col("size").alias("p_size"), "extra")
    part = written_once(part, "mix-parts")
    bucket = F.shiftrightunsigned("__place", 40 - _BUCKETS.bit_length() + 1)
    placed = facts.join(broadcast_if_small(part), _same("__source", "p_source") & (F.col("__size") == F.col("p_size"))).withColumn("bucket", bucket)
    steps = placed.groupBy("__source", "__size", "bucket").agg(F.count("*").alias("rows"), F.first("extra").alias("extra"))
    before = F.coalesce(F.sum("rows").over(W.partitionBy("__source", "__size").orderBy("bucket").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    ends = steps.withColumn("before", before).where("before < extra AND before + rows >= extra")
    ends = written_once(ends.select(F.col("__source").alias("e_source"), F.col("__size").alias("e_size"), F.col("bucket").alias("e_bucket"), (F.col("extra") - F.col("before")).alias("rest")), "mix-ends")
    last = placed.join(broadcast_if_small(ends), _same("__source", "e_source") & (F.col("__size") == F.col("e_size")) & (F.col("bucket") == F.col("e_bucket")))
    ranked = last.withColumn("rank", F.row_number().over(W.partitionBy("__source", "__size").orderBy("__place", F.col("doc_id").asc_nulls_last())))
    # the place up to which a length is taken, and how many rows at that very place are (rows that repeat share a place)
    limit = ranked.where("rank <= rest").groupBy("__source", "__size").agg(F.max("__place").alias("upto"))
    limit = limit.select(F.col("__source").alias("l_source"), F.col("__size").alias("l_size"), "upto")
    plan = plan.join(limit, _same("source", "l_source") & (F.col("size") == F.col("l_size")), "left")
    more = F.when(F.col("extra") >= F.col("n"), 1).when(F.col("extra") == 0, 0).otherwise(F.coalesce(F.col("upto"), F.lit(-1)))
    plan = written_once(
        plan.select(
            F.col("source").alias("__p_source"), F.col("size").alias("__p_size"), F.col("source_size").alias("__source_size"), F.col("target").alias("__target"),
            F.col("base").alias("__base"), (F.col("extra") >= F.col("n")).alias("__all"), F.when(F.col("extra") > 0, more).otherwise(-1).alias("__upto"),
        ),
        "mix-choice",
    )
    out = rows.join(broadcast_if_small(plan), _same("__source", "__p_source") & (F.col("__size") == F.col("__p_size")), "left")
    extra = (F.col("__all") | (F.col("__place") <= F.col("__upto"))).cast("int")
    return out.withColumn("__copies", F.col("__base") + extra)


def mix_documents(docs: DataFrame, seed: int = 17, **shares) -> DataFrame:
    """One row per document: doc_id, size, source_size, target, taken.

    ``size`` counts the words of the text, null: 0. ``target`` is that of the row's
    source. ``taken`` counts the words that the mix takes of the row, repeats counted; it
    is a whole multiple of ``size``, at most ``ceiling`` times. Rows of a null source form
    a source. Rows that repeat id and text share a seeded place, so they are taken or left
    together. An empty text has nothing to take. An empty table gives no rows. Reruns agree.
    """
    out = taken_copies(docs, seed, **shares)
    return out.select(
        "doc_id", F.col("__size").alias("size"), F.col("__source_size").alias("source_size"), F.col("__target").alias("target"), (F.col("__copies") * F.col("__size")).alias("taken")
    )


def mixed_documents(docs: DataFrame, seed: int = 17, **shares) -> DataFrame:
    """``docs`` with every row as often as the mix takes it; a row without words has nothing to weigh and stays once."""
    out = taken_copies(docs, seed, **shares)
    times = F.when(F.col("__size") == 0, 1).otherwise(F.col("__copies"))
    return out.withColumn("__copy", F.explode(F.array_repeat(F.lit(0), times.cast("int")))).select("row.*")
