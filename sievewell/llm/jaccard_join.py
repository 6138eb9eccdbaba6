"""Near-duplicate documents: a self-join on the Jaccard likeness of word shingles, by a MinHash LSH forest.

1. One pass gives each text a digest of its words and a MinHash signature: for each tree
   of the forest one string of ``DEPTH`` bytes. Texts with equal words are one class from here on.
2. A tree is the trie of its strings. Classes are matched by long prefixes first, each to the
   first class of its node, and joined where the whole signatures agree as near copies do. Then
   the prefix is shortened, to the length at which the trees find a pair at the threshold with
   the target recall. There only nodes whose classes are not all joined yet are looked at,
   so dense groups are settled by long prefixes and the short ones serve the rest; all pairs
   that are not joined are compared by their signatures, in blocks.
3. A group of joined classes is where links can be. Its shingle sets meet once, however many
   trees joined them. A group above a fixed weight is cut into blocks, and every pair of
   blocks is a task of its own.
4. Tasks compare whole sets exactly, count links, and give the edges of a spanning
   forest of what they found; the components of these edges are the groups.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sievewell.llm.buckets import forest
from sievewell.llm.graph import components
from sievewell.llm.hot import looked_up
from sievewell.llm.texts import by_text, lower_words, mixed, shingles, slices
from sievewell.session import broadcast_if_small, written_once

DEPTH = 10
_U = np.uint64
_NONE = _U(0xFFFFFFFFFFFFFFFF)


def prefix_depth(similarity: float, trees: int, recall: float, depth: int = DEPTH) -> int:
    """The longest prefix at which ``trees`` tries find a pair of this similarity with the wanted recall."""
    for d in range(depth, 0, -1):
        if 1 - (1 - similarity**d) ** trees >= recall:
            return d
    raise ValueError(f"{trees} trees cannot reach a recall of {recall} at {similarity}")


def least_agreement(similarity: float, values: int) -> int:
    """How many of a signature's ``values`` agree at least: four standard deviations below what a pair at the threshold has.

    A pair at the threshold falls below it with a chance of 3 in 100,000. Values are single bytes,
    of which one in 256 agrees by accident.
    """
    return math.floor(values * similarity - 4 * math.sqrt(values * similarity * (1 - similarity)))


def word_digests(words: np.ndarray, bounds: np.ndarray) -> list:
    """A 16-byte digest of the words of each text in their order; None for a text without words."""
    place = np.arange(len(words), dtype=np.uint64) - np.repeat(bounds[:-1], np.diff(bounds)).astype(np.uint64)
    low = by_text(np.add, mixed(words + mixed(place + _U(11))), bounds, _U(0))
    high = by_text(np.add, mixed((words ^ _U(0x5851F42D4C957F2D)) * (mixed(place) | _U(1))), bounds, _U(0))
    both = np.stack([mixed(low), mixed(high + np.diff(bounds).astype(np.uint64))], 1).astype(">u8")
    return [x.tobytes() if n else None for x, n in zip(both, np.diff(bounds), strict=True)]


def signatures_of(sets: np.ndarray, bounds: np.ndarray, trees: int, depth: int = DEPTH, seed: int = 7) -> np.ndarray:
    """The MinHash signature of each text: ``trees`` strings of ``depth`` bytes, one after the other."""
    factors = np.random.default_rng(seed).integers(1, 1 << 63, trees * depth, dtype=np.uint64) | _U(1)
    out = np.zeros((len(bounds) - 1, trees * depth), np.uint8)
    for k, f in enumerate(factors):
        out[:, k] = mixed(by_text(np.minimum, (sets * f) >> _U(8), bounds, _NONE)) & _U(255)
    return out


def signed_documents(docs: DataFrame, trees: int, size: int) -> DataFrame:
    """(doc_id, key, text_key, digest, weight, signature) of every document; a text without words has no digest."""

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for piece in slices(batches, "text", 1 << 20):
            words, bounds = lower_words(piece.column("text"))
            sets, to = shingles(words, bounds, size)
            found = signatures_of(sets, to, trees)
            yield pa.record_batch(
                [
                    *(piece.column(c) for c in ("doc_id", "key", "text_key")),
                    pa.array(word_digests(words, bounds), pa.binary()),
                    pa.array(np.diff(to), pa.int64()),
                    pa.array([x.tobytes() for x in found], pa.binary()),
                ],
                names=["doc_id", "key", "text_key", "digest", "weight", "signature"],
            )

    return keyed(docs).mapInArrow(sign, "doc_id long, key long, text_key long, digest binary, weight long, signature binary")


def _entries(classes: DataFrame, trees: int, depth: int, *others: str) -> DataFrame:
    """(digest, node, others): the node of each tree, at this depth, that a class lies in; the signature goes no further."""
    node = F.xxhash64("tree", F.substring("signature", F.col("tree") * DEPTH + 1, F.lit(depth)))
    rows = classes.withColumn("tree", F.explode(F.sequence(F.lit(0), F.lit(trees - 1))))
    return rows.select("digest", node.alias("node"), *others)


def _first_matches(classes: DataFrame, trees: int, depth: int, least: int) -> DataFrame:
    """(a, b): classes with the first class of a node they share, where their signatures agree."""
    entries = _entries(classes, trees, depth)
    heads = entries.groupBy("node").agg(F.min("digest").alias("other"), F.count("*").alias("n")).where("n > 1").select("node", "other")
    ties = entries.join(heads, "node").where("digest <> other").select("digest", "other").distinct()  # met in several trees
    ties = written_once(ties.join(classes, "digest"), "ties")
    met = looked_up(ties, classes.select(F.col("digest").alias("other"), F.col("signature").alias("other_signature")), ["other"], "inner", "hot-heads")

    def agree(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x, y = (np.frombuffer(b"".join(b.column(c).to_pylist()), np.uint8).reshape(len(b), -1) for c in ("signature", "other_signature"))
            near = b.filter(pa.array((x == y).sum(1) >= least)) if len(b) else b
            yield pa.record_batch([near.column("digest"), near.column("other")], names=["a", "b"])

    return met.mapInArrow(agree, "a binary, b binary")


def _agreements(least: int):
    def compare(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
        """Rows of (node, right, joined, digest, signature): all of a node's against those to the right, where not joined."""
        table = table.sort_by([("node", "ascending"), ("right", "ascending"), ("digest", "ascending")]).combine_chunks()
        node, right, digest = table.column("node").to_pylist(), table.column("right").to_numpy(), table.column("digest").to_pylist()
        groups = table.column("joined").combine_chunks().dictionary_encode().indices.to_numpy()
        codes = np.frombuffer(b"".join(table.column("signature").to_pylist()), np.uint8).reshape(len(node), -1)
        heads = [k for k in range(len(node)) if not k or node[k] != node[k - 1]]
        found: tuple[list, list] = ([], [])
        for a, b in zip(heads, [*heads[1:], len(node)], strict=True):
            rows = np.arange(a, b)
            left, others = rows[~right[a:b]], rows[right[a:b]]
            ties: tuple[list, list] = ([], [])
            step = max(1, (4 << 20) // max(1, len(left) * codes.shape[1]))
            for k in range(0, len(others), step):
                some = others[k : k + step]
                same = (codes[left][:, None, :] == codes[some][None, :, :]).sum(2)
                x, y = np.nonzero((same >= least) & (groups[left][:, None] != groups[some][None, :]))
                ties[0].extend(left[x].tolist())
                ties[1].extend(some[y].tolist())
            for p, q in forest(b - a, np.array(ties[0], int) - a, np.array(ties[1], int) - a):
                found[0].append(digest[a + p])
                found[1].append(digest[a + q])
        return pa.table([pa.array(found[0], pa.binary()), pa.array(found[1], pa.binary())], names=["a", "b"])

    return compare


def _all_matches(joined: DataFrame, trees: int, depth: int, least: int, block_rows: int) -> DataFrame:
    """(a, b): a spanning forest of all pairs that share a node, are not joined yet and whose signatures agree.

    In each node the largest joined group needs no look at itself: all classes meet those outside it.
    """
    groups = joined.withColumn("group", F.xxhash64("joined"))
    entries = _entries(groups, trees, depth, "group")
    parts = entries.groupBy("node", "group").agg(F.count("*").alias("n"))
    nodes = parts.groupBy("node").agg(F.sum("n").alias("n"), F.count("*").alias("groups"), F.max(F.struct("n", "group")).alias("top")).where("groups > 1")
    nodes = written_once(nodes.select("node", "n", F.col("top.n").alias("top_n"), F.col("top.group").alias("top")), "open-nodes")
    met = entries.join(broadcast_if_small(nodes, 200_000, 32 << 20), "node").join(joined, "digest")
    total = nodes.agg(F.sum("n")).first()[0] or 0
    blocks, rights = (F.greatest(F.ceil(n / block_rows), F.lit(1)).cast("int") for n in (F.col("n"), F.col("n") - F.col("top_n")))
    large = F.col("n") > block_rows
    met = met.select(
        "digest", "signature", "joined", "node", F.col("group") != F.col("top"), blocks.alias("blocks"), rights.alias("rights"),
        F.when(large, F.hex("node")).otherwise(F.pmod(F.xxhash64("node"), F.lit(1 + total // 4096)).cast("string")).alias("task"),
    ).toDF("digest", "signature", "joined", "node", "outside", "blocks", "rights", "task")
    place = lambda of: F.pmod(F.xxhash64("digest"), F.col(of)).cast("int")
    row = ["digest", "signature", "joined", "node", "task"]
    left = met.select(*row, F.lit(False).alias("right"), place("blocks").alias("i"), F.explode(F.sequence(F.lit(0), F.col("rights") - 1)).alias("j"))
    right = met.where("outside").select(*row, F.lit(True).alias("right"), place("rights").alias("j"), F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("i"))
    return left.unionByName(right).groupBy("task", "i", "j").applyInArrow(_agreements(least), "a binary, b binary")


def matched(classes: DataFrame, similarity: float, trees: int, recall: float, block_rows: int = 2048) -> DataFrame:
    """(digest, component) of the classes that have near copies by their signatures; see the steps above."""
    last, least = prefix_depth(similarity, trees, recall), least_agreement(similarity, trees * DEPTH)
    some = classes.select("digest", "signature")
    joined = some.withColumn("joined", F.col("digest"))
    if last < DEPTH:
        first = components(written_once(_first_matches(some, trees, (DEPTH + last) // 2, least), "matches"))
        first = first.select(F.col("node").alias("digest"), "component")
        joined = written_once(some.join(first, "digest", "left").select("digest", "signature", F.coalesce("component", "digest").alias("joined")), "joined")
    found = written_once(_all_matches(joined, trees, last, least, block_rows), "matches")
    # what is joined is one node from here on, so few edges are left
    ends = joined.select("digest", "joined")
    left, right = (ends.select(F.col("digest").alias(c), F.col("joined").alias(f"{c}_of")) for c in ("a", "b"))
    again = components(found.join(left, "a").join(right, "b").select(F.col("a_of").alias("a"), F.col("b_of").alias("b")))
    again = again.select(F.col("node").alias("joined"), "component")
    placed = ends.join(again, "joined", "left").select("digest", F.coalesce("component", "joined").alias("component"))
    sizes = placed.groupBy("component").agg(F.count("*").alias("n")).where("n > 1").select("component")
    return placed.join(sizes, "component").select("digest", "component")


def keyed(docs: DataFrame) -> DataFrame:
    """(doc_id, text, text_key, key); key stands for the id, and for the text where there is no id."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    rows = rows.withColumn("text_key", F.xxhash64(F.coalesce("text", F.lit(""))))
    return rows.withColumn("key", F.coalesce("doc_id", "text_key"))


def _sets_of(size: int):
    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for piece in slices(batches, "text", 1 << 20):
            words, bounds = lower_words(piece.column("text"))
            sets, to = shingles(words, bounds, size)
            blobs = [np.unique(x).tobytes() for x in np.split(sets, to[1:-1])] if len(to) > 1 else []
            # an id can stand for several texts; only the one that was meant goes on
            meant = pa.array([a == b.as_py() for a, b in zip(word_digests(words, bounds), piece.column("digest"), strict=True)], pa.bool_())
            names = [n for n in piece.schema.names if n != "text"]
            yield pa.record_batch([*(piece.column(n) for n in names), pa.array(blobs, pa.binary())], names=[*names, "shingles"]).filter(meant)

    return read


def links_within(sets: list[np.ndarray], left: np.ndarray, right: np.ndarray, similarity: float) -> tuple[np.ndarray, np.ndarray]:
    """Index pairs of ``left`` x ``right`` whose exact Jaccard likeness reaches ``similarity``; each pair once.

    Shared shingles are counted by products of 0/1 blocks: exact whole numbers.
    """
    rows = np.unique(np.concatenate([left, right]))
    at = {int(r): i for i, r in enumerate(rows)}
    sizes = np.array([len(sets[r]) for r in rows])
    owner = np.repeat(np.arange(len(rows)), sizes)
    every = np.concatenate([sets[r] for r in rows])
    order = np.argsort(every, kind="stable")
    e = every[order]
    new = np.ones(len(e), bool)
    new[1:] = e[1:] != e[:-1]
    column = np.cumsum(new) - 1
    shared = np.bincount(column) > 1
    column = np.where(shared, np.cumsum(shared) - 1, -1)[column]
    owner = owner[order]
    owner, column = owner[column >= 0], column[column >= 0]
    li, ri = np.array([at[int(x)] for x in left]), np.array([at[int(x)] for x in right])
    common = np.zeros((len(li), len(ri)), np.float32)
    wide = max(256, min(4096, (2 << 20) // max(1, len(rows))))
    n = int(column.max()) + 1 if len(column) else 0
    cuts = np.searchsorted(column, np.arange(0, n + wide, wide))
    for k in range(len(cuts) - 1):
        part = slice(cuts[k], cuts[k + 1])
        block = np.zeros((len(rows), wide), np.float32)
        block[owner[part], column[part] - k * wide] = 1
        common += block[li] @ block[ri].T
    total = sizes[li][:, None] + sizes[ri][None, :] - common
    return np.nonzero(common >= similarity * total - 1e-9)


def _verifier(similarity: float):
    def verify(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
        table = table.sort_by([("component", "ascending"), ("digest", "ascending")]).combine_chunks()
        again = np.array([a == b for a, b in zip(table.column("digest").to_pylist()[1:], table.column("digest").to_pylist(), strict=False)], bool)
        table = table.filter(pa.array(np.concatenate([[True], ~again])))
        digest, copies = table.column("digest").to_pylist(), table.column("copies").to_numpy()
        block, component = table.column("block").to_numpy(), table.column("component").to_pylist()
        sets = [np.frombuffer(x.as_py(), np.uint64) for x in table.column("shingles")]
        i, j = key[1].as_py(), key[2].as_py()
        heads = [k for k in range(len(component)) if not k or component[k] != component[k - 1]]
        found: dict[str, list] = {"digest": [], "links": [], "other": []}
        for a, b in zip(heads, [*heads[1:], len(component)], strict=True):
            rows = np.arange(a, b)
            left, right = (rows, rows) if i == j else (rows[block[a:b] == i], rows[block[a:b] == j])
            if not len(left) or not len(right) or b - a < 2:
                continue
            x, y = links_within(sets, left, right, similarity)
            x, y = left[x], right[y]
            if i == j:
                x, y = x[x < y], y[x < y]
            count = np.zeros(b - a, np.int64)
            np.add.at(count, x - a, copies[y])
            np.add.at(count, y - a, copies[x])
            for k in np.flatnonzero(count).tolist():
                found["digest"].append(digest[a + k])
                found["links"].append(int(count[k]))
                found["other"].append(None)
            for p, q in forest(b - a, x - a, y - a):
                found["digest"].append(digest[a + p])
                found["links"].append(0)
                found["other"].append(digest[a + q])
        return pa.table([pa.array(found["digest"], pa.binary()), pa.array(found["links"], pa.int64()), pa.array(found["other"], pa.binary())], names=list(found))

    return verify


def near_duplicates(
    docs: DataFrame,
    similarity: float = 0.8,
    size: int = 5,
    trees: int = 20,
    recall: float = 0.995,
    block_weight: int = 200_000,
) -> DataFrame:
    """One row per document: doc_id, class_id, n_links, group_id, kept.

    Two documents are linked when the sets of their ``size``-word shingles have a
    Jaccard likeness of ``similarity`` or more; words are compared in lower case and
    without punctuation, and a text of fewer words is one shingle. ``class_id`` is the
    smallest id of documents with the same words, ``n_links`` the number of other
    documents linked directly, copies included, ``group_id`` the smallest id that links
    reach, and ``kept`` marks it. Every link that a shared prefix offers is verified, and
    none is given that is not; a pair at the threshold is offered with a chance of at
    least ``recall`` (less 3 in 100,000, see ``least_agreement``), a closer pair with a higher one.

    A null or empty text, or one without words, links with nothing and is a class of its
    own. A row without id takes part in counting links; its class and group are those of the ids
    it is linked to, or null, and of a group without any id the row of the smallest text hash is kept.
    Rows that repeat an id give one row each, all marked alike where their texts are equal. Other columns do not matter; an empty
    table gives no rows.
    """
    found = _resolved(docs, similarity, size, trees, recall, block_weight)
    return found.select("doc_id", "class_id", "n_links", "group_id", "kept")


def without_near_duplicates(docs: DataFrame, **options) -> DataFrame:
    """``docs`` with one row of each group of near-duplicates; all columns stay.

    It is the row of the smallest id, or of the smallest text hash where no row of the group has
    an id. Of rows that repeat it in id and text the one whose row has the smallest hash stays.
    """
    found = _resolved(docs, **options).where("copied OR NOT kept").groupBy(F.col("key").alias("of_key"), F.col("text_key").alias("of_text")).agg(
        F.bool_or("kept").alias("kept"), F.count("*").alias("rows")
    )
    found = written_once(found.where("rows > 1 OR NOT kept"), "near-duplicates")
    text_key = F.xxhash64(F.coalesce(F.col("text").cast("string"), F.lit("")))
    whole = F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("row")  # so that no column can clash
    rows = docs.select(whole, F.coalesce(F.col("doc_id").cast("long"), text_key).alias("of_key"), text_key.alias("of_text"))
    known = broadcast_if_small(found)
    single = rows.join(known, ["of_key", "of_text"], "left_anti").select("row.*")
    repeated = found.where("kept AND rows > 1")
    if repeated.isEmpty():
        return single
    again = rows.join(broadcast_if_small(repeated), ["of_key", "of_text"]).groupBy("of_key", "of_text").agg(F.min_by("row", F.xxhash64(F.to_json("row"))).alias("row"))
    return single.unionByName(again.select("row.*"))


def _resolved(docs: DataFrame, similarity: float = 0.8, size: int = 5, trees: int = 20, recall: float = 0.995, block_weight: int = 200_000) -> DataFrame:
    signed = written_once(signed_documents(docs, trees, size), "signatures")
    some = signed.where("digest IS NOT NULL")
    first = F.struct(F.col("doc_id").isNull().alias("none"), "key", "text_key")
    classes = some.groupBy("digest").agg(
        F.count("*").alias("copies"), F.min("doc_id").alias("class_id"), F.min("key").alias("pick"), F.min(first).alias("first"),
        F.first("weight").alias("weight"), F.first("signature").alias("signature"),
    )
    classes = written_once(classes, "classes")
    placed = matched(classes, similarity, trees, recall)
    members = written_once(placed.join(classes.select("digest", "copies", "weight", "pick"), "digest"), "members")
    loads = members.groupBy("component").agg(F.sum("weight").alias("load"))
    total = members.agg(F.sum("weight")).first()[0] or 0
    lots = max(1, int(total // block_weight)) * 2
    # small components share a task; a heavy one has a block for each part of its weight
    cut = F.when(F.col("load") > block_weight, F.ceil(F.col("load") / block_weight)).otherwise(F.lit(1)).cast("int")
    tasks = loads.select("component", cut.alias("blocks"), F.when(F.col("load") > block_weight, F.hex("component")).otherwise(F.pmod(F.xxhash64("component"), F.lit(lots)).cast("string")).alias("task"))
    cells = members.join(tasks, "component").withColumn("block", F.pmod(F.xxhash64("digest"), F.col("blocks")).cast("int"))

    cells = written_once(cells.drop("weight"), "cells")
    # one text of each class; rows that repeat an id and its words come several times and are made one
    picked = keyed(docs).select(F.col("key").alias("pick"), "text").join(broadcast_if_small(cells, 200_000), "pick")
    picked = picked.select("pick", "digest", "component", "copies", "blocks", "task", "block", "text")
    sets = picked.mapInArrow(_sets_of(size), "pick long, digest binary, component binary, copies long, blocks int, task string, block int, shingles binary")
    if signed.select("digest", F.col("key").alias("pick")).join(cells.select("digest", "pick"), ["digest", "pick"]).count() > cells.count():
        sets = sets.dropDuplicates(["digest"])
    ends = F.transform(F.sequence(F.lit(0), F.col("blocks") - 1), lambda x: F.struct(F.least("block", x).alias("i"), F.greatest("block", x).alias("j")))
    spread = sets.select("digest", "component", "copies", "task", "block", "shingles", F.explode(ends).alias("e")).select("*", "e.i", "e.j").drop("e")
    found = written_once(
        spread.groupBy("task", "i", "j").applyInArrow(_verifier(similarity), "digest binary, links long, other binary"), "links"
    )
    counts = found.groupBy("digest").agg(F.sum("links").alias("links"))
    groups = components(found.where("other IS NOT NULL").select(F.col("digest").alias("a"), F.col("other").alias("b")))
    groups = groups.select(F.col("node").alias("digest"), "component")
    ids = groups.join(classes.select("digest", "class_id", "first"), "digest").groupBy("component").agg(F.min("class_id").alias("group_id"), F.min("first").alias("group_first"))
    grouped = groups.join(ids, "component").select("digest", "group_id", "group_first")
    facts = classes.select("digest", "copies", "class_id", "first").join(counts, "digest", "left").join(grouped, "digest", "left")
    facts = facts.select(
        "digest", "copies", "class_id", (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links"), F.coalesce("group_id", "class_id").alias("group_id"),
        F.coalesce("group_first", "first").alias("head"),
    )
    out = signed.select("doc_id", "key", "text_key", "digest").join(facts, "digest", "left")
    is_head = (F.col("key") == F.col("head.key")) & (F.col("text_key") == F.col("head.text_key")) & (F.col("doc_id").isNull() == F.col("head.none"))
    return out.select(
        "doc_id",
        "key",
        "text_key",
        F.when(F.col("digest").isNull(), F.col("doc_id")).otherwise(F.col("class_id")).alias("class_id"),
        F.coalesce("n_links", F.lit(0)).alias("n_links"),
        F.when(F.col("digest").isNull(), F.col("doc_id")).otherwise(F.col("group_id")).alias("group_id"),
        F.coalesce(is_head, F.lit(True)).alias("kept"),
        (F.coalesce(F.col("copies"), F.lit(1)) > 1).alias("copied"),
    )
