"""A trie of conversation prefixes, by whole-sequence collapse.

1. Conversations are rebuilt and read turn by turn in order; each turn chains a digest, so
   a prefix of a conversation has a key of 16 bytes and no prefix is ever stored as text.
2. Conversations that are equal as a whole collapse into one sequence with a weight and a
   digest of its members. Only one conversation of each sequence goes on.
3. Sequences that are proper prefixes of others are dropped by an anti-join; those left
   are the leaves.
4. Weighted prefixes of the sequences are aggregated to nodes. A node belongs to one of
   the leaves below it, so the nodes of a leaf are the lower end of its path, and sums over
   subtrees are running sums along paths, as long in all as the paths.

Turns of one conversation are streamed through a task, never held together.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from sievewell.llm.hot import looked_up
from sievewell.session import written_once

ROOT = b"\0" * 16
EMPTY_SHA256 = hashlib.sha256().hexdigest()
BASE, HEADS = 100, 6
CHAIN = "conv_id long, depth long, key binary, parent binary, chars long, last boolean"


def numbered_turns(conversations: DataFrame) -> DataFrame:
    """(conv_id, place from 1, digest, chars) of all turns; the text itself goes no further.

    Turns are ordered by turn, null first; ties by role, then by a digest of the text.
    """
    role, text = (F.coalesce(F.col(c).cast("string"), F.lit("")) for c in ("role", "text"))
    digest = F.unhex(F.sha2(F.concat(F.octet_length(role).cast("string"), F.lit(":"), role, text), 256))
    rows = conversations.select(
        F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").alias("turn"), role.alias("role"), digest.alias("digest"), F.char_length(text).cast("long").alias("chars")
    ).where("conv_id IS NOT NULL")
    order = Window.partitionBy("conv_id").orderBy(F.asc_nulls_first("turn"), "role", "digest")
    return rows.select("conv_id", F.row_number().over(order).cast("long").alias("place"), "digest", "chars")


def rebuilt(turns: DataFrame, base: int = BASE, heads: int = HEADS) -> DataFrame:
    """(conv_id, place, digest, chars): the first h turns of conversation c - c % ``base``, then the own ones after h.

    h is crc32 of the id in decimal, modulo ``heads``. A row of place 0 stands for each conversation itself.
    """
    h = F.pmod(F.crc32(F.col("conv_id").cast("string").cast("binary")), F.lit(heads)).cast("long")
    own = turns.where(F.col("place") > h).select("conv_id", (F.col("place") + heads).alias("place"), "digest", "chars")
    every = turns.where("place = 1").select("conv_id")
    first = turns.where((F.col("place") < heads) & (F.col("conv_id") % base == 0)).select(F.col("conv_id").alias("of"), "place", "digest", "chars")
    wanted = every.select("conv_id", (F.col("conv_id") - F.col("conv_id") % base).alias("of"), h.alias("h")).where("h > 0")
    head = wanted.join(first, "of").where("place <= h").select("conv_id", "place", "digest", "chars")
    root = every.select("conv_id", F.lit(0).cast("long").alias("place"), F.lit(None).cast("binary").alias("digest"), F.lit(0).cast("long").alias("chars"))
    return root.unionByName(head).unionByName(own)


def _chain(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows in order of conversation and place, as (conv_id, depth, key, parent, chars, last)."""
    held = None  # the row before, whose ``last`` is not known yet
    depth, key = 0, ROOT
    for batch in batches:
        out: list[tuple] = []
        columns = (batch.column(c).to_pylist() for c in ("conv_id", "place", "digest", "chars"))
        for conv, place, digest, chars in zip(*columns, strict=True):
            if held is not None:
                out.append((*held, place == 0))
            if place == 0:
                depth, key, parent = 0, ROOT, None
            else:
                depth, parent = depth + 1, key
                key = hashlib.sha256(key + digest).digest()[:16]
            held = (conv, depth, key, parent, chars)
        yield _rows(out)
    if held is not None:
        yield _rows([(*held, True)])


def _rows(rows: list[tuple]) -> pa.RecordBatch:
    types = [("conv_id", pa.int64()), ("depth", pa.int64()), ("key", pa.binary()), ("parent", pa.binary()), ("chars", pa.int64()), ("last", pa.bool_())]
    columns = list(zip(*rows, strict=True)) or [()] * len(types)
    return pa.record_batch([pa.array(c, t) for c, (_, t) in zip(columns, types, strict=True)], names=[n for n, _ in types])


def prefixes(turns: DataFrame, base: int = BASE, heads: int = HEADS) -> DataFrame:
    """One row for each prefix of each rebuilt conversation, the empty one included."""
    rows = rebuilt(turns, base, heads)
    return rows.repartition("conv_id").sortWithinPartitions("conv_id", "place").mapInArrow(_chain, CHAIN)


def _digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """SHA-256 of the comma-joined ids of each key; rows come in order of key and id."""
    now, sha = None, None
    for batch in batches:
        keys, ids = batch.column("key"), batch.column("conv_id").cast(pa.string())
        done: list[tuple] = []
        runs = pc.run_end_encode(keys) if len(keys) else None
        start = 0
        for key, end in zip(runs.values.to_pylist(), runs.run_ends.to_pylist(), strict=True) if runs is not None else ():
            text = ",".join(ids.slice(start, end - start).to_pylist()).encode()
            start = end
            if key == now:
                sha.update(b"," + text)
                continue
            if sha is not None:
                done.append((now, sha.hexdigest()))
            now, sha = key, hashlib.sha256(text)
        yield pa.record_batch([pa.array([k for k, _ in done], pa.binary()), pa.array([s for _, s in done], pa.string())], names=["key", "ends_sha256"])
    if sha is not None:
        yield pa.record_batch([pa.array([now], pa.binary()), pa.array([sha.hexdigest()], pa.string())], names=["key", "ends_sha256"])


def sequences(chains: DataFrame) -> DataFrame:
    """Equal conversations as one: (key, conv_id, weight, ends_sha256) with their smallest id and the digest of all ids."""
    ends = chains.where("last").select("key", "conv_id")
    facts = ends.groupBy("key").agg(F.min("conv_id").alias("conv_id"), F.count("*").alias("weight"))
    listed = ends.repartition("key").sortWithinPartitions("key", "conv_id").mapInArrow(_digests, "key binary, ends_sha256 string")
    return facts.join(listed, "key")


def trie(conversations: DataFrame, base: int = BASE, heads: int = HEADS) -> DataFrame:
    """One row per node: conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256.

    A node is a distinct sequence of the first turns (role, text) of rebuilt conversations,
    from the root of depth 0; its members are the rebuilt conversations that begin with it.
    ``conv_id`` is the smallest member and ``parent_conv_id`` the parent's (root: null);
    ``n_leaves`` counts the childless nodes of the subtree, the node itself included;
    ``saved_tokens`` sums, over the subtree, (members - 1) times the characters of the node's last
    text; ``ends_sha256`` is of the ids, joined by commas, of the members that end there.

    A null role or text is empty. A null turn comes first, ties are ordered by role and then by a
    digest of the text, and rows that repeat are turns of their own. Rows without conv_id belong
    to no conversation and are left out. Ids below zero take the remainder with its sign. Other
    columns do not matter; an empty table gives no rows, not even a root.
    """
    turns = written_once(numbered_turns(conversations), "turns")
    chains = written_once(prefixes(turns, base, heads), "chains")
    whole = written_once(sequences(chains), "sequences")  # its smallest id stands for each sequence
    paths = written_once(chains.drop("last").join(whole.select("conv_id", "weight"), "conv_id"), "paths")
    inner = paths.where("parent IS NOT NULL").groupBy(F.col("parent").alias("key")).agg(F.count("*").alias("n")).select("key")
    leaves = whole.join(inner, "key", "left_anti").select("conv_id", F.lit(1).cast("long").alias("leaf"))
    paths = written_once(paths.join(leaves, "conv_id", "left"), "paths")
    nodes = paths.groupBy("key", "parent", "depth", "chars").agg(
        F.min("conv_id").alias("conv_id"), F.sum("weight").alias("n_convs"), F.sum("leaf").alias("n_leaves"), F.min(F.when(F.col("leaf") == 1, F.col("conv_id"))).alias("owner")
    )
    nodes = written_once(nodes, "nodes")
    # every row of a leaf's path counts what the leaf owns from there on; above what it owns, that is all of it
    own = nodes.select(F.col("owner").alias("conv_id"), "depth", ((F.col("n_convs") - 1) * F.col("chars")).alias("own"))
    down = paths.where("leaf = 1").select("conv_id", "depth", "key").join(own, ["conv_id", "depth"], "left")
    below = Window.partitionBy("conv_id").orderBy(F.desc("depth")).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    summed = down.select("key", F.coalesce(F.sum("own").over(below), F.lit(0)).alias("below")).groupBy("key").agg(F.sum("below").alias("saved_tokens"))
    children = nodes.where("parent IS NOT NULL").groupBy(F.col("parent").alias("key")).agg(F.count("*").alias("n_children"))
    known = nodes.join(children, "key", "left").join(summed, "key").join(whole.select("key", "ends_sha256"), "key", "left")
    known = written_once(known.drop("owner", "chars"), "nodes")
    parents = known.where("n_children > 0").select(F.col("key").alias("parent"), F.col("conv_id").alias("parent_conv_id"))
    out = looked_up(known, parents, ["parent"], "left", "hot-parents")
    return out.select(
        "conv_id", "depth", "parent_conv_id", "n_convs", F.coalesce("n_children", F.lit(0)).cast("long").alias("n_children"), "n_leaves", "saved_tokens",
        F.coalesce("ends_sha256", F.lit(EMPTY_SHA256)).alias("ends_sha256"),
    )


def trie_sql(base: int = BASE, heads: int = HEADS) -> str:
    """The same in DuckDB's SQL, with whole prefixes as keys."""
    table = "list_transform(range(256), lambda n: list_reduce(list_concat([n], range(8)), lambda c, i: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END))"
    codes = "list_transform(string_split(conv_id::VARCHAR, ''), lambda x: ascii(x)::BIGINT)"
    crc = f"xor(list_reduce(list_concat([4294967295], {codes}), lambda c, b: xor(c >> 8, t[(xor(c, b) & 255) + 1])), 4294967295)"
    return f"""
WITH turns AS (
  SELECT conv_id, coalesce(role, '') AS role, coalesce(text, '') AS text, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, sha256(text)) AS place
  FROM conversations WHERE conv_id IS NOT NULL
), crc_table AS (
  SELECT {table} AS t
), ids AS (
  SELECT conv_id, conv_id - conv_id % {base} AS base, {crc} % {heads} AS h FROM (SELECT DISTINCT conv_id FROM turns), crc_table
), rebuilt AS (
  SELECT i.conv_id, t.place, t.role, t.text FROM ids i JOIN turns t ON t.conv_id = i.base AND t.place <= i.h
  UNION ALL SELECT i.conv_id, t.place + {heads}, t.role, t.text FROM ids i JOIN turns t ON t.conv_id = i.conv_id AND t.place > i.h
), paths AS (
  SELECT conv_id, list(sha256(strlen(role) || ':' || role || text) ORDER BY place) FILTER (place IS NOT NULL) AS path, list(length(text) ORDER BY place) FILTER (place IS NOT NULL) AS sizes
  FROM ids LEFT JOIN rebuilt USING (conv_id) GROUP BY conv_id
), steps AS (
  SELECT conv_id, len(coalesce(path, [])) AS turns, d, array_to_string(coalesce(path, [])[1:d], '') AS key, array_to_string(coalesce(path, [])[1:d - 1], '') AS parent, CASE WHEN d = 0 THEN 0 ELSE sizes[d] END AS chars
  FROM paths, LATERAL (SELECT unnest(range(0, len(coalesce(path, [])) + 1)) AS d)
), nodes AS (
  SELECT key, CASE WHEN any_value(d) > 0 THEN any_value(parent) END AS parent, any_value(d) AS depth, min(conv_id) AS conv_id, count(*) AS n_convs, (count(*) - 1) * any_value(chars) AS own,
         coalesce(string_agg(conv_id::VARCHAR, ',' ORDER BY conv_id) FILTER (turns = d), '') AS ends
  FROM steps GROUP BY key
), children AS (
  SELECT parent AS key, count(*) AS n FROM nodes WHERE parent IS NOT NULL GROUP BY parent
), up AS (
  SELECT left(n.key, 64 * u.d::INT) AS key, sum(n.own) AS saved, count(*) FILTER (c.n IS NULL) AS leaves
  FROM nodes n LEFT JOIN children c USING (key), LATERAL (SELECT unnest(range(0, n.depth + 1)) AS d) u GROUP BY 1
)
SELECT n.conv_id, n.depth, p.conv_id AS parent_conv_id, n.n_convs, coalesce(c.n, 0) AS n_children, u.leaves AS n_leaves, u.saved::BIGINT AS saved_tokens, sha256(n.ends) AS ends_sha256
FROM nodes n LEFT JOIN nodes p ON p.key = n.parent LEFT JOIN children c ON c.key = n.key JOIN up u ON u.key = n.key
"""
