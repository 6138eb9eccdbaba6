import hashlib
import random
import zlib

import pytest

from sievewell.llm.conversation_trie import trie

SCHEMA = "conv_id long, turn long, role string, text string"


def _brute(rows):
    convs = {}
    for c, turn, role, text in rows:
        if c is not None:
            convs.setdefault(c, []).append((turn is not None, turn or 0, role or "", hashlib.sha256(f"{len((role or '').encode())}:{role or ''}{text or ''}".encode()).digest(), text or ""))
    own = {c: [(r, t) for *_, r, _, t in sorted(v)] for c, v in convs.items()}
    built = {}
    for c, turns in own.items():
        h = zlib.crc32(str(c).encode()) % 6
        rest = c % 100 if c >= 0 else -(-c % 100)
        built[c] = tuple(own.get(c - rest, [])[:h] + turns[h:])
    nodes = {}
    for c, s in built.items():
        for d in range(len(s) + 1):
            nodes.setdefault(s[:d], []).append(c)
    out = []
    for p, members in nodes.items():
        below = [q for q in nodes if q[: len(p)] == p]
        children = [q for q in below if len(q) == len(p) + 1]
        leaves = [q for q in below if not any(len(o) == len(q) + 1 and o[: len(q)] == q for o in below)]
        saved = sum((len(nodes[q]) - 1) * len(q[-1][1]) for q in below if q)
        ends = ",".join(str(c) for c in sorted(members) if len(built[c]) == len(p))
        out.append((min(members), len(p), min(nodes[p[:-1]]) if p else None, len(members), len(children), len(leaves), saved, hashlib.sha256(ends.encode()).hexdigest()))
    return sorted(out, key=str)


def _found(df):
    return sorted((tuple(r) for r in trie(df).collect()), key=str)


@pytest.mark.parametrize("seed", [1, 2])
def test_equals_brute_force_over_few_texts(spark, seed):
    rnd = random.Random(seed)
    rows = []
    for c in [*range(0, 230, 3), *range(100, 200, 7), 1000, 1001, 1100]:
        for t in range(rnd.choice([1, 2, 3, 6, 9])):
            rows.append((c, rnd.choice([t, t, None]), rnd.choice(["user", "assistant"]), rnd.choice(["a", "b", "é€"])))
    rnd.shuffle(rows)
    assert _found(spark.createDataFrame(rows, SCHEMA).repartition(5)) == _brute(rows)


def test_nulls_repeats_turnless_and_clashing_columns(spark):
    rows = [
        (0, 1, None, None), (0, None, "user", "first"), (0, 1, None, None), (5, 0, "user", ""), (7, 2, "user", "x" * 100_000), (None, 1, "user", "lost"),
        (300, 0, "user", "alone"), (301, 0, "user", "alone"), (-3, 0, "user", "below zero"), (-100, 1, "user", "base"), (-101, 1, "user", "base"), (901, 0, "a", "b"), (902, 0, "a", "b"),
    ]
    df = spark.createDataFrame(rows, SCHEMA).selectExpr("*", "1 AS key", "2 AS place", "'x' AS sequence", "3 AS depth", "4 AS parent", "5 AS h")
    assert _found(df) == _brute(rows)


def test_a_conversation_without_turns_belongs_to_the_root(spark):
    lone = next(c for c in range(101, 200) if zlib.crc32(str(c).encode()) % 6 > 2)  # loses its only turn; has no base
    found = _found(spark.createDataFrame([(lone, 0, "user", "gone")], SCHEMA))
    assert found == [(lone, 0, None, 1, 0, 1, 0, hashlib.sha256(str(lone).encode()).hexdigest())]


def test_no_rows(spark):
    assert trie(spark.createDataFrame([], SCHEMA)).collect() == []


def test_copies_and_a_long_conversation(spark):
    rows = [(c, t, "user", f"t{t}") for c in range(1000, 1400) for t in range(3)] + [(2000, t, "user", f"t{t % 3}") for t in range(400)]
    assert _found(spark.createDataFrame(rows, SCHEMA).repartition(7)) == _brute(rows)
