"""Suffix-array dedup, n-gram Jaccard join, embedding near-dedup and fingerprints against brute force."""

import hashlib
import random
import re
from collections import defaultdict

import numpy as np
import pyarrow as pa
import pytest

from sievewell.llm import embedding_dedup, fingerprints, jaccard_join, suffix_dedup
from sievewell.llm.graph import components


def removed_by_hand(docs, window):
    first = {}
    for i, t in docs:
        for s in range(len(t) - window + 1):
            k = t[s : s + window]
            first[k] = min(first.get(k, i), i)
    out = []
    for i, t in docs:
        gone = np.zeros(len(t), bool)
        for s in range(len(t) - window + 1):
            if first[t[s : s + window]] < i:
                gone[s : s + window] = True
        kept = bytes(np.frombuffer(t, np.uint8)[~gone])
        edges = np.diff(np.concatenate([[0], gone.astype(int), [0]]))
        out.append((i, len(t), int(gone.sum()), int((edges == 1).sum()), hashlib.sha256(kept).hexdigest()))
    return sorted(out)


@pytest.mark.parametrize(("seed", "letters", "window"), [(1, "ab", 50), (2, "abcdefgh", 50), (3, "aé€b", 50), (4, "abc", 25), (5, "xyzw", 67)])
def test_repeats_match_brute_force(spark, seed, letters, window):
    rnd = random.Random(seed)
    passages = ["".join(rnd.choice(letters) for _ in range(rnd.randint(30, 220))) for _ in range(8)]
    docs = []
    for i in rnd.sample(range(1000), 50):
        text = ""
        for _ in range(rnd.randint(0, 8)):
            p = rnd.choice(passages)
            if rnd.random() < 0.5:
                p = p[rnd.randint(0, len(p)) :][: rnd.randint(0, 150)]
            text += (p[:10] * 8 if rnd.random() < 0.1 else p) + "".join(rnd.choice("pq") for _ in range(rnd.choice([0, 3, 30])))
        docs.append((i, text))
    docs += [(2000, "a" * 300), (2001, "a" * 200)]
    df = spark.createDataFrame(docs, "doc_id long, text string").repartition(4)
    got = sorted(tuple(r) for r in suffix_dedup.remove_repeats(df, window).collect())
    assert got == removed_by_hand([(i, t.encode()) for i, t in docs], window)


def test_repeats_of_messy_rows(messy, nothing):
    got = suffix_dedup.remove_repeats(messy).collect()
    assert len(got) == messy.count()
    by = defaultdict(list)
    for r in got:
        by[r.doc_id].append((r.n_bytes, r.n_removed))
    assert by[1] == [(77, 0), (77, 0)] and by[2] == [(77, 77)] and sorted(by[None]) == [(0, 0), (77, 0)]
    assert by[10][0][0] == by[10][0][1] and by[7][0][1] == 0
    assert suffix_dedup.remove_repeats(nothing).collect() == []
    cut = suffix_dedup.without_repeats(messy)
    assert cut.columns == messy.columns and cut.count() == messy.count()
    rows = {(r.doc_id, r.text) for r in cut.collect()}
    assert (2, "") in rows and (3, None) in rows and all(r.n_chars == len(r.text) for r in cut.where("text IS NOT NULL").collect())
    assert suffix_dedup.without_repeats(nothing).columns == messy.columns


def test_buckets_do_not_depend_on_the_splitters(docs):
    few = {tuple(r) for r in suffix_dedup.remove_repeats(docs).collect()}
    many = {tuple(r) for r in suffix_dedup.remove_repeats(docs, pack_bytes=1 << 14, sample_docs=20).collect()}
    assert few == many
    with pytest.raises(ValueError, match="window"):
        suffix_dedup.remove_repeats(docs, window=10)


def shingle_set(text):
    words = re.findall(r"(?:[a-z0-9_]|[^\x00-\x7f])+", (text or "").lower())
    return {tuple(words[i : i + 5]) for i in range(len(words) - 4)} if len(words) >= 5 else ({tuple(words)} if words else set())


def test_near_duplicates_match_brute_force(spark, docs):
    rnd = random.Random(3)
    base = [f"t{rnd.randint(0, 400)}" for _ in range(120)]
    copies = []
    for i in range(60):
        words = list(base)
        for _ in range(rnd.randint(0, 6)):
            words[rnd.randrange(len(words))] = f"u{rnd.randint(0, 9)}"
        copies.append((100_000 + i, " ".join(words)))
    rows = [(r.doc_id, r.text) for r in docs.collect()] + copies + [(200_000, ""), (200_001, "a b c"), (200_002, "A, b; c!")]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    got = {r.doc_id: r for r in jaccard_join.near_duplicates(df, block_weight=1500).collect()}
    sets = {i: shingle_set(t) for i, t in rows}
    holders, links = defaultdict(set), defaultdict(set)
    for i, s in sets.items():
        for x in s:
            holders[x].add(i)
    for i, s in sets.items():
        common = defaultdict(int)
        for x in s:
            for j in holders[x] - {i}:
                common[j] += 1
        links[i] = {j for j, n in common.items() if n >= 0.8 * (len(s) + len(sets[j]) - n) - 1e-9}
    assert {i: len(x) for i, x in links.items()} == {i: r.n_links for i, r in got.items()}
    for i in sets:
        seen, todo = {i}, [i]
        while todo:
            new = links[todo.pop()] - seen
            seen |= new
            todo += new
        assert got[i].group_id == min(seen) and got[i].kept == (i == min(seen))
    assert max(r.n_links for r in got.values()) > 15


def test_near_duplicates_of_messy_rows(messy, nothing):
    got = jaccard_join.near_duplicates(messy).collect()
    assert len(got) == messy.count() and sorted(r.n_links for r in got if r.doc_id == 1) == [3, 3]
    assert [(r.class_id, r.n_links, r.kept) for r in got if r.doc_id == 4] == [(4, 0, True)]
    kept = jaccard_join.without_near_duplicates(messy)
    assert kept.columns == messy.columns
    assert sorted((r.doc_id or 0) for r in kept.collect()) == [0, 1, 3, 3, 4, 5, 7, 8, 9, 10]
    assert jaccard_join.near_duplicates(nothing).collect() == [] and jaccard_join.without_near_duplicates(nothing).count() == 0


def test_one_row_of_each_group_stays(spark):
    text = " ".join(f"w{i}" for i in range(60))
    rows = [(None, text, "a"), (None, text, "b"), (None, text + " more", "c"), (7, "other words that are alone here", "d"), (7, "other words that are alone here", "d"), (7, "Other words that are alone here!", "e")]
    df = spark.createDataFrame(rows, "doc_id long, text string, row string")
    kept = jaccard_join.without_near_duplicates(df).collect()
    assert sorted((r.doc_id or 0) for r in kept) == [0, 7]
    again = jaccard_join.without_near_duplicates(df.unionByName(df).repartition(3)).collect()  # a second ingest
    assert sorted(map(tuple, again), key=str) == sorted(map(tuple, kept), key=str)


def test_texts_that_are_little_alike_make_no_groups(spark):
    rnd = random.Random(11)
    shared = [f"s{i}" for i in range(60)]
    rows = [(i, " ".join([*shared, *(f"u{rnd.randrange(10**9)}" for _ in range(64))])) for i in range(8000)]  # 56 of 176 shingles: 0.3
    rows += [(10_000 + i, rows[i][1] + " end") for i in range(30)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    classes = jaccard_join.signed_documents(df, 20, 5).select("digest", "signature")
    placed = jaccard_join.matched(jaccard_join.written_once(classes, "classes"), 0.8, 20, 0.995)
    assert placed.groupBy("component").count().agg({"count": "max"}).first()[0] == 2 and placed.count() == 60


@pytest.mark.parametrize(("likeness", "changed"), [(0.8, 22), (0.85, 16)])
def test_recall_of_planted_pairs(spark, likeness, changed):
    rnd = random.Random(13)
    rows = []
    for i in range(600):
        words = [f"w{rnd.randrange(10**9)}" for _ in range(204)]  # 200 shingles; words changed at the end change as many shingles
        rows += [(2 * i, " ".join(words)), (2 * i + 1, " ".join([*words[: 204 - changed], *(f"v{j}x{i}" for j in range(changed))]))]
    found = jaccard_join.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string").repartition(3)).collect()
    assert (200 - changed) / (200 + changed) >= likeness
    assert sum(r.n_links == 1 for r in found) / len(rows) >= 0.99 and max(r.n_links for r in found) == 1


def test_a_large_node_is_compared_in_blocks(spark):
    rnd = random.Random(17)
    base = [f"t{i}" for i in range(100)]
    rows = []
    for i in range(300):
        words = list(base)
        words[rnd.randrange(100)] = f"u{i}"
        rows.append((i, " ".join(words)))
    df = spark.createDataFrame(rows, "doc_id long, text string")
    classes = jaccard_join.written_once(jaccard_join.signed_documents(df, 20, 5).select("digest", "signature"), "classes")
    joined = classes.selectExpr("*", "digest AS joined")
    least = jaccard_join.least_agreement(0.8, 200)
    count = lambda rows: components(jaccard_join._all_matches(joined, 20, 6, least, rows)).groupBy("component").count().count()
    assert count(16) == count(4096) == 1


def test_prefixes_are_shortened_until_the_recall_holds():
    assert jaccard_join.prefix_depth(0.8, 20, 0.995) == 6 and jaccard_join.prefix_depth(0.8, 60, 0.995) == 10
    with pytest.raises(ValueError, match="recall"):
        jaccard_join.prefix_depth(0.1, 2, 0.99)


def test_components(spark):
    rnd = random.Random(5)
    pairs = [(rnd.randrange(300), rnd.randrange(300)) for _ in range(180)] + [(1000 + i, 1001 + i) for i in range(64)] + [(7, 7), (5000, 5000)]
    got = {r.node: r.component for r in components(spark.createDataFrame([*pairs, (None, 3)], "a long, b long")).collect()}
    root = {x: x for p in pairs for x in p}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in pairs:
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    assert got == {x: find(x) for x in root}
    assert components(spark.createDataFrame([], "a long, b long")).collect() == []


def test_vectors_match_brute_force(spark):
    rng = np.random.default_rng(1)
    centres = rng.standard_normal((12, 24))
    rows, k = [], 0
    for c in range(12):
        for _ in range(40 if c == 0 else 5):
            rows.append((k, [float(x) for x in centres[c] + rng.standard_normal(24) * 0.06], c % 3))
            k += 1
    rows += [(k + i, rows[0][1], 0) for i in range(30)]
    k += 30
    odd = [(k, None, 0), (k + 1, [0.0] * 24, 0), (k + 2, [float("nan")] * 24, 0), (k + 3, [1.0, None], 1), (k + 4, rows[0][1], None), (k + 5, [], 1), (k + 6, [1.0], 1), (None, rows[0][1], 0)]
    df = spark.createDataFrame(rows + odd, "vec_id long, embedding array<double>, label int").selectExpr("*", "'d' AS digest", "1 AS keys").repartition(3)
    got = {r.vec_id: r for r in embedding_dedup.near_duplicate_vectors(df).collect()}
    assert len(got) == len(rows) + len(odd)
    x = np.array([r[1] for r in rows])
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    like = (x @ x.T >= 0.98) & (np.array([r[2] for r in rows])[:, None] == np.array([r[2] for r in rows])[None, :])
    np.fill_diagonal(like, False)
    hot = np.array([like[0, i] or i == 0 or np.array_equal(x[i], x[0]) for i in range(len(rows))])
    for i, r in enumerate(rows):
        assert got[r[0]].n_links == like[i].sum() + hot[i], i  # the row without id is a copy of the first
        seen, todo = {i}, [i]
        while todo:
            new = set(np.flatnonzero(like[todo.pop()]).tolist()) - seen
            seen |= new
            todo += new
        assert got[r[0]].component_id == min(seen) and got[r[0]].kept == (i == min(seen))
    assert all((got[r[0]].n_links, got[r[0]].component_id) == (0, r[0]) for r in odd[:-1])
    assert embedding_dedup.near_duplicate_vectors(df.where("false")).collect() == []


def test_fingerprints_and_their_neighbours(spark, docs):
    rows = sorted(((r.doc_id, r.text or "") for r in docs.collect()), reverse=True)
    got = {r.doc_id: r for r in fingerprints.fingerprint_documents(docs, piece_bytes=1 << 14).collect()}
    for k, (i, text) in enumerate(rows):
        half = len(text) // 2
        edited = text[: len(text) - half] + rows[(k + 1) % len(rows)][1][:half]
        assert (got[i].n_chars, got[i].edited_sha256) == (len(text), hashlib.sha256(edited.encode()).hexdigest())
        assert got[i].edited_fingerprint == fingerprints.fingerprints(pa.array([edited]))[0].tobytes().hex()
    prints = np.array([np.frombuffer(bytes.fromhex(got[i].fingerprint), np.uint64) for i, _ in rows])
    apart = np.bitwise_count(prints[:, None, :] ^ prints[None, :, :]).sum(2)
    assert [got[i].n_near for i, _ in rows] == ((apart <= 7).sum(1) - 1).tolist() and (apart <= 7).sum() > len(rows)
    long = [i for i, t in rows if len(t) > 300]
    assert np.mean([got[i].near_edited > got[i].near_next for i in long]) > 0.99


def test_fingerprints_of_messy_rows(messy, nothing):
    got = fingerprints.fingerprint_documents(messy).collect()
    assert len(got) == messy.count()
    assert len({r.fingerprint for r in got if r.n_chars == 77}) == 1 and {r.fingerprint for r in got if r.n_chars == 0} == {"0" * 64}
    assert fingerprints.fingerprint_documents(nothing).collect() == []
    one = fingerprints.fingerprint_documents(messy.where("doc_id = 8")).collect()
    assert one[0].edited_sha256 == hashlib.sha256(b"ono").hexdigest() and one[0].near_next == 1.0
