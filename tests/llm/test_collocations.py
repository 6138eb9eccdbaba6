import random
import re
from collections import Counter

import numpy as np
import pytest

from sievewell.llm.collocations import KeySet, _summed, collocations, count_phrases, frequent_phrases, key_set

FULL = KeySet(16, np.full(8192, 255, np.uint8))
WORD = re.compile(r"[^\x20\x09]+")


def _brute(rows, least=3, longest=5, within=100, best=2000):
    counts, totals = {}, Counter()
    for lang, text in rows:
        lang = "und" if lang is None else lang
        low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", low):
            words = WORD.findall(piece)
            totals[lang] += len(words)
            for m in range(1, longest + 1):
                for i in range(len(words) - m + 1):
                    counts.setdefault(lang, Counter())[tuple(words[i : i + m])] += 1
    out = []
    for lang, f in counts.items():
        some = {p: a for p, a in f.items() if len(p) > 1 and a >= least}
        ranked = []
        for p, a in some.items():
            if any(len(q) > len(p) and 100 * b >= within * a and any(q[i : i + len(p)] == p for i in range(len(q))) for q, b in some.items()):
                continue
            score, _, left, right = min((1000 * a * totals[lang] // (f[p[:k]] * f[p[k:]]), k, f[p[:k]], f[p[k:]]) for k in range(1, len(p)))
            ranked.append((-score, -a, " ".join(p).encode(), left, right))
        for i, (s, a, p, left, right) in enumerate(sorted(ranked)[:best], 1):
            out.append((lang, i, p.decode(), -a, left, right, totals[lang], -s))
    return sorted(out)


@pytest.mark.parametrize("share,slack", [(2, 0.4), (5, 3.0), (1000, 1.0)])
def test_equals_brute_force_whatever_the_sample_proposes(docs, share, slack):
    some = docs.where("doc_id < 60")
    want = _brute([(r["lang"], r["text"]) for r in some.collect()])
    assert want
    assert sorted(map(tuple, collocations(some, 3, share=share, slack=slack).collect())) == want


def test_a_failing_border_is_counted_in_further_passes(spark):
    text = "a b c d e f " * 30
    few = spark.createDataFrame([(1, text, "en")], "doc_id long, text string, lang string")
    found, totals, passes = frequent_phrases(few, 5, share=1000, slack=1e9)  # nothing is proposed
    assert passes > 2
    counts = {r["phrase"]: r["n"] for r in found.collect()}
    assert counts["a b c d e"] == 30 and counts["e f"] == 30 and counts["f a b c d"] == 29
    assert [tuple(r) for r in totals.collect()] == [("en", 180)]


def test_what_few_failures_open_is_counted_in_one_pass(spark):
    rows = [(i, "a b c d e. c d. p q r s", "en") for i in range(40)] + [(100 + i, "a b c d e f g h", "de") for i in range(60)]
    # one long document that no sample of one in 20 need hold: all its phrases fail
    rows += [(1000, "v w x y z. " * 30 + "w x y z v. " * 30, "en")]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string").repartition(3)
    for share in (2, 3, 4, 20):
        found, _, passes = frequent_phrases(df, 30, share=share, slack=0.5)
        assert passes <= 3
        counts = {(r["lang"], r["phrase"]): r["n"] for r in found.collect()}
        assert counts["en", "v w x y z"] == counts["en", "x y z v"] == 30 and counts["en", "w x y z"] == 60 and counts["de", "d e f g h"] == 60
        assert sorted(map(tuple, collocations(df, 30, share=share, slack=0.5).collect())) == _brute([(r[2], r[1]) for r in rows], 30)


@pytest.mark.parametrize("each", [1, 4])
def test_the_last_pass_counts_all_that_was_not(spark, each):
    rnd = random.Random(8)
    texts = [" ".join(rnd.choice("abcdefgh") for _ in range(300)) for _ in range(8)]
    docs = spark.createDataFrame([("en", t) for t in texts], "lang string, text string")
    every = count_phrases(docs, [1, 2, 3, 4, 5], FULL)
    total = {r["phrase"]: (r["n"], r["words"], r["key"]) for r in _summed(every, 3).where("phrase IS NOT NULL").collect()}
    # some are proposed, not always those that would be; a small set holds more than it should
    picked = [(k,) for p, (_, w, k) in total.items() if w < 5 and rnd.randrange(each + 1)]
    now = key_set(spark.createDataFrame(picked, "key long"), 16)
    first = _summed(count_phrases(docs, [1, 2, 3, 4, 5], now), 3).where("phrase IS NOT NULL")
    last = _summed(count_phrases(docs, [1, 2, 3, 4, 5], now, known=key_set(first.where("words < 5"))), 3)
    got = [(r["phrase"], r["n"]) for r in first.unionByName(last).collect()]
    assert len(got) == len(total) and dict(got) == {p: n for p, (n, _, _) in total.items()}


def test_pieces_cases_and_overlaps(spark):
    rows = [(1, "X x\tx  x. x, X!x\n\x0bx", None), (2, "x x", "und"), (3, "É é é É", "fr"), (None, "x x", "fr"), (None, "x x", "fr")]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    assert sorted(map(tuple, collocations(df, 2, share=2).collect())) == _brute([(r[2], r[1]) for r in rows], 2)


def test_messy_rows_and_no_rows(messy, nothing):
    want = _brute([(r["lang"], r["text"]) for r in messy.select("lang", "text").collect()], 50)
    assert sorted(map(tuple, collocations(messy, 50).collect())) == want
    assert collocations(nothing).count() == 0


def test_a_full_key_set_only_counts_more(spark, docs):
    some = docs.where("doc_id < 10").select("lang", "text")
    import numpy as np

    full = KeySet(16, np.full(8192, 255, np.uint8))
    assert count_phrases(some, [2], full).count() >= count_phrases(some, [2], key_set(spark.range(0).selectExpr("id AS key"))).count() == 0
