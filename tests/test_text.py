"""Text functions on small inputs worked out by hand, and chunking properties."""

import math
import re

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st

from pyspark.sql import functions as F
from sievewell.functions import text as tx


def one(spark, expr, *values):
    names = "abcdefg"[: len(values)]
    schema = ", ".join(f"{n} string" for n in names)
    return spark.createDataFrame([tuple(values)], schema).select(expr.alias("x")).first()["x"]


def test_tokens_are_unicode_words(spark):
    # TR10: letters beyond ASCII stay inside the word
    assert one(spark, tx.tokenize(F.col("a")), "Müde_1 naïve! Ωmega-3²") == ["müde_1", "naïve", "ωmega", "3²"]
    assert one(spark, tx.tokenize(F.col("a")), None) == []


def test_markup_is_removed_in_order(spark):
    text = "<b>See</b> [the page](http://x.y) **bold** _it_ `code` end"
    assert one(spark, tx.tokenize(F.col("a")), text) == ["see", "the", "page", "bold", "it", "end"]


def test_strip_removes_all_whitespace(spark):
    # TR21: a plain trim removes blanks only
    assert one(spark, tx.strip(F.col("a")), "\t\n x \r ") == "x"
    assert one(spark, F.trim(F.col("a")), "\t x ") == "\t x"


def test_sentences(spark):
    assert one(spark, tx.split_sentences(F.col("a")), "One.  Two?\nThree! v1.2 four") == ["One.", "Two?", "Three!", "v1.2 four"]


def words(n, word="w"):
    return " ".join([word] * n) + "."


def test_short_text_has_no_chunk(spark):
    assert one(spark, tx.chunk_text(F.col("a")), "too short") == []
    assert one(spark, tx.chunk_text(F.col("a")), None) == []


def test_chunk_limit_and_overlap(spark):
    # TR13: 190 + 30 + 190: the overlap of 30 and the next sentence exceed the limit unchecked
    a, b, c = words(190, "a"), words(30, "b"), words(190, "c")
    assert one(spark, tx.chunk_text(F.col("a")), f"{a} {b} {c}") == [a, b, f"{b} {c}"]
    assert one(spark, tx.chunk_text(F.col("a")), f"{a} {words(10, 'b')} {c}") == [f"{a} {words(10, 'b')}", f"{words(10, 'b')} {c}"]


def test_long_sentence_is_its_own_chunk(spark):
    a, b = words(500, "a"), words(20, "b")
    assert one(spark, tx.chunk_text(F.col("a")), f"{a} {b}") == [a, b]


@settings(max_examples=15, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.integers(1, 260), min_size=1, max_size=14))
def test_chunks_hold_every_sentence_in_order(spark, sizes):
    sentences = [" ".join([f"s{i}"] * n) + "." for i, n in enumerate(sizes)]
    text = " ".join(sentences) + " " + words(60, "end")
    chunks = one(spark, tx.chunk_text(F.col("a")), text)
    seen = [m for c in chunks for m in re.findall(r"(s\d+|end)\.", c)]
    firsts = list(dict.fromkeys(seen))
    assert firsts == [f"s{i}" for i in range(len(sizes))] + ["end"]
    for c in chunks:
        lengths = [len(x.split()) for x in c.split(". ")]
        assert sum(lengths) <= 200 or sum(lengths[:-1]) <= 50


def test_key_terms(spark):
    # TR7: repeats use up slots before duplicates go; ties keep text order
    text = "zebra zebra apple the mango the peach"
    assert one(spark, tx.key_terms(tx.tokenize(F.col("a")), 3), text) == ["zebra", "apple"]
    assert one(spark, tx.key_terms(tx.tokenize(F.col("a")), 4), "bb cccc aaaa the d") == ["cccc", "aaaa", "bb", "d"]


def test_term_counts(spark):
    got = one(spark, tx.term_counts(tx.words(F.col("a"))), "b a b c b a")
    assert [(r["term"], r["tf"]) for r in got] == [("a", 2), ("b", 3), ("c", 1)]
    assert one(spark, tx.term_counts(tx.words(F.col("a"))), "") == []


def test_jaccard(spark):
    sim = tx.jaccard(tx.words(F.col("a")), tx.words(F.col("b")))
    assert one(spark, sim, "a b c", "b c d") == pytest.approx(0.5)
    assert one(spark, sim, "", "") == 0.0


def test_cosine_of_two_texts(spark):
    # TR6: shared terms weigh 1, terms of one side ln(1.5) + 1
    alone = math.log(1.5) + 1
    dot = 2 * 1 + 1 * 1
    norm = math.sqrt(4 + 1 + alone**2) * math.sqrt(1 + 1 + 4 * alone**2)
    sim = tx.tfidf_cosine(tx.words(F.col("a")), tx.words(F.col("b")))
    assert one(spark, sim, "x x y z", "x y q q") == pytest.approx(dot / norm)
    assert one(spark, sim, "x y", "x y") == pytest.approx(1.0)
    assert one(spark, sim, "", "x") == 0.0


def test_preview(spark):
    assert one(spark, tx.preview(F.col("a"), 5), "ab\ncdefg") == "ab cd..."
    assert one(spark, tx.preview(F.col("a"), 5), None) == ""


def test_label_index_orders_by_frequency_then_name(spark):
    from sievewell.operators.features import label_index, with_label_index

    names = [f"l{i:03d}" for i in range(200)]
    data = [(n,) for i, n in enumerate(names) for _ in range(1 + i % 5)] + [(None,)]
    df = spark.createDataFrame(data, "label string").repartition(6)
    want = {n: float(k) for k, n in enumerate(sorted(names, key=lambda n: (-(1 + int(n[1:]) % 5), n)))}
    assert {r["label"]: r["label_index"] for r in label_index(df, "label").collect()} == want
    got = {(r["label"], r["at"]) for r in with_label_index(df, "label", "at").collect()}
    assert got == {*want.items(), (None, 200.0)}


def test_markup_rules_run_only_over_texts_with_their_signs(spark):
    plain = F.col("a")
    for pattern, replacement in tx.P.MARKUP:
        plain = F.regexp_replace(plain, pattern, replacement)
    for text in ["no marks, at all.", "a_b_c", "2 < 3 > 1", "[x](y) *z*", "`code` t", "[**x**](y)", "un*closed", "", None]:
        assert one(spark, tx.clean_markup(F.col("a")), text) == one(spark, plain, text)
    # none of the rules can begin elsewhere, and none brings a sign into a text
    assert all(re.match(tx.P.MARKUP_SIGNS, pattern.lstrip("\\")) for pattern, _ in tx.P.MARKUP)
    assert not any(re.search(tx.P.MARKUP_SIGNS, replacement) for _, replacement in tx.P.MARKUP)
