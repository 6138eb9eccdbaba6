"""Toxicity, quality, pseudo-likelihood, licences, mixing, pieces and the pipeline."""

import hashlib
import math
import pathlib
import random
import re
import textwrap
from collections import Counter, defaultdict

import duckdb
import numpy as np
import pyarrow as pa
import pytest

import corpus_pipeline
from sievewell.llm import licenses, mixing, pieces, pseudo_likelihood, quality_neighbours, queries, toxicity

MODEL = pieces.MODEL


def held_out_accuracy(scored, labels, label):
    rows = scored.join(labels, "doc_id").where("held_out").select("predicted", label).collect()
    return np.mean([r[0] == r[1] for r in rows])


def test_toxicity_learns_and_leaves_clean_texts_alone(spark):
    rnd = random.Random(2)
    plain = ["".join(rnd.choice("bcdfglmnprst") + rnd.choice("aeiou") for _ in range(rnd.randint(1, 4))) for _ in range(400)]
    rows, marks = [], []
    for i in range(600):
        words = [rnd.choice(plain) for _ in range(rnd.randint(5, 200))]
        toxic = i % 5 == 0
        for _ in range(3 if toxic else 0):
            words.insert(rnd.randrange(len(words)), rnd.choice(["idiot", "zworg" + rnd.choice(plain), "m0r0n", "ІDІОТ"]))
        rows.append((i, " ".join(words)))
        marks.append((i, int(toxic)))
    docs, labels = spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(marks, "doc_id long, toxic int")
    model = toxicity.learned(docs, labels)
    assert any(s.startswith("zwor") for s in model.stems)
    assert held_out_accuracy(toxicity.scored(docs, model), labels, "toxic") > 0.98
    kept = {r.doc_id for r in toxicity.without_toxic(docs, model).collect()}
    assert {i for i, t in marks if not t} <= kept


def test_folding_and_exceptions():
    lexicon = toxicity.Lexicon({"idiot": 3.0, "scum": 2.0, "stupid": 1.0}, {"zworg": 4.0})
    weigh = lambda t: toxicity.hits_weight(t, lexicon.automaton())
    assert weigh("1d10t") == weigh("ìdiöt") == weigh("іdіоt") == 3.0 and weigh("IDIOT idiot") == 6.0
    assert weigh("idiots") == 0 and weigh("nonidiot") == 0 and weigh("zworgelte") == 4.0
    assert weigh("pond scum") == 0 and weigh("scum of a pond scum") == 2.0 and weigh("") == 0


@pytest.mark.parametrize("spelt", ["1oser", "a55ho1e", "wor7h1ess", "worth1ess", "id!ot", "|diot id|ot", "lDlOT", "LOSER", "łoser", "so hello!loser"])
def test_spellings_of_insults(spelt):
    automaton = toxicity.Lexicon({toxicity.folded(w): 3.0 for w in toxicity.INSULTS}, {}).automaton()
    assert toxicity.hits_weight(f"you {spelt} you", automaton) == 3.0


def _plain_weight(text, lexicon):
    """Every entry tried at every place of the folded text."""

    def read(t):
        inside = lambda k: 0 <= k < len(t) and t[k].isalnum()
        at = lambda e: [k for k in range(len(t) - len(e) + 1) if t.startswith(e, k) and not inside(k - 1)]
        free = [(k, k + len(e)) for e in map(toxicity.folded, lexicon.exceptions) for k in at(e) if not inside(k + len(e))]
        hits = {}
        for entries, open_end in ((lexicon.words, False), (lexicon.stems, True)):
            for entry, weight in entries.items():
                e = toxicity.folded(entry)
                for k in at(e):
                    if open_end or not inside(k + len(e)):
                        hits.setdefault(k, []).append((weight, k + len(e)))
        return sum(max(x)[0] for k, x in hits.items() if not any(a <= k and max(x)[1] <= b for a, b in free))

    low = toxicity.folded(text)
    return max(read(low), read(re.sub(r"(?<=\w)[!|](?=\w)", "i", low)))


def test_the_automaton_agrees_with_a_plain_search():
    rnd = random.Random(21)
    pieces_ = ["idiot", "1d1ot", "scum", "pond", "Pond", "scumbag", "loser", "sore", "ioser", "stu", "stupid", "mistake", " ", " ", " ", ".", "!", "|", "x", "і", "é", "\n", "trash", "can"]
    lexicon = toxicity.Lexicon({"idiot": 3.0, "scum": 2.0, "loser": 1.5, "stupid": 1.0, "trash": 0.5}, {"stup": 0.75, "scumb": 4.0, "ix": 0.25})
    automaton = lexicon.automaton()
    for _ in range(1500):
        text = "".join(rnd.choice(pieces_) for _ in range(rnd.randint(0, 25)))
        assert toxicity.hits_weight(text, automaton) == pytest.approx(_plain_weight(text, lexicon)), text


def test_the_lexicon_does_not_depend_on_the_order_of_rows(spark, docs, labels):
    more = docs.unionByName(docs.where("doc_id % 5 = 0").selectExpr("doc_id", "concat(text, ' again') AS text", "lang", "source", "n_chars"))  # ids that repeat
    one = toxicity.learned(more.repartition(2), labels)
    assert all(toxicity.learned(more.repartition(n, "lang"), labels.repartition(3)) == one for n in (7, 13))


def test_toxicity_of_messy_rows(spark, messy, nothing, labels):
    model = toxicity.learned(nothing, labels.where("false"))
    got = toxicity.scored(messy, model).collect()
    assert len(got) == messy.count() and all(0 <= r.score <= 1 and r.predicted == 0 for r in got)
    assert toxicity.scored(nothing, model).collect() == []
    kept = toxicity.without_toxic(messy, model)
    assert kept.columns == messy.columns and kept.count() == messy.count()
    assert toxicity.learned(messy, spark.createDataFrame([(1, None), (None, 1)], "doc_id long, toxic int")).stems == {}


def test_quality_by_neighbours(docs, labels, messy, nothing):
    model = quality_neighbours.fitted(docs, labels)
    assert held_out_accuracy(quality_neighbours.scored(docs, model), labels, "quality") > 0.95
    counts = quality_neighbours.term_counts(pa.array([r.text for r in docs.limit(40).collect()]))
    like = model.project(counts) @ model.vectors.T
    for k, row in enumerate(like):  # against a plain search
        near = np.flatnonzero(np.round(row, 12) >= np.sort(np.round(row, 12))[-15])
        w = np.clip(np.round(row[near], 12), 0, None) ** 4
        assert abs(model.votes(counts[k : k + 1], 15)[0] - (w * model.labels[near]).sum() / w.sum()) < 1e-9
    got = quality_neighbours.scored(messy, model).collect()
    assert len(got) == messy.count() and {r.score for r in got if r.doc_id in (4,)} == {model.prior}
    assert quality_neighbours.scored(nothing, model).collect() == []
    empty = quality_neighbours.fitted(nothing, labels)
    assert {r.score for r in quality_neighbours.scored(messy, empty).collect()} == {0.5}


def test_pseudo_likelihood(spark, messy, nothing):
    rnd = random.Random(4)
    # after "a" comes "b", before "d" comes "c": only the sides tell
    texts = [" ".join(rnd.choice(["a b", "c d", "e f g"]) for _ in range(60)) for _ in range(200)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    net = pseudo_likelihood.fitted(docs, rounds=3)
    shuffled = []
    for i, t in enumerate(texts):
        words = t.split()
        rnd.shuffle(words)
        shuffled.append((i, " ".join(words)))
    own = {r.doc_id: r for r in pseudo_likelihood.scored(docs, net).collect()}
    other = {r.doc_id: r for r in pseudo_likelihood.scored(spark.createDataFrame(shuffled, "doc_id long, text string"), net).collect()}
    assert np.mean([own[i].mean_log_prob > other[i].mean_log_prob for i in own]) > 0.99
    # the sum over one document, word by word
    h, kinds, bounds = pseudo_likelihood.words_of(pa.array([texts[0]]))
    ids = net.ids(h, kinds)
    vectors, bias, out, base = pseudo_likelihood.layers(net.weights, net.tokens, 16)
    total = 0.0
    for k in range(len(ids)):
        z = bias.astype(float).copy()
        for j in range(1, 4):
            z += vectors[j - 1][ids[k - j] if k >= j else 0] + vectors[2 + j][ids[k + j] if k + j < len(ids) else 0]
        logits = np.tanh(z) @ out + base
        total += logits[ids[k]] - np.log(np.exp(logits - logits.max()).sum()) - logits.max() + (net.within[kinds[k]] if ids[k] <= 32 else 0)
    assert abs(total - own[0].log_prob) < 1e-3 * abs(total)
    got = pseudo_likelihood.score_documents(messy).collect()
    assert len(got) == messy.count() and {(r.n_words, r.log_prob) for r in got if r.doc_id in (4, 5)} == {(0, 0.0)}
    assert pseudo_likelihood.score_documents(nothing).collect() == []


@pytest.mark.parametrize("size", [0.5, 40.0])  # outputs that fit a float as they are, and some that do not
def test_pseudo_likelihood_works_in_blocks_that_stay_in_cache(size):
    rng, n = np.random.default_rng(3), 2 * pseudo_likelihood.ROWS + 77
    h = np.ones((n, 17), np.float32)
    h[:, :-1] = np.tanh(rng.normal(size=(n, 16)) * 3)
    out, base, own = (rng.normal(size=(16, 90)) * size).astype(np.float32), rng.normal(size=90).astype(np.float32), rng.integers(0, 90, n)
    assert max(len(z) for _, z in pseudo_likelihood._outputs(h, out, base)) == pseudo_likelihood.ROWS
    z = h[:, :-1].astype(float) @ out + base
    p = np.exp(z - z.max(1, keepdims=True))
    p /= p.sum(1, keepdims=True)
    assert np.allclose(pseudo_likelihood._chances(h, out, base, own), (z - z.max(1, keepdims=True))[np.arange(n), own] - np.log(np.exp(z - z.max(1, keepdims=True)).sum(1)), atol=2e-3)
    p[np.arange(n), own] -= 1
    dh, by_weight, by_base = pseudo_likelihood._pulls(h, out, base, own)
    assert np.allclose(dh, p @ out.T, atol=2e-3 * size) and np.allclose(by_weight, h[:, :-1].T @ p / n, atol=1e-4) and np.allclose(by_base, p.mean(0), atol=1e-4)


def test_pseudo_likelihood_learns_rare_words_at_one_rate(spark):
    rnd = random.Random(5)
    # each of 300 words has one word that follows it; the pairs stand in any order
    pairs = [f"{chr(97 + i % 26)}x{i} {chr(97 + i % 26)}y{i}" for i in range(300)]
    texts = [" ".join(rnd.choice(pairs) for _ in range(60)) + f" once{i:05d}" for i in range(1200)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(2)
    assert pseudo_likelihood.fitted(docs, rounds=0).tokens == 33 + math.isqrt(1200 * 121)
    assert pseudo_likelihood.fitted(docs, rounds=0, most_words=50).tokens == 33 + 50
    one = pseudo_likelihood.fitted(docs.repartition(4), vocabulary=50, rounds=1, replicas=1)  # one copy reads all partitions
    assert one.weights.shape == pseudo_likelihood.fitted(docs, vocabulary=50, rounds=0).weights.shape
    net = pseudo_likelihood.fitted(docs, vocabulary=600, rounds=4)
    shuffled = [(i, " ".join(rnd.sample(t.split(), 121))) for i, t in enumerate(texts)]
    own = {r.doc_id: r.log_prob for r in pseudo_likelihood.scored(docs, net).collect()}
    other = {r.doc_id: r.log_prob for r in pseudo_likelihood.scored(spark.createDataFrame(shuffled, "doc_id long, text string"), net).collect()}
    assert np.mean([own[i] > other[i] for i in own]) > 0.99
    # chances of all words after one place sum to one, over all classes
    h, kinds, bounds = pseudo_likelihood.words_of(pa.array([texts[0]]))
    ids = net.ids(h, kinds)
    assert (ids <= 32).sum() == 1 and pseudo_likelihood.class_count(net.tokens) > 4
    total = 0.0
    for token in range(net.tokens):
        row = pseudo_likelihood.edged(np.array([*ids[:5], token, *ids[6:9]], np.int32), np.array([0, 9]))[0]
        total += np.exp(pseudo_likelihood.log_likelihoods(net.weights, net.tokens, 16, row)[5]) if token else 0
    assert abs(total - 1) < 1e-3
    # one window in seven, also of few texts; a sequence that comes again is picked by its place
    piece = pa.record_batch([pa.array([1, 2, None]), pa.array(["a b c d e f g " * 700] * 3)], names=["doc_id", "text"])
    got = next(pseudo_likelihood._tokens_of(net, 7)([piece])).column("chosen")[0].as_py()
    places = np.frombuffer(got, np.int32)
    assert abs(len(places) / (3 * 4900) - 1 / 7) < 0.02 and len(set(places % 7)) == 7


def test_pseudo_likelihood_gives_common_words_small_classes():
    starts = pseudo_likelihood.class_starts(9233)
    sizes = np.diff(starts)
    assert starts[0] == 0 and starts[1] == 33 and starts[-1] == 9233 and (sizes > 0).all() and (np.diff(sizes[1:-1]) >= 0).all()
    # outputs of a window, where the n-th commonest word stands in proportion to 1 / n; classes of 128 take 201
    share = 1 / np.arange(1, 9201)
    own = np.repeat(sizes, sizes)[33:]
    assert len(sizes) + (own * share).sum() / share.sum() < 150
    assert pseudo_likelihood.class_count(128) == 1 and pseudo_likelihood.class_count(129) > 2


def test_pseudo_likelihood_sums_rows_by_token():
    rng = np.random.default_rng(6)
    few = pseudo_likelihood.FEW_ROWS
    part = rng.permutation(np.concatenate([np.full(3 * few + 5, 7), np.full(pseudo_likelihood.FEW + 1, 3), np.full(pseudo_likelihood.FEW, 2), np.repeat(np.arange(100, 100 + 2 * few), 2), np.arange(5000, 5000 + few)])).astype(np.int32)
    around = rng.normal(size=(len(part), 112)).astype(np.float32)
    tokens, counts, sums = pseudo_likelihood._sums_by_token(around, part, 9233)
    assert sorted(tokens.tolist()) == np.unique(part).tolist()
    for token, n, row in zip(tokens, counts, sums, strict=True):
        assert n == (part == token).sum() and np.allclose(row, around[part == token].astype(float).sum(0), atol=1e-3)


def test_pseudo_likelihood_scores_from_stored_tokens_as_from_texts(spark, messy):
    rows = lambda df: sorted(((r.doc_id is None, r.doc_id or 0, r.n_words, r.log_prob) for r in df.collect()))
    own, other = rows(pseudo_likelihood.score_documents(messy)), rows(pseudo_likelihood.scored(messy, pseudo_likelihood.fitted(messy)))
    assert [r[:3] for r in own] == [r[:3] for r in other] and len(own) == messy.count()
    assert np.allclose([r[3] for r in own], [r[3] for r in other], rtol=1e-3)


def test_licenses(spark, messy, nothing):
    full = licenses.KNOWN[7][1]
    rows = [(1, "Copyright (c) 2020 A. Person\nCOPYRIGHT B\n\n" + full.upper().replace("LICENSE", "LICENCE")), (2, full + " And more."), (3, "x\nLicenced under the apache licence — version 2.0\ny")]
    got = {r.doc_id: r for r in licenses.scan_licenses(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert (got[1].license_id, got[2].license_id, got[3].license_id) == ("MIT", None, None)
    assert got[3].notices == "Apache-2.0"
    rows = licenses.scan_licenses(messy).collect()
    assert len(rows) == messy.count() and {r.license_id for r in rows} == {None}
    assert licenses.scan_licenses(nothing).collect() == []


def test_wrapped_and_titled_licenses(spark):
    mit, isc = licenses.KNOWN[7][1], licenses.KNOWN[8][1]
    wrapped = lambda text, first: re.sub(rf"(?i) ({first})", r"\n\1", text)
    folder = pathlib.Path(licenses.__file__).parent / "known_licenses"
    whole = lambda name: (folder / f"{name}.txt").read_text()
    bsd = whole("BSD-2-Clause")
    # paragraphs wrapped anew, but for those of notices, which end with their line
    filled = lambda text, n: "\n\n".join(x if re.search(r"(?i)copyright (\(c\)|\[)", x) else textwrap.fill(x, n) for x in re.split(r"\n\s*\n", text))
    cases = [
        ("ISC", "Copyright 2020 A. Person\n\n" + wrapped(isc, "copyright notice")), ("ISC", "ISC License\n\nCopyright (c) 2020 A. Person\r\n\r\n" + wrapped(isc, "copyright notice")),
        ("MIT", "MIT License\n\nCopyright (c) 2020 A. Person\n\n" + wrapped(mit, "copyright holders")), ("MIT", "The MIT License (MIT)\n\n© A. Person\nAll rights reserved.\n\n" + textwrap.fill(mit, 50)),
        ("MIT", wrapped(mit, "copyright notice")), ("Unlicense", whole("Unlicense")), ("Unlicense", filled(whole("Unlicense"), 41)), ("Apache-2.0", whole("Apache-2.0")),
        ("Apache-2.0", filled(whole("Apache-2.0"), 61)), ("Apache-2.0", whole("Apache-2.0").split("APPENDIX")[0]), ("GPL-3.0", whole("GPL-3.0")), ("GPL-2.0", filled(whole("GPL-2.0").split("\n\n", 1)[1], 47)),
        ("MPL-2.0", whole("MPL-2.0")), ("CC0-1.0", whole("CC0-1.0")), ("CC-BY-SA-4.0", whole("CC-BY-SA-4.0")), ("BSD-2-Clause", "Copyright (c) 2001, B\nAll rights reserved.\n\n" + bsd[bsd.index("Redistribution") :]),
        (None, "MIT License"), (None, "Copyright (c) 2020 A. Person"), (None, isc.replace("copyright notice", "")),
    ]
    docs = spark.createDataFrame([(i, text) for i, (_, text) in enumerate(cases)], "doc_id long, text string")
    got = {r.doc_id: r.license_id for r in licenses.scan_licenses(docs).collect()}
    assert [(i, got[i]) for i in range(len(cases))] == [(i, want) for i, (want, _) in enumerate(cases)]


def test_long_runs_of_notices(spark):
    mit = licenses.KNOWN[7][1]
    for end in ("\n", "\r\n"):
        run = end.join(f"Copyright (c) {1990 + i % 30} Person {i}" if i % 3 else f"copyright Person {i}" if i % 2 else "All rights reserved." for i in range(100_000))
        docs = spark.createDataFrame([(1, "MIT License" + end * 2 + "(c) 2020 A" + end + run + end * 2 + mit), (2, run), (3, " \t" * 200_000 + "x"), (4, "\n " * 200_000 + "copyright X")], "doc_id long, text string")
        got = {r.doc_id: r for r in licenses.scan_licenses(docs).collect()}
        assert got[1].license_id == "MIT" and [got[i].license_id for i in (2, 3, 4)] == [None] * 3
        assert got[4].digest == hashlib.sha256(b"").hexdigest()


def test_the_sql_knows_whole_licences_and_the_notice_rule(spark):
    mit, isc = licenses.KNOWN[7][1], licenses.KNOWN[8][1]
    rnd = random.Random(9)
    parts = ["Copyright (c) 2020 A", "copyright A. Person", "Copyright Holders of X, 2020", "all rights reserved.", "", " \t", "© B", "(C) Copyright 1999", "copyright notice of this", "text", "copyright\x01x", "Licenced under CC BY 4.0", "x (c) y\r"]
    texts = ["\n".join(rnd.choice(parts) for _ in range(rnd.randint(0, 7))) + rnd.choice(["", "\n\n" + mit, "\n" + isc]) for _ in range(400)]
    texts += [t for _, t in licenses.known_texts()] + [textwrap.fill(t, 60) for _, t in licenses.known_texts()[::7]] + [None, "é ✓", "This work is licensed under the GNU General Public License, version 3.\r\n\x01x"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    con = duckdb.connect()
    con.register("documents", pa.table({"doc_id": list(range(len(texts))), "text": texts}))
    got = sorted((r.doc_id, r.digest, r.license_id or "", r.notices) for r in licenses.scan_licenses(docs).collect())
    want = sorted((a, b, c or "", d) for a, b, c, d in con.sql(f"SELECT doc_id, digest, license_id, notices FROM ({licenses.scan_sql()})").fetchall())
    assert got == want and len({c for _, _, c, _ in got}) > 15


def test_license_sql(spark, sf, docs):
    con = duckdb.connect()
    con.sql(f"CREATE VIEW documents AS SELECT * FROM '{sf}/documents.parquet'")
    want = sorted(con.sql(queries.oracle_sql()["op3_license_scan"]).fetchall())
    got = sorted((r.doc_id, r.digest, r.license_id, r.notices) for r in queries.queries()["op3_license_scan"](spark, sf).collect())
    assert got == want


def reshared(sizes, weights, share=1.5, ceiling=2.0):
    """The contract's own procedure: share out, stop at the ceiling, share the excess again."""
    left, active, target = share * sum(sizes.values()), set(sizes), {}
    while active:
        level = left / sum(weights[s] for s in active)
        over = [s for s in active if level * weights[s] > ceiling * sizes[s]]
        if not over:
            break
        for s in over:
            target[s] = ceiling * sizes[s]
            left -= target[s]
            active.discard(s)
    return target | {s: level * weights[s] for s in active}


@pytest.mark.parametrize("seed", range(4))
def test_mix(spark, seed):
    rnd = random.Random(seed)
    names = [*rnd.sample(["a", "b", "Z", "é", "ß", "zz", "𝒜", "0"], rnd.randint(2, 7)), None]
    rows = [(i, " ".join("w" for _ in range(rnd.choice([0, 1, 2, 3, 5, 8, 13, 400]))), rnd.choice(names + names[:1] * 4)) for i in range(400)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string").repartition(3)
    got = mixing.mix_documents(df).collect()
    sizes = defaultdict(int)
    for _, t, s in rows:
        sizes[s] += len(t.split())
    order = sorted(sizes, key=lambda s: (s is None, [ord(c) for c in s or ""]))
    target = reshared(sizes, {s: (5, 2, 1)[k % 3] for k, s in enumerate(order)})
    source = {i: s for i, _, s in rows}
    taken = defaultdict(int)
    for r in got:
        assert r.source_size == sizes[source[r.doc_id]] and r.target == pytest.approx(target[source[r.doc_id]]) and r.taken in (0, r.size, 2 * r.size)
        taken[source[r.doc_id]] += r.taken
    for s in sizes:
        base = int(target[s] // sizes[s]) if sizes[s] else 0
        near = round(target[s] - base * sizes[s])
        reach = 1
        for _, t, of in rows:
            reach |= reach << len(t.split()) if of == s else 0
        best = max(x for x in range(near + 1) if reach >> x & 1)
        assert taken[s] == base * sizes[s] + best
    assert {tuple(r) for r in got} == {tuple(r) for r in mixing.mix_documents(df.repartition(5)).collect()}


def test_fitted_counts_reach_the_best_sum():
    for seed in range(200):
        rnd = random.Random(seed)
        lengths = np.array(sorted(rnd.sample(range(30), rnd.randint(1, 6)), reverse=True))
        counts = np.array([rnd.randint(1, 4) for _ in lengths])
        budget = rnd.randint(0, 60)
        got = mixing.fitted_counts(lengths, counts, budget)
        sums = {0}
        for a, n in zip(lengths, counts, strict=True):
            sums = {x + a * j for x in sums for j in range(n + 1)}
        assert (got >= 0).all() and (got <= counts).all()
        assert int((got * lengths).sum()) == max(x for x in sums if x <= budget)


def test_mix_of_messy_rows(messy, nothing):
    got = mixing.mix_documents(messy).collect()
    assert len(got) == messy.count() and all(r.taken <= 2 * r.size for r in got)
    assert {(r.size, r.taken) for r in got if r.doc_id in (4, 5)} == {(0, 0)}
    assert mixing.mix_documents(nothing).collect() == []
    out = mixing.mixed_documents(messy)
    assert out.columns == messy.columns and out.where("doc_id = 4").count() == 1


def test_pieces_are_the_library_s(spark, docs, messy, nothing):
    import sentencepiece

    lib = sentencepiece.SentencePieceProcessor(model_file=MODEL)
    rnd = random.Random(1)
    odd = ["".join(rnd.choice("abcdeé ▁\n\t中文😀thingre0123  ") for _ in range(rnd.randint(0, 80))) for _ in range(300)]
    odd += ["a" * 3000, "ab" * 400 + "\n" + "x" * 700, "", " ", "   ", "🎉" * 40, None]
    rows = [(i, t) for i, t in enumerate([*odd, *(r.text for r in docs.collect())])]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r.doc_id: r for r in pieces.encode_documents(df).collect()}
    assert all(list(got[i].ids) == lib.encode(t or "") for i, t in rows)
    assert all(got[i].round_trip == ("▁" not in (t or "")) for i, t in rows)
    back = pieces.decoded(pieces.encoded(df)).collect()
    assert all(r.text == (dict(rows)[r.doc_id] or "").replace("▁", " ") for r in back)
    out = pieces.encoded(messy)
    assert set(out.columns) == {*messy.columns} - {"text"} and out.count() == messy.count()
    assert pieces.encoded(nothing).collect() == []
    back = pieces.decoded(spark.createDataFrame([(None,), ([],)], "ids array<int>")).collect()
    assert [r.text for r in back] == [None, ""]


@pytest.mark.parametrize("kind", ["bpe", "unigram"])
def test_the_relational_lattice_agrees_with_the_arrays(spark, docs, kind):
    table = pieces.load_pieces()
    table = pieces.Pieces(table.texts, table.ids, [s / 100 for s in table.scores], table.byte_ids, table.unknown_id, kind, table.names)
    words = pieces.common_words(docs, 400, 100)
    got = {r.word: list(r.ids) for r in pieces.encode_words(words, table).collect()}
    lattice = pieces.Lattice(table, {})
    for word, ids in got.items():
        raw = np.frombuffer(word.replace(pieces.SPACE, " ").encode(), np.uint8)
        ends = np.array([len(raw)])
        mine, _ = lattice.encode(raw, ends * 0, ends, pieces.span_hashes(raw, ends * 0, ends))
        assert pieces.UNKNOWN in ids or ids == mine.tolist(), word


def test_every_word_goes_through_the_join(spark):
    import sentencepiece

    lib, table = sentencepiece.SentencePieceProcessor(model_file=MODEL), pieces.load_pieces()
    words = ["▁中文😀", "▁~~~a", "▁" + "a" * 700, "▁nothingelse.", "▁🎉🎉x", "▁", ""]
    got = {r.word: list(r.ids) for r in pieces.encode_words(spark.createDataFrame([(w,) for w in words], "word string"), table).collect()}
    assert got == {w: lib.encode(w[1:]) for w in words if len(w) > 1} | {"▁": [i for i, n in table.names.items() if n == "▁"]}
    df = spark.createDataFrame([(1, "rare words zyxwq"), (2, None), (3, "")], "doc_id long, text string")
    plan = pieces.encoded(df)._jdf.queryExecution().optimizedPlan().toString()
    assert "Join LeftOuter" in plan and "FlatMapCoGroupsInArrow" in plan


def test_unigram_words_by_the_join(spark):
    rnd = random.Random(8)
    texts = ["a", "b", "c", "ab", "bc", "abc", "ca", "cab", "bca"]
    table = pieces.Pieces(texts, list(range(3, 12)), [-rnd.random() * 5 for _ in texts], {}, 0, "unigram", {})
    lattice = pieces.Lattice(table, {})
    words = sorted({"".join(rnd.choice("abcx") for _ in range(rnd.randint(1, 9))) for _ in range(60)})
    got = {r.word: list(r.ids) for r in pieces.encode_words(spark.createDataFrame([(w,) for w in words], "word string"), table).collect()}
    for word in words:
        codes = np.frombuffer(word.encode("utf-32-le"), np.uint32).astype(np.uint64)[None, :]
        ids, n = lattice.paths(codes, len(word))
        assert got[word] == lattice.with_bytes(ids[0, : n[0]][::-1], word).tolist()


def test_viterbi_against_all_paths():
    rnd = random.Random(7)
    texts = ["a", "b", "c", "ab", "bc", "abc", "ca", "cab", "bca"]
    table = pieces.Pieces(texts, list(range(3, 12)), [-rnd.random() * 5 for _ in texts], {}, 0, "unigram", {})
    score = dict(zip(texts, table.scores, strict=True)) | {"x": table.unknown_score}

    def best(word):
        if not word:
            return 0.0
        return max(score[word[:k]] + best(word[k:]) for k in range(1, min(3, len(word)) + 1) if word[:k] in score)

    lattice = pieces.Lattice(table, {})
    for _ in range(60):
        word = "".join(rnd.choice("abcx") for _ in range(rnd.randint(1, 9)))
        codes = np.frombuffer(word.encode("utf-32-le"), np.uint32).astype(np.uint64)[None, :]
        ids, n = lattice.paths(codes, len(word))
        assert sum(table.unknown_score if i == pieces.UNKNOWN else table.scores[i - 3] for i in ids[0, : n[0]]) == pytest.approx(best(word))


def test_pipeline(spark, sf, docs):
    assert [len(s) for s in corpus_pipeline.STAGES] == [2] * 5
    import sentencepiece

    model = toxicity.learned(docs, spark.read.parquet(f"{sf}/labels.parquet"))
    lexicon = toxicity.Lexicon(model.words, model.stems, model.exceptions, model.bias, model.gain, model.per_length)
    now, kept = docs, None
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        before, now = [(r.doc_id, r.text) for r in now.collect()] if k < 4 else before, stage(spark, now, sf).persist()
        if k < 4:
            assert now.columns == docs.columns
            after = [(r.doc_id, r.text) for r in now.collect()]
        if k == 0:  # by a plain search of all entries
            weight = np.array([_plain_weight(t or "", lexicon) for _, t in before], float)
            words = np.array([len(re.findall(r"(?:[A-Za-z0-9_]|[^\x00-\x7f])+", t or "")) for _, t in before], float)
            assert sorted(after) == sorted(r for r, s in zip(before, toxicity._scores(lexicon, weight, words), strict=True) if s < 0.7)
            assert len(after) < len(before)
        if k == 1:
            stay = _one_of_each_group(before)
            assert sorted(after) == sorted(r for r in before if r[0] in stay) and len(after) < len(before)
        if k == 2:
            assert sorted((i, t or "") for i, t in after) == _without_repeats(before)
            assert {i for i, _ in after} == {i for i, _ in before}
        if k == 3:  # as often as the mix of these very rows takes them
            takes = {r.doc_id: r.taken // r.size if r.size else None for r in mixing.mix_documents(spark.createDataFrame(stage_rows, docs.schema)).collect()}
            times = Counter(i for i, _ in after)
            assert all(n is None or times[i] == n for i, n in takes.items()) and set(after) <= set(before)
            kept = now
        if k == 2:
            stage_rows = now.collect()
    lib = sentencepiece.SentencePieceProcessor(model_file=MODEL)
    encoded = Counter((r.doc_id, tuple(r.ids)) for r in now.collect())
    assert encoded == Counter((r.doc_id, tuple(lib.encode(r.text or ""))) for r in kept.collect())
    assert now.count() == kept.count() and sum(r.n_pieces for r in now.collect()) > 0
    got = sorted((r.doc_id, tuple(r.ids)) for r in corpus_pipeline.run(spark, sf).collect())
    assert got == sorted((r.doc_id, tuple(r.ids)) for r in now.collect())


def _without_repeats(rows, window=50):
    """(id, text without the bytes that a 50-byte string of a smaller id covers), by hand."""
    first = {}
    texts = [(i, (t or "").encode()) for i, t in rows]
    for i, t in texts:
        for s in range(len(t) - window + 1):
            k = t[s : s + window]
            first[k] = min(first.get(k, i), i)
    out = []
    for i, t in texts:
        gone = np.zeros(len(t), bool)
        for s in range(len(t) - window + 1):
            if first[t[s : s + window]] < i:
                gone[s : s + window] = True
        out.append((i, np.frombuffer(t, np.uint8)[~gone].tobytes().decode("utf-8", "replace")))
    return sorted(out)


def _one_of_each_group(rows):
    """Ids that stay when of texts of likeness 0.8 or more, linked through others too, the smallest id does."""
    from .test_dedup import shingle_set

    sets = {i: shingle_set(t) for i, t in rows}
    holders, root = defaultdict(set), {i: i for i in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i, s in sets.items():
        for x in s:
            holders[x].add(i)
    for i, s in sets.items():
        common = defaultdict(int)
        for x in s:
            for j in holders[x]:
                if j < i:
                    common[j] += 1
        for j, n in common.items():
            if n >= 0.8 * (len(s) + len(sets[j]) - n) - 1e-9:
                a, b = find(i), find(j)
                root[max(a, b)] = min(a, b)
    return {i for i in sets if find(i) == i}


def test_every_query_is_there():
    assert sorted(int(re.match(r"op(\d+)_", q)[1]) for q in queries.queries()) == list(range(1, 14))
