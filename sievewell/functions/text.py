"""Text functions: every one maps columns to a column and stays inside the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from sievewell.functions import patterns as P


def bind(value: Column, body) -> Column:
    """Evaluate ``value`` once and use it as a variable inside ``body``.

    A lambda body that mentions an outer expression evaluates it per element;
    binding it first keeps the work linear.
    """
    return F.get(F.transform(F.array(value), body), F.lit(0))


def strip(c) -> Column:
    """Remove whitespace of every kind from both ends (``trim`` removes blanks only)."""
    return F.btrim(c, F.lit(P.WHITESPACE))


def blank_to_null(c) -> Column:
    """The value itself, or null when it is null or all whitespace."""
    col = F.col(c) if isinstance(c, str) else c
    return F.when(F.length(strip(col.cast("string"))) > 0, col)


def clean_markup(c: Column) -> Column:
    """Strip HTML tags, links, emphasis and inline code, in that order.

    A text without any of the signs that markup begins with, as most are, is looked through once and not rewritten.
    """
    cleaned = c
    for pattern, replacement in P.MARKUP:
        cleaned = F.regexp_replace(cleaned, pattern, replacement)
    return F.when(c.rlike(P.MARKUP_SIGNS), cleaned).otherwise(c)


def words(c: Column) -> Column:
    """Lower-case Unicode words, markup kept."""
    return F.regexp_extract_all(F.lower(F.coalesce(c, F.lit(""))), F.lit(P.WORD), F.lit(0))


def tokenize(c: Column) -> Column:
    """Lower-case Unicode words of the text without its markup."""
    return words(clean_markup(c))


def count_tokens(c: Column) -> Column:
    return F.size(tokenize(c))


def ascii_words(c: Column) -> Column:
    return F.regexp_extract_all(F.lower(F.coalesce(c, F.lit(""))), F.lit(P.ASCII_WORD), F.lit(0))


def split_sentences(c: Column) -> Column:
    """Cut after ``.``, ``!`` or ``?`` where whitespace follows."""
    return F.split(c, r"(?U)(?<=[.!?])\s+")


def chunk_text(
    c: Column,
    max_tokens: int = P.CHUNK_MAX_TOKENS,
    overlap: int = P.CHUNK_OVERLAP_TOKENS,
    min_chars: int = P.CHUNK_MIN_CHARS,
) -> Column:
    """Pack whole sentences into chunks of at most ``max_tokens`` tokens.

    A chunk that is closed hands its last whole sentences, up to ``overlap``
    tokens, to the next one. A sentence longer than the limit forms its own
    chunk, and overlap plus the next sentence is not checked again, so a chunk
    may exceed the limit. Texts shorter than ``min_chars`` give no chunk.

    One fold over the sentence array; the state holds the closed chunks, the
    open sentences with their token counts, and the open token total.
    """
    sentence_type = "array<struct<s:string,n:int>>"
    sentences = F.transform(
        split_sentences(c), lambda s: F.struct(s.alias("s"), count_tokens(s).alias("n"))
    )
    start = F.struct(
        F.array().cast("array<string>").alias("done"),
        F.array().cast(sentence_type).alias("open"),
        F.lit(0).alias("total"),
    )

    def joined(open_sentences: Column) -> Column:
        return F.array_join(F.transform(open_sentences, lambda x: x["s"]), " ")

    def tail(open_sentences: Column) -> Column:
        """How many trailing sentences fit into the overlap, and their tokens."""
        return F.aggregate(
            F.reverse(open_sentences),
            F.struct(F.lit(0).alias("k"), F.lit(0).alias("n"), F.lit(True).alias("fits")),
            lambda a, x: F.when(
                a["fits"] & (a["n"] + x["n"] <= overlap),
                F.struct((a["k"] + 1).alias("k"), (a["n"] + x["n"]).alias("n"), F.lit(True).alias("fits")),
            ).otherwise(F.struct(a["k"].alias("k"), a["n"].alias("n"), F.lit(False).alias("fits"))),
        )

    def step(state: Column, x: Column) -> Column:
        fits = state["total"] + x["n"] <= max_tokens
        grown = F.struct(
            state["done"].alias("done"),
            F.concat(state["open"], F.array(x)).alias("open"),
            (state["total"] + x["n"]).alias("total"),
        )
        closed = F.when(
            F.size(state["open"]) > 0, F.concat(state["done"], F.array(joined(state["open"])))
        ).otherwise(state["done"])
        fresh = bind(
            tail(state["open"]),
            lambda t: F.struct(
                closed.alias("done"),
                F.concat(
                    F.slice(state["open"], F.size(state["open"]) - t["k"] + 1, t["k"]), F.array(x)
                ).alias("open"),
                (t["n"] + x["n"]).alias("total"),
            ),
        )
        return F.when(fits, grown).otherwise(fresh)

    def finish(state: Column) -> Column:
        return F.when(
            F.size(state["open"]) > 0, F.concat(state["done"], F.array(joined(state["open"])))
        ).otherwise(state["done"])

    packed = F.aggregate(sentences, start, step, finish)
    return F.when(F.length(strip(c)) >= min_chars, packed).otherwise(F.array().cast("array<string>"))


def key_terms(tokens: Column, k: int = P.KEY_TERMS) -> Column:
    """Distinct terms among the ``k`` longest tokens that are no stop words.

    Equal lengths keep text order, and repeats use up slots before the
    duplicates are dropped.
    """
    stop = F.array(*[F.lit(w) for w in P.KEY_TERM_STOP_WORDS])
    kept = F.filter(tokens, lambda t: ~F.array_contains(stop, t))
    keyed = F.transform(
        kept, lambda t, i: F.struct((-F.length(t)).alias("l"), i.alias("i"), t.alias("t"))
    )
    return F.array_distinct(F.transform(F.slice(F.array_sort(keyed), 1, k), lambda x: x["t"]))


def term_counts(tokens: Column) -> Column:
    """array<struct<term, tf>> of a token array: sorted, then measured run by run.

    Counting inside the row needs neither a shuffle nor a hash table.
    """

    def runs(s: Column) -> Column:
        at = F.sequence(F.lit(0), F.size(s) - 1)
        starts = F.filter(at, lambda i: (i == 0) | (F.get(s, i) != F.get(s, i - 1)))
        return bind(
            starts,
            lambda b: F.transform(
                b,
                lambda i, j: F.struct(
                    F.get(s, i).alias("term"), (F.coalesce(F.get(b, j + 1), F.size(s)) - i).alias("tf")
                ),
            ),
        )

    empty = F.array().cast("array<struct<term:string,tf:int>>")
    return bind(F.sort_array(tokens), lambda s: F.when(F.size(s) > 0, runs(s)).otherwise(empty))


def jaccard(a: Column, b: Column) -> Column:
    """Jaccard similarity of two token arrays taken as sets; 0 when either is empty."""
    def score(x: Column, y: Column) -> Column:
        union = F.size(F.array_union(x, y))
        return F.when(union > 0, F.size(F.array_intersect(x, y)) / union).otherwise(F.lit(0.0))

    return bind(a, lambda x: bind(b, lambda y: score(x, y)))


def tfidf_cosine(a: Column, b: Column) -> Column:
    """Cosine of two token arrays under tf-idf fitted on just these two texts.

    With two documents the smoothed idf takes two values: 1 for a shared term
    and ln(1.5)+1 for a term of one side. Sorting both sides together and
    folding once over the runs of equal terms needs no vocabulary and keeps
    only a handful of numbers as state.
    """
    side = lambda arr, s: F.transform(arr, lambda t: F.struct(t.alias("t"), F.lit(s).alias("s")))
    merged = F.array_sort(F.concat(side(a, 0), side(b, 1)))
    zero = F.lit(0).cast("bigint")
    start = F.struct(
        F.lit(None).cast("string").alias("t"),
        zero.alias("ca"),
        zero.alias("cb"),
        zero.alias("dot"),
        zero.alias("a_shared"),
        zero.alias("a_alone"),
        zero.alias("b_shared"),
        zero.alias("b_alone"),
    )

    def flushed(s: Column) -> dict[str, Column]:
        shared = (s["ca"] > 0) & (s["cb"] > 0)
        sq = lambda name: s[name] * s[name]
        return {
            "dot": s["dot"] + s["ca"] * s["cb"],
            "a_shared": s["a_shared"] + F.when(shared, sq("ca")).otherwise(zero),
            "a_alone": s["a_alone"] + F.when(shared, zero).otherwise(sq("ca")),
            "b_shared": s["b_shared"] + F.when(shared, sq("cb")).otherwise(zero),
            "b_alone": s["b_alone"] + F.when(shared, zero).otherwise(sq("cb")),
        }

    def step(s: Column, x: Column) -> Column:
        in_a = (1 - x["s"]).cast("bigint")
        in_b = x["s"].cast("bigint")
        same = F.struct(
            s["t"].alias("t"),
            (s["ca"] + in_a).alias("ca"),
            (s["cb"] + in_b).alias("cb"),
            *[s[n].alias(n) for n in ("dot", "a_shared", "a_alone", "b_shared", "b_alone")],
        )
        sums = flushed(s)
        new = F.struct(
            x["t"].alias("t"),
            in_a.alias("ca"),
            in_b.alias("cb"),
            *[sums[n].alias(n) for n in ("dot", "a_shared", "a_alone", "b_shared", "b_alone")],
        )
        return F.when(s["t"] == x["t"], same).otherwise(new)

    def finish(s: Column) -> Column:
        sums = flushed(s)
        alone = F.pow(F.log(F.lit(1.5)) + 1.0, F.lit(2.0))
        norm = F.sqrt(sums["a_shared"] + alone * sums["a_alone"]) * F.sqrt(
            sums["b_shared"] + alone * sums["b_alone"]
        )
        return F.when(norm > 0, sums["dot"] / norm).otherwise(F.lit(0.0))

    return F.aggregate(merged, start, step, finish)


def regex_find(c: Column, pattern: str) -> Column:
    """Case-insensitive search with Unicode word boundaries."""
    return c.rlike("(?iU)" + pattern)


def first_match(rules, otherwise: Column) -> Column:
    """The value of the first condition that holds; ``rules`` is [(condition, value)]."""
    out = None
    for condition, value in rules:
        out = F.when(condition, value) if out is None else out.when(condition, value)
    return otherwise if out is None else out.otherwise(otherwise)


def preview(c: Column, chars: int = 100, ellipsis: bool = True) -> Column:
    """One-line preview: line breaks become blanks, long text is cut."""
    flat = F.regexp_replace(F.coalesce(c.cast("string"), F.lit("")), r"[\r\n]", " ")
    cut = F.substring(flat, 1, chars)
    if not ellipsis:
        return cut
    return F.when(F.length(flat) > chars, F.concat(cut, F.lit("..."))).otherwise(cut)
