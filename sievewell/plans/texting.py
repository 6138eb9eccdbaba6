"""Text-function and prompt queries (T)."""

from pyspark.sql import functions as F

from sievewell.functions import text as tx
from sievewell.operators import chunks as ch
from sievewell.operators import features as ft
from sievewell.plans.base import plan, text_table
from sievewell.plans.frames import (
    PAIRS_SQL,
    SILVER_SQL,
    silver,
    sql_clean_markup,
    sql_tokenize,
    sql_words,
    turn_pairs,
)

_PAGES_CLEAN = sql_clean_markup("html")


@plan("clean_markup_pages", "T-1", f"SELECT page_id, {_PAGES_CLEAN} AS cleaned FROM pages")
def clean_markup_pages(spark, sf):
    return text_table(spark, sf, "pages").select("page_id", tx.clean_markup(F.col("html")).alias("cleaned"))


@plan(
    "token_counts",
    "T-2 T-3 TR10",
    f"""WITH t AS (SELECT doc_id, {sql_tokenize('text')} AS w FROM documents)
    SELECT doc_id, len(w) AS token_count, len(list_distinct(w)) AS distinct_tokens, md5(array_to_string(w, ' ')) AS token_md5 FROM t""",
)
def token_counts(spark, sf):
    d = text_table(spark, sf, "documents").select("doc_id", tx.tokenize(F.col("text")).alias("w"))
    return d.select(
        "doc_id",
        F.size("w").cast("bigint").alias("token_count"),
        F.size(F.array_distinct("w")).cast("bigint").alias("distinct_tokens"),
        F.md5(F.array_join("w", " ")).alias("token_md5"),
    )


@plan(
    "plain_and_ascii_tokens",
    "T-4 T-5",
    f"""SELECT doc_id, len({sql_words('text')}) AS plain_tokens, len(regexp_extract_all(lower(text), '[a-z0-9]+')) AS ascii_tokens FROM documents""",
)
def plain_and_ascii_tokens(spark, sf):
    return text_table(spark, sf, "documents").select(
        "doc_id",
        F.size(tx.words(F.col("text"))).cast("bigint").alias("plain_tokens"),
        F.size(tx.ascii_words(F.col("text"))).cast("bigint").alias("ascii_tokens"),
    )


@plan(
    "sentence_counts",
    "T-6",
    """WITH s AS (SELECT doc_id, string_split(regexp_replace(text, '([.!?])\\s+', '\\1' || chr(1), 'g'), chr(1)) AS s FROM documents)
    SELECT doc_id, len(s) AS sentences, md5(array_to_string(s, '|')) AS sentence_md5 FROM s""",
)
def sentence_counts(spark, sf):
    d = text_table(spark, sf, "documents").select("doc_id", tx.split_sentences(F.col("text")).alias("s"))
    return d.select(
        "doc_id", F.size("s").cast("bigint").alias("sentences"), F.md5(F.array_join("s", "|")).alias("sentence_md5")
    )


# The packer said again as a fold over one-sentence states.
CHUNKS_SQL = f"""
cleaned AS (SELECT doc_id, source, lang, {sql_clean_markup('text')} AS t FROM documents),
sentences AS (SELECT doc_id, source, lang,
    list_transform(string_split(regexp_replace(t, '([.!?])\\s+', '\\1' || chr(1), 'g'), chr(1)),
      lambda s: {{'done': []::VARCHAR[], 'open': [{{'s': s, 'n': len({sql_tokenize('s')})}}], 'n': len({sql_tokenize('s')})}}) AS x
  FROM cleaned WHERE length(trim(t, ' ' || chr(9) || chr(10) || chr(13) || chr(12) || chr(11))) >= 50),
folded AS (SELECT doc_id, source, lang, list_reduce(x, lambda a, b:
    CASE WHEN a.n + b.n <= 200 THEN {{'done': a.done, 'open': list_concat(a.open, b.open), 'n': a.n + b.n}}
    ELSE {{'done': list_append(a.done, array_to_string(list_transform(a.open, lambda o: o.s), ' ')),
          'open': list_concat(list_filter(a.open, lambda o, i: list_sum(list_transform(a.open[i:], lambda q: q.n)) <= 50), b.open),
          'n': coalesce(list_sum(list_transform(list_filter(a.open, lambda o, i: list_sum(list_transform(a.open[i:], lambda q: q.n)) <= 50), lambda q: q.n)), 0)::BIGINT + b.n}} END) AS f
  FROM sentences),
chunk_lists AS (SELECT doc_id, source, lang, list_append(f.done, array_to_string(list_transform(f.open, lambda o: o.s), ' ')) AS c FROM folded),
chunks AS (SELECT doc_id::VARCHAR AS drug_id, source AS drug_name, lang AS field_name, unnest(range(len(c))) AS chunk_idx, unnest(c) AS chunk_text FROM chunk_lists)
"""


def document_chunks(spark, sf):
    """Documents as evidence records: source is the name, language the field."""
    d = text_table(spark, sf, "documents").select(
        F.col("doc_id").cast("string").alias("drug_id"),
        F.col("source").alias("drug_name"),
        F.col("lang").alias("field_name"),
        tx.clean_markup(F.col("text")).alias("text"),
    )
    return ch.chunk_rows(d, "text", ["drug_id", "drug_name", "field_name"])


@plan(
    "document_chunks",
    "T-7 T-8 TR13",
    f"""WITH {CHUNKS_SQL} SELECT drug_id, drug_name, field_name, chunk_idx, chunk_text, len({sql_tokenize('chunk_text')}) AS token_count FROM chunks""",
)
def document_chunks_plan(spark, sf):
    return document_chunks(spark, sf).withColumns(
        {"chunk_idx": F.col("chunk_idx").cast("bigint"), "token_count": F.col("token_count").cast("bigint")}
    )


@plan(
    "record_field_chunks",
    "T-8 P5 P6",
    f"""WITH s AS ({SILVER_SQL}), r AS (
      SELECT drug_id, drug_name, 'description' AS field_name, description AS t FROM s UNION ALL
      SELECT drug_id, drug_name, 'indication', indication FROM s UNION ALL
      SELECT drug_id, drug_name, 'toxicity', toxicity FROM s UNION ALL
      SELECT drug_id, drug_name, 'mechanism_of_action', mechanism FROM s)
    SELECT drug_id, drug_name, field_name, 0 AS chunk_idx, t AS chunk_text, len({sql_tokenize('t')}) AS token_count
    FROM r WHERE length(trim(t)) >= 50""",
)
def record_field_chunks(spark, sf):
    from sievewell.operators.standardize import coalesce_aliases

    return ch.build_chunks(coalesce_aliases(silver(spark, sf)))


_STOPS = ", ".join("'" + w.replace("'", "''") + "'" for w in tx.P.ENGLISH_STOP_WORDS)


@plan(
    "stop_word_tokens",
    "T-9 A12",
    f"""SELECT doc_id, len(t)::INTEGER AS tokens, md5(array_to_string(t, ' ')) AS token_md5 FROM (SELECT doc_id, list_filter(
      regexp_split_to_array(lower(coalesce(text, '')), '[^a-zA-Z0-9_]+'), lambda x: x <> '' AND NOT list_contains([{_STOPS}], x)) AS t FROM documents)""",
)
def stop_word_tokens(spark, sf):
    d = ft.stop_word_tokens(text_table(spark, sf, "documents").select("doc_id", "text"), "text")
    return d.select("doc_id", F.size("text_tokens").alias("tokens"), F.md5(F.array_join("text_tokens", " ")).alias("token_md5"))


@plan("hashed_tfidf", "T-10")
def hashed_tfidf(spark, sf):
    d = ft.stop_word_tokens(text_table(spark, sf, "documents").select("doc_id", "text"), "text")
    return ft.hashed_tfidf(d, "text_tokens", "text_tfidf").select("doc_id", "text_tfidf")


@plan(
    "mean_token_counts",
    "A12",
    f"SELECT round(avg(len({sql_tokenize('text')})), 6) AS avg_text_tokens FROM documents",
)
def mean_token_counts(spark, sf):
    from sievewell.operators.profile import mean_token_counts as means

    d = text_table(spark, sf, "documents").select(tx.tokenize(F.col("text")).alias("text_tokens"))
    return means(d, ["text_tokens"]).select(F.round("avg_text_tokens", 6).alias("avg_text_tokens"))


@plan(
    "label_index",
    "T-14",
    f"""WITH s AS ({SILVER_SQL}), c AS (SELECT indication, row_number() OVER (ORDER BY count(*) DESC, indication) - 1 AS i
      FROM s WHERE indication IS NOT NULL GROUP BY 1)
    SELECT k, coalesce(i, (SELECT count(*) FROM c))::DOUBLE AS indication_index FROM s LEFT JOIN c ON s.indication = c.indication""",
)
def label_index(spark, sf):
    s = silver(spark, sf).select("k", "indication")
    return ft.with_label_index(s, "indication", "indication_index").select("k", "indication_index")


@plan(
    "key_terms",
    "T-15 TR7",
    f"""WITH t AS (SELECT doc_id, {sql_tokenize('text')} AS w FROM documents),
    u AS (SELECT doc_id, unnest(w) AS term, unnest(range(len(w))) AS pos FROM t),
    r AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY length(term) DESC, pos) AS rn FROM u WHERE term NOT IN
      ({", ".join(f"'{w}'" for w in tx.P.KEY_TERM_STOP_WORDS)}))
    SELECT t.doc_id, coalesce(g.terms, '') AS terms FROM t LEFT JOIN (
      SELECT doc_id, string_agg(term, ' ' ORDER BY rn) AS terms FROM (SELECT doc_id, term, min(rn) AS rn FROM r WHERE rn <= 15 GROUP BY 1, 2) GROUP BY 1) g
      ON t.doc_id = g.doc_id""",
)
def key_terms(spark, sf):
    return text_table(spark, sf, "documents").select(
        "doc_id", F.array_join(tx.key_terms(tx.tokenize(F.col("text"))), " ").alias("terms")
    )


@plan(
    "turn_jaccard",
    "T-16 U4",
    f"""WITH {PAIRS_SQL}, w AS (SELECT conv_id, turn, list_distinct({sql_words('question')}) AS a, list_distinct({sql_words('answer')}) AS b FROM pairs)
    SELECT conv_id, turn, len(list_intersect(a, b)) AS shared, len(list_distinct(list_concat(a, b))) AS together,
      round(CASE WHEN len(list_concat(a, b)) = 0 THEN 0.0 ELSE len(list_intersect(a, b))::DOUBLE / len(list_distinct(list_concat(a, b))) END, 9) AS jaccard FROM w""",
)
def turn_jaccard(spark, sf):
    p = turn_pairs(spark, sf).select(
        "conv_id", "turn", tx.words(F.col("question")).alias("a"), tx.words(F.col("answer")).alias("b")
    )
    return p.select(
        "conv_id",
        "turn",
        F.size(F.array_intersect("a", "b")).cast("bigint").alias("shared"),
        F.size(F.array_union("a", "b")).cast("bigint").alias("together"),
        F.round(tx.jaccard(F.col("a"), F.col("b")), 9).alias("jaccard"),
    )


def cosine_sql(src: str, keys: str, a: str, b: str) -> str:
    """CTE ``cosine(keys, score)`` for token lists ``a`` and ``b`` of ``src``."""
    return f"""
    cos_u AS (SELECT {keys}, unnest({a}) AS t, 1 AS ca, 0 AS cb FROM {src} UNION ALL SELECT {keys}, unnest({b}), 0, 1 FROM {src}),
    cos_t AS (SELECT {keys}, t, sum(ca) AS ca, sum(cb) AS cb FROM cos_u GROUP BY ALL),
    cos_w AS (SELECT {keys}, ca, cb, CASE WHEN ca > 0 AND cb > 0 THEN 1.0::DOUBLE ELSE ln(1.5::DOUBLE) + 1 END AS idf FROM cos_t),
    cos_s AS (SELECT {keys}, sum(ca * cb * idf * idf) AS dot, sqrt(sum(ca * ca * idf * idf)) * sqrt(sum(cb * cb * idf * idf)) AS norm FROM cos_w GROUP BY ALL),
    cosine AS (SELECT {keys}, CASE WHEN norm > 0 THEN dot / norm ELSE 0.0 END AS score FROM cos_s)"""


@plan(
    "turn_tfidf_cosine",
    "T-17 TR6",
    f"""WITH {PAIRS_SQL}, w AS (SELECT conv_id, turn, {sql_tokenize('question')} AS a, {sql_tokenize('answer')} AS b FROM pairs),
    {cosine_sql('w', 'conv_id, turn', 'a', 'b')}
    SELECT w.conv_id, w.turn, round(coalesce(score, 0.0), 9) AS cosine FROM w LEFT JOIN cosine c ON c.conv_id = w.conv_id AND c.turn = w.turn""",
)
def turn_tfidf_cosine(spark, sf):
    p = turn_pairs(spark, sf)
    score = tx.tfidf_cosine(tx.tokenize(F.col("question")), tx.tokenize(F.col("answer")))
    return p.select("conv_id", "turn", F.round(score, 9).alias("cosine"))
