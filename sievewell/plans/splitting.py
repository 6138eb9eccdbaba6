"""Split queries (W0-W6, W9, J6, A13, A14)."""

from pyspark.sql import functions as F

from sievewell.operators import splits as sp
from sievewell.plans.base import plan, table


def _hash(seed: int, col: str) -> str:
    return f"('0x' || substr(md5('{seed}|' || {col}), 1, 15))::BIGINT"


RANDOM_SQL = f"""r AS (SELECT o_orderkey, row_number() OVER (ORDER BY {_hash(42, 'o_orderkey')}, o_orderkey) - 1 AS rn,
   (SELECT count(*) FROM orders) AS n FROM orders),
   s AS (SELECT o_orderkey, CASE WHEN rn < round_even(n * 0.7, 0) THEN 'train'
     WHEN rn < round_even(n * 0.7, 0) + round_even(n * 0.15, 0) THEN 'val' ELSE 'test' END AS split FROM r)"""


@plan("split_random", "W3 W0 TR15", f"WITH {RANDOM_SQL} SELECT o_orderkey, split FROM s")
def split_random(spark, sf):
    return sp.split_random(table(spark, sf, "orders").select("o_orderkey"), "o_orderkey", (70, 15, 15))


TEMPORAL_SQL = f"""r AS (SELECT o_orderkey, o_orderdate, row_number() OVER (ORDER BY o_orderdate, {_hash(0, 'o_orderkey')}, o_orderkey) - 1 AS rn,
   (SELECT count(*) FROM orders) AS n FROM orders),
   s AS (SELECT o_orderkey, o_orderdate, CASE WHEN rn < round_even(n * 0.7, 0) THEN 'train'
     WHEN rn < round_even(n * 0.7, 0) + round_even(n * 0.15, 0) THEN 'val' ELSE 'test' END AS split FROM r)"""


def _temporal(spark, sf):
    return sp.split_temporal(table(spark, sf, "orders").select("o_orderkey", "o_orderdate"), "o_orderdate", "o_orderkey")


@plan("split_temporal", "W2 W0", f"WITH {TEMPORAL_SQL} SELECT o_orderkey, split FROM s")
def split_temporal(spark, sf):
    return _temporal(spark, sf).select("o_orderkey", "split")


@plan(
    "split_time_ranges",
    "A14",
    f"""WITH {TEMPORAL_SQL} SELECT split, strftime(min(o_orderdate), '%Y-%m-%d') AS first_time,
    strftime(max(o_orderdate), '%Y-%m-%d') AS last_time FROM s GROUP BY 1""",
)
def split_time_ranges(spark, sf):
    d = sp.time_ranges(_temporal(spark, sf), "o_orderdate")
    return d.select("split", *[F.date_format(c, "yyyy-MM-dd").alias(c) for c in ("first_time", "last_time")])


def _quota(src: str, size: str, keep: str, total: str, seed: int, out: str) -> str:
    """Largest-remainder quotas over classes."""
    return f"""SELECT *, ({size} * {keep}) // {total} + CASE WHEN row_number() OVER (ORDER BY ({size} * {keep}) % {total} DESC,
       {_hash(seed, 'class')}, class) <= {keep} - sum(({size} * {keep}) // {total}) OVER () THEN 1 ELSE 0 END AS {out} FROM {src}"""


def stratified_sql(src: str, id_col: str, label: str, min_per_class: int, to_train: bool, train: str, val_share: str) -> str:
    """CTEs up to ``s(id, class, split)`` for a split where both stages are stratified."""
    main = "WHERE class <> '__RARE__'" if to_train else ""
    return f"""
a AS (SELECT {id_col} AS id, coalesce({label}, '__MISSING__') AS raw FROM {src}),
cl AS (SELECT raw, CASE WHEN count(*) < {min_per_class} THEN '__RARE__' ELSE raw END AS class FROM a GROUP BY raw),
b AS (SELECT id, class FROM a JOIN cl USING (raw)),
m AS (SELECT class, count(*)::BIGINT AS n FROM b {main} GROUP BY 1),
t AS (SELECT sum(n)::BIGINT AS n, (sum(n) - ceil(sum(n) * (1.0::DOUBLE - {train})))::BIGINT AS keep FROM m),
q1 AS ({_quota('(SELECT m.*, t.n AS tn, t.keep FROM m, t)', 'n', 'keep', 'tn', 42, 'train_n')}),
t2 AS (SELECT sum(n - train_n)::BIGINT AS n2, (sum(n - train_n) - ceil(sum(n - train_n) * (1.0::DOUBLE - {val_share})))::BIGINT AS keep2 FROM q1),
q2 AS ({_quota('(SELECT q1.*, n - train_n AS temp_n, t2.n2, t2.keep2 FROM q1, t2 WHERE n > train_n)', 'temp_n', 'keep2', 'n2', 43, 'val_n')}),
r AS (SELECT id, class, row_number() OVER (PARTITION BY class ORDER BY {_hash(42, 'id')}, id) - 1 AS rn FROM b),
s AS (SELECT id, r.class, CASE WHEN q1.class IS NULL OR rn < q1.train_n THEN 'train' WHEN rn < q1.train_n + coalesce(val_n, 0) THEN 'val' ELSE 'test' END AS split
  FROM r LEFT JOIN q1 USING (class) LEFT JOIN q2 USING (class))"""


_PRIORITY = stratified_sql("orders", "o_orderkey", "o_orderpriority", 2, False, "0.7", "0.15::DOUBLE / (0.15 + 0.15)")


def _by_priority(spark, sf):
    d = table(spark, sf, "orders").select("o_orderkey", "o_orderpriority")
    return sp.split_stratified(d, "o_orderpriority", "o_orderkey")


@plan("split_stratified", "W4 W6", f"WITH {_PRIORITY} SELECT id AS o_orderkey, class AS o_orderpriority, split FROM s")
def split_stratified(spark, sf):
    return _by_priority(spark, sf)[0]


@plan("split_leakage", "J6", f"""WITH {_PRIORITY} SELECT 'train_val_overlap' AS pair, 0 AS overlap UNION ALL
    SELECT 'train_test_overlap', 0 UNION ALL SELECT 'val_test_overlap', 0""")
def split_leakage(spark, sf):
    return sp.leakage(_by_priority(spark, sf)[0], "o_orderkey")


@plan(
    "copied_text_leakage",
    "J6",
    f"""WITH d AS (SELECT doc_id, text, row_number() OVER (ORDER BY {_hash(42, 'doc_id')}, doc_id) - 1 AS rn, (SELECT count(*) FROM documents) AS n FROM documents),
    s AS (SELECT text, CASE WHEN rn < round_even(n * 0.7, 0) THEN 'train' WHEN rn < round_even(n * 0.7, 0) + round_even(n * 0.15, 0) THEN 'val' ELSE 'test' END AS split FROM d)
    SELECT p.a || '_' || p.b || '_overlap' AS pair, (SELECT count(*) FROM (SELECT text FROM s WHERE split = p.a INTERSECT SELECT text FROM s WHERE split = p.b)) AS overlap
    FROM (VALUES ('train', 'val'), ('train', 'test'), ('val', 'test')) p(a, b)""",
)
def copied_text_leakage(spark, sf):
    d = sp.split_random(table(spark, sf, "documents").select("doc_id", "text"), "doc_id")
    return sp.leakage(d, "text")


@plan(
    "split_class_distribution",
    "A13",
    f"""WITH {_PRIORITY} SELECT split, class AS o_orderpriority, row_count, rank FROM (
      SELECT split, class, count(*) AS row_count, row_number() OVER (PARTITION BY split ORDER BY count(*) DESC, class) AS rank FROM s GROUP BY 1, 2) WHERE rank <= 20""",
)
def split_class_distribution(spark, sf):
    d = sp.class_distribution(_by_priority(spark, sf)[0], "o_orderpriority")
    return d.withColumn("rank", F.col("rank").cast("bigint"))


@plan(
    "split_shares",
    "W4 K12",
    f"""WITH {_PRIORITY} SELECT split, count(*) AS row_count, count(*)::DOUBLE / (SELECT count(*) FROM s) AS share FROM s GROUP BY 1""",
)
def split_shares(spark, sf):
    return sp.split_counts(_by_priority(spark, sf)[0])


# Document classes: language and source, with missing labels and a few tiny classes.
_DOC_LABEL = "CASE WHEN doc_id % 17 = 0 THEN NULL WHEN n_chars > 12000 THEN concat(lang, '-', source) ELSE lang END"


def _docs(spark, sf):
    return table(spark, sf, "documents").selectExpr("doc_id", f"{_DOC_LABEL} AS label")


_DOC_SRC = f"(SELECT doc_id, {_DOC_LABEL} AS label FROM documents)"


@plan(
    "split_stratified_pooled",
    "W4 W6 TR16",
    f"""WITH {stratified_sql(_DOC_SRC, 'doc_id', 'label', 5, False, '0.7', '0.15::DOUBLE / (0.15 + 0.15)')}
    SELECT id AS doc_id, class AS label, split FROM s""",
)
def split_stratified_pooled(spark, sf):
    return sp.split_stratified(_docs(spark, sf), "label", "doc_id", min_per_class=5)[0]


_RARE_N = f"""(SELECT count(*) FROM {_DOC_SRC} x JOIN (SELECT coalesce(label, '__MISSING__') AS l FROM {_DOC_SRC} GROUP BY 1 HAVING count(*) < 5) y
   ON coalesce(x.label, '__MISSING__') = y.l)"""
_TRAIN_MAIN = f"""(SELECT least(greatest(greatest(0.7::DOUBLE * n - r, 0.0) / (n - r), 0.01), 0.98) FROM (SELECT count(*) AS n, {_RARE_N} AS r FROM documents))"""


@plan(
    "split_stratified_rare_to_train",
    "W4 W5",
    f"""WITH {stratified_sql(_DOC_SRC, 'doc_id', 'label', 5, True, _TRAIN_MAIN, '0.5::DOUBLE')}
    SELECT id AS doc_id, class AS label, split FROM s""",
)
def split_stratified_rare_to_train(spark, sf):
    d, _ = sp.split_stratified(
        _docs(spark, sf), "label", "doc_id", min_per_class=5, rare_to_train=True, enforce_target=True
    )
    return d


def fallback_sql(first_random: bool, label: str) -> str:
    """Splits whose second stage, or both stages, are random, as small classes demand."""
    src = f"(SELECT doc_id, {label} AS label FROM documents)"
    if first_random:
        head = f"""b AS (SELECT doc_id AS id, coalesce(label, '__MISSING__') AS class FROM {src}),
        n AS (SELECT count(*) AS n, round_even(count(*) * (1.0::DOUBLE - 0.7), 0)::BIGINT AS n_temp FROM b),
        f AS (SELECT id, class, row_number() OVER (ORDER BY {_hash(42, 'id')}, id) - 1 < n_temp AS rest, n_temp FROM b, n)"""
    else:
        head = stratified_sql(src, "doc_id", "label", 2, False, "0.7", "0.5::DOUBLE") + """,
        f AS (SELECT id, r.class, rn >= q1.train_n AS rest, (SELECT n - keep FROM t) AS n_temp FROM r JOIN q1 USING (class))"""
    return f"""WITH {head}, g AS (SELECT *, row_number() OVER (PARTITION BY rest ORDER BY {_hash(43, 'id')}, id) - 1 AS rn2 FROM f)
    SELECT id AS doc_id, class AS label, CASE WHEN NOT rest THEN 'train' WHEN rn2 < round_even(n_temp * 0.5::DOUBLE, 0) THEN 'test' ELSE 'val' END AS split FROM g"""


_SINGLES = "CASE WHEN doc_id < 60 THEN concat('s', cast(doc_id AS string)) ELSE lang END"
_TRIPLES = "CASE WHEN doc_id < 30 THEN concat('s', cast(doc_id % 10 AS string)) ELSE lang END"


@plan("split_stage1_fallback", "W6", fallback_sql(True, _SINGLES))
def split_stage1_fallback(spark, sf):
    d = table(spark, sf, "documents").selectExpr("doc_id", f"{_SINGLES} AS label")
    out, notes = sp.split_stratified(d, "label", "doc_id", min_per_class=1)
    assert notes["stage1_mode"] == "random_fallback_small_class", notes
    return out


@plan("split_stage2_fallback", "W6", fallback_sql(False, _TRIPLES))
def split_stage2_fallback(spark, sf):
    d = table(spark, sf, "documents").selectExpr("doc_id", f"{_TRIPLES} AS label")
    out, notes = sp.split_stratified(d, "label", "doc_id")
    assert notes["stage2_mode"] == "random_fallback_small_class", notes
    return out


@plan("split_samples", "W9", f"""WITH {RANDOM_SQL} SELECT o_orderkey, split FROM (
  SELECT *, row_number() OVER (PARTITION BY split ORDER BY o_orderkey) AS rn FROM s) WHERE rn <= 5""")
def split_samples(spark, sf):
    return sp.split_samples(split_random(spark, sf), ["o_orderkey"])
