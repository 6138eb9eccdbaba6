"""Sources, sinks, high-water mark and streams."""

import datetime as dt
import hashlib
import time

import pytest

from conftest import rows
from pyspark.sql import functions as F
from sievewell.operators import evaluate as ev
from sievewell.session import work_dir
from sievewell.sources import files as fs
from sievewell.sources import incremental as inc
from sievewell.sources import sinks
from sievewell.streaming import streams as sm


def test_work_dir_is_below_the_shared_folder(spark):
    base = spark.conf.get("spark.checkpoint.dir", None)
    if base:
        assert work_dir(spark, "x").startswith(base)
    assert work_dir(spark, "x") != work_dir(spark, "x")


def test_a_cluster_needs_a_shared_folder(spark, monkeypatch):
    from sievewell import session

    class Context:
        master, applicationId = "spark://host:7077", "app"
        getCheckpointDir = staticmethod(lambda: None)

    class Other:
        sparkContext = Context()
        conf = type("C", (), {"get": staticmethod(lambda k, d=None: d)})()

    with pytest.raises(RuntimeError, match="spark.checkpoint.dir"):
        session.work_dir(Other(), "x")


def test_new_data_under_an_old_path_is_seen(spark, tmp_path):
    from sievewell.plans.base import data_version

    spark.range(3).write.parquet(str(tmp_path / "t.parquet"))
    first = data_version(spark, str(tmp_path), "t")
    assert data_version(spark, str(tmp_path), "t") == first
    spark.range(4).write.mode("overwrite").parquet(str(tmp_path / "t.parquet"))
    assert data_version(spark, str(tmp_path), "t") != first


def test_broadcast_is_bounded_by_bytes(spark):
    from sievewell.session import broadcast_if_small

    df = spark.range(50).selectExpr("id", "repeat('x', 1000) AS t", "array(id) AS a")
    hinted = lambda d: "ResolvedHint" in d._jdf.queryExecution().analyzed().toString()
    assert hinted(broadcast_if_small(df)) and not hinted(broadcast_if_small(df, max_bytes=10_000)) and not hinted(broadcast_if_small(df, max_rows=10))


@pytest.mark.parametrize("size", ["100m", "9000", "700"])
def test_xml_is_split_and_elements_cross_splits(spark, tmp_path, size):
    inner = "<drugs><drug><name>in</name></drug><drug>\n<name>in</name></drug></drugs>"
    for f in range(2):
        body = "".join(f'<drug type="t" id="{f * 1000 + i}"><name>n{f}-{i}</name>{inner * (i % 3)}<note>{"é" * (i % 50)}</note></drug>\n' for i in range(300))
        (tmp_path / f"{f}.xml").write_text(f'<?xml version="1.0"?>\n<drugbank>\n{body}</drugbank>\n')
    for k, v in (("maxPartitionBytes", size), ("openCostInBytes", "0")):
        spark.conf.set(f"spark.sql.files.{k}", v)
    try:
        scan = spark.read.option("lineSep", "</drug>").text(str(tmp_path))
        assert scan.rdd.getNumPartitions() >= {"100m": 2, "9000": 8, "700": 100}[size]
        got = fs.read_xml(spark, str(tmp_path), "drug", schema="_id long, name string, note string").collect()
    finally:
        for k in ("maxPartitionBytes", "openCostInBytes"):
            spark.conf.unset(f"spark.sql.files.{k}")
    assert sorted((r["_id"], r["name"], len(r["note"] or "")) for r in got) == [(f * 1000 + i, f"n{f}-{i}", i % 50) for f in range(2) for i in range(300)]


def test_a_repeated_pull_adds_nothing(spark):
    state, out = work_dir(spark, "r-mark"), work_dir(spark, "r-out")
    src = spark.createDataFrame([(i, dt.datetime(2025, 1, i)) for i in range(1, 4)], "id int, updated_at timestamp")
    inc.pull(src, "updated_at", state, out)
    mark = inc.read_mark(spark, state)
    more = src.union(spark.createDataFrame([(9, dt.datetime(2025, 2, 1))], src.schema))
    inc.pull(more, "updated_at", state, out)
    inc.write_mark(spark, state, mark)  # as if the run had ended before it moved the mark
    inc.pull(more, "updated_at", state, out)
    assert sorted(r["id"] for r in spark.read.parquet(out).collect()) == [1, 2, 3, 9]


def test_progress_of_all_batches_is_kept(spark, tmp_path):
    topic = messages(tmp_path)
    spark.conf.set("spark.sql.streaming.numRecentProgressUpdates", "2")
    try:
        raw = sm.message_stream(spark, "text", path=topic, maxFilesPerTrigger=1)
        q = sm.start_idempotent_sink(raw, str(tmp_path / "io"), str(tmp_path / "ic"), str(tmp_path / "ip"))
        q.awaitTermination()
        assert len(q.recentProgress) <= 2
    finally:
        spark.conf.unset("spark.sql.streaming.numRecentProgressUpdates")
    assert spark.read.parquet(str(tmp_path / "ip")).agg(F.sum("input_rows")).first()[0] == 24
    # a new checkpoint counts from 0 again and replaces nothing
    sm.start_idempotent_sink(raw, str(tmp_path / "io"), str(tmp_path / "ic2")).awaitTermination()
    assert spark.read.parquet(str(tmp_path / "io")).count() == 48


def test_run_metrics_by_mode_keep_rows_without_mode(spark):
    df = spark.createDataFrame(
        [("{}", "BLOCK", "SCHEMA_INVALID", 0.0, 0.0, True, 10.0, None), ("x", "ALLOW", None, 1.0, 0.5, True, 20.0, "baseline")],
        "content string, decision string, rule_tag string, grounding_score double, coverage_ratio double, should_allow boolean, latency_ms double, model_mode string",
    )
    got = {r["model_mode"]: r for r in ev.run_metrics(df, by="model_mode").collect()}
    assert got["rag"]["latency_p95_ms"] == 10.0 and got["rag"]["rule_breakdown"] == {"SCHEMA_INVALID": 1} and got["baseline"]["optimal_threshold"] is not None


def test_nested_row_tags_are_no_rows(spark, tmp_path):
    # TR20
    (tmp_path / "a.xml").write_text("<r><drug><name>a</name><pathways><drug><name>inner</name></drug></pathways></drug><drug><name>b</name></drug></r>")
    got = fs.read_xml(spark, str(tmp_path / "a.xml"), "drug", schema="name string")
    assert rows(got) == [("a",), ("b",)]


@pytest.mark.parametrize("nested", [False, True])
def test_empty_elements_comments_and_sections(spark, tmp_path, nested):
    inner = "<in><drug><name>x</name></drug><drug/></in>" if nested else ""
    body = (
        f'<drug/><drug><name>a</name>{inner}</drug>\n<drug id="7"/><!-- <drug><name>no <drug/> --><drug id="1"><name><![CDATA[<drug> & </x><drug/>]]></name><!-- c --></drug>'
        f'<drugs/><drug-x/><drug ><name>b</name><drugx/>{inner}</drug><drug\n/>'
    )
    (tmp_path / "a.xml").write_text(f"<r>{body}</r>")
    got = sorted(tuple(r) for r in fs.read_xml(spark, str(tmp_path / "a.xml"), "drug", schema="_id long, name string").select(F.coalesce("_id", F.lit(0)), F.coalesce("name", F.lit(""))).collect())
    assert got == [(0, ""), (0, ""), (0, "a"), (0, "b"), (1, "<drug> & </x><drug/>"), (7, "")]


def test_files_cut_inside_a_comment_are_read_whole(spark, tmp_path):
    (tmp_path / "a.xml").write_text("<r><drug><name>a</name></drug><!-- <drug><name>no</name></drug> --><drug><name><![CDATA[</drug>]]></name></drug></r>")
    (tmp_path / "b.xml").write_text("<r><drug><name>b</name></drug></r>")
    elements, whole = fs.xml_elements(spark, str(tmp_path), "drug")
    assert [w.rsplit("/", 1)[1] for w in whole] == ["a.xml"] and elements.count() == 1
    assert rows(fs.read_xml(spark, str(tmp_path), "drug", schema="name string")) == [("</drug>",), ("a",), ("b",)]


def test_unknown_suffix(spark):
    with pytest.raises(ValueError):
        fs.read_by_suffix(spark, "/x/y.xlsx")


def test_read_any_falls_back_to_parquet(spark, tmp_path):
    path = str(tmp_path / "t")
    spark.range(3).write.parquet(path)
    assert fs.read_any(spark, path).count() == 3


def test_line_numbers_span_files_and_splits(spark, tmp_path):
    for i in range(3):
        (tmp_path / f"p{i}.txt").write_text("".join(f"{i}-{j}\n" for j in range(400)))
    spark.conf.set("spark.sql.files.maxPartitionBytes", "700")
    try:
        got = fs.with_line_numbers(spark.read.text(str(tmp_path))).orderBy("line_number").collect()
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    assert [(r["value"], r["line_number"]) for r in got] == [(f"{i}-{j}", i * 400 + j) for i in range(3) for j in range(400)]


def test_latest_batch(spark, tmp_path):
    with pytest.raises(Exception):
        fs.latest_batch(spark, str(tmp_path / "none"))


def test_fingerprint_changes_with_content(spark, tmp_path):
    digest = lambda: fs.line_fingerprint(spark, str(tmp_path)).first()["digest"]
    (tmp_path / "a.txt").write_text("x\ny\n")
    first = digest()
    (tmp_path / "a.txt").write_text("x\nz\n")
    assert digest() != first


def test_empty_batch_keeps_the_mark(spark):
    # TR12
    state, out = work_dir(spark, "t-mark"), work_dir(spark, "t-out")
    src = spark.createDataFrame([(i, dt.datetime(2025, 1, i)) for i in range(1, 4)], "id int, updated_at timestamp")
    assert inc.read_mark(spark, state) is None
    assert inc.pull(src, "updated_at", state, out) == 3
    mark = inc.read_mark(spark, state)
    assert inc.pull(src, "updated_at", state, out) == 0
    assert inc.read_mark(spark, state) == mark
    more = src.union(spark.createDataFrame([(9, dt.datetime(2025, 2, 1))], src.schema))
    assert inc.pull(more, "updated_at", state, out) == 1
    assert spark.read.parquet(out).count() == 4


def test_mark_is_pushed_to_the_scan(spark, tmp_path):
    path, state = str(tmp_path / "t"), work_dir(spark, "t-push")
    spark.range(5).selectExpr("id", "timestamp_seconds(id) AS updated_at").write.parquet(path)
    inc.write_mark(spark, state, dt.datetime(1970, 1, 1, 0, 0, 2))
    plan = inc.incremental_load(spark.read.parquet(path), "updated_at", state)._jdf.queryExecution().toString()
    assert "GreaterThan(updated_at" in plan


def test_promotion_replaces_and_archives(spark, tmp_path):
    good, bad = spark.range(3), spark.range(3, 5)
    for batch in ("1", "2"):
        sinks.promote(good, bad, str(tmp_path / "c"), str(tmp_path / "a"), batch)
    assert spark.read.parquet(str(tmp_path / "c")).count() == 3
    assert spark.read.parquet(str(tmp_path / "a" / "bad_2")).count() == 2


def messages(tmp_path):
    folder = tmp_path / "topic"
    folder.mkdir()
    for i in range(4):
        (folder / f"m{i}.txt").write_text("".join(f'{{"id":{i * 10 + j},"source":"s","text":"t{j}","amount":1.5}}\n' for j in range(5)) + "{cut\n")
    return str(folder)


def test_restarted_stream_adds_nothing(spark, tmp_path):
    # TR23: the checkpoint remembers what was read
    topic, out, check = messages(tmp_path), str(tmp_path / "out"), str(tmp_path / "check")
    for _ in range(2):
        s = sm.with_landing_date(sm.json_stream(spark, "text", sm.EVENT_SCHEMA, path=topic, maxFilesPerTrigger=1))
        sm.start_sink(s, out, check, ["dt"]).awaitTermination()
    got = spark.read.parquet(out)
    assert got.count() == 24 and got.where("id IS NOT NULL").count() == 20


def test_two_hops_equal_the_batch(spark, tmp_path):
    from sievewell.operators.standardize import clean_messages

    topic = messages(tmp_path)
    raw = sm.message_stream(spark, "text", path=topic, maxFilesPerTrigger=2)
    sm.two_hop(spark, raw, str(tmp_path / "h1"), str(tmp_path / "h2"), str(tmp_path / "c"), F.lit("now"))
    batch = clean_messages(spark.read.text(topic), "value", F.lit("now"))
    schema = "id string, source string, text string, text_length int, processed_at string"
    assert rows(spark.read.schema(schema).json(str(tmp_path / "h2"))) == rows(batch)


def test_progress(spark, tmp_path):
    q = sm.start_sink(sm.message_stream(spark, "text", path=messages(tmp_path), maxFilesPerTrigger=1), str(tmp_path / "o"), str(tmp_path / "c"))
    q.awaitTermination()
    assert sm.progress_rows(q).agg(F.sum("input_rows")).first()[0] == 24
    assert rows(sm.status_row(q), "active", "recent_batches") == [(False, 4)]


# --- evaluation -------------------------------------------------------------------------


def scored(spark, data):
    return spark.createDataFrame(data, "grounding_score double, should_allow boolean")


def test_rates_of_nothing_are_zero(spark):
    df = spark.createDataFrame([], "decision string, should_allow boolean")
    r = ev.rates(ev.confusion(df)).first()
    assert [r[c] for c in ("precision", "recall", "f1", "far", "frr")] == [0.0] * 5


def test_labels_are_required(spark):
    # TR9: without a label there is no confusion matrix, instead of one that assumes true
    with pytest.raises(Exception, match="should_allow"):
        ev.confusion(spark.createDataFrame([("ALLOW",)], "decision string")).collect()


def test_youden_takes_the_smallest_threshold(spark):
    sweep = ev.roc_sweep(scored(spark, [(0.9, True), (0.8, True), (0.2, False), (0.1, False)]))
    assert ev.best_threshold(sweep).first()["optimal_threshold"] == pytest.approx(0.25)
    assert sweep.count() == 21


def test_run_metrics_take_population_deviation(spark):
    df = spark.createDataFrame(
        [("{}", "BLOCK", "SCHEMA_INVALID", 0.0, 0.0, True, 10.0, "rag"), ("x", "BLOCK", "JSON_INVALID", 1.0, 0.5, False, 20.0, "rag")],
        "content string, decision string, rule_tag string, grounding_score double, coverage_ratio double, should_allow boolean, latency_ms double, model_mode string",
    )
    r = ev.run_metrics(df).first()
    # TR19: JSON validity and schema match are counted apart
    assert (r["jsvs"], r["smr"], r["grounding_std"], r["model_mode"]) == (0.5, 0.0, 0.5, "rag")
    assert r["latency_p95_ms"] == pytest.approx(19.5) and r["rule_breakdown"] == {"SCHEMA_INVALID": 1, "JSON_INVALID": 1}


def test_running_allows(spark):
    df = spark.range(25).selectExpr("id", "CASE WHEN id % 2 = 0 THEN 'ALLOW' ELSE 'BLOCK' END AS decision")
    assert rows(ev.running_allows(df, "id"), "seen", "allowed") == [(10, 5), (20, 10)]


def test_auc_counts_ties_half(spark):
    from sievewell.operators.classify import ovr_auc

    df = spark.createDataFrame([("c", 0.1, False), ("c", 0.5, True), ("c", 0.5, False), ("c", 0.9, True)], "class string, score double, is_class boolean")
    assert ovr_auc(df).first()[0] == pytest.approx(3.5 / 4)
    assert ovr_auc(df.where("is_class")).first()[0] is None


def test_throughput_floor(spark):
    df = spark.createDataFrame([("2025-01-01T00:00:00",), ("2025-01-01T00:00:30",), ("?",)], "t string")
    assert ev.throughput(df, "t").first()[0] == pytest.approx(6.0)


def _ordered(spark, path):
    return [(r["line_count"], r["bytes"], r["sha256"]) for r in fs.ordered_fingerprint(spark, f"file://{path}").collect()]


def test_the_ordered_digest_sees_order_and_no_splits(spark, tmp_path, monkeypatch):
    lines = [f"line {i} {'x' * (i % 90)}" for i in range(5000)]
    (tmp_path / "a.txt").write_text("\n".join(lines) + "\n")
    (tmp_path / "empty.txt").write_text("")
    monkeypatch.setattr(fs, "LEAF_LINES", 64)
    monkeypatch.setattr(fs, "FAN_OUT", 8)  # four levels
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    try:
        found = []
        for size in ("128m", "50000", "7000"):
            spark.conf.set("spark.sql.files.maxPartitionBytes", size)
            found.append(_ordered(spark, tmp_path))
        assert found[0] == found[1] == found[2] and found[0][0][0] == 5000 and len(found[0]) == 1
        level = [hashlib.sha256(x.encode()).hexdigest() for x in lines]
        for wide in (64, 8, 8, 8):
            level = [hashlib.sha256("".join(level[i : i + wide]).encode()).hexdigest() for i in range(0, len(level), wide)]
        size = (tmp_path / "a.txt").stat().st_size
        assert len(level) == 1 and found[0][0][2] == hashlib.sha256(f"{level[0]}|5000|{size}".encode()).hexdigest()
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)
    seen = {found[0][0]}
    for text in ("\n".join(lines), "\r\n".join(lines) + "\n", "\n".join([lines[1], lines[0], *lines[2:]]) + "\n", "\n".join([*lines[:4000], lines[4001], lines[4000], *lines[4002:]]) + "\n"):
        (tmp_path / "a.txt").write_bytes(text.encode())
        seen.add(_ordered(spark, tmp_path)[0])
    assert len(seen) == 5


def _envelopes(spark, path, rows):
    spark.createDataFrame(rows, sm.ENVELOPE_SCHEMA).write.mode("append").json(path)


def test_replays_add_no_row_and_state_is_forgotten(spark, tmp_path):
    landed, out, check = (f"{tmp_path}/{x}" for x in ("landed", "out", "check"))

    def run():
        stream = spark.readStream.schema(sm.ENVELOPE_SCHEMA).json(landed)
        query = sm.start_sink(sm.without_replays(stream, "1 hour"), out, check)
        query.awaitTermination()
        state = [op for p in query.recentProgress for op in p["stateOperators"]]
        rows = sorted(r["value"] for r in spark.read.parquet(out).collect())
        return rows, (state[-1]["numRowsTotal"] if state else None)

    _envelopes(spark, landed, [("t", 0, 1, "a", "2025-01-01 10:00:00"), ("t", 0, 1, "a", "2025-01-01 10:00:00"), ("t", 1, 1, "b", "2025-01-01 10:05:00"), ("u", 0, 1, "c", "2025-01-01 10:05:00")])
    assert run()[0] == ["a", "b", "c"]
    _envelopes(spark, landed, [("t", 0, 1, "a", "2025-01-01 10:00:00"), ("t", 0, 2, "d", "2025-01-01 10:20:00"), ("t", 0, None, "no offset", "2025-01-01 10:20:00"), (None, None, 1, "e", "2025-01-01 10:20:00")])
    rows, held = run()  # started again from the checkpoint
    assert rows == ["a", "b", "c", "d", "e"] and held == 5
    _envelopes(spark, landed, [("t", 0, 3, "f", "2025-01-01 20:00:00")])
    run()
    _envelopes(spark, landed, [("t", 0, 4, "g", "2025-01-01 20:01:00"), ("t", 0, 1, "too late to judge", "2025-01-01 10:00:00")])
    rows, held = run()
    assert rows == ["a", "b", "c", "d", "e", "f", "g"] and held == 2


def test_a_listener_sees_more_batches_than_a_query_remembers(spark, tmp_path):
    topic, out, check = (str(tmp_path / x) for x in ("topic", "out", "check"))
    spark.range(120).selectExpr("cast(id AS string) AS value").repartition(120).write.text(topic)
    spark.range(200, 230).selectExpr("cast(id AS string) AS value").repartition(30).write.mode("append").text(topic)
    log = sm.ProgressLog(spark, str(tmp_path / "log"), flush_rows=40)
    spark.streams.addListener(log)
    try:
        query = sm.start_sink(sm.message_stream(spark, "text", path=topic, maxFilesPerTrigger=1), out, check)
        query.awaitTermination()
        for _ in range(300):
            if log.read().count() > 100 and not log.rows if (tmp_path / "log").exists() else False:
                break
            time.sleep(0.1)
    finally:
        spark.streams.removeListener(log)
        log.flush()
    seen = log.read().where("input_rows > 0")
    assert seen.count() > 100 >= len(query.recentProgress) and seen.agg({"input_rows": "sum"}).first()[0] == 150
    assert {r["run_id"] for r in seen.select("run_id").distinct().collect()} == {str(query.runId)}
