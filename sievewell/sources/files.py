"""File sources: XML, lake tables, JSON lines, prompts, batches, fingerprints."""

from __future__ import annotations

import re

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sievewell.operators.guardrail import kind_of
from sievewell.session import broadcast_if_small, written_once


def read_xml(
    spark: SparkSession,
    path: str,
    row_tag: str,
    schema: T.StructType | str | None = None,
    sampling_ratio: float | None = None,
    exclude_attribute: bool = False,
    mode: str = "PERMISSIVE",
) -> DataFrame:
    """One row per outermost ``row_tag`` element.

    With a schema, files are split between tasks like any text, see :func:`xml_elements`; the few
    that it cannot split are read by one task each. Without one, the built-in reader infers it: a pass over all files, or the sampled share
    of them, by one task for each file.
    """
    reader = spark.read.format("xml").option("rowTag", row_tag).option("mode", mode)
    reader = reader.option("excludeAttribute", exclude_attribute)
    if schema is not None:
        if not isinstance(schema, str):
            schema = schema.toDDL()
        options = {"mode": mode, "excludeAttribute": str(exclude_attribute).lower()}
        elements, whole = xml_elements(spark, path, row_tag)
        # by a generator, which later filters on the fields are not pushed below: each would parse the element again
        parsed = elements.select(F.inline(F.array(F.from_xml("element", F.lit(schema), options))))
        return parsed.unionByName(reader.schema(schema).load(whole)) if whole else parsed
    if sampling_ratio is not None:
        reader = reader.option("samplingRatio", sampling_ratio)
    return reader.load(path)


def xml_elements(spark: SparkSession, path: str, row_tag: str) -> tuple[DataFrame, list[str]]:
    """(element): the text of each outermost ``row_tag`` element of the files at ``path``, and files to be read whole.

    Files are read as text that ends records at the closing tag, so a file is split by size.
    Nearly all records are whole elements. Where elements of the same name stand inside an
    element, its records are told by the depth of open tags, which is summed up within each
    split, and over splits from one row for each; only those records are moved to be joined.
    Elements without content (``<tag/>``) count where they are outermost. Tags in comments and
    CDATA sections are none. A file in which a comment or section holds a closing tag, so that
    it is cut by one, is left out and listed: only a reader of whole files can tell its tags.
    Tags that are never closed make no element.
    """
    close, tag = f"</{row_tag}>", re.escape(row_tag)
    opening, empty = rf"<{tag}(?:\s(?:[^>]*[^>/])?)?>", rf"<{tag}(?:\s[^>]*)?/>"
    parts = spark.read.option("lineSep", close).text(path).select(
        "value", F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("split"), F.monotonically_increasing_id().alias("nth")
    )
    # plain tests come first: most records hold no comment, section or element of the name inside
    without = lambda c, mark, pattern: F.when(F.contains(c, F.lit(mark)), F.regexp_replace(c, pattern, "")).otherwise(F.col(c))
    parts = parts.withColumn("value", without("value", "<!--", "(?s)<!--.*?-->")).withColumn("seen", without("value", "<![CDATA[", r"(?s)<!\[CDATA\[.*?\]\]>"))
    start = lambda c: F.split(c, opening, 2)[0]
    cut = F.contains("seen", F.lit("<!--")) | F.contains("seen", F.lit("<![CDATA[")) | (F.contains("value", F.lit("<![CDATA[")) & F.contains(start("value"), F.lit("<![CDATA[")))
    parts = parts.select("file", "split", "nth", "value", F.regexp_count("seen", F.lit(opening)).alias("opens"), start("seen").alias("start"), cut.alias("cut"))
    # the last record of a file ends without a closing tag; it opens no element that is ever closed
    parts = parts.withColumn("step", F.col("opens") - 1)
    sums = parts.groupBy("file", "split").agg(F.sum("step").alias("total"), F.max("opens").alias("most"), F.bool_or("cut").alias("cut"))
    before = F.coalesce(F.sum("total").over(W.partitionBy("file").orderBy("split").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    starts = written_once(sums.select(F.col("file").alias("s_file"), F.col("split").alias("s_split"), before.alias("depth"), "most", "cut"), "xml-splits")
    whole_files = sorted(r[0] for r in starts.where("cut").select("s_file").distinct().collect())
    if whole_files:
        parts, starts = parts.where(~F.col("file").isin(whole_files)), starts.where(~F.col("s_file").isin(whole_files))
    head = F.concat(F.regexp_extract("value", f"(?s)({opening}.*)", 1), F.lit(close))
    none = F.array().cast("array<string>")
    empties = F.when(F.contains("start", F.lit("/>")), F.regexp_extract_all("start", F.lit(empty), F.lit(0))).otherwise(none)
    if (starts.agg(F.max("most")).first()[0] or 0) <= 1:  # no element inside another of its name: nothing to join
        return parts.select(F.explode(F.concat(empties, F.when(F.col("opens") == 1, F.array(head)).otherwise(none))).alias("element")), whole_files
    starts = broadcast_if_small(starts.drop("most", "cut"))
    placed = parts.join(starts, (F.col("file") == F.col("s_file")) & (F.col("split") == F.col("s_split")))
    inside = W.partitionBy("file", "split").orderBy("nth")
    after = F.col("depth") + F.sum("step").over(inside)
    placed = placed.withColumn("after", after).withColumn("whole", (F.col("opens") == 1) & (F.col("after") == 0))
    single = placed.where("whole").select(head.alias("element"))
    outer = placed.where("after = step").select(F.explode(empties).alias("element"))  # at depth 0 before the record
    # records of nested elements: a group ends where the depth is 0 again
    rest = placed.where("NOT whole").select("file", "split", "nth", "value", "after")
    ends = rest.where("after = 0").groupBy("file", "split").agg(F.count("*").alias("n"))
    earlier = F.coalesce(F.sum("n").over(W.partitionBy("file").orderBy("split").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    counted = rest.select("file", "split").distinct().join(ends, ["file", "split"], "left").na.fill({"n": 0}).select("file", "split", "n")
    offsets = broadcast_if_small(counted.select("file", "split", earlier.alias("earlier")))
    rest = rest.join(offsets, ["file", "split"])
    closed = F.coalesce(F.sum((F.col("after") == 0).cast("int")).over(inside.rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    rest = rest.withColumn("group", F.col("earlier") + closed)
    joined = rest.groupBy("file", "group").agg(
        F.array_sort(F.collect_list(F.struct("split", "nth", "value"))).alias("parts"), F.min("after").alias("lowest")
    )
    text = F.concat(F.array_join(F.transform("parts", lambda p: p["value"]), close), F.lit(close))
    nested = joined.where("lowest = 0").select(F.regexp_extract(text, f"(?s)({opening}.*)", 1).alias("element"))
    return single.unionByName(outer).unionByName(nested), whole_files


def path_exists(spark: SparkSession, path: str) -> bool:
    try:
        spark.read.format("binaryFile").load(path)
        return True
    except AnalysisException:
        return False


def read_any(spark: SparkSession, path: str) -> DataFrame:
    """A lake table when the folder has a transaction log, else parquet.

    Reading a lake table's folder as parquet would also return superseded files.
    """
    fmt = "delta" if path_exists(spark, f"{path.rstrip('/')}/_delta_log") else "parquet"
    return spark.read.format(fmt).load(path)


def read_table(spark: SparkSession, path: str, fmt: str = "parquet") -> DataFrame:
    return spark.read.format(fmt).load(path)


def read_by_suffix(spark: SparkSession, path: str, schema: T.StructType | str | None = None) -> DataFrame:
    """Parquet for ``.parquet`` and folders, CSV with header for ``.csv``."""
    if path.lower().endswith(".csv"):
        reader = spark.read.option("header", True)
        return (reader.schema(schema) if schema is not None else reader).csv(path)
    if path.lower().endswith(".parquet") or "." not in path.rstrip("/").rsplit("/", 1)[-1]:
        return spark.read.parquet(path)
    raise ValueError(f"Unsupported input format: {path}")


def read_jsonl(spark: SparkSession, path: str, schema: T.StructType | str) -> DataFrame:
    """JSON lines by path or glob with a fixed schema."""
    return spark.read.schema(schema).json(path)


def read_enriched_jsonl(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """Records from flat lines or from ``{"raw": …, "llm_enriched": …}`` lines.

    A key of the enriched part replaces the same key of the raw part, also with
    null; lines that are no JSON object are skipped.
    """
    lines = spark.read.text(path).select(F.try_parse_json(F.btrim("value")).alias("v"))
    v = F.col("v")
    kept = lines.where(F.startswith(F.schema_of_variant(v), F.lit("OBJECT")))
    nested = kind_of(v, "$.raw").isNotNull()

    def field(f: T.StructField) -> Column:
        at = lambda part: F.try_variant_get(v, f"$.{part}{f.name}", f.dataType.simpleString())
        replaced = kind_of(v, f"$.llm_enriched.{f.name}").isNotNull()
        return (
            F.when(nested & replaced, at("llm_enriched."))
            .when(nested, at("raw."))
            .otherwise(at(""))
            .alias(f.name)
        )

    return kept.select(*[field(f) for f in schema.fields])


def with_line_numbers(lines: DataFrame) -> DataFrame:
    """Add ``line_number`` from 0 over all files in path order.

    Each file split counts its own lines; the lines of the splits before it are
    added from a table of one row per split.
    """
    tagged = lines.select(
        "*",
        F.col("_metadata.file_path").alias("_file"),
        F.col("_metadata.file_block_start").alias("_start"),
        F.monotonically_increasing_id().alias("_mono"),
    )
    splits = tagged.groupBy("_file", "_start").agg(F.min("_mono").alias("_first"), F.count("*").alias("_n"))
    earlier = W.orderBy("_file", "_start").rowsBetween(W.unboundedPreceding, -1)
    offsets = splits.select("_file", "_start", "_first", F.coalesce(F.sum("_n").over(earlier), F.lit(0)).alias("_off"))
    joined = tagged.join(broadcast_if_small(offsets), ["_file", "_start"])
    number = F.col("_off") + F.col("_mono") - F.col("_first")
    return joined.withColumn("line_number", number).select(*lines.columns, "line_number")


def read_prompts(spark: SparkSession, path: str) -> DataFrame:
    """Prompts from JSON lines: ``query`` from query, prompt or text; the id defaults to the line number."""
    lines = with_line_numbers(spark.read.text(path)).withColumn("v", F.try_parse_json(F.btrim("value")))
    v = F.col("v")
    get = lambda f, t="string": F.try_variant_get(v, f"$.{f}", t)
    there = lambda f: kind_of(v, f"$.{f}").isNotNull()
    query = (
        F.when(there("query"), get("query"))
        .when(there("prompt"), get("prompt"))
        .when(there("text"), get("text"))
        .otherwise(F.lit(""))
    )
    ident = F.when(there("prompt_id"), get("prompt_id", "bigint")).otherwise(F.col("line_number"))
    kept = lines.where(F.startswith(F.schema_of_variant(v), F.lit("OBJECT")))
    return kept.select(
        ident.alias("prompt_id"),
        query.alias("query"),
        *[get(f).alias(f) for f in ("drug_id", "drug_name", "query_type", "expected_drug")],
    )


def list_files(spark: SparkSession, path: str) -> DataFrame:
    """(path, modified, bytes) of the files below a folder; contents are not read."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path)
    return files.select("path", F.col("modificationTime").alias("modified"), F.col("length").alias("bytes"))


def latest_batch(spark: SparkSession, path: str) -> str:
    """Path of the most recently modified file below a folder; the last name on ties."""
    newest = list_files(spark, path).agg(F.max(F.struct("modified", "path")).alias("f")).first()["f"]
    if newest is None:
        raise FileNotFoundError(f"no files below {path}")
    return newest["path"]


def source_fingerprint(spark: SparkSession, path: str) -> DataFrame:
    """(path, bytes, sha256) per file. A file must fit one row; see :func:`line_fingerprint`."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path)
    return files.select("path", F.col("length").alias("bytes"), F.sha2("content", 256).alias("sha256"))


def folder_fingerprint(spark: SparkSession, path: str) -> str:
    """A sha256 over the names, line counts and line digests of the text files below a folder, whatever their size."""
    name = F.element_at(F.split("path", "/"), -1)
    rows = line_fingerprint(spark, path).select(F.concat_ws("|", name, "line_count", "digest").alias("row"))
    # One row for each file; sums do not depend on the order of files.
    parts = [F.sum(F.conv(F.substring(F.sha2("row", 256), 1 + 15 * k, 15), 16, 10).cast("decimal(38,0)")).cast("string") for k in range(4)]
    return rows.agg(F.sha2(F.concat_ws("|", F.count("*"), *parts), 256)).first()[0]


def line_fingerprint(spark: SparkSession, path: str) -> DataFrame:
    """(path, line_count, digest) per text file of any size.

    The digest adds up the hashes of the lines, so splits are hashed apart and
    no task reads a whole file. It does not see the order of the lines.
    """
    lines = spark.read.text(path).select(F.col("_metadata.file_path").alias("path"), "value")
    digest = F.sum(F.xxhash64("value").cast("decimal(38,0)")).cast("string")
    return lines.groupBy("path").agg(F.count("*").alias("line_count"), digest.alias("digest"))


LEAF_LINES, FAN_OUT = 1024, 1024


def ordered_fingerprint(spark: SparkSession, path: str) -> DataFrame:
    """(path, bytes, line_count, sha256) per text file of any size: a digest of the lines in their order.

    A tree of hashes: a leaf is the SHA-256 of the hashes of ``LEAF_LINES`` lines, a node that of
    ``FAN_OUT`` nodes below it, and the digest that of the top node with the numbers of lines and
    bytes. Where a file is split does not matter: a line is placed by its number in its split and the
    lines of the splits before, of which there is one row each. So no task holds more than a leaf's lines,
    and two lines that change places change the digest. Lines end at a line feed; a carriage return
    belongs to its line, and a missing last line end shows in the bytes. An empty file has no row.
    """
    lines = spark.read.option("lineSep", "\n").text(path).select(
        F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_block_start").alias("start"), F.col("_metadata.file_size").alias("bytes"),
        F.monotonically_increasing_id().alias("id"), F.sha2("value", 256).alias("hash"),
    )
    # rows of a split come one after the other, so ids count its lines
    splits = lines.groupBy("path", "start").agg(F.min("id").alias("first"), F.count("*").alias("n"))
    before = F.coalesce(F.sum("n").over(W.partitionBy("path").orderBy("start").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    splits = written_once(splits.select("path", "start", "first", "n", before.alias("before")), "line-splits")
    placed = lines.join(broadcast_if_small(splits.drop("n")), ["path", "start"])
    nodes = placed.select("path", "bytes", (F.col("id") - F.col("first") + F.col("before")).alias("place"), "hash")
    counts = splits.groupBy("path").agg(F.sum("n").alias("line_count"))
    most, wide = counts.agg(F.max("line_count")).first()[0] or 0, LEAF_LINES
    while True:
        nodes = nodes.groupBy("path", "bytes", F.floor(F.col("place") / wide).alias("place")).agg(F.array_sort(F.collect_list(F.struct("place", "hash"))).alias("below"))
        nodes = nodes.select("path", "bytes", "place", F.sha2(F.array_join("below.hash", ""), 256).alias("hash"))
        most, wide = -(-most // wide), FAN_OUT
        if most <= 1:
            break
    top = F.sha2(F.concat_ws("|", "hash", F.col("line_count").cast("string"), F.col("bytes").cast("string")), 256)
    return nodes.join(counts, "path").select("path", "bytes", "line_count", top.alias("sha256"))
