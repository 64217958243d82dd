"""JSON-lines records: lines with numbers, tolerant parsing, and the reason why a line is no record."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from riskweave.operators.context import ATTACHMENTS, MESSAGES, RECORD
from riskweave.session import scratch

from . import jsonlines

#: Byte ranges of an input up to which their first lines are broadcast (16 bytes each); beyond, they are joined by a shuffle.
BROADCAST_RANGES = 1 << 20
FIELDS = ["share_id", "unique_uid", "platform", "source_url", "conversation_title", "crawl_time"]


def lines(spark: SparkSession, path: str, offset: int = 0, split_bytes: int = jsonlines.SPLIT_BYTES) -> DataFrame:
    """line_no (from 0, blank lines counted) and value of the lines from ``offset`` on that are not blank.

    Byte ranges are counted first; a running sum over ranges says where each begins, and is joined to the lines. Ranges
    that end before the offset are not read again. The driver gets one number.
    """
    try:
        jsonlines.filesystem(path)
    except pa.ArrowInvalid:
        return _spark_lines(spark, path, offset)  # a file system that only Spark reads
    jsonlines.register(spark)
    counts = scratch(spark, "line-counts")
    spark.read.format(jsonlines.NAME).options(counts="true", splitBytes=split_bytes).load(path).write.parquet(counts)
    upto = F.sum("n_lines").over(Window.orderBy("split"))  # one row for each range, not for each line
    begin = spark.read.schema(jsonlines.COUNTS).parquet(counts).select("split", (upto - F.col("n_lines")).alias("begin"), upto.alias("upto"))
    ranges, skipped = begin.agg(F.count("*"), F.count_if(F.col("upto") <= offset)).first()
    begin = F.broadcast(begin.drop("upto")) if ranges <= BROADCAST_RANGES else begin.drop("upto")
    rows = spark.read.format(jsonlines.NAME).options(first=skipped, splitBytes=split_bytes).load(path).join(begin, "split")
    return rows.select((F.col("begin") + F.col("row")).alias("line_no"), "value").where((F.col("line_no") >= offset) & (F.trim("value") != ""))


def _spark_lines(spark: SparkSession, path: str, offset: int) -> DataFrame:
    """The same by Spark's own text source, whose splits are counted by their partition numbers."""
    raw = spark.read.text(path).select(F.spark_partition_id().alias("split"), F.monotonically_increasing_id().alias("id"), "value")
    counts = raw.groupBy("split").agg(F.count("*").alias("n_lines"))
    begin = counts.select("split", (F.sum("n_lines").over(Window.orderBy("split")) - F.col("n_lines")).alias("begin"))
    row = F.col("id").bitwiseAND((1 << 33) - 1)
    return raw.join(begin, "split").select((F.col("begin") + row).alias("line_no"), "value").where((F.col("line_no") >= offset) & (F.trim("value") != ""))


def _text(v: Column) -> Column:
    return F.coalesce(F.nullif(v, F.lit("")), F.lit(None).cast("string"))


def _get(path: str) -> Column:
    return F.get_json_object("value", path)


def _kind(path: str) -> Column:
    """Type of a value in the line's JSON; null where it is missing."""
    v = F.try_variant_get(F.try_parse_json("value"), path, "variant")
    return F.schema_of_variant(v)


def parsed(rows: DataFrame) -> DataFrame:
    """line_no, error and the record's columns of each line; ``error`` is null for records."""
    parts = F.from_json(_get("$.messages"), "array<struct<role:string,content:string>>")
    segments = lambda c: F.array_join(F.transform(F.from_json(c, "array<string>"), lambda s: F.when(F.ltrim(s).startswith("{"), F.coalesce(F.get_json_object(s, "$.text"), F.lit(""))).otherwise(s)), "\n")
    content = lambda m: F.coalesce(F.when(F.ltrim(m["content"]).startswith("["), segments(m["content"])), m["content"], F.lit(""))
    messages = F.transform(F.coalesce(parts, F.array().cast(MESSAGES)), lambda m: F.struct(F.upper(F.coalesce(m["role"], F.lit(""))).alias("role"), content(m).alias("content"))).cast(MESSAGES)
    one_of = lambda a, *names: F.coalesce(*(F.nullif(F.get_json_object(a, f"$.{n}"), F.lit("")) for n in names))
    listed = F.transform(F.filter(F.from_json(_get("$.attachment_info"), "array<string>"), lambda a: F.ltrim(a).startswith("{")), lambda a: F.struct(one_of(a, "file_name", "fileName").alias("file_name"), one_of(a, "file_type", "mime_type", "fileMimeType").alias("file_type"), one_of(a, "file_uri", "fileUri", "url").alias("uri")))
    own = lambda k: F.transform(F.coalesce(F.from_json(_get(f"$.attachment_info.{k}"), "array<string>"), F.array().cast("array<string>")), lambda a: F.struct(*(F.get_json_object(a, f"$.{n}").alias(n) for n in ("file_name", "file_type", "uri"))))
    attachments = F.when(F.ltrim(_get("$.attachment_info")).startswith("["), listed).when(F.ltrim(_get("$.attachment_info")).startswith("{"), F.concat(own("files"), own("images"), own("attachments"))).otherwise(F.array().cast(ATTACHMENTS)).cast(ATTACHMENTS)
    whole, inner = _kind("$"), _kind("$.messages")
    odd = F.exists(F.coalesce(F.from_json(_get("$.messages"), "array<string>"), F.array().cast("array<string>")), lambda m: m.isNull() | ~F.ltrim(m).startswith("{"))
    error = (
        F.when(F.try_parse_json("value").isNull(), "invalid JSON")
        .when(~whole.startswith("OBJECT"), "top level is not an object")
        .when(inner.isNotNull() & (~inner.startswith("ARRAY") | odd), "messages is not a list of objects")
    )
    f = {n: _get(f"$.{n}") for n in FIELDS}
    cols = {
        "record_id": F.coalesce(_text(f["share_id"]), _text(f["unique_uid"]), F.lit("")), "platform": F.coalesce(_text(f["platform"]), F.lit("unknown")), "source_url": f["source_url"], "title": f["conversation_title"],
        "crawl_time": f["crawl_time"], "messages": messages, "attachments": F.coalesce(attachments, F.array().cast(ATTACHMENTS)),
    }
    return rows.select("line_no", error.alias("error"), *(cols[c].alias(c) for c in RECORD), F.col("value").alias("raw"))


def read_records(spark: SparkSession, path: str, offset: int = 0, limit: int = 0) -> tuple[DataFrame, DataFrame]:
    """Records, told apart by row_key, and rejected lines (line_no, error) of a JSON-lines file; ``limit`` records at most, 0 for all."""
    rows = parsed(lines(spark, path, offset)).withColumn("row_key", F.col("line_no"))
    good = rows.where("error is null").drop("error")
    return (good.orderBy("line_no").limit(limit) if limit else good), rows.where("error is not null").select("line_no", "error")
