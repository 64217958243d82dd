"""From messages to the columns that rules read: joined text, offsets, links, statistics."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from riskweave.functions import rx
from riskweave.functions import text as tx
from riskweave.session import ship

MESSAGES = "array<struct<role:string,content:string>>"
ATTACHMENTS = "array<struct<file_name:string,file_type:string,uri:string>>"
OFFSETS = "array<struct<s:int,e:int,role:string>>"
RECORD = ["record_id", "platform", "source_url", "title", "crawl_time", "messages", "attachments"]


def conversation_records(turns: DataFrame) -> DataFrame:
    """One record for each conv_id of a table of turns, in turn order; a group holds one conversation."""
    m = F.transform(F.array_sort(F.collect_list(F.struct("turn", "role", "text"))), lambda t: F.struct(F.upper(F.coalesce(t["role"], F.lit(""))).alias("role"), F.coalesce(t["text"], F.lit("")).alias("content")))
    rows = turns.groupBy(F.col("conv_id").cast("string").alias("record_id")).agg(m.cast(MESSAGES).alias("messages"))
    return _with_defaults(rows)


def text_records(rows: DataFrame, key: str, text: str, platform: Column | None = None, url: Column | None = None) -> DataFrame:
    """One record of a single USER message for each row of a table of texts."""
    message = F.array(F.struct(F.lit("USER").alias("role"), F.coalesce(F.col(text), F.lit("")).alias("content"))).cast(MESSAGES)
    rows = rows.select(F.col(key).cast("string").alias("record_id"), message.alias("messages"), (platform if platform is not None else F.lit("unknown")).alias("platform"), (url if url is not None else F.lit(None).cast("string")).alias("source_url"))
    return _with_defaults(rows)


def _with_defaults(rows: DataFrame) -> DataFrame:
    spare = {"platform": F.lit("unknown"), "source_url": F.lit(None).cast("string"), "title": F.lit(None).cast("string"), "crawl_time": F.lit(None).cast("string"), "attachments": F.array().cast(ATTACHMENTS)}
    return rows.withColumns({k: v for k, v in spare.items() if k not in rows.columns}).select(*RECORD)


def offsets(messages: Column) -> Column:
    """Start, end and role of each message in the joined text, two characters between neighbours."""
    start = F.struct(F.lit(0).alias("at"), F.array().cast(OFFSETS).alias("out"))

    def step(a: Column, m: Column) -> Column:
        end = a["at"] + F.length(m["content"])
        return F.struct((end + 2).alias("at"), F.concat(a["out"], F.array(F.struct(a["at"].alias("s"), end.alias("e"), m["role"].alias("role")))).alias("out"))

    return F.aggregate(messages, start, step, lambda a: a["out"])


def located(spans: Column, pos: Column) -> Column:
    """(message_index, role) of a position: the first message that holds it, its end included; otherwise the last."""
    k = F.array_position(F.transform(spans, lambda o: (o["s"] <= pos) & (pos <= o["e"])), True).cast("int")
    k = F.when(k > 0, k - 1).otherwise(F.greatest(F.size(spans) - 1, F.lit(0)))
    return F.struct(k.alias("message_index"), F.coalesce(F.get(spans, k)["role"], F.lit("")).alias("role"))


def with_context(records: DataFrame) -> DataFrame:
    """Adds text, spans, links, chars, ratio, longest_repeat and pair to records; those that have them stay as they are."""
    ship(records.sparkSession)
    if {"text", "spans", "links", "chars", "ratio", "longest_repeat", "pair"} <= set(records.columns):
        return records
    rows = records.withColumn("text", rx.clean(F.array_join(F.transform("messages", lambda m: m["content"]), "\n\n"))).withColumn("spans", offsets(F.col("messages")))
    return rows.withColumns({"links": tx.links("text"), "chars": F.length("text"), "ratio": tx.compression_ratio("text"), "longest_repeat": tx.repeated_prefix(F.col("text")), "pair": tx.top_pair("text")})


def guarded(records: DataFrame, max_chars: int = 2_000_000, max_messages: int = 2_000, max_links: int = 10_000) -> DataFrame:
    """Adds ``error``: the first limit that a record with context breaks, or null."""
    if min(max_chars, max_messages, max_links) < 1:
        raise ValueError("limits are at least 1")
    chars = F.aggregate("messages", F.lit(0), lambda a, m: a + F.length(m["content"]))
    return records.withColumn("error", F.when(F.size("messages") > max_messages, F.format_string("%d messages exceed the limit %d", F.size("messages"), F.lit(max_messages))).when(chars > max_chars, F.format_string("%d characters exceed the limit %d", chars, F.lit(max_chars))).when(F.size("links") > max_links, F.format_string("%d links exceed the limit %d", F.size("links"), F.lit(max_links))))
