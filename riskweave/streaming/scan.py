"""Scans of JSON-lines records: of a file, with limit, resumption, summary and status; of a folder, as a stream."""

from __future__ import annotations

import time

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from riskweave.operators.context import guarded, with_context
from riskweave.operators.images import all_findings
from riskweave.operators.merge import merged, reports, review_queue, summary
from riskweave.sources.records import lines, parsed
from riskweave.session import scratch

COMPLETE, FAILED, PARTIAL = 0, 1, 2


def scanned_rows(rows: DataFrame, limit: int, mirror_folder: str | None, **limits: int) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(records that are scanned, rejected lines, merged findings) of parsed rows with a row_key.

    ``limit`` counts records that break no limit, in the order of row_key; 0 is all.
    """
    spark = rows.sparkSession
    path = scratch(spark, "scan-rows")  # written with its context: neither a second pass nor a lost executor computes that again
    rows = guarded(with_context(rows.withColumnRenamed("error", "unread")), **limits).withColumn("error", F.coalesce("unread", "error")).drop("unread")
    rows.write.parquet(path)
    rows = spark.read.schema(rows.schema).parquet(path)
    kept = rows.where("error is null").drop("error")
    kept = kept.orderBy("row_key").limit(limit) if limit else kept
    rejected = rows.where("error is not null").select("row_key", "error", F.substring("raw", 1, 200).alias("line"))
    if limit:  # lines behind the last record that counts were not reached
        last = kept.agg(F.max("row_key"), F.count("*")).first()
        rejected = rejected.where(F.col("row_key") < last[0]) if last[1] == limit else rejected
    return kept, rejected, merged(all_findings(kept, mirror_folder))


def scan_file(spark: SparkSession, path: str, out: str, offset: int = 0, limit: int = 0, resume: bool = False, mirror_folder: str | None = None, **limits: int) -> int:
    """Scans a JSON-lines file and returns 0 if all lines were records, 2 if some were not, 1 if none was scanned.

    Writes below ``out``: reports, needs_review, rejected, summary, and a checkpoint with the next line and the
    errors so far, last. ``resume`` goes on from there and adds to what is there; otherwise it is replaced.
    ``limits`` are those of ``guarded``.
    """
    began, before = time.time(), {"next_line": 0, "errors": 0, "records": 0}
    if resume:
        saved = spark.read.schema("next_line long, errors long, records long").json(f"{out}/checkpoint").first()
        before = saved.asDict() if saved else before
    rows = parsed(lines(spark, path, max(offset, before["next_line"]))).withColumn("row_key", F.col("line_no"))
    kept, rejected, found = scanned_rows(rows, limit, mirror_folder, **limits)
    found_path = scratch(spark, "scan-findings")
    found.write.parquet(found_path)
    found = spark.read.schema(found.schema).parquet(found_path)
    mode = "append" if resume else "overwrite"
    reports(kept, found).write.mode(mode).json(f"{out}/reports")
    review_queue(found).drop("row_key").write.mode(mode).json(f"{out}/needs_review")
    rejected.withColumnRenamed("row_key", "line_no").write.mode(mode).json(f"{out}/rejected")
    n, last = kept.agg(F.count("*"), F.max("row_key")).first()
    errors, worst = rejected.agg(F.count("*"), F.max("row_key")).first()
    after = {"next_line": max(x + 1 for x in (last, worst, before["next_line"] - 1) if x is not None), "errors": before["errors"] + errors, "records": before["records"] + n}
    text = summary(kept, found, time.time() - began)
    spark.createDataFrame([(text,)], "value string").coalesce(1).write.mode("overwrite").text(f"{out}/summary")
    spark.createDataFrame([tuple(after.values())], "next_line long, errors long, records long").coalesce(1).write.mode("overwrite").json(f"{out}/checkpoint")
    return COMPLETE if not after["errors"] else PARTIAL if after["records"] else FAILED


def scan_batch(rows: DataFrame, out: str, batch: int, mirror_folder: str | None = None) -> None:
    """Writes reports, review queue and rejected lines of one batch, each below its number: run again, it replaces them."""
    rows = rows.withColumn("row_key", F.monotonically_increasing_id())  # ids of records may be missing or repeat
    kept, rejected, found = scanned_rows(rows, 0, mirror_folder)
    found = found.persist()
    reports(kept, found).write.mode("overwrite").json(f"{out}/reports/batch={batch}")
    review_queue(found).drop("row_key").write.mode("overwrite").json(f"{out}/needs_review/batch={batch}")
    rejected.drop("row_key").write.mode("overwrite").json(f"{out}/rejected/batch={batch}")
    found.unpersist()


def scan_folder(spark: SparkSession, folder: str, out: str, files_at_once: int = 100, mirror_folder: str | None = None) -> StreamingQuery:
    """Scans what is in the folder and not yet scanned, then ends; ``out`` keeps the checkpoint."""
    new = spark.readStream.option("maxFilesPerTrigger", files_at_once).text(folder).where(F.trim("value") != "").withColumn("line_no", F.lit(-1).cast("long"))
    return parsed(new).writeStream.foreachBatch(lambda df, k: scan_batch(df, out, k, mirror_folder)).option("checkpointLocation", f"{out}/checkpoint").trigger(availableNow=True).start()


REPORT = "record_id string, platform string, scan_status string, finding_count int, findings array<struct<taxonomy_id:string,needs_review:boolean>>"
TOTAL = "kind string, name string, n long"


def measures(reports: DataFrame) -> DataFrame:
    """kind, name and n to be added up of each report: its platform, its status, its findings, and each category once a record."""
    one = lambda kind, name: F.struct(F.lit(kind).alias("kind"), name.alias("name"))
    found = F.coalesce(F.transform("findings", lambda f: F.struct(f["taxonomy_id"].alias("taxonomy_id"), f["needs_review"].alias("needs_review"))), F.array().cast("array<struct<taxonomy_id:string,needs_review:boolean>>"))
    each = F.concat(
        F.array(one("records", F.coalesce("platform", F.lit("unknown"))), one("status", F.col("scan_status"))),
        F.transform(found, lambda f: one("findings", f["taxonomy_id"])),
        F.transform(F.filter(found, lambda f: f["needs_review"]), lambda f: one("reviews", f["taxonomy_id"])),
        F.transform(F.array_distinct(F.transform(found, lambda f: f["taxonomy_id"])), lambda t: one("records_with", t)),
    )
    return reports.select(F.explode(each).alias("m")).select("m.kind", "m.name", F.lit(1).cast("long").alias("n"))


def added_up(rows: DataFrame) -> DataFrame:
    """The totals of measures: one row for each platform, status, category and kind of rejection."""
    return rows.groupBy("kind", "name").agg(F.sum("n").alias("n"))


def folder_totals(spark: SparkSession, out: str, files_at_once: int = 1000) -> StreamingQuery:
    """Adds what ``scan_folder`` has written since the last time to the totals of all its batches, then ends.

    A stateful aggregation over the reports and the rejected lines as streams of files: its state, as many rows as
    there are platforms and categories, and what it has read are kept below ``out/checkpoint-totals``, so totals
    go on after a restart and count no report twice. Nothing is scanned again. Writes totals, summary and status
    (0 if all lines were records, 2 if some were not, 1 if none was).
    """
    stream = lambda name, schema: spark.readStream.schema(schema).option("recursiveFileLookup", "true").option("maxFilesPerTrigger", files_at_once).json(f"{out}/{name}")
    rejected = stream("rejected", "error string").select(F.lit("rejected").alias("kind"), F.regexp_replace(F.coalesce("error", F.lit("")), "[0-9]+", "N").alias("name"), F.lit(1).cast("long").alias("n"))
    totals = added_up(measures(stream("reports", REPORT)).unionByName(rejected))
    return totals.writeStream.outputMode("complete").foreachBatch(lambda df, k: write_totals(df, out)).option("checkpointLocation", f"{out}/checkpoint-totals").trigger(availableNow=True).start()


def write_totals(totals: DataFrame, out: str) -> None:
    """Replaces totals, summary and status; all are a few rows, made from the totals by Spark."""
    spark = totals.sparkSession
    path = scratch(spark, "totals")
    totals.write.parquet(path)
    totals = spark.read.schema(TOTAL).parquet(path)
    totals.coalesce(1).write.mode("overwrite").json(f"{out}/totals")
    of = lambda kind: F.coalesce(F.sum(F.when(F.col("kind") == kind, F.col("n"))), F.lit(0))
    counts = totals.agg(of("records").alias("records"), of("findings").alias("findings"), of("reviews").alias("reviews"), of("rejected").alias("rejected"))
    status = F.when(F.col("rejected") == 0, COMPLETE).when(F.col("records") > 0, PARTIAL).otherwise(FAILED)
    counts.withColumn("status", status).coalesce(1).write.mode("overwrite").json(f"{out}/status")
    head = counts.select(F.lit(0).alias("part"), F.lit("").alias("name"), F.format_string("# Scan summary\n\n- records: %d\n- findings: %d\n- for review: %d\n- rejected lines: %d", "records", "findings", "reviews", "rejected").alias("value"))
    titles = {"records": "Platforms", "findings": "Findings by category", "rejected": "Rejected lines"}
    listed = [totals.where(F.col("kind") == kind).select(F.lit(k + 1).alias("part"), "name", F.format_string("- %s: %d", "name", "n").alias("value")) for k, kind in enumerate(titles)]
    heads = spark.createDataFrame([(k + 1, "", f"\n## {t}\n") for k, t in enumerate(titles.values())], "part int, name string, value string")
    lines_ = head.unionByName(heads)
    for more in listed:
        lines_ = lines_.unionByName(more)
    lines_.coalesce(1).sortWithinPartitions("part", "name").select("value").write.mode("overwrite").text(f"{out}/summary")


def scan_folder_whole(spark: SparkSession, folder: str, out: str, files_at_once: int = 100, mirror_folder: str | None = None) -> int:
    """Scans what is new in a folder and brings its totals up to date; returns the status of all that was ever scanned."""
    scan_folder(spark, folder, out, files_at_once, mirror_folder).awaitTermination()
    folder_totals(spark, out).awaitTermination()
    return spark.read.schema("status int").json(f"{out}/status").first().status
