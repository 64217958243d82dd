"""From raw findings to reported ones: first of equals, best two of a kind, corroboration, review, reports."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from riskweave.plans.taxonomy import categories

KEEP = 2


def unit(rows: DataFrame) -> str:
    """The column that tells records apart: ``row_key`` where rows have it, since record_id may be missing or repeat."""
    return "row_key" if "row_key" in rows.columns else "record_id"


def fingerprint():
    """16 hex digits that name a finding's category, pattern, place and text; missing places count as None."""
    part = lambda c: F.coalesce(F.col(c).cast("string"), F.lit("None"))
    place = F.concat_ws(":", part("message_index"), part("char_start"), part("char_end"))
    return F.substring(F.sha1(F.concat_ws("|", "taxonomy_id", "pattern_id", place, F.coalesce("matched_text", F.lit(""))).cast("binary")), 1, 16)


def merged(found: DataFrame, keep: int = KEEP) -> DataFrame:
    """Reported findings of each record with ``place`` in its report.

    Of findings with one fingerprint the first stays; of one category, message and pattern the ``keep`` most
    confident. Where static rules and the judge agree on a category, confidence rises by a quarter, to at most
    0.98; candidates for categories always go to review. Both windows of a record share one exchange.
    """
    one = unit(found)
    found = found.withColumn("fingerprint", fingerprint())
    first = found.withColumn("_k", F.row_number().over(Window.partitionBy(one, "fingerprint").orderBy("seq"))).where("_k = 1").drop("_k")
    kind = Window.partitionBy(one, "taxonomy_id", "message_index", "pattern_id")
    best = first.withColumns({"_rank": F.row_number().over(kind.orderBy(F.desc("confidence"), "seq")), "_met": F.min("seq").over(kind)}).where(F.col("_rank") <= keep)
    tracks = F.size(F.collect_set("detector").over(Window.partitionBy(one, "taxonomy_id")))
    best = best.withColumn("confidence", F.when(tracks == 2, F.least(F.col("confidence") * 1.25, F.lit(0.98))).otherwise(F.col("confidence")))
    status = F.broadcast(categories(found.sparkSession).select(F.col("id").alias("taxonomy_id"), "status"))
    best = best.join(status, "taxonomy_id", "left").withColumn("needs_review", F.col("needs_review") | (F.coalesce("status", F.lit("")) == "candidate")).drop("status")
    spot = F.coalesce(F.nullif(F.col("message_index"), F.lit(0)), F.lit(-1))
    place = F.row_number().over(Window.partitionBy(one).orderBy("taxonomy_id", spot, "_met", "_rank"))
    return best.withColumn("place", place).withColumn("confidence", F.bround("confidence", 3)).drop("_rank", "_met", "fingerprint")


def reports(records: DataFrame, found: DataFrame, statuses: DataFrame | None = None) -> DataFrame:
    """One row for each record: header, scan_status, counts and its findings in order."""
    one = unit(found)
    fields = [c for c in found.columns if c not in ("row_key", "record_id", "platform", "seq", "place")]
    per = found.groupBy(one).agg(F.array_sort(F.collect_list(F.struct("place", *fields))).alias("findings"), F.count_if("needs_review").alias("needs_review_count"))
    rows = records.select(*{one: 0, "record_id": 0}, "platform", "title").join(per, one, "left")
    if statuses is not None:
        by = one if one in statuses.columns else "record_id"
        worst = statuses.groupBy(by).agg(F.max(F.col("status") == "failed").alias("failed"), F.max(F.col("status") == "partial").alias("partial"))
        rows = rows.join(worst, by, "left").withColumn("scan_status", F.when(F.col("failed"), "failed").when(F.col("partial"), "partial").otherwise("complete")).drop("failed", "partial")
    else:
        rows = rows.withColumn("scan_status", F.lit("complete"))
    return rows.select("record_id", "platform", "title", "scan_status", F.coalesce(F.size("findings"), F.lit(0)).alias("finding_count"), F.coalesce("needs_review_count", F.lit(0)).alias("needs_review_count"), "findings")


def review_queue(found: DataFrame) -> DataFrame:
    """The findings that a person should look at."""
    return found.where("needs_review")


def by_category(found: DataFrame) -> DataFrame:
    """Findings, records and reviews of each category."""
    return found.groupBy("taxonomy_id").agg(F.count("*").alias("n_findings"), F.count_distinct(unit(found)).alias("n_records"), F.count_if("needs_review").alias("n_reviews"))


def totals(records: DataFrame, found: DataFrame) -> DataFrame:
    """Records, findings and reviews of each platform."""
    n = records.groupBy("platform").agg(F.count("*").alias("n_records"))
    f = found.groupBy("platform").agg(F.count("*").alias("n_findings"), F.count_if("needs_review").alias("n_reviews"))
    return n.join(f, "platform", "left").fillna(0, ["n_findings", "n_reviews"])


def summary(records, found, seconds: float) -> str:
    """A short report in Markdown from a few counted rows: totals, platforms, findings by category, categories that no rule looks for."""
    platforms = records.groupBy("platform").count().orderBy("platform").collect()
    hits = by_category(found).orderBy(F.desc("n_findings"), "taxonomy_id").collect()
    skipped = categories(found.sparkSession).where("status = 'skipped'").agg(F.array_sort(F.collect_list("id")).alias("ids")).first().ids
    lines = ["# Scan summary", "", f"- records: {sum(r['count'] for r in platforms)}", f"- findings: {sum(r.n_findings for r in hits)}", f"- for review: {sum(r.n_reviews for r in hits)}", f"- seconds: {seconds:.1f}", f"- categories left out: {', '.join(skipped)}", "", "## Platforms", ""]
    lines += [f"- {r['platform']}: {r['count']}" for r in platforms] + ["", "## Findings by category", ""] + [f"- {r.taxonomy_id}: {r.n_findings}" for r in hits]
    return "\n".join(lines) + "\n"
