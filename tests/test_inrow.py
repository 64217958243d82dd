import base64
import hashlib
import json

from pyspark.sql import functions as F

from riskweave.operators.annotate import findings
from riskweave.operators.context import text_records
from riskweave.operators.images import all_findings
from riskweave.operators.inrow import reports_in_rows, with_findings
from riskweave.operators.merge import merged, reports
from riskweave.queries import PROBES

from .test_annotate import CASES
from .test_images import hidden, png


def records(spark, sf):
    texts = [t for t, _, _ in CASES] + PROBES + ["\n\n".join(PROBES), " ".join(f"u{k}@corp-mail.com" for k in range(40)), None, ""]
    rows = text_records(spark.createDataFrame(list(enumerate(texts)), "id long, text string"), "id", "text")
    many = spark.read.parquet(f"{sf}/documents.parquet").withColumn("key", F.concat(F.lit("d"), "doc_id"))
    talks = F.array(*(F.struct(F.lit(r).alias("role"), F.lit(t).alias("content")) for r, t in (("USER", PROBES[0]), ("ASSISTANT", PROBES[0] + PROBES[4]), ("USER", PROBES[8]))))
    talk = rows.where("record_id = '0'").withColumns({"record_id": F.lit("talk"), "messages": talks})
    return rows.unionByName(text_records(many, "key", "text", F.col("source"))).unionByName(talk)


def test_equals_windows(spark, sf):
    """Each record's findings, in order, as the merge over windows has them."""
    rows = records(spark, sf)
    want = {r.record_id: r for r in reports(rows, merged(all_findings(rows))).collect()}
    got = {r.record_id: r for r in reports_in_rows(rows).collect()}
    assert want.keys() == got.keys() and sum(r.finding_count for r in want.values()) > 100
    for k, r in want.items():
        assert (r.finding_count, r.needs_review_count) == (got[k].finding_count, got[k].needs_review_count), k
        assert [f.asDict() for f in r.findings or []] == [f.asDict() for f in got[k].findings], k


def test_more_of_a_kind(spark, sf):
    rows = records(spark, sf).where("record_id not like 'd%'")
    n = merged(findings(rows, ["pii"]), keep=5).groupBy("record_id").count().collect()
    got = {r.record_id: len(r.findings) for r in with_findings(rows, ["pii"], keep=5).collect()}
    assert {r.record_id: r["count"] for r in n} == {k: v for k, v in got.items() if v} and max(got.values()) >= 5


def test_plain_stream(spark, tmp_path):
    """Annotation and merge on a stream without foreachBatch; records without an id stay apart."""
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.txt").write_text("mail a.b@corp-mail.com\n" * 4)
    lines = spark.readStream.text(str(tmp_path / "in")).select(F.lit("").alias("id"), F.col("value").alias("text"))
    out = reports_in_rows(text_records(lines, "id", "text"))
    out.writeStream.format("json").option("checkpointLocation", str(tmp_path / "c")).option("path", str(tmp_path / "out")).trigger(availableNow=True).start().awaitTermination()
    got = [json.loads(r.value) for r in spark.read.text(str(tmp_path / "out")).collect()]
    assert len(got) == 4 and all(r["record_id"] == "" and r["finding_count"] == 1 for r in got)


def test_images_in_rows(spark, tmp_path):
    """Nested, inline and mirrored images of each record, on a table as the joins have them, and on a plain stream."""
    uri = "data:image/png;base64," + base64.b64encode(png(hidden())).decode()
    link = "https://h.example/a/b.png"
    (tmp_path / "mirror").mkdir()
    (tmp_path / "in").mkdir()
    name = tmp_path / "mirror" / hashlib.sha1(link.encode()).hexdigest()
    name.with_suffix(".gif").write_bytes(b"GIF89a")
    name.with_suffix(".png").write_bytes(png(hidden()))
    nested = json.dumps({"messages": [{"role": "assistant", "extra": {"a": "https://h.example/x.jpg", "b": [uri[:100], "data:image/gif;base64,R0lGODlhAQABAAAAACw="]}}]})
    texts = [("a", f"see {link} or https://h.example/none.png", nested), ("b", f"{uri} and {uri}", None), ("c", "data:image/png;base64,@@ no image", "{bad"), ("", "nothing", None), ("", None, "[]")]
    lines = [json.dumps({"id": i, "text": t, "raw": r}) for i, t, r in texts]
    (tmp_path / "in" / "a.json").write_text("\n".join(lines))

    def made(rows):
        rows = rows.withColumn("k", F.concat_ws("#", "id", "text"))
        return text_records(rows, "k", "text").join(rows.select(F.col("k").alias("record_id"), "raw"), "record_id")

    schema = "id string, text string, raw string"
    table = made(spark.read.schema(schema).json(str(tmp_path / "in")))
    for folder in (None, str(tmp_path / "mirror")):
        want = {r.record_id: r for r in reports(table, merged(all_findings(table, folder))).collect()}
        got = {r.record_id: r for r in reports_in_rows(table, mirror_folder=folder).collect()}
        assert want.keys() == got.keys()
        for k, r in want.items():
            assert [f.asDict() for f in r.findings or []] == [f.asDict() for f in got[k].findings], k
        rules = {k[:1]: [f.rule for f in r.findings if f.rule in ("G-1", "G-4")] for k, r in got.items()}
        assert rules["b"] == ["G-4"] and rules["a"].count("G-1") == 2 and ("G-4" in rules["a"]) == (folder is not None) and not rules["c"]
    kept = with_findings(table, ["pii"])
    assert kept.columns == [*table.columns, "findings"] and kept.schema["raw"].dataType.simpleString() == "string"
    plain = spark.readStream.schema(schema).json(str(tmp_path / "in"))
    records = text_records(plain, "id", "text").withColumn("raw", F.lit(nested))
    out = reports_in_rows(records, ["stego_imagery"], str(tmp_path / "mirror"))
    out.writeStream.format("json").option("checkpointLocation", str(tmp_path / "c")).option("path", str(tmp_path / "out")).trigger(availableNow=True).start().awaitTermination()
    got = [json.loads(r.value) for r in spark.read.text(str(tmp_path / "out")).collect()]
    assert len(got) == 5 and all(sum(f["rule"] == "G-1" for f in r["findings"]) == 2 for r in got) and sum(f["rule"] == "G-4" for r in got for f in r["findings"]) == 2
