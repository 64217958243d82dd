import json

from riskweave.operators.annotate import findings
from riskweave.operators.chunks import chunked, judge_all, judged_findings, usage, verdicts
from riskweave.operators.merge import merged, reports
from riskweave.sources.records import read_records

HIT = json.dumps({"hit": True, "confidence": 0.6, "evidence": "needle", "reasoning": "r"})
NO = json.dumps({"hit": False, "confidence": 0.0, "evidence": "", "reasoning": "r"})


def keyword(name, prompt):
    return HIT if "needle" in prompt else NO


def put(tmp_path, rows):
    path = tmp_path / "a.jsonl"
    path.write_text("".join(json.dumps(r) + "\n" for r in rows))
    return str(path)


def test_records_without_ids_are_judged_each_by_itself(spark, tmp_path):
    """Three records without an id, of which one holds the word: its findings are its own."""
    said = lambda text, **more: {"messages": [{"role": "user", "content": text}], **more}
    records, _ = read_records(spark, put(tmp_path, [said("one"), said("the needle"), said("three"), said("x needle", share_id="s"), said("none", share_id="s")]))
    calls = judge_all(chunked(records), keyword).persist()
    found, status = judged_findings(verdicts(calls), records)
    n = calls.select("taxonomy_id").distinct().count()
    assert calls.count() == status.count() == 5 * n and {r.status for r in status.collect()} == {"ok"}
    got = found.groupBy("row_key").count().collect()
    assert sorted((r.row_key, r["count"]) for r in got) == [(1, n), (3, n)]
    assert {(r.row_key, r.char_start, r.matched_text) for r in found.collect()} == {(1, 4, "needle"), (3, 2, "needle")}
    rows = merged(findings(records).unionByName(found))
    whole = reports(records, rows, status).collect()
    assert len(whole) == 5 and sorted(r.finding_count for r in whole) == [0, 0, 0, n, n] and {r.scan_status for r in whole} == {"complete"}

    def fails(name, prompt):
        if "three" in prompt:
            raise ValueError("down")
        return NO

    _, status = judged_findings(verdicts(judge_all(chunked(records), fails, wait=0)), records)
    whole = reports(records, rows, status).collect()
    assert sorted(r.scan_status for r in whole) == ["complete"] * 4 + ["failed"]


def test_strong_findings_of_a_record_skip_its_own_questions(spark, tmp_path):
    said = lambda text: {"messages": [{"role": "user", "content": text}]}
    records, _ = read_records(spark, put(tmp_path, [said("one"), said("two")]))
    strong = spark.createDataFrame([(0, "", "A-I-1", 0.9)], "row_key long, record_id string, taxonomy_id string, confidence double")
    skipped = judge_all(chunked(records), keyword, found=strong).where("error = 'skipped'").collect()
    assert [(r.row_key, r.taxonomy_id) for r in skipped] == [(0, "A-I-1")]


def test_replies_are_stored(spark, tmp_path):
    """A judge that counts its calls: none is made twice, neither for equal prompts nor by a run that is repeated."""
    log, store = tmp_path / "calls", str(tmp_path / "store")
    log.mkdir()
    folder = str(log)

    def counting(name, prompt):
        import os
        import uuid

        with open(os.path.join(folder, uuid.uuid4().hex), "w") as f:
            f.write(f"{name}|{prompt}")
        if "broken" in prompt and not os.path.exists(os.path.join(folder, "mended")):
            raise ValueError("down")
        return keyword(name, prompt), 10, 1

    said = lambda *texts: read_records(spark, put(tmp_path, [{"messages": [{"role": "user", "content": t}]} for t in texts]))[0]
    calls = lambda: len([p for p in log.iterdir() if p.name != "mended"])
    first = judge_all(chunked(said("needle", "needle", "hay")), counting, store=store, rounds=2, wait=0)
    n = first.select("taxonomy_id").distinct().count()
    assert first.count() == 3 * n and calls() == 2 * n
    found, _ = judged_findings(verdicts(first), said("needle", "needle", "hay"))
    assert found.count() == 2 * n
    again = judge_all(chunked(said("needle", "hay", "more")), counting, store=store, rounds=2, wait=0)
    assert again.count() == 3 * n and calls() == 3 * n and usage(again).first().calls == 3 * n
    # failures are not kept as replies: they are asked for again
    failed = judge_all(chunked(said("broken", "hay")), counting, tries=1, store=store, rounds=1, wait=0)
    assert failed.where("error is not null").count() == n and calls() == 4 * n
    (log / "mended").write_text("")
    mended = judge_all(chunked(said("broken", "hay")), counting, tries=1, store=store, rounds=1, wait=0)
    assert mended.where("error is null").count() == 2 * n and calls() == 5 * n
