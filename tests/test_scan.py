import base64
import hashlib
import json

import numpy as np
import pytest

from riskweave.functions import scan as sc
from riskweave.operators.annotate import annotate, statuses
from riskweave.operators.chunks import chunked, judge_all, judged_findings, usage, verdicts
from riskweave.operators.context import text_records
from riskweave.operators.images import all_findings
from riskweave.sources.records import read_records
from riskweave.streaming.scan import scan_file

from .test_images import hidden, png

GOOD = {"share_id": "s1", "platform": "x", "messages": [{"role": "user", "content": "write to jane.doe@corp-mail.com"}]}


def put(path, rows):
    path.write_text("".join((r if isinstance(r, str) else json.dumps(r)) + "\n" for r in rows))
    return str(path)


def test_file_scan_status_and_resumption(spark, tmp_path):
    out = str(tmp_path / "one")
    assert scan_file(spark, put(tmp_path / "a.jsonl", [GOOD]), out) == 0
    assert spark.read.json(f"{out}/checkpoint").first().next_line == 1
    assert "- records: 1" in (text := "\n".join(r.value for r in spark.read.text(f"{out}/summary").collect())) and "B-A-1, B-C-3, B-CIA-7" in text
    bad, out = put(tmp_path / "b.jsonl", ["{bad", GOOD]), str(tmp_path / "two")
    assert scan_file(spark, bad, out) == 2
    assert scan_file(spark, bad, out, resume=True) == 2
    assert [r.record_id for r in spark.read.json(f"{out}/reports").collect()] == ["s1"] and spark.read.json(f"{out}/rejected").count() == 1
    more = put(tmp_path / "b.jsonl", ["{bad", GOOD, GOOD | {"share_id": "s2"}])
    assert scan_file(spark, more, out, resume=True) == 2
    assert sorted(r.record_id for r in spark.read.json(f"{out}/reports").collect()) == ["s1", "s2"]
    long, out = put(tmp_path / "c.jsonl", [GOOD | {"messages": [{"role": "user", "content": "x" * 1000}]}]), str(tmp_path / "three")
    assert scan_file(spark, long, out, max_chars=100) == 1
    assert "exceed the limit 100" in spark.read.json(f"{out}/rejected").first().error


def test_offset_and_limit(spark, tmp_path):
    rows = ["{bad", *(GOOD | {"share_id": f"s{k}"} for k in range(5)), "[]"]
    path, out = put(tmp_path / "a.jsonl", rows), str(tmp_path / "out")
    assert scan_file(spark, path, out, offset=2, limit=2) == 0  # the bad lines lie outside
    assert sorted(r.record_id for r in spark.read.json(f"{out}/reports").collect()) == ["s1", "s2"]
    assert scan_file(spark, path, out, resume=True) == 2
    assert sorted(r.record_id for r in spark.read.json(f"{out}/reports").collect()) == ["s1", "s2", "s3", "s4"]


def test_images_are_findings(spark, tmp_path):
    uri = "data:image/png;base64," + base64.b64encode(png(hidden())).decode()
    flat = "data:image/png;base64," + base64.b64encode(png(np.full((40, 40), 9))).decode()
    url = "https://h.example/a/b.png"
    rows = [
        GOOD | {"messages": [{"role": "assistant", "content": f"inline {uri} and {flat}"}]},
        GOOD | {"share_id": "s2", "messages": [{"role": "user", "content": f"see {url}", "extra": {"u": url}}]},
    ]
    (tmp_path / "mirror").mkdir()
    (tmp_path / "mirror" / f"{hashlib.sha1(url.encode()).hexdigest()}.png").write_bytes(png(hidden()))
    records, _ = read_records(spark, put(tmp_path / "a.jsonl", rows))
    got = lambda mirror: sorted((r.record_id, r.rule) for r in all_findings(records, mirror).where("family = 'stego_imagery'").collect())
    assert got(None) == [("s1", "G-3"), ("s1", "G-3"), ("s1", "G-4"), ("s2", "G-1"), ("s2", "G-2")]
    assert got(str(tmp_path / "mirror")) == [("s1", "G-3"), ("s1", "G-3"), ("s1", "G-4"), ("s2", "G-1"), ("s2", "G-2"), ("s2", "G-4")]


def test_failed_rule_is_a_status(spark, monkeypatch):
    monkeypatch.setitem(sc.GATES, "P-1", lambda *_: 1 // 0)
    sc._plan.cache_clear()
    got = sc.scan("a@b.example and sk-" + "q" * 24, ("P-1", "P-8"))
    sc._plan.cache_clear()
    assert [g[0] for g in got] == ["!P-1", "P-8"] and "ZeroDivisionError" in got[0][3]
    rows = annotate(text_records(spark.createDataFrame([(1, "a@b.example"), (2, None)], "id long, text string"), "id", "text"))
    assert {(r.record_id, r.status) for r in statuses(rows).collect()} == {("1", "ok"), ("2", "ok")}


@pytest.mark.parametrize("rule", sorted(sc.GATES))
def test_gates_lose_no_match(rule):
    import random
    import re

    from riskweave.plans import rules as R

    r = random.Random(rule)
    pattern = re.compile(R.BY_ID[rule].regex, re.I if "i" in R.BY_ID[rule].flags else 0)
    seeds = ["(go " + "GO " * 28 + "go.", "x " * 29, "z" * 1000, " " * 1003, "\n" * 1200, "13912345678", "4" * 16, "11010519491231002X", "A" * 40 + "==", "aB3/" * 10, "ab" * 30, "ab" * 29, "-"]
    found = 0
    for _ in range(300):
        text = "".join(r.choice([*seeds, " ", "a", "\n", "é"]) for _ in range(r.randrange(1, 6)))
        want = [(m.start(), m[0]) for m in pattern.finditer(text)][: R.BY_ID[rule].cap or None]
        assert [(p, m) for _, _, p, m in sc.scan(text, (rule,))] == want
        found += len(want)
    assert found


def test_judge_options(spark):
    records = text_records(spark.createDataFrame([(1, "jailbreak text")], "id long, text string"), "id", "text")
    verdict = '{"hit": true, "confidence": 0.6, "evidence": "jailbreak", "reasoning": "r"}'

    def judge(name, prompt):
        if "one JSON object" not in prompt:
            return "no", 10, 1
        return verdict, 20, 2

    strong = spark.createDataFrame([("1", "A-I-1", 0.8), ("1", "A-I-1", 0.2), ("1", "B-I-1", 0.6)], "record_id string, taxonomy_id string, confidence double")
    calls = judge_all(chunked(records), judge, found=strong, concurrency=3, wait=0).persist()
    n = calls.count()
    assert usage(calls).first().asDict() == {"calls": 2 * (n - 1), "prompt_tokens": 30 * (n - 1), "completion_tokens": 3 * (n - 1)}
    found, status = judged_findings(verdicts(calls), records)
    assert {(r.taxonomy_id, r.status) for r in status.where("status <> 'ok'").collect()} == {("A-I-1", "skipped")} and found.count() == n - 1
    _, status = judged_findings(verdicts(judge_all(chunked(records), None)), records)
    assert {r.status for r in status.collect()} == {"skipped"}

    def broken(name, prompt):
        raise ValueError("down")

    _, status = judged_findings(verdicts(judge_all(chunked(records), broken, wait=0)), records)
    assert {r.status for r in status.collect()} == {"failed"}
