import json
import random

import pytest

from riskweave.sources.jsonlines import files, ranges, register, whole_lines
from riskweave.sources.records import lines


def python_lines(path):
    with open(path, encoding="utf-8", errors="replace") as f:
        return [x.rstrip("\n") for x in f]


TEXTS = ["a\nb\n", "", "\n\n", "no end", "é\r\nü\rx\n\r\n", "x" * 5000 + "\n" + "y\n" * 50, "\n" * 7 + "end\n"]


@pytest.mark.parametrize("text", TEXTS)
@pytest.mark.parametrize("size", [1, 2, 3, 7, 64, 10_000])
def test_ranges_share_out_the_lines(tmp_path, text, size):
    path = tmp_path / "a.txt"
    path.write_bytes(text.encode())
    got = [(at, x) for r in ranges(str(path), size) for at, x in whole_lines(r)]
    assert [x for _, x in got] == python_lines(path)
    assert all(path.read_bytes()[at:].startswith(x.encode()) for at, x in got)


@pytest.mark.parametrize("size", [5, 50, 1 << 20])
def test_line_numbers_are_python_s(spark, tmp_path, size):
    r = random.Random(size)
    whole = []
    for name in ("a.jsonl", "b.jsonl", "_hidden"):
        text = "".join(r.choice(["", " ", json.dumps({"k": r.random()}), "ü" * 30]) + r.choice(["\n", "\n", "\r\n"]) for _ in range(60))
        (tmp_path / name).write_bytes(text.encode())
        whole += python_lines(tmp_path / name) if name[0] != "_" else []
    want = [(k, x) for k, x in enumerate(whole) if x.strip()]
    for offset in (0, 1, 59, 60, 61, 200):
        got = sorted((x.line_no, x.value) for x in lines(spark, str(tmp_path), offset, size).collect())
        assert got == [w for w in want if w[0] >= offset]


def test_offset_is_pushed_down(spark, tmp_path):
    """Ranges that end before the offset are not among the partitions."""
    path = tmp_path / "a.txt"
    path.write_text("line\n" * 1000)
    register(spark)
    assert lines(spark, str(path), 0, 500).rdd.getNumPartitions() >= 10
    assert spark.read.format("riskweave_lines").option("splitBytes", 500).option("first", 9).load(str(path)).rdd.getNumPartitions() == 1
    assert [(x.split, x.n_lines) for x in spark.read.format("riskweave_lines").options(counts="true", splitBytes=2500).load(str(path)).orderBy("split").collect()] == [(0, 500), (1, 500)]


def test_stream_of_a_growing_file(spark, tmp_path):
    register(spark)
    folder, out = tmp_path / "in", str(tmp_path / "out")
    folder.mkdir()
    path = folder / "a.jsonl"

    def run():
        df = spark.readStream.format("riskweave_lines").option("splitBytes", 10).load(str(folder))
        df.select("value", "at").writeStream.format("parquet").option("path", out).option("checkpointLocation", str(tmp_path / "check")).trigger(availableNow=True).start().awaitTermination()
        return sorted((x.at, x.value) for x in spark.read.schema("value string, at long").parquet(out).collect())

    path.write_text("one\ntwo\nthr")
    assert run() == [(0, "one"), (4, "two")]  # the last line is not whole yet
    with path.open("a") as f:
        f.write("ee\nfour\n")
    assert run() == [(0, "one"), (4, "two"), (8, "three"), (14, "four")]
    (folder / "b.jsonl").write_text("five\n")
    assert [x for _, x in run()] == ["five", "one", "two", "three", "four"] or len(run()) == 5


def test_missing_file(tmp_path):
    with pytest.raises(FileNotFoundError):
        files(str(tmp_path / "none"))
