import re

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from riskweave.functions import rx
from riskweave.functions import text as tx

PATTERNS = [(r"\b\w+\b", ""), (r"[^\s|;]+", ""), (r"(?<!\d)\d{2,4}(?!\d)", ""), (r"^.{0,3}a", "im"), (r"a.b", "s"), (r"\d+|[\w.-]+@", "i")]
TEXT = st.text(alphabet="ab 12.\n\r\t@é_中🙂ſK\x1c\x85 -|", max_size=30)


@pytest.mark.parametrize(("pattern", "flags"), PATTERNS)
def test_positions_equal_python(spark, pattern, flags):
    texts: list[str] = []

    @settings(max_examples=120, deadline=None, database=None)
    @given(TEXT)
    def collect(t):
        texts.append(t)

    collect()
    df = spark.createDataFrame(list(enumerate(texts)), "id int, text string").withColumn("text", rx.clean(F.col("text")))
    got = {r.id: [(m.pos, m.m) for m in r.h] for r in df.select("id", rx.matches(F.col("text"), rx.java(pattern, flags)).alias("h")).collect()}
    sql = {r.id: [(m.pos, m.m) for m in r.h] for r in df.select("id", F.expr(rx.matches_sql("text", rx.java(pattern, flags))).alias("h")).collect()}
    want = {k: [(m.start(), m[0]) for m in re.finditer(pattern, t, sum({"i": re.I, "m": re.M, "s": re.S}[f] for f in flags))] for k, t in enumerate(texts)}
    assert got == want == sql


def test_re2_refuses_lookaround():
    assert rx.re2(r"(?<!a)b") is None and rx.re2(r"\bx") is None and rx.re2(r"(.)\1") is None and rx.re2("a.b", "i") == "(?i)a.b"


def test_helpers(spark):
    t = "ab" * 300
    r = spark.createDataFrame([(t, "aabb")], "t string, e string").select(tx.repeated_prefix(F.col("t")).alias("p"), tx.entropy(F.col("e")).alias("e"), tx.compression_ratio("t").alias("c"), tx.top_pair("t").alias("w")).first()
    assert r.p == 600 and abs(r.e - 1.0) < 1e-12 and 0 < r.c < 0.1 and r.w.words == 1 and r.w.n == 0


@pytest.mark.parametrize(("url", "want"), [("javascript://x", None), ("HTTP://Example.ORG:80/a#f", ("http://example.org/a", "example.org")), ("https://user:pw@h.example/x", ("https://h.example/x", "h.example")), ("http://h.example:port/", None), ("www.h.example/x).", ("https://www.h.example/x", "www.h.example")), ("http://[::1", None), ("/local/path", None)])
def test_addresses(url, want):
    got = tx.address(url)
    assert (got and got[:2]) == want
