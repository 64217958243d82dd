import math
from collections import Counter

import duckdb
import pytest

from riskweave.llm import mixing


@pytest.mark.parametrize("size", ["sf0.001", "sf0.01"])
def test_equals_sql(spark, size):
    path = f"/root/testdata/{size}/documents.parquet"
    got = sorted(tuple(r) for r in mixing.plan(spark.read.parquet(path)).select("doc_id", "source", "block", "place").collect())
    con = duckdb.connect()
    con.execute(f"create view documents as select * from '{path}'")
    assert got == sorted(con.execute(mixing.ORACLE).fetchall())


def skewed(spark, extra=()):
    rows = [(i, f"w{i} " * (3 + i % 5), "hot") for i in range(600)] + [(1000 + i, f"v{i} " * 4, f"s{i % 6}") for i in range(60)]
    return spark.createDataFrame([*rows, *extra], "doc_id long, text string, source string")


def test_targets(spark):
    docs = skewed(spark)
    by, a = mixing.weights(docs, entropy=0.8, repetition=1e9)
    w = [r.weight for r in by.collect()]
    assert 0 < a < 1 and math.isclose(sum(w), 1) and math.isclose(-sum(x * math.log(x) for x in w), 0.8 * math.log(7), abs_tol=1e-4)
    by, b = mixing.weights(docs, entropy=0.999, repetition=3.0)
    passes = [r.quota / r.tokens for r in by.collect()]
    assert b > 0 and min(passes) == 1 and 2.9 < max(passes) < 3.1
    copies = Counter(r.doc_id for r in mixing.mix(docs, 0.999, 3.0).collect())
    assert len(copies) == 660 and all(copies[i] == 1 for i in range(600)) and all(copies[1000 + i] in (2, 3, 4) for i in range(60))


def test_prefixes_keep_weights(spark):
    docs = skewed(spark)
    by, _ = mixing.weights(docs, 0.999, 3.0)
    want = {r.source: r.weight for r in by.collect()}
    rows = mixing.mixed(docs, 0.999, 3.0).orderBy("_place").collect()
    half = rows[: len(rows) // 2]
    n = Counter()
    for r in half:
        n[r.source] += len(r.text.split()) + 1
    assert abs(n["hot"] / sum(n.values()) - want["hot"]) < 0.06


def test_edges(spark):
    odd = [(None, None, None), (1, "", None), (1, "", None), (5000, "long " * 50_000, "s1"), (1003, "again again", "s1"), (1003, "again again", "s1"), (1003, "other", "s1")]
    docs = skewed(spark, odd)
    out = mixing.mix(docs, 0.999, 3.0)
    assert out.columns == docs.columns and {(r.doc_id, r.text, r.source) for r in out.collect()} == {(r.doc_id, r.text, r.source) for r in docs.collect()}
    assert mixing.mix(docs.limit(0)).count() == 0 and mixing.plan(docs.limit(0)).count() == 0
    one = docs.where("source = 'hot'")
    assert mixing.mix(one).count() == one.count()
    clash = docs.selectExpr("*", "1 tokens", "2 weight", "3 quota", "4 block")
    assert mixing.mix(clash).columns == clash.columns


def test_own_columns_stay(spark):
    """Columns with any name come back as they were, and of equal rows the same ones get the extra copy each time."""
    rows = [(i, f"w{i} " * (3 + i % 5), "hot", i % 3) for i in range(300)] + [(1000, "again again", "s", k) for k in range(40)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, lang int")
    clash = docs.selectExpr("*", "lang _key", "lang r", "lang block", "lang place", "lang passes", "lang u", "map('a', lang) extra", "lang `full`", "lang of_source")
    first = sorted(tuple(r)[:13] for r in mixing.mix(clash, 0.999, 3.0).drop("extra").collect())
    assert mixing.mix(clash).columns == clash.columns and all(len(set(r[3:])) == 1 for r in first)
    again = sorted(tuple(r)[:13] for r in mixing.mix(clash.repartition(7), 0.999, 3.0).drop("extra").collect())
    assert first == again and len(first) > len(rows)
