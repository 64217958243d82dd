import random

import duckdb
import pytest

from riskweave.llm import licenses as lc


@pytest.mark.parametrize("size", ["sf0.001", "sf0.01"])
def test_equals_sql(spark, size):
    path = f"/root/testdata/{size}/documents.parquet"
    got = sorted((tuple(r) for r in lc.scan(spark.read.parquet(path)).select("doc_id", "n_licenses", "licenses", "coverage").collect()), key=str)
    con = duckdb.connect()
    con.execute(f"create view documents as select * from '{path}'")
    assert got == sorted(con.execute(lc.oracle()).fetchall(), key=str)
    assert any(r[1] for r in got)


def test_whole_and_partial_notices(spark):
    r = random.Random(4)
    filler = lambda n: " ".join(r.choices("lorem ipsum dolor sit amet the of and".split(), k=n))
    rows = []
    for i, (_, t) in enumerate(lc.NOTICES):
        for k in range(6):
            rows.append((100 * i + k, f"{filler(r.randrange(300))} {t.upper() if k % 2 else t} {filler(r.randrange(60))}"))
        w = t.split()
        rows.append((100 * i + 50, " ".join([filler(9), *w[: len(w) * 6 // 10], filler(9)])))
    odd = [(9001, None), (9002, ""), (None, lc.NOTICES[0][1]), (9003, "license"), (9003, "license"), (9004, "word " * 20_000 + lc.NOTICES[2][1])]
    docs = spark.createDataFrame([(*x, "old", 1) for x in rows + odd], "doc_id long, text string, license string, coverage int")
    got = sorted((tuple(r) for r in lc.scan(docs).select("doc_id", "n_licenses", "licenses", "coverage").collect()), key=str)
    con = duckdb.connect()
    documents = docs.toPandas()  # noqa: F841
    assert got == sorted(con.execute(lc.oracle().replace("FROM documents", "FROM (SELECT doc_id::BIGINT doc_id, text FROM documents)")).fetchall(), key=str)
    by = {d: set(x.split(",")) for d, _, x, _ in got if d is not None}
    for i, (name, _) in enumerate(lc.NOTICES):
        assert all(name in by[100 * i + k] for k in range(6))
    assert by[9004] == {"apache-2.0"} and by[9003] == {""}
    assert lc.scan(docs.limit(0)).count() == 0
    none = spark.createDataFrame([("x", None), ("y", " ")], "license string, text string")
    assert {r.n_licenses for r in lc.scan(docs, none).collect()} == {0}


def test_settings():
    assert all(lc.bins(w) <= 1 << 12 for w in (8, 16, 32, 64, 128, 256))
    assert all(any(w in t.lower() for w in lc.anchors([t])) for _, t in lc.NOTICES)


def test_large_catalogue(spark, monkeypatch):
    """Without anchors, as for a catalogue that does not go to the driver, the same is found; and with no templates at all, nothing."""
    docs = spark.createDataFrame([(i, f"before {t} after") for i, (_, t) in enumerate(lc.NOTICES)] + [(99, "no terms at all in here")], "doc_id long, text string")
    want = [tuple(r) for r in lc.scan(docs).collect()]
    monkeypatch.setattr(lc, "ANCHORED", 3)
    assert sorted(map(str, (tuple(r) for r in lc.scan(docs).collect()))) == sorted(map(str, want))
    assert {r.n_licenses for r in lc.scan(docs, lc.templates(spark).limit(0)).collect()} == {0}
