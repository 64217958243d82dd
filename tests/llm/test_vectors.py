import math

import numpy as np
import pytest

from riskweave.llm import vectors
from riskweave.llm.queries import ORACLE_SQL, op13_embedding_dedup


def brute(rows, cosine=0.95):
    """All pairs in double precision, then components by union."""
    def unit(v):
        if not v or any(x is None or not math.isfinite(x) for x in v) or not any(v):
            return None
        x = np.asarray(v, float)
        x = x / np.abs(x).max()
        return x / np.linalg.norm(x)

    us = [unit(v) if i is not None else None for i, v in rows]
    up, links = list(range(len(rows))), [0] * len(rows)

    def root(i):
        while up[i] != i:
            i = up[i]
        return i

    for i, a in enumerate(us):
        for j in range(i):
            b = us[j]
            if a is not None and b is not None and len(a) == len(b) and a @ b >= cosine:
                links[i] += 1
                links[j] += 1
                up[root(i)] = root(j)
    least = {}
    for i, (v, _) in enumerate(rows):
        if v is not None:
            least[root(i)] = min(v, least.get(root(i), v))
    return sorted(((v, links[i], least[root(i)] if v is not None else None, v is None or v == least[root(i)]) for i, (v, _) in enumerate(rows)), key=str)


def frame(spark, rows, kind="double"):
    return spark.createDataFrame(rows, f"vec_id long, embedding array<{kind}>")


def run(df, **kw):
    return sorted((tuple(r) for r in vectors.near_duplicates(df, **kw).collect()), key=str)


def groups(seed, sizes, noise, dim=24, alone=150):
    r = np.random.default_rng(seed)
    out = [r.standard_normal(dim) for _ in range(alone)]
    for n, s in zip(sizes, noise):
        c = r.standard_normal(dim)
        c /= np.linalg.norm(c)
        out += [c + s * r.standard_normal(dim) / math.sqrt(dim) for _ in range(n)]
    order = r.permutation(len(out))
    return [(int(k), [float(x) for x in out[i] * r.uniform(0.1, 9)]) for k, i in enumerate(order)]


@pytest.mark.parametrize("bucket", [512, 8])
def test_groups(spark, bucket, monkeypatch):
    """Close groups, loose groups whose members are partly linked, pairs; in one bucket and in many tables."""
    real = vectors.tables_of
    monkeypatch.setattr(vectors, "tables_of", lambda n, c: real(n, c, 1e-6, bucket))
    rows = groups(1, [120, 90, 60, 40, 2, 2, 3], [0.05, 0.2, 0.24, 0.33, 0.1, 0.2, 0.3])
    want = brute(rows)
    assert sum(w[1] for w in want) > 10_000
    assert run(frame(spark, rows)) == want


def test_chunks_of_a_crowded_bucket(spark, monkeypatch):
    monkeypatch.setattr(vectors, "BLOCK", 32)
    rows = groups(2, [30, 20], [0.1, 0.25], alone=60)
    assert run(frame(spark, rows)) == brute(rows)
    monkeypatch.setattr(vectors, "CROWD", 10**9)  # no classes: every link by its pair
    assert run(frame(spark, rows)) == brute(rows)


def test_copies_and_crowds_of_copies(spark):
    one, two = [1.0, 2.0, 3.0, 4.0], [1.0, 2.0, 3.0, 4.1]
    rows = [(i, one) for i in range(40)] + [(100 + i, two) for i in range(3)] + [(7, one), (7, one), (200, two), (200, two)]
    assert run(frame(spark, rows)) == brute(rows)


def test_edges(spark):
    rows = [(1, None), (2, []), (3, [0.0, 0.0]), (4, [1.0, None]), (5, [1.0, math.inf]), (6, [math.nan, 1.0]), (7, [1.0, 0.0]), (8, [5.0, 0.0]), (9, [1.0, 0.0, 0.0]), (None, [1.0, 0.0]), (None, None), (10, [1e300, 1e299]), (11, [1e-300, 1e-301]), (12, [-1.0, 0.0]), (8, [5.0, 0.0]), (8, [0.0, 1.0])]
    df = frame(spark, rows)
    assert run(df.selectExpr("*", "1 rid", "2 n", "3 cls", "4 label", "5 key")) == brute(rows)
    assert run(df.limit(0)) == []
    assert run(frame(spark, [(1, [1.0] * 5000), (2, [1.0] * 5000), (3, [-1.0] * 5000)], "float")) == [(1, 1, 1, True), (2, 1, 1, False), (3, 0, 3, True)]


def test_calibration():
    """Counts and tables keep their promise for pairs at the wanted cosine."""
    r = np.random.default_rng(4)
    d = math.sqrt(2 - 2 * 0.95)
    hits = np.abs(r.standard_normal((20_000, vectors.COUNTED)) * d) <= vectors.Z * d
    assert abs(hits.mean() - vectors.INSIDE) < 1e-3
    assert (hits.sum(axis=1) < vectors.need(vectors.COUNTED, 1e-5)).mean() < 3e-4 and vectors.need(vectors.COUNTED, 1e-5) > 20
    for n in (1, 100, 10**5, 10**9):
        tables, bits = vectors.tables_of(n, 0.95)
        assert n / 2**bits <= 2 * vectors.BUCKET and (1 - (1 - math.acos(0.95) / math.pi) ** bits) ** tables <= vectors.MISS * 1.0001


def test_recall_and_query(spark, sf):
    duckdb = pytest.importorskip("duckdb")
    rows = groups(8, [2] * 300, [0.2] * 300, dim=64, alone=1500)
    want = brute(rows)
    got = run(frame(spark, rows))
    assert sum(w[1] for w in want) > 300 and sum(g != w for g, w in zip(got, want)) <= 0.001 * len(rows)
    got = {tuple(r) for r in op13_embedding_dedup(spark, sf).collect()}
    con = duckdb.connect()
    con.execute(f"create view embeddings as select * from '{sf}/embeddings.parquet'")
    assert got == set(con.execute(ORACLE_SQL["op13_embedding_dedup"]).fetchall())
