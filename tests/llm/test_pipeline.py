import zlib
from collections import Counter

import numpy as np
import public_tokenizers

import corpus_pipeline
from riskweave.llm.token_count import load

from .test_decontaminate import brute as leaks
from .test_minhash import brute as groups


def test_stages_and_run(spark):
    """Every stage on what its predecessor kept, against plain versions; then run() as a whole."""
    sf = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{sf}/labels.parquet").collect()}
    texts = {r.doc_id: r.text for r in docs.collect()}
    good = corpus_pipeline.quality(spark, docs, sf)
    kept = {r.doc_id for r in good.collect()}
    assert good.columns == docs.columns and np.mean([(d in kept) == bool(q) for d, q in labels.items()]) > 0.95
    one = corpus_pipeline.near_duplicates(spark, good, sf)
    want = {d for d, _, _, k in groups([(d, texts[d]) for d in sorted(kept)], 5) if k}
    assert one.columns == docs.columns and {r.doc_id for r in one.collect()} == want
    clean = corpus_pipeline.decontaminate(spark, one, sf)
    bench = [tuple(r) for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()]
    want -= {r[0] for r in leaks([(d, texts[d]) for d in want], bench) if r[1]}
    assert clean.columns == docs.columns and {r.doc_id for r in clean.collect()} == want
    mix = corpus_pipeline.mixture(spark, clean, sf)
    copies = Counter(r.doc_id for r in mix.collect())
    assert mix.columns == docs.columns and set(copies) == want
    tok, out, at = load(public_tokenizers.path("word_bpe_49k.json")), [], 0
    for d in sorted(copies):
        ids = [*tok.encode(texts[d], add_special_tokens=False).ids, 1]
        for _ in range(copies[d]):
            out.append((d, at, len(ids), zlib.crc32(np.array(ids, "<u4"))))
            at += len(ids)
    assert sorted(tuple(r)[:4] for r in corpus_pipeline.run(spark, sf).collect()) == sorted(out)
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality", "near_duplicates", "decontaminate", "mixture", "tokens"]


def test_edges(spark, tmp_path):
    """Nulls in any column, empty and very long texts, repeated rows and further columns through every stage, and empty tables."""
    good = [r.text for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").where("length(text) between 300 and 900").limit(6).collect()]
    rows = [(k, t, "en", "web", len(t)) for k, t in enumerate(good)]
    rows += [rows[0], rows[0], (50, good[0], None, None, None), (None, good[1], "en", None, 3), (None, None, None, None, None), (60, "", "en", "web", 0), (61, None, "en", "web", 0), (62, " \t\n", "x", "y", 1), (63, "long tail of words " * 30_000, "en", "web", 1)]
    docs = spark.createDataFrame([(*r, 1, 2, 3, 4) for r in rows], "doc_id long, text string, lang string, source string, n_chars long, _id int, _key int, block int, node int")
    bench = spark.createDataFrame([(1, good[2]), (2, None), (None, good[3]), (4, "")], "item_id long, text string")
    labels = spark.createDataFrame([(0, 1, 0), (1, None, None), (None, 1, 1), (60, 0, 0)], "doc_id long, quality int, toxic int")
    for name, df in (("documents", docs), ("benchmark", bench), ("labels", labels)):
        df.write.parquet(f"{tmp_path}/{name}.parquet")
    sf, now = str(tmp_path), docs
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, now, sf)
        assert out.columns == docs.columns
        got, had = Counter(map(str, out.collect())), Counter(map(str, now.collect()))
        assert set(got) <= set(had)
        if name == "near_duplicates":
            assert sum(r.doc_id == 0 for r in out.collect()) == sum(r.doc_id == 0 for r in now.limit(99).distinct().collect()) and not any(r.doc_id == 50 for r in out.collect())
            assert sum(r.doc_id is None for r in out.collect()) == sum(r.doc_id is None for r in now.collect())
        if name == "decontaminate":
            assert {r.doc_id for r in now.collect()} - {r.doc_id for r in out.collect()} == {2} & {r.doc_id for r in now.collect()}
        if name == "mixture":
            assert set(got) == set(had)
        path = f"{tmp_path}/{name}"
        out.write.parquet(path)
        now = spark.read.parquet(path)
        assert stage(spark, docs.limit(0), sf).count() == 0
    assert corpus_pipeline.tokens(spark, now, sf).count() == now.count() == corpus_pipeline.run(spark, sf).count()
    assert corpus_pipeline.tokens(spark, docs.limit(0), sf).count() == 0
