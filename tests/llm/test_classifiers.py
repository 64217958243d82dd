import zlib

import numpy as np
import pytest

from riskweave.llm import quality, toxicity
from riskweave.llm.learn import logistic, sigmoid

SF = "/root/testdata/sf0.1"


def auc(y, s):
    r = np.argsort(np.argsort(s, kind="stable")) + 1
    n1 = y.sum()
    return (r[y == 1].sum() - n1 * (n1 + 1) / 2) / (n1 * (len(y) - n1))


@pytest.mark.parametrize(("run", "label", "least"), [(quality.quality_scores, "quality", 0.99), (toxicity.toxicity_scores, "toxic", 0.93)])
def test_held_out(spark, run, label, least):
    docs, labels = spark.read.parquet(f"{SF}/documents.parquet"), spark.read.parquet(f"{SF}/labels.parquet")
    got = run(docs, labels).toPandas()
    assert len(got) == docs.count() and got.score.between(0, 1).all()
    assert all(h == (zlib.crc32(str(d).encode()) % 3 == 1) for d, h in zip(got.doc_id, got.held_out, strict=True))
    m = got.merge(labels.toPandas(), on="doc_id")
    m = m[m.held_out]
    assert auc(m[label].to_numpy(), m.score.to_numpy()) > least
    assert (m.predicted == m[label]).mean() > 0.97


@pytest.mark.parametrize(("run", "label"), [(quality.quality_scores, "quality"), (toxicity.toxicity_scores, "toxic")])
def test_edges(spark, run, label):
    docs = spark.createDataFrame([(1, None, 0.5), (2, "", 0.5), (2, "", 0.5), (None, "you idiot", 0.5), (4, "long " * 40_000, 0.5), (5, "​ \x00", 0.5)], "doc_id long, text string, score double")
    labels = spark.createDataFrame([(1, 1, 0), (2, None, None), (None, 1, 1), (4, 0, 1), (4, 0, 1), (5, 7, 7)], "doc_id long, quality int, toxic int")
    for d, lab in ((docs, labels), (docs, labels.limit(0)), (docs.limit(0), labels), (docs, labels.where("doc_id = 1"))):
        rows = run(d, lab).collect()
        assert len(rows) == d.count() and all(0 <= r.score <= 1 and r.predicted in (0, 1) for r in rows)
        assert len({r.score for r in rows if r.doc_id == 2}) <= 1
    if label == "quality":
        assert quality.keep_good(docs, labels.limit(0)).count() == docs.count()
        assert quality.keep_good(docs, labels).columns == docs.columns


def test_fold_and_exceptions():
    assert toxicity.fold("Ѕtup1d, 1DIOT! É\u0301t\u200bé") == " stupid idiot ete "
    lex = toxicity.Lexicon({" stupi": 2.0, " idiot ": 3.0}, frozenset({" stupid proof "}), (1.0, 0.0, 0.0, 0.0, -1.0))
    a = lex.automaton()
    assert lex.hits("STUPID idiot idiots", a) == (5.0, 2, 3)
    assert lex.hits("it is stupid proof", a) == (0, 0, 4)
    assert lex.hits("", a) == (0, 0, 0)


def test_additive_learns_interaction():
    r = np.random.default_rng(0)
    x = r.normal(size=(3000, 3))
    y = ((x[:, 0] > 0) ^ (x[:, 1] > 0)).astype(float)
    m = quality.fit(x, y, rounds=30, pair_rounds=80, n_pairs=1)
    assert m.pairs == [(0, 1)] and ((m.score(x) > 0.5) == y).mean() > 0.95
    one = quality.fit(x, (x[:, 2] > 1).astype(float), rounds=60, pair_rounds=1)
    assert auc((x[:, 2] > 1), one.score(x)) > 0.99


def test_logistic():
    r = np.random.default_rng(0)
    x = r.normal(size=(4000, 2))
    y = (r.random(4000) < sigmoid(x @ np.array([1.0, -2.0]) + 0.5)).astype(float)
    assert np.allclose(logistic(x, y, 0.01), [1, -2, 0.5], atol=0.2)


def naive_hits(lexicon, text):
    """Weights, hit words and words of a text: every entry tried on every word, exceptions by neighbouring words."""
    w = toxicity.fold(text or "").split()
    total = n = 0
    for k, word in enumerate(w):
        fit = [v for e, v in lexicon.entries.items() if (word == e.strip() if e.endswith(" ") else word.startswith(e.strip()))]
        around = {" " + " ".join(w[max(k - 1, 0) : k + 1]) + " ", " " + " ".join(w[k : k + 2]) + " "}
        if fit and max(fit) > 0 and not around & lexicon.exceptions:
            total, n = total + max(fit), n + 1
    return total, n, len(w)


def test_toxicity_equals_brute_force(spark):
    """The lexicon's counts, weights and evidence from the labelled texts alone, then every score, without Aho-Corasick."""
    sf = "/root/testdata/sf0.01"
    docs, labels = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet")
    lexicon = toxicity.learn(docs, labels)
    toxic = {r.doc_id: r.toxic for r in labels.collect() if r.toxic in (0, 1) and zlib.crc32(str(r.doc_id).encode()) % 3 != 1}
    rows = [(toxic[r.doc_id], toxicity.fold(r.text or "").split(), len(r.text or "") / 6) for r in docs.collect() if r.doc_id in toxic]
    n = [sum(y == c for y, _, _ in rows) for c in (0, 1)]
    size = [sum(s for y, _, s in rows if y == c) for c in (0, 1)]
    assert lexicon.entries
    for e, weight in lexicon.entries.items():
        fits = lambda x: x == e.strip() if e.endswith(" ") else x.startswith(e.strip()) and len(x) > len(e.strip())  # noqa: B023, E731
        tf = [sum(sum(map(fits, w)) for y, w, _ in rows if y == c) for c in (0, 1)]
        df = [sum(any(map(fits, w)) for y, w, _ in rows if y == c) for c in (0, 1)]
        expected = [(df[0] + df[1]) * n[c] / (n[0] + n[1]) for c in (0, 1)]
        assert 2 * sum(d * np.log(d / x) for d, x in zip(df, expected, strict=True) if d) >= toxicity.EVIDENCE - 1e-9
        assert np.isclose(weight, min(6.0, np.log(((tf[1] + 0.5) / (size[1] + 1)) / ((tf[0] + 0.5) / (size[0] + 1)))))
    got = {r.doc_id: r for r in toxicity.toxicity_scores(docs, labels).collect()}
    for r in docs.collect():
        total, hits, words = naive_hits(lexicon, r.text)
        x = [np.log1p(total), np.log1p(1000 * total / max(words, 1)), float(hits > 0), np.log1p(hits)]
        score = 1 / (1 + np.exp(-np.clip(np.dot(x, lexicon.weights[:-1]) + lexicon.weights[-1], -35, 35)))
        assert np.isclose(got[r.doc_id].score, score) and got[r.doc_id].hits == hits and got[r.doc_id].predicted == (score >= 0.7)


def naive_features(text):
    """The quality features of a text, one count at a time."""
    raw = (text or "").encode()
    w, size = raw.split(), max(1, len(raw))
    kind = [sum(map(f, raw)) / size for f in (lambda c: 65 <= c <= 90, lambda c: 48 <= c <= 57, lambda c: chr(c) in ".,;:!?'\"-()", lambda c: c < 128 and not chr(c).isalnum() and not chr(c).isspace() and chr(c) not in ".,;:!?'\"-()", lambda c: c > 127)]
    if not w:
        return [0.0, 0.0, *kind, *[0.0] * 8]
    n, lines = len(w), raw.split(b"\n")
    pairs = [(w[k], w[k + 1]) for k in range(n - 1)]
    return [
        np.log(1 + n), sum(map(len, w)) / n, *kind, sum(len(x) <= 3 for x in w) / n, sum(len(x) > 14 for x in w) / n, len(set(w)) / n, len(set(pairs)) / max(1, n - 1), sum(a == b for a, b in pairs) / max(1, n - 1),
        np.log(1 + n / len(lines)), len(set(lines)) / len(lines), sum(x in (b"|", b"-", b"*", b"#") for x in w) / n,
    ]


def test_quality_equals_brute_force(spark):
    """Every score from features counted one by one and table entries added row by row."""
    sf = "/root/testdata/sf0.01"
    docs, labels = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet")
    model = quality.train(docs, labels)
    got = {r.doc_id: r for r in quality.quality_scores(docs, labels).collect()}
    for r in docs.collect():
        x = naive_features(r.text)
        place = [sum(c <= v for c in cuts) for v, cuts in zip(x, model.cuts, strict=True)]
        logit = model.intercept + sum(t[b] for t, b in zip(model.tables, place, strict=True)) + sum(t[place[i], place[j]] for (i, j), t in zip(model.pairs, model.pair_tables, strict=True))
        score = 1 / (1 + np.exp(-logit))
        assert np.isclose(got[r.doc_id].score, score) and got[r.doc_id].predicted == (score >= 0.5)


def test_boosting_equals_plain_loops():
    """The tables of a small fit against boosting written as loops over rows and cuts."""
    r = np.random.default_rng(4)
    x = r.integers(0, 6, (200, 2)).astype(float)
    y = (r.random(200) < sigmoid(x[:, 0] - 2.5)).astype(float)
    model = quality.fit(x, y, bins=6, rounds=3, pair_rounds=0, n_pairs=0, least=1.0)
    share = (y.sum() + 0.5) / 201
    f = [np.log(share / (1 - share))] * 200
    tables = [[0.0] * (len(c) + 1) for c in model.cuts]
    where = [[sum(c <= v for c in model.cuts[j]) for v in x[:, j]] for j in range(2)]

    def best(bins, g, h, a, b):
        def value(p, q):
            s, t = (sum(v[k] for k in range(200) if p <= bins[k] < q) for v in (g, h))
            return s * s / (t + 2.0), t

        cuts = [(value(a, c)[0] + value(c, b)[0], -c) for c in range(a + 1, b) if value(a, c)[1] >= 1 and value(c, b)[1] >= 1]
        return -max(cuts)[1] if cuts and max(cuts)[0] > 0 else None

    for _ in range(3):
        for j in range(2):
            p = [1 / (1 + np.exp(-v)) for v in f]
            g, h = [y[k] - p[k] for k in range(200)], [p[k] * (1 - p[k]) for k in range(200)]
            spans = [(0, len(tables[j]))]
            for _ in range(2):
                spans = [s for a, b in spans for c in [best(where[j], g, h, a, b)] for s in ([(a, c), (c, b)] if c else [(a, b)])]
            for a, b in spans:
                step = 0.15 * sum(g[k] for k in range(200) if a <= where[j][k] < b) / (sum(h[k] for k in range(200) if a <= where[j][k] < b) + 2.0)
                for c in range(a, b):
                    tables[j][c] += step
                f = [v + step if a <= where[j][k] < b else v for k, v in enumerate(f)]
    for t, want in zip(model.tables, tables, strict=True):
        assert np.allclose(t, want)
