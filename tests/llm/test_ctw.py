import math
import zlib
from collections import Counter

import numpy as np
import pytest

from riskweave.llm import ctw
from riskweave.llm.common import words

DEPTH, BITS = 3, 24


def brute(train, texts, depth=DEPTH):
    """The same mixture by walking explicit trees: nodes are (context bytes, bits so far)."""
    n = Counter()
    for t in train:
        raw = bytes([ctw.START]) * depth + t.encode() + b"\xff"
        for i in range(depth, len(raw)):
            s = f"{raw[i]:08b}"
            for d in range(depth + 1):
                for j in range(8):
                    n[raw[i - d : i], s[:j], s[j]] += 1
    nodes = {(c, b) for c, b, _ in n}
    kids = {}
    for c, b in nodes:
        if c:
            kids.setdefault((c[1:], b), []).append((c, b))

    def pe(x):
        a, b = n[*x, "0"], n[*x, "1"]
        return math.lgamma(a + 0.5) + math.lgamma(b + 0.5) - math.lgamma(a + b + 1) - math.log(math.pi)

    pw, w = {}, {}
    for x in sorted(nodes, key=lambda x: -len(x[0])):
        own = pe(x)
        below = sum(pw[k] for k in kids.get(x, ()))
        pw[x] = own if len(x[0]) == depth else np.logaddexp(own, below) - math.log(2)
        w[x] = 1 / (1 + math.exp(-max(-20, min(20, own - below)))) if len(x[0]) < depth else 1.0

    def score(t):
        raw, out = bytes([ctw.START]) * depth + t.encode() + b"\xff", 0.0
        for i in range(depth, len(raw)):
            s = f"{raw[i]:08b}"
            for j in range(8):
                one = 0.5  # a context without counts
                for d in range(depth, -1, -1):
                    x = (raw[i - d : i], s[:j])
                    a, b = n[*x, "0"], n[*x, "1"]
                    if x in nodes:
                        one = w[x] * (b + 0.5) / (a + b + 1) + (1 - w[x]) * one
                out += math.log10(one if s[j] == "1" else 1 - one)
        return out

    return [score(t) for t in texts]


def test_kt():
    a, b = np.array([0, 1, 5, 20_000]), np.array([0, 0, 9, 70_000])
    want = [math.lgamma(x + 0.5) + math.lgamma(y + 0.5) - math.lgamma(x + y + 1) - math.log(math.pi) for x, y in zip(a.tolist(), b.tolist(), strict=True)]
    assert np.allclose(ctw.kt_log(a, b), want, rtol=1e-9, atol=1e-9)


def base(train, text):
    c = Counter(w for t in train for w in [*words(t), None])
    total, v = sum(c.values()), len(c)
    mine = [*words(text), None]
    return len(mine), sum(c[w] > 0 for w in mine), total, sum(math.log10((c[w] + 0.5) / (total + 0.5 * (v + 1))) for w in mine)


@pytest.mark.parametrize("frequent", [0, 200_000])
def test_equals_brute_force(spark, sf, frequent):
    odd = [(None, "no id"), (-1, None), (-2, ""), (-2, ""), (-5, "zzz qqq 日本 \x00"), (-6, "The the")]
    docs = spark.read.parquet(f"{sf}/documents.parquet").where("length(text) < 1200").select("doc_id", "text").limit(15)
    docs = docs.unionByName(spark.createDataFrame(odd, "doc_id long, text string"))
    rows = [(r.doc_id, r.text or "") for r in docs.collect()]
    train = [t for d, t in rows if d is None or zlib.crc32(str(d).encode()) % 5 != 1]
    got = {(r.doc_id, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 6)): r.score for r in ctw.scores(docs, depth=DEPTH, bits=BITS, frequent=frequent).collect()}
    for (d, t), s in zip(rows, brute(train, [t for _, t in rows]), strict=True):
        n, known, total, b = base(train, t)
        assert math.isclose(got[d, n, known, total, round(b, 6)], s, rel_tol=2e-3, abs_tol=0.01)
    assert len(got) == len(set(rows))


def test_empty_and_untrained(spark):
    none = spark.createDataFrame([], "doc_id long, text string, score double")
    assert ctw.scores(none, depth=2, bits=10).count() == 0
    held = next(i for i in range(100) if zlib.crc32(str(i).encode()) % 5 == 1)
    (r,) = ctw.scores(spark.createDataFrame([(held, "ab", 0.1)], "doc_id long, text string, score double"), depth=2, bits=10).collect()
    assert (r.held_out, r.n_tokens, r.n_known, r.train_tokens) == (True, 2, 0, 0) and math.isclose(r.score, 24 * math.log10(0.5), abs_tol=1e-6)


def test_probabilities_sum_to_one():
    m = ctw.Model(2, 12, 12)
    grams, _ = ctw.pack(["abcab", "abd"], 2)
    k, n = np.unique(grams, return_counts=True)
    for place, packed in ctw.subtree(k, n, 2, 0, 12)[0]:
        m.put(place, packed)
    for context in (b"ab", b"zz", b"\xfe\xfe"):
        every = np.array([int.from_bytes(context + bytes([b]), "big") for b in range(256)], np.uint64)
        assert math.isclose((10.0 ** m.mix(every)).sum(), 1, abs_tol=1e-5)


def test_beats_words(spark):
    r = ctw.scores(spark.read.parquet("/root/testdata/sf0.1/documents.parquet")).where("held_out").selectExpr("sum(score) s", "sum(base_score) b").first()
    assert r.s > r.b


def test_every_node_counts(spark):
    """No node is dropped, in however many slices the strings are scored."""
    train = ["abcabd abcabe", "xyz once only", "the cat sat on the mat"]
    ids = [i for i in range(200) if zlib.crc32(str(i).encode()) % 5 != 1][: len(train)]
    held = next(i for i in range(200) if zlib.crc32(str(i).encode()) % 5 == 1)
    docs = spark.createDataFrame([*zip(ids, train, strict=True), (held, "abc once cat \x00\x00\x00\x00\x00")], "doc_id long, text string")

    want = exact(train, [*train, "abc once cat \x00\x00\x00\x00\x00"])
    for bits in (3, 22):
        got = {r.doc_id: r.score for r in ctw.scores(docs, depth=DEPTH, bits=bits).collect()}
        for d, s in zip([*ids, held], want, strict=True):
            assert math.isclose(got[d], s, rel_tol=2e-3, abs_tol=0.01)


def exact(train, texts, depth=DEPTH):
    """Context-tree weighting itself: code lengths of a byte after a context, with every node of the tree."""
    n = Counter()
    for t in train:
        raw = bytes([ctw.START]) * depth + t.encode() + b"\xff"
        for i in range(depth, len(raw)):
            s = f"{raw[i]:08b}"
            for d in range(depth + 1):
                for j in range(8):
                    n[raw[i - d : i], s[:j], s[j]] += 1
    pe = lambda a, b: math.lgamma(a + 0.5) + math.lgamma(b + 0.5) - math.lgamma(a + b + 1) - math.log(math.pi)
    pw, below = {}, Counter()
    for c, b in sorted({(c, b) for c, b, _ in n}, key=lambda x: -len(x[0])):
        own = pe(n[c, b, "0"], n[c, b, "1"])
        pw[c, b] = own if len(c) == depth else np.logaddexp(own, below[c, b]) - math.log(2)
        if c:
            below[c[1:], b] += pw[c, b]

    def one(c, b):
        """Probability of a one: the mixture at each node of the path; below the deepest that was seen, 1/2."""
        got = 0.5
        for d in range(depth + 1):
            x = c[len(c) - (depth - d) :] if d < depth else b""
            zeros, ones = n[x, b, "0"], n[x, b, "1"]
            if zeros + ones:
                own = (ones + 0.5) / (zeros + ones + 1)
                w = 1.0 if len(x) == depth else 1 / (1 + math.exp(-max(-20, min(20, pe(zeros, ones) - below[x, b]))))
                got = w * own + (1 - w) * got
        return got

    out = []
    for t in texts:
        raw, total = bytes([ctw.START]) * depth + t.encode() + b"\xff", 0.0
        for i in range(depth, len(raw)):
            s = f"{raw[i]:08b}"
            for j in range(8):
                p = one(raw[i - depth : i], s[:j])
                total += math.log10(p if s[j] == "1" else 1 - p)
        out.append(total)
    return out
