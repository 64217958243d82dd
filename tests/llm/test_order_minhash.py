import hashlib
import random

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st

from riskweave.llm import order_minhash as om


WORD = (1 << 64) - 1
BASE = 0x9E3779B97F4A7C15


def mixed(x):
    for factor in (0xFF51AFD7ED558CCD, 0xC4CEB9FE1A85EC53):
        x = (x ^ x >> 33) * factor & WORD
    return x ^ x >> 33


def kmer(s):
    """Hash of a k-mer: its code points as a polynomial; shorter ones with their length."""
    h = 0
    if len(s) < om.K:
        for c in s:
            h = (h * BASE + ord(c) + 1) & WORD
        return mixed((h + len(s)) & WORD)
    for c in s:
        h = (h * BASE + ord(c)) & WORD
    return mixed(h)


def plain(text, k=om.K, l=om.L, m=om.M, circles=om.CIRCLES):  # noqa: E741
    """Each entry by sorting all occurrence-numbered k-mers in its own order, with whole numbers only."""
    if not text:
        return [0] * m
    seen, items = {}, []
    for p in range(max(1, len(text) - k + 1)):
        h = kmer(text[p : p + k]) >> 24
        turn = seen[h] = seen.get(h, 0) + 1
        items.append((mixed((h + turn * BASE) & WORD), p))
    out = []
    for b in range(m):
        factor, start = mixed(b // (m // circles) + 1) | 1, (b % (m // circles) << 40) // (m // circles)
        placed = [(v * factor % (1 << 64) >> 24, p) for v, p in items]
        least = sorted(placed, key=lambda x: ((x[0] - start) % (1 << 40), x[1]))[:l]
        h = len(least)
        for v, _ in sorted(least, key=lambda x: x[1]):
            h = mixed((h * BASE + v + 1) & WORD)
        out.append(h >> 32)
    return out


@settings(max_examples=60, deadline=None)
@given(st.text(alphabet="ab é🙂", max_size=80))
def test_equals_plain(text):
    assert om.fingerprint(text).tolist() == plain(text)


def test_long_texts_equal_plain():
    r = random.Random(8)
    for n in (100, 192, 193, 1500):
        for alphabet in ("ab", "abcdefghij klmnop"):
            text = "".join(r.choices(alphabet, k=n))
            assert om.fingerprint(text).tolist() == plain(text)


def test_short_texts_have_many_orders():
    r = random.Random(2)
    for n, least in ((20, 30), (40, 50)):
        made = [len(set(om.fingerprint("".join(r.choices("abcdefghijklmnop ", k=n))).tolist())) for _ in range(20)]
        assert np.mean(made) > least, made


def test_follows_edits_and_order():
    r = random.Random(3)
    words = ["".join(r.choices("abcdefghij", k=6)) for _ in range(400)]
    a = " ".join(words)
    close = " ".join(words[:200] + ["new"] + words[200:])
    moved = " ".join(words[::-1])
    near = [om.likeness(om.fingerprint(a), om.fingerprint(x)) for x in (a, close, moved, " ".join(r.choices(words, k=3))[::-1])]
    assert near[0] == 1 and near[1] > 0.9 and near[2] < 0.2 and near[3] < 0.1


def expect(rows):
    rows = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1] is not None, r[1] or ""))
    out = []
    for (d, t), (_, n) in zip(rows, rows[1:] + rows[:1], strict=True):
        t, n = t or "", n or ""
        e = t[: len(t) - len(t) // 4] + n[: len(t) // 4]
        f, g, x = (om.fingerprint(y) for y in (t, e, n))
        out.append((d, len(t), hashlib.sha256(e.encode()).hexdigest(), f.astype(">u4").tobytes().hex(), g.astype(">u4").tobytes().hex(), float((f == g).mean()), float((f == x).mean())))
    return sorted(out, key=str)


def test_rows(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text")
    odd = spark.createDataFrame([(3, "b", 1), (3, "a" * 50, 1), (3, "a" * 50, 1), (None, "null id", 1), (-7, None, 1), (9, "", 1), (12, "xyz " * 30_000, 1)], "doc_id long, text string, n_chars int")
    one = odd.where("doc_id = 9")
    for d, size in ((docs, 40_000), (odd, 1 << 20), (odd, 30), (one, 10), (odd.limit(0), 10)):
        got = sorted((tuple(r) for r in om.fingerprints(d, size).collect()), key=str)
        assert got == expect([(r.doc_id, r.text) for r in d.collect()])
