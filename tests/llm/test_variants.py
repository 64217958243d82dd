import random
import re
import zlib
from collections import Counter

import pytest

from riskweave.llm import variants
from riskweave.llm.queries import op12_spelling_variants

LOWER = str.maketrans(variants.UPPER, variants.LOWER)


def brute(rows, length=5, least=3):
    """Counts, then all pairs of words by comparing them letter by letter."""
    seen = Counter()
    for doc, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = run.translate(LOWER)
            h = zlib.crc32(f"{'null' if doc is None else doc}:{run}".encode())
            at = h % len(run)
            seen[run[:at] + run[at + 1 :] if h % 97 == 0 else run] += 1
    words = {w: n for w, n in seen.items() if len(w) >= length and n >= least}
    out = {}
    for w, n in words.items():
        near = [x for x in words if apart(w, x)]
        form = min(near, key=lambda x: (-words[x], x)) if near else None
        out[w] = (form if near and words[form] >= 2 * n else None, n, len(near))
    rows = []
    for w, (form, n, n_near) in out.items():
        root = w
        while out[root][0]:
            root = out[root][0]
        rows.append((w, form, root, n, n_near, out[form][1] if form else None))
    return sorted(rows)


def apart(a, b):
    if len(a) < len(b):
        a, b = b, a
    if len(a) - len(b) > 1 or a == b:
        return False
    i = next((i for i in range(len(b)) if a[i] != b[i]), len(b))
    return a[i + 1 :] == (b[i + 1 :] if len(a) == len(b) else b[i:])


def frame(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, text string")


def run(df, **kw):
    return sorted(tuple(r) for r in variants.variants(df, **kw).collect())


def test_few_letters_many_neighbours(spark):
    """Words over three letters: every kind of edit at every place, in chains and at nodes of the trie."""
    r = random.Random(2)
    rows = [(i, " ".join("".join(r.choices("abé", k=r.randrange(1, 8))) for _ in range(120))) for i in range(60)]
    want = brute(rows, 3, 2)
    assert sum(w[4] for w in want) > 2000 and any(w[1] for w in want)
    assert run(frame(spark, rows), length=3, least=2) == want


def test_sample(spark, sf):
    rows = [tuple(r) for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").limit(60).collect()]
    assert run(frame(spark, rows)) == brute(rows)


def test_crowded_nodes(spark, monkeypatch):
    """States of a node dealt to many parts give the same pairs."""
    r = random.Random(6)
    rows = [(i, " ".join("".join(r.choices("abcd", k=6)) for _ in range(200))) for i in range(15)]
    monkeypatch.setattr(variants, "PART", 40)
    monkeypatch.setattr(variants, "LONG", 2)
    assert run(frame(spark, rows), least=2) == brute(rows, least=2)


def test_edges(spark):
    long = "x" * 30_000 + "y" + "z" * 30_000
    rows = [(1, None), (2, ""), (3, "abcde abcde abcde ABCDÉ abcdé abcdé Abcdéf ×÷×÷× ×÷×÷×"), (None, "abcde Abcdef abcdef ×÷×÷×"), (3, "abcdef abcdef"), (3, "abcdef abcdef")]
    rows += [(10 + i, long) for i in range(5)] + [(20 + i, long[:-1] + "w") for i in range(3)] + [(30 + i, long + "z") for i in range(3)]
    df = frame(spark, rows).selectExpr("*", "1 word", "2 n", "3 node", "'a' run")
    assert run(df) == brute(rows)
    assert run(df.limit(0)) == []
    assert run(df.where("doc_id = 2")) == []


def test_a_chain_of_words(spark):
    """Every word is a prefix of the next: as many nodes on a path as letters."""
    rows = [(i, " ".join("q" * k for k in range(1, 40))) for i in range(4)]
    assert run(frame(spark, rows)) == brute(rows)


def test_prefix_hashes():
    h, nexts, pos = variants.prefix_hashes(["abcde", "abxde", "é"])
    a, b = h[:6], h[6:12]
    assert (a[:3] == b[:3]).all() and not set(a[3:]) & set(b[3:]) and len(set(a)) == 6 and h[0] == h[12]
    assert "".join(map(chr, nexts[:5])) == "abcde" and nexts[5] == nexts[11] == nexts[13] == -1 and pos.tolist() == [*range(6), *range(6), 0, 1]


def test_query(spark, sf):
    got = op12_spelling_variants(spark, sf)
    assert got.columns == ["word", "form", "root", "n", "n_near", "form_n"]
    rows = got.collect()
    near = {r.word: r for r in rows}
    assert len(near) == len(rows) and all(apart(r.word, r.form) and near[r.form].n == r.form_n >= 2 * r.n for r in rows if r.form)
    assert all(near[r.form].root == r.root if r.form else r.root == r.word for r in rows)


@pytest.mark.parametrize("pair", [("abcde", "abcdef"), ("abcdef", "bcdef"), ("abcde", "abxde"), ("abcde", "abcd")])
def test_apart(pair):
    assert apart(*pair) and apart(*pair[::-1])
