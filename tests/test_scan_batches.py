import random
import unicodedata

import pytest
from pyspark.sql import functions as F

from riskweave.functions import scan as sc
from riskweave.functions import text as tx
from riskweave.operators.annotate import MIXED, NATIVE
from riskweave.plans import rules as R
from riskweave.queries import PROBES

NAMES = tuple([r.id for r in R.RULES if r.id not in NATIVE] + list(sc.HELPERS))


def one_by_one(text, names):
    """The matches by the patterns alone, without groups, pieces or gates."""
    out = []
    for name, pattern, *_, cap in sc._plan(names):
        out += [(name, n, m.start(), m[0]) for n, m in enumerate(list(pattern.finditer(text))[:cap])]
    return out


def test_groups_lose_no_match(monkeypatch):
    r, texts = random.Random(3), []
    for _ in range(1500):
        x = r.choice(["", "\n", " "]).join(r.choice(PROBES) for _ in range(r.randrange(1, 3)))
        x = r.choice([str, str, str.upper, str.swapcase])(x).replace(" ", r.choice([" ", " ", "\t", "\u3000", "\xa0"]))
        x = x.replace(*r.choice([("", ""), ("", ""), ("i", "ı"), ("s", "ſ"), ("k", "\u212a"), ("1", "\u0661")]))
        at = r.randrange(len(x))
        texts.append(x[:at] + r.choice(["", "é", "-", "/", "漢", "@", "İ"]) + x[at:])
    got = sc.scan_all(texts, NAMES)
    assert got == [one_by_one(t, NAMES) for t in texts] and sum(map(len, got)) > 1000
    tried = []
    monkeypatch.setattr(sc, "_scan", lambda text, low, han, names: tried.append(names) or [])
    sc.scan_all(["plain words of no interest"] * 3, NAMES)
    assert all(set(names) == {"B-6", "B-7"} for names in tried)  # all other rules are passed over in one pass


def test_flags_hold_where_native_rules_find_something(spark):
    codes = [*range(0x3400), *range(0xA000, 0xAC00), *range(0xF900, 0x20000)]
    letters = spark.createDataFrame([(chr(x),) for x in codes if unicodedata.category(chr(x))[0] in "LN"], "c string")
    known = letters.where(F.col("c").rlike(r"[\p{IsGreek}\p{IsCyrillic}\p{IsLatin}]")).select("c", F.col("c").rlike(r"\p{IsLatin}").alias("latin"), F.col("c").rlike(r"[\p{L}\p{N}_]").alias("word")).collect()
    rows = [f"ab{x.c}" if not x.latin else f"{x.c}\u0434" for x in known if x.word]
    texts = spark.createDataFrame([(x,) for x in rows], "t string").where(F.col("t").rlike(MIXED))
    texts = [x.t for x in texts.collect()]
    assert len(texts) > 1500 and [t for t, out in zip(texts, sc.scan_all(texts, ("#mixed",)), strict=True) if not out] == []
    cases = {"#deep": "a\n" + "> " * 20, "#bars": "|" * 60, "#refs": "&a;" * 2001, "#repeats": "ab\n" * 30_000, "#tags": "a\U000e0041", "#exposed": "ig\u200bnore", "#mixed": "p\u0430y"}
    assert set(cases) == set(sc.FLAGS)
    for name, text in cases.items():
        assert [h[0] for h in sc.scan(text, (name,))] == [name] and sc.scan("plain", (name,)) == []
    assert [h[0] for h in sc.scan("s\u0443st\u0435m \u0455ystem", ("#exposed",))] == ["#exposed"]


@pytest.mark.parametrize("seed", range(3))
def test_frequent_pairs(seed):
    import pandas as pd

    r = random.Random(seed)
    texts = pd.Series([" ".join(r.choice(["the", "sea", "É", "été", "a", "x1", "µm,", "o_o", "漢字", "Ünder-way"][: r.choice([3, 8, 10])]) for _ in range(r.randrange(1000))) for _ in range(60)])
    want, got = tx._top_pair(texts), tx._frequent_pair(texts, 30)
    frequent = want.n > 30
    assert frequent.any() and (~frequent).any() and got[frequent].equals(want[frequent]) and (got.n[~frequent] == 0).all()


def test_clean_keeps_places(spark):
    from riskweave.functions import rx

    rows = spark.createDataFrame([("a\ufdd0b\ufdd1\ufdd0",), (None,), ("plain",)], "t string")
    assert [x[0] for x in rows.select(rx.clean(F.col("t"))).collect()] == ["a\ufffdb\ufffd\ufffd", "", "plain"]
