import random

import pytest

from riskweave.operators.lookalikes import lookalikes, shortened
from riskweave.operators.nearby import near


def distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        row, last = [i], row
        for j, y in enumerate(b, 1):
            row.append(min(last[j] + 1, row[-1] + 1, last[j - 1] + (x != y)))
    return row[-1]


@pytest.mark.parametrize("most", [1, 2])
def test_lookalikes_are_those_of_all_pairs(spark, most):
    r = random.Random(most)
    word = lambda: "".join(r.choices("abcé", k=r.randrange(1, 9)))
    names, tokens = {word() for _ in range(60)}, [word() for _ in range(500)] + ["requests", None, "", "x" * 50_000]
    got = {(x.token, x.official, x.distance) for x in lookalikes(spark.createDataFrame([(t,) for t in tokens], "token string"), spark.createDataFrame([(n,) for n in [*names, None, ""]], "name string"), most).collect()}
    want = set()
    for t in {t for t in tokens if t and len(t) < 100} - names:
        d, n = min((distance(t, n), n) for n in names)
        if d <= most:
            want.add((t, n, d))
    assert want and got == want


def test_lookalikes_of_nothing(spark):
    some, none = spark.createDataFrame([("abc",)], "token string"), spark.createDataFrame([], "name string")
    assert lookalikes(some, none).count() == 0 and lookalikes(some.limit(0), none).count() == 0
    assert lookalikes(some, spark.createDataFrame([("abc",), ("abd",)], "name string")).count() == 0  # a name itself


def test_shortened(spark):
    got = spark.createDataFrame([("aba",), ("",)], "w string").select(shortened("w", 2).alias("s")).collect()
    assert sorted(got[0].s) == sorted({"aba", "ba", "aa", "ab", "a", "b"}) and got[1].s == [""]


def test_near(spark):
    r = random.Random(5)
    left = [(r.choice("abc"), r.randrange(5000)) for _ in range(300)] + [("d", 1), (None, 5), ("a", None)]
    right = [(r.choice("abc"), r.randrange(5000)) for _ in range(30)] + [(None, 5), ("a", None)]
    df = lambda rows: spark.createDataFrame(rows, "record_id string, pos int")
    key = lambda x: (str(x[0]), x[1])
    for d in (1, 40, 400):
        want = [x for x in left if None not in x and any(x[0] == y[0] and y[1] is not None and abs(x[1] - y[1]) < d for y in right)]
        assert sorted((tuple(x) for x in near(df(left), df(right), d).collect()), key=key) == sorted(want, key=key)
    with pytest.raises(ValueError):
        near(df(left), df(right), 0)
