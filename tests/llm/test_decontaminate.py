import random
from collections import defaultdict

from riskweave.llm import decontaminate as dc


def plain_tokens(text):
    out, opens, prev_num = [], True, False
    for w in text.replace("\n", ".\n").split():
        tokens, ends = dc.parse(w)
        for k, _, v in tokens:
            kind = dc.LITERAL if (k == dc.NAME and opens) or (k == dc.UNIT and not prev_num) else k
            out.append((kind, v))
            prev_num = kind == dc.NUM
        opens = ends
    return out


def plain_windows(text, width=dc.WINDOW):
    t = plain_tokens(text)
    n = min(width, len(t))
    got = []
    for p in range(len(t) - n + 1 if t else 0):
        w = t[p : p + n]
        if sum(k == dc.LITERAL for k, _ in w) >= min(2, n):
            got.append((tuple(v if k == dc.LITERAL else k for k, v in w), p, [f"{k}{v}" for k, v in w if k != dc.LITERAL]))
    return got


def exact_windows(text, width=dc.WINDOW):
    """Windows with fewer literals than two, by their values."""
    t = plain_tokens(text)
    n = min(width, len(t))
    cut = [(t[p : p + n], p) for p in range(len(t) - n + 1 if t else 0)]
    return [(("exact", *(v for _, v in w)), p, []) for w, p in cut if sum(k == dc.LITERAL for k, _ in w) < min(2, n)]


def folded_windows(text):
    """Windows of tokens where a run of names is one."""
    t = []
    for kind, v in plain_tokens(text):
        if kind == dc.NAME and t and t[-1][0] == kind:
            t[-1] = (kind, f"{t[-1][1]} {v}")
        else:
            t.append((kind, v))
    cut = [(t[p : p + dc.WINDOW], p) for p in range(len(t) - dc.WINDOW + 1)]
    return [(tuple(v if k == dc.LITERAL else k for k, v in w), p, [f"{k}{v}" for k, v in w if k != dc.LITERAL]) for w, p in cut if sum(k == dc.LITERAL for k, _ in w) >= 2]


def brute(docs, bench, percent=80):
    items = [(i, plain_windows(t or "") or exact_windows(t or ""), False) for i, t in bench if i is not None]
    for i, t in bench:
        if i is not None and any(k == dc.NAME for k, _ in plain_tokens(t or "")) and len(w := folded_windows(t)) >= dc.WINDOW:
            items.append((i, w, True))
    out = []
    for d, t in docs:
        found, forms = [], (defaultdict(list), defaultdict(list))
        for w, p, s in plain_windows(t or "") + exact_windows(t or ""):
            forms[0][w].append((p, s))
        for w, p, s in folded_windows(t or ""):
            forms[1][w].append((p, s))
        for i, ws, form in items:
            index, lines = forms[form], defaultdict(list)
            for w, q, si in ws:
                for p, sd in index[w]:
                    lines[p - q].append((q, si, sd))
            hit, changed = set(), False
            for x in lines.values():
                pairs = {(a, b) for _, si, sd in x for a, b in zip(si, sd, strict=True)}
                if len(pairs) == len({a for a, _ in pairs}):
                    hit |= {q for q, _, _ in x}
                    changed |= any(a != b for a, b in pairs)
            if hit and 100 * len(hit) / len(ws) >= percent - 1e-9:
                found.append((len(hit) / len(ws), -i, changed))
        best = max(found, key=lambda f: (*f[:2], not f[2])) if found else None
        out.append((d, bool(found), len({i for _, i, _ in found}), -best[1] if best else None, round(best[0], 6) if best else None, best[2] if best else None))
    return sorted(out, key=str)


def run(docs, bench):
    return sorted((tuple(r)[:6] for r in dc.leaks(docs, bench).collect()), key=str)


def test_sample(spark, sf):
    docs, bench = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text"), spark.read.parquet(f"{sf}/benchmark.parquet")
    got = run(docs, bench)
    assert got == brute([tuple(r) for r in docs.collect()], [tuple(r) for r in bench.collect()])
    texts, items = {r.doc_id: r.text for r in docs.collect()}, [r.text for r in bench.collect()]
    assert all(c == any(i in texts[d] for i in items) for d, c, *_ in got)
    assert dc.drop_leaks(docs, bench).count() == sum(not r[1] for r in got)


QUESTION = "A train leaves Berlin at 9:30 with 120 passengers and travels 300 km to Hamburg. After the train left Berlin, how many hours does it need if its speed is 100 km/h on average?"


def test_parameters(spark):
    changed = QUESTION.replace("Berlin", "Paris").replace("Hamburg", "Lyon").replace("120", "75").replace("300", "450").replace("100", "150")
    uneven = QUESTION.replace("leaves Berlin", "leaves Paris")
    filler = " ".join(random.Random(2).choices(["some", "plain", "filler", "words", "here"], k=80))
    docs = [(1, f"{filler} {QUESTION} {filler}"), (2, f"{filler}\n{changed}\n{filler}"), (3, uneven), (4, filler), (5, None), (6, ""), (None, QUESTION), (7, changed), (7, changed), (8, "1 2 3 4 5 6 7 8"), (9, " ".join(QUESTION.split()[:20])), (10, "two words")]
    bench = [(1, QUESTION), (2, None), (None, QUESTION), (3, "1 2 3 4 5 6"), (4, "two words"), (1, "")]
    d, b = spark.createDataFrame([(*r, 0, "x") for r in docs], "doc_id long, text string, item_id int, coverage string"), spark.createDataFrame(bench, "item_id long, text string")
    got = run(d, b)
    assert got == brute(docs, bench)
    flags = {r[0]: (r[1], r[5]) for r in got}
    assert flags[1] == (True, False) and flags[2] == flags[7] == (True, True) and flags[8] == flags[10] == (True, False)
    assert not any(flags[k][0] for k in (3, 4, 5, 6, 9))
    assert dc.drop_leaks(d, b).columns == d.columns and dc.drop_leaks(d, b).count() == 5
    assert run(d.limit(0), b) == [] and not any(r[1] for r in run(d, b.limit(0)))


def flagged(spark, docs, bench):
    d, b = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(bench, "item_id long, text string")
    return {r.doc_id: r.item_id for r in dc.leaks(d, b).collect() if r.contaminated}


def test_short_items(spark):
    bench = [(1, "Who wrote Hamlet?"), (2, "Which river runs through old town?"), (3, "zebra")]
    around = "we were asked {} and nobody could answer that at all"
    docs = [(1, around.format(bench[0][1])), (2, around.format(bench[1][1])), (3, around.format("a zebra")), (4, around.format("Who wrote Faust?")), (5, around.format("nothing")), (6, "Who wrote Hamlet?"), (7, around.format("this. " + bench[1][1]))]
    assert flagged(spark, docs, bench) == {1: 1, 2: 2, 3: 3, 6: 1, 7: 2}


def test_few_literals(spark):
    names, units = "The Old Red Lion And King George Inn", "10 km 20 kg 30 km 40 kg 50 km 60 kg"
    mixed = "Give the sum for Anna Maria Clara Bella Donna Erika and then divide it by the number of people"
    docs = [(1, f"they met at {names} by noon"), (2, f"listed are {units} in all"), (3, f"they met at {names.replace('Lion', 'Bear')} by noon"), (4, f"listed are {units.replace('30', '31')} in all"), (5, mixed.replace("Clara", "Carla"))]
    got = flagged(spark, docs, [(1, names), (2, units), (3, mixed)])
    assert got == {1: 1, 2: 2, 5: 3}


def test_numbers_alone(spark):
    """A row of numbers is found where it is quoted, and no other row of numbers."""
    powers, mixed = "2 4 8 16 32 64 128 256 512 1024", "1, 1, 2, 3, 5, 8 and then 13, 21, 34, 55"
    docs = [(1, f"continue {powers} please"), (2, "continue 2 4 8 16 33 64 129 256 513 1024 please"), (3, f"so {mixed} it goes"), (4, "3 5 7 11 13 17 19 23"), (5, powers)]
    assert flagged(spark, docs, [(1, powers), (2, mixed)]) == {1: 1, 3: 2, 5: 1}


PROBLEM = "Every morning John Smith walks 3 km to the market where Mary Jones sells 12 apples for 4 dollars. How much does John Smith pay when he buys 5 apples from Mary Jones?"


def test_names_of_other_lengths(spark):
    """A run of names is one placeholder, whatever number of words stands for it; one name for two people is not consistent."""
    r = random.Random(4)
    other = PROBLEM.replace("John Smith", "Robert").replace("Mary Jones", "Anna Maria de Vries").replace("12", "15").replace(" de ", " De ")
    filler = " ".join(r.choices(["some", "plain", "Filler", "Words", "here", "Anna"], k=60))
    uneven = PROBLEM.replace("John Smith", "Robert", 1).replace("Mary Jones", "Anna").replace("John Smith", "Peter")
    docs = [(1, f"{filler}. {other} {filler}"), (2, filler), (3, PROBLEM), (4, uneven), (5, f"{filler} {PROBLEM.replace('John Smith', 'Lee')}"), (6, "They asked Anna Maria who is Robert Miller of Old Town")]
    bench = [(1, PROBLEM), (2, PROBLEM.replace("John Smith", "Lee")), (3, "who is Robert of Rome"), (4, "Lee met Ann")]
    d, b = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(bench, "item_id long, text string")
    got = run(d, b)
    assert got == brute(docs, bench)
    flags = {r[0]: (r[1], r[3], r[5]) for r in got}
    assert flags[1] == (True, 1, True) and flags[3] == (True, 1, False) and flags[5] == (True, 2, False)
    assert not flags[2][0] and not flags[6][0]
    assert flags[4] == (True, 2, True)  # of one-word names: two alignments, each consistent by itself
    assert flagged(spark, [docs[3]], [bench[0]]) == {}  # folded, it is one alignment, in which John Smith is two people


def test_folded_windows_against_plain_ones():
    """What the folded pass and the plain windows without runs give together is every folded window, once."""
    r = random.Random(11)
    t = dc.Templates()
    words = ["Anna", "Bella", "Rome", "some", "plain", "words", "5", "km", "stop.", "here"]
    texts = ["", "Anna", *(" ".join(r.choices(words, k=r.randrange(1, 60))) for _ in range(300))]
    tokens = t.tokens(texts)
    win, p, who, width, exact, bare, within, kinds, inner, at, begin = t.windows(tokens, len(texts), [dc.WINDOW])
    runs, whole = (t.folded(tokens, len(texts), x) for x in (True, False))
    f = runs[4][p]
    single = [(int(w), int(o), int(k)) for w, o, k, e in zip(win, who, f, exact, strict=True) if k >= 0 and not e]
    assert sorted(single + list(zip(*(x.tolist() for x in (runs[0], runs[2], runs[3])), strict=True))) == sorted(zip(*(x.tolist() for x in (whole[0], whole[2], whole[3])), strict=True))
    for i, text in enumerate(texts):
        got = sorted((int(k), t.folded_slots(kinds, at, whole[5], int(q))) for q, o, k in zip(*whole[1:4], strict=True) if o == i)
        assert got == sorted((k, s) for _, k, s in folded_windows(text))


def test_very_long_text(spark):
    r = random.Random(7)
    filler = " ".join(r.choices(["some", "plain", "filler", "words", "here", "42", "Anna"], k=300_000))
    changed = QUESTION.replace("Berlin", "Paris").replace("120", "75")
    assert flagged(spark, [(1, f"{filler}. {changed} {filler}"), (2, filler)], [(1, QUESTION)]) == {1: 1}
