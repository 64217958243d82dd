import hashlib
import itertools
import random
import re
import zlib
from collections import defaultdict

import pytest

from riskweave.llm import repair
from riskweave.llm.queries import op11_conversation_repair

WHITE = " \t\n\x0b\x0c\r"


def harm(rows):
    out = []
    for conv, turn, role, text in rows:
        role, text = " " if role is None else role, " " if text is None else text
        h = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        if h == 0:
            continue
        text = "" if h == 1 else re.sub("[.!?]", "", text) if h == 2 else text
        out += [(conv, turn, "user" if h == 4 else role, text)] * (2 if h == 3 else 1)
    return out


def ordered(rows):
    return sorted(rows, key=lambda r: (r[1] is not None, r[1] or 0, r[2], hashlib.md5(r[3].encode()).hexdigest()))


def faults(rows):
    seen, out = set(), []
    for _, _, role, text in rows:
        t = text.strip(WHITE)
        out.append("blank" if not t else "duplicate" if (role, text) in seen else "truncated" if t[-1] not in ".!?" else "")
        seen.add((role, text))
    return out


def cheapest(rows, kinds):
    """Least (cost, audit, repaired rows) by trying all sequences of edits with few inserted turns: no table of states."""
    best = None
    choices = [["D"] if k in ("blank", "duplicate") else ["D", "K", "Ru", "Ra"] for k in kinds]
    for picked in itertools.product(*choices):
        left = [(c[0], ("user" if c[1:] == "u" else "assistant") if c[0] == "R" else r[2], r[3]) if c != "D" else None for c, r in zip(picked, rows)]
        base = sum({"D": 4, "K": 0, "R": 3}[c[0]] + (3 if c != "D" and k == "truncated" else 0) for c, k in zip(picked, kinds))
        kept = [x for x in left if x]
        # between two kept rows, and at both ends, nothing or one or two inserted turns
        gaps = range(len(kept) + 1)
        for extra in itertools.product(("", "u", "a", "ua", "au"), repeat=len(kept) + 1):
            cost = base + 3 * sum(map(len, extra))
            if best is not None and cost > best[0]:
                continue
            letters = "".join(extra[g] + (kept[g][1][:1] if g < len(kept) else "") for g in gaps)
            if not re.fullmatch("(s?(ua)+)?", letters) or any(not x[1] for x in kept):
                continue
            turns = [t for g in gaps for t in [("I", {"u": "user", "a": "assistant"}[x], "") for x in extra[g]] + ([kept[g]] if g < len(kept) else [])]
            # deleted rows may stand before or after inserted turns: the least string over all interleavings
            for audit in _audits(left, extra):
                if best is None or (cost, audit) < best[:2]:
                    best = (cost, audit, turns)
    return best


def _audits(left, extra):
    """All places of the inserted turns of a gap among the deleted rows there."""
    parts, gap, deleted = [], 0, 0
    for x in [*left, None]:
        if x is None and len(parts) < 10**6:
            deleted += 1
            continue
        parts.append((len(extra[gap]), deleted, x[0]))
        gap, deleted = gap + 1, 0
    parts.append((len(extra[gap]), deleted - 1, ""))
    options = [[("".join("I" if k in at else "D" for k in range(i + d))) + last for at in map(set, itertools.combinations(range(i + d), i))] for i, d, last in parts]
    return map("".join, itertools.product(*options))


def brute(rows, damage=True):
    out = []
    groups = defaultdict(list)
    for r in harm(rows) if damage else [(c, t, " " if r is None else r, " " if x is None else x) for c, t, r, x in rows]:
        groups[r[0]].append(r)
    for conv in {r[0] for r in rows}:
        mine = ordered(groups[conv])
        kinds = faults(mine)
        turns = [r[1] for r in mine if r[1] is not None]
        gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
        illegal = sum(a[2][:1] + b[2][:1] not in ("su", "ua", "au") for a, b in zip(mine, mine[1:]))
        cost, audit, turns = cheapest(mine, kinds)
        sha = hashlib.sha256("\n".join(f"{role}:{text}" for _, role, text in turns).encode()).hexdigest()
        out.append((conv, gaps, kinds.count("blank"), kinds.count("duplicate"), kinds.count("truncated"), illegal, cost, audit, sha))
    return sorted(out, key=str)


def frame(spark, rows):
    return spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")


def run(df, damage=True, **kw):
    rows = repair.damaged(df) if damage else repair.undamaged(df)
    return sorted((tuple(r) for r in repair.reports(rows, **kw).collect()), key=str)


def some(seed, n, most=4):
    r, out = random.Random(seed), []
    for conv in range(n):
        for _ in range(r.randrange(most + 1)):
            turn = r.choice((None, 0, 1, 2, 3, 7))
            out.append((conv, turn, r.choice(("user", "user", "assistant", "assistant", "system", "tool", "", None, "unknown")), r.choice(("Hi.", "yes!", "no", "", " \t", None, "ok?", "ü. ", "a\nb", "a. \n\x0b"))))
    return out


@pytest.mark.parametrize("block_rows", [128, 1, 2])
def test_against_all_edits(spark, block_rows):
    rows = some(4, 60)
    assert run(frame(spark, rows), damage=False, block_rows=block_rows) == brute(rows, damage=False)


def test_damage(spark):
    rows = some(5, 120, 3)
    assert run(frame(spark, rows)) == brute(rows)


def test_edges(spark):
    rows = [(None, None, None, None), (None, 1, "user", "a."), (1, -(2**63), "user", "x."), (1, 2**63 - 1, "assistant", "y."), (2, 5, "assistant", "z."), (2, 5, "assistant", "z."), (2, 5, "assistant", "z.")]
    df = frame(spark, rows).selectExpr("*", "1 copies", "2 digest", "3 tag", "'x' audit")
    got = run(df, damage=False)
    want = [r if r[0] != 1 else (1, 2**63 - 1, *r[2:]) for r in brute(rows, damage=False)]
    assert got == want
    assert run(df.limit(0)) == []
    dropped = next(t for t in range(1000) if zlib.crc32(f"9:{t}".encode()) % 20 == 0)
    assert run(frame(spark, [(9, dropped, "user", "hi")])) == [(9, 0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())]


def test_long_conversation_and_texts(spark):
    """A conversation of many rows over several ranges and blocks, with very long texts: blocks change nothing."""
    r = random.Random(3)
    rows = [(7, t, r.choice(("user", "assistant")), r.choice((f"text {t}.", f"text {t}", "same."))) for t in range(1500)]
    rows += [(8, t, "ua"[t % 2] and ("user", "assistant")[t % 2], "word " * 200_000 + f"{t}.") for t in range(3)]
    df = frame(spark, rows).repartition(8)
    got = run(df, damage=False, block_rows=64)
    assert got == run(df, damage=False, block_rows=10_000)
    mine = ordered([x for x in rows if x[0] == 7])
    codes = "".join("x" if f in ("blank", "duplicate") else m[2][0].upper() if f == "truncated" else m[2][0] for f, m in zip(faults(mine), mine))
    assert got[0][6] == viterbi(codes) and len(got[0][7].replace("I", "")) == len(codes)
    turns = [tuple(x)[1:] for x in repair.repaired(repair.undamaged(df), 64).orderBy("conv_id", "position").where("conv_id = 7").collect()]
    assert [t[0] for t in turns] == list(range(len(turns))) and re.fullmatch("(s?(ua)+)?", "".join(t[1][0] for t in turns))
    assert hashlib.sha256("\n".join(f"{t[1]}:{t[2]}" for t in turns).encode()).hexdigest() == got[0][8]


def viterbi(codes):
    """Least cost by plain relaxation over rows and states."""
    cost = {0: 0}

    def insert(c):
        for _ in range(3):
            for q, v in list(c.items()):
                for x in "ua":
                    if (q, x) in repair.STEP:
                        to = repair.STEP[q, x]
                        c[to] = min(c.get(to, 10**9), v + 3)
        return c

    for code in codes:
        cost, new = insert(cost), {}
        for q, v in cost.items():
            for _, c, initial in repair.edits(code):
                to = q if initial is None else repair.STEP.get((q, initial))
                if to is not None:
                    new[to] = min(new.get(to, 10**9), v + c)
        cost = new
    return min(v for q, v in insert(cost).items() if q in (0, 3))


def test_agenda_stops_at_its_goal():
    seen = []

    def deduce(weight, item):
        seen.append(item)
        yield (weight[0] + 1,), item + 1

    assert repair.lightest([((0,), 0), ((0,), 5)], deduce, {7}) == {0: (0,), 5: (0,), 1: (1,), 6: (1,), 2: (2,), 7: (2,)}
    assert 7 not in seen


def test_query(spark, sf):
    rows = [tuple(r) for r in spark.read.parquet(f"{sf}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    short = defaultdict(int)
    for r in rows:
        short[r[0]] += 1
    got = {r.conv_id: tuple(r) for r in op11_conversation_repair(spark, sf).collect()}
    assert got.keys() == short.keys()
    few = [r for r in rows if short[r[0]] <= 4]
    assert few and all(got[w[0]] == w for w in brute(few))
