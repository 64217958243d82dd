"""Repair of conversation structure by Knuth's lightest derivation (operator 11).

A conversation is legal if the initials of its roles read ``(s?(ua)+)?``. Its rows may be kept (K), given the role
of a user or an assistant (R) or deleted (D), and empty turns inserted (I); the lightest such sequence is wanted.

Deductions: the item (i, p, q) says that the first i rows of a block can be made to lead from state p of the
grammar to q. Its weight is (cost, i, audit), the audit being the letters of its edits. An item and an edit of
the next row, an axiom of its own, give an item one row further; an item and an inserted turn give one at the same
row. Both ways to add up weights are monotone and superior: cost or i grows, and two audits of the same rows and
cost are never a prefix of each other, so what is appended does not turn their order. So Knuth's agenda holds: the
least weight popped for an item is final. A second agenda does the same over blocks, whose weights for each (p, q) are
its axioms. That makes the weights of blocks an associative product: a conversation with a third of all rows is
cut into blocks that are weighed in parallel, and only their sixteen weights meet.

Spark's part: rows lose their texts but for a digest; equal rows of one turn are counted before they are shuffled;
ranges of (conversation, turn, role, digest) cut long conversations; the few conversations that cross ranges are put
together from their blocks. At the end one sorted pass over the texts applies the audits, a row at a time.
SHA-256 reads its input in order, so the digest of one conversation is one stream, of bounded memory, in one task.

Defined results: a null role or text is one space, as is a null conv_id or turn where a key is made of them; rows of
one turn go by role and digest of their text; a null conv_id is a conversation; repeated rows are rows like others (so
duplicates); a role that begins with none of s, u, a fits nowhere and is rerolled or deleted; gaps beyond a long
are the largest long; no rows give no rows; other columns are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterable, Iterator
from functools import lru_cache
from heapq import heappop, heappush

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from riskweave.session import ship

from .common import tidy
from .graph import saved

#: Rows of a block; its weighing is quadratic in them.
BLOCK = 128
#: Grammar states: 0 nothing yet, 1 after s, 2 after u, 3 after a. Which role's initial leads where.
STEP = {(0, "s"): 1, (0, "u"): 2, (1, "u"): 2, (2, "a"): 3, (3, "u"): 2}
STATES, LEGAL = range(4), (0, 3)
NEXT = {0: "user", 1: "user", 2: "assistant", 3: "user"}
KEEP, REROLE, DELETE, INSERT, TRUNCATED = 0, 3, 4, 3, 3

LIGHT = "conv_id long, turn long, role string, digest string, initial string, blank boolean, truncated boolean, copies long, duplicate boolean"
COUNTS = "gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string"
WEIGHED = "conv_id long, turn long, role string, digest string, whole boolean, n_rows long, blank long, duplicate long, truncated long, illegal long, first string, last string, lo long, hi long, turns long, costs array<long>, audits array<string>"
RESULT = f"conv_id long, {COUNTS}, repaired_sha256 string"


def lightest(axioms: Iterable[tuple], deduce: Callable[[tuple, tuple], Iterable[tuple]], goals: set | None = None) -> dict:
    """Knuth's agenda: the least weight of every item that can be derived, or of ``goals`` until all of them are final.

    ``axioms`` are (weight, item); ``deduce(weight, item)`` gives the (weight, item) that follow from a final item
    and axioms. Weights must not fall along a deduction and must keep their order through it.
    """
    agenda, final, open_goals = list(axioms), {}, set(goals or ())
    agenda.sort()
    while agenda:
        weight, item = heappop(agenda)
        if item in final:
            continue
        final[item] = weight
        if goals is not None:
            open_goals.discard(item)
            if not open_goals:
                break
        for new in deduce(weight, item):
            if new[1] not in final:
                heappush(agenda, new)
    return final


@lru_cache(maxsize=1 << 16)
def edits(code: str) -> tuple[tuple[str, int, str | None], ...]:
    """(letter, cost, initial that it leaves) of the edits of a row: s, u, a, o by its role, upper case if truncated, x if it must go."""
    out = [("D", DELETE, None)]
    if code != "x":
        more = TRUNCATED if code.isupper() else 0
        out += [("K", KEEP + more, code.lower()), ("R", REROLE + more, "u"), ("R", REROLE + more, "a")]
    return tuple(out)


@lru_cache(maxsize=1 << 15)
def block_weights(codes: str, starts: tuple[int, ...] = tuple(STATES)) -> dict[tuple[int, int], tuple[int, str]]:
    """(p, q) -> (cost, audit): the lightest edits of a block of rows that lead from a state p of ``starts`` to q."""
    n = len(codes)

    def deduce(weight: tuple, item: tuple) -> Iterator[tuple]:
        cost, i, audit = weight
        _, p, q = item
        if i < n:
            for letter, c, initial in edits(codes[i]):
                to = q if initial is None else STEP.get((q, initial))
                if to is not None:
                    yield (cost + c, i + 1, audit + letter), (i + 1, p, to)
        for initial in "ua":
            to = STEP.get((q, initial))
            if to is not None:
                yield (cost + INSERT, i, audit + "I"), (i, p, to)

    final = lightest([((0, 0, ""), (0, p, p)) for p in starts], deduce)
    return {(p, q): (w[0], w[2]) for (i, p, q), w in final.items() if i == n}


def goal(blocks: Iterable[dict[tuple[int, int], tuple[int, str]]]) -> tuple[int, str]:
    """(cost, audit): the lightest derivation of a whole conversation from the weights of its blocks in order.

    One agenda for each block: the items are the states that all rows so far may end in.
    """
    so_far = {0: (0, "")}
    for weights in blocks:
        # an axiom is a final state before the block; an item of the block follows from it and one weight of the block
        axioms = [((c, 0, a), ("before", p)) for p, (c, a) in so_far.items()]

        def deduce(weight: tuple, item: tuple, weights=weights) -> Iterator[tuple]:
            if item[0] == "before":
                for q in STATES:
                    if (item[1], q) in weights:
                        c, a = weights[item[1], q]
                        yield (weight[0] + c, 1, weight[2] + a), ("after", q)

        final = lightest(axioms, deduce)
        so_far = {q: (w[0], w[2]) for (when, q), w in final.items() if when == "after"}
    return min(so_far[q] for q in LEGAL if q in so_far)


@lru_cache(maxsize=1 << 15)
def whole_weight(codes: str) -> tuple[int, str]:
    return goal([block_weights(codes, (0,))])


def damaged(conversations: DataFrame) -> DataFrame:
    """conv_id, turn, role, text and copies (0 for a dropped row) of each row after the damage that its key decides."""
    key = F.concat(F.coalesce(F.col("conv_id").cast("string"), F.lit(" ")), F.lit(":"), F.coalesce(F.col("turn").cast("string"), F.lit(" ")))
    rows = conversations.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), F.coalesce(F.col("role").cast("string"), F.lit(" ")).alias("role"), F.coalesce(F.col("text").cast("string"), F.lit(" ")).alias("text"), (F.crc32(key) % 20).alias("harm"))
    text = F.when(F.col("harm") == 1, "").when(F.col("harm") == 2, F.translate("text", ".!?", "")).otherwise(F.col("text"))
    role = F.when(F.col("harm") == 4, "user").otherwise(F.col("role"))
    copies = F.when(F.col("harm") == 0, 0).when(F.col("harm") == 3, 2).otherwise(1)
    return rows.select("conv_id", "turn", role.alias("role"), text.alias("text"), copies.cast("long").alias("copies"))


def undamaged(conversations: DataFrame) -> DataFrame:
    """The same columns of rows as they are."""
    return conversations.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), *(F.coalesce(F.col(c).cast("string"), F.lit(" ")).alias(c) for c in ("role", "text")), F.lit(1).cast("long").alias("copies"))


def _light(rows: DataFrame) -> DataFrame:
    """One row for equal rows of a turn, without text: what weighing needs."""
    end = F.expr("substring(rtrim(' \\t\\n\\u000B\\f\\r', text), -1, 1)")
    gone = F.col("copies") == 0
    initial = F.substring("role", 1, 1)
    slim = rows.select("conv_id", "turn", F.when(gone, "").otherwise(F.col("role")).alias("role"), F.when(gone, "").otherwise(F.md5("text")).alias("digest"), F.when(initial.isin("s", "u", "a"), initial).otherwise("o").alias("initial"), end.alias("end"), "copies", gone.alias("gone"))
    slim = slim.select("conv_id", "turn", "role", "digest", F.when(F.col("gone"), "").otherwise(F.col("initial")).alias("initial"), (F.col("end") == "").alias("blank"), (~F.col("end").isin("", ".", "!", "?")).alias("truncated"), "copies")
    once = slim.groupBy("conv_id", "turn", "role", "digest", "initial").agg(F.max("blank").alias("blank"), F.max("truncated").alias("truncated"), F.sum("copies").alias("copies"))
    at = F.struct(F.col("turn").isNotNull().alias("has"), F.col("turn").alias("turn"))
    again = once.where("copies > 0").groupBy("conv_id", "role", "digest").agg(F.count("*").alias("times"), F.min(at).alias("at")).where("times > 1")
    again = again.select(F.col("conv_id").alias("c"), F.col("role").alias("r"), F.col("digest").alias("d"), "at")
    both = once.join(again, F.col("conv_id").eqNullSafe(F.col("c")) & (F.col("role") == F.col("r")) & (F.col("digest") == F.col("d")), "left")
    later = F.coalesce((F.col("copies") > 0) & F.col("at").isNotNull() & ~at.eqNullSafe(F.col("at")), F.lit(False))
    return both.select("conv_id", "turn", "role", "digest", "initial", "blank", "truncated", "copies", later.alias("duplicate"))


class _Block:
    """Rows of one conversation that follow each other."""

    def __init__(self, key: tuple):
        self.key, self.codes, self.n = key, [], 0
        self.blank = self.duplicate = self.truncated = self.illegal = self.turns = 0
        self.first = self.last = self.lo = self.hi = None

    def add(self, turn, initial, blank, truncated, copies, duplicate) -> None:
        if not copies:
            return
        self.n += copies
        if blank:
            self.blank += copies
            self.codes.append("x" * copies)
        else:
            first = not duplicate
            self.duplicate += copies - first
            self.truncated += first and truncated
            self.codes.append((initial.upper() if truncated else initial if first else "") + "x" * (copies - 1) if first else "x" * copies)
        if self.last is None:
            self.first = initial
        elif self.last + initial not in ("su", "ua", "au"):
            self.illegal += 1
        self.illegal += copies - 1  # a role after itself
        self.last = initial
        if turn is not None and turn != self.hi:
            self.turns += 1
            self.hi = turn
            if self.lo is None:
                self.lo = turn

    def row(self, whole: bool) -> tuple:
        codes = "".join(self.codes)
        if whole:
            cost, audit = whole_weight(codes) if len(codes) <= BLOCK else goal([block_weights(codes[at : at + BLOCK]) for at in range(0, len(codes), BLOCK)])
            costs, audits = [cost], [audit]
        else:
            parts = [block_weights(codes[at : at + BLOCK]) for at in range(0, len(codes), BLOCK)] or [block_weights("")]
            got = _product(parts)
            costs, audits = [got.get((p, q), (-1, ""))[0] for p in STATES for q in STATES], [got.get((p, q), (-1, ""))[1] for p in STATES for q in STATES]
        return (*self.key, whole, self.n, self.blank, self.duplicate, self.truncated, self.illegal, self.first, self.last, self.lo, self.hi, self.turns, costs, audits)


def _product(parts: list[dict]) -> dict:
    """(p, q) -> weight over several blocks, for every state p before them."""
    got = parts[0]
    for more in parts[1:]:
        new: dict = {}
        for (p, q), (c, a) in got.items():
            for r in STATES:
                if (q, r) in more:
                    w = (c + more[q, r][0], a + more[q, r][1])
                    if (p, r) not in new or w < new[p, r]:
                        new[p, r] = w
        got = new
    return got


def _batch(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), schema, strict=True)], schema=schema)


_TYPES = {"long": pa.int64(), "string": pa.string(), "boolean": pa.bool_(), "array<long>": pa.list_(pa.int64()), "array<string>": pa.list_(pa.string())}


def _schema(ddl: str) -> pa.Schema:
    return pa.schema([(n, _TYPES[t]) for n, t in (f.split(" ", 1) for f in ddl.split(", "))])


def _weighed(light: DataFrame, block_rows: int) -> DataFrame:
    """The blocks of all conversations, ranges of rows at a time; ``whole`` if a block is all of its conversation."""
    order = ["conv_id", "turn", "role", "digest"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema, out, block, number, cut = _schema(WEIGHED), [], None, 0, False
        for b in batches:
            for conv, turn, role, digest, initial, blank, truncated, copies, duplicate in zip(*(c.to_pylist() for c in b.columns), strict=True):
                if block is None or block.key[0] != conv:
                    if block is not None:
                        out.append(block.row(whole=number > 0 and not cut))
                        number += 1
                    block, cut = _Block((conv, turn, role, digest)), False
                elif block.n >= block_rows:
                    out.append(block.row(whole=False))
                    block, cut = _Block((conv, turn, role, digest)), True
                block.add(turn, initial, blank, truncated, copies, duplicate)
            if len(out) >= 2000:
                yield _batch(out, schema)
                out = []
        if block is not None:  # the last one may go on in the next range
            out.append(block.row(whole=False))
        if out:
            yield _batch(out, schema)

    return light.repartitionByRange(*order).sortWithinPartitions(*order).select(*(f.split()[0] for f in LIGHT.split(", "))).mapInArrow(tidy("repair", run), WEIGHED)


def _gaps(lo, hi, turns: int) -> int:
    return 0 if lo is None else min(hi - lo + 1 - turns, (1 << 63) - 1)


def _put_together(blocks: DataFrame) -> DataFrame:
    """Counts and audit of each conversation; those of several blocks meet in their order."""

    def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema, out = _schema(f"conv_id long, {COUNTS}"), []
        for b in batches:
            out += [(r["conv_id"], _gaps(r["lo"], r["hi"], r["turns"]), r["blank"], r["duplicate"], r["truncated"], r["illegal"], r["costs"][0], r["audits"][0]) for r in b.to_pylist()]
            if out:
                yield _batch(out, schema)
                out = []

    def several(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema, conv, so_far = _schema(f"conv_id long, {COUNTS}"), None, None

        def close() -> tuple:
            t = so_far
            cost, audit = min(t["w"][q] for q in LEGAL if q in t["w"])
            return (conv, _gaps(t["lo"], t["hi"], t["turns"]), t["blank"], t["duplicate"], t["truncated"], t["illegal"], cost, audit)

        for b in batches:
            out = []
            for r in b.to_pylist():
                if so_far is None or r["conv_id"] != conv:
                    if so_far is not None:
                        out.append(close())
                    conv, so_far = r["conv_id"], {"w": {0: (0, "")}, "lo": None, "hi": None, "last": None, **dict.fromkeys(("turns", "blank", "duplicate", "truncated", "illegal"), 0)}
                t, weights = so_far, {(p, q): (r["costs"][4 * p + q], r["audits"][4 * p + q]) for p in STATES for q in STATES if r["costs"][4 * p + q] >= 0}
                new: dict = {}
                for (p, q), (c, a) in weights.items():
                    if p in t["w"]:
                        w = (t["w"][p][0] + c, t["w"][p][1] + a)
                        new[q] = min(w, new.get(q, w))
                t["w"] = new
                for k in ("blank", "duplicate", "truncated", "illegal"):
                    t[k] += r[k]
                if r["first"] is not None:
                    t["illegal"] += t["last"] is not None and t["last"] + r["first"] not in ("su", "ua", "au")
                    t["last"] = r["last"]
                if r["lo"] is not None:
                    t["turns"] += r["turns"] - (t["hi"] == r["lo"])
                    t["lo"], t["hi"] = r["lo"] if t["lo"] is None else t["lo"], r["hi"]
            if out:
                yield _batch(out, schema)
        if so_far is not None:
            yield _batch([close()], schema)

    ddl = f"conv_id long, {COUNTS}"
    done = blocks.where("whole").mapInArrow(tidy("repair", whole), ddl)
    cut = blocks.where("not whole").repartition("conv_id").sortWithinPartitions("conv_id", "turn", "role", "digest")
    return done.unionByName(cut.mapInArrow(tidy("repair", several), ddl))


class _Applied:
    """The edits of an audit, applied to the rows of its conversation one after another."""

    def __init__(self, audit: str):
        self.audit, self.at, self.state = audit, 0, 0

    def _take(self, letter: str, role: str | None, text: str) -> tuple[str, str, str]:
        role = NEXT[self.state] if role is None else role
        self.state = STEP[self.state, role[0]]
        return letter, role, text

    def inserted(self) -> Iterator[tuple[str, str, str]]:
        while self.audit[self.at : self.at + 1] == "I":
            self.at += 1
            yield self._take("I", None, "")

    def row(self, role: str, text: str) -> Iterator[tuple[str, str, str]]:
        """(letter, role, text) of the turns that go before a row and of the row, if it stays."""
        yield from self.inserted()
        letter = self.audit[self.at]
        self.at += 1
        if letter != "D":
            yield self._take(letter, role if letter == "K" else None, text)


def _applied(rows: DataFrame, counts: DataFrame, run, ddl: str) -> DataFrame:
    """``run`` over each conversation's counts, then its rows in order: (conversation, counts or None, role, text, copies)."""
    names = [c.split()[0] for c in COUNTS.split(", ")]
    heads = counts.select("conv_id", F.lit(0).alias("tag"), F.lit(None).cast("long").alias("turn"), F.lit("").alias("role"), F.lit("").alias("digest"), F.lit("").alias("text"), F.lit(0).cast("long").alias("copies"), *names)
    texts = rows.where("copies > 0").select("conv_id", F.lit(1).alias("tag"), "turn", "role", F.md5("text").alias("digest"), "text", "copies", *(F.lit(None).cast(t).alias(n) for n, t in (c.split() for c in COUNTS.split(", "))))
    both = heads.unionByName(texts).repartition("conv_id").sortWithinPartitions("conv_id", "tag", "turn", "role", "digest")
    return both.select("conv_id", "tag", "turn", "role", "text", "copies", *names).mapInArrow(tidy("repair", run), ddl)


def _counts(rows: DataFrame, block_rows: int) -> DataFrame:
    blocks = saved(_weighed(_light(rows), block_rows), WEIGHED, "repair-blocks")
    return _put_together(blocks)


def reports(rows: DataFrame, block_rows: int = BLOCK) -> DataFrame:
    """conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit and repaired_sha256 of each conversation of ``damaged`` rows."""
    ship(rows.sparkSession)
    counts = _counts(rows, block_rows)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema, head, applied, hashed, some = _schema(RESULT), None, None, None, False

        def feed(turns) -> None:
            nonlocal some
            for _, role, text in turns:
                hashed.update((("\n" if some else "") + f"{role}:{text}").encode("utf-8", "surrogatepass"))
                some = True

        def close() -> tuple:
            feed(applied.inserted())
            return (*head, hashed.hexdigest())

        for b in batches:
            out = []
            for conv, tag, _, role, text, copies, *more in zip(*(c.to_pylist() for c in b.columns), strict=True):
                if not tag:
                    if head is not None:
                        out.append(close())
                    head, applied, hashed, some = (conv, *more), _Applied(more[-1]), hashlib.sha256(), False
                else:
                    for _ in range(copies):
                        feed(applied.row(role, text))
            if out:
                yield _batch(out, schema)
        if head is not None:
            yield _batch([close()], schema)

    return _applied(rows, counts, run, RESULT)


def repaired(rows: DataFrame, block_rows: int = BLOCK) -> DataFrame:
    """conv_id, position (from 0), role, text and edit (K, R or I) of every turn of the repaired conversations."""
    ship(rows.sparkSession)
    ddl = "conv_id long, position long, role string, text string, edit string"
    counts = _counts(rows, block_rows)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema, conv, applied, n = _schema(ddl), None, None, 0
        for b in batches:
            out = []

            def put(turns) -> None:
                nonlocal n
                for letter, role, text in turns:
                    out.append((conv, n, role, text, letter))  # noqa: B023
                    n += 1

            for c, tag, _, role, text, copies, *more in zip(*(x.to_pylist() for x in b.columns), strict=True):
                if not tag:
                    if applied is not None:
                        put(applied.inserted())
                    conv, applied, n = c, _Applied(more[-1]), 0
                else:
                    for _ in range(copies):
                        put(applied.row(role, text))
            if out:
                yield _batch(out, schema)
        if applied is not None:
            out = []
            put = [(conv, n + k, role, text, letter) for k, (letter, role, text) in enumerate(applied.inserted())]
            if put:
                yield _batch(put, schema)

    return _applied(rows, counts, run, ddl)


#: crc32 of a short ASCII string ``k``, bit by bit, in DuckDB.
CRC32_SQL = """xor(list_reduce([4294967295::BIGINT] || list_transform(generate_series(1, length(k)), lambda i: ascii(substr(k, i::INT, 1))::BIGINT),
    lambda c, b: list_reduce([xor(c, b)] || [0::BIGINT, 1, 2, 3, 4, 5, 6, 7], lambda x, j: xor(x >> 1, CASE WHEN x & 1 = 1 THEN 3988292384 ELSE 0 END))), 4294967295::BIGINT)"""

#: The same repair as a recursion over rows that keeps the least cost and audit of each grammar state.
ORACLE = f"""
WITH RECURSIVE keyed AS (
  SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text,
         coalesce(CAST(conv_id AS VARCHAR), ' ') || ':' || coalesce(CAST(turn AS VARCHAR), ' ') AS k FROM conversations
), harmed AS (SELECT *, {CRC32_SQL} % 20 AS h FROM keyed), left_over AS (
  SELECT conv_id, turn, CASE WHEN h = 4 THEN 'user' ELSE role END AS role,
         CASE h WHEN 1 THEN '' WHEN 2 THEN translate(text, '.!?', '') ELSE text END AS text
  FROM harmed, (VALUES (1), (2)) AS v(copy) WHERE h <> 0 AND (copy = 1 OR h = 3)
), placed AS (
  SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, md5(text)) AS i,
         rtrim(text, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)) AS t FROM left_over
), judged AS (
  SELECT conv_id, turn, role, text, i, CASE WHEN t = '' THEN 'b' WHEN row_number() OVER (PARTITION BY conv_id, role, text ORDER BY i) > 1 THEN 'd' WHEN right(t, 1) NOT IN ('.', '!', '?') THEN 't' ELSE '' END AS fault,
         substr(lag(role) OVER (PARTITION BY conv_id ORDER BY i), 1, 1) || substr(role, 1, 1) AS pair FROM placed
), counts AS (
  SELECT conv_id, count(*) AS n, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (fault = 'b') AS blank,
         count(*) FILTER (fault = 'd') AS duplicate, count(*) FILTER (fault = 't') AS truncated, count(*) FILTER (pair NOT IN ('su', 'ua', 'au')) AS illegal
  FROM judged GROUP BY conv_id
), convs AS (SELECT DISTINCT c.conv_id, coalesce(n, 0) AS n FROM conversations c LEFT JOIN counts k ON c.conv_id IS NOT DISTINCT FROM k.conv_id),
gap(p, q, letters, cost, turns) AS (
  VALUES (0, 0, '', 0, []), (1, 1, '', 0, []), (2, 2, '', 0, []), (3, 3, '', 0, []), (0, 2, 'I', 3, ['user:']), (1, 2, 'I', 3, ['user:']),
         (2, 3, 'I', 3, ['assistant:']), (3, 2, 'I', 3, ['user:']), (0, 3, 'II', 6, ['user:', 'assistant:']), (1, 3, 'II', 6, ['user:', 'assistant:'])
), leads(p, x, q) AS (VALUES (0, '', 0), (1, '', 1), (2, '', 2), (3, '', 3), (0, 's', 1), (0, 'u', 2), (1, 'u', 2), (2, 'a', 3), (3, 'u', 2)),
edits AS (
  SELECT conv_id, i, 'D' AS letter, 4 AS cost, '' AS x, [] AS turns FROM judged
  UNION ALL SELECT conv_id, i, 'K', CASE WHEN fault = 't' THEN 3 ELSE 0 END, substr(role, 1, 1), [role || ':' || text] FROM judged WHERE fault NOT IN ('b', 'd') AND role <> ''
  UNION ALL SELECT conv_id, i, 'R', CASE WHEN fault = 't' THEN 6 ELSE 3 END, substr(r, 1, 1), [r || ':' || text] FROM judged, (VALUES ('user'), ('assistant')) AS v(r) WHERE fault NOT IN ('b', 'd')
), walk AS (
  SELECT conv_id, 0::BIGINT AS i, 0 AS q, lpad('0', 12, '0') AS w, []::VARCHAR[] AS turns FROM convs
  UNION ALL
  SELECT conv_id, i, q, min(w), arg_min(turns, w) FROM (
    SELECT e.conv_id, e.i, l.q, lpad(CAST(CAST(left(s.w, 12) AS BIGINT) + g.cost + e.cost AS VARCHAR), 12, '0') || substr(s.w, 13) || g.letters || e.letter AS w,
           s.turns || g.turns || e.turns AS turns
    FROM walk s JOIN gap g ON g.p = s.q JOIN edits e ON e.conv_id IS NOT DISTINCT FROM s.conv_id AND e.i = s.i + 1 JOIN leads l ON l.p = g.q AND l.x = e.x
  ) GROUP BY conv_id, i, q
), ends AS (
  SELECT conv_id, min(w) AS w, arg_min(turns, w) AS turns FROM (
    SELECT s.conv_id, lpad(CAST(CAST(left(s.w, 12) AS BIGINT) + g.cost AS VARCHAR), 12, '0') || substr(s.w, 13) || g.letters AS w, s.turns || g.turns AS turns
    FROM walk s JOIN convs c ON c.conv_id IS NOT DISTINCT FROM s.conv_id AND c.n = s.i JOIN gap g ON g.p = s.q WHERE g.q IN (0, 3)
  ) GROUP BY conv_id
)
SELECT e.conv_id, coalesce(gaps, 0) AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate, coalesce(truncated, 0) AS truncated, coalesce(illegal, 0) AS illegal,
       CAST(left(w, 12) AS BIGINT) AS cost, substr(w, 13) AS audit, sha256(array_to_string(turns, chr(10))) AS repaired_sha256
FROM ends e LEFT JOIN counts k ON e.conv_id IS NOT DISTINCT FROM k.conv_id
"""
