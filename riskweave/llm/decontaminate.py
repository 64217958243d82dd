"""Benchmark decontamination by template windows and slot consistency (operator 2).

Words become template tokens: numbers, names (capitalised words that do not start a sentence) and units
(after a number) are replaced by typed placeholders, everything else is lower-cased and stripped of outer
punctuation. Every window of WINDOW tokens with at least two literal ones is hashed; one with fewer, numbers
alone among them, is hashed with its exact values, so a copy of it is found but no variant. An item of fewer
tokens is one window of its own width, and documents give windows of each such width that the benchmark has.
The first word of an item counts as opening a sentence and, in a second hash, as what it is within one. The
benchmark's windows set bits in a bitmap of fixed size; documents give up only the windows whose bit is set, with the
values of their slots, and an exact join on the hash follows, so nothing of either side is broadcast but
the bitmap.

An item whose names have another number of words than the copy's is found by a second, folded form of both: a run
of names is one placeholder with the whole run as its value. An item has this form if it holds names and at least
WINDOW folded windows with two literal tokens, which are all that count for it; shorter items stay with one placeholder a
word, as their folded form would fit too much. Folded windows without a run of two or more names are the plain
ones, so documents hash the others only.

Windows of a document and an item that lie at the same distance belong to one alignment. Its slots are
consistent if every value of the item's slots stands for one value in the document: then the passage is the
item, perhaps with other numbers and names. An item leaks into a document if consistent alignments cover at
least ``percent`` of its windows with two literal tokens, its first word as at a sentence's start; or else of all its
windows, or of all with two literal tokens, its first word in either form.

Defined results: a null or empty text has no windows and is clean; an item without text matches nothing;
equal rows are judged each; a null doc_id is a document like others; a null item_id never matches; without rows
there are none, and without items all documents are clean; very long texts are taken whole; other columns are not read.
"""

from __future__ import annotations

import hashlib
import re
from array import array
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from riskweave.session import ship

from .common import kept, mix64, tidy, unused
from .graph import saved

WINDOW, PERCENT, BITS = 5, 80, 1 << 24
#: Documents to drop, up to which their keys are broadcast; beyond, a shuffle join does it.
BROADCAST_IDS = 2_000_000
UNITS = frozenset("mm cm m km mi ft in inch inches feet yard yards mile miles mg g kg t lb lbs oz ton tons ml cl l liter liters litre litres s sec secs second seconds min mins minute minutes h hr hrs hour hours day days week weeks month months year years hz khz mhz ghz w kw kwh mw v a j kj cal kcal pa kpa bar k c f km/h mph m/s % percent usd eur gbp dollar dollars cent cents euro euros pound pounds kb mb gb tb meter meters metre metres gram grams degree degrees °c °f °".split())
NUMBER = re.compile(r"[+-]?[$€£]?\d[\d.,:/]*")
GLUED = re.compile(r"([+-]?[$€£]?\d[\d.,]*)([^\W\d_%°].*|[%°].*)")
EDGE = ".,;:!?\"'()[]{}<>«»“”‘’…¡¿*#&|~`_"
LITERAL, NUM, NAME, UNIT = range(4)
_BASE = np.uint64(0x9E3779B97F4A7C15)


def _hash(s: str) -> int:
    return int.from_bytes(hashlib.blake2b(s.encode("utf-8", "surrogatepass"), digest_size=8).digest(), "little")


def parse(word: str) -> tuple[list[tuple[int, int, str]], bool]:
    """Tokens (kind, hash, value) of a raw word, NAME and UNIT as far as the word tells; and whether a sentence may end after it."""
    ends = word.rstrip("\"')]}»”’*#&|").endswith((".", "!", "?", ":"))
    core = word.strip(EDGE) if not NUMBER.fullmatch(word) else word.rstrip(".,:")
    if not core:
        return [], ends
    if NUMBER.fullmatch(core):
        return [(NUM, _hash(core.rstrip(".,:")), core.rstrip(".,:"))], ends
    low = core.lower()
    if (m := GLUED.fullmatch(core)) and m[2].lower() in UNITS:
        return [(NUM, _hash(m[1]), m[1]), (UNIT, _hash(m[2].lower()), m[2].lower())], ends
    if low in UNITS:
        return [(UNIT, _hash(low), low)], ends
    return [(NAME if core[0].isupper() and not core.isupper() else LITERAL, _hash(low), low)], ends


class _Words(dict):
    """Word to its number, parsed when first met."""

    def __init__(self, learn):
        super().__init__()
        self.learn = learn

    def __missing__(self, word: str) -> int:
        n = self[word] = len(self)
        self.learn(word)
        return n


class Templates:
    """Turns texts into template tokens; remembers words, up to a bound."""

    def __init__(self, remember: int = 250_000):
        self.limit = remember
        self._clear()

    def _clear(self) -> None:
        self.number = _Words(self._learn)
        # of tokens: kind, hash, value; of words: first token, number of tokens, whether a sentence may end
        self.kind, self.hash, self.value = array("b"), array("Q"), []
        self.first, self.size, self.ends = array("q"), array("q"), array("b")

    def _learn(self, w: str) -> None:
        tokens, ends = parse(w)
        self.first.append(len(self.kind))
        self.size.append(len(tokens))
        self.ends.append(ends)
        for k, h, v in tokens:
            self.kind.append(k)
            self.hash.append(h)
            self.value.append(v)

    def tokens(self, texts: list[str]) -> tuple[np.ndarray, ...]:
        """Of all texts' tokens: kind, literal hash, index of the value, and the text's number."""
        if len(self.number) > self.limit:
            self._clear()
        cut = [t.replace("\n", ".\n").split() for t in texts]  # a sentence may end with a line
        k = np.fromiter(map(self.number.__getitem__, chain.from_iterable(cut)), np.int64)
        owner = np.repeat(np.arange(len(texts)), np.fromiter(map(len, cut), np.int64, len(cut)))
        if not len(k):
            return np.empty(0, np.int8), np.empty(0, np.uint64), k, owner
        first, size, ends = (np.frombuffer(x, t) for x, t in ((self.first, np.int64), (self.size, np.int64), (self.ends, bool)))
        kinds, hashes = np.frombuffer(self.kind, np.int8), np.frombuffer(self.hash, np.uint64)
        opens = np.ones(len(k), bool)
        opens[1:] = ends[k[:-1]] | (owner[1:] != owner[:-1])
        n = size[k]
        stop = np.cumsum(n)
        at = np.arange(stop[-1]) + np.repeat(first[k] - stop + n, n)
        if not len(at):
            return np.empty(0, np.int8), np.empty(0, np.uint64), at, owner[:0]
        kind, h, who = kinds[at], hashes[at], np.repeat(owner, n)
        kind[(kind == NAME) & np.repeat(opens, n)] = LITERAL
        after = np.zeros(len(kind), bool)
        after[1:] = (kind[:-1] == NUM) & (who[1:] == who[:-1])
        kind[(kind == UNIT) & ~after] = LITERAL
        return kind, h, at, who

    def windows(self, tokens: tuple[np.ndarray, ...], n_texts: int, widths: list[int] | None = None) -> tuple[np.ndarray, ...]:
        """Of all windows of ``tokens``: hash, first token, its text, its length, whether it takes exact values for want of
        two literal tokens (by the item's own form, and in this hash), and whether its first token counts as within a sentence; the tokens, their kinds so, and where texts begin.

        Windows of ``widths``; None stands for an item's: WINDOW, or the whole of a shorter text, the first also as within a sentence.
        """
        kind, h, at, who = tokens
        size = np.bincount(who, minlength=n_texts) if len(who) else np.zeros(n_texts, np.int64)
        begin = np.cumsum(size) - size
        inner, first = kind.copy(), begin[size > 0]
        if len(first):
            inner[first] = np.frombuffer(self.kind, np.int8)[at[first]]
        turned = np.zeros(len(kind), bool)
        turned[first] = inner[first] != kind[first]
        own, out = widths is None, []
        for width in range(1, WINDOW + 1) if own else widths:
            n = len(kind) - width + 1
            if n < 1:
                continue
            fit = who[:n] == who[width - 1 :]
            if own and width < WINDOW:
                fit &= size[who[:n]] == width
            few = self._few(kind, width)
            for kinds, use, alone in ((kind, fit, False), (inner, fit & turned[:n], True)):
                if not alone or own and use.any():
                    win, p = self._hashed(kinds, h, width, use)
                    out.append((win, p, np.full(len(p), width), few[p], self._few(kinds, width)[p], np.full(len(p), alone)))
        if not out:
            z = np.empty(0, np.int64)
            return np.empty(0, np.uint64), z, z, z, z.astype(bool), z.astype(bool), z.astype(bool), kind, inner, at, begin
        win, p, width_, exact, bare, within = (np.concatenate(x) for x in zip(*out, strict=True))
        return win, p, who[p], width_, exact, bare, within, kind, inner, at, begin

    def _few(self, kind: np.ndarray, width: int) -> np.ndarray:
        """Whether the windows have too few literal tokens."""
        literal = np.concatenate([[0], np.cumsum(kind == LITERAL)])
        return literal[width:] - literal[:-width] < min(2, width)

    def _hashed(self, kind: np.ndarray, h: np.ndarray, width: int, use: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Hash and first token of the windows in ``use``."""
        n, few = len(use), self._few(kind, width)
        p = np.flatnonzero(use)
        with np.errstate(over="ignore"):
            code = np.where(kind == LITERAL, h, kind.astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93))
            w = code[:n].copy()
            for j in range(1, width):
                w = mix64(w * _BASE + code[j : j + n])
            win = mix64(w[p] + np.uint64(width))
            exact = np.flatnonzero(few[p])
            e = p[exact]
            w = h[e]
            for j in range(1, width):
                w = mix64(w * _BASE + h[e + j])
            win[exact] = mix64(w + np.uint64(width + 2 * WINDOW))
        return win, p

    def folded(self, tokens: tuple[np.ndarray, ...], n_texts: int, runs_only: bool) -> tuple[np.ndarray, ...]:
        """Of the windows of WINDOW folded tokens with two literal ones (``runs_only``: and a run of names): hash, first
        token, text, place in the folded text; then each token's folded place, where it is one by itself, and where folded tokens start.
        """
        kind, h, _, who = tokens
        more = np.zeros(len(kind) + 1, bool)  # whether a token goes on with the run of names before it
        more[1:-1] = (kind[1:] == NAME) & (kind[:-1] == NAME) & (who[1:] == who[:-1])
        start = np.flatnonzero(~more)  # and the end of all
        k, o = kind[start[:-1]], who[start[:-1]]
        size = np.bincount(o, minlength=n_texts) if len(o) else np.zeros(n_texts, np.int64)
        place = np.arange(len(k)) - (np.cumsum(size) - size)[o]
        n = len(k) - WINDOW + 1
        if n < 1:
            z = np.empty(0, np.int64)
            return z.astype(np.uint64), z, z, z, np.full(len(kind), -1), start
        use = (o[:n] == o[WINDOW - 1 :]) & ~self._few(k, WINDOW)
        if runs_only:
            use &= start[WINDOW:] - start[:n] > WINDOW
        win, q = self._hashed(k, h[start[:-1]], WINDOW, use)
        alone = np.full(len(kind), -1)
        alone[start[:-1]] = place
        runs = np.cumsum(more)
        cut = np.ones(len(kind), bool)  # windows that hold a part of a run of two or more names
        m = len(kind) - WINDOW + 1
        cut[:m] = runs[WINDOW:] - np.concatenate([[0], runs[: m - 1]]) > 0
        alone[cut] = -1
        return win, start[q], o[q], place[q], alone, start

    def slots(self, kind: np.ndarray, at: np.ndarray, p: int, width: int) -> list[str]:
        """Typed values of a window's placeholders, in order."""
        return [f"{kind[i]}{self.value[at[i]]}" for i in range(p, p + width) if kind[i] != LITERAL]

    def folded_slots(self, kind: np.ndarray, at: np.ndarray, start: np.ndarray, p: int) -> list[str]:
        """The same for a folded window from token ``p`` on."""
        first = int(np.searchsorted(start, p))
        ends = start[first : first + WINDOW + 1].tolist()
        return [f"{kind[i]}{' '.join(self.value[j] for j in at[i:end])}" for i, end in zip(ends, ends[1:], strict=False) if kind[i] != LITERAL]


def _templates() -> Templates:
    return kept("decontaminate", "templates", Templates)


HITS = "array<struct<win:long,at:long,folded_at:long,exact:boolean,within:boolean,slots:array<string>>>"


def _marked(bits: np.ndarray, win: np.ndarray) -> np.ndarray:
    """Whether the windows' bits are set."""
    k = (win & np.uint64(BITS - 1)).astype(np.int64)
    return (bits[k >> 3] >> (k & 7).astype(np.uint8) & 1) == 1


def _windows(rows: DataFrame, key: str, bitmap=None, widths: list[int] | None = None) -> DataFrame:
    """key, text_key, n_windows, n_plain (with two literal tokens), n_folded, width and the windows (an item's, or those of ``widths`` whose bit is set) of each row, in ``hits``; ``row`` tells rows apart.

    A window has its place in the text (``at``), in the folded text (``folded_at``), or in both where no run of names is in it; an item's has one of them.
    """
    kind = pa.list_(pa.struct([("win", pa.int64()), ("at", pa.int64()), ("folded_at", pa.int64()), ("exact", pa.bool_()), ("within", pa.bool_()), ("slots", pa.list_(pa.string()))]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        row, t = TaskContext.get().partitionId() << 40, _templates()
        bits = None if bitmap is None else np.frombuffer(bitmap.value, np.uint8)
        for b in batches:
            for start in range(0, b.num_rows, 500):
                part = b.slice(start, 500)
                texts = [x or "" for x in part.column("text").to_pylist()]
                tokens = t.tokens(texts)
                win, p, who, width, exact, bare, within, kinds, inner, at, begin = t.windows(tokens, len(texts), widths)
                f_win, f_p, f_who, f_at, alone, start = t.folded(tokens, len(texts), runs_only=bits is not None)
                n_folded = np.bincount(f_who, minlength=len(texts))
                n, plain = (np.bincount(who[x], minlength=len(texts)) for x in (~within, ~within & ~exact))
                widest = np.zeros(len(texts), np.int64)
                np.maximum.at(widest, who, width)
                if bits is None:
                    named = np.bincount(tokens[3][tokens[0] == NAME], minlength=len(texts)) if len(tokens[0]) else n_folded
                    n_folded = np.where((named > 0) & (n_folded >= WINDOW), n_folded, 0)
                    use = n_folded[f_who] > 0
                    f_win, f_p, f_who, f_at = (x[use] for x in (f_win, f_p, f_who, f_at))
                else:
                    win, p, who, width, exact, bare, within = (x[_marked(bits, win)] for x in (win, p, who, width, exact, bare, within))
                    f_win, f_p, f_who, f_at = (x[_marked(bits, f_win)] for x in (f_win, f_p, f_who, f_at))
                both = np.where((width == WINDOW) & ~exact & (bits is not None), alone[p], -1)
                hits: list[list] = [[] for _ in texts]
                for w, i, o, size, few, same, inside, f in zip(win.view(np.int64).tolist(), p.tolist(), who.tolist(), width.tolist(), exact.tolist(), bare.tolist(), within.tolist(), both.tolist(), strict=True):
                    hits[o].append({"win": w, "at": i - int(begin[o]), "folded_at": None if f < 0 else f, "exact": few, "within": inside, "slots": [] if same else t.slots(inner if inside else kinds, at, i, size)})
                for w, i, o, f in zip(f_win.view(np.int64).tolist(), f_p.tolist(), f_who.tolist(), f_at.tolist(), strict=True):
                    hits[o].append({"win": w, "at": None, "folded_at": f, "exact": False, "within": False, "slots": t.folded_slots(kinds, at, start, i)})
                yield pa.RecordBatch.from_arrays([pa.array(row + np.arange(len(texts))), part.column(key), part.column("text_key"), pa.array(n), pa.array(plain), pa.array(n_folded), pa.array(widest), pa.array(hits, kind)], names=["row", key, "text_key", "n_windows", "n_plain", "n_folded", "width", "hits"])
                row += len(texts)

    schema = f"row long, {key} long, text_key long, n_windows long, n_plain long, n_folded long, width long, hits {HITS}"
    rows = rows.select(F.col(key).cast("long").alias(key), "text", F.xxhash64("text").alias("text_key"))
    return saved(rows.mapInArrow(tidy("decontaminate", run), schema), schema, f"windows-{key}")


def leaks(docs: DataFrame, benchmark: DataFrame, percent: int = PERCENT) -> DataFrame:
    """doc_id, contaminated, n_items, item_id and coverage (best item, least id first), changed (a slot differs) and text_key of each row."""
    spark = docs.sparkSession
    ship(spark)
    items = _windows(benchmark.where("item_id is not null"), "item_id")
    # an item's two forms are weighed as two items
    folded, of = F.col("h.folded_at").isNotNull(), lambda c: F.when(F.col("h.folded_at").isNotNull(), F.col("n_folded")).otherwise(F.col(c)).alias(c)
    own = items.select("row", "item_id", "n_windows", "n_plain", "n_folded", F.explode("hits").alias("h")).select((F.col("row") * 2 + folded.cast("int")).alias("item"), "item_id", of("n_windows"), of("n_plain"), folded.alias("folded"), F.col("h.exact").alias("exact"), (F.col("h.exact") | F.col("h.within")).alias("extra"), F.col("h.win").alias("win"), F.coalesce("h.at", "h.folded_at").alias("item_at"), F.col("h.slots").alias("item_slots"))
    place = F.col("win").bitwiseAND(BITS - 1) + 1
    found = own.groupBy(F.call_function("bitmap_bucket_number", place).alias("b")).agg(F.call_function("bitmap_construct_agg", F.call_function("bitmap_bit_position", place)).alias("bits")).collect()
    bitmap = bytearray(BITS // 8)
    for r in found:  # BITS / 8 bytes whatever the benchmark's size
        bitmap[(r.b - 1) * 4096 : r.b * 4096] = r.bits
    widths = sorted({r.width for r in items.where("n_windows > 0").select("width").distinct().collect()})  # 1 to WINDOW
    rows = _windows(docs, "doc_id", spark.sparkContext.broadcast(bytes(bitmap)), widths)
    hits = rows.select("row", F.explode("hits").alias("h")).select("row", F.col("h.win").alias("win"), F.col("h.at").alias("at"), F.col("h.folded_at").alias("folded_at"), F.col("h.slots").alias("slots"))
    both = hits.join(own, "win").withColumn("distance", F.when(F.col("folded"), F.col("folded_at")).otherwise(F.col("at")) - F.col("item_at")).where("distance is not null")
    line = ["row", "item", "distance"]
    pairs = both.select(*line, "extra", F.explode_outer(F.arrays_zip("item_slots", "slots")).alias("s"))
    plain, some = ~F.col("extra"), F.col("s.item_slots").isNotNull()
    differs = lambda use: F.coalesce(F.max(F.when(use, F.col("s.item_slots") != F.col("s.slots"))), F.lit(False))
    even = lambda use: F.count_distinct(F.when(use & some, F.struct("s.item_slots", "s.slots"))) == F.count_distinct(F.when(use, F.col("s.item_slots")))
    lines = pairs.groupBy(*line).agg(even(plain).alias("even"), differs(plain).alias("differs"), even(F.lit(True)).alias("all_even"), differs(F.lit(True)).alias("all_differ")).where("even or all_even")
    share = lambda use, of: F.coalesce(F.count_distinct(F.when(use, F.col("item_at"))) / F.nullif(F.max(of), F.lit(0)), F.lit(0.0))
    every = F.col("all_even")
    cover = both.join(lines, line).groupBy("row", "item", "item_id").agg(share(F.col("even") & plain, "n_plain").alias("coverage"), F.coalesce(F.max(F.when(F.col("even") & plain, F.col("differs"))), F.lit(False)).alias("changed"), F.greatest(share(every, "n_windows"), share(every & ~F.col("exact"), "n_plain")).alias("wide"), F.coalesce(F.max(F.when(every, F.col("all_differ"))), F.lit(False)).alias("wide_changed"))
    # what the windows with literals show by themselves stands; all windows speak for the items that these miss
    enough = F.col("coverage") * 100 >= percent - 1e-9
    cover = cover.select("row", "item", "item_id", F.when(enough, F.col("coverage")).otherwise(F.col("wide")).alias("coverage"), F.when(enough, F.col("changed")).otherwise(F.col("wide_changed")).alias("changed")).where(enough)
    best = cover.groupBy("row").agg(F.count_distinct("item_id").alias("n_items"), F.max_by(F.struct("item_id", "coverage", "changed"), F.struct("coverage", -F.col("item_id"), ~F.col("changed"))).alias("best"))
    out = rows.select("row", "doc_id", "text_key").join(best, "row", "left")
    return out.select("doc_id", F.col("best").isNotNull().alias("contaminated"), F.coalesce("n_items", F.lit(0)).cast("long").alias("n_items"), F.col("best.item_id").alias("item_id"), F.round("best.coverage", 6).alias("coverage"), F.col("best.changed").alias("changed"), "text_key")


def drop_leaks(docs: DataFrame, benchmark: DataFrame, percent: int = PERCENT) -> DataFrame:
    """The rows of ``docs``, whole, into which no benchmark item leaks."""
    bad = saved(leaks(docs, benchmark, percent).where("contaminated").select("doc_id", "text_key").distinct(), "doc_id long, text_key long", "leaks")
    own_id, own_key = unused(docs, "id", "key")
    bad = bad.select(F.col("doc_id").alias(own_id), F.col("text_key").alias(own_key))
    bad = F.broadcast(bad) if bad.count() <= BROADCAST_IDS else bad
    return docs.join(bad, F.col("doc_id").cast("long").eqNullSafe(F.col(own_id)) & (F.xxhash64("text") == F.col(own_key)), "left_anti")
