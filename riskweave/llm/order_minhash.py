"""Document fingerprints by Order MinHash (operator 3).

A text's k-mers (K code points) are numbered by occurrence, so the multiset becomes a set, and hashed.
CIRCLES multiplications of the hash put them on as many circles of 40-bit numbers, and each circle gives
M / CIRCLES orders: the distance of a number from a start, going round, the starts dividing the circle
evenly. Starts of one circle look at different parts of it, so a text of more than a few k-mers has
orders that hardly share their least ones. An entry takes the L least k-mers of its order, puts them back
into the order of the text, and hashes that tuple. Two texts agree on an entry if both its k-mers and their
order agree, which follows edit distance where a plain MinHash follows content alone. The likeness of two
fingerprints is the share of entries that agree.

The document that follows in ascending doc_id is found without a global sort in one task: rows are dealt
to ranges of doc_id, and the first rows of each range are also dealt to the range before it.

Defined results: a null text counts as empty; a text shorter than K is one k-mer, an empty text has a
fingerprint of its own; a null doc_id comes before all others; rows of equal doc_id follow each other in
the order of their texts; a single document is its own next one; no rows give no rows.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from riskweave.session import ship

from .common import id_bounds, mix64, range_of, tidy

K, L, M, CIRCLES = 8, 2, 64, 16
RANGE_CHARS = 32 << 20
_PLACE = np.uint64(24)
_LOW = np.uint64((1 << 24) - 1)
_BASE = np.uint64(0x9E3779B97F4A7C15)
#: Odd factors, one for each circle.
_TURNS = mix64(np.arange(1, 65, dtype=np.uint64)) | np.uint64(1)
SCHEMA = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"


def kmer_hashes(text: str, k: int = K) -> np.ndarray:
    """Hash of each k-mer of code points; of the whole text when it is shorter. ``k`` is a power of two."""
    c = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), "<u4").astype(np.uint64)
    with np.errstate(over="ignore"):
        if len(c) < k:
            h = np.zeros(1, np.uint64)
            for x in c:
                h = h * _BASE + x + np.uint64(1)
            return mix64(h + np.uint64(len(c)))
        h, width, base = c, 1, _BASE
        while width < k:
            h, base, width = h[:-width] * base + h[width:], base * base, 2 * width
        return mix64(h)


def numbered(h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hashes of the occurrence-numbered k-mers, and their positions."""
    if len(h) < 1 << 24:
        s = np.sort((h >> _PLACE << _PLACE) | np.arange(len(h), dtype=np.uint64))
        value, place = s >> _PLACE, s & _LOW
    else:
        value = h >> _PLACE
        place = np.argsort(value, kind="stable").astype(np.uint64)
        value = value[place]
    first = np.ones(len(h), bool)
    first[1:] = value[1:] != value[:-1]
    turn = np.zeros(len(h), np.uint64)
    if not first.all():
        at = np.arange(len(h))
        turn = (at - np.maximum.accumulate(np.where(first, at, 0))).astype(np.uint64)
    with np.errstate(over="ignore"):
        return mix64(value + (turn + np.uint64(1)) * _BASE), place


def _least(v: np.ndarray, place: np.ndarray, starts: np.ndarray, l: int) -> tuple[np.ndarray, np.ndarray]:  # noqa: E741
    """Numbers and positions of the ``l`` k-mers (all, if there are fewer) that come first from each start, going round; equal numbers by position."""
    n, span = len(v), (1 << 40) // len(starts)
    if n > 48 * len(starts) and n < 1 << 24:
        # the first ones lie right behind the starts: about 12 a start are looked at
        near = np.flatnonzero(v % np.uint64(span) < np.uint64(span * 12 * len(starts) // n))
        s = np.sort(v[near] << _PLACE | place[near])
        first = np.searchsorted(s, starts << _PLACE)
        if (np.append(first[1:], len(s)) - first >= l).all():
            got = s[first[:, None] + np.arange(l)]
            return got >> _PLACE, got & _LOW
    order = np.lexsort((place, v))
    at = order[(np.searchsorted(v[order], starts)[:, None] + np.arange(min(l, n))) % n]
    return v[at], place[at]


def fingerprint(text: str, k: int = K, l: int = L, m: int = M, circles: int = CIRCLES) -> np.ndarray:  # noqa: E741
    """``m`` entries of 32 bits."""
    if not text:
        return np.zeros(m, np.uint32)
    value, place = numbered(kmer_hashes(text, k))
    each = m // circles
    starts = (np.arange(each, dtype=np.uint64) << np.uint64(40)) // np.uint64(each)
    with np.errstate(over="ignore"):
        got = [_least(value * turn >> _PLACE, place, starts, l) for turn in _TURNS[:circles]]
        v, at = (np.concatenate(x) for x in zip(*got, strict=True))
        picked = np.take_along_axis(v, np.argsort(at, axis=1, kind="stable"), axis=1)
        out = np.full(m, np.uint64(picked.shape[1]))
        for j in range(picked.shape[1]):
            out = mix64(out * _BASE + picked[:, j] + np.uint64(1))
    return (out >> np.uint64(32)).astype(np.uint32)


def likeness(a: np.ndarray, b: np.ndarray) -> float:
    """Share of equal entries, 0 to 1."""
    return float((a == b).mean())


def edit(text: str, following: str) -> str:
    """``text`` with its last floor(n / 4) code points replaced by the first as many (or all) of ``following``."""
    q = len(text) // 4
    return text[: len(text) - q] + following[:q]


def _hex(f: np.ndarray) -> str:
    return f.astype(">u4").tobytes().hex()


def _run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    out: list[tuple] = []
    held = place = None
    for b in batches:
        for at in range(0, b.num_rows, 500):
            part = b.slice(at, 500)
            for doc, text, where, tail in zip(*(part.column(c).to_pylist() for c in ("doc_id", "text", "_range", "_tail")), strict=True):
                if where != place:
                    held, place = None, where
                if tail and held is None:
                    continue
                text = text or ""
                mark = fingerprint(text)
                if held is not None:
                    d, t, f = held
                    edited = edit(t, text)
                    e = fingerprint(edited)
                    out.append((d, len(t), hashlib.sha256(edited.encode("utf-8", "surrogatepass")).hexdigest(), _hex(f), _hex(e), likeness(f, e), likeness(f, mark)))
                held = None if tail else (doc, text, mark)
            if out:
                kinds = (pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64())
                yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in out], t) for k, t in enumerate(kinds)], names=[x.split()[0] for x in SCHEMA.split(", ")])
                out = []


def fingerprints(docs: DataFrame, range_chars: int = RANGE_CHARS) -> DataFrame:
    """Fingerprints of each row's text and of the text edited with the next row's; see ``SCHEMA``."""
    ship(docs.sparkSession)
    docs = docs.selectExpr("cast(doc_id as long) doc_id", "text")
    size = docs.agg(F.sum(F.octet_length("text")).alias("bytes"), F.min("doc_id").alias("least"), F.max(F.col("doc_id").isNull()).alias("unknown")).first()
    bounds = id_bounds(docs, max(1, -(-(size.bytes or 0) // range_chars)))
    first = F.col("doc_id").isNull() if size.unknown else F.col("doc_id") == (size.least if size.least is not None else 0)
    own = range_of(bounds)
    tail = F.when(F.col("doc_id").isin(bounds), own - 1) if bounds else F.lit(None).cast("int")
    dealt = docs.select("doc_id", "text", F.explode(F.filter(F.array(F.struct(own.alias("_range"), F.lit(False).alias("_tail")), F.struct(tail.alias("_range"), F.lit(True).alias("_tail")), F.struct(F.when(F.coalesce(first, F.lit(False)), len(bounds)).alias("_range"), F.lit(True).alias("_tail"))), lambda r: r["_range"].isNotNull())).alias("r")).select("doc_id", "text", "r.*")
    dealt = dealt.where("_range >= 0").repartitionById(len(bounds) + 1, "_range").sortWithinPartitions("_range", "_tail", "doc_id", "text")
    return dealt.mapInArrow(tidy("order_minhash", _run), SCHEMA)
