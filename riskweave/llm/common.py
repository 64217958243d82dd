"""Helpers of the text operators: bytes, words, hashes and ordered shards."""

from __future__ import annotations

import ctypes
import hashlib
from collections.abc import Iterator
from math import isqrt

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

M1, M2 = np.uint64(0xFF51AFD7ED558CCD), np.uint64(0xC4CEB9FE1A85EC53)
S33 = np.uint64(33)


def mix64(x: np.ndarray) -> np.ndarray:
    """The 64-bit finaliser of MurmurHash3: a bijection that spreads every input bit."""
    with np.errstate(over="ignore"):
        x = x ^ (x >> S33)
        x = x * M1
        x = x ^ (x >> S33)
        x = x * M2
        return x ^ (x >> S33)


class WordHash(dict):
    """Word (bytes) to 64-bit hash, remembered; forgets all beyond ``limit`` words, so memory is bounded."""

    def __init__(self, limit: int = 200_000):
        super().__init__()
        self.limit = limit

    def __missing__(self, word: bytes) -> int:
        if len(self) >= self.limit:
            self.clear()
        h = self[word] = int.from_bytes(hashlib.blake2b(word, digest_size=8).digest(), "little")
        return h


_KEPT: dict[str, dict] = {}


def kept(operator: str, name: str, make):
    """What an operator keeps in a Python worker between tasks: made once, and dropped when another operator runs there."""
    if operator not in _KEPT:
        if _KEPT:
            _KEPT.clear()
            release()  # before the new operator fills the worker
        _KEPT[operator] = {}
    own = _KEPT[operator]
    if name not in own:
        own[name] = make()
    return own[name]


def release() -> None:
    """Gives memory that Arrow and the C library hold free back to the system."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):  # other C libraries have no such call
        pass


def tidy(operator: str, run):
    """``run`` for mapInArrow: drops what other operators keep in the worker first, and releases free memory at the end."""

    def wrapped(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept(operator, "", list)
        try:
            yield from run(batches)
        finally:
            release()

    return wrapped


def words(text: str | None) -> list[bytes]:
    """Lower-cases A-Z and takes the words ``[^\\x20\\x09-\\x0D]+`` as UTF-8; a null text has none."""
    return text.encode("utf-8", "surrogatepass").lower().split() if text else []


def shingles(tokens: list[bytes], n: int, hashes: WordHash) -> np.ndarray:
    """Sorted distinct 64-bit hashes of n-word shingles; of the whole sequence when it has fewer words."""
    if not tokens:
        return np.empty(0, np.uint64)
    n = min(n, len(tokens))
    h = np.fromiter(map(hashes.__getitem__, tokens), np.uint64, len(tokens))
    k = len(h) - n + 1
    with np.errstate(over="ignore"):
        out = h[:k].copy()
        for j in range(1, n):
            out = mix64(out * np.uint64(0x9E3779B97F4A7C15) + h[j : j + k])
    return np.unique(mix64(out + np.uint64(n)))


def texts(batches: Iterator[pa.RecordBatch], column: str = "text", rows: int = 2000) -> Iterator[tuple[pa.RecordBatch, list[str]]]:
    """Cuts batches to ``rows`` rows and gives each with its texts, null as empty."""
    for b in batches:
        for at in range(0, b.num_rows, rows):
            part = b.slice(at, rows)
            yield part, [t or "" for t in part.column(column).to_pylist()]


#: Ranges of ids at most; beyond, ranges grow. Bounds are numbers in the plan, found by two short searches a row.
MOST_RANGES = 1 << 14


def id_bounds(docs: DataFrame, parts: int) -> list[int]:
    """At most ``parts - 1`` ascending doc_ids that cut the rows into ranges of about equal numbers.

    Only the ids are read; the driver receives one number for each range, of ``MOST_RANGES`` at most.
    """
    parts = min(parts, MOST_RANGES)
    if parts < 2:
        return []
    at = ", ".join(f"{k / parts!r}d" for k in range(1, parts))
    got = docs.where(F.col("doc_id").isNotNull()).select(F.expr(f"percentile_approx(doc_id, array({at}), {20 * parts})")).first()[0]
    return sorted(set(got or []))


def range_of(bounds: list[int]):
    """Column: the number of bounds that are not above doc_id; a null doc_id comes first."""
    if not bounds:
        return F.lit(0)
    step = isqrt(len(bounds)) + 1
    groups = [bounds[k : k + step] for k in range(0, len(bounds), step)]
    listed = lambda xs: f"array({', '.join(f'cast({x} as long)' for x in xs)})"
    upto = lambda xs: f"size(filter({xs}, b -> b <= doc_id))"
    group = upto(listed([g[0] for g in groups]))
    within = upto(f"get(array({', '.join(map(listed, groups))}), {group} - 1)")
    return F.expr(f"case when doc_id is null or doc_id < {bounds[0]} then 0 else ({group} - 1) * {step} + {within} end")


def unused(df: DataFrame, *names: str) -> list[str]:
    """Column names like ``names`` that the table does not have in any case, for columns of our own beside a caller's."""
    have, out = {c.lower() for c in df.columns}, []
    for name in names:
        while name.lower() in have:
            name = f"_{name}"
        have.add(name.lower())
        out.append(name)
    return out


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
