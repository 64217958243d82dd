"""Toxicity by a weighted lexicon (operator 5).

Folding lower-cases a text, maps accented letters, Cyrillic and Greek homoglyphs and digit or sign
substitutions to plain letters, and everything that is no letter to a space. The lexicon holds stems
(matched where a word begins) and whole words with weights; an Aho-Corasick automaton finds all of them in
one pass over the folded text. Exception phrases, two words with a lexicon word among them, take the
weight of a hit back. A text's score is a logistic function of its weighted hits, in total and normalised
by its length.

Lexicon, exceptions and the logistic function are learned from at most ``FIT_ROWS`` labelled rows outside
the held-out ones: counting runs on Spark, and the driver gets at most ``CANDIDATES`` rows of counts and the
hit totals of the sample. Every row is scored, on its whole text.

Defined results: a null or empty text has no hits; without usable labels every score is 0.5 and nothing
is predicted toxic; a null doc_id stays null.
"""

from __future__ import annotations

import unicodedata
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from riskweave.session import ship

from .common import tidy
from .learn import held_out, labelled_sample, logistic, sigmoid

#: Bound of the labelled rows to learn from, and so of the words that the driver may see.
FIT_ROWS = 12_000
#: Least likelihood-ratio statistic, over texts, of an entry; about a million candidates are tried. Nothing else ends the lexicon.
EVIDENCE = 30.0

_FOLD = {"0": "o", "1": "i", "3": "e", "4": "a", "5": "s", "7": "t", "8": "b", "@": "a", "$": "s", "ß": "ss", "ø": "o", "đ": "d", "ł": "l", "æ": "ae", "œ": "oe", "ı": "i"}
_FOLD |= dict(zip("абвгеёзіїјкмнопрстухцчѕԁԛԝ", ["a", "b", "b", "r", "e", "e", "3", "i", "i", "j", "k", "m", "h", "o", "n", "p", "c", "t", "y", "x", "u", "4", "s", "d", "q", "w"], strict=True))
_FOLD |= dict(zip("αβγεηικνορτυχω", "abyenikvoptuxw", strict=True))


class _Fold(dict):
    """Code point to folded string, worked out when first met; 0x110000 code points bound it."""

    def __missing__(self, c: int) -> str:
        s = chr(c).lower()
        base = unicodedata.normalize("NFKD", s)
        kept = "".join(x for x in base if not unicodedata.combining(x))
        out = "".join(_FOLD.get(x, x) for x in (_FOLD.get(s, kept)))
        out = "".join(x if x.isalpha() else "" if unicodedata.category(x) in ("Cf", "Mn") else " " for x in out) if out else ""
        self[c] = out
        return out


_TABLE = _Fold()


def fold(text: str) -> str:
    """Folded words between single spaces, with a space at each end; ``" "`` without words."""
    return f" {' '.join(text.translate(_TABLE).split())} " if text else " "


@dataclass
class Lexicon:
    """Folded entries (``" stem"`` or ``" word "``) with weights, exception phrases, and the logistic weights."""

    entries: dict[str, float]
    exceptions: frozenset[str]
    weights: tuple[float, ...]

    def automaton(self) -> ahocorasick.Automaton:
        a = ahocorasick.Automaton()
        for k, v in self.entries.items():
            a.add_word(k, (len(k), v))
        if self.entries:
            a.make_automaton()
        return a

    def hits(self, text: str, automaton: ahocorasick.Automaton) -> tuple[float, int, int]:
        """Sum of weights, number of hit words, number of words. Of several entries in one word, the heaviest counts."""
        folded = fold(text)
        best: dict[int, float] = {}
        if self.entries:
            for end, (size, v) in automaton.iter(folded):
                at = end - size + 1
                if v > best.get(at, 0.0):
                    best[at] = v
        total = n = 0
        for at, v in best.items():
            if self.exceptions and not self.exceptions.isdisjoint(phrases(folded, at)):
                continue
            total += v
            n += 1
        return total, n, folded.count(" ") - 1

    def score(self, x: np.ndarray) -> np.ndarray:
        return sigmoid(signals(x) @ np.array(self.weights[:-1]) + self.weights[-1]) if self.weights else np.full(len(x), 0.5)


def phrases(folded: str, at: int) -> tuple[str, str]:
    """The two-word phrases that end and begin with the word after the space at ``at``."""
    end = folded.index(" ", at + 1)
    before = folded.rfind(" ", 0, at)
    after = folded.find(" ", end + 1)
    return folded[max(before, 0) : end + 1], folded[at : after + 1] if after > 0 else folded[at : end + 1]


def signals(x: np.ndarray) -> np.ndarray:
    """Of (weights, hits, words): logs of the weighted hits in total and per thousand words, and whether there are any."""
    total, hits, words = x.T
    return np.column_stack([np.log1p(total), np.log1p(1000 * total / np.maximum(words, 1)), hits > 0, np.log1p(hits)])


def _candidates(folded: str) -> list[str]:
    out = []
    for w in folded.split():
        n = len(w)
        out += [f" {w} ", *(f" {w[:k]}" for k in range(4, min(n, 8)))]
    return out


def _tally(kind: str, lexicon: Lexicon | None = None):
    """Counts, for each batch, candidates (or phrases around hits) by label: occurrences and texts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        automaton = lexicon.automaton() if lexicon else None
        for b in batches:
            for at in range(0, b.num_rows, 500):
                part = b.slice(at, 500)
                tf, df = (Counter(), Counter()), (Counter(), Counter())
                for t, y in zip(part.column("text").to_pylist(), part.column("y").to_pylist(), strict=True):
                    folded = fold(t or "")
                    if kind == "words":
                        found = _candidates(folded)
                    else:
                        found = [p for e, (size, _) in automaton.iter(folded) for p in phrases(folded, e - size + 1)] if lexicon.entries else []
                    tf[y].update(found)
                    df[y].update(set(found))
                keys = list(tf[0].keys() | tf[1].keys())
                yield pa.RecordBatch.from_arrays([pa.array(keys, pa.string()), *(pa.array([c[k] for k in keys], pa.int64()) for c in (*tf, *df))], names=["key", "tf0", "tf1", "df0", "df1"])

    return run


_TALLY = "key string, tf0 long, tf1 long, df0 long, df1 long"


def _sums(sample: DataFrame, kind: str, lexicon: Lexicon | None = None) -> DataFrame:
    return sample.mapInArrow(tidy("toxicity", _tally(kind, lexicon)), _TALLY).groupBy("key").agg(*(F.sum(c).alias(c) for c in ("tf0", "tf1", "df0", "df1")))


def choose(rows: list, w0: float, w1: float) -> dict[str, float]:
    """Entries by evidence: most first, leaving out what a chosen one matches, and stems of a chosen one. Weight: log ratio of rates by occurrence."""
    out: dict[str, float] = {}
    begun: set[str] = set()  # all beginnings of chosen entries
    for r in rows:
        k = r["key"]
        if k in begun or any(k[:n] in out for n in range(1, len(k) + 1)):
            continue
        begun.update(k[:n] for n in range(1, len(k) + 1))
        ratio = ((r["tf1"] + 0.5) / (w1 + 1)) / ((r["tf0"] + 0.5) / (w0 + 1))
        out[k] = float(min(6.0, np.log(ratio)))
    return out


def learn(docs: DataFrame, labels: DataFrame, fit_rows: int = FIT_ROWS) -> Lexicon:
    """Learns the lexicon, its exceptions and the logistic function from a bounded labelled sample."""
    ship(docs.sparkSession)
    sample = labelled_sample(docs, labels, "toxic", fit_rows).persist()
    try:
        by = {r["y"]: (r["n"], float(r["w"] or 0)) for r in sample.groupBy("y").agg(F.count("*").alias("n"), F.sum(F.length("text") / 6).alias("w")).collect()}
        (n0, w0), (n1, w1) = by.get(0, (0, 0.0)), by.get(1, (0, 0.0))
        if not n0 or not n1:
            return Lexicon({}, frozenset(), ())
        a, b, g, h = (F.col(c).cast("double") for c in ("tf0", "tf1", "df0", "df1"))
        s0, s1 = (g + h) * n0 / (n0 + n1), (g + h) * n1 / (n0 + n1)
        safe = lambda x, e: F.when(x > 0, x * F.log(x / e)).otherwise(0.0)
        least = max(3, n1 // 200)
        rows = _sums(sample, "words").where((h >= least) & ((b + 0.5) / (w1 + 1) > 5 * (a + 0.5) / (w0 + 1)) & ((h / n1) > 3 * (g / n0))).withColumn("g2", 2 * (safe(g, s0) + safe(h, s1))).where(F.col("g2") >= EVIDENCE).orderBy(F.desc("g2"), F.length("key"), "key").collect()
        first = Lexicon(choose(rows, w0, w1), frozenset(), ())
        spare = _sums(sample, "phrases", first).where((g >= 3) & (g / n0 > 2 * (h + 0.5) / n1)).collect()
        lexicon = Lexicon(first.entries, frozenset(r["key"] for r in spare), ())

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            automaton = lexicon.automaton()
            for b in batches:
                x = [lexicon.hits(t or "", automaton) for t in b.column("text").to_pylist()]
                yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("y"), *(pa.array([r[k] for r in x], pa.float64()) for k in range(3))], names=["doc_id", "y", "total", "hits", "words"])

        got = sample.mapInArrow(tidy("toxicity", run), "doc_id long, y int, total double, hits double, words double").toPandas().sort_values("doc_id", kind="stable")
        weights = logistic(signals(got[["total", "hits", "words"]].to_numpy(float)), got["y"].to_numpy(float))
        return Lexicon(lexicon.entries, lexicon.exceptions, tuple(weights.tolist()))
    finally:
        sample.unpersist()


def toxicity_scores(docs: DataFrame, labels: DataFrame, threshold: float = 0.7, fit_rows: int = FIT_ROWS) -> DataFrame:
    """doc_id, held_out, score, predicted and hits of each row."""
    lexicon = learn(docs, labels, fit_rows)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        automaton = lexicon.automaton()
        for b in batches:
            for at in range(0, b.num_rows, 2000):
                part = b.slice(at, 2000)
                x = np.array([lexicon.hits(t or "", automaton) for t in part.column("text").to_pylist()], float).reshape(-1, 3)
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(lexicon.score(x)), pa.array(x[:, 1].astype(np.int64))], names=["doc_id", "score", "hits"])

    out = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(tidy("toxicity", run), "doc_id long, score double, hits long")
    return out.select("doc_id", held_out().alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"), "hits")
