"""Token counts by the whole-token shortcut (operator 6).

Which vocabulary strings encode alone as exactly one token is settled once, with the library itself.
A pre-token that is one of them counts 1 without any merge; only the other pre-tokens go through the
library's merges, each distinct one once in a while.

Text is cut where the tokenizer's own pre-tokenizer always cuts: before a space that leads a run of
non-spaces, and inside runs of white space as ``\\s+(?!\\S)|\\s+`` does. A special token's string, and the
four separators that Python and the library class differently as white space, send the whole text to
the library instead.

Defined results: a null or empty text has 0 bytes and 0 tokens; repeated rows are counted each; a null
doc_id stays null; other columns are not read.
"""

from __future__ import annotations

import os
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame

from riskweave.session import ship

from .common import kept, tidy

CHUNK = re.compile(r" ?\S+|\s+(?!\S)|\s+")
ODD = re.compile("[\x1c-\x1f᠎﻿]")
SCHEMA = "doc_id long, n_bytes long, n_tokens long, over_limit boolean"
#: Distinct pre-tokens that a worker remembers; beyond it forgets them.
REMEMBERED = 1_000_000


def load(path: str):
    """The library's tokenizer without truncation or padding, on one thread."""
    os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(path)
    tok.no_truncation()
    tok.no_padding()
    return tok


def encode_all(tok, strings: list[str]) -> list[list[int]]:
    run = getattr(tok, "encode_batch_fast", tok.encode_batch)
    return [e.ids for e in run(strings, add_special_tokens=False)]


def specials(tok) -> re.Pattern:
    """Matches a text that holds the string of a special or added token, or an odd separator."""
    own = [re.escape(t.content) for t in tok.get_added_tokens_decoder().values()]
    return re.compile("|".join([*own, ODD.pattern]))


def single_tokens(tok) -> set[str]:
    """The vocabulary strings that are one pre-token chunk and encode alone as one token."""
    ids = range(tok.get_vocab_size())
    strings = [tok.decode([i], skip_special_tokens=False) for i in ids]
    fit = [s for s in strings if "�" not in s and CHUNK.fullmatch(s)]
    return {s for s, e in zip(fit, encode_all(tok, fit), strict=True) if len(e) == 1}


def _state(path: str) -> tuple:
    def make() -> tuple:
        tok = load(path)
        single = single_tokens(tok)
        return tok, single, specials(tok), dict.fromkeys(single, 1)

    return kept("token_count", path, make)


def count(strings: list[str], path: str) -> list[int]:
    """Tokens of each text."""
    tok, single, odd, memo = _state(path)
    cut = [None if odd.search(s) else CHUNK.findall(s) for s in strings]
    new = list(set().union(*(c for c in cut if c)) - memo.keys())
    if len(memo) + len(new) > REMEMBERED:
        memo.clear()
        memo.update(dict.fromkeys(single, 1))
        new = list(set().union(*(c for c in cut if c)) - memo.keys())
    for at in range(0, len(new), 20_000):
        part = new[at : at + 20_000]
        memo.update(zip(part, map(len, encode_all(tok, part)), strict=True))
    return [len(encode_all(tok, [s])[0]) if c is None else sum(map(memo.__getitem__, c)) for s, c in zip(strings, cut, strict=True)]


def token_counts(docs: DataFrame, tokenizer_path: str, limit: int = 1024, rows: int = 1000) -> DataFrame:
    """doc_id, n_bytes, n_tokens and over_limit (n_tokens > limit) of each row of ``docs``."""
    ship(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for at in range(0, b.num_rows, rows):
                part = b.slice(at, rows)
                strings = [t or "" for t in part.column("text").to_pylist()]
                n = count(strings, tokenizer_path)
                size = [len(s.encode()) for s in strings]
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(size, pa.int64()), pa.array(n, pa.int64()), pa.array([x > limit for x in n])], names=["doc_id", "n_bytes", "n_tokens", "over_limit"])

    return docs.selectExpr("cast(doc_id as long) doc_id", "text").mapInArrow(tidy("token_count", run), SCHEMA)
