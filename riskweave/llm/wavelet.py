"""Token shards as wavelet matrices (operator 9).

One file holds one shard: the documents' ids and lengths, and their token ids as a wavelet matrix, one
bit-plane for each bit of the vocabulary. A plane is stored as packed bits, deflated when that is
smaller, with the ones counted before each block of 4,096 positions. From one file, ``Shard`` gives
tokens by position, the count of an id in a range, the position of an id's k-th occurrence, and all
tokens.

File: ``RWWM1``, a little-endian header length, a JSON header, then the deflated document table and the
planes, at the offsets that the header names.

``write_shards`` cuts the documents by ranges of doc_id, so that file names sort as doc_ids do, and every
task writes its range as a row of files of bounded size, each through a temporary name and a rename: a
task that runs again writes the same bytes to the same names. ``read_shards`` reads the files with Spark's
binary-file source, so they can lie in any store that Spark and Arrow know.

Defined results: a null or empty text has only the end id; a null doc_id comes first and stays null;
rows with equal doc_id follow each other in the order of their texts; no rows give no files.
"""

from __future__ import annotations

import io
import json
import re
import struct
import zlib
from collections.abc import Callable, Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from riskweave.session import scratch, ship

from .common import id_bounds, kept, range_of, tidy
from .token_count import encode_all, load

MAGIC, BLOCK = b"RWWM1", 4096
#: Tokens after which a task closes a file; a document is never cut.
SHARD_TOKENS = 1 << 21
#: Characters of text that a range of doc_ids shall hold.
RANGE_CHARS = 32 << 20


# ------------------------------------------------------------------ the matrix


def build(tokens: np.ndarray, bits: int) -> tuple[list[np.ndarray], list[int]]:
    """Packed planes from the highest bit down, and the zeros of each."""
    planes, zeros = [], []
    a = tokens
    for b in range(bits - 1, -1, -1):
        one = (a & a.dtype.type(1 << b)) != 0
        planes.append(np.packbits(one))
        low, high = np.flatnonzero(~one), np.flatnonzero(one)  # taking positions is faster than masks
        zeros.append(len(low))
        a = np.concatenate([a[low], a[high]])
    return planes, zeros


def ones_before(plane: np.ndarray) -> np.ndarray:
    """Ones before each block; one entry more than there are blocks."""
    size = BLOCK // 8
    full = np.zeros(-(-len(plane) // size) * size, np.uint8)
    full[: len(plane)] = plane
    return np.concatenate([[0], np.cumsum(np.bitwise_count(full).reshape(-1, size).sum(axis=1, dtype=np.int64))])


def encode_shard(doc_ids: list[int | None], lengths: list[int], tokens: np.ndarray, bits: int) -> bytes:
    """The bytes of one file."""
    planes, zeros = build(tokens, bits)
    body, parts = io.BytesIO(), []

    def put(raw: bytes, level: int = 1) -> None:
        small = zlib.compress(raw, level) if level else raw
        best = small if len(small) < 0.95 * len(raw) else raw
        parts.append([body.tell(), len(best), int(best is not raw)])
        body.write(best)

    known = np.array([d is not None for d in doc_ids], np.uint8)
    put(np.array([d or 0 for d in doc_ids], "<i8").tobytes() + np.array(lengths, "<u4").tobytes() + known.tobytes(), 6)
    for p in planes:
        sample = p[: 1 << 12]
        put(p.tobytes(), int(len(zlib.compress(sample.tobytes(), 1)) < 0.85 * len(sample)))
        put(ones_before(p).astype("<u4").tobytes())
    head = json.dumps({"docs": len(doc_ids), "tokens": len(tokens), "bits": bits, "zeros": zeros, "parts": parts}).encode()
    return MAGIC + struct.pack("<I", len(head)) + head + body.getvalue()


class Shard:
    """Reads one file's bytes."""

    def __init__(self, raw: bytes):
        if raw[:5] != MAGIC:
            raise ValueError("not a token shard")
        (n,) = struct.unpack_from("<I", raw, 5)
        head = json.loads(raw[9 : 9 + n])
        self.raw, self.base, self.parts = raw, 9 + n, head["parts"]
        self.docs, self.tokens, self.bits, self.zeros = head["docs"], head["tokens"], head["bits"], head["zeros"]
        self._planes: dict[int, np.ndarray] = {}

    def _part(self, k: int) -> bytes:
        at, size, deflated = self.parts[k]
        raw = self.raw[self.base + at : self.base + at + size]
        return zlib.decompress(raw) if deflated else raw

    def plane(self, level: int) -> np.ndarray:
        if level not in self._planes:
            self._planes[level] = np.frombuffer(self._part(1 + 2 * level), np.uint8)
        return self._planes[level]

    def table(self) -> tuple[list[int | None], np.ndarray]:
        """The documents' ids and their numbers of tokens."""
        raw, n = self._part(0), self.docs
        ids, known = np.frombuffer(raw, "<i8", n).tolist(), np.frombuffer(raw, np.uint8, n, 12 * n).tolist()
        return [i if k else None for i, k in zip(ids, known, strict=True)], np.frombuffer(raw, "<u4", n, 8 * n).astype(np.int64)

    def rank(self, level: int, at: int) -> int:
        """Ones before position ``at`` of a plane."""
        before = np.frombuffer(self._part(2 + 2 * level), "<u4")
        block, p = at // BLOCK, self.plane(level)
        bits = np.unpackbits(p[block * BLOCK // 8 : -(-at // 8)])
        return int(before[block]) + int(bits[: at - block * BLOCK].sum())

    def select(self, level: int, bit: int, k: int) -> int:
        """Position of the k-th (from 0) ``bit`` of a plane."""
        before = np.frombuffer(self._part(2 + 2 * level), "<u4").astype(np.int64)
        if not bit:
            before = np.arange(len(before), dtype=np.int64) * BLOCK - before
        block = int(np.searchsorted(before, k, side="right")) - 1
        bits = np.unpackbits(self.plane(level)[block * BLOCK // 8 : (block + 1) * BLOCK // 8])
        return block * BLOCK + int(np.flatnonzero(bits == bit)[k - int(before[block])])

    def access(self, at: int) -> int:
        """The token at a position."""
        value = 0
        for level in range(self.bits):
            bit = int(self.plane(level)[at >> 3]) >> (7 - (at & 7)) & 1
            ones = self.rank(level, at)
            at = self.zeros[level] + ones if bit else at - ones
            value = value << 1 | bit
        return value

    def _range(self, token: int, start: int, stop: int) -> tuple[int, int]:
        for level in range(self.bits):
            a, b = self.rank(level, start), self.rank(level, stop)
            if token >> (self.bits - 1 - level) & 1:
                start, stop = self.zeros[level] + a, self.zeros[level] + b
            else:
                start, stop = start - a, stop - b
        return start, stop

    def ranks(self, level: int, at: np.ndarray) -> np.ndarray:
        """Ones before each of many positions of a plane."""
        p = self.plane(level)
        upto = np.concatenate([[0], np.cumsum(np.bitwise_count(p), dtype=np.int64)])
        byte = np.minimum(at >> 3, len(p) - 1)  # a position behind the last byte counts that whole
        part = np.bitwise_count(p[byte].astype(np.uint16) >> (8 - (at - (byte << 3))).astype(np.uint16))
        return upto[byte] + part

    def access_many(self, at: np.ndarray) -> np.ndarray:
        """The tokens at many positions."""
        value = np.zeros(len(at), np.int64)
        if not len(at):
            return value
        for level in range(self.bits):
            bit = self.plane(level)[at >> 3] >> (7 - (at & 7)).astype(np.uint8) & 1
            ones = self.ranks(level, at)
            at = np.where(bit, self.zeros[level] + ones, at - ones)
            value = value << 1 | bit
        return value

    def count_many(self, token: int, start: np.ndarray, stop: np.ndarray) -> np.ndarray:
        """Occurrences of a token in many ranges [start, stop)."""
        if not len(start) or not self.tokens:
            return np.zeros(len(start), np.int64)
        for level in range(self.bits):
            a, b = self.ranks(level, start), self.ranks(level, stop)
            high = token >> (self.bits - 1 - level) & 1
            start, stop = (self.zeros[level] + a, self.zeros[level] + b) if high else (start - a, stop - b)
        return stop - start

    def count(self, token: int, start: int = 0, stop: int | None = None) -> int:
        """Occurrences of a token in [start, stop)."""
        a, b = self._range(token, start, self.tokens if stop is None else stop)
        return b - a

    def locate(self, token: int, k: int) -> int:
        """Position of the k-th (from 0) occurrence of a token."""
        a, b = self._range(token, 0, self.tokens)
        if not 0 <= k < b - a:
            raise IndexError(k)
        at = a + k
        for level in range(self.bits - 1, -1, -1):
            bit = token >> (self.bits - 1 - level) & 1
            at = self.select(level, bit, at - self.zeros[level] if bit else at)
        return at

    def all(self) -> np.ndarray:
        """All tokens in order: the partitions undone from the lowest plane up."""
        kind = np.uint16 if self.bits <= 16 else np.uint32
        a = np.zeros(self.tokens, kind)
        for level in range(self.bits - 1, -1, -1):
            one = np.unpackbits(self.plane(level), count=self.tokens).view(bool)
            up = np.empty_like(a)
            up[np.flatnonzero(~one)] = a[: self.zeros[level]]
            up[np.flatnonzero(one)] = a[self.zeros[level] :] | kind(1 << (self.bits - 1 - level))
            a = up
        return a


# ------------------------------------------------------------------ tokens


class _Numbers(dict):
    """Numbers keys as they are first met and lists the new ones."""

    def __init__(self):
        super().__init__()
        self.new: list[str] = []

    def __missing__(self, key: str) -> int:
        n = self[key] = len(self)
        self.new.append(key)
        return n


def gather(ids: np.ndarray, start: np.ndarray, size: np.ndarray, k: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of the sequences that lie in ``ids``, those numbered ``k`` one after the other, and where each ends."""
    size = size[k]
    end = np.cumsum(size, dtype=np.int64)
    at = np.arange(end[-1] if len(end) else 0, dtype=np.int64)
    return ids[at + np.repeat(start[k] - end + size, size)], end


class _Pool:
    """Id sequences by number, gathered many at a time."""

    def __init__(self, kind: type):
        self.ids, self.start, self.size = np.empty(1 << 16, kind), np.empty(1 << 14, np.int64), np.empty(1 << 14, np.int32)
        self.used = self.n = 0

    def add(self, flat: np.ndarray, start: np.ndarray, size: np.ndarray) -> None:
        """Adds sequences that lie in ``flat`` at ``start``."""
        while self.used + len(flat) > len(self.ids):
            self.ids = np.concatenate([self.ids, self.ids])
        while self.n + len(size) > len(self.size):
            self.start, self.size = np.concatenate([self.start, self.start]), np.concatenate([self.size, self.size])
        at = slice(self.n, self.n + len(size))
        self.ids[self.used : self.used + len(flat)] = flat
        self.size[at] = size
        self.start[at] = self.used + start
        self.used += len(flat)
        self.n += len(size)

    def take(self, k: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The sequences ``k`` one after the other, and where each ends."""
        return gather(self.ids, self.start, self.size, k)


class Words:
    """Encodes texts with the library, each distinct piece of a word once in a while.

    The tokenizer lower-cases character by character, composes within words, and drops white space, so
    its ids of a text are those of its words in turn. Arrow lower-cases A-Z, but not where a mark could
    compose with them, and cuts words of Latin letters, without an apostrophe, where letters meet other
    characters, which the tokenizer also does; these pieces, and all other words, go to the library when
    they are new. Texts with a special token's string, in any case, or an odd separator go there whole.
    ``remember`` bounds the pieces: beyond the second number all are forgotten but those met in several
    batches, of which the first number stays at most.
    """

    LETTER = "A-Za-zªµºÀ-ÖØ-öø-\u017f"
    #: The dotted capital I is lower-cased to a letter and a mark, which joins what follows.
    NOT_PLAIN, BETWEEN = "['\u0130\u0180-\U0010ffff]", f"[^{LETTER}]+"
    COMPOSING = "[\u0300-\u036f]"
    #: One pre-token whatever is beside it, of which only the last token ends a word.
    ONE = re.compile("[a-zß-öø-ÿ]+")
    #: Stands between pieces that go to the library in one string, and is one token; texts that hold it go whole.
    MARK = "\x01"

    def __init__(self, path: str, remember: tuple[int, int] = (150_000, 400_000)):
        self.tok, (self.most_kept, self.most_pieces) = load(path), remember
        own = [re.escape(t.content) for t in self.tok.get_added_tokens_decoder().values()]
        self.special = "|".join([*own, f"[{self.MARK}\x1c\x1d\x1e\x1f\u180e\ufeff]"])
        (mark,) = encode_all(self.tok, [self.MARK])
        self.mark = mark[0] if len(mark) == 1 else None
        size = self.tok.get_vocab_size()
        self.kind = np.uint16 if size <= 1 << 16 else np.uint32
        suffix = getattr(self.tok.model, "end_of_word_suffix", None)
        self.ends = np.array([(self.tok.id_to_token(k) or "").endswith(suffix) for k in range(size)]) if suffix else None
        self.pieces, self.of_piece, self.met = _Numbers(), _Pool(self.kind), np.zeros(1 << 14, np.int32)

    def _flat(self, strings: list[str]) -> np.ndarray:
        return np.fromiter(chain.from_iterable(encode_all(self.tok, strings)), self.kind)

    def _ids(self, pieces: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """The ids of pieces one after the other, and the number of each one's ids."""
        if self.mark is None:
            ids = encode_all(self.tok, pieces)
            return np.fromiter(chain.from_iterable(ids), self.kind), np.fromiter(map(len, ids), np.int32, len(ids))
        flat = self._flat([f" {self.MARK} ".join([*pieces[at : at + 200], ""]) for at in range(0, len(pieces), 200)])
        marks = np.flatnonzero(flat == self.mark)
        return np.delete(flat, marks), np.diff(marks, prepend=-1).astype(np.int32) - 1

    def _ids_of_ones(self, pieces: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """The same of pieces that are one pre-token each: the tokens that end a word part them."""
        if self.ends is None or not pieces:
            return self._ids(pieces)
        flat = self._flat([" ".join(pieces[at : at + 200]) for at in range(0, len(pieces), 200)])
        last = np.flatnonzero(self.ends[flat])
        if len(last) != len(pieces):  # another tokenizer cuts them
            return self._ids(pieces)
        return flat, np.diff(last, prepend=-1).astype(np.int32)

    def _learn(self) -> None:
        fresh, self.pieces.new = self.pieces.new, []
        for at in range(0, len(fresh), 5_000):
            part = fresh[at : at + 5_000]
            one = np.array([self.ONE.fullmatch(p) is not None for p in part])
            ones, others = np.flatnonzero(one), np.flatnonzero(~one)
            flat, of_ones = self._ids_of_ones([part[k] for k in ones])
            rest, of_others = self._ids([part[k] for k in others])
            start, size = np.empty(len(part), np.int64), np.empty(len(part), np.int32)
            size[ones], size[others] = of_ones, of_others
            start[ones], start[others] = np.cumsum(of_ones) - of_ones, len(flat) + np.cumsum(of_others) - of_others
            self.of_piece.add(np.concatenate([flat, rest]), start, size)

    def _forget(self) -> None:
        met = self.met[: len(self.pieces)]
        keep = np.argsort(-met, kind="stable")[: self.most_kept]
        keep = keep[met[keep] > 1]
        names, old = list(self.pieces), self.of_piece
        self.pieces, self.of_piece = _Numbers(), _Pool(self.kind)
        self.pieces.update(zip((names[k] for k in keep.tolist()), range(len(keep)), strict=True))
        flat, end = old.take(keep)
        self.of_piece.add(flat, end - old.size[keep], old.size[keep])
        self.met[:] = 0

    def encode(self, texts: pa.Array | list[str]) -> list[np.ndarray]:
        """The ids of each text; null is empty. Arrow cuts the texts at white space and their distinct words into pieces."""
        if len(self.pieces) > self.most_pieces:
            self._forget()
        column = pc.fill_null(texts if isinstance(texts, pa.Array) else pa.array(texts, pa.string()), "")
        whole = pc.match_substring_regex(column, self.special, ignore_case=True)
        lower = pc.if_else(pc.match_substring_regex(column, self.COMPOSING), column, pc.ascii_lower(column))
        cut = pc.utf8_split_whitespace(pc.if_else(whole, "", lower))
        words = cut.flatten().dictionary_encode()
        distinct = words.dictionary
        apart = pc.replace_substring_regex(distinct, self.BETWEEN, r" \0 ")
        pieces = pc.utf8_split_whitespace(pc.if_else(pc.match_substring_regex(distinct, self.NOT_PLAIN), distinct, apart))
        coded = pieces.flatten().dictionary_encode()
        k = np.fromiter(map(self.pieces.__getitem__, coded.dictionary.to_numpy(zero_copy_only=False)), np.int64, len(coded.dictionary))
        self._learn()
        while len(self.met) < len(self.pieces):
            self.met = np.concatenate([self.met, np.zeros_like(self.met)])
        self.met[k] += 1
        flat, end = self.of_piece.take(k[coded.indices.to_numpy()])
        of_word = np.concatenate([[0], end])[pieces.offsets.to_numpy() - pieces.offsets[0].as_py()]
        flat, end = gather(flat, of_word[:-1], np.diff(of_word), words.indices.to_numpy())
        last = cut.offsets.to_numpy()[1:] - cut.offsets[0].as_py()
        parts = np.split(flat, np.concatenate([[0], end])[last][:-1]) if len(column) else []
        for at in np.flatnonzero(whole.to_numpy(zero_copy_only=False)).tolist():
            parts[at] = np.array(encode_all(self.tok, [column[at].as_py()])[0], self.kind)
        return parts


def encoder(path: str) -> Callable[[pa.Array | list[str]], list[np.ndarray]]:
    return kept("wavelet", path, lambda: Words(path)).encode


# ------------------------------------------------------------------ files


def put_file(path: str, raw: bytes) -> None:
    """Writes a file of a shared store whole: a task that is run twice leaves the same file."""
    from uuid import uuid4

    from pyarrow import fs

    store, at = fs.FileSystem.from_uri(path)
    store.create_dir(at.rpartition("/")[0], recursive=True)
    temp = f"{at.rpartition('/')[0]}/_{uuid4().hex}.tmp"
    with store.open_output_stream(temp) as out:
        out.write(raw)
    store.move(temp, at)


def write_shards(docs: DataFrame, out_dir: str, tokenizer_path: str, end_id: int = 1, shard_tokens: int = SHARD_TOKENS, range_chars: int = RANGE_CHARS) -> DataFrame:
    """Encodes the documents, appends ``end_id`` to each, and writes the shards below ``out_dir`` in ascending doc_id order.

    Returns the manifest, a row for each file: name, docs, tokens and start, the tokens of all files before it.
    """
    spark = docs.sparkSession
    ship(spark)
    docs = docs.selectExpr("cast(doc_id as long) doc_id", "text")
    chars = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    parts = max(1, -(-chars // range_chars))
    bounds = id_bounds(docs, parts)
    ranged = docs.withColumn("_range", range_of(bounds)).repartitionById(len(bounds) + 1, "_range").sortWithinPartitions("_range", "doc_id", "text")
    bits = max(1, (load(tokenizer_path).get_vocab_size() - 1).bit_length())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(tokenizer_path)
        ids: list[int | None] = []
        sizes: list[int] = []
        held: list[np.ndarray] = []
        rows: list[tuple[str, int, int]] = []
        place, number, total = None, 0, 0

        def flush() -> None:
            nonlocal number, total
            if ids:
                name = f"part-{place:06d}-{number:06d}.wm"
                put_file(f"{out_dir}/{name}", encode_shard(ids, sizes, np.concatenate(held), bits))
                rows.append((name, len(ids), total))
                number += 1
                for x in (ids, sizes, held):
                    x.clear()
                total = 0

        for b in batches:
            for at in range(0, b.num_rows, 250):
                part = b.slice(at, 250)
                for doc, where, tokens in zip(part.column("doc_id").to_pylist(), part.column("_range").to_pylist(), encode(part.column("text")), strict=True):
                    if where != place:
                        flush()
                        place, number = where, 0
                    ids.append(doc)
                    held.append(np.append(tokens, tokens.dtype.type(end_id)))
                    sizes.append(len(tokens) + 1)
                    total += len(tokens) + 1
                    if total >= shard_tokens:
                        flush()
        flush()
        yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], t) for k, t in enumerate((pa.string(), pa.int64(), pa.int64()))], names=["file", "docs", "tokens"])

    manifest = f"{out_dir}/manifest"
    ranged.mapInArrow(tidy("wavelet", run), "file string, docs long, tokens long").write.mode("overwrite").parquet(manifest)
    rows = spark.read.schema("file string, docs long, tokens long").parquet(manifest)
    # starts of ranges, of which there are MOST_RANGES at most, then of files within their range
    rows = rows.withColumn("place", F.substring("file", 6, 6))
    earlier = lambda w: F.coalesce(F.sum("tokens").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    ranges = rows.groupBy("place").agg(F.sum("tokens").alias("tokens")).select("place", earlier(Window.orderBy("place")).alias("begin"))
    return rows.join(F.broadcast(ranges), "place").withColumn("start", F.col("begin") + earlier(Window.partitionBy("place").orderBy("file"))).drop("place", "begin")


def read_shards(spark: SparkSession, out_dir: str) -> DataFrame:
    """A row for each file of ``out_dir``: file and its bytes."""
    return spark.read.format("binaryFile").option("pathGlobFilter", "*.wm").load(out_dir).select(F.regexp_extract("path", r"([^/]+)$", 1).alias("file"), "content")


def digests(spark: SparkSession, out_dir: str, manifest: DataFrame, end_id: int = 1) -> DataFrame:
    """Per document, from the files: doc_id, start, n_tokens and ids_crc32 (its ids as little-endian unsigned 32-bit integers);

    and by rank alone, without undoing the planes, first_id, its first token, and n_ends, how often it has ``end_id``.
    """
    schema = "file string, doc_id long, at long, n_tokens long, ids_crc32 long, first_id long, n_ends long"
    if not manifest.take(1):
        return spark.createDataFrame([], "doc_id long, start long, n_tokens long, ids_crc32 long, first_id long, n_ends long")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for name, raw in zip(b.column("file").to_pylist(), b.column("content"), strict=True):
                shard = Shard(raw.as_py())
                ids, sizes = shard.table()
                ends = np.cumsum(sizes)
                tokens = shard.all().astype("<u4")
                crc = [zlib.crc32(tokens[e - n : e]) for e, n in zip(ends.tolist(), sizes.tolist(), strict=True)]
                yield pa.RecordBatch.from_arrays([pa.array([name] * len(ids)), pa.array(ids, pa.int64()), pa.array(ends - sizes), pa.array(sizes), pa.array(crc, pa.int64()), pa.array(shard.access_many(ends - sizes)), pa.array(shard.count_many(end_id, ends - sizes, ends))], names=["file", "doc_id", "at", "n_tokens", "ids_crc32", "first_id", "n_ends"])

    docs = read_shards(spark, out_dir).mapInArrow(tidy("wavelet", run), schema)
    return docs.join(manifest.select("file", F.col("start").alias("before")), "file").select("doc_id", (F.col("before") + F.col("at")).alias("start"), "n_tokens", "ids_crc32", "first_id", "n_ends")


def token_shards(docs: DataFrame, tokenizer_path: str, out_dir: str | None = None, end_id: int = 1) -> DataFrame:
    """Writes the shards, reads them back, and returns the digest of each document."""
    spark = docs.sparkSession
    out_dir = out_dir or scratch(spark, "shards")
    return digests(spark, out_dir, write_shards(docs, out_dir, tokenizer_path, end_id), end_id)
