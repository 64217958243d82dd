"""Language-model scoring by context-tree weighting (operator 4).

A byte is eight binary decisions. Each decision, named by the bits before it, has a context tree over the
``DEPTH`` bytes before the text's byte; a node counts its zeros and ones and holds their
Krichevsky-Trofimov (KT) probability Pe. The weighted probability of a node is Pw = (Pe + product of the
children's Pw) / 2, and Pw = Pe at the deepest level. What remains for coding is, at each node, the
share w = Pe / (2 Pw) of its own KT estimate against its child's estimate: a bit's probability mixes the
estimates of all depths along its context. A context that was never seen has the KT estimate of no counts, 1/2,
as have all below it. A text ends with the byte 0xFF and starts after ``DEPTH`` bytes 0xFE, which UTF-8 never uses,
so probabilities of all texts sum to one.

Counting: every task counts the byte strings of DEPTH + 1 bytes of its texts (those of held-out texts count
0), and Spark adds them up; this grows with the corpus. The trees below each context of ``TOP`` bytes are then
weighted side by side, in streams sorted by that context, which also mixes these levels for each string there;
the levels above are weighted by aggregations, and complete each string's log probability. No node is dropped
or shares its place: the levels above ``TOP`` have at most 256**TOP nodes for any corpus and are loaded whole.
The texts are scored in one pass: strings with counts of at least a power of two that leaves at most
2**COMMON_BITS of them are loaded with their values, once in a Python worker; what a text has of the others,
few of its strings by the nature of text, is joined to their values by a shuffle.

The base model needs the exact count of every word. Words with counts of at least a power of two that
leaves at most ``FREQUENT`` of them are broadcast; the tokens that are not among them are counted by a
join on the word's 64-bit hash, so no list of all words is held anywhere.

Defined results: a null or empty text is its end byte and end token alone; a null doc_id counts as not
held out; without training texts every bit has probability 1/2, and the base model knows no token.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from riskweave.session import scratch, ship

from .common import WordHash, kept, mix64, tidy, words
from .learn import held_out

DEPTH, TOP, COMMON_BITS = 6, 3, 22
#: Distinct keys that a task holds while it counts, 16 bytes each and as much again for a merge.
HELD = 4_000_000
#: Words whose counts are broadcast, at most.
FREQUENT = 200_000
START, END = 0xFE, 0xFF
_STEP = 1500.0  # logits are kept as multiples of 1 / _STEP in 16 bits


def _lgamma(x: np.ndarray) -> np.ndarray:
    """log Gamma(x) for x > 0, by Stirling's series after shifting small arguments up."""
    small = x < 8
    shift, prod = np.where(small, x, 1.0), np.ones_like(x)
    for k in range(8):
        prod *= np.where(small, shift + k, 1.0)
    z = np.where(small, x + 8, x)
    y = 1 / (z * z)
    return (z - 0.5) * np.log(z) - z + 0.9189385332046727 + (1 / 12 - y * (1 / 360 - y * (1 / 1260 - y / 1680))) / z - np.log(prod)


_HALF, _WHOLE = (_lgamma(np.arange(1 << 14) + x) for x in (0.5, 1.0))


def _looked_up(table: np.ndarray, n: np.ndarray, plus: float) -> np.ndarray:
    out = table[np.minimum(n, len(table) - 1)]
    large = np.flatnonzero(n >= len(table))
    out[large] = _lgamma(n[large] + plus)
    return out


def kt_log(n0: np.ndarray, n1: np.ndarray) -> np.ndarray:
    """Natural log of the KT probability of n0 zeros and n1 ones."""
    return _looked_up(_HALF, n0, 0.5) + _looked_up(_HALF, n1, 0.5) - _looked_up(_WHOLE, n0 + n1, 1.0) - np.log(np.pi)


def pack(texts: list[str], depth: int = DEPTH) -> tuple[np.ndarray, np.ndarray]:
    """Each text's strings of depth + 1 bytes, one for each byte and the end, packed big-endian in 64 bits; and the number of each text's strings."""
    start = bytes([START]) * depth
    raw = [t.encode("utf-8", "surrogatepass") for t in texts]
    size = np.array([len(r) + 1 for r in raw], np.int64)
    a = np.frombuffer(b"".join(x for r in raw for x in (start, r, b"\xff")), np.uint8)
    n = len(a) - depth
    if n <= 0:
        return np.empty(0, np.uint64), size
    out = a[:n].astype(np.uint64)
    for j in range(1, depth + 1):
        out <<= np.uint64(8)
        out |= a[j : j + n]
    return out[a[depth:] != START], size


def bit_nodes(symbol: np.ndarray, j: int) -> tuple[np.ndarray, np.ndarray]:
    """The node (1 to 255) of the j-th decision of each symbol, and the decision."""
    s = symbol.astype(np.uint64)
    return np.uint64(1 << j) | (s >> np.uint64(8 - j)), (s >> np.uint64(7 - j)) & np.uint64(1)


def _sum_by(keys: np.ndarray, *values: np.ndarray) -> tuple[np.ndarray, ...]:
    order = np.argsort(keys)
    return _sum_runs(keys[order], *(v[order] for v in values))


def _sum_runs(keys: np.ndarray, *values: np.ndarray) -> tuple[np.ndarray, ...]:
    if not len(keys):
        return (keys, *values)
    at = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]]))
    return (keys[at], *(np.add.reduceat(v, at) for v in values))


def leaves(grams: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Nodes of the deepest level as context << 8 | node, with their zeros and ones. ``grams`` ascend, so each decision's nodes do too."""
    context, symbol = grams >> np.uint64(8) << np.uint64(8), grams & np.uint64(255)
    found = []
    for j in range(8):
        node, bit = bit_nodes(symbol, j)
        found.append(_sum_runs(context | node, np.where(bit == 0, counts, 0), np.where(bit == 1, counts, 0)))
    return tuple(np.concatenate(x) for x in zip(*found, strict=True))


def weigh(n0: np.ndarray, n1: np.ndarray, below: np.ndarray | None) -> tuple[np.ndarray, np.ndarray]:
    """log Pw of nodes and the logit of w; ``below`` is the sum of the children's log Pw, None at the deepest level."""
    pe = kt_log(n0, n1)
    if below is None:
        return pe, np.full(len(pe), 20.0)
    return np.logaddexp(pe, below) - np.log(2), np.clip(pe - below, -20, 20)


def up(keys: np.ndarray, depth: int, n0: np.ndarray, n1: np.ndarray, pw: np.ndarray) -> tuple[np.ndarray, ...]:
    """The parents of nodes at ``depth``, the context's farthest byte dropped: keys, zeros, ones and the sum of log Pw."""
    keep = np.uint64((1 << 8 * (depth - 1)) - 1)
    return _sum_by((keys >> np.uint64(8) & keep) << np.uint64(8) | keys & np.uint64(255), n0, n1, pw)


def entries(depth: int, keys: np.ndarray, n0: np.ndarray, n1: np.ndarray, share: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of each node: depth and key in one number; KT logit and logit of w in another."""
    p = np.clip(np.log((n1 + 0.5) / (n0 + 0.5)) * _STEP, -32000, 32000).round().astype(np.int64) + 32768
    w = np.clip(share * _STEP, -32000, 32000).round().astype(np.int64) + 32768
    return np.int64(depth) << 56 | keys.astype(np.int64), p << 16 | w


def subtree(grams: np.ndarray, counts: np.ndarray, depth: int, top: int, _bits: int = COMMON_BITS) -> tuple[list[tuple[np.ndarray, np.ndarray]], tuple[np.ndarray, ...]]:
    """Levels ``depth`` to ``top`` of the trees of some contexts, from ascending strings: entries of each, and the sums for level top - 1."""
    keys, n0, n1 = leaves(grams, counts)
    below, out = None, []
    for d in range(depth, top - 1, -1):
        pw, share = weigh(n0, n1, below)
        out.append(entries(d, keys, n0, n1, share))
        if d:
            keys, n0, n1, below = up(keys, d, n0, n1, pw)
    return out, (keys, n0, n1, below)


_SIGMOID = 1 / (1 + np.exp(-(np.arange(65536) - 32768) / _STEP))


class Model:
    """All nodes of some levels, each level's in ascending order: the KT estimate of a one, and w."""

    def __init__(self, depth: int = DEPTH, *_sizes: int):
        self.depth = depth
        self.parts: list[list[tuple[np.ndarray, np.ndarray]]] = [[] for _ in range(depth + 1)]

    def put(self, place: np.ndarray, packed: np.ndarray) -> None:
        """Adds nodes from entries, each once."""
        depth = place >> 56
        for d in np.unique(depth):
            self.parts[d].append(((place[depth == d] & ((1 << 56) - 1)).astype(np.uint64), packed[depth == d].astype(np.uint32)))

    def level(self, d: int) -> tuple[np.ndarray, np.ndarray]:
        if len(self.parts[d]) > 1 or self.parts[d] and np.any(self.parts[d][0][0][1:] < self.parts[d][0][0][:-1]):
            keys, packed = (np.concatenate(x) for x in zip(*self.parts[d], strict=True))
            order = np.argsort(keys)
            self.parts[d] = [(keys[order], packed[order])]
        return self.parts[d][0] if self.parts[d] else (np.empty(0, np.uint64), np.empty(0, np.uint32))

    def decisions(self, grams: np.ndarray, low: np.ndarray | None = None) -> np.ndarray:
        """Probability of each decision of the strings' last bytes by the levels held; ``low`` is that of deeper levels, 1/2 without."""
        context, symbol = grams >> np.uint64(8), grams & np.uint64(255)
        out = np.full((8, len(grams)), 0.5) if low is None else low.astype(float)
        for d in range(self.depth, -1, -1):
            keys, packed = self.level(d)
            if not len(keys):
                continue
            own_context = (context & np.uint64((1 << 8 * d) - 1)) << np.uint64(8)
            for j in range(8):
                node, bit = bit_nodes(symbol, j)
                key = own_context | node
                at = np.searchsorted(keys, key)
                at[at == len(keys)] = 0
                seen = keys[at] == key
                v = packed[at].astype(np.int64)
                p = v >> 16
                own, w = _SIGMOID[np.where(bit == 1, p, 65536 - p)], _SIGMOID[v & 65535]
                out[j] = np.where(seen, out[j] + w * (own - out[j]), out[j])
        return out

    def mix(self, grams: np.ndarray, low: np.ndarray | None = None) -> np.ndarray:
        """log10 probability of each string's last byte after the others."""
        return np.log10(self.decisions(grams, low)).sum(axis=0)


class Values:
    """Strings with their log10 probabilities: a table of slots, a smaller one for those whose slot is taken, and so on until none is left."""

    def __init__(self, keys: np.ndarray, value: np.ndarray):
        self.tables = []
        while len(keys):
            bits = max(4, len(keys).bit_length())
            factor, shift = mix64(np.uint64([len(self.tables) + 1])) | np.uint64(1), np.uint64(64 - bits)
            known, held = np.zeros(1 << bits, np.uint64), np.zeros(1 << bits, np.float32)
            with np.errstate(over="ignore"):
                at = (keys * factor >> shift).astype(np.int64)
            known[at] = keys
            left = known[at] != keys
            held[at[~left]] = value[~left]
            self.tables.append((factor, shift, known, held))
            keys, value = keys[left], value[left]

    def get(self, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The values of strings, 0 for those that are not held; and which are not held."""
        out, todo = np.zeros(len(keys), np.float32), np.arange(len(keys))
        for factor, shift, known, held in self.tables:
            with np.errstate(over="ignore"):
                at = (keys * factor >> shift).astype(np.int64)
            hit = known[at] == keys
            out[todo[hit]] = held[at[hit]]
            keys, todo = keys[~hit], todo[~hit]
        missing = np.zeros(len(out), bool)
        missing[todo] = True
        return out, missing


# ------------------------------------------------------------------ training


def _arrow(**columns: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(v) for v in columns.values()], names=list(columns))


def _text_parts(batches: Iterator[pa.RecordBatch], chars: int = 2 << 20) -> Iterator[tuple[pa.RecordBatch, list[str]]]:
    """Batches cut to about ``chars`` characters (a longer text alone), with their texts, null as empty."""
    for b in batches:
        texts = [t or "" for t in b.column("text").to_pylist()]
        at = size = 0
        for k, t in enumerate(texts):
            size += len(t)
            if size >= chars or k + 1 == len(texts):
                yield b.slice(at, k + 1 - at), texts[at : k + 1]
                at, size = k + 1, 0


def _merge(held: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    return _sum_by(np.concatenate([k for k, _ in held]), np.concatenate([n for _, n in held]))


def _counter(keys_of):
    """Counts keys within a task, giving them up when over ``HELD`` distinct ones are held."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, np.ndarray]] = []
        size = 0
        for part, texts in _text_parts(batches):
            out = part.column("held_out").to_pylist() if "held_out" in part.schema.names else [False] * len(texts)
            for aside in set(out):  # texts that are held out only show which keys there are
                k, n = np.unique(keys_of([t for t, o in zip(texts, out, strict=True) if o == aside]), return_counts=True)
                held.append((k, n.astype(np.int64) * (not aside)))
                size += len(k)
            if size > HELD:
                held = [_merge(held)]
                size = len(held[0][0])
                if size > 3 * HELD // 4:  # or the next parts would be merged with it one by one
                    yield _arrow(key=held[0][0].view(np.int64), n=held[0][1])
                    held, size = [], 0
        if held:
            k, n = _merge(held)
            yield _arrow(key=k.view(np.int64), n=n)

    return run


END_TOKEN = b" "  # no word has a space


def word_keys(texts: list[str], hashes) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hashes of each text's words, then one end; and the number of each text's tokens."""
    cut = [[*words(t), END_TOKEN] for t in texts]
    size = np.fromiter(map(len, cut), np.int64, len(cut))
    tokens = list(chain.from_iterable(cut))
    return np.fromiter(map(hashes.__getitem__, tokens), np.uint64, len(tokens)), size


LOW = [f"b{j}" for j in range(8)]


def string_values(docs: DataFrame, depth: int = DEPTH, bits: int = COMMON_BITS, top: int = TOP) -> str:
    """Where the log10 probabilities (key, value) of all strings of the texts lie, in parts ``rare=false`` and ``rare=true``; the rows not held_out train."""
    spark, top = docs.sparkSession, min(top, depth)

    def strings(texts: list[str]) -> np.ndarray:
        return pack(texts, depth)[0]

    grams = docs.select("text", "held_out").mapInArrow(tidy("ctw-trees", _counter(strings)), "key long, n long")
    near = F.col("key").bitwiseAND((1 << 8 * (top + 1)) - 256)
    # dealt by the nearest bytes once: the sums and the trees below them need no other exchange
    grams = grams.withColumn("near", near).repartition("near").groupBy("near", "key").agg(F.sum("n").alias("n")).sortWithinPartitions("near")

    def below(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def weighed(k: np.ndarray, n: np.ndarray) -> Iterator[pa.RecordBatch]:
            k = k.view(np.uint64)
            order = np.argsort(k)
            k, n = k[order], n[order]
            model = Model(depth)
            if n.any():
                levels, (keys, n0, n1, low) = subtree(k[n > 0], n[n > 0], depth, top)
                for place, packed in levels:
                    model.put(place, packed)
                yield rows(keys, len(keys), n0=n0, n1=n1, below=low)
            for at in range(0, len(k), 100_000):
                part = k[at : at + 100_000]
                yield rows(part, len(part), n0=n[at : at + 100_000], **dict(zip(LOW, model.decisions(part).astype(np.float32), strict=True)))

        held: list[np.ndarray] = []
        size = 0
        for b in batches:
            t = np.stack([b.column(c).to_numpy() for c in ("near", "key", "n")])
            held.append(t)
            size += t.shape[1]
            if size > 200_000:
                t = np.concatenate(held, axis=1)
                cut = int(np.searchsorted(t[0], t[0, -1]))  # the last context may go on
                if cut:
                    yield from weighed(t[1, :cut], t[2, :cut])
                held, size = [t[:, cut:]], t.shape[1] - cut
        if size:
            t = np.concatenate(held, axis=1)
            yield from weighed(t[1], t[2])

    def rows(keys: np.ndarray, n: int, **columns: np.ndarray) -> pa.RecordBatch:
        kinds = {"n0": pa.int64(), "n1": pa.int64(), "below": pa.float64()} | dict.fromkeys(LOW, pa.float32())
        data = [pa.array(columns[c], t) if c in columns else pa.nulls(n, t) for c, t in kinds.items()]
        return pa.RecordBatch.from_arrays([pa.array(keys.astype(np.int64)), *data], names=["key", *kinds])

    def level(d: int):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                keys, n0, n1, low = (b.column(c).to_numpy() for c in ("key", "n0", "n1", "below"))
                keys = keys.astype(np.uint64)
                pw, share = weigh(n0, n1, low)
                place, packed = entries(d, keys, n0, n1, share)
                zero = np.zeros(len(place), np.int64)
                yield _arrow(place=place, packed=packed, n0=zero, n1=zero, below=zero.astype(float))
                if d:
                    k, a, c, p = up(keys, d, n0, n1, pw)
                    yield _arrow(place=-1 - k.astype(np.int64), packed=np.zeros(len(k), np.int64), n0=a, n1=c, below=p)

        return run

    path, low = scratch(spark, "ctw-levels"), "key long, n0 long, n1 long, below double, " + ", ".join(f"{c} float" for c in LOW)
    grams.mapInArrow(tidy("ctw-trees", below), low).write.parquet(f"{path}/low")
    both = spark.read.schema(low).parquet(f"{path}/low")
    schema = "place long, packed long, n0 long, n1 long, below double"
    sums = both.where("below is not null").select("key", "n0", "n1", "below")
    for d in range(top - 1, -1, -1):
        sums = sums.groupBy("key").agg(*(F.sum(c).alias(c) for c in ("n0", "n1", "below")))
        sums.mapInArrow(tidy("ctw-trees", level(d)), schema).write.parquet(f"{path}/nodes/level={d}")
        sums = spark.read.schema(schema).parquet(f"{path}/nodes/level={d}").where("place < 0").select((-1 - F.col("place")).alias("key"), "n0", "n1", "below")

    all_strings = both.where("below is null")
    size = F.floor(F.log2(F.col("n0") + 1)).cast("int")
    room, least = 1 << bits, 64
    for r in all_strings.groupBy(size.alias("b")).agg(F.count("*").alias("n")).orderBy(F.desc("b")).collect():  # 64 rows at most
        room -= r.n
        if room < 0:
            break
        least = r.b

    def complete(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            model = load_model(f"{path}/nodes", top)
            keys = b.column("key").to_numpy().astype(np.uint64)
            value = model.mix(keys, np.stack([b.column(c).to_numpy(zero_copy_only=False) for c in LOW]))
            yield pa.RecordBatch.from_arrays([pa.array(keys.view(np.int64)), pa.array(value.astype(np.float32)), b.column("rare")], names=["key", "value", "rare"])

    values = all_strings.select("key", (size < least).alias("rare"), *LOW).mapInArrow(tidy("ctw-values", complete), "key long, value float, rare boolean")
    values.write.partitionBy("rare").parquet(f"{path}/values")
    return f"{path}/values"


def _stored(path: str, columns: list[str], where=None) -> Iterator[pa.RecordBatch]:
    """Batches of the Parquet files below ``path``, none where nothing was written."""
    from pyarrow import dataset, fs

    store, at = fs.FileSystem.from_uri(path)
    if store.get_file_info(at).type != fs.FileType.NotFound:
        yield from dataset.dataset(at, filesystem=store, format="parquet").to_batches(columns=columns, filter=where)


def load_model(path: str, top: int) -> Model:
    """The levels above ``top`` written below ``path``; each Python process loads them once."""

    def make() -> Model:
        from pyarrow import dataset

        model = Model(top - 1)
        for d in range(top):
            for b in _stored(f"{path}/level={d}", ["place", "packed"], dataset.field("place") >= 0):
                model.put(b.column("place").to_numpy(), b.column("packed").to_numpy())
        return model

    return kept("ctw-values", path, make)


def load_values(path: str) -> Values:
    """The values of the common strings, loaded once in a Python process."""

    def make() -> Values:
        got = [(b.column("key").to_numpy().view(np.uint64), b.column("value").to_numpy()) for b in _stored(f"{path}/rare=false", ["key", "value"])]
        return Values(*(np.concatenate(x) for x in zip(*got, strict=True))) if got else Values(np.empty(0, np.uint64), np.empty(0, np.float32))

    return kept(f"ctw-{path}", "values", make)


def _lists(size: np.ndarray, mine: np.ndarray, items: np.ndarray) -> pa.ListArray:
    """The ``items`` marked by ``mine`` as one list for each text; ``size`` items belong to each."""
    n = np.add.reduceat(mine.astype(np.int64), np.cumsum(size) - size) if len(size) else size
    return pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(n)]).astype(np.int32)), pa.array(items[mine].view(np.int64)))


# ------------------------------------------------------------------ scoring


def scores(docs: DataFrame, mod: int = 5, depth: int = DEPTH, bits: int = COMMON_BITS, frequent: int = FREQUENT) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score and bits_per_byte of each row.

    Learns from the rows that are not held out: crc32 of doc_id's digits does not leave 1 modulo ``mod``.
    """
    spark = docs.sparkSession
    ship(spark)
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    train = docs.where(~held_out(mod))
    values_path = string_values(docs.withColumn("held_out", held_out(mod)), depth, bits)
    docs = docs.withColumn("row", F.monotonically_increasing_id())

    def hashed(texts: list[str]) -> np.ndarray:
        return word_keys(texts, _hashes("ctw-words"))[0]

    counts_path = scratch(spark, "word-counts")
    train.select("text").mapInArrow(tidy("ctw-words", _counter(hashed)), "key long, n long").groupBy("key").agg(F.sum("n").alias("n")).write.parquet(counts_path)
    counts = spark.read.schema("key long, n long").parquet(counts_path)
    by_size = {r["b"]: (r["v"], r["n"]) for r in counts.groupBy(F.floor(F.log2("n")).cast("int").alias("b")).agg(F.count("*").alias("v"), F.sum("n").alias("n")).collect()}
    distinct, total = sum(v for v, _ in by_size.values()), sum(n for _, n in by_size.values())
    least, room = 64, frequent
    for b in sorted(by_size, reverse=True):
        room -= by_size[b][0]
        if room < 0:
            break
        least = b
    common = counts.where(F.floor(F.log2("n")) >= least).orderBy("key").toPandas() if by_size else None
    shared = spark.sparkContext.broadcast((np.array([], np.uint64), np.array([], np.int64)) if common is None else (common["key"].to_numpy(np.int64).view(np.uint64), common["n"].to_numpy(np.int64)))
    scale = total + 0.5 * (distinct + 1)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, n = shared.value
        order = np.argsort(key)
        key, n = key[order], n[order]
        logs = np.log10((n + 0.5) / scale)
        for part, texts in _text_parts(batches):
            values, hashes = load_values(values_path), _hashes(f"ctw-{values_path}")
            h, size = word_keys(texts, hashes)
            at = np.searchsorted(key, h)
            at[at == len(key)] = 0
            found = key[at] == h if len(key) else np.zeros(len(h), bool)
            start = np.cumsum(size) - size
            base = np.add.reduceat(np.where(found, logs[at], 0.0) if len(key) else np.zeros(len(h)), start)
            known = np.add.reduceat(found.astype(np.int64), start)
            grams, n_bytes = pack(texts, depth)
            value, missing = values.get(grams)
            score = np.add.reduceat(value, np.cumsum(n_bytes) - n_bytes, dtype=float)
            yield pa.RecordBatch.from_arrays([part.column("row"), part.column("doc_id"), pa.array(size), pa.array(known), pa.array(base), pa.array(score), pa.array(n_bytes), _lists(size, ~found, h), _lists(n_bytes, missing, grams)], names=names)

    schema = "row long, doc_id long, n_tokens long, known long, base double, score double, n_bytes long, rest array<long>, rare array<long>"
    names = [x.split()[0] for x in schema.split(", ")]
    path = scratch(spark, "lm-rows")
    docs.mapInArrow(tidy(f"ctw-{values_path}", run), schema).write.parquet(path)
    rows = spark.read.schema(schema).parquet(path)
    some = spark.read.schema("key long, value float, rare boolean").parquet(values_path).where("rare").select("key", "value")
    if some.take(1):
        value = F.when(F.col("value").isNull(), F.raise_error(F.lit("texts changed while they were scored"))).otherwise(F.col("value").cast("double"))
        rare = rows.select("row", F.explode("rare").alias("key")).join(some, "key", "left").groupBy("row").agg(F.sum(value).alias("rare_score"))
        rows = rows.drop("rare").join(rare, "row", "left").withColumn("score", F.col("score") + F.coalesce("rare_score", F.lit(0.0)))
    rest = rows.select("row", F.explode("rest").alias("key")).join(counts, "key", "left")
    log = F.log10((F.coalesce("n", F.lit(0)) + 0.5) / F.lit(float(scale) or 1.0))
    rest = rest.groupBy("row").agg(F.sum(log).alias("more"), F.count("n").alias("more_known"))
    out = rows.drop("rest", "rare").join(rest, "row", "left")
    return out.select(
        "doc_id", held_out(mod).alias("held_out"), "n_tokens", (F.col("known") + F.coalesce("more_known", F.lit(0))).alias("n_known"), F.lit(total).cast("long").alias("train_tokens"),
        (F.col("base") + F.coalesce("more", F.lit(0.0))).alias("base_score"), "score", (-F.col("score") * float(np.log2(10)) / F.col("n_bytes")).alias("bits_per_byte"),
    )


def _hashes(stage: str) -> WordHash:
    return kept(stage, "words", WordHash)
