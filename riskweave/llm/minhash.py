"""Near-duplicate documents by one-permutation MinHash (operator 1).

A document's set of word shingles is hashed once. The hash's high bits name one of BANDS * ROWS bins, and
each bin keeps its least hash. An empty bin takes the value of the first non-empty bin in its own fixed
sequence of bins (optimal densification), so every bin samples the set by itself, however small the set.
ROWS bins make a band; documents that agree on a band share a bucket. At a similarity of 0.8, four rows and
26 bands miss a pair with a probability of (1 - 0.8**4)**26, about one in a million.

Equal sets are one node. A bucket's nodes are compared with one centre, a star: as many pairs as nodes. The
centre is the node that meets most others in all its buckets, as the original of many copies does. Pairs
whose sizes allow the similarity are confirmed on their full sets, and components formed.

A star does not link two members that are like each other but not like the centre. So ``LEVELS`` finer
levels follow, all in one pass. Level k has one bucket for each run of k + 1 neighbouring bands, 26 a node, which
only documents share that agree on all of them; buckets whose nodes are in one component already are left out.
Two centres are drawn in each: a bucket's components are ordered by a hash of component and bucket, and the
first and the last one send their node with most company, so that small components come up as often as
large ones. Each member of another component is compared with them. All levels emit at most
26 * (2 * LEVELS + 1) pairs a node, however large a group of copies is.

What the levels may still leave apart is a node that is like some members of a large group, but neither like
a centre nor a centre itself in any bucket that they share. ``small`` is the way to be sure: buckets of up
to so many nodes compare all pairs across components at the end (bounded by small / 2 pairs a member), and
None compares them in all buckets, which loses nothing but grows with the square of a group that stays open.

Defined results: a null or empty text, or one without words, has no shingles and is linked with nothing; a
text with fewer words than a shingle is one shingle; a null doc_id is linked with nothing, its component_id
is null and it is kept; rows with equal doc_id and different texts are judged one by one; no rows give no
rows; other columns are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from riskweave.session import ship

from .common import WordHash, kept, mix64, shingles, tidy, unused, words
from .graph import EDGE, components, forget, saved

BANDS, ROWS, LEVELS = 26, 4, 3
#: Documents in candidate pairs, up to which their ids are broadcast to fetch their texts; beyond, a shuffle join does it.
BROADCAST_IDS = 2_000_000
SIGNATURES = "doc_id long, text_key long, n_shingles long, node long, bands array<long>"


@cache
def _detours(bins: int) -> np.ndarray:
    """Each bin's sequence of bins to try when empty: hashes, then all bins, so that one is found."""
    tries = mix64(np.arange(bins * 4 * bins, dtype=np.uint64) + np.uint64(1 << 33)).reshape(bins, -1) % np.uint64(bins)
    return np.concatenate([tries.astype(np.int32), np.tile(np.arange(bins, dtype=np.int32), (bins, 1))], axis=1)


def signature(hashes: np.ndarray, bins: int = BANDS * ROWS) -> np.ndarray:
    """The least hash of each bin of a non-empty ascending set, empty bins filled."""
    where = ((hashes >> np.uint64(32)) * np.uint64(bins) >> np.uint64(32)).astype(np.int64)
    first = np.concatenate([[True], where[1:] != where[:-1]])
    out, full = np.zeros(bins, np.uint64), np.zeros(bins, bool)
    out[where[first]], full[where[first]] = hashes[first], True
    empty = np.flatnonzero(~full)
    for at, upto in ((0, 16), (16, None)):
        if len(empty):
            tries = _detours(bins)[empty, at:upto]
            hit = full[tries]
            found = hit.any(axis=1)
            out[empty[found]] = out[tries[found, hit[found].argmax(axis=1)]]
            empty = empty[~found]
    return out


def bands(sig: np.ndarray, rows: int = ROWS) -> np.ndarray:
    """A 64-bit bucket for each band."""
    parts = sig.reshape(-1, rows)
    key = np.arange(len(parts), dtype=np.uint64)
    with np.errstate(over="ignore"):
        for j in range(rows):
            key = mix64(key * np.uint64(0x9E3779B97F4A7C15) + parts[:, j])
    return key.view(np.int64)


def node_of(hashes: np.ndarray) -> int:
    """64 bits that name a set."""
    return int.from_bytes(hashlib.blake2b(hashes.tobytes(), digest_size=8).digest(), "little", signed=True)


def _sets(texts: list[str | None], n: int) -> list[np.ndarray]:
    hashes = kept("minhash", "words", WordHash)
    return [shingles(words(t), n, hashes) for t in texts]


def signatures(docs: DataFrame, n: int, n_bands: int = BANDS, rows: int = ROWS) -> DataFrame:
    """doc_id, text_key, n_shingles, node and bands of each row; node is null without shingles."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for at in range(0, b.num_rows, 1000):
                part = b.slice(at, 1000)
                sets = _sets(part.column("text").to_pylist(), n)
                keys = [bands(signature(s, n_bands * rows), rows).tolist() if len(s) else None for s in sets]
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), part.column("text_key"), pa.array([len(s) for s in sets], pa.int64()), pa.array([node_of(s) if len(s) else None for s in sets], pa.int64()), pa.array(keys, pa.list_(pa.int64()))], names=["doc_id", "text_key", "n_shingles", "node", "bands"])

    return docs.select("doc_id", "text", F.xxhash64("text").alias("text_key")).mapInArrow(tidy("minhash", run), SIGNATURES)


def _item_sets(docs: DataFrame, nodes: DataFrame, n: int) -> DataFrame:
    """node and items, its full set of shingle hashes, of ``nodes`` (node, doc_id)."""
    ids = saved(nodes.select("doc_id").distinct(), "doc_id long", "pair-docs")
    texts = docs.join(F.broadcast(ids) if ids.count() <= BROADCAST_IDS else ids, "doc_id", "left_semi")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for at in range(0, b.num_rows, 500):
                sets = _sets(b.slice(at, 500).column("text").to_pylist(), n)
                yield pa.RecordBatch.from_arrays([pa.array([node_of(s) for s in sets], pa.int64()), pa.array([s.view(np.int64) for s in sets], pa.list_(pa.int64()))], names=["node", "items"])

    schema = "node long, items array<long>"
    out = saved(texts.mapInArrow(tidy("minhash", run), schema).dropDuplicates(["node"]), schema, "pair-sets")
    forget(ids)
    return out


def _confirmed(items: DataFrame, pairs: DataFrame, percent: int) -> DataFrame:
    """The pairs (u, v) of nodes whose full sets reach the similarity."""
    need = pairs.select(F.explode(F.array("u", "v")).alias("node")).distinct()
    items = items.join(F.broadcast(need) if need.count() <= BROADCAST_IDS else need, "node", "left_semi")
    both = pairs.join(items.withColumnsRenamed({"node": "u", "items": "a"}), "u").join(items.withColumnsRenamed({"node": "v", "items": "b"}), "v")
    common = F.size(F.array_intersect("a", "b")).cast("long")
    return both.withColumn("common", common).where(F.col("common") * 100 >= percent * (F.size("a") + F.size("b") - F.col("common"))).select("u", "v")


def _buckets(nodes: DataFrame, n_bands: int, levels: range, labels: DataFrame | None) -> DataFrame:
    """key, node, n, label and members of the buckets of some levels that hold more than one component."""
    keys = [f"transform(sequence(0, {n_bands - 1}), i -> xxhash64({level}, {', '.join(f'bands[(i + {j}) % {n_bands}]' for j in range(level + 1))}))" for level in levels]
    each = nodes.select("node", "n", F.explode(F.expr(f"concat({', '.join(keys)})")).alias("key"))
    each = each.withColumn("label", F.col("node")) if labels is None else each.join(labels, "node", "left").withColumn("label", F.coalesce("label", "node"))
    size = each.groupBy("key").agg(F.count("*").alias("members"), F.min("label").alias("lo"), F.max("label").alias("hi")).where("lo <> hi")
    return saved(each.join(size.select("key", "members"), "key").select("key", "node", "n", "label", "members"), "key long, node long, n long, label long, members long", "buckets")


def _stars(buckets: DataFrame, two: bool, percent: int) -> DataFrame:
    """Candidate pairs (u, v): each member with the centre of its bucket, or with two centres."""
    # a node's company: the members of all its buckets; the original of many copies has most of it
    company = buckets.groupBy("node").agg(F.sum("members").alias("company"))
    b = buckets.join(company, "node")
    member, turn = F.struct("node", "n", "label"), F.xxhash64("label", "key")
    if two:
        ends = F.array(F.max_by(member, F.struct(turn, "company", "node")), F.min_by(member, F.struct(turn, -F.col("company"), "node")))
    else:
        ends = F.array(F.max_by(member, F.struct("company", "node")))
    heads = b.groupBy("key").agg(ends.alias("heads")).select("key", F.explode("heads").alias("h"))
    fits = 100 * F.least("n", "h.n") >= percent * F.greatest("n", "h.n")  # sizes alone allow the similarity
    pairs = buckets.join(heads, "key").where((F.col("label") != F.col("h.label")) & fits)
    return pairs.select(F.least("node", "h.node").alias("u"), F.greatest("node", "h.node").alias("v")).distinct()


def _rest(buckets: DataFrame, small: int | None, percent: int) -> DataFrame:
    """All pairs (u, v) across components in buckets of up to ``small`` nodes, or in all."""
    b = buckets if small is None else buckets.where(F.col("members") <= small)
    other = b.select("key", *(F.col(c).alias(f"o_{c}") for c in ("node", "n", "label")))
    fits = 100 * F.least("n", "o_n") >= percent * F.greatest("n", "o_n")
    return b.join(other, "key").where((F.col("node") < F.col("o_node")) & (F.col("label") != F.col("o_label")) & fits).select(F.col("node").alias("u"), F.col("o_node").alias("v")).distinct()


def near_duplicates(docs: DataFrame, n: int = 2, percent: int = 80, n_bands: int = BANDS, rows: int = ROWS, small: int | None = 1, levels: int = LEVELS) -> DataFrame:
    """doc_id, n_shingles, component_id, kept and text_key (xxhash64 of the text) of each row.

    Rows are linked if their sets of ``n``-word shingles have 100 * intersection >= ``percent`` * union.
    """
    spark = docs.sparkSession
    ship(spark)
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    rows_ = saved(signatures(docs, n, n_bands, rows), SIGNATURES, "signatures")
    linked = rows_.where("node is not null and doc_id is not null")
    nodes = saved(linked.groupBy("node").agg(F.min("doc_id").alias("doc_id"), F.min("n_shingles").alias("n"), F.first("bands").alias("bands")), "node long, doc_id long, n long, bands array<long>", "nodes")
    # nodes that share a bucket with another one; the others are done
    each = nodes.select("node", F.explode("bands").alias("band"))
    shared = each.groupBy("band").agg(F.min("node").alias("lo"), F.max("node").alias("hi")).where("lo <> hi").select("band")
    meet = each.join(shared, "band", "left_semi").select("node").distinct()
    active = saved(nodes.join(meet, "node", "left_semi"), "node long, doc_id long, n long, bands array<long>", "active")
    items = _item_sets(docs, active, n)
    labels = found = tried = None
    for step in ("first", "finer", "rest"):
        if step == "rest" and small == 1 or step == "finer" and not levels:
            continue
        buckets = _buckets(active, n_bands, range(1, levels + 1) if step == "finer" else range(1), labels)
        pairs = _rest(buckets, small, percent) if step == "rest" else _stars(buckets, step == "finer", percent)
        if tried is not None:  # two nodes may meet in several buckets, at different levels
            pairs = pairs.join(tried, ["u", "v"], "left_anti")
        pairs = saved(pairs, EDGE, "pairs")
        good = saved(_confirmed(items, pairs, percent), EDGE, "links")
        tried = pairs if tried is None else tried.unionByName(pairs)
        found = good if found is None else found.unionByName(good)
        if good.take(1):
            before, labels = labels, components(found)
            forget(before)
        forget(buckets)
    forget(active, items)
    if labels is None:
        labels = spark.createDataFrame([], "node long, label long")
    group = nodes.join(labels, "node", "left").select("node", "doc_id", F.coalesce("label", "node").alias("label"))
    least = group.groupBy("label").agg(F.min("doc_id").alias("component_id"))
    of = group.join(least, "label").select("node", "component_id")
    out = rows_.drop("bands").join(of, "node", "left").withColumn("component_id", F.when(F.col("doc_id").isNull(), None).otherwise(F.coalesce("component_id", "doc_id")))
    return out.select("doc_id", "n_shingles", "component_id", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)).alias("kept"), "text_key")


def keep_one(docs: DataFrame, n: int = 5, percent: int = 80) -> DataFrame:
    """The rows of ``docs``, whole, one of each group of near-duplicates: that of its least doc_id, and one of equal rows."""
    found = saved(near_duplicates(docs, n, percent).select("doc_id", "text_key", "kept"), "doc_id long, text_key long, kept boolean", "kept")
    own_id, own_key = unused(docs, "id", "key")
    id_, key = F.col("doc_id").cast("long"), F.xxhash64("text")

    def rows_in(part: DataFrame, how: str) -> DataFrame:
        part = part.select(F.col("doc_id").alias(own_id), F.col("text_key").alias(own_key)).distinct()
        part = F.broadcast(part) if part.count() <= BROADCAST_IDS else part
        return docs.join(part, (id_ == F.col(own_id)) & (key == F.col(own_key)), how)

    lost = found.where("not kept")
    again = found.where("kept and doc_id is not null").groupBy("doc_id", "text_key").count().where("count > 1")
    if not again.take(1):
        return rows_in(lost, "left_anti")
    once = rows_in(again, "left_semi").withColumns({own_id: id_, own_key: key}).dropDuplicates([own_id, own_key]).drop(own_id, own_key)
    return rows_in(lost.select("doc_id", "text_key").unionByName(again.select("doc_id", "text_key")), "left_anti").unionByName(once)
