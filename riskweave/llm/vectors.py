"""Near-duplicate vectors by collision-counting projections (operator 13).

A vector is projected onto many random directions. Two unit vectors at distance d differ by N(0, d * d) in each, so a
pair at the wanted cosine falls into a query's window of ``Z`` deviations with a known probability, and must
collide with it in at least ``need`` of ``COUNTED`` projections but for a probability of ``MISS``: that number is
calculated, as are all others here. Pairs that pass are confirmed in double precision.

Windows of single projections hold a good part of all vectors, so pairs are counted within buckets only. A table of
buckets takes the signs of ``bits`` further projections; two vectors at an angle t share a bucket with probability
(1 - t / pi) ** bits whatever the data are. ``bits`` grows with the logarithm of the number of vectors, so that
buckets stay of one size, and there are as many tables as miss a pair with a probability of ``MISS`` at most: about
N ** 0.15 of them at a cosine of 0.95. Within a bucket each projection is sorted, a query's window is a range of
ranks, and one comparison a pair and projection counts it. Only numbers and codes of one byte a projection are dealt
to buckets, never vectors.

Crowds of near copies are not compared pair by pair. Vectors that agree in the signs of many projections with
``CROWD`` others gather around a centre; those within half of the angle are its class, and all pairs within a class
are links, without looking. A class is one row in a bucket. Between classes the angle of their centres and
their radii settle most pairs at once; what they leave open is settled for each member against the other centre,
and only members that even that leaves open meet the other class's members one by one.

A bucket with more than ``BLOCK`` rows is dealt as pairs of chunks, each a task's work of bounded size; no row is dropped.

Defined results: a null, empty or zero vector, or one with a null or non-finite component, is linked with nothing, as
are vectors of different lengths and a vector with a null vec_id (its component_id is null and it is kept);
repeated rows are vectors of their own, linked with each other; no rows give no rows; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from math import acos, ceil, comb, log, log2, pi

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import FloatType

from riskweave.session import ship

from .common import kept, mix64, tidy
from .graph import EDGE, components, forget, saved

#: Projections whose collisions are counted, and the first of them that must hold out by themselves.
COUNTED, EARLY = 32, 8
Z, INSIDE = 2.5, 0.98758
MISS = 1e-4
#: Rows of a bucket that tables aim at; rows beyond which it is dealt in chunks.
BUCKET, BLOCK = 512, 4096
#: Members of a fine cell that make it a crowd; how many fine cells a vector has.
CROWD, ROUNDS = 16, 6
#: Classes whose centres are broadcast; beyond, they are joined by a shuffle.
BROADCAST_CENTRES = 20_000
STEP = 20.0
#: Angles within so much of a bound are settled by the pairs themselves.
SLACK = 1e-7


def tables_of(n: int, cosine: float, miss: float = MISS, bucket: int = BUCKET) -> tuple[int, int]:
    """(tables, bits) for ``n`` vectors: buckets of about one size, and a pair at the cosine missed by few enough."""
    bits = min(48, max(0, int(log2(max(1, n / bucket)))))
    shared = (1 - acos(cosine) / pi) ** bits
    return (1, 0) if bits == 0 else (max(1, ceil(log(miss) / log(1 - shared))), bits)


def need(of: int, miss: float, inside: float = INSIDE) -> int:
    """The largest count that a pair at the wanted cosine reaches in ``of`` projections but for ``miss``."""
    below, k = 0.0, 0
    while k < of:
        below += comb(of, k) * inside**k * (1 - inside) ** (of - k)
        if below > miss:
            break
        k += 1
    return k


def _directions(dim: int, columns: int) -> np.ndarray:
    """Gaussian directions for vectors of a length: the same in every worker."""
    return kept("vectors", f"{dim}-{columns}", lambda: np.random.default_rng([13, dim]).standard_normal((columns, dim)).T)


def _by_length(column: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(rows, matrix) of the lists of each length, null and empty ones left out."""
    lists = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    sizes = np.array([-1 if s is None else s for s in pa.compute.list_value_length(lists).to_pylist()], np.int64) if lists.null_count else np.diff(lists.offsets.to_numpy()).astype(np.int64)
    flat = lists.flatten()
    starts = np.concatenate([[0], np.cumsum(np.maximum(sizes, 0))])
    values = flat.to_numpy(zero_copy_only=False).astype(np.float64)  # null components are nan
    for d in np.unique(sizes):
        if d > 0:
            rows = np.flatnonzero(sizes == d)
            yield rows, values[starts[rows][:, None] + np.arange(d)]


def _units(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(which rows have a direction, their unit vectors); scaled by powers of two first, so nothing overflows."""
    top = np.abs(x).max(axis=1)
    good = np.isfinite(x).all(axis=1) & (top > 0)
    x = x[good]
    x = np.ldexp(x, -np.frexp(top[good])[1][:, None])
    return good, x / np.sqrt(np.einsum("ij,ij->i", x, x))[:, None]


def _signs(p: np.ndarray, groups: int, bits: int, salt: int, dim: int) -> np.ndarray:
    """A 64-bit cell for each group of projections."""
    cells = ((p > 0).reshape(len(p), groups, bits).astype(np.uint64) << np.arange(bits, dtype=np.uint64)).sum(axis=2, dtype=np.uint64) if bits else np.zeros((len(p), groups), np.uint64)
    with np.errstate(over="ignore"):
        return mix64(mix64(cells + np.uint64(1)) + np.uint64(salt) * np.uint64(0x9E3779B97F4A7C15) + (np.arange(groups, dtype=np.uint64) << np.uint64(32)) + np.uint64(dim)).view(np.int64)


def _projected(rows: DataFrame, tables: int, bits: int, fine_bits: int, vec: str) -> tuple[DataFrame, str]:
    """rid, vec_id, vec, fine, keys and code of the rows whose vectors have a direction."""
    schema = f"rid long, vec_id long, vec {vec}, fine array<long>, keys array<long>, code binary"
    columns = COUNTED + ROUNDS * fine_bits + tables * bits

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for at in range(0, b.num_rows, 1000):
                part = b.slice(at, 1000)
                for where, x in _by_length(part.column("vec")):
                    good, u = _units(x)
                    if not len(u):
                        continue
                    p = u @ _directions(x.shape[1], columns)
                    code = np.clip(np.rint(p[:, :COUNTED] * STEP), -127, 127).astype(np.int8)
                    fine = _signs(p[:, COUNTED : COUNTED + ROUNDS * fine_bits], ROUNDS, fine_bits, 1, x.shape[1])
                    keys = _signs(p[:, COUNTED + ROUNDS * fine_bits :], tables, bits, 2, x.shape[1])
                    took = part.take(pa.array(where[good]))
                    yield pa.RecordBatch.from_arrays([took.column("rid"), took.column("vec_id"), took.column("vec"), pa.array(list(fine), pa.list_(pa.int64())), pa.array(list(keys), pa.list_(pa.int64())), pa.array([c.tobytes() for c in code], pa.binary())], names=["rid", "vec_id", "vec", "fine", "keys", "code"])

    return rows.mapInArrow(tidy("vectors", run), schema), schema


def _angles(pairs: DataFrame, keep: str) -> DataFrame:
    """The columns ``keep`` (DDL) of ``pairs`` and the cosine of its vectors va and vb, in double precision."""
    names = [c.split()[0] for c in keep.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for at in range(0, b.num_rows, 2000):
                part = b.slice(at, 2000)
                out = np.zeros(part.num_rows)
                right = {x.shape[1]: (rows, x) for rows, x in _by_length(part.column("vb"))}
                for rows, x in _by_length(part.column("va")):
                    _, y = right[x.shape[1]]
                    x, y = (np.ldexp(v, -np.frexp(np.abs(v).max(axis=1))[1][:, None]) for v in (x, y))
                    dot = lambda p, q: np.einsum("ij,ij->i", p, q)
                    out[rows] = dot(x, y) / np.sqrt(dot(x, x) * dot(y, y))
                yield pa.RecordBatch.from_arrays([*(part.column(c) for c in names), pa.array(out)], names=[*names, "cosine"])

    return pairs.select(*names, "va", "vb").mapInArrow(tidy("vectors", run), f"{keep}, cosine double")


def _angle():
    return F.acos(F.least(F.lit(1.0), F.greatest(F.lit(-1.0), F.col("cosine"))))


def _classes(nodes: DataFrame, cosine: float) -> tuple[DataFrame, DataFrame] | None:
    """(rid, cls, angle) of the vectors in a class and (cls, size, radius) of the classes, or None."""
    cells = nodes.select("rid", "n", F.explode("fine").alias("key"))
    crowded = saved(cells.groupBy("key").agg(F.sum("n").alias("c"), F.min("rid").alias("centre"), F.max("rid").alias("hi")).where((F.col("c") >= CROWD) & (F.col("centre") != F.col("hi"))).select("key", "centre"), "key long, centre long", "vector-cells")
    if not crowded.take(1):
        forget(crowded)
        return None
    near = saved(cells.join(crowded, "key").select("rid", "centre").distinct(), "rid long, centre long", "vector-gathered")
    centres = nodes.join(near.select(F.col("centre").alias("rid")).distinct(), "rid", "left_semi").select(F.col("rid").alias("centre"), F.col("vec").alias("vb"))
    centres = F.broadcast(centres) if near.select("centre").distinct().count() <= BROADCAST_CENTRES else centres
    both = near.join(nodes.select("rid", F.col("vec").alias("va")), "rid").join(centres, "centre")
    half = _angles(both, "rid long, centre long").withColumn("angle", _angle()).where(F.col("angle") <= acos(cosine) / 2 - SLACK)
    half = saved(half.select("rid", "centre", "angle"), "rid long, centre long, angle double", "vector-near")
    # the centre with most around it, so that few classes take most of a crowd
    company = half.groupBy("centre").agg(F.count("*").alias("company"))
    member = half.join(company, "centre").groupBy("rid").agg(F.max(F.struct("company", "centre", "angle")).alias("m"))
    member = saved(member.select("rid", F.col("m.centre").alias("cls"), F.col("m.angle").alias("angle")), "rid long, cls long, angle double", "vector-members")
    classes = saved(member.join(nodes.select("rid", "n"), "rid").groupBy("cls").agg(F.sum("n").alias("size"), F.max("angle").alias("radius")), "cls long, size long, radius double", "vector-classes")
    forget(crowded, near, half)
    return member, classes


def _bucket_rows(nodes: DataFrame, grouped: tuple | None) -> DataFrame:
    """key, cls, code and radius: one row for each single vector and table, one for each class and bucket."""
    if grouped is None:
        return nodes.select(F.explode("keys").alias("key"), F.col("rid").alias("cls"), "code", F.lit(0.0).alias("radius"))
    member, classes = grouped
    alone = nodes.join(member.select("rid"), "rid", "left_anti").select(F.explode("keys").alias("key"), F.col("rid").alias("cls"), "code", F.lit(0.0).alias("radius"))
    inside = nodes.join(member.select("rid", "cls"), "rid").select(F.explode("keys").alias("key"), "cls").distinct()
    centre = classes.join(nodes.select(F.col("rid").alias("cls"), "code"), "cls").select("cls", "code", "radius")
    return alone.unionByName(inside.join(centre, "cls").select("key", "cls", "code", "radius"))


def window(angle: np.ndarray) -> np.ndarray:
    """Half of a window in steps of the codes: deviations of the chord of an angle."""
    return (np.ceil(STEP * Z * 2 * np.sin(np.minimum(pi, angle) / 2)) + 1).astype(np.int16)


def colliding(codes: np.ndarray, chunk: np.ndarray, radius: np.ndarray, angle: float, early: int, whole: int) -> tuple[np.ndarray, np.ndarray]:
    """(i, j), i < j, of the rows of a bucket that collide in enough projections; of different chunks if there are two.

    ``codes`` has a row for each vector or centre, ``radius`` its class's. A query's window is a range of ranks in the
    sorted projection, wide enough for every row of the bucket; those that pass ``early`` ones are counted anew with the
    window of their own two radii.
    """
    n, two = len(codes), chunk.min() != chunk.max()
    wide = window(angle + radius + radius.max())
    order = np.argsort(codes[:, :EARLY], axis=0, kind="stable")
    ranks = np.empty((EARLY, n), np.uint16)
    low, width = np.empty((EARLY, n), np.uint16), np.empty((EARLY, n), np.uint16)
    for j in range(EARLY):
        ranks[j, order[:, j]] = np.arange(n, dtype=np.uint16)
        inline = codes[order[:, j], j]
        low[j] = np.searchsorted(inline, codes[:, j] - wide, "left")
        width[j] = np.searchsorted(inline, codes[:, j] + wide, "right") - low[j]
    left, right = [], []
    for at in range(0, n, 256):
        to = min(n, at + 256)
        count = np.zeros((to - at, n - at), np.uint8)
        for j in range(EARLY):
            count += (ranks[j, None, at:] - low[j, at:to, None]) < width[j, at:to, None]
        i, k = np.nonzero(count >= early)
        i, k = i + at, k + at
        fit = i < k
        if two:
            fit &= chunk[i] != chunk[k]
        i, k = i[fit], k[fit]
        for some in range(0, len(i), 1 << 16):
            a, b = i[some : some + (1 << 16)], k[some : some + (1 << 16)]
            hits = np.abs(codes[a] - codes[b]) <= window(angle + radius[a] + radius[b])[:, None]
            good = (hits[:, :EARLY].sum(axis=1) >= early) & (hits.sum(axis=1) >= whole)
            left.append(a[good])
            right.append(b[good])
    if not left:
        return np.empty(0, np.int64), np.empty(0, np.int64)
    return np.concatenate(left), np.concatenate(right)


def _candidates(rows: DataFrame, cosine: float) -> DataFrame:
    """Pairs (u, v), u < v, of classes that collide often enough in a bucket."""
    big = rows.groupBy("key").agg(F.count("*").alias("c")).where(F.col("c") > BLOCK).select("key", F.ceil(F.col("c") / (BLOCK // 2)).cast("int").alias("chunks"))
    big = saved(big, "key long, chunks int", "vector-crowded")
    lo, hi, chunk = F.lit(0), F.lit(0), F.lit(0)
    if big.take(1):
        rows = rows.join(big, "key", "left").withColumn("chunk", F.when(F.col("chunks").isNull(), 0).otherwise(F.pmod(F.xxhash64("cls"), F.col("chunks")).cast("int")))
        rows = rows.withColumn("o", F.explode(F.when(F.col("chunks").isNull(), F.array(F.lit(0))).otherwise(F.sequence(F.lit(0), F.col("chunks") - 1))))
        chunk, lo, hi = F.col("chunk"), F.least("chunk", "o"), F.greatest("chunk", "o")
    rows = rows.select("key", lo.cast("int").alias("lo"), hi.cast("int").alias("hi"), chunk.cast("int").alias("chunk"), "cls", "code", "radius")
    early, whole, angle = need(EARLY, MISS / 10), need(COUNTED, MISS / 10), acos(cosine)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []

        def pairs() -> Iterator[pa.RecordBatch]:
            t = pa.Table.from_batches(held)
            if len(t) > 1:
                codes = np.frombuffer(b"".join(t.column("code").to_pylist()), np.int8).reshape(len(t), COUNTED).astype(np.int16)
                # centres of linked vectors may lie apart by their radii more than these
                i, j = colliding(codes, t.column("chunk").to_numpy(), t.column("radius").to_numpy(), angle, early, whole)
                cls = t.column("cls").to_numpy()
                a, b = cls[i], cls[j]
                yield pa.RecordBatch.from_arrays([pa.array(np.minimum(a, b)), pa.array(np.maximum(a, b))], names=["u", "v"])
            held.clear()

        now = None
        for b in batches:
            keys = np.stack([b.column(c).to_numpy() for c in ("key", "lo", "hi")])
            cuts = [0, *(np.flatnonzero((keys[:, 1:] != keys[:, :-1]).any(axis=0)) + 1), b.num_rows]
            for at, to in zip(cuts, cuts[1:]):
                if at == to:
                    continue
                key = tuple(keys[:, at])
                if key != now:
                    if held:
                        yield from pairs()
                    now = key
                held.append(b.slice(at, to - at))
        if held:
            yield from pairs()

    dealt = rows.repartition("key", "lo", "hi").sortWithinPartitions("key", "lo", "hi")
    out = saved(dealt.mapInArrow(tidy("vectors", run), EDGE).where("u <> v").distinct(), EDGE, "vector-pairs")
    forget(big)
    return out


def near_duplicates(vectors: DataFrame, cosine: float = 0.95) -> DataFrame:
    """vec_id, n_links, component_id and kept of each row of ``vectors`` (vec_id, embedding)."""
    ship(vectors.sparkSession)
    spark = vectors.sparkSession
    vec = "array<float>" if isinstance(getattr(vectors.schema["embedding"].dataType, "elementType", None), FloatType) else "array<double>"
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast(vec).alias("vec")).select("vec_id", "vec", F.xxhash64("vec_id", "vec").alias("rid"))
    n = rows.count()
    tables, bits = tables_of(n, cosine)
    fine_bits = min(62, max(8, ceil(log2(max(2, n))) + 4))
    theta = acos(cosine)
    made, schema = _projected(rows.where("vec_id is not null"), tables, bits, fine_bits, vec)
    nodes = saved(made, schema, "vectors")
    again = nodes.groupBy("rid").agg(F.count("*").alias("n")).where("n > 1")
    many = saved(again, "rid long, n long", "vector-copies")
    repeated = bool(many.take(1))
    if repeated:
        # equal rows are one vector that counts n times; the others pass without a shuffle of their vectors
        names = ["rid", "vec_id", "vec", "fine", "keys", "code"]
        first = nodes.join(many, "rid").groupBy("rid", "n").agg(*(F.first(c).alias(c) for c in names[1:])).select(*names, "n")
        once = saved(nodes.join(many, "rid", "left_anti").withColumn("n", F.lit(1).cast("long")).unionByName(first), f"{schema}, n long", "vectors")
        forget(nodes)
        nodes = once
    else:
        nodes = nodes.withColumn("n", F.lit(1).cast("long"))
    grouped = _classes(nodes, cosine)
    pairs = _candidates(_bucket_rows(nodes, grouped), cosine)
    at = lambda rid, v: nodes.select(F.col("rid").alias(rid), F.col("vec").alias(v))
    if grouped is not None:
        member, classes = grouped
        of = nodes.select("rid", "n").join(member.select("rid", "cls"), "rid", "left").select("rid", "n", F.coalesce("cls", "rid").alias("cls"))
        alone = of.where(F.col("rid") == F.col("cls")).join(classes.select("cls"), "cls", "left_anti").select("cls", F.col("n").alias("size"), F.lit(0.0).alias("radius"))
        info = classes.unionByName(alone)
    else:
        of = nodes.select("rid", "n", F.col("rid").alias("cls"))
        info = of.select("cls", F.col("n").alias("size"), F.lit(0.0).alias("radius"))
    side = lambda u, s: info.select(F.col("cls").alias(u), F.col("size").alias(f"size_{s}"), F.col("radius").alias(f"radius_{s}"))
    met = _angles(pairs.join(at("u", "va"), "u").join(at("v", "vb"), "v"), "u long, v long").join(side("u", "u"), "u").join(side("v", "v"), "v").withColumn("angle", _angle())
    r = F.col("radius_u") + F.col("radius_v")
    single = r == 0
    fate = F.when(single, F.when(F.col("cosine") >= cosine, "all").otherwise("none")).when(F.col("angle") + r <= theta - SLACK, "all").when(F.col("angle") - r > theta + SLACK, "none").otherwise("some")
    met = saved(met.withColumn("fate", fate).where("fate <> 'none'").select("u", "v", "size_u", "size_v", "radius_u", "radius_v", "fate"), "u long, v long, size_u long, size_v long, radius_u double, radius_v double, fate string", "vector-met")
    both = lambda df: df.select("u", "v", F.col("size_v").alias("size"), F.col("radius_v").alias("radius")).unionByName(df.select(F.col("v").alias("u"), F.col("u").alias("v"), F.col("size_u").alias("size"), F.col("radius_u").alias("radius")))
    settled = both(met.where("fate = 'all'")).groupBy(F.col("u").alias("cls")).agg(F.sum("size").alias("links"))
    edges = met.where("fate = 'all'").select("u", "v")
    singly, temporary = None, [pairs, met]
    if grouped is not None and met.where("fate = 'some'").take(1):
        # each member against the other class's centre, and members still open against its members
        each = both(met.where("fate = 'some'")).join(of.select("rid", F.col("cls").alias("u")), "u")
        against = _angles(each.join(at("rid", "va"), "rid").join(at("v", "vb"), "v"), "rid long, u long, v long, size long, radius double").withColumn("angle", _angle())
        one = F.when(F.col("radius") == 0, F.when(F.col("cosine") >= cosine, "all").otherwise("none")).when(F.col("angle") + F.col("radius") <= theta - SLACK, "all").when(F.col("angle") - F.col("radius") > theta + SLACK, "none").otherwise("some")
        against = saved(against.withColumn("fate", one).where("fate <> 'none'").select("rid", "u", "v", "size", "fate"), "rid long, u long, v long, size long, fate string", "vector-against")
        open_ = against.where("fate = 'some'").select("rid", "u", "v").join(of.select(F.col("rid").alias("other"), F.col("n").alias("size"), F.col("cls").alias("v")), "v")
        open_ = _angles(open_.join(at("rid", "va"), "rid").join(at("other", "vb"), "other"), "rid long, u long, v long, size long").where(F.col("cosine") >= cosine)
        found = against.where("fate = 'all'").select("rid", "u", "v", "size").unionByName(open_.select("rid", "u", "v", "size"))
        found = saved(found.groupBy("rid", "u", "v").agg(F.sum("size").alias("links")), "rid long, u long, v long, links long", "vector-singly")
        singly = found.groupBy("rid").agg(F.sum("links").alias("more"))
        edges = edges.unionByName(found.select(F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v")).distinct())
        temporary += [against, found]
    labels = components(edges) if edges.take(1) else spark.createDataFrame([], "node long, label long")
    out = of.join(settled, "cls", "left")
    if grouped is not None:
        out = out.join(classes.select("cls", "size"), "cls", "left")
    else:
        out = out.withColumn("size", F.lit(None).cast("long"))
    out = out.join(singly, "rid", "left") if singly is not None else out.withColumn("more", F.lit(0).cast("long"))
    zero = F.lit(0).cast("long")
    out = out.join(labels.withColumnRenamed("node", "cls"), "cls", "left").select("rid", (F.coalesce("size", "n") - 1 + F.coalesce("links", zero) + F.coalesce("more", zero)).alias("n_links"), F.coalesce("label", "cls").alias("label"))
    linked = saved(out.where("n_links > 0").join(nodes.select("rid", "vec_id"), "rid").select("rid", "n_links", "label", "vec_id"), "rid long, n_links long, label long, vec_id long", "vector-linked")
    least = linked.groupBy("label").agg(F.min("vec_id").alias("component_id"))
    linked = linked.join(least, "label").select("rid", "n_links", "component_id")
    forget(many, *temporary)
    out = rows.select("vec_id", "rid").join(linked, "rid", "left")
    component = F.coalesce("component_id", "vec_id")
    return out.select("vec_id", F.coalesce("n_links", zero).alias("n_links"), component.alias("component_id"), F.coalesce(F.col("vec_id") == component, F.lit(True)).alias("kept"))


#: All pairs, which is right and slow: for tables of some thousand vectors.
ORACLE = """
WITH RECURSIVE v AS (
  SELECT vec_id, CAST(embedding AS DOUBLE[]) AS e, row_number() OVER (ORDER BY vec_id) AS r FROM embeddings
), fit AS (
  SELECT * FROM v WHERE vec_id IS NOT NULL AND len(e) > 0 AND len(list_filter(e, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(e, lambda x: x <> 0)) > 0
), near AS (
  SELECT a.r AS a, b.r AS b FROM fit a JOIN fit b ON a.r <> b.r AND len(a.e) = len(b.e) WHERE list_cosine_similarity(a.e, b.e) >= 0.95
), reach AS (
  SELECT r AS a, r AS b FROM v UNION SELECT reach.a, near.b FROM reach JOIN near ON near.a = reach.b
), least AS (SELECT reach.a, min(o.vec_id) AS component_id FROM reach JOIN v o ON o.r = reach.b GROUP BY reach.a),
links AS (SELECT a, count(*) AS n_links FROM near GROUP BY a)
SELECT vec_id, coalesce(n_links, 0) AS n_links, component_id, coalesce(vec_id = component_id, true) AS kept
FROM v JOIN least ON least.a = v.r LEFT JOIN links ON links.a = v.r
"""
