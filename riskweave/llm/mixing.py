"""Mixing sources to target weights by temperature (operator 10). DataFrame functions only.

A source's share p of all tokens becomes the weight p**a / sum p**a. The exponent a lies on a grid of
2**20 steps from 0 (all alike) to 1 (as they are). Two are found by bisection, a grid of 32 exponents in one
aggregation at a time, so the driver gets 32 rows whatever the number of sources: the largest whose weights
have the target entropy, a share of the logarithm of the number of sources, and the least that repeats no
source more than the limit. The larger one holds.

The budget is the least at which no source falls short of one pass, so that no document is lost. A
source's quota of tokens is met in blocks: whole passes over its documents, each in its own permutation by
hash, then the beginning of one more, up to the quota. ``place`` (block and place in it, by the source's
number of passes) orders all copies so that every stretch of it has the target weights.

The running sums of the last block are made in slices of the permutation: sums by slice, running sums of
these, then running sums within a slice, so a source with a third of all rows is spread out.

Tokens are words ``[^\\x20\\x09-\\x0D]+`` and one end. Defined results: a null or empty text has its end only;
a null source is a source of its own; repeated rows and null ids are documents like others; no rows give
no rows; a single source has weight 1 and one pass.
"""

from __future__ import annotations

from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import MapType

from .graph import saved

STEPS, FAN, SLICES = 1 << 20, 32, 256
STATS = "source string, tokens long"


def tokens(text: Column) -> Column:
    """Words of a text and one end."""
    return (F.regexp_count(F.coalesce(text, F.lit("")), F.lit("[^\\x20\\x09-\\x0D]+")) + 1).cast("long")


def unit(doc_id: Column, block: Column) -> Column:
    """Number in [0, 1) from 32 bits of md5: where a document stands in a block's permutation."""
    return F.conv(F.substring(F.md5(F.concat_ws(":", F.coalesce(doc_id.cast("string"), F.lit("null")), block.cast("string"))), 1, 8), 16, 10).cast("double") / F.lit(float(1 << 32))


def _measured(stats: DataFrame, exponents: list[int], total: float) -> list:
    """(k, entropy of the weights, most passes over a source) for exponents k / STEPS, by partial aggregation."""
    p = F.col("tokens") / F.lit(total)
    a = F.col("k") / F.lit(float(STEPS))
    each = stats.select((F.log(p)).alias("lp"), F.explode(F.array(*map(F.lit, exponents))).alias("k")).withColumn("e", F.exp(a * F.col("lp")))
    sums = each.groupBy("k").agg(F.sum("e").alias("z"), F.sum(F.col("e") * a * F.col("lp")).alias("s"), F.max("lp").alias("hi"), F.min("lp").alias("lo"))
    return sums.select("k", (F.log("z") - F.col("s") / F.col("z")).alias("entropy"), F.exp((1 - a) * (F.col("hi") - F.col("lo"))).alias("passes")).orderBy("k").collect()


def _bisect(stats: DataFrame, total: float, good, last: bool) -> int:
    """The last (or first) exponent on the grid for which ``good`` holds, which is true on one side of it only."""
    lo, hi = 0, STEPS
    while hi - lo > 1:
        step = max(1, (hi - lo) // FAN)
        rows = _measured(stats, sorted({*range(lo, hi + 1, step), hi}), total)
        fit = [r["k"] for r in rows if good(r)]
        ks = [r["k"] for r in rows]
        at = ks.index(fit[-1] if last else fit[0])
        lo, hi = (ks[at], ks[min(at + 1, len(ks) - 1)]) if last else (ks[max(at - 1, 0)], ks[at])
        if at == (len(ks) - 1 if last else 0):
            return ks[at]
        if step == 1:
            return ks[at]
    return lo if last else hi


def weights(docs: DataFrame, entropy: float = 0.9, repetition: float = 4.0) -> tuple[DataFrame, float]:
    """source, tokens, weight, quota of each source; and the exponent."""
    stats = saved(docs.groupBy("source").agg(F.sum(tokens(F.col("text"))).alias("tokens")), STATS, "sources")
    r = stats.agg(F.sum("tokens").alias("t"), F.count("*").alias("n")).first()
    if not r.n:
        return stats.selectExpr("source", "tokens", "1d weight", "tokens quota"), 1.0
    aim = F.log(F.lit(float(r.n)))
    aim = entropy * stats.select(aim.alias("x")).first().x
    a = max(_bisect(stats, float(r.t), lambda m: m["entropy"] >= aim - 1e-12, True), _bisect(stats, float(r.t), lambda m: m["passes"] <= repetition + 1e-12, False)) / STEPS
    power = F.exp(F.lit(a) * F.log(F.col("tokens") / F.lit(float(r.t))))
    z, most = stats.select(power.alias("e"), "tokens").agg(F.sum("e"), F.max(F.col("tokens") / F.col("e"))).first()
    # quota = budget * weight with budget = max(tokens / weight)
    return stats.select("source", "tokens", (power / F.lit(z)).alias("weight"), F.round(F.lit(most) * power).cast("long").alias("quota")), a


def copies(docs: DataFrame, keep: list[str], entropy: float = 0.9, repetition: float = 4.0) -> DataFrame:
    """Each copy of a row: ``r`` (a struct of its columns ``keep``), ``block`` (0, 1, ...) and ``place`` in [0, 1).

    The caller's columns travel inside ``r``, so no name of theirs meets one of ours. Of rows equal in doc_id,
    text and source, those first by their other columns get the extra copy.
    """
    by, _ = weights(docs, entropy, repetition)
    by = saved(by, "source string, tokens long, weight double, quota long", "weights")
    of = by.select(F.col("source").alias("of_source"), F.expr("quota div tokens").alias("full"), F.expr("quota % tokens").alias("rest"), (F.col("quota") / F.col("tokens")).alias("passes"))
    own = [F.col("doc_id").cast("long").alias("doc_id"), F.col("source").cast("string").alias("source"), F.xxhash64("text").alias("key")]
    same = lambda *pairs: reduce(and_, (F.col(x).eqNullSafe(F.col(y)) for x, y in pairs))
    ids = docs.select(*own, tokens(F.col("text")).alias("n")).join(of, same(("source", "of_source"))).drop("of_source")
    ids = ids.withColumn("u", unit(F.col("doc_id"), F.col("full"))).withColumn("slice", F.floor(F.col("u") * SLICES).cast("int"))
    schema = "doc_id long, source string, key long, n long, full long, rest long, passes double, u double, slice int"
    ids = saved(ids.select(*(c.split()[0] for c in schema.split(", "))), schema, "copies")
    part = ids.where("rest > 0")
    earlier = Window.partitionBy("of_source").orderBy("of_slice").rowsBetween(Window.unboundedPreceding, -1)
    before = part.groupBy(F.col("source").alias("of_source"), F.col("slice").alias("of_slice")).agg(F.sum("n").alias("m")).select("of_source", "of_slice", F.coalesce(F.sum("m").over(earlier), F.lit(0)).alias("before"))
    upto = Window.partitionBy("source", "slice").orderBy("u", "doc_id", "key").rowsBetween(Window.unboundedPreceding, 0)
    part = part.join(before, same(("source", "of_source"), ("slice", "of_slice"))).withColumn("upto", F.col("before") + F.sum("n").over(upto))
    # a document is found again by its id and its text's hash; equal rows share their extra copies in turn
    extra = part.where("upto <= rest").groupBy(F.col("doc_id").alias("d"), F.col("key").alias("k"), F.col("source").alias("s")).agg(F.count("*").alias("extra"))
    rows = docs.select(F.struct(*keep).alias("r"), *own).join(of, same(("source", "of_source")))
    rows = rows.join(extra, same(("doc_id", "d"), ("key", "k"), ("source", "s")), "left").drop("d", "k", "s")
    again = ids.groupBy(F.col("doc_id").alias("d"), F.col("key").alias("k"), F.col("source").alias("s")).agg(F.count("*").alias("times")).where("times > 1")
    if again.take(1):
        rows = rows.join(again, same(("doc_id", "d"), ("key", "k"), ("source", "s")), "left")
        others = [F.col(f"r.`{c}`") for c in keep if not isinstance(docs.schema[c].dataType, MapType)]
        turn = F.row_number().over(Window.partitionBy("d", "k", "s").orderBy(*others))
        single, several = rows.where("times is null"), rows.where("times is not null").withColumn("extra", F.when(turn <= F.coalesce("extra", F.lit(0)), 1).otherwise(0))
        rows = single.unionByName(several)
    blocks = F.sequence(F.lit(0).cast("long"), F.col("full") - F.when(F.coalesce("extra", F.lit(0)) > 0, 0).otherwise(1))
    rows = rows.select("r", "doc_id", "passes", F.explode(blocks).alias("block"))
    return rows.select("r", "block", ((F.col("block") + unit(F.col("doc_id"), F.col("block"))) / F.greatest("passes", F.lit(1.0))).alias("place"))


def mixed(docs: DataFrame, entropy: float = 0.9, repetition: float = 4.0) -> DataFrame:
    """The rows of ``docs`` once for each copy, with ``_block`` (0, 1, ...) and ``_place`` in [0, 1) behind their columns."""
    return copies(docs, docs.columns, entropy, repetition).select("r.*", F.col("block").alias("_block"), F.col("place").alias("_place"))


def mix(docs: DataFrame, entropy: float = 0.9, repetition: float = 4.0) -> DataFrame:
    """The rows of ``docs``, whole, once for each copy that the target weights ask for."""
    return copies(docs, docs.columns, entropy, repetition).select("r.*")


def plan(docs: DataFrame, entropy: float = 0.9, repetition: float = 4.0) -> DataFrame:
    """doc_id, source, block and place (9 decimals) of every copy."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("source").cast("string").alias("source"), "text")
    return copies(rows, ["doc_id", "source"], entropy, repetition).select("r.doc_id", "r.source", "block", F.round("place", 9).alias("place"))


#: The same rows in DuckDB: bisection by a recursive query over the list of shares.
ORACLE = """
WITH RECURSIVE d AS (SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+')) + 1 AS n FROM documents),
s AS (SELECT source, sum(n)::BIGINT AS t FROM d GROUP BY source),
l AS (SELECT list(ln(t / (SELECT sum(t)::DOUBLE FROM s)) ORDER BY source) AS lp, count(*) AS m FROM s),
e(lo, hi, lp, aim) AS (
  SELECT 0, 1048577, lp, 0.9 * ln(m::DOUBLE) FROM l
  UNION ALL
  SELECT CASE WHEN ok THEN mid ELSE lo END, CASE WHEN ok THEN hi ELSE mid END, lp, aim FROM (
    SELECT *, (lo + hi) // 2 AS mid,
      ln(list_sum(list_transform(lp, lambda x: exp((lo + hi) // 2 / 1048576.0::DOUBLE * x))))
      - list_sum(list_transform(lp, lambda x: exp((lo + hi) // 2 / 1048576.0::DOUBLE * x) * ((lo + hi) // 2 / 1048576.0::DOUBLE) * x))
        / list_sum(list_transform(lp, lambda x: exp((lo + hi) // 2 / 1048576.0::DOUBLE * x))) >= aim - 1e-12 AS ok
    FROM e WHERE hi - lo > 1)),
r(lo, hi, span) AS (
  SELECT -1, 1048576, list_max(lp) - list_min(lp) FROM l
  UNION ALL
  SELECT CASE WHEN exp((1 - (lo + hi) // 2 / 1048576.0::DOUBLE) * span) <= 4 + 1e-12 THEN lo ELSE (lo + hi) // 2 END,
         CASE WHEN exp((1 - (lo + hi) // 2 / 1048576.0::DOUBLE) * span) <= 4 + 1e-12 THEN (lo + hi) // 2 ELSE hi END, span FROM r WHERE hi - lo > 1),
a AS (SELECT greatest((SELECT max(lo) FROM e), (SELECT min(hi) FROM r)) / 1048576.0::DOUBLE AS a),
p AS (SELECT source, t, exp((SELECT a FROM a) * ln(t / (SELECT sum(t)::DOUBLE FROM s))) AS e FROM s),
q AS (SELECT source, t, round((SELECT max(t / e) FROM p) * e)::BIGINT AS quota FROM p),
c AS (SELECT doc_id, d.source, n, quota // t AS f, quota % t AS rest, quota / t::DOUBLE AS passes,
        ('0x' || substr(md5(doc_id || ':' || quota // t), 1, 8))::BIGINT / 4294967296.0::DOUBLE AS u FROM d JOIN q ON d.source IS NOT DISTINCT FROM q.source),
k AS (SELECT *, f + CASE WHEN rest > 0 AND sum(n) OVER (PARTITION BY source ORDER BY u, doc_id ROWS UNBOUNDED PRECEDING) <= rest THEN 1 ELSE 0 END AS copies FROM c),
b AS (SELECT *, unnest(range(copies)) AS block FROM k)
SELECT doc_id, source, block, round((block + ('0x' || substr(md5(doc_id || ':' || block), 1, 8))::BIGINT / 4294967296.0::DOUBLE) / greatest(passes, 1.0), 9) AS place FROM b
"""
