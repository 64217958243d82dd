"""Spelling variants: words one edit apart, found by a frontier that walks a relational trie (operator 12).

The vocabulary is a trie kept as a table of edges (node, label, child). Chains without a branch are one edge, as
in a radix tree, so a word has a node only where another word leaves it, and a long word few. A node's number
is a 64-bit hash of its prefix, rolled along the word in linear time.

The frontier is a table of states (word, position, node, edits). With no edit yet a word can only be at the nodes
of its own path, so all these states are known at once. The first round joins them with the edges of their nodes:
one character may be deleted or replaced on the way along the edge, and nothing else may differ. A letter inserted is
one deleted from the other word, and of two words that differ in a letter the lesser finds the greater.
The trie holds every word forwards and, behind a mark, backwards, and edits are made in the second half of either
only: there a node has few edges, while at the root every word would meet every letter. So paths begin at the half.
Each later round joins the states, one edit old, with the one edge that goes on exactly as the word does. A state
at the end of its word whose node ends a word is a pair of neighbours, confirmed by Spark's own edit distance.

What keeps rounds small: an edge knows what may follow its child (first characters and whether a word ends there), so
most states that cannot go on are not made; rounds are as many as a path has branches, not characters. A crowded
node's states are dealt to as many parts as their number asks for, and its edges, at most one for each character, are
copied to each part. Every round's states are a written table.

Counting is native: occurrences are counted before they are shuffled.

Defined results: a null or empty text has no words; a null doc_id is the text ``null`` in the key; repeated rows count
each; no rows give no rows; other columns are not read. Very long runs are words like others.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from riskweave.session import ship

from .common import mix64, tidy
from .graph import forget, saved

RUN = "[A-Za-z\\u00C0-\\u00FF]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: States of a node that one part takes.
PART = 20_000
VOCABULARY = "word string, n long"
EDGES = "node long, label string, m int, child long, ends boolean, follow string, crowd long"
STATES = "word string, len int, pos int, node long"
PAIRS = "word string, other string"
#: Begins a word that is read backwards.
BACK = "<"


def runs(docs: DataFrame, length: int = 1, modulus: int = 97) -> DataFrame:
    """word of every occurrence: lower-cased runs of at least ``length`` letters, one in ``modulus`` of them with a letter lost."""
    run = F.explode(F.regexp_extract_all("text", F.lit(RUN if length < 2 else f"{RUN[:-1]}{{{length},}}"), F.lit(0))).alias("run")
    key = F.concat(F.coalesce(F.col("doc_id").cast("string"), F.lit("null")), F.lit(":"), F.col("run"))
    # most runs have no capital; translating letter by letter is slow
    each = docs.select("doc_id", run).withColumn("run", F.when(F.col("run").rlike("[A-Z]"), F.translate("run", UPPER, LOWER)).otherwise(F.col("run"))).select("run", F.crc32(key).alias("h"))
    at = (F.col("h") % F.length("run")).cast("int")
    lost = F.concat(F.substring("run", F.lit(1), at), F.substring("run", at + 2, F.length("run")))
    return each.select(F.when(F.col("h") % modulus == 0, lost).otherwise(F.col("run")).alias("word"))


def vocabulary(docs: DataFrame, length: int = 5, least: int = 3) -> DataFrame:
    """word and n of the words of at least ``length`` characters that occur ``least`` times."""
    return runs(docs, length).where(F.length("word") >= length).groupBy("word").agg(F.count("*").alias("n")).where(F.col("n") >= least)


def halves(length: np.ndarray, back: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where a word's second half begins, for it and for a word with a letter more; the mark of a backward word not counted."""
    return back + (length - back) // 2, back + (length - back + 1) // 2


def prefix_hashes(words: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(hash, next code point or -1, position) of the prefixes of each word, one after another, from the empty one on.

    One pass for all words: sums of codes times falling powers of an odd base; a difference of two of them times a
    rising power is a word's own polynomial, modulo 2**64.
    """
    n = np.fromiter(map(len, words), np.int64, len(words))
    codes = np.frombuffer("".join(words).encode("utf-32-le"), np.uint32)
    base = 0x9E3779B97F4A7C15
    with np.errstate(over="ignore"):
        rising = np.multiply.accumulate(np.concatenate([[np.uint64(1)], np.full(len(codes), base, np.uint64)]))
        falling = np.multiply.accumulate(np.full(len(codes), pow(base, -1, 1 << 64), np.uint64))
        sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(mix64(codes.astype(np.uint64) + np.uint64(1)) * falling)])
        rows = n + 1
        first = np.cumsum(n) - n
        pos = np.arange(rows.sum()) - np.repeat(np.cumsum(rows) - rows, rows)
        at = np.repeat(first, rows) + pos
        hashes = mix64((sums[at] - np.repeat(sums[first], rows)) * rising[at])
    nexts = np.append(codes, 0).astype(np.int32)[at]
    nexts[np.cumsum(rows) - 1] = -1
    return hashes.view(np.int64), nexts, pos.astype(np.int32)


def _prefixes(words: DataFrame) -> DataFrame:
    """node, next, forced, id (of the word) and pos of the prefixes of every word from its half on."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for at in range(0, b.num_rows, 2000):
                part = b.slice(at, 2000)
                texts = part.column("word").to_pylist()
                node, nexts, pos = prefix_hashes(texts)
                rows = np.fromiter(map(len, texts), np.int64, len(texts))
                half, more = (np.repeat(h, rows + 1) for h in halves(rows, np.fromiter((t[0] == BACK for t in texts), np.int64, len(texts))))
                keep = pos >= half
                columns = [node, nexts, (pos == half) | (pos == more), np.repeat(part.column("id").to_numpy(), rows + 1), pos]
                yield pa.RecordBatch.from_arrays([pa.array(c[keep]) for c in columns], names=["node", "next", "forced", "id", "pos"])

    return words.select("word", F.xxhash64("word").alias("id")).mapInArrow(tidy("variants", run), "node long, next int, forced boolean, id long, pos int")


def trie(words: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The path (word, len, pos, node) of each word and the edges of the trie, both written.

    Nodes are the prefixes that end where the second half of a word begins, those after which words part, and words.
    Prefixes are rows of numbers, so a very long word costs its length, not its square.
    """
    prefixes = _prefixes(words)
    parting = prefixes.groupBy("node").agg(F.min("next").alias("lo"), F.max("next").alias("hi"), F.max("forced").alias("forced"), F.count("*").alias("crowd"))
    # an end (-1), or two characters
    nodes = saved(parting.where("lo = -1 or lo <> hi or forced").select("node", (F.col("lo") == -1).alias("ends"), "crowd"), "node long, ends boolean, crowd long", "variant-nodes")
    at = prefixes.select("node", "id", "pos").join(nodes.select("node"), "node").groupBy("id").agg(F.sort_array(F.collect_list(F.struct("pos", "node"))).alias("at"))
    at = words.select("word", F.xxhash64("word").alias("id")).join(at, "id").select("word", F.length("word").alias("len"), "at")
    at = saved(at, "word string, len int, at array<struct<pos int, node long>>", "variant-paths")
    # a step from each node of a path to the next; equal steps of many words are one edge
    steps = at.select("word", F.explode(F.expr("transform(sequence(2, size(at)), i -> struct(at[i - 2] as a, at[i - 1] as b))")).alias("s"))
    edges = steps.select(F.col("s.a.node").alias("node"), F.expr("substring(word, s.a.pos + 1, s.b.pos - s.a.pos)").alias("label"), F.col("s.b.node").alias("child")).distinct()
    edges = saved(edges, "node long, label string, child long", "variant-edges")
    follow = edges.groupBy("node").agg(F.concat_ws("", F.collect_set(F.substring("label", 1, 1))).alias("follow"))
    child = nodes.select(F.col("node").alias("child"), "ends").join(follow.withColumnRenamed("node", "child"), "child", "left")
    full = edges.join(child, "child").join(nodes.select("node", "crowd"), "node").select("node", "label", F.length("label").alias("m"), "child", "ends", F.coalesce("follow", F.lit("")).alias("follow"), "crowd")
    full = saved(full, EDGES, "variant-trie")
    forget(nodes, edges)
    return at, full


#: Characters from which the edit distance, whose time grows with the square of them, gives way to the first difference.
LONG = 200


def one_edit(a: str, b: str) -> str:
    """SQL: whether two strings whose lengths differ by at most one are one edit apart."""
    at = f"cast(array_position(zip_with(split({a}, ''), split({b}, ''), (x, y) -> x <=> y), false) as int)"
    rest = f"case length({a}) - length({b}) when 0 then substring({a}, {at} + 1) = substring({b}, {at} + 1) when 1 then substring({a}, {at} + 1) = substring({b}, {at}) else substring({a}, {at}) = substring({b}, {at} + 1) end"
    return f"if(length({a}) > {LONG}, abs(length({a}) - length({b})) < 2 and {a} <> {b} and {rest}, levenshtein({a}, {b}, 1) = 1)"


#: An edge's child at the word's end must end a word, and else go on with the word's next character.
GOES_ON = "{after} <= len and if({after} = len, ends, contains(follow, substring(word, {after} + 1, 1)))"


def first_edits(path: DataFrame, edges: DataFrame) -> DataFrame:
    """States after one edit on an edge from a node of the word's own path, in its second half.

    A letter is replaced by a later one on any edge of the node; or the word loses a letter, which only edges allow
    that begin with its next letter or the one after.
    """
    parts = F.ceil(F.col("crowd") / PART).cast("int")
    crowded = edges.where(F.col("crowd") > PART).groupBy("node").agg(F.max("crowd").alias("crowd"))

    dealt = edges.withColumn("part", F.explode(F.sequence(F.lit(0), parts - 1))).drop("crowd")
    here = path.join(crowded, "node", "left").withColumn("part", F.coalesce(F.pmod(F.xxhash64("word"), parts), F.lit(0)).cast("int")).drop("crowd")
    piece = "substring(word, pos + 1, m)"
    fits = f"{GOES_ON.format(after='pos + m')} and {piece} < label"
    other = here.join(dealt, ["node", "part"]).where(f"{fits} and {one_edit(piece, 'label')}").selectExpr("word", "len", "pos + m as pos", "child as node")
    after = "pos + m + 1"
    # a letter lost right after the label is one lost before the next edge
    fits = f"{GOES_ON.format(after=after)} and substring(word, pos + 1, m) <> label"
    starts = F.explode(F.array_distinct(F.array(F.expr("substring(word, pos + 1, 1)"), F.expr("substring(word, pos + 2, 1)"))))
    lost = path.withColumn("c", starts).join(edges.withColumn("c", F.substring("label", 1, 1)), ["node", "c"]).where(f"{fits} and {one_edit('substring(word, pos + 1, m + 1)', 'label')}")
    return other.unionByName(lost.selectExpr("word", "len", f"{after} as pos", "child as node"))


def neighbours(words: DataFrame) -> DataFrame:
    """The pairs (word, other) of words that are one edit apart, both ways round, written."""
    ship(words.sparkSession)
    both = words.select("word").unionByName(words.select(F.concat(F.lit(BACK), F.reverse("word")).alias("word")))
    at, edges = trie(both)
    path = at.select("word", "len", F.explode("at").alias("p")).select("word", "len", "p.pos", "p.node").where("pos < len")
    at_end = at.select(F.expr("element_at(at, -1).node").alias("node"), F.col("word").alias("other"))
    # a word without its last letter is a node of its own path that ends a word
    found = [saved(_pairs(path.where("pos = len - 1").select("word", "node"), at_end), PAIRS, "variant-pairs")]
    states = saved(first_edits(path, edges), STATES, "variant-states")
    steps = edges.select("node", "label", "m", "child", "ends", "follow", F.substring("label", 1, 1).alias("c"))
    goes_on = GOES_ON.format(after="pos + m")
    while True:
        found.append(saved(_pairs(states.where("pos = len").select("word", "node"), at_end), PAIRS, "variant-pairs"))
        going = states.where("pos < len").withColumn("c", F.expr("substring(word, pos + 1, 1)"))
        on = going.join(steps, ["node", "c"]).where(f"{goes_on} and substring(word, pos + 1, m) = label")
        last, states = states, saved(on.selectExpr("word", "len", "pos + m as pos", "child as node"), STATES, "variant-states")
        forget(last)
        if not states.take(1):
            break
    pairs = found[0]
    for more in found[1:]:
        pairs = pairs.unionByName(more)
    turned = lambda c: F.expr(f"if(startswith({c}, '{BACK}'), reverse(substring({c}, 2)), {c})").alias(c)
    pairs = pairs.select(turned("word"), turned("other"))
    out = saved(pairs.unionByName(pairs.select(F.col("other").alias("word"), F.col("word").alias("other"))).distinct(), PAIRS, "variant-neighbours")
    forget(at, edges, states, *found)
    return out


def _pairs(ends: DataFrame, at_end: DataFrame) -> DataFrame:
    return ends.join(at_end, "node").where(f"word <> other and startswith(word, '{BACK}') = startswith(other, '{BACK}') and {one_edit('word', 'other')}").select("word", "other")


def variants(docs: DataFrame, length: int = 5, least: int = 3, times: int = 2) -> DataFrame:
    """word, form, root, n, n_near and form_n of every word of the vocabulary of ``docs``."""
    words = saved(vocabulary(docs, length, least), VOCABULARY, "variant-words")
    near = neighbours(words)
    other = words.select(F.col("word").alias("other"), F.col("n").alias("other_n"))
    # the largest n, then the least word in code-point order, by one ordered minimum
    best = near.join(other, "other").groupBy("word").agg(F.count("*").alias("n_near"), F.min(F.struct((-F.col("other_n")).alias("minus"), F.col("other").alias("form"))).alias("b"))
    out = words.join(best, "word", "left").select("word", "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), F.when(-F.col("b.minus") >= times * F.col("n"), F.struct(F.col("b.form").alias("form"), (-F.col("b.minus")).alias("form_n"))).alias("f"))
    out = saved(out.select("word", F.col("f.form").alias("form"), "n", "n_near", F.col("f.form_n").alias("form_n")), "word string, form string, n long, n_near long, form_n long", "variant-forms")
    # roots by doubling: along forms n doubles at least, so a path has at most 63 steps
    leads = out.where("form is not null").select("word", F.col("form").alias("root"))
    schema, old = "word string, root string, moved boolean", None
    for _ in range(7):
        further = leads.select(F.col("word").alias("root"), F.col("root").alias("next"))
        new = saved(leads.join(further, "root", "left").select("word", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moved")), schema, "variant-roots")
        forget(old)
        old, leads = new, new.select("word", "root")
        if not new.where("moved").take(1):
            break
    return out.join(leads, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")


#: The same words, and their neighbours by the words that are left when one letter is taken out of each.
ORACLE = f"""
WITH RECURSIVE each AS (
  SELECT coalesce(CAST(doc_id AS VARCHAR), 'null') AS d, unnest(regexp_extract_all(translate(text, '{UPPER}', '{LOWER}'), '[A-Za-z\u00C0-\u00FF]+')) AS run FROM documents
), counted AS (SELECT d, run, count(*) AS n, encode(d || ':' || run) AS b FROM each GROUP BY d, run),
bits AS (SELECT i, list_reduce([i::BIGINT, 0, 0, 0, 0, 0, 0, 0, 0], lambda x, k: xor(x >> 1, CASE WHEN x & 1 = 1 THEN 3988292384 ELSE 0 END)) AS c FROM range(256) t(i)),
steps AS (SELECT list(c ORDER BY i) AS t FROM bits),
hashed AS (
  SELECT run, n, xor(list_reduce([4294967295::BIGINT] || list_transform(generate_series(1, octet_length(b)), lambda i: ('0x' || substr(hex(b), (2 * i - 1)::INT, 2))::BIGINT),
    lambda c, x: xor(c >> 8, t[1 + xor(c & 255, x)])), 4294967295::BIGINT) AS h FROM counted, steps
), lost AS (SELECT CASE WHEN h % 97 = 0 THEN substr(run, 1, (h % length(run))::INT) || substr(run, (h % length(run))::INT + 2) ELSE run END AS word, n FROM hashed),
words AS (SELECT word, sum(n)::BIGINT AS n FROM lost WHERE length(word) >= 5 GROUP BY word HAVING sum(n) >= 3),
cut AS (SELECT word, i, substr(word, 1, (i - 1)::INT) || substr(word, (i + 1)::INT) AS rest FROM words, unnest(generate_series(1, length(word))) AS u(i)),
one AS (SELECT DISTINCT c.word, w.word AS other FROM cut c JOIN words w ON w.word = c.rest),
near AS (SELECT word, other FROM one UNION SELECT other, word FROM one UNION SELECT a.word, b.word FROM cut a JOIN cut b ON a.rest = b.rest AND a.i = b.i AND a.word <> b.word),
best AS (
  SELECT word, count(*) AS n_near, arg_min(form, (minus, form)) AS form, -min(minus) AS form_n FROM (SELECT near.word, other AS form, -n AS minus FROM near JOIN words o ON o.word = near.other) GROUP BY word
), formed AS (
  SELECT w.word, w.n, coalesce(n_near, 0) AS n_near, CASE WHEN form_n >= 2 * w.n THEN form END AS form, CASE WHEN form_n >= 2 * w.n THEN form_n END AS form_n FROM words w LEFT JOIN best b ON b.word = w.word
), follow AS (
  SELECT word, word AS root, form AS next FROM formed UNION ALL SELECT f.word, f.next, o.form FROM follow f JOIN formed o ON o.word = f.next
)
SELECT f.word, form, root, n, n_near, CAST(form_n AS BIGINT) AS form_n FROM formed f JOIN follow r ON r.word = f.word WHERE r.next IS NULL
"""
