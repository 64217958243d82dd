"""Conversations cut into overlapping chunks for a judge, and the judge's verdicts merged into findings."""

from __future__ import annotations

import time
from bisect import bisect_left, bisect_right
from collections.abc import Callable, Iterator
from concurrent.futures import ThreadPoolExecutor
from itertools import accumulate
from typing import NamedTuple

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from riskweave.plans.taxonomy import judged
from riskweave.session import ship

CHUNK, OVERLAP, LEAST = 24_000, 800, 200
CHUNKS = "array<struct<index:int,text:string,spans:array<struct<mi:int,s:int,e:int>>,truncated:boolean>>"
CHUNK_ROW = "chunk int, text string, spans array<struct<mi:int,s:int,e:int>>, truncated boolean"
#: Confidence of a static finding from which the judge need not be asked; the error of a reply without JSON.
STRONG, NO_JSON = 0.7, "no JSON in the reply"
VERDICT = "hit boolean, confidence double, evidence string, reasoning string"


def limits(size: int = CHUNK, overlap: int = OVERLAP) -> tuple[int, int]:
    """Sizes within bounds: at least 200 characters, an overlap of at most a quarter."""
    return max(LEAST, size), max(0, min(overlap, size // 4))


class Unit(NamedTuple):
    """A paragraph of a message, or a window of one that is too long; ``cut`` marks windows."""

    mi: int
    s: int
    e: int
    text: str
    cut: bool


def head(role: str, size: int) -> str:
    h = f"[{role}]\n" if role else ""
    return h if len(h) < size else ""


def units(mi: int, role: str, body: str, size: int, overlap: int) -> Iterator[Unit]:
    """The paragraphs of a message that are not blank, or the message as it is if it has none."""
    room = size - len(head(role, size))
    step = max(1, room - min(overlap, room - 1))
    parts = body.split("\n\n")
    found = [(at, p) for at, p in zip(accumulate((len(p) + 2 for p in parts), initial=0), parts, strict=False) if p.strip()]
    if not found:
        yield Unit(mi, 0, len(body), body, False)
    for at, p in found:
        windows = 1 + max(0, -(-(len(p) - room) // step))
        for w in range(0, windows * step, step):
            yield Unit(mi, at + w, at + min(len(p), w + room), p[w : w + room], windows > 1)


#: What a judge's reply is, beside the keys of its task.
REPLY = "reply string, error string, calls long, prompt_tokens long, completion_tokens long"


def chunk(messages: list[tuple[str, str]], size: int = CHUNK, overlap: int = OVERLAP) -> list[dict]:
    """Paragraphs packed up to ``size``, the last ones repeated at the start of the next chunk within ``overlap``; all text is in some chunk.

    ``ends`` holds running sums of the units' lengths with their separators and the heads of messages that
    begin: a chunk's end is found in it by bisection, as is the first unit within the overlap in the sums of
    lengths alone.
    """
    every = [u for mi, (role, body) in enumerate(messages) for u in units(mi, role, body, size, overlap)]
    heads = [head(role, size) for role, _ in messages]
    begins = [k == 0 or every[k - 1].mi != u.mi for k, u in enumerate(every)]
    ends = [0, *accumulate(len(u.text) + 2 + (len(heads[u.mi]) if new else 0) for u, new in zip(every, begins, strict=True))]
    lengths = [0, *accumulate(len(u.text) for u in every)]
    blank = [0, *accumulate((k + 1 if not u.text else 0 for k, u in enumerate(every)), max)]  # a blank unit ends what is repeated

    def before(first: int) -> int:
        """Where the running sum must count from for a chunk that starts with this unit, which shows its message's head."""
        return ends[first] + 2 - (0 if begins[first] else len(heads[every[first].mi]))

    bounds, first, n = [], 0, len(every)
    while first < n:
        stop = max(bisect_right(ends, size + before(first)) - 1, bounds[-1][1] + 1 if bounds else 1)
        bounds.append((first, stop))
        if stop == n:
            break
        again = max(bisect_left(lengths, lengths[stop] - overlap), blank[stop], first)
        first = next(k for k in range(again, stop + 1) if k == stop or ends[stop + 1] <= size + before(k))
    out = []
    for k, (i, j) in enumerate(bounds or [(0, 0)]):
        shown = [heads[u.mi] + u.text if begins[at] or at == i else u.text for at, u in enumerate(every[i:j], i)]
        out.append({"index": k, "text": "\n\n".join(shown), "spans": [{"mi": u.mi, "s": u.s, "e": u.e} for u in every[i:j] if u.e > u.s], "truncated": any(u.cut for u in every[i:j])})
    for mi, (_, body) in enumerate(messages):  # gaps between paragraphs belong to the first chunk
        at = 0
        for s, e in [*sorted((x["s"], x["e"]) for c in out for x in c["spans"] if x["mi"] == mi), (len(body), len(body))]:
            if s > at:
                out[0]["spans"].append({"mi": mi, "s": at, "e": s})
            at = max(at, e)
    return out


def chunked(records: DataFrame, size: int = CHUNK, overlap: int = OVERLAP) -> DataFrame:
    """The keys of each record, its title, and one row for each chunk."""
    ship(records.sparkSession)
    size, overlap = limits(size, overlap)

    def run(messages: pd.Series) -> pd.Series:
        return messages.map(lambda ms: chunk([(m["role"], m["content"]) for m in ms], size, overlap))

    names = [*_keys(records), "title"]
    rows = records.select(*names, "messages", F.pandas_udf(run, CHUNKS)("messages").alias("chunks"))
    return rows.select(*names, F.explode("chunks").alias("c")).select(*names, "c.*")


class Chunks:
    """The rows of the table function: a conversation's chunks; null messages are an empty conversation."""

    def eval(self, messages: list | None, size: int | None, overlap: int | None) -> Iterator[tuple]:
        size, overlap = limits(CHUNK if size is None else size, OVERLAP if overlap is None else overlap)
        for c in chunk([(m["role"] or "", m["content"] or "") for m in messages or []], size, overlap):
            yield c["index"], c["text"], [(x["mi"], x["s"], x["e"]) for x in c["spans"]], c["truncated"]


def register_chunks(spark: SparkSession, name: str = "chunks") -> None:
    """Makes ``chunks(messages, size, overlap)`` a table function of SQL, for ``FROM records, LATERAL chunks(messages, 1200, 200)``.

    Its columns are chunk, text, spans and truncated; a null size or overlap takes the default.
    """
    ship(spark)
    spark.udtf.register(name, F.udtf(Chunks, returnType=CHUNK_ROW))


def _keys(rows: DataFrame) -> list[str]:
    """What tells records apart, and their platform; ids may be missing or repeat, so ``row_key`` goes along where it is."""
    return [*(["row_key"] if "row_key" in rows.columns else []), "record_id", "platform"]


def judge_all(chunks: DataFrame, judge: Callable | None, tries: int = 2, found: DataFrame | None = None, concurrency: int = 1, wait: float = 1.5, store: str | None = None, rounds: int = 8) -> DataFrame:
    """Every chunk judged for every judged category: record_id, platform, taxonomy_id, index, reply, error, calls and tokens.

    ``judge`` takes a category's name and a prompt and returns JSON, alone or with the tokens of prompt and
    reply; ``concurrency`` calls at a time run where the chunks are. After an exception it waits ``wait``
    seconds for each attempt so far; after a reply without JSON it asks for nothing but JSON. Categories of
    which ``found``, the static findings, has one of a record with ``STRONG`` confidence are not asked about;
    they, and all categories where there is no judge, have the error ``skipped``.

    ``store`` is a folder of replies by the hash of category and prompt. What is there is not asked for again, equal
    prompts are asked once, and each of ``rounds`` rounds adds its replies as soon as it is done: a run that is
    repeated after it died asks only for what its last round had not written. Failures are asked for again.
    Calls and tokens are those of a stored reply's first asking.
    """
    ids = [*_keys(chunks), "taxonomy_id", "index"]
    tasks = chunks.crossJoin(F.broadcast(judged(chunks.sparkSession).select(F.col("id").alias("taxonomy_id"), "name")))
    title = F.concat(F.lit("Title: "), F.coalesce("title", F.lit("")), F.lit("\n\n"))
    prompt = F.concat(title, "text", F.when(F.col("index") > 0, F.format_string("\n\n(part %d of the conversation)", F.col("index") + 1)).otherwise(""))
    tasks = tasks.select(*ids, "name", prompt.alias("prompt"))
    whole = chunks.select(*ids[:-2], "index", prompt.alias("prompt"))  # one row for each chunk, with all categories
    skipped = tasks if judge is None else None
    if judge is not None and found is not None:
        one = "row_key" if "row_key" in found.columns and "row_key" in ids else "record_id"
        strong = found.groupBy(one, "taxonomy_id").agg(F.max("confidence").alias("most")).where(F.col("most") >= STRONG)
        skipped = tasks.join(strong, [one, "taxonomy_id"], "left_semi")
        tasks = tasks.join(strong, [one, "taxonomy_id"], "left_anti")

    def ask(name: str, prompt_: str) -> tuple:
        reply, error, spent, n = None, None, [0, 0], 0
        for n in range(1, tries + 1):
            try:
                got = judge(name, prompt_ if n == 1 or error != NO_JSON else f"{prompt_}\n\nReply with one JSON object and nothing else.")
                reply, *tokens = got if isinstance(got, tuple) else (got,)
                spent = [a + b for a, b in zip(spent, tokens or (0, 0), strict=True)]
                error = None if "{" in reply else NO_JSON
                if error is None:
                    break
            except Exception as e:  # noqa: BLE001  a judge's failure is a result, not the task's
                reply, error = None, str(e)[:300] or type(e).__name__
                if n < tries:
                    time.sleep(wait * n)
        return reply, error, n, *spent

    def asked(names: list[str]) -> Callable:
        def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            with ThreadPoolExecutor(concurrency) as pool:
                for b in batches:
                    got = list((map if concurrency == 1 else pool.map)(ask, b["name"], b["prompt"]))  # a thread's hand-over takes longer than a quick judge
                    yield pd.concat([b[names], pd.DataFrame(got, columns=["reply", "error", "calls", "prompt_tokens", "completion_tokens"], index=b.index)], axis=1)

        return run

    zero = F.lit(0).cast("long")
    left_out = None if skipped is None else skipped.select(*ids, F.lit(None).cast("string").alias("reply"), F.lit("skipped").alias("error"), zero.alias("calls"), zero.alias("prompt_tokens"), zero.alias("completion_tokens"))
    if judge is None:
        return left_out
    if store is None and found is None:
        every = [tuple(r) for r in judged(chunks.sparkSession).select("id", "name").collect()]  # a fixed table

        def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            ask_all = asked(ids)
            for b in batches:
                for k in range(0, len(b), 100):  # a chunk's text is sent once and is the same object for all categories
                    rows = b.iloc[k : k + 100].loc[lambda x: x.index.repeat(len(every))].reset_index(drop=True)
                    n = len(rows) // len(every)
                    yield from ask_all([rows.assign(taxonomy_id=[c for c, _ in every] * n, name=[c for _, c in every] * n)])

        replies = whole.mapInPandas(run, ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in tasks.select(*ids).schema) + f", {REPLY}")
    elif store is None:
        replies = tasks.mapInPandas(asked(ids), ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in tasks.select(*ids).schema) + f", {REPLY}")
    else:
        replies = _stored(tasks, ids, asked(["key"]), store, rounds)
    return replies if left_out is None else replies.unionByName(left_out)


def _stored(tasks: DataFrame, ids: list[str], ask: Callable, store: str, rounds: int) -> DataFrame:
    """The replies to all tasks, from the store or asked for now and put there."""
    spark = tasks.sparkSession
    schema = f"key string, {REPLY}"
    tasks = tasks.withColumn("key", F.sha2(F.concat_ws("\u0000", "taxonomy_id", "prompt"), 256))
    once = tasks.select("key", "name", "prompt").dropDuplicates(["key"])
    spark.createDataFrame([], schema).write.mode("append").parquet(store)  # so that there is something to read
    for k in range(rounds):
        known = spark.read.schema(schema).parquet(store).where("error is null").select("key")
        new = once.where(F.pmod(F.xxhash64("key"), rounds) == k).join(known, "key", "left_anti")
        new.mapInPandas(ask, schema).write.mode("append").parquet(store)
    fields = [f.split()[0] for f in REPLY.split(", ")]
    best = spark.read.schema(schema).parquet(store).groupBy("key").agg(F.max_by(F.struct(*fields), F.col("error").isNull()).alias("r"))
    return tasks.join(best, "key").select(*ids, "r.*")


def usage(replies: DataFrame) -> DataFrame:
    """One row: calls, prompt_tokens and completion_tokens of all replies."""
    return replies.agg(*(F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in ("calls", "prompt_tokens", "completion_tokens")))


def verdicts(replies: DataFrame) -> DataFrame:
    """Replies with their verdict: the outermost braces' JSON, all four fields present; otherwise ``error``."""
    v = F.from_json(F.regexp_extract("reply", r"(?s)\{.*\}", 0), VERDICT)
    whole = v["hit"].isNotNull() & v["confidence"].isNotNull() & v["evidence"].isNotNull() & v["reasoning"].isNotNull()
    return replies.withColumn("v", v).withColumn("error", F.coalesce("error", F.when(~F.coalesce(whole, F.lit(False)), "incomplete verdict")))


def judged_findings(judged_: DataFrame, records: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(findings, statuses) of a judge's verdicts, one finding for a record and category at most.

    The most confident hit counts, the first chunk among equals; more than one hit raises it by 15 %, to at
    most 0.98. A category with a failed chunk has no finding. Evidence is placed in the one message that holds it.
    """
    keys = _keys(judged_) if "row_key" in records.columns else ["record_id", "platform"]
    one = keys[0]
    g = judged_.groupBy(*keys, "taxonomy_id").agg(
        F.count_if(F.col("error").isNotNull()).alias("failed"), F.count_if(F.col("error") == "skipped").alias("skipped"), F.count("*").alias("n_chunks"), F.count_if(F.col("v.hit")).alias("n_hits"),
        F.max_by("v", F.when(F.col("v.hit"), F.struct("v.confidence", -F.col("index")))).alias("best"),
    )
    status = g.select(*keys[:-1], "taxonomy_id", F.when(F.col("skipped") == F.col("n_chunks"), "skipped").when(F.col("failed") == 0, "ok").when(F.col("failed") == F.col("n_chunks"), "failed").otherwise("partial").alias("status"))
    c = F.least(F.greatest(F.col("best.confidence"), F.lit(0.1)), F.lit(1.0))
    c = F.when(F.col("n_hits") > 1, F.least(c * 1.15, F.lit(0.98))).otherwise(c)
    hit = g.where("failed = 0 and n_hits > 0").withColumn("confidence", c).join(records.select(one, "messages"), one)
    holds = F.transform("messages", lambda m: F.when(F.col("best.evidence") != "", F.position(F.col("best.evidence"), m["content"])).otherwise(0))
    only = F.when(F.size(F.filter(holds, lambda p: p > 0)) == 1, F.array_position(F.transform(holds, lambda p: p > 0), True).cast("int") - 1)
    start = F.get(holds, only) - 1
    found = hit.withColumns({"message_index": only, "char_start": start}).select(
        *keys, F.lit("llm").alias("detector"), F.lit("llm").alias("family"), F.lit("M-12").alias("rule"), F.lit(1 << 50).alias("seq"), "taxonomy_id", F.lit("LLM-1").alias("pattern_id"), "confidence",
        F.lit("judge verdict").alias("message"), (F.col("confidence") <= 0.5).alias("needs_review"), "message_index", F.get("messages", F.col("message_index"))["role"].alias("role"), "char_start", (F.col("char_start") + F.length("best.evidence")).alias("char_end"),
        F.substring("best.evidence", 1, 200).alias("matched_text"), F.lit(None).cast("string").alias("snippet"),
        F.to_json(F.struct("n_chunks", "n_hits", F.substring("best.reasoning", 1, 300).alias("reasoning"), F.when(only.isNull(), "unresolved").otherwise("located").alias("location_status"))).alias("evidence"),
    )
    return found, status
