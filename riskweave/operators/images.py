"""Image references in nested message fields, mirrored image files, and a screening of decoded pixels."""

from __future__ import annotations

import hashlib
import json
import re
import struct
import zlib
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from riskweave.functions import rx
from riskweave.functions import text as tx
from riskweave.plans import rules as R
from riskweave.session import ship

from .annotate import OTHER, catalogue, findings

REFS = "array<struct<value:string,kind:string,path:string,message_index:int,role:string>>"
REPORT = "width int, height int, near_bg_ratio double, near_bg_struct double, lsb_pairs int, lsb_chi_mean double, lsb_balance_z double, verdict boolean"
# fixed values: fields that are walked, and limits of the screening
WALKED, LONGEST = ("extra", "fragments", "platform_extra"), 4096
NEAR, RATIO, STRUCTURE, EDGE, EXTENSIONS = 10.0, 0.5, 0.12, 16, [".png", ".jpg", ".jpeg", ".webp", ".gif", ".bmp"]
# fixed values: messages, a field of the reported finding
NESTED_URI, NESTED_LINK, LAYER = "Data-URI image within message structure", "Image reference within message structure", "low-contrast structured text layer (microtext signal)"
_URI = re.compile(R.DATA_URI, re.I)


def _reference(uri: Column) -> Column:
    return F.when(uri, NESTED_URI).otherwise(NESTED_LINK)


def _strings(value, path: str) -> Iterator[tuple[str, str]]:
    """Every string below a JSON value with its path, in the order of the document."""
    todo = [(path, value)]
    while todo:
        at, v = todo.pop()
        if isinstance(v, dict):
            todo += [(f"{at}.{k}", x) for k, x in reversed(v.items())]
        elif isinstance(v, list):
            todo += [(f"{at}[{k}]", x) for k, x in reversed(list(enumerate(v)))]
        elif isinstance(v, str) and len(v) < LONGEST:
            yield at, v


def refs_of(raw: str | None) -> list[dict]:
    """Image addresses and data URIs in a record's nested message fields, the first of each value."""
    try:
        record = json.loads(raw or "null")
    except ValueError:
        return []
    if not isinstance(record, dict):
        return []
    inner = record.get("content") if isinstance(record.get("content"), dict) else {}
    messages = [m for box in (record.get("messages"), inner.get("messages")) if isinstance(box, list) for m in box if isinstance(m, dict)]
    found: dict[str, dict] = {}
    for k, m in enumerate(messages):
        for key in WALKED:
            for path, s in _strings(m.get(key), f"messages[{k}].{key}"):
                kind = "data_uri" if _URI.fullmatch(s.strip()) else None
                if not kind and s.startswith(("http://", "https://")) and (a := tx.address(s)) and a[2].lower().endswith(tuple(R.IMAGE_ENDS)):
                    kind = "url"
                if kind:
                    s = s.strip() if kind == "data_uri" else s
                    found.setdefault(s, {"value": s, "kind": kind, "path": path, "message_index": k, "role": str(m.get("role") or "").upper()})
    return list(found.values())


def _keys(rows: DataFrame) -> list[str]:
    return [c for c in ("row_key", "record_id", "platform") if c in rows.columns]


def structured_refs(parsed: DataFrame) -> DataFrame:
    """row_key (if there is one), record_id, platform and one row for each reference in records with their raw JSON; ``n`` is its place in the record."""
    ship(parsed.sparkSession)

    def each(raw: pd.Series) -> pd.Series:
        return raw.map(refs_of)

    refs = F.pandas_udf(each, REFS)
    return parsed.select(*_keys(parsed), refs("raw").alias("r")).select(*_keys(parsed), F.posexplode("r").alias("n", "r")).select(*_keys(parsed), "n", "r.*")


def mirror(spark: SparkSession, folder: str, urls: DataFrame) -> DataFrame:
    """url and content of the addresses (url) whose image lies in the folder as sha1(url) and an extension, the first by ``EXTENSIONS``."""
    files = spark.read.format("binaryFile").load(folder).select(F.regexp_extract("path", r"([0-9a-f]{40})(\.[a-z]+)$", 1).alias("key"), F.array_position(F.array(*map(F.lit, EXTENSIONS)), F.regexp_extract("path", r"(\.[a-z]+)$", 1)).alias("rank"), "content")
    best = files.where("key <> '' and rank > 0").groupBy("key").agg(F.min_by("content", "rank").alias("content"))
    return urls.select("url").distinct().withColumn("key", F.sha1(F.col("url").cast("binary"))).join(best, "key").select("url", "content")


def pixels(data: bytes) -> np.ndarray | None:
    """Grey or RGB samples of an 8-bit PNG that is not interlaced; None for what else it may be."""
    if not data or data[:8] != b"\x89PNG\r\n\x1a\n":
        return None
    at, head, body = 8, None, b""
    try:
        while at + 8 <= len(data):
            n, kind = struct.unpack(">I4s", data[at : at + 8])
            part = data[at + 8 : at + 8 + n]
            if kind == b"IHDR":
                head = struct.unpack(">IIBBBBB", part)
            elif kind == b"IDAT":
                body += part
            at += n + 12
        w, h, depth, colour, _, _, lace = head
        bands = {0: 1, 2: 3, 4: 2, 6: 4}[colour]
        if depth != 8 or lace or w * h > 1 << 26:
            return None
        raw = np.frombuffer(zlib.decompress(body), np.uint8).reshape(h, 1 + w * bands)
    except (struct.error, TypeError, KeyError, ValueError, zlib.error):
        return None
    out = np.zeros((h, w * bands), np.uint8)
    above = np.zeros(w * bands, np.int64)
    for y in range(h):
        line, f = raw[y, 1:].astype(np.int64), raw[y, 0]
        if f == 2:
            line = (line + above) & 255
        elif f:
            for x in range(w * bands):
                a, c = (line[x - bands], above[x - bands]) if x >= bands else (0, 0)
                b = above[x]
                p = a + b - c
                pick = a if f == 1 else (a + b) // 2 if f == 3 else min((abs(p - a), 0, a), (abs(p - b), 1, b), (abs(p - c), 2, c))[2]
                line[x] = (line[x] + pick) & 255
        out[y], above = line, line
    image = out.reshape(h, w, bands)
    return image[:, :, :3] if bands > 2 else image[:, :, :1]


def screened(image: np.ndarray | None) -> tuple:
    """The columns of ``REPORT`` for an image; nulls where there is none."""
    if image is None:
        return (None,) * 8
    h, w, bands = image.shape
    grey = (image.astype(float) @ np.array([0.299, 0.587, 0.114])).round() if bands == 3 else image[:, :, 0].astype(float)
    near = np.abs(grey - np.percentile(grey, 90)) < NEAR
    struct_ = near[:, 1:] & (np.abs(np.diff(grey, axis=1)) > 0.5)
    ratio, texture = round(float(near.mean()), 4), round(float(struct_.mean()), 4) if struct_.size else 0.0
    pairs, chi, z = 0, None, None
    if min(w, h) >= EDGE:
        # one histogram by value pair and parity of the place; for two counts of one expectation, chi-square is (difference)^2 / sum
        first = image[:, :, 0].ravel()
        counts = np.bincount((first & 254) + (np.arange(first.size) & 1), minlength=256).reshape(128, 2)
        total = counts.sum(axis=1)
        enough = total >= 8
        if enough.sum() >= 8:
            each = np.diff(counts[enough], axis=1)[:, 0] ** 2 / total[enough]
            pairs, chi, z = len(each), round(float(each.mean()), 3), round(float((each.sum() - len(each)) / np.sqrt(2 * len(each))), 2)
    return w, h, ratio, texture, pairs, chi, z, ratio >= RATIO and texture >= STRUCTURE


def forensics(images: DataFrame) -> DataFrame:
    """Rows with a binary ``content`` and its screening; a row at a time, so that one image is held at once."""
    ship(images.sparkSession)
    keys = [c for c in images.columns if c != "content"]
    names = [x.split()[0] for x in REPORT.split(", ")]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = pd.DataFrame([screened(pixels(bytes(c) if c is not None else b"")) for c in b["content"]], columns=names, index=b.index)
            yield pd.concat([b[keys], rows.astype({"width": "Int32", "height": "Int32", "lsb_pairs": "Int32", "verdict": "boolean"})], axis=1)

    own = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in images.schema if f.name != "content")
    return images.mapInPandas(run, f"{own}, {REPORT}")


def decoded(uri: Column) -> Column:
    """The bytes of a data URI, null if they are no base64."""
    return F.try_to_binary(F.substring_index(uri, ",", -1), F.lit("base64"))


def _mirrored(folder: str):
    """Arrow UDF from addresses to the bytes of their files in the folder, as ``mirror`` finds them; read in the task, so rows stay where they are."""
    from riskweave.sources.jsonlines import filesystem

    filesystem(folder)  # a scheme that pyarrow does not know fails here, not in a task

    def read(system, base: str, url: str) -> bytes | None:
        from pyarrow import fs

        key = hashlib.sha1(url.encode("utf-8", "surrogatepass")).hexdigest()
        for info in system.get_file_info([f"{base}/{key}{e}" for e in EXTENSIONS]):
            if info.type == fs.FileType.File:
                with system.open_input_file(info.path) as f:
                    return f.read()
        return None

    def each(urls: pd.Series) -> pd.Series:
        system, base = filesystem(folder)
        return urls.map(lambda u: [read(system, base.rstrip("/"), x) for x in u])

    return F.pandas_udf(each, "array<binary>")


def _screen(contents: pd.Series) -> pd.Series:
    names = [x.split()[0] for x in REPORT.split(", ")]
    return contents.map(lambda c: [dict(zip(names, screened(pixels(bytes(x) if x is not None else b"")), strict=True)) for x in c])


def with_image_hits(rows: DataFrame, mirror_folder: str | None = None) -> DataFrame:
    """Rows with context (text, links; perhaps ``raw``) and ``image_hits``: what ``image_findings`` finds in each, as hits with a message of their own.

    No join and no shuffle, on streams as well; the images of one record are held at once.
    """
    ship(rows.sparkSession)
    uris = F.regexp_extract_all("text", F.lit(rx.java(R.DATA_URI, "i")), F.lit(0))
    inline = F.when(F.col("text").rlike("(?i)data:image/"), uris).otherwise(F.array().cast("array<string>"))
    refs = F.pandas_udf(lambda raw: raw.map(refs_of), REFS)("raw") if "raw" in rows.columns else F.array().cast(REFS)
    ends = "|".join(e[1:] for e in R.IMAGE_ENDS)
    linked = F.filter(F.transform("links", lambda x, n: F.struct(n.alias("n"), x["url"].alias("value"), x["path"].alias("path"))), lambda x: F.lower(x["path"]).rlike(rf"\.({ends})$"))
    rows = rows.withColumns({"_refs": F.transform(refs, lambda r, n: F.struct(n.alias("n"), r.alias("r"))), "_linked": linked if mirror_folder else F.array().cast("array<struct<n:int,value:string,path:string>>")})
    files = _mirrored(mirror_folder)(F.transform("_linked", lambda x: x["value"])) if mirror_folder else F.array().cast("array<binary>")
    image = lambda n, value, content: F.struct(n.cast("int").alias("n"), value.alias("value"), content.alias("content"))
    nested = F.transform(F.filter("_refs", lambda x: x["r"]["kind"] == "data_uri"), lambda x: image(x["n"], x["r"]["value"], decoded(x["r"]["value"])))
    found = F.transform(F.arrays_zip("_linked", "_files"), lambda x: image(x["_linked"]["n"] + (1 << 20), x["_linked"]["value"], x["_files"]))
    within = F.transform(inline, lambda u, n: image(n + (2 << 20), u, decoded(u)))
    rows = rows.withColumn("_files", files).withColumn("_images", F.filter(F.concat(nested, found, within), lambda x: x["content"].isNotNull()))
    rows = rows.withColumn("_reports", F.when(F.size("_images") > 0, F.pandas_udf(_screen, f"array<struct<{REPORT.replace(' ', ':').replace(',:', ',')}>>")(F.transform("_images", lambda x: x["content"]))).otherwise(F.array()))

    def hit(rule: str, n: Column, value: Column, message: Column, *evidence: Column) -> Column:
        null = lambda t: F.lit(None).cast(t)
        fields = {"rule": F.lit(rule), "n": n.cast("int"), "pos": null("int"), "m": F.substring(value, 1, 120), "up": F.lit(False), "evidence": F.to_json(F.struct(*evidence)), "snippet": null("string"), "at": null("struct<message_index:int,role:string>"), "message": message}
        return F.struct(*(c.alias(k) for k, c in fields.items()))

    listed = F.transform("_refs", lambda x: hit("G-1", x["n"], x["r"]["value"], _reference(x["r"]["kind"] == "data_uri"), x["r"]["kind"].alias("ref_kind"), x["r"]["path"].alias("field_path"), x["r"]["message_index"].alias("message_index"), x["r"]["role"].alias("ref_role")))
    flagged = F.filter(F.arrays_zip("_images", "_reports"), lambda x: x["_reports"]["verdict"])
    shown = F.transform(flagged, lambda x: hit("G-4", x["_images"]["n"], x["_images"]["value"], F.lit(LAYER), x["_reports"].alias("forensics")))
    return rows.withColumn("image_hits", F.concat(listed, shown)).drop("_refs", "_linked", "_files", "_images", "_reports")


def image_findings(records: DataFrame, mirror_folder: str | None = None) -> DataFrame:
    """G-1 for each nested reference of records with ``raw``, and G-4 for each image whose pixels show a low-contrast layer.

    Screened are nested data URIs, the images of linked addresses that lie in ``mirror_folder``, and data URIs
    within the text, in this order. G-2 and G-3, the addresses and URIs in the text, are text rules.
    """
    spark, keys = records.sparkSession, _keys(records)
    place = {r["rule"]: r["place"] for r in catalogue(spark).where("rule in ('G-1', 'G-4')").collect()}  # two rows
    joined = rx.clean(F.array_join(F.transform("messages", lambda m: m["content"]), "\n\n")) if "messages" in records.columns else F.lit("")
    text = records.select(*keys, joined.alias("text"))
    inline = text.where(F.col("text").rlike("(?i)data:image/")).select(*keys, F.posexplode(F.regexp_extract_all("text", F.lit(rx.java(R.DATA_URI, "i")), F.lit(0))).alias("n", "value"))
    images = [inline.select(*keys, (F.col("n") + (2 << 20)).alias("n"), "value", decoded(F.col("value")).alias("content"))]
    parts = []
    null = lambda t, name: F.lit(None).cast(t).alias(name)

    def row(rows: DataFrame, rule: str, message: Column, evidence: list) -> DataFrame:
        _, pattern, confidence, _, review, _ = OTHER[rule]
        return rows.select(
            *keys, F.lit("static").alias("detector"), F.lit("stego_imagery").alias("family"), F.lit(rule).alias("rule"), (F.lit(place[rule]).cast("long") * 1_000_000_000 + F.col("n")).alias("seq"), F.lit(OTHER[rule][0]).alias("taxonomy_id"), F.lit(pattern).alias("pattern_id"),
            F.lit(confidence).alias("confidence"), message.alias("message"), F.lit(review).alias("needs_review"), null("int", "message_index"), null("string", "role"), null("int", "char_start"), null("int", "char_end"), F.substring("value", 1, 120).alias("matched_text"), null("string", "snippet"), F.to_json(F.struct(*evidence)).alias("evidence"),
        )

    if "raw" in records.columns:
        refs = structured_refs(records)
        uri = F.col("kind") == "data_uri"
        parts.append(row(refs, "G-1", _reference(uri), [F.col("kind").alias("ref_kind"), F.col("path").alias("field_path"), "message_index", F.col("role").alias("ref_role")]))
        images.append(refs.where(uri).select(*keys, "n", "value", decoded(F.col("value")).alias("content")))
    if mirror_folder:
        ends = "|".join(e[1:] for e in R.IMAGE_ENDS)
        linked = text.select(*keys, F.posexplode(tx.links("text")).alias("n", "l")).where(F.lower("l.path").rlike(rf"\.({ends})$")).select(*keys, (F.col("n") + (1 << 20)).alias("n"), F.col("l.url").alias("value"))
        files = mirror(spark, mirror_folder, linked.select(F.col("value").alias("url"))).withColumnRenamed("url", "value")
        images.append(linked.join(files, "value").select(*keys, "n", "value", "content"))
    flagged = forensics(reduce(DataFrame.unionByName, images).where("content is not null")).where("verdict")
    report = F.struct(*(x.split()[0] for x in REPORT.split(", ")))
    parts.append(row(flagged, "G-4", F.lit(LAYER), [report.alias("forensics")]))
    return reduce(DataFrame.unionByName, parts)


def all_findings(records: DataFrame, mirror_folder: str | None = None) -> DataFrame:
    """The findings of all static rules, images included."""
    return findings(records).unionByName(image_findings(records, mirror_folder))
