"""Columns on a record's text, and the few helpers that need Python, as Arrow UDFs."""

from __future__ import annotations

import re
import zlib
from collections import Counter
from itertools import pairwise
from urllib.parse import urlsplit

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

LINKS = "array<struct<url:string,host:string,path:string,anchor:string,kind:string,pos:int>>"


def around(text: Column, pos: Column, before: int, after: int) -> Column:
    """The text from ``before`` code points before a position (or its start) to ``after`` beyond."""
    start = F.greatest(pos - before, F.lit(0))
    return F.substring(text, start + 1, pos + after - start)


def snippet(text: Column, pos: Column) -> Column:
    """60 code points on either side, line ends written as backslash-n."""
    return F.replace(around(text, pos, 60, 60), F.lit("\n"), F.lit("\\n"))


def entropy(s: Column) -> Column:
    """Shannon entropy of a string's characters, in bits."""
    chars = F.split(s, "")
    n = F.length(s)
    share = lambda c: (n - F.length(F.replace(s, c, F.lit("")))) / n
    return F.aggregate(F.array_distinct(chars), F.lit(0.0), lambda a, c: a - F.when(share(c) > 0, share(c) * F.log2(share(c))).otherwise(0.0))


def repeated_prefix(text: Column) -> Column:
    """Longest prefix, among sampled sizes up to 200,000, whose two halves are equal."""
    n = F.length(text)
    step = F.greatest(F.lit(200), F.floor(n / 200).cast("int"))
    half = lambda s: F.floor(s / 2).cast("int")
    sizes = F.when(n >= step, F.sequence(step, F.least(n, F.lit(200_000)), step)).otherwise(F.array().cast("array<int>"))
    even = F.filter(sizes, lambda s: F.substring(text, 1, half(s)) == F.substring(text, half(s) + 1, half(s)))
    return F.coalesce(half(F.array_max(even)) * 2, F.lit(0))


def under(host: Column, domains: list[str]) -> Column:
    """Whether a host is one of the domains or below one."""
    return F.exists(F.array(*map(F.lit, domains)), lambda d: (host == d) | F.endswith(host, F.concat(F.lit("."), d)))


def compression_ratio(text: str) -> Column:
    """Deflated size over UTF-8 size, to four places; 1 for an empty text."""
    return F.pandas_udf(_ratio, "double")(text)


def top_pair(text: str) -> Column:
    """Number of words, and the most frequent pair of neighbours (the earliest among equals)."""
    return F.pandas_udf(_top_pair, "struct<words:int,first:string,second:string,n:int>")(text)


def ratio_of_long(text: str, least: int) -> Column:
    """``compression_ratio`` of texts with more than ``least`` characters, 1 for the others."""
    return F.pandas_udf(lambda texts: _ratio(texts.where(texts.str.len() > least, "")), "double")(text)


def frequent_pair(text: str, least: int) -> Column:
    """``top_pair`` of texts where that pair occurs more than ``least`` times; of the others 0, null, null, 0."""
    return F.pandas_udf(lambda texts: _frequent_pair(texts, least), "struct<words:int,first:string,second:string,n:int>")(text)


def links(text: str) -> Column:
    """The links of each text, the first of each address, by the order in ``FOUND_IN``."""
    return F.pandas_udf(_links, LINKS)(text)


def _ratio(texts: pd.Series) -> pd.Series:
    raw = texts.fillna("").map(lambda t: t.encode("utf-8", "replace"))
    return raw.map(lambda r: round(len(zlib.compress(r, 6)) / len(r), 4) if r else 1.0)


_WORDS = re.compile(r"[\w一-鿿]{2,}")
_BYTES = bytes(c if re.match(r"\w", chr(c)) else 32 for c in range(256))  # other signs become spaces


def _top_pair(texts: pd.Series) -> pd.DataFrame:
    rows = []
    for t in texts.fillna(""):
        w = _WORDS.findall(t.lower())
        (pair, n), *_ = Counter(pairwise(w)).most_common(1) or [((None, None), 0)]
        rows.append((len(w), *pair, n))
    return pd.DataFrame(rows, columns=["words", "first", "second", "n"])


def _split_words(low: str) -> list:
    """``_WORDS`` of a text with those of one sign among them; texts in Latin-1 are cut as bytes, which takes a fraction of the time."""
    try:
        return low.encode("latin-1").translate(_BYTES).split()
    except UnicodeEncodeError:
        return _WORDS.findall(low)


def _frequent_pair(texts: pd.Series, least: int) -> pd.DataFrame:
    """Both words of such a pair are frequent themselves, so only pairs of frequent words are counted."""
    rows = []
    for t in texts.fillna(""):
        w = _split_words(t.lower())
        often = {x for x, n in Counter(w).items() if n > least and len(x) > 1} if len(w) > least else ()
        w = [x for x in w if len(x) > 1] if often else ()
        (pair, n), *_ = Counter(p for p in pairwise(w) if p[0] in often and p[1] in often).most_common(1) or [(None, 0)]
        rows.append((len(w), *(x if isinstance(x, str) else x.decode("latin-1") for x in pair), n) if n > least else (0, None, None, 0))
    return pd.DataFrame(rows, columns=["words", "first", "second", "n"])


# fixed values: where links are found, in order of precedence (kind, pattern, groups of url and anchor)
FOUND_IN = [
    ("link", re.compile(r"\[([^\]]*)\]\((https?://[^\s)]+|www\.[^\s)]+)\)"), 2, 1),
    ("html_link", re.compile(r"""<a\s[^>]*href=["']([^"']+)["'][^>]*>(.*?)</a>""", re.I | re.S), 1, 2),
    ("resource", re.compile(r"""<(img|source|iframe|link|script|video|audio)\b[^>]*(?:src|href)=["']([^"']+)["']""", re.I), 2, 0),
    ("resource", re.compile(r"!\[[^\]]*\]\(([^)]+)\)"), 1, 0),
    ("raw", re.compile(r"""(?<!["'(\[])(https?://[^\s<>"')\]]+|www\.[^\s<>"')]+)"""), 1, 0),
]
TRAILING = ".,;:!?）)】」\"'"


def address(url: str) -> tuple[str, str, str] | None:
    """(url, host, path) of an HTTP address: host in lower case, no user, default port or fragment; None if it is none."""
    url = url.strip().rstrip(TRAILING)
    try:
        u = urlsplit(url if "://" in url else f"https://{url}")
        host, port = (u.hostname or "").lower(), u.port
    except ValueError:
        return None
    if u.scheme not in ("http", "https") or not host:
        return None
    at = host if port in (None, {"http": 80, "https": 443}[u.scheme]) else f"{host}:{port}"
    return u._replace(netloc=at, fragment="").geturl(), host, u.path


def _links(texts: pd.Series) -> pd.Series:
    out = []
    for t in texts.fillna(""):
        found: dict[str, dict] = {}
        if "http" in t or "www." in t or "<" in t or "](" in t:
            for kind, pattern, url, anchor in FOUND_IN:
                for m in pattern.finditer(t):
                    a = address(m[url])
                    if a and a[0] not in found:
                        name = re.sub(r"<[^>]+>", "", m[anchor]) if kind == "html_link" else m[anchor] if anchor else ""
                        found[a[0]] = {"url": a[0], "host": a[1], "path": a[2], "anchor": name.strip()[:120], "kind": kind, "pos": m.start()}
        out.append(list(found.values()))
    return pd.Series(out)
