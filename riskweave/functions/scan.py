"""One pass over a text for many rules: each rule's matches with their positions, as one Arrow UDF.

Rules are in groups. One RE2 pass over a batch tells for each group which texts may hold a match of its rules
(``QUICK``); on the others none of them is tried. Of the rest, a rule is tried only on texts that hold one of its pieces
(``rules.NEEDS``), and some only after a cheap test that all its matches pass. The patterns are those of the
catalogue, in the notation of Python's ``re``.
"""

from __future__ import annotations

import re
from collections.abc import Callable
from functools import cache, lru_cache
from itertools import islice
from operator import eq

import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column
from pyspark.sql import functions as F

from riskweave.plans import rules as R

RAW = "array<struct<rule:string,n:int,pos:int,m:string>>"
#: Patterns that are only counted or located, not rules by themselves: name, pattern, pieces.
HELPERS = {
    "#authority": (R.AUTHORITY, ["根据", "来源", "according to", "based on", "权威", "官方", "exclusive", "内幕", "insider"]),
    "#cites": (R.CITES, ["["]), "#promo": (R.PROMO, [R.HAN, "promo code", "coupon", "best ", "discount", "limited time offer", "buy now", "order now", "click here"]),
    "#install": (R.INSTALL, ["install", "add", "npm"]), "#social": (R.SOCIAL, ["install", "add", "npm"]),  # these words matter beside install commands only
}
_FOLDED = str.maketrans("ſı", "si")  # the letters that case folding brings to s and i
_HAN = re.compile("[⺀-鿿]")
_RUN, _DIGITS = 500, re.compile(r"\d{11}")


def _same_run(text: str, _: str) -> bool:
    """A run of twice ``_RUN`` equal characters holds a whole block of ``_RUN`` from a multiple of it on."""
    return any(text[i] * _RUN == text[i : i + _RUN] for i in range(0, len(text) - _RUN + 1, _RUN))


def _same_words(_: str, low: str) -> bool:
    """A word that follows itself 29 times is 28 equal neighbours, the first and last perhaps joined to other signs.

    Any 28 words in a row hold a place divisible by 14 with its follower, so those are looked at first.
    """
    if len(low) < 59 or not any(map(eq, (w := low.split())[::14], w[1::14])):
        return False
    run = 0
    for same in map(eq, w, islice(w, 1, None)):
        run = run + 1 if same else 0
        if run >= 27:
            return True
    return False


def _long_digits(text: str, _: str) -> bool:
    return _DIGITS.search(text) is not None


def _long_words(least: int) -> Callable[[str, str], bool]:
    return lambda text, _: len(text) >= least and max(map(len, text.split()), default=0) >= least


#: Tests that a text with a match of the rule passes, given the text and its lower-cased form.
GATES: dict[str, Callable[[str, str], bool]] = {
    "B-6": _same_words, "B-7": _same_run, "P-2": _long_digits, "P-4": _long_digits, "P-6": _long_digits,
    "P-16": _long_words(40), "B-13": _long_words(40), "B-14": _long_words(60),
}


#: Where a rule's pieces are frequent, RE2 patterns that a lower-cased text with a match holds: rules that share one, and the pattern. Where
#: white space or word edges of Python are meant, they take any sign that is no ASCII letter.
FINER = [
    (["H-2"], r"(?:^|[^a-z])dan(?:[^a-z]|$)"), (["H-5"], "restrict|without any|不受限|无限制"), (["S-6"], "on(?:error|load|click|mouseover|focus|animationstart|toggle)"),
    (["S-16"], r"[=+\-@][ \t]*(?:hyperlink|webservice|import|dde|cmd|powershell|https?:|file:|[a-z]{1,2}\$?[0-9]|r\[)"), (["I-21"], "env(?:ironment)?[^a-z]*(?:post|upload|send|发送|上传|传到)"),
    (["I-27"], "fetch|xmlhttprequest|navigator"), (["L-3"], "target=[\"']_blank"), (["S-1", "S-5"], "<!doctype|<script"), (["P-18"], "[0-9a-f]{2}:[0-9a-f]{2}:"), (["P-19"], "/(?:home|root|var|etc|opt|srv|usr)/"),
    (["B-16"], "(?:zip|tar|archive)[^a-z]*(?:x|extract|xf|rv)"), (["I-23"], "when (?:retrieved|indexed|searched|cited|rag)|for (?:future|subsequent) (?:retrieval|reference|rag|agent)"),
    (["Y-1", "Y-2"], "you are (?:claude|chatgpt|gpt|gemini|grok|deepseek|qwen|kimi|an? ai|a large language|(?:an? )?(?:helpful|harmless|innocent|expert|assistant))"), (["P-1", "P-21"], "@"), (["P-3"], r"\+"),
    (["P-15"], "(?:key|secret|token|password)[^a-z0-9]*[:=]"), (["#promo"], "promo code|coupon|best (?:price|deal)|discount|limited time offer|buy now|order now|click here"),
    (["P-20"], "[0-9a-f]{12}"), (["P-5"], "[eg][0-9]{8}"), (["P-2", "P-4", "P-6"], "(?:[0-9]|[^\\x00-\\x7f]){11}"), (["P-16", "B-13", "B-14"], "[a-z0-9+/]{40}"),
    (["U-1", "U-2"], f"[{R.ZERO_WIDTH}{R.BIDI}]"), (["S-20"], r"[\x{80}-\x{9f}]"),
]
_FINER = {rule: k for k, (rules, _) in enumerate(FINER) for rule in rules}
# Greek and Cyrillic letters, and Latin ones, with some others of their blocks
_STRANGE = f"[{R.ZERO_WIDTH}{R.LOOKALIKE}]"
_GREEK_CYRILLIC = "\u0370-\u052f\u1c80-\u1c8f\u1d00-\u1dff\u1f00-\u1fff\u2100-\u214f\u2de0-\u2dff\ua640-\ua69f\uab30-\uab6f\ufe20-\ufe2f\U00010140-\U000101af\U0001d200-\U0001d24f\U0001e030-\U0001e08f"
_LATIN = "A-Za-z\xaa\xba\xc0-\u02ff\u1d00-\u1dff\u1e00-\u1eff\u2000-\u2bff\u2c60-\u2c7f\ua700-\uabff\ufb00-\ufb06\uff00-\uffef\U00010780-\U000107bf\U0001df00-\U0001dfff"
_OTHERS, _LATINS, _KEYWORDS = re.compile(f"[{_GREEK_CYRILLIC}]"), re.compile(f"[{_LATIN}]"), re.compile(R.KEYWORDS, re.I)
_TAGS, _DEEP = "[\U000e0000-\U000e007f]", re.compile(r"[ >\t]{%d}" % R.DEPTH_WARN)
_HIDDEN = re.compile(f"{_TAGS}|[{R.ZERO_WIDTH}]")
_RARE = f"[{_GREEK_CYRILLIC}{_TAGS[1:-1]}{R.ZERO_WIDTH}{R.LOOKALIKE}{R.LOOKALIKE.lower()}]"
_BARE = str.maketrans(R.LOOKALIKE, R.PLAIN)


def _mixed(text: str) -> bool:
    return _OTHERS.search(text) is not None and any(_OTHERS.search(w) and _LATINS.search(w) for w in text.split())


def _exposed(text: str) -> bool:
    return re.search(_STRANGE, text) is not None and _KEYWORDS.search(_HIDDEN.sub("", text).translate(_BARE)) is not None


def _repeats(text: str, least: int = 20_000) -> bool:
    """Whether the longest repeated prefix, as ``text.repeated_prefix`` samples it, has ``least`` characters."""
    n = len(text)
    step = max(200, n // 200)
    halves = (s // 2 for s in range(step, min(n, 200_000) + 1, step) if s // 2 * 2 >= least)
    return any(text[:99] == text[h : h + 99] and text[:h] == text[h : 2 * h] for h in halves)


#: Tests of a text that all texts pass on which a native rule can find something; as helpers, they have one match of no text. Texts that a
#: test's RE2 pattern does not hit fail it.
FLAGS: dict[str, tuple[Callable[[str], bool], str]] = {
    "#deep": (lambda t: _DEEP.search(t) is not None, r"[ >\t]{%d}" % R.DEPTH_WARN), "#bars": (lambda t: t.count("|") >= R.COLUMNS_WARN, r"\|"), "#refs": (lambda t: t.count("&") > 2_000, "&"), "#repeats": (lambda t: len(t) >= 20_000 and _repeats(t), ""),
    "#tags": (lambda t: re.search(_TAGS, t) is not None, _RARE), "#exposed": (_exposed, _RARE), "#mixed": (_mixed, _RARE),
}


@cache
def _plan(names: tuple[str, ...]) -> list[tuple]:
    """(name, pattern, pieces, whether Chinese characters will do, gate, cap) of each rule; compiled once in a Python process."""
    out = []
    for name in names:
        if name in HELPERS:
            regex, needs, flags, cap = *HELPERS[name], "i", 0
        else:
            r = R.BY_ID[name]
            regex, needs, flags, cap = r.regex, R.NEEDS.get(name, []), r.flags, r.cap
        pattern = re.compile(regex, sum({"i": re.I, "m": re.M, "s": re.S}[f] for f in flags))
        out.append((name, pattern, [x for x in needs if x != R.HAN], R.HAN in needs, GATES.get(name), cap or None))
    return out


@cache
def _quick(names: tuple[str, ...]) -> list[tuple[str, list[str], list[str]]]:
    """Groups of rules: RE2 pattern for lower-cased texts, its rules, and those of them that Chinese characters will do for too."""
    groups: dict = {}
    for name in names:
        needs = HELPERS[name][1] if name in HELPERS else R.NEEDS.get(name, [])
        pieces = [x for x in needs if x != R.HAN]
        key = _FINER.get(name, name[0] if pieces else "han" if needs else "all")
        rules, held = groups.setdefault(key, ([], set()))
        rules.append((name, R.HAN in needs))
        held.update(pieces)
    out = []
    for key, (rules, pieces) in groups.items():
        pattern = FINER[key][1] if isinstance(key, int) else "" if key == "all" else "|".join(re.escape(x) for x in sorted(pieces)) or None
        out.append((pattern, [n for n, _ in rules], [n for n, h in rules if h]))
    return out


def _folded(text: str) -> str:
    low = text.lower()
    return low if low.isascii() else low.translate(_FOLDED) if "ſ" in low or "ı" in low else low


@lru_cache(4096)
def _tried(names: tuple[str, ...], groups: tuple[bool, ...], han: bool) -> tuple[str, ...]:
    """The rules to try on a text by the groups whose pattern it holds, in their order."""
    on = {n for hit, (_, rules, by_han) in zip(groups, _quick(names), strict=True) for n in (rules if hit else by_han if han else ())}
    return tuple(n for n in names if n in on)


def _held(texts: pa.Array, patterns: list[str | None]) -> list[list[bool]]:
    """Whether each pattern occurs in each text; the empty one does, None does not. What no pattern occurs in is told by one pass for all of them."""
    real = [p for p in patterns if p]
    some = pc.match_substring_regex(texts, "|".join(f"(?:{p})" for p in real)) if real else None
    few = texts.filter(some) if real else None
    places = pc.indices_nonzero(some).to_pylist() if real else []
    out = []
    for p in patterns:
        hits = [p == ""] * len(texts)
        if p:
            for k, hit in zip(places, pc.match_substring_regex(few, p).to_pylist(), strict=True):
                hits[k] = hit
        out.append(hits)
    return out


def scan_all(texts: list[str], names: tuple[str, ...]) -> list[list[tuple[str, int, int, str]]]:
    """``scan`` of each text."""
    rules = tuple(n for n in names if n not in FLAGS)
    lows = [_folded(t) for t in texts]
    column = pa.array(lows, pa.large_string())
    *hits, hans = _held(column, [pattern for pattern, _, _ in _quick(rules)] + [_HAN.pattern])
    hits = list(zip(*hits, strict=True)) or [()] * len(texts)
    found = []
    for text, low, groups, han in zip(texts, lows, hits, hans, strict=True):
        found.append(_scan(text, low, han, _tried(rules, groups, han)))
    flags = [n for n in names if n in FLAGS]
    for n, held in zip(flags, _held(column, [FLAGS[n][1] for n in flags]), strict=True):
        test, _ = FLAGS[n]
        for text, out, maybe in zip(texts, found, held, strict=True):
            if maybe and test(text):
                out.append((n, 0, 0, ""))
    return found


def scan(text: str, names: tuple[str, ...]) -> list[tuple[str, int, int, str]]:
    """(rule, number within the rule, position, match) of all matches, at most the rule's first ``cap``.

    A rule that fails on a text gives no matches but ``!`` and its name, with the error in place of a match.
    """
    return scan_all([text], names)[0]


def _scan(text: str, low: str, han: bool, names: tuple[str, ...]) -> list[tuple[str, int, int, str]]:
    out, seen = [], {}

    def held(piece: str) -> bool:
        if piece not in seen:
            seen[piece] = piece in low
        return seen[piece]

    for name, pattern, needs, by_han, gate, cap in _plan(names):
        try:
            if (needs or by_han) and not (by_han and han or any(map(held, needs))) or gate is not None and not gate(text, low):
                continue
            out += [(name, n, m.start(), m[0]) for n, m in enumerate(islice(pattern.finditer(text), cap))]
        except Exception as e:  # noqa: BLE001  a rule's failure is the record's status, not the task's
            out.append((f"!{name}", 0, 0, f"{type(e).__name__}: {e}"[:300]))
    return out


def scanned(text: str, names: list[str]) -> Column:
    """The matches of the named rules and helpers in a text column without nulls."""
    key = tuple(names)

    def run(texts: pd.Series) -> pd.Series:
        return pd.Series(scan_all(list(texts), key), index=texts.index, dtype=object)

    return F.pandas_udf(run, RAW)(text)
