"""Regular expressions for Spark (Java) and DuckDB (RE2) from one notation, and matches with positions.

Rules are written once, in the notation of Python's ``re``. Its classes are Unicode-aware, while Java's and
RE2's are ASCII by default, so ``\\w``, ``\\d``, ``\\s`` and ``\\b`` are spelled out for each engine.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

WORD, DIGIT = r"\p{L}\p{N}_", r"\p{Nd}"
SPACE = r"\t\n\x0B\f\r\x1C-\x20\x85\xA0\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}"
EDGE = f"(?:(?<=[{WORD}])(?![{WORD}])|(?<![{WORD}])(?=[{WORD}]))"


def _spelled(pattern: str, edge: str | None) -> str:
    out, inside, i = [], False, 0
    while i < len(pattern):
        c = pattern[i]
        if c == "\\" and i + 1 < len(pattern):
            n = pattern[i + 1]
            i += 2
            if n in "wds":
                body = {"w": WORD, "d": DIGIT, "s": SPACE}[n]
                out.append(body if inside else f"[{body}]")
            elif n in "WDS":
                if inside:
                    raise ValueError(f"\\{n} in a class: {pattern}")
                out.append(f"[^{ {'W': WORD, 'D': DIGIT, 'S': SPACE}[n] }]")
            elif n == "b" and not inside:
                if edge is None:
                    raise ValueError("this engine cannot look around")
                out.append(edge)
            elif n in "\"'`/":
                out.append(n)
            else:
                out.append("\\" + n)
            continue
        if c == "[" and not inside:
            inside = True
            if pattern[i + 1 : i + 2] == "]" or pattern[i + 1 : i + 3] == "^]":
                raise ValueError(f"leading bracket in a class: {pattern}")
        elif c == "[" and inside:
            c = "\\["
        elif c == "]" and inside:
            inside = False
        elif c == "&" and inside:
            c = "\\&"
        out.append(c)
        i += 1
    return "".join(out)


def java(pattern: str, flags: str = "") -> str:
    """The pattern for Java. ``flags``: i (ignore case), m (line anchors), s (dot matches all)."""
    pattern = pattern.replace("(?i)", "")
    return f"(?d{'iu' if 'i' in flags else ''}{''.join(f for f in 'ms' if f in flags)})" + _spelled(pattern, EDGE)


def re2(pattern: str, flags: str = "") -> str | None:
    """The pattern for RE2, None if it looks around or back."""
    pattern = pattern.replace("(?i)", "")
    if any(x in pattern for x in ("(?=", "(?!", "(?<", "\\1")):
        return None
    try:
        body = _spelled(pattern, None)
    except ValueError:
        return None
    flags = "".join(f for f in "ims" if f in flags)
    return (f"(?{flags})" if flags else "") + body


S1, S2 = "﷐", "﷑"
MATCHES = "array<struct<pos:int,m:string>>"


def clean(text: Column) -> Column:
    """Text without the two noncharacters that ``matches`` uses as marks, one code point for one."""
    text = F.coalesce(text, F.lit(""))
    for mark in S1 + S2:  # a text without it is passed on as it is, while translate makes every text anew
        text = F.replace(text, F.lit(mark), F.lit("�"))
    return text


def matches(text: Column, pattern: str) -> Column:
    """All matches of a Java pattern in a cleaned text: array of (pos in code points from 0, m).

    Matches are marked by one replacement and cut out by one split; positions are running sums of lengths.
    """
    pieces = F.split(F.regexp_replace(text, F.lit(pattern), F.lit(f"{S1}$0{S2}")), S1)
    start = F.struct(F.lit(-1).alias("at"), F.array().cast(MATCHES).alias("out"))

    def step(acc: Column, piece: Column) -> Column:
        m = F.substring_index(piece, S2, 1)
        size = F.length(piece)
        return F.when(acc["at"] < 0, F.struct(size.alias("at"), acc["out"].alias("out"))).otherwise(
            F.struct((acc["at"] + size - 1).alias("at"), F.concat(acc["out"], F.array(F.struct(acc["at"].alias("pos"), m.alias("m")))).alias("out"))
        )

    found = F.aggregate(pieces, start, step, lambda acc: acc["out"])
    return F.when(text.rlike(pattern), found).otherwise(F.array().cast(MATCHES))


def quoted(pattern: str) -> str:
    """A Java pattern as a raw SQL literal."""
    return "r'" + pattern.replace("'", "\\x27") + "'"


def matches_sql(text: str, pattern: str) -> str:
    """``matches`` as SQL text: building a long list of rules this way takes one call each."""
    p = quoted(pattern)
    step = f"if(a.at < 0, named_struct('at', length(p), 'out', a.out), named_struct('at', a.at + length(p) - 1, 'out', concat(a.out, array(named_struct('pos', a.at, 'm', substring_index(p, '{S2}', 1))))))"
    return f"if({text} rlike {p}, aggregate(split(regexp_replace({text}, {p}, '{S1}$0{S2}'), '{S1}'), named_struct('at', -1, 'out', cast(array() as {MATCHES})), (a, p) -> {step}, a -> a.out), cast(array() as {MATCHES}))"
