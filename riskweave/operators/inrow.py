"""Merged findings and reports within a record's row: no shuffle, on streams as well as on tables.

The same rules as ``merge.merged`` for static findings, on the arrays that ``annotate`` and ``images`` give: sorted
copies and their neighbours stand for windows. What a judge finds is joined to the static findings by rows, so that
takes ``merge``.
"""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from riskweave.plans.taxonomy import CATEGORIES

from .annotate import annotate, catalogue_rows
from .context import with_context
from .images import with_image_hits
from .merge import KEEP

FIELDS = ["detector", "family", "rule", "taxonomy_id", "pattern_id", "confidence", "message", "needs_review", "message_index", "role", "char_start", "char_end", "matched_text", "snippet", "evidence"]

HIT_FIELDS = ["rule", "n", "pos", "m", "up", "evidence", "snippet", "at"]
IMAGE_HITS = "array<struct<rule:string,n:int,pos:int,m:string,up:boolean,evidence:string,snippet:string,at:struct<message_index:int,role:string>,message:string>>"


def _quoted(value) -> str:
    if isinstance(value, str):
        return "'" + value.replace("\\", "\\\\").replace("'", "\\'") + "'"
    return f"{value!r}d" if isinstance(value, float) else str(value).lower()


def _bound(name: str, value: str, body: str) -> str:
    """``body`` with ``name`` standing for a value that is worked out once."""
    return f"transform(array({value}), {name} -> {body})[0]"


def _rules() -> str:
    """Rules by id, as a constant map."""
    names = ["family", "taxonomy_id", "pattern_id", "confidence", "raised_to", "review", "message", "place", "settled"]
    rows = (f"{_quoted(rule)}, named_struct({', '.join(f'{_quoted(n)}, {_quoted(v)}' for n, v in zip(names, rest, strict=True))})" for rule, *rest in catalogue_rows())
    return f"map({', '.join(rows)})"


def _places(keep: int) -> str:
    """SQL for the reported findings of the column hits."""
    candidates = ", ".join(_quoted(c[0]) for c in CATEGORIES if c[2] == "candidate")
    part = lambda c: f"coalesce(cast({c} as string), 'None')"
    text = "left(h.m, 200)"
    print_ = f"left(sha1(cast(concat_ws('|', r.taxonomy_id, r.pattern_id, concat_ws(':', {part('h.at.message_index')}, {part('h.pos')}, {part('h.pos + length(h.m)')}), {text}) as binary)), 16)"
    values = {
        "detector": "'static'", "family": "r.family", "rule": "h.rule", "taxonomy_id": "r.taxonomy_id", "pattern_id": "r.pattern_id", "confidence": "if(h.up, r.raised_to, r.confidence)", "message": "coalesce(h.message, r.message)",
        "needs_review": f"(r.review and not (h.up and r.settled)) or r.taxonomy_id in ({candidates})", "message_index": "h.at.message_index", "role": "h.at.role", "char_start": "h.pos", "char_end": "h.pos + length(h.m)", "matched_text": text, "snippet": "h.snippet", "evidence": "h.evidence",
    }
    struct = ", ".join(f"'{k}', {values[k]}" for k in FIELDS)
    rows = f"transform(hits, h -> {_bound('r', f'element_at({_rules()}, h.rule)', f"named_struct('print', {print_}, 'seq', r.place * 1000000000L + h.n, {struct})")})"
    first = _bound("s", f"array_sort({rows})", "filter(s, (x, i) -> i = 0 or x.print <> s[i - 1].print)")
    kind = "named_struct('taxonomy_id', x.taxonomy_id, 'message_index', x.message_index, 'pattern_id', x.pattern_id)"
    kinds = f"array_sort(transform({first}, x -> named_struct('kind', {kind}, 'less', -x.confidence, 'seq', x.seq, 'x', x)))"
    rank = "size(filter(s, y -> y.kind <=> x.kind and (y.less < x.less or y.less = x.less and y.seq <= x.seq)))"  # for those kept only
    met = "array_min(transform(filter(s, y -> y.kind <=> x.kind), y -> y.seq))"
    spot = "coalesce(nullif(x.kind.message_index, 0), -1)"
    best = _bound("s", kinds, f"filter(transform(s, (x, i) -> if(i >= {keep} and x.kind <=> s[i - {keep}].kind, null, named_struct('taxonomy_id', x.kind.taxonomy_id, 'spot', {spot}, 'met', {met}, 'rank', {rank}, 'x', x.x))), x -> x is not null)")
    shown = ", ".join(f"'{k}', {'bround(x.x.confidence, 3)' if k == 'confidence' else f'x.x.{k}'}" for k in FIELDS)
    return f"transform(array_sort({best}), (x, i) -> named_struct('place', i + 1, {shown}))"


def with_findings(records: DataFrame, families: Iterable[str] | None = None, keep: int = KEEP, mirror_folder: str | None = None) -> DataFrame:
    """Records with ``findings``: what ``merged(all_findings(records, mirror_folder))`` reports of each, as an array in order.

    Image rules belong to the family stego_imagery; ``raw``, a record's JSON, is read for nested references where records have it.
    """
    families = None if families is None else set(families)
    rows = with_context(records)
    if families is None or "stego_imagery" in families:
        rows = with_image_hits(rows, mirror_folder)
    else:
        rows = rows.withColumn("image_hits", F.expr(f"cast(array() as {IMAGE_HITS})"))
    own = [c for c in records.columns if c not in ("hits", "findings")]
    rows = rows.withColumn("_own", F.struct(*own))  # annotate has working columns of the same names
    rows = annotate(rows, families).withColumn("hits", F.expr(f"concat(transform(hits, h -> named_struct({', '.join(f"'{c}', h.{c}" for c in HIT_FIELDS)}, 'message', cast(null as string))), image_hits)"))
    return rows.select("_own.*", F.expr(_places(keep)).alias("findings"))


def reports_in_rows(records: DataFrame, families: Iterable[str] | None = None, mirror_folder: str | None = None) -> DataFrame:
    """One row for each record, as ``reports`` has them."""
    rows = with_findings(records, families, mirror_folder=mirror_folder)
    return rows.select("record_id", "platform", "title", F.lit("complete").alias("scan_status"), F.size("findings").alias("finding_count"), F.size(F.filter("findings", lambda f: f["needs_review"])).cast("long").alias("needs_review_count"), "findings")
