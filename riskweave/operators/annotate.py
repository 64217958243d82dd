"""Findings of all static rules: one array for each record, no shuffle; then one row for each finding."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from riskweave.functions import rx
from riskweave.functions import text as tx
from riskweave.functions.scan import FLAGS, HELPERS, RAW, scanned
from riskweave.plans import rules as R

from .context import located, with_context

HIT = "struct<rule:string,n:int,pos:int,m:string,up:boolean,evidence:string>"
NO_HITS = f"cast(array() as array<{HIT}>)"
MIXED = f"(?<![{rx.WORD}])(?=[{rx.WORD}]*\\p{{IsLatin}})(?=[{rx.WORD}]*[\\p{{IsCyrillic}}\\p{{IsGreek}}])[{rx.WORD}]+"


def _has(text: Column, pattern: str, flags: str = "i") -> Column:
    return text.rlike(rx.java(pattern, flags))


def _like(text: str, pattern: str, flags: str = "i") -> str:
    return f"{text} rlike {rx.quoted(rx.java(pattern, flags))}"


def _near(before: int, after: int) -> str:
    return f"substring(text, greatest(h.pos - {before}, 0) + 1, h.pos + {after} - greatest(h.pos - {before}, 0))"


_ENTROPY = "aggregate(array_distinct(split(h.m, '')), 0.0d, (e, c) -> e - if(c = '', 0.0d, (length(h.m) - length(replace(h.m, c, ''))) / length(h.m) * log2((length(h.m) - length(replace(h.m, c, ''))) / length(h.m))))"
_PLAIN = {"base64": "try_to_binary(concat(h.m, repeat('=', pmod(-length(h.m), 4))), 'base64')", "hex": "try_to_binary(left(h.m, length(h.m) - pmod(length(h.m), 2)), 'hex')"}
_DECODED = {k: f"regexp_extract(translate(make_valid_utf8(cast({v} as string)), '\ufffd', ''), {rx.quoted(rx.java(R.DECODED))}, 0)" for k, v in _PLAIN.items()}
_OWN = ", ".join(f"'{d}'" for d in R.AI_DOMAINS)
_LOOKALIKES = f"(length(h.m) - length(translate(h.m, '{R.LOOKALIKE}', '')))"
#: Further tests of a match ``h``, by name.
TESTS = {
    "luhn": "luhn_check(h.m)", "entropy": f"{_ENTROPY} > 4.5", "handle": f"not {_near(200, 0)} rlike {rx.quoted(f'(?:://|www[.])[{rx.SPACE}]*$')}",
    "noopener": f"not {_like('h.m', 'rel=[\"' + chr(39) + '][^\"' + chr(39) + ']*noopener')}",
    "near_link": f"exists(links, x -> abs(x.pos - h.pos) < 400 and not exists(array({_OWN}), d -> x.host = d or endswith(x.host, concat('.', d))))",
    "table": _like(_near(200, 200), R.TABLE_CONTEXT), "table_from_2": f"h.pos >= 2 and {_like(_near(200, 200), R.TABLE_CONTEXT)}",
    "base64": f"coalesce({_DECODED['base64']}, '') <> ''", "hex": f"coalesce({_DECODED['hex']}, '') <> ''",
}
#: Tests that raise a match's confidence.
RAISED = {"jailbreak_done": _like("substring(text, h.pos + length(h.m) + 1, 500)", R.JAILBREAK_DONE), "danger": _like("h.m", R.TEMPLATE_DANGER), "two_marks": "marks >= 2", "two_lookalikes": f"{_LOOKALIKES} >= 2"}
EVIDENCE = {
    "entropy": f"to_json(named_struct('entropy', bround({_ENTROPY}, 2), 'length', length(h.m)))", "mixed_script": f"to_json(named_struct('homoglyphs', {_LOOKALIKES}))", "hide": "to_json(named_struct('char', hex(encode(h.m, 'UTF-16BE'))))",
    **{k: f"to_json(named_struct('decoded_hit', left({v}, 80)))" for k, v in _DECODED.items()},
}


#: Rules whose further test Java's script properties make; they are matched there, on texts with such scripts.
NATIVE = {r.id for r in R.RULES if r.only == "mixed_script"}


def _by_rule(values: dict[str, str], rest: str) -> str:
    """A SQL value for the hit ``h`` by its rule; ``values`` are by rule, rules with one value share a branch."""
    branches: dict[str, list[str]] = {}
    for rule, value in values.items():
        branches.setdefault(value, []).append(f"'{rule}'")
    cases = " ".join(f"when h.rule in ({', '.join(rules)}) then {value}" for value, rules in branches.items())
    return f"case {cases} else {rest} end" if cases else rest


def _shown(rule: R.Rule) -> str:
    """What a finding shows of its match."""
    m = "''" if rule.only == "hide" else f"left(h.m, {rule.cut})" if rule.cut else "h.m"
    if rule.only in ("ellipsis", "base64", "hex"):
        m = f"concat({m}, '…')"
    return f"replace({m}, '\x1b', r'\\e')" if rule.pattern == "PS-4" else m


def text_hits(rules: list[R.Rule]) -> Column:
    """Array of the text rules' hits from the columns raw, text, links, marks: further tests, cuts and evidence on matches only."""
    own = "array()" if not any(r.id in NATIVE for r in rules) else f"slice(transform(if(mixed, {rx.matches_sql('text', MIXED)}, cast(array() as {rx.MATCHES})), (x, n) -> named_struct('rule', 'U-4', 'n', n, 'pos', x.pos, 'm', x.m)), 1, {R.BY_ID['U-4'].cap})"
    keep = _by_rule({r.id: TESTS[r.only] for r in rules if r.only in TESTS}, "true")
    shown = _by_rule({r.id: _shown(r) for r in rules if _shown(r) != "h.m"}, "h.m")
    up = _by_rule({r.id: RAISED[r.raised] for r in rules if r.raised in RAISED}, "false")
    evidence = _by_rule({r.id: EVIDENCE[r.only] for r in rules if r.only in EVIDENCE}, "cast(null as string)")
    raw = f"concat(filter(raw, h -> not h.rule rlike '^[#!]'), cast({own} as {RAW}))"
    return F.expr(f"transform(filter({raw}, h -> {keep}), h -> named_struct('rule', h.rule, 'n', h.n, 'pos', h.pos, 'm', {shown}, 'up', {up}, 'evidence', {evidence}))")


def _counted(helper: str) -> Column:
    return F.size(F.filter("raw", lambda h: h["rule"] == helper))


def _flag(name: str) -> Column:
    """Whether the scan has flagged a text for a native rule; the rule's own expression goes over flagged texts only."""
    return F.exists("raw", lambda h: h["rule"] == name)


def _hit(rule: str, n: Column | None = None, pos: Column | None = None, m: Column | None = None, up: Column | None = None, evidence: Column | None = None) -> Column:
    """A hit; without ``pos`` it is about the record as a whole."""
    null = F.lit(None)
    fields = {"rule": F.lit(rule), "n": F.lit(0) if n is None else n, "pos": null.cast("int") if pos is None else pos, "m": F.lit("") if m is None else m, "up": F.lit(False) if up is None else up, "evidence": null.cast("string") if evidence is None else evidence}
    return F.struct(*(c.alias(k) for k, c in fields.items())).cast(HIT)


def _one(when: Column, rule: str, **more: Column) -> Column:
    """An array with one hit where ``when`` holds, else an empty one."""
    return F.when(F.coalesce(when, F.lit(False)), F.array(_hit(rule, **more))).otherwise(F.expr(NO_HITS))


def _json(**fields: Column) -> Column:
    return F.to_json(F.struct(*(c.alias(k) for k, c in fields.items())))


# fixed values: rules that are no scans of the text: taxonomy, pattern, confidence, raised to, review, and the message, a field of the reported finding
OTHER = {
    "B-1": ("B-A-2", "AB-1", 0.7, None, False, "Oversized content volume"), "B-2": ("B-A-2", "AB-1", 0.4, None, True, "Large content volume"),
    "B-3": ("B-A-2", "AB-1", 0.5, None, True, "Deeply nested structure"), "B-4": ("B-A-2", "AB-1", 0.5, None, True, "Oversized table row"),
    "B-8": ("B-A-3", "AB-2", 0.7, None, False, "Long repeated prefix"), "B-9": ("B-A-4", "AB-3", 0.75, None, False, "Extreme low compression ratio"),
    "B-10": ("B-A-4", "AB-3", 0.45, None, True, "Low compression ratio (candidate)"), "B-11": ("B-A-4", "AB-3", 0.6, None, False, "Massive entity-reference repetition"),
    "B-12": ("B-A-4", "AB-3", 0.4, None, True, "Archive attachment (size needs manual verification)"), "B-15": ("B-IA-5", "AB-5", 0.8, None, True, "Attachment filename contains path-traversal marker"),
    "L-1": ("B-CI-4", "LA-1", 0.85, None, False, "Anchor-text domain mismatches target domain"), "L-2": ("B-CI-5", "LA-2", 0.6, None, True, "Open-redirect parameter pattern"),
    "L-4": ("B-C-2", "LA-4", 0.45, None, True, "External resource reference (potential tracking/de-anonymization)"), "L-5": ("B-C-4", "LA-5", 0.6, 0.8, True, "Internal/cloud-metadata endpoint URL"),
    "G-1": ("B-CI-1", "CI1-1", 0.5, None, True, "Structured image reference in assistant answer pipeline"), "G-2": ("B-CI-1", "CI1-1", 0.35, 0.4, True, "Image URL referenced in message content"),
    "G-4": ("B-CI-1", "CI1-2", 0.65, None, True, "forensic anomaly"),
    "E-1": ("B-I-2", "SEO-1", 0.5, None, True, "Keyword stuffing"), "E-2": ("B-I-2", "SEO-2", 0.5, None, True, "Citation markers without a reference list (candidate)"),
    "E-3": ("B-I-2", "SEO-2", 0.45, None, True, "Dense authority-impersonation wording (candidate)"), "E-4": ("B-I-3", "SEO-3", 0.55, None, True, "Promo wording co-occurring with external links (candidate)"),
    "E-5": ("B-I-3", "SEO-3", 0.5, None, True, "High-frequency external links to one domain (candidate)"),
    "C-1": ("B-CIA-9", "SC-1", 0.55, 0.7, True, "Suspected typosquat package"), "C-2": ("B-CIA-9", "SC-2", 0.45, None, True, "Install command co-occurring with social-engineering wording (candidate)"),
    "U-3": ("B-CI-2", "UH-1", 0.85, None, False, "Tag characters (can hide ASCII instructions)"), "U-5": ("B-I-7", "UH-2", 0.7, None, False, "Mixed-script words occurring en masse"),
    "U-6": ("B-I-7", "UH-3", 0.8, None, False, "Injection keyword exposed after normalization"),
}
FAMILY_OF = {"B": "dos_abuse", "H": "harmful_jailbreak", "I": "injection_signatures", "L": "link_analysis", "S": "payload_structures", "P": "pii", "E": "seo_abuse", "G": "stego_imagery", "C": "supply_chain", "Y": "system_prompt_leak", "U": "unicode_hidden"}
#: Rules whose raised findings need no review.
SETTLED = {"U-4", "C-1", "L-5"}


def catalogue_rows() -> list[tuple]:
    """All rules: rule, family, taxonomy_id, pattern_id, confidence, raised_to, review, message, place in the order of findings, settled."""
    rows = [(r.id, r.family, r.taxonomy, r.pattern, r.confidence, r.raised_to or r.confidence, r.review, r.message) for r in R.RULES]
    rows += [(k, FAMILY_OF[k[0]], t, p, c, c if up is None else up, rev, m) for k, (t, p, c, up, rev, m) in OTHER.items()]
    rows.sort(key=lambda r: (R.FAMILIES.index(r[1]), int(r[0].split("-")[1])))
    return [(*r, k, r[0] in SETTLED) for k, r in enumerate(rows)]


def catalogue(spark: SparkSession) -> DataFrame:
    """All rules as a table, with the columns of ``catalogue_rows``."""
    return spark.createDataFrame(catalogue_rows(), "rule string, family string, taxonomy_id string, pattern_id string, confidence double, raised_to double, review boolean, message string, place int, settled boolean")


def abuse(text: Column) -> list[Column]:
    """Volume, depth, tables, repeated prefixes, compression, entities and attachments."""
    ends = "\n\r\x0b\x0c\x1c-\x1e\x85\u2028\u2029"
    lines = F.split(text, f"\r\n|[{ends}]")
    pipes = lambda x: F.length(x) - F.length(F.replace(x, F.lit("|"), F.lit("")))
    refs = F.regexp_extract_all(text, F.lit(rx.java(r"&\w+;")), F.lit(0))
    chars, ratio, far = F.col("chars"), F.col("ratio_of_long"), F.when(_flag("#repeats"), tx.repeated_prefix(text))
    archive = F.filter("attachments", lambda a: F.lower(F.coalesce(a["file_type"], F.lit(""))).rlike("zip|gzip|rar|7z|tar"))
    escape = F.filter("attachments", lambda a: F.coalesce(a["file_name"], F.lit("")).rlike(r"""(?:^|[/\\])\.\.(?:[/\\]|$)|(?:^|["'/])/(?:etc|usr|var|root|home|tmp)/|\bsymlink\s*->"""))
    packed = _json(ratio=ratio, chars=chars)
    return [
        _one(chars >= R.SIZE_HIGH, "B-1", evidence=_json(chars=chars)), _one((chars >= R.SIZE_WARN) & (chars < R.SIZE_HIGH), "B-2", evidence=_json(chars=chars)),
        _one(_flag("#deep") & text.rlike(f"(?:^|[{ends}])[ >\t]{{{R.DEPTH_WARN}}}"), "B-3"), _one(_flag("#bars") & F.exists(lines, lambda x: pipes(x) >= R.COLUMNS_WARN), "B-4"), _one(far >= 20_000, "B-8", evidence=_json(longest_repeat=far)),
        _one((chars > 10_000) & (ratio < 0.01), "B-9", evidence=packed), _one((chars > 10_000) & (ratio >= 0.01) & (ratio < 0.05), "B-10", evidence=packed),
        _one(_flag("#refs") & (F.size(refs) > 2_000) & (F.size(F.array_distinct(refs)) < 10), "B-11"),
        F.transform(archive, lambda a, n: _hit("B-12", n, evidence=F.to_json(a))), F.transform(escape, lambda a, n: _hit("B-15", n, evidence=F.to_json(a))),
    ]


def link_rules(text: Column) -> list[Column]:
    """Rules on each link: spoofed anchor, redirect, internal address, foreign resource, image address."""
    root = lambda h: F.substring_index(h, ".", -2)
    domain = r"(?i)(?:https?://)?([a-z0-9-]+(?:\.[a-z0-9-]+)+)"
    shown = lambda x: F.lower(F.regexp_extract(x["anchor"], domain, 1))
    start = lambda x: F.substring(x["url"], 1, 120)
    role = lambda x: located(F.col("spans"), x["pos"])["role"]

    def every(rule: str, when, m, **more) -> Column:
        return F.transform(F.filter("links", when), lambda x, n: _hit(rule, n, x["pos"], m(x), **{k: f(x) for k, f in more.items()}))

    return [
        every("L-1", lambda x: x["kind"].isin("link", "html_link") & x["anchor"].rlike(domain) & (root(shown(x)) != root(x["host"])) & ~tx.under(x["host"], R.TRUSTED), lambda x: F.concat(F.lit("["), F.substring(x["anchor"], 1, 40), F.lit("]("), F.substring(x["url"], 1, 80), F.lit(")")), evidence=lambda x: _json(anchor_domain=shown(x), href_domain=x["host"])),
        every("L-2", lambda x: _has(x["url"], R.REDIRECT), start),
        every("L-5", lambda x: _has(x["url"], R.INTERNAL), start, up=lambda x: _has(tx.around(text, x["pos"], 300, 300), R.VISIT_LURE)),
        every("L-4", lambda x: (x["kind"] == "resource") & ~tx.under(x["host"], R.AI_DOMAINS), start, evidence=lambda x: _json(domain=x["host"], platform=F.col("platform"))),
        every("G-2", lambda x: x["path"].rlike(r"(?i)\.(png|jpg|jpeg|gif|webp|svg|bmp|ico)$"), lambda x: F.substring(x["url"], 1, 200), up=lambda x: role(x) == "ASSISTANT", evidence=lambda x: _json(link_kind=x["kind"])),
    ]


def search_rules(text: Column) -> list[Column]:
    """Keyword stuffing, citations, authority claims, promotion, anchor farms."""
    p = F.col("frequent_pair")
    foreign = F.filter("links", lambda x: ~tx.under(x["host"], R.OWN_PLATFORMS))
    promo = _counted("#promo")
    per = promo * 100 / (F.greatest(F.col("chars"), F.lit(1)) / 1000)
    hosts = F.transform(foreign, lambda x: x["host"])
    most = F.array_max(F.transform(F.array_distinct(hosts), lambda d: F.size(F.filter(hosts, lambda h: h == d))))
    return [
        _one((p["words"] > 100) & (p["n"] > 30) & (p["n"] / p["words"] > 0.02), "E-1", evidence=_json(bigram=F.concat_ws(" ", p["first"], p["second"]), count=p["n"], density=F.bround(p["n"] / p["words"], 4))),
        _one((_counted("#cites") >= 5) & ~_has(text, R.CITE_LIST, "im"), "E-2"), _one(_counted("#authority") >= 3, "E-3"),
        _one((promo >= 3) & ((per > 1.0) | (F.size(foreign) >= 5)), "E-4", evidence=_json(promo_words=promo, ext_links=F.size(foreign), per_1k_chars=F.bround(per, 2))),
        _one((F.size("links") >= 8) & (most >= 8), "E-5"),
    ]


def package_rules(text: Column) -> list[Column]:
    """Look-alike packages after install commands, and social engineering beside them."""
    installs = F.filter("raw", lambda h: h["rule"] == "#install")
    social = _counted("#social")

    def name(token: Column) -> Column:
        raw = F.element_at(F.split(token, f"[{rx.SPACE}]+"), -1)
        pkg = F.regexp_replace(F.trim(F.element_at(F.split(F.ltrim(raw, F.lit("@")), "@"), 1), F.lit("`\"'")), f"[^@{rx.WORD}/.-]", "")
        return F.when((F.length(pkg) >= 3) & ~F.contains(pkg, F.lit("/")) & ~pkg.isin(R.OFFICIAL), pkg)

    def nearest(pkg: Column) -> Column:
        official = F.array(*map(F.lit, R.OFFICIAL))
        return F.array_min(F.filter(F.transform(official, lambda o: F.struct(F.levenshtein(pkg, o, 2).alias("distance"), o.alias("official"))), lambda x: x["distance"] >= 0))

    def packages(h: Column) -> Column:
        tokens = F.regexp_extract_all(F.substring(text, h["pos"] + 1, F.lit(160)), F.lit(rx.java(R.PACKAGE, "i")), F.lit(0))
        named = F.filter(F.transform(tokens, name), lambda p: p.isNotNull())
        return F.filter(F.transform(named, lambda p: F.struct(p.alias("pkg"), nearest(p).alias("near"))), lambda x: x["near"].isNotNull())

    found = F.flatten(F.transform(installs, lambda h, n: F.transform(packages(h), lambda x: _hit("C-1", n, h["pos"], F.substring(h["m"], 1, 80), social > 0, _json(pkg=x["pkg"], nearest_official=x["near"]["official"], distance=x["near"]["distance"])))))
    first = F.get(installs, 0)
    return [F.when(F.size(installs) > 0, found).otherwise(F.expr(NO_HITS)), _one((social >= 2) & (F.size(installs) > 0), "C-2", pos=first["pos"], m=first["m"])]


def hidden_rules(text: Column) -> list[Column]:
    """Tag characters, mixed scripts in bulk, and keywords that appear when look-alikes are undone."""
    tags, strange = "[\\x{E0000}-\\x{E007F}]", f"[{R.ZERO_WIDTH}{R.LOOKALIKE}]"
    first = F.get(rx.matches(text, tags), 0)
    many = F.when(F.col("mixed"), F.regexp_count(text, F.lit(MIXED))).otherwise(0)
    bare = F.translate(F.regexp_replace(F.translate(text, R.ZERO_WIDTH, ""), tags, ""), R.LOOKALIKE, R.PLAIN)
    window = lambda h: F.substring(text, F.greatest(h["pos"] - 5, F.lit(0)) + 1, h["pos"] + F.length(h["m"]) + 5 - F.greatest(h["pos"] - 5, F.lit(0)))
    exposed = F.filter(rx.matches(bare, rx.java(R.KEYWORDS, "i")), lambda h: window(h).rlike(strange))
    return [
        _one(_flag("#tags"), "U-3", pos=first["pos"], evidence=_json(count=F.regexp_count(text, F.lit(tags)))), _one(many > 20, "U-5", pos=F.lit(0), evidence=_json(count=many)),
        F.when(_flag("#exposed") & text.rlike(strange), F.transform(exposed, lambda h, n: _hit("U-6", n, h["pos"], h["m"]))).otherwise(F.expr(NO_HITS)),
    ]


BY_FAMILY = {"dos_abuse": abuse, "link_analysis": link_rules, "seo_abuse": search_rules, "supply_chain": package_rules, "unicode_hidden": hidden_rules}


def annotate(records: DataFrame, families: Iterable[str] | None = None, only: Iterable[str] | None = None) -> DataFrame:
    """Records with their context and ``hits`` of the named families, or all; unknown names add nothing. ``only`` names text rules instead.

    A hit has its rule, its number within the rule, its position and text, whether it is raised, evidence,
    the text around it, and the message it is in. No shuffle; works on streams as well.
    """
    wanted = set(R.FAMILIES if families is None else families)
    text = F.col("text")
    rules = [r for r in R.RULES if r.family in wanted] if only is None else [R.BY_ID[x] for x in only]
    wanted = wanted if only is None else set()
    # template marks raise extraction requests; links, search and package rules count or locate helpers
    names = [r.id for r in rules if r.id not in NATIVE] + (list(HELPERS) if wanted & {"seo_abuse", "supply_chain"} else [])
    names += list(FLAGS) if wanted & {"dos_abuse", "unicode_hidden"} else ["#mixed"] if any(r.id in NATIVE for r in rules) else []
    marks = " or ".join(f"h.rule = '{r.id}'" for r in R.SYSTEM_PROMPT if r.pattern == "SPL-1")
    rows = with_context(records).withColumns({"raw": scanned("text", names), "ratio_of_long": tx.ratio_of_long("text", 10_000), "frequent_pair": tx.frequent_pair("text", 30)})
    rows = rows.withColumns({"mixed": _flag("#mixed"), "marks": F.expr(f"size(filter(raw, h -> {marks}))")})
    parts = [text_hits(rules)]
    for f, make in BY_FAMILY.items():
        if f in wanted or f == "link_analysis" and "stego_imagery" in wanted:
            parts += make(text)
    hits = F.concat(F.expr(NO_HITS), *parts)
    if only is None and wanted != set(R.FAMILIES):
        hits = F.filter(hits, lambda h: F.substring(h["rule"], 1, 1).isin([k for k, f in FAMILY_OF.items() if f in wanted]))
    rows = rows.withColumn("hits", hits)
    return rows.withColumn("hits", F.transform("hits", lambda h: F.struct(*(h[k].alias(k) for k in ("rule", "n", "pos", "m", "up", "evidence")), F.when(h["pos"].isNotNull(), tx.snippet(text, h["pos"])).alias("snippet"), F.when(h["pos"].isNotNull(), located(F.col("spans"), h["pos"])).alias("at"))))


def statuses(annotated: DataFrame, families: Iterable[str] | None = None) -> DataFrame:
    """One row for each record and family of annotated records: status ``ok``, or ``error`` with the first failed rule's error as detail."""
    keys = [c for c in ("row_key", "record_id", "platform") if c in annotated.columns]
    of = F.create_map(*(F.lit(x) for r in R.RULES for x in (r.id, r.family)))
    failed = F.transform(F.filter("raw", lambda h: h["rule"].startswith("!")), lambda h: F.struct(of[F.substring(h["rule"], 2, 9)].alias("family"), h["m"].alias("detail")))
    names = F.array(*map(F.lit, [f for f in R.FAMILIES if families is None or f in set(families)]))
    rows = annotated.select(*keys, failed.alias("failed")).select(*keys, "failed", F.explode(names).alias("family"))
    detail = F.get(F.filter("failed", lambda x: x["family"] == F.col("family")), 0)["detail"]
    return rows.select(*keys, "family", F.when(detail.isNull(), "ok").otherwise("error").alias("status"), detail.alias("detail"))


def findings(records: DataFrame, families: Iterable[str] | None = None, only: Iterable[str] | None = None) -> DataFrame:
    """One row for each finding before merging: a record's hits with their rules, which are a small broadcast table."""
    # an outer explode: for the plain one, Catalyst infers filters that evaluate all rules twice more
    keys = [c for c in ("row_key", "record_id", "platform") if c in records.columns]
    rows = annotate(records, families, only).select(*keys, F.explode_outer("hits").alias("h")).where("h is not null")
    rules = F.broadcast(catalogue(records.sparkSession))
    rows = rows.join(rules, F.col("h.rule") == F.col("rule"))
    raised = F.col("h.up")
    return rows.select(
        *keys, F.lit("static").alias("detector"), "family", "rule", (F.col("place").cast("long") * 1_000_000_000 + F.col("h.n")).alias("seq"), "taxonomy_id", "pattern_id",
        F.when(raised, F.col("raised_to")).otherwise(F.col("confidence")).alias("confidence"), "message", (F.col("review") & ~(raised & F.col("settled"))).alias("needs_review"),
        F.col("h.at.message_index").alias("message_index"), F.col("h.at.role").alias("role"), F.col("h.pos").alias("char_start"), (F.col("h.pos") + F.length("h.m")).alias("char_end"), F.substring("h.m", 1, 200).alias("matched_text"), F.col("h.snippet").alias("snippet"), F.col("h.evidence").alias("evidence"),
    )
