"""The category dimension: 49 rows, and views on it."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# fixed values: id, name, status, tracks, whether a judge looks for it
CATEGORIES = [
    ("A-C-1", "Identity information disclosure", "implemented", "static/llm", True),
    ("A-C-2", "Sensitive privacy disclosure", "implemented", "static/llm", True),
    ("A-C-3", "Credential leakage", "implemented", "static/llm", True),
    ("A-C-4", "Technical information leakage", "implemented", "static/llm", True),
    ("A-C-5", "Digital footprint leakage", "implemented", "static/llm", True),
    ("A-C-6", "High-risk personal safety information", "implemented", "llm/static", True),
    ("A-I-1", "Jailbreak showcase", "implemented", "static/llm", True),
    ("B-C-1", "System prompt disclosure", "implemented", "static/llm", True),
    ("B-C-2", "External resource tracking (viewer de-anonymization)", "implemented", "static/dynamic/llm", True),
    ("B-C-3", "Model distillation/extraction via public shares", "skipped", "platform/llm", False),
    ("B-C-4", "Preview-triggered SSRF", "implemented", "static/llm", True),
    ("B-C-5", "XML external entity injection (XXE)", "implemented", "static/llm/platform", True),
    ("B-C-6", "Cross-site leaks (XS-Leaks)", "candidate", "static/llm/platform", True),
    ("B-I-1", "Harmful content hosting/distribution", "implemented", "static/llm", True),
    ("B-I-2", "AI search results manipulation (GEO)", "implemented", "static/llm", True),
    ("B-I-3", "Traditional SEO manipulation", "implemented", "static/llm", True),
    ("B-I-4", "Share preview card forgery (OpenGraph/oEmbed)", "phase2_dynamic", "static/llm", True),
    ("B-I-5", "Media provenance forgery (C2PA)", "future_work", "static/metadata", False),
    ("B-I-6", "Mutable share TOCTOU mismatch", "future_work", "dynamic/metadata", False),
    ("B-I-7", "Moderation classifier evasion (obfuscation)", "implemented", "static/llm", True),
    ("B-I-8", "False factual claims", "implemented", "llm/static", True),
    ("B-I-9", "Misleading summaries", "implemented", "llm/static", True),
    ("B-I-10", "Harmful decision advice", "implemented", "llm/static", True),
    ("B-A-1", "Application-layer resource exhaustion", "skipped", "platform/llm", False),
    ("B-A-2", "Complex content rendering exhaustion", "implemented", "static/dynamic/llm", True),
    ("B-A-3", "Regex denial of service via crafted content", "implemented", "static/llm", True),
    ("B-A-4", "Decompression/media bombs", "implemented", "static/metadata/llm", True),
    ("B-CI-1", "Image/cross-modal prompt injection", "candidate", "static", False),
    ("B-CI-2", "Zero-width/Bidi hidden-character injection", "implemented", "static/llm", True),
    ("B-CI-3", "Trusted-domain phishing/social engineering", "implemented", "static/llm", True),
    ("B-CI-4", "Hyperlink anchor-text spoofing", "implemented", "static/llm", True),
    ("B-CI-5", "Open redirect", "implemented", "static/dynamic/llm", True),
    ("B-CI-6", "Reverse tabnabbing", "candidate", "static/platform", False),
    ("B-CI-7", "Embedded malicious QR codes (quishing)", "implemented", "static/llm", True),
    ("B-CI-8", "Cross-session persistent memory poisoning", "implemented", "static/llm/platform", True),
    ("B-IA-1", "Enterprise RAG/knowledge-base poisoning", "implemented", "static/llm/platform", True),
    ("B-IA-2", "Passive cross-site state changes via share pages", "implemented", "static/llm", True),
    ("B-IA-3", "Base-model training data poisoning", "future_work", "llm", False),
    ("B-IA-4", "Share links as C2 dead drops", "candidate", "static/llm/platform", True),
    ("B-IA-5", "Archive path traversal (zip slip)", "candidate", "static/metadata/llm", False),
    ("B-CIA-1", "Natural-language instruction hijacking (direct prompt injection)", "implemented", "static/llm/dynamic", True),
    ("B-CIA-2", "AI-summary-driven social engineering", "implemented", "static/llm", True),
    ("B-CIA-3", "Stored XSS in shared content", "implemented", "static/llm/platform", True),
    ("B-CIA-4", "CSV/formula injection via tables", "implemented", "static/llm", True),
    ("B-CIA-5", "Terminal ANSI escape injection", "implemented", "static/llm", True),
    ("B-CIA-6", "Server-side template injection (SSTI)", "candidate", "static/llm/platform", True),
    ("B-CIA-7", "Insecure deserialization", "skipped", "static/platform", False),
    ("B-CIA-8", "Shared custom assistant/GPT configuration trojan", "implemented", "static/llm", True),
    ("B-CIA-9", "Malicious/imitation dependency recommendation", "implemented", "static/llm", True),
]


def categories(spark: SparkSession) -> DataFrame:
    """id, name, status, tracks, judged, and ``place`` in the list."""
    rows = [(i, n, s, t.split("/"), j, k) for k, (i, n, s, t, j) in enumerate(CATEGORIES)]
    return spark.createDataFrame(rows, "id string, name string, status string, tracks array<string>, judged boolean, place int")


def coverage(spark: SparkSession) -> DataFrame:
    """Who can test each category."""
    local = F.arrays_overlap("tracks", F.array(F.lit("static"), F.lit("llm")))
    note = (
        F.when(F.array_contains("tracks", "platform") & ~local, "platform only: logs and servers that outsiders do not see")
        .when(F.array_contains("tracks", "dynamic") & ~local, "needs a sandbox, or fetching and following addresses; optional for outsiders")
        .when(F.col("status") == "future_work", "possible for outsiders, with means that are not built yet")
        .when(F.col("status") == "skipped", "left out: no feature to detect, or its payload is not in the text")
        .otherwise("outsiders, by rules or a judge")
    )
    return categories(spark).select("id", "name", F.array_join("tracks", "/").alias("tracks"), "status", note.alias("who_can_test"))


def judged(spark: SparkSession) -> DataFrame:
    """The categories that a judge looks for."""
    return categories(spark).where("judged and status <> 'skipped'")
