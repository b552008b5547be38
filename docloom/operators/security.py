"""Governance: masking of personal data, prompt-injection rules, audit events, and the gate on remote calls."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import weave

#: Detectors of personal data in the order in which they are applied. Java reads classes and cases as Unicode with the flag U only.
DETECTORS = (
    ("CNPJ", r"(?U)\b\d{2}\.\d{3}\.\d{3}/\d{4}-\d{2}\b"),
    ("CPF", r"(?U)\b\d{3}\.\d{3}\.\d{3}-\d{2}\b"),
    ("EMAIL", r"(?U)\b[\w.+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}\b"),
    ("PHONE", r"(?U)\(\d{2}\)\s?9?\d{4,5}-\d{4}|\+55\s?\d{2}\s?9?\d{4,5}-?\d{4}|\b\d{2}\s9?\d{4,5}-\d{4}\b|(?i:(?:tel|telefone|fone|celular|whats|whatsapp)[^\d]{0,4})\d{10,11}\b"),
    ("RG", r"(?U)\b\d{1,2}\.\d{3}\.\d{3}-[\dXx]\b"),
    ("CEP", r"(?U)\b\d{5}-\d{3}\b|(?i:cep[^\d]{0,4})\d{8}\b"),
)
#: Rules against injected instructions.
INJECTIONS = (
    ("ignore_instructions", r"(?iU)\b(?:ignore|disregard|forget)\s+(?:(?:all|every|the|previous|prior|above|earlier|original)\s+){1,3}(?:instructions?|prompts?|context|messages?|rules?)"),
    ("ignore_instructions_pt", r"(?iU)\b(?:ignore|esqueça|desconsidere|despreze)\s+(?:(?:as?|todas?|todos?|os?|tudo)\s+)?(?:instru[cç][õo]es?|comandos?|regras?|prompts?|mensagens?)(?:\s+(?:acima|anteriores|originais?|prévia))?"),
    ("force_response", r"(?iU)\b(?:respond|reply|return|output|print|say)\s+(?:only|just|exclusively)(?:\s+(?:with|using|as))?\s*['\"`][^'\"`]{1,40}['\"`]"),
    ("force_response_pt", r"(?iU)\b(?:responda|retorne|imprima|escreva|diga)\s+(?:apenas|somente|exclusivamente|s[óo])(?:\s+(?:com|usando|como))?\s*['\"`][^'\"`]{1,40}['\"`]"),
    ("system_override", r"(?iU)\b(?:system|admin|root|developer|sudo)\s*[:=]\s*['\"`]?(?:override|bypass|disable|jailbreak|new\s+instructions?)"),
    ("role_hijack", r"(?iU)\byou\s+are\s+(?:now|actually|really)\s+(?:a|an)\s+\w+|\bact\s+as\s+(?:a|an)\s+\w+\s+who"),
    ("delimiter_injection", r"(?iU)<<<(?:UNTRUSTED|SYSTEM|ADMIN|END|STOP)[A-Z_]*>>>"),
)
SNIPPET = 80


class RemoteCallRefused(RuntimeError):
    """A provider was given although remote calls are switched off."""


class InjectionFound(ValueError):
    """A document holds an injected instruction, and the caller asked for rejection."""


def require_local(local_only: bool, provider: object | None) -> None:
    if local_only and provider is not None:
        raise RemoteCallRefused("local_only forbids a provider")


def _token(kind: str):
    return lambda x: F.concat(F.lit(f"<{kind}_"), F.lpad(F.array_position(F.col("_d"), x).cast("string"), 3, "0"), F.lit(">"))


def mask_pii(docs: DataFrame) -> DataFrame:
    """doc_id, masked, mask (token to original). Detectors run in turn over the text as masked so far; equal values share a token, numbered as first seen in the document.

    Staged by projections: each detector's matches are made once and woven into the gaps between them."""
    out = docs.select("doc_id", F.col("text").alias("masked"), F.create_map().cast("map<string,string>").alias("mask"))
    for name, pattern in DETECTORS:
        out = out.withColumn("_m", F.regexp_extract_all("masked", F.lit(pattern), 0)).withColumn("_d", F.array_distinct("_m"))
        token = _token(name)
        out = out.select("doc_id", F.when(F.size("_m") == 0, F.col("masked")).otherwise(weave(F.split("masked", pattern, -1), F.transform("_m", token))).alias("masked"),
                         F.map_concat("mask", F.map_from_arrays(F.transform("_d", token), F.col("_d"))).alias("mask"))
    return out


def unmask(masked: DataFrame) -> DataFrame:
    """doc_id, text: the originals put back, the longest token first."""
    entries = F.array_sort(F.map_entries("mask"), lambda a, b: F.length(b["key"]) - F.length(a["key"]))
    return masked.select("doc_id", F.aggregate(entries, F.col("masked"), lambda t, e: F.replace(t, e["key"], e["value"])).alias("text"))


def pii_counts(masked: DataFrame) -> DataFrame:
    """How many different values of each type a document holds: doc_id, type, n."""
    kinds = masked.select("doc_id", F.explode(F.map_keys("mask")).alias("_t"))
    return kinds.groupBy("doc_id", F.regexp_extract("_t", r"^<(.*)_\d+>$", 1).alias("type")).agg(F.count(F.lit(1)).alias("n"))


def injection_hits(docs: DataFrame, rules=INJECTIONS) -> DataFrame:
    """Every match of every rule: doc_id, rule, snippet (its first characters), position (from 0)."""
    before = lambda c, n: F.aggregate(F.slice(c, F.lit(1), n), F.lit(0), lambda a, x: a + F.char_length(x))
    found = []
    for name, pattern in rules:
        gaps, hits = F.split("text", pattern, -1), F.regexp_extract_all("text", F.lit(pattern), 0)
        one = lambda name, gaps, hits: lambda x, i: F.struct(F.lit(name).alias("rule"), F.left(x, F.lit(SNIPPET)).alias("snippet"), (before(gaps, i + 1) + before(hits, i)).alias("position"))
        found.append(F.transform(hits, one(name, gaps, hits)))
    return docs.select("doc_id", F.explode(F.concat(*found)).alias("h")).select("doc_id", "h.*")


def reject_injections(docs: DataFrame) -> DataFrame:
    """docs, or an InjectionFound error that names the rules when a document breaks any."""
    broken = [r["rule"] for r in injection_hits(docs).select("rule").distinct().collect()]  # as many rows as rules
    if broken:
        raise InjectionFound("injected instructions: " + ", ".join(sorted(broken)))
    return docs


def audit_hash(c: Column) -> Column:
    return F.sha2(c, 256)


def audit_events(docs: DataFrame, event: str, ts: Column, **extra: Column) -> DataFrame:
    """An event for each document with the hash of its content, never the content: append it to a JSON or Parquet table."""
    return docs.select(ts.cast("timestamp").alias("ts"), F.lit(event).alias("event"), audit_hash(F.col("text")).alias("doc_hash"), *[v.alias(k) for k, v in extra.items()])


def append_audit(events: DataFrame, path: str) -> None:
    events.write.mode("append").json(path)
