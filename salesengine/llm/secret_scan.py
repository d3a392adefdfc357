"""Secret scans over an incremental blob ledger.

A repository of texts has many paths and versions but far fewer distinct
contents.  Every version is addressed by the SHA-256 of its text; a blob is
scanned for a rule only if the ledger has no row for (blob, rule, rule
version).  Findings are joined back to every path that has the blob.

Defined cases: a null text is the empty blob, which has no findings; a text in
many rows is scanned once; an empty table gives empty frames; columns beside
path, version and text are ignored, whatever their names.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from salesengine.session import reliable_checkpoint

LEDGER_SCHEMA = "blob binary, rule string, rule_version int, spans array<struct<start:int,end:int>>"


@dataclass(frozen=True)
class Rule:
    """A kind of secret.  ``version`` rises with every change of the pattern, so old ledger rows stop counting.

    A match counts if its group ``value_group`` has at least ``min_value`` characters.
    """

    name: str
    pattern: str
    version: int = 1
    value_group: int = 0
    min_value: int = 1
    any_case: bool = False

    def compiled(self) -> re.Pattern:
        return re.compile(self.pattern, re.ASCII | (re.IGNORECASE if self.any_case else 0))


BASE_RULES = (
    Rule("assign", r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", value_group=2, min_value=8, any_case=True),
    # runs are maximal, so a minimum in the pattern drops the same matches as a check of their length
    Rule("access", r"AKIA[A-Z0-9]{12,}"),
    Rule("hex", r"(?<![0-9a-f])[0-9a-f]{32,}"),
)
EXTRA_RULES = (
    Rule("pem", r"-----BEGIN (?:[A-Z]+ )*PRIVATE KEY-----"),
)


def addressed(versions: DataFrame) -> DataFrame:
    """(path, version, blob): the content address of every version, in the shared folder so texts are hashed once."""
    return reliable_checkpoint(versions.select("path", "version", F.unhex(F.sha2(F.coalesce("text", F.lit("")), 256)).alias("blob")))


def unseen(addresses: DataFrame, rules: tuple[Rule, ...], ledger: DataFrame | None) -> DataFrame:
    """(blob, todo array<string>, path, version): the rules each blob lacks in the ledger, and one version that has its text."""
    blobs = addresses.groupBy("blob").agg(F.min(F.struct("path", "version")).alias("at"))
    todo = F.array(*(F.struct(F.lit(r.name).alias("rule"), F.lit(r.version).alias("rule_version")) for r in rules))
    pairs = blobs.select("blob", "at", F.explode(todo).alias("t")).select("blob", "at", "t.rule", "t.rule_version")
    if ledger is not None:
        pairs = pairs.join(ledger.select("blob", "rule", "rule_version").distinct(), ["blob", "rule", "rule_version"], "left_anti")
    return pairs.groupBy("blob", "at").agg(F.collect_list("rule").alias("todo")).select("blob", "todo", "at.path", "at.version")


def _scanner(rules: tuple[Rule, ...]):
    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        compiled = {r.name: (r, r.compiled()) for r in rules}
        for batch in batches:
            out: dict[str, list] = {"blob": [], "rule": [], "rule_version": [], "spans": []}
            for blob, todo, text in zip(*(batch.column(c) for c in ("blob", "todo", "text")), strict=True):
                blob, text = blob.as_py(), text.as_py() or ""
                for name in todo.as_py():
                    rule, pattern = compiled[name]
                    out["blob"].append(blob)
                    out["rule"].append(name)
                    out["rule_version"].append(rule.version)
                    out["spans"].append([{"start": m.start(), "end": m.end()} for m in pattern.finditer(text) if len(m[rule.value_group]) >= rule.min_value])
            yield pa.RecordBatch.from_arrays([
                pa.array(out["blob"], pa.binary()), pa.array(out["rule"], pa.string()), pa.array(out["rule_version"], pa.int32()),
                pa.array(out["spans"], pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))),
            ], names=list(out))
    return scan


def scan(versions: DataFrame, rules: tuple[Rule, ...] = BASE_RULES + EXTRA_RULES, ledger: DataFrame | None = None, addresses: DataFrame | None = None) -> DataFrame:
    """Ledger rows (``LEDGER_SCHEMA``) for the blob and rule-version pairs of ``versions`` that ``ledger`` lacks.

    ``versions`` has path, version, text.  Spans are code points, end exclusive, leftmost and not overlapping per rule.
    """
    addresses = addressed(versions) if addresses is None else addresses
    at = unseen(addresses, rules, ledger)
    texts = versions.select("path", "version", F.coalesce("text", F.lit("")).alias("text"))
    same = F.col("v.path").eqNullSafe(F.col("a.path")) & F.col("v.version").eqNullSafe(F.col("a.version"))
    # repeated (path, version) rows may hold different texts: only the one with the address counts
    found = (texts.alias("v").join(at.alias("a"), same)
             .where(F.unhex(F.sha2("v.text", 256)) == F.col("a.blob"))
             .select("a.blob", "a.todo", "v.text")
             .mapInArrow(_scanner(rules), LEDGER_SCHEMA))
    return found.dropDuplicates(["blob", "rule", "rule_version"])


def findings(addresses: DataFrame, ledger: DataFrame, rules: tuple[Rule, ...] = BASE_RULES + EXTRA_RULES) -> DataFrame:
    """(path, version, blob, found array<struct<start,rank,rule,end>>): ledger spans of the rules' versions, on every path.

    Spans are in order of start, then of the rules as listed; paths without a finding have an empty array.
    """
    ranks = F.create_map(*(x for i, r in enumerate(rules) for x in (F.lit(r.name), F.lit(i))))
    versions = F.create_map(*(x for r in rules for x in (F.lit(r.name), F.lit(r.version))))
    hits = ledger.where((F.size("spans") > 0) & (F.col("rule_version") == versions[F.col("rule")]))
    spans = F.transform("spans", lambda s: F.struct(s["start"].alias("start"), ranks[F.col("rule")].alias("rank"), F.col("rule").alias("rule"), s["end"].alias("end")))
    by_blob = hits.groupBy("blob").agg(F.array_sort(F.flatten(F.collect_list(spans))).alias("found"))
    empty = F.expr("cast(array() as array<struct<start:int,rank:int,rule:string,end:int>>)")
    return (addresses.select("path", "version", "blob").join(by_blob, "blob", "left")
            .select("path", "version", "blob", F.coalesce("found", empty).alias("found")))
