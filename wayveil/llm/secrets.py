"""Secret scan with an incremental blob ledger.

Every version of every path is content-addressed by the SHA-256 of its text. The ledger is a table of (blob,
rule_version) pairs that were scanned, with their findings. A scan takes only the blobs that the ledger has not seen
under the present rules, reads each of them once, appends to the ledger and joins the findings back to all paths.

A rule version is a hash of the rules themselves. A null text counts as empty. Repeated rows each get a result row, and
their text is read once. A null path is a path like any other. Other columns are ignored. Positions are code points, end
exclusive; spans are ordered by start, then by kind in the order of KINDS. Every pattern takes time in proportion to the
text: a run of the characters of a web token is looked at once, from its first "eyJ" that enough characters follow.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import bounded_batches, cut

_FLAGS = re.ASCII
_WORD = "[A-Za-z0-9_-]"
#: Kind, pattern, the group that is measured, its least length. A group named "span" is the span, else the match.
KINDS = (
    ("assign", re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.ASCII | re.IGNORECASE), 2, 12),
    ("access", re.compile(r"AKIA[A-Z0-9]+", _FLAGS), 0, 18),
    ("hex", re.compile(r"[0-9a-f]{16,}", _FLAGS), 0, 16),  # runs are maximal, so the shorter ones need not be matched
    ("pem", re.compile(r"-----BEGIN [A-Z ]*PRIVATE KEY-----", _FLAGS), 0, 1),
    ("webtoken", re.compile(rf"(?<!{_WORD})(?>{_WORD}*?(?=eyJ{_WORD}{{8}}))(?P<span>{_WORD}++\.{_WORD}{{8,}}+\.{_WORD}++)", _FLAGS), 0, 1),
)
#: What every match of a kind holds; a text without it is not searched.
NEEDED = {"access": "AKIA", "pem": "PRIVATE KEY", "webtoken": "eyJ"}
#: Changes with the rules.
RULE_VERSION = hashlib.sha256(repr([(kind, p.pattern, int(p.flags), group, least) for kind, p, group, least in KINDS]).encode()).hexdigest()[:16]
BASE = ("assign", "access", "hex")
FINDINGS = "n_assign long, n_access long, n_hex long, base_sha256 string, spans string"


def scan_text(text: str | None) -> tuple[int, int, int, str, str]:
    """Counts of the base kinds, SHA-256 of their spans, and all spans as kind:start:end, joined by commas."""
    found, text = [], text or ""
    for order, (kind, pattern, group, least) in enumerate(KINDS):
        if NEEDED.get(kind, "") not in text:
            continue
        span = pattern.groupindex.get("span", 0)
        found += [(m.start(span), order, kind, m.end(span)) for m in pattern.finditer(text) if m.end(group) - m.start(group) >= least]
    found.sort()
    said = [(kind, f"{kind}:{start}:{end}") for start, _, kind, end in found]
    counts = [sum(kind == k for k, _ in said) for kind in BASE]
    base = ",".join(x for kind, x in said if kind in BASE)
    return *counts, hashlib.sha256(base.encode()).hexdigest(), ",".join(x for _, x in said)


def versions(table: DataFrame, path: str, text: str) -> DataFrame:
    """(path, blob, text): every version, content-addressed."""
    whole = F.coalesce(F.col(text).cast("string"), F.lit(""))
    return table.select(F.col(path).alias("path"), F.sha2(whole, 256).alias("blob"), whole.alias("text"))


def scan(history: DataFrame, ledger: DataFrame | None = None, rule_version: str = RULE_VERSION) -> DataFrame:
    """New ledger rows: (blob, rule_version, findings) of the blobs in history that the ledger lacks under these rules."""
    bounded_batches(history.sparkSession)
    # One text a blob leaves each task, so repeated rows, under one path or many, are neither sent nor read again.
    unseen = history.groupBy("blob").agg(F.first("text").alias("text"))
    if ledger is not None:
        unseen = unseen.join(ledger.where(F.col("rule_version") == rule_version).select("blob"), "blob", "left_anti")

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [scan_text(x) for x in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array([r[i] for r in rows], pa.int64() if i < 3 else pa.string()) for i in range(5))], names=["blob", "n_assign", "n_access", "n_hex", "base_sha256", "spans"])

    found = unseen.select("blob", "text").mapInArrow(read, f"blob string, {FINDINGS}")
    return found.withColumn("rule_version", F.lit(rule_version))


def _by_path(history: DataFrame, known: DataFrame, path: str, rule_version: str) -> DataFrame:
    """The findings of every row's path."""
    joined = history.select("path", "blob").join(known.where(F.col("rule_version") == rule_version).drop("rule_version"), "blob")
    return joined.select(F.col("path").alias(path), "blob", *[x.split()[0] for x in FINDINGS.split(", ")])


def scan_with_ledger(table: DataFrame, folder: str, path: str = "doc_id", text: str = "text") -> DataFrame:
    """Findings of every row's path; the ledger is kept as a Parquet table in `folder` and gets the new pairs only."""
    spark = table.sparkSession
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
    there = at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(at)
    ledger = spark.read.parquet(folder) if there else None
    history = versions(table, path, text)
    cut(scan(history, ledger)).write.mode("append").parquet(folder)
    return _by_path(history, spark.read.parquet(folder), path, RULE_VERSION)


def secret_scan(table: DataFrame, path: str = "doc_id", text: str = "text", ledger: DataFrame | None = None, rule_version: str = RULE_VERSION) -> tuple[DataFrame, DataFrame]:
    """(findings of every row's path, the ledger with the new pairs). Findings: path, blob and FINDINGS."""
    history = versions(table, path, text)
    new = cut(scan(history, ledger, rule_version))
    whole = new if ledger is None else ledger.select(*new.columns).unionByName(new)
    return _by_path(history, whole, path, rule_version), whole
