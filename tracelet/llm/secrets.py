r"""Secret scans over an incremental blob ledger.

Every version of every path is addressed by the SHA-256 of its content. Only
blobs that the ledger doesn't yet hold under the present rule version are
scanned, each once; findings are then joined back to all paths that hold the
blob. A ledger row is (blob_id binary, rule_version int, n_assign, n_access,
n_hex long, base string, spans string); blobs without findings have a row too,
so that they aren't scanned again.

Rules, leftmost and non-overlapping within a kind, offsets in code points:
assign, access and hex are the base rules; pem is an added one (the first line
of a private key block). Key words match in either case of ASCII letters only.

Defined cases: a null text is the empty text; a null path is kept as such;
repeated rows each get their row back; very long texts are scanned whole; an
empty table gives no rows; other columns are ignored.

How it scales: one shuffle of the texts (each blob's representative meets its
ledger decision), then only hashes and findings move. The lookup from paths to
blobs is salted by path, so a blob that a third of all paths share is spread.
"""

from __future__ import annotations

import re

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracelet.llm.common import explode_salts, map_arrow, salt_bits, salt_of

RULE_VERSION = 1
KINDS = ("assign", "access", "hex", "pem")
BASE_KINDS = 3
MIN_VALUE, MIN_ACCESS, MIN_HEX = 6, 20, 24
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE | re.ASCII)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{%d,}" % MIN_HEX)  # a maximal run either is long enough or fails as a whole
PEM = re.compile(r"-----BEGIN (?:[A-Z]+ )*PRIVATE KEY-----")
WORDS = ("passw", "secret", "token", "api")

LEDGER = "blob_id binary, rule_version int, n_assign long, n_access long, n_hex long, base string, spans string"


def find_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind, end), in order."""
    found = []
    low = text.lower()
    if any(w in low for w in WORDS):
        found += [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if m.end(2) - m.start(2) >= MIN_VALUE]
    if "AKIA" in text:
        found += [(m.start(), 1, m.end()) for m in ACCESS.finditer(text) if m.end() - m.start() >= MIN_ACCESS]
    found += [(m.start(), 2, m.end()) for m in HEX.finditer(text)]
    if "PRIVATE KEY" in text:
        found += [(m.start(), 3, m.end()) for m in PEM.finditer(text)]
    return sorted(found)


def spell(spans) -> str:
    return ",".join(f"{KINDS[k]}:{a}:{b}" for a, k, b in spans)


def address(history: DataFrame, path: str, text: str) -> DataFrame:
    content = F.coalesce(F.col(text), F.lit(""))
    return history.select(F.col(path).alias("path"), F.unhex(F.sha2(content.cast("binary"), 256)).alias("blob_id"), content.alias("text"))


def scan_unseen(history: DataFrame, path: str = "doc_id", text: str = "text", ledger: DataFrame | None = None, rule_version: int = RULE_VERSION) -> DataFrame:
    """New ledger rows: each blob of history that ledger doesn't hold under this rule version, scanned once."""
    versions = address(history, path, text)
    unseen = versions.groupBy("blob_id").agg(F.min("path").alias("first_path"))
    if ledger is not None:
        unseen = unseen.join(ledger.filter(F.col("rule_version") == rule_version).select("blob_id"), "blob_id", "left_anti")
    unseen = unseen.withColumnRenamed("blob_id", "wanted").hint("shuffle_hash")
    texts = versions.join(unseen, (F.col("blob_id") == F.col("wanted")) & F.col("path").eqNullSafe(F.col("first_path")), "left_semi").select("blob_id", "text")

    def make():
        seen: set[bytes] = set()

        def step(batch: pa.RecordBatch) -> pa.RecordBatch:
            rows = []
            for blob, content in zip(batch.column(0).to_pylist(), batch.column(1)):
                if blob not in seen:
                    seen.add(blob)
                    spans = find_spans(content.as_py())
                    n = [sum(k == kind for _, k, _ in spans) for kind in range(BASE_KINDS)]
                    rows.append((blob, rule_version, *n, spell(s for s in spans if s[1] < BASE_KINDS), spell(spans)))
            names = ["blob_id", "rule_version", "n_assign", "n_access", "n_hex", "base", "spans"]
            kinds = [pa.binary(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.string()]
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows) if rows else [[]] * 7, kinds)], names)

        return step

    return map_arrow(texts, make, LEDGER)


def findings_by_path(history: DataFrame, ledger: DataFrame, path: str = "doc_id", text: str = "text", rule_version: int = RULE_VERSION) -> DataFrame:
    """One row for each row of history: path, n_assign, n_access, n_hex, base, spans."""
    versions = address(history, path, text).select("path", "blob_id")
    held = versions.groupBy("blob_id").agg(salt_bits(salt_of(F.col("path"))).alias("bits"))
    found = ledger.filter((F.col("rule_version") == rule_version) & (F.col("spans") != ""))
    found = found.groupBy("blob_id").agg(*[F.max(c).alias(c) for c in ("n_assign", "n_access", "n_hex", "base", "spans")])
    found = found.join(held, "blob_id").select("*", explode_salts(F.col("bits")).alias("salt")).drop("bits")
    out = versions.withColumn("salt", salt_of(F.col("path"))).join(found, ["blob_id", "salt"], "left")
    return out.select(
        "path",
        *[F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in ("n_assign", "n_access", "n_hex")],
        *[F.coalesce(c, F.lit("")).alias(c) for c in ("base", "spans")],
    )
