"""Secret scans over an incremental ledger of content-addressed blobs.

Every row (a version of a document at a path) is addressed by the SHA-256 of its text. The ledger
holds one row per scanned (blob, rule, version) pair, with the spans found or none. A run scans only
pairs that the ledger lacks, once per blob however many rows carry it, appends them, and joins the
findings back to all rows.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import scratch_path
from .common import free_name, ship, table, utf8, written


@dataclass(frozen=True)
class Rule:
    """A kind of secret. ``hints``: lower-case strings of which a text must hold one (none: always scanned).
    ``group`` and ``least``: the group whose length must reach ``least``, else the match is dropped."""

    kind: str
    version: int
    pattern: str
    group: int = 0
    least: int = 0
    ignore_case: bool = False
    hints: tuple[str, ...] = ()

    def spans(self, text: str, lower: str) -> list[tuple[int, int]]:
        if self.hints and not any(h in lower for h in self.hints):
            return []
        flags = re.ASCII | (re.IGNORECASE if self.ignore_case else 0)
        found = re.compile(self.pattern, flags).finditer(text)
        return [m.span() for m in found if m.end(self.group) - m.start(self.group) >= self.least]


#: Fixed patterns; the first three are the base kinds. ``[0-9a-f]{16,}`` has the matches of
#: ``[0-9a-f]+`` that are long enough: both are whole runs.
RULES = (
    Rule("assign", 1, r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 12, True, ("password", "passwd", "secret", "token", "apikey", "api_key")),
    Rule("access", 1, r"AKIA[A-Z0-9]+", 0, 18, False, ("akia",)),
    Rule("hex", 1, r"[0-9a-f]{16,}", 0, 16),
    Rule("github", 1, r"gh[pousr]_[A-Za-z0-9]{36,}", 0, 40, False, ("ghp_", "gho_", "ghu_", "ghs_", "ghr_")),
    Rule("jwt", 1, r"eyJ[A-Za-z0-9_-]+\.eyJ[A-Za-z0-9_-]+\.[A-Za-z0-9_-]+", 0, 30, False, ("eyj",)),
    Rule("private_key", 1, r"-----BEGIN [A-Z ]*PRIVATE KEY-----", 0, 0, False, ("private key-----",)),
)
BASE = ("assign", "access", "hex")
LEDGER = "blob binary, kind string, version int, spans array<struct<start: int, end: int>>"


def _first_of_task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One row per blob of this task, so that a blob that many rows carry is sent on once a task."""
    seen: set[bytes] = set()
    for batch in batches:
        keep = []
        for b in batch.column(0).to_pylist():
            keep.append(b not in seen)
            seen.add(b)
        yield batch.filter(pa.array(keep, pa.bool_()))


def _scan(rules: tuple[Rule, ...]):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        seen: set[bytes] = set()
        for batch in batches:
            out = []
            for blob, text, wanted in zip(batch["blob"], batch["text"], batch["wanted"], strict=True):
                blob = bytes(blob)
                if blob in seen:
                    continue
                seen.add(blob)
                lower = text.lower()
                for i in range(len(rules)) if wanted is None else wanted:
                    r = rules[i]
                    out.append((blob, r.kind, r.version, [{"start": a, "end": b} for a, b in r.spans(text, lower)]))
            yield pd.DataFrame(out, columns=["blob", "kind", "version", "spans"])

    return run


def address(text: str = "text"):
    """SHA-256 of the text's UTF-8 bytes; a null text is the empty one."""
    return F.unhex(F.sha2(utf8(F.coalesce(F.col(text), F.lit(""))), 256))


def scan_new(docs: DataFrame, ledger: str, text_col: str = "text", rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """Scan what ``ledger`` (a folder of Parquet files in a shared place; may not exist yet) lacks,
    append it, and return the ledger."""
    spark = ship(docs.sparkSession)
    known = None
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(ledger)
    if hadoop.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(hadoop):
        known = spark.read.schema(LEDGER).parquet(ledger)
    texts = docs.select(address(text_col).alias("blob"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    texts = texts.mapInArrow(_first_of_task, "blob binary, text string")
    if known is None:
        texts = texts.withColumn("wanted", F.lit(None).cast("array<int>")).repartition("blob")
    else:
        now = spark.createDataFrame([(i, r.kind, r.version) for i, r in enumerate(rules)], "rule int, kind string, version int")
        seen = known.join(F.broadcast(now), ["kind", "version"]).groupBy("blob").agg(F.collect_set("rule").alias("done"))
        wanted = docs.select(address(text_col).alias("blob")).distinct().join(seen, "blob", "left").select(
            "blob", F.array_except(F.array(*[F.lit(i) for i in range(len(rules))]), F.coalesce("done", F.array().cast("array<int>"))).alias("wanted")
        )
        texts = texts.join(wanted.where(F.size("wanted") > 0), "blob").select("blob", "text", "wanted").repartition("blob")
    texts.mapInPandas(_scan(rules), LEDGER).write.mode("append").parquet(ledger)
    return spark.read.schema(LEDGER).parquet(ledger)


_REPORT = "struct<n: array<bigint>, base: string, spans: string, merged: array<struct<start: int, end: int>>>"


def _reporter(rules: tuple[Rule, ...]):
    order = {r.kind: i for i, r in enumerate(rules)}

    @F.pandas_udf(_REPORT)
    def report(found: pd.Series) -> pd.DataFrame:
        out = []
        for kinds in found:
            spans = sorted((s["start"], order[k["kind"]], k["kind"], s["end"]) for k in kinds for s in k["spans"])
            text = [f"{kind}:{a}:{b}" for a, _, kind, b in spans]
            whole: list[list[int]] = []
            for a, _, _, b in spans:
                if whole and a <= whole[-1][1]:
                    whole[-1][1] = max(whole[-1][1], b)
                else:
                    whole.append([a, b])
            out.append((
                [sum(x[2] == kind for x in spans) for kind in BASE],
                ",".join(t for t, x in zip(text, spans, strict=True) if x[2] in BASE), ",".join(text),
                [{"start": a, "end": b} for a, b in whole],
            ))
        return pd.DataFrame(out, columns=["n", "base", "spans", "merged"])

    return report.asNondeterministic()


def findings(ledger: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """One row per blob with findings under the current rules: blob, n (per base kind), base and spans
    (kind:start:end by start, then kind as listed, comma-joined), merged (spans without overlap)."""
    now = ledger.sparkSession.createDataFrame([(r.kind, r.version) for r in rules], "kind string, version int")
    found = ledger.where(F.size("spans") > 0).join(F.broadcast(now), ["kind", "version"])
    # a pair that two runs scanned at once is in the ledger twice, with the same spans
    found = found.groupBy("blob").agg(F.collect_set(F.struct("kind", "spans")).alias("kinds"))
    return found.withColumn("r", _reporter(rules)("kinds")).select("blob", "r.*")


def op10_secrets(spark, sf_dir: str) -> DataFrame:
    """Secrets of every document. The run starts with an empty ledger in the shared folder."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    found = findings(scan_new(docs, scratch_path(spark, "ledger")))
    paths = docs.select("doc_id", address().alias("blob"))
    none = F.array(*[F.lit(0).cast("bigint")] * 3)
    x = paths.join(found, "blob", "left").withColumn("n", F.coalesce("n", none))
    return x.select(
        "doc_id", F.col("n")[0].alias("n_assign"), F.col("n")[1].alias("n_access"), F.col("n")[2].alias("n_hex"),
        F.sha2(F.coalesce("base", F.lit("")), 256).alias("base_sha256"), F.coalesce("spans", F.lit("")).alias("spans"),
    )


def redact(docs: DataFrame, text_col: str = "text", mark: str = "[SECRET]") -> DataFrame:
    """``docs`` with every found span of the text replaced by ``mark``; ``n_chars``, if there, is the
    new text's length. Null and empty texts and texts without secrets stay as they are."""
    found = written(findings(scan_new(docs, scratch_path(docs.sparkSession, "ledger"), text_col)), "findings")
    names = [free_name(docs.columns, x) for x in ("_blob", "_spans")]
    found = found.select(F.col("blob").alias(names[0]), F.col("merged").alias(names[1]))
    # by shuffling at every size: the findings grow with the documents
    joined = docs.join(found.hint("merge"), address(text_col) == F.col(names[0]), "left")
    text = F.col(text_col)
    clean = F.aggregate(
        F.reverse(F.col(names[1])), text,
        lambda t, s: F.concat(F.substring(t, F.lit(1), s["start"]), F.lit(mark), F.substring(t, s["end"] + 1, F.length(t))),
    )
    hit = F.col(names[1]).isNotNull()
    new = {text_col: F.when(hit, clean).otherwise(text)}
    if "n_chars" in docs.columns:
        kind = docs.schema["n_chars"].dataType
        new["n_chars"] = F.when(hit, F.length(clean).cast(kind)).otherwise(F.col("n_chars"))
    return joined.select(*[new[c].alias(c) if c in new else F.col(c) for c in docs.columns])
