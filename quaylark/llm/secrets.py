"""Secret scans with an incremental blob ledger.

Every version of every path is addressed by its content. The ledger has one row for each
(blob, rule version) that was scanned, with or without findings; an update scans only the
pairs that it lacks and joins the findings back to all paths.
"""

from __future__ import annotations

import re
import uuid

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quaylark.llm.common import BROADCAST_IDS, col, keep_for_run, python_map, shared_folder

#: Fixed rules. The first three are the base; kinds count in this order.
BASE_KINDS = ("assign", "access", "hex")
KINDS = (*BASE_KINDS, "pem", "jwt")
RULE_VERSION = "2"

_RULES = {
    "assign": (re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE | re.ASCII), lambda m: len(m[2]) >= 6),
    "access": (re.compile(r"AKIA[A-Z0-9]+"), lambda m: len(m[0]) >= 20),
    "hex": (re.compile(r"[0-9a-f]{24,}"), lambda m: True),  # a run is taken whole, so this drops the shorter ones
    "pem": (re.compile(r"-----BEGIN [A-Z ]{0,30}PRIVATE KEY-----"), lambda m: True),
    "jwt": (re.compile(r"(?<![A-Za-z0-9_-])eyJ[A-Za-z0-9_-]{10,}\.eyJ[A-Za-z0-9_-]{10,}\.[A-Za-z0-9_-]{10,}"), lambda m: True),
}

_FOUND = "array<struct<kind:string,start:int,stop:int>>"
LEDGER = f"blob string, rule_version string, found {_FOUND}"


def find_secrets(text: str) -> list[tuple[str, int, int]]:
    """(kind, start, stop) by start, then kind; code points, stop is exclusive."""
    found = [(m.start(), k, m.end()) for k, kind in enumerate(KINDS) for m in _RULES[kind][0].finditer(text) if _RULES[kind][1](m)]
    return [(KINDS[k], a, b) for a, k, b in sorted(found)]


def address(versions: DataFrame, path_col: str, text_col: str) -> DataFrame:
    """(path, text, blob): blob is the SHA-256 of the text's UTF-8 bytes; null is empty."""
    v = versions.select(col(path_col).alias("path"), F.coalesce(col(text_col), F.lit("")).alias("text"))
    return v.withColumn("blob", F.sha2("text", 256))


def update_ledger(versions: DataFrame, ledger: DataFrame | None = None, *, path_col: str = "doc_id", text_col: str = "text", rule_version: str = RULE_VERSION) -> DataFrame:
    """The rows to add to the ledger: (blob, rule_version, found), one for each blob of
    `versions` that `ledger` lacks under this rule version.

    What the ledger has goes before any text moves. Copies of a text are one blob whatever
    their paths; they meet after a partial aggregate, so that a group of copies sends one
    row from each task.
    """
    blobs = address(versions, path_col, text_col).select("blob", "text")
    if ledger is not None:
        known = ledger.where(F.col("rule_version") == rule_version).select("blob")
        blobs = blobs.join(F.broadcast(known) if known.count() <= BROADCAST_IDS else known, "blob", "left_anti")
    blobs = blobs.groupBy("blob").agg(F.first("text").alias("text"))

    def make():
        names = ("kind", "start", "stop")
        return lambda b: {"found": [[dict(zip(names, x)) for x in find_secrets(t)] for t in b["text"]]}

    found = python_map(blobs, make, f"found {_FOUND}", ["blob"])
    return found.select("blob", F.lit(rule_version).alias("rule_version"), "found")


def stored_ledger(versions: DataFrame, path: str, **options) -> DataFrame:
    """The ledger at `path`, a folder that all executors reach, after the blobs of `versions`
    that it lacks were scanned and added to it. It only grows; a run that fails adds nothing,
    and a second run over the same versions scans nothing."""
    spark = versions.sparkSession
    try:
        ledger = spark.read.schema(LEDGER).parquet(path)
    except AnalysisException:  # there is none yet
        ledger = None
    update_ledger(versions, ledger, **options).write.mode("append").parquet(path)
    return spark.read.schema(LEDGER).parquet(path)


def findings(versions: DataFrame, ledger: DataFrame, *, path_col: str = "doc_id", text_col: str = "text", rule_version: str = RULE_VERSION) -> DataFrame:
    """(path, blob, found) for every row of `versions`; found is empty where nothing was.

    Only blobs with findings go into the join; a blob with very many paths is one row on
    that side, so that a skewed join can split the paths. A blob that the ledger has more than
    once, as after two runs at a time, counts once.
    """
    hits = ledger.where((F.col("rule_version") == rule_version) & (F.size("found") > 0)).select("blob", "found").dropDuplicates(["blob"])
    paths = address(versions, path_col, text_col).select("path", "blob")
    return paths.join(hits, "blob", "left").select("path", "blob", F.coalesce("found", F.array().cast(_FOUND)).alias("found"))


def digest(found, kinds=None):
    """kind:start:stop of the findings, comma-joined."""
    if kinds is not None:
        found = F.filter(found, lambda x: x["kind"].isin(*kinds))
    return F.concat_ws(",", F.transform(found, lambda x: F.concat_ws(":", x["kind"], x["start"].cast("string"), x["stop"].cast("string"))))


def count_of(kind: str):
    return F.size(F.filter("found", lambda x: x["kind"] == kind)).cast("long")


def secret_report(docs: DataFrame, ledger_path: str | None = None, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row a document: counts of the base kinds and the spans found.

    The ledger at `ledger_path` is read, extended by what it lacks and joined back to all
    documents; without a path it is kept for this run in the shared folder. Null texts and
    ids, repeated ids and copies are all defined: each row gets its own text's findings. An
    empty table gives none. Columns other than these two are ignored.
    """
    if ledger_path is None:
        ledger_path = keep_for_run(docs.sparkSession, f"{shared_folder(docs.sparkSession)}/ledger-{uuid.uuid4().hex}")
    rows = findings(docs, stored_ledger(docs, ledger_path, path_col=id_col, text_col=text_col), path_col=id_col, text_col=text_col)
    counts = [count_of(kind).alias(f"n_{kind}") for kind in BASE_KINDS]
    return rows.select(F.col("path").alias(id_col), *counts, F.sha2(digest(F.col("found"), BASE_KINDS), 256).alias("base_sha256"), digest(F.col("found")).alias("spans"))
