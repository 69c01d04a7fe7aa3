"""What is kept between scans: findings by content, summaries by content, fingerprints that are known already."""

from __future__ import annotations

import os
import re
from datetime import UTC, datetime
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.operators.documents import Document, Section
from quarry.sources.deltas import DeltaLog
from quarry.sources.hadoop import Folder
from quarry.sources.store import materialised

FOLDER = ".quarry"
SCHEMA = 1


class StateError(ValueError):
    pass


def now() -> str:
    """The time by RFC 3339, in UTC."""
    return datetime.now(UTC).strftime("%Y-%m-%dT%H:%M:%SZ")


def summary_key(content_hash, rules_hash: str):
    """Where a file's summaries are kept: by its content, the rules and the form of summaries."""
    return F.sha2(F.concat_ws("\x1f", content_hash, F.lit(rules_hash), F.lit(str(SCHEMA))), 256)


def folder(root: str, state: str | None = None) -> str:
    """Where a scan of root keeps what it knows: a path that driver and executors share; beside the files unless one is named."""
    return state or f"{root.rstrip('/')}/{FOLDER}"


def caches(spark: SparkSession, where: str, rules_hash: str = "") -> tuple[DeltaLog, DeltaLog]:
    """Findings and summaries by path: logs of deltas, as if empty under other rules."""
    where = where if re.match(r"[a-z][a-z0-9+.-]*:", where) else "file://" + os.path.abspath(where)
    kind = f"{SCHEMA}:{rules_hash}"
    return DeltaLog(spark, f"{where}/cache", ["path"], kind), DeltaLog(spark, f"{where}/summaries", ["path"], kind)


def clear_caches(root: str, state: str | None = None) -> bool:
    """Whether there was anything."""
    return any([log.clear() for log in caches(SparkSession.active(), folder(root, state))])


def info(root: str, state: str | None = None) -> dict:
    return {name: dict(zip(("files", "bytes"), log.folder.size("data"))) for name, log in zip(("cache", "summaries"), caches(SparkSession.active(), folder(root, state)))}


# -- baselines -------------------------------------------------------------------------------------------------------------------
BASELINE = "schema int, updated string, fingerprints array<string>"
HEAD = re.compile(r'\{"schema": \d+, "updated": "([^"]*)", "fingerprints": \[')


def _located(path: str | Path) -> tuple[str, str]:
    path = str(path)
    full = path if re.match(r"[a-z][a-z0-9+.-]*:", path) else "file://" + os.path.abspath(path)
    where, name = full.rsplit("/", 1)
    return where, name


def _head(spark: SparkSession, path: str | Path) -> str | None:
    """The first line of a baseline that was written here; None for other documents. One that is missing is an error."""
    where, name = _located(path)
    try:
        first = next(Folder(spark, where).lines(name), "")
    except Exception as e:
        raise StateError(f"baseline {path}: {type(e).__name__}") from e
    return first if HEAD.fullmatch(first) else None


def baseline_table(spark: SparkSession, path: str | Path) -> DataFrame:
    """fingerprint, of a baseline's document. What this module wrote has one on a line and is read by lines, in as many tasks as it
    has splits; any other JSON by Spark's reader. One that is missing or spoilt is an error: a gate must not pass by accident."""
    where, name = _located(path)
    if _head(spark, path) is not None:
        lines = spark.read.text(f"{where}/{name}")
        if lines.where("value = ']}'").isEmpty():
            raise StateError(f"baseline {path}: no end")
        return lines.select(F.regexp_extract("value", r'^,?"([^"]+)"$', 1).alias("fingerprint")).where("fingerprint <> ''")
    try:
        doc = spark.read.schema(BASELINE).option("multiLine", True).option("mode", "FAILFAST").json(f"{where}/{name}")
        if doc.where("fingerprints IS NOT NULL").isEmpty():
            raise StateError(f"baseline {path}: no fingerprints")
    except StateError:
        raise
    except Exception as e:
        raise StateError(f"baseline {path}: {type(e).__name__}") from e
    return doc.select(F.explode("fingerprints").alias("fingerprint"))


def baseline_info(spark: SparkSession, path: str | Path) -> dict:
    head = _head(spark, path)
    count = baseline_table(spark, path).count()
    if head is not None:
        return {"fingerprints": count, "updated": HEAD.fullmatch(head)[1]}
    where, name = _located(path)
    return {"fingerprints": count, "updated": spark.read.schema(BASELINE).option("multiLine", True).json(f"{where}/{name}").first()["updated"]}


def write_baseline(path: str | Path, findings: DataFrame) -> int:
    """Keeps the distinct fingerprints, sorted, one on a line of a JSON document; executors write the lines."""
    prints = materialised(findings.select("fingerprint").distinct())
    head = f'{{"schema": {SCHEMA}, "updated": "{now()}", "fingerprints": ['
    rows = prints.select(F.concat(F.lit('"'), "fingerprint", F.lit('"')).alias("line"), "fingerprint")
    Document([Section(head, rows, ["fingerprint"], ",")], "]}").write(str(path))
    return prints.count()
