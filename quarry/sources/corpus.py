"""Corpora as DataFrames of files: folders, driver tables, change lists, caches."""

from __future__ import annotations

import subprocess

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.functions.scalars import any_glob, content_hash, extension

MAX_BYTES = 2 * 1024 * 1024
#: File name endings of each language; the first language that names an ending has it.
EXTENSIONS = {
    "javascript": ("js", "mjs", "cjs", "jsx"),
    "typescript": ("ts", "mts", "cts"),
    "tsx": ("tsx",),
    "csharp": ("cs",),
    "go": ("go",),
    "rust": ("rs",),
    "pascal": ("pas", "pp", "dpr", "dpk", "lpr"),
    "objectscript": ("cls", "mac", "int", "inc"),
}


def languages(spark: SparkSession, overrides: dict[str, str] | None = None) -> DataFrame:
    """ext, lang; overrides replace what is built in."""
    known: dict[str, str] = {}
    for lang, endings in EXTENSIONS.items():
        for e in endings:
            known.setdefault(e, lang)
    known |= {e.lower().lstrip("."): lang for e, lang in (overrides or {}).items()}
    return spark.createDataFrame(sorted(known.items()), "ext string, lang string")


def with_language(files: DataFrame, overrides: dict[str, str] | None = None) -> DataFrame:
    """files whose ending has a language, with lang. The dimension has a few dozen rows."""
    return files.withColumn("ext", extension(F.col("path"))).join(F.broadcast(languages(files.sparkSession, overrides)), "ext").drop("ext")


def read_folder(spark: SparkSession, root: str, overrides: dict[str, str] | None = None) -> DataFrame:
    """path (relative, with /), lang, size, text, content_hash of the files under root that have a language. Hidden files and
    folders are left out. Undecodable bytes become replacement characters."""
    raw = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(root)
    base = root.rstrip("/")
    relative = F.regexp_replace(F.regexp_replace(F.col("path"), "^[a-z]+:/*", "/"), "^.*?" + _quoted(base.split("://")[-1].lstrip("/")) + "/", "")
    files = raw.select(relative.alias("path"), F.col("length").alias("size"), F.make_valid_utf8(F.col("content").cast("string")).alias("text"), content_hash(F.col("content")).alias("content_hash"), F.when(F.col("content").isNull(), F.lit("no content")).alias("read_error"))
    return with_language(files.where(~F.col("path").rlike(r"(^|/)\.")), overrides)


def _quoted(text: str) -> str:
    return "\\Q" + text + "\\E"


def scoped(files: DataFrame, include: list[str] = (), exclude: list[str] = (), langs: list[str] = ()) -> DataFrame:
    """Include globs are alternatives, exclude globs too; empty lists mean all, and none."""
    if langs:
        files = files.where(F.col("lang").isin(*langs))
    if include:
        files = files.where(any_glob(F.col("path"), list(include)))
    return files.where(~any_glob(F.col("path"), list(exclude))) if exclude else files


def stats(files: DataFrame, max_bytes: int = MAX_BYTES) -> DataFrame:
    """One row: files considered, scanned and skipped for size (strictly larger than the limit)."""
    return files.agg(F.count("*").alias("considered"), F.count_if(F.col("size") <= max_bytes).alias("scanned"), F.count_if(F.col("size") > max_bytes).alias("skipped"))


def changed_paths(root: str, base: str) -> list[str]:
    """Paths that differ from the merge base with `base` (or from base itself) and still exist, and untracked ones; sorted."""
    git = lambda *a: subprocess.run(["git", "-C", root, *a], capture_output=True, text=True, check=True).stdout
    try:
        start = git("merge-base", base, "HEAD").strip()
    except subprocess.CalledProcessError:
        start = base
    names = git("diff", "--name-only", "-z", "--diff-filter=ACMRT", start).split("\0") + git("ls-files", "--others", "--exclude-standard", "-z").split("\0")
    return sorted({n for n in names if n})


def only_paths(files: DataFrame, paths: DataFrame) -> DataFrame:
    return files.join(paths, "path", "left_semi")


def cache_partition(files: DataFrame, cache: DataFrame, keys: list[str] = ("path", "content_hash")) -> DataFrame:
    """files with hit: whether the cache has the same path, content and further keys."""
    return files.join(cache.select(*keys).distinct().withColumn("hit", F.lit(True)), list(keys), "left").withColumn("hit", F.coalesce("hit", F.lit(False)))


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The driver's documents as files."""
    d = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return d.select("doc_id", F.concat_ws("/", "source", "lang", F.col("doc_id").cast("string")).alias("path"), "lang", "source", "text", F.octet_length("text").cast("long").alias("size"), content_hash(F.col("text")).alias("content_hash"))
