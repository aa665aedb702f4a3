"""Vaults of markdown files as notes, and snapshots as Parquet directories."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lumenark.functions import text as T


def glob_regex(pattern: str) -> str:
    """An exclude pattern as a regular expression on the relative path: without a slash
    at any depth, with one at the end a whole folder, with one inside from the root."""
    if not pattern.strip("/ "):
        raise ValueError("empty exclude pattern")
    folder, body = pattern.endswith("/"), pattern.strip("/")
    out = ""
    for part in re.split(r"(\*\*/|\*\*|\*|\?)", body):
        out += {"**/": "(?:.*/)?", "**": ".*", "*": "[^/]*", "?": "[^/]"}.get(part) or re.sub(r"([^\w/\s-])", r"\\\1", part)
    lead = "^" if "/" in body else "(?:^|.*/)"
    return lead + out + ("/.*$" if folder else "(?:/.*)?$")


def ignore_rules(text: str, folder: str = "") -> list[tuple[str, bool]]:
    """The lines of a ``.gitignore`` in ``folder`` as (regular expression on the relative
    path, ignored), in order; the last that matches decides."""
    out = []
    for line in text.splitlines():
        line = line.strip()
        if not line or line.startswith("#") or not line.strip("/!* "):
            continue
        ignored, line = not line.startswith("!"), line.removeprefix("!")
        inner = glob_regex(line.lstrip("/"))
        if line.startswith("/"):
            inner = "^" + inner.removeprefix("(?:^|.*/)").removeprefix("^")
        under = re.escape(folder.strip("/")) + "/" if folder.strip("/") else ""
        out.append(("^" + under + (inner[1:] if inner.startswith("^") else inner.replace("(?:^|.*/)", "(?:.*/)?", 1)), ignored))
    return out


def ignore_files(spark: SparkSession, root: str) -> list[tuple[str, str]]:
    """(folder, text) of the ``.gitignore`` files below ``root``, upper ones first. Spark's
    own listing passes over names with a dot, so folders are globbed level by level."""
    jvm = spark.sparkContext._jvm
    top = jvm.org.apache.hadoop.fs.Path(root)
    fs = top.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    base, out, level = fs.makeQualified(top).toUri().getPath().rstrip("/"), [], ""
    while fs.globStatus(jvm.org.apache.hadoop.fs.Path(f"{root.rstrip('/')}{level or '/'}")):
        for status in fs.globStatus(jvm.org.apache.hadoop.fs.Path(f"{root.rstrip('/')}{level}/.gitignore")) or ():
            stream = fs.open(status.getPath())
            text = jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
            stream.close()
            out.append((status.getPath().getParent().toUri().getPath()[len(base) :].strip("/"), text))
        level += "/*"
    return out


def read_vault(spark: SparkSession, root: str, exclude: tuple[str, ...] = (), hidden: bool = False, ignore: bool = True) -> DataFrame:
    """One row per ``*.md`` file below ``root``: path, content, content_hash, mtime,
    docid, note_date (of the frontmatter's ``date``, else of the path) and file_id (from
    the path's hash). Unreadable bytes are replaced. ``ignore``: leave out what
    ``.gitignore`` files name (they are few and read by the driver)."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", "*.md").load(root)
    base = F.lit(spark.sparkContext._jvm.org.apache.hadoop.fs.Path(root).toUri().getPath().rstrip("/") + "/")
    whole = F.regexp_replace("path", "^[a-zA-Z]+:(//[^/]*)?", "")
    rel = F.url_decode(F.substr(whole, F.instr(whole, base) + F.length(base)))
    out = files.select(rel.alias("path"), F.decode("content", "UTF-8").alias("content"), F.sha2("content", 256).alias("content_hash"), F.unix_timestamp("modificationTime").alias("mtime"))
    if not hidden:
        out = out.where(~F.col("path").rlike(r"(^|/)\."))
    for p in exclude:
        out = out.where(~F.col("path").rlike(glob_regex(p)))
    if ignore:
        gone = F.lit(False)
        for folder, text in ignore_files(spark, root):
            for pattern, ignored in ignore_rules(text, folder):
                gone = F.when(F.col("path").rlike(pattern), ignored).otherwise(gone)
        out = out.where(~gone)
    out = out.withColumn("note_date", T.note_date(T.frontmatter_date(F.col("content")), F.col("path")))
    return out.withColumns({"docid": T.docid(F.col("path")), "file_id": F.xxhash64("path")})


def write_snapshot(tables: dict[str, DataFrame], root: str, version: int) -> None:
    """All tables of a version; a version is complete when its ``_DONE`` is there."""
    for name, df in tables.items():
        df.write.mode("overwrite").parquet(f"{root}/v{version}/{name}")
    spark = next(iter(tables.values())).sparkSession
    done = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{root}/v{version}/_DONE")
    done.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).create(done, True).close()


def read_snapshot(spark: SparkSession, root: str, names: tuple[str, ...], version: int) -> dict[str, DataFrame]:
    done = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{root}/v{version}/_DONE")
    if not done.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(done):
        raise FileNotFoundError(f"version {version} is not complete")
    return {n: spark.read.parquet(f"{root}/v{version}/{n}") for n in names}
