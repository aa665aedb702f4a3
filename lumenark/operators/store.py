"""Incremental maintenance: snapshot diffs, upserts, cascading deletes, fingerprints.

A store is a set of tables keyed by ``file_id``. Changes are anti joins plus appends;
snapshots are written whole to versioned directories, so a reader sees one or the other."""

from __future__ import annotations

import hashlib
import json

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def diff(found: DataFrame, stored: DataFrame) -> DataFrame:
    """(path, change) of (path, content_hash) snapshots: new, changed or deleted."""
    f = found.select("path", F.col("content_hash").alias("_new"))
    s = stored.select("path", F.col("content_hash").alias("_old"))
    change = F.when(F.col("_old").isNull(), "new").when(F.col("_new").isNull(), "deleted").when(F.col("_new") != F.col("_old"), "changed")
    return f.join(s, "path", "full").select("path", change.alias("change")).where(F.col("change").isNotNull())


def upsert(stored: DataFrame, rows: DataFrame, keep: tuple[str, ...] = ("created_by",), key: str = "path") -> DataFrame:
    """``rows`` replace stored rows of the same key; columns of ``keep`` only where the
    new value is not null."""
    old = stored.select(key, *(F.col(c).alias(f"_{c}") for c in keep))
    merged = rows.join(old, key, "left").withColumns({c: F.coalesce(c, f"_{c}") for c in keep}).drop(*(f"_{c}" for c in keep))
    return stored.join(rows.select(key), key, "left_anti").unionByName(merged.select(stored.columns))


def remove(gone: DataFrame, tables: dict[str, DataFrame], null_out: dict[str, str] | None = None) -> dict[str, DataFrame]:
    """Every table without the rows of ``gone`` (file_id); in ``null_out`` (table to
    column) references are emptied instead of deleted as well."""
    ids = gone.select("file_id").distinct()
    out = {name: df.join(ids, "file_id", "left_anti") for name, df in tables.items()}
    for name, column in (null_out or {}).items():
        mark = ids.select(F.col("file_id").alias(column), F.lit(True).alias("_gone"))
        df = out[name].join(mark, column, "left")
        out[name] = df.withColumn(column, F.when(F.col("_gone").isNull(), F.col(column))).select(tables[name].columns)
    return out


def delete_edges(edges: DataFrame, gone: DataFrame, outgoing_only: bool = False) -> DataFrame:
    out = edges.join(gone.select(F.col("file_id").alias("from_file")), "from_file", "left_anti")
    return out if outgoing_only else out.join(gone.select(F.col("file_id").alias("to_file")), "to_file", "left_anti").select(edges.columns)


class Conflict(ValueError):
    pass


def rename(notes: DataFrame, old: str, new: str) -> DataFrame:
    """A note under another path, with the short id that follows from it."""
    if notes.where(F.col("path") == new).limit(1).count():
        raise Conflict(f"{new!r} is taken")
    path = F.when(F.col("path") == old, F.lit(new)).otherwise(F.col("path"))
    return notes.withColumn("path", path).withColumn("docid", F.substring(F.sha2("path", 256), 1, 6))


def replace_rows(stored: DataFrame, fresh: DataFrame, keys: tuple[str, ...] | None = None) -> DataFrame:
    """Derived rows of the files in ``fresh`` replaced, repeated ones dropped."""
    out = stored.join(fresh.select("file_id").distinct(), "file_id", "left_anti").unionByName(fresh.dropDuplicates(list(keys) if keys else None))
    return out


def move_folder(notes: DataFrame, prefix: str, to: str) -> DataFrame:
    """Archive or restore: the part of the path after ``prefix`` under ``to``."""
    rest = F.substr("path", F.lit(len(prefix) + 2))
    return notes.withColumn("path", F.when(F.col("path").startswith(prefix + "/"), F.concat(F.lit(to + "/"), rest)).otherwise(F.col("path"))).withColumn("docid", F.substring(F.sha2("path", 256), 1, 6))


def orphan_rows(rows: DataFrame, notes: DataFrame) -> DataFrame:
    return rows.join(notes.select("file_id"), "file_id", "left_anti")


def vectors_of(vectors: DataFrame, width: int) -> DataFrame:
    """Vectors, or an error on the first of another width."""
    return vectors.withColumn("vector", F.when(F.size("vector") == width, F.col("vector")).otherwise(F.raise_error(F.lit("vector width changed: rebuild the vectors"))))


def digest(*parts: str) -> str:
    """SHA-256 over length-prefixed parts."""
    h = hashlib.sha256()
    for p in parts:
        b = p.encode()
        h.update(len(b).to_bytes(8, "little") + b)
    return h.hexdigest()


#: What a changed fingerprint asks for.
ACTIONS = {"parser": "reindex", "chunker": "reindex", "embedding": "reindex", "link": "rebuild_edges", "fts": "rebuild_fts", "reranker": "invalidate_thresholds"}


def fingerprints(config: dict) -> dict[str, str]:
    return {k: digest(k, json.dumps(config.get(k), sort_keys=True)) for k in ACTIONS}


def stale(recorded: dict[str, str], now: dict[str, str]) -> dict[str, str]:
    """The keys that differ, each with its action; unrecorded keys are adopted."""
    return {k: ACTIONS[k] for k, v in now.items() if k in recorded and recorded[k] != v}


TRASH = ".trash"


def soft_delete(notes: DataFrame, path: str) -> DataFrame:
    """A deleted note lies under the trash until it is restored or removed."""
    return rename(notes, path, f"{TRASH}/{path}")


def undelete(notes: DataFrame, name: str) -> DataFrame:
    """Restore by path, old path, file name or short id; several hits are a conflict."""
    trash = notes.where(F.col("path").startswith(TRASH + "/"))
    old = F.substr("path", F.lit(len(TRASH) + 2))
    hits = [r["path"] for r in trash.where((F.col("path") == name) | (old == name) | (F.substring_index("path", "/", -1) == name) | (F.col("docid") == name.lstrip("#"))).select("path").limit(3).collect()]
    if not hits:
        raise LookupError(f"nothing deleted is called {name!r}")
    if len(hits) > 1:
        raise Conflict(f"several deleted notes are called {name!r}: {', '.join(sorted(hits))}")
    return rename(notes, hits[0], hits[0].removeprefix(TRASH + "/"))


def declared_types(config: DataFrame, column: str = "json") -> DataFrame:
    """(name, declared) from JSON of the form {"types": {name: type}}."""
    types = F.from_json(F.get_json_object(column, "$.types"), "map<string,string>")
    return config.select(F.explode(types).alias("name", "declared"))
