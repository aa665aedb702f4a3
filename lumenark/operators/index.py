"""The stored index of a vault: a base, deltas and tombstones, merged when read.

Tables: notes, parsed (tags, aliases, properties), chunks, links, edges, unresolved,
postings, lengths and vectors (with a model). Rows belong to a file. A *part* is a folder
of some tables, written once; the base is a part of all. What a change replaces is not
rewritten: a later part brings the new rows, and *tombstones* (ids of files) beside it
take the older parts' rows out when tables are read. So the bytes that ``refresh`` writes
follow the change, not the vault; ``compact`` writes a new base when parts have become
many, and ``vacuum`` removes folders that no kept version names.

A version is one small manifest, ``_log/<number>.json``: its parts, tombstones, counts and
fingerprints. Committing puts that file where none may be yet, so of two writers of one
version the later gets ``Conflict`` and tries again on what the other wrote, and a reader
sees a version whole or not at all. On a file system without such a put (some object
stores) only one writer at a time is safe.

Notes that cannot be parsed, chunked or embedded stop nothing: they are set aside in
``faults`` with the error and the number of attempts, keep the rows of their last good
state, and are tried again by every later refresh, as their hash is not the stored one."""

from __future__ import annotations

import json
import os
import time
import uuid
from dataclasses import asdict
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from lumenark.functions import text as T
from lumenark.operators import graph, keyword, markdown, store, vector
from lumenark.operators.store import Conflict

#: Whose tombstones take a table's rows out: of files whose own rows changed, or of files
#: whose edges did.
KIND = {"notes": "own", "parsed": "own", "chunks": "own", "links": "own", "postings": "own", "lengths": "own", "vectors": "own", "edges": "edges", "unresolved": "edges"}
OWNER = {"edges": "from_file"}
#: Parts after which a refresh compacts, and tombstones (8 bytes each) that are broadcast.
PARTS, BROADCAST_IDS = 8, 1_000_000
FAULTS = "file_id long, path string, content_hash string, attempts int, error string"


def made_by(options: markdown.ChunkOptions, model: vector.EmbedModel | None, shape: keyword.Shape = keyword.Shape()) -> dict[str, str]:
    return store.fingerprints({"parser": 1, "chunker": asdict(options), "embedding": getattr(model, "name", type(model).__name__) if model else None, "link": 1, "fts": [*shape.fields, shape.fold]})


# --- the log -----------------------------------------------------------------


def _fs(spark: SparkSession, path: str):
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), p


def versions(spark: SparkSession, root: str) -> list[int]:
    fs, log = _fs(spark, f"{root}/_log")
    names = [s.getPath().getName() for s in fs.listStatus(log)] if fs.exists(log) else []
    return sorted(int(n[:-5]) for n in names if n.endswith(".json") and n[:-5].isdigit())


def latest(spark: SparkSession, root: str) -> int:
    """The last version, 0 if there is none."""
    return max(versions(spark, root), default=0)


def manifest(spark: SparkSession, root: str, version: int) -> dict:
    fs, p = _fs(spark, f"{root}/_log/{version:010d}.json")
    if not fs.exists(p):
        raise FileNotFoundError(f"no version {version} in {root}")
    stream = fs.open(p)
    try:
        return json.loads(spark.sparkContext._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8"))
    finally:
        stream.close()


def commit(spark: SparkSession, root: str, m: dict) -> int:
    """Make ``m`` the version that it names, unless another writer has."""
    fs, final = _fs(spark, f"{root}/_log/{m['version']:010d}.json")
    _, tmp = _fs(spark, f"{root}/_log/.{uuid.uuid4().hex}.tmp")
    stream = fs.create(tmp, True)
    stream.write(bytearray(json.dumps(m).encode()))
    stream.close()
    try:
        if fs.getScheme() == "file":  # a rename would replace there; a link never does
            os.link(tmp.toUri().getPath(), final.toUri().getPath())
            won = True
        else:
            won = not fs.exists(final) and fs.rename(tmp, final)
    except FileExistsError:
        won = False
    fs.delete(tmp, False)
    if not won:
        raise Conflict(f"version {m['version']} of {root} was written by another")
    return m["version"]


# --- reading -----------------------------------------------------------------


def _schema(known: dict) -> StructType:
    """A table's columns as its manifest has them: no file is opened to learn them."""
    return StructType.fromJson(known)


def _gone(spark: SparkSession, root: str, stones: list[dict]) -> DataFrame:
    ids = reduce(DataFrame.union, (spark.read.schema("file_id long").parquet(f"{root}/{g['at']}") for g in stones)).distinct()
    return F.broadcast(ids) if sum(g["rows"] for g in stones) <= BROADCAST_IDS else ids


def _merged(spark: SparkSession, root: str, m: dict, name: str) -> DataFrame | None:
    """A table of a version: its parts' rows without those of later tombstones."""
    out, owner = None, OWNER.get(name, "file_id")
    for part in m["parts"]:
        if name not in part["tables"]:
            continue
        rows = spark.read.schema(_schema(part["tables"][name])).parquet(f"{root}/{part['at']}/{name}")
        later = [g for g in m["gone"] if g["kind"] == KIND[name] and g["seq"] > part["seq"] and g["rows"]]
        if later:
            columns = rows.columns
            rows = rows.join(_gone(spark, root, later).withColumnRenamed("file_id", owner), owner, "left_anti").select(columns)
        out = rows if out is None else out.unionByName(rows, allowMissingColumns=True)
    return out


def read(spark: SparkSession, root: str, version: int, model: vector.EmbedModel | None = None) -> dict[str, DataFrame]:
    m = manifest(spark, root, version)
    found = {n: _merged(spark, root, m, n) for n in KIND if n != "vectors" or model is not None}
    return {n: df for n, df in found.items() if df is not None}


def counts(spark: SparkSession, root: str, version: int) -> keyword.Counts:
    c = manifest(spark, root, version)["counts"]
    return keyword.Counts(c["rows"], tuple(c["words"]))


def faults(spark: SparkSession, root: str, version: int) -> DataFrame:
    at = manifest(spark, root, version)["faults"]
    return spark.read.schema(FAULTS).parquet(f"{root}/{at}") if at else spark.createDataFrame([], FAULTS)


# --- making ------------------------------------------------------------------


class _Part:
    """A folder of tables that is being written."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root, self.at, self.tables = spark, root, f"data/{uuid.uuid4().hex}", {}

    def put(self, name: str, df: DataFrame) -> DataFrame:
        """Write a table and read it back; names with ``_`` are helpers and go at the end."""
        if KIND.get(name) == "own" and name != "postings":  # one note's rows lie together
            df = df.repartitionByRange("file_id").sortWithinPartitions("file_id")
        elif name == "postings":
            df = keyword.laid_out(df)
        df.write.option("parquet.writer.version", "v2").parquet(f"{self.root}/{self.at}/{name}")
        self.tables[name] = json.loads(df.schema.json())
        return self.get(name)

    def get(self, name: str) -> DataFrame:
        return self.spark.read.schema(_schema(self.tables[name])).parquet(f"{self.root}/{self.at}/{name}")

    def stone(self, ids: DataFrame, kind: str, seq: int) -> dict:
        rows = self.put(f"_gone_{kind}", ids.select("file_id").distinct()).count()
        return {"at": f"{self.at}/_gone_{kind}", "seq": seq, "kind": kind, "rows": rows}

    def done(self, seq: int, *helpers: str) -> dict:
        for h in self.tables.keys() & {*helpers}:
            fs, p = _fs(self.spark, f"{self.root}/{self.at}/{h}")
            fs.delete(p, True)
        return {"at": self.at, "seq": seq, "tables": {n: s for n, s in self.tables.items() if not n.startswith("_")}}


def _edges(links: DataFrame, notes: DataFrame, chunks: DataFrame) -> tuple[DataFrame, DataFrame]:
    return graph.edges_of(links, notes.select("file_id", "path"), chunks.select("file_id", "seq", "heading"))


def _searchable(chunks: DataFrame, parsed: DataFrame, shape: keyword.Shape) -> DataFrame:
    if "tags_text" not in shape.fields:
        return chunks
    return chunks.join(parsed.select("file_id", F.array_join(F.array_sort(F.array_distinct(F.transform("tags", lambda t: t["folded"]))), " ").alias("tags_text")), "file_id", "left")


def _own(part: _Part, notes: DataFrame, options: markdown.ChunkOptions, model: vector.EmbedModel | None, shape: keyword.Shape) -> DataFrame:
    """Write what follows from notes alone; gives the notes that could not be made
    (file_id, path, content_hash, error). A note is read and chunked once."""
    staged = part.put("_staged", markdown.digest(notes, options))
    bad = staged.where("error is not null").select("file_id", "error")
    good = staged.where("error is null")
    rows = good.select("file_id", "path", F.inline("chunks"))
    if model is not None:
        vectors = part.put("_vectors", vector.embed_each(rows.select("file_id", "seq", "text"), model))
        bad = bad.unionByName(vectors.where("error is not null").groupBy("file_id").agg(F.min("error").alias("error")))
    bad = part.put("_bad", bad)
    fine = lambda df: df.join(bad.select("file_id"), "file_id", "left_anti")
    part.put("notes", fine(notes))
    parsed = part.put("parsed", fine(good).select("file_id", "path", "frontmatter", "tags", "aliases", "properties"))
    chunks = part.put("chunks", fine(rows).select("file_id", "path", "seq", "heading", "heading_path", "text", "token_count"))
    part.put("links", graph.link_rows(chunks))
    words = _searchable(chunks, parsed, shape)
    part.put("postings", keyword.postings(words, shape))
    part.put("lengths", keyword.lengths(words, shape))
    if model is not None:
        part.put("vectors", fine(vectors).select("file_id", "seq", "vector"))
    return notes.join(bad, "file_id").select("file_id", "path", "content_hash", "error")


HELPERS = ("_staged", "_vectors", "_bad", "_changes", "_found", "_links")


def build(notes: DataFrame, root: str, options: markdown.ChunkOptions, model: vector.EmbedModel | None = None, shape: keyword.Shape = keyword.Shape()) -> int:
    """All tables from notes, as the next version."""
    spark = notes.sparkSession
    before = latest(spark, root)
    part = _Part(spark, root)
    notes = part.put("_found", notes)  # files are read once
    bad = _own(part, notes, options, model, shape)
    kept = {n: part.get(n) for n in ("notes", "chunks", "links", "lengths")}
    edges, unresolved = _edges(kept["links"], kept["notes"], kept["chunks"])
    part.put("edges", edges)
    part.put("unresolved", unresolved)
    aside = _set_aside(part, bad, faults(spark, root, before) if before else None, None)
    c = keyword.counted(kept["lengths"], shape)
    m = {"version": before + 1, "parts": [part.done(before + 1, *HELPERS)], "gone": [], "faults": aside, "counts": {"rows": c.rows, "words": list(c.words)}, "prints": made_by(options, model, shape)}
    return commit(spark, root, m)


def _set_aside(part: _Part, bad: DataFrame, before: DataFrame | None, untouched: DataFrame | None) -> str:
    """Write the faults of a version: ``bad``, one attempt more than before, and what of
    before was not tried (``untouched``: paths)."""
    known = before if before is not None else part.spark.createDataFrame([], FAULTS)
    old = known.select("path", F.col("content_hash").alias("_hash"), F.col("attempts").alias("_tried"))
    again = F.when(F.col("_hash") == F.col("content_hash"), F.col("_tried")).otherwise(0)
    rows = bad.join(old, "path", "left").select("file_id", "path", "content_hash", (F.coalesce(again, F.lit(0)) + 1).cast("int").alias("attempts"), "error")
    if untouched is not None:
        rows = rows.unionByName(known.join(untouched, "path", "left_semi").select(rows.columns))
    part.put("_faults", rows)
    return f"{part.at}/_faults"


def reaching(links: DataFrame, paths: DataFrame) -> DataFrame:
    """(file_id) of notes with a link that one of ``paths`` (file_id, path), new or gone,
    may answer."""
    tail = F.regexp_replace(F.lower("target"), r"\.md$", "")
    return links.select("file_id", tail.alias("tail")).join(graph.suffixes(paths).select("tail").distinct(), "tail", "left_semi").select("file_id").distinct()


def _refreshed(spark: SparkSession, root: str, m: dict, found: DataFrame, options, model, shape, only: str | None) -> dict | None:
    """The manifest of the version after ``m``, its part written; None if nothing changed."""
    seq = m["version"] + 1
    old = {n: _merged(spark, root, m, n) for n in KIND}
    part = _Part(spark, root)
    before = old["notes"] if only is None else old["notes"].where((F.col("file_id") == F.xxhash64(F.lit(only))) & (F.col("path") == only))
    change = part.put("_changes", store.diff(found, before).withColumn("file_id", F.xxhash64("path")))
    if not change.limit(1).count():
        return None
    own = part.put("_found", found.join(change.where("change <> 'deleted'").select("path"), "path", "left_semi"))
    bad = _own(part, own, options, model, shape)
    new = {n: part.get(n) for n in ("notes", "links", "chunks", "lengths")}
    # what is replaced: deleted notes, and changed ones that could be made
    gone = change.where("change = 'deleted'").select("file_id").union(change.where("change = 'changed'").join(new["notes"].select("file_id"), "file_id", "left_semi").select("file_id"))
    stones = [part.stone(gone, "own", seq)]
    gone = part.get("_gone_own")
    after = {n: old[n].join(F.broadcast(gone) if stones[0]["rows"] <= BROADCAST_IDS else gone, "file_id", "left_anti").unionByName(new[n], allowMissingColumns=True) for n in ("notes", "links", "chunks")}
    # whose edges may differ: changed notes, those that link to one, those that a path
    # that came or went may answer
    moved = change.where("change = 'deleted'").select("file_id", "path").union(change.where("change = 'new'").join(new["notes"].select("file_id"), "file_id", "left_semi").select("file_id", "path"))
    to_gone = old["edges"].join(gone.select(F.col("file_id").alias("to_file")), "to_file", "left_semi").select(F.col("from_file").alias("file_id"))
    stones.append(part.stone(new["notes"].select("file_id").union(gone).union(to_gone).union(reaching(after["links"], moved)), "edges", seq))
    touched = part.get("_gone_edges")
    links = part.put("_links", after["links"].join(touched, "file_id", "left_semi"))
    edges, unresolved = _edges(links, after["notes"], after["chunks"])
    part.put("edges", edges)
    part.put("unresolved", unresolved)
    untouched = None
    if only is not None:
        untouched = faults(spark, root, m["version"]).where(F.col("path") != only).select("path")
    aside = _set_aside(part, bad, faults(spark, root, m["version"]), untouched)
    c = keyword.Counts(m["counts"]["rows"], tuple(m["counts"]["words"])) - keyword.counted(old["lengths"].join(gone, "file_id", "left_semi"), shape) + keyword.counted(new["lengths"], shape)
    return {"version": seq, "parts": [*m["parts"], part.done(seq, *HELPERS)], "gone": [*m["gone"], *stones], "faults": aside, "counts": {"rows": c.rows, "words": list(c.words)}, "prints": m["prints"]}


def refresh(spark: SparkSession, root: str, found: DataFrame, options: markdown.ChunkOptions, model: vector.EmbedModel | None = None, shape: keyword.Shape = keyword.Shape(), only: str | None = None, attempts: int = 5, parts: int = PARTS) -> int:
    """The index of the notes found by a later scan (``only``: of this path alone, and
    ``found`` is at most its note). A conflict with another writer is tried again on what
    that one wrote. Too many parts are made one."""
    for attempt in range(attempts):
        m = manifest(spark, root, latest(spark, root))
        todo = _refreshed(spark, root, m, found, options, model, shape, only)
        if todo is None:
            return m["version"]
        try:
            version = commit(spark, root, todo)
            break
        except Conflict:
            if attempt + 1 == attempts:
                raise
    return compact(spark, root) if len(todo["parts"]) > parts else version


def compact(spark: SparkSession, root: str) -> int:
    """The same tables as one part without tombstones, as the next version."""
    m = manifest(spark, root, latest(spark, root))
    part, seq = _Part(spark, root), m["version"] + 1
    for name in KIND:
        df = _merged(spark, root, m, name)
        if df is not None:
            part.put(name, df)
    aside = _set_aside(part, faults(spark, root, m["version"]).drop("attempts").where("false"), faults(spark, root, m["version"]), faults(spark, root, m["version"]).select("path"))
    return commit(spark, root, m | {"version": seq, "parts": [part.done(seq)], "gone": [], "faults": aside})


def vacuum(spark: SparkSession, root: str, keep: int = 2, older_than: float = 86_400.0) -> int:
    """Remove the manifests of all but the last ``keep`` versions and the folders that none
    of these names, if they were made ``older_than`` seconds ago (a writer may still be at
    work in younger ones); gives the number of folders removed."""
    all_, removed = versions(spark, root), 0
    kept = [manifest(spark, root, v) for v in all_[-keep:]]
    named = {x["at"].split("/")[1] for m in kept for x in (*m["parts"], *m["gone"])} | {m["faults"].split("/")[1] for m in kept if m["faults"]}
    fs, data = _fs(spark, f"{root}/data")
    for s in fs.listStatus(data) if fs.exists(data) else []:
        if s.getPath().getName() not in named and s.getModificationTime() / 1000 <= time.time() - older_than:
            fs.delete(s.getPath(), True)
            removed += 1
    for v in all_[:-keep]:
        fs.delete(_fs(spark, f"{root}/_log/{v:010d}.json")[1], False)
    return removed


def adopt(spark: SparkSession, root: str, version: int, options: markdown.ChunkOptions, model: vector.EmbedModel | None = None, shape: keyword.Shape = keyword.Shape()) -> int:
    """The version to read: ``version`` if it was made as asked now, else a new one with
    what is stale made anew from the stored notes or chunks. What a store has no record of
    is stale."""
    m, now = manifest(spark, root, version), made_by(options, model, shape)
    todo = set(store.stale(dict.fromkeys(now, "") | m["prints"], now).values())
    if "reindex" in todo:
        return build(_merged(spark, root, m, "notes"), root, options, model, shape)
    if todo & {"rebuild_edges", "rebuild_fts"}:
        t, part, seq, c = read(spark, root, version), _Part(spark, root), version + 1, m["counts"]
        if "rebuild_edges" in todo:
            links = part.put("links", graph.link_rows(t["chunks"]))
            edges, unresolved = _edges(links, t["notes"], t["chunks"])
            part.put("edges", edges)
            part.put("unresolved", unresolved)
        if "rebuild_fts" in todo:
            words = _searchable(t["chunks"], t["parsed"], shape)
            part.put("postings", keyword.postings(words, shape))
            made = keyword.counted(part.put("lengths", keyword.lengths(words, shape)), shape)
            c = {"rows": made.rows, "words": list(made.words)}
        others = [p | {"tables": {n: x for n, x in p["tables"].items() if n not in part.tables}} for p in m["parts"]]
        return commit(spark, root, m | {"version": seq, "parts": [*others, part.done(seq)], "counts": c, "prints": now})
    return version if m["prints"] == now else commit(spark, root, m | {"version": version + 1, "prints": now})


def note_at(spark: SparkSession, folder: str, path: str) -> DataFrame:
    """The one note of a path below ``folder``, as ``read_vault`` has it; a path outside is
    refused, a missing one an error."""
    parts = path.split("/")
    if path.startswith("/") or any(p in ("", ".", "..") for p in parts) or ":" in parts[0] or "\\" in path:
        raise ValueError(f"{path!r} does not lie within the vault")
    fs, p = _fs(spark, f"{folder.rstrip('/')}/{path}")
    if not fs.exists(p) or not fs.getFileStatus(p).isFile():
        raise FileNotFoundError(path)
    escaped = "".join("\\" + c if c in "*?[]{}\\" else c for c in f"{folder.rstrip('/')}/{path}")
    files = spark.read.format("binaryFile").load(escaped)
    out = files.select(F.lit(path).alias("path"), F.decode("content", "UTF-8").alias("content"), F.sha2("content", 256).alias("content_hash"), F.unix_timestamp("modificationTime").alias("mtime"))
    return out.withColumns({"note_date": T.note_date(T.frontmatter_date(F.col("content")), F.col("path")), "docid": T.docid(F.col("path")), "file_id": F.xxhash64("path")})
