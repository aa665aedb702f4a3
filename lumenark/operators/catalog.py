"""Listings and aggregates over notes, tags, properties and edges."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lumenark.functions import text as T


class InvalidInput(ValueError):
    pass


def in_scope(rows: DataFrame, scoped: DataFrame | None, key: str = "file_id") -> DataFrame:
    """Rows whose ``key`` is a note in scope (None: all)."""
    return rows if scoped is None else rows.join(scoped.select(F.col("file_id").alias(key)), key, "left_semi")


def listing(notes: DataFrame, chunks: DataFrame, edges: DataFrame, order: str = "path", after: str | None = None, limit: int = 100) -> DataFrame:
    """Notes with links_in, chunk_count and token_count, a page at a time by key.

    ``after`` is the last path of the page before; for the two link orders it must
    name a note that exists. Sums are made before the joins."""
    links = edges.where("from_file <> to_file").select(F.col("to_file").alias("file_id"), "from_file").distinct().groupBy("file_id").agg(F.count(F.lit(1)).alias("links_in"))
    sums = chunks.groupBy("file_id").agg(F.count(F.lit(1)).alias("chunk_count"), F.sum("token_count").alias("token_count"))
    rows = notes.select("file_id", "path").join(links, "file_id", "left").join(sums, "file_id", "left").fillna(0, ["links_in", "chunk_count", "token_count"])
    if order not in ("path", "links", "fewest"):
        raise InvalidInput(f"unknown order {order!r}")
    down = order == "links"
    if after is not None and order == "path":
        rows = rows.where(F.col("path") > after)
    elif after is not None:
        at = rows.where(F.col("path") == after).select("links_in").head()
        if at is None:
            raise InvalidInput(f"no note {after!r} to continue after")
        n = F.col("links_in")
        rows = rows.where(((n < at[0]) if down else (n > at[0])) | ((n == at[0]) & (F.col("path") > after)))
    return rows.orderBy(*listing_order(order)).limit(limit)


def listing_order(order: str) -> list[Column]:
    n = F.col("links_in")
    return [F.col("path")] if order == "path" else [n.desc() if order == "links" else n.asc(), F.col("path")]


def recent(notes: DataFrame, limit: int = 10) -> DataFrame:
    return notes.select("path", "mtime").orderBy(F.desc("mtime"), "path").limit(limit)


def tags_under(tags: DataFrame, prefix: str | None = None) -> DataFrame:
    hit = tags if prefix is None else tags.where((F.col("tag") == prefix) | F.col("tag").startswith(prefix + "/"))
    return hit.groupBy("tag").agg(F.countDistinct("file_id").alias("notes"))


def top_tags(tags: DataFrame, limit: int = 20) -> DataFrame:
    return tags_under(tags).orderBy(F.desc("notes"), "tag").limit(limit)


def tag_axes(tags: DataFrame) -> DataFrame:
    return tags.groupBy(T.tag_axis(F.col("tag")).alias("axis")).agg(F.countDistinct("file_id").alias("notes"))


def tagged_count(tags: DataFrame) -> DataFrame:
    return tags.agg(F.countDistinct("file_id").alias("tagged_notes"))


def file_tags(tags: DataFrame) -> DataFrame:
    """Each note's tags in order, separated by the unit separator."""
    return tags.groupBy("file_id").agg(F.array_join(F.array_sort(F.collect_set("tag")), "\x1f").alias("tags"))


def property_registry(props: DataFrame, declared: DataFrame | None = None) -> DataFrame:
    """Notes and kinds per property name, with declared types if given."""
    found = props.groupBy("name").agg(F.countDistinct("file_id").alias("notes"), F.array_join(F.array_sort(F.collect_set("kind")), ",").alias("kinds"))
    if declared is None:
        return found
    return found.join(declared.select("name", "declared"), "name", "full").fillna({"notes": 0, "kinds": ""})


def property_values(props: DataFrame, name: str) -> DataFrame:
    return props.where(F.col("name") == name).groupBy("value", "kind").agg(F.countDistinct("file_id").alias("notes"))


def property_findings(props: DataFrame, declared: DataFrame) -> DataFrame:
    """Names of several kinds, names that fold alike, and declared names never used."""
    registry = property_registry(props)
    mixed = registry.where(F.instr("kinds", ",") > 0).select(F.lit("mixed-kinds").alias("rule"), "name", F.col("kinds").alias("detail"))
    folded = registry.select("name", F.regexp_replace(F.lower("name"), "[-_ ]", "").alias("folded"))
    other = folded.select(F.col("name").alias("detail"), "folded")
    close = folded.join(other, "folded").where(F.col("name") < F.col("detail")).select(F.lit("name-collision").alias("rule"), "name", "detail")
    unused = declared.join(registry, "name", "left_anti").select(F.lit("declared-unused").alias("rule"), "name", F.col("declared").alias("detail"))
    return mixed.unionByName(close).unionByName(unused)


def note_properties(props: DataFrame) -> DataFrame:
    """A map per note: name to values in order."""
    per = props.groupBy("file_id", "name").agg(F.array_sort(F.collect_list("value")).alias("values"))
    return per.groupBy("file_id").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("name", "values")))).alias("properties"))


def top_linked(edges: DataFrame, limit: int = 10) -> DataFrame:
    return edges.groupBy("to_file").agg(F.countDistinct("from_file").alias("links_in")).orderBy(F.desc("links_in"), "to_file").limit(limit)


def edge_stats(edges: DataFrame, notes: DataFrame) -> DataFrame:
    """Totals, and how many notes have an edge at all: one pass over edges and one
    over notes, joined on a constant row."""
    ends = edges.select(F.col("from_file").alias("file_id")).union(edges.select(F.col("to_file").alias("file_id"))).distinct()
    totals = edges.agg(F.count(F.lit(1)).alias("total"), F.count_if(F.col("edge_type") == "wikilink").alias("wikilinks")).withColumn("k", F.lit(1))
    mine = notes.select("file_id").join(ends.withColumn("hit", F.lit(1)), "file_id", "left").agg(F.count("hit").alias("connected"), F.count(F.lit(1)).alias("n")).withColumn("k", F.lit(1))
    return totals.join(mine, "k").select("total", "wikilinks", "connected", (F.col("n") - F.col("connected")).alias("isolated"))


def edge_counts(edges: DataFrame) -> DataFrame:
    """Edges per note, both directions."""
    return edges.select(F.col("from_file").alias("file_id")).union(edges.select(F.col("to_file").alias("file_id"))).groupBy("file_id").agg(F.count(F.lit(1)).alias("edges"))


def folder_counts(notes: DataFrame) -> DataFrame:
    folder = F.when(F.instr("path", "/") > 0, F.substring_index("path", "/", 1)).otherwise("(root)")
    return notes.groupBy(folder.alias("folder")).agg(F.count(F.lit(1)).alias("notes"))


def totals(notes: DataFrame, chunks: DataFrame, edges: DataFrame) -> DataFrame:
    """Files, their chunks and the edges that start in them, as one row."""
    n = notes.select(F.lit("files").alias("what"))
    c = in_scope(chunks, notes).select(F.lit("chunks").alias("what"))
    e = in_scope(edges, notes, "from_file").select(F.lit("edges").alias("what"))
    return n.union(c).union(e).agg(*(F.count_if(F.col("what") == w).alias(w) for w in ("files", "chunks", "edges")))


def structure(notes: DataFrame) -> DataFrame:
    """Folder shares that tell a vault's structure: dated names, people, tagged notes."""
    folder = F.when(F.instr("path", "/") > 0, F.regexp_replace("path", "/[^/]*$", "")).otherwise("(root)")
    name = F.substring_index("path", "/", -1)
    daily = name.rlike(r"^\d{4}-\d{2}-\d{2}").cast("int")
    return notes.groupBy(folder.alias("folder")).agg(F.count(F.lit(1)).alias("notes"), F.sum(daily).alias("daily"), F.max(F.size(F.split("path", "/")) - 1).cast("long").alias("depth")).withColumn("is_daily", F.floor(F.col("daily") * 100 / F.col("notes")) >= 60)


# The roles that a top folder's name may tell, after leading digits and one
# run of separators, and how many of the first four make the numbered method.
ROLES = ("inbox", "projects", "areas", "resources", "archive", "templates", "daily", "people")
METHOD_ROLES = ("inbox", "projects", "areas", "resources")
METHOD_LEAST = 3
FOLDER_PERCENT = 60


def profile(notes: DataFrame, people: DataFrame) -> DataFrame:
    """(role, folder, found_by, notes): the folders of a vault by role, from their names,
    and for daily notes and people, where no name tells, from their notes' names or from
    ``people`` (file_id of notes on people), if that holds for 60 in 100 of a top folder's
    own notes; the first such folder by name. The row ``method`` has para, folders or flat."""
    parts = F.split("path", "/")
    inside = notes.where(F.instr("path", "/") > 0).select("file_id", F.col("path"), parts[0].alias("folder"), (F.size(parts) == 2).alias("own"))
    person = inside.join(people.select("file_id").distinct().withColumn("person", F.lit(1)), "file_id", "left")
    dated = F.substring_index("path", "/", -1).rlike(r"^\d{4}-\d{2}-\d{2}").cast("int")
    own = lambda c: F.sum(F.when(F.col("own"), c).otherwise(0))
    folders = person.groupBy("folder").agg(F.count(F.lit(1)).alias("notes"), own(F.lit(1)).alias("own"), own(dated).alias("daily"), own(F.coalesce("person", F.lit(0))).alias("people"))
    folders = folders.withColumn("role", F.lower(F.regexp_replace("folder", r"^\d*[-_ ]*", "")))
    named = folders.where(F.col("role").isin(*ROLES)).groupBy("role").agg(F.min_by(F.struct("folder", "notes"), "folder").alias("f")).select("role", "f.folder", F.lit("name").alias("found_by"), "f.notes")
    shape = folders.agg(F.count_distinct(F.when(F.col("role").isin(*METHOD_ROLES), F.col("role"))).alias("hits"), F.count(F.lit(1)).alias("n"))
    method = F.when(F.col("hits") >= METHOD_LEAST, "para").when(F.col("n") > 0, "folders").otherwise("flat")
    out = named.unionByName(shape.select(F.lit("method").alias("role"), method.alias("folder"), F.lit("shape").alias("found_by"), F.lit(0).cast("long").alias("notes")))
    loose = shape.where(F.col("hits") < METHOD_LEAST).select(F.lit(1).alias("_one"))
    for role in ("people", "daily"):
        share = folders.where((F.col("own") > 0) & (F.floor(F.col(role) * 100 / F.col("own")) >= FOLDER_PERCENT))
        first = share.agg(F.min_by(F.struct("folder", "notes"), "folder").alias("f")).where("f is not null").select(F.lit(role).alias("role"), "f.folder", F.lit("notes").alias("found_by"), "f.notes", F.lit(1).alias("_one"))
        out = out.unionByName(first.join(named.select("role"), "role", "left_anti").join(loose, "_one", "left_semi").drop("_one"))
    return out


def hygiene(notes: DataFrame, tags: DataFrame, inbox: str | None = None, archive: str = "04-Archive", work: str = "Work/", tag: str = "work") -> DataFrame:
    """(finding, file_id, detail): notes waiting in the inbox folder, and live notes under
    ``work`` without its tag."""
    row = lambda df, kind: df.select(F.lit(kind).alias("finding"), "file_id", F.col("path").alias("detail"))
    at_work = notes.where(F.col("path").contains(work) & ~F.col("path").startswith(archive + "/"))
    out = row(at_work.join(tags.where(F.lower("tag") == tag).select("file_id"), "file_id", "left_anti"), "work-tag-missing")
    return out if inbox is None else out.unionByName(row(notes.where(F.col("path").startswith(inbox)), "inbox-pending"))


def vault_map(notes: DataFrame, tags: DataFrame, edges: DataFrame) -> DataFrame:
    """One table of sections: folders, tags, axes, linked and recent notes."""
    row = lambda df, section, name, n: df.select(F.lit(section).alias("section"), F.col(name).cast("string").alias("name"), F.col(n).cast("long").alias("n"))
    return (
        row(folder_counts(notes), "folder", "folder", "notes")
        .union(row(top_tags(tags), "tag", "tag", "notes"))
        .union(row(tag_axes(tags), "axis", "axis", "notes"))
        .union(row(top_linked(edges), "linked", "to_file", "links_in"))
        .union(row(recent(notes), "recent", "path", "mtime"))
    )
