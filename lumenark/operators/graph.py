"""Links between notes: neighbours, resolution, a personalised PageRank hop, health."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lumenark.functions import text as T


@dataclass(frozen=True)
class Walk:
    iterations: int = 1
    alpha: float = 0.6
    out_degree: float = 1.0
    spread: float = 0.5
    off_chunk: float = 0.5
    limit: int = 20
    cap: int = 3
    #: Chunks that a further hop starts from, those of the largest mass.
    frontier: int = 2000


def both_ways(edges: DataFrame) -> DataFrame:
    """Every edge from both of its ends; reciprocal edges count twice."""
    near = edges.select(F.col("from_file").alias("file_id"), F.col("from_chunk_seq").alias("near_seq"), F.col("to_file").alias("far_file"), F.col("to_chunk_seq").alias("far_seq"))
    far = edges.select(F.col("to_file").alias("file_id"), F.col("to_chunk_seq").alias("near_seq"), F.col("from_file").alias("far_file"), F.col("from_chunk_seq").alias("far_seq"))
    return near.unionByName(far)


def hop(frontier: DataFrame, edges: DataFrame, chunks: DataFrame, w: Walk = Walk(), first: bool = False) -> DataFrame:
    """Mass (file_id, seq, mass) that one hop sends on. The frontier is a shortlist (the
    seeds of a search: at most the lanes' widths, and in later hops the walk's
    ``frontier``), so only edges that touch its files take part: a small one (``first``)
    is broadcast and the edges are filtered where they are read. A whole-note end spreads over all of the note's
    chunks."""
    touching = both_ways(edges).join(F.broadcast(frontier) if first else frontier, "file_id").where("far_file <> file_id")
    weight = F.when((F.col("near_seq") == F.col("seq")) | (F.col("near_seq") == -1), 1.0).otherwise(w.off_chunk)
    touching = touching.withColumn("weight", weight)
    degree = touching.groupBy("file_id", "seq").agg(F.sum("weight").alias("degree"))
    sent = touching.join(degree, ["file_id", "seq"]).withColumn("sent", F.col("mass") * F.col("weight") / F.pow("degree", F.lit(w.out_degree)))
    exact = sent.where("far_seq <> -1").select(F.col("far_file").alias("file_id"), F.col("far_seq").alias("seq"), "sent")
    whole = sent.where("far_seq = -1").groupBy(F.col("far_file").alias("file_id")).agg(F.sum("sent").alias("sent"))
    targets = chunks.select("file_id", "seq").join(whole.select("file_id"), "file_id", "left_semi")
    counts = targets.groupBy("file_id").agg(F.count(F.lit(1)).alias("n"))
    spread = targets.join(whole, "file_id").join(counts, "file_id").select("file_id", "seq", (F.col("sent") / F.pow("n", F.lit(w.spread))).alias("sent"))
    return exact.unionByName(spread).groupBy("file_id", "seq").agg(F.sum("sent").alias("mass"))


def expand(seeds: DataFrame, edges: DataFrame, chunks: DataFrame, w: Walk = Walk(), scoped: DataFrame | None = None, few: bool = False) -> DataFrame:
    """``few``: the seeds come from lanes of bounded width. The walk's ranking (file_id, seq, score): masses of all hops, damped, then
    scope (admission, not traversal), cap per file and limit."""
    frontier = seeds.groupBy("file_id", "seq").agg(F.sum("score").alias("mass"))
    out = None
    for i in range(w.iterations):
        frontier = hop(frontier, edges, chunks, w, few if i == 0 else 0 < w.frontier <= 2000)
        x = frontier.select("file_id", "seq", (F.col("mass") * w.alpha ** (i + 1)).alias("mass"))
        out = x if out is None else out.unionByName(x)
        if i + 1 < w.iterations and w.frontier > 0:
            frontier = frontier.orderBy(F.desc("mass"), "file_id", "seq").limit(w.frontier)
    total = out.groupBy("file_id", "seq").agg(F.sum("mass").alias("score"))
    if scoped is not None:
        total = total.join(scoped.select("file_id"), "file_id", "left_semi")
    order = [F.desc("score"), F.asc("file_id"), F.asc("seq")]
    capped = total.withColumn("_r", F.row_number().over(W.partitionBy("file_id").orderBy(*order))).where(F.col("_r") <= w.cap).drop("_r") if w.cap else total
    return capped.orderBy(*order).limit(w.limit)


def neighbours(edges: DataFrame, incoming: bool = False) -> DataFrame:
    a, b = ("to_file", "from_file") if incoming else ("from_file", "to_file")
    return edges.select(F.col(a).alias("file_id"), F.col(b).alias("neighbour")).distinct()


def suffixes(notes: DataFrame) -> DataFrame:
    """Every lower-cased tail of each path, at segment borders, without ``.md``: the
    suffix match of links becomes an equi join."""
    parts = F.split(F.regexp_replace(F.lower("path"), r"\.md$", ""), "/")
    tails = F.transform(F.sequence(F.lit(1), F.size(parts)), lambda i: F.array_join(F.slice(parts, i, F.size(parts) - i + 1), "/"))
    return notes.select("file_id", "path", F.explode(tails).alias("tail"))


def resolve(targets: DataFrame, notes: DataFrame, archive: str = "04-Archive") -> DataFrame:
    """(target, file_id, path) of each distinct ``target``: the exact path first, else
    by suffix in any case; live before archived, then the shortest path, then its name."""
    asked = targets.select("target").distinct().withColumn("tail", F.regexp_replace(F.lower("target"), r"\.md$", ""))
    hit = asked.join(suffixes(notes), "tail")
    exact = (F.col("path") == F.col("target")) | (F.col("path") == F.concat("target", F.lit(".md")))
    order = W.partitionBy("target").orderBy(F.desc(exact.cast("int")), F.col("path").startswith(archive + "/").cast("int"), F.char_length("path"), "path")
    return hit.withColumn("_r", F.row_number().over(order)).where("_r = 1").select("target", "file_id", "path")


def link_rows(chunks: DataFrame) -> DataFrame:
    """(file_id, seq, target, heading): the distinct links of each chunk."""
    links = chunks.select("file_id", "seq", F.explode(T.wikilinks(F.col("text"))).alias("link")).select("file_id", "seq", T.link_note(F.col("link")).alias("target"), T.link_heading(F.col("link")).alias("heading"))
    return links.where("target <> ''").distinct()


def derive_edges(chunks: DataFrame, notes: DataFrame, headings: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """Edges and unresolved links of all ``chunks`` (file_id, seq, text). A link with a
    heading leads to the chunks under it (``headings``: file_id, seq, heading), else to
    the whole note."""
    return edges_of(link_rows(chunks), notes, headings)


def edges_of(links: DataFrame, notes: DataFrame, headings: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """Edges and unresolved links of rows of ``link_rows``."""
    found = resolve(links, notes).select("target", F.col("file_id").alias("to_file"))
    joined = links.join(found, "target", "left")
    unresolved = joined.where(F.col("to_file").isNull()).select("file_id", "target").distinct()
    good = joined.where(F.col("to_file").isNotNull() & (F.col("to_file") != F.col("file_id")))
    if headings is not None:
        under = headings.select(F.col("file_id").alias("to_file"), F.col("seq").alias("to_seq"), T.heading_key(F.col("heading")).alias("key"))
        good = good.withColumn("key", T.heading_key(F.col("heading"))).join(under, ["to_file", "key"], "left").withColumn("to_seq", F.coalesce("to_seq", F.lit(-1)))
    else:
        good = good.withColumn("to_seq", F.lit(-1))
    edges = good.select(F.col("file_id").alias("from_file"), F.col("seq").alias("from_chunk_seq"), "to_file", F.col("to_seq").cast("long").alias("to_chunk_seq"), F.lit("wikilink").alias("edge_type")).distinct()
    return edges, unresolved


def property_targets(props: DataFrame, notes: DataFrame) -> DataFrame:
    """``props`` (file_id, name, value, kind) with ``target_file``: the note that a property
    whose value is a link names, resolved as links in texts are; null for other kinds and
    for links to no note."""
    link = F.col("kind").eqNullSafe("link") & F.col("value").isNotNull()
    # links are read once for each distinct value; counted, so that no filter on what is read sinks below
    values = props.where(link).groupBy("value").agg(F.count(F.lit(1)).alias("_n"))
    values = values.select("value", F.when(F.col("_n") > 0, T.link_note(F.get(T.wikilinks(F.col("value")), F.lit(0)))).alias("target")).where("target <> ''")
    found = values.join(resolve(values, notes), "target").select("value", F.col("file_id").alias("target_file"))
    # a row a value is hashed and the properties stream by unsorted; what is no link takes no part
    named = props.where(link).join(found.hint("shuffle_hash"), "value", "left").select(*props.columns, "target_file")
    return named.unionByName(props.where(~link).withColumn("target_file", F.lit(None).cast(named.schema["target_file"].dataType)))


def reconcile(unresolved: DataFrame, notes: DataFrame) -> DataFrame:
    """Notes whose unresolved links resolve now."""
    return unresolved.join(resolve(unresolved, notes).select("target"), "target", "left_semi").select("file_id").distinct()


def orphans(notes: DataFrame, edges: DataFrame, outside: tuple[str, ...] = ()) -> DataFrame:
    """Notes without any edge, not in the folders given."""
    ends = edges.select(F.col("from_file").alias("file_id")).union(edges.select(F.col("to_file").alias("file_id"))).distinct()
    out = notes
    for folder in outside:
        out = out.where(~F.col("path").startswith(folder + "/"))
    return out.join(ends, "file_id", "left_anti")


def stale_headings(chunks: DataFrame, notes: DataFrame, headings: DataFrame) -> DataFrame:
    """Links to a heading that the note they resolve to does not have."""
    links = chunks.select("file_id", F.explode(T.wikilinks(F.col("text"))).alias("link")).select("file_id", T.link_note(F.col("link")).alias("target"), T.link_heading(F.col("link")).alias("heading")).where(F.col("heading").isNotNull() & (F.col("target") != ""))
    to = resolve(links, notes).select("target", F.col("file_id").alias("to_file"))
    have = headings.select(F.col("file_id").alias("to_file"), T.heading_key(F.col("heading")).alias("key")).distinct()
    return links.join(to, "target").withColumn("key", T.heading_key(F.col("heading"))).join(have, ["to_file", "key"], "left_anti").select("file_id", "target", "heading").distinct()


def resolve_tags(proposed: DataFrame, tags: DataFrame) -> DataFrame:
    """(proposed, resolved, how): the tag itself, a sibling whose leaf is within two
    edits, an existing tag that it extends, or new. Siblings meet by their parent, so
    this is an equi join."""
    known = tags.select(F.lower("tag").alias("tag")).distinct()
    parent = lambda c: F.regexp_replace(c, "/?[^/]*$", "")
    leaf = lambda c: F.substring_index(c, "/", -1)
    p = proposed.select("proposed", F.lower("proposed").alias("low")).distinct().withColumn("parent", parent(F.col("low")))
    exact = p.join(known, F.col("low") == F.col("tag")).select("proposed", "tag", F.lit(0).alias("way"), F.lit(0).alias("far"))
    sibling = p.join(known.withColumn("parent", parent(F.col("tag"))), "parent").withColumn("far", F.levenshtein(leaf(F.col("low")), leaf(F.col("tag")), 2)).where("far between 1 and 2").select("proposed", "tag", F.lit(1).alias("way"), "far")
    prefixes = F.transform(F.sequence(F.lit(1), F.greatest(F.size(F.split("low", "/")) - 1, F.lit(1))), lambda i: F.array_join(F.slice(F.split("low", "/"), F.lit(1), i), "/"))
    extend = p.where(F.instr("low", "/") > 0).select("proposed", F.explode(prefixes).alias("tag")).join(known, "tag").select("proposed", "tag", F.lit(2).alias("way"), (-F.char_length("tag")).alias("far"))
    best = exact.unionByName(sibling).unionByName(extend).withColumn("_r", F.row_number().over(W.partitionBy("proposed").orderBy("way", "far", "tag"))).where("_r = 1")
    how = F.when(F.col("way") == 0, "exact").when(F.col("way") == 1, "similar").when(F.col("way") == 2, "extends").otherwise("new")
    return p.select("proposed", "low").join(best, "proposed", "left").select("proposed", F.when(how.isin("exact", "similar"), F.col("tag")).otherwise(F.col("low")).alias("resolved"), how.alias("how"))


def prune_tags(vocabulary: DataFrame, tags: DataFrame) -> DataFrame:
    """Tags that some note still has."""
    return vocabulary.join(tags.select("tag").distinct(), "tag", "left_semi")
