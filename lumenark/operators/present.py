"""What a search shows: blocks of adjacent chunks within a token budget."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from lumenark.functions import text as T

OVERHEAD = 50


def within(inner: list[str], outer: list[str]) -> bool:
    """Whether a heading path is the other or below it, by whole segments."""
    return inner[: len(outer)] == outer


def blocks(rows: list[dict]) -> list[list[dict]]:
    """Rows (file_id, seq, heading_path) in rank order as blocks of neighbours of one
    section: a block grows at either end by a chunk whose section contains or is
    within the block's; the block's section is the widest one met."""
    taken, out = set(), []
    for i, row in enumerate(rows):
        if i in taken:
            continue
        taken.add(i)
        block, low, high = [row], row["seq"], row["seq"]
        root = [x for x in (row["heading_path"] or "").split(" > ") if x]
        grew = True
        while grew:
            grew = False
            for j in range(i + 1, len(rows)):
                if j in taken or rows[j]["file_id"] != row["file_id"] or rows[j]["seq"] not in (low - 1, high + 1):
                    continue
                path = [x for x in (rows[j]["heading_path"] or "").split(" > ") if x]
                if within(root, path):
                    root = path
                elif not within(path, root):
                    continue
                taken.add(j)
                block.append(rows[j])
                low, high, grew = min(low, rows[j]["seq"]), max(high, rows[j]["seq"]), True
        out.append(sorted(block, key=lambda r: r["seq"]))
    return out


def coalesce_adjacent(shortlist: DataFrame) -> DataFrame:
    """(file_id, seq, score, rank, heading_path, text) of a shortlist as blocks named
    by their first chunk: best score and rank, texts joined. Files are independent.
    Rows whose ``answer`` is false, if there is such a column, stay single."""
    if "answer" not in shortlist.columns:
        shortlist = shortlist.withColumn("answer", F.lit(True))

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        rows = pdf.sort_values(["rank", "seq"]).to_dict("records")
        found = blocks([r for r in rows if r["answer"]]) + [[r] for r in rows if not r["answer"]]
        return pd.DataFrame(
            [
                {"file_id": b[0]["file_id"], "seq": b[0]["seq"], "n_chunks": len(b), "score": max(r["score"] for r in b), "rank": min(r["rank"] for r in b), "heading_path": b[0]["heading_path"], "text": "\n\n".join(r["text"] or "" for r in b), "answer": b[0]["answer"]}
                for b in found
            ],
            columns=["file_id", "seq", "n_chunks", "score", "rank", "heading_path", "text", "answer"],
        )

    fields = "file_id long, seq long, n_chunks long, score double, rank long, heading_path string, text string, answer boolean"
    return shortlist.groupBy("file_id").applyInPandas(run, fields).withColumn("tokens", T.packaging_tokens(F.col("text")))


def admit(shortlist: DataFrame, top_n: int) -> DataFrame:
    """The rows of a shortlist (with ``answer``) in rank order up to the first that makes
    the answers ``top_n`` blocks; rows that are no answers stay. Each file says how many
    blocks each of its rows adds (fewer than none, where a row joins two blocks), so the
    count over all files is a running sum."""
    wanted = shortlist.select("file_id", "seq", "score", F.col("rank").cast("long").alias("rank"), "heading_path", "text", "answer")

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["rank", "seq"])
        rows = pdf.to_dict("records")
        counts = [len(blocks([r for r in rows[:k] if r["answer"]])) for k in range(len(rows) + 1)]
        return pdf.assign(added=[b - a for a, b in zip(counts, counts[1:])])

    order = W.partitionBy(F.lit(0)).orderBy("rank", "file_id", "seq")
    counted = wanted.groupBy("file_id").applyInPandas(run, StructType([*wanted.schema.fields, StructField("added", LongType())]))
    counted = counted.withColumn("blocks", F.sum("added").over(order.rowsBetween(W.unboundedPreceding, 0)))
    most = F.coalesce(F.max("blocks").over(order.rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    return counted.withColumn("most", most).where(~F.col("answer") | (F.col("most") < top_n)).drop("added", "blocks", "most")


def fill(results: DataFrame, top_n: int) -> DataFrame:
    """``top_n`` rows: the answers, then, in what they leave free, the best others."""
    place = F.row_number().over(W.partitionBy(F.lit(0)).orderBy(F.desc("answer"), "rank", "file_id", "seq"))
    return results.withColumn("_place", place).where(F.col("_place") <= top_n).drop("_place")


def with_properties(results: DataFrame, properties: DataFrame) -> DataFrame:
    """The results with their notes' ``properties`` (name, value), by name and value; of
    ``properties`` (file_id, name, value) only rows of the notes shown are gathered."""
    ids = F.broadcast(results.select("file_id").distinct())  # as few as the results
    held = properties.join(ids, "file_id", "left_semi").groupBy("file_id").agg(F.array_sort(F.collect_list(F.struct("name", "value"))).alias("properties"))
    none = F.array().cast("array<struct<name:string,value:string>>")
    return results.join(F.broadcast(held), "file_id", "left").withColumn("properties", F.coalesce("properties", none))


def pack_budget(results: DataFrame, budget: int = 8192, full: bool = False) -> DataFrame:
    """``results`` (rank, tokens) with ``admitted``: in rank order until the first that
    does not fit; the first always. ``full`` admits all."""
    if full:
        return results.withColumn("admitted", F.lit(True))
    order = W.partitionBy(F.lit(0)).orderBy("rank")
    upto = order.rowsBetween(W.unboundedPreceding, 0)
    total = F.sum(F.col("tokens") + OVERHEAD).over(upto)
    over = (total > budget) & (F.row_number().over(order) > 1)
    marked = results.withColumn("_over", over)
    return marked.withColumn("admitted", ~F.max("_over").over(upto)).drop("_over")


def envelope(results: DataFrame) -> DataFrame:
    """One JSON line per result."""
    return results.select(F.to_json(F.struct(*sorted(results.columns))).alias("json"))


def render_text(results: DataFrame) -> DataFrame:
    """(rank, line): each result as it is read: place, score and text."""
    score = F.when(F.col("score").isNull(), "").otherwise(F.concat(F.lit(" ("), F.format_number("score", 3), F.lit(")")))
    return results.select("rank", F.concat(F.col("rank"), F.lit(". "), F.col("file_id"), F.lit("#"), F.col("seq"), score, F.lit("\n"), T.render_wikilinks(F.coalesce("text", F.lit("")))).alias("line"))
