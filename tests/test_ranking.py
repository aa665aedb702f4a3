import random

import pytest

from lumenark.operators import fusion, lexical, present
from lumenark.operators.scope import NotFound, Scope, Term, check_terms

LANE = "file_id long, seq long, score double"


def test_rrf_by_hand(spark):
    a = spark.createDataFrame([(1, 0, 0.9), (2, 0, 0.5)], LANE)
    b = spark.createDataFrame([(2, 0, 7.0), (3, 0, 1.0)], LANE)
    got = {r.file_id: (round(r.rrf, 9), list(r.lanes)) for r in fusion.rrf({"a": (a, 1.0), "b": (b, 0.5)}).collect()}
    assert got == {1: (round(1 / 61, 9), ["a"]), 2: (round(1 / 62 + 0.5 / 61, 9), ["a", "b"]), 3: (round(0.5 / 62, 9), ["b"])}


def test_rrf_does_not_depend_on_row_order(spark):
    rows = [(i % 7, i, float(i % 3)) for i in range(40)]
    want = None
    for seed in range(3):
        random.Random(seed).shuffle(rows)
        got = sorted((r.file_id, r.seq, round(r.rrf, 12), r.rrf_rank) for r in fusion.rrf({"a": (spark.createDataFrame(rows, LANE), 1.0)}).collect())
        want = want or got
        assert got == want


def test_floor(spark):
    pool = spark.createDataFrame([(1, 0, 0.8), (2, 0, 0.75), (3, 0, 0.1), (4, 0, None)], LANE)
    yes, no = fusion.split_at_floor(pool, 0.75)
    assert sorted(r.file_id for r in yes.collect()) == [1, 2, 4] and [r.file_id for r in no.collect()] == [3]
    assert fusion.split_at_floor(pool, 0)[1].count() == 0


def test_pool_has_one_slot_per_chunk(spark):
    rank = "file_id long, seq long, rank int"
    content = spark.createDataFrame([(i, 0, i) for i in range(1, 41)], rank)
    graph = spark.createDataFrame([(5, 0, 1), (100, 0, 2), (30, 0, 3)], rank)
    dated = spark.createDataFrame([(200, 0, 1)], rank)
    got = fusion.build_pool(content, graph, dated).orderBy("slot").collect()
    keys = [r.file_id for r in got]
    assert len(keys) == len(set(keys)) == 32 and keys[:20] == list(range(1, 21)) and {100, 30, 200} <= set(keys)


def test_probability_by_hand(spark):
    from pyspark.sql import functions as F

    got = spark.createDataFrame([(0.5, 0.2), (None, None), (2.0, 0.0)], "c double, b double").select(fusion.probability(F.col("c"), F.col("b")).alias("p")).collect()
    want = [1 / (1 + 2.718281828459045**-z) for z in (20.777 * 0.5 + 13.377 * 0.2 - 8.762, -8.762, 20.777 - 8.762)]
    assert [round(r.p, 9) for r in got] == [round(w, 9) for w in want]


def test_blocks():
    row = lambda seq, path, rank: {"file_id": 1, "seq": seq, "heading_path": path, "rank": rank}
    found = present.blocks([row(3, "A > B", 1), row(9, "A", 2), row(4, "A > B > C", 3), row(2, "A", 4), row(5, "Ax", 5), row(1, "Z", 6)])
    assert [[r["seq"] for r in b] for b in found] == [[2, 3, 4], [9], [5], [1]]


def _admitted(rows, top_n):
    """Brute force: the shortest prefix of the answers that makes ``top_n`` blocks."""
    rows = sorted(rows, key=lambda r: r["rank"])
    out = []
    for r in rows:
        out.append(r)
        if len({(f, i) for f in {x["file_id"] for x in out} for i in range(len(present.blocks([x for x in out if x["file_id"] == f])))}) >= top_n:
            break
    return out


def test_chunks_are_admitted_until_the_blocks_are_enough(spark):
    rng = random.Random(4)
    for top_n in (1, 3, 5, 50):
        keys = rng.sample([(f, s) for f in range(3) for s in range(10)], 20)
        rows = [{"file_id": f, "seq": s, "score": 1 - k / 100, "rank": k + 1, "heading_path": rng.choice(["A", "A > B", "A > C", "", None]), "text": "t", "answer": True} for k, (f, s) in enumerate(keys)]
        others = [{**rows[0], "seq": 90 + k, "rank": 30 + k, "answer": False} for k in range(2)]
        df = spark.createDataFrame(rows + others, "file_id long, seq long, score double, rank int, heading_path string, text string, answer boolean").repartition(3)
        got = present.admit(df, top_n)
        assert sorted(r.rank for r in got.collect()) == [*(r["rank"] for r in _admitted(rows, top_n)), 30, 31]
        shown = present.coalesce_adjacent(got).collect()
        assert sum(r.answer for r in shown) <= top_n and sorted(r.seq for r in shown if not r.answer) == [90, 91]
        assert [r.n_chunks for r in shown if not r.answer] == [1, 1]


def test_a_chunk_that_joins_two_blocks_takes_one_away(spark):
    row = lambda seq, rank: (1, seq, 0.9, rank, "A", None, True)
    df = spark.createDataFrame([row(1, 1), row(3, 2), row(2, 3), row(9, 4), row(7, 5), row(5, 6)], "file_id long, seq long, score double, rank int, heading_path string, text string, answer boolean")
    assert sorted(r.seq for r in present.admit(df, 3).collect()) == [1, 2, 3, 7, 9]
    assert sorted(r.seq for r in present.admit(df, 2).collect()) == [1, 3]
    assert present.admit(df.limit(0), 3).count() == 0


def test_free_places_and_properties(spark):
    fields = "file_id long, seq long, score double, rank int, answer boolean, tokens long"
    df = spark.createDataFrame([(1, 0, 0.9, 1, True, 5), (2, 0, 0.3, 2, False, 5), (2, 1, 0.2, 3, False, 5)], fields)
    assert [(r.file_id, r.seq) for r in present.fill(df, 2).orderBy("rank").collect()] == [(1, 0), (2, 0)]
    props = spark.createDataFrame([(1, "b", "2"), (1, "a", None), (1, "a", "1"), (7, "x", "y")], "file_id long, name string, value string")
    got = {r.seq + 10 * r.file_id: [tuple(p) for p in r.properties] for r in present.with_properties(df, props).collect()}
    assert got == {10: [("a", None), ("a", "1"), ("b", "2")], 20: [], 21: []}


def test_budget_stops_at_first_overflow(spark):
    rows = spark.createDataFrame([(1, 9000), (2, 10), (3, 10)], "rank int, tokens long")
    assert [r.admitted for r in present.pack_budget(rows, 100).orderBy("rank").collect()] == [True, False, False]
    rows = spark.createDataFrame([(1, 10), (2, 500), (3, 10)], "rank int, tokens long")
    assert [r.admitted for r in present.pack_budget(rows, 200).orderBy("rank").collect()] == [True, False, False]


def test_query_terms():
    assert lexical.query_terms("The the -- dragon's LAIR") == ["The", "dragon's", "LAIR"]
    assert lexical.sub_terms("dragon's") == ["dragon", "s"]


def test_bm25_phrases_and_nothing(spark):
    c = spark.createDataFrame([(1, 0, "dragon s lair"), (2, 0, "s dragon"), (3, 0, None)], "file_id long, seq long, text string")
    assert [r.file_id for r in lexical.bm25(c, "dragon's", {"text": 1.0}).collect()] == [1]
    assert lexical.bm25(c, "-- !", {"text": 1.0}).count() == 0


def test_scope(spark):
    notes = spark.createDataFrame([(1, "lore/live.md"), (2, "04-Archive/old.md"), (3, "notes.md"), (4, "lore/deep/x.md")], "file_id long, path string")
    tags = spark.createDataFrame([(1, "type/undead"), (3, "type")], "file_id long, tag string")
    ids = lambda **k: sorted(r.file_id for r in Scope.parse(**k).apply(notes, tags).collect())
    assert ids() == [1, 3, 4]
    assert ids(all=("04-Archive/",)) == [2] and ids(none=("04-Archive/",)) == [1, 3, 4] and ids(include_archive=True) == [1, 2, 3, 4]
    assert ids(all=("#type",)) == [1, 3] and ids(all=("=#type",)) == [3] and ids(none=("#type",)) == [4]
    assert ids(all=("=lore/",)) == [1] and ids(any=("notes.md", "#type/undead")) == [1, 3]
    assert ids(all=("lore/",), none=("lore/deep/", "#type")) == []
    with pytest.raises(ValueError):
        Term.parse("#")
    with pytest.raises(NotFound, match="type/undead"):
        check_terms(Scope.parse(all=("#type/undaed",)), notes, tags)
    check_terms(Scope.parse(none=("#nowhere",)), notes, tags)


def test_plans(spark, tmp_path):
    """Prefixes and columns reach the scan; top-k is one bounded sort."""
    from lumenark.operators import vector

    notes = spark.createDataFrame([(1, "a/x.md", "t")], "file_id long, path string, text string")
    notes.write.parquet(str(tmp_path / "n"))
    df = Scope.parse(all=("a/",)).apply(spark.read.parquet(str(tmp_path / "n"))).select("file_id")
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "StringStartsWith(path,a/)" in plan and "text" not in plan.split("ReadSchema")[1]
    v = spark.createDataFrame([(1, 0, [1.0, 0.0])], "file_id long, seq long, vector array<float>")
    assert "TakeOrderedAndProject" in vector.knn(v, [1.0, 0.0], 3)._jdf.queryExecution().executedPlan().toString()
