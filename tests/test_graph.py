from lumenark.operators import graph as G


def edges(spark, rows):
    return spark.createDataFrame([(*r, "wikilink") for r in rows], "from_file long, from_chunk_seq long, to_file long, to_chunk_seq long, edge_type string")


def seeds(spark, rows):
    return spark.createDataFrame(rows, "file_id long, seq long, score double")


def chunks(spark, sizes):
    return spark.createDataFrame([(f, s) for f, n in sizes.items() for s in range(n)], "file_id long, seq long")


def walked(df):
    return {(r.file_id, r.seq): round(r.score, 6) for r in df.collect()}


def test_masses_add_up(spark):
    """Three seeds of 0.4 to one note outweigh one of 0.9 to another."""
    e = edges(spark, [(1, 0, 10, 0), (2, 0, 10, 0), (3, 0, 10, 0), (4, 0, 11, 0)])
    got = walked(G.expand(seeds(spark, [(1, 0, 0.4), (2, 0, 0.4), (3, 0, 0.4), (4, 0, 0.9)]), e, chunks(spark, {10: 1, 11: 1}), G.Walk(alpha=1.0)))
    assert got == {(10, 0): 1.2, (11, 0): 0.9}


def test_out_degree(spark):
    e = edges(spark, [(1, 0, 10 + i, 0) for i in range(9)] + [(2, 0, 30, 0)])
    s, c = seeds(spark, [(1, 0, 1.0), (2, 0, 0.2)]), chunks(spark, {})
    got = walked(G.expand(s, e, c, G.Walk(alpha=1.0)))
    assert got[30, 0] == 0.2 and got[10, 0] == round(1 / 9, 6)
    got = walked(G.expand(s, e, c, G.Walk(alpha=1.0, out_degree=0.5)))
    assert got[10, 0] == round(1 / 3, 6)


def test_a_further_hop_starts_from_the_largest_masses(spark):
    e = edges(spark, [(1, 0, 2, 0), (1, 0, 2, 0), (1, 0, 3, 0), (2, 0, 20, 0), (3, 0, 30, 0)])
    s, c = seeds(spark, [(1, 0, 0.9)]), chunks(spark, {})
    far = lambda n: {k[0] for k in walked(G.expand(s, e, c, G.Walk(iterations=2, frontier=n)))}
    assert far(2) == far(0) == {1, 2, 3, 20, 30} and far(1) == {1, 2, 3, 20}


def test_whole_note_spreads(spark):
    e = edges(spark, [(1, 0, 10, -1), (1, 0, 11, -1)])
    got = walked(G.expand(seeds(spark, [(1, 0, 1.0)]), e, chunks(spark, {10: 4, 11: 1}), G.Walk(alpha=1.0, spread=1.0)))
    assert got[11, 0] == 0.5 and sorted(v for k, v in got.items() if k[0] == 10) == [0.125] * 3


def test_walk_is_undirected(spark):
    e = edges(spark, [(1, 0, 2, 0)])
    got = G.expand(seeds(spark, [(1, 0, 0.9), (2, 0, 0.8)]), e, chunks(spark, {1: 1, 2: 1})).collect()
    assert [r.file_id for r in got] == [2, 1]


def test_no_edges(spark):
    assert G.expand(seeds(spark, [(1, 0, 1.0)]), edges(spark, []), chunks(spark, {})).count() == 0


def test_resolve_order(spark):
    notes = spark.createDataFrame([(1, "04-Archive/n.md"), (2, "a/b/c/n.md"), (3, "a/n.md"), (4, "x/dup.md"), (5, "y/dup.md")], "file_id long, path string")
    t = spark.createDataFrame([("N",), ("c/n",), ("dup",), ("none",), ("a/n.md",)], "target string")
    assert {r.target: r.file_id for r in G.resolve(t, notes).collect()} == {"N": 3, "c/n": 2, "dup": 4, "a/n.md": 3}


def test_derive_edges(spark):
    notes = spark.createDataFrame([(1, "a.md"), (2, "b.md")], "file_id long, path string")
    c = spark.createDataFrame([(1, 0, "see [[b#Part]] and [[b|B]] and [[a]] and [[gone]] and ![[b]]"), (2, 3, None)], "file_id long, seq long, text string")
    h = spark.createDataFrame([(2, 5, "## Part (cont.)")], "file_id long, seq long, heading string")
    e, u = G.derive_edges(c, notes, h)
    assert sorted((r.from_file, r.from_chunk_seq, r.to_file, r.to_chunk_seq) for r in e.collect()) == [(1, 0, 2, -1), (1, 0, 2, 5)]
    assert [r.target for r in u.collect()] == ["gone"]


def test_cascade_reaches_all_ids(spark, tmp_path):
    """Deleted notes are those of the tables, however high their ids go."""
    from lumenark.plans import registry

    top = 200_000
    orders = [(top + i, "O", "1-URGENT", 10.5) for i in range(12)] + [(3, "F", "2-HIGH", 1.0), (4, "F", "2-HIGH", 1.0)]
    docs = [(top + i, "en", "src1") for i in range(8)]
    spark.createDataFrame(orders, "o_orderkey long, o_orderstatus string, o_orderpriority string, o_totalprice double").write.parquet(str(tmp_path / "orders.parquet"))
    spark.createDataFrame(docs, "doc_id long, lang string, source string").write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(top + 4, 1, 0)], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    spark.createDataFrame([(top + i, 0, "user", "x") for i in range(6)], "conv_id long, turn long, role string, text string").write.parquet(str(tmp_path / "conversations.parquet"))
    keys = [o[0] for o in orders]
    left = {"chunks": sum(i % 4 > 0 for i in range(6)), "tags": 2 * sum(d[0] % 4 > 0 for d in docs), "props": 4 * sum(k % 4 > 0 for k in keys), "targets": 4 * sum(k % 4 > 0 and (k + 1) % 4 > 0 for k in keys)}
    assert {r.name: r.n for r in registry.QUERIES["delete_cascade"](spark, str(tmp_path)).collect()} == left


def test_orphans_for_any_keys(spark, tmp_path):
    """Customers that an order's key meets, unknown customers: as NOT IN has it."""
    import duckdb

    from lumenark.plans import registry

    cases = [[(0, 1, "1-URGENT"), (5, 1, "1-URGENT"), (-2, 1, "1-URGENT")], [(1, None, "1-URGENT"), (2, 1, "1-URGENT")], [(1, None, "5-LOW"), (2, 1, "1-URGENT")], [(2, 1, "5-LOW")]]
    customers = [(0, 1), (1, 1), (2, 1), (-5, 4), (3, 3), (4, 30), (6, None), (None, 1)]
    for i, orders in enumerate(cases):
        at = tmp_path / str(i)
        spark.createDataFrame(customers, "c_custkey long, c_nationkey int").write.parquet(f"{at}/customer.parquet")
        spark.createDataFrame(orders, "o_orderkey long, o_custkey long, o_orderpriority string").write.parquet(f"{at}/orders.parquet")
        con = duckdb.connect()
        for t in ("customer", "orders"):
            con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{at}/{t}.parquet/*.parquet')")
        want = con.execute("SELECT c_custkey FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_orderpriority LIKE '1%') AND c_nationkey <> 3").fetchall()
        assert sorted(map(str, (r.file_id for r in registry.QUERIES["orphans"](spark, str(at)).collect()))) == sorted(str(w[0]) for w in want), i


def test_property_targets_of_any_values(spark):
    """Links to notes, to none, repeated, within text, and values that are no links or null."""
    rows = [(1, "a", "[[n1]]", "link"), (2, "a", "[[n1]]", "link"), (2, "b", "[[folder/n2#part|shown]]", "link"), (3, "a", "[[gone]]", "link"), (3, "b", "[[ | ]]", "link"), (4, "a", None, "link"), (4, "b", "[[n1]]", "text"), (5, "a", "n1", None), (5, "b", None, "empty")]
    props = spark.createDataFrame(rows, "file_id long, name string, value string, kind string")
    notes = spark.createDataFrame([(11, "x/n1.md"), (12, "folder/n2.md")], "file_id long, path string")
    want = [(*r, {"[[n1]]": 11, "[[folder/n2#part|shown]]": 12}.get(r[2]) if r[3] == "link" else None) for r in rows]
    got = G.property_targets(props, notes)
    assert got.columns == ["file_id", "name", "value", "kind", "target_file"]
    assert sorted(map(str, map(tuple, got.collect()))) == sorted(map(str, want))


def test_property_targets_deals_out_no_nulls(spark):
    """Properties that are no links do not meet in one task, and links are not sorted for the join."""
    import pyspark.sql.functions as F

    props = spark.range(0, 4000, 1, 8).select(F.col("id").alias("file_id"), F.lit("a").alias("name"), F.when(F.col("id") % 4 == 0, F.format_string("[[n%s]]", F.col("id") % 40)).otherwise("x").alias("value"), F.when(F.col("id") % 4 == 0, "link").otherwise("text").alias("kind"))
    notes = spark.createDataFrame([(10_000 + i, f"x/n{i}.md") for i in range(40)], "file_id long, path string")
    old = {k: spark.conf.get(k) for k in ("spark.sql.adaptive.enabled", "spark.sql.autoBroadcastJoinThreshold")}
    try:
        spark.conf.set("spark.sql.adaptive.enabled", "false")
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
        got = G.property_targets(props, notes)
        task = got.where("target_file is null").groupBy(F.spark_partition_id().alias("p")).count()
        most = max(r["count"] for r in task.collect())
        plan = got._jdf.queryExecution().executedPlan().toString()
    finally:
        for k, x in old.items():
            spark.conf.set(k, x)
    assert most <= 1000 and "LeftOuter, BuildRight" in plan and "ShuffledHashJoin" in plan
