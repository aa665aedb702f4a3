from lumenark.streaming import watch

EVENTS = "event_id long, kind string, path string, content_hash string, mtime long"


def test_a_write_takes_one_change(spark):
    ops = spark.createDataFrame([(3, "a.md", 9), (1, "a.md", 9), (2, "a.md", 9), (4, "b.md", 9), (5, None, None), (6, "a.md", None)], "event_id long, path string, mtime long")
    log = spark.createDataFrame([("a.md", 9), ("a.md", 9), ("c.md", 9)], "path string, mtime long")
    rest, used = watch.echoes(ops, log)
    assert sorted(r.event_id for r in rest.collect()) == [3, 4, 5, 6] and [tuple(r) for r in used.collect()] == [("a.md", 9, 2)]


def test_an_echo_is_taken_once_over_batches(spark, tmp_path):
    """The second change of the same time is somebody else's, in a later batch too; a batch
    that runs again does the same; a second write takes it."""
    log = [("own.md", 9)]
    store = watch.Store(spark, str(tmp_path / "store"))
    store.write(spark.createDataFrame([("own.md", "w", 1)], store.fields), 1, set(range(watch.BUCKETS)))
    f = watch.Follower(store, own_writes=lambda: spark.createDataFrame(log, "path string, mtime long"))
    step = lambda text, n: f.step(spark.createDataFrame([(n, "changed", "own.md", text, 9)], EVENTS), n)
    now = lambda v: [r.content_hash for r in store.read(v).collect()]
    step("mine", 1)
    step("mine", 1)  # runs twice
    assert now(2) == ["w"] and [tuple(r) for r in store.taken(2).collect()] == [("own.md", 9, 1)]
    step("theirs", 2)
    assert now(3) == ["theirs"]
    log.append(("own.md", 9))
    step("mine again", 3)
    assert now(4) == ["theirs"] and [tuple(r) for r in store.taken(4).collect()] == [("own.md", 9, 2)]
