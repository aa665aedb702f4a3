import datetime as dt

import pytest
from pyspark.sql import functions as F

from lumenark.api import ReadOnly, Vault
from lumenark.functions import dates
from lumenark.functions import text as T
from lumenark.operators import edits, lint, links, store
from lumenark.operators import markdown as M
from lumenark.operators import resolve as R
from lumenark.sources.vault import glob_regex, read_snapshot, read_vault, write_snapshot

NOW = dt.datetime(2026, 3, 26, 14, 30, tzinfo=dt.timezone.utc)
DAY = lambda s, last=False: int(dt.datetime.fromisoformat(s + ("T23:59:59" if last else "T00:00:00") + "+00:00").timestamp())


@pytest.mark.parametrize(
    "q, a, b",
    [
        ("what did I do today", "2026-03-26", "2026-03-26"), ("yesterday", "2026-03-25", "2026-03-25"), ("last week", "2026-03-16", "2026-03-22"), ("this week", "2026-03-23", "2026-03-29"),
        ("last month", "2026-02-01", "2026-02-28"), ("this month", "2026-03-01", "2026-03-31"), ("recently seen", "2026-03-20", "2026-03-26"), ("on 2026-03-25 we", "2026-03-25", "2026-03-25"),
        ("jan to mar", "2026-01-01", "2026-03-31"), ("december 2024 notes", "2024-12-01", "2024-12-31"), ("it may be", "2026-05-01", "2026-05-31"), ("road to march", "2026-03-01", "2026-03-31"),
    ],
)
def test_date_phrases(q, a, b):
    assert dates.parse_range(q, NOW) == (DAY(a), DAY(b, True))


def test_no_date():
    assert dates.parse_range("dragons", NOW) is None


def test_chunk_sections():
    got = M.chunk_note("## Alpha\none\n\n## Beta\ntwo\n\n## Gamma\nthree\n", M.ChunkOptions(min_chars=0))
    assert [(c["heading"], c["heading_path"]) for c in got] == [("Alpha", ["Alpha"]), ("Beta", ["Beta"]), ("Gamma", ["Gamma"])]


def test_chunk_carries_orphan_headings():
    got = M.chunk_note("## Nobody\n## Body\nsome text\n", M.ChunkOptions(min_chars=0))
    assert len(got) == 1 and got[0]["text"].startswith("## Nobody\n## Body") and got[0]["heading_path"] == ["Body"]


def test_chunk_merges_short_and_packs_long():
    got = M.chunk_note("# T\n" + "word " * 60 + "\n\n## S\nshort\n")
    assert len(got) == 1 and got[0]["text"].endswith("## S\nshort")
    long = "# T\n" + "\n\n".join("para " * 100 for _ in range(12))
    got = M.chunk_note(long)
    assert len(got) > 2 and all(c["text"].startswith("# T") and M.tokens(c["text"]) <= 512 for c in got)
    assert M.chunk_note(" \n ") == []


def test_split_oversized_overlaps():
    text = "".join(f"Sentence number {i} here. " for i in range(100))
    got = M.split_oversized([{"seq": 0, "text": text}], M.tokens, 100, 20)
    assert len(got) > 3 and all(M.tokens(c["text"]) <= 100 for c in got)
    assert all(b["text"].split(". ")[0] in a["text"] for a, b in zip(got, got[1:]))


def test_fences_hide_headings_and_tags():
    body = "```\n# no\n#no\n```\n# Yes\n#tag `#code` #123 #A/b\n"
    assert [h.text for h in M.headings(body)] == ["Yes"] and M.tags(body) == [("tag", "tag"), ("a/b", "A/b")]


def test_properties():
    got = M.properties("---\nstatus: draft\nrating: 5\ndone: true\nnothing:\ntags: [x]\naliases: [y]\ncssclasses: z\n---\n")
    assert got == [("status", "draft", "text"), ("rating", "5", "number"), ("done", "true", "checkbox"), ("nothing", "", "empty")]
    got = M.properties('---\nrel:\n  - "[[A]]"\n  - plain\n  - 3\n  - {a: 1}\n---\n')
    assert [k for _, _, k in got] == ["link", "text", "number"]
    assert M.inline_fields("due:: 2026-01-01\n- with:: [[A]] and [[B]]\nsee [k:: v, w]\n```\nno:: x\n```") == [("due", "2026-01-01", "text"), ("with", "[[A]]", "link"), ("with", "[[B]]", "link"), ("k", "v", "text"), ("k", "w", "text")]


def test_sections():
    body = "# A\nx\n## B\ny\n### C\nz\n## B2 (cont.)\nw\n"
    assert M.find_section(body, "B") == (2, 6) and M.find_section(body, "A > B > C") == (4, 6) and M.find_section(body, "b2") == (6, 9) and M.find_section(body, "no") is None


def test_wikilink_columns(spark):
    rows = [("[[a|b]] ![[img]] [[c#d]] [[a]] [[x\\|y]]",), ("[[broken\n]]",), (None,)]
    got = spark.createDataFrame(rows, "t string").select(T.wikilinks(F.col("t")).alias("l"), T.render_wikilinks(F.col("t")).alias("r")).collect()
    assert got[0].l == ["a", "c#d", "x"] and got[0].r == "b img c#d a y" and got[1].l == [] and got[2].l is None


def test_lint_rules():
    rules = lambda text, **k: sorted({r for _, r, _ in lint.note_findings(text, **k)})
    assert rules("# T\n" + "long enough text " * 10) == []
    assert "unterminated-fence" in rules("# T\n```\nx") and "malformed-frontmatter" in rules("---\na: [\n---\n# T\n")
    assert "malformed-frontmatter" in rules("---\na: b\n") and "malformed-wikilink" in rules("# T\nsee [[a and\n")
    assert "missing-title" in rules("text") and "multiple-titles" in rules("# A\nx\n# B\ny")
    assert "duplicate-sibling" in rules("# A\n## x\n1\n## X\n2") and "empty-section" in rules("# A\nt\n## x\n") and "short-section" in rules("# A\nx")
    assert "long-paragraph" in rules("# A\n" + "w" * 3000) and "malformed-tags" in rules("---\ntags: [1]\n---\n# T\n") and "unquoted-link" in rules("---\na: [[b]]\n---\n")
    assert "type-mismatch" in rules("---\nn: word\n---\n", declared={"n": "number"}) and rules("�") == ["file-unreadable"]


def test_edits():
    note = "---\na: 1\n---\n# T\n\n## S\n\nold\n\n### Sub\n\nx\n\n## R\n\ny\n"
    assert "old\n\nnew" in edits.section_edit(note, "S", "append", "new") and "new\n\nold" in edits.section_edit(note, "S", "prepend", "new")
    assert "### Sub" not in edits.section_edit(note, "S", "remove") and "## R" in edits.section_edit(note, "S", "remove")
    for bad in (lambda: edits.section_edit(note, "S", "replace", "z"), lambda: edits.section_edit(note, "R", "replace", "## Q\nz"), lambda: edits.rename_section(note, "S", "R")):
        with pytest.raises(edits.Refused):
            bad()
    assert "## New" in edits.rename_section(note, "S", "New")
    with pytest.raises(LookupError):
        edits.section_edit(note, "nope", "append", "x")
    assert edits.section_edit("# T\r\n\r\nx\r\n", "T", "append", "y").count("\r\n") == edits.section_edit("# T\r\n\r\nx\r\n", "T", "append", "y").count("\n")


def test_property_edits_keep_other_bytes():
    note = "---\na:   'odd'   # why\nlist:\n  - x\n---\nbody"
    got = edits.property_edit(note, "add", "list", "y z")
    assert got == "---\na:   'odd'   # why\nlist:\n  - x\n  - y z\n---\nbody"
    assert edits.property_edit(got, "discard", "list", "x") == "---\na:   'odd'   # why\nlist:\n  - y z\n---\nbody"
    assert edits.property_edit(note, "set", "b", "true", before="list").split("\n")[2] == 'b: true'
    assert edits.property_edit("body", "set", "k", "v") == "---\nk: v\n---\nbody" and edits.property_edit("---\nk: v\n---\nbody", "remove", "k") == "body"
    with pytest.raises(edits.Refused):
        edits.property_edit("---\nk: |\n  x\n---\n", "set", "k", "v")
    with pytest.raises(LookupError):
        edits.property_edit(note, "set", "b", "1", after="none")


def test_link_discovery():
    index = links.NameIndex([("Ada Lovelace", "People/Ada Lovelace.md", "exact"), ("RRF", "x/rank.md", "alias"), ("Ada", "x/language.md", "exact"), ("2026-03-26", "d.md", "exact")])
    text = "---\nn: Ada\n---\nAda Lovelace met `RRF` and RRF, Ada Lovelase too. See [[RRF]] on 2026-03-26 and RRF.md\n"
    got = [(f.text, f.target, f.kind) for f in links.discover(text, "me.md", index)]
    assert got == [("Ada Lovelace", "People/Ada Lovelace.md", "exact"), ("RRF", "x/rank.md", "alias"), ("Ada", "x/language.md", "exact")]
    assert "[[rank|RRF]], " in links.apply_links(text, links.discover(text, "me.md", index)) and "[[Ada Lovelace]] met" in links.apply_links(text, links.discover(text, "me.md", index))


def test_name_ladder(spark):
    notes = spark.createDataFrame([("04-Archive/n.md", "aaaaaa"), ("a/b/c/n.md", "bbbbbb"), ("x/My-File.md", "cccccc"), ("y/notes.md", "dddddd"), ("z/abcd.md", "e1"), ("z/abce.md", "e2")], "path string, docid string")
    aliases = spark.createDataFrame([("bob", "y/notes.md")], "folded string, path string")
    names = spark.createDataFrame([(x,) for x in ("#cccccc", "a/b/c/n", "n", "my file", "Bob", "notex", "abcf", "zzzzzz")], "name string")
    got = {r["name"]: (r.path, r.step, r.ambiguous) for r in R.candidates(names, notes, aliases).collect()}
    assert got["#cccccc"][0] == "x/My-File.md" and got["a/b/c/n"][:2] == ("a/b/c/n.md", 1) and got["n"][0] == "a/b/c/n.md" and got["my file"][0] == "x/My-File.md"
    assert got["Bob"][:2] == ("y/notes.md", 3) and got["notex"][:2] == ("y/notes.md", 4) and got["abcf"][2] and "zzzzzz" not in got
    with pytest.raises(R.Ambiguous):
        R.require(spark, "abcf", notes)
    with pytest.raises(R.NoSuchNote):
        R.require(spark, "zzzzzz", notes)


def test_a_short_id_of_several_notes_names_them_all(spark):
    notes = spark.createDataFrame([("a/one.md", "abcdef"), ("b/other.md", "abcdef"), ("#abcdef.md", "cccccc")], "path string, docid string")
    got = sorted(map(tuple, R.candidates(spark.createDataFrame([("#abcdef",), ("#cccccc",)], "name string"), notes).collect()))
    assert got == [("#abcdef", "a/one.md", 0, False), ("#abcdef", "b/other.md", 0, False), ("#cccccc", "#abcdef.md", 0, False)]
    with pytest.raises(R.Ambiguous):
        R.require(spark, "#abcdef", notes)


def test_exclude_globs():
    import re

    hit = lambda p, s: bool(re.search(glob_regex(p), s))
    assert hit("node_modules", "a/node_modules/x.md") and hit("drafts/", "drafts/x.md") and hit("a/*.md", "a/x.md") and not hit("a/*.md", "b/a/x.md") and not hit("a/*.md", "a/b/x.md")
    with pytest.raises(ValueError):
        glob_regex("/")


@pytest.fixture
def vault(spark, tmp_path):
    files = {
        "lore/dragon.md": "---\ntags: [type/beast]\naliases: [Wyrm]\nrating: 5\n---\n# Dragon\n\nThe dragon sleeps under the hill and dreams of gold. See [[silence]] and [[nowhere]].\n",
        "silence.md": "# Silence\n\nNothing is heard where the dragon sleeps. #quiet\n", "04-Archive/old.md": "# Old\n\nAn old dragon.\n", ".hidden/x.md": "# X\n", "skip/y.md": "# Y\n",
    }
    for p, t in files.items():
        (tmp_path / "v" / p).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / "v" / p).write_text(t)
    return Vault.index(spark, str(tmp_path / "v"), ("skip/",))


def test_vault(spark, vault, tmp_path):
    assert sorted(r.path for r in vault.notes.collect()) == ["04-Archive/old.md", "lore/dragon.md", "silence.md"]
    assert [r.path for r in vault.scoped(all=("#type",)).collect()] == ["lore/dragon.md"]
    from lumenark.operators.search import Options, fusion

    o = Options(calibration=fusion.Calibration(floor=0.0))
    assert vault.search("dragon gold", o).count() >= 1 and vault.search("dragon", o, all=("#none",)).count() == 0
    n, lines = vault.match("dragon")
    assert (n.first().notes, n.first().lines) == (2, 3) and lines.count() == 3
    assert "dreams of gold" in vault.read("wyrm") and vault.read("silence", "Silence").startswith("# Silence")
    assert vault.edges.count() == 1 and [r.target for r in vault.unresolved.collect()] == ["nowhere"]
    assert {(r.finding, r.detail) for r in vault.health().collect()} == {("broken-link", "nowhere")}
    assert "unresolvable-wikilink" in {r.rule for r in vault.validate().collect()}
    moved = vault.archive_note("silence.md")
    assert moved.notes.where("path = '04-Archive/silence.md'").count() == 1 and moved.unarchive_note("04-Archive/silence.md").notes.where("path = 'silence.md'").count() == 1
    assert vault.create("new/a.md", "A", "See the Dragon", ["x"]).tag_rows.where("tag = 'x'").count() == 1
    with pytest.raises(store.Conflict):
        vault.create("silence.md", "S", "")
    with pytest.raises(ReadOnly):
        Vault(vault.notes, read_only=True).delete("silence.md")
    todo = spark.createDataFrame([("silence.md", 0, "section", "Silence", "append", "More.", None, None, None)], "path string, n int, what string, heading string, how string, text string, key string, value string, expected_mtime long")
    assert "More." in vault.update(todo).read("silence")


def test_incremental_is_full(spark, vault, tmp_path):
    """Taking over changes gives what a fresh index gives, table by table."""
    from lumenark.operators.markdown import ChunkOptions
    from lumenark.operators.vector import HashEmbedder

    root, model = tmp_path / "v", HashEmbedder()
    (root / "other.md").write_text("# Other\n\nSee [[silence#Silence]] and [[old]] and [[nowhere]].\n")
    kept = Vault.index(spark, str(root), ("skip/",), store=str(tmp_path / "store"), model=model)
    (root / "silence.md").write_text("# Silence\n\nNow [[dragon]] is loud.\n")
    (root / "04-Archive/old.md").unlink()
    (root / "nowhere.md").write_text("# Nowhere\n\nHere.\n")
    got = kept.reindex(read_vault(spark, str(root), ("skip/",)))
    want = Vault.index(spark, str(root), ("skip/",), store=str(tmp_path / "other"), model=model)
    for name in ("notes", "parsed", "chunks", "links", "edges", "unresolved", "postings", "vectors"):
        rows = lambda v: sorted(repr(tuple(r[c] for c in sorted(v.tables[name].columns))) for r in v.tables[name].collect())
        assert rows(got) == rows(want) and rows(got), name
    assert got.notes.count() == 4 and got.version == 2 and [r.target for r in got.unresolved.collect()] == ["old"]
    assert sorted(map(tuple, Vault(read_vault(spark, str(root), ("skip/",))).edges.collect())) == sorted(map(tuple, got.edges.collect()))
    # the same answers from postings as from texts
    from lumenark.operators.search import Options, fusion

    o = Options(calibration=fusion.Calibration(floor=0.0))
    lazy = Vault(got.notes, model=model)
    answers = lambda v: [(r.file_id, r.seq, round(r.score, 9)) for r in v.search("dragon loud", o).orderBy("rank").collect()]
    assert answers(got) == answers(lazy) and answers(got)
    # another chunker makes the chunks anew, nothing else reads the files
    (root / "silence.md").unlink()
    again = Vault.open(spark, str(tmp_path / "store"), options=ChunkOptions(target_tokens=20), model=model)
    assert again.version == 3 and again.notes.count() == 4
    with pytest.raises(ValueError):
        Vault(got.notes).reindex(got.notes)


def test_dates_and_ignored_files(spark, tmp_path):
    root = tmp_path / "v"
    for p, t in {"a.md": "---\ndate: 2024-02-03\n---\nx", "2024-05-06 b.md": "x", "c.md": "---\nx: 1\n---\ndate: 2024-01-01", "build/d.md": "x", "deep/build/e.md": "x", "deep/tmp.md": "x", "deep/keep.md": "x", "top.md": "x", "deep/top.md": "x"}.items():
        (root / p).parent.mkdir(parents=True, exist_ok=True)
        (root / p).write_text(t)
    (root / ".gitignore").write_text("# made\nbuild/\n/top.md\n*.tmp\n")
    (root / "deep/.gitignore").write_text("*.md\n!keep.md\n!top.md\n")
    found = {r.path: r.note_date for r in read_vault(spark, str(root)).collect()}
    assert sorted(found) == ["2024-05-06 b.md", "a.md", "c.md", "deep/keep.md", "deep/top.md"]
    assert found["a.md"] == 1706918400 and found["2024-05-06 b.md"] == 1714953600 and found["c.md"] is None


def test_dates_promote_and_hide_nothing(spark):
    import datetime as dt

    from lumenark.operators.search import Options, fusion

    rows = [(i, f"n{i}.md", f"# N{i}\n\nthe dragon sleeps {'dragon ' * (i % 3)}\n", 1711411200 if i == 5 else None) for i in range(8)]
    v = Vault(spark.createDataFrame(rows, "file_id long, path string, content string, note_date long"))
    o = Options(top_n=40, calibration=fusion.Calibration(floor=0.0))
    found = lambda o: {r.file_id for r in v.search("dragon today", o, now=dt.datetime(2024, 3, 26, 12)).collect()}
    assert found(o) == set(range(8))
    degraded = Options(top_n=40, scorer="degraded", candidates=4, graph_reserve=0, temporal_reserve=1, calibration=fusion.Calibration(floor=0.0))
    assert 5 in found(degraded) and len(found(degraded)) == 4
    read = [r.file_id for r in v.search("dragon", Options(top_n=3, scorer="rerank", calibration=fusion.Calibration(floor=0.0))).collect()]
    assert len(read) == 3


def test_create_takes_the_vaults_tags_and_links(spark, vault):
    new = vault.create("new/b.md", "B", "The dragon came. So did the Wyrm.", ["type/beasts"], link=True)
    assert "[[dragon]]" in new.read("new/b.md") and "type/beast\n" in new.read("new/b.md") + "\n"
    item = next(r for r in vault.list(outline=True).collect() if r.path == "lore/dragon.md")
    assert item.aliases == ["Wyrm"] and item.outline and {p["name"] for p in item.properties} == {"rating"}


def test_pages_make_the_listing(vault):
    whole = [r.path for r in vault.list(include_archive=True).collect()]
    for order in ("path", "links", "fewest"):
        pages, after = [], None
        while page := [r.path for r in vault.list(order, after, 1, include_archive=True).collect()]:
            pages += page
            after = page[-1]
        assert sorted(pages) == sorted(whole) and len(pages) == len(whole)


def test_snapshots_and_fingerprints(spark, tmp_path):
    df = spark.range(3)
    write_snapshot({"t": df}, str(tmp_path), 1)
    assert read_snapshot(spark, str(tmp_path), ("t",), 1)["t"].count() == 3
    with pytest.raises(FileNotFoundError):
        read_snapshot(spark, str(tmp_path), ("t",), 2)
    a = store.fingerprints({"chunker": {"target": 512}})
    assert store.stale(a, store.fingerprints({"chunker": {"target": 400}})) == {"chunker": "reindex"} and store.stale({}, a) == {}
    assert store.digest("ab", "c") != store.digest("a", "bc")


def test_calibration_fit(spark):
    from lumenark.operators.calibrate import fit

    rows = [(c / 20, b / 10, int(c / 20 + b / 20 > 0.8)) for c in range(21) for b in range(11)]
    got = fit(spark.createDataFrame(rows, "cosine double, bm25n double, y int"))
    right = sum((got.cosine * c + got.bm25 * b + got.bias > 0) == (y == 1) for c, b, y in rows)
    assert right / len(rows) > 0.97


def test_stream(spark, tmp_path):
    from lumenark.streaming import watch

    rows = [(1, "created", "a.md", "h1", 1), (2, "created", "b.md", "h2", 2), (3, "deleted", "a.md", None, None), (4, "changed", "b.md", "h3", 3), (5, "created", "x.txt", "h", 1)]
    fields = "event_id long, kind string, path string, content_hash string, mtime long"
    spark.createDataFrame(rows, fields).write.parquet(str(tmp_path / "in"))
    for _ in range(2):  # the second run finds nothing new
        watch.follow(spark.readStream.schema(fields).parquet(str(tmp_path / "in")), str(tmp_path / "out"), str(tmp_path / "cp")).awaitTermination()
    assert [tuple(r) for r in watch.Store(spark, str(tmp_path / "out")).read(1).collect()] == [("b.md", "h3", 3)]


def test_stream_life_cycle(spark, tmp_path):
    """A move, an echo and an event that cannot be told, over several batches; only the
    touched partitions are written."""
    from lumenark.streaming import watch

    fields = "path string, content_hash string, mtime long, created_by string"
    events = "event_id long, kind string, path string, content_hash string, mtime long"
    store_ = watch.Store(spark, str(tmp_path / "store"), fields)
    told = []
    own = lambda: spark.createDataFrame([("own.md", 9)], "path string, mtime long")
    listed = [("kept.md", "k", 1), ("odd.md", "o2", 5), ("fresh.md", "f", 6), ("new/a.md", "ha", 3)]
    f = watch.Follower(store_, scan=lambda: spark.createDataFrame(listed, "path string, content_hash string, mtime long"), own_writes=own, on_change=lambda ops, before, after: told.append(ops.count()))
    store_.write(spark.createDataFrame([("a.md", "ha", 1, "me"), ("kept.md", "k", 1, "you"), ("odd.md", "o", 1, "she"), ("own.md", "w", 1, "me")], fields), 1, set(range(watch.BUCKETS)))
    f.step(spark.createDataFrame([(1, "deleted", "a.md", None, None), (2, "created", "new/a.md", "ha", 3), (3, "changed", "own.md", "w2", 9)], events), 1)
    now = {r.path: (r.content_hash, r.created_by) for r in store_.read(2).collect()}
    assert now == {"new/a.md": ("ha", "me"), "kept.md": ("k", "you"), "odd.md": ("o", "she"), "own.md": ("w", "me")}
    assert 1 in store_.manifest(2).values() and told == [2]
    f.step(spark.createDataFrame([(4, "renamed-somehow", "kept.md", None, None), (5, "changed", "odd.md", "o2", 5)], events), 2)
    now = {r.path: (r.content_hash, r.created_by) for r in store_.read(3).collect()}
    assert now == {"kept.md": ("k", "you"), "odd.md": ("o2", "she"), "fresh.md": ("f", None), "new/a.md": ("ha", "me")}
    again = sorted(map(tuple, store_.read(3).collect()))
    f.step(spark.createDataFrame([(4, "renamed-somehow", "kept.md", None, None)], events), 2)  # runs twice
    assert sorted(map(tuple, store_.read(3).collect())) == again
    no_scan = watch.apply_batch(store_.read(3), watch.classify(spark.createDataFrame([(9, "renamed-somehow", "kept.md", None, None)], events)))
    assert no_scan.where("path = 'kept.md'").count() == 1
    assert sorted(r.path for r in watch.start_up(store_, lambda: spark.createDataFrame(listed[:1], "path string, content_hash string, mtime long"), 3).collect()) == ["kept.md"]
    f.step(spark.createDataFrame([(6, "deleted", "kept.md", None, None)], events), 4)  # the last note
    assert store_.read(5).count() == 0 and store_.manifest(5) == {}
    f.step(spark.createDataFrame([(7, "created", "kept.md", "k", 1)], events), 5)
    assert [r.path for r in store_.read(6).collect()] == ["kept.md"]


def test_notes_of_conversations_hold_every_turn(spark, tmp_path):
    """The queries over notes made of conversations against a brute-force version."""
    from collections import Counter

    from lumenark.plans import registry

    said = "words that are long enough to be a section of their own, for they are many and go on and on and on, as they do in every turn of this talk"
    odd = {(1, 5): f"see [[never closed {said}", (1, 6): "```\nan open fence", (2, 4): f"mood:: calm\n\n{said}", (2, 7): None}
    rows = [(c, t, "user" if t % 2 else "bot", odd.get((c, t), f"{t} {said}")) for c in (1, 2) for t in range(8)] + [(3, 6, "user", said)]
    spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").repartition(3).write.parquet(str(tmp_path / "conversations.parquet"))
    run = lambda name: registry.QUERIES[name](spark, str(tmp_path)).collect()
    notes = {c: f"---\ntags: [chat/log]\nrating: 5\n---\n# Conversation {c}\n\n" + "".join(f"## {r} {t}\n\n{x or ''}\n\n" for i, t, r, x in rows if i == c) for c in (1, 2, 3)}
    o = M.ChunkOptions()
    chunks = [(c, k["seq"], " > ".join(k["heading_path"]), M.tokens(k["text"])) for c, x in notes.items() for k in M.split_oversized(M.chunk_note(x), M.tokens, o.target_tokens, o.overlap_tokens)]
    assert sorted(map(tuple, run("chunk_notes"))) == sorted(chunks) and (2, "Conversation 2 > user 5") in {(c[0], c[2]) for c in chunks}
    found = Counter((r, "error" if r in lint.ERRORS else "warning") for x in notes.values() for _, r, _ in lint.note_findings(x))
    assert {(r.rule, r.severity): r.n for r in run("lint_all")} == found and found["malformed-wikilink", "error"] == found["unterminated-fence", "error"] == 1
    props = Counter((n, k) for x in notes.values() for n, _, k in [*M.properties(x), *M.inline_fields(M.split_frontmatter(x)[1])])
    assert {(r.name, r.kind): r.n for r in run("structure_edges")} == props and props["mood", "text"] == 1
    assert sorted(r.file_id for r in run("parse_notes")) == [1, 2, 3]


def test_discovery_beyond_the_broadcast_is_the_same(spark, monkeypatch):
    import random

    rng = random.Random(3)
    slip = lambda w: (lambda i: rng.choice([w[:i] + "q" + w[i + 1 :], w[:i] + w[i + 1 :], w[:i] + "q" + w[i:]]))(rng.randrange(len(w)))
    word = lambda: "".join(rng.choices("abcdefgh", k=rng.randint(3, 14)))
    names = [" ".join(word() for _ in range(rng.randint(1, 5))) for _ in range(60)] + ["internationalisation", "Jonathan Smithson Alexander", "(draft) plan of the year", "v1.2 notes of release", "Ada Lovelace", "Ada Byronson", "Grace Hopper", "2026-01-02", "ab"]
    said = [f"we met {slip(n)} and {slip(slip(n))} or {n.title()}" for n in names]
    said += ["internationalization is long", "Jonathon Smithson Alexander came", "the draft) plan of the year", "see v1.2 notes of release", "Ada and Grace, Grace-like", None, "nothing"]
    rows = [(f"n/{n}.md", f"{a}. {b}") for n, a, b in zip(names, said, reversed(said[: len(names)]))] + [(f"p/x{i}.md", c) for i, c in enumerate(said[len(names) :])] + [("m/Grace Hopper.md", "Hopper")]
    notes = spark.createDataFrame(rows, "path string, content string").repartition(3)
    aliases = spark.createDataFrame([("n/Grace Hopper.md", "Amazing Grace of the Navy"), ("p/x1.md", "Ada Lovelace")], "path string, alias string")
    found = lambda: sorted(map(tuple, links.discover_links(notes, aliases, "n").collect()))
    whole = found()
    monkeypatch.setattr(links, "BROADCAST_NAMES", 5)
    assert found() == whole
    kinds = [(t, k) for *_, t, k in whole]
    assert ("n/internationalisation.md", "fuzzy") in kinds and ("n/Jonathan Smithson Alexander.md", "fuzzy") in kinds and any(k == "first-name" for _, k in kinds)
    assert sum(k == "fuzzy" for _, k in kinds) > 30


def test_discovery_with_many_names_but_few_spoken(spark, monkeypatch):
    """Names that no window meets are not sent to the notes; neither way reads them."""
    rows = [(f"n/Nobody Number {i}.md", None) for i in range(40)] + [("n/Ada Lovelace.md", "Grace Hopper wrote"), ("n/Grace Hopper.md", "Ada Lovelase and Ada, Grace Hopper"), ("x/hen.md", "Hen met Grace")]
    notes = spark.createDataFrame(rows, "path string, content string").repartition(3)
    found = lambda: sorted(map(tuple, links.discover_links(notes, None, "n").collect()))
    whole = found()
    monkeypatch.setattr(links, "BROADCAST_NAMES", 10)
    assert found() == whole
    plan = links.discover_links(notes, None, "n")._jdf.queryExecution().executedPlan().toString()
    assert "Join" not in plan
    monkeypatch.setattr(links, "BROADCAST_NAMES", 1)
    assert found() == whole


def test_shingles_of_a_long_text_take_linear_time(spark):
    import time

    from pyspark.sql import functions as F

    from lumenark.functions import text as T

    text = "Ab\U0001f600cd\u00e9 " * 60_000
    began = time.time()
    got = spark.createDataFrame([(text,)], "t string").select(T.shingles(F.col("t")).alias("s")).first()["s"]
    low = text.lower()
    assert got == list(dict.fromkeys(low[i : i + 4] for i in range(len(low) - 3)))
    assert time.time() - began < 30


def test_names_that_are_not_of_people():
    """Single words resemble nothing and have no first name outside the people's folder."""
    rows = [("Constantinople", "Places/Constantinople.md", "exact"), ("Winter Market", "Events/Winter Market.md", "exact"), ("Steve Barbera", "People/Steve Barbera.md", "exact"), ("Marie", "People/Marie.md", "exact"), ("Anna Bly", "People/Anna Bly.md", "exact"), ("Anna Kay", "People/Anna Kay.md", "exact"), ("Internationale", "People/Internationale.md", "exact")]
    found = lambda text: [(f.text, f.target, f.kind) for f in links.discover(text, "me.md", links.NameIndex(rows))]
    assert found("From Constantinaple in Winter.") == [] and found("Anna came.") == []
    assert found("I met Steeve Barbera, then Steve's brother, and Steeve Barbera again.") == [("Steeve Barbera", "People/Steve Barbera.md", "fuzzy"), ("Steve", "People/Steve Barbera.md", "first-name")]
    assert found("Internationala is by MARIE") == [("Internationala", "People/Internationale.md", "fuzzy"), ("MARIE", "People/Marie.md", "exact")]
    assert found("Steven Rogers was there") == [] and links.NameIndex(rows, None).firsts == {}


def test_thousands_of_names_are_not_all_compared():
    import random
    import time

    rng = random.Random(2)
    word = lambda: "".join(rng.choices("abcdefghijklmnop", k=rng.randint(4, 9)))
    names = [f"{word()} {word()}" for _ in range(4000)]
    index = links.NameIndex([(n, f"People/{n}.md", "exact") for n in names])
    begun = time.time()
    links.discover(" ".join(word() for _ in range(200)) + f" {names[7][:-1]}x", "me.md", index)
    assert time.time() - begun < 2


def test_probes_reach_every_name_that_is_near():
    import random

    rng = random.Random(5)
    for _ in range(3000):
        name = "".join(rng.choices("abc ", k=rng.randint(6, 70)))
        text = list(name)
        for _ in range(rng.randint(0, links.edits_of(len(name)) + 1)):
            i = rng.randrange(len(text))
            text[i : i + rng.randint(0, 1)] = rng.choices("abcx", k=rng.randint(0, 1))
        text = "".join(text)
        if text != name and links.similarity(name, text) >= links.FUZZY:
            own = {(len(name), i, name[a:b]) for i, (a, b) in enumerate(links.segments(len(name)))}
            assert own & set(links.probes(text)), (name, text)


def test_status_profile_and_trash(spark, vault):
    assert (vault.status().first().files, vault.status().first().version, vault.status().first().postings) == (3, 0, False)
    roles = {r.role: r.folder for r in vault.profile().collect()}
    assert roles == {"method": "folders", "archive": "04-Archive"}
    gone = vault.delete("silence.md", hard=False)
    assert gone.notes.where("path = '.trash/silence.md'").count() == 1 and gone.undelete("silence.md").notes.where("path = 'silence.md'").count() == 1
    assert {(r.finding, r.detail) for r in vault.health(inbox="lore/").collect()} == {("broken-link", "nowhere"), ("inbox-pending", "lore/dragon.md")}


def test_outlines_and_sections_of_all_notes(spark):
    rows = [
        (1, "a.md", "---\nx: 1\n---\n# A\n\n## Part ##\n**Point:**\none\n\n**Other**\ntwo\n```\n# no\n```\n## Part (cont.)\nthree"),
        (2, "sub/b.md", "no heading"),
        (3, "sub/c.md", "## Part\n\n### Deep\n\nfour\n\n# C"),
        (4, "d.md", ""),
        (5, "e.md", None),
    ]
    notes = spark.createDataFrame(rows, "file_id long, path string, content string").repartition(3)
    heads = [(r.path, r.line, r.level, r.heading) for r in M.outline(notes).orderBy("path", "line").collect()]
    assert heads == [("a.md", 4, 1, "A"), ("a.md", 6, 2, "Part"), ("a.md", 7, 255, "Point"), ("a.md", 10, 255, "Other"), ("a.md", 15, 2, "Part (cont.)"), ("sub/c.md", 1, 2, "Part"), ("sub/c.md", 3, 3, "Deep"), ("sub/c.md", 7, 1, "C")]
    assert M.outline(notes, False).where("level = 255").count() == 0
    found = lambda wanted: {r.path: r.text for r in M.sections(notes, wanted).collect()}
    assert found("part > point") == {"a.md": "**Point:**\none\n"} and found("Part")["sub/c.md"] == "## Part\n\n### Deep\n\nfour\n"
    assert found("nothing") == {} and found("# Deep") == {"sub/c.md": "### Deep\n\nfour\n"}
    v = Vault(notes.where("content > ''"))
    assert {r.path for r in v.sections("Part").collect()} == {"a.md", "sub/c.md"}
    assert [r.path for r in v.sections("Part", all=("sub/",)).collect()] == ["sub/c.md"]
