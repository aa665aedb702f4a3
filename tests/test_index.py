"""The stored index: bytes that follow the change, commits, faults, one path."""

import os

import pytest

from lumenark.api import ReadOnly, Vault
from lumenark.operators import index, keyword, lexical, vector
from lumenark.operators.markdown import ChunkOptions
from lumenark.sources.vault import read_vault


def Flaky(word):
    """A model that refuses texts with a word (a local class: workers cannot import tests)."""

    class Model(vector.HashEmbedder):
        name = "flaky"

        def embed(self, texts):
            if word and any(word in t for t in texts):
                raise RuntimeError("refused")
            return super().embed(texts)

    return Model(8)


def size(folder):
    return sum(os.path.getsize(os.path.join(d, f)) for d, _, names in os.walk(folder) for f in names)


def words_of(v):
    return sorted((r.term, r.file_id, r.seq, r.field, tuple(r.positions)) for r in v.tables["postings"].collect())


def test_an_index_grows_by_its_changes(spark, tmp_path):
    root, store = tmp_path / "v", str(tmp_path / "store")
    root.mkdir()
    for i in range(30):
        (root / f"n{i}.md").write_text(f"# Note {i}\n\nSee [[n{i + 1}]]. " + " ".join(f"word{i}x{k}" for k in range(400)))
    (root / "bad.md").write_text("# Bad\n\nPOISON here.\n")
    kept = Vault.index(spark, str(root), store=store, model=Flaky("POISON"))
    # a note that cannot be embedded stops nothing and is no part of the index
    assert kept.notes.count() == 30 and [(r.path, r.attempts, r.error) for r in kept.faults.collect()] == [("bad.md", 1, "RuntimeError: refused")]
    base = size(store)
    # one written path: only what it reaches is written
    (root / "n3.md").write_text("# Note 3\n\nNow [[n7]] has state-of-the-art dragons.\n")
    one = kept.reindex_path(str(root), "n3.md")
    assert one.version == 2 and size(store) - base < base / 2 and one.notes.count() == 30
    assert [r.attempts for r in one.faults.collect()] == [1]  # not tried
    found = {(r.from_file, r.to_file) for r in one.edges.collect()}
    ids = {r.path: r.file_id for r in one.notes.collect()}
    assert (ids["n3.md"], ids["n7.md"]) in found and (ids["n3.md"], ids["n4.md"]) not in found and len(found) == 29
    for path, error in (("../x.md", ValueError), ("/etc/hosts", ValueError), ("a/../n1.md", ValueError), ("none.md", FileNotFoundError)):
        with pytest.raises(error):
            one.reindex_path(str(root), path)
    with pytest.raises(ReadOnly):
        Vault(one.notes, read_only=True, store=store, tables=one.tables).reindex_path(str(root), "n3.md")
    # two writers of one version: the later is refused, and the index stays whole
    m = index.manifest(spark, store, 2)
    with pytest.raises(index.Conflict):
        index.commit(spark, store, m)
    assert index.latest(spark, store) == 2 and index.manifest(spark, store, 2) == m and not [f for f in os.listdir(f"{store}/_log") if f.endswith(".tmp")]
    # a writer that started from an older version takes over what the other wrote
    (root / "n9.md").unlink()
    (root / "bad.md").write_text("# Bad\n\nPOISON here, again.\n")
    real, lost = index.commit, []

    def late(spark, root_, todo):
        if not lost:
            lost.append(todo["version"])
            real(spark, root_, index.manifest(spark, root_, 2) | {"version": 3})  # another comes first
        return real(spark, root_, todo)

    index.commit = late
    try:
        two = one.reindex(read_vault(spark, str(root)))
    finally:
        index.commit = real
    assert lost == [3] and two.version == 4 and two.notes.count() == 29
    assert [(r.path, r.attempts) for r in two.faults.collect()] == [("bad.md", 1)]  # another text, so its first attempt
    assert sorted(r.target for r in two.unresolved.collect()) == ["n30", "n9"]
    # nothing changed but the fault, which is tried again
    same = two.reindex(read_vault(spark, str(root)))
    assert [r.attempts for r in same.faults.collect()] == [2] and words_of(same) == words_of(two)
    # a model that takes it brings it in; all is as a fresh index has it, in one part too
    healed = index.refresh(spark, store, read_vault(spark, str(root)), ChunkOptions(), Flaky(None), parts=2)
    m = index.manifest(spark, store, healed)
    assert len(m["parts"]) == 1 and not m["gone"] and index.faults(spark, store, healed).count() == 0
    last = Vault.open(spark, store, model=Flaky(None))
    fresh = Vault.index(spark, str(root), store=str(tmp_path / "other"), model=Flaky(None))
    assert last.version == healed and words_of(last) == words_of(fresh) and last.keyword.counts == fresh.keyword.counts
    assert sorted(map(tuple, last.edges.collect())) == sorted(map(tuple, fresh.edges.collect()))
    rows = lambda df: sorted((r.file_id, r.seq, round(r.bm25, 9)) for r in df.collect())
    for columns in ({"text": 1.0}, {"heading_path": 1.0}):
        assert rows(keyword.bm25(last.keyword, "state-of-the-art note", columns)) == rows(lexical.bm25(last.chunks, "state-of-the-art note", columns))
    # old parts go, the last versions stay readable
    assert index.vacuum(spark, store, keep=1, older_than=-1) >= 5 and Vault.open(spark, store, model=Flaky(None)).notes.count() == 30
    assert index.versions(spark, store) == [healed]


def test_scope_by_a_named_link(spark, tmp_path):
    """A property whose value is a link leads to its note, both ways; other kinds, links of
    other names and links to no note lead nowhere."""
    notes = {"a.md": "---\nrelated: [[b]]\nother: [[c]]\n---\n# A\n\n[[c]]\n", "sub/b.md": "# B\n", "c.md": "---\nrelated:\n  - [[sub/b|the b]]\n  - [[none]]\n  - b\n---\n# C\n"}
    (tmp_path / "sub").mkdir()
    for path, text in notes.items():
        (tmp_path / path).write_text(text)
    v = Vault(read_vault(spark, str(tmp_path)))
    ids = {r.path: r.file_id for r in v.notes.collect()}
    paths = lambda **scope: sorted(r.path for r in v.scoped(**scope).collect())
    assert paths(property="related", links_to=ids["sub/b.md"]) == ["a.md", "c.md"]
    assert paths(property="other", links_to=ids["sub/b.md"]) == [] and paths(property="other", links_to=ids["c.md"]) == ["a.md"]
    assert paths(property="related", linked_from=ids["c.md"]) == ["sub/b.md"] and paths(links_to=ids["c.md"]) == ["a.md"]
