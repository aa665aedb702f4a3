"""A vault as one object: the verbs of the service, each a DataFrame or a new vault."""

from __future__ import annotations

import datetime as dt
from dataclasses import dataclass, replace
from functools import cached_property

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lumenark.functions import dates
from lumenark.functions import text as T
from lumenark.operators import catalog, edits, graph, keyword, lint, links, markdown, match, resolve, search, store, vector
from lumenark.operators import index as stored
from lumenark.operators.scope import Scope
from lumenark.sources.vault import read_vault


class ReadOnly(PermissionError):
    pass


@dataclass(frozen=True)
class Vault:
    """Notes are (file_id, path, content, content_hash, mtime, docid, note_date)."""

    notes: DataFrame
    options: markdown.ChunkOptions = markdown.ChunkOptions()
    model: vector.EmbedModel | None = None
    archive: str = "04-Archive"
    people: str | None = links.PEOPLE
    read_only: bool = False
    #: What the keyword index is declared over.
    shape: keyword.Shape = keyword.Shape()
    #: Where the index is stored, its version and its tables; without a store all that is
    #: derived is lazy.
    store: str | None = None
    version: int = 0
    tables: dict[str, DataFrame] | None = None

    @staticmethod
    def index(spark: SparkSession, root: str, exclude: tuple[str, ...] = (), store: str | None = None, **more) -> Vault:
        """The vault of the files below ``root``; with ``store`` (a folder) as a stored
        index, which a later ``index`` or ``reindex`` brings up to date."""
        found = read_vault(spark, root, exclude)
        if store is None:
            return Vault(found, **more)
        if stored.latest(spark, store):
            return Vault.open(spark, store, **more).reindex(found)
        stored.build(found, store, more.get("options", markdown.ChunkOptions()), more.get("model"), more.get("shape", keyword.Shape()))
        return Vault.open(spark, store, **more)

    @staticmethod
    def open(spark: SparkSession, store: str, **more) -> Vault:
        """The last version of a stored index, what was made otherwise made anew."""
        version = stored.latest(spark, store)
        if not version:
            raise FileNotFoundError(f"no index in {store}")
        version = stored.adopt(spark, store, version, more.get("options", markdown.ChunkOptions()), more.get("model"), more.get("shape", keyword.Shape()))
        tables = stored.read(spark, store, version, more.get("model"))
        return Vault(tables["notes"], store=store, version=version, tables=tables, **more)

    def _stored(self, name: str) -> DataFrame | None:
        return (self.tables or {}).get(name)

    # derived tables: stored ones, else lazy
    @cached_property
    def parsed(self) -> DataFrame:
        found = self._stored("parsed")
        return markdown.parse(self.notes) if found is None else found

    @cached_property
    def chunks(self) -> DataFrame:
        found = self._stored("chunks")
        return markdown.chunk(self.notes, self.options) if found is None else found

    @cached_property
    def tag_rows(self) -> DataFrame:
        return self.parsed.select("file_id", F.inline("tags")).select("file_id", F.col("folded").alias("tag"))

    @cached_property
    def props(self) -> DataFrame:
        return self.parsed.select("file_id", F.lit(-1).cast("long").alias("chunk_seq"), F.inline("properties"))

    @cached_property
    def linked_props(self) -> DataFrame:
        """Properties with the note that a link among them names."""
        return graph.property_targets(self.props, self.notes.select("file_id", "path"))

    @cached_property
    def aliases(self) -> DataFrame:
        return self.parsed.select("file_id", "path", F.inline("aliases"))

    @cached_property
    def edges(self) -> DataFrame:
        if self._stored("edges") is not None:
            return self._stored("edges")
        return graph.derive_edges(self.chunks, self.notes.select("file_id", "path"), self.chunks.select("file_id", "seq", "heading"))[0]

    @cached_property
    def unresolved(self) -> DataFrame:
        if self._stored("unresolved") is not None:
            return self._stored("unresolved")
        return graph.derive_edges(self.chunks, self.notes.select("file_id", "path"))[1]

    @cached_property
    def keyword(self) -> keyword.Index | None:
        """The stored keyword index, if there is one."""
        if self._stored("postings") is None:
            return None
        return keyword.Index(self._stored("postings"), stored.counts(self.notes.sparkSession, self.store, self.version), self.shape)

    @property
    def faults(self) -> DataFrame:
        """Notes that the stored index could not take in, with their errors."""
        return stored.faults(self.notes.sparkSession, self.store, self.version)

    def scoped(self, **scope) -> DataFrame:
        asked = Scope.parse(archive=self.archive, **scope)
        named = asked.property and (asked.links_to is not None or asked.linked_from is not None)
        return asked.apply(self.notes, self.tag_rows, self.linked_props if named else self.props, self.edges)

    # reading
    def search(self, question: str, o: search.Options = search.Options(), now: dt.datetime | None = None, reranker: search.RerankModel | None = None, **scope) -> DataFrame:
        """Blocks that answer the question, with their notes' properties. A date phrase in
        it (with ``now``) promotes notes of that time and hides none; postings and vectors
        are the stored ones."""
        notes = self.scoped(**scope)
        when = dates.parse_range(question, now) if now else None
        dated = search.Dated(notes.select("file_id", "note_date"), *when) if when else None
        if not notes.limit(1).count():
            return search.ranked_search(self.chunks.limit(0), None, question, None, o, properties=self.props)
        mine = self.chunks.join(notes.select("file_id"), "file_id", "left_semi")
        vectors, query = None, None
        if self.model:
            held = self._stored("vectors")
            vectors = held.join(notes.select("file_id"), "file_id", "left_semi") if held is not None else vector.embed(mine.select("file_id", "seq", "text"), self.model).select("file_id", "seq", "vector")
            query = self.model.embed([question])[0]
        found, index = None, self.keyword
        if index is not None and index.shape.covers(o.columns):
            found = keyword.bm25(index, question, o.columns, notes)
        return search.ranked_search(mine, vectors, question, query, o, self.edges, self.chunks, dated, reranker, found, self.props)

    def match(self, pattern: str, limit: int = 50, case_sensitive: bool = False, word: bool = False, part: str = "all", **scope) -> tuple[DataFrame, DataFrame]:
        """(counts, first lines)."""
        keep = self.scoped(**scope).select("file_id")
        rows = match.lines(self.chunks.join(keep, "file_id", "left_semi"), self.parsed.join(keep, "file_id", "left_semi"), part)
        found = match.hits(rows, match.Match(pattern, case_sensitive, word, part))
        return match.counts(found), match.page(found, limit)

    def read(self, name: str, section: str | None = None) -> str:
        path = resolve.require(self.notes.sparkSession, name, self.notes, self.aliases.select("folded", "path"), self.archive)
        content = self.notes.where(F.col("path") == path).select("content").first()[0]
        if section is None:
            return content
        body = markdown.split_frontmatter(content)[1]
        at = markdown.find_section(body, section)
        if at is None:
            raise LookupError(f"no section {section!r} in {path}")
        return "\n".join(body.split("\n")[at[0] : at[1]])

    def sections(self, section: str, **scope) -> DataFrame:
        """One section (a heading, or a path ``A > B``) of every note in scope that has it."""
        return markdown.sections(self.scoped(**scope).select("file_id", "path").join(self.notes.select("path", "content"), "path"), section)

    def list(self, order: str = "path", after: str | None = None, limit: int = 100, outline: bool = False, **scope) -> DataFrame:
        """A page of notes with their aliases and properties and, with ``outline``, the
        headings; these are joined to the page's rows only."""
        page = catalog.listing(self.scoped(**scope), self.chunks, self.edges, order, after, limit)
        some = F.broadcast(page.select("path"))  # at most ``limit`` rows
        more = self.parsed.join(some, "path", "left_semi").select("path", F.transform("aliases", lambda a: a["display"]).alias("aliases"), "properties")
        page = page.join(F.broadcast(more), "path", "left")
        if outline:
            heads = self.chunks.join(some, "path", "left_semi").groupBy("path").agg(F.array_sort(F.collect_list(F.struct("seq", "heading_path"))).alias("outline"))
            page = page.join(heads.withColumn("outline", F.transform("outline", lambda h: h["heading_path"])), "path", "left")
        return page.orderBy(*catalog.listing_order(order))

    def tags(self, prefix: str | None = None) -> DataFrame:
        return catalog.tags_under(self.tag_rows, prefix)

    def properties(self, name: str | None = None) -> DataFrame:
        return catalog.property_values(self.props, name) if name else catalog.property_registry(self.props)

    def vault_map(self) -> DataFrame:
        return catalog.vault_map(self.notes, self.tag_rows, self.edges)

    def health(self, outside: tuple[str, ...] = (), inbox: str | None = None) -> DataFrame:
        row = lambda df, kind, detail: df.select(F.lit(kind).alias("finding"), F.col("file_id"), detail.alias("detail"))
        lonely = graph.orphans(self.notes, self.edges, (*outside, *((inbox.rstrip("/"),) if inbox else ()), self.archive))
        stale = graph.stale_headings(self.chunks, self.notes.select("file_id", "path"), self.chunks.select("file_id", "heading"))
        return row(lonely, "orphan", F.col("path")).unionByName(row(self.unresolved, "broken-link", F.col("target"))).unionByName(row(stale, "stale-heading", F.concat("target", F.lit("#"), "heading"))).unionByName(catalog.hygiene(self.notes, self.tag_rows, inbox, self.archive))

    def validate(self, declared: dict[str, str] | None = None, **scope) -> DataFrame:
        own = lint.lint(self.scoped(**scope), self.options.min_chars, declared)
        broken = self.unresolved.join(self.notes.select("file_id", "path"), "file_id").withColumn("line", F.lit(1))
        return own.unionByName(lint.unresolvable(broken, self.notes.select("file_id", "path")))

    def discover(self) -> DataFrame:
        return links.discover_links(self.notes, self.aliases.select(F.col("display").alias("alias"), "path"), self.people)

    def status(self) -> DataFrame:
        """One row: totals, tags, the last change, and of a stored index its version and
        whether it has postings and vectors."""
        more = self.notes.agg(F.max("mtime").alias("last_change"))
        tags = self.tag_rows.agg(F.count_distinct("tag").alias("tags"))
        row = catalog.totals(self.notes, self.chunks, self.edges).join(F.broadcast(more)).join(F.broadcast(tags))  # three rows of one
        return row.withColumns({"version": F.lit(self.version), "postings": F.lit(self._stored("postings") is not None), "vectors": F.lit(self._stored("vectors") is not None)})

    def profile(self) -> DataFrame:
        """The vault's folders by role: where daily notes, people and the archive are."""
        people = self.tag_rows.where(F.lower("tag").isin("person", "people")).select("file_id").union(self.props.where("name = 'role'").select("file_id"))
        return catalog.profile(self.notes, people)

    def structure(self) -> DataFrame:
        return catalog.structure(self.notes)

    # writing: each gives a new vault
    def _with(self, notes: DataFrame) -> Vault:
        """Another state of the notes; what is derived from them is lazy again."""
        if self.read_only:
            raise ReadOnly("the vault is open for reading only")
        return replace(self, notes=notes, tables=None)

    def create(self, path: str, title: str, body: str, tags: list[str] | None = None, mtime: int = 0, link: bool = False) -> Vault:
        """A new note. Its tags are taken as the vault has them (a near sibling's, or the
        one that a tag extends); ``link`` turns mentions of other notes into links."""
        if ".." in path.split("/") or path.startswith("/"):
            raise ValueError("a path lies within the vault")
        spark = self.notes.sparkSession
        if self.notes.where(F.col("path") == path).limit(1).count():
            raise store.Conflict(f"{path!r} is taken")
        if tags:
            asked = spark.createDataFrame([(t,) for t in tags], "proposed string")
            known = {r["proposed"]: r["resolved"] for r in graph.resolve_tags(asked, self.tag_rows).collect()}
            tags = list(dict.fromkeys(known.get(t, t) for t in tags))
        content = edits.create(title, body, tags)
        if link:
            names = self.notes.select("path", F.lit("").alias("content")).unionByName(spark.createDataFrame([(path, content)], "path string, content string"))
            aliases = self.aliases.select(F.col("display").alias("alias"), "path")
            found = links.discover_links(names, aliases, self.people).where(F.col("path") == path).orderBy("start").collect()
            content = links.apply_links(content, [links.Found(f["start"], f["start"] + len(f["text"]), f["text"], f["target"], f["kind"]) for f in found])
        row = spark.createDataFrame([(path, content, mtime)], "path string, content string, mtime long")
        row = row.withColumns({"content_hash": F.sha2("content", 256), "docid": T.docid(F.col("path")), "file_id": F.xxhash64("path"), "note_date": T.note_date(T.frontmatter_date(F.col("content")), F.col("path"))})
        return self._with(self.notes.unionByName(row, allowMissingColumns=True))

    def update(self, todo: DataFrame) -> Vault:
        done = edits.apply(self.notes, todo).drop("fault")
        dated = {"content_hash": F.sha2("content", 256)} | ({"note_date": T.note_date(T.frontmatter_date(F.col("content")), F.col("path"))} if "note_date" in done.columns else {})
        return self._with(done.withColumns(dated))

    def move(self, old: str, new: str) -> Vault:
        return self._with(store.rename(self.notes, old, new))

    def archive_note(self, path: str) -> Vault:
        return self.move(path, f"{self.archive}/{path}")

    def unarchive_note(self, path: str) -> Vault:
        return self.move(path, path.removeprefix(f"{self.archive}/"))

    def delete(self, path: str, hard: bool = True) -> Vault:
        """``hard``: for good; else into the trash, from where ``undelete`` brings it."""
        return self._with(self.notes.where(F.col("path") != path) if hard else store.soft_delete(self.notes, path))

    def undelete(self, name: str) -> Vault:
        return self._with(store.undelete(self.notes, name))

    def reindex(self, found: DataFrame) -> Vault:
        """The stored index with the changes of a later scan: only what changed notes
        reach is made anew."""
        if self.read_only:
            raise ReadOnly("the vault is open for reading only")
        if self.store is None or self.tables is None:
            raise ValueError("only a stored index can take over changes: give index() a store")
        return self._at(stored.refresh(self.notes.sparkSession, self.store, found, self.options, self.model, self.shape))

    def reindex_path(self, folder: str, path: str) -> Vault:
        """The stored index with one written note of the vault's folder: only that file is
        read, and of the index what it reaches."""
        if self.read_only:
            raise ReadOnly("the vault is open for reading only")
        if self.store is None or self.tables is None:
            raise ValueError("only a stored index can take over changes: give index() a store")
        spark = self.notes.sparkSession
        found = stored.note_at(spark, folder, path)
        return self._at(stored.refresh(spark, self.store, found, self.options, self.model, self.shape, only=path))

    def _at(self, version: int) -> Vault:
        tables = stored.read(self.notes.sparkSession, self.store, version, self.model)
        return replace(self, notes=tables["notes"], version=version, tables=tables)
