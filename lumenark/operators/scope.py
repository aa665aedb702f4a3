"""The scope algebra: which notes a question is about.

A ``Scope`` is (all of ``all``) and (any of ``any``) and none of ``none``, and a
property, link and archive clause. Terms: ``#tag`` with its subtree, ``=#tag`` exactly,
``folder/`` with its subtree, ``=folder/`` its direct children, and a note's path.
Compiled to predicates on the path and to semi and anti joins; a scoped plan filters
before any limit."""

from __future__ import annotations

from dataclasses import dataclass, field, replace

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

ARCHIVE = "04-Archive"


@dataclass(frozen=True)
class Term:
    kind: str  # tag, folder or file
    value: str
    exact: bool = False

    @staticmethod
    def parse(written: str) -> Term:
        w = written.strip()
        exact = w.startswith("=")
        w = w[1:] if exact else w
        if not w or w in ("#", "/"):
            raise ValueError(f"empty scope term: {written!r}")
        if w.startswith("#"):
            return Term("tag", w[1:].strip("/").lower(), exact)
        if w.endswith("/"):
            return Term("folder", w.strip("/"), exact)
        return Term("file", w)

    def on_tag(self, tag: Column) -> Column:
        return tag == self.value if self.exact else (tag == self.value) | tag.startswith(self.value + "/")

    def on_path(self, path: Column) -> Column:
        if self.kind == "file":
            return path == self.value
        inside = path.startswith(self.value + "/")
        return inside & (F.instr(F.substr(path, F.lit(len(self.value) + 2)), "/") == 0) if self.exact else inside


@dataclass(frozen=True)
class Scope:
    all: tuple[Term, ...] = ()
    any: tuple[Term, ...] = ()
    none: tuple[Term, ...] = ()
    property: tuple[str, str | None] | None = None
    links_to: int | None = None
    linked_from: int | None = None
    include_archive: bool = False
    archive: str = ARCHIVE
    created_by: str | None = None
    dates: tuple[int, int] | None = field(default=None)

    @staticmethod
    def parse(all: tuple[str, ...] = (), any: tuple[str, ...] = (), none: tuple[str, ...] = (), scope: tuple[str, ...] = (), property: str | None = None, **more) -> Scope:
        """``scope`` is an alias of ``all``; ``property`` is ``name`` or ``name=value``."""
        prop = None
        if property is not None:
            name, eq, value = property.partition("=")
            if not name.strip():
                raise ValueError("a property needs a name")
            prop = (name.strip(), value.strip() if eq else None)
        terms = lambda ts: tuple(map(Term.parse, ts))
        return Scope(terms((*all, *scope)), terms(any), terms(none), prop, **more)

    def with_filters(self, **more) -> Scope:
        return replace(self, **more)

    def is_empty(self) -> bool:
        return self == Scope(include_archive=self.include_archive, archive=self.archive)

    def admits_archive(self) -> bool:
        """By flag, or by a path term of ``all`` or ``any`` that lies inside it."""
        return self.include_archive or any_inside(self.archive, (*self.all, *self.any))

    def describe(self) -> str:
        show = lambda t: ("=" if t.exact else "") + {"tag": "#" + t.value, "folder": t.value + "/", "file": t.value}[t.kind]
        parts = [show(t) for t in self.all] + (["(" + " or ".join(map(show, self.any)) + ")"] if self.any else []) + ["not " + show(t) for t in self.none]
        if self.property:
            parts.append("=".join(x for x in self.property if x is not None))
        return " and ".join(parts) or "everything"

    def apply(self, notes: DataFrame, tags: DataFrame | None = None, props: DataFrame | None = None, edges: DataFrame | None = None) -> DataFrame:
        """The notes (file_id, path, ...) in scope."""
        out = notes
        if not self.admits_archive():
            out = out.where(~F.col("path").startswith(self.archive + "/"))
        if self.created_by is not None:
            out = out.where(F.col("created_by") == self.created_by)
        if self.dates:
            out = out.where(F.col("note_date").between(*self.dates))
        for t in self.all:
            out = self._keep(out, tags, (t,), "left_semi")
        if self.any:
            out = self._keep(out, tags, self.any, "left_semi")
        if self.none:
            out = self._keep(out, tags, self.none, "left_anti")
        if self.property and self.links_to is None and self.linked_from is None:
            name, value = self.property
            hit = props.where(F.col("name") == name)
            hit = hit if value is None else hit.where(F.col("value") == value)
            out = out.join(hit.select("file_id"), "file_id", "left_semi")
        if self.links_to is not None:
            source = props.where((F.col("name") == self.property[0]) & (F.col("target_file") == self.links_to)).select("file_id") if self.property else edges.where(F.col("to_file") == self.links_to).select(F.col("from_file").alias("file_id"))
            out = out.join(source, "file_id", "left_semi")
        if self.linked_from is not None:
            target = props.where((F.col("name") == self.property[0]) & (F.col("file_id") == self.linked_from)).select(F.col("target_file").alias("file_id")) if self.property else edges.where(F.col("from_file") == self.linked_from).select(F.col("to_file").alias("file_id"))
            out = out.join(target, "file_id", "left_semi")
        return out

    @staticmethod
    def _keep(notes: DataFrame, tags: DataFrame | None, terms: tuple[Term, ...], how: str) -> DataFrame:
        paths = [t.on_path(F.col("path")) for t in terms if t.kind != "tag"]
        tagged = [t.on_tag(F.col("tag")) for t in terms if t.kind == "tag"]
        either = lambda xs: __import__("functools").reduce(lambda a, b: a | b, xs)
        if not tagged:
            return notes.where(either(paths) if how == "left_semi" else ~either(paths))
        hit = tags.where(either(tagged)).select("file_id").distinct()
        if not paths:
            return notes.join(hit, "file_id", how)
        if how == "left_anti":
            return notes.where(~either(paths)).join(hit, "file_id", how)
        # a path term or a tag term: one left join with a mark, no union of notes
        return notes.join(hit.withColumn("_tagged", F.lit(True)), "file_id", "left").where(either(paths) | F.col("_tagged")).drop("_tagged")


def any_inside(folder: str, terms: tuple[Term, ...]) -> bool:
    return any(t.kind != "tag" and (t.value == folder or t.value.startswith(folder + "/")) for t in terms)


class NotFound(LookupError):
    """A scope term that names nothing, with the nearest name there is."""


def check_terms(scope: Scope, notes: DataFrame, tags: DataFrame) -> None:
    """Raise ``NotFound`` for a term of ``all`` or ``any`` that matches nothing; terms
    of ``none`` may. Probes one row per term, and only on failure looks for the nearest."""
    for t in (*scope.all, *scope.any):
        if t.kind == "tag":
            missing = tags.where(t.on_tag(F.col("tag"))).limit(1).count() == 0
            names = tags.select(F.col("tag").alias("name"))
        else:
            missing = notes.where(t.on_path(F.col("path"))).limit(1).count() == 0
            names = notes.select((F.regexp_replace("path", "/[^/]*$", "") if t.kind == "folder" else F.col("path")).alias("name"))
        if missing:
            near = names.distinct().orderBy(F.levenshtein(F.col("name"), F.lit(t.value)), "name").limit(1).collect()
            raise NotFound(f"no {t.kind} {t.value!r}" + (f"; nearest: {near[0]['name']!r}" if near else ""))
