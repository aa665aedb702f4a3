import re
from collections import Counter, defaultdict

import duckdb
import pytest
from pyspark.sql import functions as F

from lumenark.llm import queries, source_audit

TERM = re.compile("[^\x00-\x40\x5b-\x60\x7b-\x7f]+")


def by_hand(rows, documents=30, top=50):
    """The definition, term by term and pair by pair."""
    count, df, total, sources = defaultdict(Counter), defaultdict(Counter), defaultdict(Counter), defaultdict(set)
    for lang, source, text in rows:
        lang, source, text = lang or "", source or "", text or ""
        sources[lang].add(source)
        terms = [re.sub("[A-Z]", lambda m: m[0].lower(), t) for t in TERM.findall(text)]
        count[lang, source].update(terms)
        total[lang].update(terms)
        df[lang].update(set(terms))
    out = []
    for lang, own in sources.items():
        kept = [t for t, d in df[lang].items() if d >= documents]
        v = len(kept)

        def shares(c):
            n = sum(c[t] for t in kept)
            return {t: 1 + 1_000_000_000 * (c[t] + 5) // (n + 5 * v) for t in kept}

        p, q = {s: shares(count[lang, s]) for s in own}, shares(total[lang])
        for s in own:
            pairs = [(-sum(abs(p[s][t] - p[o][t]) for t in kept), o.encode(), o) for o in own if o != s]
            terms = [(q[t] - p[s][t], t.encode(), t) for t in kept if count[lang, s][t] and p[s][t] > q[t]]
            for part, found in (("pair", sorted(pairs)), ("term", sorted(terms)[:top])):
                out += [(lang, s, part, o, -value, i) for i, (value, _, o) in enumerate(found, 1)]
    return sorted(out)


def found(df):
    return sorted(map(tuple, df.select("lang", "source", "part", "item", "value", "rank").collect()))


def some_rows(seed, n=400, sources=7):
    import random

    r = random.Random(seed)
    words = [f"w{chr(97 + i % 26)}{chr(97 + i // 26)}" for i in range(200)] + ["É", "é", "Zz", "zZ", "梦梦"]
    rows = []
    for i in range(n):
        source = r.choice([None, "", "hot", "hot", "hot", *(f"s{k}" for k in range(sources))])
        mine = words[: 40 + 20 * (ord(source[-1]) % 5)] if source else words
        rows.append((r.choice(["en", "en", "fr", None]), source, " ".join(min(r.choice(mine), r.choice(mine)) for _ in range(r.choice([0, 3, 30])))))
    return rows + [("de", "only", "ein wort"), ("de", "other", None), ("xx", "alone", ""), ("en", "empty", ""), ("fr", "empty", "12 ,. "), ("en", "hot", "wa" * 40_000)]


@pytest.mark.parametrize("seed, documents, top", [(1, 5, 50), (2, 1, 3), (3, 30, 1)])
def test_audit_by_the_definition(spark, seed, documents, top):
    rows = some_rows(seed)
    docs = spark.createDataFrame(rows, "lang string, source string, text string").withColumns({"term": F.lit("x"), "N": F.lit(0), "item": F.lit(1)}).repartition(5)
    assert found(source_audit.audit(docs, documents, top)) == by_hand(rows, documents, top)


def test_tiles_add_up(spark, monkeypatch):
    """Sources over many tiles: the reduced bounds travel to no worker, so the function is
    called here."""
    monkeypatch.setattr(source_audit, "TILE", 3)
    monkeypatch.setattr(source_audit, "TILES", 2)
    import pyarrow as pa

    lists = [{"lang": "a", "at": [0, 8, 4, 3], "p": [9, 7, 30, 4], "absent": [2, 1, 5, 3]}, {"lang": "a", "at": [3, 4], "p": [6, 6], "absent": [3, 5]}, {"lang": "b", "at": [7, 0], "p": [5, 6], "absent": [5, 5]}] * 3
    sums = Counter()
    for out in source_audit._together(iter([pa.RecordBatch.from_pylist(lists)])):
        for r in out.to_pylist():
            sums[r["lang"], r["i"], r["j"]] += r["value"]
    want = Counter()
    for row in lists:
        for i, p, x in zip(row["at"], row["p"], row["absent"]):
            for j, q, y in zip(row["at"], row["p"], row["absent"]):
                want[row["lang"], i, j] += abs(p - q) - abs(p - y) - abs(x - q) + abs(x - y)
    assert {k: v for k, v in sums.items() if v} == {k: v for k, v in want.items() if v}


def test_few_buckets_are_evaluated(spark):
    """The search leaves out what its bounds exclude, and evaluates the rest exactly."""
    rows = [("en", f"s{i % 4}", " ".join(f"w{chr(97 + k % 26)}{chr(97 + k // 26)} " * (1 + (k * (i % 4 + 1)) % 90) for k in range(150))) for i in range(40)]
    tables = source_audit.Audit(spark.createDataFrame(rows, "lang string, source string, text string"))
    every = tables.over(10_000).groupBy("lang", "source").count().agg(F.min("count")).first()[0]
    assert every > 60  # far more than the ten asked for
    assert found(tables.over(10).withColumn("part", F.lit("term"))) == [r for r in by_hand(rows, top=10) if r[2] == "term"]


def test_shares_are_exact_beyond_64_bits(spark):
    n, total, v = 4 * 10**15 + 1, 9 * 10**16 + 7, 10**9
    row = spark.range(1).select(source_audit.share(F.lit(n), F.lit(total), F.lit(v)).alias("p")).first()
    assert row.p == 1 + 10**9 * (n + 5) // (total + 5 * v)


def test_an_empty_table_gives_no_rows(spark):
    assert source_audit.audit(spark.createDataFrame([], "lang string, source string, text string")).count() == 0


def test_op11_against_its_sql_and_the_definition(spark):
    sf = "/root/testdata/sf0.001"
    mine = found(queries.QUERIES["op11_source_audit"](spark, sf))
    db = duckdb.connect()
    db.sql(f"CREATE VIEW documents AS SELECT * FROM '{sf}/documents.parquet'")
    assert mine == sorted(db.sql(queries.ORACLES["op11_source_audit"]).fetchall())
    assert mine == by_hand([tuple(r) for r in spark.read.parquet(f"{sf}/documents.parquet").select("lang", "source", "text").collect()])
