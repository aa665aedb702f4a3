import hashlib
import os
import random
import re

import duckdb
import pytest

from lumenark.llm import line_dedup, quality_rules, queries, url_filters

SF = "/root/testdata/sf0.001"
have = pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables here")
WORD = re.compile(r"[^\x20\x09-\x0D]+")


@have
@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_oracle(spark, name):
    con = duckdb.connect()
    for t in ("documents", "pages", "embeddings"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF}/{t}.parquet')")
    df = queries.QUERIES[name](spark, SF)
    found = con.execute(queries.ORACLES[name])
    names = [d[0] for d in found.description]
    assert sorted(df.columns) == sorted(names)
    assert sorted(map(repr, (tuple(r[n] for n in names) for r in df.collect()))) == sorted(map(repr, found.fetchall()))


def measures(text):
    text = text or ""
    words, lines = WORD.findall(text), [x for x in text.split("\n") if WORD.search(x)]
    grams, covered = {}, set()
    for i in range(len(words) - 7):
        grams.setdefault(tuple(words[i : i + 8]), []).append(i)
    for at in grams.values():
        if len(at) > 1:
            covered.update(i + k for i in at for k in range(8))
    return len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text), len(lines) - len(set(lines)), len(covered)


def test_measures(spark):
    rng = random.Random(3)
    texts = [None, "", " \n\t\x0b\x0c\r", "one", "a " * 50, "f\fx #$%|<>&*", "é 梦 😀\n梦\n梦", "x\n" * 40, "w " * 30_000]
    texts += [" ".join(rng.choice("abc") for _ in range(rng.randint(0, 60))) for _ in range(80)]
    docs = spark.createDataFrame([(i, t, "h") for i, t in enumerate(texts)], "doc_id long, text string, source string")
    for r in quality_rules.measure(docs).collect():
        want = measures(texts[r.doc_id])
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == want
        assert r.base_failed == (want[0] < 20 or 100 * want[4] > 30 * want[0])


def test_hosts_are_shrunk(spark):
    good, bad = " ".join(map(str, range(30))), "short"
    rows = [("bad", bad)] * 40 + [("good", good)] * 400 + [("few", bad), ("few", good), (None, good), (None, bad)]
    docs = spark.createDataFrame([(i, t, s, 1) for i, (s, t) in enumerate(rows)], "doc_id long, text string, source string, kept int")
    out = quality_rules.judge(docs).collect()
    assert len(out) == len(rows) and not any(r.kept for r in out if r.source == "bad") and all(r.kept for r in out if r.source == "good")
    assert sorted(r.kept for r in out if r.source == "few") == [False, True] and sorted(r.kept for r in out if r.source is None) == [False, True]
    one_sided = spark.createDataFrame([(1, good, "bad")] + [(2, bad, "bad")] * 30 + [(3, good, "good")] * 100, "doc_id long, text string, source string")
    assert [r.kept for r in quality_rules.judge(one_sided).where("doc_id = 1").collect()] == [False]
    assert quality_rules.judge(docs.limit(0)).count() == 0


def test_urls(spark):
    urls = {
        "http://a.example.net/en/x?q": ("a.example.net", "/en/x", "example.net/en/", "allow"), "https://B.Example.NET/fr/": ("b.example.net", "/fr/", "net/", "block"),
        "x://example.com/de/1#f": ("example.com", "/de/1", "example.com/de/", "block"), "x://example.com/dex": ("example.com", "/dex", None, "allow"), "x://notexample.com/de/": ("notexample.com", "/de/", None, "allow"),
        "http://foo.org/fr/": ("foo.org", "/fr/", "org/fr/", "allow"), "http://foo.net": ("foo.net", "", None, "allow"), "no scheme net/": ("", "", None, "allow"), None: ("", "", None, "allow"), "": ("", "", None, "allow"),
        "http://spam-farm.example.org/x": ("spam-farm.example.org", "/x", None, "block"), "http://my-casino.com/": ("my-casino.com", "/", None, "block"), "http://spammy.com/spam/": ("spammy.com", "/spam/", None, "allow"),
        "http://ünet/": ("ünet", "/", None, "allow"), "a://b://net/": ("b:", "//net/", None, "allow"),
    }
    rows = [(i, u, "x") for i, u in enumerate([*urls, *urls])]
    pages = spark.createDataFrame(rows, "page_id long, url string, host string")
    out = url_filters.judge_urls(pages).collect()
    assert len(out) == 2 * len(urls)
    for r in out:
        assert (r["host"], r.path, r.rule, r.verdict) == urls[r.url], r.url
    assert url_filters.judge_urls(pages.limit(0)).count() == 0


def test_rule_without_literal(spark):
    pages = spark.createDataFrame([(1, "http://1.2.3.4/x"), (2, "http://a.b/c")], "page_id long, url string")
    rules = (url_filters.Rule("ip", r"^[0-9.]+/", (), "block", True),)
    assert {r.page_id: r.verdict for r in url_filters.judge_urls(pages, rules).collect()} == {1: "block", 2: "allow"}


def dedup(docs):
    strip, out, held = " \t\n\x0b\x0c\r", [], {}
    low = lambda s: "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in s)
    rows = [(i, (t or "").split("\n")) for i, t in docs]
    for i, lines in rows:
        for k in {low(x.strip(strip)) for x in lines}:
            if len(k) >= 20:
                held.setdefault(k, []).append(i)
    for i, lines in rows:
        keep = [x for x in lines if len(held.get(low(x.strip(strip)), ())) < 3 or max(held[low(x.strip(strip))]) == i]
        out.append((i, len(lines), len(lines) - len(keep), hashlib.sha256("\n".join(keep).encode()).hexdigest()))
    return out


@pytest.mark.parametrize("room", [line_dedup.BROADCAST_BYTES, 0])
def test_lines(spark, room, monkeypatch):
    monkeypatch.setattr(line_dedup, "SHARD_KEYS", 5)
    rng = random.Random(5)
    shared = [f"This Line is Shared number {i}" for i in range(30)] + ["é" * 20, "ABCDEFGHIJKLMNOPQRST", "short", ""]
    docs = [(i, "\n".join(rng.choice([x, " \t" + x.lower() + "\r", x.upper()]) for x in rng.choices(shared, k=rng.randint(1, 9)))) for i in range(80)]
    docs += [(100, None), (101, ""), (102, "\n\n"), (103, shared[0]), (104, "x" * 50_000), (105, "x" * 50_000), (106, "X" * 50_000)]
    df = spark.createDataFrame([(*d, 1, "z") for d in docs], "doc_id long, text string, n_lines int, extra string").repartition(4)
    got = line_dedup.dedup_lines(df, digest=True, broadcast_bytes=room).collect()
    assert sorted((r.doc_id, r.n_lines, r.n_dropped, r.kept_sha256) for r in got) == sorted(dedup(docs))
    assert all(r.extra == "z" for r in got) and next(r for r in got if r.doc_id == 100).text is None


def test_lines_of_odd_tables(spark):
    empty = spark.createDataFrame([], "doc_id long, text string")
    assert line_dedup.dedup_lines(empty).count() == 0
    line = "the same long line for everyone"
    rows = spark.createDataFrame([(None, line), (None, line), (1, line), (1, line)], "doc_id long, text string")
    assert sorted((r.doc_id is None, r.n_dropped) for r in line_dedup.dedup_lines(rows).collect()) == [(False, 0), (False, 0), (True, 1), (True, 1)]


def test_perfect_hash():
    import numpy as np

    keys = np.random.default_rng(1).integers(0, 2**63, 20_000).astype(np.uint64)
    h = line_dedup.PerfectHash(keys)
    assert h.size == len(np.unique(keys)) and sorted(h.index(np.unique(keys))) == list(range(h.size))
    assert len(line_dedup.PerfectHash(np.zeros(0, np.uint64)).index(keys[:3])) == 3


def test_columns_may_clash(spark):
    """Extra columns named as the operators' own or their inner ones."""
    good = " ".join(map(str, range(30)))
    docs = spark.createDataFrame([(1, good, "h", 7, 8, 9, 6)], "doc_id long, text string, source string, host_failed int, _host int, _figures int, n_words int")
    r = quality_rules.judge(docs).first()
    assert (r.host_failed, r._host, r._figures, r.n_words, r.kept) == (7, 8, 9, 30, True)
    pages = spark.createDataFrame([(1, "http://a.net/", "v", "u", "t", "b")], "page_id long, url string, _verdict string, _u string, _target string, _best string")
    r = url_filters.judge_urls(pages).first()
    assert (r._verdict, r._u, r._target, r._best, r.rule, r.verdict) == ("v", "u", "t", "b", "net/", "block")
    line = "a line of more than twenty characters"
    lines = spark.createDataFrame([(i, line, 1, 2, 3) for i in range(4)], "doc_id long, text string, _own int, _gone int, _mark int")
    for room in (line_dedup.BROADCAST_BYTES, 0):
        out = line_dedup.dedup_lines(lines, broadcast_bytes=room).collect()
        assert sorted((r.doc_id, r.n_dropped, r._own, r._gone, r._mark) for r in out) == [(i, int(i < 3), 1, 2, 3) for i in range(4)]


def test_many_rules_and_ties(spark):
    rules = [url_filters.Rule.prefix(f"site{i}.com/", "block") for i in range(3000)]
    rules += [url_filters.Rule("aa", r"^tie\.org", ("tie",), "block", True), url_filters.Rule("bb", r"^tie\.o", ("tie",), "allow", True), url_filters.Rule("it's", r"^quote\.org/it's", ("quote",), "block", True)]
    pages = spark.createDataFrame([(1, "http://www.site2999.com/x"), (2, "http://site3000.com/"), (3, "http://tie.org/"), (4, "http://quote.org/it's")], "page_id long, url string")
    got = {r.page_id: (r.rule, r.verdict) for r in url_filters.judge_urls(pages, tuple(rules)).collect()}
    assert got == {1: ("site2999.com/", "block"), 2: (None, "allow"), 3: ("bb", "allow"), 4: ("it's", "block")}
    with pytest.raises(ValueError):
        url_filters.judge_urls(pages, tuple(rules[:1]) * (url_filters.MOST_RULES + 1))


def test_urls_do_not_shuffle(spark):
    pages = spark.range(10).selectExpr("id page_id", "concat('http://a.net/', id) url")
    assert "Exchange" not in url_filters.judge_urls(pages)._jdf.queryExecution().executedPlan().toString()


def test_counts_decide_in_a_shard():
    """The count array over all distinct lines decides, and equal first halves are told apart."""
    import numpy as np

    h1, h2 = np.array([5, 5, 9, 5, 9], np.uint64), np.array([1, 2, 3, 1, 3], np.uint64)
    s = line_dedup.Shard(h1, h2, np.array([2, 1, 1, 1, 1]), np.array([4, 8, 2, 7, 1]))
    assert s.hash.size == 3 and s.seed > 0
    for each in (s, s.repeated(3)):
        found, keeper = each.keepers(np.array([5, 5, 9, 6], np.uint64), np.array([1, 2, 3, 1], np.uint64), 3)
        assert found.tolist() == [True, False, False, False] and keeper[0] == 7
    assert s.repeated(3).hash.size == 1


def test_a_line_in_most_documents(spark, monkeypatch):
    monkeypatch.setattr(line_dedup, "ASKING", 7)
    docs = [(i, f"the one line that everybody holds\nown line of document {i} here") for i in range(200)] + [(None, "the one line that everybody holds\nx")] * 60
    out = line_dedup.dedup_lines(spark.createDataFrame(docs, "doc_id long, text string").repartition(5), broadcast_bytes=0).collect()
    assert sorted((r.doc_id if r.doc_id is not None else -1, r.n_dropped) for r in out) == [(-1, 1)] * 60 + [(i, int(i < 199)) for i in range(200)]
