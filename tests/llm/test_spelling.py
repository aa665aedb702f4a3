import re
import zlib
from collections import Counter, defaultdict

from hypothesis import given, settings
from hypothesis import strategies as st

from lumenark.llm import queries, spelling


def misspelt(key, low):
    h = zlib.crc32(f"{'' if key is None else key}:{low}".encode())
    return low if h % 97 else low[: h % len(low)] + low[h % len(low) + 1 :]


def counted(rows, change=True, letters=5, times=3):
    c = Counter()
    for key, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            low = "".join(x.lower() if x.isascii() else x for x in run)
            c[misspelt(key, low) if change else low] += 1
    return {w: n for w, n in c.items() if len(w) >= letters and n >= times}


def near(a, b):
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    a, b = sorted((a, b), key=len)
    return len(b) - len(a) == 1 and any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def judged(words, near_of):
    form = {}
    for w, n in words.items():
        best = min(near_of[w], key=lambda x: (-words[x], x), default=None)
        form[w] = best if best and words[best] >= 2 * n else None
    out = []
    for w, n in words.items():
        root = w
        while form[root]:
            root = form[root]
        out.append((w, n, len(near_of[w]), form[w], words[form[w]] if form[w] else None, root))
    return sorted(out)


def all_pairs(words):
    return judged(words, {w: [x for x in words if near(w, x)] for w in words})


def by_patterns(words):
    groups, near_of = defaultdict(set), {w: set() for w in words}
    for w in words:
        for i in range(len(w)):
            groups[w[:i], w[i + 1 :]].add(w)
            groups[w[:i] + w[i + 1 :]].add(w)
    for left, own in groups.items():
        for w in own:
            if isinstance(left, tuple):
                near_of[w] |= own - {w}
            elif left in words:
                near_of[w].add(left)
                near_of[left].add(w)
    return judged(words, near_of)


@settings(max_examples=200, deadline=None)
@given(st.text(alphabet="abAZÀ×ÿßſİ€ .\n-9梦", max_size=40), st.one_of(st.none(), st.integers(-3, 10**6)))
def test_words_and_their_misspellings(text, key):
    found = [w for w in spelling.words_of(text) if w]
    runs = [r for r in re.findall("[A-Za-zÀ-ÿ]+", text)]
    assert [w.decode("latin-1") for w in found] == ["".join(x.lower() if x.isascii() else x for x in r) for r in runs]
    assert [spelling.misspelt(key, w).decode("latin-1") for w in found] == [misspelt(key, w.decode("latin-1")) for w in found]


WORDS = {
    "house": 64, "houses": 30, "mouse": 64, "hose": 9, "hous": 3, "housse": 5, "housses": 4, "horse": 64, "horsse": 3,
    "aaaaa": 3, "aaaaaa": 6, "aaaaaaa": 12, "aaaaaaaa": 24, "aaaaaaaaa": 48, "aaaaaaaaaa": 96, "baaaa": 6, "caaaa": 6, "éaaaa": 6, "lonely": 7, "ßßßßß": 3,
    "abcde": 3, "abcdf": 3, "abcdg": 6, "abcdeg": 6, "bcdeg": 6, "x" * 3000: 8, "x" * 2999 + "y": 3, "x" * 2999: 99,
    "ab" * 32: 4, "ab" * 32 + "c": 9, "cab" + "ab" * 31: 9, "ab" * 31 + "ac": 9, "ab" * 32 + "d": 9, "ab" * 33: 4, "bb" + "ab" * 32: 20, "ab" * 10 + "zb" + "ab" * 22: 20,
}


def test_groups_say_what_pairs_say(spark):
    words = spark.createDataFrame(list(WORDS.items()), "word string, n long").repartition(3)
    found = sorted(map(tuple, spelling.variants(words).select("word", "n", "n_near", "form", "form_n", "root").collect()))
    assert found == all_pairs(WORDS) == by_patterns(WORDS)
    assert {r[0]: r[5] for r in found}["aaaaa"] == "a" * 10  # a chain of five


@settings(max_examples=8, deadline=None)
@given(st.dictionaries(st.text(alphabet="abé", min_size=1, max_size=5), st.integers(1, 9), max_size=60))
def test_groups_of_any_words(spark, words):
    df = spark.createDataFrame(list(words.items()), "word string, n long")
    assert sorted(map(tuple, spelling.variants(df).select("word", "n", "n_near", "form", "form_n", "root").collect())) == all_pairs(words)


@settings(max_examples=6, deadline=None)
@given(st.dictionaries(st.text(alphabet="aé", min_size=1, max_size=4), st.integers(1, 9), max_size=40))
def test_digests_say_what_strings_say(spark, words):
    """Words around the length at which digests stand in."""
    words = {"ba" * 30 + w + "aé": n for w, n in words.items()} | {"ba" * 30 + w: 10 - n for w, n in words.items()}
    df = spark.createDataFrame(list(words.items()), "word string, n long")
    assert sorted(map(tuple, spelling.variants(df).select("word", "n", "n_near", "form", "form_n", "root").collect())) == all_pairs(words)


def test_a_very_long_word_has_small_rows(spark):
    words = spark.createDataFrame([("k" * 150_000, 3), ("k" * 150_001, 9), ("k" * 70_000 + "j" + "k" * 80_000, 40)], "word string, n long")
    found = {len(r.word): (r.n_near, r.form_n, len(r.root)) for r in spelling.variants(words).where("n <> 9").collect()}
    assert found == {150_000: (2, 40, 150_001), 150_001: (2, None, 150_001)}


def test_vocabulary_of_odd_tables(spark):
    rows = [(1, "Apple apple APPLE Àpple"), (None, "apple plain"), (2, None), (2, ""), (2, "plain,plain"), (2, "plain,plain"), (3, "z" * 100_000), (4, "z" * 100_000), (5, "tiny tiny tiny"), (6, "梦퟿ apples")] * 3
    docs = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("doc_id", "text", "'w' AS word", "0 AS N")
    for one_in in (97, None):
        found = {tuple(r) for r in spelling.vocabulary(docs, one_in=one_in).collect()}
        assert found == set(counted(rows, one_in is not None).items())
    assert spelling.vocabulary(docs.limit(0)).count() == 0 and spelling.variants(spelling.vocabulary(docs.limit(0))).count() == 0


def test_op13_against_brute_force(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text").collect()
    assert sorted(map(tuple, queries.QUERIES["op13_spelling_variants"](spark, "/root/testdata/sf0.001").select("word", "n", "n_near", "form", "form_n", "root").collect())) == by_patterns(counted(docs))


def test_no_vocabulary_goes_through_the_driver(spark, tmp_path):
    """Stored words are small in their files; what is made of them is not."""
    spark.createDataFrame([("hallo", 9), ("halo", 3), ("w" * 70, 4)], "word string, n long").write.parquet(str(tmp_path / "w"))
    words = spark.read.parquet(str(tmp_path / "w"))
    plan = spelling.near(words)._jdf.queryExecution().executedPlan().toString()
    assert "Broadcast" not in plan and plan.count("SortMergeJoin") >= 5
    plan = spelling.variants(words)._jdf.queryExecution().executedPlan().toString()
    assert "Broadcast" not in plan
