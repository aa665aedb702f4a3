"""The stored keyword index says what a scan of the texts says."""

import itertools
import random
import re
import unicodedata

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from lumenark.operators import keyword, lexical
from lumenark.operators.keyword import Shape

ALL = Shape(keyword.FIELDS)
WORDS = ["dragon", "wake", "state-of-the-art", "loud", "the", "Silence", "art", "of", "state", "x_y", "é", "42"]


def chunks_of(spark, n=60, seed=3):
    r = random.Random(seed)
    text = lambda k: " ".join(r.choice(WORDS) for _ in range(r.choice([0, 1, k])))
    rows = [(i // 3, i % 3, r.choice([None, text(30), text(8)]), text(3), text(2)) for i in range(n)]
    return spark.createDataFrame(rows, "file_id long, seq long, text string, heading_path string, tags_text string")


@pytest.fixture(scope="module")
def stored(spark, tmp_path_factory):
    chunks = chunks_of(spark).cache()
    return chunks, keyword.write(chunks, str(tmp_path_factory.mktemp("keyword") / "k"), ALL)


SUBSETS = [dict(zip(c, w)) for n in (1, 2, 3) for c in itertools.combinations(keyword.FIELDS, n) for w in ([2.0, 0.5, 0.0][:n],)]


@pytest.mark.parametrize("columns", SUBSETS, ids=str)
def test_scores_are_the_scans_for_every_subset_of_columns(stored, columns):
    chunks, index = stored
    rows = lambda df: {(r.file_id, r.seq): (round(r.bm25, 9), round(r.bound, 9)) for r in df.collect()}
    for question, every in (("dragon state-of-the-art nowhere x_y", False), ("the art", True)):
        got = rows(keyword.bm25(index, question, columns, require_all=every))
        assert got == rows(lexical.bm25(chunks, question, columns, require_all=every)), question


def test_a_scope_keeps_the_stores_weights(stored, spark):
    chunks, index = stored
    scope = spark.createDataFrame([(1,), (4,), (99,)], "file_id long")
    mine = lambda df: sorted((r.file_id, r.seq, round(r.bm25, 9)) for r in df.collect())
    want = mine(lexical.bm25(chunks.join(scope, "file_id", "left_semi"), "dragon loud", {"text": 1.0}, chunks))
    assert mine(keyword.bm25(index, "dragon loud", {"text": 1.0}, scope)) == want and want


def test_phrases_stand_in_one_field(stored):
    chunks, index = stored
    for words in ("the art of", "of of", "nowhere at all", "..."):
        want = set()
        for r in chunks.collect():
            for text in (r.text, r.tags_text):
                toks = [t for t in re.split(r"[\W_]+", (text or "").lower()) if t]
                asked = [t for t in re.split(r"[\W_]+", words) if t]
                if asked and any(toks[i : i + len(asked)] == asked for i in range(len(toks))):
                    want.add((r.file_id, r.seq))
        assert {(r.file_id, r.seq) for r in keyword.phrase(index, words, ("text", "tags_text")).collect()} == want


def test_what_is_not_declared_is_an_error(stored, spark, tmp_path):
    chunks, _ = stored
    index = keyword.write(chunks, str(tmp_path / "k"), Shape(("text",)))
    assert index.counts.words[0] == sum(len([t for t in re.split(r"[\W_]+", r.text or "") if t]) for r in chunks.collect())
    with pytest.raises(ValueError):
        keyword.bm25(index, "dragon", {"heading_path": 1.0})


def test_a_search_reads_no_text_and_few_row_groups(stored):
    _, index = stored
    plan = index.postings.where(F.col("term").isin("dragon")).select("positions")._jdf.queryExecution().executedPlan().toString()
    assert "PushedFilters" in plan and "dragon" in plan
    rows, _ = keyword.matches(index, "dragon loud", {"text": 1.0})
    plan = rows._jdf.queryExecution().executedPlan().toString()
    assert "In(term, [dragon,loud])" in plan and "heading_path" not in plan and "text:" not in plan


def test_empty_tables(spark, tmp_path):
    index = keyword.write(chunks_of(spark).limit(0), str(tmp_path / "k"), ALL)
    assert index.counts == keyword.Counts(0, (0, 0, 0)) and keyword.bm25(index, "dragon", {"text": 1.0}).count() == 0


def test_marks_fold_only_if_asked(spark, tmp_path):
    rows = [(1, 0, "Café café ÀÉÎ"), (2, 0, "cafe aei"), (3, 0, "Ελλάδα ελλαδα")]
    chunks = spark.createDataFrame(rows, "file_id long, seq long, text string")
    plain, loose = (keyword.write(chunks, str(tmp_path / str(f)), Shape(("text",), f)) for f in (False, True))
    ids = lambda index, q: sorted(r.file_id for r in keyword.bm25(index, q, {"text": 1.0}).collect())
    assert ids(plain, "café") == [1] and ids(loose, "café") == ids(loose, "cafe") == ids(loose, "café") == [1, 2]
    assert ids(loose, "àéî") == [1, 2] and ids(loose, "ελλαδα") == [3] and ids(plain, "aei") == [2]


@given(st.text(max_size=30))
def test_folding_a_question_is_by_decomposition(text):
    for x in text:
        d = unicodedata.normalize("NFD", x)
        if ord(x) < 0x3000 and all(unicodedata.category(m) == "Mn" for m in d[1:]):
            assert keyword.fold(x) == ("" if unicodedata.category(d[0]) == "Mn" else d[0])


def snippet_by_hand(text, asked, size):
    pieces = re.findall(r"[^\W_]+(?:[\W_]+|$)", text or "") if text else []
    plain = [re.match(r"[^\W_]+", p)[0].lower() for p in pieces]
    at = [i for i, w in enumerate(plain) if w in asked]
    best = None
    for first in at:
        inside = [i for i in at if first <= i < first + size]
        key = (len({plain[i] for i in inside}), len(inside), -first)
        if best is None or key > best[0]:
            best = key, first, inside[-1]
    start = 0
    if best:
        start = max(0, min(best[1] - (size - (best[2] - best[1] + 1)) // 2, len(pieces) - size))
    shown = []
    for i in range(start, min(start + size, len(pieces))):
        w = re.match(r"[^\W_]+", pieces[i])[0]
        shown.append(f"<b>{w}</b>{pieces[i][len(w):]}" if i in at else pieces[i])
    return ("..." if start else "") + "".join(shown) + ("..." if start + size < len(pieces) else "")


@settings(max_examples=4, deadline=None)
@given(st.lists(st.lists(st.sampled_from(["dragon", "Wake", "loud", "a", "b ", "c,", "d\n", "...", "e-f"]), max_size=60).map(" ".join), min_size=20, max_size=40), st.sampled_from([1, 3, 8]))
def test_snippets_by_hand(spark, texts, size):
    texts += ["", None, "dragon", "a " * 200 + "dragon b loud " + "c " * 200]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, text string")
    got = {r.i: r.s for r in df.select("i", keyword.snippet(F.col("text"), "dragon wake-LOUD", size=size).alias("s")).collect()}
    assert got == {i: snippet_by_hand(t, {"dragon", "wake", "loud"}, size) for i, t in enumerate(texts)}


def test_postings_are_made_within_rows(spark):
    """Each word's places, whatever its text, and no shuffle to bring them together."""
    texts = [("b a b, A-b", "h b"), ("", "x"), (None, None), ("one", ""), ("  ,. ", "a a a"), ("é É 1 a " * 40, "z")]
    chunks = spark.createDataFrame([(i // 2, i % 2, *t) for i, t in enumerate(texts)], "file_id long, seq long, text string, heading_path string")
    want = {}
    for i, both in enumerate(texts):
        words = [[w for w in re.split(r"[\W_]+", (t or "").lower()) if w] for t in both]
        for j, ws in enumerate(words):
            for at, w in enumerate(ws):
                want.setdefault((w, i // 2, i % 2, j, tuple(map(len, words))), []).append(at)
    made = keyword.postings(chunks)
    got = {(r.term, r.file_id, r.seq, r.field, tuple(r.lengths)): r.positions for r in made.collect()}
    assert made.count() == len(want) and got == want
    assert "Exchange" not in made._jdf.queryExecution().executedPlan().toString()
