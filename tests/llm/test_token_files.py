import zlib

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from lumenark.llm import queries, token_files

BPE = public_tokenizers.path("byte_bpe_50k.json")
LONG = " ".join(f"word{i}" for i in range(5000))
TEXTS = {5: "the cat", 3: "", 9: None, -4: "née 梦 😀 <|endoftext|>", 7: LONG, 1 << 60: "x" * 3000, 8: "the cat", 2: "\n\n  "}


@settings(max_examples=60, deadline=None)
@given(st.lists(st.sampled_from([0, 3, 255, 256, 50256, 65535, 65536, 1 << 24, (1 << 32) - 1]), max_size=1500), st.data())
def test_any_token_and_any_range(ids, data):
    ids = np.array(ids, "<u4")
    cut = data.draw(st.integers(0, len(ids)))
    file = token_files.held(token_files.pack_file(2, 9, [None, 77], [cut, len(ids) - cut], ids))
    assert (file.task, file.nth, file.size, file.keys(), file.ends().tolist()) == (2, 9, len(ids), [None, 77], [cut, len(ids)])
    assert [file[i] for i in range(len(ids))] == ids.tolist() == file.ids().tolist()
    lo = data.draw(st.integers(0, len(ids)))
    hi = data.draw(st.integers(lo, len(ids)))
    assert file.ids(lo, hi).tolist() == ids[lo:hi].tolist()
    for i in (-1, len(ids)):
        with pytest.raises(IndexError):
            file[i]


def test_a_token_costs_few_bytes():
    ids = np.arange(200_000, dtype="<u4")
    content, seen = token_files.pack_file(0, 0, [1], [len(ids)], ids), []

    def read(at, n):
        seen.append(n)
        return content[at : at + n]

    file = token_files.TokenFile(read)
    seen.clear()
    assert file[123_456] == 123_456 and sum(seen) <= 3 * (1 + 64 + 4) and file.length == len(content)
    with pytest.raises(ValueError):
        token_files.held(b"PAR1")


def expected(rows):
    tokenizer, at = Tokenizer.from_file(BPE), 0
    coded = [(i, np.array([*tokenizer.encode(t or "", add_special_tokens=False).ids, 2], "<u4")) for i, t in rows]
    out = []
    for i, ids in sorted(coded, key=lambda r: (r[0] is not None, r[0] or 0)):
        out.append((i, at, len(ids), zlib.crc32(ids.tobytes()), ids.tolist()))
        at += len(ids)
    return out


def test_files_hold_every_token_in_order(spark):
    rows = [*TEXTS.items(), (None, "no id"), (None, "no id"), (5, "the cat")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("doc_id", "text", "1 AS n", "2 AS ROW", "'x' AS content").repartition(3)
    root = token_files.write(docs, BPE, file_ids=4000)
    want = expected(rows)
    found = sorted(map(tuple, token_files.index(spark, root).select("start", "doc_id", "n_tokens", "ids_crc32").collect()))
    assert found == [(s, i, n, c) for i, s, n, c, _ in want]
    back = token_files.index(spark, root).join(token_files.read(spark, root).drop("doc_id"), ["file", "place"]).orderBy("start").collect()
    assert [r["ids"] for r in back] == [w[4] for w in want]
    flat = [x for w in want for x in w[4]]
    assert spark.read.parquet(f"{root}/files").count() > 1
    assert [token_files.token(spark, root, i) for i in (0, 1, 4321, len(flat) - 1)] == [flat[i] for i in (0, 1, 4321, len(flat) - 1)]
    with pytest.raises(IndexError):
        token_files.token(spark, root, len(flat))


def test_equal_ids_keep_every_text(spark):
    texts = ["a", "b b", "a", None, "c c c"] * 20
    root = token_files.write(spark.createDataFrame([(1, t) for t in texts], "doc_id long, text string").repartition(4), BPE, file_ids=50)
    rows = token_files.index(spark, root).orderBy("start").collect()
    assert [r.start for r in rows] == np.cumsum([0, *(r.n_tokens for r in rows)])[:-1].tolist()
    assert sorted(r.ids_crc32 for r in rows) == sorted(w[3] for w in expected([(1, t) for t in texts]))


def test_an_empty_table_gives_no_file(spark):
    root = token_files.write(spark.createDataFrame([], "doc_id long, text string"), BPE)
    assert token_files.index(spark, root).count() == token_files.read(spark, root).count() == 0


def test_op12_against_brute_force(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    want = [w[:4] for w in expected([tuple(r) for r in docs.select("doc_id", "text").collect()])]
    assert sorted(map(tuple, queries.QUERIES["op12_token_files"](spark, "/root/testdata/sf0.001").collect())) == sorted(want)
