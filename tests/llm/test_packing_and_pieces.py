import random
import zlib

import numpy as np
import public_tokenizers
import pytest
import sentencepiece
from hypothesis import given, settings
from hypothesis import strategies as st

from lumenark.llm import packing, pieces
from lumenark.llm.bpe import ChunkedBpe

BPE, PIECES = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")
TEXTS = ["", "the cat sat on the mat", "  two  spaces\n\n\tand tabs ", "née Ünïcödé 梦 😀", "<|endoftext|> a <|endoftext|>", "x" * 3000, "a\nb " * 400, "I'm you're 's 42 4 2!!", "\x1c\x85 \u3000 x", None]


@pytest.fixture(scope="module")
def bpe():
    return ChunkedBpe(BPE)


@pytest.fixture(scope="module")
def model():
    return pieces.PieceModel(PIECES)


def whole(bpe, text):
    return bpe.tokenizer.encode(text or "", add_special_tokens=False).ids


def test_chunked_ids_are_the_librarys(bpe):
    for text, ids in zip(TEXTS, bpe.encode(TEXTS)):
        assert np.frombuffer(ids, "<u4").tolist() == whole(bpe, text)


@settings(max_examples=150, deadline=None)
@given(st.text(alphabet=" \n\tab'é梦.1|", max_size=60))
def test_chunked_ids_of_any_text(bpe, text):
    assert np.frombuffer(bpe.encode([text])[0], "<u4").tolist() == whole(bpe, text)


def check_pieces(rows, limits, texts, bpe):
    by_doc, by_seq = {}, {}
    for r in rows:
        by_doc.setdefault(r.doc_id, []).append(r)
        by_seq.setdefault(r.sequence_id, []).append(r)
    for doc, own in by_doc.items():
        ids, at = np.array([*whole(bpe, texts[doc]), 1], "<u4"), 0
        for r in sorted(own, key=lambda r: r.start):
            assert r.start == at and r.doc_tokens == len(ids) and r.ids_crc32 == zlib.crc32(ids[at : at + r.length].tobytes())
            at += r.length
        assert at == len(ids)
    for own in by_seq.values():
        own.sort(key=lambda r: r.offset)
        assert [r.offset for r in own] == np.cumsum([0, *[r.length for r in own]])[:-1].tolist()
        n = sum(r.length for r in own)
        assert n <= limits.tokens and len(own) <= limits.segments and sum(r.loss_tokens for r in own) <= limits.loss_tokens
        assert n == limits.tokens or n & (n - 1) == 0


@pytest.mark.parametrize("limits", [packing.Limits(), packing.Limits(64, 3, 40), packing.Limits(16, 1, 16), packing.Limits(7, 2, 3)])
def test_pack(spark, bpe, limits):
    rng = random.Random(1)
    texts = TEXTS + [" ".join(rng.choice(["the", "of", "zqx", "élan"]) for _ in range(rng.randint(1, 300))) for _ in range(60)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    rows = packing.pack(docs, BPE, limits=limits).collect()
    assert {r.doc_id for r in rows} == set(range(len(texts)))
    check_pieces(rows, limits, texts, bpe)


def test_pack_prompts_bear_no_loss(spark, bpe):
    docs = spark.createDataFrame([(i, "the answer is here " * 5, "some long question " * 8) for i in range(30)], "doc_id long, text string, prompt string")
    rows = packing.pack(docs.coalesce(1), BPE, prompt_col="prompt", limits=packing.Limits(256, 8, 90), keep_ids=True).collect()
    answer = len(whole(bpe, "the answer is here " * 5)) + 1
    assert sum(r.loss_tokens for r in rows) == 30 * answer
    sums = {}
    for r in rows:
        sums[r.sequence_id] = sums.get(r.sequence_id, 0) + r.loss_tokens
        assert len(r.ids) == r.length
    assert max(sums.values()) <= 90


def test_pack_little_padding(spark):
    docs = spark.createDataFrame([(i, "word " * (i % 700 + 1)) for i in range(1500)], "doc_id long, text string").coalesce(1)
    rows = packing.pack(docs, BPE).collect()
    n = {}
    for r in rows:
        n[r.sequence_id] = n.get(r.sequence_id, 0) + r.length
    assert sum(v == 2048 for v in n.values()) >= len(n) - 12


def test_pack_odd_tables(spark):
    empty = spark.createDataFrame([], "doc_id long, text string, extra int")
    assert packing.pack(empty, BPE).count() == 0
    twice = spark.createDataFrame([(1, "same", "n"), (1, "same", "n"), (None, None, None)], "doc_id long, text string, length string")
    rows = packing.pack(twice.coalesce(1), BPE).collect()
    assert sum(r.length for r in rows if r.doc_id == 1) == 4 and sum(r.length for r in rows if r.doc_id is None) == 1
    with pytest.raises(ValueError):
        packing.Packer(packing.Limits(0, 1, 1))


def brute(m, s):
    """Viterbi over the whole lattice."""
    best, back = [0.0] + [-1e300] * len(s), [None] * (len(s) + 1)
    for j in range(1, len(s) + 1):
        for i in range(max(0, j - m.longest), j):
            hit = m.pieces.get(s[i:j])
            if hit and best[i] + hit[1] > best[j]:
                best[j], back[j] = best[i] + hit[1], (i, [hit[0]])
            elif not hit and j == i + 1 and best[i] + m.unknown > best[j]:
                best[j], back[j] = best[i] + m.unknown, (i, [m.bytes[b] for b in s[i].encode()])
    out, j = [], len(s)
    while j:
        i, p = back[j]
        out, j = p + out, i
    return out


@settings(max_examples=150, deadline=None)
@given(st.lists(st.sampled_from(["the ", "a", "é", "  ", "\n", "梦", "😀", "ing", "tion", " ", "\0"]), max_size=120).map("".join))
def test_viterbi(model, text):
    ids = np.frombuffer(model.encode(text), "<u4").tolist()
    assert model.decode(ids) == text
    if text:
        s = pieces.SPACE + text.replace(" ", pieces.SPACE)
        assert ids == brute(model, s)
        stream, got = pieces.StreamingViterbi(model), []
        for i in range(0, len(s), 7):
            got += stream.feed(s[i : i + 7])
        assert got + stream.settle() == ids


def test_long_text_streams_in_a_window(model):
    s = "abcdefgh" * 20_000
    stream, got, held = pieces.StreamingViterbi(model), [], 0
    for i in range(0, len(s), 1000):
        got += stream.feed(s[i : i + 1000])
        held = max(held, len(stream.text))
    assert held < 1100 and stream.commits > 9000 and model.decode([model.pieces["▁"][0], *got, *stream.settle()]) == s


def test_literal_marks_and_bad_ids(model):
    for text in ("▁", "a▁ ▁b", " ", "\0"):
        assert model.decode(np.frombuffer(model.encode(text), "<u4").tolist()) == text
    for bad in ([0], [1], [40_000], [-1]):
        with pytest.raises(ValueError):
            model.decode(bad)


def test_decodes_as_the_library(model):
    sp = sentencepiece.SentencePieceProcessor(model_file=PIECES)
    for text in ("the cat sat", "née 梦 😀", "a  b"):
        assert sp.decode(np.frombuffer(model.encode(text), "<u4").tolist()) == text
        assert model.decode(sp.encode(text)) == text


def test_piece_tables(spark):
    docs = spark.createDataFrame([(1, "a b", "x"), (1, "a b", "x"), (None, None, None), (2, "", "y")], "doc_id long, text string, ids string")
    out = pieces.decode(pieces.encode(docs, PIECES), PIECES).collect()
    assert [r.decoded for r in out] == ["a b", "a b", "", ""] and [len(r.ids) > 0 for r in out] == [True, True, False, False]
    assert pieces.encode(docs.limit(0), PIECES).count() == 0


def test_special_tokens(bpe):
    """By default as the library gives them; on request ordinary text."""
    import tokenizers

    plain = tokenizers.Tokenizer.from_file(BPE)
    text = "hello <|endoftext|> world"
    assert np.frombuffer(bpe.encode([text])[0], "<u4").tolist() == plain.encode(text, add_special_tokens=False).ids == [31373, 220, 50256, 995]
    plain.encode_special_tokens = True
    assert np.frombuffer(ChunkedBpe(BPE, specials=False).encode([text])[0], "<u4").tolist() == plain.encode(text, add_special_tokens=False).ids


def test_many_short_rows_pack_quickly():
    """140,000 rows of one id each wait as one demand."""
    import time

    packer, begun, n = packing.Packer(packing.Limits()), time.time(), 0
    one = np.array([1], np.uint32)
    for i in range(140_000):
        n += sum(len(s) for s in packer.add(one, 0, 0, i))
    n += sum(len(s) for s in packer.drain())
    assert n == 140_000 and time.time() - begun < 20


def test_pack_bare_ends(spark, bpe):
    """First and end ids bear no loss, and the limit on loss binds inside long texts."""
    rng = random.Random(2)
    texts = [None, "", *(" ".join(rng.choice(["the", "of", "zqx"]) for _ in range(rng.choice([1, 5, 40, 900]))) for _ in range(60))]
    limits = packing.Limits(64, 8, 62)
    rows = packing.pack(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").coalesce(2), BPE, limits=limits, bare_ends=True).collect()
    check_pieces(rows, limits, texts, bpe)
    for r in rows:
        bare = {0, r.doc_tokens - 1} & set(range(r.start, r.start + r.length))
        assert r.loss_tokens == r.length - len(bare)
    full = [r for r in rows if r.length == 64]
    assert all(r.loss_tokens < 64 for r in full)


def test_op9_query(spark, tmp_path):
    """The query's columns against the whole lattice's best path."""
    from lumenark.llm import queries

    texts = [None, "", "the cat sat on the mat", "née 梦 😀  two", "x" * 300, "same", "same"]
    spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    m = pieces.PieceModel(PIECES)
    for r in queries.QUERIES["op9_piece_encoding"](spark, str(tmp_path)).collect():
        t = texts[r.doc_id]
        ids = np.array(brute(m, pieces.SPACE + t.replace(" ", pieces.SPACE)) if t else [], "<u4")
        assert (r.n_ids, r.ids_crc32, r.exact) == (len(ids), zlib.crc32(ids.tobytes()), True)


def test_ids_are_committed_as_paths_converge(model, monkeypatch):
    """Every span that is not remembered is committed through the stream."""
    seen = []
    commit = pieces.StreamingViterbi._commit
    monkeypatch.setattr(pieces.StreamingViterbi, "_commit", lambda self: seen.append(len(self.text)) or commit(self))
    fresh = pieces.PieceModel(PIECES)
    fresh.encode("every word here is committed by itself")
    assert len(seen) == 7
