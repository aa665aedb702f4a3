import collections
import random
import re
from fractions import Fraction

import numpy as np
import pytest

from lumenark.llm import components, embedding_dedup, minhash_dedup


def union(n, pairs):
    up = list(range(n))

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    for a, b in pairs:
        a, b = find(a), find(b)
        up[max(a, b)] = min(a, b)
    return [find(x) for x in range(n)]


@pytest.mark.parametrize("local", [0, 1000])
def test_components(spark, local):
    rng = random.Random(2)
    pairs = [(i, i + 1) for i in range(100, 140)] + [(rng.randint(0, 60), rng.randint(0, 60)) for _ in range(40)] + [(7, 7)] + [(200, i) for i in range(201, 260)]
    want = union(260, pairs)
    got = {r.id: r.component for r in components.components(spark.createDataFrame(pairs, "a long, b long"), local_edges=local).collect()}
    ends = {x for p in pairs if p[0] != p[1] for x in p}
    assert got == {x: want[x] for x in ends}
    assert components.components(spark.createDataFrame([], "a long, b long"), local_edges=local).count() == 0


def weighted_shingles(text):
    """Five-word shingles and their counts, by the docstring's rule and nothing of the module."""
    w = tuple(re.findall(r"[0-9A-Za-z\u0080-\U0010ffff]+", (text or "").lower()))
    return w, collections.Counter(w[i : i + 5] for i in range(len(w) - 4)) if len(w) >= 5 else collections.Counter([w] if w else [])


def similarity(x, y):
    """Probability Jaccard by its definition, in fractions."""
    both = x.keys() & y.keys()
    if not both:
        return Fraction(0)
    if max(*x.values(), *y.values()) == 1:
        return Fraction(len(both), len(x.keys() | y.keys()))
    every = x.keys() | y.keys()
    return sum(1 / sum(max(Fraction(x[e], x[d]), Fraction(y[e], y[d])) for e in every) for d in both)


def brute(texts, threshold=Fraction(4, 5)):
    own = [weighted_shingles(t) for t in texts]
    pairs = []
    for i, (w, x) in enumerate(own):
        for j, (v, y) in enumerate(own[:i]):
            # no more than the common share of the larger one can be similar
            if w and v and (w == v or len(x.keys() & y.keys()) >= 0.8 * max(len(x), len(y)) * 0.99 and similarity(x, y) >= threshold or max(*x.values(), *y.values()) > 1 and x.keys() & y.keys() and similarity(x, y) >= threshold):
                pairs.append((i, j))
    return union(len(texts), pairs)


def words(rng, n):
    return ["".join(rng.choices("abcdefghij", k=5)) for _ in range(n)]


def edited(rng, own, share):
    out = list(own)
    for i in rng.sample(range(len(out)), int(len(out) * share)):
        out[i] = "".join(rng.choices("klmnop", k=5))
    return out


def test_near_duplicates(spark):
    rng = random.Random(4)
    texts = [None, "", "... !!", "one", "One!", "one two three four", "a b c d e"]
    base = words(rng, 300)
    texts += [" ".join(base)] * 3 + [" ".join(edited(rng, base, 0.01)) for _ in range(60)] + [" ".join(edited(rng, base, s)) for s in (0.02, 0.03, 0.04, 0.1, 0.3)]
    passage = words(rng, 60)
    texts += [" ".join(passage + words(rng, 60)) for _ in range(40)]
    for _ in range(10):
        own = words(rng, rng.randint(30, 200))
        texts += [" ".join(own), " ".join(own[: int(len(own) * 0.9)]), " ".join(own + own)]
    texts += [" ".join(base * 20)]
    rows = list(enumerate(texts))
    rng.shuffle(rows)
    df = spark.createDataFrame([(*r, 1) for r in rows], "doc_id long, text string, id int").repartition(5)
    got = {r.doc_id: r.class_id for r in minhash_dedup.near_duplicates(df).collect()}
    assert [got[i] for i in range(len(texts))] == brute(texts)


@pytest.mark.parametrize("dense", [0, 4])
def test_bridges_are_found(spark, monkeypatch, dense):
    """A chain whose ends are apart is one class, in blocks of any size and density."""
    monkeypatch.setattr(minhash_dedup, "BLOCK", 4)
    monkeypatch.setattr(minhash_dedup, "DENSE", dense)
    monkeypatch.setattr(minhash_dedup, "PIVOT_PAIRS", 3)
    rng = random.Random(9)
    base, texts = words(rng, 200), []
    for i in range(25):
        base = base[6:] + words(rng, 6)
        texts.append(" ".join(base))
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.doc_id: r.class_id for r in minhash_dedup.near_duplicates(df).collect()}
    assert [got[i] for i in range(25)] == brute(texts)


def test_near_duplicates_of_odd_tables(spark):
    df = spark.createDataFrame([(1, "same text of six whole words"), (1, "same text of six whole words"), (None, "same text of six whole words"), (2, None)], "doc_id long, text string")
    got = sorted((r.doc_id or -1, r.class_id or -1, r.kept) for r in minhash_dedup.near_duplicates(df).collect())
    assert got == [(-1, -1, True), (1, 1, True), (2, 2, True)]
    assert minhash_dedup.near_duplicates(df.limit(0)).count() == 0


def test_pairs_at_the_threshold_link(spark):
    """8 of 10 shingles in common: 0.8 without rounding below it."""
    a = [f"w{i}" for i in range(13)]
    rows = [(1, " ".join(a)), (2, " ".join(a[:-1] + ["other"])), (3, " ".join(["x", *a])), (4, " ".join(a[:12]))]
    got = {r.doc_id: r.class_id for r in minhash_dedup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert [got[i] - 1 for i in range(1, 5)] == brute([t for _, t in rows])


def test_repeated_ids_and_hot_texts(spark):
    """Rows of one id are one document; a text that most rows share is one class."""
    rows = [(i % 40, "the very same text of more than five words") for i in range(400)] + [(500 + i, None) for i in range(50)]
    got = {r.doc_id: (r.class_id, r.kept) for r in minhash_dedup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string").repartition(4)).collect()}
    assert got == {i: (0, i == 0) for i in range(40)} | {500 + i: (500 + i, True) for i in range(50)}


def test_probability_jaccard_by_definition():
    rng = np.random.default_rng(1)
    for _ in range(50):
        a, b = (np.unique(rng.integers(0, 30, 20)).astype(np.uint64) for _ in range(2))
        x, y = rng.integers(1, 6, len(a)), rng.integers(1, 6, len(b))
        wx, wy = dict(zip(a, x)), dict(zip(b, y))
        want = sum(1 / sum(max(wx.get(e, 0) / wx[d], wy.get(e, 0) / wy[d]) for e in {*wx, *wy}) for d in wx if d in wy)
        assert abs(minhash_dedup.probability_jaccard(a, x, b, y) - want) < 1e-9


def test_signatures_estimate_it():
    rng = random.Random(3)
    a = words(rng, 400)
    texts = [" ".join(a), " ".join(edited(rng, a, 0.02)), " ".join(a[:200] * 2), "w"]
    v, c, _ = minhash_dedup.shingles(texts)
    s = minhash_dedup.signatures(v, c, 4096)
    for i in range(3):
        for j in range(3):
            assert abs((s[i] == s[j]).mean() - minhash_dedup.probability_jaccard(v[i], c[i], v[j], c[j])) < 0.04
    assert (s[3] == v[3][0]).all()


def brute_links(rows, threshold=0.93):
    ok = [i for i, (_, v, lab) in enumerate(rows) if lab is not None and v and all(x is not None and np.isfinite(x) for x in v) and any(v)]
    pairs = []
    for k, i in enumerate(ok):
        for j in ok[:k]:
            a, b = np.array(rows[i][1], float), np.array(rows[j][1], float)
            if rows[i][2] == rows[j][2] and len(a) == len(b) and a @ b / (np.linalg.norm(a) * np.linalg.norm(b)) >= threshold:
                pairs.append((i, j))
    n = [0] * len(rows)
    for i, j in pairs:
        n[i] += 1
        n[j] += 1
    return n, union(len(rows), pairs)


@pytest.mark.parametrize("tile", [7, 2048])
def test_embeddings(spark, tile):
    rng = np.random.default_rng(6)
    centres = rng.normal(size=(6, 16))
    rows = []
    for i in range(160):
        v = (centres[i % 6] + rng.normal(size=16) * rng.choice([0.05, 0.25, 0.3, 1.0])).astype(np.float32).tolist()
        rows.append((i, v, int(rng.integers(0, 2))))
    rows += [(160 + k, rows[0][1], rows[0][2]) for k in range(30)]
    rows += [(190, [2 * x for x in rows[0][1]], rows[0][2]), (191, None, 0), (192, [0.0] * 16, 0), (193, [float("nan")] * 16, 0), (194, [None] * 16, 0), (195, rows[0][1], None), (196, [1.0], 0), (197, [], 0), (198, [float("inf")] + [1.0] * 15, 0)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int").repartition(4)
    got = {r.vec_id: (r.n_links, r.component_id, r.kept) for r in embedding_dedup.near_duplicates(df, tile=tile).collect()}
    n, low = brute_links(rows)
    assert got == {i: (n[i], low[i], low[i] == i) for i in range(len(rows))}
    assert embedding_dedup.near_duplicates(df.limit(0)).count() == 0


def test_error_bounds_hold():
    rng = np.random.default_rng(8)
    x = rng.normal(size=(200, 24)) * rng.lognormal(size=(200, 24))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    q, s, g, e = embedding_dedup.quantise(x)
    est = (q.astype(int) @ q.astype(int).T) * s[:, None] * s[None, :]
    assert (np.abs(est - x @ x.T) <= e[:, None] + g[:, None] * e[None, :] + 1e-12).all()


def test_sketches_lose_little_next_to_the_bands():
    from math import comb

    size, t = minhash_dedup.SIZE, 0.8
    lost = sum(comb(size, k) * t**k * (1 - t) ** (size - k) for k in range(size + 1) if k < minhash_dedup.least_places(t))
    assert lost < 0.001 * (1 - t**minhash_dedup.PER_BAND) ** minhash_dedup.BANDS


def test_very_small_and_large_components(spark):
    rows = [(1, [1e-170, 2e-170], 0), (2, [1e-170, 2e-170], 0), (3, [3e200, 6e200], 0), (4, [2.0, -1.0], 0), (5, [5e-324, 1e-323], 0)]
    got = {r.vec_id: (r.n_links, r.component_id) for r in embedding_dedup.near_duplicates(spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")).collect()}
    assert got == {1: (3, 1), 2: (3, 1), 3: (3, 1), 4: (0, 4), 5: (3, 1)}


def test_a_worker_gives_back_what_a_task_took():
    """Spark's workers outlive tasks: what earlier operators left in them adds up."""
    import subprocess
    import sys

    said = """
import re
from lumenark.llm import common

stay = []

def anonymous():
    return int(re.search(r"\\nAnonymous:\\s+(\\d+)", open("/proc/self/smaps_rollup").read()).group(1)) >> 10

common.kept("another's")["x"] = common.kept("own")["x"] = 1

def run(batches):
    assert "x" not in common.kept("another's") and "x" in common.kept("own")
    large = []
    for n in range(2000):
        large.append(b"x" * (100_000 + n))
        stay.append(b"x" * (1000 + n))  # so that glibc keeps the pages before it
    del large
    yield from batches

before = anonymous()
assert list(common.returning(run, keeps="own")(iter([1, 2]))) == [1, 2]
print(anonymous() - before)
"""
    if sys.platform != "linux":
        pytest.skip("reads /proc")
    left = subprocess.run([sys.executable, "-c", said], capture_output=True, text=True, check=True, timeout=120).stdout
    assert int(left) < 50


def test_the_stages_give_back(spark, monkeypatch):
    """Every Python function of the pipeline's near-duplicates and packing; packing keeps its encoder."""
    import public_tokenizers
    from pyspark.sql.classic.dataframe import DataFrame

    from lumenark.llm import packing
    from lumenark.llm.common import drop_kept

    seen, real = [], DataFrame.mapInArrow

    def spy(self, func, *a, **b):
        seen.append(func)
        return real(self, func, *a, **b)

    monkeypatch.setattr(DataFrame, "mapInArrow", spy)
    docs = spark.createDataFrame([(i, "one two three four five six " + "seven " * (i % 3)) for i in range(9)], "doc_id long, text string")
    assert minhash_dedup.near_duplicates(docs).where("kept").count() == 3
    packing.pack(docs, public_tokenizers.path("byte_bpe_50k.json"))
    assert len(seen) > 4 and all(hasattr(f, "__wrapped__") for f in seen)
    packing._ENCODERS["a file", True] = None
    drop_kept("encoders")
    assert ("a file", True) in packing._ENCODERS
    drop_kept()
    assert not packing._ENCODERS


def test_signatures_do_not_depend_on_the_batch():
    rng = np.random.default_rng(5)
    texts = [" ".join(rng.choice(["a", "bc", "def", "é", "x1"], int(n))) for n in rng.integers(0, 300, 60)] + ["", None]
    values, counts, keys = minhash_dedup.shingles(texts)
    whole = minhash_dedup.signatures(values, counts)
    for at in (1, 7, 25):
        some = [minhash_dedup.shingles(texts[i : i + at]) for i in range(0, len(texts), at)]
        assert [k for s in some for k in s[2]] == keys
        assert (np.concatenate([minhash_dedup.signatures(s[0], s[1]) for s in some]) == whole).all()
