"""Column functions, chunks and centrality."""

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tessera.functions import ids, text, vectors
from tessera.operators import chunk, lexrank


def one(spark, v):
    return spark.createDataFrame([([float(x) for x in v],)], "v array<double>")


def test_cosine_of_nothing_is_one(spark):
    df = spark.createDataFrame([([0.0, 0.0], [1.0, 0.0])], "a array<double>, b array<double>")
    r = df.select(vectors.distance("Cos", F.col("a"), F.col("b")), vectors.distance("odd", F.col("a"), F.col("b")), vectors.l2_normalize(F.col("a"))).first()
    assert r[0] == 1.0 and r[1] == float("inf") and r[2] == [None, None]


def test_normalisations(spark):
    df = one(spark, [3, -4])
    get = lambda c: df.select(c).first()[0]
    assert get(vectors.p_normalize(F.col("v"), 2)) == pytest.approx([0.6, -0.8])
    assert get(vectors.p_normalize(F.col("v"), -1)) == [3, -4]
    assert get(vectors.p_normalize(F.col("v"), 0)) == pytest.approx([3 * 32760 / 4, -32760])
    assert get(vectors.p_normalize(F.col("v"), 3)) == pytest.approx(np.array([3, -4]) / 91 ** (1 / 3))
    assert one(spark, [0, 0]).select(vectors.p_normalize(F.col("v"), 2)).first()[0] == [0, 0]


def test_half_precision_is_exact(spark):
    rng = np.random.default_rng(3)
    x = np.concatenate([rng.standard_normal(500), rng.standard_normal(200) * 1e-6, rng.standard_normal(50) * 1e5, [0, 65504, 65519.9, 65520, -7e4, 6e-8, 2.9e-8]])
    got = np.array(one(spark, x).select(vectors.to_f16(F.col("v"))).first()[0])
    with np.errstate(over="ignore"):
        assert (got == x.astype(np.float16).astype(float)).all()


def test_quantised_kinds(spark):
    df = one(spark, [0.6, -0.8, 0.0])
    get = lambda k: df.select(vectors.quantize(F.col("v"), k)).first()[0]
    assert get("F64") == [0.6, -0.8, 0.0]
    assert get("I8") == [76, -102, 0]
    assert get("B1") == [1, 0, 0]
    assert get("BF16") == pytest.approx([0.6, -0.8, 0], abs=0.004)
    with pytest.raises(ValueError):
        get("F8")


def test_width_check(spark):
    df = spark.createDataFrame([([1.0, 2.0],)], "v array<float>")
    assert df.select(vectors.check_width(F.col("v"), 2)).first()[0] == [1, 2]
    with pytest.raises(Exception, match="expected a vector of width 3"):
        df.select(vectors.check_width(F.col("v"), 3)).collect()


def test_ids_are_stable_and_apart(spark):
    df = spark.range(1)
    a = df.select(ids.split_id(F.lit(1), F.lit(23)), ids.split_id(F.lit(12), F.lit(3)), ids.doc_id(F.lit("u")), ids.doc_id(F.lit("u"))).first()
    assert a[0] != a[1] and a[2] == a[3]


def test_sentences(spark):
    df = spark.createDataFrame([("One two three four. No. Is this one long enough? tail without an end",), ("",), (None,)], "t string")
    got = [r[0] for r in df.select(text.sentences(F.col("t"))).collect()]
    assert got == [["One two three four.", "Is this one long enough?", "tail without an end"], [], None]


@given(st.text(alphabet="ab .!?,;\n", max_size=200), st.integers(1, 12))
@settings(max_examples=200, deadline=None)
def test_chunks_keep_all_words_within_the_budget(t, budget):
    got = chunk.chunks(t, budget)
    assert " ".join(got).split() == t.split()
    assert all(1 <= chunk.count_words(c) <= budget for c in got)


def test_chunk_levels():
    t = "a b c.\n\nd e f. g h i.\nj k"
    assert chunk.chunks(t, 100) == [t]
    assert chunk.chunks(t, 5) == ["a b c.", "d e f.", "g h i.\nj k"]
    assert chunk.chunks("a b. c d", 100, merge=False) == ["a b.", "c d"]
    assert chunk.chunks("one two<SENT>three four", 2) == ["one two<SENT>", "three four"]


def test_chunk_operator(spark):
    df = spark.createDataFrame([(1, "a b c d e"), (2, None), (3, " \n ")], "doc_id long, text string")
    got = [(r.doc_id, r.seq_id, r.text, r.token_len) for r in chunk.chunk(df, "text", 2).orderBy("doc_id", "seq_id").collect()]
    assert got == [(1, 0, "a b", 2), (1, 1, "c d", 2), (1, 2, "e", 1)]


def test_power_iteration_equals_degree(spark):
    x = np.abs(np.random.default_rng(5).standard_normal((30, 6)))
    df = spark.createDataFrame([(i // 10, i, [float(v) for v in x[i]]) for i in range(30)], "g int, id long, embedding array<double>")
    a = sorted((r.g, r.rank, r.id, round(r.centrality, 8)) for r in lexrank.lexrank_power(df, ["g"], "id").collect())
    b = sorted((r.g, r.rank, r.id, round(r.centrality, 8)) for r in lexrank.lexrank_degree(df, ["g"], "id", threshold=None).collect())
    assert a == b and len(a) == 6


@given(st.integers(1, 12), st.integers(0, 1000), st.sampled_from([None, 0.3]))
@settings(max_examples=100, deadline=None)
def test_limit_of_power_iteration(n, seed, threshold):
    x = np.random.default_rng(seed).standard_normal((n, 3))
    x[n // 2 :, :2] = 0  # often more than one connected part
    assert lexrank.stationary_scores(x, threshold) == pytest.approx(lexrank.power_scores(x, threshold, max_iter=200_000, tolerance=1e-15), abs=1e-6)


def test_nearest_rank(spark):
    df = spark.createDataFrame([([5.0, 1.0, 3.0, 2.0],)], "v array<double>")
    assert df.select(text.nearest_rank(F.col("v"), 50)).first()[0] == 3.0
