"""Search, the global cut and merging."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera.operators import merge, rerank, stats, topk
from tessera.plans.search import ranked_splits


def hits(spark, *lists):
    rows = [(w, i, d) for w, one in enumerate(lists) for i, d in one]
    return spark.createDataFrame(rows, "workspace_id int, id long, distance double")


@pytest.mark.parametrize("seed", range(4))
def test_global_cut(spark, seed):
    """Random lists, with ties over and in them, against a plain sort."""
    rng = np.random.default_rng(seed)
    lists = [[(int(i), round(float(rng.random()), 1)) for i in rng.choice(90, rng.integers(0, 9), replace=False) + 100 * w] for w in range(rng.integers(1, 6))]
    order = sorted((d, w, i) for w, one in enumerate(lists) for i, d in one)
    for k in (0, 1, 4, len(order), 50):
        got = topk.keep_nearest(hits(spark, *lists), k, "id").orderBy("rank").collect()
        assert [(r.distance, r.workspace_id, r.id) for r in got] == order[:k]
        assert [r["rank"] for r in got] == list(range(1, len(got) + 1))


def vectors(spark, n=60, width=8, seed=1):
    x = np.random.default_rng(seed).standard_normal((n, width))
    rows = [(str(i % 3), i // 4, i, [float(v) for v in x[i]]) for i in range(n)]
    return spark.createDataFrame(rows, "workspace_id string, doc_id long, split_id long, embedding array<float>"), x.astype("float32").astype(float)


@pytest.mark.parametrize("metric", ["Cos", "IP", "L2sq"])
def test_search_is_exact(spark, metric):
    df, x = vectors(spark)
    q = x[7]
    d = {"Cos": 1 - x @ q / np.linalg.norm(x, axis=1) / np.linalg.norm(q), "IP": 1 - x @ q, "L2sq": ((x - q) ** 2).sum(axis=1)}[metric]
    got = [r.split_id for r in topk.search(df, list(q), 5, "split_id", metric).orderBy("rank").collect()]
    assert got == list(np.argsort(d, kind="stable")[:5])
    if metric == "Cos":
        assert got[0] == 7


def test_filters(spark):
    df, x = vectors(spark)
    q = list(x[7])
    ids = lambda **o: {r.doc_id for r in topk.search(df, q, 60, "split_id", **o).collect()}
    assert len(ids()) == 15
    assert ids(doc_ids=[1, 2]) == {1, 2}
    assert ids(doc_ids=[]) == set()
    assert ids(workspaces=[]) == set()
    assert ids(doc_ids=spark.createDataFrame([(3,), (3,)], "doc_id long")) == {3}
    one = topk.search(df, q, 60, "split_id", workspaces=["1", "1", "nowhere"]).collect()
    assert {r.workspace_id for r in one} == {"1"} and len(one) == 20
    with pytest.raises(ValueError):
        topk.search(df, q, -1, "split_id")


def test_many_queries_in_tiles(spark):
    df, x = vectors(spark)
    queries = df.select(F.col("split_id").alias("query_id"), F.col("embedding").alias("query_vector"))
    rows = lambda tile: sorted((r.query_id, r.rank, r.split_id) for r in topk.search_many(df, queries, 3, "split_id", tile=tile).collect())
    assert rows(7) == rows(4096)
    assert all(s == q for q, r, s in rows(4096) if r == 1)


@pytest.mark.parametrize("metric", ["Cos", "IP", "L2sq"])
def test_small_and_large_query_sets_agree(spark, metric):
    """On null vectors, null components, other widths, ties, and vectors whose difference is small beside them."""
    rng = np.random.default_rng(5)
    rows = [(i, rng.integers(-2, 3, 4).astype(float).tolist()) for i in range(80)]
    rows += [(100, None), (101, [1.0, 2.0]), (102, [1.0, None, 2.0, 3.0]), (103, [0.0] * 4), (104, []), *((200 + i, [1.0, 2.0, 0.0, 1.0]) for i in range(40)), *((300 + i, [1e8 + i, 1.0, 1.0, 1.0]) for i in range(6))]
    df = spark.createDataFrame(rows, "id long, embedding array<double>").repartition(5)
    asked = spark.createDataFrame([(i, v) for i, v in rows if v and len(v) == 4 and None not in v] + [(900, None)], "query_id long, query_vector array<double>")
    few, many = ({(r.query_id, r["rank"]): (r.id, r.distance) for r in topk.search_many(df, asked, 6, "id", metric, tile=t).collect()} for t in (4096, 7))
    assert few.keys() == many.keys() and {q for q, _ in few} == {i for i, v in rows if v and len(v) == 4 and None not in v}
    assert all(few[k] == pytest.approx(many[k], abs=1e-9, rel=1e-12) for k in few)
    assert not {i for i, _ in few.values()} & {100, 101, 102, 104}
    one = topk.topk(topk.scored(df, rows[0][1], metric), 200, "id").collect()
    assert len(one) == 80 + 1 + 40 + 6 and all(r.distance is not None for r in one)
    with pytest.raises(ValueError, match="widths"):
        topk.search_many(df, spark.createDataFrame([(1, [1.0]), (2, [1.0, 2.0])], asked.schema), 3, "id", metric, tile=1)


def test_ties_pass_on_k_rows_a_batch(spark):
    df = spark.createDataFrame([(i, [1.0, 1.0]) for i in range(3000)], "id long, embedding array<double>").coalesce(1)
    q = spark.createDataFrame([(i, [1.0, 1.0]) for i in range(5)], "query_id long, query_vector array<double>")
    near = topk._scored_in_batches(df.select("id", F.col("embedding").alias("vector")), q.collect(), 2, q.schema["query_id"].dataType, 3, "id", "Cos")
    assert near.count() <= 5 * 3 * 3 and {r.id for r in topk.search_many(df, q, 3, "id").collect()} == {0, 1, 2}


def test_direct_hit_overrides_and_summary_only_has_no_query_distance(spark):
    s = spark.createDataFrame([("a", 1, 10, 0.9), ("a", 1, 11, 0.2)], "workspace_id string, doc_id long, split_id long, distance double")
    m = spark.createDataFrame([("a", 1, 10, 100, 0.1), ("a", 2, 20, 200, 0.3), ("a", 2, 20, 201, 0.15)], "workspace_id string, doc_id long, split_id long, summary_id long, distance double")
    got = {r.split_id: r for r in merge.rank_documents(merge.merge_hits(s, m)).collect()}
    assert (got[10].query_distance, got[10].sort_distance, got[10].n_summaries) == (0.9, 0.9, 1)
    assert (got[20].query_distance, got[20].sort_distance, got[20].n_summaries) == (None, 0.15, 2)
    assert [got[i].doc_rank for i in (11, 10, 20)] == [2, 2, 1]
    assert got[11].split_rank == 1


def test_modes_plan_only_their_leg(spark):
    df, x = vectors(spark)
    m = df.withColumn("summary_id", F.col("split_id") + 1000)
    q = list(x[0])
    only = lambda mode: {(r.query_distance is None, r.n_summaries > 0) for r in ranked_splits(df, m, q, mode=mode)[0].collect()}
    assert only(1) == {(False, False)}
    assert only(2) == {(True, True)}
    assert only(3) == {(False, True)}
    with pytest.raises(ValueError):
        ranked_splits(df, m, q, mode=4)


def test_rank_puts_nan_last_and_join_drops(spark):
    s = spark.createDataFrame([(0, 0.5), (1, float("nan")), (2, 0.9), (3, 0.5)], "index int, score double")
    ranks = rerank.rank_scores(s)
    assert [r["index"] for r in ranks.orderBy("rank").collect()] == [2, 0, 3, 1]
    rows = spark.createDataFrame([(0, "a"), (2, "c"), (9, "z")], "index int, text string")
    assert sorted(r.text for r in rerank.attach(rows, ranks).collect()) == ["a", "c"]
    assert rerank.nan_count(s).first().n_nan == 1


def test_ranks_without_groups_are_dealt_to_many_tasks(spark):
    rng = np.random.default_rng(8)
    rows = [(i, [float("nan"), 0.5, float(rng.random()), float("-inf"), None][min(int(rng.integers(0, 9)), 4) if i % 3 else 2]) for i in range(500)]
    df = spark.createDataFrame(rows, "index int, score double").repartition(6)
    ranks = rerank.rank_scores(df)
    order = sorted(rows, key=lambda r: (r[1] is not None and r[1] != r[1], r[1] is None, -r[1] if r[1] is not None and r[1] == r[1] else 0, r[0]))
    assert [r["index"] for r in ranks.orderBy("rank").collect()] == [i for i, _ in order]
    assert sorted(r["rank"] for r in ranks.collect()) == list(range(500))
    assert "hashpartitioning(range_" in ranks._jdf.queryExecution().executedPlan().toString()
    assert rerank.rank_scores(df.limit(0)).count() == 0


@pytest.mark.parametrize("n", [1, 2, 3, 10, 101, 200, 6000])
def test_percentiles_are_the_nearest_ranks(spark, n):
    rng = np.random.default_rng(n)
    x = np.sort(np.round(rng.standard_normal(n), 2))
    rows = [(g, float(v)) for g in ("a", "b") for v in rng.permutation(x)] + [("none", None)]
    got = {r.g: r for r in stats.latency(spark.createDataFrame(rows, "g string, v double"), "v", ["g"], most=500).collect()}
    place = lambda p: int(np.floor(p * (n - 1) + 0.5))
    for g in ("a", "b"):
        assert (got[g].p50, got[g].p99, got[g].n) == (x[place(0.5)], x[place(0.99)], n) and got[g]["mean"] == pytest.approx(x.mean())
    assert (got["none"].p50, got["none"].n) == (None, 1)


def test_topk_plan_has_no_full_sort(spark):
    df, x = vectors(spark)
    plan = topk.topk(topk.scored(df, list(x[0]), "Cos"), 3, "split_id")._jdf.queryExecution().executedPlan().toString()
    assert "TakeOrderedAndProject" in plan and "Python" not in plan
    plan = topk.topk_by(topk.scored(df, list(x[0]), "Cos"), ["workspace_id"], 3, "split_id")._jdf.queryExecution().executedPlan().toString()
    assert "WindowGroupLimit" in plan
