"""Configuration, store, engine, replay, migration and streams."""

import json
import os
import shutil
import threading
import time
from http.server import BaseHTTPRequestHandler, ThreadingHTTPServer

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tessera import models
from tessera.config import EngineConfig, IndexConfig, SplitterConfig, StorageConfig, load_config
from tessera.models import Failure, HashingEmbedder, HttpEmbedder, HttpReranker, OverlapReranker, score_column
from tessera.operators import dml, replay
from tessera.operators.chunk import BATCH_BYTES, chunk, text_slices
from tessera.plans.engine import Engine
from tessera.plans.ingest import process_documents
from tessera.plans.requests import Header, dispatch
from tessera.plans.search import search_documents
from tessera.functions import ids
from tessera.sources import legacy, migrate, readers
from tessera.sources.store import Conflict, Store
from tessera.streaming.ingest import ingest_stream, replay_stream

CONFIG = EngineConfig(index=IndexConfig(dimensions=32, metric_kind="Cos"), splitter=SplitterConfig(max_tokens=20))
TEXT = {
    "a": "The quick brown fox jumps over the dog. A lazy dog sleeps in the warm sun.\nRivers carry water down to the cold sea. Boats sail upon the wide rivers every day.",
    "b": "Bread is baked in a hot oven daily. Flour and water make a simple dough for bread.",
    "c": "Stars shine in the dark night sky above. Planets move around the bright burning star.",
}


def documents(spark, workspace, **texts):
    return spark.createDataFrame([(workspace, f"u://{k}", v) for k, v in texts.items()], "workspace_id string, url string, text string")


@pytest.fixture
def engine(spark, tmp_path):
    e = Engine(spark, f"file://{tmp_path}/store", CONFIG, HashingEmbedder(32), OverlapReranker())
    e.insert(documents(spark, "w1", **TEXT)).collect()
    e.insert(documents(spark, "w2", b=TEXT["b"])).collect()
    return e


def state(e):
    return {t: sorted(map(str, e.store.table(t).collect())) for t in ("docs", "splits", "summaries")}


def test_insert_and_query(engine):
    got = engine.query("bread flour dough oven", workspaces=["w1"]).orderBy("doc_rank").collect()
    assert got[0].url == "u://b" and got[0].workspace_id == "w1"
    assert [s.split_rank for s in got[0].splits] == sorted(s.split_rank for s in got[0].splits)
    assert len(got[0].summaries) == 2
    assert all(s.embedding is None for s in got[0].splits)
    both = engine.query("bread flour dough oven", workspaces=["w1", "w2"], top_k=2, mode=1).collect()
    assert {r.workspace_id for r in both} == {"w1", "w2"}
    assert engine.query("bread", workspaces=["w1"], top_k=0).count() == 0
    assert engine.query("bread", workspaces=["nowhere"]).count() == 0


@pytest.mark.parametrize("kind", ["F16", "BF16"])
def test_stored_vectors_are_of_the_scalar_kind(spark, tmp_path, kind):
    config = EngineConfig(index=IndexConfig(dimensions=32, metric_kind="Cos", scalar_kind=kind), splitter=SplitterConfig(max_tokens=20))
    plain = process_documents(documents(spark, "w", **TEXT), CONFIG, HashingEmbedder(32))
    e = Engine(spark, f"file://{tmp_path}/store", config, HashingEmbedder(32))
    e.insert(documents(spark, "w", **TEXT)).collect()
    for name, key in (("splits", "split_id"), ("summaries", "summary_id")):
        before = {r[key]: r.embedding for r in getattr(plain, name).collect()}
        after = {r[key]: r.embedding for r in e.store.table(name).collect()}
        if kind == "F16":
            assert after == {k: np.array(v, np.float16).astype(float).tolist() for k, v in before.items()}
        assert after.keys() == before.keys() and after != before
        # of a float's 24 significant bits the last 13 or 16 are gone
        assert not (np.array(list(after.values()), np.float32).view(np.uint32) & ((1 << (13 if kind == "F16" else 16)) - 1)).any()


def test_merge_level_and_settings_that_are_refused(spark, tmp_path):
    docs = documents(spark, "w", **TEXT)
    count = lambda level: process_documents(docs, EngineConfig(index=CONFIG.index, splitter=SplitterConfig(max_tokens=20, merge_level=level)), HashingEmbedder(32)).splits.count()
    assert count(0) > count(None)
    for bad in (EngineConfig(index=IndexConfig(dimensions=32, scalar_kind="I8")), EngineConfig(index=IndexConfig(dimensions=32, scalar_kind="B1")), EngineConfig(index=CONFIG.index, splitter=SplitterConfig(merge_level=2))):
        with pytest.raises(ValueError, match="scalar_kind|merge_level"):
            Engine(spark, f"file://{tmp_path}/none", bad, HashingEmbedder(32))


def test_query_options(engine):
    everything = engine.query("dog", workspaces=["w1"]).collect()
    star = next(r.doc_id for r in everything if r.url == "u://c")
    assert [r.url for r in engine.query("dog", workspaces=["w1"], doc_ids=[star]).collect()] == ["u://c"]
    ranked = engine.query("dog sleeps", workspaces=["w1"], mode=2, rerank=True, verbose=True).collect()
    inner = [m for r in ranked for s in r.splits for m in s.summaries]
    assert {m.rank for m in inner} == set(range(len(inner)))
    assert all(len(s.embedding) == 32 for r in ranked for s in r.splits)
    assert "query_embedding" in ranked[0].asDict()


def test_replace_delete_retrieve(engine, spark):
    before = engine.retrieve("w1", url="u://a", verbose=True).first()
    assert before.status == "Success" and [s.seq_id for s in before.splits] == list(range(len(before.splits)))
    engine.insert(documents(spark, "w1", a="Only one short sentence is left here now.")).collect()
    after = engine.retrieve("w1", doc_id=before.doc_id).first()
    assert len(after.splits) == 1 and len(before.splits) > 1
    gone = engine.delete("w1", [before.doc_id, 5]).collect()
    assert {r.doc_id: r.status for r in gone} == {before.doc_id: "Success", 5: "NotFound"}
    assert engine.retrieve("w1", doc_id=before.doc_id).first().status == "Error"
    assert engine.store.table("splits").filter(F.col("doc_id") == before.doc_id).count() == 0
    assert engine.retrieve("w2", url="u://b").first().status == "Success"
    with pytest.raises(ValueError):
        engine.retrieve("w1", doc_id=0)
    with pytest.raises(ValueError):
        engine.delete("", [1])


def test_reopen_compact_and_refuse(engine, spark, tmp_path):
    engine.delete("w1", [r.doc_id for r in engine.store.table("docs").filter("url <> 'u://b'").collect()]).collect()
    before = state(engine)
    again = Engine(spark, f"file://{tmp_path}/store", CONFIG, HashingEmbedder(32))
    assert state(again) == before
    assert engine.maintain() and state(engine) == before
    assert not engine.maintain()
    assert engine.store.dead_rows().filter("dead_bytes > 0").count() == 0
    assert {(r.workspace_id, r.n_docs) for r in engine.store.stats().collect()} == {("w1", 1), ("w2", 1)}
    with pytest.raises(ValueError):
        Store(spark, f"file://{tmp_path}/store", model_id=1, n_embd=32)
    with pytest.raises(ValueError):
        again.rerank("q", spark.createDataFrame([(0, "x")], "index int, text string"))


class Crash(RuntimeError):
    pass


@pytest.mark.parametrize("step", ["_write", "_publish", "_rename"])
def test_a_crash_at_any_step_leaves_the_last_version(engine, spark, tmp_path, monkeypatch, step):
    """Whatever step of an insert or a compaction ends the writer, what was there before is there after, and cleaning keeps it."""
    before = state(engine)

    def crash(*_):
        raise Crash

    monkeypatch.setattr(Store, step, crash)
    with pytest.raises(Crash):
        engine.insert(documents(spark, "w1", z="This text never becomes visible at all."))
    monkeypatch.setattr(engine.store, "most_commits", 0)
    assert engine.maintain() is False  # the failure is logged
    monkeypatch.undo()
    again = Engine(spark, f"file://{tmp_path}/store", CONFIG, HashingEmbedder(32))
    again.store.clean()
    assert state(again) == before
    again.insert(documents(spark, "w1", z="This text becomes visible later on."))
    assert "u://z" in {r.url for r in again.store.table("docs").collect()}


def test_cleaning_needs_a_manifest(engine, spark, tmp_path):
    shutil.rmtree(f"{tmp_path}/store/_manifests")
    lost = Engine(spark, f"file://{tmp_path}/store", CONFIG, HashingEmbedder(32))
    with pytest.raises(RuntimeError, match="no manifest"):
        lost.store.clean()
    assert any((tmp_path / "store" / "docs").iterdir())


def test_of_two_writers_one_gets_a_conflict(engine, spark, tmp_path):
    other = Engine(spark, f"file://{tmp_path}/store", CONFIG, HashingEmbedder(32))
    engine.insert(documents(spark, "w1", y="The first writer came in before you."))
    with pytest.raises(Conflict):
        other.insert(documents(spark, "w1", x="The second writer came in too late."))
    with pytest.raises(Conflict):
        other.store.clean()
    assert {"u://y"} == {r.url for r in engine.store.table("docs").collect()} - {"u://a", "u://b", "u://c"}
    other.store.refresh()
    other.insert(documents(spark, "w1", x="The second writer tries it again."))
    engine.store.refresh()
    assert state(engine) == state(other)


def test_many_commits_are_one_scan(spark, tmp_path):
    e = Engine(spark, f"file://{tmp_path}/store", CONFIG, HashingEmbedder(32))
    e.insert(documents(spark, "w", **TEXT))
    commit = e.store.manifest.commits[0]
    for n in range(199):
        folder = f"copy-{n}"
        for t in ("docs", "splits", "summaries"):
            shutil.copytree(f"{tmp_path}/store/{t}/batch={commit['folder']}", f"{tmp_path}/store/{t}/batch={folder}")
        e.store.manifest.commits.append(commit | {"folder": folder})
    rows = e.store._read("splits")
    plan = rows._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Relation") == 1 and "Union" not in plan
    assert rows.count() == 200 * spark.read.parquet(f"{tmp_path}/store/splits/batch={commit['folder']}").count()
    e.store.manifest = e.store._load()
    e.store.most_commits = 0
    before = state(e)
    assert e.maintain() and len(e.store.manifest.commits) == 1 and state(e) == before
    assert len(list((tmp_path / "store" / "splits").iterdir())) == 1


def test_rows_in_requested_order(engine, spark):
    ids = [r.split_id for r in engine.store.table("splits").filter("workspace_id = 'w1'").orderBy("split_id").collect()]
    asked = [ids[2], 5, ids[0], ids[2]]
    wanted = spark.createDataFrame([(n, "w1", i) for n, i in enumerate(asked)], "position int, workspace_id string, split_id long")
    got = engine.store.get("splits", wanted).orderBy("position").collect()
    assert [(r.position, r.split_id) for r in got] == [(0, ids[2]), (2, ids[0]), (3, ids[2])] and all(r.text for r in got)


def test_bad_documents_are_rejected_whole(spark, tmp_path):
    e = Engine(spark, f"file://{tmp_path}/store", CONFIG, HashingEmbedder(32))
    p = process_documents(documents(spark, "w", **TEXT), CONFIG, e.embedder)
    bad = p.docs.filter("url = 'u://b'").first().doc_id
    p.rows = None
    p.splits = p.splits.withColumn("embedding", F.when(F.col("doc_id") == bad, F.slice("embedding", 1, 3)).otherwise(F.col("embedding")))
    assert {r.doc_id: r.status for r in e.store.append(p).collect()}[bad] == "Error"
    assert {r.url for r in e.store.table("docs").collect()} == {"u://a", "u://c"}
    assert e.store.table("summaries").filter(F.col("doc_id") == bad).count() == 0


def test_splits_without_a_vector_fail_alone(spark):
    p = process_documents(documents(spark, "w", a="!!! ... ???\n" + "word " * 25), CONFIG, HashingEmbedder(32))
    assert p.splits.count() == 2
    p = process_documents(documents(spark, "w", a="!!! ??? " * 10 + "\n" + "word " * 20), CONFIG, HashingEmbedder(32))
    assert p.failures.count() == 1 and p.docs.count() == 1


def test_rerank_and_health(engine, spark):
    texts = spark.createDataFrame([(0, "about bread"), (1, "nothing"), (2, "bread and butter"), (3, "!!")], "index int, text string")
    got = engine.rerank("bread butter", texts, return_text=True).orderBy("rank").collect()
    assert [(r["index"], r.text) for r in got] == [(2, "bread and butter"), (0, "about bread"), (1, "nothing")]
    with pytest.raises(ValueError):
        engine.rerank("", texts)
    assert engine.health().first().status == "OK"


def log(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, seq long, kind int, entity_id long, split_ids array<bigint>, summary_ids array<bigint>")


def live(df):
    return sorted((r.doc_id, r.entity_id) for r in df.filter("kind <> 1").collect())


def test_replay(spark):
    D, S, X = 1, 2, 4
    full = [(1, 1, S, 10, None, None), (1, 2, D, 0, [10], []), (2, 3, S, 20, None, None), (2, 4, D, 0, [20], [])]
    assert live(replay.committed(log(spark, full))) == [(1, 10), (2, 20)]
    assert live(replay.committed(log(spark, full[:3]))) == [(1, 10)]
    torn = [*full, (1, 5, X, 0, None, None), (1, 6, S, 11, None, None)]
    assert live(replay.committed(log(spark, torn))) == [(2, 20)]
    stale = [*torn, (1, 7, S, 12, None, None), (1, 8, D, 0, [12], [])]
    assert live(replay.committed(log(spark, stale))) == [(1, 12), (2, 20)]
    assert live(replay.snapshot_and_tail(log(spark, full), 2)) == [(1, 10), (2, 20)]


def test_replay_stream_agrees(spark, tmp_path):
    rows = [(d, 10 * d + n, k, 100 * d + n, sp, None) for d in range(20) for n, k, sp in ((1, 2, None), (2, 3, None), (3, 1, [100 * d + 1]), *(((4, 4, None),) if d % 4 == 0 else ()))]
    df = log(spark, rows)
    for part in (0, 1):
        df.filter(F.col("seq") % 10 > 2 if part else F.col("seq") % 10 <= 2).coalesce(1).write.mode("append").parquet(f"{tmp_path}/log/p{part}")
    src = spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", True).parquet(f"{tmp_path}/log")
    q = replay_stream(src).writeStream.format("parquet").option("checkpointLocation", f"{tmp_path}/c").option("path", f"{tmp_path}/out").trigger(availableNow=True).start()
    q.awaitTermination()
    last = spark.read.parquet(f"{tmp_path}/out").groupBy("doc_id").agg(F.max_by("deleted", "seq").alias("deleted"), F.count("*").alias("n")).collect()
    assert {r.doc_id for r in last if not r.deleted} == {r.doc_id for r in replay.committed(df).collect()}
    assert len(last) == 20


def test_replay_stream_keeps_few_states(spark, tmp_path):
    """Documents share a state; those without an id too, and whole numbers stay exact beside nulls."""
    big = 1 << 60
    rows = [(d, 10 * n + at, k, e, sp, None) for n, d in enumerate([None, *range(big, big + 40)]) for at, k, e, sp in ((1, 2, big + 1, None), (2, 3, big + 2, None), (3, 1, None, [big + 1]))]
    rows += [(d, 10_000 + d % 100, k, e, None, None) for d in range(big, big + 40) for k, e in (((2, big + 5),) if d % 3 else ((4, None),))]
    df = log(spark, rows)
    for part, batch in enumerate((df.filter("seq % 10 = 1 and seq < 10000"), df.filter("seq % 10 <> 1 or seq >= 10000"))):
        batch.coalesce(1).write.parquet(f"{tmp_path}/log/p{part}")
    src = spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", True).parquet(f"{tmp_path}/log")
    q = replay_stream(src, buckets=3).writeStream.format("parquet").option("checkpointLocation", f"{tmp_path}/c").option("path", f"{tmp_path}/out").trigger(availableNow=True).start()
    q.awaitTermination()
    assert 0 < max(p["stateOperators"][0]["numRowsTotal"] for p in q.recentProgress if p["stateOperators"]) <= 4
    got = sorted(map(tuple, spark.read.parquet(f"{tmp_path}/out").select("doc_id", "seq", "deleted", "n_splits", "n_summaries").collect()), key=str)
    want = [(d, 10 * n + 3, False, 1, 1) for n, d in enumerate([None, *range(big, big + 40)])] + [(d, 10_000 + d % 100, True, 0, 0) for d in range(big, big + 40) if d % 3 == 0]
    assert got == sorted(want, key=str)


def test_replay_stream_forgets_torn_inserts(spark, tmp_path):
    put = lambda name, *rows: (log(spark, list(rows)).coalesce(1).write.parquet(f"{tmp_path}/new/{name}"), os.makedirs(f"{tmp_path}/log", exist_ok=True), os.rename(f"{tmp_path}/new/{name}", f"{tmp_path}/log/{name}"))
    put("a", (1, 1, 2, 11, None, None), (2, 2, 2, 12, None, None))
    src = spark.readStream.schema(log(spark, []).schema).option("recursiveFileLookup", True).parquet(f"{tmp_path}/log")
    q = replay_stream(src, hold_ms=8000, buckets=1).writeStream.format("memory").queryName("held").option("checkpointLocation", f"{tmp_path}/c").start()

    def wait(done):
        end = time.time() + 40
        while not done() and time.time() < end:
            time.sleep(0.2)

    states = lambda: (q.lastProgress or {"stateOperators": []})["stateOperators"]
    held = lambda: sorted(map(tuple, spark.table("held").collect()))
    try:
        wait(lambda: states() and states()[0]["numRowsTotal"])
        put("b", (2, 3, 1, None, None, None))
        wait(held)
        assert held() == [(2, 3, False, 1, 0)]
        wait(lambda: not states()[0]["numRowsTotal"])
        put("c", (1, 4, 1, None, None, None))
        wait(lambda: len(held()) == 2)
        assert held() == [(1, 4, False, 0, 0), (2, 3, False, 1, 0)]
    finally:
        q.stop()


def test_ingest_stream(spark, tmp_path):
    e = Engine(spark, f"file://{tmp_path}/store", CONFIG, HashingEmbedder(32))
    rows = documents(spark, "w", **TEXT).withColumn("seq", F.lit(1)).unionByName(documents(spark, "w", a="A new version of this text stands here.").withColumn("seq", F.lit(2)))
    rows.write.parquet(f"{tmp_path}/in")
    src = spark.readStream.schema(rows.schema).parquet(f"{tmp_path}/in")
    ingest_stream(src, e, f"{tmp_path}/c").awaitTermination()
    assert e.store.table("docs").count() == 3
    assert len(e.retrieve("w", url="u://a").first().splits) == 1


def test_a_query_searches_once_and_a_batch_stages_what_it_stores(spark, engine):
    seen = spark.sparkContext.accumulator(0)

    @F.udf("array<float>")
    def counted(v):
        seen.add(1)
        return v

    counted = counted.asNondeterministic()
    tables = {t: engine.store.table(t) for t in ("docs", "splits", "summaries")}
    for t in ("splits", "summaries"):
        tables[t] = tables[t].withColumn("embedding", counted("embedding"))
    text = "bread flour dough oven"
    found = search_documents(*tables.values(), HashingEmbedder(32).embed([text])[0], k=3, workspaces=["w1", "w2"], query_text=text, reranker=OverlapReranker())
    assert found.count() == engine.query(text, workspaces=["w1", "w2"], top_k=3, rerank=True).count() > 0
    assert 0 < seen.value <= sum(engine.store.table(t).count() for t in ("splits", "summaries"))
    staged = [n for n in engine.store._names("") if n.startswith("_staging-")]
    assert len(staged) == 2
    for name in staged:
        assert "sentences" not in spark.read.parquet(f"{engine.store.root}/{name}/rows").columns
        assert spark.read.schema("doc_id long").parquet(f"{engine.store.root}/{name}/bad").count() == 0


def test_only_summaries_of_found_documents_are_scored(spark, engine):
    seen = spark.sparkContext.accumulator(0)

    class Counted(OverlapReranker):
        def score(self, query, texts):
            seen.add(len(texts))
            return super().score(query, texts)

    text = "bread flour dough oven"
    tables = [engine.store.table(t) for t in ("docs", "splits", "summaries")]
    rows = search_documents(*tables, HashingEmbedder(32).embed([text])[0], k=1, mode=1, workspaces=["w2"], query_text=text, reranker=Counted()).collect()
    assert len(rows) == 1 and 0 < seen.value <= len(rows[0].summaries) < tables[2].count()


def test_python_gets_bounded_batches(spark):
    docs = spark.range(60).coalesce(1).select("id", F.lit("word " * 40_000).alias("text"))
    chunk(docs, "text", 100)
    sizes = docs.mapInArrow(lambda batches: (pa.RecordBatch.from_pydict({"n": [b.nbytes]}) for b in batches), "n long").collect()
    assert sum(r.n for r in sizes) > 60 * 200_000 and max(r.n for r in sizes) <= 2 * BATCH_BYTES
    parts = list(text_slices(iter([pa.RecordBatch.from_pydict({"t": ["a" * 60, None, "b" * 300, "c" * 60, ""]}), pa.RecordBatch.from_pydict({"t": pa.array([], pa.string())})]), 0, 100))
    assert [p.column(0).to_pylist() for p in parts] == [["a" * 60, None], ["b" * 300], ["c" * 60, ""], []]


def test_embedder_remembers_a_bounded_number_of_words():
    for lo in range(0, 200_000, 1000):
        HashingEmbedder(16).embed([" ".join(f"w{n}" for n in range(lo, lo + 500)), "x" * 100 + str(lo)])
    assert len(models._places(16)) <= models._Places.MOST
    assert not any(len(w) > models._Places.LONGEST for w in models._places(16))


def test_embedders_with_and_without_arrays_agree(spark):
    class Lists:
        n_embd, path = 32, "hashing"

        def embed(self, texts):
            return HashingEmbedder(32).embed(texts)

    docs = documents(spark, "w", **TEXT, d="!!! ... ???\n" + "word " * 25, e="!!! ??? ... !!! ok. " * 30, f="", g="er thouat er thouat")
    found = [{t: sorted(map(str, getattr(process_documents(docs, CONFIG, e), t).collect())) for t in ("docs", "splits", "summaries", "failures")} for e in (Lists(), HashingEmbedder(32))]
    assert found[0] == found[1] and found[0]["failures"] and found[0]["summaries"]


def test_set_operations(spark):
    lists = spark.createDataFrame([([1, 2], [[2, 3], [3, 4]]), (None, [[5]]), ([], [[]])], "d array<bigint>, s array<array<bigint>>")
    got = lists.select(dml.extra_summary_ids(F.col("d"), F.col("s")), dml.owned_summary_ids(F.col("d"), F.col("s")), dml.distinct_summaries(F.col("d"), F.col("s")), dml.empty_as_null(F.col("d"))).collect()
    assert [tuple(r) for r in got] == [([3, 4], [1, 2, 3, 4], 4, [1, 2]), ([5], [5], 1, None), ([], [], 0, None)]


def test_migration(spark):
    docs = spark.createDataFrame([(1, "u1", [10], [100]), (2, "u2", [20], []), (3, "u3", [30], []), (4, "u4", [40], [])], "doc_id long, url string, split_ids array<bigint>, summary_ids array<bigint>")
    splits = spark.createDataFrame([(10, 1), (20, 2), (30, 3), (40, 4)], "split_id long, doc_id long")
    summaries = spark.createDataFrame([(100, 1)], "summary_id long, doc_id long")
    vec = spark.createDataFrame([(10, [1.0, 0.0], 7), (100, [0.0, 1.0], 7), (20, [1.0, 1.0], 7), (40, [1.0], 7)], "embedding_id long, embedding array<float>, model_id long")
    rows = spark.createDataFrame([(10, 1, "A"), (100, 1, "B"), (20, 2, "A"), (40, 4, "B")], "embed_id long, doc_id long, user_uuid string")
    m = legacy.migrate(legacy.Legacy(docs, splits, summaries, vec, rows), 2, 7)
    assert sorted((r.workspace_id, r.doc_id) for r in m.docs.collect()) == [("A", 1), ("A", 2), ("B", 1)]
    assert [r.doc_id for r in m.shared.collect()] == [1] and [r.doc_id for r in m.orphans.collect()] == [3]
    assert {(r.doc_id, r.reason) for r in m.failures.collect()} == {(4, "split")}
    assert {r.workspace_id: (r.n_read, r.n_written) for r in m.report.collect()} == {"A": (2, 2), "B": (2, 1), None: (4, 3)}


def test_migration_from_files(spark, tmp_path, capsys):
    tables = {
        "documents": ([(1, "u1", [10], [100]), (2, "u2", [20], []), (3, "u3", [30], [])], "doc_id long, url string, split_ids array<bigint>, summary_ids array<bigint>"),
        "splits": ([(10, 1, "one"), (20, 2, "two"), (30, 3, "three")], "split_id long, doc_id long, text string"),
        "summaries": ([(100, 1, 10)], "summary_id long, doc_id long, split_id long"),
        "embeddings": ([(10, [1.0, 0.0], 7), (100, [0.0, 1.0], 7), (20, [1.0, 1.0], 7)], "embedding_id long, embedding array<float>, model_id long"),
        "embedding_filter_info": ([(10, 1, "A"), (20, 2, "B"), (30, 3, "B")], "embed_id long, doc_id long, user_uuid string"),
    }
    for name, (rows, schema) in tables.items():
        spark.createDataFrame(rows, schema).write.parquet(f"{tmp_path}/old/{name}")
    args = [f"file://{tmp_path}/old", f"file://{tmp_path}/new", "--model", "m", "--width", "2"]
    assert migrate.main([*args, "--report-only"], spark) == 1 and not (tmp_path / "new").exists()
    assert migrate.main(args, spark) == 1
    said = capsys.readouterr().out
    assert "B: 1 of 2 documents" in said and "all: 2 of 3 documents" in said and "failed for want of a split: 1" in said
    model = spark.range(1).select(ids.model_id("m", 2)).first()[0]
    store = Store(spark, f"file://{tmp_path}/new", model_id=model, n_embd=2)
    assert {(r.workspace_id, r.url) for r in store.table("docs").collect()} == {("A", "u1"), ("B", "u2")}
    assert {(r.split_id, r.text) for r in store.table("splits").collect()} == {(10, "one"), (20, "two")} and store.table("summaries").count() == 1


def test_files_end_at_the_size_of_a_segment(spark, tmp_path):
    e = Engine(spark, f"file://{tmp_path}/store", EngineConfig(index=CONFIG.index, splitter=SplitterConfig(max_tokens=4)), HashingEmbedder(32))
    e.store.segment_bytes = 10 * (4 * 32 + 512)
    e.insert(documents(spark, "w", a="some words stand here. " * 60).coalesce(1))
    sizes = [spark.read.parquet(str(f)).count() for f in (tmp_path / "store" / "splits").rglob("*.parquet")]
    assert max(sizes) == 10 and sum(sizes) == e.store.table("splits").count() > 30


def test_config(tmp_path):
    p = tmp_path / "c.toml"
    p.write_text('[index]\ndimensions = 384\nmetric_kind = "Cos"\n[splitter]\nmax_tokens = 512\n[embedding_model]\npath = "m"\nn_embd = 384\nn_ctx = 5\n[storage]\nfsync_interval_ms = 0\n')
    c = load_config(p)
    assert c.index.metric_kind == "Cos" and c.storage.sync_every_write and c.storage.memory_budget_bytes == 4096 << 20
    for bad in ({"dir": ""}, {"memory_budget_mb": 0}, {"segment_max_mb": 0}, {"snapshot_interval_s": 0}, {"compact_ratio": 0.0}, {"compact_ratio": 1.5}):
        with pytest.raises(ValueError):
            StorageConfig(**bad)
    p.write_text("[index]\ndimensions = 2\n[storage]\nodd = 1\n")
    with pytest.raises(ValueError):
        load_config(p)
    (tmp_path / "c.yaml").write_text("x")
    with pytest.raises(ValueError):
        load_config(tmp_path / "c.yaml")
    with pytest.raises(FileNotFoundError):
        load_config(tmp_path / "none.toml")


def test_readers(spark, tmp_path):
    long = "x" * 40
    (tmp_path / "p.csv").write_bytes(f'id,passage\r\n1,"a ""quoted"", and\nbroken passage of some length"\r\n2,short\r\n3, {long} \r\n4,{long}\r\n'.encode())
    got = [r.passage for r in readers.load_passages(spark, str(tmp_path / "p.csv")).orderBy("first_at").collect()]
    assert got == ['a "quoted", and\nbroken passage of some length', long]
    (tmp_path / "r.json").write_text('{"query": "q", "summaries": ["a", "b"]}')
    assert [(r.query, r["index"], r.text) for r in readers.read_rerank_json(spark, str(tmp_path / "r.json")).collect()] == [("q", 0, "a"), ("q", 1, "b")]
    (tmp_path / "t.txt").write_text("one\ntwo")
    assert readers.read_texts(spark, str(tmp_path / "t.txt"), "w").first().text == "one\ntwo"
    df = spark.createDataFrame([(1, "x")], "a int, b string")
    assert readers.from_json(readers.to_json(df), df.schema).collect() == df.collect()


def test_requests(engine, spark):
    head, reply = dispatch(engine, Header.of("query"), {"input": "bread flour", "workspace_ids": ["w1"], "top_k": 1})
    assert head.status == 1 and head.response_ts >= head.request_ts and reply.count() >= 1
    docs = documents(spark, "w3", z="A document that came by request today.")
    assert dispatch(engine, Header.of("insert"), {"documents": docs})[1].first().status == "Success"
    got = dispatch(engine, Header.of("retrieve"), {"workspace_id": "w3", "document_url": "u://z"})[1].first()
    assert engine.store.contains("w3", got.doc_id) and not engine.store.contains("w3", 1)
    assert engine.store.doc_id_for_url("u://z").first().doc_id == got.doc_id
    assert engine.store.vectors("splits").filter("workspace_id = 'w3'").count() == 1
    assert dispatch(engine, Header.of("delete"), {"workspace_id": "w3", "document_ids": [got.doc_id]})[1].first().status == "Success"
    assert dispatch(engine, Header.of("health"))[1].count() == 1
    for kind, body in (("query", {}), ("retrieve", {}), ("rerank", {"query": "", "texts": docs}), ("unknown", {})):
        head, reply = dispatch(engine, Header.of(kind), body)
        assert head.status == 2 and head.error_message and reply is None


def test_torn_tail_and_corruption(spark):
    df = log(spark, [(1, n, 2, n, None, None) for n in range(1, 9)]).withColumn("segment", F.floor(F.col("seq") / 5))
    df = df.withColumn("crc", replay.checksum(df.columns))
    damage = lambda at: df.withColumn("crc", F.when(F.col("seq") == at, 0).otherwise(F.col("crc")))
    assert replay.verified(df, 1).count() == 8
    assert sorted(r.seq for r in replay.verified(damage(7), 1).collect()) == [1, 2, 3, 4, 5, 6]
    with pytest.raises(Exception, match="corrupt record in sealed segment 0 from seq 3"):
        replay.verified(damage(3), 1).collect()
    assert replay.snapshot_is_usable(5, 5, 5) and not replay.snapshot_is_usable(5, 5, 6) and not replay.snapshot_is_usable(None, 5, 5)


def test_frames_are_checked_whole(spark):
    rows = [(n, 2, 7, n, f"text {n}", [1.0, float(n)]) for n in range(1, 7)]
    df = spark.createDataFrame(rows, "seq long, kind int, doc_id long, entity_id long, text string, embedding array<float>").withColumn("segment", F.lit(1))
    df = df.withColumn("crc", replay.checksum(df.columns))
    at = F.col("seq") == 4
    for bad, what in (
        (df.withColumn("text", F.when(at, "text 44").otherwise(F.col("text"))), "wrong checksum"), (df.withColumn("embedding", F.when(at, F.array(F.lit(1.0), F.lit(4.5)).cast("array<float>")).otherwise(F.col("embedding"))), "wrong checksum"),
        (df.withColumn("kind", F.when(at, 9).otherwise(F.col("kind"))), "unknown kind"), (df.withColumn("embedding", F.when(at, F.slice("embedding", 1, 1)).otherwise(F.col("embedding"))), "wrong length"),
        (df.withColumn("crc", F.when(~at, F.col("crc"))), "truncated"),
    ):
        assert sorted(r.seq for r in replay.verified(bad, 1, width=2).collect()) == [1, 2, 3]
        with pytest.raises(Exception, match=f"segment 1 from seq 4: {what}"):
            replay.verified(bad, 2, width=2).collect()
    assert replay.verified(df, 1, width=2).count() == 6


class Server(BaseHTTPRequestHandler):
    """Vectors and scores by length of text; a text "slow" is answered late, "wrong" badly, and the first call of each "again" not at all."""

    seen: set = set()

    def do_POST(self):
        body = json.loads(self.rfile.read(int(self.headers["Content-Length"])))
        texts = body.get("input", body.get("texts"))
        if "slow" in texts:
            time.sleep(1.5)
        if "again" in texts and not self.seen:
            self.seen.add(1)
            self.send_error(503)
            return
        if "wrong" in texts:
            self.send_error(400)
            return
        answer = {"embeddings": [None if t == "none" else [float(len(t)), 1.0, 0.0][: 2 if t == "narrow" else 3] for t in texts]} if "input" in body else {"scores": [float(len(t)) for t in texts]}
        data = json.dumps(answer).encode()
        self.send_response(200)
        self.send_header("Content-Length", str(len(data)))
        self.end_headers()
        self.wfile.write(data)

    def log_message(self, *_):
        pass


@pytest.fixture
def server():
    s = ThreadingHTTPServer(("127.0.0.1", 0), Server)
    threading.Thread(target=s.serve_forever, daemon=True).start()
    yield f"http://127.0.0.1:{s.server_port}/"
    s.shutdown()


def test_models_behind_a_server(spark, server):
    model = HttpEmbedder(server, 3, timeout=0.5, retries=1, batch=1, pause=0.01)
    got = model.embed(["abc", "again", "slow", "wrong", "none", "narrow", "abcd"])
    assert (got[0], got[1], got[4], got[6]) == ([3.0, 1.0, 0.0], [5.0, 1.0, 0.0], None, [4.0, 1.0, 0.0])
    assert [isinstance(g, Failure) for g in got] == [False, False, True, True, False, True, False]
    p = process_documents(documents(spark, "w", a="A text of five words.", b="slow", c="wrong"), CONFIG, model)
    errors = {r.url: r.error for r in p.failures.collect()}
    assert {r.url for r in p.docs.collect()} == {"u://a"} and "400" in errors["u://c"] and "timed out" in errors["u://b"]
    texts = spark.createDataFrame([(0, "ab"), (1, "wrong"), (2, "abcd")], "index int, text string")
    scores = texts.withColumn("score", score_column("q", F.col("text"), HttpReranker(server, timeout=0.5, retries=0, batch=1))).collect()
    assert [r.score for r in scores] == [2.0, None, 4.0] or [r.score for r in scores][1] != [r.score for r in scores][1]
    assert all(isinstance(v, Failure) for v in HttpEmbedder("http://127.0.0.1:9/", 3, timeout=0.5, retries=0).embed(["a", "b"]))


def test_chunks_by_tokens_and_own_patterns(spark):
    path = os.path.join("/opt/tokenizers", "word_bpe_49k.json")
    if not os.path.exists(path):
        pytest.skip("no tokenizer files here")
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(path)
    text = "Unbelievably long compounds, like internationalisation; stand here. " * 6 + "x" * 400
    docs = spark.createDataFrame([(1, text), (2, None)], "id long, text string")
    got = chunk(docs, "text", 12, tokenizer=path).orderBy("seq_id").collect()
    assert [r.seq_id for r in got] == list(range(len(got))) and all(0 < r.token_len <= 12 for r in got)
    assert all(r.token_len == len(tokenizer.encode(r.text, add_special_tokens=False).ids) for r in got)
    assert "".join("".join(r.text for r in got).split()) == "".join(text.split())
    assert [r.text for r in chunk(spark.createDataFrame([("a|b c|d",)], "text string"), "text", 1, patterns=[["|"]]).orderBy("seq_id").collect()] == ["a|", "b", "c|", "d"]
    config = EngineConfig(index=CONFIG.index, splitter=SplitterConfig(max_tokens=12, hf_model_id=path, patterns=[["; "], [". "]]))
    splits = process_documents(documents(spark, "w", a=text), config, HashingEmbedder(32)).splits.collect()
    assert len(splits) > 6 and all(r.token_len <= 12 for r in splits)
