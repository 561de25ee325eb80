"""The catalogue: each query applies operators to whole tables; its SQL twin says the same for another engine."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tessera.config import EngineConfig, IndexConfig, SplitterConfig
from tessera.functions import ids, text, vectors
from tessera.models import HashingEmbedder, OverlapReranker, score_column
from tessera.operators import chunk as chunking
from tessera.operators import dml, lexrank, merge, replay, rerank, stats, topk
from tessera.plans.engine import Engine
from tessera.plans.ingest import first_sentences, process_documents
from tessera.plans.search import ranked_splits, search_documents
from tessera.schemas import KIND, SEARCH_MODE
from tessera.sources import legacy
from tessera.sources.paths import shared_folder
from tessera.sources.readers import distinct_passages
from tessera.streaming.ingest import replay_stream

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def add(name: str, f: Query, sql: str | None = None) -> None:
    QUERIES[name] = f
    if sql:
        ORACLES[name] = sql


def r6(c: str | Column) -> Column:
    return F.round(c, 6)


# --- vectors as splits and summaries -------------------------------------------------------------------------------
# Even vectors are splits, odd ones summaries of the split before; ten neighbours are a document, documents are dealt
# to three workspaces.

ENTITIES = """
v AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS e, label, vec_id // 10 AS doc_id, (vec_id // 10) % 3 AS workspace_id FROM embeddings),
s AS (SELECT workspace_id, doc_id, vec_id AS split_id, e FROM v WHERE vec_id % 2 = 0),
m AS (SELECT workspace_id, doc_id, vec_id - 1 AS split_id, vec_id AS summary_id, e FROM v WHERE vec_id % 2 = 1),
q AS (SELECT e AS qe FROM v WHERE vec_id = 0)"""
DISTANCE = {
    "Cos": "(1 - list_dot_product(e, qe) / sqrt(list_dot_product(e, e) * list_dot_product(qe, qe)))",
    "IP": "(1 - list_dot_product(e, qe))",
    "L2sq": "list_sum(list_transform(list_zip(e, qe), lambda p: (p[1] - p[2]) * (p[1] - p[2])))",
}


def entities(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """(vectors, splits, summaries, query) as above."""
    v = table(spark, sf_dir, "embeddings").withColumn("doc_id", F.floor(F.col("vec_id") / 10).cast("long"))
    v = v.withColumn("workspace_id", F.col("doc_id") % 3)
    splits = v.filter("vec_id % 2 = 0").select("workspace_id", "doc_id", F.col("vec_id").alias("split_id"), "embedding")
    summaries = v.filter("vec_id % 2 = 1").select("workspace_id", "doc_id", (F.col("vec_id") - 1).alias("split_id"), F.col("vec_id").alias("summary_id"), "embedding")
    query = v.filter("vec_id = 0").select(F.col("embedding").alias("query_vector"))
    return v, splits, summaries, query


def _topk(metric: str) -> Query:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        v, _, _, q = entities(spark, sf_dir)
        return topk.topk(topk.scored(v, q, metric), 10, "vec_id").select("rank", "vec_id", r6("distance").alias("distance"))

    return run


for _metric, _name in (("Cos", "topk_cosine"), ("L2sq", "topk_l2sq"), ("IP", "topk_ip")):
    add(_name, _topk(_metric), f"""WITH {ENTITIES}, d AS (SELECT vec_id, {DISTANCE[_metric]} AS d FROM v, q)
SELECT row_number() OVER (ORDER BY d, vec_id) AS rank, vec_id, round(d, 6) AS distance FROM d ORDER BY d, vec_id LIMIT 10""")

F16 = "list_transform(e, lambda x: CASE WHEN x = 0 THEN 0 ELSE round_even(x * pow(2, 10 - greatest(floor(log2(abs(x))), -14)), 0) / pow(2, 10 - greatest(floor(log2(abs(x))), -14)) END)"


def topk_f16_cosine(spark: SparkSession, sf_dir: str) -> DataFrame:
    v, _, _, q = entities(spark, sf_dir)
    v = v.withColumn("embedding", vectors.quantize(F.col("embedding"), "F16"))
    return topk.topk(topk.scored(v, q, "Cos"), 10, "vec_id").select("rank", "vec_id", r6("distance").alias("distance"))


add("topk_f16_cosine", topk_f16_cosine, f"""WITH {ENTITIES}, h AS (SELECT vec_id, {F16} AS e FROM v), d AS (SELECT vec_id, {DISTANCE['Cos']} AS d FROM h, q)
SELECT row_number() OVER (ORDER BY d, vec_id) AS rank, vec_id, round(d, 6) AS distance FROM d ORDER BY d, vec_id LIMIT 10""")

PER_WORKSPACE = f"""WITH {ENTITIES}, d AS (SELECT workspace_id, split_id, doc_id, {DISTANCE['Cos']} AS d FROM s, q),
w AS (SELECT *, row_number() OVER (PARTITION BY workspace_id ORDER BY d, split_id) AS rank FROM d)"""


def topk_per_workspace(spark: SparkSession, sf_dir: str) -> DataFrame:
    _, s, _, q = entities(spark, sf_dir)
    return topk.topk_by(topk.scored(s, q, "Cos"), ["workspace_id"], 5, "split_id").select("workspace_id", "rank", "split_id", r6("distance").alias("distance"))


add("topk_per_workspace", topk_per_workspace, PER_WORKSPACE + " SELECT workspace_id, rank, split_id, round(d, 6) AS distance FROM w WHERE rank <= 5")


def topk_global_cut(spark: SparkSession, sf_dir: str) -> DataFrame:
    _, s, _, q = entities(spark, sf_dir)
    return topk.search(s, q, 5, "split_id").select("rank", "workspace_id", "split_id", r6("distance").alias("distance"))


add("topk_global_cut", topk_global_cut, PER_WORKSPACE + " SELECT row_number() OVER (ORDER BY d, workspace_id, split_id) AS rank, workspace_id, split_id, round(d, 6) AS distance FROM w WHERE rank <= 5 ORDER BY d, workspace_id, split_id LIMIT 5")

FILTERED = (3, 4, 8, 15, 16, 23, 42)


def _filtered(doc_ids) -> Query:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        _, s, _, q = entities(spark, sf_dir)
        hits = topk.search(s, q, 5, "split_id", workspaces=[0, 1, 2], doc_ids=doc_ids)
        return hits.select("rank", "workspace_id", "doc_id", "split_id", r6("distance").alias("distance"))

    return run


_FILTER_SQL = f"""WITH {ENTITIES}, d AS (SELECT workspace_id, doc_id, split_id, {DISTANCE['Cos']} AS d FROM s, q WHERE doc_id IN ({', '.join(map(str, FILTERED))}))
SELECT row_number() OVER (ORDER BY d, workspace_id, split_id) AS rank, workspace_id, doc_id, split_id, round(d, 6) AS distance FROM d"""
add("topk_doc_filter", _filtered(FILTERED), _FILTER_SQL + " ORDER BY d, workspace_id, split_id LIMIT 5")
add("topk_doc_filter_empty", _filtered(()), _FILTER_SQL + " WHERE false")


def topk_batch_queries(spark: SparkSession, sf_dir: str) -> DataFrame:
    v, _, _, _ = entities(spark, sf_dir)
    queries = v.filter("vec_id % 100 = 7").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("query_vector"))
    return topk.search_many(v, queries, 3, "vec_id").select("query_id", "rank", "vec_id", r6("distance").alias("distance"))


add("topk_batch_queries", topk_batch_queries, f"""WITH {ENTITIES}, qs AS (SELECT vec_id AS query_id, e AS qe FROM v WHERE vec_id % 100 = 7), d AS (SELECT query_id, vec_id, {DISTANCE['Cos']} AS d FROM v, qs),
w AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY d, vec_id) AS rank FROM d) SELECT query_id, rank, vec_id, round(d, 6) AS distance FROM w WHERE rank <= 3""")

# --- merging -------------------------------------------------------------------------------------------------------
SEARCH = f"""WITH {ENTITIES},
sd AS (SELECT workspace_id, doc_id, split_id, {DISTANCE['Cos']} AS d FROM s, q),
sw AS (SELECT *, row_number() OVER (PARTITION BY workspace_id ORDER BY d, split_id) AS n FROM sd),
sh AS (SELECT * FROM sw WHERE n <= 20 AND {{split}} ORDER BY d, workspace_id, split_id LIMIT 20),
md AS (SELECT workspace_id, doc_id, split_id, summary_id, {DISTANCE['Cos']} AS d FROM m, q),
mw AS (SELECT *, row_number() OVER (PARTITION BY workspace_id ORDER BY d, summary_id) AS n FROM md),
mh AS (SELECT * FROM mw WHERE n <= 20 AND {{summary}} ORDER BY d, workspace_id, summary_id LIMIT 20),
g AS (SELECT workspace_id, doc_id, split_id, min(d) AS derived, count(*) AS n_summaries FROM mh GROUP BY ALL),
j AS (SELECT coalesce(sh.workspace_id, g.workspace_id) AS workspace_id, coalesce(sh.doc_id, g.doc_id) AS doc_id, coalesce(sh.split_id, g.split_id) AS split_id,
  sh.d AS query_distance, coalesce(sh.d, g.derived) AS sort_distance, coalesce(g.n_summaries, 0) AS n_summaries FROM sh FULL JOIN g ON sh.split_id = g.split_id),
k AS (SELECT *, min(sort_distance) OVER (PARTITION BY doc_id) AS doc_distance, row_number() OVER (PARTITION BY doc_id ORDER BY sort_distance, split_id) AS split_rank FROM j)
"""


def _search(mode: int) -> Query:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        _, s, m, q = entities(spark, sf_dir)
        ranked, _ = ranked_splits(s, m, q, k=20, mode=mode)
        return ranked.select("workspace_id", "doc_id", "split_id", r6("query_distance").alias("query_distance"), r6("sort_distance").alias("sort_distance"), r6("doc_distance").alias("doc_distance"), "split_rank", "doc_rank", "n_summaries")

    return run


for _name, _mode in (("search_split_only", "split"), ("search_summary_only", "summary"), ("search_split_and_summary", "both")):
    _sql = SEARCH.format(split=str(_mode != "summary").lower(), summary=str(_mode != "split").lower())
    add(_name, _search(SEARCH_MODE[_mode]), _sql + """SELECT workspace_id, doc_id, split_id, round(query_distance, 6) AS query_distance, round(sort_distance, 6) AS sort_distance, round(doc_distance, 6) AS doc_distance,
split_rank, dense_rank() OVER (ORDER BY doc_distance, workspace_id, doc_id) AS doc_rank, n_summaries FROM k""")
_BOTH = SEARCH.format(split="true", summary="true")


def summary_min_per_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    _, _, m, q = entities(spark, sf_dir)
    hits = topk.search(m, q, 20, "summary_id")
    return merge.summary_minimum(hits).select("split_id", r6("derived_distance").alias("distance"), "n_summaries")


add("summary_min_per_split", summary_min_per_split, _BOTH + "SELECT split_id, round(derived, 6) AS distance, n_summaries FROM g")


def direct_overrides_derived(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Splits hit both ways where the direct distance is the larger one and still counts."""
    _, s, m, q = entities(spark, sf_dir)
    split_hits, summary_hits = topk.scored(s, q, "Cos"), topk.scored(m, q, "Cos")
    both = merge.merge_hits(split_hits, summary_hits).join(merge.summary_minimum(summary_hits).select("split_id", "derived_distance"), "split_id")
    return both.filter("query_distance > derived_distance").select("split_id", r6("sort_distance").alias("sort_distance"), r6("derived_distance").alias("derived_distance"))


add("direct_overrides_derived", direct_overrides_derived, f"""WITH {ENTITIES}, sd AS (SELECT split_id, {DISTANCE['Cos']} AS d FROM s, q), md AS (SELECT split_id, min({DISTANCE['Cos']}) AS d FROM m, q GROUP BY 1)
SELECT sd.split_id, round(sd.d, 6) AS sort_distance, round(md.d, 6) AS derived_distance FROM sd JOIN md USING (split_id) WHERE sd.d > md.d""")


def documents_by_best_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    _, s, m, q = entities(spark, sf_dir)
    merged = merge.merge_hits(topk.search(s, q, 20, "split_id"), topk.search(m, q, 20, "summary_id"))
    return merge.documents_by_best_split(merged).select("rank", "workspace_id", "doc_id", r6("distance").alias("distance"), "n_splits")


add("documents_by_best_split", documents_by_best_split, _BOTH + """, b AS (SELECT workspace_id, doc_id, min(sort_distance) AS d, count(*) AS n_splits FROM j GROUP BY ALL)
SELECT row_number() OVER (ORDER BY d, workspace_id, doc_id) AS rank, workspace_id, doc_id, round(d, 6) AS distance, n_splits FROM b""")


def _texts(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """Entities with the other columns of stored ones, and documents."""
    v, s, m, q = entities(spark, sf_dir)
    s = s.withColumns({"seq_id": ((F.col("split_id") % 10) / 2).cast("int"), "text": F.concat(F.lit("split "), "split_id"), "token_len": F.lit(2).cast("long")})
    m = m.withColumns({"split_seq_id": ((F.col("split_id") % 10) / 2).cast("int"), "text": F.concat(F.lit("summary "), "summary_id"), "centrality": F.lit(0.5)})
    docs = v.groupBy("workspace_id", "doc_id").agg(F.min("vec_id").alias("first")).select("workspace_id", "doc_id", F.concat(F.lit("bench://doc/"), "doc_id").alias("url"))
    return docs, s, m, q


def search_documents_nested(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, s, m, q = _texts(spark, sf_dir)
    return search_documents(docs, s, m, q, k=20)


add("search_documents_nested", search_documents_nested)


def search_documents_flat(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The nested result, a row for each split: its summaries that were hit, and how many the document has in all."""
    d = search_documents_nested(spark, sf_dir).withColumn("s", F.explode("splits"))
    hit = F.col("s.summaries")
    return d.select(
        "workspace_id", "doc_id", "url", "doc_rank", "s.split_rank", "s.split_id", F.col("s.seq_id").cast("long").alias("seq_id"), "s.text", r6("s.query_distance").alias("query_distance"),
        F.size(hit).cast("long").alias("n_hits"), F.try_element_at(hit, F.lit(1))["summary_id"].alias("first_hit"), F.size("summaries").cast("long").alias("n_all"),
    )


add("search_documents_flat", search_documents_flat, _BOTH + """, t AS (SELECT split_id, arg_min(summary_id, d) AS first_hit FROM mh GROUP BY 1), a AS (SELECT doc_id, count(*) AS n_all FROM m GROUP BY 1)
SELECT k.workspace_id, k.doc_id, 'bench://doc/' || k.doc_id AS url, dense_rank() OVER (ORDER BY doc_distance, k.workspace_id, k.doc_id) AS doc_rank, split_rank, k.split_id, (k.split_id % 10) // 2 AS seq_id, 'split ' || k.split_id AS text,
round(query_distance, 6) AS query_distance, n_summaries AS n_hits, first_hit, n_all FROM k JOIN a ON a.doc_id = k.doc_id LEFT JOIN t ON t.split_id = k.split_id""")


def get_document_flat(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's splits in recorded order with their number of summaries."""
    docs, s, m, _ = _texts(spark, sf_dir)
    count = m.groupBy("split_id").agg(F.count("*").alias("n_summaries"))
    rows = docs.join(s, ["workspace_id", "doc_id"]).join(count, "split_id", "left")
    return rows.select("doc_id", "url", F.col("seq_id").cast("long").alias("seq_id"), "split_id", F.coalesce("n_summaries", F.lit(0)).alias("n_summaries"))


add("get_document_flat", get_document_flat, f"""WITH {ENTITIES} SELECT s.doc_id, 'bench://doc/' || s.doc_id AS url, (s.split_id % 10) // 2 AS seq_id, s.split_id, count(m.summary_id) AS n_summaries
FROM s LEFT JOIN m USING (split_id) GROUP BY ALL""")

# --- ranking -------------------------------------------------------------------------------------------------------
_SCORE = "CASE WHEN event_id % 7 = 0 THEN CAST('NaN' AS DOUBLE) ELSE value END"


def _scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events")
    return e.select(F.col("event_id").alias("index"), "user_id", "event_type", F.when(F.col("event_id") % 7 == 0, float("nan")).otherwise(F.col("value")).alias("score"))


add("rank_scores_nan_last", lambda spark, sf: rerank.rank_scores(_scores(spark, sf), ["user_id"]).select("index", "user_id", "rank"),
    f"SELECT event_id AS index, user_id, row_number() OVER (PARTITION BY user_id ORDER BY isnan({_SCORE}), {_SCORE} DESC, event_id) - 1 AS rank FROM events")


def rerank_join_drops_unscored(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "events").select(F.col("event_id").alias("index"), "user_id", "value")
    scored = _scores(spark, sf_dir).filter("index % 3 <> 0").drop("event_type")
    ranks = rerank.rank_scores(scored, ["user_id"])
    return rerank.attach(rows, ranks, ["user_id", "index"]).select("index", "user_id", "value", "rank")


add("rerank_join_drops_unscored", rerank_join_drops_unscored, f"SELECT event_id AS index, user_id, value, row_number() OVER (PARTITION BY user_id ORDER BY isnan({_SCORE}), {_SCORE} DESC, event_id) - 1 AS rank FROM events WHERE event_id % 3 <> 0")


def rerank_return_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    ranks = rerank.rank_scores(_scores(spark, sf_dir).select("user_id", "index", "score"), ["user_id"])
    texts = table(spark, sf_dir, "events").select(F.col("event_id").alias("index"), "user_id", F.col("event_type").alias("text"))
    return rerank.return_text(ranks, texts, True, ["user_id", "index"]).select("index", "user_id", "rank", "text")


add("rerank_return_text", rerank_return_text, f"SELECT event_id AS index, user_id, row_number() OVER (PARTITION BY user_id ORDER BY isnan({_SCORE}), {_SCORE} DESC, event_id) - 1 AS rank, event_type AS text FROM events")
add("nan_count", lambda spark, sf: rerank.nan_count(_scores(spark, sf)), f"SELECT count(*) FILTER (isnan({_SCORE})) AS n_nan, count(*) AS n_rows FROM events")

# --- normalising ---------------------------------------------------------------------------------------------------


def _normalized(f: Callable[[Column], Column]) -> Query:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        v = table(spark, sf_dir, "embeddings").select("vec_id", F.posexplode(f(F.col("embedding"))).alias("pos", "x"))
        return v.select("vec_id", F.col("pos").cast("long").alias("pos"), r6("x").alias("x"))

    return run


_FLAT = "WITH v AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS e FROM embeddings), n AS (SELECT vec_id, e, {size} AS size FROM v) SELECT vec_id, CAST(i - 1 AS BIGINT) AS pos, round(e[i] / size, 6) AS x FROM n, range(1, 65) r(i)"
add("l2_normalize", _normalized(vectors.l2_normalize), _FLAT.format(size="sqrt(list_dot_product(e, e))"))
add("normalize_maxabs", _normalized(lambda c: vectors.p_normalize(c, 0)), _FLAT.format(size="list_max(list_transform(e, lambda x: abs(x))) / 32760.0"))
add("normalize_p3", _normalized(lambda c: vectors.p_normalize(c, 3)), _FLAT.format(size="pow(list_sum(list_transform(e, lambda x: pow(abs(x), 3))), 1.0 / 3)"))
add("quantize_f16", _normalized(vectors.to_f16), f"WITH v AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS e FROM embeddings), n AS (SELECT vec_id, {F16} AS e FROM v) SELECT vec_id, CAST(i - 1 AS BIGINT) AS pos, round(e[i], 6) AS x FROM n, range(1, 65) r(i)")

# --- text ----------------------------------------------------------------------------------------------------------
_WORDS = "len(regexp_extract_all({}, '[^ \\t\\n\\r]+'))"
_SENTENCES = f"""WITH c AS (SELECT doc_id, list_transform(regexp_extract_all(text, '[^.!?]*[.!?]|[^.!?]+$'), lambda x: regexp_replace(x, '^[ \\t\\n\\r]+|[ \\t\\n\\r]+$', '', 'g')) AS a FROM documents),
f AS (SELECT doc_id, list_filter(a, lambda x: {_WORDS.format('x')} >= 4) AS a FROM c),
e AS (SELECT doc_id, CAST(i - 1 AS BIGINT) AS pos, a[i] AS sentence FROM f, LATERAL (SELECT unnest(range(1, len(a) + 1)) AS i))"""


def _sentences(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents").select("doc_id", F.posexplode(text.sentences(F.col("text"))).alias("pos", "sentence"))
    return d.select("doc_id", F.col("pos").cast("long").alias("pos"), "sentence")


add("sentences_min4", _sentences, _SENTENCES + " SELECT doc_id, pos, sentence FROM e")
add("sentence_token_counts", lambda spark, sf: _sentences(spark, sf).groupBy("doc_id").agg(F.count("*").alias("n_sentences"), F.sum(text.token_count(F.col("sentence"))).cast("long").alias("n_tokens")),
    _SENTENCES + f" SELECT doc_id, count(*) AS n_sentences, CAST(sum({_WORDS.format('sentence')}) AS BIGINT) AS n_tokens FROM e GROUP BY 1")
add("first_two_sentences", lambda spark, sf: first_sentences(table(spark, sf, "documents"), ["doc_id"]).select("doc_id", F.col("pos").cast("long").alias("pos"), "sentence", "centrality"),
    _SENTENCES + " SELECT doc_id, pos, sentence, CAST(1.0 AS DOUBLE) / (pos + 1) AS centrality FROM e WHERE pos < 2")
add("chunk_paragraph_lines", lambda spark, sf: chunking.chunk_lines(table(spark, sf, "documents"), ["doc_id"], "text", 100), f"""
WITH l AS (SELECT doc_id, i, regexp_replace(string_split(text, chr(10))[i], '^[ \\t\\n\\r]+|[ \\t\\n\\r]+$', '', 'g') AS t FROM documents, LATERAL (SELECT unnest(range(1, len(string_split(text, chr(10))) + 1)) AS i)),
n AS (SELECT doc_id, i, t, {_WORDS.format('t')} AS k FROM l WHERE t <> ''),
c AS (SELECT *, CAST(floor(coalesce(sum(k) OVER (PARTITION BY doc_id ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) / 100.0) AS BIGINT) AS seq_id FROM n)
SELECT doc_id, seq_id, string_agg(t, chr(10) ORDER BY i) AS text, CAST(sum(k) AS BIGINT) AS token_len, count(*) AS n_lines FROM c GROUP BY 1, 2""")
#: Chunks of at most 100 words of the documents in ``d`` (id, text): cut at lines, then at punctuation, then between words, as far as needed, and merged while they fit.
_CHUNKS = f"""RECURSIVE {{d}},
c0 AS (SELECT id, 0 AS a, text AS p FROM d WHERE {_WORDS.format('text')} <= 100 UNION ALL SELECT id, a, x[a] FROM (SELECT id, x, generate_subscripts(x, 1) AS a FROM (SELECT id, regexp_extract_all(text, '[^\\n]*\\n|[^\\n]+') AS x FROM d WHERE {_WORDS.format('text')} > 100))),
c1 AS (SELECT id, a, 0 AS b, p FROM c0 WHERE {_WORDS.format('p')} <= 100 UNION ALL SELECT id, a, b, x[b] FROM (SELECT id, a, x, generate_subscripts(x, 1) AS b FROM (SELECT id, a, regexp_extract_all(p, '(?s).*?(?:\\. |! |\\? |, |; )|(?s).+$') AS x FROM c0 WHERE {_WORDS.format('p')} > 100))),
c2 AS (SELECT id, a, b, 0 AS c, p FROM c1 WHERE {_WORDS.format('p')} <= 100 UNION ALL SELECT id, a, b, c, x[c] FROM (SELECT id, a, b, x, generate_subscripts(x, 1) AS c FROM (SELECT id, a, b, regexp_extract_all(p, '[ \\t\\n\\r]*(?:[^ \\t\\n\\r]+[ \\t\\n\\r]*){{{{1,100}}}}') AS x FROM c1 WHERE {_WORDS.format('p')} > 100))),
c3 AS MATERIALIZED (SELECT id, p, {_WORDS.format('p')} AS size, row_number() OVER (PARTITION BY id ORDER BY a, b, c) AS n FROM c2),
c4 AS (SELECT id, n, size AS total, 0 AS k FROM c3 WHERE n = 1 UNION ALL SELECT c3.id, c3.n, CASE WHEN total + size <= 100 THEN total + size ELSE size END, CASE WHEN total + size <= 100 THEN k ELSE k + 1 END FROM c4 JOIN c3 ON c3.id = c4.id AND c3.n = c4.n + 1),
c5 AS (SELECT c3.id, k, regexp_replace(string_agg(p, '' ORDER BY c3.n), '^[ \\t\\n\\r]+|[ \\t\\n\\r]+$', '', 'g') AS text FROM c3 JOIN c4 ON c3.id = c4.id AND c3.n = c4.n GROUP BY ALL),
chunks AS MATERIALIZED (SELECT id, CAST(row_number() OVER (PARTITION BY id ORDER BY k) - 1 AS INTEGER) AS seq_id, text, CAST({_WORDS.format('text')} AS BIGINT) AS token_len FROM c5 WHERE text <> '')"""
add("chunk_documents", lambda spark, sf: chunking.chunk(table(spark, sf, "documents").select("doc_id", "text"), "text", 100),
    "WITH " + _CHUNKS.format(d="d AS (SELECT doc_id AS id, text FROM documents)") + " SELECT id AS doc_id, seq_id, text, token_len FROM chunks")
_MD5 = "CAST('0x' || substr(md5({}), 1, 15) AS BIGINT)"


def deterministic_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents").select("doc_id", ids.doc_id(F.concat(F.lit("doc://"), F.col("doc_id").cast("string"))).alias("id"))
    d = d.withColumn("split_id", ids.split_id(F.col("id"), F.lit(3)))
    return d.withColumn("summary_id", ids.summary_id(F.col("split_id"), F.lit(1), F.lit(7))).withColumn("model_id", ids.model_id("hashing", 64))


add("deterministic_ids", deterministic_ids, f"""WITH a AS (SELECT doc_id, {_MD5.format("'doc://' || doc_id")} AS id FROM documents), b AS (SELECT *, {_MD5.format("id || '/3'")} AS split_id FROM a)
SELECT *, {_MD5.format("split_id || '/1/7'")} AS summary_id, {_MD5.format("'hashing/64'")} AS model_id FROM b""")


def passages_distinct_min32(spark: SparkSession, sf_dir: str) -> DataFrame:
    return distinct_passages(table(spark, sf_dir, "documents"), "text", "doc_id").select(F.md5("passage").alias("passage"), "first_at", F.octet_length("passage").cast("long").alias("n_bytes"))


add("passages_distinct_min32", passages_distinct_min32, """WITH p AS (SELECT regexp_replace(text, '^[ \\t\\n\\r]+|[ \\t\\n\\r]+$', '', 'g') AS t, doc_id FROM documents)
SELECT md5(t) AS passage, min(doc_id) AS first_at, CAST(octet_length(encode(t)) AS BIGINT) AS n_bytes FROM p WHERE octet_length(encode(t)) >= 32 GROUP BY t""")

# --- centrality ----------------------------------------------------------------------------------------------------
add("lexrank_degree_top2", lambda spark, sf: lexrank.lexrank_degree(entities(spark, sf)[0], ["doc_id"], "vec_id").select("doc_id", "vec_id", r6("centrality").alias("centrality"), "rank"), f"""WITH {ENTITIES},
p AS (SELECT a.doc_id, a.vec_id, sum(CASE WHEN a.vec_id = b.vec_id OR list_dot_product(a.e, b.e) / sqrt(list_dot_product(a.e, a.e) * list_dot_product(b.e, b.e)) >= 0.1 THEN 1.0 ELSE 0.0 END) AS deg FROM v a JOIN v b USING (doc_id) GROUP BY 1, 2),
c AS (SELECT *, CAST(deg AS DOUBLE) / sum(CAST(deg AS DOUBLE)) OVER (PARTITION BY doc_id) AS cen FROM p), w AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY round(cen, 12) DESC, vec_id) AS rank FROM c)
SELECT doc_id, vec_id, round(cen, 6) AS centrality, rank FROM w WHERE rank <= 2""")
#: The matrix multiplied by itself again and again: 65,536 steps.
_SQUARED = ", ".join(f"m{k + 1} AS MATERIALIZED (SELECT a.doc_id, a.i, b.j, sum(a.v * b.v) AS v FROM m{k} a JOIN m{k} b ON a.doc_id = b.doc_id AND a.j = b.i GROUP BY ALL)" for k in range(16))
add("lexrank_power_top2", lambda spark, sf: lexrank.lexrank_power(entities(spark, sf)[0], ["doc_id"], "vec_id").withColumn("centrality", r6("centrality")), f"""WITH {ENTITIES},
c AS (SELECT a.doc_id, a.vec_id AS i, b.vec_id AS j, CASE WHEN a.vec_id = b.vec_id THEN 1.0 ELSE greatest(0, list_dot_product(a.e, b.e) / sqrt(list_dot_product(a.e, a.e) * list_dot_product(b.e, b.e))) END AS s FROM v a JOIN v b USING (doc_id)),
m0 AS MATERIALIZED (SELECT doc_id, i, j, CAST(s AS DOUBLE) / sum(CAST(s AS DOUBLE)) OVER (PARTITION BY doc_id, i) AS v FROM c), {_SQUARED},
p AS (SELECT doc_id, j AS vec_id, avg(v) AS p FROM m16 GROUP BY ALL), w AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY round(p, 9) DESC, vec_id) AS rank FROM p)
SELECT doc_id, vec_id, round(p, 6) AS centrality, rank FROM w WHERE rank <= 2""")

# --- replacing and deleting ----------------------------------------------------------------------------------------
# Every seventh document is replaced by one with only its first two splits and a new one.


def _dml(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    current = entities(spark, sf_dir)[1].select("workspace_id", "doc_id", "split_id", F.lit(1).alias("version"))
    some = current.filter("doc_id % 7 = 0")
    incoming = some.filter("split_id % 10 < 4").withColumn("version", F.lit(2))
    return current, incoming.unionByName(some.filter("split_id % 10 = 0").select("workspace_id", "doc_id", (F.col("split_id") + 1_000_000).alias("split_id"), F.lit(2).alias("version")))


_DML = f"""WITH {ENTITIES}, cur AS (SELECT workspace_id, doc_id, split_id, 1 AS version FROM s),
inc AS (SELECT workspace_id, doc_id, split_id, 2 AS version FROM cur WHERE doc_id % 7 = 0 AND split_id % 10 < 4 UNION ALL SELECT workspace_id, doc_id, split_id + 1000000, 2 FROM cur WHERE doc_id % 7 = 0 AND split_id % 10 = 0)"""
add("upsert_replace", lambda spark, sf: dml.upsert(*_dml(spark, sf)), _DML + " SELECT * FROM cur WHERE doc_id NOT IN (SELECT doc_id FROM inc) UNION ALL SELECT * FROM inc")
add("replaced_set_difference", lambda spark, sf: dml.replaced_ids(*_dml(spark, sf), "split_id"), _DML + " SELECT workspace_id, doc_id, split_id FROM cur WHERE doc_id IN (SELECT doc_id FROM inc) AND split_id NOT IN (SELECT split_id FROM inc)")


def delete_cascade(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What is left of each table after every fourth document is deleted."""
    _, s, m, _ = entities(spark, sf_dir)
    gone = s.filter("doc_id % 4 = 1").select("workspace_id", "doc_id").distinct()
    left = [dml.delete(df, gone).select("doc_id", F.lit(what).alias("what"), F.col(key).alias("entity_id")) for df, what, key in ((s, "split", "split_id"), (m, "summary", "summary_id"))]
    return left[0].unionByName(left[1])


add("delete_cascade", delete_cascade, f"WITH {ENTITIES} SELECT doc_id, 'split' AS what, split_id AS entity_id FROM s WHERE doc_id % 4 <> 1 UNION ALL SELECT doc_id, 'summary', summary_id FROM m WHERE doc_id % 4 <> 1")
add("delete_status", lambda spark, sf: dml.delete_status(entities(spark, sf)[1].select("workspace_id", "doc_id").distinct(), spark.range(0, 100, 7).select((F.col("id") % 3).alias("workspace_id"), F.col("id").alias("doc_id"))),
    f"WITH {ENTITIES} SELECT i % 3 AS workspace_id, i AS doc_id, CASE WHEN i IN (SELECT doc_id FROM s) THEN 'Success' ELSE 'NotFound' END AS status FROM range(0, 100, 7) r(i)")


def distinct_summary_first_wins(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A summary in the document's list (every third) and in its split's is one; the document's list comes first."""
    m = entities(spark, sf_dir)[2]
    rows = m.filter("summary_id % 3 = 0").select("doc_id", "summary_id", F.lit(0).alias("list")).unionByName(m.select("doc_id", "summary_id", F.lit(1).alias("list")))
    return dml.first_by_id(rows, ["summary_id"], F.col("list"), F.col("doc_id"))


add("distinct_summary_first_wins", distinct_summary_first_wins, f"WITH {ENTITIES} SELECT doc_id, summary_id, CASE WHEN summary_id % 3 = 0 THEN 0 ELSE 1 END AS list FROM m")


def _lists(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = entities(spark, sf_dir)[2]
    doc_list = F.array_sort(F.collect_list(F.when(F.col("summary_id") % 3 == 0, F.col("summary_id"))))
    return m.groupBy("doc_id").agg(doc_list.alias("doc_list"), F.array_sort(F.collect_list("summary_id")).alias("all_ids")).withColumn("lists", F.array("all_ids"))


add("extra_summary_ids", lambda spark, sf: _lists(spark, sf).select("doc_id", F.explode(dml.extra_summary_ids(F.col("doc_list"), F.col("lists"))).alias("summary_id")), f"WITH {ENTITIES} SELECT doc_id, summary_id FROM m WHERE summary_id % 3 <> 0")
add("owned_summary_ids", lambda spark, sf: _lists(spark, sf).select("doc_id", F.size(dml.owned_summary_ids(F.col("doc_list"), F.col("lists"))).cast("long").alias("n_owned"), dml.distinct_summaries(F.col("doc_list"), F.col("lists")).alias("n_distinct")),
    f"WITH {ENTITIES} SELECT doc_id, count(*) AS n_owned, count(DISTINCT summary_id) AS n_distinct FROM m GROUP BY 1")


def _validated(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Splits of which some have no vector, a short one or another model's; (all, bad)."""
    s = entities(spark, sf_dir)[1].withColumn("model_id", F.when(F.col("split_id") % 94 == 0, 2).otherwise(1))
    e = F.when(F.col("split_id") % 86 == 0, None).when(F.col("split_id") % 98 == 0, F.slice("embedding", 1, 3)).otherwise(F.col("embedding"))
    s = s.withColumn("embedding", e)
    return s, dml.invalid(s, 64, 1, "split_id")


add("validate_rejects", lambda spark, sf: _validated(spark, sf)[1], f"""WITH {ENTITIES} SELECT workspace_id, doc_id, split_id, CASE WHEN split_id % 86 = 0 THEN 'missing embedding' WHEN split_id % 98 = 0 THEN 'wrong width' ELSE 'other model' END AS reason
FROM s WHERE split_id % 86 = 0 OR split_id % 98 = 0 OR split_id % 94 = 0""")
add("validate_accepts", lambda spark, sf: dml.reject(*_validated(spark, sf))[0].select("doc_id", "split_id"),
    f"WITH {ENTITIES} SELECT doc_id, split_id FROM s WHERE doc_id NOT IN (SELECT doc_id FROM s WHERE split_id % 86 = 0 OR split_id % 98 = 0 OR split_id % 94 = 0)")

# --- change log ----------------------------------------------------------------------------------------------------
# For each document a summary, a split and the commit; every fifth is deleted, every tenth inserted again with other
# entities, every seventh has lost its first commit, and every third ends in a torn insert.


def change_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents").select("doc_id")
    one = lambda at, kind, entity, cond=True: F.when(F.lit(cond) if isinstance(cond, bool) else cond, F.struct(F.lit(at).alias("at"), F.lit(KIND[kind]).alias("kind"), F.lit(entity).alias("entity")))
    i = F.col("doc_id")
    rows = F.array(
        one(1, "summary", 1), one(2, "split", 2), one(3, "doc", 0, i % 7 != 0), one(4, "delete", 0, i % 5 == 0),
        one(5, "split", 5, i % 10 == 0), one(6, "split", 6, i % 10 == 0), one(7, "doc", 0, i % 10 == 0), one(8, "split", 8, i % 3 == 0),
    )
    log = d.select("doc_id", F.explode(F.array_compact(rows)).alias("r"))
    id_ = lambda n: (i * 10 + n).cast("long")
    is_doc = F.col("r.kind") == KIND["doc"]
    splits = F.when(is_doc & (F.col("r.at") == 3), F.array(id_(2))).when(is_doc, F.array(id_(5), id_(6)))
    summaries = F.when(is_doc & (F.col("r.at") == 3), F.array(id_(1))).when(is_doc, F.array().cast("array<bigint>"))
    return log.select("doc_id", id_(F.col("r.at")).alias("seq"), F.col("r.kind").alias("kind"), id_(F.col("r.entity")).alias("entity_id"), splits.alias("split_ids"), summaries.alias("summary_ids"))


_LOG = """WITH k AS (SELECT doc_id AS i FROM documents), live AS (SELECT i, CASE WHEN i % 10 = 0 THEN 2 WHEN i % 5 = 0 OR i % 7 = 0 THEN 0 ELSE 1 END AS v FROM k),
r AS (SELECT i AS doc_id, i * 10 + n AS seq, kind, i * 10 + entity AS entity_id FROM live JOIN (VALUES (1, 1, 3, 1), (1, 2, 2, 2), (1, 3, 1, 0), (2, 5, 2, 5), (2, 6, 2, 6), (2, 7, 1, 0)) t(tv, n, kind, entity) ON v = tv)"""
_LIVE = ("doc_id", "seq", "kind", "entity_id")
add("log_replay_current", lambda spark, sf: replay.committed(change_log(spark, sf)).select(*_LIVE), _LOG + " SELECT doc_id, seq, kind, entity_id FROM r")
add("log_replay_torn", lambda spark, sf: replay.committed(change_log(spark, sf).filter("kind <> 1 or seq % 10 <> 7 or doc_id % 20 <> 0")).select(*_LIVE), _LOG + " SELECT doc_id, seq, kind, entity_id FROM r WHERE doc_id % 20 <> 0")
add("snapshot_plus_tail", lambda spark, sf: replay.snapshot_and_tail(change_log(spark, sf), 2_010).select(*_LIVE), _LOG + " SELECT doc_id, seq, kind, entity_id FROM r")
add("log_sequence_range", lambda spark, sf: replay.sequence_range(change_log(spark, sf).withColumn("segment", F.floor(F.col("seq") / 1000).cast("long"))), """WITH k AS (SELECT doc_id AS i FROM documents),
r AS (SELECT i * 10 + n AS seq FROM k, (VALUES (1), (2), (3), (4), (5), (6), (7), (8)) t(n) WHERE n <= 2 OR (n = 3 AND i % 7 <> 0) OR (n = 4 AND i % 5 = 0) OR (n BETWEEN 5 AND 7 AND i % 10 = 0) OR (n = 8 AND i % 3 = 0))
SELECT seq // 1000 AS segment, min(seq) AS min_seq, max(seq) AS max_seq FROM r GROUP BY 1""")

# --- figures -------------------------------------------------------------------------------------------------------


def shard_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, s, m, _ = _texts(spark, sf_dir)
    return stats.shard_stats(docs, s, m)


add("shard_stats", shard_stats, f"WITH {ENTITIES} SELECT workspace_id, count(DISTINCT doc_id) AS n_docs, count(*) FILTER (vec_id % 2 = 0) AS n_splits, count(*) FILTER (vec_id % 2 = 1) AS n_summaries FROM v GROUP BY 1")


add("pool_stats", lambda spark, sf: stats.pool_stats(shard_stats(spark, sf)), f"WITH {ENTITIES} SELECT count(DISTINCT workspace_id) AS n_workspaces, count(DISTINCT doc_id) AS n_docs, count(*) FILTER (vec_id % 2 = 0) AS n_splits, count(*) FILTER (vec_id % 2 = 1) AS n_summaries FROM v")


def log_torn_tail(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The log in segments of 1,000 numbers; in the last one a record in the middle is damaged, and the rest of it is cut."""
    log = change_log(spark, sf_dir).withColumn("segment", F.floor(F.col("seq") / 1000).cast("long"))
    log = log.withColumn("crc", replay.checksum(log.columns))
    last = log.agg(F.max("segment"), F.max("seq")).first()
    log = log.withColumn("crc", F.when((F.col("segment") == last[0]) & (F.col("seq") % 100 == 42), F.col("crc") + 1).otherwise(F.col("crc")))
    return replay.verified(log, last[0]).groupBy("segment").agg(F.count("*").alias("n_rows"), F.max("seq").alias("max_seq"))


add("log_torn_tail", log_torn_tail, """WITH k AS (SELECT doc_id AS i FROM documents),
r AS (SELECT i * 10 + n AS seq FROM k, (VALUES (1), (2), (3), (4), (5), (6), (7), (8)) t(n) WHERE n <= 2 OR (n = 3 AND i % 7 <> 0) OR (n = 4 AND i % 5 = 0) OR (n BETWEEN 5 AND 7 AND i % 10 = 0) OR (n = 8 AND i % 3 = 0)),
s AS (SELECT seq, seq // 1000 AS segment, max(seq // 1000) OVER () AS active FROM r), b AS (SELECT *, min(CASE WHEN segment = active AND seq % 100 = 42 THEN seq END) OVER (PARTITION BY segment) AS bad FROM s)
SELECT segment, count(*) AS n_rows, max(seq) AS max_seq FROM b WHERE bad IS NULL OR seq < bad GROUP BY 1""")


def dead_ratio(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents").select(F.col("source").alias("workspace_id"), F.col("n_chars").alias("bytes"), F.when(F.col("doc_id") % 3 == 0, F.col("n_chars")).otherwise(0).alias("dead_bytes"))
    return stats.needs_compaction(d, 0.3).withColumn("dead_ratio", r6("dead_ratio"))


add("dead_ratio", dead_ratio, """WITH a AS (SELECT source AS workspace_id, CAST(sum(n_chars) AS BIGINT) AS sealed_bytes, CAST(sum(CASE WHEN doc_id % 3 = 0 THEN n_chars ELSE 0 END) AS BIGINT) AS dead_bytes FROM documents GROUP BY 1)
SELECT *, round(CASE WHEN sealed_bytes = 0 THEN 0 ELSE CAST(dead_bytes AS DOUBLE) / sealed_bytes END, 6) AS dead_ratio, sealed_bytes > 0 AND CAST(dead_bytes AS DOUBLE) / sealed_bytes > 0.3 AS needs_compaction FROM a""")
add("workspace_rollup", lambda spark, sf: stats.totals(table(spark, sf, "documents").select(F.col("source").alias("workspace_id"), F.lit(1).alias("n_docs"), "n_chars"), "n_docs", "n_chars"),
    "SELECT source AS workspace_id, CAST(count(*) AS BIGINT) AS n_docs, CAST(sum(n_chars) AS BIGINT) AS n_chars FROM documents GROUP BY ROLLUP (source)")


def _filter_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row a vector as older layouts have them: every tenth document is in two workspaces, every thirteenth in none."""
    v = entities(spark, sf_dir)[0].filter("doc_id % 13 <> 0").select("workspace_id", "doc_id", "vec_id")
    return v.unionByName(v.filter("doc_id % 10 = 0").withColumn("workspace_id", (F.col("workspace_id") + 1) % 3))


_ROWS = f"WITH {ENTITIES}, b AS (SELECT workspace_id, doc_id, vec_id FROM v WHERE doc_id % 13 <> 0), f AS (SELECT * FROM b UNION ALL SELECT (workspace_id + 1) % 3, doc_id, vec_id FROM b WHERE doc_id % 10 = 0)"
add("docs_per_workspace", lambda spark, sf: stats.docs_per_workspace(_filter_rows(spark, sf)), _ROWS + " SELECT workspace_id, count(DISTINCT doc_id) AS n_docs, min(doc_id) AS first_doc, max(doc_id) AS last_doc FROM f GROUP BY 1")
add("shared_documents", lambda spark, sf: stats.shared_documents(_filter_rows(spark, sf)), _ROWS + " SELECT doc_id, count(DISTINCT workspace_id) AS n_workspaces FROM f GROUP BY 1 HAVING count(DISTINCT workspace_id) > 1")
add("orphan_documents", lambda spark, sf: stats.orphan_documents(entities(spark, sf)[0].select("doc_id").distinct(), _filter_rows(spark, sf)), _ROWS + " SELECT DISTINCT doc_id FROM v WHERE doc_id NOT IN (SELECT doc_id FROM f)")
add("distinct_documents", lambda spark, sf: stats.distinct_documents(_filter_rows(spark, sf)), _ROWS + " SELECT count(DISTINCT doc_id) AS n_docs, count(*) AS n_rows FROM f")
add("list_workspaces", lambda spark, sf: _filter_rows(spark, sf).select("workspace_id").distinct(), _ROWS + " SELECT DISTINCT workspace_id FROM f")
add("latency_percentiles", lambda spark, sf: stats.latency(table(spark, sf, "events"), "value", ["event_type"]).withColumn("mean", r6("mean")), """WITH w AS (SELECT event_type, value, row_number() OVER (PARTITION BY event_type ORDER BY value) - 1 AS place, count(*) OVER (PARTITION BY event_type) AS n FROM events)
SELECT event_type, max(CASE WHEN place = CAST(floor(0.50 * (n - 1) + 0.5) AS BIGINT) THEN value END) AS p50, max(CASE WHEN place = CAST(floor(0.99 * (n - 1) + 0.5) AS BIGINT) THEN value END) AS p99, round(avg(value), 6) AS mean, max(n) AS n FROM w GROUP BY 1""")


def lookup_by_url(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "pages").filter(F.col("url").contains("example.org/en/")).select("page_id", "url", ids.doc_id(F.col("url")).alias("doc_id"))


add("lookup_by_url", lookup_by_url, f"SELECT page_id, url, {_MD5.format('url')} AS doc_id FROM pages WHERE contains(url, 'example.org/en/')")


def get_in_requested_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Splits by a list of ids, in its order; ids that aren't there are skipped."""
    _, s, _, _ = entities(spark, sf_dir)
    wanted = spark.range(1).select(F.posexplode(F.sequence(F.lit(300).cast("long"), F.lit(-1).cast("long"), F.lit(-7).cast("long"))).alias("pos", "split_id"))
    return dml.in_requested_order(s, wanted, ["split_id"], "pos").select(F.col("pos").cast("long").alias("pos"), "split_id", "doc_id")


add("get_in_requested_order", get_in_requested_order, f"WITH {ENTITIES}, w AS (SELECT CAST(row_number() OVER (ORDER BY i DESC) - 1 AS BIGINT) AS pos, i FROM (SELECT 300 - 7 * n FROM range(0, 44) t(n)) r(i)) SELECT pos, split_id, doc_id FROM w JOIN s ON s.split_id = w.i")
add("sentence_window_ranks", lambda spark, sf: _sentences(spark, sf).withColumn("words", text.token_count(F.col("sentence"))).withColumn("rank", F.row_number().over(Window.partitionBy("doc_id").orderBy(F.col("words").desc(), "pos")).cast("long")).filter("rank <= 2").select("doc_id", "pos", "words", "rank"),
    _SENTENCES + f", w AS (SELECT doc_id, pos, CAST({_WORDS.format('sentence')} AS BIGINT) AS words FROM e), x AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY words DESC, pos) AS rank FROM w) SELECT * FROM x WHERE rank <= 2")

# --- whole paths through the engine --------------------------------------------------------------------------------


def _config() -> EngineConfig:
    return EngineConfig(index=IndexConfig(dimensions=64, metric_kind="Cos"), splitter=SplitterConfig(max_tokens=100))


def _incoming(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents")
    return d.select(F.col("lang").alias("workspace_id"), F.concat(F.lit("doc://"), F.col("doc_id").cast("string")).alias("url"), "text")


def ingest_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Splits of all documents with vectors and summaries."""
    return process_documents(_incoming(spark, sf_dir), _config(), HashingEmbedder(64)).splits.select("workspace_id", "doc_id", "split_id", "seq_id", "token_len", F.size("summary_ids").alias("n_summaries"), F.size("embedding").alias("width"))


_LETTER = "regexp_matches({}, '[\\p{{L}}\\p{{N}}_]')"
#: Splits that have a vector, which takes a word character, with those of their sentences that can be summaries.
_SPLITS = "WITH " + _CHUNKS.format(d="d AS (SELECT lang || ' doc://' || doc_id AS id, text FROM documents)") + f""",
u AS (SELECT split_part(id, ' ', 1) AS workspace_id, {_MD5.format("split_part(id, ' ', 2)")} AS doc_id, seq_id, text, token_len FROM chunks WHERE {_LETTER.format('text')}),
sp AS MATERIALIZED (SELECT *, {_MD5.format("doc_id || '/' || seq_id")} AS split_id, list_filter(list_transform(regexp_extract_all(text, '[^.!?]*[.!?]|[^.!?]+$'), lambda x: regexp_replace(x, '^[ \\t\\n\\r]+|[ \\t\\n\\r]+$', '', 'g')), lambda x: {_WORDS.format('x')} >= 4 AND {_LETTER.format('x')}) AS sentences FROM u)"""
add("ingest_documents", ingest_documents, _SPLITS + " SELECT workspace_id, doc_id, split_id, seq_id, token_len, CAST(least(2, len(sentences)) AS INTEGER) AS n_summaries, 64 AS width FROM sp")


def ingest_summaries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The extractive summaries of all documents."""
    return process_documents(_incoming(spark, sf_dir), _config(), HashingEmbedder(64)).summaries.drop("embedding")


add("ingest_summaries", ingest_summaries)


def engine_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Store all documents and ask for the text of one, with reranking."""
    engine = Engine(spark, shared_folder(spark), _config(), HashingEmbedder(64), OverlapReranker())
    engine.insert(_incoming(spark, sf_dir))
    query = table(spark, sf_dir, "benchmark").orderBy("item_id").select("text").first()[0]
    return engine.query(query, workspaces=["en", "de", "fr", "es"], top_k=10, rerank=True)


add("engine_query", engine_query)


def engine_lifecycle(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Insert all documents, replace some, delete some, compact; what is left by workspace."""
    engine = Engine(spark, shared_folder(spark), _config(), HashingEmbedder(64))
    docs = _incoming(spark, sf_dir)
    engine.insert(docs)
    engine.insert(docs.filter("url like '%7'").withColumn("text", F.lit("One sentence of five words.")))
    engine.store.delete(engine.store.table("docs").filter("url like '%3'").select("workspace_id", "doc_id"))
    engine.maintain()
    return engine.store.table("docs").groupBy("workspace_id").agg(F.count("*").alias("n_docs"), F.count_if(F.col("url").endswith("7")).alias("n_replaced"))


# a document has splits, and so is stored, if it holds a word that the model can embed
add("engine_lifecycle", engine_lifecycle, """SELECT lang AS workspace_id, count(*) AS n_docs, count(*) FILTER (doc_id % 10 = 7) AS n_replaced FROM documents
WHERE doc_id % 10 <> 3 AND (doc_id % 10 = 7 OR regexp_matches(text, '[\\p{L}\\p{N}_]')) GROUP BY 1""")


def rerank_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Benchmark texts ranked against the first of them by a model."""
    b = table(spark, sf_dir, "benchmark")
    query = b.orderBy("item_id").select("text").first()[0]
    engine_free = b.select(F.col("item_id").alias("index"), "text")
    scored = engine_free.withColumn("score", score_column(query, F.col("text"), OverlapReranker())).filter("score is not null")
    return rerank.return_text(rerank.rank_scores(scored.select("index", "score")), engine_free)


_TOKENS = "regexp_extract_all(lower({}), '[\\p{{L}}\\p{{N}}_]+')"
add("rerank_texts", rerank_texts, f"""WITH q AS (SELECT {_TOKENS.format("(SELECT text FROM benchmark ORDER BY item_id LIMIT 1)")} AS q), t AS (SELECT item_id, text, {_TOKENS.format("text")} AS w, q FROM benchmark, q),
s AS (SELECT item_id, text, CAST(len(list_distinct(list_intersect(q, w))) AS DOUBLE) / len(list_distinct(q)) AS score FROM t WHERE len(w) > 0 AND len(q) + len(w) + 4 <= 512)
SELECT item_id AS index, score, row_number() OVER (ORDER BY score DESC, item_id) - 1 AS rank, text FROM s""")


def _legacy(spark: SparkSession, sf_dir: str) -> legacy.Legacy:
    v, s, m, _ = entities(spark, sf_dir)
    lists = v.groupBy("doc_id").agg(F.array_sort(F.collect_list(F.when(F.col("vec_id") % 2 == 0, F.col("vec_id")))).alias("split_ids"), F.array_sort(F.collect_list(F.when(F.col("vec_id") % 2 == 1, F.col("vec_id")))).alias("summary_ids"))
    docs = lists.select("doc_id", F.concat(F.lit("bench://doc/"), "doc_id").alias("url"), "split_ids", "summary_ids")
    vecs = v.filter("vec_id % 83 <> 5").select(F.col("vec_id").alias("embedding_id"), "embedding", F.lit(1).cast("long").alias("model_id"))
    rows = _filter_rows(spark, sf_dir).select(F.col("vec_id").alias("embed_id"), "doc_id", F.col("workspace_id").cast("string").alias("user_uuid"))
    return legacy.Legacy(docs, s.select("split_id", "doc_id"), m.select("summary_id", "doc_id"), vecs, rows)


_FAILED = _ROWS + ", bad AS (SELECT DISTINCT doc_id FROM v WHERE vec_id % 83 = 5)"
add("legacy_migration", lambda spark, sf: legacy.migrate(_legacy(spark, sf), 64, 1).docs.select("workspace_id", "doc_id", "url", F.size("split_ids").cast("long").alias("n_splits")),
    _FAILED + " SELECT DISTINCT CAST(workspace_id AS VARCHAR) AS workspace_id, f.doc_id, 'bench://doc/' || f.doc_id AS url, (SELECT count(*) FROM s WHERE s.doc_id = f.doc_id) AS n_splits FROM f WHERE f.doc_id NOT IN (SELECT doc_id FROM bad)")
add("legacy_report", lambda spark, sf: legacy.migrate(_legacy(spark, sf), 64, 1).report.select("workspace_id", "n_read", "n_written"),
    _FAILED + ", d AS (SELECT DISTINCT CAST(workspace_id AS VARCHAR) AS workspace_id, doc_id FROM f) SELECT workspace_id, count(*) AS n_read, CAST(sum(CASE WHEN doc_id IN (SELECT doc_id FROM bad) THEN 0 ELSE 1 END) AS BIGINT) AS n_written FROM d GROUP BY ROLLUP (workspace_id)")
add("candidate_count", lambda spark, sf: topk.restrict(entities(spark, sf)[1], doc_ids=FILTERED).groupBy("workspace_id").agg(F.count("*").alias("n_candidates")),
    f"WITH {ENTITIES} SELECT workspace_id, count(*) AS n_candidates FROM s WHERE doc_id IN ({', '.join(map(str, FILTERED))}) GROUP BY 1")


def stream_log_replay(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The change log as a stream, replayed with state by document: the live version of each document."""
    folder = shared_folder(spark)
    log = change_log(spark, sf_dir)
    log.repartition("doc_id").sortWithinPartitions("doc_id", "seq").write.parquet(f"{folder}/log")
    changes = replay_stream(spark.readStream.schema(log.schema).parquet(f"{folder}/log"))
    changes.writeStream.format("parquet").option("path", f"{folder}/out").option("checkpointLocation", f"{folder}/state").trigger(availableNow=True).start().awaitTermination()
    last = spark.read.schema(changes.schema).parquet(f"{folder}/out").groupBy("doc_id").agg(F.max(F.struct("seq", "deleted", "n_splits", "n_summaries")).alias("last"))
    return last.filter(~F.col("last.deleted")).select("doc_id", "last.seq", "last.n_splits", "last.n_summaries")


add("stream_log_replay", stream_log_replay, _LOG + " SELECT doc_id, max(seq) AS seq, count(*) FILTER (kind = 2) AS n_splits, count(*) FILTER (kind = 3) AS n_summaries FROM r GROUP BY 1")
