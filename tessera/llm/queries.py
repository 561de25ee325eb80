"""One thin query for each operator, over its whole table with production parameters."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


#: Rows that a Python worker gets at once. Texts and pages are long, so the usual ten thousand are too many.
BATCH_ROWS = 2000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(key)) <= BATCH_ROWS:
        spark.conf.set(key, str(BATCH_ROWS))
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def query(f: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    QUERIES[f.__name__] = f
    return f


def tokenizer_file(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


@query
def op8_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tessera.llm.packing import pack

    return pack(table(spark, sf_dir, "documents"), tokenizer_file("word_bpe_49k.json"))


@query
def op4_nearest_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tessera.llm.ann import search

    rows = table(spark, sf_dir, "embeddings")
    return search(rows, rows.filter("vec_id % 50 = 0"))


@query
def op6_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tessera.llm.embedding_dedup import near_duplicates

    return near_duplicates(table(spark, sf_dir, "embeddings"))


#: The rules of the url filter: verdict, host, path.
URL_RULES = (("block", "net", "/"), ("allow", "example.net", "/en/"), ("block", "example.com", "/de/"), ("allow", "org", "/fr/"))


@query
def op3_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tessera.llm.link_graph import judge

    return judge(table(spark, sf_dir, "pages"), URL_RULES).drop("trust", "distrust")


@query
def op7_archives(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tessera.llm.archives import round_trip
    from tessera.llm.common import scratch

    return round_trip(table(spark, sf_dir, "pages"), scratch(spark))


ORACLES["op7_archives"] = """
SELECT page_id, CAST(octet_length(encode(coalesce(html, ''))) AS BIGINT) AS payload_bytes, sha256(coalesce(html, '')) AS payload_digest,
  CASE WHEN octet_length(encode(coalesce(html, ''))) >= 100 AND page_id > min(page_id) OVER (PARTITION BY coalesce(html, '')) THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN octet_length(encode(coalesce(html, ''))) >= 100 AND page_id > min(page_id) OVER (PARTITION BY coalesce(html, '')) THEN min(page_id) OVER (PARTITION BY coalesce(html, '')) END AS refers_to
FROM pages
"""


@query
def op5_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tessera.llm.jaccard_join import join

    return join(table(spark, sf_dir, "documents"))


@query
def op1_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tessera.llm.lm_scoring import score

    return score(table(spark, sf_dir, "documents"))


@query
def op2_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tessera.llm.suffix_dedup import remove_repeats

    return remove_repeats(table(spark, sf_dir, "documents"), words=51, remove_words=False).drop("kept")


@query
def op10_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tessera.llm.quality import resample

    return resample(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


@query
def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


@query
def op9_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tessera.llm.piece_fst import encode

    return encode(table(spark, sf_dir, "documents"), tokenizer_file("piece_bpe_32k.model"))


# --- SQL twins -----------------------------------------------------------------------------------------------------
_LOWER = "translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_HOST = _LOWER.format("regexp_extract({}, '(?s)^.*?://([^/?#]*)', 1)")
_HREF = r"""(?i)\bhref\s*=\s*["'']?((?:[a-z][a-z0-9+.-]*:)?//[^\s"''<>]+)"""


def _url_filter_sql(rounds: int = 8) -> str:
    """The rules and the propagation, its rounds written out."""
    rules = sorted(URL_RULES, key=lambda r: -len(r[1] + r[2]))
    fits = lambda host, path: f"(host = '{host}' OR ends_with(host, '.{host}')) AND starts_with(path, '{path}')"
    case = lambda pick: "CASE " + " ".join(f"WHEN {fits(h, p)} THEN '{pick(v, h, p)}'" for v, h, p in rules) + " END"

    def walk(name: str, seed: str, src: str, dst: str) -> str:
        weight = f"{name}_w AS MATERIALIZED (SELECT {src} AS src, {dst} AS dst, CAST(n AS DOUBLE) / sum(n) OVER (PARTITION BY {src}) AS weight FROM e)"
        steps = [weight, f"{name}0 AS (SELECT host, {seed} AS score FROM hosts)"]
        for k in range(rounds):
            sent = f"SELECT dst, sum(score * weight) AS received FROM {name}_w JOIN {name}{k} ON src = host GROUP BY dst"
            steps.append(f"{name}{k + 1} AS MATERIALIZED (SELECT host, CAST(0.15000000000000002 AS DOUBLE) * {seed} + CAST(0.85 AS DOUBLE) * coalesce(received, 0) AS score FROM hosts LEFT JOIN ({sent}) ON host = dst)")
        return ", ".join(steps)

    return f"""WITH b AS MATERIALIZED (SELECT page_id, html, coalesce({_HOST.format('url')}, '') AS host, coalesce(regexp_extract(url, '(?s)^.*?://[^/?#]*([^?#]*)', 1), '') AS path FROM pages),
j AS MATERIALIZED (SELECT *, {case(lambda v, h, p: h + p)} AS rule, {case(lambda v, h, p: v)} AS ruled FROM b),
links AS (SELECT host AS src, unnest(regexp_extract_all(html, '{_HREF}', 1)) AS link FROM j),
e AS MATERIALIZED (SELECT src, dst, count(*) AS n FROM (SELECT src, {_HOST.format("CASE WHEN starts_with(link, '//') THEN 'http:' || link ELSE link END")} AS dst FROM links) WHERE src <> '' AND dst <> '' AND src <> dst GROUP BY 1, 2),
hosts AS MATERIALIZED (SELECT host, max(trusted) AS trusted, max(blocked) AS blocked FROM (SELECT host, avg(CASE WHEN ruled = 'allow' THEN 1.0 ELSE 0.0 END) AS trusted, avg(CASE WHEN ruled = 'block' THEN 1.0 ELSE 0.0 END) AS blocked FROM j GROUP BY 1 UNION ALL SELECT dst, 0, 0 FROM e) GROUP BY 1),
{walk('t', 'trusted', 'src', 'dst')}, {walk('d', 'blocked', 'dst', 'src')}
SELECT page_id, j.host, path, rule, coalesce(ruled, CASE WHEN (d{rounds}.score - t{rounds}.score) / CAST(0.15000000000000002 AS DOUBLE) > 0.5 THEN 'block' ELSE 'allow' END) AS verdict
FROM j JOIN t{rounds} ON j.host = t{rounds}.host JOIN d{rounds} ON j.host = d{rounds}.host"""


ORACLES["op3_url_filter"] = _url_filter_sql()

ORACLES["op5_jaccard_join"] = f"""WITH RECURSIVE w AS MATERIALIZED (SELECT doc_id, regexp_extract_all({_LOWER.format("coalesce(text, '')")}, '[^\\x20\\x09-\\x0D]+') AS a FROM documents),
s AS MATERIALIZED (SELECT doc_id, list_distinct(CASE WHEN len(a) = 0 THEN [] WHEN len(a) < 5 THEN [array_to_string(a, ' ')] ELSE list_transform(range(1, len(a) - 3), lambda i: array_to_string(a[i:i + 4], ' ')) END) AS g FROM w),
h AS MATERIALIZED (SELECT doc_id, len(g) AS size, CASE WHEN len(g) > 0 THEN md5(array_to_string(list_sort(g), chr(10))) END AS k FROM s),
c AS MATERIALIZED (SELECT k, size, min(doc_id) AS rep, count(*) AS n FROM h WHERE k IS NOT NULL GROUP BY 1, 2),
x AS MATERIALIZED (SELECT rep, unnest(g) AS t FROM c JOIN s ON rep = doc_id),
p AS MATERIALIZED (SELECT a.rep AS a, b.rep AS b, count(*) AS shared FROM x a JOIN x b ON a.t = b.t AND a.rep <> b.rep GROUP BY 1, 2),
l AS MATERIALIZED (SELECT a, b, cb.n FROM p JOIN c ca ON a = ca.rep JOIN c cb ON b = cb.rep WHERE shared >= 0.8 * (ca.size + cb.size - shared) - 1e-9),
r AS (SELECT DISTINCT a AS node, a AS reach FROM l UNION SELECT r.node, l.b FROM r JOIN l ON r.reach = l.a),
m AS (SELECT node, min(reach) AS low FROM r GROUP BY 1), d AS (SELECT a, CAST(sum(n) AS BIGINT) AS more FROM l GROUP BY 1)
SELECT h.doc_id, coalesce(c.rep, h.doc_id) AS set_id, coalesce(m.low, c.rep, h.doc_id) AS class_id, CAST(coalesce(c.n - 1, 0) + coalesce(d.more, 0) AS BIGINT) AS n_links
FROM h LEFT JOIN c ON h.k = c.k AND h.size = c.size LEFT JOIN m ON m.node = c.rep LEFT JOIN d ON d.a = c.rep"""

ORACLES["op6_embedding_dedup"] = """WITH RECURSIVE v AS MATERIALIZED (SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS e FROM embeddings),
u AS MATERIALIZED (SELECT *, list_dot_product(e, e) AS size FROM v WHERE label IS NOT NULL AND list_dot_product(e, e) > 0 AND isfinite(list_dot_product(e, e))),
l AS MATERIALIZED (SELECT a.vec_id AS a, b.vec_id AS b FROM u a JOIN u b ON a.label = b.label AND a.vec_id <> b.vec_id WHERE list_dot_product(a.e, b.e) / sqrt(a.size * b.size) >= 0.98),
r AS (SELECT DISTINCT a AS node, a AS reach FROM l UNION SELECT r.node, l.b FROM r JOIN l ON r.reach = l.a), m AS (SELECT node, min(reach) AS low FROM r GROUP BY 1), n AS (SELECT a, count(*) AS n FROM l GROUP BY 1)
SELECT v.vec_id, coalesce(n.n, 0) AS n_links, coalesce(m.low, v.vec_id) AS component_id, coalesce(m.low, v.vec_id) = v.vec_id AS kept FROM v LEFT JOIN m ON m.node = v.vec_id LEFT JOIN n ON n.a = v.vec_id"""

ORACLES["op2_suffix_dedup"] = """WITH b AS MATERIALIZED (SELECT doc_id, coalesce(text, '') AS text, encode(coalesce(text, '')) AS t FROM documents),
w AS MATERIALIZED (SELECT doc_id, pos, md5(array_slice(t, pos, pos + 399)) AS h FROM (SELECT doc_id, t, unnest(range(1, octet_length(t) - 398)) AS pos FROM b WHERE octet_length(t) >= 400)),
f AS MATERIALIZED (SELECT doc_id, pos FROM w JOIN (SELECT h FROM w GROUP BY h HAVING count(*) > 1) USING (h)),
g AS (SELECT doc_id, pos, lag(pos) OVER (PARTITION BY doc_id ORDER BY pos) AS before FROM f),
i AS (SELECT doc_id, pos, sum(CASE WHEN before IS NULL OR pos - before > 400 THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY pos) AS run FROM g),
r AS MATERIALIZED (SELECT doc_id, run, min(pos) AS low, max(pos) + 400 AS high FROM i GROUP BY 1, 2),
k AS (SELECT doc_id, coalesce(lag(high) OVER (PARTITION BY doc_id ORDER BY low), 1) AS low, low AS high FROM r UNION ALL SELECT b.doc_id, coalesce(max(high), 1), octet_length(any_value(t)) + 1 FROM b LEFT JOIN r ON b.doc_id = r.doc_id GROUP BY 1),
s AS (SELECT k.doc_id, sha256(unhex(string_agg(CASE WHEN k.high > k.low THEN hex(array_slice(t, k.low, k.high - 1)) ELSE '' END, '' ORDER BY k.low))) AS kept FROM k JOIN b ON k.doc_id = b.doc_id GROUP BY 1),
pt AS (SELECT doc_id, x, generate_subscripts(x, 1) AS n FROM (SELECT doc_id, regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+|[\\x20\\x09-\\x0D]+') AS x FROM b)),
pp AS (SELECT doc_id, x[n] AS p, 1 + sum(octet_length(encode(x[n]))) OVER (PARTITION BY doc_id ORDER BY n) AS high, n FROM pt),
pw AS MATERIALIZED (SELECT doc_id, high - octet_length(encode(p)) AS low, high, row_number() OVER (PARTITION BY doc_id ORDER BY n) AS n FROM pp WHERE regexp_matches(p, '^[^\\x20\\x09-\\x0D]')),
ps AS MATERIALIZED (SELECT a.doc_id, a.low, z.high, md5(array_slice(t, CAST(a.low AS BIGINT), CAST(z.high AS BIGINT) - 1)) AS h FROM pw a JOIN pw z ON a.doc_id = z.doc_id AND z.n = a.n + 50 JOIN b ON b.doc_id = a.doc_id),
pi AS (SELECT doc_id, low, high FROM ps JOIN (SELECT h FROM ps GROUP BY h HAVING count(*) > 1) USING (h) UNION ALL SELECT doc_id, low, high FROM r),
pr AS (SELECT doc_id, low, high, max(high) OVER (PARTITION BY doc_id ORDER BY low, high ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS reached FROM pi),
pn AS (SELECT doc_id, sum(greatest(0, high - greatest(low, coalesce(reached, low)))) AS n FROM pr GROUP BY 1)
SELECT b.doc_id, CAST(octet_length(t) AS BIGINT) AS n_bytes, CAST(coalesce(q.n, 0) AS BIGINT) AS n_removed, CAST(coalesce(c, 0) AS BIGINT) AS n_spans, kept AS kept_sha256, CAST(coalesce(pn.n, 0) AS BIGINT) AS n_repeated
FROM b JOIN s ON b.doc_id = s.doc_id LEFT JOIN (SELECT doc_id, sum(high - low) AS n, count(*) AS c FROM r GROUP BY 1) q ON b.doc_id = q.doc_id LEFT JOIN pn ON pn.doc_id = b.doc_id"""
