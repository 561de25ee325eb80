"""The pipeline's stages against plain versions, each on its own input."""

import random
import struct
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

import corpus_pipeline
from tessera.llm.queries import tokenizer_file
from tests.llm import brute
from tests.llm.test_operators import CLASH, LABELS, hashed_grams, mixed_quality, prose

COLUMNS = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    rows, n = mixed_quality(120)
    rng = random.Random(3)
    shared = prose(rng, 100)
    texts = [t for _, t in rows] + [rows[5][1], rows[6][1] + " more words", shared + " " + prose(rng, 50), prose(rng, 50) + " " + shared, None, "", prose(rng, 5000)]
    table = [(i, t, "en", "s", len(t or "")) for i, t in enumerate(texts)]
    table += [(5, texts[5], "en", "s", len(texts[5])), (None, prose(rng, 30), None, None, None)]
    path = tmp_path_factory.mktemp("sf")
    spark.createDataFrame(table, COLUMNS).write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame([(i, int(i < n), 0) for i, _ in rows if i % 2], LABELS).write.parquet(f"{path}/labels.parquet")
    return str(path)


def test_stages(spark, folder, tmp_path):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    names = docs.columns
    seen = [docs.collect()]
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES[:-1]):
        out = stage(spark, docs, folder)
        assert out.dtypes == docs.dtypes
        out.write.parquet(f"{tmp_path}/{k}")
        docs = spark.read.parquet(f"{tmp_path}/{k}")
        seen.append(docs.collect())
    raw, good, single, cut = seen
    marks = {r.doc_id: r.quality for r in spark.read.parquet(f"{folder}/labels.parquet").collect()}
    plain = brute.resampled([(-1 if r.doc_id is None else r.doc_id, r.text) for r in raw], marks, None, hashed_grams)
    assert sorted(map(str, good)) == sorted(str(r) for r in raw if plain[-1 if r.doc_id is None else r.doc_id][2])
    assert 0 < sum(not x[2] for x in plain.values()) < len(plain) / 2

    ids = {r.doc_id: r.text for r in good if r.doc_id is not None}
    groups = brute.jaccard_groups(list(ids.items()))
    assert sorted(r.doc_id for r in single if r.doc_id is not None) == sorted(i for i, g in groups.items() if g[1] == i)
    assert [r.text for r in single if r.doc_id is None] == [r.text for r in good if r.doc_id is None]
    assert {r.doc_id: tuple(r) for r in single if r.doc_id is not None}.items() <= {r.doc_id: tuple(r) for r in good}.items()

    want = brute.without_repeats([(r.doc_id, r.text) for r in single], 400)
    assert sorted(((-1 if r.doc_id is None else r.doc_id), r.text) for r in cut) == sorted(((-1 if w[0] is None else w[0]), w[5].decode()) for w in want)
    assert all(r.n_chars == len(r.text) for r in cut) and sum(w[2] for w in want) > 0

    pieces = corpus_pipeline.STAGES[-1][1](spark, docs, folder).collect()
    assert set(names) == set(docs.columns)
    tokenizer = Tokenizer.from_file(tokenizer_file("word_bpe_49k.json"))
    whole = {r.doc_id: [*tokenizer.encode(r.text, add_special_tokens=False).ids, 2] for r in cut}
    for i, ids in whole.items():
        own = sorted((r for r in pieces if r.doc_id == i), key=lambda r: r.start)
        assert [r.start for r in own] == [0, *np.cumsum([r.length for r in own])[:-1].tolist()] and sum(r.length for r in own) == len(ids)
        assert all(r.doc_tokens == len(ids) and r.ids_crc32 == zlib.crc32(struct.pack(f"<{r.length}I", *ids[r.start : r.start + r.length])) for r in own)
    for sequence in {r.sequence_id for r in pieces}:
        own = sorted((r for r in pieces if r.sequence_id == sequence), key=lambda r: r.offset)
        assert [r.offset for r in own] == [0, *np.cumsum([r.length for r in own])[:-1].tolist()] and sum(r.length for r in own) <= 4096


def test_passages_of_more_than_fifty_words_go(spark, folder):
    rng = random.Random(8)
    shared = {n: " ".join(w[:5] for w in prose(rng, n).split()) for n in (20, 50, 51, 52, 55, 60)}
    assert all(len(p) < 400 for p in shared.values())
    rows = [(10 * n + k, f"{prose(rng, 30)} start{k} {p} stop{k} {prose(rng, 30)}", "en", "s", 0) for n, p in shared.items() for k in range(3)]
    out = {r.doc_id: r for r in corpus_pipeline.without_repeats(spark, spark.createDataFrame(rows, COLUMNS), folder).collect()}
    assert len(out) == len(rows)
    for i, text, *_ in rows:
        p = shared[i // 10]
        assert out[i].text == (text if i // 10 <= 50 else text.replace(p, "")) and out[i].n_chars == len(out[i].text)


def test_run(spark, folder):
    out = corpus_pipeline.run(spark, folder)
    assert out.columns == ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"] and out.count() > 50


@pytest.mark.parametrize("k", range(4))
def test_stages_carry_columns_of_any_name(spark, folder, k):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    odd = docs.select("*", *(F.lit(f"{c} of {k}").alias(c) for c in [*CLASH, "same_text", "Kept_2", "n_bytes", "n_removed", "n_spans", "kept_sha256", "carried_0", "own_id", "row", "copy", "first_id", "s", "doc", "key"]))
    plain, more = (corpus_pipeline.STAGES[k][1](spark, d, folder) for d in (docs, odd))
    assert more.columns == (odd.columns if k < 3 else plain.columns)
    assert Counter(plain.collect()) == Counter(more.select(*plain.columns).collect())
    assert k == 3 or {(r.kept, r.same_text, r.key) for r in more.collect()} == {(f"kept of {k}", f"same_text of {k}", f"key of {k}")}


def test_ties_and_repeated_rows(spark, folder):
    """Equal texts under several ids and rows that stand twice: the smallest id stays, once."""
    rng = random.Random(4)
    text = prose(rng, 40)
    rows = [(i, text, "en", "s", len(text)) for i in (9, 4, 7, 4)] + [(2, None, None, None, None), (2, None, None, None, None), (3, "", "en", "s", 0)]
    out = corpus_pipeline.one_of_each_group(spark, spark.createDataFrame(rows, COLUMNS), folder).collect()
    assert sorted((r.doc_id, r.text or "") for r in out) == [(2, ""), (3, ""), (4, text)]


@pytest.mark.parametrize("k", range(4))
def test_stages_of_no_documents(spark, folder, k):
    docs = spark.createDataFrame([], COLUMNS)
    assert corpus_pipeline.STAGES[k][1](spark, docs, folder).count() == 0
