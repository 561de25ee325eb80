"""From raw documents to packed training sequences, stage by stage.

Each stage takes (spark, docs, sf_dir), where docs is what the stage before it kept, written as Parquet and read
again. All but the last return the columns of ``documents``, and further columns of theirs, whatever their names. Null and empty
texts, null ids, repeated rows and empty tables give what the operators' docstrings say.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tessera.llm.common import save
from tessera.llm.jaccard_join import join
from tessera.llm.packing import pack
from tessera.llm.quality import keep_good
from tessera.llm.queries import table, tokenizer_file
from tessera.llm.suffix_dedup import remove_repeats


def good_documents(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier keeps."""
    return keep_good(docs, table(spark, sf_dir, "labels"))


def one_of_each_group(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near-duplicates the document of smallest id; of repeated rows one. Rows with a null id stay."""
    groups = join(docs)
    first = groups.filter("doc_id = class_id").select(F.col("doc_id").alias("first_id")).distinct()
    row = docs.select(docs["doc_id"].alias("own_id"), F.struct(*(docs[c] for c in docs.columns)).alias("row"))
    found = row.join(first, F.col("own_id") == F.col("first_id"), "left_semi")
    # copies of a row have the same id, so they meet where the join has put them already
    mark = F.xxhash64(F.coalesce("row.text", F.lit("")))
    same = F.lag(mark).over(Window.partitionBy("own_id").orderBy(mark))
    found = found.select("row", same.eqNullSafe(mark).alias("copy")).filter(~F.col("copy"))
    return found.select("row").unionByName(row.filter("own_id is null").select("row")).select("row.*")


def without_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the bytes of passages of 400 bytes, or of more than 50 words, that stand elsewhere too; bytes of a
    character that is cut in two go as well. Documents of which nothing is left stay, with an empty text."""
    other = [c for c in docs.columns if c not in ("doc_id", "text", "n_chars")]
    out = remove_repeats(docs, words=51, carry=other, as_text=True)
    place = {"doc_id": F.col("doc_id"), "text": F.col("kept"), "n_chars": F.length("kept").cast("long")} | {c: F.col(f"carried_{n}") for n, c in enumerate(other)}
    return out.select(*(place[c].alias(c) for c in docs.columns))


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the documents in sequences of at most 4096 ids."""
    return pack(docs, tokenizer_file("word_bpe_49k.json"))


STAGES = [
    ("quality classifier", good_documents),
    ("n-gram Jaccard join", one_of_each_group),
    ("suffix-array dedup", without_repeats),
    ("packing", packed),
]

#: SQL can't express the stages; tests compare them with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The result of the last stage; every stage's rows are written and read again."""
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = save(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
