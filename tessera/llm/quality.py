"""Quality classifier by importance resampling: hashed n-gram models of target and raw text, sampled by Gumbel top-k."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import give_back, save, slices, text_slices
from tessera.llm.shingles import mixed, word_hashes

#: Buckets that n-grams are hashed to.
BUCKETS = 1 << 17
#: Hash that stands for a word that repeats the one before it.
AGAIN = np.uint64(0x2545F4914F6CDD1D)


def n_grams(texts: list[bytes]) -> list[tuple[np.ndarray, np.ndarray]]:
    """Buckets of the n-grams of each kind, and where each text's begin (n + 1).

    Kinds: words, pairs of words, and bytes in threes. A word that repeats the one before it is the token AGAIN, whatever it spells.
    """

    def hashed(values: np.ndarray, kind: int) -> np.ndarray:
        return (mixed(values + np.uint64(kind << 60)) % np.uint64(BUCKETS)).astype(np.int64)

    words, first = word_hashes(texts)
    starts = np.zeros(len(words), bool)
    starts[first[:-1][first[:-1] < first[1:]]] = True
    before = np.concatenate([words[:1], words[:-1]])
    words = np.where((words == before) & ~starts, AGAIN, words)
    before = np.concatenate([words[:1], words[:-1]])
    pair = hashed(mixed(before) * np.uint64(3) + words, 2)[~starts]
    out = [(hashed(words, 1), first), (pair, np.cumsum([0, *np.maximum(np.diff(first) - 1, 0)]))]

    data = np.frombuffer(b"".join(texts), np.uint8).astype(np.uint64)
    size = np.array([len(t) for t in texts], np.int64)
    if len(data) >= 3:
        three = (data[:-2] << np.uint64(16)) | (data[1:-1] << np.uint64(8)) | data[2:]
        inside = np.ones(len(three), bool)
        for back in (1, 2):
            edge = np.cumsum(size) - back
            # the last two places of a text begin no triple of its own
            edge = edge[(edge >= 0) & (edge < len(three)) & (size >= back)]
            inside[edge] = False
        out.append((hashed(three[inside], 3), np.cumsum([0, *np.maximum(size - 2, 0)])))
    return out


def _texts(values) -> list[bytes]:
    return [(t or "").encode("utf-8", "surrogatepass") for t in values]


class Counts:
    """n-gram counts of the target and of all raw text, and which documents the target is made of."""

    def __init__(self, target: np.ndarray, raw: np.ndarray, members: np.ndarray, smoothing: float):
        self.target, self.raw, self.members, self.smoothing = target, raw, np.sort(members), smoothing
        self.share = target.sum() / max(1.0, raw.sum())

    def log_ratios(self, ids: np.ndarray, texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """log p(text | target) - log p(text | raw) of each text, and its number of n-grams.

        Both models leave the text's own n-grams out, else every text would be likelier under the model that has seen it. Their
        pseudo-counts are in proportion to their sizes, so that n-grams that neither has seen decide nothing.
        """
        grams = n_grams(texts)
        count = np.sum([np.diff(f) for _, f in grams], axis=0).astype(np.int64)
        if self.share == 0:
            return np.zeros(len(texts)), count
        key = np.sort(np.concatenate([b + np.repeat(np.arange(len(texts)), np.diff(f)) * BUCKETS for b, f in grams]))
        first = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]])) if len(key) else np.zeros(0, np.int64)
        own = np.diff(np.append(first, len(key)))
        text, bucket = np.divmod(key[first], BUCKETS)
        inside = np.isin(ids, self.members)
        target = self.target[bucket] - own * inside[text] + self.smoothing * self.share
        raw = (self.raw[bucket] - own + self.smoothing) * self.share
        return np.bincount(text, own * np.log(target / raw), len(texts)), count


def gumbel(ids: np.ndarray, seed: int) -> np.ndarray:
    """Standard Gumbel noise of each id."""
    uniform = ((mixed(mixed(ids.astype(np.uint64)) + np.uint64(seed)) >> np.uint64(12)).astype(np.float64) + 0.5) / (1 << 52)
    return -np.log(-np.log(uniform))


class Classifier:
    """Fitted counts, the labels they come from, and after ``choose`` the least key that is kept."""

    def __init__(self, docs: DataFrame, counts: Counts, labels: DataFrame, seed: int):
        self.known = counts.share > 0
        self.counts = docs.sparkSession.sparkContext.broadcast(counts)
        self.labels, self.seed, self.least = labels, seed, None

    def scored(self, doc_id: Column, text: Column) -> Column:
        """Struct of log_ratio, n_grams and key: a number that sorts as the log ratio plus Gumbel noise by the id. A text without
        n-grams has the least key."""
        counts, seed = self.counts, self.seed

        @F.pandas_udf("log_ratio double, n_grams long, key long")
        def run(columns: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.DataFrame]:
            for ids, values in columns:
                number = pd.to_numeric(ids).fillna(-1).astype("int64").to_numpy()
                ratio, count = np.zeros(len(ids)), np.zeros(len(ids), np.int64)
                for part in slices([len(t or "") for t in values], rows=128):
                    ratio[part], count[part] = counts.value.log_ratios(number[part], _texts(values.iloc[part]))
                bits = np.where(count > 0, ratio + gumbel(number, seed), -np.inf).view(np.int64)
                yield pd.DataFrame({"log_ratio": ratio, "n_grams": count, "key": bits ^ ((bits >> 63) & np.int64(0x7FFFFFFFFFFFFFFF))})
            give_back()

        return run(doc_id, text)

    def cut(self, scored: DataFrame) -> float:
        """The log ratio that tells the labelled sample's documents of quality 1 from the others with the fewest errors, between two
        documents; of equally good ones the highest. Without labels of both kinds everything is above it."""
        rows = scored.join(F.broadcast(self.labels), F.col("doc_id") == F.col("labelled")).filter("n_grams > 0")
        rows = rows.groupBy("labelled", "quality").agg(F.avg("log_ratio").alias("log_ratio")).collect()  # one row for each label of the sample
        return best_cut([(r.log_ratio, r.quality == 1) for r in rows]) if self.known else float("-inf")

    def size(self, scored: DataFrame) -> int:
        """How many documents are like the target: those with a log ratio above the cut."""
        if not self.known:
            return scored.count()
        return scored.filter((F.col("log_ratio") > self.cut(scored)) & (F.col("n_grams") > 0)).count()

    def keeps(self, key: Column) -> Column:
        return F.lit(False) if self.least >= 1 << 63 else key >= F.lit(self.least).cast("long")

    def choose(self, scored: DataFrame, sample: int | None = None) -> int:
        """Set ``least`` so that the ``sample`` rows with the largest keys are kept (default: ``size``), by counting digits.

        Each of four rounds counts at most 65,536 values of sixteen bits.
        """
        k = self.size(scored) if sample is None else sample
        if k <= 0:
            self.least = 1 << 63
            return 0
        prefix, left = None, k
        for digit in range(4):
            shift = 48 - 16 * digit
            rows = scored if prefix is None else scored.filter(F.shiftright("key", shift + 16) == prefix)
            counts = dict(rows.groupBy(F.shiftright("key", shift).alias("d")).count().collect())
            if prefix is None and sum(counts.values()) <= k:
                self.least = -(1 << 63)
                return k
            for d in sorted(counts, reverse=True):
                if counts[d] >= left:
                    prefix = d
                    break
                left -= counts[d]
        self.least = prefix
        return k


def best_cut(labelled: list[tuple[float, bool]]) -> float:
    """Where (number, good) pairs are parted with the fewest errors, the good above; of equally good places the highest."""
    rows = sorted(labelled)
    value, good = np.array([r[0] for r in rows]), np.array([r[1] for r in rows], bool)
    if good.all() or not good.any():
        return float("-inf")
    # errors of keeping all above row n: good ones up to it, and others after it
    errors = np.cumsum(good) + (~good).sum() - np.cumsum(~good)
    best = len(rows) - 1 - int(np.argmin(errors[::-1]))
    return float(value[best] + value[min(best + 1, len(rows) - 1)]) / 2


def fit(docs: DataFrame, labels: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", quality_col: str = "quality", most_labels: int = 50_000, smoothing: float = 10.0, seed: int = 3) -> Classifier:
    """Fit the two n-gram models: target on labelled documents of quality 1, raw on all documents.

    At most ``most_labels`` labels count (those of least hash of the id), so that they can be sent to every task; the raw model is of all
    documents. Counts are added up in each task and then by bucket.
    """
    few = labels.select(labels[id_col].cast("long").alias("labelled"), labels[quality_col].cast("int").alias("quality")).filter("labelled is not null and quality is not null")
    few = save(few.groupBy("labelled").agg(F.max("quality").alias("quality")).orderBy(F.xxhash64("labelled"), "labelled").limit(most_labels))
    base = docs.select(docs[id_col].cast("long").alias("doc_id"), docs[text_col].cast("string").alias("text"))
    marked = base.join(F.broadcast(few), base["doc_id"] == few["labelled"], "left").select("text", (F.coalesce("quality", F.lit(0)) == 1).alias("target"))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        raw, target = np.zeros(BUCKETS, np.int64), np.zeros(BUCKETS, np.int64)
        for whole in batches:
            for batch in text_slices(whole, 0):
                good = np.array(batch.column(1).to_pylist(), bool)
                for buckets, first in n_grams(_texts(batch.column(0).to_pylist())):
                    raw += np.bincount(buckets, minlength=BUCKETS)
                    target += np.bincount(buckets[np.repeat(good, np.diff(first))], minlength=BUCKETS)
        some = np.flatnonzero(raw)
        yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(target[some]), pa.array(raw[some])], ["bucket", "target", "raw"])

    sums = marked.mapInArrow(count, "bucket long, target long, raw long").groupBy("bucket").agg(F.sum("target"), F.sum("raw")).collect()
    counts = np.zeros((2, BUCKETS))
    for bucket, target, raw in sums:
        counts[:, bucket] = target, raw
    members = np.array([r[0] for r in few.filter("quality = 1").select("labelled").collect()], np.int64)
    return Classifier(docs, Counts(*counts, members, smoothing), few, seed)


def resample(docs: DataFrame, labels: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", sample: int | None = None, **options) -> DataFrame:
    """Importance weight of each document and whether the sample keeps it.

    The log weight of a document is the log ratio of its n-grams under the target and the raw model. The sample is drawn
    without replacement in proportion to the weights by Gumbel top-k: the ``sample`` documents with the largest sums of
    log weight and Gumbel noise are kept. If no size is given, it is the number of documents like the target: those with a log ratio above the
    cut that parts the labelled documents best. All rows that tie at the last place are kept.

    Rows, one for each input row: doc_id, log_ratio, n_grams, kept. Texts without n-grams (null, empty) have ratio 0 and the least
    keys; they aren't kept unless the sample has room for all rows. Repeated rows have equal keys. A null id has the noise of -1. Without a label of quality 1 nothing is known, and
    the default is all rows; without one of quality 0, all that have n-grams. Empty table: no rows. Other columns are ignored.
    """
    model = fit(docs, labels, id_col=id_col, text_col=text_col, **options)
    base = docs.select(docs[id_col].cast("long").alias("doc_id"), docs[text_col].cast("string").alias("text"))
    rows = save(base.select("doc_id", model.scored(F.col("doc_id"), F.col("text")).alias("s")).select("doc_id", "s.*"))
    model.choose(rows, sample)
    return rows.select("doc_id", "log_ratio", "n_grams", model.keeps(F.col("key")).alias("kept"))


def keep_good(docs: DataFrame, labels: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", sample: int | None = None, **options) -> DataFrame:
    """The rows of ``docs`` that ``resample`` keeps, with all columns, whatever their names. Texts are scored once, and written with their keys."""
    model = fit(docs, labels, id_col=id_col, text_col=text_col, **options)
    score = model.scored(docs[id_col].cast("long"), docs[text_col].cast("string"))
    rows = save(docs.select(docs[id_col].cast("long").alias("doc_id"), F.struct(*(docs[c] for c in docs.columns)).alias("doc"), score.alias("s")).select("doc_id", "doc", "s.*"))
    model.choose(rows, sample)
    return rows.filter(model.keeps(F.col("key"))).select("doc.*")
