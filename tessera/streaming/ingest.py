"""Continuous ingest, and log replay as keyed state."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from tessera.operators.dml import first_by_id
from tessera.plans.engine import Engine
from tessera.schemas import KIND


def ingest_stream(documents: DataFrame, engine: Engine, checkpoint: str, **trigger) -> StreamingQuery:
    """Insert a stream of documents (workspace_id, url, text, seq); of one url in a batch the latest seq counts.

    Inserting a document again replaces it, so a batch that is repeated after a failure changes nothing.
    """

    def insert(batch: DataFrame, number: int) -> None:
        engine.insert(first_by_id(batch, ["workspace_id", "url"], F.col("seq").desc()))

    return documents.writeStream.foreachBatch(insert).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()


CHANGES = "doc_id long, seq long, deleted boolean, n_splits long, n_summaries long"


#: Groups that documents are dealt to for their state.
BUCKETS = 1 << 12
_NO_SEQ = (1 << 63) - 1


def replay_stream(log: DataFrame, hold_ms: int | None = None, buckets: int = BUCKETS) -> DataFrame:
    """Commits and deletes of a change-log stream, as they happen: (doc_id, seq, deleted, n_splits, n_summaries).

    The state of a document is what waits for its document row; commits clear it. The last change of a document by seq is its
    state. Rows of a document must arrive in order of seq over batches; inside a batch they are put in order. With
    ``hold_ms`` what has waited so long without a document row is a torn insert, and is forgotten. That is for streams without an end: one
    that is run until all input has been read (``availableNow``) would wait for the clock for ever.

    Documents are dealt to ``buckets``, which keep the states of theirs together, since a call of Python for each document would take most of
    the time. A checkpoint can only be continued with the same number of them.
    """
    entities = (KIND["split"], KIND["summary"])

    def run(key: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        waiting: dict[int | None, list[tuple[int, int]]] = {}
        until: dict[int | None, int] = {}
        for doc, kind, entity, limit in zip(*state.get, strict=True) if state.exists else ():
            waiting.setdefault(doc, []).append((kind, entity))
            until[doc] = limit
        now = 0 if hold_ms is None else state.getCurrentProcessingTimeMs()
        found = [] if state.hasTimedOut else [p for p in parts if len(p)]
        out, touched = [], set()
        if found:
            rows = pd.concat(found).sort_values("seq", kind="stable")
            docs = [None] * len(rows) if key[0] < 0 else rows["doc_id"].tolist()
            for doc, seq, kind, entity, split_ids, summary_ids in zip(docs, *(rows[c].tolist() for c in ("seq", "kind", "entity_id", "split_ids", "summary_ids")), strict=True):
                touched.add(doc)
                if kind in entities:
                    waiting.setdefault(doc, []).append((int(kind), int(entity)))
                    continue
                if seq == _NO_SEQ:
                    raise ValueError(f"a commit or delete of document {doc} has no seq")
                before = waiting.pop(doc, ())
                if kind == KIND["doc"]:
                    n = {}
                    for what, named in (("split", split_ids), ("summary", summary_ids)):
                        have = {e for k, e in before if k == KIND[what]}
                        n[what] = len(have if named is None else have & {int(x) for x in named})
                    out.append((doc, int(seq), False, n["split"], n["summary"]))
                else:
                    out.append((doc, int(seq), True, 0, 0))
        if hold_ms is not None:
            until = {doc: now + hold_ms if doc in touched else until[doc] for doc in waiting}
            waiting = {doc: w for doc, w in waiting.items() if until[doc] > now}
        if waiting:
            flat = [(doc, k, e, until.get(doc, 0)) for doc, w in waiting.items() for k, e in w]
            state.update(tuple(map(list, zip(*flat, strict=True))))
            if hold_ms is not None:
                state.setTimeoutDuration(min(until[doc] for doc in waiting) - now)
        elif state.exists:
            state.remove()
        if out:
            yield pd.DataFrame(out, columns=["doc_id", "seq", "deleted", "n_splits", "n_summaries"])

    bucket = F.when(F.col("doc_id").isNull(), F.lit(-1)).otherwise(F.pmod(F.xxhash64("doc_id"), F.lit(buckets)).cast("int"))
    # pandas has whole numbers exactly only where none is null
    seq = F.coalesce("seq", F.lit(_NO_SEQ))
    entity = F.coalesce("entity_id", F.when(~F.col("kind").isin(*entities), F.lit(0)))
    rows = log.select(bucket.alias("bucket"), "doc_id", seq.alias("seq"), "kind", entity.alias("entity_id"), "split_ids", "summary_ids")
    held = "docs array<bigint>, kinds array<int>, entities array<bigint>, until array<bigint>"
    return rows.groupBy("bucket").applyInPandasWithState(run, CHANGES, held, "append", GroupStateTimeout.NoTimeout if hold_ms is None else GroupStateTimeout.ProcessingTimeTimeout)
