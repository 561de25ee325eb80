"""A versioned store of documents on Parquet: commits are appended, the manifest is written last."""

from __future__ import annotations

import json
import re
import uuid
from dataclasses import asdict, dataclass, field, replace

from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera.operators import dml, stats
from tessera.plans.ingest import Processed, written
from tessera.schemas import DOCS, SPLITS, SUMMARIES

TABLES = {"docs": DOCS, "splits": SPLITS, "summaries": SUMMARIES}
VERSION = 2
MANIFESTS = "_manifests"
_COMMIT = T.StructField("commit", T.LongType())


_BATCH = T.StructField("batch", T.StringType())


class Conflict(RuntimeError):
    """Another writer has published since this one read the manifest."""


@dataclass(frozen=True)
class Manifest:
    """What a reader may see: the commits in order, and where each table of a commit is. ``number`` counts manifests."""

    model_id: int
    n_embd: int
    scalar_kind: str = "F32"
    commits: list[dict] = field(default_factory=list)
    next_commit: int = 1
    version: int = VERSION
    number: int = 0


class Store:
    """Documents by workspace under ``root``, in any file system that Spark writes.

    A commit is a folder of Parquet files in each table and becomes visible with the manifest that names it; what a failed commit has
    written is never read. A document's live rows are those of its latest commit, unless that deleted it. Readers of one
    manifest see one version.

    Manifests are numbered files. A new one is written under another name and renamed to the next number, which fails if that is
    there: the newest complete manifest always stays, and of two writers at a time one gets a ``Conflict`` and
    changes nothing.
    """

    def __init__(self, spark: SparkSession, root: str, *, model_id: int, n_embd: int, scalar_kind: str = "F32", segment_bytes: int = 256 << 20, most_commits: int = 64):
        self.spark, self.root = spark, root.rstrip("/")
        self.segment_bytes, self.most_commits = segment_bytes, most_commits
        self.manifest = self._load() or Manifest(model_id, n_embd, scalar_kind)
        m = self.manifest
        if m.version > VERSION:
            raise ValueError(f"the store is of version {m.version}; this program reads up to {VERSION}")
        if (m.model_id, m.n_embd, m.scalar_kind) != (model_id, n_embd, scalar_kind):
            raise ValueError(f"the store holds vectors of model {m.model_id}, width {m.n_embd}, kind {m.scalar_kind}")

    def _path(self, name: str):
        p = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.root}/{name}")
        return p.getFileSystem(self.spark._jsc.hadoopConfiguration()), p

    def _names(self, folder: str) -> list[str]:
        fs, path = self._path(folder)
        return sorted(s.getPath().getName() for s in fs.listStatus(path)) if fs.exists(path) else []

    def _load(self) -> Manifest | None:
        """The manifest of the highest number."""
        numbered = [n for n in self._names(MANIFESTS) if re.fullmatch(r"\d{10}\.json", n)]
        if not numbered:
            return None
        fs, path = self._path(f"{MANIFESTS}/{numbered[-1]}")
        stream = fs.open(path)
        try:
            text = self.spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
        finally:
            stream.close()
        return Manifest(**json.loads(text))

    def refresh(self) -> None:
        """See what others have published."""
        self.manifest = self._load() or self.manifest

    def _publish(self, manifest: Manifest) -> None:
        manifest = replace(manifest, number=self.manifest.number + 1)
        fs, new = self._path(f"{MANIFESTS}/{uuid.uuid4().hex}.tmp")
        stream = fs.create(new, True)
        try:
            stream.write(bytearray(json.dumps(asdict(manifest)).encode()))
        finally:
            stream.close()
        self._rename(new, f"{MANIFESTS}/{manifest.number:010d}.json")
        self.manifest = manifest

    def _rename(self, source, name: str) -> None:
        """Rename a file to a name that must be free."""
        jvm, (fs, target) = self.spark._jvm, self._path(name)
        options = self.spark.sparkContext._gateway.new_array(getattr(jvm.org.apache.hadoop.fs, "Options$Rename"), 0)
        try:
            jvm.org.apache.hadoop.fs.FileContext.getFileContext(target.toUri(), self.spark._jsc.hadoopConfiguration()).rename(source, target, options)
        except Py4JJavaError as e:
            fs.delete(source, False)
            if "FileAlreadyExistsException" in str(e.java_exception.getClass().getName()):
                raise Conflict(f"{name} has been published by another writer") from None
            raise

    def _write(self, number: int, tables: dict[str, DataFrame], label: str) -> dict:
        folder = f"{label}-{number:010d}-{uuid.uuid4().hex[:8]}"
        # files end at about the size of a segment; vectors are most of a row
        most = max(1, self.segment_bytes // (4 * self.manifest.n_embd + 512))
        for name, df in tables.items():
            df.write.option("maxRecordsPerFile", most).partitionBy("workspace_id").parquet(f"{self.root}/{name}/batch={folder}")
        return {"number": number, "folder": folder, "tables": sorted(tables), "kind": label}

    def _read(self, name: str, commits: list[dict] | None = None) -> DataFrame:
        """Rows of all commits with their number, by one scan; a compacted commit keeps the numbers of its rows."""
        schema = T.StructType([*(f for f in TABLES[name].fields), *([T.StructField("deleted", T.BooleanType())] if name == "docs" else []), _COMMIT])
        paths = [f"{self.root}/{name}/batch={c['folder']}" for c in (self.manifest.commits if commits is None else commits) if name in c["tables"]]
        if not paths:
            return self.spark.createDataFrame([], schema)
        rows = self.spark.read.schema(T.StructType([*schema.fields, _BATCH])).option("basePath", f"{self.root}/{name}").parquet(*paths)
        return rows.select(*schema.fieldNames())

    def _live(self) -> DataFrame:
        """(workspace_id, doc_id, live commit) of each document that is there."""
        last = self._read("docs").groupBy(*dml.KEY).agg(F.max(F.struct("commit", "deleted")).alias("last"))
        return last.filter(~F.col("last.deleted")).select(*dml.KEY, F.col("last.commit").alias("commit"))

    def table(self, name: str) -> DataFrame:
        """Live rows of ``docs``, ``splits`` or ``summaries``."""
        rows = self._read(name)
        out = rows.filter(~F.col("deleted")).drop("deleted") if name == "docs" else rows
        if len(self.manifest.commits) == 1:  # nothing can have been replaced
            return out.select(*TABLES[name].fieldNames())
        return out.join(self._live(), [*dml.KEY, "commit"], "left_semi").select(*TABLES[name].fieldNames())

    def append(self, batch: Processed) -> DataFrame:
        """Insert or replace documents. A document with a bad vector is rejected as a whole, before anything is visible.

        Returns the status of each document. The batch is staged once, so that its model runs once.
        """
        number, m = self.manifest.next_commit, self.manifest
        staging = f"{self.root}/_staging-{uuid.uuid4().hex}"
        batch = batch.staged(staging)
        rows = {"docs": batch.docs, "splits": batch.splits, "summaries": batch.summaries}
        bad = [dml.invalid(rows[n], m.n_embd, m.model_id, key).select(*dml.KEY) for n, key in (("splits", "split_id"), ("summaries", "summary_id"))]
        bad = written(bad[0].unionByName(bad[1]).distinct(), f"{staging}/bad")  # found once for all three tables
        tables = {}
        for name, df in rows.items():
            good = dml.reject(df, bad)[0].withColumn("commit", F.lit(number).cast("long"))
            tables[name] = good.withColumn("deleted", F.lit(False)) if name == "docs" else good
        commit = self._write(number, tables, "commit")
        self._publish(replace(m, commits=[*m.commits, commit], next_commit=number + 1))
        rejected = bad.withColumn("bad", F.lit(True))
        out = rows["docs"].select(*dml.KEY).join(rejected, dml.KEY, "left").select(*dml.KEY, F.when(F.col("bad"), "Error").otherwise("Success").alias("status"))
        return out

    def clean(self) -> None:
        """Delete staged batches, older manifests, and folders that the newest manifest doesn't name. Refuses where there is none, or one that
        isn't this writer's."""
        newest = self._load()
        if newest is None:
            if any(self._names(t) for t in TABLES):
                raise RuntimeError(f"{self.root} has tables but no manifest; nothing is deleted")
            return
        if newest != self.manifest:
            raise Conflict("the newest manifest is another writer's")
        keep = {f"batch={c['folder']}" for c in newest.commits}
        old = [f"{t}/{n}" for t in TABLES for n in self._names(t) if n.startswith("batch=") and n not in keep]
        old += [n for n in self._names("") if n.startswith("_staging-")]
        old += [f"{MANIFESTS}/{n}" for n in self._names(MANIFESTS) if n != f"{newest.number:010d}.json"]
        for name in old:
            fs, path = self._path(name)
            fs.delete(path, True)

    def delete(self, doc_ids: DataFrame) -> DataFrame:
        """Delete documents (workspace_id, doc_id); status Success or NotFound. Unknown ids change nothing."""
        number, m = self.manifest.next_commit, self.manifest
        status = dml.delete_status(self._live(), doc_ids)
        gone = status.filter("status = 'Success'").select(*dml.KEY)
        marks = gone.select(*dml.KEY, *[F.lit(None).cast(f.dataType).alias(f.name) for f in DOCS.fields if f.name not in dml.KEY], F.lit(True).alias("deleted"), F.lit(number).cast("long").alias("commit"))
        commit = self._write(number, {"docs": marks}, "commit")
        written = self._read("docs", [commit]).select(*dml.KEY, F.lit(True).alias("gone"))
        self._publish(replace(m, commits=[*m.commits, commit], next_commit=number + 1))
        return doc_ids.select(*dml.KEY).distinct().join(written, dml.KEY, "left").select(*dml.KEY, F.when(F.col("gone"), "Success").otherwise("NotFound").alias("status"))

    def dead_rows(self) -> DataFrame:
        """Per workspace all rows, dead rows and whether compaction is due at a ratio; see ``stats.needs_compaction``."""
        parts = []
        for name in TABLES:
            every = self._read(name).groupBy("workspace_id").agg(F.count("*").alias("bytes"))
            live = self.table(name).groupBy("workspace_id").agg(F.count("*").alias("live"))
            parts.append(every.join(live, "workspace_id", "left").select("workspace_id", "bytes", (F.col("bytes") - F.coalesce("live", F.lit(0))).alias("dead_bytes")))
        return parts[0].unionByName(parts[1]).unionByName(parts[2])

    def compact(self, ratio: float = 0.3) -> bool:
        """Rewrite the live rows if any workspace's dead share is over ``ratio``, or there are more than ``most_commits`` commits; commit
        numbers stay, tombstones go. Files are of about ``segment_bytes``."""
        due = len(self.manifest.commits) > self.most_commits
        if not due and not stats.needs_compaction(self.dead_rows(), ratio).filter("needs_compaction").limit(1).count():
            return False
        m, live = self.manifest, self._live()
        tables = {}
        for name in TABLES:
            rows = self._read(name)
            rows = rows.filter(~F.col("deleted")) if name == "docs" else rows
            files = max(1, -(-self._size(name) // self.segment_bytes))
            tables[name] = rows.join(live, [*dml.KEY, "commit"], "left_semi").repartition(files, "workspace_id", "doc_id").sortWithinPartitions("workspace_id", "doc_id")
        commit = self._write(m.next_commit, tables, "base")
        self._publish(replace(m, commits=[commit], next_commit=m.next_commit + 1))
        return True

    def _size(self, name: str) -> int:
        """Bytes that the manifest's files of a table take."""
        paths = [self._path(f"{name}/batch={c['folder']}") for c in self.manifest.commits if name in c["tables"]]
        return sum(fs.getContentSummary(p).getLength() for fs, p in paths)

    def stats(self) -> DataFrame:
        return stats.shard_stats(self.table("docs"), self.table("splits"), self.table("summaries"))

    def vectors(self, name: str) -> DataFrame:
        """Ids and vectors of all live splits or summaries; texts aren't read."""
        return self.table(name).select("workspace_id", "doc_id", f"{'summary' if name == 'summaries' else 'split'}_id", "embedding")

    def get(self, name: str, wanted: DataFrame) -> DataFrame:
        """Live rows of a table by id, with their ``position``: ``wanted`` has (position, workspace_id, doc_id, split_id or summary_id).
        Ids that aren't there are skipped; one that is asked for twice comes twice."""
        key = {"docs": "doc_id", "splits": "split_id", "summaries": "summary_id"}[name]
        return dml.in_requested_order(self.table(name), wanted.select("position", "workspace_id", key), ["workspace_id", key])

    def contains(self, workspace: str, doc_id: int) -> bool:
        return bool(self._live().filter((F.col("workspace_id") == workspace) & (F.col("doc_id") == doc_id)).limit(1).count())

    def doc_id_for_url(self, url: str) -> DataFrame:
        """(workspace_id, doc_id) of the documents with a url."""
        return self.table("docs").filter(F.col("url") == url).select(*dml.KEY)

    def workspaces(self) -> DataFrame:
        return self._live().select("workspace_id").distinct()
