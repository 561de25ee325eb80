"""Legacy ARC archives to WARC: writing, parsing by declared lengths, conversion with revisits, reading back."""

from __future__ import annotations

import hashlib
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm.common import save

#: A gzip member ends with the length of its content as four little-endian bytes. Members hold less
#: than 2**24 bytes, so each ends with a zero byte; the writer's line separator supplies it.
MEMBER = (1 << 24) - 1
SPACE = uuid.UUID("5f1f3a60-7d3e-5f0f-9d0f-4b1c6f1f2a11")


def members(data: bytes) -> Iterator[bytes]:
    """``data`` as gzip members, each without its last (zero) byte."""
    for at in range(0, max(1, len(data)), MEMBER):
        z = zlib.compressobj(1, zlib.DEFLATED, 31)
        yield (z.compress(data[at : at + MEMBER]) + z.flush())[:-1]


def write_archive(df: DataFrame, column: str, path: str) -> None:
    """One archive for each partition: gzip members as they come, by the text writer, which adds bytes unchanged."""
    df.select(F.col(column).cast("string").alias("value")).write.option("lineSep", "\u0000").text(path)


def unzip(data: bytes, step: int = 1 << 20) -> Iterator[bytes]:
    """The content of all gzip members of a file, piece by piece."""
    at = 0
    z = zlib.decompressobj(31)
    view = memoryview(data)
    while at < len(view):
        if z.eof:
            z = zlib.decompressobj(31)
        part = view[at : at + step]
        yield z.decompress(part)
        at += len(part) - len(z.unused_data)


class Reader:
    """Lines and blocks of declared length from a stream of pieces."""

    def __init__(self, pieces: Iterator[bytes]):
        self.pieces, self.kept, self.at = pieces, bytearray(), 0

    def _more(self) -> bool:
        piece = next(self.pieces, None)
        if piece is None:
            return False
        if self.at:
            del self.kept[: self.at]
            self.at = 0
        self.kept += piece
        return True

    def line(self) -> bytes | None:
        """Up to and without the next line feed; None at the end."""
        look = self.at
        while (end := self.kept.find(b"\n", look)) < 0:
            look = len(self.kept) - self.at
            if not self._more():
                rest = bytes(self.kept[self.at :])
                self.at = len(self.kept)
                return rest or None
        out = bytes(self.kept[self.at : end])
        self.at = end + 1
        return out

    def block(self, n: int) -> bytes:
        while len(self.kept) - self.at < n:
            if not self._more():
                raise ValueError("the archive ends inside a record")
        out = bytes(self.kept[self.at : self.at + n])
        self.at += n
        return out


#: Fields of the header line by version of the ARC format; the length comes last in both.
ARC_FIELDS = {
    1: ("url", "ip", "date", "mime", "length"),
    2: ("url", "ip", "date", "mime", "status", "checksum", "location", "offset", "filename", "length"),
}


def arc_records(data: bytes, name: str) -> Iterator[dict]:
    """Records of an ARC file of version 1 or 2, after its version block; blank lines between records are skipped."""
    reader = Reader(unzip(data))
    version, number = 0, 0
    while (line := reader.line()) is not None:
        if not line.strip():
            continue
        parts = line.rstrip(b"\r").decode("utf-8", "surrogateescape").split(" ")
        if not version:
            if not parts[0].startswith("filedesc://"):
                raise ValueError("an ARC file begins with its version block")
            block = reader.block(int(parts[-1]))
            version = int(block.split(b" ", 1)[0])
            if version not in ARC_FIELDS:
                raise ValueError(f"unknown ARC version {version}")
            continue
        fields = ARC_FIELDS[version]
        if len(parts) != len(fields):
            raise ValueError(f"a header line of ARC version {version} has {len(fields)} fields: {line[:200]!r}")
        record = dict(zip(fields, parts, strict=True))
        block = reader.block(int(record["length"]))
        head, gap, payload = block.partition(b"\r\n\r\n")
        if not gap or not head.startswith(b"HTTP/"):
            head, payload = b"", block
        yield {"archive": name, "number": number, "version": version, **{k: record[k] for k in ("url", "ip", "date", "mime")}, "http": head, "payload": payload}
        number += 1


def http_field(head: bytes, name: bytes) -> bytes | None:
    for line in head.split(b"\r\n")[1:]:
        key, _, value = line.partition(b":")
        if key.strip().lower() == name:
            return value.strip()
    return None


def arc_url(url: str | None) -> str:
    """A url without white space or control characters, which an ARC header line can't hold."""
    raw = (url or "unknown:").encode("utf-8", "surrogatepass")
    return "".join(chr(b) if 32 < b < 127 else f"%{b:02X}" for b in raw)


def write_arc(pages: DataFrame, path: str, *, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", date: str = "20240101000000") -> None:
    """Write pages as ARC files, one a partition, of version 1 and 2 in turn; the id goes into an HTTP header."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part = TaskContext.get().partitionId()
        version, out, size = 1 + part % 2, [], 0
        names = "URL IP-address Archive-date Content-type Archive-length" if version == 1 else "URL IP-address Archive-date Content-type Result-code Checksum Location Offset Filename Archive-length"
        block = f"{version} 0 tessera\n{names}\n\n".encode()
        fill = "" if version == 1 else f" 200 - - 0 part-{part:05d}.arc"
        first = f"filedesc://part-{part:05d}.arc 0.0.0.0 {date} text/plain{fill} {len(block)}\n".encode() + block + b"\n"
        for batch in batches:
            for page, url, html in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                payload = (html or "").encode("utf-8", "surrogatepass")
                head = "HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n%s\r\n" % (len(payload), "" if page is None else f"X-Page-Id: {page}\r\n")
                body = head.encode() + payload
                checksum = zlib.crc32(payload)
                fill = "" if version == 1 else f" 200 {checksum:08x} - 0 part-{part:05d}.arc"
                record = f"{arc_url(url)} 0.0.0.0 {date} text/html{fill} {len(body)}\n".encode() + body + b"\n"
                out += members((first or b"") + record)
                first, size = None, size + len(body)
                if size > 1 << 22:
                    yield pa.RecordBatch.from_arrays([pa.array(out, pa.binary())], ["value"])
                    out, size = [], 0
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(out, pa.binary())], ["value"])

    rows = pages.select(pages[id_col].cast("long"), pages[url_col].cast("string"), pages[html_col].cast("string"))
    write_archive(rows.mapInArrow(run, "value binary"), "value", path)


def _parsed(spark: SparkSession, path: str, read, schema: str, flush: int = 1 << 22) -> DataFrame:
    """Rows that ``read(content, name)`` makes of each file below ``path``."""
    names = [f.split()[0] for f in schema.split(", ")]
    kinds = {"long": pa.int64(), "string": pa.string(), "binary": pa.binary(), "int": pa.int32()}
    target = pa.schema([(f.split()[0], kinds[f.split()[1]]) for f in schema.split(", ")])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name, content in zip(batch.column(0), batch.column(1), strict=True):
                rows, size = [], 0
                for row in read(content.as_buffer(), name.as_py().rpartition("/")[2]):
                    rows.append(row)
                    size += 200 + sum(len(v) for v in row.values() if isinstance(v, bytes))
                    if size > flush:
                        yield pa.RecordBatch.from_pylist(rows, target)
                        rows, size = [], 0
                if rows:
                    yield pa.RecordBatch.from_pylist(rows, target)

    files = spark.read.format("binaryFile").load(path).filter("length > 0").select("path", "content")
    return files.mapInArrow(run, ", ".join(f"{n} {f.split()[1]}" for n, f in zip(names, schema.split(", "), strict=True)))


def record_id(archive: str, number: int) -> str:
    return f"urn:uuid:{uuid.uuid5(SPACE, f'{archive}/{number}')}"


def iso(date: str) -> str:
    """The 14 digits of an ARC date (fewer: padded with zeros) as WARC writes them."""
    d = date[:14].ljust(14, "0")
    month, day = (max("01", d[i : i + 2]) for i in (4, 6))
    return f"{d[:4]}-{month}-{day}T{d[8:10]}:{d[10:12]}:{d[12:14]}Z"


def described(record: dict) -> dict:
    """An ARC record with a synthesised identifier and date and its payload's digest."""
    page = http_field(record["http"], b"x-page-id")
    return record | {
        "record_id": record_id(record["archive"], record["number"]), "page_id": int(page) if page else None, "date": iso(record["date"]),
        "payload_digest": hashlib.sha256(record["payload"]).hexdigest(), "payload_bytes": len(record["payload"]),
    }


DIGESTS = "archive string, number long, record_id string, page_id long, payload_digest string, payload_bytes long"


def arc_digests(spark: SparkSession, path: str) -> DataFrame:
    """One small row for each record of the ARC files below ``path``."""
    wanted = [f.split()[0] for f in DIGESTS.split(", ")]

    def read(content, name: str) -> Iterator[dict]:
        for record in arc_records(content, name):
            d = described(record)
            yield {c: d[c] for c in wanted}

    return _parsed(spark, path, read, DIGESTS)


def warc_record(r: dict) -> bytes:
    """A WARC/1.1 record; a revisit holds the HTTP header alone."""
    revisit = r["refers_id"] is not None
    block = r["http"] + b"\r\n\r\n" if r["http"] else b""
    block += b"" if revisit else r["payload"]
    kind = "revisit" if revisit else "response" if r["http"] else "resource"
    fields = [("WARC-Type", kind), ("WARC-Record-ID", f"<{r['record_id']}>"), ("WARC-Date", r["date"]), ("WARC-Target-URI", r["url"]), ("WARC-IP-Address", r["ip"])]
    fields += [("WARC-Payload-Digest", f"sha256:{r['payload_digest']}"), ("WARC-Block-Digest", f"sha256:{hashlib.sha256(block).hexdigest()}")]
    if revisit:
        fields += [("WARC-Profile", "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"), ("WARC-Refers-To", f"<{r['refers_id']}>")]
    fields += [("Content-Type", "application/http; msgtype=response" if r["http"] else r["mime"]), ("Content-Length", str(len(block)))]
    head = "WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in fields) + "\r\n"
    return head.encode("utf-8", "surrogateescape") + block + b"\r\n\r\n"


def convert(spark: SparkSession, arc_path: str, path: str, least_bytes: int = 100) -> None:
    """Write the ARC files below ``arc_path`` as WARC files below ``path``.

    Of records with equal payloads of ``least_bytes`` or more, the one with the smallest page id (then
    record id) is kept as a response and the others become revisits of it. That is decided on digests
    alone, by aggregation; each archive is then converted as a whole, beside the list of its revisits.
    """
    digests = save(arc_digests(spark, arc_path)).filter(F.col("payload_bytes") >= least_bytes)
    first = digests.groupBy("payload_digest").agg(F.min(F.struct(F.col("page_id").isNull().alias("none"), "page_id", "record_id")).alias("first"), F.count("*").alias("n")).filter("n > 1")
    again = digests.join(first, "payload_digest").filter("record_id <> first.record_id")
    # written, so that the planner knows its size: only a long list makes the archives be shuffled to meet it
    revisits = save(again.groupBy("archive").agg(F.collect_list("number").alias("numbers"), F.collect_list("first.record_id").alias("refers")))
    files = spark.read.format("binaryFile").load(arc_path).filter("length > 0")
    files = files.select(F.element_at(F.split("path", "/"), -1).alias("name"), "content")
    rows = files.join(revisits, files["name"] == revisits["archive"], "left").select("name", "content", "numbers", "refers")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name, content, numbers, refers in zip(*batch.columns, strict=True):
                known = dict(zip(numbers.as_py() or (), refers.as_py() or (), strict=True))
                out, size = [], 0
                for record in arc_records(content.as_buffer(), name.as_py()):
                    made = warc_record(described(record) | {"refers_id": known.get(record["number"])})
                    out += members(made)
                    size += len(made)
                    if size > 1 << 22:
                        yield pa.RecordBatch.from_arrays([pa.array(out, pa.binary())], ["value"])
                        out, size = [], 0
                if out:
                    yield pa.RecordBatch.from_arrays([pa.array(out, pa.binary())], ["value"])

    write_archive(rows.mapInArrow(run, "value binary"), "value", path)


def warc_records(data: bytes, name: str) -> Iterator[tuple[dict[str, str], bytes]]:
    """Header fields (lower-case names) and block of each record of a WARC file."""
    reader = Reader(unzip(data))
    while (line := reader.line()) is not None:
        if not line.strip():
            continue
        if not line.startswith(b"WARC/1."):
            raise ValueError(f"{name}: not a WARC record: {line[:80]!r}")
        fields = {}
        while line := reader.line().rstrip(b"\r"):
            key, _, value = line.partition(b":")
            fields[key.decode().strip().lower()] = value.decode("utf-8", "surrogateescape").strip()
        block = reader.block(int(fields["content-length"]))
        if f"sha256:{hashlib.sha256(block).hexdigest()}" != fields.get("warc-block-digest"):
            raise ValueError(f"{name}: the block of {fields.get('warc-record-id')} doesn't have its digest")
        yield fields, block


WARC_SCHEMA = "record_id string, record_type string, refers_id string, url string, date string, page_id long, payload binary, payload_digest string, payload_bytes long"


def read_warc(spark: SparkSession, path: str) -> DataFrame:
    """Records of all WARC files below ``path``; a revisit's payload is null, its digest and length are of the full one."""

    def read(content, name: str) -> Iterator[dict]:
        for fields, block in warc_records(content, name):
            head, gap, payload = block.partition(b"\r\n\r\n")
            if not fields["content-type"].startswith("application/http"):
                head, payload = b"", block
            revisit = fields["warc-type"] == "revisit"
            page, refers = http_field(head, b"x-page-id"), fields.get("warc-refers-to")
            length = http_field(head, b"content-length")
            yield {
                "record_id": fields["warc-record-id"].strip("<>"), "record_type": fields["warc-type"], "refers_id": refers and refers.strip("<>"), "url": fields["warc-target-uri"], "date": fields["warc-date"],
                "page_id": int(page) if page else None, "payload": None if revisit else payload, "payload_digest": fields["warc-payload-digest"].removeprefix("sha256:"), "payload_bytes": int(length or 0) if revisit else len(payload),
            }

    return _parsed(spark, path, read, WARC_SCHEMA)


def round_trip(pages: DataFrame, folder: str, **columns: str) -> DataFrame:
    """Write pages as legacy archives below ``folder``, convert those to WARC, and read the WARC files.

    Rows: page_id, payload_bytes, payload_digest, record_type, refers_to (the response's page_id). Null html
    is an empty payload; a null url becomes ``unknown:``. Repeated page ids: each row is a record; with
    equal payloads the later ones revisit the first. Empty table: no files and no rows. Other columns are
    ignored.
    """
    spark = pages.sparkSession
    write_arc(pages, f"{folder}/arc", **columns)
    convert(spark, f"{folder}/arc", f"{folder}/warc")
    warc = save(read_warc(spark, f"{folder}/warc").select("record_id", "record_type", "refers_id", "page_id", "payload_bytes", "payload_digest"))
    target = warc.filter("record_type = 'response'").select(F.col("record_id").alias("target_id"), F.col("page_id").alias("refers_to"))
    out = warc.join(target, warc["refers_id"] == target["target_id"], "left")
    return out.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")
