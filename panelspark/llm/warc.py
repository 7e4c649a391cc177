"""WARC archives: a writer of gzip members and a splittable reader of byte ranges."""

from __future__ import annotations

import base64
import hashlib
import uuid
import zlib
from collections.abc import Iterator

import pandas as pd
from pyarrow import fs as pafs
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from panelspark.llm.workspace import Workspace

#: Fixed formats of the archive standard.
VERSION = b"WARC/1.1\r\n"
MAGIC = b"\x1f\x8b\x08"
REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
HEAD_BYTES = 1 << 16
READ_BYTES = 1 << 20

RECORD_SCHEMA = "record_id string, record_type string, target_uri string, refers_to_id string, payload_digest string, payload_bytes bigint, payload binary, path string, offset bigint"


def _clean(value: str) -> str:
    return "".join(ch if ch not in "\r\n" else "%0D" if ch == "\r" else "%0A" for ch in value)


def payload_digest(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def record_bytes(record_id: str, uri: str | None, payload: bytes, refers_to: str | None) -> bytes:
    """One archive record. A revisit carries the HTTP head of its capture (with the payload's length), no payload."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http + (b"" if refers_to else payload)
    head = [f"WARC-Type: {'revisit' if refers_to else 'response'}", f"WARC-Record-ID: <{record_id}>", "WARC-Date: 1970-01-01T00:00:00Z"]
    if uri is not None:
        head.append(f"WARC-Target-URI: {_clean(uri)}")
    if refers_to:
        head += [f"WARC-Refers-To: <{refers_to}>", f"WARC-Profile: {REVISIT_PROFILE}"]
    head += [f"WARC-Payload-Digest: sha1:{payload_digest(payload)}", "Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}"]
    return VERSION + "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def write_archives(records: DataFrame, folder: str, level: int = 6) -> DataFrame:
    """records (record_id, uri, payload binary, refers_to) -> manifest (path, bytes, records) of one archive a task.

    Each task attempt writes a file of its own name, and only the manifest of attempts that ended is read later, so a
    lost executor or a second attempt leaves no doubled records."""

    def run(batches):
        out, path, count, size = None, f"{folder}/{uuid.uuid4().hex}.warc.gz", 0, 0
        for pdf in batches:
            for rid, uri, payload, ref in zip(pdf["record_id"], pdf["uri"], pdf["payload"], pdf["refers_to"], strict=True):
                if out is None:
                    system, where = pafs.FileSystem.from_uri(path)
                    system.create_dir(where.rsplit("/", 1)[0], recursive=True)
                    out = system.open_output_stream(where, compression=None)
                packer = zlib.compressobj(level, zlib.DEFLATED, 31)
                member = packer.compress(record_bytes(rid, uri, bytes(payload), ref)) + packer.flush()
                out.write(member)
                count, size = count + 1, size + len(member)
        if out is not None:
            out.close()
            yield pd.DataFrame({"path": [path], "bytes": [size], "records": [count]})

    return records.select("record_id", "uri", "payload", "refers_to").mapInPandas(run, "path string, bytes bigint, records bigint")


def _head(data: bytes) -> dict[str, str] | None:
    """Header fields if data begins with a whole record head, else None."""
    if not data.startswith(b"WARC/1."):
        return None
    end = data.find(b"\r\n\r\n")
    if end < 0:
        return None
    fields = {}
    for line in data[:end].split(b"\r\n")[1:]:
        name, colon, value = line.partition(b":")
        if not colon:
            return None
        fields[name.strip().lower().decode("latin-1")] = value.strip().decode("utf-8", "replace")
    ok = {"warc-type", "warc-record-id", "content-length"} <= fields.keys() and fields["content-length"].isdigit()
    return fields | {"": str(end + 4)} if ok else None


class _Window:
    """A file read forward in steps; bytes before the scan position are let go."""

    def __init__(self, file, at: int):
        self.file, self.base, self.data, self.end = file, at, b"", False
        file.seek(at)

    def more(self) -> bool:
        piece = self.file.read(READ_BYTES)
        self.end = not piece
        self.data += piece
        return bool(piece)

    def drop(self, at: int) -> None:
        if at - self.base > 0:
            self.data, self.base = self.data[at - self.base :], at


def _member(window: _Window, at: int) -> tuple[bytes, int] | None:
    """The decoded member at the offset and the offset of its end; None if no whole record stands there. The first bytes
    must decode to a record head before the rest is read."""
    unpack, parts, checked, pos = zlib.decompressobj(31), [], False, at
    size = 0
    while not unpack.eof:
        while pos - window.base >= len(window.data):
            if not window.more():
                return None
        piece = window.data[pos - window.base : pos - window.base + (4096 if not checked else READ_BYTES)]
        try:
            parts.append(unpack.decompress(piece))
        except zlib.error:
            return None
        pos += len(piece)
        size += len(parts[-1])
        if not checked:
            head = b"".join(parts)
            if not head.startswith(VERSION[: len(head)][:7]):
                return None
            if _head(head) is not None:
                checked = True
            elif size > HEAD_BYTES:
                return None
    data = b"".join(parts)
    return (data, pos - len(unpack.unused_data)) if _head(data) is not None else None


def read_range(path: str, start: int, stop: int) -> Iterator[tuple]:
    """Records whose member starts in [start, stop). A candidate (the gzip magic) counts only if it decodes to a whole
    record and is followed by another magic or the end of the file, so payload bytes that look like a member do not."""
    system, where = pafs.FileSystem.from_uri(path)
    with system.open_input_file(where) as file:
        window, at = _Window(file, start), start
        while at < stop:
            window.drop(at)
            hit = window.data.find(MAGIC, at - window.base)
            if hit < 0:
                at = max(at, window.base + len(window.data) - 2)
                if not window.more():
                    return
                continue
            at = window.base + hit
            if at >= stop:
                return
            found = _member(window, at)
            if found is not None:
                data, end = found
                while end - window.base + 3 > len(window.data) and not window.end:
                    window.more()
                after = window.data[end - window.base : end - window.base + 3]
                if after in (b"", MAGIC):
                    yield at, data
                    at = end
                    continue
            at += 1


def parse_record(data: bytes) -> dict:
    fields = _head(data)
    start = int(fields[""])
    block = data[start : start + int(fields["content-length"])]
    head, gap, payload = block.partition(b"\r\n\r\n")
    length = next((int(x.split(b":")[1]) for x in head.split(b"\r\n") if x.lower().startswith(b"content-length:")), len(payload))
    response = fields["warc-type"] == "response"
    strip = lambda x: x.strip("<>") if x else None
    return {
        "record_id": strip(fields["warc-record-id"]), "record_type": fields["warc-type"], "target_uri": fields.get("warc-target-uri"), "refers_to_id": strip(fields.get("warc-refers-to")),
        "payload_digest": payload_digest(payload) if response else fields.get("warc-payload-digest", "").removeprefix("sha1:"), "payload_bytes": len(payload) if response else length, "payload": payload if response else None,
    }


def read_archives(spark: SparkSession, manifest: DataFrame, split_bytes: int = 64 << 20, with_payload: bool = True) -> DataFrame:
    """manifest (path, bytes) -> one row a record (RECORD_SCHEMA). Each archive is cut into byte ranges, dealt over the
    tasks; a range owns the records that start in it. Memory: one record and a read buffer a task."""

    def run(batches):
        for pdf in batches:
            for path, start, stop in zip(pdf["path"], pdf["start"], pdf["stop"], strict=True):
                rows, size = [], 0
                for offset, data in read_range(path, int(start), int(stop)):
                    row = parse_record(data) | {"path": path, "offset": offset}
                    if not with_payload:
                        row["payload"] = None
                    rows.append(row)
                    size += len(row["payload"] or b"") + 500
                    if size > 8 << 20:
                        yield pd.DataFrame(rows)[columns]
                        rows, size = [], 0
                if rows:
                    yield pd.DataFrame(rows)[columns]

    columns = [x.split()[0] for x in RECORD_SCHEMA.split(", ")]
    cuts = manifest.where("bytes > 0").select("path", "bytes", F.explode(F.sequence(F.lit(0), F.col("bytes") - 1, F.lit(split_bytes))).alias("start"))
    cuts = cuts.select("path", "start", F.least(F.col("start") + split_bytes, "bytes").alias("stop"))
    return cuts.repartition(max(1, cuts.count())).mapInPandas(run, RECORD_SCHEMA)  # a number: else these few rows are put into one task


def with_revisits(pages: DataFrame, id_col: str, payload_col: str, least_bytes: int = 0) -> DataFrame:
    """pages plus payload (UTF-8 bytes; null is empty) and refers_to: the smallest id of an equal payload, null for one row of that
    id, the first by url (further rows of the id refer to it). Payloads under least_bytes refer to nothing. Null ids refer to
    the smallest id of equal payloads; where all are null, there is no name to refer to and refers_to is null. Very long payloads
    are hashed whole.

    Equality is by length and SHA-1. Digests are grouped with partial aggregation; only those that stand under several
    ids are joined back, and both sides are plain shuffles, so a payload that a third of the rows share is split."""
    slim = pages.select(F.col(id_col).alias("__first"), F.sha1(F.coalesce(F.encode(payload_col, "UTF-8"), F.lit(b""))).alias("__sha"), F.coalesce(F.octet_length(payload_col), F.lit(0)).alias("__len"))
    ids = slim.groupBy("__sha", "__len", "__first").agg(F.count(F.lit(1)).alias("__c"))
    groups = ids.groupBy("__sha", "__len").agg(F.min("__first").alias("__first"), F.sum("__c").alias("__n"), F.min_by("__c", "__first").alias("__tied"))
    groups = Workspace(pages.sparkSession).save(groups.where(f"__n > 1 and __len >= {least_bytes}").drop("__n"), "repeated")
    out = pages.withColumn("payload", F.coalesce(F.encode(payload_col, "UTF-8"), F.lit(b""))).withColumn("__sha", F.sha1("payload")).withColumn("__len", F.octet_length("payload"))
    out = out.join(groups, ["__sha", "__len"], "left")
    refers = F.when(F.col(id_col).isNull() | (F.col(id_col) > F.col("__first")), F.col("__first"))
    out = out.withColumn("refers_to", refers)
    if groups.where("__tied > 1").limit(1).count():  # several rows of the smallest id: the first by url answers, the others refer to it
        tied = (F.col("__tied") > 1) & (F.col(id_col) == F.col("__first"))
        w = Window.partitionBy("__sha", "__len").orderBy(*[c for c in pages.columns if c not in (id_col, payload_col)])
        rows = out.where(tied).withColumn("__n", F.row_number().over(w)).withColumn("refers_to", F.when(F.col("__n") > 1, F.col("__first"))).drop("__n")
        out = out.where(~F.coalesce(tied, F.lit(False))).unionByName(rows)
    return out.drop("__sha", "__len", "__first", "__tied")


def archive_pages(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", payload_col: str = "html", least_bytes: int = 0, split_bytes: int = 64 << 20, with_payload: bool = True) -> DataFrame:
    """Writes pages as archives in the shared folder and reads them back: one row a record (RECORD_SCHEMA plus page_id,
    refers_to as ids). Repeated rows give a record each; a null url has no target, a null payload is empty, very long ones are
    archived whole; further columns are ignored; an empty table gives no records."""
    spark, ws = pages.sparkSession, Workspace(pages.sparkSession)
    slim = with_revisits(pages.select(id_col, url_col, payload_col), id_col, payload_col, least_bytes)
    name = lambda c: F.concat(F.lit("urn:page:"), F.coalesce(F.col(c).cast("string"), F.lit("null")))
    records = slim.select(name(id_col).alias("record_id"), F.col(url_col).alias("uri"), "payload", F.when(F.col("refers_to").isNotNull(), name("refers_to")).alias("refers_to"))
    manifest = ws.save(write_archives(records, ws.folder("archives")), "manifest")
    back = read_archives(spark, manifest, split_bytes, with_payload)
    number = lambda c: F.expr(f"try_cast(substring({c}, 10) as bigint)")
    return back.withColumn("page_id", number("record_id")).withColumn("refers_to", number("refers_to_id"))
