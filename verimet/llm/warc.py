"""A deterministic, sharded WARC writer and its reader.

Records are range-sorted by page id into shards whose borders are a function of the rows.
Each shard's task writes gzip members and starts a new file when a file's compressed
size is reached.  A file is written under a temporary name of its attempt; a second job
moves the files of the attempts that succeeded to their final names, and the manifest
(a table beside them, written last) says which files make up the archive.
"""

from __future__ import annotations

import base64
import hashlib
import os
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from verimet.llm.common import range_of, range_splits, stored

LEAST_REVISIT = 100
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
_SPACE = uuid.UUID("5e0f0b0e-0c34-4ad9-9d6e-6f4b36b6a1d7")
MANIFEST = "shard int, part int, name string, temporary string, records long, bytes long, first_id long, last_id long"
RECORDS = "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long, url string, file string, payload binary"


def _store(path: str):
    """File system and path of a URI; plain paths are local."""
    from pyarrow import fs

    return fs.FileSystem.from_uri(path if "://" in path or path.startswith("file:") else f"file://{os.path.abspath(path)}")


def described(pages: DataFrame) -> DataFrame:
    """page_id, url, payload, digest (hex) and size of each page."""
    rows = pages.select(
        F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"),
        F.coalesce(F.col("html").cast("string"), F.lit("")).cast("binary").alias("payload"))
    return rows.withColumns({"digest": F.sha2("payload", 256), "size": F.octet_length("payload").cast("long")})


def revisits(rows: DataFrame) -> DataFrame:
    """page_id, digest and original of the pages that repeat a payload: the smallest page_id that has it.

    Works on digests alone (`rows` has page_id, digest and size and should be stored); the minimum is folded before
    its shuffle and only digests that occur twice meet the rows.
    """
    large = rows.where(F.col("size") >= LEAST_REVISIT).select("page_id", "digest")
    first = large.groupBy("digest").agg(F.min("page_id").alias("original"), F.count("*").alias("n"))
    first = first.where((F.col("n") > 1) & F.col("original").isNotNull()).select("digest", "original")
    return large.join(first, "digest").where(~F.col("page_id").eqNullSafe(F.col("original"))).select("page_id", "digest", "original").distinct()


def _block(kind: str, headers: list[tuple[str, str]], block: bytes) -> bytes:
    digest = base64.b32encode(hashlib.sha1(block).digest()).decode()
    lines = ["WARC/1.1", f"WARC-Type: {kind}", *(f"{k}: {v}" for k, v in headers), f"WARC-Block-Digest: sha1:{digest}", f"Content-Length: {len(block)}"]
    return ("\r\n".join(lines) + "\r\n\r\n").encode() + block + b"\r\n\r\n"


def _uri(url: str | None, page_id) -> str:
    """A header-safe target: blanks and control characters are percent-encoded."""
    text = url if url else f"urn:page:{page_id}"
    return "".join(c if c > " " and c != "\x7f" else "".join(f"%{b:02X}" for b in c.encode()) for c in text)


def _record_id(page_id, digest: str) -> str:
    return f"<urn:uuid:{uuid.uuid5(_SPACE, f'{page_id} {digest}')}>"


def record(page_id, url, payload: bytes, digest: str, original, date: str) -> bytes:
    """One uncompressed record; a revisit holds the HTTP headers alone."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    headers = [
        ("WARC-Record-ID", _record_id(page_id, digest)), ("WARC-Date", date), ("WARC-Target-URI", _uri(url, page_id)),
        ("WARC-Payload-Digest", f"sha256:{digest}"), ("Content-Type", "application/http; msgtype=response"),
        ("X-Page-Id", "" if page_id is None else str(page_id))]
    if original is None:
        return _block("response", headers, http + payload)
    headers += [("WARC-Profile", PROFILE), ("WARC-Refers-To", _record_id(original, digest)), ("X-Refers-To-Page-Id", str(original))]
    return _block("revisit", headers, http)


def _member(data: bytes) -> bytes:
    squeeze = zlib.compressobj(6, zlib.DEFLATED, 31)
    return squeeze.compress(data) + squeeze.flush()


def write_warc(pages: DataFrame, folder: str, shard_bytes: int = 1 << 30, file_bytes: int = 256 << 20, date: str = "1970-01-01T00:00:00Z") -> DataFrame:
    """Write `pages` (page_id, url, html) to `folder`; returns the manifest, read back.

    Cases: null html is an empty payload; payloads under 100 bytes are always responses; of equal payloads
    the smallest page_id is the response; rows repeating that id are responses too; a row without id
    is written first, and as a response if no row with an id has its payload; a null
    url becomes ``urn:page:<id>``; no rows give a manifest without files; further columns are ignored.
    Rows of one page_id (or without one) that outweigh a shard go on in the next ones, by their digest.
    """
    spark = pages.sparkSession
    rows, tie = described(pages), F.conv(F.substring("digest", 1, 3), 16, 10).cast("int")
    narrow = stored(rows.select("page_id", "digest", "size"), "digests")
    cuts = range_splits(narrow.withColumn("tie", tie), "page_id", "size", shard_bytes, "tie")
    # payloads travel once; what makes a page a revisit comes as a narrow row just before it
    told = revisits(narrow).select("page_id", F.lit(None).cast("string").alias("url"), F.lit(None).cast("binary").alias("payload"), "digest", "original")
    rows = rows.select("page_id", "url", "payload", "digest", F.lit(None).cast("long").alias("original")).unionByName(told)
    rows = rows.withColumn("tie", tie).withColumn("shard", range_of("page_id", cuts, "tie")).repartitionById(len(cuts) + 1, F.col("shard"))
    rows = rows.sortWithinPartitions("shard", "page_id", "digest", F.col("payload").isNotNull(), "url")
    rows = rows.select("shard", "page_id", "url", "payload", "digest", "original")

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        attempt, done, shard, out, told = uuid.uuid4().hex, [], None, None, {}
        store, root = _store(folder)
        store.create_dir(f"{root}/_temporary", recursive=True)

        def close():
            if out is not None:
                out.close()

        def begin(number, part):
            name = f"part-{number:06d}-{part:05d}.warc.gz"
            stream = store.open_output_stream(f"{root}/_temporary/{attempt}-{name}", compression=None)
            info = f"software: verimet\r\nformat: WARC File Format 1.1\r\nisPartOf: shard {number}\r\n".encode()
            head = _member(_block("warcinfo", [
                ("WARC-Record-ID", f"<urn:uuid:{uuid.uuid5(_SPACE, name)}>"), ("WARC-Date", date), ("WARC-Filename", name),
                ("Content-Type", "application/warc-fields")], info))
            stream.write(head)
            done.append([number, part, name, f"{attempt}-{name}", 0, len(head), None, None])
            return stream

        for batch in batches:
            for row in batch.to_pylist():
                key = row["page_id"], row["digest"]
                if row["payload"] is None:
                    told = {key: row["original"]}
                    continue
                if row["shard"] != shard:
                    close()
                    shard, out = row["shard"], begin(row["shard"], 0)
                elif done[-1][5] >= file_bytes:
                    close()
                    out = begin(shard, done[-1][1] + 1)
                data = _member(record(row["page_id"], row["url"], row["payload"], row["digest"], told.get(key), date))
                out.write(data)
                last = done[-1]
                last[4], last[5], last[7] = last[4] + 1, last[5] + len(data), row["page_id"]
                last[6] = row["page_id"] if last[6] is None else last[6]
        close()
        yield _table(done)

    def _table(lines):
        kinds = [pa.int32(), pa.int32(), pa.string(), pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.int64()]
        names = [x.split()[0] for x in MANIFEST.split(", ")]
        return pa.RecordBatch.from_arrays([pa.array([x[i] for x in lines], k) for i, k in enumerate(kinds)], names=names)

    def move(batches):
        from pyarrow import fs

        store, root = _store(folder)
        for batch in batches:
            for row in batch.to_pylist():
                source, target = f"{root}/_temporary/{row['temporary']}", f"{root}/{row['name']}"
                if store.get_file_info(source).type == fs.FileType.File:
                    store.move(source, target)
                elif store.get_file_info(target).size != row["bytes"]:
                    raise OSError(f"{target} is missing or incomplete")
            yield batch

    written = f"{folder}/_written"
    rows.mapInArrow(write, MANIFEST).write.parquet(written)
    files = spark.read.schema(MANIFEST).parquet(written)
    files.repartition(max(1, min(len(cuts) + 1, 1000)), "name").mapInArrow(move, MANIFEST).write.parquet(f"{folder}/_manifest")
    return manifest(spark, folder)


def manifest(spark: SparkSession, folder: str) -> DataFrame:
    return spark.read.schema(MANIFEST).parquet(f"{folder}/_manifest").drop("temporary")


def _members(stream, chunk: int = 1 << 20) -> Iterator[bytes]:
    """The gzip members of a stream, one at a time."""
    rest = b""
    while True:
        if not rest:
            rest = stream.read(chunk)
            if not rest:
                return
        inflate, parts = zlib.decompressobj(31), []
        while not inflate.eof:
            if not rest:
                rest = stream.read(chunk)
                if not rest:
                    raise OSError("a gzip member is cut off")
            parts.append(inflate.decompress(rest))
            rest = inflate.unused_data
        yield b"".join(parts)


def _parsed(data: bytes):
    head, _, rest = data.partition(b"\r\n\r\n")
    lines = head.decode().split("\r\n")
    if lines[0] != "WARC/1.1":
        raise OSError("not a WARC record")
    fields = dict(line.split(": ", 1) if ": " in line else (line.rstrip(":"), "") for line in lines[1:])
    block = rest[:int(fields["Content-Length"])]
    if fields["WARC-Block-Digest"] != "sha1:" + base64.b32encode(hashlib.sha1(block).digest()).decode():
        raise OSError(f"block digest of {fields['WARC-Record-ID']} differs")
    return fields, block


def read_warc(spark: SparkSession, folder: str, payloads: bool = True) -> DataFrame:
    """The records of the files that the manifest lists; digests and lengths are checked.

    A revisit has no payload of its own; its length and digest are those of the page it refers to.
    """
    files = manifest(spark, folder)
    names = [x.split()[0] for x in RECORDS.split(", ")]
    kinds = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.string(), pa.string(), pa.binary()]

    def read(batches):
        store, root = _store(folder)

        def table(rows):
            return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], k) for i, k in enumerate(kinds)], names=names)

        for batch in batches:
            for name in batch.column(0).to_pylist():
                rows, held = [], 0
                with store.open_input_stream(f"{root}/{name}", compression=None) as stream:
                    for data in _members(stream):
                        fields, block = _parsed(data)
                        if fields["WARC-Type"] == "warcinfo":
                            continue
                        http, _, payload = block.partition(b"\r\n\r\n")
                        size = int(http.rpartition(b"Content-Length: ")[2])
                        digest = fields["WARC-Payload-Digest"].removeprefix("sha256:")
                        if fields["WARC-Type"] == "response" and (len(payload) != size or hashlib.sha256(payload).hexdigest() != digest):
                            raise OSError(f"payload of {fields['WARC-Record-ID']} differs from its digest")
                        ids = [int(fields[k]) if fields.get(k) else None for k in ("X-Page-Id", "X-Refers-To-Page-Id")]
                        rows.append((ids[0], size, digest, fields["WARC-Type"], ids[1], fields["WARC-Target-URI"], name,
                                     payload if payloads and fields["WARC-Type"] == "response" else None))
                        held += len(payload) if payloads else 200
                        if held > 8 << 20:
                            yield table(rows)
                            rows, held = [], 0
                yield table(rows)

    spread = max(1, spark.sparkContext.defaultParallelism)
    return files.select("name").repartition(spread, "name").mapInArrow(read, RECORDS)
