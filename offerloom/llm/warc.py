"""WARC archives with revisit records for payloads that were seen before."""

from __future__ import annotations

import gzip
import io
import math
import re
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import hot_limit, join_one_row_per_key, materialize, ship_package

#: Payloads below this many bytes are stored again and not referred to.
LEAST_BYTES = 100
#: About how many bytes of records an archive file holds.
FILE_BYTES = 32 << 20
END = "\r\n\r\n"


def resolve_revisits(headers: DataFrame, least_bytes: int = LEAST_BYTES) -> DataFrame:
    """Decide which records are responses and which revisit another.

    Takes headers (page_id bigint, payload_bytes bigint, payload_digest string)
    and returns them with (record_type, refers_to). Of records with one digest
    and at least ``least_bytes``, the smallest page_id is the response. Rows
    that repeat that id are responses too; a null id is never referred to, and
    records of which all ids are null are responses. Headers alone are shuffled,
    by digest; a digest with a large share of them is dealt out.
    """
    headers = headers.withColumn("__key", F.when(F.col("payload_bytes") >= least_bytes, F.xxhash64("payload_digest")))
    firsts = headers.filter("__key IS NOT NULL").groupBy("__key", "payload_digest").agg(F.min("page_id").alias("first"), F.count(F.lit(1)).alias("copies")).filter("copies > 1")
    # short payloads have no partner; they are dealt out by a key of their own
    dealt = headers.withColumn("__key", F.coalesce("__key", F.xxhash64("page_id", "payload_digest")))
    joined = join_one_row_per_key(dealt, firsts, ["__key", "payload_digest"], "copies", hot_limit(headers.count()), "page_id", how="left")
    again = (F.col("payload_bytes") >= least_bytes) & F.col("first").isNotNull() & ~F.col("first").eqNullSafe(F.col("page_id"))
    return joined.select("page_id", "payload_bytes", "payload_digest", F.when(again, "revisit").otherwise("response").alias("record_type"), F.when(again, F.col("first")).alias("refers_to"))


def _identity(page: F.Column, digest: F.Column) -> F.Column:
    return F.concat(F.lit("<urn:pages:"), F.coalesce(page.cast("string"), F.lit("null")), F.lit(":"), F.substring(digest, 1, 16))


def _record(date: str) -> F.Column:
    """The text of a record up to the two line ends that close it."""
    nl = F.lit("\r\n")
    uri = F.regexp_replace(F.coalesce("url", F.lit("")), "[\\x00-\\x20\\x7F]", "%20")
    identity = lambda page, digest: F.concat(_identity(page, digest), F.lit(">"))
    response = F.col("record_type") == "response"
    http = F.concat(F.lit("HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: "), F.octet_length("payload").cast("string"), F.lit(END), F.col("payload"))
    body = F.when(response, http).otherwise("")
    refers = F.when(response, "").otherwise(F.concat(F.lit("WARC-Refers-To: "), identity(F.col("refers_to"), F.col("payload_digest")), nl, F.lit("WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest\r\n")))
    head = F.concat(
        F.lit("WARC/1.1\r\nWARC-Type: "), F.col("record_type"), nl,
        F.lit("WARC-Record-ID: "), identity(F.col("page_id"), F.col("payload_digest")), nl,
        F.lit("WARC-Date: "), F.lit(date), nl,
        F.lit("WARC-Target-URI: "), uri, nl,
        F.lit("WARC-Payload-Digest: sha256:"), F.col("payload_digest"), nl,
        refers,
        F.lit("Content-Type: application/http;msgtype=response\r\nContent-Length: "), F.octet_length(body).cast("string"),
    )
    return F.concat(head, F.lit(END), body, F.lit(END))


def _store(path: str) -> tuple[fs.FileSystem, str]:
    """The file system of a path or URI and the folder there, made if need be."""
    store, folder = fs.FileSystem.from_uri(path) if re.match("[a-z0-9+]+:", path) else (fs.LocalFileSystem(), path)
    store.create_dir(folder, recursive=True)
    return store, folder


def _writer(path: str, date: str):
    """Write each partition's records to a file, a gzip member for each, so that
    one can be read by itself. A file takes its name when it is whole; a task
    that is run again writes the same one."""
    schema = pa.schema([("file", pa.string()), ("records", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        context = TaskContext.get()
        store, folder = _store(path)
        name = f"part-{context.partitionId():06d}.warc.gz"
        at, seen = f"{folder}/_{name}.{context.taskAttemptId()}", Counter()
        info = b"software: offerloom\r\nformat: WARC File Format 1.1\r\n"
        first = f"WARC/1.1\r\nWARC-Type: warcinfo\r\nWARC-Record-ID: <urn:file:{name}>\r\nWARC-Date: {date}\r\nWARC-Filename: {name}\r\nContent-Type: application/warc-fields\r\nContent-Length: {len(info)}{END}".encode()
        with store.open_output_stream(at, compression=None) as out:
            out.write(gzip.compress(first + info + END.encode(), 6, mtime=0))
            for batch in batches:
                for identity, record in zip(batch.column("identity").to_pylist(), batch.column("value")):
                    # rows that repeat a page and payload are in one file
                    n = seen[identity] = seen[identity] + 1
                    raw = record.as_py().encode()
                    if n > 1:
                        raw = raw.replace(f"{identity}>".encode(), f"{identity}:{n}>".encode(), 1)
                    out.write(gzip.compress(raw, 6, mtime=0))
        store.move(at, f"{folder}/{name}")
        yield pa.RecordBatch.from_arrays([pa.array([name]), pa.array([seen.total()], pa.int64())], schema=schema)

    return run


def write_warc(pages: DataFrame, path: str, least_bytes: int = LEAST_BYTES, date: str = "2024-01-01T00:00:00Z", file_bytes: int = FILE_BYTES) -> None:
    """Write one record for each row of (page_id, url, html) under ``path``.

    The payload is the html in UTF-8, empty where null. Records that revisit
    another have no block; those of a response are a header and the payload.
    Each record is a gzip member with an id of its own, each file begins with a
    warcinfo record. ``path`` is in a folder that all executors see, or a URI
    that pyarrow opens (hdfs, s3, gs). Pages are dealt to as many files as their
    bytes call for.
    """
    ship_package(pages.sparkSession)
    _store(path)
    pages = pages.select(F.col("page_id").cast("bigint").alias("page_id"), "url", F.coalesce("html", F.lit("")).alias("payload"))
    digest = F.sha2(F.encode("payload", "UTF-8"), 256)
    headers = pages.select("page_id", F.octet_length("payload").cast("bigint").alias("payload_bytes"), digest.alias("payload_digest"))
    decided = materialize(resolve_revisits(materialize(headers, "headers"), least_bytes), "revisits")
    size = decided.agg(F.sum(F.when(F.col("record_type") == "response", F.col("payload_bytes")).otherwise(0) + 500)).first()[0] or 0
    revisits = decided.filter("record_type = 'revisit'").select("page_id", "payload_digest", "refers_to").distinct()
    own = pages.withColumn("payload_digest", digest)
    # one shuffle of the payloads serves both the join and the files
    pair = F.concat_ws(":", F.coalesce(F.col("page_id").cast("string"), F.lit("null")), "payload_digest").alias("pair")
    files = math.ceil(size / file_bytes)
    # with fewer files than a join is dealt to, Spark deals once more; then its
    # own number is taken, of which it makes fewer, larger ones
    number = [files] if files > int(pages.sparkSession.conf.get("spark.sql.shuffle.partitions")) else []
    records = own.select(pair, "*").repartition(*number, "pair").join(revisits.select(pair, "refers_to").repartition(*number, "pair"), "pair", "left")
    records = records.select("page_id", "url", F.when(F.col("refers_to").isNull(), F.col("payload")).otherwise("").alias("payload"), "payload_digest", "refers_to")
    records = records.withColumn("record_type", F.when(F.col("refers_to").isNull(), "response").otherwise("revisit"))
    named = records.select(_identity(F.col("page_id"), F.col("payload_digest")).alias("identity"), _record(date).alias("value"))
    materialize(named.mapInArrow(_writer(path, date), "file string, records bigint"), "warc-files")


def _parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    schema = pa.schema([(c, pa.string()) for c in ("record_id", "record_type", "url", "digest", "refers")] + [("payload", pa.binary())])
    names = {b"warc-record-id": 0, b"warc-type": 1, b"warc-target-uri": 2, b"warc-payload-digest": 3, b"warc-refers-to": 4}

    def batch(rows):
        return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), schema)], schema=schema)

    for b in batches:
        for content in b.column("content"):
            data, at, rows, held = memoryview(content.as_buffer()), 0, [], 0
            if bytes(data[:2]) == b"\x1f\x8b":
                # a reader goes from member to member without copying the rest
                data = memoryview(gzip.GzipFile(fileobj=io.BytesIO(data)).read())
            while at < len(data):
                stop, step = -1, 4096
                while stop < 0:  # headers are short; look no further than need be
                    if (stop := bytes(data[at : at + step]).find(END.encode())) < 0 and at + step >= len(data):
                        raise ValueError("a WARC record has no end of headers")
                    step *= 4
                row, length, http = [None] * 5, 0, False
                for line in bytes(data[at : at + stop]).split(b"\r\n")[1:]:
                    name, _, value = line.partition(b":")
                    if (name := name.lower()) in names:
                        row[names[name]] = value.strip().decode()
                    elif name == b"content-length":
                        length = int(value)
                    elif name == b"content-type":
                        http = value.strip().startswith(b"application/http")
                start = at + stop + 4
                block = bytes(data[start : start + length])
                rows.append((*row, block.partition(END.encode())[2] if http else block))
                at, held = start + length + 4, held + length
                if held > 4 << 20 or len(rows) >= 2000:
                    yield batch(rows)
                    rows, held = [], 0
            if rows:
                yield batch(rows)


def read_warc(spark: SparkSession, path: str) -> DataFrame:
    """(record_id, record_type, url, digest, refers, payload binary) of each
    record, in no order. Blocks are taken by their Content-Length, whatever they
    contain; the header of an HTTP response is left out. A file is read in one
    task, so its size bounds the memory."""
    ship_package(spark)
    files = spark.read.format("binaryFile").load(path).filter("length > 0").select("content")
    return files.mapInArrow(_parse, "record_id string, record_type string, url string, digest string, refers string, payload binary")


def read_pages(spark: SparkSession, path: str) -> DataFrame:
    """Headers of the pages in archives of write_warc(), revisits resolved.

    Returns (page_id, payload_bytes, payload_digest, record_type, refers_to,
    url). Sizes and digests are computed from the stored payloads; a revisit
    takes those of the response that its record refers to, found by record id.
    """
    records = read_warc(spark, path)
    page = lambda c: F.expr(f"try_cast(nullif(split_part({c}, ':', 3), 'null') AS bigint)")
    head = records.select("record_id", "record_type", "url", "refers", page("record_id").alias("page_id"), page("refers").alias("refers_to"), F.octet_length("payload").cast("bigint").alias("bytes"), F.sha2("payload", 256).alias("sha"))
    head = materialize(head, "archive")
    responses, revisits = head.filter("record_type = 'response'"), head.filter("record_type = 'revisit'")
    referred = revisits.groupBy("refers").agg(F.count(F.lit(1)).alias("n"))
    original = referred.join(responses.groupBy(F.col("record_id").alias("refers")).agg(F.first("bytes").alias("payload_bytes"), F.first("sha").alias("payload_digest")), "refers")
    original = original.withColumn("__key", F.xxhash64("refers"))
    resolved = join_one_row_per_key(revisits.withColumn("__key", F.xxhash64("refers")), original, ["__key", "refers"], "n", hot_limit(head.count()), "record_id", how="left")
    columns = ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "url"]
    return responses.withColumnsRenamed({"bytes": "payload_bytes", "sha": "payload_digest"}).select(columns).union(resolved.select(columns))
