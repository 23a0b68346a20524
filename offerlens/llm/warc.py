"""WARC archives: index first, then coalesced byte-range reads.

``write`` makes gzip-member-per-record WARC 1.1 files in a folder and returns the index as a table: file, offset, length,
URL, digest and record type of every record, written in the same pass. ``read`` takes any selection of index rows, deals
them out by archive bytes (the number of tasks is set, since the index rows are small whatever they stand for), puts them in file order, joins ranges
that lie close together into one read, and parses the records; payload digests are checked on the way.

Equal payloads: the record with the smallest ``page_id`` is the response, the others are revisit records (identical payload
digest profile) that carry the response's headers but no payload. Which is which is a partial minimum by digest and a join,
so a payload that a third of all pages share is no large group.

Files come from ``pyarrow.fs`` (local, s3, gs, hdfs). A task names its files after itself and its attempt; only files that
the committed index names count, so lost executors and repeated attempts leave no wrong records.

Defined results: a null html is an empty payload; a null url is left out of the record and read as null (line breaks in one are percent-encoded); among rows that
repeat with the same ``page_id`` and payload all are of one type (responses if theirs is the smallest id); a null ``page_id``
revisits the smallest id of its payload, or is a response if all are null; an empty table gives an empty index.
Extra columns of ``pages`` are ignored.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import uuid
from collections.abc import Iterator

import pandas as pd
import pyarrow.fs
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import shared_dir, staged

INDEX = "file string, offset long, length long, page_id long, url string, payload_digest string, payload_bytes long, record_type string, refers_to long"
RECORD = "page_id long, url string, record_type string, refers_to long, payload_bytes long, payload_digest string, payload binary"
FILE_BYTES = 1 << 30
#: Ranges are read together if at most GAP bytes lie between them and they span at most SPAN bytes.
GAP, SPAN = 64 << 10, 8 << 20
#: Records are dealt to tasks by stretches of BIN bytes of a file, so that a task reads about TASK bytes.
BIN, TASK = 16 << 20, 128 << 20
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


def bare_sha1(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def record(page_id, url, payload: bytes, refers_to, date: str, least_revisit: int = 0) -> tuple[bytes, str]:
    """The gzip member of one record, and its payload's digest."""
    digest = bare_sha1(payload)
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload)
    block = http if refers_to is not None else http + payload
    name = "" if page_id is None else str(page_id)
    head = [
        "WARC/1.1",
        f"WARC-Type: {'response' if refers_to is None else 'revisit'}",
        f"WARC-Record-ID: <urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'{name} {url} {digest}')}>",
        f"WARC-Date: {date}",
        "Content-Type: application/http;msgtype=response",
        f"WARC-Payload-Digest: sha1:{digest}",
        f"Content-Length: {len(block)}",
        f"X-Page-Id: {name}",
    ]
    if url is not None:
        head.append("WARC-Target-URI: " + url.replace("\r", "%0D").replace("\n", "%0A"))
    if refers_to is not None:
        head += [f"WARC-Profile: {PROFILE}", f"X-Refers-To-Page-Id: {refers_to}"]
    return gzip.compress("\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n", 6, mtime=0), digest


def parse(member: bytes) -> dict:
    """The fields of one gzip member; a response's payload is held against its digest."""
    raw = gzip.decompress(member)
    top, _, rest = raw.partition(b"\r\n\r\n")
    fields = dict(line.split(": ", 1) if ": " in line else (line.rstrip(":"), "") for line in top.decode().split("\r\n")[1:])
    block = rest[: int(fields["Content-Length"])]
    http, _, payload = block.partition(b"\r\n\r\n")
    size = int(http.rpartition(b"Content-Length: ")[2].split(b"\r\n")[0])
    digest = fields["WARC-Payload-Digest"].removeprefix("sha1:")
    revisit = fields["WARC-Type"] == "revisit"
    if not revisit and (bare_sha1(payload) != digest or len(payload) != size):
        raise ValueError(f"payload of record {fields['WARC-Record-ID']} doesn't have its digest")
    number = lambda x: int(x) if x else None
    return {"page_id": number(fields["X-Page-Id"]), "url": fields.get("WARC-Target-URI"), "record_type": fields["WARC-Type"], "refers_to": number(fields.get("X-Refers-To-Page-Id")), "payload_bytes": size, "payload_digest": digest, "payload": None if revisit else payload}


def with_revisits(pages: DataFrame, least_revisit: int = 0) -> DataFrame:
    """page_id, url, payload and refers_to (null for responses)."""
    p = pages.select(pages["page_id"].cast("long").alias("page_id"), pages["url"].cast("string").alias("url"), F.coalesce(pages["html"].cast("string"), F.lit("")).cast("binary").alias("payload"))
    p = p.withColumn("key", F.unhex(F.sha2("payload", 256)))
    shared = p.filter(F.length("payload") >= least_revisit).groupBy("key").agg(F.min("page_id").alias("first"), F.count("*").alias("n")).filter("n > 1").drop("n")
    refers = F.when(~F.col("page_id").eqNullSafe(F.col("first")), F.col("first"))
    shared = staged(shared, "shared-payloads")  # read from a table, so that Spark splits a payload's pages if they are many
    return p.join(shared, "key", "left").select("page_id", "url", "payload", refers.alias("refers_to"))


def write(pages: DataFrame, folder: str, date: str = "2024-01-01T00:00:00Z", least_revisit: int = 0) -> DataFrame:
    """Writes the archives below ``folder`` and returns their index (a table in ``folder``)."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        context = TaskContext.get()
        name = f"part-{context.partitionId():06d}-{context.taskAttemptId()}-{uuid.uuid4().hex[:8]}"
        fs, root = pyarrow.fs.FileSystem.from_uri(folder)
        fs.create_dir(root, recursive=True)
        out, file, at, n = None, "", 0, 0
        try:
            for batch in batches:
                rows = []
                for page_id, url, payload, refers in zip(batch["page_id"], batch["url"], batch["payload"], batch["refers_to"], strict=True):
                    if out is None or at >= FILE_BYTES:
                        if out is not None:
                            out.close()
                        file, at, n = f"{name}-{n}.warc.gz", 0, n + 1
                        out = fs.open_output_stream(f"{root}/{file}", compression=None)
                    page_id, refers = (None if pd.isna(x) else int(x) for x in (page_id, refers))
                    member, digest = record(page_id, url, payload, refers, date)
                    out.write(member)
                    rows.append((file, at, len(member), page_id, url, digest, len(payload), "response" if refers is None else "revisit", refers))
                    at += len(member)
                yield pd.DataFrame(rows, columns=[c.split()[0] for c in INDEX.split(", ")]).astype({"page_id": "Int64", "refers_to": "Int64"})
        finally:
            if out is not None:
                out.close()

    index = with_revisits(pages, least_revisit).mapInPandas(run, INDEX)
    index.write.parquet(f"{folder}/index")
    return pages.sparkSession.read.schema(INDEX).parquet(f"{folder}/index")


def tasks_for(selected: DataFrame, bin_bytes: int, task_bytes: int) -> int:
    """How many tasks read the selected ranges: ``task_bytes`` for each, but no fewer than there are cores as long as the stretches suffice."""
    total = selected.agg(F.coalesce(F.sum("length"), F.lit(0))).first()[0]
    bins = selected.select("file", (F.col("offset") / bin_bytes).cast("long").alias("bin")).distinct().count()
    return max(1, -(-total // task_bytes), min(bins, selected.sparkSession.sparkContext.defaultParallelism))


def read(index: DataFrame, folder: str, bin_bytes: int = BIN, task_bytes: int = TASK) -> DataFrame:
    """The records of the selected rows of ``index``."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        fs, root = pyarrow.fs.FileSystem.from_uri(folder)
        for batch in batches:
            rows, files = [], {}
            places = list(zip(batch["file"], batch["offset"], batch["length"], strict=True))
            i = 0
            while i < len(places):
                file, start, length = places[i]
                j, end = i + 1, start + length
                while j < len(places) and places[j][0] == file and places[j][1] <= end + GAP and places[j][1] + places[j][2] - start <= SPAN:
                    end = max(end, places[j][1] + places[j][2])
                    j += 1
                if file not in files:
                    for f in files.values():
                        f.close()
                    files = {file: fs.open_input_file(f"{root}/{file}")}
                files[file].seek(start)
                data = files[file].read(end - start)
                rows += [parse(data[a - start : a - start + n]) for _, a, n in places[i:j]]
                i = j
            for f in files.values():
                f.close()
            yield pd.DataFrame(rows, columns=[c.split()[0] for c in RECORD.split(", ")]).astype({"page_id": "Int64", "refers_to": "Int64"})

    selected = index.select("file", "offset", "length")
    dealt = selected.repartition(tasks_for(selected, bin_bytes, task_bytes), "file", (F.col("offset") / bin_bytes).cast("long"))
    return dealt.sortWithinPartitions("file", "offset").mapInPandas(run, RECORD)


def archive(pages: DataFrame, least_revisit: int = 0) -> DataFrame:
    """Writes all of ``pages`` to a new folder of the shared place and reads every record back."""
    folder = shared_dir(pages.sparkSession, "warc")
    return read(write(pages, folder, least_revisit=least_revisit), folder)
