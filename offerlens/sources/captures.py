"""Captured replies as a Spark data source: ``spark.read.format("captures")`` and ``spark.readStream.format("captures")``.

A folder of captures holds ``source=<s>/kind=<k>/<file>`` (below it any folders may follow), each file with a JSON object a line: request_key, status,
final_url, headers and body; ``.gz`` files are read too. Folders are read through ``pyarrow.fs`` (``file:``, ``s3:``, ``gs:``, ``hdfs:`` or a plain path).

* Options ``source`` and ``kind`` (names with commas between) choose folders before any file is listed; ``Folder`` hands them to each retailer's parser.
* With the option ``pushdown`` and ``spark.sql.python.filterPushdown.enabled`` equality, null-safe equality and ``IN`` on source and kind do the same, and on
  request_key are decided line by line in the reader; other filters are left to Spark. Spark 4.1 keeps one pushed reader for a loaded frame, so a
  frame loaded with ``pushdown`` must be scanned once in a plan (a union of two filters of it would read one of them twice); hence it isn't the default.
* Partitions are byte ranges of one source and kind: large plain files are split at line ends, small files share a partition (option ``splitBytes``).
* A line that is no JSON object, and a file that can't be read (on), give a row that states ``error``, with the columns that are known; the task goes on.
* A stream takes files in order of change time and path; only files that are ``settleSeconds`` old are taken, so that one
  renamed late isn't passed over; ``filesPerBatch`` bounds a batch. An offset is the last file's time and path, so it holds over restarts.
"""

from __future__ import annotations

import gzip
import io
import json
import time
from collections.abc import Iterable, Iterator, Mapping
from dataclasses import dataclass
from urllib.parse import unquote

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, EqualNullSafe, EqualTo, Filter, In, InputPartition

from ..schemas import PAYLOADS

CAPTURES = f"{PAYLOADS}, capture_file string, capture_line long, error string"
ARROW = pa.schema(
    [("source", pa.string()), ("kind", pa.string()), ("request_key", pa.string()), ("status", pa.int32()), ("final_url", pa.string()), ("headers", pa.map_(pa.string(), pa.string())), ("body", pa.string()), ("capture_file", pa.string()), ("capture_line", pa.int64()), ("error", pa.string())]
)
SPLIT, ROWS, BATCH_BYTES = 64 << 20, 2048, 16 << 20


@dataclass
class Range(InputPartition):
    """Pieces (path, first byte, byte after the last) of files of one source and kind; a piece has the lines that begin in it."""

    source: str
    kind: str
    pieces: list[tuple[str, int, int]]


def opened(path: str) -> tuple[pafs.FileSystem, str]:
    if path.startswith("file:"):
        return pafs.LocalFileSystem(), "/" + unquote(path.removeprefix("file:").lstrip("/"))
    return pafs.FileSystem.from_uri(path) if "://" in path else (pafs.LocalFileSystem(), path)


def folders(files: pafs.FileSystem, root: str, key: str, wanted: set[str] | None) -> list[tuple[str, str]]:
    """(value, path) of the folders ``key=value`` below ``root``; only ``wanted`` ones are looked at, if given."""
    if wanted is not None:
        named = [(v, f"{root}/{key}={v}") for v in sorted(wanted)]
        kinds = files.get_file_info([p for _, p in named]) if named else []
        return [x for x, info in zip(named, kinds, strict=True) if info.type == pafs.FileType.Directory]
    found = files.get_file_info(pafs.FileSelector(root, allow_not_found=True))
    return sorted((unquote(i.base_name.partition("=")[2]), i.path) for i in found if i.type == pafs.FileType.Directory and i.base_name.startswith(f"{key}="))


def listed(path: str, sources: set[str] | None = None, kinds: set[str] | None = None) -> Iterator[tuple[str, str, pafs.FileInfo]]:
    """Source, kind and info of every capture file; names that begin with ``_`` or ``.`` are none."""
    files, root = opened(path)
    for source, at in folders(files, root.rstrip("/"), "source", sources):
        for kind, below in folders(files, at, "kind", kinds):
            for info in files.get_file_info(pafs.FileSelector(below, recursive=True)):
                if info.type == pafs.FileType.File and info.base_name[0] not in "_.":
                    yield source, kind, info


def packed(found: Iterable[tuple[str, str, pafs.FileInfo]], split: int) -> list[Range]:
    """Ranges of about ``split`` bytes."""
    out: list[Range] = []
    room: dict[tuple[str, str], int] = {}
    current: dict[tuple[str, str], Range] = {}
    for source, kind, info in sorted(found, key=lambda x: (x[0], x[1], x[2].path)):
        step = info.size if info.path.endswith(".gz") else split
        for at in range(0, max(info.size, 1), max(step, 1)):
            end = min(at + max(step, 1), info.size)
            key = (source, kind)
            if key not in current or room[key] < end - at:
                current[key], room[key] = Range(source, kind, []), split
                out.append(current[key])
            current[key].pieces.append((info.path, at, end))
            room[key] -= end - at
    return out


def lines_of(files: pafs.FileSystem, path: str, start: int, end: int) -> Iterator[tuple[int, bytes]]:
    """(place, line): lines that begin in ``start <= place < end``; of a compressed file all, places in the plain text."""
    if path.endswith(".gz"):
        with files.open_input_stream(path, compression=None) as raw, gzip.GzipFile(fileobj=raw) as plain:
            at = 0
            for line in plain:
                yield at, line
                at += len(line)
        return
    with files.open_input_file(path) as raw:
        at = max(start - 1, 0)
        raw.seek(at)
        buffered = io.BufferedReader(raw, 1 << 20)
        if start > 0:
            at += len(buffered.readline())  # the rest of a line that began before
        while at < end and (line := buffered.readline()):
            yield at, line
            at += len(line)


def parsed(line: bytes) -> tuple:
    """request_key, status, final_url, headers, body and error of a line."""
    try:
        x = json.loads(line)
        if not isinstance(x, dict):
            raise ValueError("no JSON object")
        status, headers = x.get("status"), x.get("headers")
        if status is not None and (isinstance(status, bool) or not isinstance(status, int) or not -(1 << 31) <= status < 1 << 31):
            raise ValueError("status is no number")
        if headers is not None and not isinstance(headers, dict):
            raise ValueError("headers are no object")
        text = lambda v: v if v is None or isinstance(v, str) else json.dumps(v)
        values = (text(x.get("request_key")), status, text(x.get("final_url")), None if headers is None else [(k, text(v)) for k, v in headers.items()], text(x.get("body")), None)
        for v in (values[0], values[2], values[4], *(t for pair in values[3] or () for t in pair)):
            if v is not None:
                v.encode()  # lone surrogates are no text
        return values
    except (ValueError, RecursionError) as e:
        return None, None, None, None, None, f"broken line: {str(e).splitlines()[0]}"


def rows(path: str, part: Range, keys: set[str] | None = None) -> Iterator[pa.RecordBatch]:
    """The partition's rows, in order; lines of other ``keys`` are passed over (errors stay out too then, as they have no key)."""
    files, _ = opened(path)
    held: list[tuple] = []
    weight = 0

    def batch() -> pa.RecordBatch:
        nonlocal weight
        made = pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*held, strict=True), ARROW.types, strict=True)], schema=ARROW)
        held.clear()
        weight = 0
        return made

    for name, start, end in part.pieces:
        at = start
        try:
            for at, line in lines_of(files, name, start, end):
                if line.strip():
                    key, *rest, error = parsed(line)
                    if keys is None or key in keys:
                        held.append((part.source, part.kind, key, *rest, name, at, error))
                        weight += len(line)
                        if len(held) >= ROWS or weight > BATCH_BYTES:
                            yield batch()
        except (OSError, EOFError, gzip.zlib.error) as e:
            if keys is None:
                held.append((part.source, part.kind, None, None, None, None, None, name, at, f"broken file: {type(e).__name__}: {str(e).splitlines()[0] if str(e) else ''}"))
    if held:
        yield batch()


class CaptureReader(DataSourceReader):
    def __init__(self, options: Mapping[str, str]):  # names in any case
        self.path, self.split = options["path"], int(options.get("splitBytes", SPLIT))
        chosen = lambda name: {x.strip() for x in options[name].split(",")} if name in options else None
        self.wanted: dict[str, set | None] = {"source": chosen("source"), "kind": chosen("kind"), "request_key": None}

    def partitions(self) -> list[Range]:
        found = packed(listed(self.path, self.wanted["source"], self.wanted["kind"]), self.split)
        return found or [Range("", "", [])]

    def read(self, partition: Range) -> Iterator[pa.RecordBatch]:
        return rows(self.path, partition, self.wanted["request_key"])


class PushedReader(CaptureReader):
    def pushFilters(self, filters: list[Filter]) -> Iterable[Filter]:
        for f in filters:
            name = f.attribute[0] if isinstance(f, (EqualTo, EqualNullSafe, In)) and len(f.attribute) == 1 else None
            values = set(f.value) - {None} if isinstance(f, In) else {f.value} if name else set()
            if name not in self.wanted or None in values:
                yield f
            else:
                before = self.wanted[name]
                self.wanted[name] = values if before is None else before & values


class CaptureStream(DataSourceStreamReader):
    def __init__(self, options: Mapping[str, str]):  # names in any case
        self.path, self.split = options["path"], int(options.get("splitBytes", SPLIT))
        self.settle, self.most = float(options.get("settleSeconds", 2)), int(options.get("filesPerBatch", 0))
        self.at: dict = {"time": -1, "path": ""}

    def initialOffset(self) -> dict:
        return {"time": -1, "path": ""}

    def _since(self, start: dict) -> list[tuple[str, str, pafs.FileInfo]]:
        after = (start["time"], start["path"])
        found = [(s, k, i) for s, k, i in listed(self.path) if (i.mtime_ns, i.path) > after and i.mtime_ns <= time.time_ns() - self.settle * 1e9]
        return sorted(found, key=lambda x: (x[2].mtime_ns, x[2].path))

    def latestOffset(self) -> dict:
        found = self._since(self.at)
        if found:
            last = found[min(self.most or len(found), len(found)) - 1][2]
            self.at = {"time": last.mtime_ns, "path": last.path}
        return self.at

    def partitions(self, start: dict, end: dict) -> list[Range]:
        self.at = max(self.at, end, key=lambda o: (o["time"], o["path"]))  # after a restart
        upto = (end["time"], end["path"])
        return packed([x for x in self._since(start) if (x[2].mtime_ns, x[2].path) <= upto], self.split)

    def read(self, partition: Range) -> Iterator[pa.RecordBatch]:
        return rows(self.path, partition)


class CaptureSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "captures"

    def schema(self) -> str:
        return CAPTURES

    def reader(self, schema: object) -> CaptureReader:
        return (PushedReader if self.options.get("pushdown", "false") == "true" else CaptureReader)(self.options)

    def streamReader(self, schema: object) -> CaptureStream:
        return CaptureStream(self.options)


def read(spark: SparkSession, path: str, **options: object) -> DataFrame:
    spark.dataSource.register(CaptureSource)
    return spark.read.format("captures").options(**options).load(path)


def read_stream(spark: SparkSession, path: str, **options: object) -> DataFrame:
    spark.dataSource.register(CaptureSource)
    return spark.readStream.format("captures").options(**options).load(path)


@dataclass
class Folder:
    """A folder of captures in the place of a frame of payloads: each parser loads its own sources and kinds only."""

    spark: SparkSession
    path: str

    def only(self, sources: Iterable[str] | None, kinds: Iterable[str] | None) -> DataFrame:
        chosen = {name: ",".join(values) for name, values in (("source", sources), ("kind", kinds)) if values is not None}
        return read(self.spark, self.path, **chosen)


def write(payloads: DataFrame, path: str) -> None:
    """Payloads as a new folder of captures."""
    payloads.select("source", "kind", "request_key", "status", "final_url", "headers", "body").write.partitionBy("source", "kind").json(path)
