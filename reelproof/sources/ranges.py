"""Files by byte ranges: read, digested, compared and written in tasks, never as one value.

A row of a listing names a file; tasks open it themselves, so what moves between tasks is names, numbers and digests, not
content. Stores are reached through pyarrow's file systems; files of stores that only Spark can open, up to the
2 GB of a cell, go through the binaryFile source instead (sources.files, operators.digest).
"""

from __future__ import annotations

import hashlib
import os
import re
from collections import deque
from collections.abc import Iterator
from datetime import UTC, datetime

import numpy as np
import pyarrow as pa
import xxhash
from pyarrow import fs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from .shared import kept

#: Bytes of a range, of a read within it, and of the blocks that a comparison looks at before single bytes.
RANGE, READ, BLOCK = 4 << 20, 1 << 20, 4096
RANGE_SCHEMA = "path string, no long, offset long, content binary"


def located(path: str) -> tuple[fs.FileSystem, str]:
    """The store of a path as Spark gives it, and the path within it."""
    local = re.match(r"(?:file:)?/+(.*)", path)
    return (fs.LocalFileSystem(), "/" + local[1]) if local else fs.FileSystem.from_uri(path)


def reachable(path: str) -> bool:
    """Whether tasks can open the store of a path themselves."""
    try:
        located(path)
    except (pa.ArrowInvalid, pa.ArrowNotImplementedError, OSError):
        return False
    return True


def children(store: fs.FileSystem, folder: str) -> Iterator[tuple[str, bool, int, datetime]]:
    """What a folder holds: (name, whether a folder, size, mtime). Links of a local disk are not followed."""
    if isinstance(store, fs.LocalFileSystem):
        with os.scandir(folder) as found:
            for x in found:
                if not x.is_symlink():
                    stat = x.stat()
                    yield x.name, x.is_dir(), stat.st_size, datetime.fromtimestamp(stat.st_mtime, UTC)
    else:
        for x in store.get_file_info(fs.FileSelector(folder)):
            yield x.base_name, x.type == fs.FileType.Directory, x.size or 0, x.mtime


def walked(spark: SparkSession, root: str, pruned: tuple[str, ...] = (), folders: int = 1000) -> DataFrame:
    """The files below a folder, empty and hidden ones too: (path, rel, size, mtime). Folders of pruned names are not entered.

    Tasks walk the tree: each goes through so many folders and hands the rest on to the next round, which deals them out
    anew, so a small tree takes one round and a large one has all tasks walk. Errors of a folder are raised.
    """
    schema = pa.schema([("path", pa.string()), ("rel", pa.string()), ("size", pa.int64()), ("mtime", pa.timestamp("us", "UTC")), ("folder", pa.bool_())])

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, base = located(root)
        base = base.rstrip("/")
        scheme = "" if isinstance(store, fs.LocalFileSystem) else root.rstrip("/").removesuffix(base)
        row = lambda rel, size, mtime, folder: (f"{scheme}{base}/{rel}", rel, size, mtime, folder)
        for b in batches:
            todo, seen = deque(b.column(0).to_pylist()), 0
            while todo:
                at = todo.popleft()
                found = []
                if seen < folders:
                    for name, folder, size, mtime in children(store, f"{base}/{at}".rstrip("/")):
                        rel = f"{at}/{name}" if at else name
                        if not folder:
                            found.append(row(rel, size, mtime, False))
                        elif name.lower() not in pruned:
                            todo.append(rel)
                else:
                    found = [row(at, 0, None, True)]
                seen += 1
                yield pa.RecordBatch.from_pylist([dict(zip(schema.names, r, strict=True)) for r in found], schema=schema)

    out, todo = None, spark.createDataFrame([("",)], "rel string")
    while True:
        step = kept(todo.mapInArrow(each, "path string, rel string, size long, mtime timestamp, folder boolean"))
        own = step.filter("NOT folder").drop("folder")
        out = own if out is None else out.unionByName(own)
        todo = dealt(step.filter("folder").select("rel"))
        if todo.isEmpty():
            return out


def pieces(path: str, offset: int, length: int) -> Iterator[bytes]:
    """The bytes of a range, a read at a time; fewer if the file ends before."""
    store, name = located(path)
    with store.open_input_file(name) as f:
        f.seek(offset)
        while length > 0 and (data := f.read(min(READ, length))):
            length -= len(data)
            yield data


def hasher(algorithm: str):
    return xxhash.xxh64() if algorithm == "xxh64" else hashlib.new(algorithm)


class ByteRanges(DataSource):
    """spark.read.format("byte_ranges").load(folder or file): a row a range; option `range` gives its bytes.

    A partition is some ranges of one file in a row (option `partition`, in ranges), so a file of any size is read by as
    many tasks as it has partitions. An empty file has one empty range.
    """

    @classmethod
    def name(cls) -> str:
        return "byte_ranges"

    def schema(self) -> str:
        return RANGE_SCHEMA

    def reader(self, schema) -> DataSourceReader:
        return RangesReader(self.options)


class RangePart(InputPartition):
    def __init__(self, path: str, first: int, last: int):
        self.path, self.first, self.last = path, first, last


class RangesReader(DataSourceReader):
    def __init__(self, options: dict):
        self.path, self.range, self.some = options["path"], int(options.get("range", RANGE)), int(options.get("partition", 16))

    def partitions(self) -> list[RangePart]:
        store, name = located(self.path)
        at = store.get_file_info(name)
        found = [at] if at.is_file else [x for x in store.get_file_info(fs.FileSelector(name, recursive=True)) if x.is_file]
        scheme = "" if isinstance(store, fs.LocalFileSystem) else self.path.split("://")[0] + "://"
        whole = lambda x: max(1, -(-x.size // self.range))
        return [RangePart(scheme + x.path, k, min(k + self.some, whole(x))) for x in sorted(found, key=lambda x: x.path) for k in range(0, whole(x), self.some)]

    def read(self, part: RangePart) -> Iterator[tuple]:
        for no in range(part.first, part.last):
            yield part.path, no, no * self.range, b"".join(pieces(part.path, no * self.range, self.range))


def registered(spark: SparkSession) -> SparkSession:
    spark.dataSource.register(ByteRanges)
    return spark


def dealt(files: DataFrame, tasks: int | None = None) -> DataFrame:
    """A listing dealt to tasks row by row, in no order of its own, so that large files of one folder part."""
    return files.repartition(tasks or max(1, 4 * files.sparkSession.sparkContext.defaultParallelism))


def cut(files: DataFrame, size: int = RANGE) -> DataFrame:
    """files (path, size, ...) with a row for each range: no, offset, length. An empty file has one empty range."""
    last = F.greatest(F.ceil(F.col("size") / F.lit(float(size))).cast("long") - 1, F.lit(0).cast("long"))
    rows = files.withColumn("no", F.explode(F.sequence(F.lit(0).cast("long"), last))).withColumn("offset", F.col("no") * size)
    return rows.withColumn("length", F.least(F.lit(size).cast("long"), F.col("size") - F.col("offset")))


def values(files: DataFrame, size: int = RANGE, tasks: int | None = None) -> DataFrame:
    """The content of a listing's files (path, size) as rows (path, no, offset, content) of at most `size` bytes.

    Ranges, not files, are dealt to tasks, so neither many small files nor one large one make many tasks or a long one,
    and no list of files goes through the driver as the byte_ranges source's does.
    """

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        some = max(1, RANGE // size)
        for b in batches:
            for lo in range(0, len(b), some):
                part = b.slice(lo, some)
                found = [b"".join(pieces(*x)) for x in zip(*(part.column(c).to_pylist() for c in ("path", "offset", "length")), strict=True)]
                yield pa.RecordBatch.from_arrays([part.column("path"), part.column("no"), part.column("offset"), pa.array(found, pa.binary())], ["path", "no", "offset", "content"])

    return dealt(cut(files.select("path", "size"), size), tasks).mapInArrow(each, RANGE_SCHEMA)


def digests(files: DataFrame, algorithm: str = "xxh64", tasks: int | None = None) -> DataFrame:
    """H1: (path, bytes, hash) of a listing's files of any size, each read once from end to end by one task, a read at a time.

    A file that can't be read has null for both. algorithm is xxh64 (seed 0) or any that hashlib has.
    """

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = []
            for path in b.column(0).to_pylist():
                h, n = hasher(algorithm), 0
                try:
                    for data in pieces(path, 0, 1 << 62):
                        h.update(data)
                        n += len(data)
                    out.append((path, n, h.hexdigest()))
                except OSError:
                    out.append((path, None, None))
            yield pa.RecordBatch.from_pydict(dict(zip(("path", "bytes", "hash"), map(list, zip(*out, strict=True)), strict=True)) if out else {"path": [], "bytes": [], "hash": []}, schema=pa.schema([("path", pa.string()), ("bytes", pa.int64()), ("hash", pa.string())]))

    return dealt(files.select("path"), tasks).mapInArrow(each, "path string, bytes long, hash string")


def range_digests(ranges: DataFrame, keys: list[str], algorithm: str = "xxh64", tasks: int | None = None) -> DataFrame:
    """(keys, no, length, hash) of ranges (keys, path, no, offset, length): of each range for itself, read in its own task."""
    schema = ranges.select(*keys, "no", "length").withColumn("hash", F.lit("")).schema

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = []
            for path, offset, length in zip(*(b.column(c).to_pylist() for c in ("path", "offset", "length")), strict=True):
                h = hasher(algorithm)
                for data in pieces(path, offset, length):
                    h.update(data)
                out.append(h.hexdigest())
            yield pa.RecordBatch.from_arrays([*[b.column(c) for c in (*keys, "no", "length")], pa.array(out, pa.string())], [*keys, "no", "length", "hash"])

    return dealt(ranges.select(*keys, "path", "no", "offset", "length"), tasks).mapInArrow(each, schema)


def runs_of(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where two arrays of one length differ: the starts and the lengths of the runs. Equal blocks are passed over whole."""
    n = len(a)
    words = n // BLOCK * BLOCK
    unlike = np.flatnonzero((a[:words].reshape(-1, BLOCK) != b[:words].reshape(-1, BLOCK)).any(axis=1)).tolist()
    at = [k * BLOCK + np.flatnonzero(a[k * BLOCK : (k + 1) * BLOCK] != b[k * BLOCK : (k + 1) * BLOCK]) for k in [*unlike, *([words // BLOCK] if words < n else [])]]
    pos = np.concatenate(at) if at else np.empty(0, np.int64)
    begins = np.flatnonzero(np.concatenate(([True], pos[1:] != pos[:-1] + 1))) if len(pos) else np.empty(0, np.int64)
    return pos[begins], np.diff(np.append(begins, len(pos)))


def diff_runs(pairs: DataFrame, keys: list[str], tasks: int | None = None) -> DataFrame:
    """H4: (keys, start, length) of the runs of differing bytes in ranges of two files (keys, a, b, offset, length, budget).

    Both files' range is read by one task, a read at a time; runs end where reads do. Where more than `budget` bytes
    differ, reading stops, and the range has one row that says how many there were until then, with a null start.
    """
    schema = pairs.select(*keys).withColumns({"start": F.lit(None).cast("long"), "length": F.lit(None).cast("long")}).schema

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for k, (one, other, offset, length, budget) in enumerate(zip(*(b.column(c).to_pylist() for c in ("a", "b", "offset", "length", "budget")), strict=True)):
                starts, sizes, differing = [], [], 0
                for x, y in zip(pieces(one, offset, length), pieces(other, offset, length), strict=True):
                    start, size = runs_of(np.frombuffer(x, np.uint8), np.frombuffer(y, np.uint8))
                    differing += int(size.sum())
                    if differing > budget:
                        starts, sizes = [[None]], [[differing]]
                        break
                    starts.append(start + offset)
                    sizes.append(size)
                    offset += len(x)
                starts, sizes = [int(v) if v is not None else None for p in starts for v in p], [int(v) for p in sizes for v in p]
                own = [pa.array([b.column(c)[k].as_py()] * len(starts), b.schema.field(c).type) for c in keys]
                yield pa.RecordBatch.from_arrays([*own, pa.array(starts, pa.int64()), pa.array(sizes, pa.int64())], [*keys, "start", "length"])

    return dealt(pairs.select(*keys, "a", "b", "offset", "length", "budget"), tasks).mapInArrow(each, schema)


def written(rows: DataFrame, root: str, value: Column | None = None) -> DataFrame:
    """Writes files named by rows (rel, part, value): below root, a file a rel, its values in the order of part. Returns (rel, size).

    Values are bytes or text. A file's rows stream through one task and are never gathered; a task that is tried again
    writes its files anew. value says how they are made of other columns of the rows, if they are: only once these are
    dealt and in order, so that what moves between tasks is the columns.
    """

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, base = located(root)
        rel, out, size, done, folder = None, None, 0, [], None
        for b in batches:
            for name, value in zip(b.column(0).to_pylist(), b.column(1), strict=True):
                if name != rel:
                    if out is not None:
                        out.close()
                        done.append((rel, size))
                    if (at := f"{base}/{name}".rsplit("/", 1)[0]) != folder:
                        store.create_dir(at, recursive=True)
                        folder = at
                    rel, out, size = name, store.open_output_stream(f"{base}/{name}"), 0
                data = value.as_py() or b""
                out.write(data)
                size += len(data)
            yield pa.RecordBatch.from_pydict({"rel": [x[0] for x in done], "size": [x[1] for x in done]}, schema=pa.schema([("rel", pa.string()), ("size", pa.int64())]))
            done = []
        if out is not None:
            out.close()
            yield pa.RecordBatch.from_pydict({"rel": [rel], "size": [size]}, schema=pa.schema([("rel", pa.string()), ("size", pa.int64())]))

    rows = rows.select("rel", "part", F.col("value").cast("binary").alias("value")) if value is None else rows
    rows = rows.repartition("rel").sortWithinPartitions("rel", "part")
    return rows.select("rel", (F.col("value") if value is None else value).cast("binary").alias("value")).mapInArrow(each, "rel string, size long")
