"""A data source for vector files: fvecs, bvecs and ivecs, in batch and as a stream, and a sink for them.

A record is a little-endian 32-bit dimension and that many components: 32-bit floats, unsigned bytes or 32-bit integers.
A row's id is its place in the file, or over a folder's files in the order of their names; in a stream, over files in the
order of their arrival. Files are cut into ranges of records, so a large file is read by many tasks. Any file system that
pyarrow opens will do. Writing appends files after those that are there, or replaces them in mode overwrite.

    spark.dataSource.register(VecsDataSource)
    spark.read.format("vecs").load("base.fvecs")

Options: ``reduction`` (only the first 1/reduction of the records), ``splitBytes`` (of a range), ``splits`` (as many ranges,
whatever their size), ``dim`` (what the dimension must be), ``kind`` (fvecs, bvecs or ivecs; from the extension if not given).
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import time

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, DataSourceStreamReader, InputPartition, WriterCommitMessage

COMPONENT = {"fvecs": "<f4", "bvecs": "u1", "ivecs": "<i4"}
POINTS, TRUTH = "point_id long, descriptor array<float>", "query_id int, neighbours array<int>"
BATCH_BYTES, SPLIT_BYTES = 8 << 20, 64 << 20


def _open(path: str) -> tuple[pafs.FileSystem, str]:
    return pafs.FileSystem.from_uri(path) if ":/" in path else (pafs.LocalFileSystem(), path)


def _kind(path: str, options: dict) -> str:
    kind = options.get("kind") or path.rstrip("/").rpartition(".")[2]
    if kind not in COMPONENT:
        raise ValueError(f"a vector file ends in .fvecs, .bvecs or .ivecs: {path}")
    return kind


@dataclass
class _File:
    path: str
    first: int  # id of the file's first record
    records: int


@dataclass
class Range(InputPartition):
    path: str
    start: int  # record in the file
    stop: int
    first: int  # what added to a record's place in the file is its id
    dim: int


@dataclass
class Written(WriterCommitMessage):
    temporary: str
    final: str


def layout(path: str, kind: str, dim: int | None) -> tuple[list[_File], int]:
    """The files under ``path`` with their records, and the dimension."""
    fs, at = _open(path)
    info = fs.get_file_info(at)
    if info.type == pafs.FileType.NotFound:
        raise FileNotFoundError(path)
    if info.type == pafs.FileType.Directory:
        found = fs.get_file_info(pafs.FileSelector(at))
        infos = sorted((f for f in found if f.type == pafs.FileType.File and f.base_name[0] not in "._"), key=lambda f: f.base_name)
    else:
        infos = [info]
    files, first = [], 0
    for f in infos:
        if not f.size:
            continue
        with fs.open_input_file(f.path) as stream:
            own = int(np.frombuffer(stream.read(4), dtype="<i4")[0])
        if dim is not None and own != dim:
            raise ValueError(f"{f.path}: vectors of dimension {own}, not {dim}")
        dim = own
        width = 4 + dim * np.dtype(COMPONENT[kind]).itemsize
        if f.size % width:
            raise ValueError(f"{f.path}: its size is no multiple of {width} bytes, the size of a record")
        files.append(_File(f.path, first, f.size // width))
        first += f.size // width
    return files, dim or 0


class _Reading:
    def __init__(self, options: dict):
        self.path, self.options = options["path"], dict(options)
        self.kind = _kind(self.path, self.options)
        self.dim = int(self.options["dim"]) if "dim" in self.options else None

    def ranges(self, parts: list[Range]) -> list[Range]:
        """``parts`` cut into ranges of about equal size, none across files."""
        width = 4 + (parts[0].dim if parts else 0) * np.dtype(COMPONENT[self.kind]).itemsize
        total = sum(p.stop - p.start for p in parts)
        # The options' names come in lower case or as given, by the way they were set.
        bytes_of_split = int(next((v for k, v in self.options.items() if k.lower() == "splitbytes"), SPLIT_BYTES))
        splits = int(self.options.get("splits", 0)) or -(-total * width // max(width, bytes_of_split))
        most = max(1, -(-total // max(1, splits)))
        cut = [Range(p.path, at, min(p.stop, at + most), p.first, p.dim) for p in parts for at in range(p.start, p.stop, most)]
        return cut or [Range("", 0, 0, 0, 0)]

    def batches(self, part: Range) -> Iterator[pa.RecordBatch]:
        if part.start >= part.stop:
            return
        fs, _ = _open(self.path)
        record = np.dtype([("dim", "<i4"), ("v", COMPONENT[self.kind], (part.dim,))])
        step = max(1, BATCH_BYTES // record.itemsize)
        with fs.open_input_file(part.path) as stream:
            for at in range(part.start, part.stop, step):
                n = min(step, part.stop - at)
                stream.seek(at * record.itemsize)
                rows = np.frombuffer(stream.read(n * record.itemsize), dtype=record)
                if (rows["dim"] != part.dim).any():
                    raise ValueError(f"{part.path}: a record of another dimension than {part.dim}")
                ids = np.arange(part.first + at, part.first + at + n)
                kind = pa.int32() if self.kind == "ivecs" else pa.float32()
                flat = pa.array(np.ascontiguousarray(rows["v"]).reshape(-1).astype(kind.to_pandas_dtype()), kind)
                vectors = pa.ListArray.from_arrays(np.arange(n + 1, dtype=np.int32) * part.dim, flat)
                names = ["query_id", "neighbours"] if self.kind == "ivecs" else ["point_id", "descriptor"]
                yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int32() if self.kind == "ivecs" else pa.int64()), vectors], names=names)


class VecsReader(_Reading, DataSourceReader):
    def partitions(self) -> list[Range]:
        files, dim = layout(self.path, self.kind, self.dim)
        stop = sum(f.records for f in files) // max(1, int(self.options.get("reduction", 1)))
        return self.ranges([Range(f.path, 0, min(f.records, stop - f.first), f.first, dim) for f in files if f.first < stop])

    def read(self, partition: Range) -> Iterator[pa.RecordBatch]:
        return self.batches(partition)


class VecsStreamReader(_Reading, DataSourceStreamReader):
    """An offset holds the number of records of every file, so that a file's records are read once, whatever its name.

    Files and records that are added to the path come in later batches, with the ids that follow those of the batches before.
    """

    def initialOffset(self) -> dict:
        return {"files": {}}

    def latestOffset(self) -> dict:
        files, _ = layout(self.path, self.kind, self.dim)
        return {"files": {f.path: f.records for f in files}}

    def partitions(self, start: dict, end: dict) -> list[Range]:
        before, after = start["files"], end["files"]
        gone = [p for p, n in before.items() if after.get(p, 0) < n]
        if gone:
            raise ValueError(f"files that were read have lost records: {', '.join(sorted(gone)[:5])}")
        _, dim = layout(self.path, self.kind, self.dim)
        next_id, parts = sum(before.values()), []
        for path in sorted(after):
            seen = before.get(path, 0)
            if after[path] > seen:
                parts.append(Range(path, seen, after[path], next_id - seen, dim))
                next_id += after[path] - seen
        return self.ranges(parts)

    def read(self, partition: Range) -> Iterator[pa.RecordBatch]:
        return self.batches(partition)

    def commit(self, end: dict) -> None:
        pass


class VecsWriter(DataSourceArrowWriter):
    """A file a task, under a temporary name until the job commits; the jobs' and the tasks' order is the files' order."""

    def __init__(self, options: dict, overwrite: bool):
        self.path, self.kind, self.overwrite = options["path"], _kind(options["path"], options), overwrite
        self.job = f"{time.time_ns():020d}"

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Written:
        from pyspark import TaskContext

        context = TaskContext.get()
        fs, at = _open(self.path)
        fs.create_dir(at, recursive=True)
        name = f"part-{self.job}-{context.partitionId():06d}.{self.kind}"
        temporary = f"{at}/.{name}-{context.taskAttemptId()}"
        with fs.open_output_stream(temporary) as stream:
            for batch in iterator:
                lists = batch.column(1)
                n = len(lists)
                dim = len(lists.flatten()) // max(1, n)
                if lists.null_count or not (np.diff(lists.offsets.to_numpy()) == dim).all():
                    raise ValueError("vectors of different lengths")
                rows = np.empty(n, dtype=[("dim", "<i4"), ("v", COMPONENT[self.kind], (dim,))])
                rows["dim"], rows["v"] = dim, lists.flatten().to_numpy(zero_copy_only=False).reshape(n, dim)
                stream.write(rows.tobytes())
        return Written(temporary, f"{at}/{name}")

    def commit(self, messages: list[Written | None]) -> None:
        fs, at = _open(self.path)
        if self.overwrite:
            for f in fs.get_file_info(pafs.FileSelector(at, allow_not_found=True)):
                if f.type == pafs.FileType.File and f.base_name[0] not in "._":
                    fs.delete_file(f.path)
        for m in messages:
            if m:
                fs.move(m.temporary, m.final)

    def abort(self, messages: list[Written | None]) -> None:
        fs, _ = _open(self.path)
        for m in messages:
            if m:
                fs.delete_file(m.temporary)


class VecsDataSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "vecs"

    def schema(self) -> str:
        return TRUTH if _kind(self.options["path"], self.options) == "ivecs" else POINTS

    def reader(self, schema) -> VecsReader:
        return VecsReader(self.options)

    def streamReader(self, schema) -> VecsStreamReader:
        return VecsStreamReader(self.options)

    def writer(self, schema, overwrite: bool) -> VecsWriter:
        return VecsWriter(self.options, overwrite)


def register(spark: SparkSession) -> None:
    spark.dataSource.register(VecsDataSource)


def read_vecs(spark: SparkSession, path: str, **options) -> DataFrame:
    register(spark)
    return spark.read.format("vecs").options(**options).load(path)


def write_vecs(rows: DataFrame, path: str, kind: str, partitions: int | None = None, mode: str = "append") -> None:
    """Write (id, vector) rows in the order of their ids as a folder of vector files, ``partitions`` if given."""
    register(rows.sparkSession)
    id_column = rows.columns[0]
    dealt = rows.repartitionByRange(partitions, id_column) if partitions else rows.repartitionByRange(id_column)
    dealt.sortWithinPartitions(id_column).write.format("vecs").option("kind", kind).mode(mode).save(path)
