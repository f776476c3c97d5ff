"""Files as tables: names and sizes, label lines, ground truth, and flat vector files."""

from __future__ import annotations

import struct
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

#: Of a flat file: code, dimensions, vectors, (two unused numbers, trained), metric, floats; 45 bytes, little-endian.
HEADER = struct.Struct("<4siqqqBiq")
CODE, INNER_PRODUCT = b"IxFI", 0
PART_BYTES = 64 << 20


def scan_file_manifest(spark: SparkSession, folder: str, pattern: str = "*.jpg") -> DataFrame:
    """filename, length; contents are not read."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", pattern).option("recursiveFileLookup", True).load(folder)
    return files.select(F.regexp_extract("path", "([^/]*)$", 1).alias("filename"), "length")


def scan_obb_labels(spark: SparkSession, path: str) -> DataFrame:
    """file, value: one row per line that isn't blank."""
    rows = spark.read.text(path).select(F.regexp_extract(F.col("_metadata.file_path"), "([^/]*)$", 1).alias("file"), "value")
    return rows.filter(F.trim("value") != "")


def scan_ground_truth_json(spark: SparkSession, path: str) -> DataFrame:
    """path, name, set_code, collector_number from an object of names, or of objects of the three."""
    whole = spark.read.text(path, wholetext=True)
    each = whole.select(F.explode(F.from_json("value", "map<string,string>")).alias("path", "v"))
    field = lambda name: F.when(F.startswith("v", F.lit("{")), F.get_json_object("v", f"$.{name}"))
    return each.select("path", F.coalesce(field("card_name"), F.when(~F.startswith("v", F.lit("{")), F.col("v"))).alias("name"), field("set_code").alias("set_code"), field("collector_number").alias("collector_number"))


@dataclass
class Rows(InputPartition):
    first: int
    count: int
    path: str
    skip: int
    dim: int


def _open(path: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(path if "://" in path else f"file://{path.removeprefix('file:')}")


def flat_header(raw: bytes, size: int) -> tuple[int, int]:
    """(dimensions, vectors); what doesn't fit raises."""
    if len(raw) < HEADER.size:
        raise ValueError("the file ends within its header")
    code, dim, total, _, _, _, metric, floats = HEADER.unpack(raw[: HEADER.size])
    if code != CODE or metric != INNER_PRODUCT:
        raise ValueError("not a flat inner-product file")
    if dim <= 0 or total < 0 or floats != dim * total:
        raise ValueError(f"{floats} numbers for {total} vectors of {dim}")
    if size < HEADER.size + 4 * floats:
        raise ValueError("the file ends within its vectors")
    return dim, total


def _flat_parts(path: str) -> list[tuple[str, int]]:
    """The files of a flat index in order, with their sizes: one file, or a folder of parts named by their first row."""
    files, name = _open(path)
    if files.get_file_info(name).type != fs.FileType.Directory:
        return [(path, files.get_file_info(name).size)]
    found = [f for f in files.get_file_info(fs.FileSelector(name)) if f.base_name.endswith(".flat")]
    return [(f"{path.rstrip('/')}/{f.base_name}", f.size) for f in sorted(found, key=lambda f: f.base_name)]


class _FlatReader(DataSourceReader):
    def __init__(self, path: str):
        self.parts: list[Rows] = []
        first, dims = 0, set()
        for part, size in _flat_parts(path):
            files, name = _open(part)
            with files.open_input_file(name) as file:
                dim, total = flat_header(file.read(HEADER.size), size)
            dims.add(dim)
            step = max(1, PART_BYTES // (4 * dim))
            self.parts += [Rows(first + a, min(step, total - a), part, a, dim) for a in range(0, total, step)]
            first += total
        if len(dims) > 1:
            raise ValueError(f"parts of {sorted(dims)} dimensions")

    def partitions(self) -> list[Rows]:
        return self.parts or [Rows(0, 0, "", 0, 1)]

    def read(self, partition: Rows) -> Iterator[pa.RecordBatch]:
        if not partition.count:
            return
        files, name = _open(partition.path)
        with files.open_input_file(name) as file:
            file.seek(HEADER.size + 4 * partition.dim * partition.skip)
            for at in range(partition.first, partition.first + partition.count, 4096):
                n = min(4096, partition.first + partition.count - at)
                values = np.frombuffer(file.read(4 * partition.dim * n), "<f4")
                offsets = np.arange(0, len(values) + 1, partition.dim, dtype=np.int32)
                vectors = pa.ListArray.from_arrays(pa.array(offsets), pa.array(values))
                yield pa.RecordBatch.from_arrays([pa.array(np.arange(at, at + n)), vectors], ["pos", "embedding"])


class FlatVectors(DataSource):
    """``format("flat_vectors")``: pos, embedding, read in ranges of rows."""

    @classmethod
    def name(cls) -> str:
        return "flat_vectors"

    def schema(self) -> str:
        return "pos long, embedding array<float>"

    def reader(self, schema) -> DataSourceReader:
        return _FlatReader(self.options["path"])


def scan_flat_vector_file(spark: SparkSession, path: str) -> DataFrame:
    spark.dataSource.register(FlatVectors)
    return spark.read.format("flat_vectors").load(path)


def _header(dim: int, total: int) -> bytes:
    return HEADER.pack(CODE, dim, total, 0, 0, 1, INNER_PRODUCT, dim * total)


def write_flat_vectors(index: DataFrame, path: str, dim: int) -> None:
    """The same layout, as a folder of parts: each task writes a range of pos, with a header of its own. A part's name is its
    task's number, so a task that runs again writes the same file, which is there only once it is whole."""
    n = int(index.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    files, name = _open(path)
    files.create_dir(name, recursive=True)

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        files, name = _open(path)
        task = TaskContext.get()
        place, body, total = f"{name}/{task.partitionId():08d}", f"{name}/.{task.partitionId():08d}-{task.taskAttemptId()}", 0
        with files.open_output_stream(body) as out:
            for batch in batches:
                column = batch.column(0)
                if column.null_count or pc.any(pc.not_equal(pc.list_value_length(column), dim)).as_py():
                    raise ValueError(f"a vector hasn't {dim} dimensions")
                out.write(column.flatten().to_numpy(zero_copy_only=False).astype("<f4").tobytes())
                total += len(column)
        with files.open_input_stream(body) as rows, files.open_output_stream(body + "+") as out:
            out.write(_header(dim, total))
            while block := rows.read(8 << 20):
                out.write(block)
        files.delete_file(body)
        files.move(body + "+", place + ".flat")
        yield pa.RecordBatch.from_arrays([pa.array([total], pa.int64())], ["n"])

    spread = index.repartitionByRange(n, "pos").sortWithinPartitions("pos").select(F.col("embedding").cast("array<float>"))
    spread.mapInArrow(write, "n long").agg(F.sum("n")).collect()


def join_flat_vectors(parts: str, path: str) -> None:
    """Parts as the one file that other readers of the layout know, for an index that one machine can hold: copied block by
    block, never whole in memory."""
    found = _flat_parts(parts)
    headers, (target, name) = [], _open(path)
    for part, size in found:
        files, own = _open(part)
        with files.open_input_file(own) as file:
            headers.append(flat_header(file.read(HEADER.size), size))
    dim = next((d for d, n in headers if n), 1)
    with target.open_output_stream(name) as out:
        out.write(_header(dim, sum(n for _, n in headers)))
        for part, _ in found:
            files, own = _open(part)
            with files.open_input_file(own) as file:
                file.seek(HEADER.size)
                while block := file.read(8 << 20):
                    out.write(block)
