"""Length-delimited binary token records, with a separate offset index for shuffled reads.

A shard file holds records one after another::

    length of the payload      8 bytes, little-endian
    masked CRC of the length   4 bytes
    payload                    doc_id (8 bytes), bytes per id (1 byte: 2 or 4, plus 128 where doc_id is null), ids
    masked CRC of the payload  4 bytes

The masked CRC is ``rotate_right(crc32, 15) + 0xa282ead8``, so that a record that itself holds checksums stays safe to
check.  Beside each shard lies its index: (doc_id, offset, number of ids), 24 bytes a record.  ``_MANIFEST`` is written
last, by the driver, from what the successful task attempts report; files that it doesn't name (of lost or repeated
attempts) are never read.  It has one line per shard, so its size follows the number of shards.

Used through Spark's data source API::

    write_token_records(docs, path, tokenizer)   # doc_id, text -> files
    read_token_records(spark, path)              # files -> doc_id, start, n_tokens, ids, ids_crc32

Null texts are empty documents (the end id alone); null doc_ids come first; an empty table makes an empty manifest; rows
that repeat a doc_id stay apart, in any order among themselves; a very long text is one record, whose length has eight
bytes and whose ids must fit into a worker; other columns are not read.  Any damaged byte raises ``ValueError``.
"""

from __future__ import annotations

import json
import random
import struct
import uuid
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import (
    DataSource,
    DataSourceArrowWriter,
    DataSourceReader,
    InputPartition,
    WriterCommitMessage,
)

from cardloom.llm.common import documents
from cardloom.llm.encoding import encoder

MASK_DELTA = 0xA282EAD8
MANIFEST = "_MANIFEST"
SHARD_BYTES = 64 << 20
SCHEMA = "doc_id long, start long, n_tokens long, ids binary, ids_crc32 long"


def masked_crc(data: bytes) -> int:
    crc = zlib.crc32(data)
    return ((crc >> 15 | crc << 17) + MASK_DELTA) & 0xFFFFFFFF


def frame(payload: bytes) -> bytes:
    length = struct.pack("<Q", len(payload))
    return b"".join((length, struct.pack("<I", masked_crc(length)), payload, struct.pack("<I", masked_crc(payload))))


def unframe(data: memoryview, at: int) -> tuple[memoryview, int]:
    """The payload of the record at ``at``, and where the next one begins."""
    length = bytes(data[at : at + 8])
    if len(data) < at + 12 or masked_crc(length) != int.from_bytes(data[at + 8 : at + 12], "little"):
        raise ValueError(f"damaged record length at byte {at}")
    end = at + 12 + int.from_bytes(length, "little")
    payload = data[at + 12 : end]
    if len(data) < end + 4 or masked_crc(payload) != int.from_bytes(data[end : end + 4], "little"):
        raise ValueError(f"damaged record at byte {at}")
    return payload, end + 4


def pack_payload(doc_id: int | None, ids: bytes, narrow: bool) -> bytes:
    """ids: as 32-bit integers; narrow: the vocabulary fits 16 bits."""
    body = np.frombuffer(ids, "<u4").astype("<u2").tobytes() if narrow else ids
    return struct.pack("<qB", doc_id or 0, (2 if narrow else 4) | (0x80 if doc_id is None else 0)) + body


def unpack_payload(payload: memoryview) -> tuple[int | None, bytes]:
    doc_id, width = struct.unpack_from("<qB", payload)
    body = payload[9:]
    return None if width & 0x80 else doc_id, np.frombuffer(body, "<u2").astype("<u4").tobytes() if width & 0x7F == 2 else bytes(body)


def open_folder(uri: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(uri if "://" in uri else uri.replace("file:", "file://", 1) if uri.startswith("file:") else f"file://{uri}")


@dataclass
class Shards(WriterCommitMessage):
    rows: list[list]


@dataclass
class Shard(InputPartition):
    name: str
    start: int


class _Writer(DataSourceArrowWriter):
    def __init__(self, options: dict, overwrite: bool):
        self.path, self.tokenizer = options["path"], options.get("tokenizer")
        self.end_id, self.limit = int(options.get("end_id", -1)), int(options.get("shard_bytes", SHARD_BYTES))
        self.overwrite = overwrite

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Shards:
        from pyspark import TaskContext

        partition, attempt = TaskContext.get().partitionId(), uuid.uuid4().hex
        files, folder = open_folder(self.path)
        files.create_dir(folder, recursive=True)
        enc = encoder(self.tokenizer)
        end, narrow = (struct.pack("<I", self.end_id) if self.end_id >= 0 else b""), enc.vocab_size <= 1 << 16
        done: list[list] = []
        out, index, at, tokens, name = None, b"", 0, 0, ""

        def close() -> None:
            nonlocal out
            if out is not None:
                out.close()
                with files.open_output_stream(f"{folder}/{name}.idx") as file:
                    file.write(index)
                done.append([partition, len(done), name, len(index) // 24, tokens, at])
                out = None

        for batch in iterator:
            for doc_id, text in zip(batch.column("doc_id").to_pylist(), batch.column("text"), strict=True):
                if out is None or at >= self.limit:
                    close()
                    name, index, at, tokens = f"part-{partition:06d}-{len(done):04d}-{attempt}", bytearray(), 0, 0
                    out = files.open_output_stream(f"{folder}/{name}.tok", buffer_size=1 << 20)
                ids = enc.encode_bytes(text.as_py() or "") + end
                record = frame(pack_payload(doc_id, ids, narrow))
                out.write(record)
                index += struct.pack("<qqq", doc_id or 0, at, len(ids) // 4)
                at, tokens = at + len(record), tokens + len(ids) // 4
        close()
        return Shards(done)

    def commit(self, messages: list[Shards | None]) -> None:
        files, folder = open_folder(self.path)
        files.create_dir(folder, recursive=True)
        start = 0
        with files.open_output_stream(f"{folder}/{MANIFEST}") as out:
            for _, _, name, records, tokens, size in sorted(x for m in messages if m for x in m.rows):
                out.write((json.dumps({"name": name, "records": records, "tokens": tokens, "bytes": size, "start": start}) + "\n").encode())
                start += tokens

    def abort(self, messages: list[Shards | None]) -> None:
        files, folder = open_folder(self.path)
        for name in [x[2] for m in messages if m for x in m.rows]:
            for kind in ("tok", "idx"):
                files.delete_file(f"{folder}/{name}.{kind}")


class _Reader(DataSourceReader):
    def __init__(self, options: dict):
        self.path, self.with_ids = options["path"], options.get("ids", "true") != "false"
        self.seed = options.get("shuffle_seed")

    def partitions(self) -> list[Shard]:
        files, folder = open_folder(self.path)
        with files.open_input_stream(f"{folder}/{MANIFEST}") as file:
            lines = [json.loads(x) for x in file.read().decode().splitlines()]
        shards = [Shard(x["name"], x["start"]) for x in lines]
        if self.seed is not None:
            random.Random(self.seed).shuffle(shards)
        return shards or [Shard("", 0)]

    def read(self, partition: Shard) -> Iterator[pa.RecordBatch]:
        if not partition.name:
            return
        files, folder = open_folder(self.path)
        with files.open_input_file(f"{folder}/{partition.name}.idx") as file:
            index = np.frombuffer(file.read(), "<i8").reshape(-1, 3)
        starts = partition.start + np.cumsum(index[:, 2]) - index[:, 2]
        order = np.arange(len(index))
        if self.seed is not None:
            np.random.default_rng([int(self.seed), zlib.crc32(partition.name[:16].encode())]).shuffle(order)
        with files.open_input_file(f"{folder}/{partition.name}.tok") as file:
            rows, held, data = [], 0, memoryview(file.read_buffer())
            for k in order.tolist():
                doc_id, ids = unpack_payload(unframe(data, int(index[k, 1]))[0])
                if (doc_id or 0) != index[k, 0] or len(ids) != 4 * index[k, 2]:
                    raise ValueError(f"{partition.name}: the index and record {k} differ")
                rows.append((doc_id, int(starts[k]), len(ids) // 4, ids if self.with_ids else None, zlib.crc32(ids)))
                held += len(ids)
                if held > 8 << 20:
                    yield self._batch(rows)
                    rows, held = [], 0
            if rows:
                yield self._batch(rows)

    @staticmethod
    def _batch(rows: list[tuple]) -> pa.RecordBatch:
        kinds = [pa.int64(), pa.int64(), pa.int64(), pa.binary(), pa.int64()]
        names = ["doc_id", "start", "n_tokens", "ids", "ids_crc32"]
        return pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*rows, strict=True), kinds, strict=True)], names)


class TokenRecords(DataSource):
    """``format("token_records")``. Options: path; writing: tokenizer, end_id, shard_bytes; reading: ids, shuffle_seed."""

    @classmethod
    def name(cls) -> str:
        return "token_records"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> DataSourceReader:
        return _Reader(self.options)

    def writer(self, schema, overwrite: bool) -> DataSourceArrowWriter:
        return _Writer(self.options, overwrite)


def write_token_records(docs: DataFrame, path: str, tokenizer: str, end_id: int | None = None, shard_bytes: int = SHARD_BYTES) -> None:
    """Writes all documents in ascending doc_id order to a new folder. One shuffle, by ranges of doc_id; tasks stream."""
    spark = docs.sparkSession
    spark.dataSource.register(TokenRecords)
    ordered = documents(docs).repartitionByRange("doc_id").sortWithinPartitions("doc_id")
    out = ordered.write.format("token_records").mode("append").option("tokenizer", tokenizer).option("shard_bytes", shard_bytes)
    (out.option("end_id", end_id) if end_id is not None else out).save(path)


def read_token_records(spark: SparkSession, path: str, ids: bool = True, shuffle_seed: int | None = None) -> DataFrame:
    """doc_id, start (ids of all documents before it), n_tokens, ids (32-bit little-endian; null unless asked for),
    ids_crc32. With a seed, shards and the records in each come in that seed's order, found through the index."""
    spark.dataSource.register(TokenRecords)
    reader = spark.read.format("token_records").option("ids", str(ids).lower())
    return (reader.option("shuffle_seed", shuffle_seed) if shuffle_seed is not None else reader).load(path)

