"""Token ids in binary files of framed records, with an offset index beside each file.

A record is the length of its payload (8 bytes), the masked crc32 of those 8 bytes, the payload,
and the masked crc32 of the payload; all little-endian. The payload is the document's id
(8 bytes), a byte that is 1 if the id is null, a byte with the width of an id (2 or 4), and the
ids. ``<file>.idx`` has for each record its offset and its number of ids (8 bytes each), so that
records can be read in any order. A checksum is masked by a rotation and a constant, so that one
kept inside a payload can't be taken for the frame's own.

Files are in ascending order of the id (rows that share an id: of the text's hash; null ids come
first). A task writes under a name of its own and only the names that successful attempts return
enter the manifest; what a lost executor leaves behind is never read.
"""

from __future__ import annotations

import functools
import struct
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from folioscope.llm.bpe import encoder
from folioscope.llm.common import shared_dir, slices

MASK = 0xA282EAD8
FRAME = struct.Struct("<QI")
HEAD = struct.Struct("<qBB")


def masked(data: bytes) -> int:
    """The crc32 of ``data``, rotated right by 15 bits, plus a constant."""
    c = zlib.crc32(data)
    return ((c >> 15 | c << 17) + MASK) & 0xFFFFFFFF


def frame(payload: bytes) -> bytes:
    length = struct.pack("<Q", len(payload))
    return length + struct.pack("<I", masked(length)) + payload + struct.pack("<I", masked(payload))


def read_frame(f, at: int | None = None) -> bytes | None:
    """The payload of the record here or at an offset; None at the end. Bad checksums raise."""
    if at is not None:
        f.seek(at)
    head = f.read(FRAME.size)
    if not head:
        return None
    length, check = FRAME.unpack(head)
    if masked(head[:8]) != check:
        raise ValueError("a record's length doesn't have its checksum")
    body = f.read(length + 4)
    payload, check = body[:length], body[length:]
    if len(check) != 4 or masked(payload) != struct.unpack("<I", check)[0]:
        raise ValueError("a record doesn't have its checksum")
    return payload


def pack(doc_id: int | None, ids: np.ndarray, width: int) -> bytes:
    return HEAD.pack(doc_id or 0, doc_id is None, width) + ids.astype(f"<u{width}").tobytes()


def unpack(payload: bytes) -> tuple[int | None, np.ndarray]:
    doc_id, null, width = HEAD.unpack_from(payload)
    return None if null else doc_id, np.frombuffer(payload, f"<u{width}", offset=HEAD.size)


def opened(folder: str) -> tuple[pyarrow.fs.FileSystem, str]:
    return pyarrow.fs.FileSystem.from_uri(folder)


def _write(folder: str, tokenizer: str, end_id: int, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    own = encoder(tokenizer)
    width = 2 if len(own.vocabulary.bytes_of) <= 1 << 16 and end_id < 1 << 16 else 4
    fs, root = opened(folder)
    part = TaskContext.get().partitionId()
    name = f"tokens-{part:06d}-{uuid.uuid4().hex}.rec"
    fs.create_dir(root, recursive=True)
    offset, offsets, counts = 0, [], []
    with fs.open_output_stream(f"{root}/{name}", buffer_size=1 << 20) as out:
        for batch in slices(batches, 1):
            ids = batch.column(0).to_pylist()
            for first, last, codes, at in own.blocks(batch.column(1).to_pylist()):
                for i in range(first, last):
                    tokens = np.append(own.tokens(codes[at[i - first] : at[i - first + 1]]), end_id)
                    record = frame(pack(ids[i], tokens, width))
                    out.write(record)
                    offsets.append(offset)
                    counts.append(len(tokens))
                    offset += len(record)
    with fs.open_output_stream(f"{root}/{name}.idx") as out:
        out.write(np.stack([np.array(offsets, "<u8"), np.array(counts, "<u8")], 1).tobytes() if offsets else b"")
    yield pa.RecordBatch.from_pydict({"part": [part], "name": [name], "docs": [len(counts)], "tokens": [sum(counts)]}, pa.schema([("part", pa.int32()), ("name", pa.string()), ("docs", pa.int64()), ("tokens", pa.int64())]))


def write(docs: DataFrame, tokenizer: str, folder: str, end_id: int = 0, id_col: str = "doc_id", text_col: str = "text") -> list[tuple[str, int, int]]:
    """Writes the ids of every whole text and ``end_id`` after each; returns the manifest.

    The manifest has for each file, in order: its name, the number of ids in all files before it,
    and its number of records. It has as many entries as there are files. Null texts are empty, and
    very long ones one record each. Null ids come first, repeated ids by their texts' hash, repeated
    rows each have their record. An empty table writes no record and gives an empty manifest; no
    column but the named is read.
    """
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    keys = [F.col("id"), F.xxhash64("text")]
    parts = rows.repartitionByRange(*keys).sortWithinPartitions(*keys)
    wrote = parts.mapInArrow(functools.partial(_write, folder, tokenizer, end_id), "part int, name string, docs long, tokens long").collect()
    manifest, before = [], 0
    for row in sorted(wrote, key=lambda r: r["part"]):
        if row["docs"]:
            manifest.append((row["name"], before, row["docs"]))
        before += row["tokens"]
    return manifest


def _read(folder: str, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    fs, root = opened(folder)
    for batch in batches:
        for name, start in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            rows: list[tuple] = []
            with fs.open_input_stream(f"{root}/{name}", buffer_size=1 << 20) as f:
                while (payload := read_frame(f)) is not None:
                    doc_id, ids = unpack(payload)
                    rows.append((doc_id, start, len(ids), zlib.crc32(ids.astype("<u4").tobytes())))
                    start += len(ids)
                    if len(rows) == 10_000:
                        yield _rows(rows)
                        rows = []
            yield _rows(rows)


def _rows(rows: list[tuple]) -> pa.RecordBatch:
    columns = list(zip(*rows, strict=True)) or [(), (), (), ()]
    return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], ["doc_id", "start", "n_tokens", "ids_crc32"])


def read(spark: SparkSession, folder: str, manifest: list[tuple[str, int, int]]) -> DataFrame:
    """Reads files back, checksums verified: doc_id, start, n_tokens and ids_crc32 of each record.

    ``start`` counts the ids of all records before; ``ids_crc32`` is that of the ids as unsigned
    32-bit integers. Without files there are no rows.
    """
    schema = "doc_id long, start long, n_tokens long, ids_crc32 long"
    if not manifest:
        return spark.createDataFrame([], schema)
    files = spark.createDataFrame(manifest, "name string, start long, docs long").repartition(len(manifest))
    return files.mapInArrow(functools.partial(_read, folder), schema)


def read_shuffled(folder: str, name: str, order: np.ndarray) -> Iterator[tuple[int | None, np.ndarray]]:
    """The records of one file in the order of ``order`` (record numbers), by its index."""
    fs, root = opened(folder)
    with fs.open_input_stream(f"{root}/{name}.idx") as f:
        index = np.frombuffer(f.read(), "<u8").reshape(-1, 2)
    with fs.open_input_file(f"{root}/{name}") as f:
        for k in order:
            yield unpack(read_frame(f, int(index[k, 0])))


def new_folder(spark: SparkSession) -> str:
    return f"{shared_dir(spark)}/tokenfiles-{uuid.uuid4().hex}"
