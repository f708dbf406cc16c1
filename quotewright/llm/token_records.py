"""Token ids as length-delimited binary records with a separate offset index.

A record is::

    u64 payload length | u32 masked crc of those 8 bytes | payload | u32 masked crc of the payload

and its payload ``i64 doc_id (null: -2**63) | u32 bytes per id | ids``, all little-endian.  A
checksum is CRC-32, rotated right by 15 bits plus a constant, so that a checksum stored inside
checksummed data does not weaken it.  Beside each ``.rec`` file lies an ``.idx`` file: per record its
byte offset, byte length and id count (u64 each), so a reader can seek to any record in any order.

Documents are dealt by ranges of (``doc_id``, text hash) and sorted inside each range, so the files of
``manifest.json`` give ascending ids in its order (null first; ties by text hash).  Each attempt of a
task writes files of its own name, and the manifest names those of the attempt that Spark took; nothing
is renamed or overwritten, so a lost or repeated task does no harm.  Files of other attempts are deleted
in the end.  Null text is an empty sequence with its end id.  Repeated rows give a record each; extra
columns, whatever their names, are ignored; an empty table gives a manifest without files.
"""

from __future__ import annotations

import json
import struct
import uuid
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyarrow.fs import FileSelector
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import filesystem, record_batches, shuffle_partitions, text_tag, tidy
from .tokens import encoder

NULL_ID = -(1 << 63)
#: Layouts: payload length, checksum, payload head, index entry.
_HEAD, _CRC, _META, _ENTRY = "<Q", "<I", "<qI", "<QQQ"


def masked_crc(data: bytes) -> int:
    c = zlib.crc32(data)
    return (((c >> 15) | (c << 17)) + 0xA282EAD8) & 0xFFFFFFFF


def frame(payload: bytes) -> bytes:
    head = struct.pack(_HEAD, len(payload))
    return b"".join((head, struct.pack(_CRC, masked_crc(head)), payload, struct.pack(_CRC, masked_crc(payload))))


def read_frame(stream) -> bytes | None:
    """The next payload, or None at the end; damage raises ValueError."""
    head = stream.read(12)
    if not head:
        return None
    if len(head) < 12 or masked_crc(head[:8]) != struct.unpack(_CRC, head[8:])[0]:
        raise ValueError("damaged record length")
    n = struct.unpack(_HEAD, head[:8])[0]
    body = stream.read(n + 4)
    if len(body) < n + 4 or masked_crc(body[:n]) != struct.unpack(_CRC, body[n:])[0]:
        raise ValueError("damaged record")
    return body[:n]


def read_record(root: str, part: int, k: int) -> tuple[int | None, np.ndarray]:
    """The ``k``-th record of a part by its index: (doc_id, ids), without reading others."""
    fs, path = filesystem(root)
    with fs.open_input_stream(f"{path}/manifest.json") as f:
        name = next(x["name"] for x in json.loads(f.read()) if x["part"] == part)
    with fs.open_input_file(f"{path}/{name}.idx") as f:
        f.seek(k * struct.calcsize(_ENTRY))
        offset, _, _ = struct.unpack(_ENTRY, f.read(struct.calcsize(_ENTRY)))
    with fs.open_input_file(f"{path}/{name}.rec") as f:
        f.seek(offset)
        return _parsed(read_frame(f))


def _parsed(payload: bytes) -> tuple[int | None, np.ndarray]:
    doc, width = struct.unpack_from(_META, payload)
    return None if doc == NULL_ID else doc, np.frombuffer(payload, f"<u{width}", offset=struct.calcsize(_META))


@dataclass(frozen=True)
class TokenFiles:
    """Where the files are and, by part, what they hold and are called (one entry a file)."""

    root: str
    parts: tuple[tuple[int, int, int], ...]  # part, records, ids
    names: tuple[str, ...]


def write(docs: DataFrame, root: str, tokenizer_path: str, end_id: int = 0) -> TokenFiles:
    """Encode ``docs`` (doc_id, text) into files under ``root``."""
    spark = docs.sparkSession

    def write_part(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task = TaskContext.get()
        part = task.partitionId()
        name = f"part-{part:06d}-{task.taskAttemptId()}-{uuid.uuid4().hex[:8]}"
        fs, path = filesystem(root)
        fs.create_dir(path, recursive=True)
        at = records = total = 0
        with encoder(tokenizer_path) as enc, fs.open_output_stream(f"{path}/{name}.rec") as rec, fs.open_output_stream(f"{path}/{name}.idx") as idx:
            end, width = np.array([end_id], enc.dtype).tobytes(), np.dtype(enc.dtype).itemsize
            for batch in batches:
                for start in range(0, batch.num_rows, 512):
                    piece = batch.slice(start, 512)
                    for doc, ids in zip(piece.column(0).to_pylist(), enc.encode(piece.column(1).to_pylist()), strict=True):
                        framed = frame(struct.pack(_META, NULL_ID if doc is None else doc, width) + ids + end)
                        n = len(ids) // width + 1
                        rec.write(framed)
                        idx.write(struct.pack(_ENTRY, at, len(framed), n))
                        at, records, total = at + len(framed), records + 1, total + n
        yield from record_batches((("part", pa.int32()), ("name", pa.string()), ("records", pa.int64()), ("ids", pa.int64())), [(part, name, records, total)])

    keyed = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", text_tag().alias("tag"))
    dealt = keyed.repartitionByRange(shuffle_partitions(spark), "doc_id", "tag").sortWithinPartitions("doc_id", "tag").select("doc_id", "text")
    parts = dealt.mapInArrow(tidy(write_part), "part int, name string, records long, ids long").collect()  # a row a file
    parts.sort(key=lambda r: r.part)
    files = TokenFiles(root, tuple((r.part, r.records, r.ids) for r in parts), tuple(r.name for r in parts))
    fs, path = filesystem(root)
    fs.create_dir(path, recursive=True)  # no task has made it where there are no rows
    with fs.open_output_stream(f"{path}/manifest.json") as f:
        f.write(json.dumps([{"part": part, "name": name, "records": records, "ids": ids} for (part, records, ids), name in zip(files.parts, files.names, strict=True)]).encode())
    taken = set(files.names)
    for info in fs.get_file_info(FileSelector(path)):
        if info.base_name.startswith("part-") and info.base_name.rsplit(".", 1)[0] not in taken:
            fs.delete_file(info.path)
    return files


def read(spark: SparkSession, files: TokenFiles) -> DataFrame:
    """doc_id, start (ids before the document), n_tokens and ids_crc32, from the files."""
    if not files.parts:
        return spark.createDataFrame([], "doc_id long, start long, n_tokens long, ids_crc32 long")
    root, before, bases = files.root, 0, []
    for (_, _, ids), name in zip(files.parts, files.names, strict=True):
        bases.append((name, before))
        before += ids

    def rows(which: list[int]) -> Iterator[tuple]:
        fs, path = filesystem(root)
        for i in which:
            name, start = bases[i]
            with fs.open_input_stream(f"{path}/{name}.rec", buffer_size=1 << 20) as f:
                while (payload := read_frame(f)) is not None:
                    doc, ids = _parsed(payload)
                    yield doc, start, len(ids), zlib.crc32(ids.astype("<u4").tobytes())
                    start += len(ids)

    def read_parts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        columns = [(c, pa.int64()) for c in ("doc_id", "start", "n_tokens", "ids_crc32")]
        for batch in batches:
            yield from record_batches(columns, rows(batch.column(0).to_pylist()))

    return spark.range(0, len(bases), 1, len(bases)).mapInArrow(read_parts, "doc_id long, start long, n_tokens long, ids_crc32 long")
