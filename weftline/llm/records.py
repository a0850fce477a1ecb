"""Length-delimited binary records of token ids, with a separate offset index."""

from __future__ import annotations

import struct
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from weftline.llm._store import filesystem, fresh_path, keep, qualified
from weftline.llm._words import slices
from weftline.llm.tokens import default_tokenizer, encoder, with_end

#: Text bytes aimed at in one file.
FILE_BYTES = 32 << 20
DATA_MAGIC, INDEX_MAGIC = b"WEFTREC1", b"WEFTIDX1"
#: Stands for a null doc_id in the files.
NO_ID = -(1 << 63)
_HEAD = struct.Struct("<QI")
_TAIL = struct.Struct("<I")
_INDEX = np.dtype([("doc_id", "<i8"), ("offset", "<i8"), ("n_tokens", "<i8")])
MANIFEST = "part int, data string, offsets string, n_docs long, n_tokens long, n_bytes long"


def masked(data: bytes) -> int:
    """CRC-32 rotated right by 15 bits plus a constant, so that a checksum of checksums isn't one of data."""
    c = zlib.crc32(data)
    return (((c >> 15) | (c << 17)) + 0xA282EAD8) & 0xFFFFFFFF


def frame(payload: bytes) -> bytes:
    """Length (8 bytes), its masked checksum (4), payload, the payload's masked checksum (4)."""
    n = struct.pack("<Q", len(payload))
    return b"".join((n, _TAIL.pack(masked(n)), payload, _TAIL.pack(masked(payload))))


def unframe(read, where: str) -> bytes | None:
    """The next payload of ``read(n)``, or None at the end; a ValueError names a damaged record."""
    head = read(_HEAD.size)
    if not head:
        return None
    if len(head) < _HEAD.size:
        raise ValueError(f"{where}: cut off in a length")
    n, check = _HEAD.unpack(head)
    if check != masked(head[:8]):
        raise ValueError(f"{where}: the checksum of a length differs")
    body = read(n + 4)
    if len(body) < n + 4 or _TAIL.unpack(body[n:])[0] != masked(body[:n]):
        raise ValueError(f"{where}: cut off or the checksum of a payload differs")
    return body[:n]


def write_records(docs: DataFrame, path: str | None = None, tokenizer: str | None = None, end_id: int = 1, n_files: int | None = None) -> DataFrame:
    """Encode every whole text, append ``end_id`` and write records in ascending ``doc_id``; returns the manifest.

    A record's payload is the doc_id (8 bytes) and its ids, two bytes each where the vocabulary has at most 65,536
    ids and four otherwise, as the file's ninth byte says. Each task writes under a name of its own attempt, and the
    manifest, which Spark commits, names the files of the attempts that counted: a lost executor leaves a stray file
    and no wrong record. Null texts are empty, a null doc_id comes first, repeated rows are records of their own.
    """
    spark, tokenizer = docs.sparkSession, tokenizer or default_tokenizer()
    path = qualified(spark, path) if path else fresh_path(spark, "records")
    if n_files is None:
        n_files = max(1, -(-(docs.agg(F.sum(F.octet_length("text")).alias("b")).first().b or 0) // FILE_BYTES))

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, base = filesystem(path)
        part, name = TaskContext.get().partitionId(), uuid.uuid4().hex
        enc = encoder(tokenizer)
        wide = max(enc.size, end_id + 1) > 1 << 16
        fs.create_dir(base, recursive=True)
        data, index, tokens, at = f"part-{part:05d}-{name}.rec", f"part-{part:05d}-{name}.idx", 0, 9
        rows = 0
        with fs.open_output_stream(f"{base}/{data}") as out, fs.open_output_stream(f"{base}/{index}") as idx:
            out.write(DATA_MAGIC + bytes([4 if wide else 2]))
            idx.write(INDEX_MAGIC)
            for batch in slices(batches):
                offsets, ids = with_end(*enc.encode(batch.column("text")), end_id)
                body, width = ids.astype("<u4" if wide else "<u2").tobytes(), 4 if wide else 2
                doc = [NO_ID if x is None else x for x in batch.column("doc_id").to_pylist()]
                entries = np.empty(len(doc), _INDEX)
                entries["doc_id"], entries["n_tokens"] = doc, np.diff(offsets)
                for i, x in enumerate(doc):
                    record = frame(struct.pack("<q", x) + body[offsets[i] * width : offsets[i + 1] * width])
                    entries["offset"][i] = at
                    out.write(record)
                    at += len(record)
                idx.write(entries.tobytes())
                rows, tokens = rows + len(doc), tokens + int(offsets[-1])
        yield pa.RecordBatch.from_pylist([{"part": part, "data": f"{path}/{data}", "offsets": f"{path}/{index}", "n_docs": rows, "n_tokens": tokens, "n_bytes": at}], schema=_MANIFEST)

    rows = docs.select(F.col("doc_id").cast("long"), F.coalesce("text", F.lit("")).alias("text"))
    ordered = rows.repartitionByRange(n_files, F.col("doc_id").asc_nulls_first()).sortWithinPartitions(F.col("doc_id").asc_nulls_first(), "text")
    return keep(ordered.mapInArrow(write, MANIFEST), "manifest").orderBy("part")


_MANIFEST = pa.schema([("part", pa.int32()), ("data", pa.string()), ("offsets", pa.string()), ("n_docs", pa.int64()), ("n_tokens", pa.int64()), ("n_bytes", pa.int64())])


def read_index(path: str) -> np.ndarray:
    fs, name = filesystem(path)
    with fs.open_input_stream(name) as f:
        raw = f.read()
    if raw[:8] != INDEX_MAGIC:
        raise ValueError(f"{path}: not an offset index")
    return np.frombuffer(raw, _INDEX, offset=8)


def read_at(data: str, offsets: list[int]) -> Iterator[tuple[int | None, np.ndarray]]:
    """The records at ``offsets`` of a file in any order: a shuffled read."""
    fs, name = filesystem(data)
    with fs.open_input_file(name) as f:
        head = f.read(9)
        if head[:8] != DATA_MAGIC:
            raise ValueError(f"{data}: not a record file")
        for at in offsets:
            f.seek(int(at))
            payload = unframe(f.read, data)
            doc = struct.unpack("<q", payload[:8])[0]
            yield None if doc == NO_ID else doc, np.frombuffer(payload[8:], f"<u{head[8]}").astype("<u4")


def read_records(manifest: DataFrame) -> DataFrame:
    """``doc_id, start, ids`` (unsigned 32-bit, little-endian) of every record, streamed file by file and checked."""
    placed = manifest.withColumn("start", F.coalesce(F.sum("n_tokens").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                index, start = read_index(row["offsets"]), row["start"]
                if len(index) != row["n_docs"] or index["n_tokens"].sum() != row["n_tokens"]:
                    raise ValueError(f"{row['offsets']}: the index and the manifest differ")
                starts = start + np.cumsum(index["n_tokens"]) - index["n_tokens"]
                fs, name = filesystem(row["data"])
                with fs.open_input_stream(name, buffer_size=1 << 20) as f:
                    head = f.read(9)
                    if head[:8] != DATA_MAGIC:
                        raise ValueError(f"{row['data']}: not a record file")
                    for a in range(0, len(index), 1000):
                        docs, ids = [], []
                        for k in range(a, min(a + 1000, len(index))):
                            payload = unframe(f.read, row["data"])
                            if payload is None or struct.unpack("<q", payload[:8])[0] != index["doc_id"][k]:
                                raise ValueError(f"{row['data']}: the index and the records differ")
                            docs.append(None if index["doc_id"][k] == NO_ID else int(index["doc_id"][k]))
                            ids.append(np.frombuffer(payload[8:], f"<u{head[8]}").astype("<u4").tobytes())
                        yield pa.RecordBatch.from_arrays([pa.array(docs, pa.int64()), pa.array(starts[a : a + 1000]), pa.array(ids, pa.binary())], ["doc_id", "start", "ids"])

    return placed.repartition(max(1, manifest.count())).mapInArrow(read, "doc_id long, start long, ids binary")


def record_digest(spark: SparkSession, docs: DataFrame) -> DataFrame:
    """Write all ``docs``, read the files back: ``doc_id, start, n_tokens, ids_crc32``."""
    back = read_records(write_records(docs))
    return back.select("doc_id", "start", (F.octet_length("ids") / 4).cast("long").alias("n_tokens"), F.crc32("ids").alias("ids_crc32"))
