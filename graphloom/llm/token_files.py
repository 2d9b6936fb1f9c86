"""Token-id files in patched frame-of-reference blocks.

Documents are dealt by ranges of doc_id, encoded, and written as binary files in ascending order of doc_id: the files
of a range, of FILE_SEGMENTS segments at most, are read by as many tasks.  A file is a row of segments; numbers are little-endian:

    segment   "GLTK", u32 bytes of the segment, u32 documents, u32 ids, u32 blocks,
              documents x (i64 doc_id, u32 ids),
              blocks x u32 start of the block in the segment's body,
              body
    block     u32 minimum, u8 width, u8 width of the high parts, u16 exceptions,
              ids minus the minimum, `width` low bits each,
              exceptions x u16 place, exceptions x high part of `high` bits

A block holds BLOCK ids (the last one fewer).  Its width is the smallest that holds a given share
of its values; what remains of larger values goes to the exception list (patched frame of
reference; Zukowski et al. 2006, Lemire and Boytsov 2015).  The block starts are an index: any block is
decoded without the others.  Each segment is followed by one line feed, the separator of the writer.

Defined cases: null and empty texts have their end id alone; null ids come first and come back as
null; rows of one doc_id stand in the order of their texts, equal rows each; very long texts are encoded in parts and
lie in one segment of their own size; other columns, whatever their names, are not read; an empty table gives no documents.
"""

from __future__ import annotations

import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from graphloom.llm.common import join_small, materialize, new_path, trimmed
from graphloom.llm.tokens import batch_encoder

BLOCK = 4096
#: Share of a block's values that its width must hold.
PERCENTILE = 0.95
#: Ids after which a segment is closed; bounds the memory of writer and reader.
SEGMENT_IDS = 1_000_000
#: Segments in a file at most; bounds what a reader holds (some 40 MB) whatever the size of a range.
FILE_SEGMENTS = 16
MAGIC = b"GLTK"
_NULL_ID = -(1 << 63)
_HEAD = struct.Struct("<4sIIII")
_BLOCK = struct.Struct("<IBBH")


def pack_bits(values: np.ndarray, width: int) -> bytes:
    if width == 0 or len(values) == 0:
        return b""
    bits = (values.astype(np.uint32)[:, None] >> np.arange(width, dtype=np.uint32)) & np.uint32(1)
    return np.packbits(bits.astype(np.uint8).reshape(-1), bitorder="little").tobytes()


def unpack_bits(raw: bytes, n: int, width: int) -> np.ndarray:
    if width == 0 or n == 0:
        return np.zeros(n, np.uint32)
    bits = np.unpackbits(np.frombuffer(raw, np.uint8), count=n * width, bitorder="little")
    padded = np.zeros((n, 32), np.uint8)
    padded[:, :width] = bits.reshape(n, width)
    return np.packbits(padded.reshape(-1), bitorder="little").view("<u4")


def encode_block(ids: np.ndarray, percentile: float = PERCENTILE) -> bytes:
    low = int(ids.min())
    rest = ids - np.uint32(low)
    ranked = np.sort(rest)
    width = int(ranked[max(0, int(np.ceil(percentile * len(ids))) - 1)]).bit_length()
    at = np.flatnonzero(rest >> np.uint32(width)) if width < 32 else np.zeros(0, np.int64)
    high = rest[at] >> np.uint32(width) if len(at) else np.zeros(0, np.uint32)
    high_width = int(high.max()).bit_length() if len(at) else 0
    mask = np.uint32((1 << width) - 1)
    return _BLOCK.pack(low, width, high_width, len(at)) + pack_bits(rest & mask, width) + at.astype("<u2").tobytes() + pack_bits(high, high_width)


def decode_block(raw: bytes, n: int) -> np.ndarray:
    low, width, high_width, exceptions = _BLOCK.unpack_from(raw)
    at = _BLOCK.size
    end = at + (n * width + 7) // 8
    out = unpack_bits(raw[at:end], n, width)
    if exceptions:
        places = np.frombuffer(raw, "<u2", exceptions, end)
        high = unpack_bits(raw[end + 2 * exceptions :][: (exceptions * high_width + 7) // 8], exceptions, high_width)
        out[places] |= high << np.uint32(width)
    return out + np.uint32(low)


def encode_segment(doc_ids: list[int], counts: list[int], ids: np.ndarray, block: int = BLOCK, percentile: float = PERCENTILE) -> bytes:
    blocks = [encode_block(ids[i : i + block], percentile) for i in range(0, len(ids), block)]
    starts = np.cumsum([0, *map(len, blocks)])[: len(blocks)].astype("<u4").tobytes()
    table = b"".join(struct.pack("<qI", d, n) for d, n in zip(doc_ids, counts, strict=True))
    body = table + starts + b"".join(blocks)
    return _HEAD.pack(MAGIC, _HEAD.size + len(body), len(doc_ids), len(ids), len(blocks)) + body


def segment_block(raw: bytes, k: int, at: int = 0, block: int = BLOCK) -> np.ndarray:
    """Random access: the ids of block k of the segment at byte `at`, by the index."""
    _, _, documents, ids, blocks = _HEAD.unpack_from(raw, at)
    index = at + _HEAD.size + 12 * documents
    (start,) = struct.unpack_from("<I", raw, index + 4 * k)
    end = struct.unpack_from("<I", raw, index + 4 * k + 4)[0] if k + 1 < blocks else None
    body = index + 4 * blocks
    size = at + _HEAD.unpack_from(raw, at)[1]
    return decode_block(raw[body + start : body + end if end is not None else size], min(block, ids - k * block))


def read_segments(raw: bytes) -> Iterator[tuple[list[int], list[int], np.ndarray]]:
    at = 0
    while at < len(raw):
        magic, size, documents, ids, blocks = _HEAD.unpack_from(raw, at)
        if magic != MAGIC:
            raise ValueError(f"no segment at byte {at}")
        table = np.frombuffer(raw, np.dtype([("doc", "<i8"), ("n", "<u4")]), documents, at + _HEAD.size)
        got = [segment_block(raw, k, at) for k in range(blocks)]
        yield table["doc"].tolist(), table["n"].tolist(), np.concatenate(got) if got else np.zeros(0, np.uint32)
        at += size + 1  # and the line feed


def write_token_files(df: DataFrame, vocabulary: str, end_id: int, path: str, doc_id: str = "doc_id", text: str = "text", files: int | None = None) -> None:
    """Encode every text and write the ids under path, in ascending order of doc_id over the files' names."""
    spark = df.sparkSession
    files = files or int(spark.conf.get("spark.sql.shuffle.partitions"))
    end = np.array([end_id], "<u4").tobytes()
    rows = df.select(F.col(doc_id).cast("long").alias("doc_id"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    dealt = rows.repartitionByRange(files, F.col("doc_id").asc_nulls_first(), F.xxhash64("text")).sortWithinPartitions(F.col("doc_id").asc_nulls_first(), "text")

    def run(batches):
        encode = batch_encoder(vocabulary).encode
        doc_ids, counts, parts, n = [], [], [], 0

        def segment():
            return pa.RecordBatch.from_arrays([pa.array([encode_segment(doc_ids, counts, np.frombuffer(b"".join(parts), "<u4"))], pa.binary())], names=["segment"])

        for batch in batches:
            for key, ids in zip(batch.column(0).to_pylist(), encode(batch.column(1)), strict=True):
                ids += end
                doc_ids.append(_NULL_ID if key is None else key)
                counts.append(len(ids) // 4)
                parts.append(ids)
                n += counts[-1]
                if n >= SEGMENT_IDS:
                    yield segment()
                    doc_ids, counts, parts, n = [], [], [], 0
        if doc_ids:
            yield segment()

    # Spark's own writer commits the files; the bytes of the string column are written as they are
    dealt.mapInArrow(trimmed(run), "segment binary").select(F.col("segment").cast("string").alias("value")).write.option("lineSep", "\n").option("maxRecordsPerFile", FILE_SEGMENTS).text(path)


def _file_number(path: Column) -> Column:
    """The order of the writer's files: its task, then its file of that task, whatever the number of digits."""
    name = F.element_at(F.split(path, "/"), -1)
    task, of_task = (F.regexp_extract(name, r"^part-(\d+)-.*-c(\d+)", i).cast("long") for i in (1, 2))
    return task * 1_000_000 + of_task


def read_token_files(spark: SparkSession, path: str) -> DataFrame:
    """One row for each document of the files: file (its order among all), place in it, doc_id, ids before it in the file, n_tokens, ids (binary)."""

    def run(batches):
        for batch in batches:
            for name, raw in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                start, place = 0, 0
                for doc_ids, counts, ids in read_segments(raw):
                    at = np.cumsum([0, *counts])
                    values = [ids[a:b].tobytes() for a, b in zip(at, at[1:])]
                    n = len(counts)
                    yield pa.RecordBatch.from_arrays(
                        [
                            pa.array([name] * n, pa.int64()), pa.array(range(place, place + n), pa.int64()), pa.array([None if d == _NULL_ID else d for d in doc_ids], pa.int64()),
                            pa.array((at[:-1] + start).tolist(), pa.int64()), pa.array(counts, pa.int64()), pa.array(values, pa.binary()),
                        ],
                        names=["file", "place", "doc_id", "file_start", "n_tokens", "ids"],
                    )
                    start, place = start + int(at[-1]), place + n

    files = spark.read.format("binaryFile").option("pathGlobFilter", "part-*").load(path).select(_file_number(F.col("path")).alias("file"), "content")
    return files.mapInArrow(trimmed(run), "file long, place long, doc_id long, file_start long, n_tokens long, ids binary")


def with_global_starts(documents: DataFrame) -> DataFrame:
    """Replace file_start by start, the ids of all documents before.  `documents` is materialized: one small row for each file is summed."""
    totals = documents.groupBy("file").agg(F.sum("n_tokens").alias("__gl_n"))
    before = F.coalesce(F.sum("__gl_n").over(Window.orderBy("file").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    firsts = materialize(totals.select("file", before.alias("__gl_before")), "file-starts")
    return join_small(documents, firsts, "file", "inner").withColumn("start", F.col("file_start") + F.col("__gl_before")).drop("__gl_before", "file_start")


def vocabulary_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    from graphloom.llm.common import table

    path = new_path(spark, "token-files")
    write_token_files(table(spark, sf_dir, "documents"), vocabulary_path(), 2, path)
    digests = materialize(read_token_files(spark, path).select("file", "doc_id", "file_start", "n_tokens", F.crc32("ids").alias("ids_crc32")), "token-documents")
    return with_global_starts(digests).select("doc_id", "start", "n_tokens", "ids_crc32")
