"""Token-ID files: patched frame-of-reference blocks of the ids of whole texts, in ascending doc_id order.

A shard is one range of doc_ids; its ids follow each other in pages of at most ``PAGE`` ids (a row of the file), which
cut documents freely.  A page's payload holds blocks of ``BLOCK_IDS`` ids: the block's least id is subtracted, the
rest is packed at the width that holds ``PERCENTILE`` percent of the values, and larger ones are stored in an
exception list (place and high bits).  ``index`` holds where each block starts in the payload, so that a block can be
decoded alone.  Files are Parquet, written and read by Spark, so any store that it knows will do.

Edge cases: a null text counts as empty (its row is the end id alone); rows of one doc_id are ordered by text; a null
doc_id comes first; an empty table makes files without pages.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from quern.llm import common
from quern.llm.bytes import blocks
from quern.llm.tokens import pieces

PAGE, BLOCK_IDS, PERCENTILE = 1 << 16, 1024, 98.0
SCHEMA = (
    "shard int, page long, shard_start long, n_ids int, doc_number array<long>, doc_id array<long>, "
    "piece_length array<int>, closes array<boolean>, index array<int>, payload binary"
)


# ---- blocks


def pack_bits(values: np.ndarray, width: int) -> bytes:
    """Non-negative integers, ``width`` bits each, least significant bit first."""
    if not width or not len(values):
        return b""
    bits = (values[:, None] >> np.arange(width, dtype=np.uint32)) & 1
    return np.packbits(bits.astype(np.uint8).reshape(-1), bitorder="little").tobytes()


def unpack_bits(data: np.ndarray, n: int, width: int) -> np.ndarray:
    if not width or not n:
        return np.zeros(n, np.uint32)
    bits = np.unpackbits(data, count=n * width, bitorder="little").reshape(n, width)
    return bits.astype(np.uint32) @ (np.uint32(1) << np.arange(width, dtype=np.uint32))


def encode_block(ids: np.ndarray, percentile: float = PERCENTILE) -> bytes:
    """Header (count, least, width, exceptions), packed low bits, places and high bits of the exceptions."""
    least = int(ids.min()) if len(ids) else 0
    rest = (ids - np.uint32(least)).astype(np.uint32)
    width = 0
    if len(rest):
        width = int(np.partition(rest, k := min(len(rest) - 1, int(len(rest) * percentile / 100)))[k]).bit_length()
    high = rest.astype(np.uint64) >> np.uint64(width)
    out = np.flatnonzero(high)
    low = rest & np.uint32((1 << width) - 1)
    head = np.array([len(ids), least, width, len(out)], "<u4").tobytes()
    return head + pack_bits(low, width) + out.astype("<u4").tobytes() + high[out].astype("<u4").tobytes()


def decode_block(data: np.ndarray) -> np.ndarray:
    n, least, width, out = np.frombuffer(data[:16].tobytes(), "<u4").astype(int)
    packed = (n * width + 7) // 8
    ids = unpack_bits(data[16 : 16 + packed], n, width).astype(np.uint64)
    if out:
        lists = np.frombuffer(data[16 + packed : 16 + packed + 8 * out].tobytes(), "<u4")
        ids[lists[:out]] |= lists[out:].astype(np.uint64) << np.uint64(width)
    return (ids + np.uint64(least)).astype(np.uint32)


# ---- checksums of parts


def crc32_join(first: int, second: int, length: int) -> int:
    """The crc32 of two byte strings on end, from theirs and the second's length."""
    return _times(first, _power(8 * length)) ^ second


_POLY = 0xEDB88320


def _times(a: int, b: int) -> int:
    """Product of two polynomials over GF(2), modulo that of crc32 (bits reversed: x**0 is the highest)."""
    out = 0
    for i in range(31, -1, -1):
        if a >> i & 1:
            out ^= b
        b = (b >> 1) ^ (_POLY if b & 1 else 0)
    return out


def _power(n: int) -> int:
    """x**n modulo the polynomial."""
    out, base = 1 << 31, 1 << 30
    while n:
        if n & 1:
            out = _times(out, base)
        base = _times(base, base)
        n >>= 1
    return out


# ---- writing and reading


def write(documents: DataFrame, at: str, path: str, end_id: int = 0, lead: bool = True) -> None:
    """Writes the ids of all texts, each with ``end_id`` after it, below the folder ``at``."""

    def shard(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = TaskContext.get().partitionId()  # ranges of doc_id ascend with it
        encoder, page, start, docs = pieces(path, lead), 0, 0, 0
        waiting: list[tuple[np.ndarray, list]] = []
        held = 0

        def row(ids: np.ndarray, parts: list) -> pa.RecordBatch:
            coded = [encode_block(ids[i : i + BLOCK_IDS]) for i in range(0, len(ids), BLOCK_IDS)]
            index = np.cumsum([0, *map(len, coded)])[:-1]
            values = {
                "shard": number,
                "page": page,
                "shard_start": start,
                "n_ids": len(ids),
                "doc_number": [p[0] for p in parts],
                "doc_id": [p[1] for p in parts],
                "piece_length": [p[2] for p in parts],
                "closes": [p[3] for p in parts],
                "index": index.tolist(),
                "payload": b"".join(coded),
            }
            return pa.RecordBatch.from_pylist([values], schema=_ARROW)

        for batch in batches:
            for block in blocks(batch.column(1)):
                flat, where = encoder.encode(block)
                names = batch.column(0).slice(block.first, block.rows).to_pylist()
                for r in range(block.rows):
                    ids = np.append(flat[where[r] : where[r + 1]], np.uint32(end_id))
                    while len(ids):
                        part, ids = ids[: PAGE - held], ids[PAGE - held :]
                        waiting.append((part, [docs, names[r], len(part), not len(ids)]))
                        held += len(part)
                        if held == PAGE:
                            yield row(np.concatenate([w[0] for w in waiting]), [w[1] for w in waiting])
                            page, start, held, waiting = page + 1, start + held, 0, []
                    docs += 1
        if waiting:
            yield row(np.concatenate([w[0] for w in waiting]), [w[1] for w in waiting])

    d = documents.select(F.col("doc_id").cast("long"), F.coalesce("text", F.lit("")).alias("text"))
    n = common.partitions(documents.sparkSession)
    d = d.repartitionByRange(n, F.col("doc_id").asc_nulls_first())
    d = d.sortWithinPartitions(F.col("doc_id").asc_nulls_first(), "text")
    d.mapInArrow(shard, SCHEMA).write.parquet(at)


_ARROW = pa.schema(
    [
        ("shard", pa.int32()),
        ("page", pa.int64()),
        ("shard_start", pa.int64()),
        ("n_ids", pa.int32()),
        ("doc_number", pa.list_(pa.int64())),
        ("doc_id", pa.list_(pa.int64())),
        ("piece_length", pa.list_(pa.int32())),
        ("closes", pa.list_(pa.bool_())),
        ("index", pa.list_(pa.int32())),
        ("payload", pa.binary()),
    ]
)


def read_pieces(spark: SparkSession, at: str) -> DataFrame:
    """From the files, for each piece of a document: where it lies, its length, its ids' crc32, and whether it ends it."""
    schema = "shard int, doc_number long, doc_id long, shard_start long, length long, crc long, closes boolean"

    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: dict[str, list] = {c.split()[0]: [] for c in schema.split(", ")}
            for row in batch.to_pylist():
                data = np.frombuffer(row["payload"], np.uint8)
                bounds = [*row["index"], len(data)]
                ids = np.concatenate([decode_block(data[a:b]) for a, b in zip(bounds, bounds[1:], strict=False)])
                raw, place = ids.astype("<u4").tobytes(), 0
                for number, name, length, closes in zip(
                    row["doc_number"], row["doc_id"], row["piece_length"], row["closes"], strict=True
                ):
                    crc = zlib.crc32(raw[4 * place : 4 * (place + length)])
                    for k, v in zip(
                        out, (row["shard"], number, name, row["shard_start"] + place, length, crc, closes), strict=True
                    ):
                        out[k].append(v)
                    place += length
            yield pa.RecordBatch.from_pydict(out, schema=_PIECES)

    return spark.read.schema(SCHEMA).parquet(at).mapInArrow(decode, schema)


_PIECES = pa.schema(
    [
        ("shard", pa.int32()),
        ("doc_number", pa.int64()),
        ("doc_id", pa.int64()),
        ("shard_start", pa.int64()),
        ("length", pa.int64()),
        ("crc", pa.int64()),
        ("closes", pa.bool_()),
    ]
)


def read_documents(spark: SparkSession, at: str) -> DataFrame:
    """For each document of the files doc_id, start, n_tokens and ids_crc32; ``start`` counts all ids before it."""

    @F.udf("long")
    def joined(parts: list | None) -> int | None:
        crc = 0 if parts else None
        for _, length, part in parts or ():
            crc = crc32_join(crc, part, 4 * length)
        return crc

    d = read_pieces(spark, at).groupBy("shard", "doc_number").agg(
        F.first("doc_id").alias("doc_id"),
        F.min("shard_start").alias("shard_start"),
        F.sum("length").alias("n_tokens"),
        F.count("*").alias("parts"),
        F.min("crc").alias("crc"),
        F.array_sort(F.collect_list(F.struct("shard_start", "length", "crc"))).alias("list"),
    )
    d = d.withColumn("list", F.when(F.col("parts") > 1, F.col("list")))
    # one row for each shard, of which there are as many as tasks wrote
    sizes = spark.read.schema(SCHEMA).parquet(at).groupBy("shard").agg(F.sum("n_ids").alias("ids"))
    before = Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    bases = sizes.select("shard", F.coalesce(F.sum("ids").over(before), F.lit(0)).alias("base"))
    d = d.join(F.broadcast(bases), "shard")
    return d.select(
        "doc_id",
        (F.col("base") + F.col("shard_start")).alias("start"),
        F.col("n_tokens").cast("long").alias("n_tokens"),
        F.when(F.col("parts") == 1, F.col("crc")).otherwise(joined("list")).alias("ids_crc32"),
    )
