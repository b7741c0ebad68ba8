"""Token-id files with Elias-Fano document boundaries.

A file is a run of blocks in ascending doc_id order. A block is one self-contained image: a
header, the ids of its documents end to end, and two Elias-Fano sequences: the documents' end
offsets and their doc_ids (less the first). Such a sequence has the low bits of each number
packed, the high bits as gaps in unary, and the place of every 64th number, from which a short
scan selects any other. That takes about 2 + log2(ids per document) bits per document. Blocks
are rows of a Parquet container, which Spark writes and reads on any store.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sparkloom.llm.common import running_sum
from sparkloom.llm.tokens import END_ID, SegmentEncoder

BLOCK_IDS = 1 << 20  # a block is closed when it holds so many ids
SELECT = 64
_MAGIC = b"SLEF"
_HEADER = "<4sBBxxQQqQ"  # magic, version, bytes per id, documents, ids, first doc_id, documents with a doc_id
_SEQUENCE = "<BxxxIQQ"  # low bits, samples, lengths of upper and lower
_BITS = np.unpackbits(np.arange(256, dtype=np.uint8)[:, None], axis=1, bitorder="little")
_ONES = _BITS.sum(axis=1).astype(np.int64)
_PLACE = np.argsort(1 - _BITS, axis=1, kind="stable")  # places of a byte's ones first, in order


class EliasFano:
    """A non-decreasing sequence of offsets up to ``universe`` in near-minimal space."""

    def __init__(self, low: int, n: int, upper: np.ndarray, lower: np.ndarray, samples: np.ndarray):
        self.low, self.n, self.upper, self.lower, self.samples = low, n, upper, lower, samples

    @staticmethod
    def encode(values: np.ndarray, universe: int) -> "EliasFano":
        n = len(values)
        low = max(0, (universe // n).bit_length() - 1) if n else 0
        values = values.astype(np.uint64)
        ones = (values >> np.uint64(low)).astype(np.int64) + np.arange(n)
        bits = np.zeros(int(ones[-1]) + 1 if n else 0, np.uint8)
        bits[ones] = 1
        lower = (values[:, None] >> np.arange(low, dtype=np.uint64)[None, :]) & np.uint64(1)
        return EliasFano(
            low, n, np.packbits(bits, bitorder="little"), np.packbits(lower.astype(np.uint8).ravel(), bitorder="little"),
            ones[::SELECT].astype("<u4"),
        )

    def select(self, k: np.ndarray) -> np.ndarray:
        """The numbers at places ``k``: from the sampled place on, a scan of the bytes after it."""
        k = np.asarray(k, np.int64)
        place, left = self.samples[k // SELECT].astype(np.int64), k % SELECT
        byte = place // 8
        # ones to find, counted from the start of that byte
        left = left + _ONES[self.upper[byte] & ((1 << place % 8) - 1).astype(np.uint8)] + 1 if len(k) else left
        at = np.arange(len(k))
        while len(at):
            here = _ONES[self.upper[byte[at]]]
            at, here = at[here < left[at]], here[here < left[at]]
            left[at] -= here
            byte[at] += 1
        value = (byte * 8 + _PLACE[self.upper[byte], left - 1] - k) << self.low if len(k) else k
        for b in range(self.low):
            at = k * self.low + b
            value |= (self.lower[at // 8].astype(np.int64) >> at % 8 & 1) << b
        return value

    def image(self) -> bytes:
        head = struct.pack(_SEQUENCE, self.low, len(self.samples), len(self.upper), len(self.lower))
        return b"".join([head, self.upper.tobytes(), self.lower.tobytes(), self.samples.tobytes()])

    @staticmethod
    def read(image: bytes, at: int, n: int) -> tuple["EliasFano", int]:
        """(sequence of ``n`` numbers, place after it)."""
        low, samples, upper, lower = struct.unpack_from(_SEQUENCE, image, at)
        parts, at = [], at + struct.calcsize(_SEQUENCE)
        for size, kind in ((upper, np.uint8), (lower, np.uint8), (4 * samples, "<u4")):
            parts.append(np.frombuffer(image, kind, size // np.dtype(kind).itemsize, at))
            at += size
        return EliasFano(low, n, *parts), at


def write_block(doc_ids: list[int | None], ids: np.ndarray, counts: np.ndarray) -> bytes:
    """Image of documents in ascending doc_id order, those without one last, with ``counts`` ids each."""
    ends = np.cumsum(counts, dtype=np.int64)
    known = np.array([d for d in doc_ids if d is not None], np.int64)
    first = int(known[0]) if len(known) else 0
    names = known.astype(np.uint64) - np.array(first).astype(np.uint64)
    header = struct.pack(_HEADER, _MAGIC, 2, ids.itemsize, len(doc_ids), len(ids), first, len(known))
    return b"".join([header, EliasFano.encode(ends, len(ids)).image(), EliasFano.encode(names, int(names[-1]) if len(names) else 0).image(), ids.tobytes()])


def read_block(image: bytes) -> tuple[list[int | None], EliasFano, np.ndarray]:
    """(doc_ids, end offsets, ids)."""
    magic, version, width, n, total, first, known = struct.unpack_from(_HEADER, image)
    if magic != _MAGIC or version != 2:
        raise ValueError("not a token block")
    ends, at = EliasFano.read(image, struct.calcsize(_HEADER), n)
    names, at = EliasFano.read(image, at, known)
    doc_ids = (names.select(np.arange(known)) + first).tolist()
    return doc_ids + [None] * (n - known), ends, np.frombuffer(image, f"<u{width}", total, at)


def write(docs: DataFrame, path: str, tokenizer: str, end_id: int = END_ID) -> None:
    """Encode (doc_id, text) and write blocks in ascending doc_id order, null ids last.

    Ids of documents are integers. Null texts have the end id alone. Rows with equal ids stand
    side by side. A block holds whole documents.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = SegmentEncoder.of_worker(tokenizer)
        base, number = TaskContext.get().partitionId() << 33, 0
        names: list = []
        ids: list[np.ndarray] = []
        counts: list[np.ndarray] = []

        def block():
            held = np.concatenate(ids)
            image = write_block(names, held, np.concatenate(counts))
            return pa.RecordBatch.from_arrays(
                [pa.array([base + number], pa.int64()), pa.array([len(names)], pa.int64()), pa.array([len(held)], pa.int64()), pa.array([image], pa.binary())],
                ["block", "n_docs", "n_ids", "image"],
            )

        for batch in batches:
            doc_ids, at = batch.column(0).to_pylist(), 0
            for rows, found, lengths in encoder.encode(batch.column(1)):
                ids.append(np.insert(found, np.cumsum(lengths), end_id))
                counts.append(lengths + 1)
                names += doc_ids[at:at + rows]
                at += rows
                if sum(map(len, ids)) >= BLOCK_IDS:
                    yield block()
                    names, ids, counts, number = [], [], [], number + 1
        if names:
            yield block()

    order = F.col("doc_id").asc_nulls_last()
    ordered = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text").repartitionByRange(order).sortWithinPartitions(order)
    ordered.mapInArrow(run, "block bigint, n_docs bigint, n_ids bigint, image binary").write.parquet(path)


def read_documents(spark: SparkSession, path: str) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32) of every document in the files at ``path``."""
    blocks = spark.read.parquet(path)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for number, image in zip(batch.column(0).to_pylist(), batch.column(1)):
                names, ends, ids = read_block(image.as_py())
                stop = ends.select(np.arange(len(names)))
                start = np.r_[0, stop[:-1]] if len(stop) else stop
                wide = ids.astype("<u4")
                crc = [zlib.crc32(wide[a:b].tobytes()) for a, b in zip(start, stop)]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(names, pa.int64()), pa.array([number] * len(names), pa.int64()), pa.array(start.astype(np.int64)),
                     pa.array((stop - start).astype(np.int64)), pa.array(crc, pa.int64())],
                    ["doc_id", "number", "inside", "n_tokens", "ids_crc32"],
                )

    docs = blocks.select("block", "image").mapInArrow(run, "doc_id bigint, number bigint, inside bigint, n_tokens bigint, ids_crc32 bigint")
    offsets = running_sum(blocks.select("block", "n_ids"), ["block"], "n_ids").select("block", "before")
    return docs.join(offsets, F.col("number") == F.col("block")).select(
        "doc_id", (F.col("before") + F.col("inside")).alias("start"), "n_tokens", "ids_crc32"
    )
