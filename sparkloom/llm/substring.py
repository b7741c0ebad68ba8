"""Exact substring dedup with a count-min prefilter.

A window is a run of consecutive words of one document; every word covered by a window that
starts anywhere else too is removed. The first pass counts in a count-min sketch and the
second groups by content only the windows that the merged sketch estimates to be repeated.

The sketch counts an anchor per window: the run of ANCHOR words with the smallest hash in it.
Neighbouring windows mostly share their anchor, so there are some 14 times fewer anchors than
windows, and a repeated window has a repeated anchor: the estimate is never too small, and
nothing is lost. The cells of a sketch and the pairs it lets through are summed in each task
before they are shuffled, so a passage that many documents share costs a row per task and not
per document.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sparkloom.llm.common import byte_size
from sparkloom.session import materialise

WINDOW = 35
ANCHOR = 8
ROWS = 2  # hash rows of the sketch
SKETCH_BYTES = 64 << 20  # of the merged sketch, one bit per cell; beyond it more windows pass and are grouped exactly
BLOCK_CELLS = 1 << 20
CHUNK_WORDS = 1 << 20  # words a task sketches or groups before it emits
BUCKET_WINDOWS = 1 << 21  # windows that would meet in a bucket if all were repeated

_M1, _M2 = np.uint64(0xFF51AFD7ED558CCD), np.uint64(0xC4CEB9FE1A85EC53)


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(33))) * _M1
    x = (x ^ (x >> np.uint64(29))) * _M2
    return x ^ (x >> np.uint64(32))


def _runs(hashes: np.ndarray, length: int) -> np.ndarray:
    """Hash of each run of ``length`` words, by doubling."""
    done, out, power, span = 0, None, hashes, 1
    while True:
        if length & span:
            n = len(hashes) - done - span + 1
            part = power[done:done + n]
            out = part if out is None else _mix(out[:n] * np.uint64(0x9E3779B97F4A7C15) + part)
            done += span
        if done == length:
            return out[: len(hashes) - length + 1]
        power = _mix(power[:-span] * np.uint64(0xBF58476D1CE4E5B9) + power[span:])
        span *= 2


def _least(x: np.ndarray, width: int) -> np.ndarray:
    """Minimum of each run of ``width`` numbers, by doubling."""
    span, n = 1, len(x) - width + 1
    while span * 2 <= width:
        x = np.minimum(x[:-span], x[span:])
        span *= 2
    return np.minimum(x[:n], x[width - span:width - span + n])


class WindowHashes:
    """Per text: hashes of its windows, the anchor hash of each, and the hash at each anchor's place."""

    def __init__(self):
        self.known: dict[bytes, int] = {}

    def of(self, text: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray] | None:
        words = text.split()
        if len(words) < WINDOW:
            return None
        if len(self.known) > 500_000:
            self.known.clear()
        known, hash64 = self.known, xxhash.xxh3_64_intdigest
        for w in set(words).difference(known):
            known[w] = hash64(w)
        hashes = np.fromiter(map(known.__getitem__, words), np.uint64, len(words))
        runs, width = _runs(hashes, ANCHOR), WINDOW - ANCHOR + 1
        least = _least(runs, width)
        # a place is an anchor if one of the windows over it has no smaller hash
        edge = np.full(width - 1, ~np.uint64(0))
        most = ~_least(np.concatenate([edge, ~least, edge]), width)
        return _runs(hashes, WINDOW), least, runs[most == runs]


def _cells(anchor: np.ndarray, cells: int) -> Iterator[np.ndarray]:
    """Cell numbers of the anchors in each row of the sketch."""
    for row in range(ROWS):
        yield (_mix(anchor + np.uint64(row + 1)) % np.uint64(cells // ROWS)).astype(np.int64) + row * (cells // ROWS)


def sketch_cells(text_bytes: int) -> int:
    """About 16 cells per anchor at six bytes per word, a power of two within SKETCH_BYTES."""
    wanted = max(1, text_bytes // 6 * 2 // (WINDOW - ANCHOR + 2)) * 16
    return int(min(SKETCH_BYTES * 8, max(BLOCK_CELLS, 1 << wanted.bit_length())))


def merged_sketch(docs: DataFrame, cells: int) -> np.ndarray:
    """Bits of the cells whose estimate is two or more.

    Tasks emit their sparse sketches by block of cells, blocks are added up on the executors,
    and the driver gets one bit per cell, SKETCH_BYTES at most.
    """

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes, held, words = WindowHashes(), [], 0

        def emit():
            found, counts = np.unique(np.concatenate([c for a in held for c in _cells(a, cells)]), return_counts=True)
            block = found // BLOCK_CELLS
            at = np.flatnonzero(np.r_[True, block[1:] != block[:-1]])
            ends = [*at[1:].tolist(), len(block)]
            # bit 31 marks a cell met more than once here
            packed = ((found % BLOCK_CELLS) | ((counts > 1).astype(np.int64) << 31)).astype("<u4")
            return pa.RecordBatch.from_arrays(
                [pa.array(block[at].astype(np.int32)), pa.array([packed[a:b].tobytes() for a, b in zip(at, ends)], pa.binary())], ["block", "cells"]
            )

        for batch in batches:
            for text in batch.column(0).cast(pa.large_binary()):
                found = hashes.of(text.as_py() or b"")
                if found is None:
                    continue
                held.append(found[2])
                words += len(found[0])
                if words >= CHUNK_WORDS:
                    yield emit()
                    held, words = [], 0
        if held:
            yield emit()

    def add(group: pa.Table) -> pa.Table:
        counts = np.zeros(BLOCK_CELLS, np.uint8)
        for part in group.column("cells"):
            packed = np.frombuffer(part.as_py(), "<u4")
            at = packed & 0x7FFFFFFF  # distinct within a part
            counts[at] = np.minimum(counts[at] + 1 + (packed >> 31), 2)
        return pa.table({"block": pa.array([group.column("block")[0].as_py()], pa.int32()), "bits": pa.array([np.packbits(counts > 1, bitorder="little").tobytes()], pa.binary())})

    parts = docs.select("text").mapInArrow(partial, "block int, cells binary")
    merged = parts.groupBy("block").applyInArrow(add, "block int, bits binary")
    bits = np.zeros(cells // 8, np.uint8)
    for row in merged.toLocalIterator():
        start = row["block"] * (BLOCK_CELLS // 8)
        bits[start:start + BLOCK_CELLS // 8] = np.frombuffer(row["bits"], np.uint8)
    return bits



def repeated_starts(docs: DataFrame, sketch: np.ndarray, cells: int, buckets: int) -> DataFrame:
    """(doc_id, th, starts): places where a window starts whose words start elsewhere too; th is the text's hash.

    ``docs`` has doc_id, th and text. Several rows may name one document.
    """
    shared = docs.sparkSession.sparkContext.broadcast(sketch)  # SKETCH_BYTES at most

    def candidates(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes, bits = WindowHashes(), shared.value
        ids, marks, held, words = [], [], [], 0
        chunk = TaskContext.get().partitionId() << 33

        def emit():
            window = np.concatenate([h for _, h, _ in held])
            row = np.concatenate([np.full(len(h), r, np.int64) for r, h, _ in held])
            start = np.concatenate([s for _, _, s in held]).astype(np.int64)
            order = np.argsort(window, kind="stable")
            window, row, start = window[order], row[order], start[order]
            first = np.r_[True, window[1:] != window[:-1]]
            several = ~first | np.r_[~first[1:], False]
            # met twice here: known to be repeated, and one entry tells the other tasks
            yield pa.RecordBatch.from_arrays([
                pa.array([-1], pa.int32()), pa.array([chunk], pa.int64()), pa.array([ids], pa.list_(id_type)), pa.array([marks], pa.list_(pa.int64())),
                pa.nulls(1, pa.binary()), pa.array([row[several].astype("<u4").tobytes()], pa.binary()), pa.array([start[several].astype("<u4").tobytes()], pa.binary()),
            ], names)
            keep = np.flatnonzero(first)
            bucket = (window[keep] % np.uint64(buckets)).astype(np.int64)
            by_bucket = np.argsort(bucket, kind="stable")
            keep, bucket = keep[by_bucket], bucket[by_bucket]
            at = np.flatnonzero(np.r_[True, bucket[1:] != bucket[:-1]])
            parts = [keep[a:b] for a, b in zip(at, [*at[1:].tolist(), len(bucket)])]
            packed = (start | (several.astype(np.int64) << 31)).astype("<u4")
            yield pa.RecordBatch.from_arrays([
                pa.array(bucket[at].astype(np.int32)), pa.array(np.full(len(at), chunk)), pa.nulls(len(at), pa.list_(id_type)), pa.nulls(len(at), pa.list_(pa.int64())),
                pa.array([window[k].tobytes() for k in parts], pa.binary()), pa.array([row[k].astype("<u4").tobytes() for k in parts], pa.binary()),
                pa.array([packed[k].tobytes() for k in parts], pa.binary()),
            ], names)

        for batch in batches:
            for i, text in enumerate(batch.column(2).cast(pa.large_binary())):
                found = hashes.of(text.as_py() or b"")
                if found is None:
                    continue
                window, anchor, _ = found
                change = np.r_[True, anchor[1:] != anchor[:-1]]
                passed = np.ones(int(change.sum()), bool)
                for c in _cells(anchor[change], cells):
                    passed &= (bits[c >> 3] >> (c & 7).astype(np.uint8) & 1).astype(bool)
                start = np.flatnonzero(passed[np.cumsum(change) - 1])
                if len(start):
                    held.append((len(ids), window[start], start))
                    ids.append(batch.column(0)[i].as_py())
                    marks.append(batch.column(1)[i].as_py())
                    words += len(start)
                if words >= CHUNK_WORDS:
                    yield from emit()
                    ids, marks, held, words, chunk = [], [], [], 0, chunk + 1
        if held:
            yield from emit()

    names = ["bucket", "chunk", "ids", "ths", "windows", "rows", "starts"]
    id_sql = docs.schema["doc_id"].dataType.simpleString()
    id_type = {"bigint": pa.int64(), "int": pa.int32(), "string": pa.string()}[id_sql]

    def numbers(column: pa.ChunkedArray, kind: str) -> tuple[np.ndarray, np.ndarray]:
        """(all numbers of a binary column, their counts by row)."""
        parts = [np.frombuffer(v.as_py(), kind) for v in column]
        return np.concatenate(parts), np.array([len(p) for p in parts])

    def group(table: pa.Table) -> pa.Table:
        """Answer every chunk's entries of a bucket: those whose window is met again."""
        window, counts = numbers(table.column("windows"), "<u8")
        row, start = numbers(table.column("rows"), "<u4")[0], numbers(table.column("starts"), "<u4")[0]
        chunk = np.repeat(table.column("chunk").to_numpy(), counts)
        order = np.argsort(window, kind="stable")
        same = window[order][1:] == window[order][:-1]
        again = np.zeros(len(window), bool)
        again[order] = np.r_[False, same] | np.r_[same, False]
        hit = np.flatnonzero(again & (start >> 31 == 0))  # marked ones are known already
        hit = hit[np.argsort(chunk[hit], kind="stable")]
        at = np.flatnonzero(np.r_[True, chunk[hit][1:] != chunk[hit][:-1]]) if len(hit) else hit
        parts = [hit[a:b] for a, b in zip(at, [*at[1:].tolist(), len(hit)])]
        return pa.table({
            "chunk": pa.array(chunk[hit[at]], pa.int64()), "ids": pa.nulls(len(at), pa.list_(id_type)), "ths": pa.nulls(len(at), pa.list_(pa.int64())),
            "rows": pa.array([row[k].tobytes() for k in parts], pa.binary()), "starts": pa.array([start[k].tobytes() for k in parts], pa.binary()),
        })

    def per_document(table: pa.Table) -> pa.Table:
        """Bring the answers of a chunk together by its documents."""
        known = np.flatnonzero(table.column("ids").is_valid().to_numpy())[0]
        ids, marks = table.column("ids")[known].as_py(), table.column("ths")[known].as_py()
        row, start = numbers(table.column("rows"), "<u4")[0], numbers(table.column("starts"), "<u4")[0]
        order = np.argsort(row, kind="stable")
        row, start = row[order], start[order]
        at = np.flatnonzero(np.r_[True, row[1:] != row[:-1]]) if len(row) else order
        ends = [*at[1:].tolist(), len(row)]
        return pa.table({
            "doc_id": pa.array([ids[r] for r in row[at]], id_type), "th": pa.array([marks[r] for r in row[at]], pa.int64()),
            "starts": pa.array([start[a:b].tobytes() for a, b in zip(at, ends)], pa.binary()),
        })

    answer = f"chunk bigint, ids array<{id_sql}>, ths array<bigint>, rows binary, starts binary"
    # chunk numbers name rows of this table, so it is stored before they are used
    sent = materialise(docs.select("doc_id", "th", "text").mapInArrow(
        candidates, f"bucket int, chunk bigint, ids array<{id_sql}>, ths array<bigint>, windows binary, rows binary, starts binary"), "candidates")
    across = sent.filter("bucket >= 0").groupBy("bucket").applyInArrow(group, answer)
    local = sent.filter("bucket < 0").select("chunk", "ids", "ths", "rows", "starts")
    return local.unionByName(across).groupBy("chunk").applyInArrow(per_document, f"doc_id {id_sql}, th bigint, starts binary")


def remove_repeats(docs: DataFrame) -> DataFrame:
    """(doc_id, n_words, n_removed, kept_text), one row per row of ``docs``.

    Words are runs without ASCII white space, unchanged; kept words are joined by one space.
    Windows are judged on the input. Null and empty texts have no words; texts of fewer than
    35 words lose none. Repeated rows are documents of their own, so their windows repeat;
    ids may be null. An empty table gives an empty result.

    Windows are compared by 64-bit hashes of words mixed to 64 bits.
    """
    total = docs.agg(F.sum(byte_size(F.col("text")))).first()[0] or 0
    cells = sketch_cells(total)
    sketch = merged_sketch(docs, cells)
    named = docs.select("doc_id", F.coalesce(F.xxhash64("text"), F.lit(0)).alias("th"), "text")
    buckets = max(1, total // 6 // BUCKET_WINDOWS) + docs.sparkSession.sparkContext.defaultParallelism
    found = materialise(repeated_starts(named, sketch, cells, buckets), "repeats")
    # bounded by the words of one document
    starts = found.groupBy(F.col("doc_id").alias("r_id"), F.col("th").alias("r_th")).agg(F.collect_list("starts").alias("starts"))
    joined = named.join(starts, F.col("doc_id").eqNullSafe(F.col("r_id")) & (F.col("th") == F.col("r_th")), "left").select("doc_id", "text", "starts")

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n_words, n_removed, kept = [], [], []
            for text, parts in zip(batch.column(1).cast(pa.large_binary()), batch.column(2)):
                words = (text.as_py() or b"").split()
                parts = parts.as_py()
                if parts:
                    at = np.concatenate([np.frombuffer(p, "<u4") for p in parts]) & 0x7FFFFFFF
                    edge = np.zeros(len(words) + 1, np.int64)
                    np.add.at(edge, at, 1)
                    np.add.at(edge, at + WINDOW, -1)
                    stay = np.cumsum(edge[:-1]) == 0
                    left = [w for w, s in zip(words, stay.tolist()) if s]
                else:
                    left = words
                n_words.append(len(words))
                n_removed.append(len(words) - len(left))
                kept.append(b" ".join(left))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(n_words, pa.int64()), pa.array(n_removed, pa.int64()), pa.array(kept, pa.binary()).cast(pa.string())],
                ["doc_id", "n_words", "n_removed", "kept_text"],
            )

    id_sql = docs.schema["doc_id"].dataType.simpleString()
    return joined.mapInArrow(cut, f"doc_id {id_sql}, n_words bigint, n_removed bigint, kept_text string")
