"""Alignment of two tokenizers over the distinct texts of a corpus.

Documents are shuffled by their full text, and every distinct text is tokenised and aligned
once. Both vocabularies cut a text before a space that follows a visible character and before
punctuation that ends a word (no piece of B reaches over such a place, which is checked), so a
text's alignment is that of its segments, and a batch works out each distinct segment once.

The result of a chunk of texts is stored with the chunk's own list of linked id pairs. Pair
counts weigh a text by the number of its copies, are summed by Spark, and go back to the chunks
by a join on the pair. Measures of texts go to documents by a join on the text's digest. No count
table is broadcast.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sparkloom.llm.textbatch import column_bytes
from sparkloom.llm.tokens import Memory, distinct_segments, of_worker, ragged_take, row_groups, segment_starts
from sparkloom.session import materialise

CHUNK_BYTES = 2 << 20  # whole texts of about so much are aligned and stored together
MEMORY_SEGMENTS = 60_000  # alignments a Python worker remembers
STEP_SEGMENTS = 8_000  # segments encoded at once; the encoder's objects are large
LARGE_GROUP = 4096  # links
_MEASURES = ("n_a", "n_b", "n_groups", "n_links")


def _byte_of_letter() -> dict[str, int]:
    """Byte-level vocabularies write a visible byte as itself and the others as the letters from 256 on."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in shown]
    return {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(rest)}


class SegmentAligner:
    """Aligns segments of space and text; one per pair of tokenizer files and Python worker."""

    def __init__(self, path_a: str, path_b: str):
        import sentencepiece
        from sentencepiece import sentencepiece_model_pb2
        from tokenizers import Tokenizer

        self.a = Tokenizer.from_file(path_a)
        self.a.encode_special_tokens = True  # their strings in a text are ordinary text
        letters = _byte_of_letter()
        self.bytes_a = [b""] * self.a.get_vocab_size()
        for token, number in self.a.get_vocab().items():
            self.bytes_a[number] = bytes(letters[c] for c in token) if all(c in letters for c in token) else token.encode()
        model = sentencepiece_model_pb2.ModelProto.FromString(open(path_b, "rb").read())
        model.normalizer_spec.add_dummy_prefix = False  # the space is part of the segments
        self.b = sentencepiece.SentencePieceProcessor(model_proto=model.SerializeToString())
        self.bytes_b = []
        for number in range(self.b.get_piece_size()):
            piece = self.b.id_to_piece(number)
            self.bytes_b.append(bytes([int(piece[3:-1], 16)]) if self.b.is_byte(number) else piece.replace("▁", " ").encode())
        ordinary = (self.b.id_to_piece(i) for i in range(self.b.get_piece_size()) if not (self.b.is_byte(i) or self.b.is_control(i) or self.b.is_unknown(i)))
        if any(_OVER.search(piece) for piece in ordinary):
            raise ValueError("pieces of B reach over the ends of segments")
        self.memory = Memory(MEMORY_SEGMENTS)
        self.tables = [np.frombuffer(b"".join(t), np.uint8) for t in (self.bytes_a, self.bytes_b)]
        self.lengths = [np.array([len(x) for x in t], np.int64) for t in (self.bytes_a, self.bytes_b)]
        shown = [f"{i}{c}".encode() for i in range(max(len(self.bytes_a), len(self.bytes_b))) for c in ",|;"]
        self.shown, self.shown_lengths = np.frombuffer(b"".join(shown), np.uint8), np.array([len(x) for x in shown], np.int64)

    def encode(self, segments: list[bytes]) -> tuple[list[list[int]], list[list[int]]]:
        """Ids by A and by B."""
        texts = [s.decode("utf-8", "replace") for s in segments]
        return [e.ids for e in self.a.encode_batch_fast(texts, add_special_tokens=False)], self.b.encode(texts, num_threads=1)

    def align(self, segments: list[bytes]) -> list[tuple | None]:
        """See :meth:`_align`; a bounded number of segments at a time."""
        return [value for a in range(0, len(segments), STEP_SEGMENTS) for value in self._align(segments[a:a + STEP_SEGMENTS])]

    def _align(self, segments: list[bytes]) -> list[tuple | None]:
        """Per segment, as bytes, (its four measures, pairs, their occurrences, groups as text); None if a tokenizer does not give it back.

        All segments are aligned together: tokens lie end to end, and a group ends where an A
        token and a B token do. Each group of the text ends with a semicolon.
        """
        n, raw = len(segments), np.frombuffer(b"".join(segments), np.uint8)
        size = np.fromiter(map(len, segments), np.int64, n)
        sides, good = [], np.ones(n, bool)
        for ids, length in zip(self.encode(segments), self.lengths):
            counts = np.fromiter(map(len, ids), np.int64, n)
            ids, of = np.fromiter(chain.from_iterable(ids), np.int64, int(counts.sum())), np.repeat(np.arange(n), counts)
            good &= np.bincount(of, length[ids], n) == size
            sides.append((ids, of))
        byte_of = np.repeat(np.arange(n), size)
        fits = good.copy()
        for (ids, of), length, table in zip(sides, self.lengths, self.tables):
            other = ragged_take(table, length, ids[fits[of]]) != raw[fits[byte_of]]
            good[byte_of[fits[byte_of]][other]] = False
        (a, of_a), (b, of_b) = ((ids[good[of]], of[good[of]]) for ids, of in sides)
        end_a, end_b = np.cumsum(self.lengths[0][a]), np.cumsum(self.lengths[1][b])
        last = []
        for end, other in ((end_a, end_b), (end_b, end_a)):
            mark = np.zeros(int(size[good].sum()) + 1, bool)
            mark[other] = True
            last.append(mark[end])
        group_a, group_b = (np.cumsum(x) - x for x in last)
        of_group = of_a[last[0]]
        size_a, size_b = (np.bincount(g, minlength=len(of_group)) for g in (group_a, group_b))
        links = size_a * size_b
        measures = np.stack([np.bincount(of_a, minlength=n), np.bincount(of_b, minlength=n), np.bincount(of_group, minlength=n), np.bincount(of_group, links, n)], axis=1).astype(np.int64)
        # an A token meets all B tokens of its group; large groups by their distinct ids
        from_b = np.cumsum(size_b) - size_b
        times = np.where(links > LARGE_GROUP, 0, size_b)[group_a]
        left = np.repeat(np.arange(len(a)), times)
        right = from_b[group_a[left]] + np.arange(len(left)) - np.repeat(np.cumsum(times) - times, times)
        pair, of_pair, occurs = [a[left] << 32 | b[right]], [of_a[left]], [np.ones(len(left), np.int64)]
        for g in np.flatnonzero(links > LARGE_GROUP):
            (x, m), (y, k) = (np.unique(ids[group == g], return_counts=True) for ids, group in ((a, group_a), (b, group_b)))
            pair.append((x[:, None] << 32 | y).ravel())
            occurs.append((m[:, None] * k).ravel())
            of_pair.append(np.full(len(pair[-1]), of_group[g]))
        pair, of_pair, occurs = map(np.concatenate, (pair, of_pair, occurs))
        order = np.lexsort((pair, of_pair))
        pair, of_pair, occurs = pair[order], of_pair[order], occurs[order]
        new = np.flatnonzero(np.r_[True, (pair[1:] != pair[:-1]) | (of_pair[1:] != of_pair[:-1])]) if len(pair) else order
        pairs, counts = pair[new].tobytes(), (np.add.reduceat(occurs, new) if len(new) else occurs).tobytes()
        pair_ends = np.cumsum(np.bincount(of_pair[new], minlength=n)) * 8
        # numbers with what follows them: a comma, a bar after a group's last A, a semicolon after its last B
        shown = np.concatenate([a * 3 + last[0], b * 3 + 2 * last[1]])[np.argsort(np.concatenate([group_a, group_b]), kind="stable")]
        text = ragged_take(self.shown, self.shown_lengths, shown).tobytes()
        text_ends = np.cumsum(np.bincount(of_a, self.shown_lengths[a * 3 + last[0]], n) + np.bincount(of_b, self.shown_lengths[b * 3 + 2 * last[1]], n)).astype(np.int64)
        values, p, t = [], 0, 0
        for fine, row, q, u in zip(good.tolist(), measures, pair_ends.tolist(), text_ends.tolist()):
            values.append((row.tobytes(), pairs[p:q], counts[p:q], text[t:u]) if fine else None)
            p, t = q, u
        return values


def align_chunk(aligner: SegmentAligner, column: pa.Array, copies: np.ndarray) -> dict:
    """Texts (not null, not empty) of a chunk: measures, groups digest, their pairs by number, and the chunk's pairs with counts."""
    spaced = pc.binary_join_element_wise(pa.scalar(" ", column.type), column, pa.scalar("", column.type))
    data, starts = column_bytes(spaced)
    n = len(column)
    cuts = segment_starts(data, starts[:-1])
    row = np.searchsorted(starts, cuts, "right") - 1
    which, segments = distinct_segments(data, cuts)
    found = aligner.memory.all(segments, aligner.align)
    lost = np.array([f is None for f in found])
    bad = np.zeros(n, bool)
    bad[row[lost[which]]] = True
    found = [f or (bytes(32), b"", b"", b"") for f in found]
    measures = np.frombuffer(b"".join(f[0] for f in found), np.int64).reshape(-1, 4)
    out = {name: np.where(bad, 0, np.bincount(row, measures[which, k], n)).astype(np.int64) for k, name in enumerate(_MEASURES)}
    texts = [f[3] for f in found]
    first, of_segment = np.searchsorted(row, np.arange(n + 1)), which.tolist()
    out["groups_sha256"] = ["" if b else hashlib.sha256(b"".join([texts[s] for s in of_segment[x:y]])[:-1]).hexdigest() for b, x, y in zip(bad.tolist(), first, first[1:])]
    # every (text, segment) once with its occurrences, then its pairs, then every (text, pair) once
    kept = ~bad[row]
    key, times = np.unique(row[kept] * len(segments) + which[kept], return_counts=True)
    text, segment = np.divmod(key, max(1, len(segments)))
    lengths = np.array([len(f[1]) for f in found], np.int64) // 8
    pairs, number = np.unique(np.frombuffer(b"".join(f[1] for f in found), np.int64), return_inverse=True)
    occurs = ragged_take(np.frombuffer(b"".join(f[2] for f in found), np.int64), lengths, segment) * np.repeat(times, lengths[segment])
    held = np.repeat(text, lengths[segment]) * max(1, len(pairs)) + ragged_take(number, lengths, segment)
    order = np.argsort(held, kind="stable")
    held, occurs = held[order], occurs[order]
    new = np.flatnonzero(np.r_[True, held[1:] != held[:-1]]) if len(held) else np.zeros(0, np.int64)
    links = np.add.reduceat(occurs, new) if len(new) else occurs
    text, pair = np.divmod(held[new], max(1, len(pairs)))
    counts = np.bincount(pair, copies[text], len(pairs)).astype(np.int64)
    keep = counts > 0  # pairs of texts without tokens are of no text
    renumber = np.cumsum(keep) - 1
    out |= {"held": np.bincount(text, minlength=n), "pair": renumber[pair], "links": links, "pairs": pairs[keep], "counts": counts[keep]}
    return out


def _packed(numbers: np.ndarray, kind: str) -> bytes:
    return zstandard.ZstdCompressor(level=1).compress(np.ascontiguousarray(numbers.astype(kind)).tobytes())


def _unpacked(data: bytes, kind: str) -> np.ndarray:
    return np.frombuffer(zstandard.ZstdDecompressor().decompress(data), kind)


# a piece with a space or line feed after something else, or punctuation after a letter or digit
_OVER = re.compile(r"[^▁\n][▁\n]|[A-Za-z0-9][!-/:-@\[-`{-~]")

_CHUNK = (
    "chunk bigint, digests array<string>, n_a array<bigint>, n_b array<bigint>, n_groups array<bigint>, n_links array<bigint>, "
    "groups_sha256 array<string>, held binary, pair binary, links binary, a array<int>, b array<int>, n array<bigint>"
)
_RESULT = "digest string, n_a bigint, n_b bigint, n_groups bigint, n_links bigint, n_best bigint, count_sum bigint, groups_sha256 string"


def aligned_chunks(texts: DataFrame, path_a: str, path_b: str) -> DataFrame:
    """Distinct (text, digest, copies), tokenised and aligned, a row per chunk of them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        aligner = of_worker(SegmentAligner, path_a, path_b)
        chunk = TaskContext.get().partitionId() << 33
        held, size = [], 0

        def emit():
            table = pa.Table.from_batches(held).combine_chunks()
            out = align_chunk(aligner, table.column("text").chunk(0), table.column("copies").to_numpy())
            return pa.RecordBatch.from_arrays([
                pa.array([chunk], pa.int64()), pa.array([table.column("digest").to_pylist()], pa.list_(pa.string())), *(pa.array([out[m]], pa.list_(pa.int64())) for m in _MEASURES),
                pa.array([out["groups_sha256"]], pa.list_(pa.string())), *(pa.array([_packed(out[m], "<u4")], pa.binary()) for m in ("held", "pair")), pa.array([_packed(out["links"], "<u8")], pa.binary()),
                pa.array([(out["pairs"] >> 32).astype(np.int32)], pa.list_(pa.int32())), pa.array([(out["pairs"] & 0xFFFFFFFF).astype(np.int32)], pa.list_(pa.int32())),
                pa.array([out["counts"]], pa.list_(pa.int64())),
            ], ["chunk", "digests", *_MEASURES, "groups_sha256", "held", "pair", "links", "a", "b", "n"])

        for batch in batches:
            offsets = column_bytes(batch.column(0))[1]
            for first, last in row_groups(offsets, CHUNK_BYTES):
                held.append(batch.slice(first, last - first))
                size += int(offsets[last] - offsets[first])
                if size >= CHUNK_BYTES:
                    yield emit()
                    held, size, chunk = [], 0, chunk + 1
        if held:
            yield emit()
        aligner.memory.kept.clear()  # idle workers keep what a task leaves
        pa.default_memory_pool().release_unused()

    return texts.select("text", "digest", "copies").mapInArrow(run, _CHUNK)


def measures(chunks: DataFrame) -> DataFrame:
    """Per digest the text's measures; ``n_best`` and ``count_sum`` weigh its links by the corpus-wide counts of their pairs."""
    entry = F.posexplode(F.arrays_zip("a", "b", "n")).alias("at", "e")
    pairs = chunks.select("chunk", entry).select("chunk", "at", "e.a", "e.b", "e.n")
    counts = pairs.groupBy("a", "b").agg(F.sum("n").alias("count"))
    counts = materialise(counts, "pair-counts")
    best = counts.groupBy("a").agg(F.max("count").alias("top"))
    weighed = counts.join(best, "a").select("a", "b", "count", (F.col("count") == F.col("top")).alias("is_best"))
    answers = pairs.select("chunk", "at", "a", "b").join(weighed, ["a", "b"]).groupBy("chunk").agg(
        F.collect_list("at").alias("ats"), F.collect_list("count").alias("counts"), F.collect_list("is_best").alias("bests"))  # a chunk's own pairs
    met = chunks.drop("a", "b", "n").join(answers, "chunk", "left")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(len(batch)):
                cell = lambda name: batch.column(name)[i]  # noqa: E731, B023
                digests = cell("digests").values
                held, pair, links = (_unpacked(cell(c).as_py(), k).astype(np.int64) for c, k in (("held", "<u4"), ("pair", "<u4"), ("links", "<u8")))
                count, is_best = np.zeros(0, np.int64), np.zeros(0, bool)
                if cell("ats").is_valid:
                    at = cell("ats").values.to_numpy()
                    count, is_best = np.zeros(len(at), np.int64), np.zeros(len(at), bool)
                    count[at] = cell("counts").values.to_numpy()
                    is_best[at] = cell("bests").values.to_numpy(zero_copy_only=False)
                ends = np.r_[0, np.cumsum(held)]
                totals = [np.r_[0, np.cumsum(links * weight)] for weight in (is_best[pair], count[pair])]
                best_links, count_sum = (t[ends[1:]] - t[ends[:-1]] for t in totals)
                yield pa.RecordBatch.from_arrays(
                    [digests, *(cell(m).values for m in _MEASURES), pa.array(best_links), pa.array(count_sum), cell("groups_sha256").values],
                    ["digest", *_MEASURES, "n_best", "count_sum", "groups_sha256"],
                )

    names = ["digests", *_MEASURES, "groups_sha256", "held", "pair", "links", "ats", "counts", "bests"]
    return met.select(*names).mapInArrow(run, _RESULT)


def align(docs: DataFrame, path_a: str, path_b: str) -> DataFrame:
    """(doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256), one row per row of ``docs``.

    Space and text are encoded by A, the text by B, which adds the space, both without special
    tokens. Texts that are null or empty, or whose tokens do not join to space and text, have no
    tokens: zeros and an empty digest. A pair's count is the number of documents that hold it
    linked; copies and repeated rows are documents of their own. Ids may be null. An empty table
    gives an empty result.
    """
    digest = lambda text: F.sha2(text.cast("binary"), 256)
    distinct = docs.filter("text <> ''").groupBy("text").agg(F.count("*").alias("copies")).withColumn("digest", digest(F.col("text")))
    chunks = materialise(aligned_chunks(distinct, path_a, path_b), "aligned")
    found = measures(chunks)
    zero = lambda name: F.coalesce(name, F.lit(0)).cast("bigint").alias(name)
    named = docs.select("doc_id", digest(F.col("text")).alias("__digest"))
    return named.join(found, F.col("__digest") == F.col("digest"), "left").select(
        "doc_id", *[zero(m) for m in (*_MEASURES, "n_best", "count_sum")], F.coalesce("groups_sha256", F.lit("")).alias("groups_sha256")
    )
