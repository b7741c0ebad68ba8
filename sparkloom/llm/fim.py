"""Fill-in-the-middle over texts kept as independent zstandard frames.

A stored text is a list of frames that decompress on their own, with the number of units and
code points before each. A cut point is found by these counts, so only the frame it falls in is
decompressed; all other frames move to their place in the output as they are, compressed. Since
zstandard frames end to end decompress to their texts end to end, an output is a list of frames
again, and digests and restored texts stream through it a frame at a time.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sparkloom.llm.textbatch import column_bytes
from sparkloom.llm.tokens import row_groups

FRAME_BYTES = 32 << 10  # of text in a frame, at most
GROUP_BYTES = 4 << 20
LEVEL = 1
PREFIX, SUFFIX, MIDDLE = b"<P>", b"<S>", b"<M>"
FORMS = {"psm": (PREFIX, SUFFIX, MIDDLE), "spm": (SUFFIX, PREFIX, MIDDLE)}
PLAIN_SHARE, SPM_SHARE = 10, 20  # per cent of all texts, and of those that are not plain

_LETTER = np.zeros(256, bool)
_LETTER[[*range(65, 91), *range(97, 123)]] = True
_STORE = "doc_id {id}, n bigint, marked boolean, units array<bigint>, chars array<bigint>, carried array<boolean>, frames array<binary>"
_OUTPUT = "doc_id {id}, n bigint, form string, prefix_chars bigint, middle_chars bigint, frames array<binary>"


def _leads(data: np.ndarray) -> np.ndarray:
    """True where a code point starts."""
    return (data & 0xC0) != 0x80


def _unit_starts(data: np.ndarray, carried: bool = False) -> np.ndarray:
    """True where a unit starts: a run of ASCII letters, or any other code point."""
    letter = _LETTER[data]
    starts = _leads(data)
    starts[1:] &= ~(letter[1:] & letter[:-1])
    if carried:
        starts[:1] = False
    return starts


def _frame_edges(data: np.ndarray, first: int, last: int) -> list[int]:
    """Places where the frames of the text in [first, last) start, at code points."""
    edges, at = [], first
    while at < last:
        edges.append(at)
        at = min(last, at + FRAME_BYTES)
        while at < last and data[at] & 0xC0 == 0x80:
            at -= 1
    return edges


def _id_type(df: DataFrame) -> str:
    return df.schema["doc_id"].dataType.simpleString()


def store(docs: DataFrame) -> DataFrame:
    """Texts as frames: (doc_id, n, marked, units, chars, carried, frames).

    ``n`` counts units; ``units`` and ``chars`` those before each frame. A unit counts in the
    frame it starts in, and ``carried`` is true of frames whose first letter goes on with a unit of
    the frame before. ``marked`` texts hold one of the three marks. Null and empty texts have
    no frames. One row per row of ``docs``; repeated and null ids are rows of their own.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pack = zstandard.ZstdCompressor(level=LEVEL).compress
        for batch in batches:
            everything, offsets = column_bytes(batch.column(1))
            for first, last in row_groups(offsets, GROUP_BYTES):
                data, ends = everything[offsets[first]:offsets[last]], offsets[first:last + 1] - offsets[first]
                raw = data.tobytes()
                starts = _unit_starts(data)
                starts[ends[:-1][ends[:-1] < len(data)]] = True
                by_row = [_frame_edges(data, a, b) for a, b in zip(ends[:-1].tolist(), ends[1:].tolist())]
                edges = [e for row in by_row for e in row]
                stops = [*edges[1:], len(data)]
                units = np.add.reduceat(starts, edges, dtype=np.int64) if edges else np.zeros(0, np.int64)
                chars = np.add.reduceat(_leads(data), edges, dtype=np.int64) if edges else units
                of_row = np.array([len(e) for e in by_row], np.int64)
                row_at = np.cumsum(of_row) - of_row
                before = lambda counts: (np.cumsum(counts) - counts) - np.repeat(np.r_[np.cumsum(counts) - counts, 0][row_at], of_row)
                total = np.bincount(np.repeat(np.arange(last - first), of_row), units, last - first).astype(np.int64)
                lists = pa.array(np.r_[0, np.cumsum(of_row)].astype(np.int32))
                marked = [any(raw.find(m, a, b) >= 0 for m in (PREFIX, SUFFIX, MIDDLE)) for a, b in zip(ends[:-1].tolist(), ends[1:].tolist())]
                parts = [
                    before(units), before(chars), ~starts[edges] if edges else np.zeros(0, bool),
                    pa.array([pack(raw[a:b]) for a, b in zip(edges, stops)], pa.binary()),
                ]
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(first, last - first), pa.array(total), pa.array(marked, pa.bool_()), *(pa.ListArray.from_arrays(lists, pa.array(p)) for p in parts)],
                    ["doc_id", "n", "marked", "units", "chars", "carried", "frames"],
                )

    return docs.select("doc_id", "text").mapInArrow(run, _STORE.format(id=_id_type(docs)))


class Frames:
    """A text as its frames, read in ranges of bytes; one frame is decompressed at a time."""

    def __init__(self, frames: list[bytes]):
        self.frames, self.unpack, self.last = frames, zstandard.ZstdDecompressor().decompress, (-1, b"")
        sizes = [zstandard.frame_content_size(f) for f in frames]
        self.ends = np.cumsum(sizes, dtype=np.int64) if sizes else np.zeros(0, np.int64)

    def frame(self, number: int) -> bytes:
        if self.last[0] != number:
            self.last = (number, self.unpack(self.frames[number]))
        return self.last[1]

    def read(self, start: int, stop: int) -> Iterator[bytes]:
        number = int(np.searchsorted(self.ends, start, "right"))
        while start < stop:
            begin = int(self.ends[number - 1]) if number else 0
            part = self.frame(number)[start - begin:stop - begin]
            yield part
            start, number = start + len(part), number + 1

    def find(self, mark: bytes, start: int) -> int:
        """Place of the first ``mark`` at or after ``start``; it may lie across frames."""
        tail, at = b"", start
        for part in self.read(start, self.size):
            seen = tail + part
            found = seen.find(mark)
            if found >= 0:
                return at - len(tail) + found
            at += len(part)
            tail = seen[-(len(mark) - 1):]
        raise ValueError(f"no {mark!r}")

    @property
    def size(self) -> int:
        return int(self.ends[-1]) if len(self.ends) else 0


def split_at(frames: list[bytes], units: list[int], chars: list[int], carried: list[bool], unit: int, n: int) -> tuple[int, int, int]:
    """(frame, byte in it, code points before) where unit number ``unit`` starts; the end of the text if ``unit`` is n."""
    if unit == n:
        if not frames:
            return 0, 0, 0
        last = len(frames) - 1
        text = np.frombuffer(zstandard.ZstdDecompressor().decompress(frames[last]), np.uint8)
        return last, len(text), chars[last] + int(_leads(text).sum())
    number = int(np.searchsorted(units, unit, "right")) - 1
    text = np.frombuffer(zstandard.ZstdDecompressor().decompress(frames[number]), np.uint8)
    place = int(np.flatnonzero(_unit_starts(text, carried[number]))[unit - units[number]])
    return number, place, chars[number] + int(_leads(text[:place]).sum())


def draws(doc_id, seed: int = 1) -> list[int]:
    """Four numbers that depend on the id alone; a null id counts as no digits."""
    digest = hashlib.sha256(f"{seed}:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    return [int(digest[i:i + 8], 16) for i in range(0, 32, 8)]


def rearrange(stored: DataFrame) -> DataFrame:
    """(doc_id, n, form, prefix_chars, middle_chars, frames): the output of every stored text, as frames.

    The two cuts and the form follow from doc_id. Plain outputs are the stored frames: of empty
    texts, of texts that hold a mark, and of the plain share.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pack, unpack = zstandard.ZstdCompressor(level=LEVEL).compress, zstandard.ZstdDecompressor().decompress
        for batch in batches:
            rows: dict[str, list] = {name: [] for name in ("doc_id", "n", "form", "prefix_chars", "middle_chars", "frames")}
            for doc_id, n, marked, units, chars, carried, frames in zip(*(c.to_pylist() for c in batch.columns)):
                h1, h2, h3, h4 = draws(doc_id)
                form, prefix, middle, out = "plain", None, None, frames
                if n and not marked and h3 % 100 < 100 - PLAIN_SHARE:
                    form = "spm" if h4 % 100 < SPM_SHARE else "psm"
                    cuts = [(0, 0, 0)] + [split_at(frames, units, chars, carried, c, n) for c in sorted((h1 % (n + 1), h2 % (n + 1)))]
                    prefix, middle = cuts[1][2], cuts[2][2] - cuts[1][2]
                    cuts.append((len(frames), 0, 0))

                    def between(start, stop):
                        (f, a, _), (g, b, _) = start, stop
                        if f == g:
                            return [pack(unpack(frames[f])[a:b])] if b > a else []
                        head = [pack(unpack(frames[f])[a:])] if a else [frames[f]]
                        return [*head, *frames[f + 1:g], *([pack(unpack(frames[g])[:b])] if b else [])]

                    parts = {PREFIX: between(cuts[0], cuts[1]), MIDDLE: between(cuts[1], cuts[2]), SUFFIX: between(cuts[2], cuts[3])}
                    out = [frame for mark in FORMS[form] for frame in (pack(mark), *parts[mark])]
                for name, value in zip(rows, (doc_id, n, form, prefix, middle, out)):
                    rows[name].append(value)
            yield pa.RecordBatch.from_arrays([
                pa.array(rows["doc_id"], batch.column(0).type), pa.array(rows["n"], pa.int64()), pa.array(rows["form"], pa.string()),
                pa.array(rows["prefix_chars"], pa.int64()), pa.array(rows["middle_chars"], pa.int64()), pa.array(rows["frames"], pa.list_(pa.binary())),
            ], list(rows))

    names = ["doc_id", "n", "marked", "units", "chars", "carried", "frames"]
    return stored.select(*names).mapInArrow(run, _OUTPUT.format(id=_id_type(stored)))


def restored(frames: list[bytes], form: str) -> Iterator[bytes]:
    """The text that an output of this form was made of, in pieces."""
    output = Frames(frames)
    if form == "plain":
        yield from output.read(0, output.size)
        return
    marks = FORMS[form]
    second = output.find(marks[1], len(marks[0]))
    third = output.find(marks[2], second + len(marks[1]))
    ranges = {marks[0]: (len(marks[0]), second), marks[1]: (second + len(marks[1]), third), marks[2]: (third + len(marks[2]), output.size)}
    for mark in (PREFIX, MIDDLE, SUFFIX):
        yield from output.read(*ranges[mark])


def digests(outputs: DataFrame) -> DataFrame:
    """All columns of ``outputs`` but frames, with the SHA-256 of the output and of the text restored from it."""
    names = [c for c in outputs.columns if c != "frames"]
    schema = outputs.select(*names, F.lit("").alias("output_sha256"), F.lit("").alias("restored_sha256")).schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [], []
            for form, frames in zip(batch.column("form").to_pylist(), batch.column("frames")):
                output = Frames(frames.as_py())
                for into, pieces in zip(found, (output.read(0, output.size), restored(output.frames, form))):
                    digest = hashlib.sha256()
                    for piece in pieces:
                        digest.update(piece)
                    into.append(digest.hexdigest())
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in names), *(pa.array(f, pa.string()) for f in found)], [*names, "output_sha256", "restored_sha256"])

    return outputs.mapInArrow(run, schema)


def output_text(outputs: DataFrame) -> DataFrame:
    """``outputs`` with column text, each output whole, in place of frames."""
    names = [c for c in outputs.columns if c != "frames"]
    schema = outputs.select(*names, F.lit("").alias("text")).schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = []
            for frames in batch.column("frames"):
                output = Frames(frames.as_py())
                texts.append(b"".join(output.read(0, output.size)))
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in names), pa.array(texts, pa.binary()).cast(pa.string())], [*names, "text"])

    return outputs.mapInArrow(run, schema)
