"""Byte-level BPE ids of whole texts, by the tokenizers library with a memory of segments.

A segment starts before a space that follows a visible character, and before punctuation that
ends a word. A byte-level BPE vocabulary splits its input there too, so the ids of a text are
those of its segments. A batch is cut in numpy, Arrow finds its distinct segments, and only those the memory does not
hold are encoded. Texts with special tokens are encoded as a whole.
"""

from __future__ import annotations

import os
import sys
import types
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from sparkloom.llm.textbatch import column_bytes

END_ID = 2
CACHE_SEGMENTS = 1_000_000  # the memory is emptied beyond that
CACHE_BYTES = 32 << 20
LONGEST_KEPT = 200  # bytes of a segment that is remembered
GROUP_BYTES = 8 << 20  # whole rows of about so much text are encoded together

_VISIBLE = np.zeros(256, bool)
_VISIBLE[0x21:0x7F] = True
_WORDLIKE = np.zeros(256, bool)
_WORDLIKE[[*range(48, 58), *range(65, 91), *range(97, 123)]] = True
_MARK = _VISIBLE & ~_WORDLIKE
# lead bytes of two-byte and of three-byte characters among which there is no white space
_LEAD2 = np.zeros(256, bool)
_LEAD2[0xC3:0xE0] = True
_LEAD3 = np.zeros(256, bool)
_LEAD3[[0xE0, *range(0xE4, 0xF0)]] = True


def tokenizer_path(name: str = "byte_bpe_50k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def segment_starts(data: np.ndarray, row_starts: np.ndarray) -> np.ndarray:
    """Places in UTF-8 ``data`` where a segment starts: every row start, and safe places inside rows.

    Those are spaces and line feeds after a visible character, and ASCII punctuation after an
    ASCII letter or digit. A place not known to be safe is no start, which only makes a segment
    longer.
    """
    start = (data == 32) | (data == 10)
    start[:1] = False
    at = np.flatnonzero(start)
    before = data[at - 1]
    safe = _VISIBLE[before]
    odd = np.flatnonzero(before >= 0x80)
    if len(odd):
        # near a row start the look back may leave the row, but then the place is a row start anyway
        place = at[odd]
        safe[odd] = _LEAD2[data[np.maximum(place - 2, 0)]] | _LEAD3[data[np.maximum(place - 3, 0)]]
    start[at[~safe]] = False
    start[1:] |= _MARK[data[1:]] & _WORDLIKE[data[:-1]]
    start[row_starts[row_starts < len(data)]] = True
    return np.flatnonzero(start)


def row_groups(offsets: np.ndarray, most: int) -> Iterator[tuple[int, int]]:
    """Runs (first, last) of rows of about ``most`` bytes; a longer row is a run of its own."""
    first, n = 0, len(offsets) - 1
    while first < n:
        last = min(n, max(first + 1, int(np.searchsorted(offsets, offsets[first] + most, "right")) - 1))
        yield first, last
        first = last


def distinct_segments(data: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, list[bytes]]:
    """(number of the segment at each start, distinct segments)."""
    edges = np.r_[starts, len(data)].astype(np.int64)
    array = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(starts), [None, pa.py_buffer(edges), pa.py_buffer(np.ascontiguousarray(data))])
    coded = array.dictionary_encode()
    return coded.indices.to_numpy(), coded.dictionary.to_pylist()


class Memory:
    """What is known of segments: emptied when it holds too many entries or bytes."""

    def __init__(self, entries: int = CACHE_SEGMENTS):
        self.kept: dict[bytes, object] = {}
        self.size, self.entries = 0, entries

    def all(self, segments: list[bytes], work_out: Callable[[list[bytes]], list]) -> list:
        """The value of every segment; those not remembered are worked out together."""
        if len(self.kept) > self.entries or self.size > CACHE_BYTES:
            self.kept.clear()
            self.size = 0
        kept = self.kept
        unknown = [s for s in segments if s not in kept]
        found = dict(zip(unknown, work_out(unknown))) if unknown else {}
        values = [kept[s] if s in kept else found[s] for s in segments]
        short = {s: v for s, v in found.items() if len(s) <= LONGEST_KEPT}
        kept.update(short)
        self.size += sum(map(len, short))
        return values


def ragged_take(flat: np.ndarray, lengths: np.ndarray, which: np.ndarray) -> np.ndarray:
    """The runs numbered ``which`` of ``flat``, whose runs have ``lengths``, end to end."""
    starts = np.cumsum(lengths) - lengths
    taken = lengths[which]
    ends = np.cumsum(taken)
    total = int(ends[-1]) if len(ends) else 0
    return flat[np.repeat(starts[which] - (ends - taken), taken) + np.arange(total)]


def of_worker(kind: type, path: str, *more):
    """The object of ``kind`` for ``path`` that this process keeps between tasks."""
    kept = sys.modules.setdefault("_sparkloom_worker", types.ModuleType("_sparkloom_worker")).__dict__
    key = f"{kind.__name__}:{path}:{more}"
    if key not in kept:
        kept[key] = kind(path, *more)
    return kept[key]


class SegmentEncoder:
    """Encodes columns of texts; one per tokenizer file and Python worker."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        self.tokenizer = Tokenizer.from_file(path)
        self.type = np.dtype("<u2" if self.tokenizer.get_vocab_size() <= 1 << 16 else "<u4")
        self.special = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.memory = Memory()

    @staticmethod
    def of_worker(path: str) -> "SegmentEncoder":
        return of_worker(SegmentEncoder, path)

    def _ids(self, segments: list[bytes]) -> list[bytes]:
        found = self.tokenizer.encode_batch_fast([s.decode("utf-8", "replace") for s in segments], add_special_tokens=False)
        return [np.array(e.ids, self.type).tobytes() for e in found]

    def encode(self, column: pa.Array) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        """(number of rows, their ids end to end, ids per row) for runs of rows; null texts have none."""
        special = np.zeros(len(column), bool)
        for s in self.special:
            special |= pc.fill_null(pc.match_substring(column, s), False).to_numpy(zero_copy_only=False)
        everything, offsets = column_bytes(column)
        for first, last in row_groups(offsets, GROUP_BYTES):
            data, starts = everything[offsets[first]:offsets[last]], offsets[first:last + 1] - offsets[first]
            if not len(data):
                yield last - first, np.zeros(0, self.type), np.zeros(last - first, np.int64)
                continue
            cuts = segment_starts(data, starts[:-1])
            row = np.searchsorted(starts, cuts, "right") - 1
            if special[first:last].any():  # only the first cut of a row with a special token stays
                keep = ~special[first:last][row] | np.r_[True, row[1:] != row[:-1]]
                cuts, row = cuts[keep], row[keep]
            which, segments = distinct_segments(data, cuts)
            values = self.memory.all(segments, self._ids)
            lengths = np.fromiter(map(len, values), np.int64, len(values)) // self.type.itemsize
            ids = ragged_take(np.frombuffer(b"".join(values), self.type), lengths, which)
            yield last - first, ids, np.bincount(row, lengths[which], last - first).astype(np.int64)
