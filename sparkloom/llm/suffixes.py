"""Substring dedup by sorted suffixes, over bytes.

Every byte covered by a LENGTH-byte string that starts elsewhere too is removed. Sorting all
suffixes of a corpus would move each byte LENGTH times, so suffixes are sorted only at anchors:
the places of the GRAM-byte string with the smallest hash in some LENGTH-byte window. Equal
windows have their anchors at the same place, so nothing is lost.

1. Texts are packed into chunks, stored once. Anchor hashes are dealt to buckets; a chunk gets
   back those met in another chunk or known twice in itself.
2. For these anchors a chunk sends the bytes around them, every distinct content once, to the
   bucket of the anchor.
3. A bucket sorts the suffixes that start at the anchors and, reversed, the prefixes that end
   there, both deep-shallow: multikey quicksort on 8-byte characters to the depth of the anchor,
   then a blind trie for each group of a longer common prefix. A window is repeated if another
   row is in its class both in the suffix order at the depth right of the window's start and in the
   prefix order at the depth left of the anchor.
4. Chunks get the repeated windows of their contents and cut their texts.

Anchors with more than HOT_CONTEXTS contents would fill a bucket; their windows are dealt one by
one by a 128-bit hash instead, so that no group grows with the number of documents that share a
passage.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sparkloom.llm.common import byte_size
from sparkloom.llm.textbatch import column_bytes
from sparkloom.llm.tokens import row_groups
from sparkloom.session import materialise

LENGTH = 200
GRAM = 32
SIDE = LENGTH - GRAM  # bytes before and after an anchor that a window over it can hold
CHUNK_BYTES = 4 << 20  # whole texts of about so much are one chunk
GROUP_BYTES = 128 << 10  # bytes hashed at once
BUCKET_ANCHORS = 1 << 17
HOT_CONTEXTS = 50_000
PART = 512  # quicksort leaves smaller parts of a level to one joint sort
PAD = 0xFF  # no byte of UTF-8

_CHARS = GRAM // 8
_BYTE = np.random.default_rng(17).integers(1, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_BASE = 0x9E3779B97F4A7C15
_POWERS = np.cumprod(np.r_[np.uint64(1), np.full(GROUP_BYTES + 2 * LENGTH, _BASE, np.uint64)])
_INVERSE = np.cumprod(np.r_[np.uint64(1), np.full(GROUP_BYTES + 2 * LENGTH, pow(_BASE, -1, 1 << 64), np.uint64)])


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    return (x ^ (x >> np.uint64(29))) | np.uint64(1)  # never zero


def gram_hashes(data: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Hash of the GRAM bytes at each place, as :func:`_anchors_of` has them."""
    grams = _BYTE[data[at[:, None] + np.arange(GRAM)]] if len(at) else np.zeros((0, GRAM), np.uint64)
    return _mixed((grams * _POWERS[:GRAM]).sum(axis=1, dtype=np.uint64))


def _sliding(x: np.ndarray, width: int, least: bool) -> np.ndarray:
    """Least or greatest of each run of ``width`` numbers, by doubling."""
    pick, span, n = np.minimum if least else np.maximum, 1, len(x) - width + 1
    while span * 2 <= width:
        x = pick(x[:-span], x[span:])
        span *= 2
    return pick(x[:n], x[width - span:width - span + n])


def _anchors_of(data: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Places of anchors in texts end to end; windows do not cross ``ends``."""
    n = len(data)
    if n < LENGTH:
        return np.zeros(0, np.int64)
    sums = np.r_[np.uint64(0), np.cumsum(_BYTE[data] * _POWERS[:n], dtype=np.uint64)]
    hashes = _mixed((sums[GRAM:] - sums[:-GRAM]) * _INVERSE[:n - GRAM + 1])
    least = _sliding(hashes, SIDE + 1, True)  # of the window that starts at each place
    starts = np.arange(n - LENGTH + 1)
    least[starts + LENGTH > ends[np.searchsorted(ends, starts, "right")]] = 0
    edge = np.zeros(SIDE, np.uint64)
    return np.flatnonzero(_sliding(np.concatenate([edge, least, edge]), SIDE + 1, False) == hashes)


def anchors(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Places of anchors in the texts at ``offsets`` of ``data``, in order."""
    found = []
    for first, last in row_groups(offsets, GROUP_BYTES):
        begin, end = int(offsets[first]), int(offsets[last])
        if end - begin <= GROUP_BYTES:
            found.append(_anchors_of(data[begin:end], offsets[first + 1:last + 1] - begin) + begin)
            continue
        for at in range(begin, end - LENGTH + 1, GROUP_BYTES):  # one text: windows that start in each piece
            piece = data[at:min(end, at + GROUP_BYTES + LENGTH - 1)]
            found.append(_anchors_of(piece, np.array([len(piece)])) + at)
    return np.unique(np.concatenate(found)) if found else np.zeros(0, np.int64)


# sorting ---------------------------------------------------------------------


def multikey_quicksort(chars: np.ndarray) -> np.ndarray:
    """Order of rows of characters: three-way splits by the character at one depth, then deeper in the part equal to the pivot."""
    order, deepest = np.arange(len(chars)), chars.shape[1]
    stack, small = [(0, len(chars), 0)], [[] for _ in range(deepest + 1)]
    while stack:
        low, high, depth = stack.pop()
        if high - low <= PART or depth == deepest:
            if high - low > 1 and depth < deepest:
                small[depth].append((low, high))
            continue
        part = order[low:high]
        key = chars[part, depth]
        pivot = np.sort(key[:: max(1, len(key) // 31)])[-(-min(31, len(key)) // 2)]
        below, above = key < pivot, key > pivot
        less, same, more = part[below], part[~below & ~above], part[above]
        order[low:high] = np.concatenate([less, same, more])
        a, b = low + len(less), high - len(more)
        stack += [(low, a, depth), (a, b, depth + 1), (b, high, depth)]
    for depth in range(deepest):
        if not small[depth]:
            continue
        low, high = np.array(small[depth]).T
        part = np.repeat(np.arange(len(low)), high - low)
        at = np.repeat(low - (np.cumsum(high - low) - (high - low)), high - low) + np.arange(len(part))
        key = chars[order[at], depth]
        by = np.lexsort((key, part))
        order[at] = order[at[by]]
        part, key = part[by], key[by]  # places ``at`` are in the order of the parts
        new = np.flatnonzero(np.r_[True, (part[1:] != part[:-1]) | (key[1:] != key[:-1])])
        sizes = np.diff(np.r_[new, len(part)])
        small[depth + 1] += [(at[a], at[a] + s) for a, s in zip(new[sizes > 1], sizes[sizes > 1].tolist())]
    return order


def blind_trie_order(texts: list[bytes]) -> tuple[list[int], list[int]]:
    """(order of equally long texts, common bytes of each with the one before; 0 for the first).

    Nodes hold the place of a bit; a text is led down by those bits alone, compared with the
    one text it arrives at, and put in where they part.
    """
    bits = len(texts[0]) * 8
    numbers = [int.from_bytes(t, "big") for t in texts]
    leaves, root = [[0]], 0
    for i in range(1, len(numbers)):
        x, node = numbers[i], root
        while type(node) is list:
            node = node[1 + (x >> (bits - 1 - node[0]) & 1)]
        apart = x ^ numbers[leaves[node][0]]
        if not apart:
            leaves[node].append(i)
            continue
        place, parent, node = bits - apart.bit_length(), None, root
        while type(node) is list and node[0] < place:
            parent, side = node, 1 + (x >> (bits - 1 - node[0]) & 1)
            node = node[side]
        leaves.append([i])
        new = [place, node, len(leaves) - 1] if x >> (bits - 1 - place) & 1 else [place, len(leaves) - 1, node]
        if parent is None:
            root = new
        else:
            parent[side] = new
    order, common, stack = [], [], [(root, 0)]
    while stack:
        node, shared = stack.pop()  # shared: bits in common with the text before the node's first
        if type(node) is list:
            stack += [(node[2], node[0]), (node[1], shared)]
        else:
            order += leaves[node]
            common += [shared // 8, *[len(texts[0])] * (len(leaves[node]) - 1)]
    return order, common


def deep_shallow(rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(order of the rows of bytes, common bytes of each with the one before)."""
    chars = np.ascontiguousarray(rows[:, :GRAM]).view(">u8").astype(np.uint64)
    order = multikey_quicksort(chars)
    ahead = rows[order[1:], :GRAM] != rows[order[:-1], :GRAM]
    common = np.r_[0, np.where(ahead.any(axis=1), ahead.argmax(axis=1), GRAM)]
    starts = np.flatnonzero(common < GRAM)
    for low, high in zip(starts.tolist(), [*starts[1:].tolist(), len(order)]):
        if high - low > 1:
            own = order[low:high]
            by, shared = blind_trie_order([rows[i, GRAM:].tobytes() for i in own])
            order[low:high] = own[by]
            common[low + 1:high] = GRAM + np.array(shared[1:])
    return order, common


def repeated_windows(contents: np.ndarray, left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """Bits [row, o]: the window that starts ``o`` bytes before the anchor is in another row too.

    Rows are distinct and have SIDE bytes before the anchor and LENGTH from it on, of which
    ``left`` and ``right`` are of the text and the others PAD.
    """
    n = len(contents)
    bits = np.zeros((n, SIDE + 1), bool)
    if n < 2:
        return bits
    places, commons, most = [], [], []
    for rows in (contents[:, SIDE:], np.concatenate([contents[:, SIDE:LENGTH], contents[:, :SIDE][:, ::-1]], axis=1)):
        order, common = deep_shallow(rows)
        place = np.empty(n, np.int64)
        place[order] = np.arange(n)
        places.append(place)
        commons.append(common)
        most.append(np.maximum(common, np.r_[common[1:], 0])[place])
    for o in range(SIDE + 1):
        ask = np.flatnonzero((most[0] >= LENGTH - o) & (most[1] >= GRAM + o) & (left >= o) & (right >= LENGTH - o))
        if len(ask) < 2:
            continue
        suffix = np.cumsum(commons[0] < LENGTH - o)[places[0][ask]]
        prefix = np.cumsum(commons[1] < GRAM + o)[places[1][ask]]
        key = suffix * (n + 1) + prefix
        by = np.argsort(key, kind="stable")
        same = key[by][1:] == key[by][:-1]
        bits[ask[by[np.r_[False, same] | np.r_[same, False]]], o] = True
    return bits


# chunks ----------------------------------------------------------------------


def _pack(numbers: np.ndarray) -> bytes:
    return zstandard.ZstdCompressor(level=1).compress(np.ascontiguousarray(numbers).tobytes())


def _unpack(data: bytes, kind) -> np.ndarray:
    return np.frombuffer(zstandard.ZstdDecompressor().decompress(data), kind)


class Chunk:
    """Texts end to end, their anchors, and the distinct contents around these."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray, at: np.ndarray):
        self.data, self.offsets, self.at = data, offsets, at
        row = np.searchsorted(offsets, at, "right") - 1
        self.left = np.minimum(at - offsets[row], SIDE)
        self.right = np.minimum(offsets[row + 1] - at, LENGTH)
        raw, digest, known = data.tobytes(), xxhash.xxh3_128_digest, {}
        self.content = np.fromiter(
            (known.setdefault((digest(raw[p - a:p + b]), a), len(known)) for p, a, b in zip(at.tolist(), self.left.tolist(), self.right.tolist())), np.int64, len(at))
        self.first = np.unique(self.content, return_index=True)[1]  # the first anchor of each content
        self.several = np.bincount(self.content, minlength=len(self.first)) > 1
        self.hashes = gram_hashes(data, at[self.first])  # of each content

    @staticmethod
    def read(blob: bytes, lengths: bytes, at: bytes) -> "Chunk":
        return Chunk(_unpack(blob, np.uint8), np.r_[0, np.cumsum(_unpack(lengths, "<u8").astype(np.int64))], np.cumsum(_unpack(at, "<u4").astype(np.int64)))

    def contents(self, which: np.ndarray) -> np.ndarray:
        """Bytes around the anchors of these contents, padded."""
        anchor = self.first[which]
        span = np.arange(-SIDE, LENGTH)
        inside = (span >= -self.left[anchor][:, None]) & (span < self.right[anchor][:, None])
        return np.where(inside, self.data[np.where(inside, self.at[anchor][:, None] + span, 0)], PAD).astype(np.uint8)

    def valid(self, which: np.ndarray) -> np.ndarray:
        o, anchor = np.arange(SIDE + 1), self.first[which]
        return (o <= self.left[anchor][:, None]) & (LENGTH - o <= self.right[anchor][:, None])


def _by_bucket(bucket: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
    order = np.argsort(bucket, kind="stable")
    new = np.flatnonzero(np.r_[True, bucket[order][1:] != bucket[order][:-1]]) if len(order) else order
    for a, b in zip(new.tolist(), [*new[1:].tolist(), len(order)]):
        yield int(bucket[order[a]]), order[a:b]


def _rows(schema: pa.Schema, rows: list[dict]) -> pa.RecordBatch:
    return pa.RecordBatch.from_pylist(rows, schema)


def _columns(table: pa.Table, name: str, kind) -> tuple[np.ndarray, np.ndarray]:
    """(numbers of a packed column, their counts by row)."""
    parts = [_unpack(v.as_py(), kind) for v in table.column(name)]
    return np.concatenate(parts), np.array([len(p) for p in parts])


def _chunks(docs: DataFrame, buckets: int) -> DataFrame:
    """Texts packed into chunks (kind text), and the distinct anchor hashes of each by bucket (kind anchor)."""
    id_sql = docs.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        chunk, held, size = TaskContext.get().partitionId() << 33, [], 0

        def emit():
            table = pa.Table.from_batches(held).combine_chunks()
            data, offsets = column_bytes(table.column("text").chunk(0))
            at = anchors(data, offsets)
            none = {"chunk": chunk, "kind": "anchor"}
            yield _rows(schema, [{
                "chunk": chunk, "kind": "text", "ids": table.column("doc_id").to_pylist(), "blob": _pack(data), "lengths": _pack(np.diff(offsets).astype("<u8")),
                "at": _pack(np.diff(at, prepend=0).astype("<u4")),
            }])
            packed = Chunk(data, offsets, at)
            hashes, counts = np.unique(packed.hashes, return_counts=True)  # contents of each anchor hash
            twice = np.isin(hashes, packed.hashes[packed.several]) | (counts > 1)
            yield _rows(schema, [
                {**none, "bucket": b, "hashes": hashes[k].tobytes(), "counts": np.minimum(counts[k], 1 << 30).astype("<u4").tobytes(), "twice": twice[k].tobytes()}
                for b, k in _by_bucket((hashes % np.uint64(buckets)).astype(np.int64))
            ])

        for batch in batches:
            offsets = column_bytes(batch.column(1))[1]
            for first, last in row_groups(offsets, CHUNK_BYTES):
                held.append(batch.slice(first, last - first))
                size += int(offsets[last] - offsets[first])
                if size >= CHUNK_BYTES:
                    yield from emit()
                    chunk, held, size = chunk + 1, [], 0
        if held:
            yield from emit()

    sql = f"chunk bigint, kind string, ids array<{id_sql}>, blob binary, lengths binary, at binary, bucket int, hashes binary, counts binary, twice binary"
    id_type = {"bigint": pa.int64(), "int": pa.int32(), "string": pa.string()}[id_sql]
    schema = pa.schema([
        ("chunk", pa.int64()), ("kind", pa.string()), ("ids", pa.list_(id_type)), *((c, pa.binary()) for c in ("blob", "lengths", "at")),
        ("bucket", pa.int32()), *((c, pa.binary()) for c in ("hashes", "counts", "twice")),
    ])
    return docs.select("doc_id", "text").mapInArrow(run, sql)


def _shared_anchors(sent: DataFrame) -> DataFrame:
    """(chunk, hashes, hot): the anchor hashes of each chunk that are met again, in it or elsewhere."""

    def group(table: pa.Table) -> pa.Table:
        parts = [np.frombuffer(v.as_py(), "<u8") for v in table.column("hashes")]
        hashes, rows = np.concatenate(parts), np.array([len(p) for p in parts])
        counts = np.concatenate([np.frombuffer(v.as_py(), "<u4") for v in table.column("counts")]).astype(np.int64)
        twice = np.concatenate([np.frombuffer(v.as_py(), bool) for v in table.column("twice")])
        chunk = np.repeat(table.column("chunk").to_numpy(), rows)
        found, which, times = np.unique(hashes, return_inverse=True, return_counts=True)
        hot = (np.bincount(which, counts) > HOT_CONTEXTS)[which]
        again = np.flatnonzero((times[which] > 1) | twice)
        parts = [(chunk[again[k[0]]], again[k]) for _, k in _by_bucket(chunk[again])]
        return pa.table({
            "chunk": pa.array([c for c, _ in parts], pa.int64()), "hashes": pa.array([hashes[k].tobytes() for _, k in parts], pa.binary()),
            "hot": pa.array([hot[k].tobytes() for _, k in parts], pa.binary()),
        })

    return sent.groupBy("bucket").applyInArrow(group, "chunk bigint, hashes binary, hot binary")


def _contents(texts: DataFrame, shared: DataFrame, buckets: int) -> DataFrame:
    """By bucket the contents around shared anchors (kind rows), and of hot ones the windows by hash (kind windows)."""
    replies = shared.groupBy("chunk").agg(F.collect_list("hashes").alias("shared"), F.collect_list("hot").alias("hot"))
    sql = "bucket int, kind string, chunk bigint, content binary, several binary, left binary, right binary, bytes binary, o binary, window binary"
    schema = pa.schema([("bucket", pa.int32()), ("kind", pa.string()), ("chunk", pa.int64()), *((c, pa.binary()) for c in ("content", "several", "left", "right", "bytes", "o", "window"))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(len(batch)):
                number, blob, lengths, at = (batch.column(c)[i].as_py() for c in ("chunk", "blob", "lengths", "at"))
                again = np.frombuffer(b"".join(batch.column("shared")[i].as_py()), "<u8")
                hot = again[np.frombuffer(b"".join(batch.column("hot")[i].as_py()), bool)]
                chunk = Chunk.read(blob, lengths, at)
                which = np.flatnonzero(np.isin(chunk.hashes, again))
                is_hot = np.isin(chunk.hashes[which], hot)
                plain, out = which[~is_hot], []
                for b, k in _by_bucket((chunk.hashes[plain] % np.uint64(buckets)).astype(np.int64)):
                    k = plain[k]
                    first = chunk.first[k]
                    out.append({
                        "bucket": b, "kind": "rows", "chunk": number, "content": _pack(k.astype("<u4")), "several": _pack(chunk.several[k]),
                        "left": _pack(chunk.left[first].astype("u1")), "right": _pack(chunk.right[first].astype("u1")), "bytes": _pack(chunk.contents(k)),
                    })
                for part in np.array_split(which[is_hot], max(1, int(is_hot.sum()) // 2000)):
                    if not len(part):
                        continue
                    valid, rows = chunk.valid(part), chunk.contents(part)
                    r, o = np.nonzero(valid)
                    raw = [row.tobytes() for row in rows]
                    window = np.frombuffer(b"".join(xxhash.xxh3_128_digest(raw[a][SIDE - b:SIDE - b + LENGTH]) for a, b in zip(r.tolist(), o.tolist())), "<u8").reshape(-1, 2)
                    several = chunk.several[part][r]
                    for b, k in _by_bucket((window[:, 0] % np.uint64(buckets)).astype(np.int64)):
                        out.append({
                            "bucket": b, "kind": "windows", "chunk": number, "content": _pack(part[r[k]].astype("<u4")), "several": _pack(several[k]),
                            "o": _pack(o[k].astype("u1")), "window": _pack(window[k]),
                        })
                if out:
                    yield _rows(schema, out)

    met = texts.join(replies, "chunk")
    return met.select("chunk", "blob", "lengths", "at", "shared", "hot").mapInArrow(run, sql)


def _answers(contents: DataFrame) -> DataFrame:
    """(chunk, content, bits): the repeated windows of contents, 22 bytes of bits each."""
    width = -(-(SIDE + 1) // 8)

    def group(table: pa.Table) -> pa.Table:
        kinds = np.array(table.column("kind").to_pylist())
        found_chunk, found_content, found_bits = [], [], []

        def answer(chunk, content, bits):
            hit = bits.any(axis=1)
            found_chunk.append(chunk[hit])
            found_content.append(content[hit])
            found_bits.append(np.packbits(bits[hit], axis=1))

        part = table.filter(pa.array(kinds == "rows"))
        if len(part):
            content, rows = _columns(part, "content", "<u4")
            several, left, right = (_columns(part, c, k)[0] for c, k in (("several", bool), ("left", "u1"), ("right", "u1")))
            data = _columns(part, "bytes", np.uint8)[0].reshape(-1, SIDE + LENGTH)
            chunk = np.repeat(part.column("chunk").to_numpy(), rows)
            _, first, which, times = np.unique(data.view(f"V{SIDE + LENGTH}").ravel(), return_index=True, return_inverse=True, return_counts=True)
            bits = repeated_windows(data[first], left[first], right[first])
            o = np.arange(SIDE + 1)
            whole = (times > 1) | (np.bincount(which, several) > 0)
            bits[whole] = ((o <= left[first][:, None]) & (LENGTH - o <= right[first][:, None]))[whole]
            answer(chunk, content, bits[which])
        part = table.filter(pa.array(kinds == "windows"))
        if len(part):
            content, rows = _columns(part, "content", "<u4")
            several, o = (_columns(part, c, k)[0] for c, k in (("several", bool), ("o", "u1")))
            window = _columns(part, "window", "<u8")[0].reshape(-1, 2)
            chunk = np.repeat(part.column("chunk").to_numpy(), rows)
            by = np.lexsort((o, window[:, 1], window[:, 0]))  # a window can hold several anchors, each at its own place
            new = np.r_[True, (window[by][1:] != window[by][:-1]).any(axis=1) | (o[by][1:] != o[by][:-1])]
            group_of = np.empty(len(by), np.int64)
            group_of[by] = np.cumsum(new) - 1
            # the same window at two contents of one chunk, at two chunks, or twice in a chunk
            again = (np.bincount(group_of) > 1)[group_of] | (np.bincount(group_of, several) > 0)[group_of]
            chunk, content, o = chunk[again], content[again], o[again]
            pair, where = np.unique(np.c_[chunk, content.astype(np.int64)], axis=0, return_inverse=True) if len(chunk) else (np.zeros((0, 2), np.int64), chunk)
            bits = np.zeros((len(pair), SIDE + 1), bool)
            bits[where.ravel(), o] = True
            answer(pair[:, 0], pair[:, 1].astype("<u4"), bits)
        chunk, content, bits = np.concatenate(found_chunk), np.concatenate(found_content), np.concatenate(found_bits)
        parts = [(chunk[k[0]], k) for _, k in _by_bucket(chunk)]
        return pa.table({
            "chunk": pa.array([c for c, _ in parts], pa.int64()), "content": pa.array([content[k].astype("<u4").tobytes() for _, k in parts], pa.binary()),
            "bits": pa.array([_pack(bits[k]) for _, k in parts], pa.binary()),
        })

    assert width * 8 >= SIDE + 1
    return contents.groupBy("bucket").applyInArrow(group, "chunk bigint, content binary, bits binary")


def remove_repeats(docs: DataFrame) -> DataFrame:
    """(doc_id, n_bytes, n_removed, starts, stops, kept), one row per row of ``docs``.

    ``starts`` and ``stops`` are the byte ranges removed and ``kept`` the other bytes end to end,
    which need not be whole characters. Strings are judged on the input and do not cross
    documents; overlapping ones count. Null and empty texts have no bytes; texts under LENGTH
    bytes lose none. Repeated rows are documents of their own, so all of a repeated text of
    LENGTH bytes or more goes; ids (integers or strings) may be null. An empty table gives an
    empty result.
    """
    total = docs.agg(F.sum(byte_size(F.col("text")))).first()[0] or 0
    buckets = int(total * 2 // (SIDE + 2) // BUCKET_ANCHORS) + docs.sparkSession.sparkContext.defaultParallelism
    stored = materialise(_chunks(docs, buckets), "suffix-chunks")  # chunk numbers name rows of this table
    texts = stored.filter("kind = 'text'").select("chunk", "ids", "blob", "lengths", "at")
    shared = _shared_anchors(stored.filter("kind = 'anchor'").select("bucket", "chunk", "hashes", "counts", "twice"))
    answers = _answers(_contents(texts, shared, buckets))
    answers = answers.groupBy("chunk").agg(F.collect_list("content").alias("contents"), F.collect_list("bits").alias("bits"))
    id_sql = docs.schema["doc_id"].dataType.simpleString()
    names = ["doc_id", "n_bytes", "n_removed", "starts", "stops", "kept"]
    width = -(-(SIDE + 1) // 8)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(len(batch)):
                blob, lengths, at = (batch.column(c)[i].as_py() for c in ("blob", "lengths", "at"))
                offsets, data = np.r_[0, np.cumsum(_unpack(lengths, "<u8").astype(np.int64))], _unpack(blob, np.uint8)
                begins = np.zeros(len(data), bool)  # a repeated window starts here
                if batch.column("contents")[i].is_valid:
                    chunk = Chunk.read(blob, lengths, at)
                    content = np.frombuffer(b"".join(batch.column("contents")[i].as_py()), "<u4")
                    answer = np.zeros((len(chunk.first), width), np.uint8)
                    np.bitwise_or.at(answer, content, np.concatenate([_unpack(b, np.uint8) for b in batch.column("bits")[i].as_py()]).reshape(-1, width))
                    answer = np.unpackbits(answer, axis=1, count=SIDE + 1).astype(bool)
                    for o in range(SIDE + 1):
                        begins[chunk.at[answer[chunk.content, o]] - o] = True
                start = np.flatnonzero(begins)
                row = np.searchsorted(offsets, start, "right") - 1
                new = np.flatnonzero(np.r_[True, (start[1:] > start[:-1] + LENGTH) | (row[1:] != row[:-1])]) if len(start) else start
                first, row = start[new], row[new]
                last = start[np.r_[new[1:], len(start)] - 1] + LENGTH if len(start) else start
                n = np.diff(offsets)
                removed = np.bincount(row, last - first, len(n)).astype(np.int64)
                spans = np.r_[0, np.cumsum(np.bincount(row, minlength=len(n)))].astype(np.int32)
                edge = np.zeros(len(data) + 1, np.int8)
                edge[first] += 1
                edge[last] -= 1  # a span may end where the next text's starts
                covered = np.cumsum(edge[:-1], dtype=np.int8) > 0
                kept_at = offsets - np.r_[0, np.cumsum(removed)]
                kept = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(n), [None, pa.py_buffer(kept_at), pa.py_buffer(np.ascontiguousarray(data[~covered]))])
                yield pa.RecordBatch.from_arrays([
                    batch.column("ids")[i].values, pa.array(n), pa.array(removed),
                    *(pa.ListArray.from_arrays(spans, pa.array(x - offsets[row])) for x in (first, last)), kept.cast(pa.binary()),
                ], names)

    met = texts.join(answers, "chunk", "left").select("ids", "blob", "lengths", "at", "contents", "bits")
    return met.mapInArrow(cut, f"doc_id {id_sql}, n_bytes bigint, n_removed bigint, starts array<bigint>, stops array<bigint>, kept binary")
