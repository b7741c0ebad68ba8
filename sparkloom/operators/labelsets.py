"""Label counts of many column sets in one pass, for tables of any width.

Rows cross to Python as Arrow batches. A task keeps a dictionary of codes per column, counts
code tuples of every set batch by batch, and emits each distinct tuple with its count; Spark
adds the tasks' counts up. No row is expanded per set, so hundreds of columns cost arithmetic
on codes and not hundreds of rows.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

HELD = 1 << 20  # tuples, or pair cells times four, that a task holds before it emits them
DENSE = 1 << 16  # code tuples counted by direct index
PACKED = 1 << 62
BLOCK_COLUMNS = 32
ONE_HOT_LABELS = 48  # columns with more labels in a batch are counted pair by pair
ONE_HOT_ROWS = 2048


class ColumnCodes:
    """Codes of the labels of one column, in order of first sight; null is -1."""

    def __init__(self):
        self.code: dict[str, int] = {}
        self.labels: list[str] = []

    def of(self, column: pa.Array) -> np.ndarray:
        coded = column.dictionary_encode()
        known = np.empty(len(coded.dictionary) + 1, np.int64)
        known[-1] = -1
        for i, label in enumerate(coded.dictionary.to_pylist()):
            at = self.code.setdefault(label, len(self.labels))
            if at == len(self.labels):
                self.labels.append(label)
            known[i] = at
        return known[coded.indices.fill_null(-1).to_numpy(zero_copy_only=False)]


def _tuples(columns: list[np.ndarray], sizes: list[int]) -> tuple[np.ndarray, np.ndarray]:
    """(distinct code tuples, their counts) of the rows that have all codes."""
    full = np.logical_and.reduce([c >= 0 for c in columns])
    columns = [c[full] for c in columns]
    cells = 1
    for s in sizes:
        cells *= max(1, s)
    if cells >= PACKED:
        return np.unique(np.stack(columns, axis=1), axis=0, return_counts=True)
    key = columns[0]
    for c, s in zip(columns[1:], sizes[1:]):
        key = key * s + c
    if cells <= DENSE:
        counts = np.bincount(key, minlength=1)
        key = np.flatnonzero(counts)
        counts = counts[key]
    else:
        key, counts = np.unique(key, return_counts=True)
    out = []
    for s in reversed(sizes[1:]):
        key, c = np.divmod(key, s)
        out.append(c)
    return np.stack([key, *reversed(out)], axis=1), counts


def count_sets(labels: DataFrame, sets: Sequence[Sequence[str]]) -> DataFrame:
    """``(at, labels, n)``: counts of the distinct label tuples of each set of columns.

    ``at`` is the set's place in ``sets`` and ``labels`` an array in the set's order. All columns
    are strings; rows with a null in a set are left out of that set only.
    """
    names = sorted({c for s in sets for c in s})
    place = [[names.index(c) for c in s] for s in sets]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codes, found, held = [ColumnCodes() for _ in names], [{} for _ in place], 0

        def emit():
            for at, counts in enumerate(found):
                if counts:
                    words = [[codes[c].labels[k] for c, k in zip(place[at], key)] for key in counts]
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(np.full(len(words), at, np.int32)), pa.array(words, pa.list_(pa.string())), pa.array(list(counts.values()), pa.int64())], ["at", "labels", "n"])

        for batch in batches:
            coded = [c.of(column) for c, column in zip(codes, batch.columns)]
            for own, counts in zip(place, found):
                before = len(counts)
                keys, times = _tuples([coded[c] for c in own], [len(codes[c].labels) for c in own])
                for key, n in zip(map(tuple, keys.tolist()), times.tolist()):
                    counts[key] = counts.get(key, 0) + n
                held += len(counts) - before
            if held > HELD:
                yield from emit()
                found, held = [{} for _ in place], 0
        yield from emit()

    parts = labels.select(*names).mapInArrow(run, "at int, labels array<string>, n bigint")
    return parts.groupBy("at", "labels").agg(F.sum("n").alias("n"))


def _block_cells(coded: list[np.ndarray]) -> Iterator[tuple[int, int, np.ndarray, np.ndarray, np.ndarray]]:
    """(i, j, codes of i, codes of j, counts) of all pairs of columns i < j of one batch.

    Columns with few labels are laid out one-hot in blocks, and a product of two blocks has the
    counts of all their pairs. The others are counted pair by pair.
    """
    local = [np.unique(c[c >= 0]) for c in coded]
    narrow = [i for i, u in enumerate(local) if len(u) <= ONE_HOT_LABELS]
    blocks = [narrow[a:a + BLOCK_COLUMNS] for a in range(0, len(narrow), BLOCK_COLUMNS)]
    widths = [np.cumsum([0, *[len(local[i]) for i in block]]) for block in blocks]
    rows = len(coded[0]) if coded else 0
    products = {(p, q): np.zeros((widths[p][-1], widths[q][-1]), np.int64) for q in range(len(blocks)) for p in range(q + 1)}
    for a in range(0, rows, ONE_HOT_ROWS):
        hot = []
        for block, width in zip(blocks, widths):
            x = np.zeros((min(ONE_HOT_ROWS, rows - a), width[-1]), np.float32)
            for i, begin in zip(block, width):
                c = coded[i][a:a + ONE_HOT_ROWS]
                known = np.flatnonzero(c >= 0)
                x[known, begin + np.searchsorted(local[i], c[known])] = 1
            hot.append(x)
        for p, q in products:
            products[p, q] += (hot[p].T @ hot[q]).astype(np.int64)  # exact: at most ONE_HOT_ROWS
    for (p, q), product in products.items():
        for s, i in enumerate(blocks[p]):
            for t, j in enumerate(blocks[q]):
                if i < j:
                    cells = product[widths[p][s]:widths[p][s + 1], widths[q][t]:widths[q][t + 1]]
                    u, v = np.nonzero(cells)
                    yield i, j, local[i][u], local[j][v], cells[u, v]
    wide = set(range(len(coded))) - set(narrow)
    for i in range(len(coded)):
        for j in range(i + 1, len(coded)):
            if i in wide or j in wide:
                keys, counts = _tuples([coded[i], coded[j]], [int(local[k][-1]) + 1 if len(local[k]) else 0 for k in (i, j)])
                yield i, j, keys[:, 0], keys[:, 1], counts


def count_pairs(labels: DataFrame, names: Sequence[str]) -> DataFrame:
    """``(u, v, a, b, n)``: label counts of every pair of columns, u before v in ``names``.

    All columns are strings; rows with a null in a pair are left out of that pair only.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codes = [ColumnCodes() for _ in names]
        # a cell is (pair of columns, pair of codes); cells are merged whenever many have come
        pairs, cells, counts, held, merged = [], [], [], 0, 0

        def merge():
            pair, cell, count = (np.concatenate(x) if x else np.zeros(0, np.int64) for x in (pairs, cells, counts))
            order = np.lexsort((cell, pair))
            pair, cell, count = pair[order], cell[order], count[order]
            new = np.flatnonzero(np.r_[True, (pair[1:] != pair[:-1]) | (cell[1:] != cell[:-1])]) if len(pair) else order
            return pair[new], cell[new], np.add.reduceat(count, new) if len(new) else count

        def emit():
            pair, cell, count = merge()
            for a in range(0, len(pair), 1 << 16):
                u, v = np.divmod(pair[a:a + (1 << 16)], len(names))
                x, y = cell[a:a + (1 << 16)] >> 32, cell[a:a + (1 << 16)] & 0xFFFFFFFF
                named = lambda at: pa.array([names[k] for k in at.tolist()], pa.string())
                words = lambda at, c: pa.array([codes[i].labels[k] for i, k in zip(at.tolist(), c.tolist())], pa.string())
                yield pa.RecordBatch.from_arrays([named(u), named(v), words(u, x), words(v, y), pa.array(count[a:a + (1 << 16)])], ["u", "v", "a", "b", "n"])

        for batch in batches:
            for i, j, x, y, n in _block_cells([c.of(column) for c, column in zip(codes, batch.columns)]):
                pairs.append(np.full(len(n), i * len(names) + j, np.int64))
                cells.append(x << 32 | y)
                counts.append(n.astype(np.int64))
                held += len(n)
            if held > 4 * HELD + 2 * merged:
                pair, cell, count = merge()
                if len(pair) > 8 * HELD:
                    yield from emit()
                    pairs, cells, counts, held, merged = [], [], [], 0, 0
                else:
                    pairs, cells, counts, held, merged = [pair], [cell], [count], len(pair), len(pair)
        yield from emit()

    parts = labels.select(*names).mapInArrow(run, "u string, v string, a string, b string, n bigint")
    return parts.groupBy("u", "v", "a", "b").agg(F.sum("n").alias("n"))
