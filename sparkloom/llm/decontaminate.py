"""Benchmark decontamination: BM25 over an inverted index of test items, with block-max WAND.

Every passage (window of words) of every document is a query against the index of items. A
retrieved item is verified by five-word shingles in the passage: those of the question and of
the answer, or those of the whole item, or those of the question with the words of a short
answer. Wherever an item is cut, the rest of it still counts.

Each item has a threshold of its own: the least BM25 mass that a passage can hold if it passes
the verification (see ``_lost``), so retrieval loses nothing that verification accepts.
Term statistics are those of all items, however many indexes they are dealt to.

Retrieval has two steps with the same exact bound. The first is the pivot test of WAND for a
whole batch in numpy: hits of an item's rarer terms are added up per (passage, item), and a
passage goes on only if some item can still reach its threshold with everything else it holds.
The second walks the posting lists of the passages that are left by block-max WAND.
"""

from __future__ import annotations

import math
import pickle
from collections import Counter, defaultdict
from collections.abc import Iterator, Mapping

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from sparkloom.session import materialise

K1, B = 1.2, 0.75
RETRIEVE = 1.0  # impacts are stored in units of the item's threshold
OVERLAP = 0.8  # share of question shingles and of answer shingles, or of the whole item's
SHORT_ANSWER = 25  # words; in a shorter answer one changed word can take more shingles than OVERLAP allows
SHINGLE = 5
BLOCK = 32  # postings per block
SELECTIVE = 0.05  # share of items; terms in more items are left to the second step where the threshold allows it
INDEX_BYTES = 8 << 20  # item text per index, about; more items make more indexes

# letters and digits of ASCII in lower case, other bytes from 128 unchanged, the rest white space
_PLAIN = bytes(
    c + 32 if 65 <= c <= 90 else c if 97 <= c <= 122 or 48 <= c <= 57 or c >= 128 else 32 for c in range(256)
)


def words_of(text: bytes) -> list[bytes]:
    return text.translate(_PLAIN).split()


def split_item(text: bytes) -> tuple[list[bytes], list[bytes]]:
    """(question words, answer words): the answer is the last sentence or line, if something comes before it."""
    body = text.rstrip(b" \t\r\n.!?")
    cut = max(body.rfind(b". "), body.rfind(b"? "), body.rfind(b"! "), body.rfind(b"\n"))
    question, answer = words_of(text[:cut + 1]), words_of(text[cut + 1:])
    return (question, answer) if question and answer else (words_of(text), [])


def _shingles(words: list[bytes]) -> set[tuple[bytes, ...]]:
    n = min(SHINGLE, len(words))
    return {tuple(words[i:i + n]) for i in range(len(words) - n + 1)} if n else set()


def _misses(n: int) -> int:
    """How many of n shingles or words may be missing."""
    return int((1 - OVERLAP) * n + 1e-9)


def _lost(shingles: set[tuple[bytes, ...]], mass: Mapping[bytes, float]) -> float:
    """Upper bound of the mass of words that a passage lacks while it holds OVERLAP of the shingles.

    A word is lacking only if all shingles with it are. With a word's mass dealt evenly to its
    shingles, the lacking words weigh at most what the missing shingles do, and those at most
    as much as the heaviest ones.
    """
    holders = Counter(w for s in shingles for w in set(s))
    shares = sorted((sum(mass.get(w, 0.0) / holders[w] for w in set(s)) for s in shingles), reverse=True)
    return sum(shares[:_misses(len(shares))])


def least_mass(question: list[bytes], answer: list[bytes], mass: Mapping[bytes, float]) -> float:
    """The least of an item's mass, 1 in all, in any passage that passes the verification."""
    rest = {w: x for w, x in mass.items() if w not in set(question)}
    in_answer = _lost(_shingles(answer), rest)
    if len(answer) < SHORT_ANSWER:
        counts = Counter(answer)
        words = sorted((rest.get(w, 0.0) / counts[w] for w in answer), reverse=True)
        in_answer = max(in_answer, sum(words[:_misses(len(words))]))
    return 1.0 - max(_lost(_shingles(question), mass) + in_answer, _lost(_shingles(question + answer), mass))


class ItemIndex:
    """Posting lists with block maxima; impacts are shares of the item's own score over its threshold.

    ``statistics`` is (number of items, their words, items per word) of all items; by default
    that of the given ones.
    """

    def __init__(self, items: list[tuple[object, bytes]], statistics: tuple[int, int, Mapping[bytes, int]] | None = None):
        parsed = [(i, split_item(t)) for i, t in items]
        parsed = sorted((i, q, a) for i, (q, a) in parsed if q)
        self.ids = [i for i, _, _ in parsed]
        self.parts = [(_shingles(q), _shingles(a)) for _, q, a in parsed]
        self.wholes = [_shingles(q + a) for _, q, a in parsed]
        self.short_answers = [Counter(a) if len(a) < SHORT_ANSWER else None for _, _, a in parsed]
        terms = [Counter(q + a) for _, q, a in parsed]
        lengths = [sum(t.values()) for t in terms]
        self.longest = max(lengths, default=1)
        n, words, df = statistics or (len(terms), sum(lengths), Counter(w for t in terms for w in t))
        mean = max(1.0, words / max(n, 1))
        postings, hits = defaultdict(list), defaultdict(list)
        self.thresholds = np.ones(len(terms))
        self.granted = np.ones(len(terms))  # impact that every passage is granted without a hit
        for i, t in enumerate(terms):
            part = {
                w: math.log(1 + (n - df[w] + 0.5) / (df[w] + 0.5)) * c * (K1 + 1) / (c + K1 * (1 - B + B * lengths[i] / mean))
                for w, c in t.items()
            }
            own = sum(part.values())
            shares = {w: x / own for w, x in part.items()}
            self.thresholds[i] = max(least_mass(*parsed[i][1:], shares), 1e-6)
            impacts = {w: x / self.thresholds[i] for w, x in shares.items()}
            self.granted[i] = sum(impacts.values())
            for w in sorted(impacts, key=lambda w: (df[w], w)):
                postings[w].append((i, impacts[w]))
                # hits are needed until what is granted cannot reach the threshold
                if df[w] <= max(1, SELECTIVE * n) or self.granted[i] >= RETRIEVE - 1e-6:
                    hits[w].append((i, impacts[w]))
                    self.granted[i] -= impacts[w]
        self.term = {w: k for k, w in enumerate(sorted(postings))}
        self.lists = [postings[w] for w in self.term]
        self.maxima = [max(x for _, x in p) for p in self.lists]
        self.block_maxima = [[max(x for _, x in p[a:a + BLOCK]) for a in range(0, len(p), BLOCK)] for p in self.lists]
        counts = np.array([len(hits[w]) for w in self.term], np.int64)
        self.first = np.concatenate([np.zeros(1, np.int64), np.cumsum(counts)])
        self.hit_items = np.array([i for w in self.term for i, _ in hits[w]], np.int64)
        self.hit_mass = np.array([x for w in self.term for _, x in hits[w]], float)

    @classmethod
    def restored(cls, content: dict) -> ItemIndex:
        """An index from the variables of one; only those travel, so executors need no installed package."""
        index = cls.__new__(cls)
        vars(index).update(content)
        return index

    def passages_to_search(self, terms: np.ndarray, passage: np.ndarray) -> np.ndarray:
        """Passages in which some item may reach its threshold. (term, passage) pairs are distinct."""
        counts = self.first[terms + 1] - self.first[terms]
        total = int(counts.sum())
        if not total:
            return np.zeros(0, np.int64)
        at = np.repeat(self.first[terms] - np.cumsum(counts) + counts, counts) + np.arange(total)
        key = np.repeat(passage, counts) * len(self.ids) + self.hit_items[at]
        keys, place = np.unique(key, return_inverse=True)
        mass = np.bincount(place, weights=self.hit_mass[at], minlength=len(keys))
        found = keys[mass + self.granted[keys % len(self.ids)] >= RETRIEVE - 1e-9] // len(self.ids)
        return np.unique(found)

    def search(self, terms: list[int]) -> list[tuple[int, float]]:
        """(item, impact) of all items that reach their threshold, by block-max WAND."""
        cursors = [[self.lists[k][0][0], 0, k] for k in terms]  # item, position, term
        found = []
        while cursors:
            cursors.sort()
            bound, pivot = 0.0, None
            for c in cursors:
                bound += self.maxima[c[2]]
                if bound >= RETRIEVE - 1e-9:
                    pivot = c[0]
                    break
            if pivot is None:
                return found
            at_pivot = [c for c in cursors if c[0] <= pivot]
            # block maxima of the blocks that would hold the pivot
            near, limit = 0.0, None
            for c in at_pivot:
                postings, k = self.lists[c[2]], c[1] // BLOCK
                while k < len(self.block_maxima[c[2]]) and postings[min((k + 1) * BLOCK, len(postings)) - 1][0] < pivot:
                    k += 1
                if k < len(self.block_maxima[c[2]]):
                    near += self.block_maxima[c[2]][k]
                    end = postings[min((k + 1) * BLOCK, len(postings)) - 1][0]
                    limit = end if limit is None else min(limit, end)
            if near < RETRIEVE - 1e-9:
                # no item up to the end of the nearest block can reach its threshold
                others = [c[0] for c in cursors if c[0] > pivot]
                self._advance(at_pivot, min([*others, (pivot if limit is None else limit) + 1]))
            elif cursors[0][0] == pivot:
                score = sum(self.lists[c[2]][c[1]][1] for c in at_pivot)
                if score >= RETRIEVE - 1e-9:
                    found.append((pivot, score))
                self._advance(at_pivot, pivot + 1)
            else:
                self._advance([c for c in at_pivot if c[0] < pivot], pivot)
            cursors = [c for c in cursors if c[0] is not None]
        return found

    def _advance(self, cursors: list[list], item: int) -> None:
        for c in cursors:
            postings = self.lists[c[2]]
            while c[1] < len(postings) and postings[c[1]][0] < item:
                block_end = (c[1] // BLOCK + 1) * BLOCK
                # skip a whole block where its last item is too small
                c[1] = block_end if block_end <= len(postings) and postings[block_end - 1][0] < item else c[1] + 1
            c[0] = postings[c[1]][0] if c[1] < len(postings) else None

    def _has_short_answer(self, item: int, window: list[bytes]) -> bool:
        """Whether the window holds OVERLAP of the words of the item's answer, if that is short."""
        answer = self.short_answers[item]
        if not answer:
            return False
        return (answer & Counter(window)).total() >= OVERLAP * answer.total()

    def leaks(self, text: bytes) -> dict[int, tuple[float, float, float]]:
        """{item position: (score, question overlap, answer overlap)} of verified items."""
        words = words_of(text)
        if not words or not self.ids:
            return {}
        get = self.term.get
        terms = np.fromiter((get(w, -1) for w in words), np.int64, len(words))
        step = self.longest + SHINGLE
        n_passages = max(1, -(-len(words) // step))
        at = np.flatnonzero(terms >= 0)
        # passages are two steps long and overlap by one, so an item lies whole in one of them
        first = at // step
        pairs = np.unique(np.concatenate([terms[at] * n_passages + first, (terms[at] * n_passages + first - 1)[first > 0]]))
        term, passage = pairs // n_passages, pairs % n_passages
        found: dict[int, tuple[float, float, float]] = {}
        for p in self.passages_to_search(term, passage):
            candidates = self.search(term[passage == p].tolist())
            if not candidates:
                continue
            window = words[p * step:(p + 2) * step]
            there: dict[int, set[tuple[bytes, ...]]] = {}
            for item, impact in candidates:
                q_share, a_share = (_overlap(part, window, there) for part in self.parts[item])
                if (
                    (q_share >= OVERLAP and (a_share >= OVERLAP or self._has_short_answer(item, window)))
                    or _overlap(self.wholes[item], window, there) >= OVERLAP
                ):
                    score = impact * self.thresholds[item]
                    found[item] = max(found.get(item, (0.0, 0.0, 0.0)), (score, q_share, a_share))
        return found


def _overlap(shingles: set[tuple[bytes, ...]], window: list[bytes], there: dict[int, set[tuple[bytes, ...]]]) -> float:
    """Share of the shingles in the window; ``there`` keeps the window's shingles by length."""
    if not shingles:
        return 1.0
    n = len(next(iter(shingles)))
    if n not in there:
        there[n] = set(zip(*(window[k:] for k in range(n))))
    return len(shingles & there[n]) / len(shingles)


def _words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A row per item and distinct word, and one without a word that has the item's length."""
    for batch in batches:
        for segment, text in zip(batch.column("segment").to_pylist(), batch.column("text").to_pylist()):
            words = words_of(text)
            if words:
                distinct = [None, *sorted(set(words))]
                columns = [[segment] * len(distinct), distinct, [len(words)] + [0] * (len(distinct) - 1)]
                types = [pa.int32(), pa.binary(), pa.int64()]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types)], ["segment", "word", "length"])


def indexes(items: DataFrame) -> list[Broadcast]:
    """Indexes of the rows (item_id, text), each of about INDEX_BYTES of text or one item.

    Items are dealt to indexes by hash and each index is built in a task, with the term
    statistics of all items. The driver passes on the content of one index at a time. Null ids and texts
    without words are left out.
    """
    known = items.select("item_id", F.col("text").cast("binary").alias("text")).filter("item_id IS NOT NULL AND text IS NOT NULL").distinct()
    size = known.agg(F.sum(F.octet_length("text"))).first()[0]
    if not size:
        return []
    segments = -(-size // INDEX_BYTES)
    dealt = materialise(known.withColumn("segment", F.pmod(F.xxhash64("item_id", "text"), F.lit(segments)).cast("int")), "items")
    words = materialise(
        dealt.mapInArrow(_words, "segment int, word binary, length bigint")
        .groupBy("segment", "word").agg(F.count("*").alias("items"), F.sum("length").alias("length")), "item_words"
    )
    totals = words.groupBy("word").agg(F.sum("items").alias("items"), F.sum("length").alias("length"))
    first = totals.filter("word IS NULL").first()
    if not first:
        return []
    n, length = first["items"], first["length"]
    counted = words.filter("word IS NOT NULL").select("segment", "word").join(totals.select("word", "items"), "word").select("segment", "word", "items")

    def build(rows: pa.Table, terms: pa.Table) -> pa.Table:
        df = dict(zip(terms["word"].to_pylist(), terms["items"].to_pylist()))
        texts = list(zip(rows["item_id"].to_pylist(), rows["text"].to_pylist()))
        index = ItemIndex(texts, (n, length, df))
        return pa.table({"index": pa.array([pickle.dumps(vars(index))] if index.ids else [], pa.large_binary()).cast(pa.binary())})

    built = materialise(
        dealt.groupBy("segment").cogroup(counted.groupBy("segment")).applyInArrow(build, "index binary"), "item_index"
    )
    context = items.sparkSession.sparkContext
    return [context.broadcast(pickle.loads(row["index"])) for row in built.toLocalIterator()]


def leaks(docs: DataFrame, items: DataFrame) -> DataFrame:
    """(doc_id, item_id, score, question_overlap, answer_overlap) of every verified pair of document row and item.

    Null and empty texts match nothing; whole texts are searched; repeated rows give repeated
    pairs. Empty tables give an empty result.
    """
    doc_id = docs.schema["doc_id"].dataType.simpleString()
    item_id = items.schema["item_id"].dataType
    schema = f"doc_id {doc_id}, item_id {item_id.simpleString()}, score double, question_overlap double, answer_overlap double"
    item_type = to_arrow_type(item_id)

    def against(shared: Broadcast) -> DataFrame:
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            index = ItemIndex.restored(shared.value)
            for batch in batches:
                rows = [
                    (row, index.ids[item], *shares)
                    for row, text in enumerate(batch.column(1).cast(pa.large_binary()))
                    for item, shares in sorted(index.leaks(text.as_py() or b"").items())
                ]
                at, *rest = list(zip(*rows)) if rows else [[]] * 5
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).take(pa.array(at, pa.int64())), pa.array(rest[0], item_type), *(pa.array(r, pa.float64()) for r in rest[1:])],
                    ["doc_id", "item_id", "score", "question_overlap", "answer_overlap"],
                )

        return docs.select("doc_id", "text").mapInArrow(run, schema)

    built = indexes(items)
    if not built:
        return docs.sparkSession.createDataFrame([], schema)
    frames = [against(i) for i in built]
    out = frames[0]
    for f in frames[1:]:
        out = out.unionAll(f)
    return out


def clean(docs: DataFrame, items: DataFrame) -> DataFrame:
    """The rows of ``docs`` that hold no verified item; all columns kept."""
    at = docs.columns.index("text")

    def without(rows: DataFrame, shared: Broadcast) -> DataFrame:
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            index = ItemIndex.restored(shared.value)
            for batch in batches:
                keep = [not index.leaks(t.as_py() or b"") for t in batch.column(at).cast(pa.large_binary())]
                yield batch.filter(pa.array(keep, pa.bool_()))

        return rows.mapInArrow(run, docs.schema)

    for index in indexes(items):
        docs = without(docs, index)
    return docs
