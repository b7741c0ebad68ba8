"""Toxicity by a subsequence string-kernel support vector machine with Nystroem landmarks.

The kernel of two words sums over their common subsequences of three and four letters within
six places, each weighing DECAY per place it spans, so a gap or an inserted character weakens
a match and does not end it. Characters that are no letters are dropped inside words, and
single letters in a row count as one word, so spelled-out insults meet the kernel too. The
start of a word counts as a letter of its own. Letters of all scripts count: accented
Latin letters are one letter, and one of another script has one of 27 letter classes, by its code
point in lower case without accents. Words end at ASCII white space, so text of a script without spaces is one long word.

A document is toxic if one of its words is: training alternates between choosing each
labelled document's most toxic words and fitting a linear machine on their Nystroem features
(multiple-instance learning). The machine is linear in the kernel, so it folds into one weight
per subsequence, and scoring a text is a handful of table look-ups per letter in numpy.
"""

from __future__ import annotations

import sys
import unicodedata
from collections import Counter, defaultdict
from collections.abc import Iterator
from functools import cache
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sparkloom.llm.common import hash_share, held_out
from sparkloom.llm.textbatch import SPACE, pieces

DECAY = 0.7
SPAN = 6
BASE = 29  # 1..26 the Latin letters, 27 accented ones, 1..27 the classes of other scripts, 28 the start of a word
TABLE = 0x20000  # code points from here on are ideographs and count as letters
LANDMARKS = 96
SAMPLE_ROWS = 3000  # labelled documents the machine learns from, at most
SAMPLE_BYTES = 20_000  # longer texts are left out of the sample
ROUNDS = 5
STEM = 5  # letters of a stem
BLOCK_BYTES = 8 << 20  # of features of words, as a dense block, in the driver at once
WITNESSES = 4  # words that speak for a document in training
THRESHOLD = 0.7
FIRST_SHARE = 0.4  # least shrunk share of toxic documents for a first witness
FLOOR = -1.0  # least word score that counts

_CLASS = np.zeros(256, np.int32)
_CLASS[ord("a"):ord("z") + 1] = np.arange(1, 27)
_CLASS[ord("A"):ord("Z") + 1] = np.arange(1, 27)
_LETTERS = _CLASS.copy()  # of strings with ~ for 27 and ^ for 28
_LETTERS[ord("~")], _LETTERS[ord("^")] = 27, 28
_PATTERNS = [(0, *rest) for n in (2, 3) for rest in combinations(range(1, SPAN), n)]
_SIZE = BASE**3 + BASE**4


def _norms(longest: int) -> np.ndarray:
    """Square root of the self-kernel of a word of n different letters, by n."""
    own = np.zeros(longest + 1)
    for p in _PATTERNS:
        own += np.maximum(np.arange(longest + 1) - p[-1], 0) * DECAY ** (2 * (p[-1] + 1))
    return np.sqrt(np.maximum(own, 1e-12))


def _class_of(code: int) -> int:
    letter = chr(code).upper().lower()[:1]  # a final sigma is a sigma
    if not letter.isalpha():
        return 0
    base = ord(unicodedata.normalize("NFD", letter)[0])
    return 1 + base % 27 if base >= 128 else int(_CLASS[base]) if code < 128 else 27


@cache
def _classes() -> np.ndarray:
    return np.array([_class_of(code) for code in range(TABLE)], np.int32)


def classes_of(data: np.ndarray) -> np.ndarray:
    """Letter class of each byte of UTF-8 text; a longer character has its class at its first byte, 0 at the others."""
    out = _CLASS[data]
    at = np.flatnonzero(data >= 0xC0)
    if len(at):
        follow = np.r_[data, np.zeros(3, np.uint8)].astype(np.int64) & 0x3F
        lead = data[at].astype(np.int64)
        two = (lead & 0x1F) << 6 | follow[at + 1]
        three = (lead & 0x0F) << 12 | follow[at + 1] << 6 | follow[at + 2]
        four = (lead & 0x07) << 18 | follow[at + 1] << 12 | follow[at + 2] << 6 | follow[at + 3]
        code = np.where(lead < 0xE0, two, np.where(lead < 0xF0, three, four))
        out[at] = np.where(code < TABLE, _classes()[np.minimum(code, TABLE - 1)], 1 + code % 27)
    return out


def letters_of(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(letters, index of each word's start mark, row of each word)."""
    starts_row = np.zeros(len(data) + 1, bool)
    starts_row[offsets[:-1]] = True
    word = np.cumsum(SPACE[data] | starts_row[:-1], dtype=np.int32)
    classes = classes_of(data)
    at = np.flatnonzero(classes)
    if not len(at):
        return np.zeros(0, np.int32), np.zeros(0, np.int64), np.zeros(0, np.int64)
    letters, word = classes[at], word[at]
    first = np.flatnonzero(np.r_[True, word[1:] != word[:-1]])
    row = np.searchsorted(offsets, at[first], "right") - 1
    single = np.diff(np.r_[first, len(at)]) == 1
    joined = np.r_[False, single[1:] & single[:-1] & (row[1:] == row[:-1])]
    first, row = first[~joined], row[~joined]
    return np.insert(letters, first, 28), first + np.arange(len(first)), row


def _terms(letters: np.ndarray, word: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, float]]:
    """(index of first letter, subsequence number, weight) for every pattern."""
    for last in range(2, SPAN):
        if len(letters) <= last:
            return
        i = np.flatnonzero(word[:-last] == word[last:])
        head = letters[i] * BASE
        for p in _PATTERNS:
            if p[-1] != last:
                continue
            number = head + letters[i + p[1]]
            for o in p[2:]:
                number = number * BASE + letters[i + o]
            yield i, number + (BASE**3 if len(p) == 4 else 0), DECAY ** (last + 1)


def word_scores(letters: np.ndarray, first: np.ndarray, weights: np.ndarray) -> np.ndarray:
    """The kernel machine's sum for each word, without its offset."""
    if not len(first):
        return np.zeros(0)
    lengths = np.diff(np.r_[first, len(letters)])
    word = np.repeat(np.arange(len(first), dtype=np.int32), lengths)
    total = np.zeros(len(letters), np.float32)
    for i, number, decay in _terms(letters, word):
        total[i] += weights[number] * np.float32(decay)
    return np.add.reduceat(total, first) / _norms(int(lengths.max()))[lengths]


class ToxicityModel:
    """weights: one per subsequence; offset of the machine; curve: slopes for the two document features, shift."""

    def __init__(self, weights: np.ndarray, offset: float, curve: tuple[float, float, float]):
        self.weights, self.offset, self.curve = weights, offset, curve

    def features(self, column: pa.Array) -> np.ndarray:
        """Largest word score per row, and the mean of the three largest; scores of less than -1 count as -1."""
        rows_of, scores_of = [np.zeros(0, np.int64)], [np.zeros(0)]
        for data, offsets, rows in pieces(column):
            letters, first, row = letters_of(data, offsets)
            found = word_scores(letters, first, self.weights) + self.offset
            high = found > FLOOR
            rows_of.append(rows[row[high]])
            scores_of.append(found[high])
        row, score = np.concatenate(rows_of), np.concatenate(scores_of)
        order = np.lexsort((-score, row))
        row, score = row[order], score[order]
        place = np.arange(len(row)) - np.searchsorted(row, row)
        top = np.full((len(column), 3), FLOOR)
        top[row[place < 3], place[place < 3]] = score[place < 3]
        return np.c_[top[:, 0], top.mean(axis=1)]

    def scores(self, column: pa.Array) -> np.ndarray:
        """Probability per row; a row without words gets the lowest."""
        z = self.features(column) @ np.array(self.curve[:2]) + self.curve[2]
        return 1 / (1 + np.exp(-np.clip(z, -50, 50)))


def _features(words: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(word, subsequence number, normalised weight) triples."""
    letters = _LETTERS[np.frombuffer("".join(words).encode(), np.uint8)]
    lengths = np.array([len(w) for w in words])
    first = np.cumsum(lengths) - lengths
    word = np.repeat(np.arange(len(first)), lengths)
    found = [(word[i], n, np.full(len(i), w)) for i, n, w in _terms(letters, word)]
    if not found:
        return np.zeros(0, int), np.zeros(0, int), np.zeros(0)
    owner, number, weight = (np.concatenate(x) for x in zip(*found))
    return owner, number, weight / _norms(int(lengths.max()))[lengths[owner]]


def _words(text: str) -> set[str]:
    """Distinct normalised words of 3 to 40 letters behind ^; the 27 letter classes are written a to z and ~."""
    data = np.frombuffer(text.encode("utf-8", "replace"), np.uint8)
    letters, first, _ = letters_of(data, np.array([0, len(data)]))
    keys = np.array([0, *range(97, 123), 126, 94], np.uint8)[letters].tobytes().decode()
    ends = [*first[1:].tolist(), len(keys)]
    return {sys.intern(keys[a:b]) for a, b in zip(first.tolist(), ends) if 4 <= b - a <= 41}


def _landmarks(bags: list[tuple[set[str], int]], y: np.ndarray) -> tuple[list[str], dict[str, float]]:
    """Landmark strings, and for each string that toxic documents hold the shrunk share of toxic among its documents.

    The lift of a string is (p - q)^2 / (p + q) for the shares p of toxic and q of clean documents that hold it.

    Candidates are words and stems (runs of STEM letters within words), as insults are inflected. Each turn takes
    the one with the most lift, where a toxic document counts half as much each time a
    landmark has covered it: insults of a small group of documents get landmarks as well.
    A third of the landmarks are frequent words of clean documents.
    """
    holders: dict[str, list[int]] = defaultdict(list)
    for i, (words, label) in enumerate(bags):
        if label:
            for s in words.union(*(_stems(w) for w in words)):
                holders[s].append(i)
    holders = {s: at for s, at in holders.items() if len(at) > 2}
    clean, plain, known = Counter(), Counter(), {}
    for words, label in bags:
        if not label:
            plain.update(words)
            for w in words:
                if w not in known:
                    known[w] = [s for s in {w, *_stems(w)} if s in holders]
            clean.update(set().union(*(known[w] for w in words)))
    n = np.bincount(y, minlength=2)
    share = {s: (len(at) / n[1], clean[s] / n[0]) for s, at in holders.items()}
    lift = {s: max(p - q, 0.0) ** 2 / (p + q) for s, (p, q) in share.items()}
    common = [w for w, _ in sorted(plain.items(), key=lambda x: (-x[1], x[0]))[:LANDMARKS // 3]]
    candidates = {s: np.array(holders[s]) for s in sorted(lift, key=lambda s: (-lift[s], s)) if lift[s] > 0}
    worth, chosen = np.ones(len(bags)), []
    while candidates and len(chosen) < LANDMARKS - len(common):
        best = max(candidates, key=lambda s: worth[candidates[s]].sum() * lift[s] / len(candidates[s]))
        worth[candidates.pop(best)] /= 2
        chosen.append(best)
    worst = {s: len(at) / (len(at) + clean[s] + 5) for s, at in holders.items()}
    return list(dict.fromkeys(chosen + common)), worst


def _stems(word: str) -> set[str]:
    return {word[i:i + STEM] for i in range(len(word) - STEM + 1)}


def fit(texts: list[str], labels: list[int], seed: int = 0) -> ToxicityModel:
    """Fit on labelled texts. Equal texts count once per label; without both labels the score is the share of ones."""
    seen = {(t, int(y)): None for t, y in zip(texts, labels)}
    bags = [(_words(t), y) for t, y in seen]
    bags = [(w, y) for w, y in bags if w]
    y = np.array([y for _, y in bags])
    if len(set(y.tolist())) < 2:
        share = float(y.mean()) if len(y) else 0.0
        return ToxicityModel(np.zeros(_SIZE, np.float32), 0.0, (0.0, 0.0, float(np.log((share + 1e-3) / (1 - share + 1e-3)))))
    landmarks, worst = _landmarks(bags, y)

    owner, number, weight = _features(landmarks)
    columns, place = np.unique(number, return_inverse=True)
    phi = np.zeros((len(landmarks), len(columns)))
    np.add.at(phi, (owner, place), weight)
    values, vectors = np.linalg.eigh(phi @ phi.T)
    keep = values > 1e-6 * values.max()
    half = vectors[:, keep] / np.sqrt(values[keep])  # K^-1/2 on its range

    vocabulary = sorted(set().union(*(w for w, _ in bags)))
    number_of = {w: i for i, w in enumerate(vocabulary)}
    z = np.zeros((len(vocabulary), half.shape[1]), np.float32)
    step = max(1, BLOCK_BYTES // (1024 * len(columns))) * 256  # words at a time
    right, narrow = phi.T.astype(np.float32), half.astype(np.float32)
    for a in range(0, len(vocabulary), step):
        owner, number, weight = _features(vocabulary[a:a + step])
        place = np.minimum(np.searchsorted(columns, number), len(columns) - 1)
        hit = columns[place] == number
        block = np.zeros((min(step, len(vocabulary) - a), len(columns)), np.float32)
        np.add.at(block, (owner[hit], place[hit]), weight[hit])
        z[a:a + step] = block @ right @ narrow
    del block

    members = [np.array([number_of[w] for w in words]) for words, _ in bags]
    # first witnesses: words that hold a string mostly met in toxic documents
    score = np.array([max([worst.get(w, 0.0), *(worst.get(s, 0.0) for s in _stems(w))]) for w in vocabulary])
    beta, b, best = np.zeros(z.shape[1]), 0.0, -1.0
    for turn in range(ROUNDS):
        rows, target, mass = [], [], []
        cut = np.quantile([score[m].max() for m, t in zip(members, y) if t == 0], 0.85) if turn else FIRST_SHARE
        for m, t in zip(members, y):
            top = m[np.argsort(-score[m], kind="stable")[:WITNESSES]]
            # words like the worst of clean documents are no witnesses; a document labelled toxic may have none
            if t:
                top = top[score[top] > cut]
            rows += top.tolist()
            target += [1.0 if t else -1.0] * len(top)
        if 1.0 not in target:
            break
        x, t = z[rows].astype(float), np.array(target)
        mass = np.where(t > 0, 0.5 / (t > 0).sum(), 0.5 / (t < 0).sum())
        w, shift = _svm(x, t, mass)
        # a part at a time, as the product takes z in double precision
        score = np.concatenate([z[a:a + step] @ w for a in range(0, len(z), step)]) + shift
        # the turn whose worst words tell the documents apart best is kept, the later one of equals
        parted = _separation(np.array([score[m].max() for m in members]), y)
        if parted >= best:
            beta, b, best = w, shift, parted
    alpha = half @ beta
    weights = np.zeros(_SIZE, np.float32)
    weights[columns] = (phi.T @ alpha).astype(np.float32)
    model = ToxicityModel(weights, float(b), (0.0, 0.0, 0.0))
    model.curve = _curve(model.features(pa.array([t for t, _ in seen])), np.array([y for _, y in seen]))
    return model


def _separation(score: np.ndarray, y: np.ndarray) -> float:
    """Share of (toxic, clean) pairs in the right order; ties count half."""
    clean, toxic = np.sort(score[y == 0]), score[y == 1]
    below = np.searchsorted(clean, toxic, "left") + np.searchsorted(clean, toxic, "right")
    return float(below.mean() / 2 / len(clean))


def _svm(x: np.ndarray, y: np.ndarray, mass: np.ndarray, ridge: float = 1e-4) -> tuple[np.ndarray, float]:
    """Linear machine with squared hinge loss, by Newton steps on the active rows."""
    a = np.c_[x, np.ones(len(x))]
    w = np.zeros(a.shape[1])
    penalty = np.full(a.shape[1], ridge)
    penalty[-1] = 1e-8
    for _ in range(50):
        active = y * (a @ w) < 1
        h = (a[active] * mass[active, None]).T @ a[active] + np.diag(penalty)
        new = np.linalg.solve(h, (a[active] * mass[active, None]).T @ y[active])
        if np.allclose(new, w, atol=1e-8):
            break
        w = new
    return w[:-1], float(w[-1])


def _curve(f: np.ndarray, y: np.ndarray) -> tuple[float, float, float]:
    """Slopes and shift of a logistic curve through (f, y)."""
    a, w = np.c_[f, np.ones(len(f))], np.zeros(f.shape[1] + 1)
    penalty = np.array([1e-2] * f.shape[1] + [1e-6])
    for _ in range(30):
        p = 1 / (1 + np.exp(-np.clip(a @ w, -30, 30)))
        h = (a * (p * (1 - p))[:, None]).T @ a + np.diag(penalty)
        w = w + np.linalg.solve(h, a.T @ (y - p) - penalty * w)
    return tuple(w.tolist())


def learning_sample(docs: DataFrame, labels: DataFrame, rows: int = SAMPLE_ROWS) -> tuple[list[str], list[int]]:
    """At most ``rows`` labelled texts outside the held-out fold: those whose ids have the smallest hashes.

    Rows with a null id, text or label, and texts over SAMPLE_BYTES, are left out. A document
    with several labels counts as toxic if one of them says so.
    """
    known = labels.filter("doc_id IS NOT NULL AND toxic IS NOT NULL").filter(~held_out(F.col("doc_id")))
    known = known.groupBy("doc_id").agg(F.max("toxic").cast("int").alias("toxic"))
    chosen = known.orderBy(hash_share(F.col("doc_id"), seed=8), "doc_id").limit(rows)
    texts = docs.select("doc_id", "text").filter(F.octet_length("text") <= SAMPLE_BYTES)
    # the left side has at most `rows` rows of two numbers
    got = texts.join(F.broadcast(chosen), "doc_id").select("doc_id", "text", "toxic").orderBy("doc_id", "text").limit(rows).collect()
    return [r["text"] for r in got], [r["toxic"] for r in got]


def train(docs: DataFrame, labels: DataFrame, rows: int = SAMPLE_ROWS) -> ToxicityModel:
    return fit(*learning_sample(docs, labels, rows))


def score(docs: DataFrame, model: ToxicityModel, column: str = "__toxicity") -> DataFrame:
    """All columns of ``docs`` and the probability of being toxic; null and empty texts get the lowest."""
    names = docs.columns
    schema = docs.select("*", F.lit(0.0).alias(column)).schema
    at = names.index("text")

    # the model travels with the function: one float per subsequence, 2.5 MB
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            p = pa.array(model.scores(batch.column(at)), pa.float64())
            yield pa.RecordBatch.from_arrays([*batch.columns, p], [*batch.schema.names, column])

    return docs.mapInArrow(run, schema)
