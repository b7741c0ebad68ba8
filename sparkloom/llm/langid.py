"""Language identification by a byte convolutional network.

Bytes are embedded, filters of several widths slide over a window of fixed length, each
filter's largest response is kept, and a softmax layer gives the languages. The network is
trained in numpy on windows of labelled documents. A text is cut into windows from its first to its last
byte; its probabilities are the means over the windows, weighted by their bytes.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from sparkloom.llm.common import hash_share, held_out
from sparkloom.llm.textbatch import pieces
from sparkloom.session import materialise

WINDOW = 256
EMBED = 8
WIDTHS = (2, 3, 4)
FILTERS = 12  # per width
EPOCHS = 12
SAMPLE_PER_LANGUAGE = 700  # training documents at most; fewer where all languages together would exceed SAMPLE_ROWS
SAMPLE_ROWS = 8000
EXCERPT = 400  # characters of a training document, at a place drawn from its id
UNKNOWN = "und"
_BATCH = 256

_LETTER = np.zeros(256, bool)
_LETTER[[*range(65, 91), *range(97, 123)]] = True


class ByteNetwork:
    """Embedding (256, EMBED), filters (4 * EMBED, all filters; zero outside their width), output layer."""

    def __init__(self, languages: list[str], rng: np.random.Generator):
        self.languages = languages
        n = FILTERS * len(WIDTHS)
        widest = max(WIDTHS)
        self.mask = np.zeros((widest * EMBED, n), np.float32)
        for k, width in enumerate(WIDTHS):
            self.mask[: width * EMBED, k * FILTERS:(k + 1) * FILTERS] = 1
        self.embed = rng.normal(0, 0.5, (256, EMBED)).astype(np.float32)
        self.embed[0] = 0  # padding
        self.filters = rng.normal(0, 0.3, self.mask.shape).astype(np.float32) * self.mask
        self.bias = np.zeros(n, np.float32)
        self.out = rng.normal(0, 0.1, (n, len(languages))).astype(np.float32)
        self.shift = np.zeros(len(languages), np.float32)

    def pooled(self, windows: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(sliding inputs, place of the largest response, response) of byte windows."""
        x = self.embed[windows].reshape(len(windows), -1)
        width = max(WIDTHS) * EMBED
        slid = np.lib.stride_tricks.sliding_window_view(x, width, axis=1)[:, ::EMBED]
        response = slid.reshape(-1, width) @ self.filters
        response = response.reshape(len(windows), -1, response.shape[1])
        at = response.argmax(axis=1) if self.training else None
        return slid, at, response.max(axis=1)

    training = False

    def probabilities(self, windows: np.ndarray) -> np.ndarray:
        if not self.languages:
            return np.zeros((len(windows), 0))
        _, _, best = self.pooled(windows)
        z = np.maximum(best + self.bias, 0) @ self.out + self.shift
        z = np.exp(z - z.max(axis=1, keepdims=True))
        return z / z.sum(axis=1, keepdims=True)

    def train(self, windows: np.ndarray, labels: np.ndarray, rng: np.random.Generator) -> None:
        """Adam on the cross-entropy; gradients pass through the largest response alone."""
        names = ("embed", "filters", "bias", "out", "shift")
        m = {k: np.zeros_like(getattr(self, k)) for k in names}
        v = {k: np.zeros_like(getattr(self, k)) for k in names}
        turn = 0
        self.training = True
        for _ in range(EPOCHS):
            order = rng.permutation(len(windows))
            for a in range(0, len(order), 64):
                rows = order[a:a + 64]
                slid, at, best = self.pooled(windows[rows])
                hidden = np.maximum(best + self.bias, 0)
                z = hidden @ self.out + self.shift
                z = np.exp(z - z.max(axis=1, keepdims=True))
                p = z / z.sum(axis=1, keepdims=True)
                p[np.arange(len(rows)), labels[rows]] -= 1
                p /= len(rows)
                g_hidden = (p @ self.out.T) * (hidden > 0)
                inputs = np.take_along_axis(slid, at[:, :, None], axis=1)  # row, filter, input
                g_filters = np.einsum("rfi,rf->if", inputs, g_hidden, optimize=True) * self.mask
                g_inputs = g_hidden[:, :, None] * self.filters.T[None]
                g_embed = np.zeros_like(self.embed)
                for k in range(max(WIDTHS)):
                    byte = np.take_along_axis(windows[rows], at + k, axis=1)
                    np.add.at(g_embed, byte.ravel(), g_inputs[:, :, k * EMBED:(k + 1) * EMBED].reshape(-1, EMBED))
                g_embed[0] = 0
                grads = {"embed": g_embed, "filters": g_filters, "bias": g_hidden.sum(0), "out": hidden.T @ p, "shift": p.sum(0)}
                turn += 1
                for k in names:
                    m[k] += 0.1 * (grads[k] - m[k])
                    v[k] += 0.001 * (grads[k] ** 2 - v[k])
                    step = 0.004 * (m[k] / (1 - 0.9**turn)) / (np.sqrt(v[k] / (1 - 0.999**turn)) + 1e-8)
                    setattr(self, k, (getattr(self, k) - step).astype(np.float32))
        self.training = False

    def predict(self, column: pa.Array) -> tuple[list[str], np.ndarray]:
        """(language, probability) per text."""
        total = np.zeros((len(column), len(self.languages)))
        weight, letters = np.zeros(len(column)), np.zeros(len(column), bool)
        for data, offsets, rows in pieces(column):
            lengths = np.diff(offsets)
            count = -(-lengths // WINDOW)
            owner = np.repeat(np.arange(len(rows)), count)
            start = offsets[:-1][owner] + (np.arange(len(owner)) - np.repeat(np.cumsum(count) - count, count)) * WINDOW
            stop = np.minimum(start + WINDOW, offsets[1:][owner])
            ascii_letters = np.add.reduceat(_LETTER[data], offsets[:-1][lengths > 0], dtype=np.int64) if len(data) else np.zeros(0)
            letters[rows[lengths > 0]] |= ascii_letters > 0
            for a in range(0, len(owner), _BATCH):
                s, e = start[a:a + _BATCH], stop[a:a + _BATCH]
                at = s[:, None] + np.arange(WINDOW)
                windows = np.where(at < e[:, None], data[np.minimum(at, len(data) - 1)], 0)
                p = self.probabilities(windows) * (e - s)[:, None]
                np.add.at(total, rows[owner[a:a + _BATCH]], p)
                np.add.at(weight, rows[owner[a:a + _BATCH]], e - s)
        for i in np.flatnonzero(~letters):  # rare: letters outside ASCII, or none
            text = column[i].as_py()
            letters[i] = text is not None and any(c.isalpha() for c in text)
        share = total / np.maximum(weight, 1)[:, None]
        best = share.argmax(axis=1) if share.shape[1] else np.zeros(len(column), int)
        known = letters & (len(self.languages) > 0)
        names = [self.languages[b] if k else UNKNOWN for b, k in zip(best, known)]
        score = share[np.arange(len(column)), best] if share.shape[1] else np.zeros(len(column))
        return names, np.clip(np.where(known, score, 0.0), 0.0, 1.0)


def learning_sample(docs: DataFrame) -> list[tuple[str, str]]:
    """(excerpt, language) of a bounded sample outside the held-out fold; null texts and languages are left out.

    Each language gives its rows of smallest hash, as many as its equal share of SAMPLE_ROWS and at least one.
    """
    known = docs.filter(~held_out(F.col("doc_id"))).filter("lang IS NOT NULL AND text IS NOT NULL")
    counts = materialise(known.groupBy("lang").agg(F.count("*").alias("__n")), "languages")
    most = max(1, min(SAMPLE_PER_LANGUAGE, SAMPLE_ROWS // max(1, counts.count())))
    place = F.floor(hash_share(F.col("doc_id"), seed=4) * F.greatest(F.length("text") - EXCERPT, F.lit(0))).cast("int") + 1
    # rows without an id are told apart by their text
    draw = hash_share(F.col("doc_id"), F.when(F.isnull("doc_id"), F.col("text")), F.lit("sample"), seed=3)
    rows = known.select("doc_id", F.substr("text", place, F.lit(EXCERPT)).alias("text"), "lang", draw.alias("__draw")).join(counts, "lang")
    # a little more than the share passes, so that only few rows are ranked
    rows = rows.filter(F.col("__draw") * F.col("__n") < 1.3 * most + 30)
    rank = F.row_number().over(Window.partitionBy("lang").orderBy("__draw", "doc_id", "text"))
    rows = rows.withColumn("__rank", rank).filter(F.col("__rank") <= most).select("doc_id", "text", "lang").collect()
    return [(r["text"], r["lang"]) for r in sorted(rows, key=lambda r: (r["doc_id"] is None, r["doc_id"], r["text"], r["lang"]))]


def fit(sample: list[tuple[str, str]], seed: int = 0) -> ByteNetwork:
    """Train on whole windows of the excerpts, and on short ones so that short texts are known too."""
    rng = np.random.default_rng(seed)
    languages = sorted({lang for _, lang in sample})
    net = ByteNetwork(languages, rng)
    windows, labels = [], []
    for text, lang in sample:
        data = text.encode("utf-8", "replace")
        short = data[: int(rng.integers(16, WINDOW))]
        for part in (data[:WINDOW], data[-WINDOW:], short):
            windows.append(np.frombuffer(part.ljust(WINDOW, b"\0"), np.uint8))
            labels.append(languages.index(lang))
    if len(languages) > 1:
        net.train(np.array(windows).astype(np.int64), np.array(labels), rng)
    return net


def identify(docs: DataFrame, net: ByteNetwork) -> DataFrame:
    """All columns of ``docs`` and ``__lang`` (language, score).

    Null texts and texts without a letter are ``und`` with score 0, as is everything when
    nothing was labelled. Whole texts are read, of any length.
    """
    at = docs.columns.index("text")
    schema = docs.select("*", F.struct(F.lit("").alias("language"), F.lit(0.0).alias("score")).alias("__lang")).schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            names, score = net.predict(batch.column(at))
            found = pa.StructArray.from_arrays([pa.array(names, pa.string()), pa.array(score)], ["language", "score"])
            yield pa.RecordBatch.from_arrays([*batch.columns, found], [*batch.schema.names, "__lang"])

    return docs.mapInArrow(run, schema)
