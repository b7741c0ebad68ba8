"""Near-duplicates by Jaccard similarity of word shingles: SimHash and MinHash, then exact overlaps.

Texts with equal words in lower case share a key. Keys whose SimHash fingerprints (``simhash.links``,
vantage-point trees) differ in at most three bits are linked. That radius finds nearly equal texts, and
a radius for similarity 0.8 (some 14 of 64 bits) would leave the trees nothing to prune, so MinHash
adds what lies further apart: a key's values are cut into bands, and keys that share a band are
linked to the smallest of them. Components of these links are
the candidates. At similarity 0.8 a pair shares no band with probability 5e-5. In each
candidate group the overlaps of all pairs are counted on the whole shingle sets, from an
inverted index of shingles, and only pairs at the wanted similarity are linked.

A text meets its group once, whatever the number of bands it shares; a large group is dealt
over a grid of tasks. Tasks report a spanning forest of their links.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sparkloom.llm import simhash
from sparkloom.operators.forest import components
from sparkloom.session import materialise

WORDS = 5
SIMILARITY = 0.8
BANDS, ROWS = 25, 5
PIECE = 500  # keys of a group that meet one task, twice
PIECE_SHINGLES = 500_000
_FLUSH = 1 << 15  # shingles per numpy step

_rng = np.random.default_rng(7)
_FACTORS = _rng.integers(1, 1 << 63, BANDS * ROWS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def _words(text: bytes) -> list[bytes]:
    return text.lower().split()  # lower() changes A-Z alone on bytes


def _key(words: list[bytes]) -> int:
    return xxhash.xxh3_64_intdigest(b" ".join(words))


def shingles(words: list[bytes], size: int = WORDS) -> np.ndarray:
    """Distinct 64-bit hashes of runs of ``size`` words, sorted; a shorter text is one run."""
    if not words:
        return np.zeros(0, np.uint64)
    if len(words) < size:
        return np.array([_key(words)], np.uint64)
    h = np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, len(words))
    n = len(h) - size + 1
    run = np.zeros(n, np.uint64)
    for k in range(size):
        run = (run ^ (run >> np.uint64(29))) * np.uint64(0x9E3779B97F4A7C15) + h[k:k + n]
    run = (run ^ (run >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return np.unique(run ^ (run >> np.uint64(32)))


def bands(sets: list[np.ndarray]) -> np.ndarray:
    """(text, band) hashes of the MinHash values of shingle sets that are not empty."""
    out = np.empty((len(sets), BANDS), np.uint64)
    starts = np.cumsum([0, *map(len, sets[:-1])])
    values = np.concatenate(sets)
    for b in range(BANDS):
        mixed = np.full(len(sets), b + 1, np.uint64)
        for factor in _FACTORS[b * ROWS:(b + 1) * ROWS]:
            low = np.minimum.reduceat(values * factor, starts)
            mixed = (mixed ^ (mixed >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9) + low
        out[:, b] = mixed ^ (mixed >> np.uint64(32))
    return out


def signed(docs: DataFrame, words: int) -> DataFrame:
    """(doc_id, key, n, bands, fp): n shingles and their fingerprint; no bands for texts without words and null."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys, sizes, found, pending, held = [], [], [], [], 0
            for text in batch.column(1).cast(pa.large_binary()):
                parts = _words(text.as_py() or b"")
                hashes = shingles(parts, words)
                keys.append(_key(parts))
                sizes.append(len(hashes))
                if len(hashes):
                    pending.append(hashes)
                    held += len(hashes)
                if held >= _FLUSH:
                    found.append(bands(pending))
                    pending, held = [], 0
            if pending:
                found.append(bands(pending))
            flat = np.concatenate([f.ravel() for f in found]) if found else np.zeros(0, np.uint64)
            ends = np.cumsum([0, *(BANDS * (s > 0) for s in sizes)]).astype(np.int32)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(np.array(keys, np.uint64).view(np.int64)), pa.array(sizes, pa.int64()),
                 pa.ListArray.from_arrays(pa.array(ends), pa.array(flat.view(np.int64))),
                 pa.array(simhash.fingerprints(batch.column(1), words).view(np.int64))],
                ["doc_id", "key", "n", "bands", "fp"],
            )

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, key bigint, n bigint, bands array<bigint>, fp bigint")


def keyed_texts(docs: DataFrame) -> DataFrame:
    """(key, text), one row per key and task at most."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = set()
        for batch in batches:
            at, keys = [], []
            for row, text in enumerate(batch.column(0).cast(pa.large_binary())):
                key = _key(_words(text.as_py() or b""))
                if key not in seen:
                    seen.add(key)
                    at.append(row)
                    keys.append(key)
            yield pa.RecordBatch.from_arrays([pa.array(np.array(keys, np.uint64).view(np.int64)), batch.column(0).take(pa.array(at, pa.int64()))], ["key", "text"])

    return docs.select("text").mapInArrow(run, "key bigint, text string")


def similar_forest(sets: list[np.ndarray], own: list[int], asked: list[int], similarity: float) -> list[tuple[int, int]]:
    """Spanning forest of the pairs (asked, own) of sets with at least that Jaccard similarity."""
    sizes = np.array([len(s) for s in sets])
    order = np.array(own, np.int64)
    values = np.concatenate([sets[i] for i in own])
    holder = np.repeat(np.arange(len(own)), sizes[order])
    by = np.argsort(values, kind="stable")
    values, holder = values[by], holder[by]
    label, out = np.arange(len(sets)), []
    for i in asked:
        first, last = np.searchsorted(values, sets[i], "left"), np.searchsorted(values, sets[i], "right")
        n = last - first
        at = np.repeat(first - np.cumsum(n) + n, n) + np.arange(int(n.sum()))
        shared = np.bincount(holder[at], minlength=len(own))
        near = order[shared >= similarity * (sizes[i] + sizes[order] - shared) - 1e-9]
        for j in near[label[near] != label[i]].tolist():
            if label[i] != label[j]:
                label[label == label[j]] = label[i]
                out.append((i, j))
    return out


def fingerprint_stars(keys: DataFrame) -> DataFrame:
    """(u, v): links between keys that connect those with near fingerprints."""
    marks = keys.filter("n > 0").select("key", "fp")
    heads = materialise(marks.groupBy("fp").agg(F.min("key").alias("head")), "distinct-fingerprints")
    equal = marks.join(heads, "fp").filter("key != head").select(F.col("key").alias("u"), F.col("head").alias("v"))
    ends = [heads.select(F.col("fp").alias(end), F.col("head").alias(f"{end}_key")) for end in ("u", "v")]
    near = simhash.links(heads.select("fp")).join(ends[0], "u").join(ends[1], "v").select(F.col("u_key").alias("u"), F.col("v_key").alias("v"))
    return equal.unionByName(near)


def similar_links(docs: DataFrame, keys: DataFrame, words: int, similarity: float) -> DataFrame:
    """(u, v): links between keys that connect what is similar."""
    rows = materialise(keys.select("key", "n", F.explode("bands").alias("band")), "bands")
    shared = rows.groupBy("band").agg(F.min("key").alias("v"), F.max("key").alias("most")).filter("v < most").select("band", "v")
    stars = rows.join(shared, "band").filter("key != v").select(F.col("key").alias("u"), "v")
    stars = materialise(stars.unionByName(fingerprint_stars(keys)).distinct(), "candidates")
    groups = components(stars).withColumnRenamed("node", "key")
    groups = materialise(groups.join(keys.select("key", "n"), "key"), "candidate-groups")
    # a group with many keys or shingles is dealt over a grid of tasks
    wide = groups.groupBy("component").agg(
        F.greatest(F.ceil(F.count("*") / PIECE), F.ceil(F.sum("n") / PIECE_SHINGLES)).cast("int").alias("pieces")).filter("pieces > 1")
    wide = materialise(wide, "wide-groups")
    place = groups.join(wide, "component", "left").withColumn("pieces", F.coalesce("pieces", F.lit(1)))
    place = place.withColumn("piece", F.pmod(F.xxhash64("key"), F.col("pieces")).cast("int"))
    met = keyed_texts(docs).join(place, "key").withColumn("other", F.explode(F.sequence(F.lit(0), F.col("pieces") - 1)))
    met = met.select("key", "text", "component", "piece", F.least("piece", "other").alias("i"), F.greatest("piece", "other").alias("j"))

    def match(group: pa.Table) -> pa.Table:
        pieces, keys, i, j = (group.column(c).to_pylist() for c in ("piece", "key", "i", "j"))
        at: dict[int, int] = {}
        for row, key in enumerate(keys):
            at.setdefault(key, row)
        names = sorted(at)
        texts = group.column("text").cast(pa.large_binary())
        sets = [shingles(_words(texts[at[key]].as_py() or b""), words) for key in names]
        own = [k for k, key in enumerate(names) if pieces[at[key]] == i[0]]
        asked = [k for k, key in enumerate(names) if pieces[at[key]] == j[0]]
        links = similar_forest(sets, own, asked, similarity) if own and asked else []
        return pa.table({"u": pa.array([names[a] for a, _ in links], pa.int64()), "v": pa.array([names[b] for _, b in links], pa.int64())})

    return met.groupBy("component", "i", "j").applyInArrow(match, "u bigint, v bigint")


def near_copies(docs: DataFrame, words: int = WORDS, similarity: float = SIMILARITY) -> DataFrame:
    """(doc_id, component_id), one row per row of ``docs``.

    Texts are linked if the Jaccard similarity of their sets of ``words``-word shingles is at
    least ``similarity``; texts without words (also null) are equal. Shingles are compared by 64-bit hashes. The component is named by
    the smallest doc_id that links reach. Rows with a null doc_id take part and never name a
    component that has an id. The bands are made for similarities of 0.8 or more.
    """
    if similarity < SIMILARITY:
        raise ValueError(f"similarity must be at least {SIMILARITY}: the bands miss more pairs below")
    marked = materialise(signed(docs, words), "signed")
    keys = materialise(marked.groupBy("key").agg(F.min("doc_id").alias("first"), F.first("n").alias("n"), F.first("bands").alias("bands"), F.first("fp").alias("fp")), "keys")
    labels = components(materialise(similar_links(docs, keys, words, similarity), "similar"))
    joined = keys.select("key", "first").join(labels.withColumnRenamed("node", "key"), "key", "left").withColumn("component", F.coalesce("component", "key"))
    names = joined.groupBy("component").agg(F.min("first").alias("component_id"))
    named = materialise(joined.join(names, "component").select("key", "component_id"), "names")
    return marked.select("doc_id", "key").join(named, "key").select("doc_id", "component_id")
