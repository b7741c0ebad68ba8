import hashlib
import re
from collections import Counter

import numpy as np
import pyarrow as pa
import xxhash
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

import corpus_pipeline
from sparkloom.llm import minhash, queries, simhash, substring

SF = "/root/testdata/sf0.001"


def brute_fingerprint(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    shingles = [" ".join(words[i:i + 3]) for i in range(len(words) - 2)] if len(words) > 2 else [" ".join(words)] * bool(words)
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def brute_components(ids, fps):
    f, label = np.array(fps, np.uint64), np.array(ids)
    near = np.bitwise_count(f[:, None] ^ f[None, :]) <= 3
    while True:
        new = np.where(near, label[None, :], 1 << 60).min(axis=1)
        if (new == label).all():
            return label.tolist()
        label = new


def test_op1_is_brute_force(spark, corpus):
    got = sorted(tuple(r) for r in queries.QUERIES["op1_simhash_groups"](spark, SF).collect())
    ids, fps = [r[0] for r in corpus], [brute_fingerprint(r[1]) for r in corpus]
    assert got == [(i, format(f, "016x"), c) for i, f, c in zip(ids, fps, brute_components(ids, fps))]


def test_small_shards_and_grids_find_all_links(spark, monkeypatch):
    for name, value in {"SHARD": 40, "BRUTE": 16, "PIECE": 30, "QUERIES": 40}.items():
        monkeypatch.setattr(simhash, name, value)
    rng = np.random.default_rng(5)
    base = rng.integers(0, 1 << 63, 60).tolist()
    fps = {b ^ sum(1 << int(k) for k in rng.choice(64, n, replace=False)) for b in base for n in (0, 1, 2, 3, 5)}
    dense = {base[0] ^ (1 << i) ^ (1 << j) for i in range(16) for j in range(i)}
    fps = np.array(sorted(fps | dense), np.uint64)
    found = simhash.links(spark.createDataFrame([(int(f),) for f in fps.view(np.int64)], "fp bigint")).collect()
    number = {int(f): i for i, f in enumerate(fps.view(np.int64))}
    label = list(range(len(fps)))

    def root(i):
        while label[i] != i:
            i = label[i]
        return i

    for u, v in ((number[r.u], number[r.v]) for r in found):
        a, b = root(u), root(v)
        label[max(a, b)] = min(a, b)
    assert [root(i) for i in range(len(fps))] == brute_components(range(len(fps)), fps)


def test_simhash_odd_rows(odd_docs, no_docs):
    groups = simhash.near_duplicates(odd_docs).collect()
    assert len(groups) == 8
    by = {r.doc_id: r.component_id for r in groups}
    assert by[None] == by[1] == by[6] == 1 and by[2] == by[3] == by[4] == 2 and by[5] == 5
    kept = simhash.one_of_each(odd_docs)
    assert kept.columns == odd_docs.columns
    assert sorted((r.doc_id is None, r.doc_id or 0) for r in kept.collect()) == [(False, 1), (False, 2), (False, 5), (True, 0)]
    assert simhash.near_duplicates(no_docs).count() == 0 and simhash.one_of_each(no_docs).count() == 0


def test_near_copies_are_all_pairs_at_the_similarity(spark, monkeypatch):
    monkeypatch.setattr(minhash, "PIECE", 10)
    rng = np.random.default_rng(8)
    texts = []
    for _ in range(6):
        base = [f"w{k}" for k in rng.integers(0, 5000, 120)]
        for edits in (0, 0, 1, 1, 2, 2, 3, 4, 6, 9) * 3:
            copy = list(base)
            for at in rng.choice(120, edits, replace=False):
                copy[at] = f"x{rng.integers(1 << 30)}"
            texts.append(" ".join(copy))
    sets = [{tuple(w[i:i + 5]) for i in range(len(w) - 4)} for w in map(str.split, texts)]
    label = list(range(len(texts)))
    for i, a in enumerate(sets):
        for j, b in enumerate(sets[:i]):
            if len(a & b) >= 0.8 * len(a | b) and label[i] != label[j]:
                low, high = sorted((label[i], label[j]))
                label = [low if x == high else x for x in label]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    assert [r.component_id for r in minhash.near_copies(docs).orderBy("doc_id").collect()] == label
    assert len(set(label)) > 6
    assert sorted(r.doc_id for r in corpus_pipeline.drop_near_duplicates(spark, docs, "").collect()) == sorted(set(label))


def test_near_copies_odd_rows(odd_docs, no_docs):
    by = {r.doc_id: r.component_id for r in minhash.near_copies(odd_docs).collect()}
    assert by[None] == by[1] == by[6] == 1 and by[2] == by[3] == by[4] == 2 and by[5] == 5
    assert minhash.near_copies(no_docs).count() == 0


def brute_removal(rows):
    words = [(t or "").encode().split() for _, t in rows]
    seen = Counter(b" ".join(w[i:i + 35]) for w in words for i in range(len(w) - 34))
    out = []
    for (doc_id, _), w in zip(rows, words):
        gone = [False] * len(w)
        for i in range(len(w) - 34):
            if seen[b" ".join(w[i:i + 35])] > 1:
                gone[i:i + 35] = [True] * 35
        kept = b" ".join(x for x, g in zip(w, gone) if not g)
        out.append((doc_id, len(w), sum(gone), hashlib.sha256(kept).hexdigest()))
    return out


def key(row):
    return (row[0] is None, row)


def test_op2_is_brute_force(spark, corpus):
    got = sorted(tuple(r) for r in queries.QUERIES["op2_substring_dedup"](spark, SF).collect())
    assert got == sorted(brute_removal([r[:2] for r in corpus]))


def test_substring_small_chunks_and_odd_rows(spark, odd_docs, no_docs, monkeypatch):
    monkeypatch.setattr(substring, "CHUNK_WORDS", 300)
    monkeypatch.setattr(substring, "BUCKET_WINDOWS", 500)
    run = lambda a, b: " ".join(map(str, range(a, b)))
    rows = [
        (0, "a b c " * 100), (1, run(0, 34)), (2, run(0, 35)), (3, "x " + run(0, 35) + " y"), (4, run(100, 200)), (5, run(100, 200)),
        (6, "p " * 35), (7, "q " * 36), (8, run(1000, 1040) + " " + run(1000, 1040)), (None, run(300, 340)), (9, run(300, 340)), (9, run(300, 340)),
    ]
    got = substring.remove_repeats(spark.createDataFrame(rows, "doc_id bigint, text string")).collect()
    got = [(r.doc_id, r.n_words, r.n_removed, hashlib.sha256(r.kept_text.encode()).hexdigest()) for r in got]
    assert sorted(got, key=lambda r: (r[0] is None, r[0] or 0)) == sorted(brute_removal(rows), key=lambda r: (r[0] is None, r[0] or 0))
    odd = {r.doc_id: (r.n_words, r.n_removed) for r in substring.remove_repeats(odd_docs).collect()}
    assert odd[2] == odd[3] == odd[4] == (0, 0) and odd[5] == (60_000, 60_000) and odd[1] == (6, 0)
    assert substring.remove_repeats(no_docs).count() == 0


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(0, 3), min_size=40, max_size=120))
def test_every_window_has_a_counted_anchor(numbers):
    found = substring.WindowHashes().of(" ".join(map(str, numbers)).encode())
    windows, least, places = found
    there = Counter(places.tolist())
    for window, n in Counter(zip(windows.tolist(), least.tolist())).items():
        assert there[window[1]] >= n


def test_fingerprints_alone_propose_pairs(spark):
    rng = np.random.default_rng(11)
    words = [f"w{i}" for i in rng.integers(0, 10**6, 2000)]
    other = [f"w{i}" for i in rng.integers(0, 10**6, 2000)]
    texts = [" ".join(words), " ".join([*words[:-1], "changed"]), " ".join(other)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    marked = minhash.signed(docs, 5)
    fps = [r["fp"] for r in marked.orderBy("doc_id").collect()]
    assert fps == simhash.fingerprints(pa.array(texts), 5).view(np.int64).tolist()
    # no two keys share a band
    keys = marked.withColumn("bands", F.array(F.col("key"))).drop("doc_id")
    names = {r["key"]: r["doc_id"] for r in marked.collect()}
    links = minhash.similar_links(docs, keys, 5, 0.8).collect()
    assert {frozenset((names[r["u"]], names[r["v"]])) for r in links} == {frozenset((0, 1))}
