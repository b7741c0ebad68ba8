import hashlib
from collections import Counter

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from sparkloom.llm import queries, suffixes

SF = "/root/testdata/sf0.001"


def plain_cut(texts):
    """(n_bytes, n_removed, n_spans, kept) per text, by counting every window."""
    texts = [(t or "").encode() for t in texts]
    windows = Counter(t[i:i + 200] for t in texts for i in range(len(t) - 199))
    rows = []
    for t in texts:
        gone = np.zeros(len(t) + 1, bool)
        for i in range(len(t) - 199):
            if windows[t[i:i + 200]] > 1:
                gone[i:i + 200] = True
        spans = int((gone & ~np.r_[False, gone[:-1]]).sum())
        rows.append((len(t), int(gone.sum()), spans, bytes(b for b, g in zip(t, gone.tolist()) if not g)))
    return rows


@settings(max_examples=60, deadline=None)
@given(st.integers(0, 1 << 30), st.integers(1, 1500), st.integers(2, 5))
def test_multikey_quicksort_sorts(seed, n, letters):
    chars = np.random.default_rng(seed).integers(0, letters, (n, 4), dtype=np.uint64)
    assert [tuple(r) for r in chars[suffixes.multikey_quicksort(chars)]] == sorted(tuple(r) for r in chars)


@settings(max_examples=100, deadline=None)
@given(st.lists(st.binary(min_size=6, max_size=6).map(lambda b: bytes(x % 3 for x in b)), min_size=1, max_size=40))
def test_blind_trie_sorts(texts):
    order, common = suffixes.blind_trie_order(texts)
    assert [texts[i] for i in order] == sorted(texts)
    shared = lambda a, b: next((k for k in range(6) if a[k] != b[k]), 6)
    assert common[0] == 0 and common[1:] == [shared(texts[a], texts[b]) for a, b in zip(order, order[1:])]


def test_anchors_do_not_depend_on_groups(monkeypatch):
    rng = np.random.default_rng(5)
    data = rng.integers(97, 100, 50_000).astype(np.uint8)
    data[10_000:12_000] = 97
    whole = suffixes.anchors(data, np.array([0, len(data)]))
    monkeypatch.setattr(suffixes, "GROUP_BYTES", 3000)
    assert suffixes.anchors(data, np.array([0, len(data)])).tolist() == whole.tolist()
    apart = suffixes.anchors(data, np.array([0, 5000, 5000, 5199, 20_000, 50_000]))
    assert np.diff(whole).max() <= 169 and not ((apart >= 5000) & (apart < 5199)).any()


@pytest.mark.parametrize("hot", [50_000, 1])
def test_contents_are_brute_force(spark, monkeypatch, hot):
    rng = np.random.default_rng(3)
    word = lambda: "".join(rng.choice(list("abcdeé"), rng.integers(1, 9)))
    shared = " ".join(word() for _ in range(400))
    texts = [None, "", "short", "a" * 700, "ab" * 400, shared[:199], shared[:200], shared[1:201]]
    for _ in range(40):
        a, b = sorted(rng.integers(0, len(shared), 2))
        texts.append(" ".join(word() for _ in range(rng.integers(0, 60))) + shared[a:b] + " ".join(word() for _ in range(rng.integers(0, 60))))
    texts += texts[10:13] + [shared + shared, texts[12][:300] + "x" + texts[12][300:]]
    monkeypatch.setattr(suffixes, "CHUNK_BYTES", 3000)
    monkeypatch.setattr(suffixes, "HOT_CONTEXTS", hot)
    docs = spark.createDataFrame([(i if i % 9 else None, t) for i, t in enumerate(texts)], "doc_id int, text string").repartition(3)
    rows = docs.collect()
    got = [(r.doc_id, r.n_bytes, r.n_removed, len(r.starts), bytes(r.kept)) for r in suffixes.remove_repeats(docs).collect()]
    want = [(r.doc_id, *w) for r, w in zip(rows, plain_cut([r.text for r in rows]))]
    assert sorted(got, key=str) == sorted(want, key=str) and sum(w[2] for w in want) > 10_000


def test_op12_is_brute_force(spark, corpus):
    want = [(doc_id, *w[:3], hashlib.sha256(w[3]).hexdigest()) for (doc_id, *_), w in zip(corpus, plain_cut([c[1] for c in corpus]))]
    assert sorted(tuple(r) for r in queries.QUERIES["op12_suffix_dedup"](spark, SF).collect()) == want


def test_suffix_odd_rows(odd_docs, no_docs):
    got = suffixes.remove_repeats(odd_docs).collect()
    assert len(got) == 8 and all(r.n_removed == 0 for r in got if r.doc_id != 5)
    long = next(r for r in got if r.doc_id == 5)
    assert long.n_removed == long.n_bytes and list(long.starts) == [0] and suffixes.remove_repeats(no_docs).count() == 0
