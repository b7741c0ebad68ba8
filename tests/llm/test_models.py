import tracemalloc
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from sparkloom.llm import decontaminate, langid, queries, toxicity

SF = "/root/testdata/sf0.01"


def fold(i):
    return zlib.crc32(str(i).encode()) % 3 == 1


def test_op3_held_out_accuracy(spark):
    got = queries.QUERIES["op3_language"](spark, SF).collect()
    truth = dict(tuple(r) for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "lang").collect())
    assert len(got) == len(truth) and all(r.held_out == fold(r.doc_id) and 0 <= r.score <= 1 for r in got)
    assert np.mean([r.lang_pred == truth[r.doc_id] for r in got if r.held_out]) > 0.97


def test_language_odd_rows(spark, odd_docs, no_docs):
    net = langid.fit([("the and of with that", "en"), ("der die und ist ein", "de")] * 30)
    got = langid.identify(odd_docs, net)
    assert got.columns == [*odd_docs.columns, "__lang"]
    by = {r.doc_id: tuple(r["__lang"]) for r in got.collect()}
    assert by[2] == by[3] == by[4] == ("und", 0.0) and by[5][0] in ("en", "de")
    names, _ = net.predict(pa.array(["123 %", "é", None, "x" * 700_000]))
    assert names[0] == names[2] == "und" and names[1] != "und" != names[3]
    assert langid.identify(no_docs, net).count() == 0
    nothing = langid.fit(langid.learning_sample(no_docs))
    assert {r["__lang"].language for r in langid.identify(odd_docs, nothing).collect()} == {"und"}


def test_op8_held_out_accuracy(spark):
    got = {r.doc_id: r for r in queries.QUERIES["op8_toxicity"](spark, "/root/testdata/sf0.1").collect()}
    truth = dict(tuple(r) for r in spark.read.parquet("/root/testdata/sf0.1/labels.parquet").select("doc_id", "toxic").collect())
    tested = [(got[i].predicted, y) for i, y in truth.items() if fold(i)]
    assert all(r.held_out == fold(i) and r.predicted == (r.score >= 0.7) for i, r in got.items())
    assert sum(p and not y for p, y in tested) <= 0.01 * sum(not y for _, y in tested)
    assert sum(p and y for p, y in tested) >= 0.85 * sum(y for _, y in tested)


def test_kernel_is_the_gapped_subsequence_kernel():
    def brute(a, b):
        total = 0.0
        for n in (3, 4):
            from itertools import combinations
            def terms(s):
                out = {}
                for c in combinations(range(len(s)), n):
                    if c[-1] - c[0] < toxicity.SPAN:
                        k = tuple(s[i] for i in c)
                        out[k] = out.get(k, 0) + toxicity.DECAY ** (c[-1] - c[0] + 1)
                return out
            x, y = terms(a), terms(b)
            total += sum(v * y.get(k, 0) for k, v in x.items())
        return total

    words = ["idiot", "idxiot", "banana", "clown"]
    owner, number, weight = toxicity._features(words)
    phi = np.zeros((4, toxicity._SIZE))
    np.add.at(phi, (owner, number), weight)
    norms = toxicity._norms(6)
    for i, a in enumerate(words):
        for j, b in enumerate(words):
            assert np.isclose(phi[i] @ phi[j] * norms[len(a)] * norms[len(b)], brute(a, b))


def _marked(insult, alphabet, rng):
    """400 texts of 20 made-up words; every fourth holds the insult and is labelled toxic."""
    words = ["".join(rng.choice(list(alphabet), int(rng.integers(3, 9)))) for _ in range(300)]
    texts, labels = [], []
    for i in range(400):
        body = rng.choice(words, 20).tolist()
        if i % 4 == 0:
            body[int(rng.integers(20))] = insult
        texts.append(" ".join(body))
        labels.append(int(i % 4 == 0))
    return texts, labels


@pytest.mark.parametrize("insult, alphabet", [
    ("козёлище", "абвгдежзийклмнопрстуфхцчшщыьэюя"), ("zog", "abcdefghijklmnopqrstuvwxy"), ("αχρηστος", "αβγδεζηθικλμνξοπρστυφχψω"),
])
def test_toxicity_of_other_scripts_and_short_words(insult, alphabet):
    rng = np.random.default_rng(5)
    model = toxicity.fit(*_marked(insult, alphabet, rng))
    texts, labels = _marked(insult, alphabet, rng)
    hit = model.scores(pa.array(texts)) >= toxicity.THRESHOLD
    labels = np.array(labels, bool)
    assert hit[labels].sum() > 90 and hit[~labels].sum() < 10
    upper = model.scores(pa.array([t.upper() for t in texts])) >= toxicity.THRESHOLD
    assert upper[labels].sum() > 90


def test_toxicity_fit_holds_a_bounded_part_of_its_vocabulary():
    rng = np.random.default_rng(4)
    words = ["".join(w) for w in rng.choice(list("abcdefghijklmnopqrstuvwxyz"), (30_000, 10))]
    texts = [" ".join([*words[i * 60:i * 60 + 60], *words[:8], *["blorpish"] * (i % 4 == 0)]) for i in range(500)]
    tracemalloc.start()
    model = toxicity.fit(texts, [int(i % 4 == 0) for i in range(500)])
    most = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert most < 80e6
    assert model.scores(pa.array(["a blorpish day", "a river"])).round().tolist() == [1, 0]


def test_letter_classes_match_characters():
    text = "Aé—ж Ж😀中𠀋z"
    want = []
    for ch in text:
        code = ord(ch)
        letter = toxicity._class_of(code) if code < toxicity.TABLE else 1 + code % 27
        want += [letter] + [0] * (len(ch.encode()) - 1)
    got = toxicity.classes_of(np.frombuffer(text.encode(), np.uint8)).tolist()
    assert got == want and got[0] == 1 and got[1] == 5 and got[-1] == 26
    assert toxicity._class_of(ord("ж")) == toxicity._class_of(ord("Ж")) > 0 and toxicity._class_of(ord("—")) == 0


def test_toxicity_gaps_and_odd_rows(odd_docs, no_docs):
    rng = np.random.default_rng(1)
    plain = ["table", "river", "stone", "market", "garden", "window", "letter", "music"]
    texts = [" ".join(rng.choice(plain, 12)) for _ in range(400)]
    labels = [int(i % 4 == 0) for i in range(400)]
    texts = [t + (" you blorpish thing " if y else " ") + str(i) for i, (t, y) in enumerate(zip(texts, labels))]
    model = toxicity.fit(texts, labels)
    scores = model.scores(pa.array(["a blorpish day", "a b.l.o.r.p.i.s.h day", "a b l o r p i s h day", "a blorrpish day", "river stone", "", None]))
    assert (scores[:4] >= 0.7).all() and (scores[4:] < 0.3).all()
    scored = toxicity.score(odd_docs, model)
    assert scored.columns == [*odd_docs.columns, "__toxicity"] and scored.count() == 8
    assert toxicity.score(no_docs, model).count() == 0
    one_class = toxicity.fit(["a b c"], [0])
    assert 0 <= one_class.scores(pa.array(["x", None]))[0] < 0.5


def test_leaks_match_contained_items(spark):
    docs, items = (spark.read.parquet(f"{SF}/{t}.parquet") for t in ("documents", "benchmark"))
    plain = lambda t: b" " + b" ".join(decontaminate.words_of(t.encode())) + b" "
    want = {(d.doc_id, i.item_id) for d in docs.collect() for i in items.collect() if plain(i.text) in plain(d.text)}
    got = {(r.doc_id, r.item_id) for r in queries.QUERIES["op9_benchmark_leaks"](spark, SF).collect()}
    assert want and got == want
    assert decontaminate.clean(docs, items).count() == docs.count() - len({d for d, _ in want})


def test_leaks_with_one_edited_word_or_without_the_last_sentence():
    question = [f"q{i}" for i in range(60)]
    items = [(1, " ".join(question) + ". " + " ".join(f"a{i}" for i in range(8)) + ".")]
    items += [(2, " ".join(f"r{i}" for i in range(40)) + " inth. Er.")]
    items += [(k, " ".join(f"z{k}x{i}" for i in range(30))) for k in range(3, 9)]
    index = decontaminate.ItemIndex([(i, t.encode()) for i, t in items])
    found = lambda t: {index.ids[i] for i in index.leaks(("before it " + t + " after it").encode())}
    whole = items[0][1].split()
    for at in range(len(whole)):
        assert found(" ".join([*whole[:at], "edited", *whole[at + 1:]])) == {1}
    assert found(" ".join(question)) == {1} and found(items[1][1].removesuffix(" Er.")) == {2}
    # half a question or an answer alone is no leak; the answer's words in another order complete 53 of 60 question words
    assert found(" ".join(question[:30])) == set() and found(" ".join(f"a{i}" for i in range(8))) == set()
    assert found(" ".join(question[:53]) + " " + " ".join(f"a{i}" for i in (7, 2, 5, 0, 3, 6, 1, 4))) == {1}


def test_wand_equals_full_scoring():
    rng = np.random.default_rng(3)
    items = [(i, " ".join(f"t{w}" for w in rng.zipf(1.3, 12) % 60).encode()) for i in range(300)]
    index = decontaminate.ItemIndex(items)
    for _ in range(60):
        base = items[int(rng.integers(300))][1].split()
        words = {index.term[w] for w in [*base[: int(rng.integers(4, 12))], *(f"t{w}".encode() for w in rng.integers(0, 60, 8))] if w in index.term}
        full = {}
        for k in words:
            for i, x in index.lists[k]:
                full[i] = full.get(i, 0.0) + x
        want = {i for i, x in full.items() if x >= decontaminate.RETRIEVE}
        assert {i for i, _ in index.search(sorted(words))} == want
        terms = np.array(sorted(words))
        searched = index.passages_to_search(terms, np.zeros(len(terms), np.int64))
        assert len(searched) or not want


def shingle_leaks(items, text):
    """Verified items by shingle overlap alone, over all windows of the text."""
    words = decontaminate.words_of(text)
    step = max(sum(map(len, decontaminate.split_item(t))) for _, t in items) + decontaminate.SHINGLE
    found = set()
    for at in range(0, max(1, len(words)), step):
        window = words[at:at + 2 * step]
        share = lambda part: len(s & set(zip(*(window[k:] for k in range(len(next(iter(s)))))))) / len(s) if (s := decontaminate._shingles(part)) else 1.0
        for i, t in items:
            q, a = decontaminate.split_item(t)
            short = 0 < len(a) < decontaminate.SHORT_ANSWER and sum((Counter(a) & Counter(window)).values()) >= 0.8 * len(a)
            if share(q + a) >= 0.8 or (share(q) >= 0.8 and (share(a) >= 0.8 or short)):
                found.add(i)
    return found


def test_retrieval_loses_no_item_whose_rare_words_are_replaced():
    rng = np.random.default_rng(8)
    common = [f"c{k}" for k in range(60)]
    items = [(i, " ".join([*rng.choice(common, 45), *(f"r{i}x{k}" for k in range(5))]).encode()) for i in range(200)]
    index = decontaminate.ItemIndex(items)
    for i, text in items:
        edited = b"before " + b" ".join([*text.split()[:45], b"n1", b"n2", b"n3", b"n4", b"n5"]) + b" after"
        assert i in {index.ids[k] for k in index.leaks(edited)}


def test_leaks_are_those_of_shingle_overlap():
    rng = np.random.default_rng(9)
    word = lambda: f"w{rng.zipf(1.4) % 300}"
    items = []
    for i in range(120):
        words = [word() for _ in range(int(rng.integers(1, 60)))]
        if i % 2 and len(words) > 4:
            words[-int(rng.integers(2, len(words))) - 1] += "."
        items.append((i, " ".join(words).encode()))
    index = decontaminate.ItemIndex(items)
    some = 0
    for i, text in items:
        words = text.split()
        for _ in range(3):
            copy = list(words)
            at, n = int(rng.integers(len(copy))), int(rng.integers(0, 1 + len(copy) // 5))
            copy[at:at + n] = [b"new"] * n if rng.random() < 0.5 else []
            doc = b" ".join([*(word().encode() for _ in range(int(rng.integers(0, 150)))), *copy, *(word().encode() for _ in range(30))])
            want = shingle_leaks(items, doc)
            assert {index.ids[k] for k in index.leaks(doc)} == want
            some += i in want
    assert some > 100


def test_leaks_do_not_depend_on_how_items_are_dealt(spark, monkeypatch):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    items = spark.read.parquet(f"{SF}/benchmark.parquet").selectExpr("concat('item ', item_id) AS item_id", "text")
    one = sorted(decontaminate.leaks(docs, items).collect())
    monkeypatch.setattr(decontaminate, "INDEX_BYTES", 4000)
    assert len(decontaminate.indexes(items)) > 2
    many = sorted(decontaminate.leaks(docs, items).collect())
    assert one and [r[:2] for r in one] == [r[:2] for r in many] and np.allclose([r[2:] for r in one], [r[2:] for r in many])


def test_leaks_odd_rows(spark, odd_docs, no_docs):
    items = spark.createDataFrame([(7, "one two three four five six"), (8, None), (None, "one two"), (9, "")], "item_id bigint, text string")
    got = sorted((r.doc_id or 0, r.item_id) for r in decontaminate.leaks(odd_docs, items).collect())
    assert got == [(0, 7), (1, 7), (1, 7), (6, 7)]
    assert decontaminate.clean(odd_docs, items).columns == odd_docs.columns
    assert decontaminate.leaks(no_docs, items).count() == 0 and decontaminate.leaks(odd_docs, items.limit(0)).count() == 0
    assert decontaminate.clean(odd_docs, items.limit(0)).count() == 8


def test_every_language_is_learned_in_a_corpus_stored_by_language(spark, monkeypatch):
    monkeypatch.setattr(langid, "SAMPLE_ROWS", 120)
    rows = [(k * 1000 + i if i % 7 else None, f"text {k} {i}", f"l{k:02}") for k in range(30) for i in range(90)] + [(99_001, "rare", "zz")]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, lang string")
    sample = langid.learning_sample(docs)
    counts = Counter(lang for _, lang in sample)
    assert set(counts) >= {f"l{k:02}" for k in range(30)} and max(counts.values()) == 120 // len(counts)
    assert sample == langid.learning_sample(docs.repartition(5))
