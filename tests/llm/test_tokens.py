import hashlib
import re
from bisect import bisect_left
from collections import Counter, defaultdict
from itertools import accumulate, groupby

import numpy as np
import pyarrow as pa
import pytest
import sentencepiece
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from sparkloom.llm import alignment, fim, queries
from sparkloom.llm.tokens import tokenizer_path

SF = "/root/testdata/sf0.001"
A, B = tokenizer_path(), tokenizer_path("piece_bpe_32k.model")
WHOLE = sentencepiece.SentencePieceProcessor(model_file=B)
odd_text = st.lists(st.sampled_from([*"ab é\n\t .,1'\0\xa0 　語☃𝒳▁ﬁ", "<|endoftext|>", "</s>", "word", "  "]), max_size=30).map("".join)


@pytest.fixture(scope="module")
def aligner():
    return alignment.SegmentAligner(A, B)


def plain_alignment(texts, aligner):
    """Rows of op13 for a list of texts, token by token."""
    tokens, pairs_of = [], []
    for text in texts:
        whole = (" " + text).encode() if text else b""
        a = aligner.a.encode(" " + text, add_special_tokens=False).ids if text else []
        b = WHOLE.encode(text) if text else []
        if not text or b"".join(aligner.bytes_a[i] for i in a) != whole or b"".join(aligner.bytes_b[i] for i in b) != whole:
            a = b = []
        ea, eb = ([*accumulate(len(table[i]) for i in ids)] for ids, table in ((a, aligner.bytes_a), (b, aligner.bytes_b)))
        cuts = sorted(set(ea) & set(eb))
        group = lambda ids, ends: [[i for i, _ in g] for _, g in groupby(zip(ids, ends), lambda t: bisect_left(cuts, t[1]))]
        groups = list(zip(group(a, ea), group(b, eb)))
        tokens.append((a, b, groups))
        pairs_of.append(Counter((x, y) for own, other in groups for x in own for y in other))
    count = Counter(p for pairs in pairs_of for p in pairs)
    top = defaultdict(int)
    for (x, _), n in count.items():
        top[x] = max(top[x], n)
    rows = []
    for (a, b, groups), pairs in zip(tokens, pairs_of):
        shown = ";".join(f"{','.join(map(str, own))}|{','.join(map(str, other))}" for own, other in groups)
        rows.append((
            len(a), len(b), len(groups), sum(pairs.values()), sum(n for p, n in pairs.items() if count[p] == top[p[0]]),
            sum(n * count[p] for p, n in pairs.items()), hashlib.sha256(shown.encode()).hexdigest() if a else "",
        ))
    return rows


def test_segments_encode_like_the_whole_by_both(aligner):
    assert Tokenizer.from_file(A).get_vocab_size() == len(aligner.bytes_a)
    for text in ["one two", "  lead and  run ", "x.y, (z)\nnew 1,000.5 it's", "é. ü! \n\n", "a" * 300 + ".b"]:
        assert aligner.b.encode(" " + text) == WHOLE.encode(text)


@settings(max_examples=150, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(texts=st.lists(odd_text.filter(bool), min_size=1, max_size=4, unique=True))
@pytest.mark.parametrize("large", [4096, 0])
def test_chunk_is_brute_force(monkeypatch, large, texts):
    monkeypatch.setattr(alignment, "LARGE_GROUP", large)
    aligner = alignment.of_worker(alignment.SegmentAligner, A, B)
    aligner.memory.kept.clear()
    got = alignment.align_chunk(aligner, pa.array(texts), np.ones(len(texts), np.int64))
    want = plain_alignment(texts, aligner)
    assert [tuple(int(got[m][i]) for m in ("n_a", "n_b", "n_groups", "n_links")) + (got["groups_sha256"][i],) for i in range(len(texts))] == [w[:4] + w[6:] for w in want]
    assert got["held"].sum() == len(got["pair"]) == len(got["links"]) and got["links"].sum() == sum(w[3] for w in want)


def test_op13_is_brute_force(spark, corpus, aligner):
    want = plain_alignment([text for _, text, *_ in corpus], aligner)
    got = sorted(tuple(r) for r in queries.QUERIES["op13_token_alignment"](spark, SF).collect())
    assert got == [(doc_id, *w) for (doc_id, *_), w in zip(corpus, want)]


def test_alignment_odd_rows(spark, aligner, odd_docs, no_docs, monkeypatch):
    monkeypatch.setattr(alignment, "CHUNK_BYTES", 40)
    rows = odd_docs.select("doc_id", "text").collect()
    want = sorted(((r.doc_id or -1, *w) for r, w in zip(rows, plain_alignment([r.text or "" if len(r.text or "") < 1000 else "" for r in rows], aligner))))
    got = sorted((r.doc_id or -1, *r[1:]) for r in alignment.align(odd_docs, A, B).collect())
    assert [g[:5] for g in got if g[0] != 5] == [w[:5] for w in want if w[0] != 5] and len(got) == 8
    assert next(g for g in got if g[0] == 5)[1] > 60_000
    assert alignment.align(no_docs, A, B).count() == 0


def plain_rearrangement(doc_id, text):
    units = re.findall(r"[A-Za-z]+|[^A-Za-z]", text)
    h1, h2, h3, h4 = fim.draws(doc_id)
    c, d = sorted((h1 % (len(units) + 1), h2 % (len(units) + 1)))
    prefix, middle, suffix = "".join(units[:c]), "".join(units[c:d]), "".join(units[d:])
    if not text or re.search("<[PSM]>", text) or h3 % 100 >= 90:
        return len(units), "plain", None, None, text
    if h4 % 100 < 20:
        return len(units), "spm", len(prefix), len(middle), f"<S>{suffix}<P>{prefix}<M>{middle}"
    return len(units), "psm", len(prefix), len(middle), f"<P>{prefix}<S>{suffix}<M>{middle}"


def test_fim_is_brute_force_over_small_frames(spark, monkeypatch):
    texts = ["", None, "a", "ab cd", "é", "x" * 50, "<P>", "<", "a<S>b", "ab" * 9 + "é" * 9 + "12", "語" * 30, "a\nb\n", "p <P q> <", "<S", "M>" * 9]
    rows = [(i, texts[i % len(texts)]) for i in range(30 * len(texts))] + [(None, "a b c d")] * 2
    monkeypatch.setattr(fim, "FRAME_BYTES", 7)
    monkeypatch.setattr(fim, "GROUP_BYTES", 40)
    docs = spark.createDataFrame(rows, "doc_id bigint, text string").coalesce(2)
    outputs = fim.rearrange(fim.store(docs))
    got = [(r.doc_id, r.n, r.form, r.prefix_chars, r.middle_chars, r.text) for r in fim.output_text(outputs).collect()]
    want = [(i, *plain_rearrangement(i, t or "")) for i, t in rows]
    assert sorted(got, key=str) == sorted(want, key=str) and {w[2] for w in want} == {"plain", "spm", "psm"}
    sha = lambda t: hashlib.sha256(t.encode()).hexdigest()
    back = [(r.doc_id, r.output_sha256, r.restored_sha256) for r in fim.digests(outputs).collect()]
    assert sorted(back, key=str) == sorted(((i, sha(w[5]), sha(t or "")) for (i, t), w in zip(rows, want)), key=str)


def test_fim_odd_rows(spark, odd_docs, no_docs):
    got = fim.digests(fim.rearrange(fim.store(odd_docs))).collect()
    assert len(got) == 8 and {r.n for r in got if r.doc_id in (2, 3)} == {0}
    texts = {r.doc_id: r.text or "" for r in odd_docs.collect()}
    assert all(r.restored_sha256 == hashlib.sha256(texts[r.doc_id].encode()).hexdigest() for r in got)
    assert fim.digests(fim.rearrange(fim.store(no_docs))).count() == 0
    names = fim.store(spark.createDataFrame([("x1", "some text")], "doc_id string, text string"))
    assert fim.rearrange(names).schema["doc_id"].dataType.simpleString() == "string" and fim.rearrange(names).count() == 1
