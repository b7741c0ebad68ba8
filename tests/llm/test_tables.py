import zlib

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F
from tokenizers import Tokenizer

import __spark_entry__ as entry
import corpus_pipeline
from compare import differences, duck
from sparkloom.llm import ann, mixing, queries, sharding, tokencounts, tokenfile
from sparkloom.llm.tokens import SegmentEncoder, tokenizer_path
from sparkloom.session import new_path

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(queries.SQL))
def test_sql(spark, name):
    assert differences(queries.QUERIES[name](spark, SF), duck(SF), queries.SQL[name], []) is None


def test_mix_gives_each_source_its_target(spark):
    rows = mixing.mix(spark.read.parquet(f"{SF}/documents.parquet")).select("source", "__mix.*").collect()
    for source in {r.source for r in rows}:
        own = [r for r in rows if r.source == source]
        assert sum(r.taken for r in own) == int(own[0].target + 0.5)
        assert all(0 <= r.taken <= 2 * r.size for r in own) and sum(r.size for r in own) == own[0].source_size
    assert abs(sum({r.source: r.target for r in rows}.values()) - 1.5 * sum(r.size for r in rows)) < 1e-6


def test_mix_odd_rows(odd_docs, no_docs):
    mixed = mixing.mix(odd_docs)
    assert mixed.columns == [*odd_docs.columns, "__mix"] and mixed.count() == 8
    by = {r.doc_id: r["__mix"] for r in mixed.collect()}
    assert by[2].size == by[3].size == 0 and by[2].taken == 0
    copies = mixing.mixed_documents(mixed)
    assert copies.columns == odd_docs.columns
    assert sum(len((r.text or "").split()) for r in copies.collect()) == sum(r["__mix"].taken for r in mixed.collect())
    assert mixing.mix(no_docs).count() == 0


def test_hilbert_curve_visits_neighbours(spark):
    cells = spark.range(8**3).select(*[(F.floor(F.col("id") / 8**k) % 8).cast("int").alias(c) for k, c in enumerate("xyz")])
    rows = cells.withColumn("h", sharding.hilbert_index([F.col(c) for c in "xyz"], 3)).toPandas().sort_values("h")
    assert rows["h"].tolist() == list(range(512))
    assert (np.abs(np.diff(rows[["x", "y", "z"]].to_numpy(), axis=0)).sum(axis=1) == 1).all()


def test_shards(spark, corpus):
    rows = queries.QUERIES["op7_hilbert_shards"](spark, "/root/testdata/sf0.01").collect()
    texts = {r.doc_id: r.text for r in spark.read.parquet("/root/testdata/sf0.01/documents.parquet").collect()}
    assert sorted(r.doc_id for r in rows) == sorted(texts)
    sizes, groups = {}, {}
    for r in rows:
        data = texts[r.doc_id].encode()
        assert (r.size, r.text_crc32, r.law, r.grown_shard) == (len(data) + 1, zlib.crc32(data), "bytes", None)
        sizes.setdefault(r.shard, []).append((r.slot, r.size))
        groups.setdefault(data, set()).add(r.shard)
    assert set(sizes) == set(range(8)) and max(map(len, groups.values())) == 1
    for own in sizes.values():
        assert sorted(s for s, _ in own) == list(range(len(own)))
    totals = [sum(s for _, s in own) for own in sizes.values()]
    assert max(totals) - min(totals) <= 2 * max(r.size for r in rows)


def test_shards_odd_rows(spark, odd_docs, no_docs):
    rows = sharding.shard(odd_docs, 3, carry=("doc_id", "text")).collect()
    assert len(rows) == 8 and {r.size for r in rows if not r.text} == {1}
    assert sharding.shard(no_docs, 3).count() == 0
    copies = spark.range(900).selectExpr("id AS doc_id", "'same text' AS text", "'a' AS source", "'en' AS lang")
    counts = {r.shard: r["count"] for r in sharding.shard(copies, 3).groupBy("shard").count().collect()}
    assert set(counts) == {0, 1, 2} and max(counts.values()) - min(counts.values()) < 100


@settings(max_examples=80, deadline=None)
@given(st.lists(st.integers(0, 5000), max_size=300))
def test_elias_fano_round_trip(gaps):
    values = np.cumsum(gaps, dtype=np.int64)
    ef = tokenfile.EliasFano.encode(values, int(values[-1]) if len(values) else 0)
    again, _ = tokenfile.EliasFano.read(b"xx" + ef.image(), 2, len(values))
    assert again.select(np.arange(len(values))).tolist() == values.tolist()
    assert [int(ef.select(np.array([k]))[0]) for k in range(0, len(values), 7)] == values[::7].tolist()


@settings(max_examples=200, deadline=None)
@given(st.lists(st.none() | st.lists(st.sampled_from([*"ab é\n\t .1'\0\xa0\u2003\u3000語☃𝒳", "<|endoftext|>", "'s"]), max_size=40).map("".join), max_size=4))
def test_segments_encode_like_the_whole(texts):
    encoder = SegmentEncoder.of_worker(tokenizer_path())
    want = [encoder.tokenizer.encode(t or "", add_special_tokens=False).ids for t in texts]
    got = []
    for rows, ids, counts in encoder.encode(pa.array(texts, pa.string())):
        assert len(counts) == rows
        got += [a.tolist() for a in np.split(ids, np.cumsum(counts)[:-1])] if rows else []
    assert got == want


def test_op6_round_trip(spark, corpus):
    tokenizer = Tokenizer.from_file(tokenizer_path())
    start, want = 0, []
    for doc_id, text, *_ in corpus:
        ids = np.array([*tokenizer.encode(text, add_special_tokens=False).ids, 2], "<u4")
        want.append((doc_id, start, len(ids), zlib.crc32(ids.tobytes())))
        start += len(ids)
    assert sorted(tuple(r) for r in queries.QUERIES["op6_token_file"](spark, SF).collect()) == want


def test_token_file_odd_rows(spark, odd_docs, no_docs, monkeypatch):
    monkeypatch.setattr(tokenfile, "BLOCK_IDS", 10)
    path = new_path(spark, "odd")
    tokenfile.write(odd_docs, path, tokenizer_path())
    rows = sorted((r.start, r.doc_id, r.n_tokens) for r in tokenfile.read_documents(spark, path).collect())
    assert [r[1] for r in rows] == [1, 1, 2, 3, 4, 5, 6, None]
    assert all(a[0] + a[2] == b[0] for a, b in zip(rows, rows[1:])) and rows[2][2] == rows[3][2] == 1
    path = new_path(spark, "none")
    tokenfile.write(no_docs, path, tokenizer_path())
    assert tokenfile.read_documents(spark, path).count() == 0


def test_op4_is_brute_force(spark, corpus):
    tokenizer = Tokenizer.from_file(tokenizer_path())
    poor = {r.doc_id for r in spark.read.parquet(f"{SF}/labels.parquet").filter("quality = 0").collect()}
    want = {}
    for doc_id, text, lang, source in corpus:
        if doc_id not in poor:
            docs, tokens = want.get((source, lang), (0, 0))
            want[source, lang] = (docs + 1, tokens + len(tokenizer.encode(text, add_special_tokens=False).ids))
    got = queries.QUERIES["op4_token_rollup"](spark, SF).collect()
    assert {(r.source, r.lang): (r.docs, r.tokens) for r in got} == want and {r.version for r in got} == {"byte_bpe_50k"}


def test_rollup_batches(spark, odd_docs, no_docs):
    rollup = tokencounts.TokenRollup(spark, new_path(spark, "rollup"))
    kind = "doc_id bigint, version string, op string, source string, lang string, tokens bigint"
    batch = lambda *rows: spark.createDataFrame(list(rows), kind)
    totals = lambda: {(r.source, r.lang, r.version): (r.docs, r.tokens) for r in rollup.totals().collect()}
    assert totals() == {}
    first = batch((1, "v1", "insert", "a", "en", 10), (2, "v1", "insert", None, None, 5), (2, "v1", "insert", None, None, 5), (None, "v1", "insert", "a", "en", 7))
    assert rollup.commit(1, first) and not rollup.commit(1, first)
    assert totals() == {("a", "en", "v1"): (2, 17), (None, None, "v1"): (1, 5)}
    second = batch((1, "v1", "revise", "b", "en", 12), (2, "v1", "delete", None, None, None), (9, "v1", "delete", "a", "en", 3), (1, "v2", "insert", "b", "en", 8))
    assert rollup.commit(2, second) and not rollup.commit(2, second)
    after = {("a", "en", "v1"): (1, 7), ("b", "en", "v1"): (1, 12), ("b", "en", "v2"): (1, 8)}
    assert totals() == after
    assert rollup.commit(3, batch().limit(0)) and totals() == after
    counts = tokencounts.count_tokens(odd_docs, tokenizer_path())
    assert "text" not in counts.columns and {r.doc_id: r.tokens for r in counts.collect()}[2] == 0
    assert tokencounts.count_tokens(no_docs, tokenizer_path()).count() == 0


def test_rollup_redo_and_order(spark):
    root = new_path(spark, "rollup-redo")
    rollup = tokencounts.TokenRollup(spark, root)
    batch = lambda *rows: spark.createDataFrame(list(rows), "doc_id bigint, version string, op string, source string, lang string, tokens bigint")
    totals = lambda: {(r.source, r.version): (r.docs, r.tokens) for r in rollup.totals().collect()}
    first = batch((1, "v1", "insert", "a", "en", 10), (2, "v1", "insert", "a", "en", 5))
    assert rollup.commit(1, first)
    # the files of a batch that never got its _SUCCESS count nowhere and are written anew
    files = spark._jvm.org.apache.hadoop.fs.Path(f"{root}/deltas/batch=1/_SUCCESS")
    files.getFileSystem(spark._jsc.hadoopConfiguration()).delete(files, False)
    assert totals() == {} and rollup.documents().count() == 0
    assert rollup.commit(1, first) and totals() == {("a", "v1"): (2, 15)}
    assert rollup.commit(5, batch((1, "v1", "revise", "a", "en", 7))) and totals() == {("a", "v1"): (2, 12)}
    with pytest.raises(ValueError):
        rollup.commit(4, batch((1, "v1", "revise", "a", "en", 9)))
    assert totals() == {("a", "v1"): (2, 12)} and not rollup.commit(1, first)


def test_op10_recall(spark):
    sf = "/root/testdata/sf0.1"
    points = spark.read.parquet(f"{sf}/embeddings.parquet").orderBy("vec_id").collect()
    ids, x = np.array([p.vec_id for p in points]), np.array([p.embedding for p in points], float)
    found = {}
    for r in queries.QUERIES["op10_kmeans_tree_neighbours"](spark, sf).collect():
        found.setdefault(r.query_id, []).append((r["rank"], r.vec_id, r.score))
    hits = []
    for i in np.flatnonzero(ids % 20 == 0):
        scores = (x * x[i]).sum(axis=1)
        scores[i] = -np.inf
        got = sorted(found[ids[i]])
        assert [g[0] for g in got] == list(range(1, 21)) and all(abs(scores[ids == g[1]][0] - g[2]) < 1e-12 for g in got)
        hits.append(len({g[1] for g in got} & set(ids[np.lexsort((ids, -scores))[:20]].tolist())) / 20)
    assert np.mean(hits) >= 0.9


def test_queries_in_tiny_leaves_get_all_their_neighbours(spark):
    rng = np.random.default_rng(4)
    x = np.concatenate([rng.normal(0, 0.01, (1500, 6)) + c for c in (np.eye(6)[0] * 9, np.eye(6)[1] * 9)] + [rng.normal(0, 9, (30, 6))])
    rows = [(i, v.tolist()) for i, v in enumerate(x)] + [(3029, x[3029].tolist())] * 40
    df = spark.createDataFrame(rows, "vec_id bigint, embedding array<double>")
    ranks = {}
    for r in ann.search(df, (F.col("vec_id") % 20 == 0) | (F.col("vec_id") >= 3000), k=20, recall=0.2).collect():
        ranks.setdefault(r.query_id, []).append((r["rank"], r.vec_id))
    assert set(ranks) == {i for i in range(3030) if i % 20 == 0 or i >= 3000}
    assert all(sorted(r)[-1][0] == len({v for _, v in r}) == len(r) == 20 for r in ranks.values())


@pytest.mark.parametrize("spread", [0.15, 100.0])
def test_recall_on_clusters_and_without(spark, spread):
    rng = np.random.default_rng(8)
    x = rng.normal(0, 1, (60, 16))[rng.integers(0, 60, 3000)] + rng.normal(0, spread, (3000, 16))
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id bigint, embedding array<double>")
    found = {}
    for r in ann.search(df, F.col("vec_id") % 10 == 0, k=20).collect():
        found.setdefault(r.query_id, set()).add(r.vec_id)
    hits = []
    for i in range(0, 3000, 10):
        scores = x @ x[i]
        scores[i] = -np.inf
        hits.append(len(found[i] & set(np.argsort(-scores)[:20].tolist())) / 20)
    assert np.mean(hits) >= 0.9 and all(len(f) == 20 for f in found.values())


def test_one_width_for_the_table(spark):
    rows = [(i, [1.0, i / 50.0] if i % 2 else [1.0, i / 50.0, 1.0]) for i in range(81)]
    df = spark.createDataFrame(rows, "vec_id bigint, embedding array<double>").repartition(8)
    got = ann.search(df, F.col("vec_id") % 20 == 0, k=3).collect()
    assert {r.query_id for r in got} == {0, 20, 40, 60, 80} and all(r.vec_id % 2 == 0 for r in got) and len(got) == 15


def test_neighbours_odd_rows(spark):
    rows = [(i, [1.0, float(i % 3)]) for i in range(40)] + [(100, None), (101, []), (102, [0.0, 0.0]), (103, [float("nan"), 1.0]), (104, [1.0, None]), (None, [1.0, 1.0])]
    df = spark.createDataFrame(rows, "vec_id bigint, embedding array<float>")
    got = ann.search(df, F.col("vec_id") % 20 == 0, k=5).collect()
    assert {r.query_id for r in got} == {0, 20} and {r.vec_id for r in got} <= set(range(40))
    assert [r.vec_id for r in sorted(got, key=lambda r: r["rank"]) if r.query_id == 20] == [2, 5, 8, 11, 14]
    few = ann.search(df.filter("vec_id < 3"), F.lit(True), k=20).collect()
    assert len(few) == 6
    assert ann.search(df.limit(0), F.lit(True)).count() == 0


def test_pipeline(spark):
    """On a table with enough labelled toxic rows to learn from; the smallest has six."""
    sf = "/root/testdata/sf0.01"
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    columns, tables = docs.columns, [docs]
    for _, stage in corpus_pipeline.STAGES[:-1]:
        from sparkloom.session import materialise
        tables.append(materialise(stage(spark, tables[-1], sf)))
        assert tables[-1].columns == columns
    ids = [{r.doc_id for r in t.select("doc_id").collect()} for t in tables]
    assert ids[0] > ids[1] >= ids[2] >= ids[3] >= ids[4]
    out = corpus_pipeline.run(spark, sf)
    assert out.count() == tables[-1].count() and {r.doc_id for r in out.collect()} == ids[4]


def test_registered():
    names = entry.queries()
    assert [sum(n.startswith(f"op{k}_") for n in names) for k in range(1, 14)] == [1] * 13 and "pipeline" in names
    assert set(queries.SQL) <= set(entry.oracle_sql())
