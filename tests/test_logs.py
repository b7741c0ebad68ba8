import pytest
from pyspark.sql import functions as F

from sparkloom.functions import text
from sparkloom.functions.codes import code_table
from sparkloom.operators import logs
from sparkloom.streaming import logs as stream

HEAD = "12.000000001 13.500000000 1.499999999 app host 00042 7f"
LINES = {
    "log": f"{HEAD} write 5 3 /var/log/a.log word",
    "close": f"{HEAD} close 0 3 /tmp/x",
    "drop": f"{HEAD} read 5 3 /tmp/x word",
    "spaces": f"{HEAD}   write  5 3 /a.log   w12 w13 w14 w15 w16  w17",
    "quotes": f"{HEAD} write 5 3 /a'b\".log \"w\nx'",
    "nonsocket": f"{HEAD} socket 5 3 NON_SOCKET w12 w13 w14",
    "error": f"{HEAD} open -1 3 /tmp/y w12 w13 w14",
    "short": "1.0 oops",
    "socket": f"{HEAD} close 0 3 SOCK_STREAM",
    "empty": "",
}


@pytest.fixture(scope="module")
def lines(spark):
    return spark.createDataFrame(list(LINES.items()), "name string, value string")


def by_name(df, *columns):
    return {r["name"]: tuple(r[c] for c in columns) if len(columns) > 1 else r[columns[0]] for r in df.collect()}


def test_tokens_and_tail(lines):
    words = logs.tokenised(lines)
    tokens = by_name(words, "words")
    assert tokens["quotes"][10:] == ["/a.b..log", ".w.x."]
    assert tokens["spaces"][7] == "write" and len(tokens["spaces"]) == 17
    assert tokens["empty"] == []
    tails = by_name(words.select("name", logs.tail(F.col("words")).alias("tail")), "tail")
    assert tails["nonsocket"] == "w13 w14 " and tails["error"] == "w13 w14 "
    assert tails["spaces"] == "w16 w17 "
    assert tails["log"] is None and tails["short"] is None


def test_typed_rows(lines):
    rows = logs.typed(lines, F.col("name"))
    got = {r["id"]: r for r in rows.collect()}
    assert got["log"]["start_time"] == 12.000000001 and got["log"]["fd"] == 3
    assert got["log"]["proc_id"] == "00042" and got["log"]["contents"] == "word"
    assert got["close"]["contents"] is None
    assert got["short"]["end_time"] is None and got["short"]["valid"] == "A"
    assert got["empty"]["start_time"] is None
    kept = {r["id"] for r in logs.accepted(rows).collect()}
    assert kept == {"log", "close", "spaces", "quotes"}


def test_ids_count_every_line(spark):
    df = spark.range(100).select(F.col("id").alias("k"), F.concat(F.lit("l"), "id").alias("value")).repartition(5)
    numbered = logs.numbered(df, ["k"])
    assert numbered.where("id <> k").count() == 0
    assert logs.report_lines(
        spark.createDataFrame([(5, "p", "t")], "id bigint, proc_name string, thread_id string")
    ).first()["line"] == "id = 5  proc_name = p   thread_id = t"


def test_render_and_duration(spark):
    rows = [  # end before the wrap, borrow, wrap
        (0, 1_000_000, 3_500_000), (1, 1_900_000, 3_100_000), (2, 9_999_000_000, 10_001_500_000)]
    calls = spark.createDataFrame(rows, "id int, start_us bigint, end_us bigint").select(
        "*", F.lit("p").alias("program"), F.lit("h").alias("host"), F.lit(42).alias("pid"),
        F.lit(255).cast("bigint").alias("thread"), F.lit("close").alias("call"), F.lit(0).alias("ret"),
        F.lit(3).alias("fd"), F.lit("/x").alias("path"), F.lit("rest").alias("rest"))
    rendered = calls.select("id", logs.render(calls).alias("value"))
    text_of = {r["id"]: r["value"] for r in rendered.collect()}
    assert text_of[0] == "1.000000000 3.500000000 2.500000000 p h 00042 ff close 0 3 /x rest"
    assert text_of[1].split(" ")[2] == "1.1800000000"  # the original's borrow
    checked = {r["id"]: (r["duration"], r["turnaround_ok"])
               for r in logs.duration_check(logs.typed(rendered, F.col("id"))).collect()}
    assert checked == {0: (2.5, True), 1: (1.2, False), 2: (2.5, False)}


def _payload(data: bytes, limit):
    out = ""
    for b in data:
        if limit is not None and len(out) + 2 >= limit:
            break
        out += {13: "\\r", 10: "\\n", 9: "\\t"}.get(b, chr(b) if 31 <= b <= 126 else ".")
    return out


@pytest.mark.parametrize("limit", [None, 3, 6, 7, 8, 9, 100])
def test_payload(spark, limit):
    samples = ["abc\tdef\nghi\r", "\t\t\t\t\t", "ab\\n\tq", "é€𝄞 x", "", "\x01\x02\x1f\x7f ok", "abcd\n\n\n"]
    df = spark.createDataFrame([(s,) for s in samples], "s string")
    got = {r["s"]: r["c"] for r in df.select("s", text.clean_payload(F.col("s"), limit).alias("c")).collect()}
    assert got == {s: _payload(s.encode(), limit) for s in samples}


def test_code_labels(spark):
    rows = spark.createDataFrame([(1,), (2,), (10,), (129,), (41,), (999,)], "code int")
    def label(kind):
        return {r["code"]: r["l"] for r in logs.with_label(rows, "code", kind, "l").collect()}
    assert label("errno") == {1: "EPERM", 2: "ENOENT", 10: "ECHILD", 129: "EKEYREJECTED", 41: "err-unknown", 999: "err-unknown"}
    assert label("socket")[10] == "SOCK_PACKET" and label("socket")[41] == "SOCK_unknown"
    assert label("family")[10] == "AF_INET6" and label("family")[999] == "AF_unknown"
    assert len(code_table("errno")) == 127


def test_stream(spark, tmp_path, lines, rows):
    source, target = tmp_path / "in", str(tmp_path / "out")
    source.mkdir()
    plain = {k: v for k, v in LINES.items() if "\n" not in v}
    half = len(plain) // 2
    (source / "a.txt").write_text("\n".join(list(plain.values())[:half]) + "\n")
    stream.ingest(stream.line_stream(spark, str(source)), target, availableNow=True).awaitTermination()
    # a restart continues with the new file only
    (source / "b.txt").write_text("\n".join(list(plain.values())[half:]) + "\n")
    stream.ingest(stream.line_stream(spark, str(source)), target, availableNow=True).awaitTermination()
    batch = spark.createDataFrame([(v,) for v in plain.values()], "value string")
    want = logs.accepted(logs.typed(batch, logs.stable_id(F.col("value"))))
    assert rows(stream.stored_rows(spark, target)) == rows(want)
    raw = [r["value"] for r in spark.read.text(f"{target}/raw").collect()]
    assert sorted(raw) == sorted(plain.values())
