"""Log queries: event rows rendered as system-call lines, with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from sparkloom.functions import text
from sparkloom.functions.codes import DEFAULTS, SOCKET_TYPES, code_table
from sparkloom.functions.times import epoch_micros
from sparkloom.operators import logs
from sparkloom.session import materialise, new_path
from sparkloom.sources.tables import table
from sparkloom.streaming import logs as stream

CALLS = {"click": "write", "view": "read", "purchase": "close", "signup": "socket", "error": "open"}
FILLER = "one  two three   four"


def lines(spark, root):
    """(event_id, value): one log line per event."""
    events = table(spark, root, "events")
    kind = F.col("event_type")
    start = epoch_micros(events, "ts")
    call = F.coalesce(*[F.when(kind == k, F.lit(c)) for k, c in CALLS.items()])
    file = F.concat(F.lit("/var/log/u"), F.col("user_id").cast("string"),
                    F.when(F.col("user_id") % 2 == 0, ".log").otherwise(".dat"))
    calls = events.select(
        "event_id", start.alias("start_us"),
        (start + F.round(F.col("value") * 1000).cast("bigint") + 250000).alias("end_us"),
        F.concat(F.lit("app'"), kind).alias("program"),
        F.concat(F.lit("host"), (F.col("user_id") % 7).cast("string")).alias("host"),
        (F.col("user_id") * 997).alias("pid"), F.col("event_id").alias("thread"), call.alias("call"),
        F.when(kind == "error", -1).otherwise(F.col("user_id") * 10).alias("ret"),
        (F.col("user_id") % 61 + 3).alias("fd"),
        F.when(kind == "signup", "NON_SOCKET")
        .when((kind == "purchase") & (F.col("user_id") % 5 == 0), "SOCK_STREAM")
        .otherwise(file).alias("path"),
        F.concat_ws(" ", F.concat(F.lit('"'), kind, F.lit('"')), "props", F.lit(FILLER)).alias("rest"),
    )
    return calls.select("event_id", logs.render(calls).alias("value"))


def _parsed(spark, root):
    return logs.typed(logs.numbered(lines(spark, root), ["event_id"]), F.col("id"))


def tokens(spark, root):
    words = logs.tokenised(lines(spark, root))
    return words.select("event_id", F.size("words").cast("bigint").alias("n_tokens"),
                        F.array_join("words", "|").alias("tokens"))


def tails(spark, root):
    words = logs.tokenised(lines(spark, root))
    return words.select("event_id", logs.tail(F.col("words")).alias("tail"))


def scan_project(spark, root):
    return logs.report_lines(materialise(logs.accepted(_parsed(spark, root)), "log"))


def duration(spark, root):
    return logs.duration_check(_parsed(spark, root)).select(
        "id", "turnaround_time", "duration", "turnaround_ok")


def code_labels(spark, root):
    rows = table(spark, root, "events").select(
        "event_id", F.col("user_id").alias("err"), (F.col("user_id") % 12).alias("sock"),
        (F.col("user_id") % 50).alias("af"))
    for code, kind in (("err", "errno"), ("sock", "socket"), ("af", "family")):
        rows = logs.with_label(rows, code, kind, f"{code}_label")
    return rows.select("event_id", "err_label", "sock_label", "af_label")


def payload(spark, root):
    return table(spark, root, "documents").select(
        "doc_id", text.clean_payload(F.col("text")).alias("payload"))


def stream_rows(spark, root):
    """The same lines through text files and a stream that drains and stops."""
    source, target = new_path(spark, "log-lines"), new_path(spark, "log-stream")
    lines(spark, root).select("value").write.text(source)
    stream.ingest(stream.line_stream(spark, source), target, availableNow=True).awaitTermination()
    return stream.stored_rows(spark, target)


QUERIES = {
    "log_render": lines,
    "log_tokens": tokens,
    "log_tail": tails,
    "log_parse": _parsed,
    "log_filter": lambda s, d: logs.accepted(_parsed(s, d)),
    "log_duration_check": duration,
    "log_scan_project": scan_project,
    "log_stream_rows": stream_rows,
    "log_code_labels": code_labels,
    "log_clean_payload": payload,
}

_CALL_SQL = " ".join(f"WHEN '{k}' THEN '{c}'" for k, c in CALLS.items())

_LINES = f"""WITH raw AS (
    SELECT *, epoch_us(ts) AS a, epoch_us(ts) + CAST(round(value * 1000) AS BIGINT) + 250000 AS b FROM events),
  parts AS (
    SELECT *, a // 1000000 % 10000 AS s1, a % 1000000 * 1000 AS n1,
           b // 1000000 % 10000 AS s2, b % 1000000 * 1000 AS n2 FROM raw),
  dur AS (
    SELECT *, CASE WHEN n2 < n1 THEN s2 - s1 - 1 ELSE s2 - s1 END AS ds,
           CASE WHEN n2 < n1 THEN 1000000000 - (n2 - n1) ELSE n2 - n1 END AS dn,
           user_id * 997 AS pid FROM parts),
  lines AS MATERIALIZED (
    SELECT event_id, concat_ws(' ',
      s1 || '.' || lpad(CAST(n1 AS VARCHAR), 9, '0'), s2 || '.' || lpad(CAST(n2 AS VARCHAR), 9, '0'),
      ds || '.' || CASE WHEN dn >= 1000000000 THEN CAST(dn AS VARCHAR) ELSE lpad(CAST(dn AS VARCHAR), 9, '0') END,
      'app''' || event_type, 'host' || (user_id % 7),
      CASE WHEN pid < 10000 THEN lpad(CAST(pid AS VARCHAR), 5, '0') ELSE CAST(pid AS VARCHAR) END,
      printf('%x', event_id), CASE event_type {_CALL_SQL} END,
      CASE WHEN event_type = 'error' THEN -1 ELSE user_id * 10 END, user_id % 61 + 3,
      CASE WHEN event_type = 'signup' THEN 'NON_SOCKET'
           WHEN event_type = 'purchase' AND user_id % 5 = 0 THEN 'SOCK_STREAM'
           ELSE '/var/log/u' || user_id || CASE WHEN user_id % 2 = 0 THEN '.log' ELSE '.dat' END END,
      '"' || event_type || '"', props, '{FILLER}') AS value FROM dur),
  words AS MATERIALIZED (
    SELECT event_id, value, row_number() OVER (ORDER BY event_id) - 1 AS id,
           list_filter(string_split(translate(value, '''"' || chr(10), '...'), ' '), lambda w: w <> '') AS t
    FROM lines)"""


def _typed_sql(row_id: str) -> str:
    cols = ", ".join(
        (f"t[{n}]" if kind == "string" else f"TRY_CAST(t[{n}] AS {kind})") + f" AS {name}"
        for name, kind, n in logs.COLUMNS)
    return f"{_LINES}, rows_ AS MATERIALIZED (SELECT {row_id} AS id, {cols}, 'A' AS valid FROM words)"


_SOCKETS = ", ".join(f"'{s}'" for s in [*SOCKET_TYPES.values(), DEFAULTS["socket"]])
_KEEP = (f"(coalesce(pipe_val LIKE '%.log', false) OR coalesce(sys_call = 'close', false)) "
         f"AND NOT coalesce(pipe_val IN ({_SOCKETS}), false)")
_PARSED = _typed_sql("CAST(id AS BIGINT)")
_HASHED = _typed_sql("CAST('0x' || substr(md5(value), 1, 15) AS BIGINT)")


def _labels_sql() -> str:
    ctes, joins = [], []
    for code, kind, expr in (("err", "errno", "user_id"), ("sock", "socket", "user_id % 12"),
                             ("af", "family", "user_id % 50")):
        values = ", ".join(f"({c}, '{label}')" for c, label in code_table(kind).items())
        ctes.append(f"{code}(code, label) AS (VALUES {values})")
        joins.append(f"LEFT JOIN {code} ON {code}.code = {expr}")
    return (f"WITH {', '.join(ctes)} SELECT event_id, coalesce(err.label, '{DEFAULTS['errno']}') AS err_label, "
            f"coalesce(sock.label, '{DEFAULTS['socket']}') AS sock_label, "
            f"coalesce(af.label, '{DEFAULTS['family']}') AS af_label FROM events {' '.join(joins)}")


SQL = {
    "log_render": f"{_LINES} SELECT event_id, value FROM lines",
    "log_tokens": f"{_LINES} SELECT event_id, CAST(len(t) AS BIGINT) AS n_tokens, array_to_string(t, '|') AS tokens FROM words",
    "log_tail": f"""{_LINES}, starts AS (SELECT *, CASE WHEN coalesce(t[11] = 'NON_SOCKET', false)
        OR coalesce(t[9] = '-1', false) THEN 13 ELSE 16 END AS k FROM words)
        SELECT event_id, CASE WHEN len(t) >= k THEN array_to_string(t[k:], ' ') || ' ' END AS tail FROM starts""",
    "log_parse": f"{_PARSED} SELECT * FROM rows_",
    "log_filter": f"{_PARSED} SELECT * FROM rows_ WHERE {_KEEP}",
    "log_duration_check": f"""{_PARSED} SELECT id, turnaround_time,
        round((end_time - start_time + 10000) % 10000, 9) AS duration,
        abs(round((end_time - start_time + 10000) % 10000, 9) - turnaround_time) < 1e-6 AS turnaround_ok FROM rows_""",
    "log_scan_project": f"""{_PARSED} SELECT 'id = ' || id || '  proc_name = ' || proc_name || '   thread_id = ' || thread_id AS line
        FROM rows_ WHERE {_KEEP}""",
    "log_stream_rows": f"{_HASHED} SELECT * FROM rows_ WHERE {_KEEP}",
    "log_code_labels": _labels_sql(),
    "log_clean_payload": r"""SELECT doc_id, replace(replace(replace(
        regexp_replace(regexp_replace(regexp_replace(regexp_replace(text,
          '[\x{80}-\x{7ff}]', '..', 'g'), '[\x{800}-\x{ffff}]', '...', 'g'), '[\x{10000}-\x{10ffff}]', '....', 'g'),
          '[^\x1f-\x7e\r\n\t]', '.', 'g'),
        chr(13), '\r'), chr(10), '\n'), chr(9), '\t') AS payload FROM documents""",
}
