"""Queries that run a stream over the given tables to its end and return what it wrote."""

from __future__ import annotations

import re
import uuid

from pyspark.sql import functions as F

from ..functions.levels import severity_score
from ..operators import match, params
from ..session import checkpoint_root, materialize
from ..streaming import rules
from ..streaming.detector import StreamDetector
from . import file_queries, model_queries, rule_queries, views  # noqa: F401  (defines check steps used here)
from .registry import query
from .views import define

PIECES = 5
DELAYED_EACH = 17
RESET_EACH = 3


def _folder(spark, name: str) -> str:
    return f"{checkpoint_root(spark)}/siftline/{name}-{uuid.uuid4().hex}"


def _finish(writer, folder: str):
    """Run until the input is used up."""
    stream = writer.option("checkpointLocation", f"{folder}/offsets").trigger(availableNow=True).start()
    stream.awaitTermination()


def detection_steps(prefix: str, base: str) -> None:
    """The batch detection's check steps over other lines: ``base`` has those of a_lines and grp, the history they belong to."""
    names = ("hist", "back", "keyed", "par0", "par1", "good", "unit", "mse", "done")
    old = re.compile(rf"\ba_({'|'.join(names)})\b")

    def renamed(text: str) -> str:
        text = re.sub(r"\ba_lines\b", base, old.sub(rf"{prefix}_\1", text))
        text = text.replace("WHEN seq > 3 THEN", "WHEN row_number() OVER w > 3 THEN")  # a history that begins anew counts from there
        return text.replace("PARTITION BY stream_id", "PARTITION BY stream_id, grp")

    for name in names:
        define(f"{prefix}_{name}", tuple(map(renamed, views.DEPENDS[f"a_{name}"])), renamed(views.SQL[f"a_{name}"]))


# Every 17th line comes with the lines after its own piece; it is late if a later line of its stream came before it.
define("s_pieces", ("a_lines",), f"""SELECT *, CASE WHEN seq % {DELAYED_EACH} = 0 AND piece < {PIECES - 1} THEN piece + 1 ELSE piece END AS arrives FROM (
    SELECT *, (seq - 1) * {PIECES} // max(seq) OVER (PARTITION BY stream_id) AS piece FROM a_lines)""")
define("s_known", ("s_pieces",), """SELECT stream_id, arrives, max(m) OVER (PARTITION BY stream_id ORDER BY arrives ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS known
    FROM (SELECT stream_id, arrives, max(seq) AS m FROM s_pieces GROUP BY ALL)""")
define("s_seen", ("s_pieces", "s_known"), "SELECT p.*, 0 AS grp, coalesce(p.seq <= k.known, false) AS late FROM s_pieces p JOIN s_known k USING (stream_id, arrives)")
define("s_lines", ("s_seen",), "SELECT * FROM s_seen WHERE NOT late")
detection_steps("s", "s_lines")


def _detector(spark, sf_dir, lines):
    """A detector whose models know the first four fifths of every stream of the stored application lines."""
    parsed = model_queries.parsed_app(spark, sf_dir, lines)
    train = params.train(parsed.filter("part = 'train'"), model_queries.WINDOW)
    return StreamDetector(model_queries.key_model(parsed), train, _folder(spark, "detector"))


def _app_pieces(lines):
    """Application lines in equal pieces of each stream: (stream_id, seq, raw, piece, last)."""
    lines = lines.select("stream_id", "seq", "raw")
    ends = lines.groupBy("stream_id").agg(F.max("seq").alias("last"))
    piece = F.floor((F.col("seq") - 1) * PIECES / F.col("last")).cast("int")
    return lines.join(ends, "stream_id").withColumn("piece", piece)


def _by_restarts(spark, detector, pieces):
    """Each piece arrives when those before it have been handled; the queries are started anew for it."""
    arrivals = _folder(spark, "arrivals")
    for piece in range(PIECES):
        pieces.filter(F.col("piece") == piece).drop("piece").write.mode("append").parquet(arrivals)
        detector.run_available(spark.readStream.schema(pieces.drop("piece").schema).parquet(arrivals))
    return detector.results()


@query("stream_detect", ["s_done", "s_seen"], """SELECT stream_id::VARCHAR AS stream_id, seq, anomaly_type, false AS late FROM s_done
    UNION ALL SELECT stream_id::VARCHAR, seq, 'normal', true FROM s_seen WHERE late""")
def stream_detect(spark, sf_dir):
    """Detection over application lines that arrive in five pieces, some of them late, with a restart before every piece."""
    lines = materialize(views.app_lines(spark, sf_dir), "lines")
    pieces = _app_pieces(lines)
    delayed = (F.col("seq") % DELAYED_EACH == 0) & (F.col("piece") < PIECES - 1)
    pieces = materialize(pieces.select("stream_id", "seq", "raw", (F.col("piece") + delayed.cast("int")).alias("piece")), "pieces")
    return _by_restarts(spark, _detector(spark, sf_dir, lines), pieces).select("stream_id", "seq", "anomaly_type", "late")


define("t_lines", ("a_lines",), f"""SELECT *, CASE WHEN stream_id % {RESET_EACH} = 0 AND seq > max(seq) OVER (PARTITION BY stream_id) // 2 THEN 1 ELSE 0 END AS grp FROM a_lines""")
detection_steps("t", "t_lines")


@query("stream_reset", ["t_done"], "SELECT stream_id::VARCHAR AS stream_id, seq, anomaly_type, false AS late FROM t_done")
def stream_reset(spark, sf_dir):
    """Detection in five pieces, where every third stream is told in its middle to forget what it has seen."""
    lines = materialize(views.app_lines(spark, sf_dir), "lines")
    pieces = _app_pieces(lines)
    middle = (F.col("stream_id") % RESET_EACH == 0) & (F.col("seq") == F.floor(F.col("last") / 2) + 1)
    resets = pieces.filter(middle).select("stream_id", "seq", F.lit(None).cast("string").alias("raw"), "piece", F.lit(True).alias("reset"))
    rows = pieces.drop("last").withColumn("reset", F.lit(False)).unionByName(resets)
    found = _by_restarts(spark, _detector(spark, sf_dir, lines), materialize(rows, "pieces"))
    return found.select("stream_id", "seq", "anomaly_type", "late")


SESSION_GAP_HOURS = 6
SESSION_LATE_HOURS = 3

define("x_sessions", ("a_lines",), f"""SELECT stream_id, part, count(*) AS lines, min(seq) AS first_seq, max(seq) AS last_seq, strftime(min(t), '%Y-%m-%d %H:%M:%S') AS session_start FROM (
    SELECT *, sum(begins) OVER (PARTITION BY stream_id ORDER BY seq) AS part FROM (
        SELECT stream_id, seq, t, CASE WHEN t - lag(t) OVER (PARTITION BY stream_id ORDER BY seq) < INTERVAL {SESSION_GAP_HOURS} HOUR THEN 0 ELSE 1 END AS begins
        FROM (SELECT stream_id, seq, substr(raw, 1, 19)::TIMESTAMP AS t FROM a_lines))) GROUP BY ALL""")


@query("stream_sessions", ["x_sessions"], "SELECT stream_id, session_start, lines, first_seq, last_seq FROM x_sessions")
def stream_sessions(spark, sf_dir):
    """Closed sessions of every user's lines, which arrive in five spans of time; a third of the last hours of a span comes with the next one."""
    from ..functions import text

    raw = views.app_lines(spark, sf_dir).select("stream_id", "seq", text.timestamp(F.col("raw")).cast("timestamp").alias("ts"))
    lines = materialize(raw, "session-lines")
    span = lines.agg(F.unix_seconds(F.min("ts")).alias("a"), (F.unix_seconds(F.max("ts")) + 1).alias("b")).first()
    at = (F.unix_seconds("ts") - span["a"]) * PIECES / (span["b"] - span["a"])
    ending = (F.ceil(at) - at) * (span["b"] - span["a"]) / PIECES < SESSION_LATE_HOURS * 3600 - 60
    piece = F.floor(at).cast("int") + (ending & (F.col("seq") % 3 == 0)).cast("int")
    # The last piece has a line of nobody far ahead, which moves the watermark past every session.
    closing = spark.createDataFrame([(None, 0, PIECES + 1)], "stream_id bigint, seq bigint, piece int").withColumn(
        "ts", F.timestamp_seconds(F.lit(span["b"] + 365 * 86_400)))
    pieces = materialize(lines.withColumn("piece", piece).unionByName(closing), "session-pieces")
    folder = _folder(spark, "stream-sessions")
    for number in range(PIECES + 2):
        pieces.filter(F.col("piece") == number).drop("piece").write.mode("append").parquet(f"{folder}/in")
        arrived = spark.readStream.schema("stream_id bigint, seq bigint, ts timestamp").parquet(f"{folder}/in")
        closed = rules.line_sessions(arrived, f"{SESSION_GAP_HOURS} hours", f"{SESSION_LATE_HOURS} hours")
        _finish(closed.writeStream.format("parquet").outputMode("append").option("path", f"{folder}/out"), folder)
    found = spark.read.parquet(f"{folder}/out").filter(F.col("stream_id").isNotNull())
    return found.select("stream_id", F.date_format("session_start", "yyyy-MM-dd HH:mm:ss").alias("session_start"), "lines", "first_seq", "last_seq")


def _event_stream(spark, sf_dir, columns):
    schema = spark.read.parquet(f"{sf_dir}/events.parquet").schema
    return spark.readStream.schema(schema).parquet(f"{sf_dir}/events.parquet*").select(*columns)


@query("stream_rules", ["e_both"], "SELECT seq, rule_id, category, threat_level FROM e_both WHERE starts_with(stream_id, 'web')")
def stream_rules(spark, sf_dir):
    """Line and field rules over access lines that arrive as a stream."""
    folder = _folder(spark, "stream-rules")
    events = _event_stream(spark, sf_dir, views.EVENT_COLUMNS)
    found = rules.stream_events(views.access_rows(events)).select("seq", "rule_id", "category", "threat_level")
    _finish(found.writeStream.format("parquet").option("path", f"{folder}/out"), folder)
    return spark.read.parquet(f"{folder}/out")


define("x_hours", ("e_both", "v_access"), """SELECT strftime(date_trunc('day', a.ts), '%Y-%m-%d') AS day, category, threat_level, count(*) AS n FROM e_both e JOIN v_access a
    ON e.stream_id = a.stream_id AND e.seq = a.seq GROUP BY ALL""")


@query("stream_counts", ["x_hours"], "SELECT day, category, threat_level, n FROM x_hours")
def stream_counts(spark, sf_dir):
    """Running daily counters per category and level, at the end of the stream."""
    folder = _folder(spark, "stream-counts")
    events = _event_stream(spark, sf_dir, views.EVENT_COLUMNS)
    lines = views.access_rows(events, "ts").withColumn("ts", F.col("ts").cast("timestamp"))
    counts = rules.running_counts(rules.stream_events(lines), ["category", "threat_level"], "1 day")
    day = counts.select(F.substring(F.col("window_start").cast("string"), 1, 10).alias("day"), "category", "threat_level", "n")

    def keep(batch, batch_id):
        batch.write.mode("overwrite").parquet(f"{folder}/out/batch={batch_id}")

    _finish(day.writeStream.outputMode("update").foreachBatch(keep), folder)
    rows = spark.read.parquet(f"{folder}/out")
    return rows.groupBy("day", "category", "threat_level").agg(F.max_by("n", "batch").alias("n"))


@query("stream_login_alerts", ["t_brute"], "SELECT window_start, source_ip, failures, lockout FROM t_brute")
def stream_login_alerts(spark, sf_dir):
    """The alerts of five minutes with five or more failed logins of a source, updated as lines arrive in pieces and in no order."""
    folder = _folder(spark, "stream-alerts")
    events = views.table(spark, sf_dir, "events", *views.EVENT_COLUMNS)
    pieces = materialize(events.withColumn("piece", F.pmod(F.xxhash64("event_id"), F.lit(PIECES)).cast("int")), "event-pieces")

    def keep(batch, batch_id):
        batch.write.mode("overwrite").parquet(f"{folder}/out/batch={batch_id}")

    for piece in range(PIECES):
        pieces.filter(F.col("piece") == piece).drop("piece").write.mode("append").parquet(f"{folder}/in")
        arrived = spark.readStream.schema(events.schema).parquet(f"{folder}/in")
        alerts = rule_queries.alert_rows(rules.login_alerts(rule_queries.login_failures(views.auth_rows(arrived, "ts"))))
        _finish(alerts.writeStream.outputMode("update").foreachBatch(keep), folder)
    rows = spark.read.parquet(f"{folder}/out")
    latest = rows.groupBy("window_start", "source_ip").agg(F.max_by(F.struct("failures", "lockout"), "batch").alias("r"))
    return latest.select("window_start", "source_ip", "r.failures", "r.lockout")
