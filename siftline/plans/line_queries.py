"""Queries on sources, templates, parameters, times and line layouts."""

from __future__ import annotations

from datetime import date

from pyspark.sql import functions as F

from ..functions import formats, text
from ..functions.evaluate import once
from ..operators import keys
from ..operators.sequences import dense_position
from ..packs.dimensions import PRIVATE_RANGES
from ..operators.events import in_ranges
from ..sources import flows
from ..sources import text as lines_source
from . import views
from .registry import query
from .views import define, q

YEAR = 2024

# Check steps: the template of a line, step by step.
_word = r"regexp_extract(raw, '(?i)\b(INFO|ERROR|WARN|WARNING|DEBUG|CRITICAL|FATAL)\b', 1)"


def define_keys(source: str, out: str) -> None:
    """SQL steps that add ``log_key`` to the lines of ``source``."""
    define(out + "_a", (source,), f"SELECT *, {_word} AS word, '__LEVEL_' || upper({_word}) || '__' AS mark FROM {source}")
    define(out + "_b", (out + "_a",), f"""SELECT *, CASE WHEN word = '' THEN raw ELSE
        substr(raw, 1, instr(raw, word) - 1) || mark || substr(raw, instr(raw, word) + length(word)) END AS t0 FROM {out}_a""")
    steps = "t0"
    for pattern, new in (
        (r"\d{4}-\d{2}-\d{2}\s+\d{2}:\d{2}:\d{2}", "* *:*:*"), (r"\d+", "*"), (r"\*\.\*\.\*\.\*", "*"),
        (r"(?i)[0-9a-f]{8}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{12}", "*"), (r"/\S+", "/*"),
        (r"\w+_id=\*", "*_id=*"), (r"\w+=\*", "*=*"),
    ):
        steps = f"regexp_replace({steps}, {q(pattern)}, {q(new)}, 'g')"
    define(out + "_c", (out + "_b",), f"SELECT *, {steps} AS t1 FROM {out}_b")
    define(out, (out + "_c",), f"""SELECT * EXCLUDE (word, mark, t0, t1), trim(CASE WHEN length(t1) > 200
        THEN replace(substr(t1, 1, 200) || '...', mark, upper(word)) ELSE replace(t1, mark, upper(word)) END) AS log_key
        FROM {out}_c""")


define_keys("v_mixed", "k_mixed")
define_keys("v_app", "k_app")


@query("log_keys", ["k_mixed"], "SELECT log_key, count(*) AS n FROM k_mixed GROUP BY log_key")
def log_keys(spark, sf_dir):
    parsed = views.mixed_lines(spark, sf_dir).select(text.log_key(F.col("raw")).alias("log_key"))
    return parsed.groupBy("log_key").agg(F.count(F.lit(1)).alias("n"))


define("p_ids", ("v_mixed",), r"""SELECT stream_id, seq, raw, regexp_extract(raw, '(\d{4}-\d{2}-\d{2}\s+\d{2}:\d{2}:\d{2})', 1) AS tt
    FROM v_mixed""")
define("p_all", ("p_ids",), r"""
    SELECT stream_id, seq, 1 AS part, unnest(l) AS v, generate_subscripts(l, 1) AS i
      FROM (SELECT stream_id, seq, regexp_extract_all(raw, '\w+_id=(\d+)', 1) AS l FROM p_ids)
    UNION ALL SELECT stream_id, seq, 2, unnest(l), generate_subscripts(l, 1)
      FROM (SELECT stream_id, seq, regexp_extract_all(raw, '(?i)(?:in|took|takes?)\s+(\d+\.?\d*)\s*(?:seconds?|ms|milliseconds?)', 1) AS l FROM p_ids)
    UNION ALL SELECT stream_id, seq, 3, v, i FROM (
      SELECT stream_id, seq, tt, unnest(l) AS v, generate_subscripts(l, 1) AS i
      FROM (SELECT stream_id, seq, tt, regexp_extract_all(raw, '\b(\d+\.?\d*)\b', 1) AS l FROM p_ids))
      WHERE (tt = '' OR instr(tt, v) = 0) AND v::DOUBLE > 0 AND v::DOUBLE < 100000""")
define("p_first", ("p_all",), """SELECT stream_id, seq, v::DOUBLE AS v, min(part * 1000000 + i) AS o FROM p_all GROUP BY ALL""")
define("p_list", ("p_first",), """SELECT stream_id, seq, string_agg(printf('%.3f', v), ',' ORDER BY o) AS params, count(*) AS n_params,
    sum(v) AS total FROM p_first GROUP BY stream_id, seq""")


@query("params", ["p_list"], "SELECT stream_id, seq, params, n_params FROM p_list")
def params(spark, sf_dir):
    lines = once(views.mixed_lines(spark, sf_dir), "p", text.parameters(F.col("raw")))
    return lines.filter(F.size("p") > 0).select(
        "stream_id", "seq",
        F.array_join(F.transform("p", lambda v: F.format_string("%.3f", v)), ",").alias("params"),
        F.size("p").cast("bigint").alias("n_params"),
    )


@query("line_times", ["v_mixed"], r"""SELECT stream_id, seq, strftime(ts, '%Y-%m-%d %H:%M:%S') AS ts FROM (
    SELECT stream_id, seq, try_cast(regexp_extract(raw, '(\d{4}-\d{2}-\d{2}\s+\d{2}:\d{2}:\d{2})', 1) AS TIMESTAMP) AS ts FROM v_mixed)""")
def line_times(spark, sf_dir):
    ts = text.timestamp(F.col("raw"))
    return views.mixed_lines(spark, sf_dir).select("stream_id", "seq", F.substring(ts.cast("string"), 1, 19).alias("ts"))


@query("time_delta", ["v_app"], r"""SELECT stream_id, seq, epoch(ts) - epoch(last_value(ts IGNORE NULLS) OVER
    (PARTITION BY stream_id ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)) AS time_delta
    FROM (SELECT stream_id, seq, substr(raw, 1, 19)::TIMESTAMP AS ts FROM v_app)""")
def time_delta(spark, sf_dir):
    parsed = keys.parse_lines(views.app_lines(spark, sf_dir), parts=["ts"])
    return keys.with_time_delta(parsed).select("stream_id", "seq", "time_delta")


@query("stream_ids", ["v_named"], r"""SELECT stream_id, count(*) AS n, min(seq) AS first_line FROM (SELECT seq, coalesce(
    nullif(regexp_extract(raw, '(?i)block[_\s]*id[:\s]*([^\s,]+)', 1), ''), nullif(regexp_extract(raw, '(?i)instance[_\s]*id[:\s]*([^\s,]+)', 1), ''),
    nullif(regexp_extract(raw, '(?i)id[:\s]*([a-f0-9-]{36})', 1), ''), 'default') AS stream_id FROM v_named) GROUP BY stream_id""")
def stream_ids(spark, sf_dir):
    named = views.named_lines(spark, sf_dir).select(text.stream_identifier(F.col("raw")).alias("stream_id"), "seq")
    return named.groupBy("stream_id").agg(F.count(F.lit(1)).alias("n"), F.min("seq").alias("first_line"))


@query("regrouped_lines", ["v_named"], r"""SELECT stream_id, raw, row_number() OVER (PARTITION BY stream_id ORDER BY seq) AS seq FROM (
    SELECT seq, raw, coalesce(nullif(regexp_extract(raw, '(?i)block[_\s]*id[:\s]*([^\s,]+)', 1), ''),
    nullif(regexp_extract(raw, '(?i)instance[_\s]*id[:\s]*([^\s,]+)', 1), ''),
    nullif(regexp_extract(raw, '(?i)id[:\s]*([a-f0-9-]{36})', 1), ''), 'default') AS stream_id FROM v_named)""")
def regrouped_lines(spark, sf_dir):
    return keys.by_identifier(views.named_lines(spark, sf_dir), chunk_rows=2000)


ACCESS_SQL = formats.ACCESS
define("f_access", ("v_access",), f"""SELECT stream_id, seq, raw, regexp_extract(raw, {q(ACCESS_SQL)}, 1) AS ip,
    regexp_extract(raw, {q(ACCESS_SQL)}, 2) AS ts_text, regexp_extract(raw, {q(ACCESS_SQL)}, 3) AS request,
    regexp_extract(raw, {q(ACCESS_SQL)}, 4)::BIGINT AS status, regexp_extract(raw, {q(ACCESS_SQL)}, 5)::BIGINT AS size,
    regexp_extract(raw, {q(formats.ACCESS_AGENT)}, 7) AS user_agent FROM v_access WHERE regexp_matches(raw, {q(ACCESS_SQL)})""")


@query("access_parse", ["f_access"], r"""SELECT stream_id, seq, ip, strftime(strptime(ts_text, '%d/%b/%Y:%H:%M:%S +0000'), '%Y-%m-%d %H:%M:%S') AS ts,
    request, CASE WHEN n = 3 THEN w[1] END AS method, CASE WHEN n = 3 THEN w[2] END AS path, CASE WHEN n = 3 THEN w[3] END AS protocol,
    status, size, user_agent FROM (SELECT *, regexp_split_to_array(request, '\s+') AS w, len(regexp_split_to_array(request, '\s+')) AS n FROM f_access)""")
def access_parse(spark, sf_dir):
    p = formats.parse_access(F.col("raw"))
    rows = once(views.access_lines(spark, sf_dir), "p", p, drop_nulls=True)
    return rows.select(
        "stream_id", "seq", "p.ip", F.substring(F.col("p.ts").cast("string"), 1, 19).alias("ts"), "p.request", "p.method",
        "p.path", "p.protocol", F.col("p.status").cast("bigint").alias("status"), "p.size", "p.user_agent",
    )


SYSLOG = q(formats.SYSLOG)


@query("syslog_parse", ["v_auth"], f"""SELECT stream_id, seq, strftime(strptime('{YEAR} ' || regexp_extract(raw, {SYSLOG}, 1), '%Y %b %d %H:%M:%S'),
    '%Y-%m-%d %H:%M:%S') AS ts, regexp_extract(raw, {SYSLOG}, 2) AS host, regexp_extract(raw, {SYSLOG}, 3) AS message
    FROM v_auth WHERE regexp_matches(raw, {SYSLOG})""")
def syslog_parse(spark, sf_dir):
    rows = once(views.auth_lines(spark, sf_dir), "p", formats.parse_syslog(F.col("raw"), YEAR), drop_nulls=True)
    return rows.select(
        "stream_id", "seq", F.substring(F.col("p.ts").cast("string"), 1, 19).alias("ts"), "p.host", "p.message"
    )


WINDOWS = q(formats.WINDOWS)


@query("windows_parse", ["v_win"], f"""SELECT stream_id, seq, strftime(regexp_extract(raw, {WINDOWS}, 1)::TIMESTAMP, '%Y-%m-%d %H:%M:%S') AS ts,
    regexp_extract(raw, {WINDOWS}, 2) AS level, regexp_extract(raw, {WINDOWS}, 3)::BIGINT AS event_id,
    regexp_extract(raw, {WINDOWS}, 4) AS message FROM v_win WHERE regexp_matches(raw, {WINDOWS})""")
def windows_parse(spark, sf_dir):
    rows = once(views.windows_lines(spark, sf_dir), "p", formats.parse_windows(F.col("raw")), drop_nulls=True)
    return rows.select(
        "stream_id", "seq", F.substring(F.col("p.ts").cast("string"), 1, 19).alias("ts"), "p.level",
        F.col("p.event_id").cast("bigint").alias("event_id"), "p.message",
    )


TOMCAT = q(formats.TOMCAT)


@query("tomcat_parse", ["v_tomcat"], f"""SELECT stream_id, seq, strftime(regexp_extract(raw, {TOMCAT}, 1)::TIMESTAMP, '%Y-%m-%d %H:%M:%S') AS ts,
    regexp_extract(raw, {TOMCAT}, 2) AS thread, regexp_extract(raw, {TOMCAT}, 3) AS level,
    regexp_extract(raw, {TOMCAT}, 4) AS message FROM v_tomcat WHERE regexp_matches(raw, {TOMCAT})""")
def tomcat_parse(spark, sf_dir):
    rows = once(views.tomcat_lines(spark, sf_dir), "p", formats.parse_tomcat(F.col("raw")), drop_nulls=True)
    return rows.select(
        "stream_id", "seq", F.substring(F.col("p.ts").cast("string"), 1, 19).alias("ts"), "p.thread", "p.level", "p.message"
    )


SSH = q(formats.SYSLOG_PROCESS)
define("v_sec", ("v_mixed",), f"""SELECT *, regexp_matches(raw, {q(ACCESS_SQL)}) AS is_access,
    NOT regexp_matches(raw, {q(ACCESS_SQL)}) AND regexp_matches(raw, {SSH}) AS is_syslog FROM v_mixed""")
define("f_sec", ("v_sec",), rf"""SELECT stream_id, seq, raw,
    CASE WHEN is_access THEN regexp_extract(raw, {q(ACCESS_SQL)}, 2) WHEN is_syslog THEN regexp_extract(raw, {SSH}, 1) END AS ts_text,
    CASE WHEN is_access THEN regexp_extract(raw, {q(ACCESS_SQL)}, 1)
         WHEN is_syslog THEN nullif(regexp_extract(raw, {q(formats.FIRST_IP)}, 1), '') END AS source_ip,
    CASE WHEN is_syslog THEN regexp_extract(raw, {SSH}, 2) END AS hostname,
    CASE WHEN is_access THEN regexp_extract(raw, {q(ACCESS_SQL)}, 3) END AS request,
    CASE WHEN is_syslog THEN regexp_extract(raw, {SSH}, 4) END AS message,
    CASE WHEN NOT is_access AND NOT is_syslog THEN nullif(regexp_extract(raw, 'EventID=(\d+)', 1), '') END AS event_id FROM v_sec""")


@query("security_parse", ["f_sec"], "SELECT stream_id, seq, ts_text, source_ip, hostname, request, message, event_id FROM f_sec")
def security_parse(spark, sf_dir):
    rows = once(views.mixed_lines(spark, sf_dir), "p", formats.parse_security_line(F.col("raw")))
    return rows.select(
        "stream_id", "seq", "p.ts_text", "p.source_ip", "p.hostname", "p.request", "p.message", "p.event_id"
    )


def _matches(patterns) -> str:
    return " OR ".join(f"regexp_matches(raw, {q(p)})" for p in patterns)


@query("line_type", ["v_mixed"], f"""SELECT line_type, count(*) AS n FROM (SELECT CASE
    WHEN {" OR ".join(f"contains(raw, {q(m)})" for m in formats.WINDOWS_MARKS)} OR {_matches([formats.WINDOWS_TIME])} THEN 'Windows'
    WHEN {_matches(formats.APACHE_ERROR)} OR {_matches(formats.APACHE_ACCESS)}
      OR ((contains(raw, 'GET ') OR contains(raw, 'POST ')) AND contains(raw, 'HTTP/')) THEN 'Apache'
    WHEN {_matches([formats.LINUX_TIME])} THEN 'Linux' ELSE 'unknown' END AS line_type FROM v_mixed) GROUP BY 1""")
def line_type(spark, sf_dir):
    typed = views.mixed_lines(spark, sf_dir).select(formats.line_type(F.col("raw")).alias("line_type"))
    return typed.groupBy("line_type").agg(F.count(F.lit(1)).alias("n"))


@query("time_texts", ["v_mixed"], f"""SELECT stream_id, seq, coalesce({", ".join(f"nullif(regexp_extract(raw, {q(p)}, 0), '')" for p in formats.TIME_TEXTS)}) AS ts_text
    FROM v_mixed""")
def time_texts(spark, sf_dir):
    return views.mixed_lines(spark, sf_dir).select("stream_id", "seq", formats.time_text(F.col("raw")).alias("ts_text"))


@query("source_ips", ["v_auth"], r"""SELECT source_ip, count(*) AS n FROM (SELECT nullif(regexp_extract(raw, 'from\s+([\d.]+)', 1), '') AS source_ip FROM v_auth)
    WHERE source_ip IS NOT NULL GROUP BY 1""")
def source_ips(spark, sf_dir):
    found = views.auth_lines(spark, sf_dir).select(formats.source_ip(F.col("raw")).alias("source_ip"))
    return found.filter(F.col("source_ip").isNotNull()).groupBy("source_ip").agg(F.count(F.lit(1)).alias("n"))


def _range_sql() -> str:
    result = "NULL"
    for cidr in reversed(PRIVATE_RANGES):
        base, bits = cidr.split("/")
        low = sum(int(p) << s for p, s in zip(base.split("."), (24, 16, 8, 0)))
        result = f"CASE WHEN num BETWEEN {low} AND {low + (1 << (32 - int(bits))) - 1} THEN '{cidr}' ELSE {result} END"
    return result


@query("private_ip", ["f_access"], f"""SELECT ip, {_range_sql()} AS private_range, n FROM (SELECT ip, count(*) AS n,
    split_part(ip, '.', 1)::BIGINT * 16777216 + split_part(ip, '.', 2)::BIGINT * 65536 + split_part(ip, '.', 3)::BIGINT * 256
    + split_part(ip, '.', 4)::BIGINT AS num FROM f_access GROUP BY ip)""")
def private_ip(spark, sf_dir):
    ips = views.access_lines(spark, sf_dir).select(text.group(F.col("raw"), formats.ACCESS, 1).alias("ip"))
    counts = ips.groupBy("ip").agg(F.count(F.lit(1)).alias("n"))
    return counts.select("ip", in_ranges(F.col("ip")).alias("private_range"), "n")


@query("label_split", ["v_labelled"], """SELECT label, count(*) AS n, sum(length(content))::BIGINT AS chars FROM (
    SELECT CASE WHEN instr(raw, ' ') > 0 THEN split_part(raw, ' ', 1) ELSE '-' END AS label,
    CASE WHEN instr(raw, ' ') > 0 THEN substr(raw, instr(raw, ' ') + 1) ELSE raw END AS content FROM v_labelled) GROUP BY label""")
def label_split(spark, sf_dir):
    split = lines_source.split_label(views.labelled_lines(spark, sf_dir))
    return split.groupBy("label").agg(F.count(F.lit(1)).alias("n"), F.sum(F.length("raw")).cast("bigint").alias("chars"))


@query("positional_split", ["v_app"], """SELECT stream_id, part, count(*) AS n, max(seq) AS last_seq FROM (
    SELECT stream_id, seq, CASE WHEN seq <= floor(0.8 * count(*) OVER (PARTITION BY stream_id)) THEN 'train' ELSE 'test' END AS part FROM v_app)
    GROUP BY ALL""")
def positional_split(spark, sf_dir):
    split = lines_source.positional_split(views.app_lines(spark, sf_dir))
    return split.groupBy("stream_id", "part").agg(F.count(F.lit(1)).alias("n"), F.max("seq").alias("last_seq"))


@query("tail_n", ["v_app"], """SELECT stream_id, seq, raw FROM (SELECT *, max(seq) OVER (PARTITION BY stream_id) AS m FROM v_app) WHERE seq > m - 5""")
def tail_n(spark, sf_dir):
    return lines_source.tail(views.app_lines(spark, sf_dir), 5).select("stream_id", "seq", "raw")


@query("head_per_stream", ["v_app"], "SELECT stream_id, seq, raw FROM v_app WHERE seq <= 20")
def head_per_stream(spark, sf_dir):
    return lines_source.head(views.app_lines(spark, sf_dir), 20).select("stream_id", "seq", "raw")


@query("balanced_sample", ["v_mixed"], """SELECT kind, stream_id, seq, raw FROM (SELECT *, row_number() OVER (PARTITION BY kind ORDER BY stream_id, seq, raw) AS r
    FROM (SELECT CASE WHEN regexp_matches(stream_id, '^\\d+$') THEN 'app' ELSE regexp_replace(stream_id, '\\d+', '') END AS kind, * FROM v_mixed)) WHERE r <= 300""")
def balanced_sample(spark, sf_dir):
    """Up to 300 lines of every kind of stream; application streams are numbers."""
    named = F.col("stream_id").cast("string")
    kind = F.when(named.rlike(r"^\d+$"), "app").otherwise(F.regexp_replace(named, r"\d+", ""))
    typed = views.mixed_lines(spark, sf_dir).withColumn("kind", kind)
    return lines_source.balanced(typed, "kind", 300).select("kind", "stream_id", "seq", "raw")


@query("date_range", ["v_auth"], f"""SELECT stream_id, seq, raw FROM (SELECT *, strptime('{YEAR} ' || substr(raw, 1, 15), '%Y %b %d %H:%M:%S') AS t FROM v_auth)
    WHERE t >= TIMESTAMP '{YEAR}-01-05' AND t < TIMESTAMP '{YEAR}-01-11'""")
def date_range(spark, sf_dir):
    lines = views.auth_lines(spark, sf_dir)
    ts = lines_source.linux_line_time(F.col("raw"), YEAR)
    return lines_source.in_dates(lines, ts, date(YEAR, 1, 5), date(YEAR, 1, 10)).select("stream_id", "seq", "raw")


@query("access_date_range", ["v_access"], r"""SELECT stream_id, seq, raw FROM (SELECT *, strptime(regexp_extract(raw, '\[([^:]+):', 1), '%d/%b/%Y') AS t FROM v_access)
    WHERE t >= TIMESTAMP '2024-01-03' AND t < TIMESTAMP '2024-01-08'""")
def access_date_range(spark, sf_dir):
    lines = views.access_lines(spark, sf_dir)
    days = lines_source.access_line_day(F.col("raw"))
    return lines_source.in_dates(lines, days, date(2024, 1, 3), date(2024, 1, 7)).select("stream_id", "seq", "raw")


@query("pasted_text", (), r"""SELECT doc_id AS stream_id, seq, raw FROM (SELECT doc_id, i AS seq, regexp_replace(l[i], '^\s+|\s+$', '', 'g') AS raw
    FROM (SELECT doc_id, string_split(text, chr(10)) AS l, unnest(range(1, len(string_split(text, chr(10))) + 1)) AS i FROM documents)) WHERE raw <> ''""")
def pasted_text(spark, sf_dir):
    return lines_source.pasted(views.table(spark, sf_dir, "documents"), "text", "doc_id")


@query("comment_filter", (), r"""SELECT count(*) AS n, count(DISTINCT doc_id) AS docs FROM (SELECT doc_id, regexp_replace(unnest(string_split(text, chr(10))), '^\s+|\s+$', '', 'g') AS raw
    FROM documents) WHERE raw <> '' AND NOT starts_with(raw, '#')""")
def comment_filter(spark, sf_dir):
    lines = lines_source.pasted(views.table(spark, sf_dir, "documents"), "text", "doc_id")
    return lines.filter(~F.col("raw").startswith("#")).agg(
        F.count(F.lit(1)).alias("n"), F.countDistinct("stream_id").alias("docs")
    )


@query("flow_lines", (), """SELECT l_orderkey, l_linenumber::BIGINT AS l_linenumber, '[' || upper(l_returnflag) || '] ' || l_linestatus || ' | SRC:' || l_partkey::VARCHAR
    || ' DST:' || l_suppkey::VARCHAR || ' | FLAG:' || l_returnflag || ' | ATTACK:' || l_linestatus || ' (difficulty:' || l_linenumber::VARCHAR || ')' AS nsl,
    '[' || upper(l_returnflag) || '] ' || l_linestatus || ' | SPKTS:' || l_partkey::VARCHAR || ' DPKTS:' || l_suppkey::VARCHAR || ' | SBYTES:' || l_orderkey::VARCHAR
    || ' DBYTES:' || l_linenumber::VARCHAR || ' | RATE:' || printf('%.2f', l_extendedprice) || ' | STATE:' || l_returnflag || ' | ATTACK:' || l_linestatus
    || ' LABEL:' || l_linenumber::VARCHAR AS unsw FROM lineitem""")
def flow_lines(spark, sf_dir):
    items = views.table(spark, sf_dir, "lineitem")
    c = F.col
    shaped = items.select(
        "l_orderkey", c("l_linenumber").cast("bigint").alias("l_linenumber"),
        c("l_returnflag").alias("protocol_type"), c("l_linestatus").alias("service"), c("l_partkey").alias("src_bytes"),
        c("l_suppkey").alias("dst_bytes"), c("l_returnflag").alias("flag"), c("l_linestatus").alias("attack_cat"),
        c("l_linenumber").alias("difficulty_level"), c("l_returnflag").alias("proto"), c("l_partkey").alias("spkts"),
        c("l_suppkey").alias("dpkts"), c("l_orderkey").alias("sbytes"), c("l_linenumber").alias("dbytes"),
        c("l_extendedprice").alias("rate"), c("l_returnflag").alias("state"),
    )
    nsl = shaped.withColumn("label", c("attack_cat")).withColumn("nsl", flows.nsl_kdd_line())
    return nsl.withColumn("label", c("difficulty_level")).select(
        "l_orderkey", "l_linenumber", "nsl", flows.unsw_line().alias("unsw")
    )


@query("line_positions", ["v_access"], """SELECT stream_id, seq, row_number() OVER (PARTITION BY stream_id ORDER BY seq) AS line_no FROM v_access""")
def line_positions(spark, sf_dir):
    lines = views.access_lines(spark, sf_dir).select("stream_id", "seq")
    return dense_position(lines, ["stream_id"], ["seq"], F.floor(F.col("seq") / 1000), "line_no")


@query("windows_export", (), r"""SELECT o_orderkey, strftime(o_orderdate, '%Y-%m-%d %H:%M:%S') || ' ' || o_orderstatus || ' EventID=' || (o_custkey)::VARCHAR || ' '
    || regexp_replace(o_orderpriority || chr(10) || o_orderstatus, '\r?\n', ' ', 'g') AS line FROM orders""")
def windows_export(spark, sf_dir):
    orders = views.table(spark, sf_dir, "orders")
    message = F.concat(F.col("o_orderpriority"), F.lit("\n"), F.col("o_orderstatus"))
    line = lines_source.windows_line(
        F.substring(F.col("o_orderdate").cast("string"), 1, 19), F.col("o_orderstatus"), F.col("o_custkey"), message
    )
    return orders.select("o_orderkey", line.alias("line"))
