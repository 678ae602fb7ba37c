"""Queries that write lines of the given tables as files below the shared folder and read them back through sources and sinks."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from .. import sinks
from ..operators import match, report
from ..session import checkpoint_root, materialize
from ..sources import rules as rule_files
from ..sources import text
from . import rule_queries, views
from .registry import query

PARTS = 8


def folder(spark, name: str) -> str:
    return f"{checkpoint_root(spark)}/siftline/{name}-{uuid.uuid4().hex}"


def kind_of(stream):
    """A name that tells the type of a stream's lines."""
    return F.when(stream.startswith("srv"), "Linux_auth").when(stream.startswith("dc"), "Windows_events").otherwise("web_access")


def written(spark, lines, name: str) -> str:
    """Lines as text files in one folder per kind; a kind's files hold equal shares of its lines."""
    path = folder(spark, name)
    dealt = lines.select(kind_of(F.col("stream_id")).alias("kind"), F.pmod(F.col("seq"), F.lit(PARTS)).alias("part"), "raw")
    dealt.repartition("kind", "part").select("kind", F.col("raw").alias("value")).write.partitionBy("kind").text(path)
    return path


def folder_name():
    return F.regexp_extract("stream_id", "kind=([^/]+)/", 1)


LINES = "SELECT stream_id, raw FROM v_auth UNION ALL SELECT stream_id, raw FROM v_win UNION ALL SELECT stream_id, raw FROM v_access"
KINDS = "CASE WHEN starts_with(stream_id, 'srv') THEN 'Linux_auth' WHEN starts_with(stream_id, 'dc') THEN 'Windows_events' ELSE 'web_access' END"


def all_lines(spark, sf_dir):
    views_of = (views.auth_lines, views.windows_lines, views.access_lines)
    parts = [v(spark, sf_dir).select(F.col("stream_id").cast("string").alias("stream_id"), "seq", "raw") for v in views_of]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


@query("scan_lines", ["v_auth", "v_win", "v_access"], f"SELECT {KINDS} AS kind, trim(raw) AS raw, count(*) AS n FROM ({LINES}) GROUP BY ALL")
def scan_lines(spark, sf_dir):
    """All lines of text files, with what folder they came from."""
    lines = text.read_lines(spark, written(spark, all_lines(spark, sf_dir), "scan-lines"), recursive=True)
    return lines.groupBy(folder_name().alias("kind"), "raw").agg(F.count(F.lit(1)).alias("n"))


@query("scan_auto", ["v_auth", "v_win", "v_access"], f"""SELECT CASE kind WHEN 'Linux_auth' THEN 'linux' WHEN 'Windows_events' THEN 'windows' ELSE 'nginx' END AS log_type, n
    FROM (SELECT {KINDS} AS kind, count(*) AS n FROM ({LINES}) GROUP BY 1)""")
def scan_auto(spark, sf_dir):
    """Lines per type that their own first lines tell."""
    lines = text.read_lines(spark, written(spark, all_lines(spark, sf_dir), "scan-auto"), recursive=True)
    return text.with_type(lines, unified=True).groupBy("log_type").agg(F.count(F.lit(1)).alias("n"))


@query("scan_balanced", ["v_auth", "v_win", "v_access"], f"""SELECT log_type, n FROM (VALUES ('linux'), ('windows')) t(log_type),
    (SELECT min(n) AS n FROM (SELECT count(*) AS n FROM ({LINES}) WHERE {KINDS} <> 'web_access' GROUP BY {KINDS}))""")
def scan_balanced(spark, sf_dir):
    """As many lines of each kind as the smallest has, typed by path."""
    found = text.read_balanced(spark, written(spark, all_lines(spark, sf_dir), "scan-balanced"))
    return found.groupBy("log_type").agg(F.count(F.lit(1)).alias("n"))


@query("json_report", ["e_both"], "SELECT stream_id, seq, rule_id, category, threat_level, description FROM e_both")
def json_report(spark, sf_dir):
    """Events written as JSON lines and read back."""
    path = folder(spark, "json")
    columns = ["stream_id", "seq", "rule_id", "category", "threat_level", "description"]
    sinks.write_json(rule_queries.mixed_events(spark, sf_dir).select(*columns), path)
    schema = "stream_id string, seq bigint, rule_id string, category string, threat_level string, description string"
    return spark.read.schema(schema).json(path)


@query("timeline_head", ["t_auth"], """SELECT row_number() OVER (ORDER BY ts, stream_id, seq) AS position, stream_id, seq, attack_type, threat_level FROM t_auth
    QUALIFY position <= 100""")
def timeline_head(spark, sf_dir):
    """The first hundred events of the report's timeline."""
    head = report.timeline_head(rule_queries.auth_timeline(spark, sf_dir), 100)
    return head.select("position", "stream_id", "seq", "attack_type", "threat_level")


@query("timeline_text", ["t_auth"], """SELECT strftime(ts, '%Y-%m-%d %H:%M:%S') || ' [' || threat_level || '] ' || attack_type || ' ' || coalesce(source_ip, '-') || ' ' || raw AS value, count(*) AS n
    FROM t_auth GROUP BY ALL""")
def timeline_text(spark, sf_dir):
    """The whole timeline as text, written and read back."""
    path = folder(spark, "timeline")
    sinks.write_timeline(rule_queries.auth_timeline(spark, sf_dir), path)
    return spark.read.text(path).groupBy("value").agg(F.count(F.lit(1)).alias("n"))


@query("severe_list", ["t_auth"], "SELECT stream_id, seq, attack_type, threat_level FROM t_auth")
def severe_list(spark, sf_dir):
    """All events of the timeline, the most severe first."""
    return sinks.severe_first(rule_queries.auth_timeline(spark, sf_dir)).select("stream_id", "seq", "attack_type", "threat_level")


@query("rule_packs", (), """SELECT n_name, n_nationkey % 7 <> 3 AS accepted, CASE WHEN n_nationkey % 7 = 3 THEN 0 WHEN n_nationkey % 7 = 5 THEN 2 ELSE 1 END::BIGINT AS n_rules,
    n_nationkey % 7 = 3 AS has_error, CASE WHEN n_nationkey % 7 = 3 THEN 0 ELSE (SELECT count(*) FROM customer WHERE c_nationkey = n_nationkey) END AS hits FROM nation""")
def rule_packs(spark, sf_dir):
    """A rule file per nation, written to the shared folder, some broken and some with two rules; the accepted ones then read all customers' lines."""
    nations = views.table(spark, sf_dir, "nation", "n_nationkey", "n_name")
    number, name = F.col("n_nationkey") % 7, F.col("n_name")
    rule = F.concat(F.lit('name: "of '), name, F.lit('"\nseverity: low\npattern:\n  raw: "customer \\\\d+ of '), name, F.lit('$"\n'))
    text_of = F.when(number == 3, F.lit("name: [never closed\n")).when(number == 5, F.concat(rule, F.lit("---\nname: never\npattern:\n  raw: no such line\n"))).otherwise(rule)
    path = folder(spark, "rule-packs")
    nations.select(name, text_of.alias("value")).repartition("n_name").write.partitionBy("n_name").text(path)
    outcomes = materialize(rule_files.read_rule_files(spark, path, "*.txt"), "rule-outcomes")
    customers = views.table(spark, sf_dir, "customer", "c_custkey", "c_nationkey").join(nations, F.col("c_nationkey") == F.col("n_nationkey"))
    lines = customers.select(
        F.lit("customers").alias("stream_id"), F.col("c_custkey").alias("seq"), F.concat(F.lit("customer "), F.col("c_custkey").cast("string"), F.lit(" of "), name).alias("raw")
    )
    found = match.match_rules(lines, rule_files.accepted_rules(outcomes))
    hits = found.groupBy(F.regexp_extract("rule_id", "^of (.*)$", 1).alias("n_name")).agg(F.count(F.lit(1)).alias("hits"))
    named = outcomes.withColumn("n_name", F.url_decode(F.regexp_extract("file", "n_name=([^/]+)/", 1)))
    return named.join(hits, "n_name", "left").select(
        "n_name", "accepted", "n_rules", F.col("error").isNotNull().alias("has_error"), F.coalesce("hits", F.lit(0)).alias("hits")
    )
