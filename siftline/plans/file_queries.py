"""Queries on file scanning and the unified risk over lines and files."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import filescan, report, timeline
from ..packs import files as pack
from ..session import materialize
from . import rule_queries, views
from .registry import query
from .views import define, q

EXT = r"regexp_extract(path, '[^/]\.([^./]+)$', 1)"


def _in(extensions) -> str:
    return "(" + ", ".join(q(e.lstrip(".")) for e in extensions) + ")"


_cases = " ".join(f"WHEN regexp_matches(content, {q('(?i)' + p)}) THEN {i}" for i, (_, _, p) in enumerate(pack.FIRST_HIT))
define("s_first_rules", (), "SELECT * FROM (VALUES " + ", ".join(
    f"({i}, {q(n)}, {c}::DOUBLE)" for i, (n, c, _) in enumerate(pack.FIRST_HIT)) + ") r(ord, pattern, confidence)")
define("s_hit", ("v_files", "s_first_rules"), f"SELECT * FROM (SELECT *, CASE {_cases} END AS ord FROM v_files WHERE lower({EXT}) IN {_in(pack.EXTENSIONS_FIRST_HIT)}) JOIN s_first_rules USING (ord)")


@query("file_scan_first", ["s_hit"], """SELECT path, pattern, confidence, length(content) AS file_size, md5(content) AS file_hash, CASE WHEN confidence >= 0.8 THEN 'HIGH' ELSE 'MEDIUM' END AS threat_level FROM s_hit""")
def file_scan_first(spark, sf_dir):
    return filescan.scan_first_hit(filescan.with_extension(views.files(spark, sf_dir), pack.EXTENSIONS_FIRST_HIT))


def _tests() -> list[tuple[str, float, str]]:
    tests = [
        (n, w, f"language = '{lang}' AND regexp_matches(content, {q('(?i)' + p)})")
        for lang, rules in pack.BY_LANGUAGE.items() for n, w, p in rules
    ]
    tests += [(f"tool {n}", w, f"regexp_matches(content, {q('(?i)' + n)})") for n, w in pack.TOOLS]
    name, weight, p = pack.ENCODED
    return tests + [(name, weight, f"regexp_matches(content, {q(p)})")]


define("s_lang", ("v_files",), f"SELECT *, CASE lower({EXT}) WHEN 'jsp' THEN 'jsp' WHEN 'asp' THEN 'asp' WHEN 'aspx' THEN 'asp' ELSE 'php' END AS language FROM v_files")
define("s_found", ("s_lang",), "SELECT *, list_filter([" + ", ".join(f"CASE WHEN {t} THEN {q(n)} END" for n, _, t in _tests())
       + "], lambda x: x IS NOT NULL) AS names, coalesce(list_max([" + ", ".join(f"CASE WHEN {t} THEN {w}::DOUBLE END" for _, w, t in _tests())
       + "]), 0.0::DOUBLE) AS confidence FROM s_lang")
define("s_score", ("s_found",), """SELECT path, content, language, confidence, CASE WHEN confidence >= 0.9 THEN 'CRITICAL' WHEN confidence >= 0.8 THEN 'HIGH' WHEN confidence >= 0.6 THEN 'MEDIUM'
    WHEN confidence >= 0.4 THEN 'LOW' ELSE 'INFO' END AS threat_level, confidence >= 0.6 AS is_webshell, array_to_string(names, '|') AS matched FROM s_found""")


@query("file_scan_score", ["s_score"], "SELECT path, language, confidence, threat_level, is_webshell, matched, length(content) AS file_size, md5(content) AS file_hash FROM s_score")
def file_scan_score(spark, sf_dir):
    return filescan.scan_by_score(views.files(spark, sf_dir)).withColumn("matched", F.array_join("matched", "|"))


@query("file_scan_stats", ["s_score"], """SELECT count(*) AS total_files, count_if(is_webshell)::BIGINT AS webshell_count, count_if(threat_level = 'CRITICAL')::BIGINT AS critical, count_if(threat_level = 'HIGH')::BIGINT AS high,
    count_if(threat_level = 'MEDIUM')::BIGINT AS medium, count_if(threat_level = 'LOW')::BIGINT AS low, count_if(threat_level = 'INFO')::BIGINT AS info FROM s_score""")
def file_scan_stats(spark, sf_dir):
    return filescan.scan_stats(filescan.scan_by_score(views.files(spark, sf_dir)))


@query("critical_files", ["s_score"], "SELECT path, confidence, threat_level FROM s_score WHERE is_webshell AND threat_level IN ('CRITICAL', 'HIGH')")
def critical_files(spark, sf_dir):
    return filescan.critical_files(filescan.scan_by_score(views.files(spark, sf_dir))).select("path", "confidence", "threat_level")


define("u_levels", ("t_win_unified", "s_score"), "SELECT threat_level FROM t_win_unified UNION ALL SELECT threat_level FROM s_score")
define("u_counts", ("u_levels",), "SELECT count_if(threat_level = 'CRITICAL')::BIGINT AS critical, count_if(threat_level = 'HIGH')::BIGINT AS high FROM u_levels")


@query("risk_unified", ["u_counts"], "SELECT critical, high, CASE WHEN critical > 0 THEN 'VERY_HIGH' WHEN high > 5 THEN 'HIGH' WHEN high > 0 THEN 'MEDIUM' ELSE 'LOW' END AS risk_level FROM u_counts")
def risk_unified(spark, sf_dir):
    """Risk over the Windows timeline and the scanned files."""
    lines = timeline.timeline_events(views.windows_lines(spark, sf_dir), "windows", pack="unified")
    return report.risk_of_both(lines, filescan.scan_by_score(views.files(spark, sf_dir)))


define("u_types", ("t_win_unified", "s_score"), """SELECT attack_type AS category, count(*) AS n FROM t_win_unified GROUP BY 1
    UNION ALL SELECT 'suspicious_files', count(*) FROM s_score WHERE is_webshell UNION ALL SELECT 'critical_files', count(*) FROM s_score WHERE threat_level = 'CRITICAL'""")


@query("recommendations_unified", ["u_types"], rule_queries.advice_sql("unified", "SELECT * FROM u_types"))
def recommendations_unified(spark, sf_dir):
    lines = timeline.timeline_events(views.windows_lines(spark, sf_dir), "windows", pack="unified")
    types = report.count_by(lines, "attack_type").withColumnRenamed("attack_type", "category")
    scanned = filescan.scan_stats(filescan.scan_by_score(views.files(spark, sf_dir)))
    files = scanned.select(
        F.explode(
            F.array(
                F.struct(F.lit("suspicious_files").alias("category"), F.col("webshell_count").alias("n")),
                F.struct(F.lit("critical_files").alias("category"), F.col("critical").alias("n")),
            )
        ).alias("c")
    ).select("c.category", "c.n")
    return rule_queries.advised(materialize(types.unionByName(files), "type-counts"), "unified")
