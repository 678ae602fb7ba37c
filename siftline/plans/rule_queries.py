"""Queries on rule matching, event statistics, risk, advice, timelines and chains."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import formats
from ..functions.levels import score_label
from ..operators import chains, events, match, report, timeline
from ..operators.sequences import dense_position
from ..packs import dimensions
from ..packs import timeline as timeline_pack
from ..packs import unified as unified_pack
from ..session import materialize
from . import line_queries, views  # noqa: F401  (defines check steps used here)
from .line_queries import YEAR
from .registry import query
from .views import define, q

# --- check SQL ------------------------------------------------------------------------------------------


def pattern_sql(pattern: str, text: str = "raw") -> str:
    return f"regexp_matches({text}, {q('(?i)' + pattern)})"


def values_sql(rules) -> str:
    rows = ", ".join(
        f"({i}, {q(r.rule_id)}, {q(r.category)}, {q(r.level.upper())}, {q(r.mitre)}, {float(r.confidence)}::DOUBLE, {q(r.description)}, {q(r.remediation)}, {q(r.label)})"
        for i, r in enumerate(rules)
    )
    return f"SELECT * FROM (VALUES {rows}) r(ord, rule_id, category, threat_level, mitre, confidence, description, remediation, label)"


def hits_sql(source: str, tests) -> str:
    """SQL that unfolds the positions of all tests that hold."""
    array = ", ".join(f"CASE WHEN {t} THEN {i} END" for i, t in enumerate(tests))
    return f"SELECT * FROM (SELECT *, unnest([{array}]) AS ord FROM {source}) WHERE ord IS NOT NULL"


def field_test(rule) -> str:
    parts = []
    for name, pattern in rule.patterns.items():
        if name != "user_agent":
            parts.append(pattern_sql(pattern, "req" if name in ("url", "params") else "raw"))
    return "(" + " OR ".join(parts) + ")"


define("r_v3", (), values_sql(match.pack_v3()))
define("r_v2", (), values_sql(match.pack_v2()))
define("r_fields", (), values_sql(match.pack_fields()))
define("r_both", (), values_sql(match.pack_v3() + match.pack_fields()))
define("r_signatures", (), values_sql(match.pack_signatures()))
define("s_req", ("f_sec",), "SELECT *, coalesce(nullif(request, ''), nullif(message, ''), raw) AS req FROM f_sec")
define("m_both", ("s_req",), hits_sql("s_req", [
    pattern_sql(r.patterns["raw"]) if "raw" in r.patterns else field_test(r) for r in match.pack_v3() + match.pack_fields()
]))
define("e_both", ("m_both", "r_both"), """SELECT stream_id, seq, raw, source_ip, hostname, event_id, ts_text, rule_id, category, threat_level,
    mitre, confidence, description, remediation, label, CASE threat_level WHEN 'CRITICAL' THEN 10.0::DOUBLE WHEN 'HIGH' THEN 7.5::DOUBLE WHEN 'LOW' THEN 2.5::DOUBLE
    WHEN 'INFO' THEN 1.0::DOUBLE ELSE 5.0::DOUBLE END AS threat_score, ord FROM m_both JOIN r_both USING (ord)""")
define("m_v2", ("v_auth",), hits_sql("v_auth", [pattern_sql(r.patterns["raw"]) for r in match.pack_v2()]))


def groups_sql() -> str:
    """The first capture group made of digits and dots, per rule."""
    branches = []
    for i, r in enumerate(match.pack_v2()):
        groups = match.re_groups(r.patterns["raw"])
        values = [f"regexp_extract(raw, {q('(?i)' + r.patterns['raw'])}, {g})" for g in range(1, groups + 1)]
        if values:
            tests = ", ".join(f"CASE WHEN regexp_matches({v}, '^[\\d.]+$') THEN {v} END" for v in values)
            branches.append(f"WHEN {i} THEN coalesce({tests})" if len(values) > 1 else f"WHEN {i} THEN {tests}")
    return f"CASE ord {' '.join(branches)} END"


define("e_v2", ("m_v2", "r_v2"), f"""SELECT stream_id, seq, raw, {groups_sql()} AS source_ip, rule_id, category, threat_level, mitre, confidence
    FROM m_v2 JOIN r_v2 USING (ord)""")
define("d_rep", (), "SELECT * FROM (VALUES " + ", ".join(
    f"({q(ip)}, {q(kind)}, {q('|'.join(tags))})" for ip, kind, tags in dimensions.IP_REPUTATION) + ") t(source_ip, reputation, tags)")
define("e_inc", ("e_v2", "d_rep"), """SELECT e.* EXCLUDE (threat_level), CASE WHEN reputation = 'malicious' THEN 'CRITICAL' ELSE threat_level END AS threat_level,
    reputation, tags FROM e_v2 e LEFT JOIN d_rep d ON e.source_ip = d.source_ip""")
RANK_SQL = "CASE threat_level WHEN 'CRITICAL' THEN 0 WHEN 'HIGH' THEN 1 WHEN 'MEDIUM' THEN 2 WHEN 'LOW' THEN 3 WHEN 'INFO' THEN 4 ELSE 5 END"


def first_sql(pack: str, source: str) -> str:
    rows = match.first_match_pack(pack)
    cases = " ".join(f"WHEN {pattern_sql(p)} THEN {i}" for i, (_, _, p) in enumerate(rows))
    return f"SELECT *, CASE {cases} END AS ord FROM {source}"


for _pack in ("timeline", "unified"):
    define(f"r_{_pack}", (), "SELECT * FROM (VALUES " + ", ".join(
        f"({i}, {q(k)}, {q(lv)}, {q(p)})" for i, (k, lv, p) in enumerate(match.first_match_pack(_pack))
    ) + ") r(ord, rule_type, rule_level, matched_pattern)")
    define(f"d_win_{_pack}", (), "SELECT * FROM (VALUES " + ", ".join(
        f"({i}::BIGINT, {q(lv)}, {q(k)}, {q(d)})" for i, lv, k, d in
        {"timeline": timeline_pack, "unified": unified_pack}[_pack].WINDOWS_EVENTS
    ) + ") w(event_id, win_level, win_type, description)")
define("c_auth", ("v_auth",), first_sql("timeline", "v_auth"))
define("t_auth", ("c_auth", "r_timeline"), rf"""SELECT stream_id, seq, raw,
    strptime('{YEAR} ' || regexp_extract(raw, {q(formats.SYSLOG)}, 1), '%Y %b %d %H:%M:%S') AS ts,
    regexp_extract(raw, {q(formats.SYSLOG)}, 2) AS target, nullif(regexp_extract(raw, {q(formats.FROM_IP)}, 1), '') AS source_ip,
    coalesce(rule_type, 'unknown') AS attack_type, coalesce(rule_level, 'INFO') AS threat_level, matched_pattern
    FROM c_auth LEFT JOIN r_timeline USING (ord) WHERE regexp_matches(raw, {q(formats.SYSLOG)})""")


def windows_sql(pack: str) -> str:
    return f"""SELECT stream_id, seq, raw, p.ts AS ts, event_id, coalesce(win_type, rule_type, 'unknown') AS attack_type,
    CASE WHEN win_type IS NOT NULL AND event_id = 4625 AND win_log_level = 'Error' THEN 'HIGH' ELSE coalesce(win_level, rule_level, 'INFO') END AS threat_level,
    description FROM (SELECT *, regexp_extract(raw, {q(formats.WINDOWS)}, 1)::TIMESTAMP AS ts, regexp_extract(raw, {q(formats.WINDOWS)}, 3)::BIGINT AS event_id,
    regexp_extract(raw, {q(formats.WINDOWS)}, 2) AS win_log_level FROM c_win_{pack}) p LEFT JOIN r_{pack} USING (ord) LEFT JOIN d_win_{pack} USING (event_id)"""


for _pack in ("timeline", "unified"):
    define(f"c_win_{_pack}", ("v_win",), first_sql(_pack, "v_win"))
    define(f"t_win_{_pack}", (f"c_win_{_pack}", f"r_{_pack}", f"d_win_{_pack}"), windows_sql(_pack))


# --- shared parts ---------------------------------------------------------------------------------------

def rules_both():
    return match.pack_v3() + match.pack_fields()


def mixed_events(spark, sf_dir):
    """Events of the line and field rules over all layouts; stored, as many statistics read them."""
    found = match.match_rules(views.mixed_lines(spark, sf_dir), rules_both())
    return materialize(events.with_score(found), "events")


def lazy_events(spark, sf_dir):
    """The same without storing, for a single statistic."""
    return events.with_score(match.match_rules(views.mixed_lines(spark, sf_dir), rules_both()))


def incidents(spark, sf_dir):
    return events.with_reputation(match.match_incident_rules(views.auth_lines(spark, sf_dir)))


def auth_timeline(spark, sf_dir):
    return timeline.timeline_events(views.auth_lines(spark, sf_dir), "linux", YEAR)


def windows_timeline(spark, sf_dir, pack="timeline"):
    return timeline.timeline_events(views.windows_lines(spark, sf_dir), "windows", pack=pack)


# --- rules ----------------------------------------------------------------------------------------------

define("c_web", ("e_both",), """SELECT category, count(*) AS n, count_if(threat_level = 'CRITICAL')::BIGINT AS critical, count_if(threat_level = 'HIGH')::BIGINT AS high,
    count_if(threat_level = 'MEDIUM')::BIGINT AS medium FROM e_both WHERE starts_with(stream_id, 'web') GROUP BY category""")


@query("attack_overview", ["c_web"], """SELECT category, n, critical, high, medium, (SELECT CASE WHEN sum(critical) > 0 THEN 'CRITICAL' WHEN sum(high) > 10 THEN 'HIGH'
    WHEN sum(n) > 0 THEN 'MEDIUM' ELSE 'SAFE' END FROM c_web) AS risk_level FROM c_web ORDER BY n DESC, category LIMIT 10""")
def attack_overview(spark, sf_dir):
    """Top categories with their levels, next to the overall risk, for the access lines."""
    found = match.match_rules(views.access_lines(spark, sf_dir), rules_both())
    level = F.col("threat_level")
    counts = found.groupBy("category").agg(
        F.count(F.lit(1)).alias("n"), F.count_if(level == "CRITICAL").alias("critical"),
        F.count_if(level == "HIGH").alias("high"), F.count_if(level == "MEDIUM").alias("medium"),
    )
    counts = materialize(counts, "overview")
    risk = counts.agg(
        report.risk_events(F.sum("critical"), F.sum("high"), F.sum("n")).alias("risk_level")
    )
    return report.top(counts, "category").join(F.broadcast(risk))


@query("rules_multi", ["e_both"], """SELECT stream_id, seq, rule_id, category, threat_level, confidence, source_ip, description FROM e_both
    WHERE rule_id IN (SELECT rule_id FROM r_v3)""".replace("(SELECT rule_id FROM r_v3)", "(" + ", ".join(q(r.rule_id) for r in match.pack_v3()) + ")"))
def rules_multi(spark, sf_dir):
    found = match.match_rules(views.mixed_lines(spark, sf_dir), match.pack_v3())
    return found.select("stream_id", "seq", "rule_id", "category", "threat_level", "confidence", "source_ip", "description")


@query("rules_fields", ["e_both"], "SELECT stream_id, seq, rule_id, category, threat_level, confidence, description, label FROM e_both WHERE rule_id IN ("
       + ", ".join(q(r.rule_id) for r in match.pack_fields()) + ")")
def rules_fields(spark, sf_dir):
    found = match.match_rules(views.mixed_lines(spark, sf_dir), match.pack_fields())
    return found.select("stream_id", "seq", "rule_id", "category", "threat_level", "confidence", "description", "label")


@query("rules_incidents", ["e_v2"], "SELECT stream_id, seq, rule_id, category, threat_level, mitre, source_ip FROM e_v2")
def rules_incidents(spark, sf_dir):
    found = match.match_incident_rules(views.auth_lines(spark, sf_dir))
    return found.select("stream_id", "seq", "rule_id", "category", "threat_level", "mitre", "source_ip")


define("v_bulk_m", ("v_bulk",), hits_sql("v_bulk", [pattern_sql(r.patterns["raw"]) for r in match.pack_v2()]))


@query("rules_bulk", ["v_bulk_m", "r_v2"], """SELECT stream_id, rule_id, category, count(*) AS n FROM v_bulk_m JOIN r_v2 USING (ord) GROUP BY ALL""")
def rules_bulk(spark, sf_dir):
    found = match.match_incident_rules(views.bulk_lines(spark, sf_dir))
    return found.groupBy("stream_id", "rule_id", "category").agg(F.count(F.lit(1)).alias("n"))


define("m_sig", ("v_access",), hits_sql("v_access", [pattern_sql(r.patterns["raw"]) for r in match.pack_signatures()]))


@query("rules_signatures", ["m_sig", "r_signatures"], "SELECT rule_id, category, count(*) AS n FROM m_sig JOIN r_signatures USING (ord) GROUP BY ALL")
def rules_signatures(spark, sf_dir):
    found = match.match_rules(views.access_lines(spark, sf_dir), match.pack_signatures())
    return found.groupBy("rule_id", "category").agg(F.count(F.lit(1)).alias("n"))


define("c_mixed", ("v_mixed",), first_sql("timeline", "v_mixed"))
define("c_mixed_u", ("v_mixed",), first_sql("unified", "v_mixed"))


@query("rules_first", ["c_mixed", "r_timeline"], "SELECT rule_type AS attack_type, rule_level AS threat_level, matched_pattern, count(*) AS n FROM c_mixed JOIN r_timeline USING (ord) GROUP BY ALL")
def rules_first(spark, sf_dir):
    found = match.first_match(views.mixed_lines(spark, sf_dir), match.first_match_pack("timeline"))
    return found.filter(F.col("attack_type").isNotNull()).groupBy("attack_type", "threat_level", "matched_pattern").agg(F.count(F.lit(1)).alias("n"))


@query("rules_first_unified", ["c_mixed_u", "r_unified"], "SELECT rule_type AS attack_type, rule_level AS threat_level, matched_pattern, count(*) AS n FROM c_mixed_u JOIN r_unified USING (ord) GROUP BY ALL")
def rules_first_unified(spark, sf_dir):
    found = match.first_match(views.mixed_lines(spark, sf_dir), match.first_match_pack("unified"))
    return found.filter(F.col("attack_type").isNotNull()).groupBy("attack_type", "threat_level", "matched_pattern").agg(F.count(F.lit(1)).alias("n"))


define("m_docs", (), hits_sql("(SELECT doc_id, text AS raw FROM documents)", [pattern_sql(r.patterns["raw"].replace(r"\w", r"[\p{L}\p{M}\p{N}_]") if r"[^\w" not in r.patterns["raw"] else r.patterns["raw"]) for r in match.pack_v3()]))


@query("rules_documents", ["m_docs", "r_v3"], "SELECT doc_id, rule_id FROM m_docs JOIN r_v3 USING (ord)")
def rules_documents(spark, sf_dir):
    """Line rules over whole texts."""
    documents = views.table(spark, sf_dir, "documents", "doc_id", "text").withColumnRenamed("text", "raw")
    return match.match_rules(documents, match.pack_v3()).select("doc_id", "rule_id")


DECODE_ROUNDS = 3
define("s_decoded", ("v_encoded",), r"""SELECT *, regexp_extract(raw, '"([^"]*)"', 1) AS req, url_decode(url_decode(url_decode(raw))) AS dec,
    url_decode(url_decode(url_decode(req))) AS dreq FROM v_encoded""")


def decoded_test(rule) -> str:
    """The rule's test on the line and its request, as they stand and decoded."""
    tests = []
    for name, pattern in rule.patterns.items():
        if name != "user_agent":
            tests += [pattern_sql(pattern, column) for column in (("req", "dreq") if name in ("url", "params") else ("raw", "dec"))]
    return "(" + " OR ".join(tests or ["false"]) + ")"


define("m_decoded", ("s_decoded",), hits_sql("s_decoded", [decoded_test(r) for r in match.pack_v3() + match.pack_fields()]))


@query("rules_decoded", ["m_decoded", "r_both"], "SELECT stream_id, seq, rule_id, category, threat_level FROM m_decoded JOIN r_both USING (ord)")
def rules_decoded(spark, sf_dir):
    """Line and field rules over access lines whose paths were percent-encoded up to four times, decoded up to three times."""
    found = match.match_rules(views.encoded_lines(spark, sf_dir), rules_both(), decode_rounds=DECODE_ROUNDS)
    return found.select("stream_id", "seq", "rule_id", "category", "threat_level")


def phrase_rules(spark, sf_dir):
    """A rule table made from the benchmark, four patterns for every three neighbouring words: (rule_id, pattern)."""
    words = F.regexp_extract_all("text", F.lit("[A-Za-z]+"), 0)
    items = views.table(spark, sf_dir, "benchmark", "text").select(words.alias("w"))
    three = items.select(F.explode(F.arrays_zip("w", F.expr("slice(w, 2, size(w))").alias("w2"), F.expr("slice(w, 3, size(w))").alias("w3"))).alias("t"))
    a, b, c = (F.lower(F.col(f"t.{n}")) for n in ("w", "w2", "w3"))
    space = F.lit(r"\s+")
    shapes = (F.concat(a, space, b), F.concat(b, F.lit("[,.]"), space, c), F.concat(a, space, F.lit("[a-z]+"), space, c), F.concat(a, space, b, space, c))
    rules = three.filter("t.w3 IS NOT NULL").select(F.explode(F.array(*shapes)).alias("pattern")).distinct()
    return rules.select(F.md5("pattern").alias("rule_id"), "pattern")


define("p_words", (), r"""SELECT lower(w[i]) AS a, lower(w[i + 1]) AS b, lower(w[i + 2]) AS c FROM (SELECT w, unnest(range(1, len(w) - 1)) AS i
    FROM (SELECT regexp_extract_all(text, '[A-Za-z]+') AS w FROM benchmark))""")
define("p_rules", ("p_words",), r"""SELECT md5(pattern) AS rule_id, pattern, min(needed) AS needed FROM (
    SELECT a || '\s+' || b AS pattern, CASE WHEN len(b) > len(a) THEN b ELSE a END AS needed FROM p_words UNION ALL SELECT b || '[,.]\s+' || c, CASE WHEN len(c) > len(b) THEN c ELSE b END FROM p_words
    UNION ALL SELECT a || '\s+[a-z]+\s+' || c, CASE WHEN len(c) > len(a) THEN c ELSE a END FROM p_words UNION ALL SELECT a || '\s+' || b || '\s+' || c, b FROM p_words) GROUP BY pattern""")
define("p_hits", ("p_rules",), """SELECT rule_id, doc_id FROM (SELECT doc_id, text, lower(text) AS low FROM documents) d, p_rules r
    WHERE CASE WHEN contains(low, needed) THEN regexp_matches(text, '(?i)' || pattern) ELSE false END""")


@query("rules_dynamic", ["p_hits"], "SELECT rule_id, count(*) AS n_docs, min(doc_id) AS first_doc FROM p_hits GROUP BY rule_id")
def rules_dynamic(spark, sf_dir):
    """Rules made from the benchmark at run time, thousands of them, over all documents in one scan."""
    documents = views.table(spark, sf_dir, "documents", "doc_id", "text").withColumnRenamed("text", "raw")
    found = match.match_dynamic(documents, phrase_rules(spark, sf_dir))
    return found.groupBy("rule_id").agg(F.count(F.lit(1)).alias("n_docs"), F.min("doc_id").alias("first_doc"))


@query("eventid_join", ["t_win_timeline"], "SELECT stream_id, seq, event_id, attack_type, threat_level, description FROM t_win_timeline")
def eventid_join(spark, sf_dir):
    return windows_timeline(spark, sf_dir).select(
        "stream_id", "seq", F.col("event_id").cast("bigint").alias("event_id"), "attack_type", "threat_level", "description"
    )


@query("eventid_join_unified", ["t_win_unified"], "SELECT event_id, attack_type, threat_level, count(*) AS n FROM t_win_unified GROUP BY ALL")
def eventid_join_unified(spark, sf_dir):
    rows = windows_timeline(spark, sf_dir, "unified")
    return rows.groupBy(F.col("event_id").cast("bigint").alias("event_id"), "attack_type", "threat_level").agg(F.count(F.lit(1)).alias("n"))


@query("ip_reputation", ["e_inc"], "SELECT stream_id, seq, rule_id, source_ip, threat_level, reputation, tags FROM e_inc")
def ip_reputation(spark, sf_dir):
    return incidents(spark, sf_dir).select(
        "stream_id", "seq", "rule_id", "source_ip", "threat_level", "reputation", F.array_join("tags", "|").alias("tags")
    )


define("d_rem", (), "SELECT * FROM (VALUES " + ", ".join(f"({q(c)}, {q(a)})" for c, a in dimensions.REMEDIATION) + ") t(category, advice)")


@query("remediation", ["e_both", "d_rem"], f"SELECT category, coalesce(nullif(e_both.remediation, ''), advice, {q(dimensions.REMEDIATION_DEFAULT)}) AS remediation, count(*) AS n FROM e_both LEFT JOIN d_rem USING (category) GROUP BY ALL")
def remediation(spark, sf_dir):
    return events.with_remediation(lazy_events(spark, sf_dir)).groupBy("category", "remediation").agg(F.count(F.lit(1)).alias("n"))


@query("score_labels", ["e_both"], """SELECT threat_score, CASE WHEN threat_score >= 10 THEN 'CRITICAL' WHEN threat_score >= 7.5 THEN 'HIGH' WHEN threat_score >= 5 THEN 'MEDIUM' ELSE 'LOW' END AS label,
    count(*) AS n FROM e_both GROUP BY ALL""")
def score_labels(spark, sf_dir):
    scored = lazy_events(spark, sf_dir)
    return scored.groupBy("threat_score", score_label(F.col("threat_score")).alias("label")).agg(F.count(F.lit(1)).alias("n"))


@query("severe_events", ["e_both"], "SELECT stream_id, seq, rule_id, substr(raw, 1, 200) AS raw FROM e_both WHERE threat_level IN ('CRITICAL', 'HIGH')")
def severe_events(spark, sf_dir):
    found = lazy_events(spark, sf_dir).filter(events.severe(F.col("threat_level")))
    return found.select("stream_id", "seq", "rule_id", F.substring("raw", 1, 200).alias("raw"))


# --- statistics -----------------------------------------------------------------------------------------

@query("category_counts", ["e_both"], "SELECT category, count(*) AS n FROM e_both GROUP BY 1")
def category_counts(spark, sf_dir):
    return report.count_by(lazy_events(spark, sf_dir), "category")


@query("level_counts", ["e_both"], "SELECT threat_level, count(*) AS n FROM e_both GROUP BY 1")
def level_counts(spark, sf_dir):
    return report.count_by(lazy_events(spark, sf_dir), "threat_level")


@query("top_ips", ["e_both"], "SELECT source_ip, count(*) AS n FROM e_both WHERE source_ip IS NOT NULL GROUP BY 1 ORDER BY n DESC, source_ip LIMIT 10")
def top_ips(spark, sf_dir):
    return report.top(report.count_by(lazy_events(spark, sf_dir), "source_ip"), "source_ip")


@query("category_share", ["e_both"], """SELECT row_number() OVER (ORDER BY n DESC, category) AS rank, category, n, round(n * 100.0::DOUBLE / (SELECT count(*) FROM e_both), 1) AS share
    FROM (SELECT category, count(*) AS n FROM e_both GROUP BY 1) ORDER BY n DESC, category LIMIT 10""")
def category_share(spark, sf_dir):
    return report.category_share(mixed_events(spark, sf_dir))


define("l_both", ("e_both",), """SELECT count(*) AS total, count_if(threat_level = 'CRITICAL')::BIGINT AS critical, count_if(threat_level = 'HIGH')::BIGINT AS high,
    count_if(threat_level = 'MEDIUM')::BIGINT AS medium FROM e_both""")
define("l_inc", ("e_inc",), """SELECT count(*) AS total, count_if(threat_level = 'CRITICAL')::BIGINT AS critical, count_if(threat_level = 'HIGH')::BIGINT AS high,
    count_if(threat_level = 'MEDIUM')::BIGINT AS medium FROM e_inc""")


@query("risk_v3", ["l_both"], "SELECT *, CASE WHEN critical > 0 THEN 'CRITICAL' WHEN high > 10 THEN 'HIGH' WHEN total > 0 THEN 'MEDIUM' ELSE 'SAFE' END AS risk_level FROM l_both")
def risk_v3(spark, sf_dir):
    return report.risk_of_events(lazy_events(spark, sf_dir))


@query("risk_v2", ["l_inc"], """SELECT *, CASE WHEN critical > 0 OR high > 10 THEN 'CRITICAL' WHEN high > 0 OR medium > 20 THEN 'HIGH' WHEN medium > 0 THEN 'MEDIUM' ELSE 'INFO' END AS risk_level FROM l_inc""")
def risk_v2(spark, sf_dir):
    return report.risk_of_incidents(incidents(spark, sf_dir))


@query("threat_score", ["l_both"], "SELECT *, round(least(10.0, (critical * 3 + high * 1.5 + medium * 0.5)::DOUBLE / greatest(1.0, total / 100)), 1)::DOUBLE AS threat_score FROM l_both")
def threat_score(spark, sf_dir):
    return report.score_of(lazy_events(spark, sf_dir))


@query("report_summary", ["l_both"], f"SELECT total AS total_events, critical AS critical_events, high AS high_events, {len(match.pack_v3()) + len(match.pack_fields())}::BIGINT AS rules_loaded FROM l_both")
def report_summary(spark, sf_dir):
    return report.summary(lazy_events(spark, sf_dir), rules=len(rules_both()))


@query("report_summary_incidents", ["l_inc"], f"SELECT total AS total_events, critical + high AS critical_events, high AS high_events, {len(match.pack_v2())}::BIGINT AS rules_loaded FROM l_inc")
def report_summary_incidents(spark, sf_dir):
    return report.summary(incidents(spark, sf_dir), rules=len(match.pack_v2()), severe_counts=True)


def advice_sql(name: str, counts: str) -> str:
    advice, none_text = report.ADVICE[name]
    rows = ", ".join(f"({i}, {q(c)}, {above}, {q(s)}, {q(t)})" for i, (c, above, s, t) in enumerate(advice))
    found = f"""SELECT ord::BIGINT AS ord, severity, category, n::VARCHAR || ' events of ' || category AS finding, recommendation
        FROM (VALUES {rows}) a(ord, category, above, severity, recommendation) JOIN ({counts}) USING (category) WHERE n > above"""
    if none_text is None:
        return found
    return f"{found} UNION ALL SELECT 0, 'INFO', '', '', {q(none_text)} WHERE NOT EXISTS ({found})"


def advised(counts, name):
    return report.recommendations(counts, *report.ADVICE[name]).withColumn("ord", F.col("ord").cast("bigint"))


@query("recommendations", ["e_both"], advice_sql("events", "SELECT category, count(*) AS n FROM e_both GROUP BY 1"))
def recommendations(spark, sf_dir):
    return advised(report.count_by(mixed_events(spark, sf_dir), "category"), "events")


@query("recommendations_incidents", ["e_inc"], advice_sql("incidents", "SELECT category, count(*) AS n FROM e_inc GROUP BY 1"))
def recommendations_incidents(spark, sf_dir):
    return advised(report.count_by(incidents(spark, sf_dir), "category"), "incidents")


@query("recommendations_timeline", ["t_auth"], advice_sql("timeline", "SELECT attack_type AS category, count(*) AS n FROM t_auth GROUP BY 1"))
def recommendations_timeline(spark, sf_dir):
    counts = report.count_by(auth_timeline(spark, sf_dir), "attack_type").withColumnRenamed("attack_type", "category")
    return advised(materialize(counts, "type-counts"), "timeline")


@query("critical_top", ["e_both"], """SELECT stream_id, seq, rule_id, threat_score, substr(raw, 1, 200) AS raw FROM e_both ORDER BY threat_score DESC, stream_id, seq, ord LIMIT 100""")
def critical_top(spark, sf_dir):
    found = lazy_events(spark, sf_dir).orderBy(F.desc("threat_score"), "stream_id", "seq", "ord").limit(100)
    return found.select("stream_id", "seq", "rule_id", "threat_score", F.substring("raw", 1, 200).alias("raw"))


@query("critical_incidents", ["e_inc"], f"""SELECT stream_id, seq, rule_id, threat_level FROM e_inc WHERE threat_level IN ('CRITICAL', 'HIGH')
    ORDER BY {RANK_SQL}, seq, stream_id, rule_id LIMIT 50""")
def critical_incidents(spark, sf_dir):
    severe = incidents(spark, sf_dir).filter(events.severe(F.col("threat_level")))
    return report.critical_first(severe, ["seq", "stream_id", "rule_id"], 50).select("stream_id", "seq", "rule_id", "threat_level")


# --- timelines and chains -------------------------------------------------------------------------------

@query("timeline", ["t_auth"], """SELECT stream_id, row_number() OVER (PARTITION BY stream_id ORDER BY ts, seq) AS position, seq, strftime(ts, '%Y-%m-%d %H:%M:%S') AS ts, source_ip,
    target, attack_type, threat_level FROM t_auth""")
def timeline_query(spark, sf_dir):
    rows = auth_timeline(spark, sf_dir)
    numbered = dense_position(
        rows, ["stream_id"], ["ts", "timeline_order"], F.substring(F.col("ts").cast("string"), 1, 15), "position"
    )
    return numbered.select(
        "stream_id", "position", "seq", F.substring(F.col("ts").cast("string"), 1, 19).alias("ts"), "source_ip", "target",
        "attack_type", "threat_level",
    )


@query("timeline_details", ["t_auth"], r"""SELECT stream_id, seq, 'hostname=' || target || ';matched_pattern=' || coalesce(matched_pattern, '') AS details FROM t_auth""")
def timeline_details(spark, sf_dir):
    d = F.col("details")
    return auth_timeline(spark, sf_dir).select(
        "stream_id", "seq",
        F.concat(F.lit("hostname="), d["hostname"], F.lit(";matched_pattern="), F.coalesce(d["matched_pattern"], F.lit(""))).alias("details"),
    )


@query("timeline_types", ["t_auth"], """SELECT attack_type, min(seq) AS seq FROM t_auth GROUP BY 1 ORDER BY 2 LIMIT 5""")
def timeline_types(spark, sf_dir):
    return report.first_types(auth_timeline(spark, sf_dir), "attack_type", ["seq"])


STAGES = dict(dimensions.CHAIN_STAGES)
_stage = "CASE category " + " ".join(f"WHEN {q(c)} THEN {q(s)}" for c, s in STAGES.items()) + " END"
define("e_stage", ("e_inc",), f"SELECT *, {_stage} AS stage FROM e_inc WHERE source_ip IS NOT NULL AND {_stage} IS NOT NULL")
define("s_first", ("e_stage",), "SELECT source_ip, stage, min(seq) AS f FROM e_stage GROUP BY ALL")
define("s_order", ("s_first",), "SELECT source_ip, string_agg(stage, '>' ORDER BY f, stage) AS stages_in_order FROM s_first GROUP BY 1")


@query("attack_chains", ["e_stage", "s_order"], """SELECT 'CHAIN_' || replace(source_ip, '.', '') AS chain_id, source_ip, CASE WHEN count_if(stage = 'exfiltration') > 0 THEN 'CRITICAL' ELSE 'MEDIUM' END AS threat_level,
    count(*) AS n_stages, count_if(stage = 'initial_access')::BIGINT AS initial_access, count_if(stage = 'lateral_movement')::BIGINT AS lateral_movement, any_value(stages_in_order) AS stages_in_order
    FROM e_stage JOIN s_order USING (source_ip) GROUP BY source_ip HAVING count(*) >= 2""")
def attack_chains(spark, sf_dir):
    return chains.attack_chains(incidents(spark, sf_dir)).select(
        "chain_id", "source_ip", "threat_level", "n_stages", "initial_access", "lateral_movement",
        F.array_join("stages_in_order", ">").alias("stages_in_order"),
    )


@query("chain_stages", ["e_stage"], """SELECT source_ip, stage, rule_id, seq, stage_no, n_stages FROM (SELECT *, row_number() OVER (PARTITION BY source_ip ORDER BY seq, rule_id) AS stage_no,
    count(*) OVER (PARTITION BY source_ip) AS n_stages FROM e_stage) WHERE n_stages >= 2""")
def chain_stages(spark, sf_dir):
    rows = chains.chain_stages(incidents(spark, sf_dir), ["seq", "rule_id"], F.floor(F.col("seq") / 1000))
    return rows.select("source_ip", "stage", "rule_id", "seq", "stage_no", "n_stages")


# Failed logins per source address, with a clock that runs 5,000 times as fast, so that the spread-out failures come in bursts.
BURST = 5000
BURST_FROM = 1_704_067_200_000_000  # the start of 2024 in microseconds
define("t_burst", ("v_auth",), rf"""SELECT make_timestamp({BURST_FROM} + (epoch_us(ts) - {BURST_FROM}) // {BURST}) AS ts, nullif(regexp_extract(raw, 'from\s+([\d.]+)', 1), '') AS source_ip
    FROM v_auth WHERE contains(raw, 'Failed password')""")
define("t_brute", ("t_burst",), """SELECT strftime(time_bucket(INTERVAL 5 MINUTE, ts), '%Y-%m-%d %H:%M:%S') AS window_start, source_ip, count(*) AS failures, count(*) >= 10 AS lockout
    FROM t_burst WHERE source_ip IS NOT NULL GROUP BY ALL HAVING count(*) >= 5""")


def login_failures(lines):
    """(ts, source_ip) of the failed logins of auth lines with their time, in bursts."""
    micros = F.unix_micros(F.col("ts").cast("timestamp")) - BURST_FROM
    failed = lines.filter(F.col("raw").contains("Failed password")).select(
        F.timestamp_micros(F.lit(BURST_FROM) + F.floor(micros / BURST).cast("bigint")).alias("ts"), formats.source_ip(F.col("raw")).alias("source_ip")
    )
    return failed.filter(F.col("source_ip").isNotNull())


def alert_rows(found):
    start = F.date_format("window_start", "yyyy-MM-dd HH:mm:ss")
    return found.select(start.alias("window_start"), "source_ip", "failures", "lockout")


@query("brute_force_window", ["t_auth"], """SELECT strftime(time_bucket(INTERVAL 5 MINUTE, ts), '%Y-%m-%d %H:%M:%S') AS window_start, target, count(*) AS failures, count(*) >= 10 AS lockout
    FROM t_auth WHERE attack_type = 'brute_force' GROUP BY ALL HAVING count(*) >= 1""")
def brute_force_window(spark, sf_dir):
    """Failed logins per host and five minutes; the threshold is low, as the data is spread thin."""
    failures = auth_timeline(spark, sf_dir).filter(F.col("attack_type") == "brute_force").select(
        "ts", F.col("target").alias("source_ip")
    )
    found = chains.brute_force_alerts(failures, threshold=1)
    return found.select(
        F.substring(F.col("window_start").cast("string"), 1, 19).alias("window_start"), F.col("source_ip").alias("target"),
        "failures", "lockout",
    )
