import datetime

from pyspark.sql import functions as F

from siftline.functions import formats

ACCESS = '10.0.0.7 - - [06/Feb/2026:10:00:00 +0800] "GET /api/users HTTP/1.1" 200 1234'


def one(spark, column, raw):
    return spark.createDataFrame([(raw,)], "raw string").select(column(F.col("raw")).alias("x")).first().x


def test_access(spark):
    p = one(spark, formats.parse_access, ACCESS + ' "-" "curl/8"')
    assert (p.ip, p.method, p.path, p.protocol, p.status, p.size, p.user_agent) == (
        "10.0.0.7", "GET", "/api/users", "HTTP/1.1", 200, 1234, "curl/8"
    )
    assert p.ts == datetime.datetime(2026, 2, 6, 10)
    assert one(spark, formats.parse_access, ACCESS).user_agent is None
    odd = one(spark, formats.parse_access, ACCESS.replace(" HTTP/1.1", ""))
    assert odd.method is None and odd.request == "GET /api/users"
    assert one(spark, formats.parse_access, ACCESS.replace("1234", "-")) is None


def test_syslog(spark):
    parse = lambda c: formats.parse_syslog(c, 2025)
    p = one(spark, parse, "Jan  5 10:11:12 host1 sshd[3]: Failed password")
    assert (p.ts, p.host, p.message) == (datetime.datetime(2025, 1, 5, 10, 11, 12), "host1", "sshd[3]: Failed password")
    p = one(spark, parse, "2024-02-03 04:05:06.7 host2: up and running")
    assert (p.ts, p.host, p.message) == (datetime.datetime(2024, 2, 3, 4, 5, 6), "host2", "up and running")
    assert one(spark, parse, "1月 20 10:00:00 host x") is None
    assert one(spark, lambda c: formats.parse_syslog(c, 2025, False), "2024-02-03 04:05:06 h m x") is None


def test_windows_and_tomcat(spark):
    w = one(spark, formats.parse_windows, "2024-01-01 10:00:00.250 Error EventID=4625 failed")
    assert (w.ts, w.level, w.event_id, w.message) == (datetime.datetime(2024, 1, 1, 10, 0, 0, 250000), "Error", 4625, "failed")
    t = one(spark, formats.parse_tomcat, "2024-01-01 10:00:00.250 [main] INFO started")
    assert (t.ts, t.thread, t.level, t.message) == (datetime.datetime(2024, 1, 1, 10), "main", "INFO", "started")
    g = one(spark, formats.parse_generic, "2024-01-01T10:00:00 [x] WARN hm")
    assert (g.tag, g.word, g.message) == ("[", "x", "] WARN hm")  # the layout is lazy


def test_security_line(spark):
    a = one(spark, formats.parse_security_line, ACCESS)
    assert (a.source_ip, a.request, a.status, a.hostname) == ("10.0.0.7", "GET /api/users HTTP/1.1", "200", None)
    s = one(spark, formats.parse_security_line, "Jan 05 10:00:00 web-1 sshd: Invalid user bob from 1.2.3.4")
    assert (s.source_ip, s.hostname, s.message) == ("1.2.3.4", "web-1", "Invalid user bob from 1.2.3.4")
    e = one(spark, formats.parse_security_line, "x EventID=4720 y")
    assert (e.event_id, e.source_ip) == ("4720", None)
    dated = '2024-01-01 10:00:00 9.9.9.9 - - "GET /a HTTP/1.1" 403 10 "agent"'
    assert one(spark, formats.parse_security_line, dated).source_ip is None
    loose = one(spark, lambda c: formats.parse_security_line(c, True), dated)
    assert (loose.source_ip, loose.request, loose.status) == ("9.9.9.9", "GET /a HTTP/1.1", "403")


def test_line_types(spark):
    for raw, kind in (
        ("a EventID 5", "Windows"), ("[Mon Jan 01 10:00:00.123 2024] [core:error] x", "Apache"), (ACCESS, "Apache"),
        ("Jan 5 10:00:00 h sshd: x", "Linux"), ("something else", "unknown"),
    ):
        assert one(spark, formats.line_type, raw) == kind


def test_file_types_by_name(spark):
    df = spark.createDataFrame([("secure.log",), ("Application.log",), ("catalina.out",), ("nginx.txt",), ("x.log",)], "n string")
    got = [r.t for r in df.select(formats.file_type_by_name(F.col("n")).alias("t")).collect()]
    assert got == ["linux", "windows", "tomcat", "nginx", None]
    assert df.filter("n = 'Application.log'").select(formats.file_type_by_name(F.col("n"), True).alias("t")).first().t is None


def test_source_ip_and_time_text(spark):
    assert one(spark, lambda c: formats.source_ip(c, F.lit("8.8.8.8")), "x from 1.2.3.4 y") == "1.2.3.4"
    assert one(spark, lambda c: formats.source_ip(c, F.lit("8.8.8.8")), "x") == "8.8.8.8"
    assert one(spark, formats.time_text, "a 2024-01-01T10:00:00 b Jan  1 10:00:00") == "2024-01-01T10:00:00"
    assert one(spark, formats.time_text, "none") is None
