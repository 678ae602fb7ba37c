"""Line layouts: access logs, syslog, Windows events, Tomcat, generic; and the type of a line or file."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import group

# The layouts and the markers that tell log types apart.
ACCESS = r'^([\d.]+)\s+-\s+-\s+\[([^\]]+)\]\s+"([^"]+)"\s+(\d+)\s+(\d+)'
ACCESS_AGENT = ACCESS + r'\s+"([^"]*)"\s+"([^"]*)"'
SYSLOG = r"^([A-Z][a-z]{2}\s+\d+\s+\d+:\d+:\d+)\s+(\S+)\s+(.*)"
SYSLOG_PROCESS = r"^([A-Z][a-z]{2}\s+\d+\s+\d+:\d+:\d+)\s+([\w-]+)\s+(\w+):\s+(.+)"
ISO_HOST = r"^(20\S+)\s+(\S{1,8})\S*\s+(\S+)\s+(.+)"
WINDOWS = r"^(\d{4}-\d{2}-\d{2}\s+\d{2}:\d{2}:\d{2}\.\d+)\s+(\w+)\s+EventID=(\d+)\s+(.*)"
TOMCAT = r"^(\d{4}-\d{2}-\d{2}\s+\d{2}:\d{2}:\d{2})\.\d+\s+\[([^\]]+)\]\s+(\w+)\s+(.*)"
GENERIC = r"^(\d{4}-\d{2}-\d{2}[T\s]\d{2}:\d{2}:\d{2}(?:\.\d+)?)\s*(\[?.*?\]?)\s*(\w+)\s*(.*)"
TIME_TEXTS = (
    r"\d{4}-\d{2}-\d{2}T\d{2}:\d{2}:\d{2}",
    r"\w{3}\s+\d{1,2}\s+\d{2}:\d{2}:\d{2}",
    r"\d{4}-\d{2}-\d{2}\s+\d{2}:\d{2}:\d{2}",
)
FIRST_IP = r"(\d{1,3}\.\d{1,3}\.\d{1,3}\.\d{1,3})"
FROM_IP = r"from\s+([\d.]+)"
DATED_PREFIX = r"^\d{4}-\d{2}-\d{2}\s+\d{2}:\d{2}:\d{2}\s+"
MONTHS = ("Jan", "Feb", "Mar", "Apr", "May", "Jun", "Jul", "Aug", "Sep", "Oct", "Nov", "Dec")
WEEKDAY = "(Mon|Tue|Wed|Thu|Fri|Sat|Sun)"
WINDOWS_MARKS = ("EventID", "Event ID", "EventName", "脱机下级迁移", "软件保护服务")
WINDOWS_TIME = rf"^{WEEKDAY}\s+\w+\s+\d+\s+\d{{2}}:\d{{2}}:\d{{2}}\s+\d{{4}}"
APACHE_ERROR = (
    rf"^\[{WEEKDAY}\s+\w+\s+\d+\s+\d{{2}}:\d{{2}}:\d{{2}}\.\d+\s+\d{{4}}\]",
    r"^\[.*\]\s+\[.*:.*\]\s+\[pid\s+\d+:tid\s+\d+\]",
    r"^\[.*\]\s+\[.*:.*\]\s+AH\d+:",
)
APACHE_ACCESS = (r"^\d+\.\d+\.\d+\.\d+", r'^\[.*\]\s+"(GET|POST|PUT|DELETE|HEAD|OPTIONS)')
LINUX_TIME = r"^\w+\s+\d+\s+\d{2}:\d{2}:\d{2}"
LINUX_NAMES = ("auth", "syslog", "secure", "messages")
WINDOWS_NAMES = ("windows", "system", "application")
TOMCAT_NAMES = ("catalina", "tomcat")
ACCESS_NAMES = ("access", "nginx", "apache")


def _any(tests) -> Column:
    result = F.lit(False)
    for test in tests:
        result = result | test
    return result


def access_time(text: Column) -> Column:
    """``dd/MMM/yyyy:HH:mm:ss zone`` as wall-clock time; the zone is read and dropped."""
    month = F.array_position(F.array(*[F.lit(m) for m in MONTHS]), F.substring(text, 4, 3))
    iso = F.concat_ws(
        " ",
        F.concat_ws("-", F.substring(text, 8, 4), F.lpad(month.cast("string"), 2, "0"), F.substring(text, 1, 2)),
        F.substring(text, 13, 8),
    )
    return iso.try_cast("timestamp_ntz")


def syslog_time(text: Column, year: Column | int) -> Column:
    """``MMM d HH:mm:ss`` in the given year."""
    parts = F.split(text, r"\s+")
    month = F.array_position(F.array(*[F.lit(m) for m in MONTHS]), F.get(parts, F.lit(0)))
    year = F.lit(year) if isinstance(year, int) else year
    iso = F.concat_ws(
        " ",
        F.concat_ws(
            "-", F.lpad(year.cast("string"), 4, "0"), F.lpad(month.cast("string"), 2, "0"),
            F.lpad(F.get(parts, F.lit(1)), 2, "0"),
        ),
        F.get(parts, F.lit(2)),
    )
    return iso.try_cast("timestamp_ntz")


def parse_access(raw: Column) -> Column:
    """Access log: ip, ts_text, ts, request, method, path, protocol, status, size, referer, user_agent.

    The agent part is optional. A request that is not three words leaves method, path and protocol null.
    """
    request = F.regexp_extract(raw, ACCESS, 3)
    words = F.split(request, r"\s+")
    three = F.size(words) == 3
    time_text = F.regexp_extract(raw, ACCESS, 2)
    return F.when(
        raw.rlike(ACCESS),
        F.struct(
            F.regexp_extract(raw, ACCESS, 1).alias("ip"),
            time_text.alias("ts_text"),
            access_time(time_text).alias("ts"),
            request.alias("request"),
            F.when(three, F.get(words, F.lit(0))).alias("method"),
            F.when(three, F.get(words, F.lit(1))).alias("path"),
            F.when(three, F.get(words, F.lit(2))).alias("protocol"),
            F.regexp_extract(raw, ACCESS, 4).try_cast("int").alias("status"),
            F.regexp_extract(raw, ACCESS, 5).try_cast("bigint").alias("size"),
            group(raw, ACCESS_AGENT, 6).alias("referer"),
            group(raw, ACCESS_AGENT, 7).alias("user_agent"),
        ),
    )


def parse_syslog(raw: Column, year: Column | int, iso_fallback: bool = True) -> Column:
    """Syslog: ts, host, message; optionally ``yyyy-MM-dd HH:mm:ss host message`` as well."""
    classic = F.when(
        raw.rlike(SYSLOG),
        F.struct(
            syslog_time(F.regexp_extract(raw, SYSLOG, 1), year).alias("ts"),
            F.regexp_extract(raw, SYSLOG, 2).alias("host"),
            F.regexp_extract(raw, SYSLOG, 3).alias("message"),
        ),
    )
    if not iso_fallback:
        return classic
    iso_ts = F.concat_ws(" ", F.regexp_extract(raw, ISO_HOST, 1), F.regexp_extract(raw, ISO_HOST, 2)).try_cast(
        "timestamp_ntz"
    )
    return classic.when(
        raw.rlike(ISO_HOST) & iso_ts.isNotNull(),
        F.struct(
            iso_ts.alias("ts"),
            F.regexp_replace(F.regexp_extract(raw, ISO_HOST, 3), ":+$", "").alias("host"),
            F.regexp_extract(raw, ISO_HOST, 4).alias("message"),
        ),
    )


def parse_windows(raw: Column) -> Column:
    """Windows event: ts, level, event_id, message."""
    return F.when(
        raw.rlike(WINDOWS),
        F.struct(
            F.regexp_replace(F.regexp_extract(raw, WINDOWS, 1), r"\s+", " ").try_cast("timestamp_ntz").alias("ts"),
            F.regexp_extract(raw, WINDOWS, 2).alias("level"),
            F.regexp_extract(raw, WINDOWS, 3).try_cast("int").alias("event_id"),
            F.regexp_extract(raw, WINDOWS, 4).alias("message"),
        ),
    )


def parse_tomcat(raw: Column) -> Column:
    """Tomcat: ts, thread, level, message."""
    return F.when(
        raw.rlike(TOMCAT),
        F.struct(
            F.regexp_replace(F.regexp_extract(raw, TOMCAT, 1), r"\s+", " ").try_cast("timestamp_ntz").alias("ts"),
            F.regexp_extract(raw, TOMCAT, 2).alias("thread"),
            F.regexp_extract(raw, TOMCAT, 3).alias("level"),
            F.regexp_extract(raw, TOMCAT, 4).alias("message"),
        ),
    )


def parse_generic(raw: Column) -> Column:
    """Any dated line: ts, tag, word, message."""
    return F.when(
        raw.rlike(GENERIC),
        F.struct(
            F.regexp_replace(F.regexp_extract(raw, GENERIC, 1), r"[T\s]", " ").try_cast("timestamp_ntz").alias("ts"),
            F.regexp_extract(raw, GENERIC, 2).alias("tag"),
            F.regexp_extract(raw, GENERIC, 3).alias("word"),
            F.regexp_extract(raw, GENERIC, 4).alias("message"),
        ),
    )


def security_request(raw: Column, lenient_prefix: bool = False) -> Column:
    """The request of an access line, else the message of a syslog line, else the line; empty ones pass to the next."""
    view = security_fields(raw, lenient_prefix)
    return F.coalesce(F.nullif(view["request"], F.lit("")), F.nullif(view["message"], F.lit("")), raw)


def parse_security_line(raw: Column, lenient_prefix: bool = False) -> Column:
    """The rule analyzer's view of a line: access log, else ``process: message`` syslog, else event id.

    ``lenient_prefix`` also accepts access lines that start with a date, which otherwise have no source.
    """
    return F.struct(*[value.alias(name) for name, value in security_fields(raw, lenient_prefix).items()])


def security_fields(raw: Column, lenient_prefix: bool = False) -> dict[str, Column]:
    """The columns of ``parse_security_line`` one by one, for callers that need some of them."""
    line = F.regexp_replace(raw, DATED_PREFIX, "") if lenient_prefix else raw
    access, syslog = line.rlike(ACCESS), raw.rlike(SYSLOG_PROCESS)
    if lenient_prefix:
        dated = r'^([\d.]+)\s+-\s+-\s+"([^"]+)"\s+(\d+)\s+(\d+)'
        loose = line.rlike(dated)
        ip = F.when(access, F.regexp_extract(line, ACCESS, 1)).when(loose, F.regexp_extract(line, dated, 1))
        request = F.when(access, F.regexp_extract(line, ACCESS, 3)).when(loose, F.regexp_extract(line, dated, 2))
        status = F.when(access, F.regexp_extract(line, ACCESS, 4)).when(loose, F.regexp_extract(line, dated, 3))
        access = access | loose
    else:
        ip = F.when(access, F.regexp_extract(line, ACCESS, 1))
        request = F.when(access, F.regexp_extract(line, ACCESS, 3))
        status = F.when(access, F.regexp_extract(line, ACCESS, 4))
    other = ~access & syslog
    time_text = F.when(raw.rlike(ACCESS), F.regexp_extract(raw, ACCESS, 2)).when(
        other, F.regexp_extract(raw, SYSLOG_PROCESS, 1)
    )
    return {
        "ts_text": time_text,
        "source_ip": F.coalesce(ip, F.when(other, group(raw, FIRST_IP))),
        "hostname": F.when(other, F.regexp_extract(raw, SYSLOG_PROCESS, 2)),
        "request": request,
        "message": F.when(other, F.regexp_extract(raw, SYSLOG_PROCESS, 4)),
        "status": status,
        "event_id": F.when(~access & ~syslog, group(raw, r"EventID=(\d+)")),
    }


def time_text(raw: Column) -> Column:
    """The text of the first known time layout, unparsed; null when there is none."""
    return F.coalesce(*[group(raw, p, 0) for p in TIME_TEXTS])


def source_ip(raw: Column, parsed_ip: Column | None = None) -> Column:
    """The address after ``from``, else the parsed one."""
    found = group(raw, FROM_IP)
    return found if parsed_ip is None else F.coalesce(found, parsed_ip)


def line_type(raw: Column) -> Column:
    """Windows, Apache, Linux or unknown, by the shape of one line; first match wins."""
    request = (raw.contains("GET ") | raw.contains("POST ")) & raw.contains("HTTP/")
    return (
        F.when(_any(raw.contains(m) for m in WINDOWS_MARKS) | raw.rlike(WINDOWS_TIME), "Windows")
        .when(_any(raw.rlike(p) for p in APACHE_ERROR), "Apache")
        .when(_any(raw.rlike(p) for p in APACHE_ACCESS) | request, "Apache")
        .when(raw.rlike(LINUX_TIME), "Linux")
        .otherwise("unknown")
    )


def file_type_by_name(name: Column, unified: bool = False) -> Column:
    """linux, windows, tomcat or nginx by the file name; null when the name tells nothing."""
    lowered = F.lower(name)
    windows = WINDOWS_NAMES[:2] if unified else WINDOWS_NAMES
    return (
        F.when(_any(lowered.contains(n) for n in LINUX_NAMES), "linux")
        .when(_any(lowered.contains(n) for n in windows), "windows")
        .when(_any(lowered.contains(n) for n in TOMCAT_NAMES), "tomcat")
        .when(_any(lowered.contains(n) for n in ACCESS_NAMES), "nginx")
    )
