"""Column expressions that turn one raw log line into template, parameters, time and stream.

Everything here is a chain of built-in expressions, so it stays inside generated code and can be used in
batch and in streaming alike. Patterns that use word classes carry ``(?U)``: the classes then cover all
scripts, not only ASCII.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .evaluate import let

# Level words, timestamp layouts, parameter and identifier patterns, length limit.
LEVEL_WORD = r"(?i)\b(INFO|ERROR|WARN|WARNING|DEBUG|CRITICAL|FATAL)\b"
ISO_TIME = r"\d{4}-\d{2}-\d{2}\s+\d{2}:\d{2}:\d{2}"
SLASH_TIME = r"\d{4}/\d{2}/\d{2}\s+\d{2}:\d{2}:\d{2}"
UUID = r"(?i)[0-9a-f]{8}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{12}"
ID_PARAMETER = r"(?U)\w+_id=(\d+)"
DURATION_PARAMETER = r"(?i)(?:in|took|takes?)\s+(\d+\.?\d*)\s*(?:seconds?|ms|milliseconds?)"
ANY_NUMBER = r"(?U)\b(\d+\.?\d*)\b"
STREAM_PATTERNS = (
    r"(?i)block[_\s]*id[:\s]*([^\s,]+)",
    r"(?i)instance[_\s]*id[:\s]*([^\s,]+)",
    r"(?i)id[:\s]*([a-f0-9-]{36})",
)
WHITE_SPACE = (
    "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a"
    "\u2028\u2029\u202f\u205f\u3000"
)
KEY_LIMIT = 200
EVENT_PREVIEW = 50
PARAMETER_BOUND = 100000.0


def strip(col: Column) -> Column:
    """Remove all leading and trailing white space, not only blanks."""
    return F.btrim(col, F.lit(WHITE_SPACE))


def clean_utf8(col: Column) -> Column:
    """Drop byte sequences that are not valid UTF-8."""
    return F.regexp_replace(F.make_valid_utf8(col), "�", "")


def group(col: Column, pattern: str, index: int = 1) -> Column:
    """A capture group, null where the pattern does not match."""
    return F.when(col.rlike(pattern), F.regexp_extract(col, pattern, index))


def level(raw: Column) -> Column:
    """The first level word, upper-cased; empty when the line has none."""
    return F.upper(F.regexp_extract(raw, LEVEL_WORD, 1))


def log_key(raw: Column) -> Column:
    """The template of a line: variable parts become ``*``.

    The level is hidden behind a placeholder while numbers, paths and ``k=v`` parts are replaced, and
    put back at the end. A long line with an event id and a level is shortened around the level word.
    """
    return let(F.regexp_extract(raw, LEVEL_WORD, 1), lambda word: _key_with_level(raw, word))


def _key_with_level(raw: Column, word: Column) -> Column:
    name = F.upper(word)
    mark = F.concat(F.lit("__LEVEL_"), name, F.lit("__"))
    at = F.instr(raw, word)
    text = F.when(word == "", raw).otherwise(
        F.concat(F.substring(raw, F.lit(1), at - 1), mark, F.substring(raw, at + F.length(word), F.length(raw)))
    )
    text = F.regexp_replace(F.regexp_replace(text, ISO_TIME, "* *:*:*"), r"\d+", "*")
    text = F.replace(text, F.lit("*.*.*.*"), F.lit("*"))

    def names(text: Column) -> Column:
        return F.when(text.contains("-"), F.regexp_replace(text, UUID, "*")).otherwise(text)

    def paths(text: Column) -> Column:
        return F.when(text.contains("/"), F.regexp_replace(text, r"(?U)/\S+", "/*")).otherwise(text)

    def assignments(text: Column) -> Column:
        result = F.regexp_replace(text, r"(?U)\w+_id=\*", "*_id=*")
        result = F.regexp_replace(result, r"(?U)\w++=\*", "*=*")
        return F.when(text.contains("=*"), result).otherwise(text)

    def restore(value: Column) -> Column:
        return F.when(word == "", value).otherwise(F.replace(value, mark, name))

    def finish(text: Column) -> Column:
        event = F.regexp_extract(text, r"(?U)EventID[=:](\S+)", 1)
        start = F.instr(restore(text), name)
        shortened = F.concat(
            F.substring(restore(text), F.lit(1), start - 1), F.lit(" "), name, F.lit(" EventID="), event, F.lit(" "),
            F.substring(restore(text), start, F.lit(EVENT_PREVIEW)), F.lit("..."),
        )
        return strip(
            F.when(F.length(text) <= KEY_LIMIT, restore(text))
            .when(event == "", restore(F.concat(F.substring(text, 1, KEY_LIMIT), F.lit("..."))))
            .when((word != "") & (start > 1), shortened)
            .otherwise(restore(text))
        )

    return let(let(let(let(text, names), paths), assignments), finish)


def parameters(raw: Column) -> Column:
    """Numbers of a line: ids, then durations, then other numbers outside the timestamp, each once."""
    def numbers(pattern: str) -> Column:
        return F.regexp_extract_all(raw, F.lit(pattern), F.lit(1))

    def to_double(values: Column) -> Column:
        return F.transform(values, lambda v: v.cast("double"))

    def outside(time_text: Column) -> Column:
        rest = F.filter(numbers(ANY_NUMBER), lambda v: (time_text == "") | (F.instr(time_text, v) == 0))
        return F.filter(to_double(rest), lambda v: (v > 0) & (v < PARAMETER_BOUND))

    none = F.array().cast("array<double>")
    ids = F.when(raw.contains("_id="), to_double(numbers(ID_PARAMETER))).otherwise(none)
    rest = let(F.regexp_extract(raw, f"({ISO_TIME})", 1), outside)
    return F.array_distinct(F.concat(ids, to_double(numbers(DURATION_PARAMETER)), rest))


def _wall_clock(text: Column) -> Column:
    return F.regexp_replace(text, r"\s+", " ").try_cast("timestamp_ntz")


def timestamp(raw: Column) -> Column:
    """The time written in a line, null when there is none or it is not a valid time."""
    iso = _wall_clock(F.regexp_extract(raw, f"({ISO_TIME})", 1))
    slash = _wall_clock(F.replace(F.regexp_extract(raw, f"({SLASH_TIME})", 1), F.lit("/"), F.lit("-")))
    return F.coalesce(iso, slash)


def stream_identifier(raw: Column) -> Column:
    """Block id, instance id or UUID named in the line, else ``default``."""
    return F.coalesce(*[group(raw, p) for p in STREAM_PATTERNS], F.lit("default"))


def seconds_between(earlier: Column, later: Column) -> Column:
    """Elapsed seconds between two wall-clock times."""
    return (later - earlier).cast("interval second").cast("decimal(20,6)").cast("double")


def percent_decoded(text: Column, rounds: int) -> Column:
    """Percent escapes decoded as UTF-8, again and again until none is left, at most ``rounds`` times.

    A percent sign without two hex digits and a plus stay as they are; bytes that are no UTF-8 become replacement marks.
    """

    def decode(value: Column) -> Column:
        kept = F.replace(F.regexp_replace(value, "%(?![0-9A-Fa-f]{2})", "%25"), F.lit("+"), F.lit("%2B"))
        return F.when(value.contains("%"), F.url_decode(kept)).otherwise(value)

    return F.aggregate(F.sequence(F.lit(1), F.lit(rounds)), text, lambda value, _: decode(value))
