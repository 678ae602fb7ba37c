"""Rule matching: multi-match and first-match, compiled to one array of literal patterns.

Literal patterns are compiled once per task; a pattern column would be compiled again and again. Most lines
match nothing, so a pattern that demands a fixed text is tried only on lines that contain this text. One search finds the
texts of all patterns; its tasks pass lines to Python in batches.
"""

from __future__ import annotations

import re
import re._constants as rc  # the standard library's own reading of a pattern
import re._parser as rp
from collections.abc import Iterable, Iterator, Sequence
from dataclasses import dataclass, field

import ahocorasick
import pandas as pd
from pyspark.sql import Column, DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType, IntegerType, StringType, StructField, StructType

from ..functions.evaluate import once
from ..functions.formats import security_fields, security_request
from ..functions.text import percent_decoded
from ..packs import fields as field_pack
from ..packs import lines_v2, lines_v3, signatures, texts, timeline, unified
from ..session import small_table

MIN_GUARD = 2
MAX_GUARDS = 12
#: Patterns whose flags share a number.
FLAGS = 62


@dataclass(frozen=True)
class Rule:
    """One rule of a pack. ``patterns`` maps a field to its pattern; the field ``raw`` is the line.

    ``category`` is the name that all packs share, ``label`` the pack's own.
    """

    rule_id: str
    category: str
    level: str
    mitre: str
    confidence: float
    patterns: dict[str, str] = field(hash=False)
    pack: str = ""
    description: str = ""
    remediation: str = ""
    label: str = ""


def pack_rule(rule_id: str, category: str, level: str, mitre: str, confidence: float, patterns: dict[str, str], pack: str) -> Rule:
    """A rule of a built-in pack with its texts; no advice of its own means that of its category."""
    return Rule(
        rule_id, texts.canonical(category), level, mitre, confidence, patterns, pack, texts.describe(rule_id, category),
        texts.ADVICE.get(rule_id, ""), category,
    )


def pack_v3() -> list[Rule]:
    return [pack_rule(i, c, lv, m, conf, {"raw": p}, "v3") for i, c, lv, m, conf, p in lines_v3.RULES]


def pack_v2() -> list[Rule]:
    return [pack_rule(i, c, lv, m, conf, {"raw": p}, "v2") for i, c, lv, m, conf, p in lines_v2.RULES]


def pack_fields() -> list[Rule]:
    return [
        pack_rule(name, category, severity.upper(), mitre, conf, dict(patterns), "fields")
        for _, name, severity, category, mitre, conf, patterns in field_pack.RULES
    ]


def pack_signatures() -> list[Rule]:
    return [
        pack_rule(f"{category}_{i}", category, "MEDIUM", "", 0.8, {"raw": p}, "signatures")
        for category, patterns in signatures.PATTERNS
        for i, p in enumerate(patterns, 1)
    ]


def first_match_pack(name: str) -> list[tuple[str, str, str]]:
    """(attack type, level, pattern) in matching order; ``name`` is ``timeline`` or ``unified``."""
    source = {"timeline": timeline, "unified": unified}[name]
    return [(kind, source.LEVELS.get(kind, "MEDIUM"), p) for kind, ps in source.PATTERNS for p in ps]


def required_texts(pattern: str | rp.SubPattern, shortest: int = MIN_GUARD) -> list[str] | None:
    """Lower-case texts of which every match of a pattern, parsed or not, contains at least one; null when there is no such set."""

    def best(options: list[list[str] | None]) -> list[str] | None:
        usable = [o for o in options if o and all(len(t) >= shortest for t in o) and len(o) <= MAX_GUARDS]
        return max(usable, key=lambda o: min(len(t) for t in o), default=None)

    def walk(parsed) -> list[str] | None:
        options: list[list[str] | None] = []
        run = ""
        for op, arg in parsed:
            if op is rc.LITERAL and arg < 128:
                run += chr(arg).lower()
                continue
            options.append([run])
            run = ""
            if op is rc.IN and all(kind is rc.LITERAL and value < 128 for kind, value in arg):
                options.append([chr(value).lower() for _, value in arg])
            elif op is rc.SUBPATTERN:
                options.append(walk(arg[-1]))
            elif op is rc.BRANCH:
                parts = [walk(branch) for branch in arg[1]]
                if all(parts):
                    options.append([t for part in parts for t in part])
            elif op in (rc.MAX_REPEAT, rc.MIN_REPEAT) and arg[0] > 0:
                options.append(walk(arg[2]))
        options.append([run])
        return best(options)

    return walk(rp.parse(pattern) if isinstance(pattern, str) else pattern)


def ignoring_case(pattern: str) -> str:
    """The pattern with flags; word classes cover all scripts, the rest stays on the faster ASCII rules."""
    return ("(?iU)" if r"\w" in pattern else "(?i)") + pattern


def hits(text: Column, lowered: Column, pattern: str) -> Column:
    """Case-insensitive search for ``pattern``, behind a check for the text it needs."""
    test = text.rlike(ignoring_case(pattern))
    needed = required_texts(pattern)
    if not needed:
        return test
    guard = lowered.contains(needed[0])
    for other in needed[1:]:
        guard = guard | lowered.contains(other)
    return guard & test


def seen_patterns(lines: DataFrame, text: Column, name: str, patterns: Sequence[str]) -> DataFrame:
    """Add flags, ``FLAGS`` to a number, of the patterns of which the text holds a required text; all are searched at once."""
    index: dict[str, int] = {}
    for i, pattern in enumerate(patterns):
        for needed in _guards(pattern) or ():
            index[needed] = index.get(needed, 0) | 1 << i
    words = -(-len(patterns) // FLAGS)
    return lines.withColumn(name, _flags(index, words)(F.lower(text)) if index else F.lit(None).cast(_flag_type(max(words, 1))))


def seen_hits(text: Column, seen: Column, pattern: str, number: int) -> Column:
    """Case-insensitive search for ``pattern``, the one at ``number`` of ``seen_patterns``, where its flag is set or it needs no text."""
    test = text.rlike(ignoring_case(pattern))
    flag = F.lit(1 << number % FLAGS).cast("bigint")
    return (seen[f"w{number // FLAGS}"].bitwiseAND(flag) != 0) & test if _guards(pattern) else test


def _guards(pattern: str) -> list[str] | None:
    """The required texts, single characters only where there are no longer ones."""
    return required_texts(pattern) or required_texts(pattern, 1)


def _flag_type(words: int) -> str:
    return f"struct<{', '.join(f'w{w}: bigint' for w in range(words))}>"


def _flags(index: dict[str, int], words: int):
    """The flags that the texts found in a lower-case line set together, in ``words`` numbers; none for null."""

    @F.pandas_udf(_flag_type(words))
    def flags(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        automaton = ahocorasick.Automaton()
        for text, flag in index.items():
            automaton.add_word(text, flag)
        automaton.make_automaton()
        for lines in batches:
            found = []
            for line in lines:
                held = 0
                for _, flag in automaton.iter(line) if line else ():
                    held |= flag
                found.append(held)
            yield pd.DataFrame({f"w{w}": [held >> w * FLAGS & (1 << FLAGS) - 1 for held in found] for w in range(words)}, dtype="int64")

    return flags


def rule_table(spark: SparkSession, rules: Sequence[Rule]) -> DataFrame:
    """The rules as a small table, one row per rule; ``ord`` is the position in the pack."""
    return small_table(
        spark,
        [
            (i, r.pack, r.rule_id, r.category, r.level.upper(), r.mitre, float(r.confidence),
             r.description, r.remediation, r.label or r.category)
            for i, r in enumerate(rules)
        ],
        "ord int, pack string, rule_id string, category string, threat_level string, mitre string, "
        "confidence double, description string, remediation string, label string",
    )


def _condition(rule: Rule, texts: dict[str, list[tuple[Column, Column]]], numbers: dict[str, int]) -> Column:
    result = None
    for name, pattern in rule.patterns.items():
        if name == "user_agent":
            continue
        for text, seen in texts.get(name, texts["raw"]):
            test = F.coalesce(seen_hits(text, seen, pattern, numbers[pattern]), F.lit(False))
            result = test if result is None else result | test
    return F.lit(False) if result is None else result


def match_rules(
    lines: DataFrame,
    rules: Sequence[Rule],
    raw: str = "raw",
    disabled: Iterable[str] = (),
    strict_fields: bool = False,
    lenient_prefix: bool = False,
    decode_rounds: int = 0,
) -> DataFrame:
    """One event per (line, matching rule); a rule id counts once per line, the earlier rule wins.

    Adds source_ip, hostname, event_id and ts_text from the parsed line, and the rule's columns.
    ``url`` and ``params`` patterns search the request, else the message, else the line. Other fields
    search the line, unless ``strict_fields`` binds ``http_status`` to the parsed status. A ``user_agent``
    pattern never hits: the parsed line has no such field.
    ``lenient_prefix`` also finds the request of access lines that start with a date.
    With ``decode_rounds`` a rule also hits where it finds its pattern in the text after percent-decoding, repeated until nothing
    changes, at most so many times; the text as it stands is searched in any case.
    """
    off = set(disabled)
    active = [r for r in rules if r.rule_id not in off]
    with_fields = any(set(r.patterns) - {"raw"} for r in active)
    parse = security_fields(F.col(raw), lenient_prefix)
    numbers = {p: i for i, p in enumerate(dict.fromkeys(p for r in active for name, p in r.patterns.items() if name != "user_agent"))}
    parsed = seen_patterns(lines, F.col(raw), "_seen", list(numbers))
    texts = {"raw": [(F.col(raw), F.col("_seen"))]}
    if decode_rounds:
        parsed = _decoded(parsed, raw, "_dec", decode_rounds, list(numbers))
        texts["raw"].append((F.col("_dec"), F.col("_sdec")))
    if with_fields:
        # The request is a part of the line, so what it holds was seen in the line.
        parsed = once(parsed, "_req", security_request(F.col(raw), lenient_prefix))
        texts["url"] = texts["params"] = [(F.col("_req"), F.col("_seen"))]
        if decode_rounds:
            parsed = _decoded(parsed, "_req", "_dreq", decode_rounds, list(numbers))
            texts["url"].append((F.col("_dreq"), F.col("_sdreq")))
        if strict_fields:
            parsed = once(parsed, "_status", F.coalesce(parse["status"], F.lit("")))
            texts["http_status"] = [(F.col("_status"), F.col("_seen"))]
    earlier: dict[str, Column] = {}
    branches = []
    for i, rule in enumerate(active):
        test = _condition(rule, texts, numbers)
        fires = test & ~earlier[rule.rule_id] if rule.rule_id in earlier else test
        earlier[rule.rule_id] = earlier[rule.rule_id] | test if rule.rule_id in earlier else test
        branches.append(F.when(fires, F.lit(i)))
    found = F.array_compact(F.array(*branches))
    table = rule_table(lines.sparkSession, active)
    matched = parsed.withColumn("ord", F.explode(found))  # only lines that hit are parsed, and only for the columns in use
    return (
        matched.withColumns({n: parse[n] for n in ("source_ip", "hostname", "event_id", "ts_text")})
        .drop("_seen", "_req", "_status", "_dec", "_sdec", "_dreq", "_sdreq")
        .join(F.broadcast(table), "ord")
    )


def _decoded(lines: DataFrame, source: str, name: str, rounds: int, patterns: Sequence[str]) -> DataFrame:
    """Add the decoded text, null where decoding changes nothing, and the patterns seen in it, named with an s."""
    text = F.col(source)
    value = F.when(text.contains("%"), F.nullif(percent_decoded(text, rounds), text))
    return seen_patterns(once(lines, name, value), F.col(name), f"_s{name[1:]}", patterns)


def match_incident_rules(lines: DataFrame, rules: Sequence[Rule] | None = None, raw: str = "raw") -> DataFrame:
    """Multi-match with the source taken from the rule's own capture groups.

    The source is the first group that consists of digits and dots only; a rule without groups, or
    without such a value, has no source.
    """
    rules = list(pack_v2() if rules is None else rules)
    low = seen_patterns(lines, F.col(raw), "_seen", [r.patterns["raw"] for r in rules])
    found = F.array(
        *[F.when(seen_hits(F.col(raw), F.col("_seen"), r.patterns["raw"], i), F.lit(i)) for i, r in enumerate(rules)]
    )
    sources = []
    for i, rule in enumerate(rules):
        pattern = ignoring_case(rule.patterns["raw"])
        for g in range(1, re_groups(rule.patterns["raw"]) + 1):
            value = F.regexp_extract(F.col(raw), pattern, g)
            sources.append(F.when((F.col("ord") == i) & value.rlike(r"^[\d.]+$"), value))
    table = rule_table(lines.sparkSession, rules)
    return (
        low.withColumn("ord", F.explode(F.array_compact(found)))
        .withColumn("source_ip", F.coalesce(*sources, F.lit(None).cast("string")))
        .drop("_seen")
        .join(F.broadcast(table), "ord")
    )


def re_groups(pattern: str) -> int:
    return rp.parse(pattern).state.groups - 1


def first_match(lines: DataFrame, pack: Sequence[tuple[str, str, str]], raw: str = "raw") -> DataFrame:
    """Add attack_type, threat_level, matched_pattern and captured of the first pattern that hits.

    ``captured`` holds all capture groups of this pattern in order, empty ones for groups that took no part; it is null
    for a pattern without groups. All four are null when nothing hits.
    """
    seen = seen_patterns(lines, F.col(raw), "_seen", [p for _, _, p in pack])
    number = F.coalesce(*[F.when(seen_hits(F.col(raw), F.col("_seen"), p, i), F.lit(i)) for i, (_, _, p) in enumerate(pack)])
    table = small_table(
        lines.sparkSession,
        [(i, *row) for i, row in enumerate(pack)],
        "_ord int, attack_type string, threat_level string, matched_pattern string",
    )
    captured = F.coalesce(
        *[
            F.when(F.col("_ord") == i, F.array(*[F.regexp_extract(F.col(raw), ignoring_case(p), g) for g in range(1, re_groups(p) + 1)]))
            for i, (_, _, p) in enumerate(pack)
            if re_groups(p)
        ],
        F.lit(None).cast("array<string>"),
    )
    numbered = once(seen, "_ord", number)
    return numbered.join(F.broadcast(table), "_ord", "left").withColumn("captured", captured).drop("_ord", "_seen")


def match_dynamic(lines: DataFrame, patterns: DataFrame, raw: str = "raw", block_bytes: int = 8 << 20) -> DataFrame:
    """Multi-match against a rule table (rule_id, pattern, …) that is only known at run time: rule_id, the line, the rule's other columns.

    Texts that a pattern can't do without lead to it, the longest it has, blanks between words included (``needed_parts``): all such
    texts are searched at once in every line, and a line is tested only against the rules whose texts it holds. A pattern of nothing but
    letters, small sets, white space and one run of letters (``whole_parts``) is decided by this search, without a test. Rules come to the driver in blocks of ``block_bytes`` of patterns, each one scan of the
    lines; rules without such a text are tested on every line, ``RULE_SLICE`` to a scan. Each row of the table is a rule of its own;
    one without a pattern never hits.
    """
    spark = lines.sparkSession
    low = lines.withColumn("_low", F.lower(F.col(raw)))
    schema = StructType([
        StructField("_ord", IntegerType()), StructField("_pattern", StringType()), StructField("_rule", patterns.schema),
    ])
    tested = StructType([*schema, StructField("_whole", BooleanType())])
    parts = []
    for block in _rule_blocks(patterns, block_bytes):
        rules = [(i, ignoring_case(r["pattern"]), r) for i, r in enumerate(block)]
        whole = [whole_parts(r["pattern"]) for r in block]
        needed = [parts_of or needed_parts(r["pattern"]) for r, parts_of in zip(block, whole)]
        found = []
        for text, decided in ((F.col(raw), True), (F.col("_low"), False)):
            index: dict[tuple, list[int]] = {}
            for i, parts_of in enumerate(needed):
                for part in parts_of or () if bool(whole[i]) is decided else ():
                    index.setdefault(part, []).append(i)
            if index:
                found.append(_candidates(spark.sparkContext.broadcast(index), decided)(text))
        if found:
            indexed = [(*rules[i], bool(whole[i])) for i, parts_of in enumerate(needed) if parts_of]
            hit = low.withColumn("_ord", F.explode(F.concat(*found))).join(F.broadcast(spark.createDataFrame(indexed, tested)), "_ord")
            parts.append(hit if all(r[-1] for r in indexed) else hit.filter(F.col("_whole") | F.rlike(F.col(raw), F.col("_pattern"))))
        plain = [rules[i] for i, parts_of in enumerate(needed) if not parts_of]
        for first in range(0, len(plain), RULE_SLICE):
            part = plain[first : first + RULE_SLICE]
            hit = F.array_compact(F.array(*[F.when(F.col(raw).rlike(p), F.lit(i)) for i, p, _ in part]))
            parts.append(low.withColumn("_ord", F.explode(hit)).join(F.broadcast(spark.createDataFrame(part, schema)), "_ord"))
    if not parts:
        parts = [low.limit(0).crossJoin(spark.createDataFrame([], schema))]
    others = [n for n in patterns.columns if n not in ("rule_id", "pattern")]
    out = [F.col("_rule.rule_id"), *[F.col(f"`{c}`") for c in lines.columns], *[F.col("_rule")[n].alias(n) for n in others]]
    selected = [part.select(*out) for part in parts]
    result = selected[0]
    for part in selected[1:]:
        result = result.union(part)
    return result


def _rule_blocks(patterns: DataFrame, size: int) -> Iterator[list[Row]]:
    """The rows with a pattern, in blocks of ``size`` characters of patterns or of one row."""
    block, held = [], 0
    for row in patterns.filter(F.col("pattern").isNotNull()).toLocalIterator():
        if block and held + len(row["pattern"]) > size:
            yield block
            block, held = [], 0
        block.append(row)
        held += len(row["pattern"])
    if block:
        yield block


def needed_parts(pattern: str) -> list[tuple[str, str, str]] | None:
    """Parts (text, letters, text) of which every match holds at least one in the line in lower case with single blanks for white space.

    A part is a text alone, then the others are empty, or two texts with nothing between them but a run of the letters, of which the
    second text does not begin with one. Of the parts that a match can't do without, those with the longest texts are taken. None
    where there are none, as well as for a pattern that only the JVM's dialect knows.
    """
    if "&&" in pattern or NESTED.search(pattern):  # sets that the two dialects read differently
        return None
    try:
        parsed = rp.parse(pattern)
        longest = required_texts(parsed)
    except (re.error, OverflowError, RecursionError):
        return None
    found = _runs(parsed)
    if longest:
        found.append([(BLANKS.sub(" ", t), "", "") for t in longest])
    found = [parts for parts in found if all(len(a) + len(b) >= MIN_GUARD and a != " " for a, _, b in parts)]
    return max(found, key=lambda parts: min(len(a) + len(b) for a, _, b in parts), default=None)


def whole_parts(pattern: str) -> list[tuple[str, str, str]] | None:
    """Parts as ``needed_parts`` has them, of which a line holds one if and only if it matches the pattern; none for other patterns.

    Such a pattern is a sequence of ASCII letters and signs, small sets of them, ``\\s+`` and at most one run of a set, between texts. It stands
    for its parts in the line with ASCII letters in lower case and one blank for each white space that the JVM knows (``held_whole``).
    """
    if not PLAIN.fullmatch(pattern) or r"\w" in pattern:
        return None
    try:
        parsed = rp.parse(pattern)
    except re.error:
        return None
    before, letters, texts = None, "", [""]
    for op, arg in parsed:
        run = _letter_run(op, arg)
        if _white_space(op, arg):
            if texts[0].endswith(" "):  # at least two characters of white space
                return None
            texts = [t + " " for t in texts]
        elif run:
            if before is not None or texts == [""]:
                return None
            before, letters, texts = texts, run, [""]
        else:
            kept = _small_set(op, arg)
            if not kept or len(texts) * len(kept) > MAX_GUARDS:
                return None
            texts = [t + c for t in texts for c in kept]
    if before is None:
        parts = [(t, "", "") for t in texts]
    elif all(t and t[0] not in letters for t in texts) and len(before) * len(texts) <= MAX_GUARDS:
        parts = [(b, letters, t) for b in before for t in texts]
    else:
        return None
    return parts if all(len(a) + len(b) >= MIN_GUARD and a != " " for a, _, b in parts) else None


def _small_set(op, arg) -> list[str] | None:
    """The lower-case ASCII characters of which an operation takes one, if it lists them."""
    if op is rc.LITERAL and arg < 128:
        return [chr(arg).lower()]
    if op is rc.IN and all(kind is rc.LITERAL and value < 128 for kind, value in arg):
        return sorted({chr(value).lower() for _, value in arg})
    return None


def _runs(parsed) -> list[list[tuple[str, str, str]]]:
    """All parts of a sequence of letters, small sets, white space and runs of letters; other operations end a part."""
    found: list[list[tuple[str, str, str]]] = []
    texts, letters, before = [""], "", None

    def end() -> None:
        if texts != [""] and len(texts) <= MAX_GUARDS:
            found.append([(t, "", "") for t in texts])
        if before is not None and all(t and t[0] not in letters for t in texts) and len(before) * len(texts) <= MAX_GUARDS:
            found.append([(b, letters, t) for b in before for t in texts])

    for op, arg in parsed:
        if _white_space(op, arg):
            texts = [t if t.endswith(" ") else t + " " for t in texts]
            continue
        kept = _small_set(op, arg)
        if kept and not any(c.isspace() for c in kept) and len(texts) * len(kept) <= MAX_GUARDS:
            texts = [t + c for t in texts for c in kept]
            continue
        end()
        run = _letter_run(op, arg)
        before, letters = (texts, run) if run and texts != [""] else (None, "")
        texts = [""]
    end()
    return found


def _white_space(op, arg) -> bool:
    """Whether an operation takes white space, at least one, and nothing else."""
    if op in (rc.MAX_REPEAT, rc.MIN_REPEAT):
        return arg[0] > 0 and len(arg[2]) == 1 and _white_space(*arg[2][0])
    if op is rc.LITERAL:
        return arg < 128 and chr(arg).isspace()
    return op is rc.IN and all(
        (kind is rc.LITERAL and value < 128 and chr(value).isspace()) or (kind is rc.CATEGORY and value is rc.CATEGORY_SPACE) for kind, value in arg
    )


def _letter_run(op, arg) -> str | None:
    """The lower-case ASCII letters, digits and signs of which an operation takes one or more, without white space; else none."""
    if op not in (rc.MAX_REPEAT, rc.MIN_REPEAT) or arg[0] < 1 or len(arg[2]) != 1 or arg[2][0][0] is not rc.IN:
        return None
    held: set[str] = set()
    for kind, value in arg[2][0][1]:
        if kind is rc.LITERAL and value < 128:
            held.add(chr(value).lower())
        elif kind is rc.RANGE and value[1] < 128:
            held |= {chr(c).lower() for c in range(value[0], value[1] + 1)}
        else:
            return None
    return None if any(c.isspace() for c in held) else "".join(sorted(held))


#: White space of any script; a set inside a set; letters beyond ASCII that match one of ASCII where case is ignored in all scripts.
BLANKS = re.compile(r"\s+")
JVM_BLANKS = re.compile(r"[ \t\n\x0b\f\r]+")
#: Patterns that both dialects read alike: ASCII letters and signs without a meaning, escaped signs, ``\s+``, sets of such and of ranges, runs of sets.
PLAIN = re.compile(r"(?:[0-9A-Za-z!\"#%',/:;<=>@_`~-]|\\[!-/:-@\[-`{-~]|\\s\+|\[(?:[0-9A-Za-z]-[0-9A-Za-z]|[0-9A-Za-z!\"#%',./:;<=>@_`~]|\\[!-/:-@\[-`{-~])+\]\+?)+")
NESTED = re.compile(r"(?<!\\)\[[^\]]*(?<!\\)\[")
FOLDED = (("ſ", "s"), ("ı", "i"), ("i\u0307", "i"))


def held_whole(line: str) -> str:
    """A line as the parts of whole patterns stand for it: ASCII letters in lower case, white space of the JVM as single blanks."""
    lower = line.lower() if line.isascii() else line.encode().lower().decode()
    return JVM_BLANKS.sub(" ", lower)


def _candidates(index, whole: bool = False):
    """The numbers of the rules, each once, that a lower-case line holds a part of; ``index`` is a broadcast part → numbers.

    With ``whole`` the parts are those of ``whole_parts``, and the numbers those of the rules that the line, as it stands, matches.
    """

    @F.pandas_udf("array<int>")
    def candidates(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        alone: dict[str, list[int]] = {}
        first: dict[str, set[str]] = {}
        second: set[str] = set()
        for (a, letters, b), numbers in index.value.items():
            if b:
                first.setdefault(a, set()).add(letters)
                second.add(b)
            else:
                alone[a] = numbers
        automaton = ahocorasick.Automaton()
        for text in {*alone, *first, *second}:
            automaton.add_word(text, (text, alone.get(text), tuple(sorted(first.get(text, ()))), text in second))
        automaton.make_automaton()
        least = "+" if whole else "*"
        runs = {letters: re.compile(f"[{re.escape(letters)}]{least}") for sets in first.values() for letters in sets}
        pairs = index.value

        def held(line: str | None) -> list[int]:
            if whole:
                line = held_whole(line or "")
            else:
                line = BLANKS.sub(" ", line or "")
                for letter, folded in () if line.isascii() else FOLDED:
                    line = line.replace(letter, folded)
            found: set[int] = set()
            texts: set[str] = set()
            waiting: dict[int, set[tuple[str, str]]] = {}
            begins: list[tuple[int, str]] = []
            for at, (text, numbers, followed, follows) in automaton.iter(line):
                if numbers and text not in texts:
                    texts.add(text)
                    found.update(numbers)
                for letters in followed:
                    run = runs[letters].match(line, at + 1)
                    if run:
                        waiting.setdefault(run.end(), set()).add((text, letters))
                if follows:
                    begins.append((at + 1 - len(text), text))
            for at, text in begins:
                for a, letters in waiting.get(at, ()):
                    found.update(pairs.get((a, letters, text), ()))
            return sorted(found)

        for lines in batches:
            yield lines.map(held)

    return candidates


RULE_SLICE = 500
