"""Rule packs from YAML files."""

from __future__ import annotations

import json
import logging
from collections.abc import Iterator
from pathlib import Path

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.match import Rule

# What a rule has when its file does not say so.
DEFAULT_SEVERITY = "medium"
DEFAULT_CONFIDENCE = 0.8

log = logging.getLogger(__name__)

#: A rule is a test of every line, so packs are small; more files or rules than this are a mistake.
MAX_FILES = 10_000
MAX_RULES = 10_000
OUTCOMES = "file string, accepted boolean, n_rules bigint, error string, rules string"


def load_rules(folder: str) -> list[Rule]:
    """All rules of the ``*.yaml`` files of a folder, by file name and position; a bad file is skipped.

    Rules are a dimension of a few dozen rows, read once on the driver.
    """
    try:
        import yaml
    except ImportError as error:
        raise RuntimeError("reading rule files needs the yaml package") from error
    rules: list[Rule] = []
    for file in sorted(Path(folder).glob("*.yaml")):
        try:
            documents = [d for d in yaml.safe_load_all(file.read_text(encoding="utf-8")) if d]
            rules += [_rule(d) for d in documents]
        except (yaml.YAMLError, UnicodeDecodeError, AttributeError, KeyError, TypeError, ValueError) as error:
            log.warning("skipped rule file %s: %s", file.name, error)
    return rules


def read_rule_files(spark: SparkSession, path: str, glob: str = "*.yaml") -> DataFrame:
    """One row per rule file below a folder of any file system: file, accepted, n_rules, error, rules.

    Files are read and checked by tasks. A bad file is a row with its error and without rules; a file without documents is
    accepted with none. ``rules`` has the rules' fields as JSON.
    """
    files = spark.read.text(path, wholetext=True, recursiveFileLookup=True, pathGlobFilter=glob)

    def check(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import yaml

        for pdf in batches:
            out = []
            for file, value in zip(pdf["file"], pdf["value"]):
                try:
                    rules = [_rule(d).__dict__ for d in yaml.safe_load_all(value) if d]
                    out.append((file, True, len(rules), None, json.dumps(rules)))
                except (yaml.YAMLError, AttributeError, KeyError, TypeError, ValueError) as error:
                    out.append((file, False, 0, f"{type(error).__name__}: {error}", None))
            yield pd.DataFrame(out, columns=[c.split()[0] for c in OUTCOMES.split(", ")])

    return files.select(F.col("_metadata.file_path").alias("file"), "value").mapInPandas(check, OUTCOMES)


def accepted_rules(outcomes: DataFrame) -> list[Rule]:
    """The rules of all accepted files, by file name and position."""
    rows = outcomes.filter("accepted").select("file", "rules").limit(MAX_FILES + 1).collect()
    rules = [Rule(**fields) for row in sorted(rows) for fields in json.loads(row["rules"])]
    if len(rows) > MAX_FILES or len(rules) > MAX_RULES:
        raise ValueError(f"more than {MAX_FILES} rule files or {MAX_RULES} rules")
    return rules


def _rule(document: dict) -> Rule:
    patterns = document.get("pattern") or {}
    return Rule(
        rule_id=document["name"],
        category=document.get("category", "unknown"),
        level=str(document.get("severity", DEFAULT_SEVERITY)).upper(),
        mitre=document.get("mitre_ttp", ""),
        confidence=float(document.get("confidence", DEFAULT_CONFIDENCE)),
        patterns={k: str(v) for k, v in patterns.items() if v},
        pack="fields",
        description=document.get("description", ""),
        remediation=document.get("remediation", ""),
    )
