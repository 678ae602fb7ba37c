"""Network-flow tables as log lines."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Columns of the flow table without header; all others than these three are numbers.
NSL_KDD_COLUMNS = (
    "duration protocol_type service flag src_bytes dst_bytes land wrong_fragment urgent hot num_failed_logins "
    "logged_in num_compromised root_shell su_attempted num_root num_file_creations num_shells num_access_files "
    "num_outbound_cmds is_host_login is_guest_login count srv_count serror_rate srv_serror_rate rerror_rate "
    "srv_rerror_rate same_srv_rate diff_srv_rate srv_diff_host_rate dst_host_count dst_host_srv_count "
    "dst_host_same_srv_rate dst_host_diff_srv_rate dst_host_same_src_port_rate dst_host_srv_diff_host_rate "
    "dst_host_serror_rate dst_host_srv_serror_rate dst_host_rerror_rate dst_host_srv_rerror_rate label "
    "difficulty_level"
).split()
TEXT_COLUMNS = ("protocol_type", "service", "flag", "label")


def nsl_kdd_schema() -> str:
    def kind(name: str) -> str:
        if name in TEXT_COLUMNS:
            return "string"
        return "double" if name.endswith("_rate") else "bigint"

    return ", ".join(f"`{name}` {kind(name)}" for name in NSL_KDD_COLUMNS)


def read_nsl_kdd(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.csv(path, schema=nsl_kdd_schema())


def read_unsw(spark: SparkSession, path: str) -> DataFrame:
    """A flow table with header; the columns are used by name."""
    return spark.read.csv(path, header=True)


def nsl_kdd_line() -> Column:
    return F.concat(
        F.lit("["), F.upper("protocol_type"), F.lit("] "), F.col("service"),
        F.lit(" | SRC:"), F.col("src_bytes").cast("string"), F.lit(" DST:"), F.col("dst_bytes").cast("string"),
        F.lit(" | FLAG:"), F.col("flag"), F.lit(" | ATTACK:"), F.col("label"),
        F.lit(" (difficulty:"), F.col("difficulty_level").cast("string"), F.lit(")"),
    )


def unsw_line() -> Column:
    text = {c: F.col(c).cast("string") for c in ("spkts", "dpkts", "sbytes", "dbytes", "label")}
    return F.concat(
        F.lit("["), F.upper("proto"), F.lit("] "), F.col("service"),
        F.lit(" | SPKTS:"), text["spkts"], F.lit(" DPKTS:"), text["dpkts"],
        F.lit(" | SBYTES:"), text["sbytes"], F.lit(" DBYTES:"), text["dbytes"],
        F.lit(" | RATE:"), F.format_string("%.2f", F.col("rate").cast("double")), F.lit(" | STATE:"), F.col("state"),
        F.lit(" | ATTACK:"), F.col("attack_cat"), F.lit(" LABEL:"), text["label"],
    )
