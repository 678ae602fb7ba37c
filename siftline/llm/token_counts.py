"""Token counts by source, language and tokenizer version, maintained from signed changes.

A batch of changes is summed to one row per group and appended with the name of its attempt; a second append then commits the
attempt under the batch's id. Totals add up, for every batch id, the rows of its first committed attempt. So a batch that is
delivered again, a job that dies between the two appends, or two jobs that run the same batch change nothing. Which commit came first
is decided by the shared folder, through the times it gave their files, not by the drivers' clocks. Nothing is ever rewritten in place,
and only sums by group are stored, never documents.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import materialize

CHANGE = "change_id string, source string, lang string, tokenizer string, old_tokens bigint, new_tokens bigint"
GROUP = ("source", "lang", "tokenizer")
DELTAS = "attempt string, source string, lang string, tokenizer string, n_docs bigint, n_tokens bigint"
COMMITS = "batch_id string, attempt string"
COVERS = "attempt string, batch_id string"


def inserted(docs: DataFrame, tokenizer: str, tokens: Column) -> DataFrame:
    """Changes that add documents (doc_id, source, lang)."""
    return change(docs, tokenizer, F.lit(None), tokens)


def deleted(docs: DataFrame, tokenizer: str, tokens: Column) -> DataFrame:
    """Changes that take documents away again; ``tokens`` is what they counted until now."""
    return change(docs, tokenizer, tokens, F.lit(None))


def revised(docs: DataFrame, tokenizer: str, before: Column, after: Column) -> DataFrame:
    """Changes of documents that stay but count otherwise now."""
    return change(docs, tokenizer, before, after)


def change(docs: DataFrame, tokenizer: str, before: Column, after: Column) -> DataFrame:
    """One change per row; documents without an id have changes without one, so each of them counts."""
    return docs.select(
        F.concat(F.lit(f"{tokenizer}/"), F.col("doc_id").cast("string")).alias("change_id"), "source", "lang",
        F.lit(tokenizer).alias("tokenizer"), before.cast("bigint").alias("old_tokens"), after.cast("bigint").alias("new_tokens"),
    )


class TokenRollup:
    """Totals in a folder that all executors share."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")
        for name, schema in (("deltas", DELTAS), ("commits", COMMITS), ("covers", COVERS)):
            spark.createDataFrame([], schema).write.mode("append").parquet(f"{self.path}/{name}")

    def read(self, name: str, schema: str) -> DataFrame:
        return self.spark.read.schema(schema).parquet(f"{self.path}/{name}")

    def commit(self, batch_id: str, changes: DataFrame) -> None:
        """Add a batch of changes (the columns of CHANGE; others play no part).

        A null old or new count means that the document wasn't or isn't there; a change with both null does nothing. Rows with equal change_id in a
        batch are one change, the one with the largest new, then old count; rows without a change_id are all counted. Null sources, languages and versions are groups of
        their own. An empty batch is committed too. A batch id counts once, whatever comes under it later.
        """
        if not self.standing().where(F.col("batch_id") == batch_id).isEmpty():
            return
        rows = changes.select("change_id", *GROUP, "old_tokens", "new_tokens")
        known = rows.where("change_id is not null").groupBy("change_id").agg(
            F.max(F.struct("new_tokens", "old_tokens", *GROUP)).alias("c")
        ).select(*[F.col("c")[g].alias(g) for g in GROUP], F.col("c")["old_tokens"].alias("old_tokens"), F.col("c")["new_tokens"].alias("new_tokens"))
        once = known.unionByName(rows.where("change_id is null").drop("change_id"))
        there = lambda c: F.when(F.col(c).isNotNull(), 1).otherwise(0)
        sums = once.groupBy(*GROUP).agg(
            F.sum(there("new_tokens") - there("old_tokens")).cast("bigint").alias("n_docs"),
            F.sum(F.coalesce("new_tokens", F.lit(0)) - F.coalesce("old_tokens", F.lit(0))).cast("bigint").alias("n_tokens"),
        )
        self.append(sums, batch_id, None)

    def append(self, sums: DataFrame, batch_id: str | None, covers: DataFrame | None) -> None:
        """Store sums under a new attempt, then commit it: as a batch, or as a summary of the batches that ``covers`` names."""
        attempt = uuid.uuid4().hex
        name = F.lit(attempt).alias("attempt")
        sums.select(name, *GROUP, "n_docs", "n_tokens").write.mode("append").parquet(f"{self.path}/deltas")
        if covers is not None:
            covers.select(name, "batch_id").write.mode("append").parquet(f"{self.path}/covers")
        self.spark.createDataFrame([(batch_id, attempt)], COMMITS).coalesce(1).write.mode("append").parquet(f"{self.path}/commits")

    def standing(self) -> DataFrame:
        """(batch_id, attempt, counts) of all committed batches and, without batch_id, of the newest summary.

        ``counts`` tells whose sums count: the summary's, and those of the first attempt of each batch that it doesn't cover. Batches that
        it covers have no attempt.
        """
        commits = self.read("commits", COMMITS).select("batch_id", "attempt", F.struct(F.col("_metadata.file_modification_time").alias("at"), "attempt").alias("order"))
        summary = commits.where("batch_id is null").agg(F.max("order")["attempt"].alias("attempt")).where("attempt is not null")
        first = commits.where("batch_id is not null").groupBy("batch_id").agg(F.min("order")["attempt"].alias("attempt"))
        covered = self.read("covers", COVERS).join(summary, "attempt", "left_semi").select("batch_id").distinct()
        open_batches = first.join(covered, "batch_id", "left_anti").select("batch_id", "attempt", F.lit(True).alias("counts"))
        return open_batches.unionByName(summary.select(F.lit(None).cast("string").alias("batch_id"), "attempt", F.lit(True).alias("counts"))).unionByName(
            covered.select("batch_id", F.lit(None).cast("string").alias("attempt"), F.lit(False).alias("counts"))
        )

    def totals(self) -> DataFrame:
        """(source, lang, tokenizer, n_docs, n_tokens) of all committed batches; groups that came down to nothing are left out."""
        return self.sums(self.standing())

    def sums(self, standing: DataFrame) -> DataFrame:
        rows = self.read("deltas", DELTAS).join(standing.where("counts").select("attempt"), "attempt", "left_semi")
        sums = rows.groupBy(*GROUP).agg(F.sum("n_docs").alias("n_docs"), F.sum("n_tokens").alias("n_tokens"))
        return sums.where("n_docs <> 0 or n_tokens <> 0")

    def compact(self) -> None:
        """Append one summary of all batches committed until now; their ids stay known, so a late repeat of one still counts nothing.

        Sums and ids come from one stored reading of the commits, so a batch that is committed meanwhile is in neither.
        """
        standing = materialize(self.standing(), "standing")
        self.append(self.sums(standing), None, standing.where("batch_id is not null"))


def word_count(text: Column) -> Column:
    """Words of a text; a null text has none."""
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("bigint")


def piece_count(text: Column) -> Column:
    """Words and the punctuation marks in them."""
    return (word_count(text) + F.coalesce(F.regexp_count(text, F.lit("[.,;:!?]")), F.lit(0))).cast("bigint")
