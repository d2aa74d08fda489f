"""Exact dedup by distributed MSD radix partitioning.

Equality is decided by the bytes themselves, never by a digest.  Round *k*
looks at the next *digit* of every text that is still undecided: a run of bytes
whose width grows eightfold each round (64, 448, 3584, ... bytes, so offsets
64, 512, 4096, ...).  Rows that share a group and the digit form the next
group:

* alone in its group → unique, decided;
* the texts of the group have ended with this digit → all equal, decided;
* otherwise the group goes on with the bytes that are left.

Only undecided rows, without the bytes already compared, are carried to the
next round, so a byte is shuffled at most once per round it survives and the
number of rounds is logarithmic in the longest text that has a copy.

Scale: group sizes come from a partial aggregation (a hot group is one row per
task), group numbers are given to groups of two or more only and written to
the shared folder before use (a lost executor can't renumber them), rows join
them by a plain equi-join that adaptive execution may split where a group is
hot.  Nothing is collected; the driver sees one row count per round.

Edge cases: null text counts as empty; empty texts are equal to each other; a
null doc_id is never the row that stays unless all ids of the group are null;
rows that repeat a doc_id are separate rows, ``kept`` is true for each row
whose doc_id is the smallest; an empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vocable.llm.store import scratch, written

#: First digit width in bytes and growth of the offset per round.
FIRST, GROWTH = 64, 8


def normalised(text: Column) -> Column:
    """Runs of \\x20, \\x09-\\x0D become one space; null becomes empty."""
    return F.regexp_replace(F.coalesce(text, F.lit("")), r"[\x20\x09-\x0D]+", " ")


def _round(rows: DataFrame, width: int, k: int) -> DataFrame:
    """One radix step over (doc_id, sha, grp, rest): adds keep_id, group_size, done."""
    cut = rows.withColumn("digit", F.substring("rest", 1, width)).withColumn(
        "rest", F.expr(f"substring(rest, {width + 1})"))
    groups = (cut.groupBy("grp", "digit").agg(F.count(F.lit(1)).alias("group_size"), F.min("doc_id").alias("keep_id"))
              .where("group_size > 1").withColumn("next_grp", F.monotonically_increasing_id()))
    groups = written(groups, f"radix-groups-{k}")
    # always by merge: the plan, and what it shuffles, is the same at every size
    out = cut.join(groups.hint("merge"), ["grp", "digit"], "left")
    alone, ended = F.col("group_size").isNull(), F.octet_length("digit") < width
    done = alone | ended
    return out.select(
        "doc_id", "sha",
        F.when(alone, F.col("doc_id")).otherwise(F.col("keep_id")).alias("keep_id"),
        F.coalesce("group_size", F.lit(1)).cast("long").alias("group_size"),
        F.coalesce("next_grp", F.lit(-1)).cast("long").alias("grp"),
        F.when(~done, F.col("rest")).alias("rest"),
        done.alias("done"))


def radix_groups(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Per row: doc_id, keep_id, group_size, text_sha256 of the normalised text."""
    spark = docs.sparkSession
    norm = docs.select(F.col(doc_id).alias("doc_id"), normalised(F.col(text).cast("string")).alias("norm"))
    rows = norm.select("doc_id", F.sha2("norm", 256).alias("sha"), F.lit(0).cast("long").alias("grp"),
                       F.col("norm").cast("binary").alias("rest"))
    decided, offset, k = [], 0, 0
    while True:
        width = FIRST if offset == 0 else offset * (GROWTH - 1)
        step = _round(rows, width, k)
        path = scratch(spark, f"radix-{k}")
        step.write.partitionBy("done").parquet(path)
        back = spark.read.schema(step.schema).parquet(path)
        decided.append(back.where("done").select("doc_id", "keep_id", "group_size", F.col("sha").alias("text_sha256")))
        rows = back.where("not done").select("doc_id", "sha", "grp", "rest")
        if rows.isEmpty():
            break
        offset, k = offset + width, k + 1
    out = decided[0]
    for d in decided[1:]:
        out = out.unionByName(d)
    return out


def exact_dedup(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per document: doc_id, keep_id, group_size, kept, text_sha256."""
    g = radix_groups(docs, doc_id, text)
    return g.select("doc_id", "keep_id", "group_size",
                    F.col("doc_id").eqNullSafe(F.col("keep_id")).alias("kept"), "text_sha256")


def keep_first(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """The rows of ``docs`` that stay, with their columns as they were; of rows that
    repeat both id and text one stays.  The digest only tells rows of one id apart."""
    gone = exact_dedup(docs, doc_id, text).where("not kept").select(
        F.col("doc_id").alias("_gone"), F.col("text_sha256").alias("_gone_sha")).distinct()
    named = docs.withColumn("_sha", F.sha2(normalised(F.col(text).cast("string")), 256))
    left = named.join(gone.hint("merge"), named[doc_id].eqNullSafe(gone._gone) & (named._sha == gone._gone_sha), "left_anti")
    return left.dropDuplicates([doc_id, "_sha"]).drop("_sha")
