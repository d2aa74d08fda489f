"""D: lookups and joins.  Small dimension sides (id maps, saved speaker sets)
are broadcast after a size check; missing keys fail the job with the key in
the message (``assert_true``/``raise_error``), as the reference raises."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vocable.plans.position import with_position



def dense_ids(df: DataFrame, name_col: str, id_col: str = "id") -> DataFrame:
    """D1 map: ``(name, id)`` with ids = rank over the sorted distinct names, from 0.

    The names are numbered by ranges, so their number does not matter.
    """
    names = df.select(name_col).where(F.col(name_col).isNotNull()).distinct()
    return with_position(names, [name_col], id_col)


def apply_ids(df: DataFrame, id_map: DataFrame, name_col: str, id_col: str = "id") -> DataFrame:
    """D1 join: every name must be in the map (else the job fails naming the key)."""
    j = df.join(id_map, name_col, "left")
    return j.withColumn(id_col, F.when(F.col(id_col).isNotNull(), F.col(id_col)).otherwise(
        F.raise_error(F.concat(F.lit("KeyError: "), F.col(name_col).cast("string")))))


def strict_lookup(df: DataFrame, dim: DataFrame, key: str, value_cols: list[str], what: str = "lookup",
                  broadcast: bool = False) -> DataFrame:
    """Left join + a failing guard when the key has no match."""
    right = dim if broadcast else dim
    j = df.join(right.withColumn("_hit", F.lit(True)), key, "left")
    guard = F.when(F.col("_hit").isNotNull(), F.lit(True)).otherwise(
        F.raise_error(F.concat(F.lit(f"missing {what} for key "), F.col(key).cast("string"))))
    return j.where(guard).drop("_hit")


def zip_by_stem(left: DataFrame, right: DataFrame, stem: str = "stem") -> DataFrame:
    """One-to-one pairing on file stem; a stem missing on either side or
    repeated on one side fails the job."""
    lc = left.groupBy(stem).agg(F.count(F.lit(1)).alias("_ln"))
    rc = right.groupBy(stem).agg(F.count(F.lit(1)).alias("_rn"))
    chk = lc.join(rc, stem, "full_outer")
    bad = (F.col("_ln").isNull() | F.col("_rn").isNull() | (F.col("_ln") > 1) | (F.col("_rn") > 1))
    chk = chk.where(F.when(bad, F.raise_error(F.concat(F.lit("stems do not pair 1:1: "), F.col(stem))))
                    .otherwise(F.lit(True)))
    return left.join(right, stem, "inner").join(chk.select(stem), stem, "left_semi")


def vector_upsert(old: DataFrame, new: DataFrame, key: str, name: str, vec: str) -> DataFrame:
    """Known key → only ``name`` is overwritten (vector kept); old-only rows
    stay; new-only rows take the new vector.  ``source`` says which case."""
    o = old.select(key, F.col(name).alias("_on"), F.col(vec).alias("_ov"))
    n = new.select(key, F.col(name).alias("_nn"), F.col(vec).alias("_nv"))
    j = o.join(n, key, "full_outer")
    src = (F.when(F.col("_on").isNotNull() & F.col("_nn").isNotNull(), F.lit("updated"))
           .when(F.col("_nn").isNull(), F.lit("kept")).otherwise(F.lit("computed")))
    return j.select(key, F.coalesce("_nn", "_on").alias(name), F.coalesce("_ov", "_nv").alias(vec), src.alias("source"))


def cache_miss_compute(df: DataFrame, store: DataFrame, key: str, compute) -> DataFrame:
    """Rows with a stored feature use it; the misses are computed by
    ``compute(DataFrame) -> DataFrame(key, feature...)`` and appended."""
    hits = df.select(key).join(store, key, "inner").withColumn("from_cache", F.lit(True))
    misses = compute(df.join(store.select(key), key, "left_anti")).withColumn("from_cache", F.lit(False))
    return hits.unionByName(misses)


def missing_from_set(df: DataFrame, saved: DataFrame, key: str) -> DataFrame:
    """Keys present in the data but absent from the saved set (must be empty)."""
    return df.select(key).distinct().join(saved.select(key), key, "left_anti")


def require_contained(df: DataFrame, saved: DataFrame, key: str) -> None:
    missing = missing_from_set(df, saved, key)
    if not missing.isEmpty():
        raise KeyError(f"keys not in the saved set: {[r[0] for r in missing.limit(20).collect()]}")
