"""B: projections and keys."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, MapType, StringType, StructType


def _c(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


def unique_audio_name(audio_file, root_path, dataset: str) -> Column:
    """B1: ``{dataset}#{path relative to root, extension removed}``.

    The root is removed as a prefix (with its separator); the extension is the
    last ``.suffix`` of the final path component.
    """
    f, root = _c(audio_file), _c(root_path)
    root_slash = F.concat(F.regexp_replace(root, "/+$", ""), F.lit("/"))
    rel = F.when(F.startswith(f, root_slash), F.substring(f, F.length(root_slash) + 1, 1 << 30)).otherwise(f)
    # Python's splitext keeps leading dots of the file name (".bashrc" has no extension).
    stem = F.regexp_replace(rel, r"(?<=[^/.])\.[^./]*$", "")
    return F.concat(F.lit(dataset + "#"), stem)


def file_key(s) -> Column:
    """B2: URL-safe base64 of the UTF-8 bytes (reversible)."""
    return F.translate(F.base64(F.encode(_c(s), "UTF-8")), "+/", "-_")


def file_key_decode(k) -> Column:
    return F.decode(F.unbase64(F.translate(_c(k), "-_", "+/")), "UTF-8")


def positional_record(fields) -> Column:
    """3/4/5-field array → struct(text, audio_file, speaker_name, root_path, audio_unique_name).

    Other widths fail the row with an error, as the reference raises.
    """
    a = _c(fields)
    n = F.size(a)
    ok = F.when(n.between(3, 5), F.lit(True)).otherwise(
        F.raise_error(F.concat(F.lit("positional record needs 3-5 fields, got "), n.cast("string"))))
    return F.when(ok, F.struct(
        F.element_at(a, 1).alias("text"),
        F.element_at(a, 2).alias("audio_file"),
        F.element_at(a, 3).alias("speaker_name"),
        F.try_element_at(a, F.lit(4)).alias("root_path"),
        F.try_element_at(a, F.lit(5)).alias("audio_unique_name"),
    ))


def audio_samples(seconds, rate) -> Column:
    """Number of samples = int(seconds * rate)."""
    return (_c(seconds) * _c(rate)).cast("long")


def duration_seconds(samples, rate) -> Column:
    return _c(samples).cast("double") / _c(rate)


def duration_ms(samples, rate) -> Column:
    return _c(samples).cast("double") / _c(rate) * 1000.0


def fill_defaults(df: DataFrame, defaults: dict) -> DataFrame:
    """Default for absent columns or null values."""
    for k, v in defaults.items():
        if k in df.columns:
            df = df.withColumn(k, F.coalesce(F.col(k), F.lit(v)))
        else:
            df = df.withColumn(k, F.lit(v))
    return df


def map_strings(col, dtype, fn) -> Column:
    """Apply ``fn: Column -> Column`` to every string inside a nested value.

    Walks the schema and builds ``transform`` / ``transform_values`` / struct
    expressions; non-string leaves pass through unchanged.  (The reference
    raises on other leaves; numbers are kept here and documented as such.)
    """
    c = _c(col)
    if isinstance(dtype, StringType):
        return fn(c)
    if isinstance(dtype, ArrayType):
        return F.transform(c, lambda x: map_strings(x, dtype.elementType, fn))
    if isinstance(dtype, MapType):
        return F.transform_values(c, lambda k, v: map_strings(v, dtype.valueType, fn))
    if isinstance(dtype, StructType):
        return F.struct(*[map_strings(c[f.name], f.dataType, fn).alias(f.name) for f in dtype.fields])
    return c


def rows_to_columns(df: DataFrame, group: str, order: str, cols: list[str]) -> DataFrame:
    """One row per group with one ordered array per column.

    ``collect_list`` alone is unordered; the rows are collected as structs led
    by the order key and sorted, then split into per-column arrays.
    """
    s = F.array_sort(F.collect_list(F.struct(F.col(order).alias("_o"), *[F.col(c) for c in cols])))
    out = df.groupBy(group).agg(s.alias("_rows"))
    def field(name):
        return lambda r: r[name]

    return out.select(group, *[F.transform("_rows", field(c)).alias(c) for c in cols])
