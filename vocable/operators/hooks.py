"""U: user-function surface (caller code plugged into Spark jobs).

U1 formatter callables: ``sources.metadata.load_dataset``; U2 cleaners:
``functions.text.register_cleaner``; U4 vocabularies: a DataFrame argument to
``operators.vocab``; U6 sort keys: Column arguments; U8 batch hooks:
``DataFrame.transform``.  This module holds the hooks that run caller Python
on executors, always Arrow-batched.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


def phonemizer_udf(make_backend: Callable[[], Callable[[str], str]]):
    """A phonemiser backend as an ``Iterator[pd.Series]`` pandas UDF; the
    backend is built once per task (per-worker init), then applied per batch."""
    @F.pandas_udf(T.StringType())
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        backend = make_backend()
        for s in batches:
            yield s.map(lambda t: None if t is None else backend(t))
    return run


def phonemize_by_language(df: DataFrame, text: str, lang: str, backends: dict[str, Callable[[Column], Column]],
                          out: str = "phonemes") -> DataFrame:
    """Route each language to its backend; an unknown language fails the
    job.  One CASE over the languages keeps it to a single pass."""
    expr = None
    for code, fn in backends.items():
        e = fn(F.col(text))
        expr = F.when(F.col(lang) == code, e) if expr is None else expr.when(F.col(lang) == code, e)
    expr = expr.otherwise(F.raise_error(F.concat(F.lit("no phonemiser for language "), F.col(lang))))
    return df.withColumn(out, expr)


def vectorise(df: DataFrame, id_col: str, input_col: str, fn: Callable[[np.ndarray], np.ndarray], dim: int,
              out: str = "embedding") -> DataFrame:
    """The caller's vectoriser on Arrow batches (``mapInPandas``): ``fn``
    maps a batch of inputs (object array of lists) to an (n, dim) array."""
    schema = T.StructType([df.schema[id_col], T.StructField(out, T.ArrayType(T.FloatType()))])

    def run(batches):
        for pdf in batches:
            if len(pdf) == 0:
                continue
            vecs = np.asarray(fn(pdf[input_col].to_numpy()), dtype=np.float32).reshape(len(pdf), dim)
            yield pd.DataFrame({id_col: pdf[id_col], out: list(vecs)})

    return df.select(id_col, input_col).mapInPandas(run, schema=schema)


def sentence_chunks(df: DataFrame, text: str, limit: int = 250, keep: list[str] | None = None) -> DataFrame:
    """The row-expanding segmenter: one row ``(keep…, k, chunk)`` per chunk of J19."""
    from vocable.functions.text import pack_sentences, sentences

    return df.select(*(keep or []), F.posexplode(pack_sentences(sentences(text), limit, F.col(text))).alias("k", "chunk"))
