"""Character inventory, vocabulary and encoding."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from vocable.functions.text import chars
from vocable.operators.common import let

# Default special tokens (in vocabulary order) and punctuation.
PAD, EOS, BOS, BLANK = "<PAD>", "<EOS>", "<BOS>", "<BLNK>"
DEFAULT_PUNCTUATIONS = "!'(),-.:;? "


def distinct_chars(df: DataFrame, text_col: str = "text") -> DataFrame:
    """Distinct characters ``(ch)``.  Each row first keeps only its own
    distinct characters, so the exploded rows shrink before the shuffle."""
    return (df.select(F.explode(F.array_distinct(chars(F.col(text_col)))).alias("ch"))
            .where(F.col("ch") != "")
            .distinct())


def char_inventory(df: DataFrame, text_col: str = "text") -> DataFrame:
    """``(ch, is_lower, lowered)`` for each distinct character."""
    d = distinct_chars(df, text_col)
    return d.select("ch", (F.lower("ch") == F.col("ch")).alias("is_lower"), F.lower("ch").alias("lowered"))


def build_vocabulary(df: DataFrame, text_col: str = "text",
                     specials=(PAD, EOS, BOS, BLANK), punctuations: str = DEFAULT_PUNCTUATIONS) -> DataFrame:
    """``(id, ch)`` = specials, sorted unique corpus characters, punctuation.

    Characters that are punctuation are taken from the punctuation list only,
    so the vocabulary has no duplicates (duplicates are an error).
    """
    spark = df.sparkSession
    puncs = list(dict.fromkeys(punctuations))
    if len(puncs) != len(punctuations):
        raise ValueError("duplicate characters in the punctuation set")
    corpus = distinct_chars(df, text_col).where(~F.col("ch").isin(puncs + list(specials)))
    n_spec = len(specials)
    # Corpus characters (group 0, sorted) then punctuation (group 1, in order)
    # numbered by one window over the character set only -- a single pass
    # over the corpus, and the window's size is the character set.
    punc_df = spark.createDataFrame([(1, i, p) for i, p in enumerate(puncs)], "grp int, k long, ch string")
    both = corpus.select(F.lit(0).alias("grp"), F.lit(None).cast("long").alias("k"), "ch").unionByName(punc_df)
    ranked = both.select((F.row_number().over(Window.orderBy("grp", "k", "ch")) + (n_spec - 1)).cast("long")
                         .alias("id"), "ch")
    fixed = spark.createDataFrame([(i, s) for i, s in enumerate(specials)], "id long, ch string")
    return fixed.unionByName(ranked)


#: Code points below this are looked up in an array, the others in a map.
DENSE = 0x250


def vocab_lut(vocab: DataFrame) -> Column:
    """Lookup ``struct(low array by code point + 1, high map)`` of a character vocabulary.

    A vocabulary of characters has at most as many rows as Unicode has code
    points.  ``element_at`` on the array is O(1); only characters beyond Latin
    go through the map, whose entries are the characters present.
    """
    rows = vocab.where(F.length("ch") == 1).select(F.ascii("ch").alias("cp"), "id").collect()
    low = {r.cp: r.id for r in rows if r.cp < DENSE}
    high = [x for r in rows if r.cp >= DENSE for x in (F.lit(r.cp), F.lit(r.id).cast("long"))]
    array = F.array(*[F.lit(low.get(cp)).cast("long") for cp in range(max(low, default=0) + 1)])
    return F.struct(array.alias("low"), (F.create_map(*high) if high else F.create_map().cast("map<int,bigint>")).alias("high"))


def encode_chars_lut(text: Column, lut: Column) -> Column:
    """J22 with a code-point table: unknown characters are dropped."""
    def encode(t: Column) -> Column:
        def one(c: Column) -> Column:
            cp = F.ascii(c)
            return F.when(cp < DENSE, F.try_element_at(t["low"], cp + 1)).otherwise(F.try_element_at(t["high"], cp))
        return F.filter(F.transform(chars(text), one), lambda x: x.isNotNull())
    return let(lut, encode)


def decode_ids(ids: Column, inv_map: Column) -> Column:
    """J22 inverse: concatenation of the characters of the ids."""
    return F.array_join(F.transform(ids, lambda i: F.try_element_at(inv_map, i)), "")


def oov_report(df: DataFrame, vocab: DataFrame, text_col: str = "text") -> DataFrame:
    """Characters the encoder would drop, with their counts."""
    exploded = df.select(F.explode(chars(F.col(text_col))).alias("ch")).where(F.col("ch") != "")
    # counted first: what is joined is one row per character, not the corpus
    counted = exploded.groupBy("ch").agg(F.count(F.lit(1)).alias("n"))
    return counted.join(vocab.select("ch"), "ch", "left_anti")
