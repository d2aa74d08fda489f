"""Pronunciation lexicon parse, lookup and re-assembly.

Distinct words are looked up with a join on the upper-cased word; words exploded
with their position take their tokens from that table and are re-assembled per
document in position order.

A corpus in blocks (``in_blocks``) keeps its words where they are: each block sends
its distinct words to the lexicon and gets their tokens back, so that besides the
texts only a block's distinct words are shuffled, not one row per word.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vocable.session import written

#: Distinct words up to this many are broadcast to the words of the corpus; more are joined by a shuffle.
BROADCAST_WORDS = 1_000_000
#: Text of a block, which one task holds with its distinct words; text that is looked up at once.
BLOCK_BYTES, SLICE_BYTES = 16 << 20, 4 << 20


# Fixed value: punctuation kept outside a looked-up word (one leading, one trailing).
LEXICON_PUNCTUATION = "!'(),-.:;? "


def parse_lexicon(lines: DataFrame, line_col: str = "value", valid_symbols: list[str] | None = None,
                  drop_ambiguous: bool = False) -> DataFrame:
    """``WORD  PH1 PH2`` lines → ``(word, pron, alt)``.

    Lines must start with A–Z or an apostrophe; ``WORD(2)`` is an alternate of
    WORD; an entry with a symbol outside ``valid_symbols`` is dropped.
    """
    l = lines.where(F.col(line_col).rlike("^[A-Z']"))
    parts = F.split(F.col(line_col), "  ", 2)
    e = l.select(F.element_at(parts, 1).alias("_w"), F.trim(F.element_at(parts, 2)).alias("pron"))
    e = e.select(F.regexp_replace("_w", r"\(\d+\)$", "").alias("word"),
                 F.coalesce(F.regexp_extract("_w", r"\((\d+)\)$", 1).try_cast("int"), F.lit(1)).alias("alt"), "pron")
    e = e.where(F.col("pron").isNotNull())
    if valid_symbols is not None:
        vs = F.array(*[F.lit(s) for s in valid_symbols])
        e = e.where(F.forall(F.split("pron", " "), lambda s: F.array_contains(vs, s)))
    if drop_ambiguous:
        single = e.groupBy("word").agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") == 1).select("word")
        e = e.join(single, "word", "left_semi")
    return e


def first_pronunciations(lex: DataFrame) -> DataFrame:
    """The first pronunciation of each word (lowest alternate number)."""
    return lex.groupBy("word").agg(F.min_by("pron", "alt").alias("pron"))


def in_blocks(df: DataFrame, doc: str, text: str, block: str = "_block") -> DataFrame:
    """Rows that have a text, with the number of their block, one block to a partition; a block has
    about ``BLOCK_BYTES`` of text or less, and all rows of a document are in the same one."""
    spark = df.sparkSession
    df = df.select(doc, text).where(F.col(text).isNotNull())
    size = df.agg(F.sum(F.octet_length(text))).first()[0] or 0
    n = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-size // BLOCK_BYTES))
    # the smallest number that hashes to each partition
    k = F.col("id").cast("int")
    found = spark.range(32 * n).groupBy(F.pmod(F.hash(k), F.lit(n)).alias("p")).agg(F.min(k).alias("k")).orderBy("p")
    numbers = F.array(*[F.lit(r.k) for r in found.collect()])
    number = F.coalesce(F.get(numbers, F.pmod(F.hash(doc), F.size(numbers))), F.lit(0))
    return df.repartition(n, number).withColumn(block, number)


def _parts(puncs: str) -> tuple[Column, Column, Column]:
    """Of the word ``w``: its leading mark, the form to look up, its trailing mark."""
    cls = "[" + "".join("\\" + c if c in r"\^]-[" else c for c in puncs) + "]"
    w, none = F.col("w"), F.lit("")
    starts = w.rlike("^" + cls)
    rest = F.when(starts, w.substr(F.lit(2), F.length(w))).otherwise(w)
    ends = rest.rlike(cls + "$")
    core = F.when(ends, rest.substr(F.lit(1), F.length(rest) - 1)).otherwise(rest)
    return F.when(starts, w.substr(1, 1)).otherwise(none), F.upper(core), F.when(ends, rest.substr(-1, 1)).otherwise(none)


def _look_up(slice_bytes: int):
    """One block's ``(block, doc, text)`` with its ``(block, w, token)`` as ``(doc, tokens)``, words without a token as
    they are; rows of the same document are one, by position and then by token."""
    def run(docs: pa.Table, tokens: pa.Table) -> pa.Table:
        words, tokens = tokens.column(1).combine_chunks(), tokens.column(2).combine_chunks()
        key = pc.dictionary_encode(docs.column(1).combine_chunks(), null_encoding="encode").indices.to_numpy()
        order = np.argsort(key, kind="stable")
        key, docs = key[order], docs.select([1, 2]).take(pa.array(order))
        ends = np.append(np.flatnonzero(np.diff(key)) + 1, len(key))
        total = np.cumsum(pc.binary_length(docs.column(1)).to_numpy())[ends - 1]
        out, start = [], 0
        for end in ends[np.append(np.diff(total // slice_bytes) > 0, True)]:
            part, own = docs.slice(start, end - start), key[start:end]
            split = pc.split_pattern(part.column(1).combine_chunks(), " ")
            offsets, flat = np.asarray(split.offsets), split.flatten()
            flat = pc.coalesce(tokens.take(pc.index_in(flat, value_set=words)), flat)
            firsts = np.flatnonzero(np.append(True, np.diff(own) > 0))
            if len(firsts) < len(own):
                row = np.repeat(np.arange(len(own)), np.diff(offsets))
                idx = np.arange(len(flat)) - offsets[row]
                flat = flat.take(pc.sort_indices(pa.table({"d": own[row], "i": idx, "t": flat}), [(c, "ascending") for c in "dit"]))
            lists = pa.ListArray.from_arrays(pa.array(np.append(offsets[firsts], offsets[-1]), pa.int32()), flat)
            out.append(pa.table([part.column(0).take(pa.array(firsts)), lists], ["doc", "tokens"]))
            start = end
        return pa.concat_tables(out)
    return run


def lookup_words(df: DataFrame, doc: str, text: str, lex_first: DataFrame,
                 puncs: str = LEXICON_PUNCTUATION, block: str | None = None) -> DataFrame:
    """``(doc, idx, token)`` with each word replaced by ``{pron}`` when the
    upper-cased word (one leading/trailing punctuation mark removed) is in the
    lexicon, the word unchanged otherwise.  With the ``block`` of ``in_blocks`` words
    stay in their block, and the result is ``(doc, tokens)``, a list in position order."""
    keys = [block] if block else []
    words = df.select(*keys, doc, F.posexplode(F.split(F.col(text), " ", -1)).alias("idx", "w"))
    w = words.select(*keys, "w").distinct()
    first, word, last = _parts(puncs)
    if block:
        w = w.repartition(word)  # sent without the form to look up
    tok = F.when(F.col("pron").isNotNull(), F.concat(first, F.lit("{"), F.col("pron"), F.lit("}"), last)).otherwise(F.col("w"))
    tokens = w.withColumn("word", word).join(lex_first, "word", "left").select(*keys, "w", tok.alias("token"))
    if block:
        tokens = tokens.where(F.col("token") != F.col("w")).withColumnRenamed(block, "_to")
        looked_up = df.select(block, doc, text).groupBy(block).cogroup(tokens.groupBy("_to")).applyInArrow(
            _look_up(SLICE_BYTES), f"doc {df.schema[doc].dataType.simpleString()}, tokens array<string>")
        return looked_up.withColumnRenamed("doc", doc)
    tokens = written(tokens, "lexicon-tokens")
    if tokens.count() <= BROADCAST_WORDS:
        tokens = F.broadcast(tokens)
    return words.join(tokens, "w").select(doc, "idx", "token")


def reassemble(tokens: DataFrame, doc: str, idx: str = "idx", token: str = "token", sep: str = " ",
               lists: str | None = None) -> DataFrame:
    """Tokens back into one string per document, in position order; ``lists``
    names the column where a document's tokens are already one list."""
    if lists:
        return tokens.select(doc, F.array_join(lists, sep).alias("phonemes"))
    g = tokens.groupBy(doc).agg(F.array_sort(F.collect_list(F.struct(idx, token))).alias("_t"))
    return g.select(doc, F.array_join(F.transform("_t", lambda t: t[token]), sep).alias("phonemes"))


def lexicon_from_corpus(df: DataFrame, text: str, block: str | None = None) -> DataFrame:
    """Lexicon of all upper-cased corpus words (punctuation removed),
    pronunciation = the letters separated by spaces.  With the ``block`` of ``in_blocks``
    a block's distinct words stand for its texts."""
    if block:
        df = df.select(block, F.explode(F.split(F.col(text), " ", -1)).alias(text)).distinct()
    words = df.select(F.explode(F.split(F.upper(F.regexp_replace(F.col(text), r"[^A-Za-z' ]", "")), " ", -1))
                      .alias("word")).where(F.col("word") != "").distinct()
    return words.select("word", F.array_join(F.split("word", "", -1), " ").alias("pron"), F.lit(1).alias("alt"))
