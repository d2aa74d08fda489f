"""Quality rules as a bitmask ledger.

Every rule is evaluated once per document.  The ledger keeps the raw
measurements and one integer whose bit *b* is set when rule *b* failed.  A
policy is a named, versioned set of bits; applying one, changing one or asking
what a rule costs never touches the text again:

* :func:`ledger` — documents → measurements + ``fail_bits`` (no shuffle);
* :func:`apply_policy` — ledger → ``kept`` by ``fail_bits & policy = 0``;
* :func:`ablation` — per rule and policy: documents failing it, documents
  failing only it, documents kept when it is left out; bitwise sums, one
  partial aggregation of a few rows.

Edge cases: a null or empty text has no words, fails ``few_words`` and carries
zero measurements; repeated rows are measured each on its own; an empty table
gives an empty ledger; other columns of the input are passed on under their
own names unless they clash with a measurement, in which case the measurement
replaces them.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from vocable.llm.textbytes import SPACE, U64, Texts, chunks, mix, shingle_hashes

#: The symbols that count as n_symbols.
SYMBOLS = np.zeros(256, bool)
SYMBOLS[[ord(c) for c in "#*$%&|<>"]] = True

# Characters that end a sentence, and those that may follow them.
SENTENCE_ENDS = ".!?…。！？｡।॥۔؟։።။‼⁇⁈⁉"
CLOSERS = "\"'”’»›)]}）」』】〉》"

MEASURES = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines",
            "n_upper", "n_lower", "n_ends"]

#: Rule name → SQL predicate over the measurements that is true when the rule fails.
#: The order is the bit order and must only ever be appended to.  Integers only,
#: so that every engine decides alike.
RULES: dict[str, str] = {
    "few_words": "n_words < 50",
    "repeat_words": "100 * n_repeat_words > 50 * n_words",
    "symbols": "10 * n_symbols > n_words",
    "short_words": "word_chars < 2 * n_words",
    "long_words": "word_chars > 15 * n_words",
    "dup_lines": "n_lines >= 4 and 100 * n_dup_lines > 60 * n_lines",
    "shouting": "n_upper > n_lower",
    "no_sentences": "n_words >= 50 and 200 * n_ends < n_words",
}
BIT = {name: 1 << i for i, name in enumerate(RULES)}


def policy(*rules: str) -> int:
    return sum(BIT[r] for r in rules)


#: Policies by version.  ``base`` is fixed by contract.
POLICIES: dict[str, int] = {
    "base": policy("few_words", "repeat_words"),
    "v1": policy("few_words", "repeat_words", "symbols", "short_words", "long_words", "dup_lines",
                 "shouting", "no_sentences"),
}


def _per_row_distinct(row: np.ndarray, h: np.ndarray, n: int) -> np.ndarray:
    """Number of distinct hashes of each row."""
    key = np.unique(np.stack([row.astype(U64), h]), axis=1) if len(h) else None
    return np.bincount(key[0].astype(np.int64), minlength=n) if key is not None else np.zeros(n, np.int64)


def _codes(chars: str) -> np.ndarray:
    """The UTF-8 bytes of each character as one number."""
    return np.array(sorted(int.from_bytes(c.encode(), "big") for c in chars), np.int64)


_ENDS, _CLOSERS = _codes(SENTENCE_ENDS), _codes(CLOSERS)
#: Last bytes with which a word can end a sentence.
_MAY_END = np.zeros(256, bool)
_MAY_END[[c.encode()[-1] for c in SENTENCE_ENDS + CLOSERS]] = True


def _last_chars(b: np.ndarray, s: np.ndarray, e: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(bytes of the last character as one number, where it begins) of each ``b[s:e]``."""
    at, code, shift = e - 1, b[e - 1].astype(np.int64), 8
    for _ in range(3):
        more = ((b[at] & 0xC0) == 0x80) & (at > s)
        at = at - more
        code = np.where(more, code | (b[at].astype(np.int64) << shift), code)
        shift += 8
    return code, at


def ends_of_sentences(b: np.ndarray, s: np.ndarray, e: np.ndarray) -> np.ndarray:
    """Indices of the words ``b[s:e]`` that end a sentence, closing quotes and brackets aside."""
    word, out = np.flatnonzero(_MAY_END[b[e - 1]]) if len(e) else np.zeros(0, np.int64), []
    stop = e[word]
    while len(word):
        code, at = _last_chars(b, s[word], stop)
        out.append(word[np.isin(code, _ENDS)])
        go = np.isin(code, _CLOSERS) & (at > s[word])
        word, stop = word[go], at[go]
    return np.concatenate(out) if out else word


def measure(texts: pa.Array) -> dict[str, np.ndarray]:
    """All measurements of a chunk of texts, one value per text."""
    t = Texts(texts)
    n, b = t.n, t.buf
    row, s, e = t.words()
    out = {"n_words": np.bincount(row, minlength=n)}
    word_byte = ~SPACE[b]
    out["word_chars"] = t.count_mask(word_byte & ((b & 0xC0) != 0x80))
    out["n_symbols"] = t.count_mask(SYMBOLS[b])
    out["n_upper"] = t.count_mask((b >= 65) & (b <= 90))
    out["n_lower"] = t.count_mask((b >= 97) & (b <= 122))
    out["n_ends"] = np.bincount(row[ends_of_sentences(b, s, e)], minlength=n)

    lrow, ls, le = t.lines()
    c = np.zeros(len(b) + 1, np.int64)
    np.cumsum(word_byte, out=c[1:])
    full = c[le] > c[ls]
    lrow, ls, le = lrow[full], ls[full], le[full]
    out["n_lines"] = np.bincount(lrow, minlength=n)
    lines = np.unique(mix(t.hash_ranges(ls, le) ^ mix(lrow.astype(U64))), return_index=True)[1]
    out["n_dup_lines"] = out["n_lines"] - np.bincount(lrow[lines], minlength=n)

    at, h = shingle_hashes(row, t.hash_ranges(s, e), 3)
    key = mix(h ^ mix(row[at].astype(U64)))
    srt = np.sort(key)
    twice = np.unique(srt[1:][srt[1:] == srt[:-1]])
    if len(twice):
        pos = np.searchsorted(twice, key)
        rep = at[twice[np.minimum(pos, len(twice) - 1)] == key]
        edge = np.zeros(len(row) + 4, np.int64)
        np.add.at(edge, rep, 1)
        np.add.at(edge, rep + 3, -1)
        covered = np.cumsum(edge)[:len(row)] > 0
        out["n_repeat_words"] = np.bincount(row[covered], minlength=n)
    else:
        out["n_repeat_words"] = np.zeros(n, np.int64)
    return out


def _measurer(text: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in chunks(batch, text):
                m = measure(part.column(part.schema.get_field_index(text)))
                keep = [(f.name, part.column(i)) for i, f in enumerate(part.schema) if f.name != text]
                yield pa.RecordBatch.from_arrays(
                    [a for _, a in keep] + [pa.array(m[k], pa.int64()) for k in MEASURES],
                    names=[k for k, _ in keep] + MEASURES)
    return run


def measurements(docs: DataFrame, text: str = "text", keep: list[str] | None = None) -> DataFrame:
    """``keep`` columns plus the measurements of ``text``; one pass, no shuffle."""
    keep = [c for c in (keep if keep is not None else docs.columns) if c != text and c not in MEASURES]
    src = docs.select(*[F.col(f"`{c}`") for c in keep], F.col(text).cast("string").alias("_text"))
    schema = T.StructType([src.schema[c] for c in keep] + [T.StructField(m, T.LongType()) for m in MEASURES])
    return src.mapInArrow(_measurer("_text"), schema)


def fail_bits() -> Column:
    bits = [F.when(F.expr(sql), F.lit(BIT[name])).otherwise(F.lit(0)) for name, sql in RULES.items()]
    total = bits[0]
    for b in bits[1:]:
        total = total.bitwiseOR(b)
    return total.cast("long")


def ledger(docs: DataFrame, text: str = "text", keep: list[str] | None = None) -> DataFrame:
    """The bitmask ledger: ``keep`` columns, measurements, ``fail_bits``."""
    return measurements(docs, text, keep).withColumn("fail_bits", fail_bits())


def apply_policy(led: DataFrame, version: str = "v1", col: str = "kept") -> DataFrame:
    return led.withColumn(col, F.col("fail_bits").bitwiseAND(F.lit(POLICIES[version])) == 0)


def ablation(led: DataFrame, version: str = "v1") -> DataFrame:
    """Per rule of a policy: documents that fail it, that fail only it (what the
    rule alone costs), and that are kept by the policy without it.

    Aggregates the distinct bit patterns first (at most 2**rules rows reach the
    shuffle), then splits each pattern by bit.
    """
    mask = POLICIES[version]
    patterns = led.groupBy(F.col("fail_bits").bitwiseAND(F.lit(mask)).alias("bits")).agg(
        F.count(F.lit(1)).alias("n"))
    names = [r for r in RULES if BIT[r] & mask]
    rules = F.explode(F.array(*[F.struct(F.lit(r).alias("rule"), F.lit(BIT[r]).cast("long").alias("bit"))
                                for r in names]))
    x = patterns.select("bits", "n", rules.alias("r")).select("bits", "n", "r.rule", "r.bit")
    hit = F.col("bits").bitwiseAND(F.col("bit")) != 0
    without = F.col("bits").bitwiseAND(F.lit(mask).cast("long").bitwiseXOR(F.col("bit"))) == 0
    n = F.col("n")
    return x.groupBy("rule").agg(
        F.sum(F.when(hit, n).otherwise(0)).alias("n_failed"),
        F.sum(F.when(F.col("bits") == F.col("bit"), n).otherwise(0)).alias("n_failed_only"),
        F.sum(F.when(without, n).otherwise(0)).alias("n_kept_without"))


def quality_ledger(docs: DataFrame, doc_id: str = "doc_id", text: str = "text",
                   version: str = "v1") -> DataFrame:
    """Contract columns per document, with ``fail_bits`` and the policy version."""
    led = apply_policy(ledger(docs, text, [doc_id]), version)
    return led.withColumn("base_failed", F.col("fail_bits").bitwiseAND(F.lit(POLICIES["base"])) != 0).select(
        doc_id, *MEASURES[:5], "base_failed", "kept", "fail_bits")


def keep_good(docs: DataFrame, text: str = "text", version: str = "v1") -> DataFrame:
    """The rows of ``docs`` that the policy keeps, with their columns as they were."""
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), F.col(text).alias("_text"))
    return apply_policy(ledger(rows, "_text", ["row"]), version).where("kept").select("row.*")
