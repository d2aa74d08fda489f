"""C: filters and predicates.  Each filter has a ``*_flag`` form (a boolean
Column, so kept and rejected rows come from one pass) and a DataFrame form."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vocable.operators.common import col

# Fixed value: characters Python's str.isdigit() accepts beyond \p{Nd}
# (superscripts, subscripts, circled/parenthesised digits, Ethiopic digits...).
DIGIT_CLASS = (r"[\p{Nd}\x{B2}\x{B3}\x{B9}\x{2070}\x{2074}-\x{2079}\x{2080}-\x{2089}"
               r"\x{2460}-\x{2468}\x{2474}-\x{247C}\x{2488}-\x{2490}\x{24EA}\x{24F5}-\x{24FD}"
               r"\x{2776}-\x{277E}\x{2780}-\x{2788}\x{278A}-\x{2792}\x{1369}-\x{1371}\x{19DA}"
               r"\x{1F100}-\x{1F10A}]")


# ---------------------------------------------------------------- C1
def length_ok(text_len, audio_len, min_text: int, max_text: int, min_audio: int, max_audio: int) -> Column:
    """Min ≤ len ≤ max on text **and** audio lengths."""
    return col(text_len).between(min_text, max_text) & col(audio_len).between(min_audio, max_audio)


def length_bounds(df: DataFrame, min_text: int, max_text: int, min_audio: int, max_audio: int,
                  text_col: str = "text_length", audio_col: str = "audio_length") -> DataFrame:
    return df.where(length_ok(text_col, audio_col, min_text, max_text, min_audio, max_audio))


def length_rejected(df: DataFrame, min_text: int, max_text: int, min_audio: int, max_audio: int,
                    text_col: str = "text_length", audio_col: str = "audio_length") -> DataFrame:
    """Rows failing either bound (the union of both ignore lists).  Null lengths count as rejected."""
    ok = length_ok(text_col, audio_col, min_text, max_text, min_audio, max_audio)
    return df.where(~F.coalesce(ok, F.lit(False)))


# ---------------------------------------------------------------- C2, C3
def ignore_speakers(df: DataFrame, speakers, speaker_col: str = "speaker_name") -> DataFrame:
    """Drop rows of listed speakers (a short literal list, or a DataFrame ``(speaker_name)``)."""
    if isinstance(speakers, DataFrame):
        return df.join(speakers.select(F.col(speakers.columns[0]).alias(speaker_col)).distinct(),
                       speaker_col, "left_anti")
    return df.where(~F.col(speaker_col).isin(list(speakers)) | F.col(speaker_col).isNull())


def existing_files(df: DataFrame, listing: DataFrame, file_col: str = "audio_file",
                   listing_col: str = "path") -> DataFrame:
    """Keep rows whose file appears in a listing (semi join, no per-row stat)."""
    return df.join(listing.select(F.col(listing_col).alias(file_col)), file_col, "left_semi")


def missing_files(df: DataFrame, listing: DataFrame, file_col: str = "audio_file",
                  listing_col: str = "path") -> DataFrame:
    return df.join(listing.select(F.col(listing_col).alias(file_col)), file_col, "left_anti")


# ---------------------------------------------------------------- C4, C5
def has_digit(text) -> Column:
    """C4: Python ``any(str.isdigit)``."""
    return col(text).rlike(DIGIT_CLASS)


def transcript_ok(text, n_samples=None, n_tokens=None, min_wav: int | None = None, max_wav: int | None = None,
                  min_tokens: int | None = None, max_tokens: int | None = None, mode: str = "strict") -> Column:
    """Text not '', not '<music>', at least 5 characters; strict mode also
    applies ``min < len < max`` on samples and tokens (the reference's bounds
    test can never fail; ``mode="compat"`` keeps only the text rules)."""
    t = col(text)
    ok = (t != "") & (t != "<music>") & (F.length(t) >= 5)
    if mode == "strict":
        if n_samples is not None and min_wav is not None and max_wav is not None:
            ok = ok & (col(n_samples) > min_wav) & (col(n_samples) < max_wav)
        if n_tokens is not None and min_tokens is not None and max_tokens is not None:
            ok = ok & (col(n_tokens) > min_tokens) & (col(n_tokens) < max_tokens)
    elif mode != "compat":
        raise ValueError("mode is 'strict' or 'compat'")
    return ok


# ---------------------------------------------------------------- C6, C7, C8
def post_token_reason(n_tokens, n_samples, max_text_len: int, min_audio_len: int) -> Column:
    """Reason a row is rejected after tokenisation, null when kept."""
    return (F.when(col(n_tokens) > max_text_len, F.lit("text_too_long"))
            .when(col(n_samples) < min_audio_len, F.lit("audio_too_short")))


def validity_reason(text, n_samples, n_tokens, rate: int, max_wav_len: int | None,
                    max_text_len: int | None, loaded=None) -> Column:
    """First failing rule, in the reference's order; null when valid."""
    r = F.when(F.lit(False), F.lit(None).cast("string"))
    if loaded is not None:
        r = r.when(~col(loaded), F.lit("not_loaded"))
    if max_wav_len is not None:
        r = r.when(col(n_samples) > max_wav_len, F.lit("wav_too_long"))
    if max_text_len is not None:
        r = r.when(col(n_tokens) > max_text_len, F.lit("text_too_long"))
    r = r.when(F.length(F.trim(col(text))) == 0, F.lit("blank_text"))
    r = r.when(col(n_samples) < 0.5 * rate, F.lit("clip_too_short"))
    return r


def reserved_token_found(ids, unk: int = 1, stop: int = 0) -> Column:
    """Any UNK (1) or STOP (0) id."""
    return F.exists(col(ids), lambda x: (x == unk) | (x == stop))


# ---------------------------------------------------------------- C9, C10
def class_size_filter(df: DataFrame, class_col: str, min_count: int, audio_len_col: str,
                      crop_len: int) -> DataFrame:
    """Keep classes with ≥ n rows, then rows with audio longer than the crop.

    Class sizes are one aggregate (partial counts before the shuffle) joined
    back by class; a hot class is one key of a small table, not a skewed sort.
    """
    big = df.groupBy(class_col).agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") >= min_count)
    return df.join(big.select(class_col), class_col, "left_semi").where(F.col(audio_len_col) > crop_len)


def long_enough(n_samples, rate: int, min_seconds: float | None = None) -> Column:
    """At least rate/3 samples (or ``min_seconds``)."""
    if min_seconds is None:
        return col(n_samples) >= F.lit(rate) / 3.0
    return col(n_samples) >= F.lit(rate * min_seconds)


# ---------------------------------------------------------------- C11, C12
def finite(x) -> Column:
    """C11: not NaN, not ±Inf, not null."""
    c = col(x).cast("double")
    return c.isNotNull() & ~F.isnan(c) & (F.abs(c) < F.lit(float("inf")))


def all_finite(arr) -> Column:
    return F.forall(col(arr), lambda v: ~F.isnan(v.cast("double")) & (F.abs(v.cast("double")) < F.lit(float("inf"))))


def audio_out_of_range(arr, high: float = 10.0) -> Column:
    """Flag if any sample > high or none is < 0."""
    a = col(arr)
    return F.exists(a, lambda v: v > high) | ~F.exists(a, lambda v: v < 0)


def clip_audio(arr, lo: float = -1.0, hi: float = 1.0) -> Column:
    return F.transform(col(arr), lambda v: F.greatest(F.lit(lo), F.least(F.lit(hi), v)))


def require_nonempty(df: DataFrame, what: str = "dataset") -> DataFrame:
    """Guard: raise when no row is left (one cheap ``limit(1)`` job)."""
    if df.isEmpty():
        raise RuntimeError(f" [!] No samples left in {what}")
    return df
