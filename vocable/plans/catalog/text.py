"""J (text functions run as corpus jobs) plus D8 and E3 on the lexicon."""

from pyspark.sql import functions as F

from vocable.functions import text as J
from vocable.functions.folding import fold_sql
from vocable.operators import lexicon as LX
from vocable.operators.vocab import DEFAULT_PUNCTUATIONS, build_vocabulary, encode_chars_lut, vocab_lut
from vocable.plans.catalog.sqlbits import SQL_WS, sql_basic_clean
from vocable.plans.registry import register
from vocable.sources.tables import table


def docs(spark, sf):
    return table(spark, sf, "documents").select("doc_id", "text", "lang")


@register("j1_basic_cleaners", f"""
SELECT doc_id, {sql_basic_clean('text')} AS clean,
       regexp_replace(lower(text), '{SQL_WS}+', ' ', 'g') AS clean_no_strip FROM documents
""")
def j1(spark, sf):
    d = docs(spark, sf)
    return d.select("doc_id", J.basic_cleaners("text").alias("clean"),
                    J.collapse_whitespace(J.lowercase("text"), strip=False).alias("clean_no_strip"))


@register("j2_replace_symbols", """
SELECT doc_id, CASE
  WHEN lang = 'en' THEN replace(replace(replace(replace(text, ';', ','), '-', ' '), ':', ','), '&', ' and ')
  WHEN lang = 'fr' THEN replace(replace(replace(replace(text, ';', ','), '-', ' '), ':', ','), '&', ' et ')
  WHEN lang = 'pt' THEN replace(replace(replace(replace(text, ';', ','), '-', ' '), ':', ','), '&', ' e ')
  WHEN lang = 'ca' THEN replace(replace(replace(replace(replace(text, ';', ','), '-', ''), ':', ','), '&', ' i '), '''', '')
  ELSE replace(replace(replace(text, ';', ','), '-', ' '), ':', ',') END AS replaced
FROM documents
""")
def j2(spark, sf):
    d = docs(spark, sf)
    return d.select("doc_id", J.replace_symbols_by("text", "lang").alias("replaced"))


@register("j3_remove_aux_symbols", """
SELECT doc_id, regexp_replace(text, '[<>()\\[\\]"]+', '', 'g') AS cleaned FROM documents
""")
def j3(spark, sf):
    return docs(spark, sf).select("doc_id", J.remove_aux_symbols("text").alias("cleaned"))


J4_PREFIX = "Mr. Dr. St. Co. Jr. Capt. Ltd. Ft. "


def _sql_chain(expr: str, rules) -> str:
    for pat, rep in rules:
        expr = f"regexp_replace({expr}, '{pat}', '{rep.replace(chr(39), chr(39) * 2)}', 'g')"
    return expr


@register("j4_abbreviations_en", f"""
SELECT doc_id, CASE WHEN lang = 'en' THEN {_sql_chain("'" + J4_PREFIX + "' || text", J.abbreviation_rules('en'))}
                    WHEN lang = 'fr' THEN {_sql_chain("'" + J4_PREFIX + "' || text", J.abbreviation_rules('fr'))}
                    ELSE '{J4_PREFIX}' || text END AS expanded
FROM documents
""")
def j4(spark, sf):
    """Every text by the list of its language; languages without a list are left as they are."""
    t = F.concat(F.lit(J4_PREFIX), F.col("text"))
    return docs(spark, sf).select("doc_id", F.when(F.col("lang") == "en", J.expand_abbreviations(t, "en"))
                                  .when(F.col("lang") == "fr", J.expand_abbreviations(t, "fr")).otherwise(t).alias("expanded"))


J5_PREFIX = "Dr. St. Co. Jr. Mr. Sra. Mme. Fr. "


def _sql_case_by_lang(expr: str, per_lang) -> str:
    parts = " ".join(f"WHEN lang = '{code}' THEN {per_lang(expr, code)}" for code in J.ABBREVIATIONS_ML)
    return f"CASE {parts} ELSE {expr} END"


def _sql_abbrev(expr: str, code: str) -> str:
    # RE2's \b is ASCII-only; Python's (and Java's) treats any letter or digit as
    # a word character, so the leading boundary is spelled out and kept.
    for pat, rep in J.ml_abbreviation_rules(code):
        pat = pat.replace("(?iu)\\b", "(?i)(^|[^\\p{L}\\p{Nd}_])")
        expr = f"regexp_replace({expr}, '{pat}', '\\1{rep.replace(chr(39), chr(39) * 2)}', 'g')"
    return expr


def _sql_symbols(expr: str, code: str) -> str:
    for sym, word in zip(J.SYMBOL_CHARS, J.SYMBOL_WORDS[code]):
        expr = f"replace(replace({expr}, '{sym}', '{word}'), '  ', ' ')"
    return f"regexp_replace({expr}, '^{SQL_WS}+|{SQL_WS}+$', '', 'g')"


@register("j5_abbreviations_multilingual", f"""
SELECT doc_id, {_sql_case_by_lang("'" + J5_PREFIX + "' || text", _sql_abbrev)} AS expanded FROM documents
""")
def j5(spark, sf):
    d = docs(spark, sf)
    return d.select("doc_id", J.expand_abbreviations_by(F.concat(F.lit(J5_PREFIX), F.col("text")), "lang")
                    .alias("expanded"))


@register("j6_symbols_multilingual", f"""
SELECT doc_id, {_sql_case_by_lang('text', _sql_symbols)} AS expanded FROM documents
""")
def j6(spark, sf):
    d = docs(spark, sf)
    return d.select("doc_id", J.expand_symbols_by("text", "lang").alias("expanded"))


@register("j13_multilingual_cleaners", f"""
SELECT doc_id, regexp_replace(regexp_replace(regexp_replace(
         replace(replace(replace(lower(text), ';', ','), '-', ' '), ':', ','),
         '[<>()\\[\\]"]+', '', 'g'), '{SQL_WS}+', ' ', 'g'), '^ | $', '', 'g') AS clean
FROM documents
""")
def j13m(spark, sf):
    return docs(spark, sf).select("doc_id", J.cleaner("multilingual_cleaners")(F.col("text")).alias("clean"))


@register("j13_portuguese_cleaners", f"""
SELECT doc_id, regexp_replace(regexp_replace(regexp_replace(
         replace(replace(replace(replace(lower(text), ';', ','), '-', ' '), ':', ','), '&', ' e '),
         '[<>()\\[\\]"]+', '', 'g'), '{SQL_WS}+', ' ', 'g'), '^ | $', '', 'g') AS clean
FROM documents
""")
def j13p(spark, sf):
    return docs(spark, sf).select("doc_id", J.cleaner("portuguese_cleaners")(F.col("text")).alias("clean"))


@register("j13_no_cleaners", """
SELECT doc_id, replace(text, chr(10), '') AS clean FROM documents
""")
def j13n(spark, sf):
    return docs(spark, sf).select("doc_id", J.cleaner("no_cleaners")(F.col("text")).alias("clean"))


_PCLS = "[;:,.!?¡¿—…\"«»“”]"


def _normaliser_sql(start: str, abbreviations: bool) -> str:
    """Strip and collapse (or lower), fold, mark what is not allowed; then the abbreviations and tags of J14."""
    x = f"regexp_replace(f, '[^{J.CORPUS_ALLOWED.replace("'", "''")}]+', '[UNK]', 'g')"
    x = f"regexp_replace({x}, '{SQL_WS}+', ' ', 'g')"
    if abbreviations:
        for k, v in J.CORPUS_ABBREVIATIONS:
            x = f"regexp_replace({x}, '\\b{k.replace('.', '[.]')}', '{v}', 'g')"
        for k, v in J.CORPUS_TAGS:
            x = f"replace({x}, '{k}', '{v}')"
        x = f"lower({x})"
    return f"WITH s AS (SELECT doc_id, {start} AS s FROM documents), f AS (SELECT doc_id, {fold_sql('s')} AS f FROM s) SELECT doc_id, {x} AS normalised FROM f"


_STRIPPED = f"regexp_replace(text, '^{SQL_WS}+|{SQL_WS}+$', '', 'g')"


@register("j14_corpus_normaliser", _normaliser_sql(f"regexp_replace({_STRIPPED}, '{SQL_WS}+', ' ', 'g')", True))
def j14(spark, sf):
    return docs(spark, sf).select("doc_id", J.corpus_normalise(F.col("text")).alias("normalised"))


@register("j15_txt_normaliser", _normaliser_sql(f"lower({_STRIPPED})", False))
def j15(spark, sf):
    return docs(spark, sf).select("doc_id", J.txt_normalise(F.col("text")).alias("normalised"))


_RUN = f"(?:{SQL_WS}*[;:,.!?¡¿—…\"«»“”]+{SQL_WS}*)+"


@register("j17_punctuation_split", f"""
WITH s AS (SELECT doc_id, text, regexp_extract_all(text, '{_RUN}') AS marks, string_split_regex(text, '{_RUN}') AS p
           FROM documents)
SELECT doc_id, CAST(len(marks) AS INTEGER) AS n_marks,
       CAST(len(p) - (CASE WHEN p[1] = '' THEN 1 ELSE 0 END)
                   - (CASE WHEN len(p) > 1 AND p[len(p)] = '' THEN 1 ELSE 0 END) AS INTEGER) AS n_pieces,
       true AS roundtrip_ok
FROM s
""")
def j17(spark, sf):
    d = J.punctuation_split(docs(spark, sf).select("doc_id", "text"), "text", "s")
    d = J.punctuation_restore(d, "s", "back")
    return d.select("doc_id", F.size("s.marks").alias("n_marks"), F.size("s.pieces").alias("n_pieces"),
                    (F.col("back") == F.col("text")).alias("roundtrip_ok"))


@register("j7_clock_times")
def j7(spark, sf):
    """Clock times as words; every document gets one at its end (tests compare with a plain re-computation)."""
    from vocable.functions.numbers import expand_time
    clock = F.concat(F.pmod("doc_id", F.lit(24)).cast("string"), F.lit(":"), F.lpad(F.pmod("doc_id", F.lit(60)).cast("string"), 2, "0"))
    return docs(spark, sf).select("doc_id", expand_time(F.concat("text", F.lit(" "), clock)).alias("expanded"))


@register("j8_numbers_en")
def j8(spark, sf):
    """English numbers as words (tests compare with a plain re-computation)."""
    from vocable.functions.numbers import normalize_numbers
    return docs(spark, sf).select("doc_id", normalize_numbers("text").alias("normalised"))


@register("j9_number_tokens", r"""
WITH t AS (
  SELECT lang, 'time' AS kind, unnest(regexp_extract_all(text, '(?i)\b(?:0?[0-9]|1[0-9]|2[0-3]):[0-5][0-9]\s*(?:am|pm)?\b')) AS token FROM documents
  UNION ALL SELECT lang, 'currency', unnest(regexp_extract_all(text, '[£$¥][0-9,.]*[0-9]+')) FROM documents
  UNION ALL SELECT lang, 'ordinal', unnest(regexp_extract_all(text, '[0-9]+(?:st|nd|rd|th)')) FROM documents
  UNION ALL SELECT lang, 'decimal', unnest(regexp_extract_all(text, '[0-9]+\.[0-9]+')) FROM documents
  UNION ALL SELECT lang, 'number', unnest(regexp_extract_all(text, '-?[0-9]+')) FROM documents)
SELECT lang, kind, token, count(*) AS n FROM t GROUP BY lang, kind, token
""")
def j9(spark, sf):
    from vocable.functions.numbers import number_tokens
    return number_tokens(docs(spark, sf), "text", "lang")


BPE_VOCAB = 3000


@register("j26_bpe_train")
def j26(spark, sf):
    """Vocabulary of a BPE model trained on the whole corpus (rows-only;
    tests compare merges and vocabulary with a Python trainer)."""
    from vocable.operators.bpe import train_bpe
    vocab, _ = train_bpe(docs(spark, sf), "text", vocab_size=BPE_VOCAB, merges_per_round=256)
    return vocab


@register("j27_bpe_encode")
def j27(spark, sf):
    from vocable.operators.bpe import encode_bpe, train_bpe
    d = docs(spark, sf)
    vocab, merges = train_bpe(d, "text", vocab_size=BPE_VOCAB, merges_per_round=256)
    return encode_bpe(d, "doc_id", "text", "lang", vocab, merges)


@register("j16_strip_punctuation", f"""
SELECT doc_id, regexp_replace(regexp_replace(text, '({SQL_WS}*{_PCLS}+{SQL_WS}*)+', ' ', 'g'),
                              '^{SQL_WS}+|{SQL_WS}+$', '', 'g') AS stripped FROM documents
""")
def j16(spark, sf):
    return docs(spark, sf).select("doc_id", J.strip_punctuation("text").alias("stripped"))


@register("j18_sentence_split", """
WITH s AS (SELECT doc_id, list_filter(list_transform(regexp_extract_all(text, '[^.!?]+[.!?]*'), lambda x: trim(x)),
                                      lambda x: x <> '') AS ss FROM documents)
SELECT doc_id, CAST(unnest(range(len(ss))) AS INTEGER) AS k, unnest(ss) AS sentence FROM s
""")
def j18(spark, sf):
    from vocable.functions.text import sentences
    d = docs(spark, sf)
    return d.select("doc_id", F.posexplode(sentences("text")).alias("k", "sentence"))


@register("j19_sentence_packing")
def j19(spark, sf):
    """Greedy packing of each document's sentences into chunks of ≤ 250 characters
    (rows-only check here; tests check the properties of a packing)."""
    from vocable.operators.hooks import sentence_chunks
    return sentence_chunks(docs(spark, sf), "text", 250, ["doc_id"])


J20_SQL_MAP = ("map {'en': 250, 'de': 253, 'fr': 273, 'es': 239, 'it': 213, 'pt': 203, 'pl': 224, 'zh': 82, "
               "'ar': 166, 'cs': 186, 'ru': 182, 'nl': 251, 'tr': 226, 'ja': 71, 'hu': 224, 'ko': 95}")


@register("j20_language_length_limit", f"""
SELECT doc_id, CAST(coalesce({J20_SQL_MAP}[split_part(lang, '-', 1)], 250) AS INTEGER) AS char_limit,
       length(text) > coalesce({J20_SQL_MAP}[split_part(lang, '-', 1)], 250) AS too_long
FROM documents
""")
def j20(spark, sf):
    d = docs(spark, sf)
    lim = J.char_limit(F.col("lang"))
    return d.select("doc_id", lim.alias("char_limit"), (F.length("text") > lim).alias("too_long"))


VOCAB_SQL = f"""
k AS (SELECT doc_id, {sql_basic_clean('text')} AS clean FROM documents),
ch AS (SELECT DISTINCT unnest(string_split(clean, '')) AS c FROM k),
corp AS (SELECT c FROM ch WHERE c <> '' AND c NOT IN ('!', '''', '(', ')', ',', '-', '.', ':', ';', '?', ' ',
                                                   '<PAD>', '<EOS>', '<BOS>', '<BLNK>')),
nc AS (SELECT count(*) AS n FROM corp),
v AS (
  SELECT 0 AS id, '<PAD>' AS c UNION ALL SELECT 1, '<EOS>' UNION ALL SELECT 2, '<BOS>' UNION ALL SELECT 3, '<BLNK>'
  UNION ALL SELECT 3 + row_number() OVER (ORDER BY c) AS id, c FROM corp
  UNION ALL
  SELECT 4 + nc.n + p.k AS id, p.c
  FROM (SELECT * FROM (VALUES ('!', 0), ('''', 1), ('(', 2), (')', 3), (',', 4), ('-', 5), ('.', 6),
                              (':', 7), (';', 8), ('?', 9), (' ', 10)) t(c, k)) p, nc)"""


@register("j21_character_vocabulary", f"WITH {VOCAB_SQL} SELECT CAST(id AS BIGINT) AS id, c AS ch FROM v")
def j21(spark, sf):
    d = docs(spark, sf).select(J.basic_cleaners("text").alias("clean"))
    return build_vocabulary(d, "clean")


@register("j22_encode_chars", f"""WITH {VOCAB_SQL},
e AS (SELECT doc_id, unnest(string_split(clean, '')) AS c, unnest(range(length(clean))) AS i FROM k)
SELECT e.doc_id, list(CAST(v.id AS BIGINT) ORDER BY e.i) AS ids FROM e JOIN v ON v.c = e.c GROUP BY e.doc_id
""")
def j22(spark, sf):
    d = docs(spark, sf).select("doc_id", J.basic_cleaners("text").alias("clean"))
    lut = vocab_lut(build_vocabulary(d, "clean"))
    return d.select("doc_id", encode_chars_lut(F.col("clean"), lut).alias("ids"))


LEX_SQL = """
w0 AS (SELECT unnest(string_split(upper(regexp_replace(text, '[^A-Za-z'' ]', '', 'g')), ' ')) AS word FROM documents),
lex AS (SELECT word, array_to_string(string_split(word, ''), ' ') AS pron FROM (SELECT DISTINCT word FROM w0 WHERE word <> '')),
t0 AS (SELECT doc_id, unnest(string_split(text, ' ')) AS w, unnest(range(len(string_split(text, ' ')))) AS idx FROM documents),
t1 AS (SELECT *, CASE WHEN regexp_matches(w, '^[!''(),\\-.:;? ]') THEN substr(w, 1, 1) ELSE '' END AS f FROM t0),
t2 AS (SELECT *, CASE WHEN f <> '' THEN substr(w, 2) ELSE w END AS r FROM t1),
t3 AS (SELECT *, CASE WHEN regexp_matches(r, '[!''(),\\-.:;? ]$') THEN right(r, 1) ELSE '' END AS l FROM t2),
t4 AS (SELECT *, CASE WHEN l <> '' THEN substr(r, 1, length(r) - 1) ELSE r END AS core FROM t3),
tok AS (SELECT t4.doc_id, t4.idx, CASE WHEN lex.pron IS NOT NULL THEN f || '{' || lex.pron || '}' || l ELSE f || core || l END AS token
        FROM t4 LEFT JOIN lex ON lex.word = replace(upper(t4.core), 'ẞ', 'SS'))"""


@register("d8_lexicon_lookup", f"WITH {LEX_SQL} SELECT doc_id, CAST(idx AS INTEGER) AS idx, token FROM tok")
def d8(spark, sf):
    d = docs(spark, sf)
    lex = LX.first_pronunciations(LX.lexicon_from_corpus(d, "text"))
    return LX.lookup_words(d, "doc_id", "text", lex).select("doc_id", F.col("idx").cast("int"), "token")


@register("j25_lexicon_parse", f"""WITH {LEX_SQL}
SELECT word, 1 AS alt, pron FROM lex
""")
def j25(spark, sf):
    """The corpus lexicon written as ``WORD  P R O N`` lines, then parsed back."""
    from vocable.session import scratch
    d = docs(spark, sf)
    path = scratch(spark, "j25-lexicon")
    lex = LX.lexicon_from_corpus(d, "text")
    lex.select(F.concat("word", F.lit("  "), "pron").alias("value")).write.mode("overwrite").text(path)
    return LX.parse_lexicon(spark.read.text(path)).select("word", "alt", "pron")


@register("j23_phonemise_lexicon", f"WITH {LEX_SQL} SELECT doc_id, string_agg(token, ' ' ORDER BY idx) AS phonemes FROM tok GROUP BY doc_id")
def j23(spark, sf):
    d = docs(spark, sf)
    # whole texts are brought together in blocks, so that their words need no shuffle
    blocks = LX.in_blocks(d, "doc_id", "text")
    lex = LX.first_pronunciations(LX.lexicon_from_corpus(blocks, "text", block="_block"))
    return LX.reassemble(LX.lookup_words(blocks, "doc_id", "text", lex, block="_block"), "doc_id", lists="tokens")


@register("e3_phoneme_inventory", f"""WITH {LEX_SQL},
p AS (SELECT doc_id, replace(string_agg(token, ' ' ORDER BY idx), '|', '') AS ph FROM tok GROUP BY doc_id)
SELECT DISTINCT c AS ch FROM (SELECT unnest(string_split(ph, '')) AS c FROM p) WHERE c <> ''
""")
def e3(spark, sf):
    from vocable.operators.vocab import distinct_chars
    d = docs(spark, sf)
    blocks = LX.in_blocks(d, "doc_id", "text")
    lex = LX.first_pronunciations(LX.lexicon_from_corpus(blocks, "text", block="_block"))
    ph = LX.reassemble(LX.lookup_words(blocks, "doc_id", "text", lex, block="_block"), "doc_id", lists="tokens")
    return distinct_chars(ph.select(F.replace("phonemes", F.lit("|"), F.lit("")).alias("t")), "t")
