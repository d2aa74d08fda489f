"""Text cleaners as ``Column -> Column`` expressions (all JVM-side, codegen'd).

Regexes are written so the same pattern string means the same thing in
Java regex and in RE2 (the oracle's engine): whitespace is spelled out as a
class because ``\\s`` differs between Python, Java and RE2.
"""

from __future__ import annotations

import re
from typing import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from vocable.functions.folding import fold_ascii

# Fixed value: the characters Python's str.isspace()/re "\s" treat as whitespace.
WS_CHARS = "".join(chr(c) for c in range(0x3001) if chr(c).isspace())
WS = r"[\t\n\x{0B}\x{0C}\r\x{1C}-\x{1F} \x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]"

# Symbol replacement by language (replace_symbols).
AMPERSAND_WORD = {"en": " and ", "fr": " et ", "pt": " e ", "ca": " i "}

# Fixed value: default punctuation set for strip / split-and-restore.
DEFAULT_PUNCS = ';:,.!?¡¿—…"«»“”'


def _c(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


def lowercase(t) -> Column:
    return F.lower(_c(t))


def collapse_whitespace(t, strip: bool = True) -> Column:
    out = F.regexp_replace(_c(t), WS + "+", " ")
    if strip:
        # After collapsing, any edge whitespace is exactly one space.
        out = F.regexp_replace(out, "^ | $", "")
    return out


def remove_aux_symbols(t) -> Column:
    return F.regexp_replace(_c(t), r'[<>()\[\]"]+', "")


def replace_symbols(t, lang: str | None = "en") -> Column:
    out = F.replace(_c(t), F.lit(";"), F.lit(","))
    out = F.replace(out, F.lit("-"), F.lit("" if lang == "ca" else " "))
    out = F.replace(out, F.lit(":"), F.lit(","))
    if lang in AMPERSAND_WORD:
        out = F.replace(out, F.lit("&"), F.lit(AMPERSAND_WORD[lang]))
    if lang == "ca":
        out = F.replace(out, F.lit("'"), F.lit(""))
    return out


def replace_symbols_by(t, lang_col) -> Column:
    """``replace_symbols`` with the language taken from a column."""
    t, lang = _c(t), _c(lang_col)
    branches = None
    for code in ("en", "fr", "pt", "ca"):
        e = replace_symbols(t, code)
        branches = F.when(lang == code, e) if branches is None else branches.when(lang == code, e)
    return branches.otherwise(replace_symbols(t, None))


def strip_punctuation(t, puncs: str = DEFAULT_PUNCS) -> Column:
    """Runs of punctuation with their surrounding whitespace become one space; trimmed."""
    cls = "[" + "".join("\\" + ch if ch in r"\^]-[" else ch for ch in dict.fromkeys(puncs)) + "]"
    out = F.regexp_replace(_c(t), f"({WS}*{cls}+{WS}*)+", " ")
    return F.regexp_replace(out, f"^{WS}+|{WS}+$", "")


# ---------------------------------------------------------------- abbreviations
# English abbreviations, in rule order (pattern is "\bX\." case-insensitive).
ABBREVIATIONS_EN = [
    ("mrs", "misess"), ("mr", "mister"), ("dr", "doctor"), ("st", "saint"),
    ("co", "company"), ("jr", "junior"), ("maj", "major"), ("gen", "general"),
    ("drs", "doctors"), ("rev", "reverend"), ("lt", "lieutenant"), ("hon", "honorable"),
    ("sgt", "sergeant"), ("capt", "captain"), ("esq", "esquire"), ("ltd", "limited"),
    ("col", "colonel"), ("ft", "fort"),
]
# French abbreviations, in rule order; X is used as a regex as written
# (so "." inside X matches any character).  First list: "\bX\." case-insensitive.
ABBREVIATIONS_FR = [
    ("M", "monsieur"), ("Mlle", "mademoiselle"), ("Mlles", "mesdemoiselles"), ("Mme", "Madame"),
    ("Mmes", "Mesdames"), ("N.B", "nota bene"), ("M", "monsieur"), ("p.c.q", "parce que"),
    ("Pr", "professeur"), ("qqch", "quelque chose"), ("rdv", "rendez-vous"), ("max", "maximum"),
    ("min", "minimum"), ("no", "numéro"), ("adr", "adresse"), ("dr", "docteur"), ("st", "saint"),
    ("co", "companie"), ("jr", "junior"), ("sgt", "sergent"), ("capt", "capitain"),
    ("col", "colonel"), ("av", "avenue"), ("av. J.-C", "avant Jésus-Christ"),
    ("apr. J.-C", "après Jésus-Christ"), ("art", "article"), ("boul", "boulevard"),
    ("c.-à-d", "c’est-à-dire"), ("etc", "et cetera"), ("ex", "exemple"),
    ("excl", "exclusivement"), ("boul", "boulevard"),
]
# French second list, "\bX" case-sensitive, no dot.
ABBREVIATIONS_FR_NODOT = [
    ("Mlle", "mademoiselle"), ("Mlles", "mesdemoiselles"), ("Mme", "Madame"), ("Mmes", "Mesdames"),
]


def abbreviation_rules(lang: str) -> list[tuple[str, str]]:
    """(java/RE2 pattern, replacement) in application order."""
    if lang == "en":
        return [(rf"(?i)\b{x}\.", r) for x, r in ABBREVIATIONS_EN]
    if lang == "fr":
        return ([(rf"(?i)\b{x}\.", r) for x, r in ABBREVIATIONS_FR]
                + [(rf"\b{x}", r) for x, r in ABBREVIATIONS_FR_NODOT])
    raise ValueError(f"no abbreviation list for {lang!r}")


def expand_abbreviations(t, lang: str = "en") -> Column:
    out = _c(t)
    for pat, rep in abbreviation_rules(lang):
        out = F.regexp_replace(out, pat, rep.replace("\\", "\\\\").replace("$", "\\$"))
    return out


# ---------------------------------------------------------------- J5 / J6 (15 languages)
# Multilingual abbreviations, per language, in rule order.
# Pattern "\bX\." case-insensitive, except Russian, which ends in "\b" instead of the dot.
ABBREVIATIONS_ML = {
    "en": ABBREVIATIONS_EN,
    "es": [("sra", "señora"), ("sr", "señor"), ("dr", "doctor"), ("dra", "doctora"), ("st", "santo"),
           ("co", "compañía"), ("jr", "junior"), ("ltd", "limitada")],
    "fr": [("mme", "madame"), ("mr", "monsieur"), ("dr", "docteur"), ("st", "saint"), ("co", "compagnie"),
           ("jr", "junior"), ("ltd", "limitée")],
    "de": [("fr", "frau"), ("dr", "doktor"), ("st", "sankt"), ("co", "firma"), ("jr", "junior")],
    "pt": [("sra", "senhora"), ("sr", "senhor"), ("dr", "doutor"), ("dra", "doutora"), ("st", "santo"),
           ("co", "companhia"), ("jr", "júnior"), ("ltd", "limitada")],
    "it": [("sig", "signore"), ("dr", "dottore"), ("st", "santo"), ("co", "compagnia"), ("jr", "junior"),
           ("ltd", "limitata")],
    "pl": [("p", "pani"), ("m", "pan"), ("dr", "doktor"), ("sw", "święty"), ("jr", "junior")],
    "ar": [],
    "zh": [],
    "cs": [("dr", "doktor"), ("ing", "inženýr"), ("p", "pan")],
    "ru": [("г-жа", "госпожа"), ("г-н", "господин"), ("д-р", "доктор")],
    "nl": [("dhr", "de heer"), ("mevr", "mevrouw"), ("dr", "dokter"), ("jhr", "jonkheer")],
    "tr": [("b", "bay"), ("byk", "büyük"), ("dr", "doktor")],
    "hu": [("dr", "doktor"), ("b", "bácsi"), ("nőv", "nővér")],
    "ko": [],
}

# Symbol words per language, for & @ % # $ £ ° in that order.
SYMBOL_CHARS = ["&", "@", "%", "#", "$", "£", "°"]
SYMBOL_WORDS = {
    "en": [" and ", " at ", " percent ", " hash ", " dollar ", " pound ", " degree "],
    "es": [" y ", " arroba ", " por ciento ", " numeral ", " dolar ", " libra ", " grados "],
    "fr": [" et ", " arobase ", " pour cent ", " dièse ", " dollar ", " livre ", " degrés "],
    "de": [" und ", " at ", " prozent ", " raute ", " dollar ", " pfund ", " grad "],
    "pt": [" e ", " arroba ", " por cento ", " cardinal ", " dólar ", " libra ", " graus "],
    "it": [" e ", " chiocciola ", " per cento ", " cancelletto ", " dollaro ", " sterlina ", " gradi "],
    "pl": [" i ", " małpa ", " procent ", " krzyżyk ", " dolar ", " funt ", " stopnie "],
    "ar": [" و ", " على ", " في المئة ", " رقم ", " دولار ", " جنيه ", " درجة "],
    "zh": [" 和 ", " 在 ", " 百分之 ", " 号 ", " 美元 ", " 英镑 ", " 度 "],
    "cs": [" a ", " na ", " procento ", " křížek ", " dolar ", " libra ", " stupně "],
    "ru": [" и ", " собака ", " процентов ", " номер ", " доллар ", " фунт ", " градус "],
    "nl": [" en ", " bij ", " procent ", " hekje ", " dollar ", " pond ", " graden "],
    "tr": [" ve ", " at ", " yüzde ", " diyez ", " dolar ", " sterlin ", " derece "],
    "hu": [" és ", " kukac ", " százalék ", " kettőskereszt ", " dollár ", " font ", " fok "],
    "ko": [" 그리고 ", " 에 ", " 퍼센트 ", " 번호 ", " 달러 ", " 파운드 ", " 도 "],
}


def ml_abbreviation_rules(lang: str) -> list[tuple[str, str]]:
    """(pattern, replacement) for J5; ``(?iu)`` keeps case folding Unicode-aware in Java."""
    end = r"\b" if lang == "ru" else r"\."
    return [(rf"(?iu)\b{x}{end}", r) for x, r in ABBREVIATIONS_ML[lang]]


def _by_language(t, lang_col, per_lang) -> Column:
    """One CASE over the languages (a single pass; each branch is that language's chain)."""
    t, lang = _c(t), _c(lang_col)
    out = None
    for code in ABBREVIATIONS_ML:
        e = per_lang(t, code)
        out = F.when(lang == code, e) if out is None else out.when(lang == code, e)
    return out.otherwise(t)


def expand_abbreviations_ml(t, lang: str) -> Column:
    out = _c(t)
    for pat, rep in ml_abbreviation_rules(lang):
        out = F.regexp_replace(out, pat, rep.replace("\\", "\\\\").replace("$", "\\$"))
    return out


def expand_abbreviations_by(t, lang_col) -> Column:
    """J5 with the language taken from a column."""
    return _by_language(t, lang_col, expand_abbreviations_ml)


def expand_symbols_ml(t, lang: str) -> Column:
    """Replace each symbol, halving double spaces after every rule; strip at the end."""
    out = _c(t)
    for sym, word in zip(SYMBOL_CHARS, SYMBOL_WORDS[lang]):
        out = F.replace(out, F.lit(sym), F.lit(word))
        out = F.replace(out, F.lit("  "), F.lit(" "))
    return F.regexp_replace(out, f"^{WS}+|{WS}+$", "")


def expand_symbols_by(t, lang_col) -> Column:
    return _by_language(t, lang_col, expand_symbols_ml)


# ---------------------------------------------------------------- J14 / J15 corpus normalisers
# Abbreviation and tag replacements of the corpus normaliser.
CORPUS_ABBREVIATIONS = [("Mr.", "Mister"), ("Mrs.", "Missus"), ("Ms.", "Miss"), ("Dr.", "Doctor"),
                        ("Prof.", "Professor"), ("No.", "Number"), ("U.S.", "United States"),
                        ("U.K.", "United Kingdom")]
CORPUS_TAGS = [("<COMMA>", ","), ("<PERIOD>", "."), ("<QUESTIONMARK>", "?"), ("<EXCLAMATIONPOINT>", "!"),
               ("<SIL>", ""), ("<MUSIC>", ""), ("<NOISE>", ""), ("<OTHER>", "")]
# Allowed characters: ASCII letters, digits, space and the punctuation string of
# the reference, where "\]" is an escape, so a backslash is *not* allowed.
#: Runs of what :data:`CORPUS_ALLOWED` does not name, in two ranges: from the space to the tilde it lacks the backslash only.
CORPUS_OTHERS = r"[^ -\[\]-~]+"
CORPUS_ALLOWED = r"A-Za-z0-9!" + '"' + r"#$%&'()*+,\-./:;<=>?@\[\]^_`{|}~ "


def corpus_normalise(t, lower: bool = True, remove_non_english: bool = True, abbreviate: bool = True,
                     mode: str = "strict") -> Column:
    """Strip → collapse → NFKD+ASCII → disallowed runs → ``[UNK]`` (or
    removed) → collapse → abbreviations → tag tokens → lower.

    ``mode="compat"`` keeps the reference's trailing ``\\b`` after the
    abbreviations (so ``Mr. Smith`` is left unchanged)."""
    x = F.regexp_replace(F.regexp_replace(_c(t), f"^{WS}+|{WS}+$", ""), WS + "+", " ")
    x = fold_ascii(x)
    x = F.regexp_replace(x, CORPUS_OTHERS, "[UNK]" if remove_non_english else "")
    x = F.regexp_replace(x, " {2,}", " ")           # no other whitespace is left
    if abbreviate:
        tail = r"\b" if mode == "compat" else ""
        x = _replace_alternation(x, CORPUS_ABBREVIATIONS, r"\b", tail)
    for k, v in CORPUS_TAGS:
        x = F.replace(x, F.lit(k), F.lit(v))
    return F.lower(x) if lower else x


def _replace_alternation(x: Column, pairs, head: str, tail: str) -> Column:
    """Leftmost-first alternation replace: each key is tried at a position in
    list order, like one ``re.sub`` over ``k1|k2|…``.  Done as sequential
    replacements guarded so a later key cannot match inside an earlier
    key's replacement (replacements contain no dots)."""
    for k, v in pairs:
        x = F.regexp_replace(x, head + re.escape(k) + tail, v)
    return x


def txt_normalise(t, remove_non_english: bool = True) -> Column:
    """Strip and lower first, NFKD+ASCII, disallowed → ``[UNK]``, collapse
    (its abbreviation step cannot fire on lower-cased text and is not applied)."""
    x = fold_ascii(F.lower(F.btrim(_c(t), F.lit(WS_CHARS))))
    x = F.regexp_replace(x, CORPUS_OTHERS, "[UNK]" if remove_non_english else "")
    return F.regexp_replace(x, " {2,}", " ")        # no other whitespace is left


# ---------------------------------------------------------------- J17 punctuation split / restore

def punctuation_split(df, text: str, out: str = "split", puncs: str = DEFAULT_PUNCS):
    """Adds ``out`` = struct(pieces, marks), marks being (mark, position)
    with position BEGIN / MIDDLE / END; ``punctuation_restore`` inverts it.

    DataFrame-level so the split and the extracted marks are computed once
    (lambdas do not share subexpressions: referencing them inside a lambda
    would redo the regex per element)."""
    cls = "[" + "".join("\\" + ch if ch in r"\^]-[" else ch for ch in dict.fromkeys(puncs)) + "]"
    run = f"(?:{WS}*{cls}+{WS}*)+"
    d = (df.withColumn("_marks", F.regexp_extract_all(F.col(text), F.lit(run), 0))
         .withColumn("_pieces", F.split(F.col(text), run, -1)))
    d = (d.withColumn("_lead", F.element_at("_pieces", 1) == "")
         .withColumn("_trail", (F.size("_pieces") > 1) & (F.element_at("_pieces", -1) == ""))
         .withColumn("_nm", F.size("_marks")).withColumn("_np", F.size("_pieces")))
    tagged = F.transform("_marks", lambda m, i: F.struct(
        m.alias("mark"),
        F.when((i == 0) & F.col("_lead"), F.lit("BEGIN"))
        .when((i == F.col("_nm") - 1) & F.col("_trail"), F.lit("END"))
        .otherwise(F.lit("MIDDLE")).alias("position")))
    kept = F.filter("_pieces", lambda p, i: ~(((i == 0) & F.col("_lead")) | ((i == F.col("_np") - 1) & F.col("_trail"))))
    return d.withColumn(out, F.struct(kept.alias("pieces"), tagged.alias("marks"))).drop(
        "_marks", "_pieces", "_lead", "_trail", "_nm", "_np")


def punctuation_restore(df, split_col: str, out: str = "restored"):
    """J17 inverse: interleave pieces and the MIDDLE marks, add BEGIN/END marks."""
    s = F.col(split_col)
    d = (df.withColumn("_p", s["pieces"]).withColumn("_m", s["marks"])
         .withColumn("_mid", F.filter("_m", lambda m: m["position"] == "MIDDLE")))
    begin = F.when(F.size("_m") > 0, F.when(F.element_at("_m", 1)["position"] == "BEGIN",
                                            F.element_at("_m", 1)["mark"]))
    end = F.when(F.size("_m") > 0, F.when(F.element_at("_m", -1)["position"] == "END",
                                          F.element_at("_m", -1)["mark"]))
    # Interleave then join once (linear; concatenating inside a fold is quadratic).
    mid = F.col("_mid")
    body = F.array_join(F.flatten(F.transform(
        "_p", lambda p, i: F.array(p, F.when(i < F.size(mid), mid[i]["mark"]).otherwise(F.lit(""))))), "")
    return d.withColumn(out, F.concat(F.coalesce(begin, F.lit("")), body, F.coalesce(end, F.lit("")))).drop(
        "_p", "_m", "_mid")


# ---------------------------------------------------------------- pipelines

def basic_cleaners(t) -> Column:
    return collapse_whitespace(lowercase(t))


def transliteration_cleaners(t) -> Column:
    return collapse_whitespace(lowercase(t))


def basic_german_cleaners(t) -> Column:
    return collapse_whitespace(lowercase(t))


def basic_turkish_cleaners(t) -> Column:
    return collapse_whitespace(lowercase(F.replace(_c(t), F.lit("I"), F.lit("ı"))))


def french_cleaners(t) -> Column:
    out = lowercase(expand_abbreviations(t, "fr"))
    return collapse_whitespace(remove_aux_symbols(replace_symbols(out, "fr")))


def portuguese_cleaners(t) -> Column:
    return collapse_whitespace(remove_aux_symbols(replace_symbols(lowercase(t), "pt")))


def multilingual_cleaners(t) -> Column:
    return collapse_whitespace(remove_aux_symbols(replace_symbols(lowercase(t), None)))


def no_cleaners(t) -> Column:
    return F.replace(_c(t), F.lit("\n"), F.lit(""))


def english_cleaners(t) -> Column:
    """Lower case, clock times, numbers, abbreviations, symbols, white space."""
    from vocable.functions.numbers import expand_time, normalize_numbers

    out = expand_abbreviations(normalize_numbers(expand_time(lowercase(t))), "en")
    return collapse_whitespace(remove_aux_symbols(replace_symbols(out, "en")))


def phoneme_cleaners(t) -> Column:
    from vocable.functions.numbers import normalize_numbers

    out = expand_abbreviations(normalize_numbers(_c(t)), "en")
    return collapse_whitespace(remove_aux_symbols(replace_symbols(out, "en")))


CLEANERS: dict[str, Callable[[Column], Column]] = {
    "basic_cleaners": basic_cleaners,
    "transliteration_cleaners": transliteration_cleaners,
    "basic_german_cleaners": basic_german_cleaners,
    "basic_turkish_cleaners": basic_turkish_cleaners,
    "french_cleaners": french_cleaners,
    "portuguese_cleaners": portuguese_cleaners,
    "multilingual_cleaners": multilingual_cleaners,
    "no_cleaners": no_cleaners,
    "english_cleaners": english_cleaners,
    "phoneme_cleaners": phoneme_cleaners,
}


def register_cleaner(name: str, fn: Callable[[Column], Column]) -> None:
    """A caller's cleaner (a Column expression, or a pandas UDF)."""
    CLEANERS[name] = fn


def cleaner(name: str) -> Callable[[Column], Column]:
    try:
        return CLEANERS[name]
    except KeyError:
        raise KeyError(f"unknown cleaner {name!r}; known: {sorted(CLEANERS)}") from None


# ---------------------------------------------------------------- J18-J20

def sentences(t) -> Column:
    """J18 (our documented rule): maximal runs of non-terminators followed by
    their terminators ``[.!?]*``, trimmed, empty pieces dropped."""
    pieces = F.regexp_extract_all(_c(t), F.lit(r"[^.!?]+[.!?]*"), 0)
    return F.filter(F.transform(pieces, lambda s: F.trim(s)), lambda s: s != "")


def wrap_words(s: Column, width: int) -> Column:
    """Greedy word wrap at ``width``; words longer than the width are cut."""
    pat = rf"\S.{{0,{width - 1}}}(?=\s|$)|\S{{{width}}}"
    flat = F.regexp_replace(s, WS, " ")   # every whitespace character becomes a space first
    return F.transform(F.regexp_extract_all(flat, F.lit(pat), 0), lambda x: F.trim(x))


def pack_sentences(sents: Column, limit: int = 250, text: Column | None = None) -> Column:
    """Greedy packing; append with a space while len(cur)+len(next) ≤ limit;
    a sentence longer than the limit is word-wrapped into its own chunks.  With
    ``text``, one shorter than the limit stays whole, without leading white space."""
    def step(acc, s):
        last = F.element_at(acc, -1)
        head = F.slice(acc, 1, F.size(acc) - 1)
        # Python's lstrip(): all leading whitespace, not only spaces.
        joined = F.concat(head, F.array(F.regexp_replace(F.concat(last, F.lit(" "), s), "^" + WS + "+", "")))
        return (F.when(F.length(last) + F.length(s) <= limit, joined)
                .when(F.length(s) > limit, F.concat(acc, wrap_words(s, limit)))
                .otherwise(F.concat(acc, F.array(s))))

    packed = F.aggregate(sents, F.array(F.lit("")), step)
    out = F.when((F.size(packed) > 1) & (F.element_at(packed, 1) == ""), F.slice(packed, 2, F.size(packed))) \
        .otherwise(packed)
    if text is None:
        return out
    return F.when(F.length(text) < limit, F.array(F.regexp_replace(text, "^" + WS + "+", ""))).otherwise(out)


# Per-language character limits (language code → limit); default 250.
CHAR_LIMITS = {"en": 250, "de": 253, "fr": 273, "es": 239, "it": 213, "pt": 203, "pl": 224, "zh": 82,
               "ar": 166, "cs": 186, "ru": 182, "nl": 251, "tr": 226, "ja": 71, "hu": 224, "ko": 95}


def char_limit(lang) -> Column:
    """Limit for the language with any region suffix removed."""
    m = F.create_map(*[x for k, v in CHAR_LIMITS.items() for x in (F.lit(k), F.lit(v))])
    return F.coalesce(F.try_element_at(m, F.split_part(_c(lang), F.lit("-"), F.lit(1))), F.lit(250)).cast("int")


def chars(t) -> Column:
    """Array of code points as one-character strings."""
    return F.split(_c(t), "", -1)


def char_len(t) -> Column:
    return F.length(_c(t))
