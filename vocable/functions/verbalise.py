"""Numbers, amounts, decimals and ordinals in words for English, French, German and Spanish.

Words of 0 to 999 come from a small rule per language and stand in one array
literal that Spark folds at planning time; everything above is composed from
groups of digits by Column expressions.  A text is cut at its number tokens,
each token is put into words by its kind, and the pieces are joined in order
(:func:`expand_numbers`): no shuffle and no Python per row.  Where the words come
from outside, for other languages, the tokens go through a table instead
(:func:`number_positions`, :func:`rewrite_by_table`).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vocable.functions.numbers import IRREGULAR_ORDINALS, SCALES, TENS, UNITS, replace_matches
from vocable.operators.common import col, let

LANGUAGES = ("en", "fr", "de", "es")
#: Digits that are read as one number; longer runs are read digit by digit.
LONGEST = 18

# Separators, amounts, decimals and ordinals of the normaliser.
SEPARATED = {"en": r"\b\d{1,3}(?:,\d{3})*(?:\.\d+)?\b", "other": r"\b\d{1,3}(?:.\d{3})*(?:,\d+)?\b"}
AMOUNT = r"[0-9]+(?:[.,][0-9]+)?"
DECIMAL = r"[0-9]+[.,][0-9]+"
ORDINAL = {"en": "[0-9]+(?:st|nd|rd|th)", "es": "[0-9]+(?:º|ª|er|os|as|o|a)", "fr": "[0-9]+(?:º|ª|er|re|ème|e)",
           "de": r"[0-9]+(?:st|nd|rd|th|º|ª|\.(?=\s|$))"}
# Sign → language → (one, several, one hundredth, hundredths).
CURRENCIES = {
    "£": {"en": ("pound sterling", "pounds sterling", "penny", "pence"), "fr": ("livre", "livres", "penny", "pence"),
          "de": ("Pfund", "Pfund", "Penny", "Pence"), "es": ("libra", "libras", "penique", "peniques")},
    "$": {"en": ("dollar", "dollars", "cent", "cents"), "fr": ("dollar", "dollars", "cent", "cents"),
          "de": ("Dollar", "Dollar", "Cent", "Cent"), "es": ("dólar", "dólares", "centavo", "centavos")},
    "€": {"en": ("euro", "euro", "cent", "cents"), "fr": ("euro", "euros", "centime", "centimes"),
          "de": ("Euro", "Euro", "Cent", "Cent"), "es": ("euro", "euros", "céntimo", "céntimos")},
}
POINT = {"en": "point", "fr": "virgule", "de": "Komma", "es": "punto"}
AND = {"en": ", ", "fr": " et ", "de": " und ", "es": " con "}
# Number words.
FR_UNITS = ("zéro un deux trois quatre cinq six sept huit neuf dix onze douze treize quatorze quinze seize "
            "dix-sept dix-huit dix-neuf").split()
FR_TENS = {2: "vingt", 3: "trente", 4: "quarante", 5: "cinquante", 6: "soixante"}
FR_SCALES = ["million", "milliard", "billion", "billiard"]
DE_UNITS = ("null eins zwei drei vier fünf sechs sieben acht neun zehn elf zwölf dreizehn vierzehn fünfzehn sechzehn "
            "siebzehn achtzehn neunzehn").split()
DE_TENS = ["", "", "zwanzig", "dreißig", "vierzig", "fünfzig", "sechzig", "siebzig", "achtzig", "neunzig"]
DE_SCALES = [("Million", "Millionen"), ("Milliarde", "Milliarden"), ("Billion", "Billionen"), ("Billiarde", "Billiarden")]
ES_UNITS = ("cero uno dos tres cuatro cinco seis siete ocho nueve diez once doce trece catorce quince dieciséis diecisiete "
            "dieciocho diecinueve veinte veintiuno veintidós veintitrés veinticuatro veinticinco veintiséis veintisiete "
            "veintiocho veintinueve").split()
ES_TENS = {3: "treinta", 4: "cuarenta", 5: "cincuenta", 6: "sesenta", 7: "setenta", 8: "ochenta", 9: "noventa"}
ES_HUNDREDS = ["", "ciento", "doscientos", "trescientos", "cuatrocientos", "quinientos", "seiscientos", "setecientos",
               "ochocientos", "novecientos"]
ES_SCALES = [("millón", "millones"), ("billón", "billones")]
ES_ORDINALS = [["", "primero", "segundo", "tercero", "cuarto", "quinto", "sexto", "séptimo", "octavo", "noveno"],
               ["", "décimo", "vigésimo", "trigésimo", "cuadragésimo", "quincuagésimo", "sexagésimo", "septuagésimo",
                "octogésimo", "nonagésimo"],
               ["", "centésimo", "ducentésimo", "tricentésimo", "cuadringentésimo", "quingentésimo", "sexcentésimo",
                "septingentésimo", "octingentésimo", "noningentésimo"]]


def _en(n: int) -> str:
    if n >= 100:
        return UNITS[n // 100] + " hundred" + (" and " + _en(n % 100) if n % 100 else "")
    if n < 20:
        return UNITS[n]
    return TENS[n // 10] + ("-" + UNITS[n % 10] if n % 10 else "")


def _fr(n: int) -> str:
    if n >= 100:
        head = "cent" if n < 200 else FR_UNITS[n // 100] + " cent"
        return head + ("" if n % 100 else "s" * (n >= 200)) + (" " + _fr(n % 100) if n % 100 else "")
    if n < 20:
        return FR_UNITS[n]
    if n >= 80:                                  # four twenties and up to nineteen more
        return "quatre-vingts" if n == 80 else "quatre-vingt-" + FR_UNITS[n - 80]
    tens, unit = (6, n - 60) if n >= 60 else divmod(n, 10)
    if unit == 0:
        return FR_TENS[tens]
    return FR_TENS[tens] + (" et " if unit in (1, 11) else "-") + FR_UNITS[unit]


def _de(n: int) -> str:
    if n >= 100:
        return ("ein" if n < 200 else DE_UNITS[n // 100]) + "hundert" + (_de(n % 100) if n % 100 else "")
    if n < 20:
        return DE_UNITS[n]
    unit = n % 10
    return ("" if unit == 0 else "einund" if unit == 1 else DE_UNITS[unit] + "und") + DE_TENS[n // 10]


def _es(n: int) -> str:
    if n >= 100:
        return "cien" if n == 100 else ES_HUNDREDS[n // 100] + (" " + _es(n % 100) if n % 100 else "")
    if n < 30:
        return ES_UNITS[n]
    return ES_TENS[n // 10] + (" y " + ES_UNITS[n % 10] if n % 10 else "")


def _es_ordinal(n: int) -> str:
    return " ".join(w for w in (ES_ORDINALS[2][n // 100], ES_ORDINALS[1][n // 10 % 10], ES_ORDINALS[0][n % 10]) if w)


def _table(rule) -> Column:
    """Words of 0 to 999 as one foldable array."""
    return F.split(F.lit("|".join(rule(n) for n in range(1000))), r"\|")


def _pick(rule, n: Column) -> Column:
    return F.element_at(_table(rule), n + 1)


def _group(padded: Column, k: int) -> Column:
    """Number in the ``k``-th group of three digits from the right of an 18-digit string."""
    return F.substring(padded, LONGEST - 3 * k - 2, 3).cast("int")


def _zero(words: Column, zero: str) -> Column:
    return F.when(words == "", F.lit(zero)).otherwise(words)


def _cardinal_en(p: Column) -> Column:
    n = [_group(p, k) for k in range(6)]
    head = F.concat_ws(", ", *[F.when(n[k] > 0, F.concat(_pick(_en, n[k]), F.lit(f" {SCALES[k]}"))) for k in (5, 4, 3, 2, 1)])
    return let(head, lambda h: F.when(h == "", _pick(_en, n[0])).when(n[0] == 0, h).otherwise(
        F.concat(h, F.when(n[0] < 100, F.lit(" and ")).otherwise(F.lit(", ")), _pick(_en, n[0]))))


def _cardinal_fr(p: Column) -> Column:
    def before_scale(n):                         # "cents" and "vingts" lose their s before mille
        return F.regexp_replace(_pick(_fr, n), "(cent|vingt)s$", "$1")
    n = [_group(p, k) for k in range(6)]
    parts = [F.when(n[k] > 0, F.concat(_pick(_fr, n[k]), F.lit(" " + FR_SCALES[k - 2]), F.when(n[k] > 1, F.lit("s")).otherwise(F.lit(""))))
             for k in (5, 4, 3, 2)]
    parts.append(F.when(n[1] == 1, F.lit("mille")).when(n[1] > 1, F.concat(before_scale(n[1]), F.lit(" mille"))))
    parts.append(F.when(n[0] > 0, _pick(_fr, n[0])))
    return _zero(F.concat_ws(" ", *parts), FR_UNITS[0])


def _cardinal_de(p: Column) -> Column:
    def attributive(n):
        return F.regexp_replace(_pick(_de, n), "eins$", "ein")
    n = [_group(p, k) for k in range(6)]
    parts = []
    for k in (5, 4, 3, 2):
        one, many = DE_SCALES[k - 2]
        parts.append(F.when(n[k] == 1, F.lit(f"eine {one}")).when(n[k] > 1, F.concat(attributive(n[k]), F.lit(f" {many}"))))
    low = F.concat(F.when(n[1] > 0, F.concat(attributive(n[1]), F.lit("tausend"))).otherwise(F.lit("")),
                   F.when(n[0] > 0, _pick(_de, n[0])).otherwise(F.lit("")))
    parts.append(F.when(n[1] + n[0] > 0, low))
    return _zero(F.concat_ws(" ", *parts), DE_UNITS[0])


def _apocope(words: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(words, "veintiuno$", "veintiún"), "uno$", "un")


def _cardinal_es(p: Column) -> Column:
    def six(k):                                  # the k-th group of six digits
        thousands, units = _group(p, 2 * k + 1), _group(p, 2 * k)
        words = F.concat_ws(" ", F.when(thousands == 1, F.lit("mil")).when(thousands > 1, F.concat(_apocope(_pick(_es, thousands)), F.lit(" mil"))),
                            F.when(units > 0, _pick(_es, units)))
        return thousands * 1000 + units, words
    parts = []
    for k in (2, 1):
        n, words = six(k)
        one, many = ES_SCALES[k - 1]
        parts.append(F.when(n == 1, F.lit(f"un {one}")).when(n > 1, F.concat(_apocope(words), F.lit(f" {many}"))))
    n, words = six(0)
    parts.append(F.when(n > 0, words))
    return _zero(F.concat_ws(" ", *parts), ES_UNITS[0])


_COMPOSED = {"en": _cardinal_en, "fr": _cardinal_fr, "de": _cardinal_de, "es": _cardinal_es}
_RULES = {"en": _en, "fr": _fr, "de": _de, "es": _es}


def _digit_words(digits: Column, lang: str) -> Column:
    return F.array_join(F.transform(F.regexp_extract_all(digits, F.lit("[0-9]"), 0),
                                    lambda d: _pick(_RULES[lang], d.cast("int"))), " ")


def cardinal(digits: Column, lang: str) -> Column:
    """Words of a string of digits."""
    def spelled(d: Column) -> Column:
        words = let(F.lpad(d, LONGEST, "0"), _COMPOSED[lang])
        return F.when(F.length(d) > LONGEST, _digit_words(d, lang)).otherwise(words)
    return let(F.regexp_replace(digits, "^0+(?=.)", ""), spelled)


def ordinal(digits: Column, lang: str) -> Column:
    """Words of the ordinal number, masculine; a run beyond ``LONGEST`` digits is read as digits."""
    def spelled(d: Column) -> Column:
        words = cardinal(d, lang)
        if lang == "en":
            out = F.when(words.rlike("y$"), F.regexp_replace(words, "y$", "ieth")).otherwise(F.concat(words, F.lit("th")))
            for k, v in IRREGULAR_ORDINALS.items():
                out = F.when(words.endswith(k), F.regexp_replace(words, k + "$", v)).otherwise(out)
        elif lang == "fr":
            def form(w):
                for pattern, by in ((r"(vingt|cent|llion|lliard)s$", "$1"), ("cinq$", "cinqu"), ("neuf$", "neuv"), ("e$", "")):
                    w = F.regexp_replace(w, pattern, by)
                return F.concat(w, F.lit("ième"))
            out = F.when(d == "1", F.lit("premier")).otherwise(form(words))
        elif lang == "de":
            last = F.substring(F.lpad(d, LONGEST, "0"), LONGEST - 1, 2).cast("int")
            out = words
            for pattern, by in (("eins$", "ers"), ("drei$", "drit"), ("sieben$", "sieb"), ("acht$", "ach")):
                out = F.regexp_replace(out, pattern, by)
            out = F.lower(F.concat(out, F.when((last > 0) & (last < 20), F.lit("te")).otherwise(F.lit("ste"))))
        else:
            p = F.lpad(d, LONGEST, "0")
            units = F.substring(p, LONGEST - 2, 3).cast("int")
            above = F.regexp_replace(F.substring(p, 1, LONGEST - 3), "^0+", "")
            thousand = (F.when(above == "", F.lit(None).cast("string")).when(above == "1", F.lit("milésimo"))
                        .otherwise(F.concat(_apocope(let(F.lpad(above, LONGEST, "0"), _cardinal_es)), F.lit(" milésimo"))))
            out = _zero(F.concat_ws(" ", thousand, F.when(units > 0, _pick(_es_ordinal, units))), "cero")
        return F.when(F.length(d) > LONGEST, words).otherwise(out)
    return let(F.regexp_replace(digits, "^0+(?=.)", ""), spelled)


def decimal(token: Column, lang: str) -> Column:
    """Whole part, the word for the point, digits behind it without zeros at the end."""
    whole = F.regexp_extract(token, "^[0-9]+", 0)
    part = F.regexp_replace(F.regexp_extract(token, "[0-9]+$", 0), "(?<=.)0+$", "")
    return F.concat(cardinal(whole, lang), F.lit(f" {POINT[lang]} "), _digit_words(part, lang))


def amount(token: Column, lang: str) -> Column:
    """An amount of money; hundredths are rounded half up and left out where there are none given."""
    def spelled(t: Column) -> Column:
        number = F.replace(F.regexp_extract(t, AMOUNT, 0), F.lit(","), F.lit("."))
        exact = F.concat(F.regexp_extract(number, "^[0-9]+", 0), F.rpad(F.regexp_extract(number, r"\.([0-9]+)", 1), 3, "0"))
        # hundredths of the number, half up, on its digits
        cents = F.floor((F.when(F.length(exact) <= LONGEST + 3, F.substring(exact, F.lit(1), F.length(F.regexp_extract(number, "^[0-9]+", 0)) + 3))
                         .cast("decimal(38,0)") + 5) / 10)
        whole = F.when(F.length(exact) <= LONGEST + 3, F.floor(cents / 100).cast("decimal(38,0)").cast("string")).otherwise(
            F.regexp_extract(number, "^[0-9]+", 0))
        rest = F.pmod(cents, F.lit(100)).cast("int")
        given = F.regexp_extract(number, r"\.[0-9]*[1-9]", 0) != ""
        one = {"en": "one", "fr": "un", "de": "ein", "es": "un"}[lang]

        def words(n):
            return F.when(n == "1", F.lit(one)).otherwise(_apocope(cardinal(n, lang)) if lang == "es" else cardinal(n, lang))

        def unit(k):
            out = F.lit("")
            for sign, names in CURRENCIES.items():
                out = F.when(F.contains(t, F.lit(sign)), F.lit(names[lang][k])).otherwise(out)
            return out
        main = F.concat(words(whole), F.lit(" "), F.when(whole == "1", unit(0)).otherwise(unit(1)))
        small = F.concat(words(rest.cast("string")), F.lit(" "), F.when(rest == 1, unit(2)).otherwise(unit(3)))
        return F.when(given & rest.isNotNull(), F.concat(main, F.lit(AND[lang]), small)).otherwise(main)
    return let(token, spelled)


def token_pattern(lang: str) -> str:
    """Number tokens of a language.  Pounds come before dollars before euros: a number between two signs
    belongs to the first of them."""
    number = r"[0-9]+(?:[.,][0-9]+)?"
    amounts = [rf"£{number}", rf"\${number}(?!£)", rf"€{number}(?![£$])", rf"{number}£", rf"{number}\$", rf"{number}€"]
    return "(?:" + "|".join(amounts) + f"|{DECIMAL}|{ORDINAL[lang]}|[0-9]+)"


def without_separators(text: Column, lang: str) -> Column:
    """Separators between groups of three digits removed: commas in English, dots elsewhere."""
    sign = "," if lang == "en" else "."
    return replace_matches(text, SEPARATED["en" if lang == "en" else "other"], lambda m: F.replace(m, F.lit(sign), F.lit("")))


def verbalised(token: Column, lang: str) -> Column:
    """Words of one number token."""
    digits = F.regexp_extract(token, "^[0-9]+", 0)
    return (F.when(token.rlike("[£$€]"), amount(token, lang)).when(token.rlike(f"^{DECIMAL}$"), decimal(token, lang))
            .when(token.rlike("^[0-9]+$"), cardinal(token, lang)).otherwise(ordinal(digits, lang)))


def expand_numbers(text, lang: str) -> Column:
    """Separators, pounds, dollars, euros, decimals, ordinals, whole numbers of ``text`` in words of ``lang``."""
    if lang not in LANGUAGES:
        raise ValueError(f"no number words for {lang!r}; use rewrite_by_table")
    return let(without_separators(col(text), lang), lambda t: F.when(t.rlike("[0-9]"), replace_matches(
        t, token_pattern(lang), lambda m: verbalised(m, lang))).otherwise(t))


def expand_numbers_by(text, lang_col) -> Column:
    """:func:`expand_numbers` with the language from a column; texts in other languages stay."""
    out = col(text)
    for lang in LANGUAGES:
        out = F.when(col(lang_col) == lang, expand_numbers(text, lang)).otherwise(out)
    return out


def number_positions(df: DataFrame, key: str, text: str, lang: str, pattern: str = token_pattern("en")) -> DataFrame:
    """(key, lang, pos, token): the number tokens of each text in order, whatever its language."""
    found = F.posexplode(F.regexp_extract_all(F.col(text), F.lit(pattern), 0))
    return df.select(F.col(key), F.col(lang).alias("lang"), found.alias("pos", "token"))


def rewrite_by_table(df: DataFrame, key: str, text: str, lang: str, words: DataFrame, out: str = "expanded",
                     pattern: str = token_pattern("en")) -> DataFrame:
    """``df`` with the number tokens of ``text`` replaced by ``words`` (lang, token, words).

    The table holds each distinct (lang, token) once: whoever verbalises it (a
    pandas hook for a language without rules here) sees every token once.  Tokens
    go back by (key, position), between the pieces that the text was cut into; a
    token without words stays.  ``key`` is unique.
    """
    placed = number_positions(df, key, text, lang, pattern).join(words, ["lang", "token"], "left").groupBy(key).agg(
        F.array_sort(F.collect_list(F.struct("pos", F.coalesce("words", "token").alias("w")))).alias("_found"))
    between = F.split(F.col(text), pattern, -1)
    joined = F.zip_with(between, F.col("_found"), lambda a, b: F.concat(a, F.coalesce(b["w"], F.lit(""))))
    return df.join(placed, key, "left").withColumn(out, F.when(F.col("_found").isNull(), F.col(text)).otherwise(
        F.array_join(joined, ""))).drop("_found")
