"""Clock times and numbers as words, as Column expressions.

A text is cut at the matches of a pattern; every match is rewritten by an
expression over the match and the pieces are joined again
(:func:`replace_matches`).  Words of a number come from its groups of three
digits, so numbers of up to 36 digits are covered; longer ones stay digits.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vocable.operators.common import let

# English number words.
UNITS = ("zero one two three four five six seven eight nine ten eleven twelve thirteen fourteen fifteen sixteen "
         "seventeen eighteen nineteen").split()
TENS = ["", "", "twenty", "thirty", "forty", "fifty", "sixty", "seventy", "eighty", "ninety"]
SCALES = ["", "thousand", "million", "billion", "trillion", "quadrillion", "quintillion", "sextillion", "septillion",
          "octillion", "nonillion", "decillion"]
IRREGULAR_ORDINALS = {"one": "first", "two": "second", "three": "third", "five": "fifth", "eight": "eighth",
                      "nine": "ninth", "twelve": "twelfth"}
# Currency sign → words for one hundredth, hundredths, one, several.
CURRENCIES = {"$": ("cent", "cents", "dollar", "dollars"), "£": ("penny", "pence", "pound sterling", "pounds sterling"),
              "¥": ("sen", "sen", "yen", "yen")}
# Patterns of the normaliser, in order of application.
TIME = r"(?i)\b(?:0?[0-9]|1[0-9]|2[0-3]):[0-5][0-9]\s*(?:am|pm)?\b"
COMMA_NUMBER = r"[0-9][0-9,]+[0-9]"
CURRENCY = r"[£$¥][0-9,.]*[0-9]+"
DECIMAL = r"[0-9]+\.[0-9]+"
ORDINAL = r"[0-9]+(?:st|nd|rd|th)"
NUMBER = r"-?[0-9]+"


def _words(values: list[str]) -> Column:
    return F.array(*[F.lit(v) for v in values])


def replace_matches(text: Column, pattern: str, rewrite: Callable[[Column], Column]) -> Column:
    """Every match of ``pattern`` (no capture groups) replaced by ``rewrite(match)``."""
    found = F.transform(F.regexp_extract_all(text, F.lit(pattern), 0), rewrite)
    between = F.split(text, pattern, -1)
    pairs = F.zip_with(between, found, lambda a, b: F.concat(a, F.coalesce(b, F.lit(""))))
    return F.when(text.rlike(pattern), F.array_join(pairs, "")).otherwise(text)


def below_hundred(n: Column) -> Column:
    """Words of 0 to 99."""
    tens, unit = F.element_at(_words(TENS), F.floor(n / 10).cast("int") + 1), F.element_at(_words(UNITS), F.pmod(n, F.lit(10)) + 1)
    return (F.when(n < 20, F.element_at(_words(UNITS), F.least(n, F.lit(19)) + 1))
            .when(F.pmod(n, F.lit(10)) == 0, tens).otherwise(F.concat(tens, F.lit("-"), unit)))


def below_thousand(n: Column, joint: str) -> Column:
    """Words of 1 to 999; ``joint`` stands between hundreds and the rest."""
    hundreds = F.concat(F.element_at(_words(UNITS), F.floor(n / 100).cast("int") + 1), F.lit(" hundred"))
    rest = F.pmod(n, F.lit(100))
    return (F.when(n < 100, below_hundred(n)).when(rest == 0, hundreds)
            .otherwise(F.concat(hundreds, F.lit(joint), below_hundred(rest))))


def cardinal(digits: Column, joint: str = " ", last: str = ", ") -> Column:
    """Words of a string of digits; ``last`` stands before a last group below one hundred."""
    def spelled(d: Column) -> Column:
        n_groups = F.ceil(F.length(d) / 3).cast("int")
        padded = F.lpad(d, 36, "0")
        groups = F.transform(F.sequence(F.lit(0), n_groups - 1), lambda i: F.struct(
            (n_groups - i).alias("scale"),
            F.substring(padded, F.lit(37) - 3 * (n_groups - i), F.lit(3)).cast("int").alias("n")))
        full = F.filter(groups, lambda g: g["n"] > 0)
        words = F.transform(full, lambda g: F.trim(F.concat_ws(
            " ", below_thousand(g["n"], joint), F.element_at(_words(SCALES), g["scale"]))))
        tail = F.element_at(full, -1)
        small = (F.size(words) > 1) & (tail["scale"] == 1) & (tail["n"] < 100)
        return (F.when(F.size(words) == 0, F.lit("zero"))
                .when(small, F.concat(F.array_join(F.slice(words, 1, F.size(words) - 1), ", "), F.lit(last), F.element_at(words, -1)))
                .otherwise(F.array_join(words, ", ")))
    bare = F.regexp_replace(digits, "^0+(?=.)", "")
    return F.when(F.length(bare) > 36, bare).otherwise(let(bare, spelled))


def ordinal(digits: Column) -> Column:
    """Words of an ordinal number: the last word of the cardinal takes the ordinal form."""
    def form(words: Column) -> Column:
        word = F.regexp_extract(words, "[a-z]+$", 0)
        out = F.when(word.endswith("y"), F.concat(F.regexp_replace(word, "y$", ""), F.lit("ieth"))).otherwise(
            F.concat(word, F.lit("th")))
        for k, v in IRREGULAR_ORDINALS.items():
            out = F.when(word == k, F.lit(v)).otherwise(out)
        return F.concat(F.regexp_replace(words, "[a-z]+$", ""), out)
    return let(cardinal(digits, " and ", " and "), form)


def number(match: Column) -> Column:
    """A whole number as it is read: 1001 to 2999 like years, others as cardinals."""
    digits = F.regexp_replace(match, "^-", "")
    n = F.when(F.length(F.regexp_replace(digits, "^0+", "")) <= 9, digits.cast("int"))
    low, high = F.pmod(n, F.lit(100)), F.floor(n / 100).cast("int")
    pair = (F.when(n == 2000, F.lit("two thousand"))
            .when((n > 2000) & (n < 2010), F.concat(F.lit("two thousand "), below_hundred(low)))
            .when(low == 0, F.concat(below_hundred(high), F.lit(" hundred")))
            .when(low < 10, F.concat(below_hundred(high), F.lit(" oh "), below_hundred(low)))
            .otherwise(F.concat(below_hundred(high), F.lit(" "), below_hundred(low))))
    year = ~match.startswith("-") & (n > 1000) & (n < 3000)
    return F.when(year, pair).otherwise(F.concat(F.when(match.startswith("-") & F.coalesce(n != 0, F.lit(True)), F.lit("minus "))
                                                 .otherwise(F.lit("")), cardinal(digits)))


def currency(match: Column) -> Column:
    """Amount in digits and unit words, whole units and hundredths."""
    def spelled(m: Column) -> Column:
        sign = F.substring(m, 1, 1)
        value = F.substring(m, F.lit(2), F.length(m))
        parts = F.split(F.replace(value, F.lit(","), F.lit("")), r"\.", -1)
        whole = F.regexp_replace(F.element_at(parts, 1), "^0+", "")
        part = F.regexp_replace(F.coalesce(F.try_element_at(parts, F.lit(2)), F.lit("")), "^0+", "")

        def unit(k: int) -> Column:
            out = F.lit("")
            for s, names in CURRENCIES.items():
                out = F.when(sign == s, F.lit(names[k])).otherwise(out)
            return out
        units = F.when(whole == "1", unit(2)).otherwise(unit(3))
        cents = (F.when(part == "1", unit(0)).when(part == "100", unit(2)).when(part == "200", unit(3)).otherwise(unit(1)))
        text = F.array_join(F.filter(F.array(F.when(whole != "", F.concat(whole, F.lit(" "), units)),
                                             F.when(part != "", F.concat(part, F.lit(" "), cents))), lambda x: x.isNotNull()), " ")
        return (F.when(F.size(parts) > 2, F.concat(value, F.lit(" "), unit(3)))
                .when(text == "", F.concat(F.lit("zero "), unit(3))).otherwise(text))
    return let(match, spelled)


def clock_time(match: Column) -> Column:
    """Hour, minutes (with "oh" below ten) and the half of the day; midnight counts as past noon."""
    def spelled(m: Column) -> Column:
        hour = F.regexp_extract(m, "^[0-9]+", 0).cast("int")
        minute = F.regexp_extract(m, ":([0-9]{2})", 1).cast("int")
        half = F.regexp_extract(m, "(?i)[ap]m$", 0)
        shown = F.when(hour == 0, F.lit(12)).when(hour > 12, hour - 12).otherwise(hour)
        minutes = (F.when(minute == 0, F.lit(None).cast("string"))
                   .when(minute < 10, F.concat(F.lit("oh "), below_hundred(minute))).otherwise(below_hundred(minute)))
        noon = F.when((hour >= 12) | (hour == 0), F.lit("p m")).otherwise(F.lit("a m"))
        spoken = F.when(half != "", F.concat_ws(" ", F.substring(half, 1, 1), F.substring(half, 2, 1))).otherwise(noon)
        return F.concat_ws(" ", below_hundred(shown), minutes, spoken)
    return let(match, spelled)


def expand_time(text) -> Column:
    """English clock times as words."""
    return replace_matches(F.col(text) if isinstance(text, str) else text, TIME, clock_time)


def normalize_numbers(text) -> Column:
    """English numbers as words: grouping commas, currencies, decimals, ordinals, whole numbers."""
    out = F.col(text) if isinstance(text, str) else text
    for pattern, rewrite in ((COMMA_NUMBER, lambda m: F.replace(m, F.lit(","), F.lit(""))), (CURRENCY, currency),
                             (DECIMAL, lambda m: F.replace(m, F.lit("."), F.lit(" point "))),
                             (ORDINAL, lambda m: ordinal(F.regexp_extract(m, "^[0-9]+", 0))), (NUMBER, number)):
        out = let(out, lambda t, p=pattern, r=rewrite: replace_matches(t, p, r))
    return out


def number_tokens(df: DataFrame, text: str, lang: str) -> DataFrame:
    """The number-like tokens of a corpus by language and kind, with their counts:
    what a verbaliser for that language has to cover."""
    kinds = {"time": TIME, "currency": CURRENCY, "ordinal": ORDINAL, "decimal": DECIMAL, "number": NUMBER}

    def found(kind: str, pattern: str) -> Column:
        return F.transform(F.regexp_extract_all(F.col(text), F.lit(pattern), 0),
                           lambda m: F.struct(F.lit(kind).alias("kind"), m.alias("token")))

    each = F.explode(F.flatten(F.array(*[found(k, p) for k, p in kinds.items()])))
    t = df.select(F.col(lang).alias("lang"), each.alias("t"))
    return t.groupBy("lang", "t.kind", "t.token").agg(F.count(F.lit(1)).alias("n"))
