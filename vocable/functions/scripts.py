"""Numerals of other scripts and dictionary normalisers as Column expressions.

Digit runs become Chinese numerals by groups of four digits: the words of a group
stand in one folded array literal made from a rule, groups are composed with
their units.  Character maps are ``translate``, substring maps one alternation,
word maps a join of the distinct tokens by position (``verbalise.rewrite_by_table``).
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vocable.functions.numbers import replace_matches
from vocable.functions.verbalise import rewrite_by_table
from vocable.operators.common import col, let

# Digits, units inside a group of four, units of the groups.
HAN_DIGITS, HAN_TENS, HAN_GROUPS = "零一二三四五六七八九", ["千", "百", "十", ""], ["", *"万亿兆京垓秭穰沟涧正载"]
#: Runs of more digits are out of range and stay.
HAN_LONGEST = 4 * len(HAN_GROUPS)
# Chinese characters that Korean text is stripped of, Bangla digits.
HANJA = "[⺀-⺙⺛-⻳⼀-⿕々〇〡-〩〸-〺〻㐀-䶵一-鿃豈-鶴侮-頻並-龎]"
BANGLA_DIGITS = "০১২৩৪৫৬৭৮৯"
LATIN_WORD = "[A-Za-z]+"


def _han_group(n: int) -> str:
    """A group of four digits: one zero for a run of them in front or inside, none behind; ten is
    not "one ten" where no hundred precedes it."""
    digits, out = f"{n:04d}", ""
    for i, d in enumerate(digits):
        if not int(digits[i:]):
            break
        if d == "0":
            out += "" if out.endswith(HAN_DIGITS[0]) else HAN_DIGITS[0]
        elif i == 2 and d == "1" and digits[1] == "0":
            out += HAN_TENS[2]
        else:
            out += HAN_DIGITS[int(d)] + HAN_TENS[i]
    return out


def chinese_number(digits: Column) -> Column:
    """A run of digits as a numeral."""
    table = F.split(F.lit("|".join(_han_group(n) for n in range(10_000))), r"\|")
    zero = F.lit(HAN_DIGITS[0])

    def spelled(d: Column) -> Column:
        padded, count = F.lpad(d, HAN_LONGEST, "0"), F.ceil(F.length(d) / 4).cast("int")
        groups = F.transform(F.sequence(count, F.lit(1), F.lit(-1)), lambda k: F.struct(
            k.alias("k"), F.substring(padded, F.lit(HAN_LONGEST + 1) - 4 * k, F.lit(4)).cast("int").alias("n")))
        unit = lambda k: F.element_at(F.array(*map(F.lit, HAN_GROUPS)), k)
        # a group of two alone takes no zero before it, unless it is the last
        parts = F.transform(groups, lambda g: F.when(g["n"] == 0, zero).when((g["n"] == 2) & (g["k"] > 1), F.concat(
            F.lit(HAN_DIGITS[2]), unit(g["k"]))).otherwise(F.concat(F.element_at(table, g["n"] + 1), unit(g["k"]))))
        joined = let(parts, lambda p: F.array_join(F.filter(p, lambda x, i: (i == 0) | (x != F.get(p, F.greatest(i - 1, F.lit(0))))), ""))
        return F.regexp_replace(joined, "^零+|零+$", "")
    return F.when(F.length(digits) > HAN_LONGEST, digits).when(digits.rlike("^0+$"), zero).otherwise(let(digits, spelled))


def chinese_numbers(text) -> Column:
    """Every run of digits in Chinese numerals."""
    t = col(text)
    return F.when(t.rlike("[0-9]"), replace_matches(t, "[0-9]+", chinese_number)).otherwise(t)


def bangla_digits(text) -> Column:
    """ASCII digits as Bangla ones; a colon between two digits is read "of"."""
    t = F.translate(col(text), "0123456789", BANGLA_DIGITS)
    return F.regexp_replace(t, f"(?<=[{BANGLA_DIGITS}]):(?=[{BANGLA_DIGITS}])", " এর ")


def without_hanja(text) -> Column:
    """Chinese characters removed from Korean text."""
    return F.regexp_replace(F.trim(col(text)), HANJA, "")


def replace_keys(text, mapping: dict[str, str]) -> Column:
    """Every key replaced by its value; at a place the first key in the map's order wins."""
    t = col(text)
    if not mapping:
        return t
    pairs = F.create_map(*[F.lit(x) for kv in mapping.items() for x in kv])
    return replace_matches(t, "(?:" + "|".join(re.escape(k).replace("\\ ", " ") for k in mapping) + ")", lambda m: F.element_at(pairs, m))


def map_words(df: DataFrame, key: str, text: str, lang: str, words: DataFrame, out: str = "mapped", pattern: str = LATIN_WORD) -> DataFrame:
    """The words of ``text`` that ``words`` (lang, token, words) knows replaced, the others kept; a table of any size, joined."""
    return rewrite_by_table(df, key, text, lang, words, out, pattern)


def korean_normalise(df: DataFrame, key: str, text: str, phrases: dict[str, str], words: DataFrame, out: str = "normalised") -> DataFrame:
    """J12 for Korean: Chinese characters out, phrases replaced, Latin words read by ``words`` (lang = 'ko', token, words), lower case."""
    d = df.withColumn("_t", replace_keys(without_hanja(text), phrases)).withColumn("_lang", F.lit("ko"))
    return map_words(d, key, "_t", "_lang", words, out).withColumn(out, F.lower(out)).drop("_t", "_lang")
