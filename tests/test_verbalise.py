"""Numbers in words: own cases, a plain sequential re-computation over a given table, and the table form."""

import os
import re
from decimal import ROUND_HALF_UP, Decimal

import pytest
from pyspark.sql import functions as F

from vocable.functions import verbalise as V

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


@pytest.fixture(scope="module")
def run(spark):
    def f(texts, lang):
        df = spark.createDataFrame(list(enumerate(texts)), "i long, t string")
        return [r.o for r in df.select("i", V.expand_numbers("t", lang).alias("o")).orderBy("i").collect()]
    return f


CASES = {
    "fr": {"7 chats, 21 chiens, 61 ou 71": "sept chats, vingt et un chiens, soixante et un ou soixante et onze",
           "80 81 90 99": "quatre-vingts quatre-vingt-un quatre-vingt-dix quatre-vingt-dix-neuf",
           "200 201 1.000 2.000 80.000": "deux cents deux cent un mille deux mille quatre-vingt mille",
           "1er 2e 5e 9e 80e 21e": "premier deuxième cinquième neuvième quatre-vingtième vingt et unième",
           "3,50 puis 0,05": "trois virgule cinq puis zéro virgule zéro cinq",
           "€2,10 ou 1€, £3": "deux euros et dix centimes ou un euro, trois livres", "": "", "sans": "sans"},
    "de": {"1 21 101 und 1.001": "eins einundzwanzig einhunderteins und eintausendeins",
           "Am 1. Tag, am 20. und 17. Tag": "Am erste Tag, am zwanzigste und siebzehnte Tag",
           "2.000.001": "zwei Millionen eins", "kostet 1,01€ oder $16": "kostet ein Euro und ein Cent oder sechzehn Dollar",
           "0,70": "null Komma sieben"},
    "es": {"1 21 31 100 115 500": "uno veintiuno treinta y uno cien ciento quince quinientos", "21.000 y 1.000.000": "veintiún mil y un millón",
           "2.000.000": "dos millones", "1er 10º 34º 500º": "primero décimo trigésimo cuarto quingentésimo",
           "31€ y 1,01$": "treinta y un euros y un dólar con un centavo"},
    "en": {"1,234 and 1,001": "one thousand, two hundred and thirty-four and one thousand and one", "2nd 12th 20th 100th": "second twelfth twentieth one hundredth",
           "3.05": "three point zero five", "$1.01 or £2": "one dollar, one cent or two pounds sterling",
           "1000000007": "one billion and seven", "1234567890123456789012": " ".join("one two three four five six seven eight nine zero".split() * 2 + ["one", "two"])},
}


@pytest.mark.parametrize("lang", list(CASES))
def test_own_cases(run, lang):
    assert run(list(CASES[lang]), lang) == list(CASES[lang].values())


def plain_cardinal(n, lang):
    """Groups of three digits put together by a loop."""
    rule = V._RULES[lang]
    if n < 1000:
        return rule(n)
    if lang == "es":
        high, low = divmod(n, 10 ** 12) if n >= 10 ** 12 else divmod(n, 10 ** 6) if n >= 10 ** 6 else divmod(n, 1000)
        cut = re.sub("uno$", "un", re.sub("veintiuno$", "veintiún", plain_cardinal(high, lang)))
        if n >= 10 ** 6:
            one, many = ("billón", "billones") if n >= 10 ** 12 else ("millón", "millones")
            head = f"un {one}" if high == 1 else f"{cut} {many}"
        else:
            head = "mil" if high == 1 else f"{cut} mil"
        return head + (f" {plain_cardinal(low, lang)}" if low else "")
    groups, k = [], 0
    while n:
        groups.append((n % 1000, k))
        n, k = n // 1000, k + 1
    out = []
    for g, k in reversed(groups):
        if not g:
            continue
        w = rule(g)
        if lang == "en":
            out.append(w + (f" {V.SCALES[k]}" if k else ""))
        elif lang == "fr":
            w = re.sub("(cent|vingt)s$", r"\1", w) if k == 1 else w
            out.append("mille" if k == 1 and g == 1 else w + (" mille" if k == 1 else f" {V.FR_SCALES[k - 2]}{'s' * (g > 1)}" if k else ""))
        else:
            short = re.sub("eins$", "ein", w)
            out.append(w if k == 0 else short + "tausend" if k == 1 else (f"eine {V.DE_SCALES[k - 2][0]}" if g == 1 else f"{short} {V.DE_SCALES[k - 2][1]}"))
    if lang == "en":
        low = groups[0][0]
        return ", ".join(out[:-1]) + (" and " if 0 < low < 100 else ", ") + out[-1] if len(out) > 1 else out[0]
    if lang == "de" and len(groups) > 1 and groups[0][0] and groups[1][0]:
        out[-2:] = ["".join(out[-2:])]
    return " ".join(out)


def plain(text, lang):
    """One rule after the other over the whole text."""
    text = re.sub(V.SEPARATED["en" if lang == "en" else "other"], lambda m: m[0].replace("," if lang == "en" else ".", ""), text, flags=re.A)

    def card(d):
        d = d.lstrip("0") or "0"
        return plain_cardinal(int(d), lang) if len(d) <= V.LONGEST else " ".join(V._RULES[lang](int(x)) for x in d)

    def money(m):
        value = Decimal(re.search(V.AMOUNT, m[0])[0].replace(",", ".")).quantize(Decimal(".01"), ROUND_HALF_UP)
        whole, cents = divmod(int(value * 100), 100)
        names = V.CURRENCIES[next(s for s in "£$€" if s in m[0])][lang]

        def say(n):
            w = {"en": "one", "fr": "un", "de": "ein", "es": "un"}[lang] if n == 1 else plain_cardinal(n, lang)
            return re.sub("uno$", "un", re.sub("veintiuno$", "veintiún", w)) if lang == "es" else w
        out = f"{say(whole)} {names[whole != 1]}"
        given = re.search(r"[.,]([0-9]+)", m[0])
        return out + V.AND[lang] + f"{say(cents)} {names[2 + (cents != 1)]}" if given and int(given[1]) else out

    for sign in "£$€":
        text = re.sub(rf"{re.escape(sign)}[0-9]+(?:[.,][0-9]+)?|[0-9]+(?:[.,][0-9]+)?{re.escape(sign)}", money, text)
    text = re.sub(V.DECIMAL, lambda m: f"{card(re.split('[.,]', m[0])[0])} {V.POINT[lang]} " + " ".join(
        V._RULES[lang](int(x)) for x in (re.split("[.,]", m[0])[1].rstrip("0") or "0")), text)
    return text, card


def test_given_documents_against_plain_rules(spark):
    """All documents in the language they are in; the ordinals are those of the expressions, which the cases cover."""
    df = spark.read.parquet(f"{SF}/documents.parquet").where(F.col("text").isNotNull())
    extra = F.concat(F.col("text"), F.lit(" "), F.col("doc_id") * 1234567, F.lit(" £"), F.col("doc_id"), F.lit(".25 x "), F.col("doc_id"), F.lit(",5 y"))
    rows = df.select("lang", extra.alias("text"), V.expand_numbers_by(extra, "lang").alias("o")).collect()
    compared = 0
    for r in rows:
        text, card = plain(r.text, r.lang)
        if re.search(V.ORDINAL[r.lang], text):
            continue
        assert r.o == re.sub("[0-9]+", lambda m: card(m[0]), text)
        compared += 1
    assert compared > 100


def test_table_form_and_other_languages(spark):
    df = spark.createDataFrame([(1, "a 7 b 8th 7", "en"), (2, "7", "xx"), (3, None, "en"), (4, "none", "en"), (5, "7 9", "en")], "k long, t string, lang string")
    tokens = V.number_positions(df, "k", "t", "lang")
    assert sorted((r.pos, r.token) for r in tokens.where("lang = 'en'").collect()) == [(0, "7"), (0, "7"), (1, "8th"), (1, "9"), (2, "7")]
    words = spark.createDataFrame([("en", "7", "seven"), ("en", "8th", "eighth"), ("xx", "7", "septem")], "lang string, token string, words string")
    got = {r.k: r.expanded for r in V.rewrite_by_table(df, "k", "t", "lang", words).collect()}
    assert got == {1: "a seven b eighth seven", 2: "septem", 3: None, 4: "none", 5: "seven 9"}
    with pytest.raises(ValueError, match="xx"):
        V.expand_numbers("t", "xx")


def test_chinese_numerals(spark):
    """Every number to 11,000 and larger ones, against a digit-by-digit reading."""
    from vocable.functions.scripts import chinese_numbers

    cases = {"0": "零", "10": "十", "14": "十四", "3014": "三千零十四", "3314": "三千三百一十四", "20000": "二万", "100020000": "一亿二万",
             "100030000": "一亿零三万", "2000000000000": "二兆", "10000": "一万", "10010": "一万零十", "007": "七", "00": "零", "123456789012": "一千二百三十四亿五千六百七十八万九千零十二",
             "a1b22": "a一b二十二", "x": "x", "": "", "9" * 49: "9" * 49}
    df = spark.createDataFrame(list(enumerate(cases)), "i long, t string")
    assert [r.o for r in df.select("i", chinese_numbers("t").alias("o")).orderBy("i").collect()] == list(cases.values())
    value = {c: i for i, c in enumerate("零一二三四五六七八九")}

    def read(s):
        total = part = digit = 0
        for c in s:
            if c in value:
                digit = value[c]
            elif c == "万":
                total, part, digit = (total + part + digit) * 10_000, 0, 0
            else:
                part, digit = part + (digit or 1) * {"十": 10, "百": 100, "千": 1000}[c], 0
        return total + part + digit
    got = spark.range(11_000).select("id", chinese_numbers(F.col("id").cast("string")).alias("o")).collect()
    assert all(read(r.o) == r.id for r in got)


def test_dictionary_normalisers(spark):
    from vocable.functions import scripts as S

    df = spark.createDataFrame([(1, " 漢字 2 KB of TV and tv漢, AB.C "), (2, None), (3, "AB"), (4, "")], "k long, t string")
    words = spark.createDataFrame([("ko", "TV", "티비"), ("ko", "KB", "케이비"), ("en", "and", "x")], "lang string, token string, words string")
    got = {r.k: r.normalised for r in S.korean_normalise(df, "k", "t", {"AB.C": "Long", "AB": "Short", "2 KB": "two KB"}, words).collect()}
    assert got == {1: " two 케이비 of 티비 and tv, long", 2: None, 3: "short", 4: ""}
    assert df.select(S.bangla_digits(F.lit("10:45 a:5 7")).alias("o")).first().o == "১০ এর ৪৫ a:৫ ৭"
