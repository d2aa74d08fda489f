"""Clock times and numbers against a plain re-computation."""

import re

import pytest
from pyspark.sql import functions as F

ONES = ("zero one two three four five six seven eight nine ten eleven twelve thirteen fourteen fifteen sixteen seventeen "
        "eighteen nineteen").split()
TENS = "x x twenty thirty forty fifty sixty seventy eighty ninety".split()


def small(n, joint=" "):
    if n < 20:
        return ONES[n]
    if n < 100:
        return TENS[n // 10] + (f"-{ONES[n % 10]}" if n % 10 else "")
    return f"{ONES[n // 100]} hundred" + (joint + small(n % 100) if n % 100 else "")


def words(n):
    if n < 1000:
        return small(n)
    names = ["", " thousand", " million", " billion", " trillion"]
    out, k = [], 0
    while n:
        if n % 1000:
            out.insert(0, small(n % 1000) + names[k])
        n, k = n // 1000, k + 1
    return ", ".join(out)


@pytest.fixture(scope="module")
def run(spark):
    def f(texts, fn):
        df = spark.createDataFrame(list(enumerate(texts)), "i long, t string")
        return [r.o for r in df.select("i", fn(F.col("t")).alias("o")).orderBy("i").collect()]
    return f


def test_whole_numbers(run):
    from vocable.functions.numbers import normalize_numbers

    ns = list(range(0, 1001)) + [3000, 3001, 9999, 10_000, 12_345, 100_001, 1_000_000, 2_000_017, 987_654_321, 10 ** 12 + 5]
    assert run([f"x {n} y" for n in ns], normalize_numbers) == [f"x {words(n)} y" for n in ns]
    assert run(["a", "", "-7", "007", "12,345 and 1,000,000"], normalize_numbers) == [
        "a", "", "minus seven", "seven", "twelve thousand, three hundred forty-five and one million"]


def test_years(run):
    from vocable.functions.numbers import normalize_numbers

    want = {"1001": "ten oh one", "1066": "ten sixty-six", "1900": "nineteen hundred", "1984": "nineteen eighty-four",
            "1905": "nineteen oh five", "2000": "two thousand", "2007": "two thousand seven", "2010": "twenty ten",
            "2024": "twenty twenty-four", "2999": "twenty-nine ninety-nine", "1000": "one thousand"}
    assert run(list(want), normalize_numbers) == list(want.values())


def test_ordinals_decimals_currencies(run):
    from vocable.functions.numbers import normalize_numbers

    want = {"1st": "first", "2nd place": "second place", "12th": "twelfth", "20th": "twentieth", "21st": "twenty-first",
            "101st": "one hundred and first", "3.14": "three point fourteen", "$1": "one dollar", "$2.01": "two dollars one cent",
            "£1.50": "one pound sterling fifty pence", "$0.00": "zero dollars", "$1,200": "twelve hundred dollars",
            "¥5": "five yen", "$.75": "seventy-five cents", "cost $3,000.": "cost three thousand dollars."}
    assert run(list(want), normalize_numbers) == list(want.values())


def test_clock_times(run):
    from vocable.functions.numbers import expand_time

    texts, want = [], []
    for h in range(24):
        for m in (0, 5, 10, 42):
            shown = 12 if h == 0 else h - 12 if h > 12 else h
            part = "" if m == 0 else f" oh {ONES[m]}" if m < 10 else f" {small(m)}"
            texts.append(f"at {h}:{m:02d}, then")
            want.append(f"at {small(shown)}{part} {'p m' if h >= 12 or h == 0 else 'a m'}, then")
    assert run(texts, expand_time) == want
    assert run(["8:15 pm", "08:15AM", "25:10", "7:61"], expand_time) == ["eight fifteen p m", "eight fifteen A M", "25:10", "7:61"]


def test_english_cleaners_and_corpus(run, spark):
    from conftest import SF001
    from vocable.functions.numbers import normalize_numbers
    from vocable.functions.text import cleaner

    assert run(["Mr. Lee paid $20 & left at 9:30, on May 3rd, 1999."], cleaner("english_cleaners")) == [
        "mister lee paid twenty dollars and left at nine thirty a m, on may third, nineteen ninety nine."]
    assert run(["Call 2 of 14% at noon"], cleaner("phoneme_cleaners"))[0].startswith("Call two of fourteen")
    d = spark.read.parquet(f"{SF001}/documents.parquet").select(normalize_numbers("text").alias("o"), "text").collect()
    for r in d:
        assert not re.search(r"(?<![0-9])[0-9]{1,36}(?![0-9])", r.o)
        if not re.search("[0-9]", r.text):
            assert r.o == r.text
