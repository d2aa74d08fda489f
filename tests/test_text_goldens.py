"""Text rules against their own tables, and plain re-computations."""

import re
import string
import unicodedata

from pyspark.sql import functions as F


def _check(spark, cases, fn):
    """``cases`` are (input, expected, language)."""
    df = spark.createDataFrame(cases, "inp string, expected string, lang string")
    wrong = [(r.inp, r.out) for r in df.select("inp", "expected", fn(F.col("inp"), "lang").alias("out")).collect()
             if r.out != r.expected]
    assert not wrong, wrong[:5]


def test_multilingual_abbreviations_follow_their_table(spark):
    """Every rule alone in a sentence, in lower and upper case, and inside a word, where it must not act."""
    from vocable.functions.text import ABBREVIATIONS_ML, expand_abbreviations_by

    cases = []
    for lang, rules in ABBREVIATIONS_ML.items():
        end = "" if lang == "ru" else "."
        seen = set()
        for word, out in rules:
            if word in seen:                 # an earlier rule has taken it
                continue
            seen.add(word)
            cases += [(f"zz {w}{end} zz", f"zz {out} zz", lang) for w in (word, word.upper())]
            if lang != "ru":
                cases.append((f"zz q{word}. zz", f"zz q{word}. zz", lang))
                cases.append((f"zz {word} zz", f"zz {word} zz", lang))
    _check(spark, cases + [("xx mr. xx", "xx mr. xx", "xx")], expand_abbreviations_by)


def test_multilingual_symbols_follow_their_table(spark):
    from vocable.functions.text import SYMBOL_CHARS, SYMBOL_WORDS, expand_symbols_by

    cases = []
    for lang, words in SYMBOL_WORDS.items():
        for sym, word in zip(SYMBOL_CHARS, words):
            for inp in (f"7{sym}", f"{sym} 8", f"a {sym} b", f"a{sym}b"):
                out = inp.replace(sym, word)
                cases.append((inp, re.sub("  ", " ", out).strip(), lang))
    _check(spark, cases, expand_symbols_by)


ALLOWED = set(string.ascii_letters + string.digits + string.punctuation + " ") - {"\\"}


def _normalised(text, compat):
    """The corpus normaliser, one character and one word at a time."""
    from vocable.functions.text import CORPUS_ABBREVIATIONS, CORPUS_TAGS

    out = []
    for word in text.split():
        plain = [c for ch in word for c in unicodedata.normalize("NFKD", ch) if ord(c) < 128]
        out.append("".join(c if c in ALLOWED else "\0" for c in plain))
    line = re.sub("\0+", "[UNK]", " ".join(out))
    line = " ".join(line.split(" ")) if "  " not in line else re.sub(" +", " ", line)
    i, built = 0, ""
    while i < len(line):
        inside = i > 0 and (line[i - 1].isalnum() or line[i - 1] == "_")
        hit = None
        if not inside and (line[i].isalnum() or line[i] == "_"):
            for k, v in CORPUS_ABBREVIATIONS:
                after = line[i + len(k):i + len(k) + 1]
                if line.startswith(k, i) and (not compat or after.isalnum() or after == "_"):
                    hit = (k, v)
                    break
        built += hit[1] if hit else line[i]
        i += len(hit[0]) if hit else 1
    for k, v in CORPUS_TAGS:
        built = built.replace(k, v)
    return built.lower()


def test_corpus_normaliser_matches_a_plain_recomputation(spark):
    from conftest import SF001
    from vocable.functions.text import corpus_normalise

    extra = ["  Mrs. Gray <PERIOD> lent  Prof.Moss ¾ éclair \\ two\ttabs <NOISE> Ms. U.K. rôle ß  ",
             "No. 17, Dr. Y<QUESTIONMARK> and xMr. Z"]
    d = spark.read.parquet(f"{SF001}/documents.parquet").select("text").unionByName(
        spark.createDataFrame([(t,) for t in extra], "text string"))
    for compat in (False, True):
        mode = "compat" if compat else "strict"
        for r in d.select("text", corpus_normalise(F.col("text"), mode=mode).alias("n")).collect():
            assert r.n == _normalised(r.text, compat), r.text[:60]


def test_punctuation_split_restore_roundtrip(spark):
    from conftest import SF001
    from vocable.functions.text import punctuation_restore, punctuation_split

    d = spark.read.parquet(f"{SF001}/documents.parquet").select("text").unionByName(
        spark.createDataFrame([("¿Hola, qué tal?",), ("This is. example !",), ("no marks",)], "text string"))
    out = punctuation_restore(punctuation_split(d, "text", "s"), "s", "back").collect()
    for r in out:
        assert r.back == r.text
    ex = [r for r in out if r.text == "¿Hola, qué tal?"][0]
    assert list(ex.s.pieces) == ["Hola", "qué tal"]
    assert [(m.mark, m.position) for m in ex.s.marks] == [("¿", "BEGIN"), (", ", "MIDDLE"), ("?", "END")]


def test_lexicon_parse_and_lookup(spark):
    from vocable.operators.lexicon import first_pronunciations, lookup_words, parse_lexicon, reassemble

    lines = [";;; comment", "HELLO  HH AH0 L OW1", "HELLO(2)  HH EH0 L OW1", "WORLD  W ER1 L D",
             "'TIS  T IH1 Z", "BAD  B XX D", "lower  L OW1 ER0"]
    df = spark.createDataFrame([(x,) for x in lines], "value string")
    valid = ["HH", "AH0", "L", "OW1", "EH0", "W", "ER1", "D", "T", "IH1", "Z", "ER0", "B"]
    lex = parse_lexicon(df, valid_symbols=valid)
    got = sorted((r.word, r.alt, r.pron) for r in lex.collect())
    assert got == [("'TIS", 1, "T IH1 Z"), ("HELLO", 1, "HH AH0 L OW1"), ("HELLO", 2, "HH EH0 L OW1"),
                   ("WORLD", 1, "W ER1 L D")]
    assert [r.word for r in parse_lexicon(df, valid_symbols=valid, drop_ambiguous=True).collect()].count("HELLO") == 0
    text = spark.createDataFrame([(1, "(Hello world, unknown!")], "id long, t string")
    out = reassemble(lookup_words(text, "id", "t", first_pronunciations(lex)), "id").first().phonemes
    assert out == "({HH AH0 L OW1} {W ER1 L D}, unknown!"


def test_punctuation_strip_docstring(spark):
    from vocable.functions.text import strip_punctuation

    r = spark.createDataFrame([("This is. example !",)], "t string").select(strip_punctuation("t").alias("s")).first()
    assert r.s == "This is example"


def test_fold_ascii_of_every_code_point(spark):
    """Equal to the library's NFKD, for single code points, for all of them in a row, and in front of a combining mark."""
    from vocable.functions.folding import fold_ascii

    codes = [c for c in range(0x110000) if not 0xD800 <= c < 0xE000 and c]
    texts = [chr(c) for c in codes] + ["".join(map(chr, codes[i:i + 997])) for i in range(0, len(codes), 997)]
    texts += [f"a{chr(c)}\u0301\u0323b" for c in codes[::37]] + ["", "plain", "ﬁne ½ №5 ㎏ Ⅷ é😀"]
    df = spark.createDataFrame(list(enumerate(texts)), "i long, t string").repartition(8)
    got = df.select("i", fold_ascii(F.col("t")).alias("o")).toPandas().sort_values("i").o.tolist()
    want = [unicodedata.normalize("NFKD", t).encode("ascii", "ignore").decode() for t in texts]
    assert [i for i, (a, b) in enumerate(zip(got, want)) if a != b] == []
