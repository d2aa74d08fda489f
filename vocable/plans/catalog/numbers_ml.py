"""J9 queries: numbers of the documents in words of their language."""

from __future__ import annotations

from pyspark.sql import functions as F

from vocable.functions import verbalise as V
from vocable.plans.registry import register
from vocable.sources.tables import table

#: Number words of 0 to 999 and their compositions below a million, in SQL.
WORDS_SQL = """
WITH lists AS (SELECT * FROM (VALUES
  ('en', string_split('zero one two three four five six seven eight nine ten eleven twelve thirteen fourteen fifteen sixteen seventeen eighteen nineteen', ' '),
         string_split('- - twenty thirty forty fifty sixty seventy eighty ninety', ' ')),
  ('fr', string_split('zéro un deux trois quatre cinq six sept huit neuf dix onze douze treize quatorze quinze seize dix-sept dix-huit dix-neuf', ' '),
         string_split('- - vingt trente quarante cinquante soixante soixante quatre-vingt quatre-vingt', ' ')),
  ('de', string_split('null eins zwei drei vier fünf sechs sieben acht neun zehn elf zwölf dreizehn vierzehn fünfzehn sechzehn siebzehn achtzehn neunzehn', ' '),
         string_split('- - zwanzig dreißig vierzig fünfzig sechzig siebzig achtzig neunzig', ' ')),
  ('es', string_split('cero uno dos tres cuatro cinco seis siete ocho nueve diez once doce trece catorce quince dieciséis diecisiete dieciocho diecinueve', ' '),
         string_split('- - veinti treinta cuarenta cincuenta sesenta setenta ochenta noventa', ' '))) v(lang, u, t)),
h AS (SELECT lang, u, n, CASE
    WHEN n < 20 THEN u[n + 1]
    WHEN lang = 'en' THEN t[n // 10 + 1] || CASE WHEN n % 10 > 0 THEN '-' || u[n % 10 + 1] ELSE '' END
    WHEN lang = 'de' THEN CASE n % 10 WHEN 0 THEN '' WHEN 1 THEN 'einund' ELSE u[n % 10 + 1] || 'und' END || t[n // 10 + 1]
    WHEN lang = 'es' AND n = 20 THEN 'veinte'
    WHEN lang = 'es' AND n < 30 THEN CASE n WHEN 22 THEN 'veintidós' WHEN 23 THEN 'veintitrés' WHEN 26 THEN 'veintiséis' ELSE 'veinti' || u[n % 10 + 1] END
    WHEN lang = 'es' THEN t[n // 10 + 1] || CASE WHEN n % 10 > 0 THEN ' y ' || u[n % 10 + 1] ELSE '' END
    WHEN n = 80 THEN 'quatre-vingts'
    WHEN n > 80 THEN 'quatre-vingt-' || u[n - 79]
    WHEN n = 71 THEN 'soixante et onze'
    WHEN n >= 70 THEN 'soixante-' || u[n - 59]
    WHEN n % 10 = 1 THEN t[n // 10 + 1] || ' et un'
    ELSE t[n // 10 + 1] || CASE WHEN n % 10 > 0 THEN '-' || u[n % 10 + 1] ELSE '' END END AS w
  FROM lists, (SELECT unnest(range(100))::INT AS n)),
k AS (SELECT h.lang, c * 100 + h.n AS n, CASE
    WHEN c = 0 THEN w
    WHEN h.lang = 'en' THEN u[c + 1] || ' hundred' || CASE WHEN h.n > 0 THEN ' and ' || w ELSE '' END
    WHEN h.lang = 'de' THEN CASE WHEN c = 1 THEN 'ein' ELSE u[c + 1] END || 'hundert' || CASE WHEN h.n > 0 THEN w ELSE '' END
    WHEN h.lang = 'fr' THEN CASE WHEN c = 1 THEN '' ELSE u[c + 1] || ' ' END || 'cent' || CASE WHEN h.n > 0 THEN ' ' || w WHEN c > 1 THEN 's' ELSE '' END
    WHEN c = 1 THEN CASE WHEN h.n = 0 THEN 'cien' ELSE 'ciento ' || w END
    ELSE CASE c WHEN 5 THEN 'quinientos' WHEN 7 THEN 'setecientos' WHEN 9 THEN 'novecientos' ELSE u[c + 1] || 'cientos' END
         || CASE WHEN h.n > 0 THEN ' ' || w ELSE '' END END AS w
  FROM h, (SELECT unnest(range(10))::INT AS c)),
short AS (SELECT lang, n, w, CASE lang
    WHEN 'de' THEN regexp_replace(w, 'eins$', 'ein')
    WHEN 'fr' THEN regexp_replace(w, '(cent|vingt)s$', '\\1')
    WHEN 'es' THEN regexp_replace(regexp_replace(w, 'veintiuno$', 'veintiún'), 'uno$', 'un') ELSE w END AS s FROM k),
ord AS (SELECT lang, n, CASE lang
    WHEN 'en' THEN CASE WHEN regexp_matches(w, '(one|two|three|five|eight|nine|twelve)$') THEN
         regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(w, 'one$', 'first'),
         'two$', 'second'), 'three$', 'third'), 'five$', 'fifth'), 'eight$', 'eighth'), 'nine$', 'ninth'), 'twelve$', 'twelfth')
         WHEN w LIKE '%y' THEN regexp_replace(w, 'y$', 'ieth') ELSE w || 'th' END
    WHEN 'fr' THEN CASE WHEN n = 1 THEN 'premier' ELSE regexp_replace(regexp_replace(regexp_replace(regexp_replace(w, '(vingt|cent)s$', '\\1'),
         'cinq$', 'cinqu'), 'neuf$', 'neuv'), 'e$', '') || 'ième' END
    WHEN 'de' THEN CASE WHEN n % 100 = 1 THEN regexp_replace(w, 'eins$', 'erste') WHEN n % 100 = 3 THEN regexp_replace(w, 'drei$', 'dritte')
         WHEN n % 100 = 7 THEN regexp_replace(w, 'sieben$', 'siebte') WHEN n % 100 = 8 THEN w || 'e'
         WHEN n % 100 BETWEEN 1 AND 19 THEN w || 'te' ELSE w || 'ste' END
    ELSE array_to_string(list_filter([
         (string_split('- centésimo ducentésimo tricentésimo cuadringentésimo quingentésimo sexcentésimo septingentésimo octingentésimo noningentésimo', ' '))[n // 100 + 1],
         (string_split('- décimo vigésimo trigésimo cuadragésimo quincuagésimo sexagésimo septuagésimo octogésimo nonagésimo', ' '))[n // 10 % 10 + 1],
         (string_split('- primero segundo tercero cuarto quinto sexto séptimo octavo noveno', ' '))[n % 10 + 1]], lambda x: x <> '-'), ' ') END AS w FROM k),
d AS (SELECT doc_id, lang, regexp_replace(text, '[0-9£$€]', '', 'g') AS rest, (doc_id * 7919 % 1000000)::INT AS m, (doc_id % 999 + 1)::INT AS o,
             (doc_id % 1000)::INT AS x, (doc_id % 9 + 1)::INT AS f, (doc_id * 13 % 90 + 10)::INT AS cents FROM documents WHERE lang IN ('en', 'fr', 'de', 'es'))
SELECT doc_id, CASE
    WHEN m < 1000 THEN lo.w
    WHEN d.lang = 'en' THEN hi.w || ' thousand' || CASE WHEN m % 1000 = 0 THEN '' WHEN m % 1000 < 100 THEN ' and ' || lo.w ELSE ', ' || lo.w END
    WHEN d.lang = 'de' THEN hi.s || 'tausend' || CASE WHEN m % 1000 = 0 THEN '' ELSE lo.w END
    ELSE CASE WHEN m // 1000 = 1 THEN '' ELSE hi.s || ' ' END || CASE d.lang WHEN 'fr' THEN 'mille' ELSE 'mil' END
         || CASE WHEN m % 1000 = 0 THEN '' ELSE ' ' || lo.w END END
  || ' ; ' || xs.w || CASE d.lang WHEN 'en' THEN ' point ' WHEN 'fr' THEN ' virgule ' WHEN 'de' THEN ' Komma ' ELSE ' punto ' END || fs.w
  || ' ; ' || os.w || ' ; '
  || CASE WHEN x = 1 THEN CASE d.lang WHEN 'en' THEN 'one' WHEN 'de' THEN 'ein' ELSE 'un' END WHEN d.lang = 'es' THEN xs.s ELSE xs.w END
  || CASE d.lang WHEN 'de' THEN ' Euro und ' WHEN 'en' THEN ' euro, ' WHEN 'fr' THEN CASE WHEN x = 1 THEN ' euro et ' ELSE ' euros et ' END
                 ELSE CASE WHEN x = 1 THEN ' euro con ' ELSE ' euros con ' END END
  || CASE WHEN d.lang = 'es' THEN cs.s ELSE cs.w END
  || CASE d.lang WHEN 'de' THEN ' Cent' WHEN 'en' THEN ' cents' WHEN 'fr' THEN ' centimes' ELSE ' céntimos' END || ' ; ' || rest AS expanded
FROM d JOIN short lo ON lo.lang = d.lang AND lo.n = m % 1000 JOIN short hi ON hi.lang = d.lang AND hi.n = m // 1000
JOIN short xs ON xs.lang = d.lang AND xs.n = x JOIN short fs ON fs.lang = d.lang AND fs.n = f
JOIN short cs ON cs.lang = d.lang AND cs.n = cents JOIN ord os ON os.lang = d.lang AND os.n = o
"""


def numbered(spark, sf):
    """Documents of the four languages, their own digits replaced by a number, a decimal, an ordinal and an amount in front."""
    d = table(spark, sf, "documents").where(F.col("lang").isin(*V.LANGUAGES))
    comma = F.when(F.col("lang") == "en", F.lit(".")).otherwise(F.lit(","))
    suffix = F.when(F.col("lang") == "en", F.lit("th")).when(F.col("lang") == "fr", F.lit("e")).when(
        F.col("lang") == "de", F.lit(".")).otherwise(F.lit("º"))
    text = F.concat_ws(" ; ", (F.col("doc_id") * 7919 % 1000000).cast("string"), F.concat(F.col("doc_id") % 1000, comma, F.col("doc_id") % 9 + 1),
                       F.concat(F.col("doc_id") % 999 + 1, suffix),
                       F.concat(F.col("doc_id") % 1000, comma, F.col("doc_id") * 13 % 90 + 10, F.lit("€")),
                       F.regexp_replace("text", "[0-9£$€]", ""))
    return d.select("doc_id", "lang", text.alias("text"))


@register("j9_numbers_in_words", WORDS_SQL)
def j9_words(spark, sf):
    return numbered(spark, sf).select("doc_id", V.expand_numbers_by("text", "lang").alias("expanded"))


@register("j9_numbers_by_table", WORDS_SQL)
def j9_table(spark, sf):
    """The same through the table of distinct tokens, joined back by position."""
    d = numbered(spark, sf).withColumn("text", F.regexp_replace("text", r"([0-9])\.( )", "$1º$2"))
    pattern = r"(?:[0-9]+[.,][0-9]+€|[0-9]+[.,][0-9]+|[0-9]+(?:th|e|º)|[0-9]+)"
    token = V.number_positions(d, "doc_id", "text", "lang", pattern).select("lang", "token").distinct()
    words = F.lit(None).cast("string")
    for lang in V.LANGUAGES:
        words = F.when(F.col("lang") == lang, V.verbalised(F.col("token"), lang)).otherwise(words)
    return V.rewrite_by_table(d, "doc_id", "text", "lang", token.withColumn("words", words), pattern=pattern).select("doc_id", "expanded")


@register("j10_chinese_numerals", """
WITH t AS (SELECT n, regexp_replace(regexp_replace(regexp_replace(
             list_aggregate(list_transform(range(1, 5), lambda i: CASE substr(lpad(n::varchar, 4, '0'), i, 1) WHEN '0' THEN '零'
               ELSE substr('零一二三四五六七八九', substr(lpad(n::varchar, 4, '0'), i, 1)::int + 1, 1) || ['千', '百', '十', ''][i] END), 'string_agg', ''),
             '零+', '零', 'g'), '零+$', ''), '零一十', '零十') AS w FROM (SELECT unnest(range(10000))::INT AS n)),
d AS (SELECT doc_id, regexp_replace(text, '[0-9]', '', 'g') AS rest, doc_id * 104729 * 7919 % 1000000000000 AS m FROM documents),
g AS (SELECT doc_id, rest, m, (m // 100000000)::INT AS a, (m // 10000 % 10000)::INT AS b, (m % 10000)::INT AS c FROM d),
p AS (SELECT doc_id, rest, m, CASE WHEN a = 0 THEN '' WHEN a = 2 THEN '二亿' ELSE x.w || '亿' END AS pa,
             CASE WHEN b = 0 AND a > 0 THEN '零' WHEN b = 0 THEN '' WHEN b = 2 THEN '二万' ELSE y.w || '万' END AS pb,
             CASE WHEN c = 0 THEN CASE WHEN b = 0 AND a > 0 THEN '' ELSE '零' END ELSE z.w END AS pc
      FROM g JOIN t x ON x.n = a JOIN t y ON y.n = b JOIN t z ON z.n = c)
SELECT doc_id, CASE WHEN m = 0 THEN '零' ELSE regexp_replace(pa || pb || pc, '^零+|零+$', '', 'g') END || ' ' || rest AS numerals FROM p
""")
def j10(spark, sf):
    from vocable.functions.scripts import chinese_numbers
    d = table(spark, sf, "documents")
    m = (F.col("doc_id") * 104729 * 7919 % 1000000000000).cast("string")
    return d.select("doc_id", chinese_numbers(F.concat_ws(" ", m, F.regexp_replace("text", "[0-9]", ""))).alias("numerals"))


@register("j12_word_maps", """
WITH w AS (SELECT lang, unnest(regexp_extract_all(text, '[A-Za-z]+')) AS token FROM documents),
m AS (SELECT lang, token, '<' || upper(token) || '>' AS words FROM w GROUP BY lang, token HAVING count(*) >= 20),
p AS (SELECT doc_id, lang, regexp_extract_all(text, '[A-Za-z]+') AS ts, string_split_regex(text, '[A-Za-z]+') AS gaps FROM documents),
e AS (SELECT doc_id, lang, unnest(ts) AS token, unnest(range(len(ts))) AS k FROM p),
r AS (SELECT doc_id, list(coalesce(words, e.token) ORDER BY k) AS ws FROM e LEFT JOIN m ON m.lang = e.lang AND m.token = e.token GROUP BY doc_id)
SELECT p.doc_id, array_to_string(list_transform(range(len(gaps)), lambda i: gaps[i + 1] || coalesce(ws[i + 1], '')), '') AS mapped
FROM p LEFT JOIN r ON r.doc_id = p.doc_id
""")
def j12(spark, sf):
    """The frequent words of each language, a table of the corpus itself, mapped in every text."""
    from vocable.functions.scripts import LATIN_WORD, map_words
    d = table(spark, sf, "documents").select("doc_id", "lang", "text")
    words = d.select("lang", F.explode(F.regexp_extract_all("text", F.lit(LATIN_WORD), 0)).alias("token")).groupBy("lang", "token").agg(
        F.count(F.lit(1)).alias("n")).where("n >= 20").select("lang", "token", F.concat(F.lit("<"), F.upper("token"), F.lit(">")).alias("words"))
    return map_words(d, "doc_id", "text", "lang", words).select("doc_id", "mapped")
