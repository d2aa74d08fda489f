"""Licence scan with ordered signature rules.

A text is lower-cased (A-Z) and reduced to its words, each with a space of its
own on either side.  The rules of :mod:`license_rules` run in three steps, all of
them Spark expressions on the row, without a shuffle and without Python:

1. *Prefilter*: a text without any of the ``SIGNALS`` words is done.  In the
   others, a rule runs only where its keyword, a literal part of each of its
   matches, occurs.
2. *Rules*: the patterns that are left find their matches.  A mark set in front
   of each match before the text is cut into words gives its first word, so the
   cost follows the text's length, not the number of matches squared.
3. *Suppression*: among overlapping detections one with a better tier
   (identifier tag, then notice or grant, then name) wins; within a tier one
   that contains another wins, the earlier rule if they span the same words.
   A detection spans at most ``LONGEST`` words, so that only neighbours within
   that many places for each matching rule have to be compared: exact, and
   linear in the number of detections.

Base phrases are rules too, but neither suppress nor are suppressed.

Edge cases: a null or empty text has no words, no labels (empty strings), null
first and last words and score 0; texts of any length are read whole; repeated
rows are scanned each on its own; ties in span and tier go to the earlier rule;
an empty table gives an empty result; a null id is kept as null; other columns
are not read, so their names can't clash.
"""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vocable.llm.license_rules import LONGEST, SIGNALS, Rule, rules

#: Everything but words: ASCII other than digits and lower-case letters.
GAP = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
#: Precedes a match while its place is looked for; never part of a word.
MARK = "\x01"
RULE_TYPE = "array<struct<rank:int,tier:int,label:string,keyword:string,regex:string,strength:double>>"


def word_list(text: Column) -> Column:
    """Lower-cased words of a text; ``lower`` would turn the Kelvin sign into an ASCII
    letter, so another letter outside ASCII takes its place first."""
    low = F.lower(F.replace(F.coalesce(text.cast("string"), F.lit("")), F.lit("\u212a"), F.lit("\u0138")))
    return F.split(low, GAP)


def _rule_table(table: list[Rule]) -> Column:
    """The table as one array literal."""
    return F.from_json(F.lit(json.dumps([r._asdict() for r in table])), RULE_TYPE)


def _detected() -> str:
    """SQL: the rules in ``gated`` with the words of their matches, flattened to
    (start, stop, rank, tier, label, strength); ``norm`` is the spaced text."""
    matches = "filter(transform(gated, r -> struct(r, regexp_extract_all(norm, r.regex, 1) as found)), h -> size(h.found) > 0)"
    starts = (f"filter(transform(split(trim(regexp_replace(norm, h.r.regex, ' {MARK}$1 ')), '  '), "
              f"(w, i) -> if(startswith(w, '{MARK}'), i, null)), i -> i is not null)")
    n_words = "(octet_length(h.found[k]) - octet_length(replace(h.found[k], '  ', ''))) div 2"
    return (f"flatten(transform({matches}, h -> transform({starts}, (s, k) -> struct(s as start, "
            f"cast(s + {n_words} as int) as stop, h.r.rank as rank, h.r.tier as tier, h.r.label as label, h.r.strength as strength))))")


def detections(docs: DataFrame, text: str = "text", keep: list[str] | None = None,
               table: list[Rule] | None = None) -> DataFrame:
    """``keep`` columns, ``n_words``, ``base`` and ``found``: the matches of the base
    phrases and the detections that are left after suppression, as arrays of
    (start, stop, rank, tier, label, strength) in order of start; words count from
    0 and ``stop`` is the last word."""
    table = rules() if table is None else table
    if any(not r.keyword for r in table):
        raise ValueError("every rule needs a keyword")
    keep = list(docs.columns if keep is None else keep)
    d = docs.select(F.struct(*[F.col(f"`{c}`") for c in keep]).alias("row"), word_list(F.col(f"`{text}`")).alias("words"))
    # only the first and the last piece of a cut text can be empty
    edges = F.when(F.element_at("words", 1) == "", 1).otherwise(0) + F.when(
        (F.size("words") > 1) & (F.element_at("words", -1) == ""), 1).otherwise(0)
    d = d.select("row", (F.size("words") - edges).cast("long").alias("n_words"),
                 F.when(F.arrays_overlap("words", F.array(*map(F.lit, SIGNALS))),
                        F.concat(F.lit(" "), F.trim(F.array_join("words", "  ")), F.lit(" "))).alias("norm"))
    keywords = sorted({r.keyword for r in table})
    present = F.filter(F.array(*[F.when(F.contains("norm", F.lit(w)), F.lit(w)) for w in keywords]), lambda w: w.isNotNull())
    d = d.withColumn("present", F.when(F.col("norm").isNotNull(), present).otherwise(F.array().cast("array<string>")))
    gate = F.filter(_rule_table(table), lambda r: F.array_contains("present", r["keyword"]))
    d = d.withColumn("gated", F.when(F.size("present") > 0, gate).otherwise(F.array().cast(RULE_TYPE)))
    d = d.withColumn("hits", F.expr(f"array_sort({_detected()}, (a, b) -> {_ORDER})"))
    d = d.select("row", "n_words", F.expr("filter(hits, d -> d.tier < 0)").alias("base"),
                 F.expr("filter(hits, d -> d.tier >= 0)").alias("rest"))
    reach = f"{LONGEST} * size(array_distinct(transform(rest, x -> x.rank)))"
    near = f"slice(rest, greatest(1, i + 1 - {reach}), 2 * {reach} + 1)"
    beats = ("e.start <= d.stop and d.start <= e.stop and (e.tier < d.tier or (e.tier = d.tier and e.start <= d.start and "
             "e.stop >= d.stop and (e.start < d.start or e.stop > d.stop or e.rank < d.rank)))")
    return d.select("row.*", "n_words", "base", F.expr(f"filter(rest, (d, i) -> not exists({near}, e -> {beats}))").alias("found"))


_ORDER = ("case when a.start < b.start then -1 when a.start > b.start then 1 when a.stop > b.stop then -1 "
          "when a.stop < b.stop then 1 else a.rank - b.rank end")


def license_spans(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per detection: doc_id, start, stop (words from 0), label, tier, strength."""
    d = detections(docs, text, [doc_id])
    return d.select(F.col(f"`{doc_id}`").alias("doc_id"), F.explode("found").alias("f")).select(
        "doc_id", "f.start", "f.stop", "f.label", "f.tier", "f.strength")


def license_scan(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Per document: doc_id, n_words, n_base, first_word, last_word, base_labels, labels,
    score (of the surest detection), n_found (detections left after suppression)."""
    d = detections(docs.select(F.col(f"`{doc_id}`").alias("doc_id"), F.col(f"`{text}`").alias("text")), "text", ["doc_id"])
    starts = "transform(base, b -> b.start)"
    names = "array_sort(array_distinct(transform({0}, b -> b.label)))"
    return d.select(
        "doc_id", "n_words", F.size("base").cast("long").alias("n_base"),
        F.expr(f"array_min({starts})").cast("long").alias("first_word"), F.expr(f"array_max({starts})").cast("long").alias("last_word"),
        F.expr(f"array_join({names.format('base')}, ',')").alias("base_labels"),
        F.expr(f"array_join({names.format('concat(base, found)')}, ',')").alias("labels"),
        F.expr("coalesce(array_max(transform(concat(base, found), b -> b.strength)), cast(0 as double))").alias("score"),
        F.size("found").cast("long").alias("n_found"))


def license_sql(table: list[Rule] | None = None) -> str:
    """DuckDB SQL of :func:`license_scan` over ``documents``, without the prefilters' order."""
    table = rules() if table is None else table
    quote = lambda s: "'" + s.replace("'", "''") + "'"
    values = ",\n".join(f"({r.rank}, {r.tier}, {quote(r.label)}, {quote(r.keyword)}, {quote(r.regex)}, {r.strength}::double)" for r in table)
    return rf"""
with rules(rank, tier, label, keyword, regex, strength) as (values
{values}),
low as (select row_number() over () as r, doc_id,
               translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as t from documents),
d as (select r, doc_id, len(regexp_extract_all(t, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+'))::bigint as n_words,
             ' ' || trim(regexp_replace(t, '[\x00-\x2F\x3A-\x60\x7B-\x7F]+', '  ', 'g')) || ' ' as norm from low),
hit as (select r, rank, tier, label, strength, regexp_extract_all(norm, regex, 1) as ms,
               string_split(trim(regexp_replace(norm, regex, ' ' || chr(1) || '\1 ', 'g')), '  ') as ws
        from d join rules on contains(norm, keyword) where regexp_matches(norm, regex)),
placed as (select *, list_filter(list_transform(range(len(ws)), lambda i: case when starts_with(ws[i + 1], chr(1)) then i end),
                             lambda i: i is not null) as starts from hit),
det as (select r, rank, tier, label, strength, unnest(starts) as start,
               unnest(list_transform(ms, lambda m: len(string_split(m, '  ')) - 1)) as more from placed),
det2 as (select *, start + more as stop from det),
kept as (select * from det2 d where tier < 0 or not exists (select 1 from det2 e where e.r = d.r and e.tier >= 0
         and e.start <= d.stop and d.start <= e.stop and (e.tier < d.tier or (e.tier = d.tier and e.start <= d.start and e.stop >= d.stop
         and (e.start < d.start or e.stop > d.stop or e.rank < d.rank))))),
g as (select r, count(*) filter (where tier < 0) as n_base, min(start) filter (where tier < 0) as first_word,
             max(start) filter (where tier < 0) as last_word,
             string_agg(distinct label, ',' order by label) filter (where tier < 0) as base_labels,
             string_agg(distinct label, ',' order by label) as labels, max(strength) as score,
             count(*) filter (where tier >= 0) as n_found from kept group by r)
select doc_id, n_words, coalesce(n_base, 0)::bigint as n_base, first_word::bigint as first_word, last_word::bigint as last_word,
       coalesce(base_labels, '') as base_labels, coalesce(labels, '') as labels, coalesce(score, 0)::double as score,
       coalesce(n_found, 0)::bigint as n_found
from d left join g using (r)
"""
