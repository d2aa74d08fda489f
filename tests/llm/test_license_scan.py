import re

import pytest
from brute import odd_docs, odd_rows

from vocable.llm import license_scan as scan
from vocable.llm.license_rules import BASE, LONGEST, NAMES, SENTENCES, SIGNALS, rules

WORDS = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
TEXTS = [
    "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License.",
    "SPDX-License-Identifier: GPL-2.0-or-later\nGNU GENERAL PUBLIC LICENSE version 2",
    "This work is licensed under the GNU Lesser General Public License as published by the Free Software Foundation; "
    "either version 2.1 of the License, or (at your option) any later version.",
    "Released under CC BY-NC-SA 4.0, code under the MIT License and the ISC licence",
    "mit license mit license apache license cc by cc by cc by", "mit licenses; emit license; mitlicense; mIT LICENSe",
    "gnu general public lİcense; GNU General Public License", "Creative Commons Attribution-ShareAlike 3.0 Unported License",
    "BSD 3-Clause and BSD license; Mozilla Public License 2.0, MPL 1.1, EPL-2.0", "dedicated to the public domain, all rights reserved",
    "dedicated to the Public Kdomain, rubYlicense Ruby License the verK", "GPLv3+ gplv2 only LGPL v2.1 or later (AGPL-3.0)",
    "licence " * 40, ("mit license " * 600), "x", "the gnu gpl", "mit mit license", "cc by nc by cc by sa 4 0",
    "mit the vim license " * 90 + "apache license 2 0 " * 90,
]


def brute(text):
    """All rules on the whole text, all pairs of detections."""
    words = WORDS.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))
    spaced = "".join(f" {w} " for w in words)
    base, det = [], []
    for r in rules():
        for m in re.finditer(r.regex, spaced):
            start = spaced[:m.start()].count("  ") + (m.start() > 0)
            stop = start + m[1].count("  ")
            (base if r.tier < 0 else det).append((start, stop, r.rank, r.tier, r.label, r.strength))

    def beaten(d):
        return any(e[0] <= d[1] and d[0] <= e[1] and (e[3] < d[3] or e[3] == d[3] and e[0] <= d[0] and e[1] >= d[1]
                   and (e[0] < d[0] or e[1] > d[1] or e[2] < d[2])) for e in det)

    kept = [d for d in det if not beaten(d)]
    both = base + kept
    return (len(words), len(base), min((b[0] for b in base), default=None), max((b[0] for b in base), default=None),
            ",".join(sorted({b[4] for b in base})), ",".join(sorted({b[4] for b in both})),
            max((b[5] for b in both), default=0.0), len(kept))


COLUMNS = ("n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score", "n_found")


def test_rule_table_is_sound():
    table = rules()
    assert len(table) > 300 and len({r.rank for r in table}) == len(table)
    assert all(re.compile(r.regex).groups == 1 for r in table)
    assert not any(x in r.regex for r in table for x in ("(?=", "(?!", "(?<", ".*", ".+"))


def test_every_name_is_found_and_passes_both_prefilters():
    """One text for each name and sentence, made from its pattern by taking the first choice everywhere."""
    for r in rules():
        text = r.regex[2:-2]
        while True:                                  # optional groups, then the first alternative, innermost first
            new = re.sub(r"\(\?:([^()]*)\)\?", "", text)
            new = re.sub(r"\(\?:([^()|]*)(?:\|[^()]*)?\)", r"\1", new) if new == text else new
            if new == text:
                break
            text = new
        text = re.sub(r"\[([^\]])[^\]]*\]\+?", r"\1", text)
        text = re.sub(r".\?", "", text)
        spaced = f" {text.split('|')[0].strip()} "
        found = re.search(r.regex, spaced)
        assert found, (r.label, spaced)
        assert r.keyword in found[0] and set(SIGNALS) & set(spaced.split()), (r.label, spaced)
        assert len(spaced.split()) <= LONGEST


def test_license_scan_against_all_rules(spark):
    rows = [(i, t, "en", "s", len(t)) for i, t in enumerate(TEXTS)] + [(k and k + 1000, *r) for k, *r in odd_rows()]
    got = scan.license_scan(odd_docs(spark, rows)).collect()
    want = sorted(((k, *brute(t)) for k, t, *_ in rows), key=repr)
    assert sorted(((r.doc_id, *(r[c] for c in COLUMNS)) for r in got), key=repr) == want


def test_license_spans_and_base_phrases(spark):
    rows = [(1, "Under the MIT license. SPDX-License-Identifier: MIT", "en", "s", 1), (2, None, None, None, None)]
    got = [tuple(r) for r in scan.license_spans(odd_docs(spark, rows)).orderBy("start").collect()]
    assert got == [(1, 1, 3, "mit", 2, 0.8), (1, 4, 7, "mit", 0, 1.0)]
    assert [p for p, _ in BASE] == ["gnu general public license", "apache license", "cc by", "mit license"]
    assert NAMES and SENTENCES


def test_license_scan_empty_table(spark):
    assert scan.license_scan(odd_docs(spark, [])).collect() == []


def test_rules_without_keyword_are_refused(spark):
    with pytest.raises(ValueError):
        scan.detections(odd_docs(spark), table=[rules()[0]._replace(keyword="")])
