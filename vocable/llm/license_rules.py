"""Signature rules of the licence scan: names, versions and the forms they appear in.

Patterns are matched against lower-cased words that are separated by one space
here; :func:`rules` doubles the spaces, so that every word of the scanned text
has a space of its own on both sides and neighbouring matches never share one.
Only non-capturing groups, no look-around: the patterns mean the same in Java,
RE2 and Python.  No pattern spans more than ``LONGEST`` words.
"""

from __future__ import annotations

from typing import NamedTuple

#: Words that a match may span.
LONGEST = 48


class Rule(NamedTuple):
    rank: int        #: position in the ordered table; smaller wins a tie
    tier: int        #: priority: 0 identifier tag, 1 notice or grant, 2 name; -1 base phrase
    label: str
    keyword: str     #: literal that every match contains; the prefilter
    regex: str       #: one capturing group around the words
    strength: float


# Base phrases of the contract and their labels.
BASE = [
    ("gnu general public license", "gpl"),
    ("apache license", "apache"),
    ("cc by", "cc-by"),
    ("mit license", "mit"),
]

LIC = "licen[cs]e"


def _tail(number: str) -> str:
    """The words of a version number after its first; a zero may be absent."""
    return "".join(f"(?: {t})?" if t == "0" else f" {t}" for t in number.split(".")[1:])


def _version(number: str) -> str:
    """"version 2.0", "v 2", "v2.0" or "2" as words; a trailing zero may be absent."""
    head = number.split(".")[0]
    return f"(?:v{head}|(?:(?:version|ver|v|release|rev) )?{head}){_tail(number)}"


def _gnu(label: str, name: str, short: str, versions: list[str]) -> list[tuple[str, str, str]]:
    """Rules of one GNU licence: bare, per version, per version with or without the later ones."""
    named = f"(?:gnu )?{name} public {LIC}(?: {short})?"
    later = "(?: or)?(?: at your option)?(?: any)? (?:later|newer)(?: versions?)?"
    out = [(label, "public licen", named), (label, short, f"(?:gnu )?{short}")]
    for v in versions:
        ver = _version(v)
        forms = [("public licen", f"{named} {ver}"), (short, f"(?:gnu )?{short} {ver}"),
                 (f"{short}v", f"(?:gnu )?{short}v{v.split('.')[0]}{_tail(v)}")]
        for kw, body in forms:
            out += [(f"{label}-{v}", kw, body), (f"{label}-{v}-or-later", kw, body + later), (f"{label}-{v}-only", kw, body + " only")]
        out += [(f"{label}-{v}-or-later", "free software foundation",
                 f"{named} as published by the free software foundation either {ver} of the {LIC} or at your option any later version"),
                (f"{label}-{v}-only", "free software foundation",
                 f"{named} {ver}(?: only)? as published by the free software foundation")]
    return out


def _creative_commons() -> list[tuple[str, str, str]]:
    """Creative Commons: terms × versions, written out or abbreviated."""
    words = {"by": "attribution", "sa": "share ?alike", "nc": "non ?commercial", "nd": "no ?deriv(?:ative)?s?(?: works)?"}
    out = []
    for terms in ("by", "by sa", "by nd", "by nc", "by nc sa", "by nc nd"):
        label = "cc-" + terms.replace(" ", "-")
        long = " ".join(words[t].replace(" ?", "(?: )?") for t in terms.split())
        out.append((label, "cc  by", f"cc {terms}"))
        out.append((label, "creative  commons", f"creative commons {long}"))
        for v in ("1.0", "2.0", "2.5", "3.0", "4.0"):
            ver = _version(v)
            out.append((f"{label}-{v}", "cc  by", f"cc {terms} {ver}"))
            out.append((f"{label}-{v}", "creative  commons", f"creative commons {long}(?: (?:{v.replace('.', ' ')} )?(?:international|unported|generic))?"
                                                          f"(?: public)?(?: {LIC})? {ver}(?: (?:international|unported|generic))?"))
    out += [("cc0-1.0", "cc0", "cc0(?: 1 0)?(?: universal)?"), ("cc0-1.0", "creative  commons", "creative commons (?:cc0|zero)(?: 1 0)?(?: universal)?"),
            ("cc-pdm", "public  domain", "(?:creative commons )?public domain mark(?: 1 0)?"), ("cc", "creative  commons", f"creative commons(?: {LIC})?")]
    return out


# Licence names, versions and their words.  (label, prefilter keyword, pattern)
NAMES: list[tuple[str, str, str]] = [
    ("mit", "mit  licen", f"(?:the )?mit {LIC}"),
    ("mit-0", "no attribution", f"mit no attribution(?: {LIC})?"),
    ("mit", "expat", f"(?:the )?expat {LIC}"),
    ("x11", "x11", f"(?:the )?(?:mit )?x11 {LIC}"),
    ("isc", "isc  licen", f"(?:the )?isc {LIC}"),
    ("zlib", "zlib", f"(?:the )?zlib(?: libpng)? {LIC}"),
    ("libpng", "libpng", f"(?:the )?libpng {LIC}"),
    ("bsl-1.0", "boost", f"boost software {LIC}(?: {_version('1.0')})?"),
    ("unlicense", "unlicense", "(?:the )?unlicense"),
    ("wtfpl", "wtfpl", "(?:the )?wtfpl(?: (?:version|v) 2)?"),
    ("wtfpl", "what  the  fuck", f"do what the fuck you want to public {LIC}"),
    ("public-domain", "public  domain", "(?:released|dedicated|placed) (?:in|into|to) the public domain"),
    ("0bsd", "0bsd", f"(?:0bsd|bsd zero clause)(?: {LIC})?"),
    ("bsd-2-clause", "bsd", f"(?:simplified bsd|freebsd|bsd (?:2|two) clause|(?:2|two) clause bsd)(?: {LIC})?"),
    ("bsd-3-clause", "bsd", f"(?:(?:new|modified|revised) bsd|bsd (?:3|three) clause|(?:3|three) clause bsd)(?: {LIC})?"),
    ("bsd-4-clause", "bsd", f"(?:(?:original|old) bsd|bsd (?:4|four) clause|(?:4|four) clause bsd)(?: {LIC})?"),
    ("bsd", "bsd", f"(?:the )?bsd(?: style)? {LIC}"),
    ("apache", "apache", f"(?:the )?apache(?: software(?: foundation)?)? {LIC}"),
    ("apache-1.0", "apache", f"apache(?: software)? {LIC} {_version('1.0')}"),
    ("apache-1.1", "apache", f"apache(?: software)? {LIC} {_version('1.1')}"),
    ("apache-2.0", "apache", f"apache(?: software)?(?: {LIC})? {_version('2.0')}(?: {LIC})?"),
    ("asl-2.0", "asl", "asl 2 0"),
    ("mpl", "mozilla", f"mozilla public {LIC}(?: mpl)?"),
    ("mpl-1.0", "mozilla", f"mozilla public {LIC}(?: mpl)? {_version('1.0')}"),
    ("mpl-1.1", "mozilla", f"mozilla public {LIC}(?: mpl)? {_version('1.1')}"),
    ("mpl-2.0", "mozilla", f"mozilla public {LIC}(?: mpl)? {_version('2.0')}"),
    ("mpl-1.1", "mpl", f"mpl {_version('1.1')}"),
    ("mpl-2.0", "mpl", f"mpl {_version('2.0')}"),
    ("epl", "eclipse", f"eclipse public {LIC}(?: epl)?"),
    ("epl-1.0", "eclipse", f"eclipse public {LIC}(?: epl)? {_version('1.0')}"),
    ("epl-2.0", "eclipse", f"eclipse public {LIC}(?: epl)? {_version('2.0')}"),
    ("epl-1.0", "epl", f"epl {_version('1.0')}"),
    ("epl-2.0", "epl", f"epl {_version('2.0')}"),
    ("edl-1.0", "eclipse", f"eclipse distribution {LIC}(?: {_version('1.0')})?"),
    ("cddl", "common  development", f"common development and distribution {LIC}(?: cddl)?"),
    ("cddl-1.0", "cddl", f"cddl {_version('1.0')}"),
    ("cddl-1.1", "cddl", f"cddl {_version('1.1')}"),
    ("cpl-1.0", "common  public", f"common public {LIC}(?: {_version('1.0')})?"),
    ("cpal-1.0", "common  public", f"common public attribution {LIC}(?: {_version('1.0')})?"),
    ("ipl-1.0", "ibm", f"ibm public {LIC}(?: {_version('1.0')})?"),
    ("eupl", "eupl", "eupl"),
    ("eupl-1.1", "eupl", f"eupl {_version('1.1')}"),
    ("eupl-1.2", "eupl", f"eupl {_version('1.2')}"),
    ("eupl", "european  union", f"european union public {LIC}(?: eupl)?"),
    ("eupl-1.1", "european  union", f"european union public {LIC}(?: eupl)? {_version('1.1')}"),
    ("eupl-1.2", "european  union", f"european union public {LIC}(?: eupl)? {_version('1.2')}"),
    ("cecill", "cecill", f"cecill(?: free software)?(?: {LIC})?"),
    ("cecill-2.1", "cecill", f"cecill(?: free software)?(?: {LIC})? {_version('2.1')}"),
    ("cecill-b", "cecill", f"cecill b(?: {LIC})?"),
    ("cecill-c", "cecill", f"cecill c(?: {LIC})?"),
    ("artistic", "artistic", f"(?:the )?(?:perl )?artistic {LIC}"),
    ("artistic-1.0", "artistic", f"artistic {LIC} {_version('1.0')}"),
    ("artistic-2.0", "artistic", f"artistic {LIC} {_version('2.0')}"),
    ("perl", "perl", "(?:under )?the same terms as perl(?: itself)?"),
    ("psf-2.0", "python", f"python software foundation {LIC}(?: {_version('2.0')})?"),
    ("python-2.0", "python", f"python {LIC}(?: {_version('2.0')})?"),
    ("php-3.0", "php", f"php {LIC} {_version('3.0')}"),
    ("php-3.01", "php", f"php {LIC}(?: {_version('3.01')})?"),
    ("ruby", "ruby", f"ruby {LIC}"),
    ("openssl", "openssl", f"openssl {LIC}"),
    ("ssleay", "ssleay", f"(?:original )?ssleay {LIC}"),
    ("postgresql", "postgresql", f"postgresql {LIC}"),
    ("ncsa", "ncsa", f"(?:university of illinois )?ncsa(?: open source)? {LIC}"),
    ("afl-3.0", "academic", f"academic free {LIC}(?: {_version('3.0')})?"),
    ("ecl-2.0", "educational", f"educational community {LIC}(?: {_version('2.0')})?"),
    ("osl-3.0", "open  software", f"open software {LIC}(?: {_version('3.0')})?"),
    ("ofl-1.1", "sil  open", f"sil open font {LIC}(?: {_version('1.1')})?"),
    ("ofl-1.1", "ofl", f"ofl {_version('1.1')}"),
    ("odbl-1.0", "open  database", f"open (?:data commons open )?database {LIC}(?: odbl)?(?: {_version('1.0')})?"),
    ("odbl-1.0", "odbl", "odbl(?: 1 0)?"),
    ("odc-by-1.0", "open  data  commons", f"open data commons attribution {LIC}(?: {_version('1.0')})?"),
    ("pddl-1.0", "public  domain", f"open data commons public domain dedication(?: and {LIC})?(?: {_version('1.0')})?"),
    ("gfdl", "free  documentation", f"(?:gnu )?free documentation {LIC}(?: gfdl| fdl)?"),
    ("gfdl-1.1", "free  documentation", f"(?:gnu )?free documentation {LIC}(?: gfdl| fdl)? {_version('1.1')}"),
    ("gfdl-1.2", "free  documentation", f"(?:gnu )?free documentation {LIC}(?: gfdl| fdl)? {_version('1.2')}"),
    ("gfdl-1.3", "free  documentation", f"(?:gnu )?free documentation {LIC}(?: gfdl| fdl)? {_version('1.3')}"),
    ("ms-pl", "microsoft", f"microsoft public {LIC}(?: ms pl)?"),
    ("ms-rl", "microsoft", f"microsoft reciprocal {LIC}(?: ms rl)?"),
    ("apsl-2.0", "apple", f"apple public source {LIC}(?: {_version('2.0')})?"),
    ("npl-1.1", "netscape", f"netscape public {LIC}(?: {_version('1.1')})?"),
    ("qpl-1.0", "q  public", f"q public {LIC}(?: {_version('1.0')})?"),
    ("sspl-1.0", "server  side", f"server side public {LIC}(?: {_version('1')})?"),
    ("busl-1.1", "business  source", f"business source {LIC}(?: {_version('1.1')})?"),
    ("elastic-2.0", "elastic", f"elastic {LIC}(?: {_version('2.0')})?"),
    ("commons-clause", "commons  clause", f"commons clause(?: {LIC})?(?: condition)?"),
    ("upl-1.0", "universal  permissive", f"universal permissive {LIC}(?: {_version('1.0')})?"),
    ("vim", "vim  licen", f"vim {LIC}"),
    ("beerware", "beer", f"beer ?ware {LIC}".replace(" ?", "(?: )?")),
    ("json", "json  licen", f"json {LIC}"),
    ("ijg", "jpeg", f"independent jpeg group {LIC}"),
    ("ftl", "freetype", f"freetype(?: project)? {LIC}"),
    ("icu", "icu  licen", f"icu {LIC}"),
    ("unicode", "unicode", f"unicode(?: data files and software)? {LIC}"),
    ("w3c", "w3c", f"w3c(?: software)?(?: notice and)? {LIC}"),
    ("openrail", "openrail", f"(?:creativeml |bigscience )?openrail(?: m)?(?: {LIC})?"),
    ("llama", "llama", f"llama (?:2 |3 )?community {LIC}"),
    ("all-rights-reserved", "all  rights", "all rights reserved"),
    ("proprietary", "proprietary", "proprietary and confidential"),
    *_gnu("gpl", "general", "gpl", ["1.0", "2.0", "3.0"]),
    *_gnu("lgpl", "(?:lesser|library)(?: general)?", "lgpl", ["2.0", "2.1", "3.0"]),
    *_gnu("agpl", "affero(?: general)?", "agpl", ["3.0"]),
    *_creative_commons(),
]

#: Distinctive sentences of licence texts.  (label, prefilter keyword, pattern)
SENTENCES: list[tuple[str, str, str]] = [
    ("mit", "free  of  charge", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files"),
    ("isc", "for  any  purpose", "permission to use copy modify and (?:or )?distribute this software for any purpose with or without fee is hereby granted"),
    ("bsd", "source  and  binary", "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met"),
    ("bsd-3-clause", "endorse  or  promote", "may be used to endorse or promote products derived from this software without specific prior written permission"),
    ("bsd-4-clause", "advertising  materials", "all advertising materials mentioning features or use of this software must display the following acknowledge?ment"),
    ("apache-2.0", "except  in  compliance", "you may not use this file except in compliance with the license"),
    ("mpl-2.0", "source  code  form", "this source code form is subject to the terms of the mozilla public license v 2 0"),
    ("unlicense", "unencumbered", "this is free and unencumbered software released into the public domain"),
    ("zlib", "provided  as  is", "this software is provided as is without any express or implied warranty in no event will the authors be held liable"),
    ("bsl-1.0", "machine  executable", "unless such copies or derivative works are solely in the form of machine executable object code generated by a source language processor"),
    ("wtfpl", "you  just  do", "you just do what the fuck you want to"),
    ("ofl-1.1", "reserved  font", "with reserved font name"),
    ("no-warranty", "fitness  for", "without even the implied warranty of merchantability or fitness for a particular purpose"),
    ("mit", "the  software  is  provided", "the software is provided as is without warranty of any kind express or implied"),
]

# Words of which every match of every rule holds at least one.
SIGNALS = [
    "license", "licence", "gpl", "gplv1", "gplv2", "gplv3", "lgpl", "lgplv2", "lgplv3", "agpl", "agplv3", "cc", "cc0",
    "creative", "commons", "apache", "asl", "mpl", "epl", "cddl", "eupl", "cecill", "ofl", "odbl", "wtfpl", "unlicense",
    "0bsd", "bsd", "freebsd", "attribution", "domain", "reserved", "proprietary", "perl", "openrail", "granted",
    "redistribution", "endorse", "advertising", "unencumbered", "liable", "executable", "fuck", "merchantability", "warranty",
]

#: Words that make a name a grant.
GRANT = ("(?:(?:re)?licen[cs]ed|released|distributed|published|available|provided|covered|governed|offered|shared|redistributed?) "
         "(?:to you )?(?:under|by|through) (?:the )?(?:terms (?:and conditions )?of )?(?:version [0-9]+ of )?(?:the |a )?")
STRENGTH = {-1: 0.6, 0: 1.0, 1: 0.95, 2: 0.8}


def rules() -> list[Rule]:
    """The ordered table: base phrases, identifier tags, sentences and grants, names."""
    raw = [(-1, label, phrase, phrase) for phrase, label in BASE]
    tags = sorted({label for label, _, _ in NAMES})
    raw += [(0, label, "spdx", f"spdx licen[cs]e identifier {_tag_words(label)}") for label in tags]
    raw += [(1, label, kw, body) for label, kw, body in SENTENCES]
    # longer, more specific names first: a version before its family
    for tier, prefix in ((1, GRANT), (2, "")):
        raw += [(tier, label, kw, prefix + body) for label, kw, body in NAMES]
    return [Rule(i, tier, label, kw.replace("  ", " ").replace(" ", "  "), " (" + body.replace(" ", "  ") + ") ", STRENGTH[tier])
            for i, (tier, label, kw, body) in enumerate(raw)]


def _tag_words(label: str) -> str:
    """The words of an identifier: "gpl-2.0-only" reads "gpl 2 0 only"."""
    return label.replace("-", " ").replace(".", " ")
