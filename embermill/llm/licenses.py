"""Licence detection by ordered signature rules.

A rule is a regex with the words that any match holds, a label, a priority and a
confidence.  A rule is searched for only in texts that hold all its words, and a
text is looked at only if it holds one of a few words that, between them, every
rule needs; neither gate can lose a match.  Detections are ordered by priority; one whose interval lies
within that of a detection of higher priority (or of a longer one of the same)
is suppressed.  The base phrases are places of whole words and always stay.

The rule table is written out from families of licences and the forms in which
each is named: titles, short names, SPDX lines, grant sentences and addresses.

Everything runs as SQL expressions.  Nulls: a null text is empty; null doc_ids
and repeated rows are handled like any row.  An empty table gives no rows; extra
columns are ignored.
"""

from __future__ import annotations

import functools
import re
from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .native import lower_ascii, positions

# The base phrases and their labels.
BASE_PHRASES = (("mit license", "mit"), ("apache license", "apache"), ("general public license", "gpl"))

#: A word's characters, as a class body, in a text of either case.
_W = r"\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F"
WORD = rf"[^{_W}]+"
_GAP = rf"[{_W}]++"
_FROM, _TO = rf"(?<![^{_W}])", rf"(?![^{_W}])"


class Rule(NamedTuple):
    label: str
    keyword: str
    regex: str
    priority: int
    confidence: float
    #: What any match holds as it stands, the keyword among it.
    needs: tuple[str, ...]


# name: (label stem, title regexes, versions, short names)
_VERSIONED = {
    "gpl": ("gpl", ["general public license", "gnu gpl"], ["1", "2", "3"], ["gpl"]),
    "lgpl": ("lgpl", ["lesser general public license", "library general public license", "gnu lgpl"], ["2", "2.1", "3"], ["lgpl"]),
    "agpl": ("agpl", ["affero general public license", "gnu agpl"], ["1", "3"], ["agpl"]),
    "gfdl": ("gfdl", ["free documentation license"], ["1.1", "1.2", "1.3"], ["gfdl", "fdl"]),
    "apache": ("apache", ["apache license", "apache software license"], ["1.0", "1.1", "2.0"], ["apache"]),
    "mpl": ("mpl", ["mozilla public license"], ["1.0", "1.1", "2.0"], ["mpl"]),
    "epl": ("epl", ["eclipse public license"], ["1.0", "2.0"], ["epl"]),
    "eupl": ("eupl", ["european union public licence", "european union public license"], ["1.0", "1.1", "1.2"], ["eupl"]),
    "cddl": ("cddl", ["common development and distribution license"], ["1.0", "1.1"], ["cddl"]),
    "cpl": ("cpl", ["common public license"], ["0.5", "1.0"], ["cpl"]),
    "osl": ("osl", ["open software license"], ["1.0", "2.0", "2.1", "3.0"], ["osl"]),
    "afl": ("afl", ["academic free license"], ["1.1", "1.2", "2.0", "2.1", "3.0"], ["afl"]),
    "artistic": ("artistic", ["artistic license"], ["1.0", "2.0"], ["artistic"]),
    "bsl": ("bsl", ["boost software license"], ["1.0"], ["bsl"]),
    "php": ("php", ["php license"], ["3.0", "3.01"], []),
    "python": ("python", ["python software foundation license", "python license"], ["2"], ["psf"]),
    "zpl": ("zpl", ["zope public license"], ["1.1", "2.0", "2.1"], ["zpl"]),
    "ofl": ("ofl", ["open font license"], ["1.0", "1.1"], ["ofl"]),
    "ms-pl": ("ms-pl", ["microsoft public license"], [], ["ms-pl"]),
    "ms-rl": ("ms-rl", ["microsoft reciprocal license"], [], ["ms-rl"]),
    "odbl": ("odbl", ["open database license"], ["1.0"], ["odbl"]),
    "lppl": ("lppl", ["latex project public license"], ["1.0", "1.2", "1.3"], ["lppl"]),
    "ipl": ("ipl", ["ibm public license"], ["1.0"], []),
    "npl": ("npl", ["netscape public license"], ["1.0", "1.1"], []),
    "qpl": ("qpl", ["q public license"], ["1.0"], ["qpl"]),
    "cecill": ("cecill", ["cecill license", "cecill"], ["1.0", "2.0", "2.1"], []),
}

_PLAIN = {
    "mit": ["mit license", "mit/x11 license", "expat license", "license mit", "licensed under mit", "under the mit license"],
    "isc": ["isc license", "license isc"],
    "zlib": ["zlib license", "zlib/libpng license"],
    "unlicense": ["the unlicense", "unlicense.org"],
    "wtfpl": ["wtfpl", "do what the fuck you want to public license"],
    "beerware": ["beer-ware license", "beerware license"],
    "0bsd": ["zero-clause bsd", "bsd zero clause", "0bsd license"],
    "bsd-2-clause": ["bsd 2-clause", "2-clause bsd", "simplified bsd", "freebsd license"],
    "bsd-3-clause": ["bsd 3-clause", "3-clause bsd", "new bsd license", "modified bsd", "revised bsd"],
    "bsd-4-clause": ["bsd 4-clause", "4-clause bsd", "original bsd"],
    "bsd": ["bsd license", "bsd-style license", "bsd licence"],
    "public-domain": ["public domain", "dedicated to the public domain", "released into the public domain"],
    "cc0": ["cc0 1.0", "cc0", "creative commons zero"],
    "curl": ["curl license"],
    "openssl": ["openssl license"],
    "ssleay": ["ssleay license"],
    "x11": ["x11 license"],
    "ncsa": ["university of illinois/ncsa", "ncsa open source license"],
    "postgresql": ["postgresql license"],
    "sleepycat": ["sleepycat license"],
    "ruby": ["ruby license"],
    "vim": ["vim license"],
    "json": ["json license"],
    "unicode": ["unicode license", "unicode terms of use"],
    "w3c": ["w3c software notice", "w3c license"],
    "proprietary": ["all rights reserved", "proprietary and confidential", "unauthorized copying"],
    "sspl": ["server side public license"],
    "busl": ["business source license"],
    "elastic": ["elastic license"],
    "commons-clause": ["commons clause"],
    "polyform": ["polyform noncommercial license", "polyform small business license", "polyform shield license"],
    "openrail": ["openrail-m", "responsible ai license"],
    "llama": ["llama community license", "llama 2 community license", "llama 3 community license"],
}

# label: (keyword, one word that the sentence must hold; sentence that grants or disclaims under that licence)
_SENTENCES = {
    "mit": [
        ("permission", r"permission is hereby granted, free of charge, to any person obtaining a copy"),
        ("substantial", r"shall be included in all copies or substantial portions"),
        ("restriction", r"deal in the software without restriction"),
    ],
    "isc": [("distribute", r"permission to use, copy, modify, and(?:/or)? distribute this software for any purpose with or without fee")],
    "bsd": [
        ("redistribution", r"redistribution and use in source and binary forms, with or without modification"),
        ("redistributions", r"redistributions of source code must retain the above copyright notice"),
        ("redistributions", r"redistributions in binary form must reproduce the above copyright notice"),
    ],
    "bsd-3-clause": [("endorse", r"may be used to endorse or promote products derived from this software")],
    "bsd-4-clause": [("advertising", r"all advertising materials mentioning features or use of this software")],
    "gpl": [
        ("foundation", r"under the terms of the gnu general public license as published by the free software foundation"),
        ("redistribute", r"is free software[:;] you can redistribute it and/or modify"),
        ("received", r"you should have received a copy of the gnu general public license"),
    ],
    "lgpl": [("lesser", r"under the terms of the gnu lesser general public license")],
    "agpl": [("affero", r"under the terms of the gnu affero general public license")],
    "apache-2.0": [
        ("www.apache.org", r"https?://www\.apache\.org/licenses/license-2\.0"),
        ("compliance", r"you may not use this file except in compliance with the license"),
        ("limitations", r"see the license for the specific language governing permissions and limitations under the license"),
    ],
    "mpl-2.0": [("mozilla.org/mpl", r"mozilla\.org/mpl/2\.0"), ("mozilla", r"this source code form is subject to the terms of the mozilla public license")],
    "zlib": [("altered", r"altered source versions must be plainly marked as such")],
    "unlicense": [("unencumbered", r"this is free and unencumbered software released into the public domain")],
    "bsl-1.0": [("boost.org/license", r"boost\.org/license_1_0\.txt")],
    "warranty-disclaimer": [
        ("provided", r"(?:is|are) provided [\"'`]*as is[\"'`]*,? without warranty"),
        ("warranty", r"without any warranty[,;] without even the implied warranty"),
        ("liable", r"in no event shall the (?:authors|copyright)[^.]{0,60} be liable"),
        ("merchantability", r"warrant(?:y|ies) of merchantability"),
    ],
    "copyright-notice": [
        ("copyright", r"copyright (?:\(c\)|©)?[ ]?(?:19|20)[0-9]{2}"),
        ("(c)", r"\(c\) (?:copyright )?(?:19|20)[0-9]{2}"),
    ],
}


def _spaced(phrase: str) -> str:
    return r"[\s]{1,8}".join(re.escape(w) for w in phrase.split(" "))


def _words(phrase: str) -> tuple[str, ...]:
    """The phrase's words, longest first."""
    return tuple(sorted(phrase.split(" "), key=len, reverse=True))


@functools.cache
def rules() -> tuple[Rule, ...]:
    """All rules, highest priority first."""
    out: list[Rule] = []
    edge, end = r"(?<![a-z0-9])", r"(?![a-z0-9])"

    def add(label: str, needs: tuple[str, ...], regex: str, priority: int, confidence: float) -> None:
        out.append(Rule(label, needs[0], regex, priority, confidence, needs))

    for stem, titles, versions, shorts in _VERSIONED.values():
        for v in versions:
            label, number = f"{stem}-{v}", re.escape(v.removesuffix(".0")) + (r"(?:\.0)?" if v.endswith(".0") or "." not in v else "")
            later = rf"{number}(?![0-9]|\.[0-9])"
            for t in titles:
                add(label, _words(t), rf"{edge}{_spaced(t)}[\s,(]{{1,4}}(?:version|ver\.?|v\.?)?[\s]{{0,3}}{later}", 80, 0.95)
            for s in shorts:
                add(label, (s,), rf"{edge}{re.escape(s)}[ -]?(?:version |v\.? ?)?{later}", 60, 0.8)
            add(label, ("spdx-license-identifier:",), rf"spdx-license-identifier:[ \t]{{0,8}}{re.escape(stem)}-{number}(?:-only|-or-later|\+)?{end}", 100, 1.0)
        for t in titles:
            add(stem, _words(t), rf"{edge}{_spaced(t)}{end}", 40, 0.7)
    for kind in ("by", "by-sa", "by-nd", "by-nc", "by-nc-sa", "by-nc-nd"):
        names = kind.replace("by", "attribution").replace("nc", "noncommercial").replace("nd", "noderivs").replace("sa", "sharealike")
        for v in ("1.0", "2.0", "2.5", "3.0", "4.0"):
            label, number = f"cc-{kind}-{v}", re.escape(v)
            add(label, ("cc",), rf"{edge}cc[ -]{kind}[ -]{number}(?![0-9])", 85, 0.95)
            add(label, ("creativecommons.org",), rf"creativecommons\.org/licenses/{kind}/{number}", 95, 1.0)
            add(label, ("attribution", "creative", "commons"), rf"creative commons {names.replace('-', '[- ]')}[ ]{number}", 85, 0.95)
        add(f"cc-{kind}", ("cc",), rf"{edge}cc[ -]{kind}(?![a-z-])", 45, 0.8)
    for label, phrases in _PLAIN.items():
        for p in phrases:
            add(label, _words(p), rf"{edge}{_spaced(p)}{end}", 50, 0.6 if label in ("public-domain", "proprietary") else 0.85)
        if re.fullmatch(r"[a-z0-9-]+", label):
            add(label, ("spdx-license-identifier:",), rf"spdx-license-identifier:[ \t]{{0,8}}{re.escape(label)}{end}", 100, 1.0)
    for label, sentences in _SENTENCES.items():
        for keyword, sentence in sentences:
            add(label, (keyword,), sentence.replace(" ", r"[\s*#/]{1,8}"), 30 if label.startswith(("warr", "copy")) else 90, 0.3 if label.startswith(("warr", "copy")) else 0.9)
    return tuple(sorted(out, key=lambda r: (-r.priority, r.label, r.regex)))


def gate_words() -> tuple[str, ...]:
    """A few words of which every text that any rule matches holds one."""
    left, out = list(rules()), []
    words = sorted({r.keyword for r in left})
    covers = lambda w, r: any(w in n for n in r.needs)
    while left:
        out.append(max(words, key=lambda w: (sum(covers(w, r) for r in left), len(w))))
        left = [r for r in left if not covers(out[-1], r)]
    return tuple(out)


def _table() -> Column:
    """The rules by keyword as one constant array; rank is a rule's place in the order."""
    q = lambda s: "'" + s.replace("\\", "\\\\").replace("'", "\\'") + "'"
    by_keyword: dict[str, list[str]] = {}
    for i, r in enumerate(rules()):
        by_keyword.setdefault(r.keyword, []).append(
            f"named_struct('rank',{i},'label',{q(r.label)},'needs',array({','.join(map(q, r.needs))}),'regex',{q(r.regex)},'priority',{r.priority},'confidence',{r.confidence}D)"
        )
    groups = ",".join(f"named_struct('keyword',{q(k)},'rules',array({','.join(v)}))" for k, v in by_keyword.items())
    return F.expr(f"array({groups})")


def detect(docs: DataFrame, gated: bool = True) -> DataFrame:
    """``docs`` with lic_hits: array<struct<label,priority,confidence,start,end>> after suppression.

    Without ``gated`` every rule is searched for in every text, with the same result.
    """
    low = lower_ascii(F.coalesce("text", F.lit("")))
    rows = docs.withColumn("lic_low", low)
    holds_word = lambda w: F.contains("lic_low", w)
    groups, gate = _table(), F.lit(True)
    if gated:
        gate = functools.reduce(lambda a, b: a | b, [holds_word(F.lit(w)) for w in gate_words()])
        groups = F.filter(groups, lambda g: holds_word(g["keyword"]))
    apt = F.flatten(F.transform(groups, lambda g: g["rules"]))
    if gated:
        apt = F.filter(apt, lambda r: F.forall(r["needs"], holds_word))
    apt = F.array_sort(apt)

    def found(r: Column) -> Column:
        return F.transform(
            positions(F.col("lic_low"), r["regex"]),
            lambda s: F.struct(
                r["label"].alias("label"), r["priority"].alias("priority"), r["confidence"].alias("confidence"),
                s["start"].alias("start"), s["end"].alias("end"),
            ),
        )

    empty = F.array().cast("array<struct<label:string,priority:int,confidence:double,start:int,end:int>>")
    rows = rows.withColumn("lic_all", F.when(gate, F.flatten(F.transform(apt, found))).otherwise(empty))

    def beats(d: Column, c: Column) -> Column:
        holds = (d["start"] <= c["start"]) & (d["end"] >= c["end"])
        longer = (d["end"] - d["start"]) > (c["end"] - c["start"])
        first = (d["end"] - d["start"] == c["end"] - c["start"]) & (d["label"] < c["label"])
        return holds & ((d["priority"] > c["priority"]) | (d["priority"] == c["priority"]) & (longer | first))

    kept = F.filter("lic_all", lambda c: ~F.exists(F.col("lic_all"), lambda d: beats(d, c)))
    return rows.withColumn("lic_hits", kept).drop("lic_all", "lic_low")


def base_places(text: Column) -> tuple[Column, Column, Column, Column, Column]:
    """(words, places, first, last, labels) of the base phrases; places never overlap."""
    phrases = [_FROM + _GAP.join(p.split(" ")) + _TO for p, _ in BASE_PHRASES]
    regex = "(?i)" + "|".join(f"(?:{p})" for p in phrases)
    words = lambda c: F.regexp_count(c, F.lit(WORD)).cast("long")
    gate = F.contains("lic_base_low", F.lit("license"))
    gaps = F.when(gate, F.split(text, regex, -1)).otherwise(F.array(F.lit("")))
    hits = F.when(gate, F.regexp_extract_all(text, F.lit(regex), F.lit(0))).otherwise(F.array().cast("array<string>"))
    n = F.size(hits)
    # A match begins and ends at a word's edge, so words add up over gaps and matches.
    ahead = F.aggregate(F.slice(gaps, 1, n), F.lit(0).cast("long"), lambda a, g: a + words(g))
    within = F.aggregate(
        F.slice(hits, 1, F.greatest(n - 1, F.lit(0))), F.lit(0).cast("long"), lambda a, h: a + words(h)
    )
    first = F.when(n > 0, words(F.get(gaps, 0)))
    last = F.when(n > 0, ahead + within)
    labels = F.array_compact(
        F.array(*[F.when(F.exists(hits, _starts(p)), F.lit(label)) for p, label in BASE_PHRASES])
    )
    return words(text), n.cast("long"), first, last, labels


def _starts(phrase: str):
    word = phrase.split(" ")[0]

    def test(h: Column) -> Column:
        return h.rlike("(?i)^" + word)

    return test


def license_digest(docs: DataFrame) -> DataFrame:
    rows = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    rows = detect(rows).withColumn("lic_base_low", lower_ascii(F.col("text")))
    n_words, n_base, first, last, labels = base_places(F.col("text"))
    named = F.array_sort(F.array_distinct(labels))
    every = F.array_sort(F.array_distinct(F.concat(labels, F.transform("lic_hits", lambda h: h["label"]))))
    best = F.coalesce(F.array_max(F.transform("lic_hits", lambda h: h["confidence"])), F.lit(0.0))
    return rows.select(
        "doc_id",
        n_words.alias("n_words"),
        n_base.alias("n_base"),
        first.alias("first_word"),
        last.alias("last_word"),
        F.array_join(named, ",").alias("base_labels"),
        F.array_join(every, ",").alias("labels"),
        F.greatest(best, F.when(n_base > 0, F.lit(0.7)).otherwise(F.lit(0.0))).alias("score"),
    )
