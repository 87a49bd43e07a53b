"""License scans: ordered signature rules with keyword gates, priorities and containment.

DataFrame functions only; every row is scanned on its own, without a shuffle.

Texts become words (runs of digits, letters and non-ASCII characters, A-Z in lower
case) with one space between. Three base phrases are counted at all their places.
On top, some hundred signature rules, each a regular expression over words, run on
texts that hold the keyword of a rule at all, and there each only where one of its
own keywords stands. Rules are of two kinds: phrases of license texts and notices,
one written for each (TEXTS), and names of license families with their versions,
each in two wordings (FAMILIES, COMMONS and the general public licenses).

A detection is dropped if it lies within one of a higher priority, or within a
longer one of the same priority. The score is the largest confidence of what is
left (base phrases: 0.5), 0 without any. Work is linear in a text, but for the
comparison of its detections with each other.

Nulls: a null text counts as empty: no words, no labels (an empty string), no
first or last word, score 0. Repeated rows are scanned each for itself. Other
columns go through as they are; those named like a result give way to it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lectern.llm.common import table

#: Fixed values of the contract: phrase, label.
BASE = (("cc by", "cc-by"), ("general public license", "gpl"), ("all rights reserved", "reserved"))
_UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
_NOT_WORD = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"

#: License families: label, names as regular expressions over words, versions, keywords (every match holds one as whole words; with * it is the beginning of a word).
FAMILIES = (
    ("apache", ("apache license", "apache software license", "asl"), ("1 0", "1 1", "2 0"), "apache|asl"),
    ("mpl", ("mozilla public license", "mpl"), ("1 0", "1 1", "2 0"), "mpl|mozilla"),
    ("epl", ("eclipse public license", "epl"), ("1 0", "2 0"), "epl|eclipse"),
    ("cddl", ("common development and distribution license", "cddl"), ("1 0", "1 1"), "cddl|common development"),
    ("eupl", ("european union public license", "european union public licence", "eupl"), ("1 0", "1 1", "1 2"), "eupl|european union"),
    ("osl", ("open software license", "osl"), ("1 0", "1 1", "2 0", "2 1", "3 0"), "osl|open software"),
    ("afl", ("academic free license", "afl"), ("1 1", "1 2", "2 0", "2 1", "3 0"), "afl|academic free"),
    ("artistic", ("artistic license",), ("1 0", "2 0"), "artistic"),
    ("bsl", ("boost software license", "bsl"), ("1 0",), "bsl|boost"),
    ("ofl", ("sil open font license", "open font license", "ofl"), ("1 0", "1 1"), "ofl|open font"),
    ("psf", ("python software foundation license", "python license", "psf license"), ("1 6", "2 0"), "python|psf"),
    ("php", ("php license",), ("3 0", "3 01"), "php license"),
    ("zpl", ("zope public license", "zpl"), ("1 1", "2 0", "2 1"), "zpl|zope"),
    ("apsl", ("apple public source license", "apsl"), ("1 0", "1 1", "1 2", "2 0"), "apsl|apple"),
    ("cecill", ("cecill", "cecill free software license"), ("1 0", "1 1", "2 0", "2 1"), "cecill"),
    ("ms-pl", ("microsoft public license", "ms pl"), (), "microsoft|ms pl"),
    ("ms-rl", ("microsoft reciprocal license", "ms rl"), (), "microsoft|ms rl"),
    ("mit", ("mit license", "expat license"), (), "mit license|expat license"),
    ("isc", ("isc license",), (), "isc license"),
    ("zlib", ("zlib license", "zlib libpng license"), (), "zlib license|zlib libpng"),
    ("unlicense", ("the unlicense", "unlicense org"), (), "unlicense"),
    ("wtfpl", ("wtfpl", "do what the fuck you want to public license"), ("2",), "wtfpl|do what the"),
    ("x11", ("x11 license",), (), "x11 license"),
    ("ncsa", ("ncsa open source license", "university of illinois ncsa"), (), "ncsa"),
    ("openssl", ("openssl license",), (), "openssl"),
    ("postgresql", ("postgresql license",), (), "postgresql"),
    ("odbl", ("open database license", "odbl"), ("1 0",), "odbl|open database"),
    ("odc-by", ("open data commons attribution license", "odc by"), ("1 0",), "odc|open data commons"),
    ("gfdl", ("gnu free documentation license", "gfdl"), ("1 1", "1 2", "1 3"), "gfdl|free documentation"),
)
#: The kinds of Creative Commons licenses: label, short form, long form.
COMMONS = (
    ("cc-by", "cc by", "attribution"),
    ("cc-by-sa", "cc by sa", "attribution share ?alike"),
    ("cc-by-nd", "cc by nd", "attribution no ?deriv(?:s|atives)"),
    ("cc-by-nc", "cc by nc", "attribution non ?commercial"),
    ("cc-by-nc-sa", "cc by nc sa", "attribution non ?commercial share ?alike"),
    ("cc-by-nc-nd", "cc by nc nd", "attribution non ?commercial no ?deriv(?:s|atives)"),
)
#: Phrases of license texts and notices: label, pattern, keyword, priority, confidence.
TEXTS = (
    ("mit", "permission is hereby granted free of charge to any person obtaining a copy", "permission is hereby", 60, 0.95),
    ("isc", "permission to use copy modify and or distribute this software for any purpose", "permission to use", 60, 0.95),
    ("bsd", "redistribution and use in source and binary forms with or without modification", "redistribution and use", 50, 0.9),
    ("bsd-2-clause", "bsd 2 clause(?: license)?|simplified bsd license|freebsd license", "bsd|simplified|freebsd", 60, 0.9),
    ("bsd-3-clause", "bsd 3 clause(?: license)?|(?:new|revised|modified) bsd license", "bsd|new bsd|revised bsd|modified bsd", 60, 0.9),
    ("bsd-4-clause", "bsd 4 clause(?: license)?|original bsd license", "bsd|original bsd", 60, 0.9),
    ("bsd", "bsd license|bsd style license", "bsd", 40, 0.8),
    ("cc0-1.0", "cc0(?: 1 0)?|creative commons zero", "cc0|creative commons", 60, 0.9),
    ("public-domain", "(?:released|placed|dedicated) (?:in|into|to) the public domain|public domain dedication", "released|placed|dedicated|public domain", 50, 0.85),
    ("public-domain", "public domain", "public domain", 20, 0.5),
    ("reserved", "all rights (?:are )?reserved", "all rights", 30, 0.7),
    ("proprietary", "proprietary and confidential|confidential and proprietary", "proprietary|confidential", 40, 0.8),
    ("proprietary", "no part of this (?:publication|work|book|document) may be reproduced", "no part of", 50, 0.85),
    ("proprietary", "unauthori[sz]ed (?:copying|reproduction|use|distribution)", "unauthori*", 30, 0.7),
    ("copyright", "copyright (?:c )?(?:19|20)[0-9][0-9]", "copyright", 20, 0.6),
    ("copyright", "copyright by", "copyright", 15, 0.5),
    ("no-warranty", "without warrant(?:y|ies) of any kind|as is without warranty", "without warranty|without warranties|as is", 20, 0.4),
    ("no-warranty", "warranties of merchantability and fitness for a particular purpose", "warranties", 20, 0.4),
    ("terms", "terms of (?:use|service)(?: apply)?", "terms of", 10, 0.3),
    ("licensed", "licen[sc]ed under(?: the)?(?: terms of)?", "licensed|licenced", 5, 0.3),
    ("apache-2.0", "you may not use this file except in compliance with the license", "in compliance", 55, 0.9),
    ("apache-2.0", "unless required by applicable law or agreed to in writing software distributed under the license", "unless required", 55, 0.9),
    ("apache-2.0", "apache org licenses license 2 0", "licenses license", 60, 0.95),
    ("mpl-2.0", "this source code form is subject to the terms of the mozilla public license v 2 0", "source code form", 65, 0.95),
    ("mpl-1.1", "the contents of this file are subject to the mozilla public license version 1 1", "contents of this file", 65, 0.95),
    ("epl-1.0", "made available under the terms of the eclipse public license v1 0", "made available", 65, 0.95),
    ("epl-2.0", "made available under the terms of the eclipse public license 2 0", "made available", 65, 0.95),
    ("gpl", "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license", "this program is", 65, 0.95),
    ("gpl", "you should have received a copy of the gnu general public license", "should have received", 65, 0.9),
    ("gpl", "everyone is permitted to copy and distribute verbatim copies of this license document", "everyone is permitted", 55, 0.85),
    ("lgpl", "this library is free software you can redistribute it and or modify it under the terms of the gnu (?:lesser|library) general public license", "this library is", 65, 0.95),
    ("lgpl", "you should have received a copy of the gnu (?:lesser|library) general public license", "should have received", 65, 0.9),
    ("agpl", "you should have received a copy of the gnu affero general public license", "should have received", 65, 0.9),
    ("gpl-exception", "as a special exception(?: to the gpl)?", "special exception", 30, 0.6),
    ("gfdl", "permission is granted to copy distribute and or modify this document under the terms of the gnu free documentation license", "permission is granted", 65, 0.95),
    ("0bsd", "zero clause bsd(?: license)?|bsd zero clause license|0bsd", "zero clause|bsd zero|0bsd", 60, 0.9),
    ("hpnd", "permission to use copy modify and distribute this software and its documentation for any purpose", "permission to use", 55, 0.85),
    ("bsd-3-clause", "neither the name of (?:[^ ]+ ){1,12}nor the names of its contributors may be used to endorse", "neither the name", 60, 0.9),
    ("bsd-4-clause", "all advertising materials mentioning features or use of this software must display", "advertising materials", 65, 0.95),
    ("zlib", "in no event will the authors be held liable for any damages arising from the use of this software", "in no event", 60, 0.9),
    ("zlib", "altered source versions must be plainly marked as such", "altered source", 60, 0.9),
    ("bsl-1.0", "permission is hereby granted free of charge to any person or organization obtaining a copy of the software and accompanying documentation", "permission is hereby", 65, 0.95),
    ("unlicense", "this is free and unencumbered software released into the public domain", "free and unencumbered", 65, 0.95),
    ("wtfpl", "everyone is permitted to copy and distribute verbatim or modified copies", "everyone is permitted", 50, 0.8),
    ("cc0-1.0", "has waived all copyright and related or neighboring rights", "has waived", 60, 0.95),
    ("cc-by", "creativecommons org licenses by", "creativecommons org", 50, 0.9),
    ("cc-by-sa", "creativecommons org licenses by sa", "creativecommons org", 55, 0.9),
    ("cc-by-nd", "creativecommons org licenses by nd", "creativecommons org", 55, 0.9),
    ("cc-by-nc", "creativecommons org licenses by nc", "creativecommons org", 55, 0.9),
    ("cc-by-nc-sa", "creativecommons org licenses by nc sa", "creativecommons org", 60, 0.9),
    ("cc-by-nc-nd", "creativecommons org licenses by nc nd", "creativecommons org", 60, 0.9),
    ("cc", "this work is licensed under a creative commons(?: license)?", "this work is", 40, 0.7),
    ("public-domain", "no known copyright restrictions", "no known copyright", 50, 0.8),
    ("public-domain", "(?:us|u s|united states) government works?|work of the (?:us|u s|united states) government", "government work*|work of the", 40, 0.7),
    ("pddl", "public domain dedication and license|pddl", "public domain|pddl", 60, 0.9),
    ("cdla", "community data license agreement(?: permissive| sharing)?", "community data", 55, 0.9),
    ("c-uda", "computational use of data agreement", "computational use", 55, 0.9),
    ("ogl", "open government licen[sc]e", "open government", 55, 0.9),
    ("etalab", "licence ouverte(?: open licence)?", "licence ouverte", 55, 0.9),
    ("dl-de", "datenlizenz deutschland(?: namensnennung| zero)?", "datenlizenz", 55, 0.9),
    ("sspl", "server side public license|sspl", "server side|sspl", 50, 0.9),
    ("busl", "business source license|busl", "business source|busl", 50, 0.85),
    ("busl-1.1", "business source license(?: version)? 1 1|busl 1 1", "business source|busl", 60, 0.95),
    ("elastic", "elastic license", "elastic license", 50, 0.8),
    ("elastic-2.0", "elastic license(?: version)? (?:2 0|v2)", "elastic license", 60, 0.95),
    ("polyform", "polyform (?:noncommercial|shield|small business|strict|free trial|internal use|perimeter)(?: license)?", "polyform", 55, 0.9),
    ("commons-clause", "commons clause(?: license condition)?", "commons clause", 55, 0.9),
    ("openrail", "openrail(?: m)?|(?:bigscience |creativeml )?open rail m", "openrail|open rail|bigscience|creativeml", 55, 0.9),
    ("llama", "llama (?:2|3|3 1|3 2|3 3|4) community license(?: agreement)?", "llama", 60, 0.95),
    ("gemma", "gemma terms of use", "gemma", 55, 0.9),
    ("perl", "(?:under the )?same terms as perl(?: itself)?", "same terms", 55, 0.9),
    ("ruby", "(?:under the )?same terms as ruby|ruby license", "same terms|ruby license", 55, 0.85),
    ("json", "the software shall be used for good not evil", "for good", 65, 0.95),
    ("beerware", "beerware license|beer ware license|buy me a beer in return", "beerware|beer", 50, 0.9),
    ("ijg", "independent jpeg group(?: license)?", "independent jpeg", 55, 0.8),
    ("libpng", "libpng license|png reference library license", "libpng|png reference", 55, 0.9),
    ("curl", "curl license", "curl license", 50, 0.85),
    ("vim", "vim license", "vim license", 50, 0.85),
    ("tcl", "tcl tk license|tcl license", "tcl", 50, 0.85),
    ("unicode", "unicode license(?: agreement)?|unicode terms of use", "unicode", 50, 0.85),
    ("w3c", "w3c software (?:notice and )?(?:document )?license", "w3c", 55, 0.9),
    ("freetype", "freetype (?:project )?license", "freetype", 50, 0.9),
    ("mit-0", "mit no attribution|mit 0", "mit no|mit 0", 60, 0.9),
    ("mit", "(?:released|distributed|available) under (?:the )?mit|mit licensed", "under mit|under the|mit licensed", 40, 0.75),
    ("bsd", "bsd licensed", "bsd licensed", 40, 0.75),
    ("cpl", "common public license", "common public", 50, 0.85),
    ("ipl", "ibm public license", "ibm public", 50, 0.85),
    ("sissl", "sun industry standards source license", "sun industry", 50, 0.9),
    ("npl", "netscape public license", "netscape public", 50, 0.9),
    ("qpl", "q public license", "q public", 50, 0.9),
    ("rpl", "reciprocal public license", "reciprocal public", 50, 0.9),
    ("upl", "universal permissive license", "universal permissive", 50, 0.9),
    ("lppl", "latex project public license|lppl", "latex project|lppl", 50, 0.9),
    ("ecl", "educational community license", "educational community", 50, 0.9),
    ("mulan", "mulan (?:psl|permissive software license)(?: v2| version 2)?", "mulan", 55, 0.9),
    ("hippocratic", "hippocratic license", "hippocratic", 50, 0.9),
    ("anti-996", "anti 996 license", "anti 996", 50, 0.9),
    ("eula", "end user licen[sc]e agreement|eula", "end user|eula", 40, 0.7),
    ("freeware", "this is freeware|distributed as freeware|freeware license", "freeware", 40, 0.7),
    ("shareware", "this is shareware|distributed as shareware|shareware license", "shareware", 40, 0.7),
    ("source-available", "source available license", "source available", 40, 0.7),
    ("dual", "dual licensed(?: under)?", "dual licensed", 30, 0.5),
    ("permission", "(?:used|reprinted|reproduced) (?:with|by) permission(?: of)?", "with permission|by permission", 30, 0.5),
    ("proprietary", "for internal use only", "internal use", 30, 0.6),
    ("proprietary", "do not (?:copy|redistribute)(?: or distribute)?", "do not copy|do not redistribute", 25, 0.5),
    ("proprietary", "this (?:software|document|material) (?:is|contains) (?:the )?(?:proprietary|confidential)(?: and proprietary| and confidential)?", "proprietary|confidential", 45, 0.8),
    ("proprietary", "trade secrets? of", "trade secret|trade secrets", 35, 0.7),
    ("copyright", "all copyrights? (?:are )?retained", "all copyright|all copyrights", 30, 0.6),
    ("reserved", "tous droits réservés", "tous droits", 30, 0.7),
    ("reserved", "alle rechte vorbehalten", "alle rechte", 30, 0.7),
    ("reserved", "todos los derechos reservados", "todos los", 30, 0.7),
    ("reserved", "tutti i diritti riservati", "tutti i", 30, 0.7),
    ("terms", "terms and conditions(?: apply)?", "terms and", 10, 0.3),
)


#: The columns that scan puts behind those of the documents.
ADDED = ("n_words", "detections", "n_base", "first_word", "last_word", "base_labels", "labels", "score")


def rules() -> list[tuple[str, str, str, int, float]]:
    """(label, pattern, keywords, priority, confidence), built from the tables above: names with each version, in several wordings."""
    out = [(label, pattern, keyword, priority, sure) for label, pattern, keyword, priority, sure in TEXTS]
    number = r"(?: license| licence)?(?: version)? v?"

    def named(label, names, versions, keyword, priority=50):
        for name in names:
            out.append((label, name, keyword, priority - 10, 0.75))
            out.append((label, f"(?:licensed|released|distributed|available) under (?:the )?(?:terms of the )?{name}", keyword, priority - 5, 0.85))
            for v in versions:
                full = f"{label}-{v.replace(' ', '.')}"
                number_of = v[:-2] + r"(?: 0)?" if v.endswith(" 0") else v
                out.append((full, f"{name}{number}{number_of}", keyword, priority, 0.9))
                out.append((full, f"(?:licensed|released|distributed|available) under (?:the )?(?:terms of the )?{name}{number}{number_of}", keyword, priority + 5, 0.95))

    for label, names, versions, keyword in FAMILIES:
        named(label, names, versions, keyword)
    for label, short, long in COMMONS:
        rank = 50 + 5 * label.count("-")
        named(label, (short, f"creative commons {long}"), ("1 0", "2 0", "2 5", "3 0", "4 0"), "cc by|creative commons", rank)
    for label, kind, versions in (("gpl", "", ("1", "2", "3")), ("lgpl", "lesser |library ", ("2", "2 1", "3")), ("agpl", "affero ", ("1", "3"))):
        optional = f"(?:{kind.strip()}|{kind.strip().replace(' |', '|')}) " if kind else ""
        full = rf"(?:gnu )?{optional}general public licen[sc]e"
        named(label, (full, label), versions, "general public|gpl*|lgpl*|agpl*", 60 if kind else 50)
        for v in versions:
            name = f"{label}-{v.replace(' ', '.')}"
            out.append((name, f"{label}v?{v}", f"{label}*", 60, 0.9))
            out.append((f"{name}-or-later", rf"(?:{full}|{label})(?: version)? v?{v} or (?:any )?later(?: version)?", "general public|gpl*|lgpl*|agpl*", 75, 0.95))
            out.append((f"{name}-or-later", rf"(?:{full}|{label}) as published by the free software foundation either version {v}", "general public|gpl*|lgpl*|agpl*", 75, 0.95))
            out.append((f"{name}-only", rf"(?:{full}|{label})(?: version)? v?{v} only", "general public|gpl*|lgpl*|agpl*", 75, 0.95))
    return out


def normalise(text: Column) -> Column:
    """Words with one space between, in front and behind; a single space if there are none."""
    return F.concat(F.lit(" "), F.trim(F.regexp_replace(F.translate(F.coalesce(text, F.lit("")), _UPPER, _UPPER.lower()), _NOT_WORD, " ")), F.lit(" "))


def _spaces(text: Column) -> Column:
    return F.length(text) - F.length(F.replace(text, F.lit(" "), F.lit("")))


def _any_of(strings: list[str]) -> str:
    """A regular expression for any of the strings that tries each first letter once."""
    if "" in strings:
        return ""
    heads = sorted({x[0] for x in strings})
    branches = [head + _any_of([x[1:] for x in strings if x[0] == head]) for head in heads]
    return branches[0] if len(branches) == 1 else "(?:" + "|".join(branches) + ")"


def _word_regex(phrase: str) -> str:
    return f"(?<= )(?:{phrase})(?= )"


def _spans(text: Column, pattern: Column) -> Column:
    """Word spans [start, end) of all matches of a pattern in a normalised text: matches are marked, words counted once."""
    # the one-element array binds the words; the text's first space makes an empty one in front
    words = F.split(F.regexp_replace(text, pattern, F.lit("\u0001$0\u0002")), " ")
    at = lambda w, here, shift: F.filter(F.transform(w, lambda x, i: F.when(here(x), i - shift)), lambda i: i.isNotNull())
    starts = lambda w: at(w, lambda x: x.startswith("\u0001"), 1)
    ends = lambda w: at(w, lambda x: x.endswith("\u0002"), 0)
    return F.get(F.transform(F.array(words), lambda w: F.zip_with(starts(w), ends(w), lambda a, b: F.struct(a.alias("start"), b.alias("end")))), F.lit(0))


def _base(documents: DataFrame) -> DataFrame:
    """n_words and, for each base phrase, how often it stands and its first and last place."""
    t = F.col("norm")
    out = documents.withColumn("n_words", F.when(F.length(t) <= 2, F.lit(0)).otherwise(_spaces(t) - 1).cast("long"))
    for k, (phrase, _) in enumerate(BASE):
        size = phrase.count(" ") + 1
        parts = F.when(t.contains(f" {phrase} "), F.split(t, _word_regex(phrase)))
        out = out.withColumn(f"parts{k}", parts)
        p = F.col(f"parts{k}")
        out = out.withColumn(
            f"base{k}",
            F.when(
                p.isNotNull(),
                F.struct((F.size(p) - 1).cast("long").alias("n"), (_spaces(F.element_at(p, 1)) - 1).cast("long").alias("first"), (F.col("n_words") - _spaces(F.element_at(p, -1)) + 1 - size).cast("long").alias("last")),
            ),
        ).drop(f"parts{k}")
    return out


def scan(documents: DataFrame) -> DataFrame:
    """All columns but text, and those of ADDED: word count, base places, detections (label, start, end, priority, confidence), labels and score."""
    own = [c for c in documents.columns if c not in ("text", *ADDED)]
    documents = documents.select(F.struct(*[F.col(f"`{c}`") for c in own]).alias("doc") if own else F.lit(None).alias("doc"), "text")
    table_ = rules()
    keywords = sorted({k for r in table_ for k in r[2].split("|")})
    strings = lambda xs: "array(" + ", ".join(f"r'{x}'" for x in xs) + ")"
    # one constant; as SQL text, since some hundred expressions built one by one take seconds
    catalogue = F.expr("array(" + ", ".join(f"named_struct('label', '{label}', 'pattern', r'{_word_regex(pattern)}', 'keywords', {strings(keyword.split('|'))}, 'priority', {priority}, 'confidence', {sure}D)" for label, pattern, keyword, priority, sure in table_) + ")")
    t = F.col("norm")
    gate = t.rlike(" " + _any_of([k[:-1] if k.endswith("*") else f"{k} " for k in keywords]))
    hits = F.filter(F.expr(strings(keywords)), lambda k: F.contains(t, F.concat(F.lit(" "), F.when(k.endswith("*"), F.rtrim(k, F.lit("*"))).otherwise(F.concat(k, F.lit(" "))))))
    found = F.flatten(
        F.transform(
            F.filter(catalogue, lambda r: F.arrays_overlap(r.keywords, F.col("hits"))),
            lambda r: F.transform(_spans(t, r.pattern), lambda s: F.struct(r.label.alias("label"), s.start.alias("start"), s.end.alias("end"), r.priority.alias("priority"), r.confidence.alias("confidence"))),
        )
    )
    kind = "array<struct<label:string,start:int,end:int,priority:int,confidence:double>>"
    beaten = lambda x, y: (y.start <= x.start) & (y.end >= x.end) & ((y.priority > x.priority) | ((y.priority == x.priority) & (y.end - y.start > x.end - x.start)))
    out = _base(documents.withColumn("norm", normalise(F.col("text"))))
    out = out.withColumn("hits", F.when(gate, hits))
    out = out.withColumn("raw", F.when(F.size("hits") > 0, found).otherwise(F.expr(f"cast(array() as {kind})")))
    out = out.withColumn("detections", F.filter("raw", lambda x: ~F.exists("raw", lambda y: beaten(x, y)))).drop("raw", "hits", "norm", "text")
    base = F.array_compact(F.array(*[F.when(F.col(f"base{k}").isNotNull(), F.lit(label)) for k, (_, label) in enumerate(BASE)]))
    spots = [F.col(f"base{k}") for k in range(len(BASE))]
    labels = F.array_sort(F.array_distinct(F.concat(base, F.transform("detections", lambda d: d.label))))
    sure = F.coalesce(F.array_max(F.transform("detections", lambda d: d.confidence)), F.lit(0.0))
    return out.select(
        *[F.col("doc")[c].alias(c) for c in own],
        "n_words",
        "detections",
        sum((F.coalesce(s["n"], F.lit(0)) for s in spots), F.lit(0)).cast("long").alias("n_base"),
        F.least(*[s["first"] for s in spots]).alias("first_word"),
        F.greatest(*[s["last"] for s in spots]).alias("last_word"),
        F.array_join(F.array_sort(base), ",").alias("base_labels"),
        F.array_join(labels, ",").alias("labels"),
        F.greatest(sure, F.when(F.size(base) > 0, F.lit(0.5)).otherwise(F.lit(0.0))).alias("score"),
    )


def op6_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = scan(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return out.select("doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score")
