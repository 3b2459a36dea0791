"""License scans by ordered signature rules, in DataFrame functions only.

A text passes a keyword test first; few do.  Those are searched by the rules whose own keywords they have, in order.
Keywords lose nothing: a rule has one for each alternative of its pattern, and the first test is made of what each rule
or base phrase can't do without.
Each rule is a regular expression with a label, a priority and a weight.  Those for sentences of license texts and
notices are written one by one; those for names with versions, which differ in nothing but the name, come from a table of
license families; together they are some hundreds.  Of overlapping detections, one that lies inside another of at
least its priority is suppressed.  All this happens within the row: no shuffle, no join, no Python.

Word positions count words ``[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+`` of the text with A-Z lower-cased, from 0.
A null text is an empty one: no words, no labels, score 0.  Very long texts and thousands of detections in one cost
linear time.  Equal texts have equal results, repeated rows each their own.  A column of the input with the name of one
that is made here is an error.
"""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .shared import fold, let, reject_clashes, text_of

#: Words, upper case counting as letters: the same places as in the lower-cased text.
WORD = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
GAP = r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
#: Base phrases, fixed values.
PHRASES = {"cc-by": ["cc", "by"], "gpl": ["general", "public", "license"], "reserved": ["all", "rights", "reserved"]}
#: What a text with a base phrase has at least.
BASE_KEYWORDS = ["cc", "licen", "reserved"]

#: Families: label, keywords (one for each alternative of the name, | between), name in texts, versions, short names (patterns).
FAMILIES = [
    ("apache", "apache", r"apache", ["1.0", "1.1", "2.0"], r"apache|asl"),
    ("mit", "mit|x11|expat", r"mit|x11|expat", [], r"mit"),
    ("bsd-2-clause", "bsd", r"bsd[ -]2[ -]clause|simplified bsd|freebsd", [], r"bsd-2-clause"),
    ("bsd-3-clause", "bsd", r"bsd[ -]3[ -]clause|new bsd|revised bsd|modified bsd", [], r"bsd-3-clause"),
    ("bsd-4-clause", "bsd", r"bsd[ -]4[ -]clause|original bsd", [], r"bsd-4-clause"),
    ("bsd", "bsd", r"bsd", [], r"bsd"),
    ("gpl", "general public", r"gnu general public|general public", ["1", "2", "3"], r"gpl"),
    ("lgpl", "lesser general|library general", r"gnu lesser general public|lesser general public|library general public", ["2", "2.1", "3"], r"lgpl"),
    ("agpl", "affero", r"gnu affero general public|affero general public", ["1", "3"], r"agpl"),
    ("gfdl", "documentation", r"gnu free documentation|free documentation", ["1.1", "1.2", "1.3"], r"gfdl"),
    ("mpl", "mozilla", r"mozilla public", ["1.0", "1.1", "2.0"], r"mpl"),
    ("epl", "eclipse", r"eclipse public", ["1.0", "2.0"], r"epl"),
    ("cddl", "development and distribution", r"common development and distribution", ["1.0", "1.1"], r"cddl"),
    ("cpl", "common public", r"common public", ["1.0"], r"cpl"),
    ("eupl", "european union", r"european union public", ["1.0", "1.1", "1.2"], r"eupl"),
    ("isc", "isc", r"isc", [], r"isc"),
    ("zlib", "zlib", r"zlib(?:/libpng)?", [], r"zlib"),
    ("boost", "boost", r"boost software", ["1.0"], r"bsl"),
    ("artistic", "artistic", r"artistic", ["1.0", "2.0"], r"artistic"),
    ("ofl", "open font", r"sil open font|open font", ["1.0", "1.1"], r"ofl"),
    ("odbl", "open database", r"open database|open data commons open database", ["1.0"], r"odbl"),
    ("python", "python|psf", r"python software foundation|psf", ["2", "2.0"], r"psf|python"),
    ("php", "php", r"php", ["3.0", "3.01"], r"php"),
    ("postgresql", "postgresql", r"postgresql", [], r"postgresql"),
    ("openssl", "openssl", r"openssl", [], r"openssl"),
    ("ncsa", "ncsa", r"university of illinois/ncsa open source|ncsa", [], r"ncsa"),
    ("upl", "universal permissive", r"universal permissive", ["1.0"], r"upl"),
    ("wtfpl", "do what the f|wtfpl", r"do what the f\w+ you want to public|wtfpl", ["1", "2"], r"wtfpl"),
    ("unlicense", "unlicense", r"unlicense|the unlicense", [], r"unlicense"),
    ("ms-pl", "microsoft public", r"microsoft public", [], r"ms-pl"),
    ("ms-rl", "microsoft reciprocal", r"microsoft reciprocal", [], r"ms-rl"),
    ("osl", "open software", r"open software", ["1.0", "2.0", "2.1", "3.0"], r"osl"),
    ("afl", "academic free", r"academic free", ["1.1", "1.2", "2.0", "2.1", "3.0"], r"afl"),
    ("cecill", "cecill", r"cecill", ["1.0", "1.1", "2.0", "2.1"], r"cecill"),
    ("elastic", "elastic", r"elastic", ["1.0", "2.0"], r"elastic"),
    ("sspl", "server side public", r"server side public", ["1"], r"sspl"),
    ("busl", "business source", r"business source", ["1.0", "1.1"], r"busl"),
    ("mulan", "mulan", r"mulan permissive software", ["1", "2"], r"mulanpsl"),
    ("ipl", "ibm public", r"ibm public", ["1.0"], r"ipl"),
    ("apsl", "apple public", r"apple public source", ["1.0", "1.1", "1.2", "2.0"], r"apsl"),
]
#: Creative Commons terms, and rules that stand by themselves: label, keywords, regular expression, priority, weight.
COMMONS = {"by": "attribution", "by-sa": "attribution[ -]?sharealike", "by-nd": "attribution[ -]?noderivatives", "by-nc": "attribution[ -]?noncommercial", "by-nc-sa": "attribution[ -]?noncommercial[ -]?sharealike", "by-nc-nd": "attribution[ -]?noncommercial[ -]?noderivatives"}
SINGLE = [
    ("cc0", "cc0", r"\bcc0(?:[ -]1\.0)?\b", 3, 0.9),
    ("cc0", "creative commons zero", r"creative commons zero", 3, 0.9),
    ("public-domain", "public domain", r"(?:released|dedicated|placed|is)\b.{0,40}public domain", 2, 0.8),
    ("reserved", "reserved", r"all rights reserved", 2, 0.6),
    ("copyright", "copyright", r"copyright\s++(?:\(c\)|©)?\s*+\d{4}", 1, 0.4),
    ("copyright", "copyright", r"\bcopyright\b", 0, 0.2),
    ("copyright", "©", r"©\s*\d{4}", 1, 0.4),
    ("mit", "permission is hereby granted", r"permission is hereby granted, free of charge, to any person obtaining a copy", 3, 0.95),
    ("bsd", "redistribution and use", r"redistribution and use in source and binary forms", 3, 0.9),
    ("isc", "permission to use", r"permission to use, copy, modify, and(?:/or)? distribute this software", 3, 0.9),
    ("unlicense", "free and unencumbered", r"this is free and unencumbered software released into the public domain", 3, 0.95),
    ("proprietary", "proprietary", r"\bproprietary and confidential\b|\bproprietary licen[cs]e\b", 2, 0.7),
    ("no-warranty", "warranty", r"without warranty of any kind|without any warranty", 1, 0.3),
    ("unknown-license", "licen", r"\b(?:licensed under|released under|distributed under|licen[cs]e)\b", 0, 0.2),
]


#: Sentences of license texts and notices: label, keywords, regular expression; they count as much as a named license.
NOTICES = [
    ("apache-2.0", "in compliance with the license", r"you may not use this file except in compliance with the license"),
    ("apache-2.0", "apache.org/licenses", r"apache\.org/licenses/license-2\.0"),
    ("apache-1.1", "apache software foundation", r"this product includes software developed by the apache software foundation"),
    ("apache-2.0", "contributor hereby grants", r"each contributor hereby grants to you a perpetual, worldwide, non-exclusive, no-charge, royalty-free,? irrevocable (?:copyright|patent)? ?licen[cs]e"),
    ("mit", "without restriction, including", r"deal in the software without restriction, including without limitation the rights to use, copy, modify, merge"),
    ("mit", "substantial portions", r"the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software"),
    ("mit", "opensource.org/licenses/mit", r"opensource\.org/licenses/mit\b"),
    ("mit-0", "mit-0|mit 0|mit license-0|mit license 0|no attribution", r"\bmit(?: license)?[ -](?:0|no attribution)\b"),
    ("bsd", "redistributions of source code", r"redistributions of source code must retain the above copyright notice"),
    ("bsd", "redistributions in binary form", r"redistributions in binary form must reproduce the above copyright notice"),
    ("bsd-3-clause", "neither the name", r"neither the names? of .{1,120}? nor the names of its contributors may be used to endorse or promote products"),
    ("bsd-4-clause", "advertising materials", r"all advertising materials mentioning features or use of this software must display the following acknowledge?ment"),
    ("bsd-3-clause-clear", "patent rights are granted", r"no express or implied licen[cs]es to any party's patent rights are granted"),
    ("bsd-1-clause", "bsd-1-clause", r"\bbsd-1-clause\b"),
    ("0bsd", "0bsd", r"\b0bsd\b|\bzero[ -]clause bsd\b"),
    ("gpl", "free software foundation", r"you can redistribute it and/or modify it under the terms of the gnu general public licen[cs]e"),
    ("gpl", "you should have received a copy", r"you should have received a copy of the gnu general public licen[cs]e"),
    ("lgpl", "you should have received a copy", r"you should have received a copy of the gnu (?:lesser|library) general public licen[cs]e"),
    ("agpl", "you should have received a copy", r"you should have received a copy of the gnu affero general public licen[cs]e"),
    ("gpl-classpath-exception", "independent modules", r"permission to link this library with independent modules to produce an executable"),
    ("gpl", "gnu.org/licenses/gpl", r"gnu\.org/licenses/gpl\b"),
    ("gfdl", "copy, distribute and/or modify this document", r"permission is granted to copy, distribute and/or modify this document under the terms of the gnu free documentation"),
    ("mpl-2.0", "subject to the terms of the mozilla", r"this source code form is subject to the terms of the mozilla public licen[cs]e, v\. ?2\.0"),
    ("mpl-1.1", "mozilla public license version 1.1", r"the contents of this file are subject to the mozilla public licen[cs]e version 1\.1"),
    ("epl", "accompanying materials", r"this program and the accompanying materials are made available under the terms of the eclipse"),
    ("cddl", "contents of this file are subject", r"the contents of this file are subject to the terms of (?:either the gnu .{1,80}? or )?the common development and distribution"),
    ("isc", "with or without fee", r"permission to use, copy, modify,? and(?:/or)? distribute this software for any purpose with or without fee is hereby granted"),
    ("zlib", "authors be held liable", r"in no event will the authors be held liable for any damages arising from the use of this software"),
    ("zlib", "altered source versions", r"altered source versions must be plainly marked as such"),
    ("boost-1.0", "accompanying documentation", r"obtaining a copy of the software and accompanying documentation covered by this licen[cs]e"),
    ("unlicense", "anyone is free to copy", r"anyone is free to copy, modify, publish, use, compile, sell, or distribute this software"),
    ("unlicense", "unlicense.org", r"\bunlicense\.org\b"),
    ("wtfpl", "verbatim or modified copies", r"everyone is permitted to copy and distribute verbatim or modified copies of this licen[cs]e document, and changing it is allowed"),
    ("cc0", "associated a work with this deed", r"the person who associated a work with this deed has dedicated the work to the public domain"),
    ("cc0", "publicdomain/zero", r"creativecommons\.org/publicdomain/zero/1\.0"),
    ("cc0", "possible under law", r"to the extent possible under law,? .{1,160}? has waived all copyright and related or neighboring rights"),
    ("public-domain", "publicdomain/mark", r"creativecommons\.org/publicdomain/mark/1\.0"),
    ("cc-by", "licenses/by/", r"creativecommons\.org/licenses/by/\d\.\d"),
    ("cc-by-sa", "licenses/by-sa", r"creativecommons\.org/licenses/by-sa/\d\.\d"),
    ("cc-by-nd", "licenses/by-nd", r"creativecommons\.org/licenses/by-nd/\d\.\d"),
    ("cc-by-nc", "licenses/by-nc/", r"creativecommons\.org/licenses/by-nc/\d\.\d"),
    ("cc-by-nc-sa", "licenses/by-nc-sa", r"creativecommons\.org/licenses/by-nc-sa/\d\.\d"),
    ("cc-by-nc-nd", "licenses/by-nc-nd", r"creativecommons\.org/licenses/by-nc-nd/\d\.\d"),
    ("openssl", "openssl project", r"this product includes software developed by the openssl project"),
    ("ssleay", "eric young", r"this product includes cryptographic software written by eric young"),
    ("php", "php software", r"this product includes php software, freely available from"),
    ("python", "psf hereby grants", r"psf hereby grants licensee a nonexclusive, royalty-free, world-?wide licen[cs]e"),
    ("artistic", "conditions under which", r"the intent of this (?:document|licen[cs]e) is to state the conditions under which a package may be copied"),
    ("ofl-1.1", "this font software", r"this font software is licensed under the sil open font licen[cs]e, version 1\.1"),
    ("odbl", "opendatacommons.org", r"opendatacommons\.org/licenses/odbl"),
    ("odc-by", "opendatacommons.org", r"opendatacommons\.org/licenses/by\b"),
    ("pddl", "opendatacommons.org", r"opendatacommons\.org/licenses/pddl"),
    ("postgresql", "without a written agreement", r"for any purpose, without fee, and without a written agreement is hereby granted"),
    ("ncsa", "deal with the software", r"to deal with the software without restriction, including without limitation the rights to use"),
    ("curl", "curl", r"\bcurl licen[cs]e\b"),
    ("vim", "vim licen", r"\bvim licen[cs]e\b"),
    ("jsr", "for good, not evil", r"the software shall be used for good, not evil"),
    ("beerware", "beer", r"\bbeer-?ware licen[cs]e\b|you can buy me a beer in return"),
    ("x11", "x consortium", r"the name of the x consortium shall not be used in advertising"),
    ("hpnd", "supporting documentation", r"appear in all copies and that both that copyright notice and this permission notice appear in supporting documentation"),
    ("ms-pl", "governs use of the accompanying", r"this licen[cs]e governs use of the accompanying software"),
    ("elastic-2.0", "hosted or managed service", r"you may not provide the software to third parties as a hosted or managed service"),
    ("sspl", "available to third parties as a service", r"making the functionality of the program available to third parties as a service"),
    ("busl", "change date", r"\bchange date\b.{0,200}?\bchange licen[cs]e\b"),
    ("commons-clause", "commons clause", r"\bcommons clause\b"),
    ("polyform", "polyform", r"\bpolyform (?:noncommercial|small business|shield|strict|perimeter|free trial|internal use) licen[cs]e\b"),
    ("openrail", "openrail", r"\b(?:bigscience |creativeml )?open ?rail(?:[ +-]?m)?\b"),
    ("llama", "community licen", r"\bllama \d(?:\.\d)? community licen[cs]e\b"),
    ("non-commercial", "commercial", r"\bfor (?:non-?commercial|personal|academic|research) (?:use|purposes) only\b"),
    ("no-redistribution", "may not be reproduced", r"may not be reproduced,? (?:or )?(?:distributed|transmitted|republished|copied)"),
    ("permission-required", "permission", r"without (?:the )?(?:prior |express )?(?:prior |express )?(?:written )?(?:permission|consent) of the (?:publisher|author|copyright (?:holder|owner))"),
]


def rules() -> list[tuple[str, str, str, int, float]]:
    """Label, keywords (lower case, | between; a match has one of them at least), regular expression (case-insensitive),
    priority, weight; strongest first."""
    made = [*SINGLE, *((label, keywords, pattern, 3, 0.9) for label, keywords, pattern in NOTICES)]
    for label, keyword, name, versions, short in FAMILIES:
        lead = rf"(?:(?:licensed|released|distributed|available|provided)\s+under\s+(?:the\s+)?(?:terms\s+of\s+the\s+)?)?(?:the\s+)?\b(?:{name})\s+(?:software\s+)?licen[cs]e"
        made.append((label, keyword, lead, 2, 0.85))
        made.append((label, "spdx", rf"spdx-license-identifier:\s*(?:{short})(?![a-z0-9])", 3, 0.95))
        for v in versions:
            exact = v.replace(".", r"\.")
            loose = exact.removesuffix(r"\.0") + (r"(?:\.0)?" if v.endswith(".0") or "." not in v else "")
            made.append((f"{label}-{v}", keyword, rf"{lead},?\s+(?:version\s+|v\.?\s*)?{loose}(?![0-9.]*[0-9])", 4, 0.95))
            made.append((f"{label}-{v}", "spdx", rf"spdx-license-identifier:\s*(?:{short})-{loose}(?![0-9.]*[0-9])", 5, 1.0))
            made.append((f"{label}-{v}", "licen", rf"\b(?:{short})[ -]?v?{exact}(?![0-9.]*[0-9])\s+licen[cs]e", 3, 0.8))
            if label in ("gpl", "lgpl", "agpl"):  # with a suffix, the label is the SPDX identifier
                full = v if "." in v else f"{v}.0"
                for suffix, signs in (("only", "-only"), ("or-later", r"-or-later|\+")):
                    made.append((f"{label}-{full}-{suffix}", "spdx", rf"spdx-license-identifier:\s*(?:{short})-{loose}(?:{signs})", 6, 1.0))
                made.append((f"{label}-{full}-or-later", keyword, rf"{lead}[^.]{{0,200}}?(?:version\s+|v){loose}[^.]{{0,80}}?(?:or\s+\(at\s+your\s+option\)\s+)?any\s+later\s+version", 5, 0.97))
    for code, name in COMMONS.items():
        made.append((f"cc-{code}", "creative commons", rf"creative commons {name}(?![ -]?(?:sharealike|no))(?:\s+(?:\d\.\d|international|unported|licen[cs]e|public))*+", 4, 0.95))
        for v in ("1.0", "2.0", "2.5", "3.0", "4.0"):
            made.append((f"cc-{code}-{v}", "cc", rf"\bcc[ -]{code}[ -]{v.replace('.', r'[.]')}\b", 4, 0.95))
    made.append(("cc-by", "cc", r"\bcc[ -]by\b(?![ -](?:sa|nd|nc))", 3, 0.9))
    return sorted(made, key=lambda r: (-r[3], r[0], r[2]))


def _also(keywords: str, pattern: str) -> str:
    """A family's keywords stand beside the word license, which its rules need besides; others need nothing more."""
    return "licen" if "licen[cs]e" in pattern and keywords in {k for _, k, *_ in FAMILIES} else ""


def gate() -> list[str]:
    """Keywords of which a text with any detection or base phrase has one."""
    found = {k for _, keywords, pattern, *_ in rules() for k in (_also(keywords, pattern) or keywords).split("|")}
    found |= set(BASE_KEYWORDS)
    return sorted(k for k in found if not any(other != k and other in k for other in found))


def _present(text: Column) -> Column:
    """The keywords of rules and base phrases that a text has; it is lower-cased once and searched once a keyword,
    however many rules share it."""
    every = sorted({k for _, keywords, *_ in rules() for k in keywords.split("|")} | set(gate()))
    keywords = F.array(*[F.lit(k) for k in every])
    return let(F.lower(text), lambda low: F.filter(keywords, lambda k: F.contains(low, k)))


PLACES = "struct<start:int,end:int,hit:string>"


def places(text: Column, pattern: Column) -> Column:
    """Array of (start, end, hit) of all matches, leftmost and apart, in code points: what lies between the matches and
    the matches themselves are summed up, in time linear in their number."""

    def summed(found):
        pieces = F.slice(F.arrays_zip(F.split(text, pattern, -1).alias("gap"), found.alias("hit")), F.lit(1), F.size(found))

        def step(at, piece):
            begin = at + F.length(piece["gap"])
            end = begin + F.length(piece["hit"])
            return end, F.array(F.struct(begin.alias("start"), end.alias("end"), piece["hit"].alias("hit")))

        return F.when(F.size(found) == 0, F.expr(f"cast(array() as array<{PLACES}>)")).otherwise(fold(pieces, F.lit(0), PLACES, step))

    return let(F.regexp_extract_all(text, pattern, F.lit(0)), summed)


def _base(words: Column) -> Column:
    """Array of (at, label) of the base phrases in an array of lower-cased words."""

    def found(listed):
        starts = F.transform(listed, lambda w, i: F.struct(i.alias("at"), _phrase_at(listed, w, i).alias("label")))
        return F.filter(starts, lambda x: x["label"].isNotNull())

    return let(words, found)


def _phrase_at(words: Column, word: Column, i: Column) -> Column:
    out = F.lit(None).cast("string")
    for label, phrase in PHRASES.items():
        hit = word == phrase[0]
        for k, w in enumerate(phrase[1:], 1):
            hit = hit & F.coalesce(F.get(words, i + k) == w, F.lit(False))
        out = F.when(hit, F.lit(label)).otherwise(out)
    return out


def _lower(c: Column) -> Column:
    """A-Z only."""
    return F.translate(c, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


HIT = "struct<start:int,minus_end:int,minus_priority:int,label:string,weight:double>"


def _detections(text: Column, gated: bool = True, present: Column | None = None) -> Column:
    """Detections by all rules of whose keywords the text has one (or by all rules), in order of start, those suppressed
    left out."""
    listed = [{"label": a, "keywords": k.split("|"), "also": _also(k, r), "pattern": f"(?is){r}", "priority": p, "weight": w} for a, k, r, p, w in rules()]
    table = F.from_json(F.lit(json.dumps(listed)), "array<struct<label:string,keywords:array<string>,also:string,pattern:string,priority:int,weight:double>>")  # a constant
    if gated:
        able = lambda there: F.filter(table, lambda r: F.arrays_overlap(r["keywords"], there) & ((r["also"] == "") | F.array_contains(there, r["also"])))
        table = let(present if present is not None else _present(text), able)
    hits = F.flatten(F.transform(table, lambda r: F.transform(places(text, r["pattern"]), lambda m: F.struct(m["start"].alias("start"), (-m["end"]).alias("minus_end"), (-r["priority"]).alias("minus_priority"), r["label"].alias("label"), r["weight"].alias("weight")))))
    top = max(p for *_, p, _ in rules()) + 1

    def step(reach, d):
        end, level = -d["minus_end"], -d["minus_priority"]
        # reach[p]: the furthest end of what came so far with priority p or more; those start no later than this one
        inside = F.get(reach, level) >= end
        further = F.transform(reach, lambda x, p: F.when(p <= level, F.greatest(x, end)).otherwise(x))
        return F.when(inside, reach).otherwise(further), F.when(inside, F.expr(f"cast(array() as array<{HIT}>)")).otherwise(F.array(d))

    return fold(F.array_sort(hits), F.array(*[F.lit(-1)] * top), HIT, step)


def scan_licenses(df: DataFrame, text: str = "text") -> DataFrame:
    """All columns of ``df`` and ``n_words``, ``base`` (array of word index and label), ``detections`` (array of start,
    end in code points, label, weight, priority), ``labels``, ``score``; one row for each row."""
    reject_clashes(df.columns, ["n_words", "base", "detections", "labels", "score", "__present", "__keyed", "__hits"])
    body = text_of(text)
    none_base = F.expr("cast(array() as array<struct<at:int,label:string>>)")
    none_hits = F.expr(f"cast(array() as array<{HIT}>)")
    words = F.transform(F.regexp_extract_all(body, F.lit(WORD), F.lit(0)), _lower)
    some = df.withColumn("__present", _present(body))
    made = some.withColumn("__keyed", F.exists("__present", lambda k: k.isin(gate()))).withColumns({
        "n_words": F.regexp_count(body, F.lit(WORD)).cast("long"),
        "base": F.when(F.col("__keyed"), _base(words)).otherwise(none_base),
        "__hits": F.when(F.col("__keyed"), _detections(body, present=F.col("__present"))).otherwise(none_hits),
    })
    hits = F.transform("__hits", lambda d: F.struct(d["start"].alias("start"), (-d["minus_end"]).alias("end"), d["label"].alias("label"), d["weight"].alias("weight"), (-d["minus_priority"]).alias("priority")))
    made = made.withColumn("detections", hits)
    labels = F.array_sort(F.array_union(F.transform("base", lambda b: b["label"]), F.transform("detections", lambda d: d["label"])))
    score = F.greatest(F.coalesce(F.array_max(F.transform("detections", lambda d: d["weight"])), F.lit(0.0)), F.when(F.size("base") > 0, F.lit(0.6)).otherwise(F.lit(0.0)))
    return made.withColumns({"labels": labels, "score": score}).drop("__present", "__keyed", "__hits")
