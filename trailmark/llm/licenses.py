"""License scans by ordered signature rules.

A rule is a regular expression over the words of a text (lower-cased, joined by single spaces), with a label, a priority and a
keyword. A search for a few stems sets aside texts that no rule can match; in the rest each keyword is looked for once, and only
the rules of those that occur are tried. Each match is an interval. An interval inside one of better priority, or of equal priority
and greater length, is suppressed, and of equal intervals the first rule's is left, so that `cc by` says nothing inside
`cc by nc 4 0`; in the order of their starts, longer ones first, this takes one pass that remembers the furthest end of each priority. Base
phrases are found wherever their words stand consecutively, and their labels always stay.

Everything is DataFrame functions on one row at a time: no shuffle, no Python on executors.

Cases: a null or empty text has no words and no labels; repeated rows are each scanned; very long texts are taken whole; ties
between intervals go to the earlier rule; a null id is kept; an empty table gives an empty table; further columns, whatever their names, travel
untouched in the struct `row` of scan().
"""

from __future__ import annotations

import json
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: A word: letters a-z and digits, and whatever isn't ASCII (fixed value).
WORD = r"[0-9A-Za-z\x{80}-\x{10FFFF}]"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Base phrases and their labels (fixed values).
BASE = {"under the mit license": "mit", "apache license version 2": "apache-2", "cc by nc": "cc-by-nc"}
#: A lower-cased text without any of these has no match of any rule or base phrase.
STEMS = ["licens", "licenc", "copyright", "copyleft", "spdx", "creative", "permi", "redistribut", "domain", "warrant", "rights", "gpl", "wtfpl", "apache", "endorse", "advertising", "machine", "proprietary", "reproduc", "cecill", "liab", "cc0", "misrepresent", "dedicat", "remix", "commercial purposes", "not evil", "openssl", "unauthori", "rechte", "droits", "derechos", "tortious", "network server"]
#: Nor has one without these words, apart by whatever isn't a word; the first part is looked for before the pattern is tried.
STEM_WORDS = [("cc", rf"cc(?:{WORD.replace('[', '[^', 1)})+(?:by|0|zero)"), ("asl", rf"asl(?:{WORD.replace('[', '[^', 1)})+2")]
#: How sure a match of each priority is.
SURE = {1: 1.0, 2: 0.9, 3: 0.7, 4: 0.5}
#: How many elements are combined one by one before their result is combined with the others'.
BLOCK = 128
FOUND = "array<struct<start:int,end:int,priority:int,rule:int,label:string>>"

#: Families: label, keyword, names in order of preference, SPDX identifier as words (fixed values).
FAMILIES = [
    ("mit", "mit", ["mit license", "mit licence", "mit x11 license", "expat license"], "mit"),
    ("apache-2", "apache", ["apache license version 2 0", "apache license version 2", "apache license 2 0", "apache 2 0 license", "asl 2 0"], "apache 2 0"),
    ("apache-1.1", "apache", ["apache software license version 1 1", "apache license 1 1"], "apache 1 1"),
    ("agpl-3", "affero", ["gnu affero general public license version 3", "gnu affero general public license v3", "affero general public license"], "agpl 3 0(?: or later| only)?"),
    ("agpl-3", "agpl", ["agpl v3", "agpl 3 0", "agplv3"], "agpl 3 0"),
    ("lgpl-3", "lesser", ["gnu lesser general public license version 3", "gnu lesser general public license v3"], "lgpl 3 0(?: or later| only)?"),
    ("lgpl-2.1", "lesser", ["gnu lesser general public license version 2 1", "gnu lesser general public license v2 1"], "lgpl 2 1(?: or later| only)?"),
    ("lgpl", "lgpl", ["lgpl v3", "lgpl v2 1", "lgpl"], "lgpl 3 0"),
    ("lgpl", "lesser", ["gnu lesser general public license", "lesser general public license"], "lgpl 2 0"),
    ("gpl-3", "general public", ["gnu general public license version 3", "gnu general public license v3", "general public license version 3"], "gpl 3 0(?: or later| only)?"),
    ("gpl-2", "general public", ["gnu general public license version 2", "gnu general public license v2", "general public license version 2"], "gpl 2 0(?: or later| only)?"),
    ("gpl-3", "gpl", ["gnu gpl v3", "gnu gpl version 3", "gpl v3", "gplv3", "gpl 3 0"], "gpl 3 0"),
    ("gpl-2", "gpl", ["gnu gpl v2", "gnu gpl version 2", "gpl v2", "gplv2", "gpl 2 0"], "gpl 2 0"),
    ("gpl", "general public", ["gnu general public license", "general public license"], "gpl 1 0(?: or later| only)?"),
    ("gpl", "gpl", ["gnu gpl"], "gpl"),
    ("gfdl", "free documentation", ["gnu free documentation license version 1 [123]", "gnu free documentation license"], "gfdl 1 [123]"),
    ("bsd-3", "bsd", ["bsd 3 clause license", "3 clause bsd license", "new bsd license", "modified bsd license", "revised bsd license"], "bsd 3 clause"),
    ("bsd-2", "bsd", ["bsd 2 clause license", "2 clause bsd license", "simplified bsd license", "freebsd license"], "bsd 2 clause"),
    ("bsd-4", "bsd", ["bsd 4 clause license", "original bsd license"], "bsd 4 clause"),
    ("bsd", "bsd", ["bsd style license", "bsd license", "bsd licence"], "0bsd"),
    ("mpl-2", "mozilla", ["mozilla public license version 2 0", "mozilla public license 2 0", "mozilla public license v2 0"], "mpl 2 0"),
    ("mpl-1.1", "mozilla", ["mozilla public license version 1 1", "mozilla public license 1 1"], "mpl 1 1"),
    ("mpl", "mozilla", ["mozilla public license"], "mpl"),
    ("epl-2", "eclipse", ["eclipse public license version 2 0", "eclipse public license 2 0", "eclipse public license v2 0"], "epl 2 0"),
    ("epl-1", "eclipse", ["eclipse public license version 1 0", "eclipse public license 1 0", "eclipse public license v1 0"], "epl 1 0"),
    ("cddl", "common development", ["common development and distribution license version 1 [01]", "common development and distribution license"], "cddl 1 [01]"),
    ("isc", "isc", ["isc license", "isc licence"], "isc"),
    ("zlib", "zlib", ["zlib libpng license", "zlib license"], "zlib"),
    ("bsl-1", "boost", ["boost software license version 1 0", "boost software license"], "bsl 1 0"),
    ("artistic-2", "artistic", ["artistic license version 2 0", "artistic license 2 0"], "artistic 2 0"),
    ("artistic-1", "artistic", ["artistic license version 1 0", "artistic license"], "artistic 1 0"),
    ("unlicense", "unlicense", ["the unlicense", "unlicense"], "unlicense"),
    ("wtfpl", "wtfpl", ["wtfpl version 2", "wtfpl"], "wtfpl"),
    ("python-2", "python", ["python software foundation license version 2", "python software foundation license", "psf license"], "psf 2 0"),
    ("postgresql", "postgresql", ["postgresql license"], "postgresql"),
    ("ofl-1.1", "open font", ["sil open font license version 1 1", "sil open font license", "open font license"], "ofl 1 1"),
    ("eupl-1.2", "european union", ["european union public licence version 1 2", "european union public licence", "european union public license"], "eupl 1 2"),
    ("odbl", "open database", ["open data commons open database license", "open database license"], "odbl 1 0"),
    ("odc-by", "open data commons", ["open data commons attribution license"], "odc by 1 0"),
    ("ms-pl", "microsoft", ["microsoft public license"], "ms pl"),
    ("ms-rl", "microsoft", ["microsoft reciprocal license"], "ms rl"),
    ("ncsa", "ncsa", ["university of illinois ncsa open source license", "ncsa open source license"], "ncsa"),
    ("openssl", "openssl", ["openssl license"], "openssl"),
    ("cecill-2.1", "cecill", ["cecill free software license agreement", "cecill v2 1", "cecill license"], "cecill 2 1"),
    ("elastic-2", "elastic", ["elastic license 2 0", "elastic license"], "elastic 2 0"),
    ("sspl-1", "server side", ["server side public license version 1", "server side public license"], "sspl 1 0"),
    ("busl-1.1", "business source", ["business source license 1 1", "business source license"], "busl 1 1"),
    ("cc0", "cc0", ["cc0 1 0 universal", "cc0 1 0", "cc0"], "cc0 1 0"),
    ("cc0", "creative commons zero", ["creative commons zero v1 0 universal", "creative commons zero"], "cc0 1 0"),
    ("cc-by-nc-sa", "cc by nc sa", ["cc by nc sa [1-4] [05]", "cc by nc sa"], "cc by nc sa [1-4] [05]"),
    ("cc-by-nc-nd", "cc by nc nd", ["cc by nc nd [1-4] [05]", "cc by nc nd"], "cc by nc nd [1-4] [05]"),
    ("cc-by-nc", "cc by nc", ["cc by nc [1-4] [05]", "cc by nc"], "cc by nc [1-4] [05]"),
    ("cc-by-sa", "cc by sa", ["cc by sa [1-4] [05]", "cc by sa"], "cc by sa [1-4] [05]"),
    ("cc-by-nd", "cc by nd", ["cc by nd [1-4] [05]", "cc by nd"], "cc by nd [1-4] [05]"),
    ("cc-by", "cc by", ["cc by [1-4] [05]"], "cc by [1-4] [05]"),
    ("cc-by-nc-sa", "noncommercial", ["creative commons attribution noncommercial sharealike(?: [1-4] [05])?(?: international| unported)?"], "cc by nc sa 4 0"),
    ("cc-by-nc-nd", "noncommercial", ["creative commons attribution noncommercial noderiv(?:s|atives)(?: [1-4] [05])?(?: international| unported)?"], "cc by nc nd 4 0"),
    ("cc-by-nc", "noncommercial", ["creative commons attribution noncommercial(?: [1-4] [05])?(?: international| unported)?"], "cc by nc 4 0"),
    ("cc-by-sa", "sharealike", ["creative commons attribution sharealike(?: [1-4] [05])?(?: international| unported)?"], "cc by sa 4 0"),
    ("cc-by-nd", "noderiv", ["creative commons attribution noderiv(?:s|atives)(?: [1-4] [05])?(?: international| unported)?"], "cc by nd 4 0"),
    ("cc-by", "creative commons attribution", ["creative commons attribution(?: [1-4] [05])?(?: international| unported)?"], "cc by 4 0"),
]
#: Sentences of license texts: label, keyword, words (fixed values).
SENTENCES = [
    ("mit", "hereby granted", "permission is hereby granted free of charge to any person obtaining a copy of this software"),
    ("isc", "with or without fee", "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted"),
    ("bsd", "redistribution", "redistribution and use in source and binary forms with or without modification are permitted"),
    ("bsd-3", "endorse", "neither the name of .{1,80} nor the names of its contributors may be used to endorse or promote products"),
    ("bsd-4", "acknowledgement", "all advertising materials mentioning features or use of this software must display the following acknowledgement"),
    ("zlib", "as is", "this software is provided as is without any express or implied warranty in no event will the authors be held liable"),
    ("bsl-1", "machine executable", "all derivative works of the software unless such copies or derivative works are solely in the form of machine executable object code"),
    ("apache-2", "apache", "you may not use this file except in compliance with the license .{0,120}apache org licenses license 2 0"),
    ("gpl", "redistribute it", "you can redistribute it and or modify it under the terms of the gnu general public license"),
    ("lgpl", "redistribute it", "you can redistribute it and or modify it under the terms of the gnu lesser general public license"),
    ("agpl-3", "redistribute it", "you can redistribute it and or modify it under the terms of the gnu affero general public license"),
    ("mpl-2", "mozilla", "this source code form is subject to the terms of the mozilla public license v 2 0"),
    ("unlicense", "public domain", "this is free and unencumbered software released into the public domain"),
    ("wtfpl", "everyone is permitted", "everyone is permitted to copy and distribute verbatim or modified copies of this license document"),
    ("public-domain", "public domain", "(?:released|placed|dedicated|is) (?:in|into|to) the public domain"),
    ("proprietary", "rights reserved", "all rights reserved"),
    ("proprietary", "proprietary", "proprietary and confidential"),
    ("proprietary", "permission", "(?:may not be|no part .{0,60} may be) reproduced .{0,80}without .{0,40}permission"),
    ("mit", "substantial portions", "the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software"),
    ("mit", "noninfringement", "merchantability fitness for a particular purpose and noninfringement in no event shall the authors or copyright holders be liable"),
    ("x11", "x consortium", "the name of the x consortium shall not be used in advertising or otherwise"),
    ("isc", "appear in all copies", "provided that the above copyright notice and this permission notice appear in all copies"),
    ("isc", "tortious action", "whether in an action of contract negligence or other tortious action arising out of or in connection with the use or performance of this software"),
    ("postgresql", "written agreement", "permission to use copy modify and distribute this software and its documentation for any purpose without fee and without a written agreement is hereby granted"),
    ("hpnd", "supporting documentation", "both that copyright notice and this permission notice appear in supporting documentation"),
    ("bsd", "redistributions of source", "redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer"),
    ("bsd", "binary form", "redistributions in binary form must reproduce the above copyright notice this list of conditions and the following disclaimer in the documentation"),
    ("bsd", "regents of the university", "copyright .{0,40}the regents of the university of california"),
    ("bsd-3", "endorse", "the names? of the (?:author|authors|copyright holder|copyright holders) may not be used to endorse or promote products derived from this software without specific prior written permission"),
    ("bsd", "by the copyright holders", "this software is provided by the copyright holders and contributors as is and any express or implied warranties"),
    ("ncsa", "university of illinois", "university of illinois .{0,60}may be used to endorse or promote products"),
    ("openssl", "openssl toolkit", "this product includes software developed by the openssl project for use in the openssl toolkit"),
    ("apache-2", "agreed to in writing", "unless required by applicable law or agreed to in writing software distributed under the license is distributed on an as is basis"),
    ("apache-2", "use reproduction and distribution", "terms and conditions for use reproduction and distribution"),
    ("apache-2", "each contributor", "each contributor hereby grants to you a perpetual worldwide non exclusive no charge royalty free irrevocable (?:copyright|patent|except)"),
    ("apache-1.1", "apache software foundation", "this product includes software developed by the apache software foundation"),
    ("gpl", "at your option any later", "either version [23](?: 0)? of the license or at your option any later version"),
    ("gpl", "in the hope that", "this (?:program|library|file|package) is distributed in the hope that it will be useful but without any warranty"),
    ("gpl", "a copy of the gnu general", "you should have received a copy of the gnu general public license along with this"),
    ("gpl", "your freedom", "the licenses for most software (?:and other practical works )?are designed to take away your freedom to share and change"),
    ("gpl-2", "applies to any program", "this license applies to any program or other work which contains a notice placed by the copyright holder"),
    ("gpl-3", "kinds of works", "the gnu general public license is a free copyleft license for software and other kinds of works"),
    ("gpl-3", "propagate a work", "to propagate a work means to do anything with it that without permission would make you directly or secondarily liable"),
    ("lgpl", "a copy of the gnu lesser", "you should have received a copy of the gnu lesser general public license along with this"),
    ("lgpl", "gnu library general", "gnu library general public license"),
    ("agpl-3", "a copy of the gnu affero", "you should have received a copy of the gnu affero general public license along with this"),
    ("agpl-3", "network server software", "specifically designed to ensure cooperation with the community in the case of network server software"),
    ("gfdl", "free documentation", "permission is granted to copy distribute and or modify this document under the terms of the gnu free documentation license"),
    ("mpl-1.1", "mozilla", "the contents of this file are subject to the mozilla public license version 1 1"),
    ("mpl-2", "covered software", "covered software is provided under this license on an as is basis without warranty of any kind"),
    ("mpl-2", "secondary licenses", "this source code form is incompatible with secondary licenses as defined by the mozilla public license"),
    ("epl", "accompanying materials", "this program and the accompanying materials are made available under the terms of the eclipse public license"),
    ("epl-1", "accompanying program", "the accompanying program is provided under the terms of this eclipse public license"),
    ("cpl-1", "common public", "common public license(?: version 1 0| v1 0| 1 0)?"),
    ("ipl-1", "ibm public", "ibm public license(?: version 1 0| v1 0| 1 0)?"),
    ("cddl", "common development", "subject to the terms of the common development and distribution license"),
    ("zlib", "altered source", "altered source versions must be plainly marked as such and must not be misrepresented as being the original software"),
    ("zlib", "claim that you wrote", "must not be misrepresented you must not claim that you wrote the original software"),
    ("bsl-1", "person or organization", "permission is hereby granted free of charge to any person or organization obtaining a copy of the software and accompanying documentation"),
    ("unlicense", "copyright interest", "the author or authors of this software dedicate any and all copyright interest in the software to the public domain"),
    ("unlicense", "detriment of our heirs", "we make this dedication for the benefit of the public at large and to the detriment of our heirs"),
    ("wtfpl", "you want to public", "do what the .{1,8} you want to public license"),
    ("beerware", "beer ware", "the beer ware license"),
    ("json", "good not evil", "the software shall be used for good not evil"),
    ("perl", "same terms as perl", "you can redistribute it and or modify it under the same terms as perl itself"),
    ("artistic-1", "artistic", "redistribute it and or modify it under the terms of the artistic license"),
    ("python-2", "psf hereby grants", "psf hereby grants licensee a nonexclusive royalty free world wide license to reproduce"),
    ("php-3", "php license", "php license(?: version)? 3 01?"),
    ("ruby", "ruby license", "ruby license"),
    ("ftl", "freetype project", "portions of this software are copyright .{0,40}the freetype project"),
    ("ofl-1.1", "font software", "permission is hereby granted free of charge to any person obtaining a copy of the font software"),
    ("ofl-1.1", "sil open font", "this font software is licensed under the sil open font license"),
    ("eupl-1.2", "eupl", "licensed under the eupl"),
    ("cecill-2.1", "cecill", "governed by the cecill(?: b| c)? license under french law"),
    ("odbl", "database contents", "any rights in individual contents of the database are licensed under the database contents license"),
    ("busl-1.1", "non production use", "the licensor hereby grants you the right to copy modify create derivative works redistribute and make non production use of the licensed work"),
    ("busl-1.1", "change date", "effective on the change date .{0,160}change license"),
    ("commons-clause", "commons clause", "commons clause license condition"),
    ("polyform-noncommercial", "polyform noncommercial", "polyform noncommercial license"),
    ("oracle-bcl", "binary code license", "binary code license agreement"),
    ("ms-eula", "software license terms", "microsoft software license terms"),
    ("cc0", "unconditionally waives", "overtly fully permanently irrevocably and unconditionally waives .{0,60}copyright"),
    ("cc0", "dedicated the work", "has dedicated the work to the public domain by waiving all of his or her rights"),
    ("cc-by", "appropriate credit", "you must give appropriate credit provide a link to the license and indicate if changes were made"),
    ("cc-by-sa", "same license as the original", "you must distribute your contributions under the same license as the original"),
    ("cc-by-nc", "material for commercial", "you may not use the material for commercial purposes"),
    ("cc-by-nd", "the modified material", "if you remix transform or build upon the material you may not distribute the modified material"),
    ("cc", "this creative commons", "you accept and agree to be bound by the terms and conditions of this creative commons"),
    ("cc", "a creative commons", "licensed under a creative commons license"),
    ("cc-by-sa", "weitergabe unter gleichen", "creative commons namensnennung weitergabe unter gleichen bedingungen"),
    ("gpl", "licence publique", "licence publique générale gnu"),
    ("gpl", "licencia pública", "licencia pública general de gnu"),
    ("ogl-3", "open government", "open government (?:licence|license)(?: v3 0| version 3 0)?"),
    ("etalab-2", "licence ouverte", "licence ouverte(?: open licence)?(?: version)?(?: 2 0)?"),
    ("crown", "crown copyright", "crown copyright"),
    ("public-domain", "public domain", "this (?:work|file|software|code|text|image|document) is in the public domain"),
    ("public-domain", "united states government", "work of the united states government .{0,80}public domain"),
    ("public-domain", "copyright has expired", "copyright has expired"),
    ("public-domain", "no rights reserved", "no rights reserved"),
    ("public-domain", "disclaims copyright", "the author disclaims copyright to this source code"),
    ("proprietary", "proprietary information", "(?:contains|is) (?:the )?(?:confidential and )?proprietary information"),
    ("proprietary", "unauthorized copying", "unauthorized copying of this file via any medium is strictly prohibited"),
    ("proprietary", "unpublished rights", "unpublished rights reserved under the copyright laws"),
    ("proprietary", "for redistribution", "not for (?:resale or )?redistribution"),
    ("proprietary", "trade secret", "trade secrets? .{0,60}proprietary"),
    ("proprietary", "alle rechte", "alle rechte vorbehalten"),
    ("proprietary", "tous droits", "tous droits réservés"),
    ("proprietary", "todos los derechos", "todos los derechos reservados"),
    ("educational", "permission is", "permission is (?:hereby )?granted for (?:personal|educational|noncommercial|non commercial|classroom) use"),
]
GIVEN = "(?:licensed|released|distributed|available|provided|published|offered|covered|shared)"


@dataclass(frozen=True)
class Rule:
    label: str
    keyword: str
    pattern: str
    priority: int


def rules() -> list[Rule]:
    """All rules in order: license sentences and grants, identifiers, full names, references, bare names."""
    out = [Rule(label, keyword, words, 1) for label, keyword, words in SENTENCES]
    for label, family, names, spdx in FAMILIES:
        for name in names:
            keyword = family if family in name else name  # a rule is tried only where its keyword is, so each match must have it
            out.append(Rule(label, keyword, f"{GIVEN} (?:under|by|with|through)(?: the)?(?: terms(?: and conditions)? of)?(?: the| an?)? {name}(?: or(?: at your option)? any later version)?", 1))
            out.append(Rule(label, keyword, f"(?:see|under|per|of|by) (?:the|an?) {name}", 3))
            out.append(Rule(label, keyword, name, 2 if len(name.split()) > 2 else 4))
        out.append(Rule(label, spdx.split("(")[0].split("[")[0].strip(), f"spdx license identifier {spdx}", 1))
    return out


def count_of(text: Column, part: str) -> Column:
    return ((F.length(text) - F.length(F.replace(text, F.lit(part), F.lit("")))) / len(part)).cast("long")


def let(value: Column, use) -> Column:
    return F.transform(F.array(value), use)[0]


def normal(text: Column) -> Column:
    """The words, lower-cased (A-Z only), with a space before, between and after them."""
    return F.concat(F.lit(" "), F.array_join(F.regexp_extract_all(F.translate(text, UPPER, LOWER), F.lit(f"{WORD}+"), F.lit(0)), " "), F.lit(" "))


def phrases(words: Column) -> Column:
    """For each base phrase: label, n, first and last (the word where the first and the last of its places begins)."""

    def of(phrase: str, label: str) -> Column:
        # places may share a word boundary, so the space behind a phrase isn't consumed
        def seen(segments: Column) -> Column:
            n = F.size(segments) - 1
            first = count_of(F.element_at(segments, 1), " ")
            last = count_of(words, " ") - count_of(F.element_at(segments, -1), " ") - len(phrase.split())
            return F.struct(F.lit(label).alias("label"), n.cast("long").alias("n"), first.alias("first"), last.alias("last"))

        return let(F.split(words, f" {phrase}(?= )", -1), seen)

    return F.array(*(of(p, label) for p, label in BASE.items()))


def running(values: Column, combine) -> Column:
    """All values up to and with each, combined (from zero). What an aggregation carries is copied at each step, so it is done by blocks, and then over
    their results."""

    def within(block: Column) -> Column:
        begin = F.struct(F.lit(0).alias("now"), F.array().cast("array<int>").alias("all"))
        step = lambda s, x: F.struct(combine(s["now"], x).alias("now"), F.array_append(s["all"], combine(s["now"], x)).alias("all"))
        return F.aggregate(block, begin, step, lambda s: s["all"])

    def over(both: Column) -> Column:
        before = lambda i: F.when(i == 0, 0).otherwise(F.get(both["totals"], i - 1))
        return F.flatten(F.transform(both["blocks"], lambda b, i: F.transform(within(b), lambda x: combine(before(i), x))))

    starts = F.filter(F.sequence(F.lit(1), F.size(values) + 1, F.lit(BLOCK)), lambda i: i <= F.size(values))
    totals = lambda blocks: within(F.transform(blocks, lambda b: F.aggregate(b, F.lit(0), combine)))
    return let(F.transform(starts, lambda i: F.slice(values, i, F.lit(BLOCK))), lambda blocks: let(F.struct(blocks.alias("blocks"), totals(blocks).alias("totals")), over))


def detections(words: Column) -> Column:
    """start, end (in characters of the words' string), priority, rule and label of each match that isn't suppressed."""
    by: dict[str, list[dict]] = {}
    for i, r in enumerate(rules()):
        by.setdefault(r.keyword, []).append({"rule": i, "label": r.label, "pattern": f"(?<= )(?:{r.pattern})(?= )", "priority": r.priority})
    # one literal, which the optimiser folds once, rather than thousands
    table = F.from_json(F.lit(json.dumps([{"keyword": k, "rules": found} for k, found in by.items()])), "array<struct<keyword:string,rules:array<struct<rule:int,label:string,pattern:string,priority:int>>>>")

    def matches(rule: Column) -> Column:
        def placed(found: Column) -> Column:
            lengths = F.transform(found, F.length)
            # what is between the matches and what they take, in turn, up to each match's end
            taken = F.zip_with(F.slice(F.transform(F.split(words, rule["pattern"], -1), F.length), F.lit(1), F.size(found)), lengths, lambda gap, own: gap + own)
            ends = let(taken, lambda t: running(t, lambda a, x: a + x))
            return F.zip_with(ends, lengths, lambda end, n: F.struct((end - n).alias("start"), end.alias("end"), rule["priority"].alias("priority"), rule["rule"].alias("rule"), rule["label"].alias("label")))

        return let(F.regexp_extract_all(words, rule["pattern"], F.lit(0)), placed)

    tried = F.flatten(F.transform(F.filter(table, lambda g: F.contains(words, g["keyword"])), lambda g: g["rules"]))
    every = F.flatten(F.transform(tried, matches))
    # sorted so that whatever can suppress a match is before it
    key = lambda d: F.struct(d["start"].alias("start"), (-d["end"]).alias("minus_end"), d["priority"].alias("priority"), d["rule"].alias("rule"), d["label"].alias("label"))
    ordered = F.array_sort(F.transform(every, key))
    end = lambda d: -d["minus_end"]

    def left(ordered: Column) -> Column:
        ends = lambda p: F.transform(ordered, lambda d: F.when(d["priority"] <= p, end(d)).otherwise(0))
        furthest = F.struct(*(let(ends(p), lambda v: running(v, lambda a, x: F.greatest(a, x))).alias(f"p{p}") for p in SURE))

        def kept(far: Column) -> Column:
            before = lambda d, i: F.when(i == 0, 0).otherwise(F.coalesce(*(F.when(d["priority"] == p, F.get(far[f"p{p}"], i - 1)) for p in SURE)))
            own = lambda d: F.struct(d["start"].alias("start"), end(d).alias("end"), d["priority"].alias("priority"), d["rule"].alias("rule"), d["label"].alias("label"))
            return F.filter(F.transform(ordered, lambda d, i: F.when(before(d, i) < end(d), own(d))), lambda d: d.isNotNull())

        return let(furthest, kept)

    return let(ordered, left)


def scan(docs: DataFrame, text: str = "text") -> DataFrame:
    """row (a struct of all columns of docs), n_words, base (a struct for each phrase) and found (the detections), the last two null where
    no rule can match."""
    rows = docs.select(F.struct("*").alias("row"), F.explode(F.array(F.coalesce(F.col(text).cast("string"), F.lit("")))).alias("whole"))
    low = F.lower("whole")
    possible = [F.contains(F.col("low"), F.lit(x)) for x in STEMS] + [F.contains(F.col("low"), F.lit(first)) & F.col("low").rlike(pattern) for first, pattern in STEM_WORDS]
    # lower-cased once, and matched once, whatever is read of the results
    rows = rows.select("row", "whole", F.explode(F.array(low)).alias("low")).select("row", "whole", reduce(lambda a, b: a | b, possible).alias("possible"))
    seen = F.when(F.col("possible"), let(normal(F.col("whole")), lambda w: F.struct(phrases(w).alias("base"), detections(w).alias("found"))))
    rows = rows.select("row", F.regexp_count("whole", F.lit(f"{WORD}+")).cast("long").alias("n_words"), F.explode(F.array(seen)).alias("seen"))
    return rows.select("row", "n_words", "seen.base", "seen.found")


def digested(scanned: DataFrame, key: str = "doc_id") -> DataFrame:
    """key, n_words, n_base, first_word, last_word, base_labels, labels and score; and n_found, the detections left."""
    base = F.filter(F.coalesce("base", F.array().cast("array<struct<label:string,n:bigint,first:bigint,last:bigint>>")), lambda b: b["n"] > 0)
    rows = scanned.select(F.col("row")[key].alias("key"), "n_words", base.alias("base"), F.coalesce("found", F.array().cast(FOUND)).alias("found"))
    own, more = F.transform("base", lambda b: b["label"]), F.transform("found", lambda d: d["label"])
    joined = lambda labels: F.array_join(F.array_sort(F.array_distinct(labels)), ",")
    sure = F.transform("found", lambda d: F.element_at(F.create_map(*(F.lit(x) for kv in SURE.items() for x in kv)), d["priority"]))
    score = F.greatest(F.when(F.size("base") > 0, SURE[2]).otherwise(0.0), F.coalesce(F.array_max(sure), F.lit(0.0)))
    return rows.select(
        F.col("key").alias(key), "n_words", F.aggregate("base", F.lit(0).cast("long"), lambda a, b: a + b["n"]).alias("n_base"),
        F.array_min(F.transform("base", lambda b: b["first"])).alias("first_word"), F.array_max(F.transform("base", lambda b: b["last"])).alias("last_word"),
        joined(own).alias("base_labels"), joined(F.concat(own, more)).alias("labels"), score.alias("score"), F.size("found").cast("long").alias("n_found"),
    )


_PLACES = ", ".join(f"list_transform(list_filter(range(len(w)), lambda i: w[i + 1 : i + {len(p.split())}] = {p.split()!r}), lambda i: {{'i': i, 'label': '{label}'}})" for p, label in BASE.items())
#: The base columns; what the rules find isn't SQL.
BASE_SQL = f"""
WITH words AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS w FROM documents),
found AS (SELECT doc_id, w, flatten(list_value({_PLACES})) AS f FROM words)
SELECT doc_id, len(w)::BIGINT AS n_words, len(f)::BIGINT AS n_base, list_min(list_transform(f, lambda x: x.i))::BIGINT AS first_word, list_max(list_transform(f, lambda x: x.i))::BIGINT AS last_word, array_to_string(list_sort(list_distinct(list_transform(f, lambda x: x.label))), ',') AS base_labels FROM found
"""
