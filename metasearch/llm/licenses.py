"""License scan with ordered signature rules, in SQL expressions only.

A text becomes its words, lower-cased, joined by one space. Rules (hundreds of regular expressions over that form: names, grants and tags of license
families, and sentences of license texts, file headers and addresses) have keywords: one for
each name they take, or the words they begin with. A rule runs only on texts that have one of its keywords, and a text without any gate runs none. Detections are word spans. Rules
carry a priority: a span contained in a span of the same or a higher priority is suppressed (of equal spans the earlier rule's stays),
while partial overlaps all stay.

Defined results: a null or wordless text has no words, places or labels and score 0; repeated rows are scanned each for itself; an
empty table gives no rows; columns other than doc_id and text are ignored.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Everything that separates words.
GAP = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
#: The base phrases and their labels.
BASE = {
    "gnu general public license": "gpl",
    "apache license": "apache",
    "cc by": "cc-by",
    "mit license": "mit",
}
#: License families as (label, full name, short names, versions). Names are words without signs, so that each stands in what its rule matches.
FAMILIES = [
    ("agpl", "gnu affero general public license", "affero gpl|affero general public license", "1 0|3 0|3"),
    ("agpl", "agpl", "gnu agpl", "1 0|3 0|3"),
    ("lgpl", "gnu lesser general public license", "lesser general public license", "2 1|3 0|3"),
    ("lgpl", "lgpl", "gnu lgpl", "2 0|2 1|2|3 0|3"),
    ("lgpl", "gnu library general public license", "library general public license", "2 0|2"),
    ("gpl", "gnu general public license", "gnu gpl", "1 0|1|2 0|2|3 0|3"),
    ("gpl", "gpl", "gplv", "1 0|1|2 0|2|3 0|3"),
    ("gfdl", "gnu free documentation license", "free documentation license", "1 1|1 2|1 3"),
    ("apache", "apache license", "apache software license|asl", "1 0|1 1|2 0|2"),
    ("mit", "mit license", "mit licence|mit expat license|expat license", "0"),
    ("x11", "x11 license", "mit x11", "0"),
    ("bsd", "bsd license", "bsd licence|bsd style license|berkeley software distribution", "2 clause|3 clause|4 clause"),
    ("isc", "isc license", "isc licence|internet systems consortium license", "0"),
    ("mpl", "mozilla public license", "mozilla public licence", "1 0|1 1|2 0|2"),
    ("mpl", "mpl", "mozilla mpl", "1 0|1 1|2 0|2"),
    ("epl", "eclipse public license", "eclipse public licence", "1 0|2 0"),
    ("edl", "eclipse distribution license", "eclipse distribution licence", "1 0"),
    ("cddl", "cddl", "sun cddl", "1 0|1 1"),
    ("cddl", "common development and distribution license", "common development distribution license", "1 0|1 1"),
    ("cpl", "common public license", "ibm common public license", "1 0"),
    ("ipl", "ibm public license", "ibm public licence", "1 0"),
    ("eupl", "eupl", "eu pl", "1 0|1 1|1 2"),
    ("eupl", "european union public licence", "european union public license", "1 0|1 1|1 2"),
    ("artistic", "artistic license", "artistic licence|perl artistic", "1 0|2 0"),
    ("zlib", "zlib license", "zlib libpng license", "0"),
    ("libpng", "libpng license", "png reference library license", "2"),
    ("boost", "boost software license", "boost license", "1 0"),
    ("unlicense", "the unlicense", "unlicense", "0"),
    ("wtfpl", "wtfpl", "do what the fuck you want to public license", "2"),
    ("python", "python software foundation license", "psf license|python license", "2|2 0"),
    ("php", "php license", "php licence", "3 0|3 01"),
    ("ruby", "ruby license", "ruby licence", "0"),
    ("perl", "perl license", "same terms as perl itself", "5"),
    ("openssl", "openssl license", "openssl ssleay license", "1 0"),
    ("postgresql", "postgresql license", "postgresql licence", "0"),
    ("ofl", "sil open font license", "sil ofl", "1 0|1 1"),
    ("ofl", "open font license", "open font licence", "1 0|1 1"),
    ("ms-pl", "microsoft public license", "ms public license", "1 0"),
    ("ms-rl", "microsoft reciprocal license", "ms reciprocal license", "1 0"),
    ("ncsa", "ncsa open source license", "university of illinois ncsa", "0"),
    ("ecl", "educational community license", "educational community licence", "1 0|2 0"),
    ("afl", "academic free license", "academic free licence", "1 1|2 0|2 1|3 0"),
    ("osl", "open software license", "osl", "1 0|2 0|2 1|3 0"),
    ("vim", "vim license", "vim licence", "0"),
    ("w3c", "w3c software notice and license", "w3c license", "0"),
    ("zpl", "zope public license", "zope public licence", "1 1|2 0|2 1"),
    ("qpl", "q public license", "qt public license", "1 0"),
    ("npl", "netscape public license", "netscape public licence", "1 0|1 1"),
    ("sissl", "sun industry standards source license", "sun industry standards license", "1 1|1 2"),
    ("upl", "universal permissive license", "universal permissive licence", "1 0"),
    ("odbl", "open database license", "odc odbl", "1 0"),
    ("odc-by", "open data commons attribution license", "odc by", "1 0"),
    ("pddl", "open data commons public domain dedication and license", "odc pddl", "1 0"),
    ("cc0", "cc0", "creative commons zero|creative commons cc0", "1 0"),
    ("cc-by-nc-nd", "cc by nc nd", "creative commons attribution noncommercial noderivatives", "2 0|2 5|3 0|4 0"),
    ("cc-by-nc-sa", "cc by nc sa", "creative commons attribution noncommercial sharealike", "2 0|2 5|3 0|4 0"),
    ("cc-by-nc", "cc by nc", "creative commons by nc", "2 0|2 5|3 0|4 0"),
    ("cc-by-nd", "cc by nd", "creative commons by nd", "2 0|2 5|3 0|4 0"),
    ("cc-by-sa", "cc by sa", "creative commons by sa", "2 0|2 5|3 0|4 0"),
    ("cc-by", "cc by", "creative commons by", "2 0|2 5|3 0|4 0"),
    ("cc-by", "creative commons attribution", "creative commons attribution license", "2 0|2 5|3 0|4 0"),
    ("proprietary", "all rights reserved", "proprietary and confidential", "0"),
    ("public-domain", "public domain", "released into the public domain|dedicated to the public domain", "0"),
]
#: Sentences of license texts, headers and addresses, as (label, pattern). Each begins with plain words, its keyword.
SENTENCES = [
    ("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files"),
    ("mit", "the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software"),
    ("x11", "except as contained in this notice the name of the x consortium shall not be used in advertising"),
    ("bsd", "redistribution and use in source and binary forms with or without modification are permitted"),
    ("bsd", "redistributions of source code must retain the above copyright notice(?: this list of conditions)?"),
    ("bsd", "redistributions in binary form must reproduce the above copyright notice(?: this list of conditions)?"),
    ("bsd", "neither the name of(?: [^ ]+){1,12} may be used to endorse or promote products derived from this software"),
    ("bsd", "all advertising materials mentioning features or use of this software must display the following acknowledge?ment"),
    ("isc", "permission to use copy modify and(?: or)? distribute this software for any purpose with or without fee is hereby granted"),
    ("postgresql", "permission to use copy modify and distribute this software and its documentation for any purpose without fee and without a written agreement is hereby granted"),
    ("ncsa", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal with the software without restriction"),
    ("boost", "permission is hereby granted free of charge to any person or organization obtaining a copy of the software and accompanying documentation"),
    ("apache", "you may not use this file except in compliance with the license"),
    ("apache", "you may not use this work except in compliance with the license"),
    ("apache", "you may not use this software except in compliance with the license"),
    ("apache", "unless required by applicable law or agreed to in writing software distributed under the license is distributed on an as is basis"),
    ("apache", "licensed to the apache software foundation asf under one or more contributor license agreements"),
    ("gpl", "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license"),
    ("gpl", "you should have received a copy of the gnu general public license along with"),
    ("gpl", "this file is part of(?: [^ ]+){1,6} which is released under the gnu general public license"),
    ("lgpl", "this library is free software you can redistribute it and or modify it under the terms of the gnu (?:lesser|library) general public license"),
    ("lgpl", "you should have received a copy of the gnu lesser general public license along with"),
    ("lgpl", "you should have received a copy of the gnu library general public license along with"),
    ("agpl", "this program is free software you can redistribute it and or modify it under the terms of the gnu affero general public license"),
    ("agpl", "you should have received a copy of the gnu affero general public license along with"),
    ("gfdl", "permission is granted to copy distribute and or modify this document under the terms of the gnu free documentation license"),
    ("mpl", "this source code form is subject to the terms of the mozilla public license"),
    ("mpl", "the contents of this file are subject to the mozilla public license"),
    ("npl", "the contents of this file are subject to the netscape public license"),
    ("cddl", "the contents of this file are subject to the terms of the common development and distribution license"),
    ("epl", "this program and the accompanying materials are made available under the terms of the eclipse public license"),
    ("cpl", "this program and the accompanying materials are made available under the terms of the common public license"),
    ("eupl", "licensed under the eupl(?: version)? 1 [0-2]"),
    ("zlib", "this software is provided as is without any express or implied warranty in no event will the authors be held liable for any damages arising from the use of this software"),
    ("zlib", "altered source versions must be plainly marked as such and must not be misrepresented as being the original software"),
    ("unlicense", "this is free and unencumbered software released into the public domain"),
    ("wtfpl", "everyone is permitted to copy and distribute verbatim or modified copies of this license document and changing it is allowed as long as the name is changed"),
    ("cc0", "to the extent possible under law(?: [^ ]+){1,20} waived all copyright and related or neighboring rights"),
    ("artistic", "the intent of this document is to state the conditions under which a package may be copied"),
    ("perl", "this library is free software you can redistribute it and or modify it under the same terms as perl itself"),
    ("python", "this license agreement is between the python software foundation"),
    ("php", "this product includes php software freely available from"),
    ("openssl", "this product includes software developed by the openssl project"),
    ("openssl", "this product includes cryptographic software written by eric young"),
    ("ofl", "this font software is licensed under the sil open font license"),
    ("ms-pl", "this license governs use of the accompanying software if you use the software you accept this license"),
    ("w3c", "by obtaining using and or copying this work you the licensee agree that you have read understood and will comply with the following terms"),
    ("odbl", "any rights in individual contents of the database are licensed under the database contents license"),
    ("pddl", "is made available under the public domain dedication and license"),
    ("proprietary", "unauthorized copying of this file via any medium is strictly prohibited"),
    ("proprietary", "this software is the confidential and proprietary information of"),
    ("apache", "apache org licenses license 2 0"),
    ("mit", "opensource org licenses mit"),
    ("bsd", "opensource org licenses bsd"),
    ("apache", "opensource org licenses apache"),
    ("gpl", "opensource org licenses gpl"),
    ("isc", "opensource org licenses isc"),
    ("gpl", "gnu org licenses (?:old licenses )?gpl"),
    ("lgpl", "gnu org licenses (?:old licenses )?lgpl"),
    ("agpl", "gnu org licenses agpl"),
    ("gfdl", "gnu org licenses fdl"),
    ("mpl", "mozilla org (?:en us )?mpl"),
    ("epl", "eclipse org legal epl"),
    ("boost", "boost org license 1 0"),
    ("unlicense", "unlicense org"),
    ("cc0", "creativecommons org publicdomain zero"),
    ("public-domain", "creativecommons org publicdomain mark"),
    ("cc-by-nc-nd", "creativecommons org licenses by nc nd"),
    ("cc-by-nc-sa", "creativecommons org licenses by nc sa"),
    ("cc-by-nc", "creativecommons org licenses by nc"),
    ("cc-by-nd", "creativecommons org licenses by nd"),
    ("cc-by-sa", "creativecommons org licenses by sa"),
    ("cc-by", "creativecommons org licenses by"),
    ("odbl", "opendatacommons org licenses odbl"),
    ("odc-by", "opendatacommons org licenses by"),
    ("pddl", "opendatacommons org licenses pddl"),
]
#: A detection's confidence by priority: an SPDX tag, a grant or a sentence of the license, a name with its version, a full name, a short name.
CONFIDENCE = {5: 1.0, 4: 0.95, 3: 0.9, 2: 0.8, 1: 0.5}
GRANT = "(?:licensed|released|distributed|available|published|provided|covered) (?:under|by|with) (?:the )?(?:terms (?:and conditions )?of (?:the )?)?(?:a )?"
#: A text can only have a detection if it has one of these: each name has one, whatever follows it.
GATES = ["licen", " cc ", " cc0", "creative commons", "public domain", "rights reserved", "proprietary", "gpl", "spdx", "wtfpl", " mpl", " cddl", " eupl", " eu pl", " asl", " osl", "mit x11", "odc ", "berkeley software", "university of illinois", "same terms as perl", "perl artistic", "sil ofl", "hereby granted",
         "above copyright notice", "redistribution and use", "as contained in this notice", "neither the name of", "advertising materials", "agreed to in writing", "free software", "possible under law",
         "express or implied warranty", "altered source versions", "intent of this document", "this product includes", "agree that you", "individual contents of", "unauthorized copying", "opensource org",
         "creativecommons org", "opendatacommons org", "gnu org", "mozilla org", "eclipse org", "this file are subject", "available under the terms", "permission is granted", "permission to use copy modify", "this file is part of"]


def signatures() -> list[tuple[int, str, list[str], int, str]]:
    """(order, label, keywords, priority, pattern) of every rule: a text without any of its keywords has no place of the pattern.

    A rule's keywords are its names, or a sentence's first words, each with the space before it. Patterns take one leading space and leave the one that follows.
    """
    found = []
    for label, full, short, versions in FAMILIES:
        names = f"(?:{full}|{short})"
        tag = f"spdx license identifier {label.replace('-', ' ')}"
        either = [full, *short.split("|")]
        versions = "" if versions == "0" else f"(?:,? ?(?:version|v)? ?(?:{versions}))"
        for priority, words, pattern in (
            (5, [tag], f"{tag}(?: (?:[0-9]+|only|or later|clause))*"),
            (4, either, f"{GRANT}{names}{versions + '?' if versions else ''}"),
            (3, either, f"{names}{versions}(?: or (?:any )?later(?: version)?)?" if versions else f"{names} (?:terms|text|notice|below)"),
            (2, [full], full),
            (1, either[1:], f"(?:{short})"),
        ):
            found.append((len(found), label, [f" {w}" for w in words], priority, f" {pattern}(?= )"))
    for label, pattern in SENTENCES:
        # words up to the first that isn't plain
        plain = re.match(r"[a-z0-9 ]*(?= |$|\(\?: )", pattern)[0]
        found.append((len(found), label, [f" {plain}"], 4, f" {pattern}(?= )"))
    return found


def rules() -> list[tuple[int, str, str, int, str]]:
    """(order, label, keyword, priority, pattern) of every rule; the keyword is empty where a rule has several."""
    return [(o, l, words[0] if len(words) == 1 else "", p, x) for o, l, words, p, x in signatures()]


def spaces(s: Column) -> Column:
    return (F.length(s) - F.length(F.replace(s, F.lit(" "), F.lit("")))).cast("long")


def padded(text: Column) -> Column:
    """'x', then each word after a space, then a space: the spaces before a word count the words before it."""
    return F.concat(F.lit("x "), F.ltrim(F.concat(F.rtrim(F.regexp_replace(F.lower(F.coalesce(text, F.lit(""))), GAP, " ")), F.lit(" "))))


def spans(text: Column, pattern: Column | str) -> Column:
    """array<struct(start, end)>: word spans of the pattern's places in a padded text, from left to right without overlap."""
    pattern = F.lit(pattern) if isinstance(pattern, str) else pattern
    pieces, hits = F.split(text, pattern), F.regexp_extract_all(text, pattern, F.lit(0))
    empty = F.array().cast("array<struct<start:bigint,end:bigint>>")
    start = F.struct(F.lit(0).cast("long").alias("at"), empty.alias("out"))

    def step(acc: Column, x: Column) -> Column:
        begin = acc["at"] + spaces(x["p"])
        end = begin + spaces(x["h"])
        return F.struct(end.alias("at"), F.concat(acc["out"], F.array(F.struct(begin.alias("start"), end.alias("end")))).alias("out"))

    pairs = F.filter(F.arrays_zip(pieces.alias("p"), hits.alias("h")), lambda x: x["h"].isNotNull())
    return F.aggregate(pairs, start, step, lambda acc: acc["out"])


def scanned(docs: DataFrame) -> DataFrame:
    """Each row with _padded, n_words and _spans: all rules' detections, by start, longest, priority and rule order."""
    docs = docs.withColumn("_padded", padded(F.col("text"))).withColumn("n_words", spaces(F.col("_padded")) - 1)
    text = F.col("_padded")
    gate = None
    for word in GATES:
        gate = text.contains(word) if gate is None else gate | text.contains(word)
    table = F.array(*[F.struct(F.lit(o).alias("rule"), F.lit(l).alias("label"), F.array(*map(F.lit, words)).alias("words"), F.lit(p).alias("priority"), F.lit(x).alias("pattern")) for o, l, words, p, x in signatures()])
    hit = F.filter(table, lambda r: F.exists(r["words"], lambda w: F.contains(text, w)) & F.regexp_like(text, r["pattern"]))
    found = F.flatten(F.transform(hit, lambda r: F.transform(spans(text, r["pattern"]), lambda s: F.struct(
        s["start"].alias("start"), (-s["end"]).alias("neg_end"), (-r["priority"]).alias("neg_priority"), r["rule"].alias("rule"), r["label"].alias("label")))))
    none = F.array().cast("array<struct<start:bigint,neg_end:bigint,neg_priority:int,rule:int,label:string>>")
    return docs.withColumn("_spans", F.when(gate, F.array_sort(found)).otherwise(none))


def kept(spans_: Column) -> Column:
    """struct(labels, priority): distinct labels of the spans that no earlier span of their priority or above contains; the top priority.

    Spans come by (start, longest, priority): a container always comes before what it contains, and among the spans so far the one
    that ends last contains the next if any does; so one running end a priority is enough.
    """
    levels = sorted(CONFIDENCE)
    start = F.struct(*[F.lit(-1).cast("long").alias(f"e{p}") for p in levels], F.array().cast("array<string>").alias("labels"), F.lit(0).alias("top"))

    def step(acc: Column, s: Column) -> Column:
        end, priority = -s["neg_end"], -s["neg_priority"]
        # e{p} is the last end among spans of priority p or above
        over = F.coalesce(*[F.when(priority == p, acc[f"e{p}"]) for p in levels]) >= end
        new = F.struct(*[F.when(priority >= p, F.greatest(acc[f"e{p}"], end)).otherwise(acc[f"e{p}"]).alias(f"e{p}") for p in levels], F.array_union(acc["labels"], F.array(s["label"])).alias("labels"), F.greatest(acc["top"], priority).alias("top"))
        return F.when(over, acc).otherwise(new)

    return F.aggregate(spans_, start, step, lambda acc: F.struct(acc["labels"].alias("labels"), acc["top"].alias("top")))


def detections(docs: DataFrame) -> DataFrame:
    """One row for each kept detection: doc_id, label, priority, first_word, last_word, rule."""
    levels = sorted(CONFIDENCE)
    one = F.explode(F.filter(F.transform(F.col("_spans"), lambda s, i: F.struct(s.alias("s"), F.forall(
        F.slice(F.col("_spans"), F.lit(1), i), lambda b: ~((b["neg_end"] <= s["neg_end"]) & (b["neg_priority"] <= s["neg_priority"]))).alias("stays"))), lambda x: x["stays"]))
    rows = scanned(docs.select("doc_id", "text")).select("doc_id", one.alias("d"))
    return rows.select("doc_id", F.col("d.s.label").alias("label"), (-F.col("d.s.neg_priority")).alias("priority"), F.col("d.s.start").alias("first_word"), (-F.col("d.s.neg_end") - 1).alias("last_word"), F.col("d.s.rule").alias("rule"))


def license_scan(docs: DataFrame) -> DataFrame:
    """doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score for every row."""
    rows = scanned(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"))
    text = F.col("_padded")
    any_base = f"(?= (?:{'|'.join(BASE)}) )"
    has = None
    for phrase in BASE:
        has = text.contains(f" {phrase} ") if has is None else has | text.contains(f" {phrase} ")
    rows = rows.withColumn("_pieces", F.when(has, F.split(text, any_base))).withColumn("_kept", kept(F.col("_spans")))
    pieces = F.col("_pieces")
    base = F.array_compact(F.array(*[F.when(text.contains(f" {p} "), F.lit(label)) for p, label in sorted(BASE.items(), key=lambda x: x[1])]))
    score = F.when(F.col("_kept.top") == 0, F.when(has, 0.5).otherwise(0.0))
    for p, c in CONFIDENCE.items():
        score = score.when(F.col("_kept.top") == p, c)
    return rows.select(
        "doc_id",
        "n_words",
        F.when(pieces.isNull(), F.lit(0)).otherwise(F.size(pieces) - 1).cast("long").alias("n_base"),
        F.when(pieces.isNotNull(), spaces(pieces[0])).alias("first_word"),
        F.when(pieces.isNotNull(), F.col("n_words") + 1 - spaces(F.element_at(pieces, -1))).alias("last_word"),
        F.array_join(base, ",").alias("base_labels"),
        F.array_join(F.array_sort(F.array_union(base, F.col("_kept.labels"))), ",").alias("labels"),
        score.cast("double").alias("score"),
    )
