import re

from metasearch.llm import licenses
from tests.llm.conftest import table

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
LOW = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def brute_base(text):
    w = WORD.findall((text or "").translate(LOW))
    at = [(i, label) for p, label in licenses.BASE.items() for i in range(len(w)) if w[i : i + len(p.split())] == p.split()]
    return len(w), len(at), min((i for i, _ in at), default=None), max((i for i, _ in at), default=None), ",".join(sorted({x for _, x in at}))


def brute_detections(text):
    """All rules over all texts, then containment, one pair at a time."""
    padded = "x " + "".join(w + " " for w in WORD.findall((text or "").translate(LOW)))
    found = []
    for order, label, word, priority, pattern in licenses.rules():
        if word in padded:
            for m in re.finditer(pattern, padded):
                start = padded[: m.start()].count(" ")
                found.append((start, start + m[0].count(" "), priority, order, label))
    key = lambda d: (d[0], -d[1], -d[2], d[3])
    return [d for d in found if not any(key(e) < key(d) and e[0] <= d[0] and e[1] >= d[1] and e[2] >= d[2] for e in found)]


TEXTS = [
    "Licensed under CC BY-NC 4.0. Released under the MIT License, or GPLv3.",
    "This work is licensed under the GNU General Public License, version 3, or any later version.",
    "SPDX-License-Identifier: apache", "Apache License, Version 2.0", "public domain; all rights reserved", "MIT MIT LICENSE mit license", "the BSD 3-clause license",
]


def test_base_and_method(spark, awkward):
    texts = [*awkward, *TEXTS]
    docs = table(spark, texts)
    got = {r["doc_id"]: r for r in licenses.license_scan(docs).collect()}
    spans = {}
    for r in licenses.detections(docs).collect():
        spans.setdefault(r["doc_id"], set()).add((r["first_word"], r["last_word"] + 1, r["priority"], r["rule"], r["label"]))
    for i, text in enumerate(texts):
        r, want = got[i], brute_base(text)
        assert (r["n_words"], r["n_base"], r["first_word"], r["last_word"], r["base_labels"]) == want
        kept = brute_detections(text)
        assert spans.get(i, set()) == set(kept)
        assert r["labels"] == ",".join(sorted({x for x in want[4].split(",") if x} | {d[4] for d in kept}))
        assert 0 <= r["score"] <= 1 and (r["score"] == 0) == (not kept and not want[1])


NAMED = [
    ("Licensed under the Creative Commons Attribution-NonCommercial-ShareAlike 4.0 License", "cc-by-nc-sa", 0.95), ("Released under the ASL 2.0", "apache", 0.95),
    ("Distributed under the Expat License", "mit", 0.95), ("under MPLv2", "mpl", 0.9), ("see MPL2 for this", "mpl", 0.9), ("EUPLv1.2", "eupl", 0.9), ("CDDLv1.0", "cddl", 0.9),
    ("OSLv3.0", "osl", 0.9), ("ASL2", "apache", 0.9), ("CC0v1.0", "cc0", 0.9), ("EU-PL 1.2", "eupl", 0.9), ("the Perl Artistic 2.0", "artistic", 0.9),
]


def made(pattern, much):
    """A text that the pattern takes."""
    out = re.sub(r"\(\?: \[\^ \]\+\)\{1,\d+\}", " one two three" if much else " one", pattern)
    out = re.sub(r"\(\?:([^()]*)\)\?", r"\1" if much else "", out)
    out = re.sub(r"\(\?:([^()|]*)\|([^()]*)\)", lambda m: m[1] if much else m[2].split("|")[-1], out)
    return re.sub(r"(.)\?", r"\1" if much else "", out.replace("[0-2]", "2"))


NOTICES = {
    "mit": "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software",
    "bsd": "Redistribution and use in source and binary forms, with or without\n# modification, are permitted provided that",
    "apache": "you may not use this file except in compliance with the License.\n * You may obtain a copy",
    "gpl": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published",
    "cc-by-sa": "https://creativecommons.org/licenses/by-sa/4.0/",
    "isc": "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted",
}


def test_license_texts(spark):
    got = {r["doc_id"]: r for r in licenses.license_scan(table(spark, list(NOTICES.values()))).collect()}
    for i, label in enumerate(NOTICES):
        assert label in got[i]["labels"].split(",") and got[i]["score"] == 0.95, (label, got[i])


def test_every_keyword_passes_a_gate():
    """So no gate hides a rule; and each rule's keywords are words that every text it takes begins with or names."""
    for order, label, words, _, pattern in licenses.signatures():
        assert words and all(any(g in f"{w} " for g in licenses.GATES) for w in words), (order, label, words)


def test_no_keyword_or_gate_hides_a_rule(spark):
    """Every name, bare, granted, tagged and with its versions glued or apart: as all rules find it without keywords or gates."""
    texts = [t for t, _, _ in NAMED]
    for label, full, short, versions in licenses.FAMILIES:
        for name in (full, *short.split("|")):
            v = versions.split("|")[-1]
            texts += [f"a {name} b", f"released under the {name} b", f"a {name}v{v} b", f"a {name}{v} b", f"a {name}, version {v} or later", f"a {name} terms"]
        texts.append(f"SPDX-License-Identifier: {label}")
    for label, pattern in licenses.SENTENCES:  # each with what is optional and without it
        texts += [f"a {made(pattern, much)} b" for much in (True, False)]
    got = {r["doc_id"]: r for r in licenses.license_scan(table(spark, texts)).collect()}
    for i, text in enumerate(texts):
        padded = "x " + "".join(w + " " for w in WORD.findall(text.translate(LOW)))
        found = []
        for order, label, _, priority, pattern in licenses.rules():
            for m in re.finditer(pattern, padded):
                start = padded[: m.start()].count(" ")
                found.append((start, -start - m[0].count(" "), -priority, order, label))
        kept = [d for d in found if not any(e < d and e[1] <= d[1] and e[2] <= d[2] for e in found)]
        want = {d[4] for d in kept} | {x for x in brute_base(text)[4].split(",") if x}
        score = max((licenses.CONFIDENCE[-d[2]] for d in kept), default=0.5 if brute_base(text)[1] else 0.0)
        assert (got[i]["labels"], got[i]["score"]) == (",".join(sorted(want)), score), text
    for i, (text, label, score) in enumerate(NAMED):
        assert label in got[i]["labels"].split(",") and got[i]["score"] == score, text


def test_rules_are_ordered_and_plenty():
    rules = licenses.rules()
    assert len(rules) > 380 and [r[0] for r in rules] == list(range(len(rules)))


def test_repeated_rows_ties_and_long_texts(spark):
    """Repeated rows are scanned each; equal spans go to the earlier rule; a text of 40,000 words with a phrase at each end."""
    long = "mit license " + "word " * 40_000 + "apache license"
    got = [tuple(r) for r in licenses.license_scan(table(spark, [(3, "cc by"), (3, "cc by"), (None, "cc by"), (4, long)])).collect()]
    assert sorted(got, key=str)[:2] == [(3, 2, 1, 0, 0, "cc-by", "cc-by", 0.8)] * 2
    assert {r[1:] for r in got if r[0] == 4} == {(40_004, 2, 0, 40_002, "apache,mit", "apache,mit", 0.8)}
    spans = [tuple(r) for r in licenses.detections(table(spark, [(3, "cc by")])).collect()]
    assert len(spans) == 1 and spans[0][1] == "cc-by"


def test_empty(spark):
    assert licenses.license_scan(table(spark, [])).count() == 0
