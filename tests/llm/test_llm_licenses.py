"""License scan against a plain-Python model."""

import re

import pytest

from tapestry.llm.license_rules import PHRASES, RULES
from tapestry.llm.licenses import COVERED, WEIGHT, license_scan, parse_rules

TEXTS = [
    "Released under the MIT License.", "Licensed under the Apache License, Version 2.0.\nLicensed under the Apache License, Version 2.0.",
    "This work is licensed under the GNU General Public License, version 3. MIT license mit LICENSE license", "Licensed under CC BY-NC 4.0.",
    None, "", "  \n\t ", "no words of that kind é ü", "limit license mit licensed élicense", "mit license " * 300 + "general public license",
    "SPDX-License-Identifier: GPL-2.0-or-later", "Copyright (c) 2020 X. All rights reserved. Public domain; CC0 1.0 Universal",
    "GNU Lesser General Public License v2.1 and the GNU Affero General Public License", "the\x01mit\x02license $0 \\1 apache license",
    "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files",
    "x " * 5000 + "Mozilla Public License 2.0",
]


def model(text):
    low = (text or "").translate({c: c + 32 for c in range(65, 91)})
    words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", low)
    norm = " ".join(words)
    places, base = [], set()
    for phrase, label in PHRASES:
        p = phrase.split()
        at = [i for i in range(len(words)) if words[i : i + len(p)] == p]
        places += at
        base |= {label} if at else set()
    found = []
    for r in parse_rules(RULES):
        for m in re.finditer(r["regex"], norm):
            start = norm[: m.start()].count(" ")
            found.append((start, start + m.group().count(" ") + 1, r["level"], r["rule"], r["label"]))

    def beats(e, d):
        holds = e[0] <= d[0] and e[1] >= d[1]
        wider = e[1] - e[0] > d[1] - d[0]
        return holds and (e[2] < d[2] or e[2] == d[2] and (wider or e[3] < d[3]))

    kept = [d for d in found if not any(beats(e, d) for e in found)]
    covered = len({i for d in kept for i in range(d[0], d[1])})
    score = (WEIGHT[min(d[2] for d in kept)] if kept else 0.0) + (COVERED * covered / len(words) if words else 0.0)
    return (len(words), len(places), min(places, default=None), max(places, default=None), ",".join(sorted(base)),
            ",".join(sorted(base | {d[4] for d in kept})), pytest.approx(score), len(kept))


def test_rules_are_ordered_and_many():
    rules = parse_rules(RULES)
    assert len(rules) >= 200 and [r["rule"] for r in rules] == list(range(len(rules)))


@pytest.mark.parametrize("cut", [slice(0, 8), slice(8, None)])
def test_against_model(spark, cut):
    texts = TEXTS[cut]
    docs = spark.createDataFrame([(i, t, "x") for i, t in enumerate(texts)], "doc_id long, text string, score string")
    rows = {r["doc_id"]: tuple(r)[1:] for r in license_scan(docs).collect()}
    for i, t in enumerate(texts):
        assert rows[i] == model(t), t


def forms(tree):
    """Every text that a parsed regex can match; of a wide class or a repeat, its ends."""
    out = {""}
    for op, arg in tree:
        name = str(op)
        if name == "LITERAL":
            ways = {chr(arg)}
        elif name == "IN":
            ways = {chr(c) for kind, x in arg for c in ((x,) if str(kind) == "LITERAL" else x)}
        elif name == "ANY":
            ways = {"x"}
        elif name == "SUBPATTERN":
            ways = forms(arg[-1])
        elif name == "BRANCH":
            ways = set().union(*map(forms, arg[1]))
        elif name in ("MAX_REPEAT", "MIN_REPEAT"):
            one = forms(arg[2])
            ways = {w * n for w in one for n in {arg[0], min(arg[1], arg[0] + 1)}}
        elif name == "ASSERT_NOT":
            ways = {""}
        else:
            raise ValueError(name)
        out = {a + b for a in out for b in ways}
    return out


def test_every_form_holds_its_keyword():
    for r in parse_rules(RULES):
        missing = [f for f in forms(re._parser.parse(r["regex"])) if r["keyword"] not in f.split(" ")]
        assert not missing, (r["keyword"], missing[:3])


def test_licence_agreement(spark):
    texts = ["this licence agreement binds", "the End User Licence Agreement.", "a license agreement", "an agreement"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    rows = {r["doc_id"]: tuple(r)[1:] for r in license_scan(docs).collect()}
    assert [rows[i] for i in range(4)] == [model(t) for t in texts] and "licence" in rows[0][5] and "licence" not in rows[3][5]


def test_given_documents(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    rows = {r["doc_id"]: tuple(r)[1:] for r in license_scan(docs).collect()}
    for r in docs.collect():
        assert rows[r["doc_id"]] == model(r["text"])


def test_empty_table_and_repeated_rows(spark):
    empty = spark.createDataFrame([], "doc_id long, text string")
    assert license_scan(empty).collect() == []
    twice = spark.createDataFrame([(None, "mit license")] * 2, "doc_id long, text string")
    assert len(license_scan(twice).collect()) == 2
