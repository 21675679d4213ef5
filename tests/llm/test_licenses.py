"""op12 against plain Python, and labels of well-known wordings."""

import re

import pytest

from tablewright.llm import licenses
from tablewright.llm.license_rules import AFTER, BEFORE, compiled
from tablewright.llm.queries import QUERIES

RULES = compiled()
WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
UPPER = {c: c + 32 for c in range(65, 91)}


def brute(text):
    w = WORD.findall((text or "").translate(UPPER))
    found = []
    for r in RULES:
        for p, word in enumerate(w):
            if word == r.keyword:
                around = " " + "".join(x + " " for x in w[max(p - BEFORE, 0) : p]) + "@" + " ".join(w[p : p + AFTER + 1]) + " "
                m = re.search(r.pattern, around)
                if m:
                    start = p - (m[0].split("@")[0].count(" ") - 1)
                    found.append((start, start + m[0].count(" ") - 1, r))

    def hides(e, d):
        if e[0] > d[0] or e[1] < d[1] or e[2].priority < d[2].priority:
            return False
        return e[:2] != d[:2] or (e[2].priority, -e[2].number) > (d[2].priority, -d[2].number)

    kept = [d for d in found if not any(hides(e, d) for e in found)]
    base = [d for d in found if d[2].kind == "BASE"]
    starts = [d[0] for d in base]
    labels = lambda ds: ",".join(sorted({d[2].label for d in ds}))
    return len(w), len(base), min(starts, default=None), max(starts, default=None), labels(base), labels(kept + base), max((d[2].confidence for d in kept), default=0.0)


def scanned(spark, texts):
    df = spark.createDataFrame([(i, t, 1, "x", "y") for i, t in enumerate(texts)], "doc_id long, text string, n_words int, labels string, _words string")
    return [tuple(r)[1:] for r in licenses.with_base(licenses.scan(df)).orderBy("doc_id").collect()]


#: text -> labels
KNOWN = {
    "Released under the MIT License.": "mit",
    "Licensed under the Apache License, Version 2.0 (the \"License\");": "apache,apache-2.0",
    "This work is licensed under the GNU General Public License, version 3.": "gpl,gpl-3.0-only",
    "licensed under the GNU General Public License version 2 or (at your option) any later version": "gpl,gpl-2.0-or-later",
    "Licensed under CC BY-NC 4.0.": "cc-by-nc-4.0",
    "// SPDX-License-Identifier: GPL-3.0-or-later": "gpl-3.0-or-later",
    "# SPDX-License-Identifier: MIT": "mit",
    "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\")": "mit",
    "You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0": "apache-2.0",
    "Redistribution and use in source and binary forms, with or without modification, are permitted": "bsd",
    "See the GNU Lesser General Public License": "gpl,lgpl",
    "https://creativecommons.org/licenses/by-nc-sa/4.0/": "cc-by-nc-sa",
    "(c) 2001 Someone. All rights reserved.": "proprietary",
    "The mitten licensee of a general, public; licence": "",
    "Mozilla Public License, v. 2.0": "mpl-2.0",
    "This is free and unencumbered software released into the public domain.": "unlicense",
    "MIT Apache license MIT\nLICENSE": "apache,mit",
}


def test_known_wordings(spark):
    assert dict(zip(KNOWN, [r[5] for r in scanned(spark, KNOWN)])) == KNOWN


ODD = [None, "", " ", "mit", "license mit license", "MIT LICENSE " * 4, "général public license", "mit license mit license", "x" * 30_000, "K gnu gpl", "\u0000mit\u0000license\u0000"]


def test_odd_texts_equal_brute_force(spark):
    texts = ODD + list(KNOWN) + [" ".join(KNOWN), " ".join(reversed(list(KNOWN)))]
    assert scanned(spark, texts) == [brute(t) for t in texts]
    assert licenses.scan(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_long_texts_and_edges_of_segments(spark):
    """Matches that cross the edge of a segment, or lie inside one that does, are found and hidden once."""
    notice = "licensed under the terms of the gnu general public license version 3 or any later version"
    texts = [" ".join(["w"] * lead + [notice] + ["w"] * 7 + ["mit license"]) for lead in range(1024 - 60, 1024 + 4, 3)]
    texts.append(" ".join(["mit license apache license version 2 0 released under the mit license"] * 4_000))
    assert scanned(spark, texts) == [brute(t) for t in texts[:-1]] + [(48_000, 12_000, 0, 47_998, "apache,mit", "apache,apache-2.0,mit", 0.9)]


def test_detections_are_hidden_by_priority_and_containment(spark):
    df = spark.createDataFrame([(1, "licensed under the apache license version 2 0 and mit license")] * 2 + [(None, "mit license")], "doc_id long, text string")
    rows = licenses.scan(df).collect()
    assert len(rows) == 3 and rows[0] == rows[1]
    got = {(d["start"], d["stop"], d["kind"], d["kept"]) for d in rows[0]["detections"]}
    assert got == {(0, 2, "HINT", False), (0, 8, "NOTICE", True), (3, 5, "BASE", False), (3, 8, "NAME", False), (9, 11, "BASE", True)}
    assert rows[2]["doc_id"] is None and rows[2]["labels"] == ["mit"]


def test_own_rules(spark):
    rules = compiled("# BASE\nx: {alpha} beta\n# TAG\ny: gamma {alpha} beta")
    df = spark.createDataFrame([(1, "gamma alpha beta alpha beta")], "doc_id long, text string")
    assert [(d["label"], d["start"], d["kept"]) for d in licenses.scan(df, rules=rules).first()["detections"]] == [("y", 0, True), ("x", 1, False), ("x", 3, True)]
    with pytest.raises(ValueError):
        compiled("# BASE\nx: no keyword")


def test_rules_span_no_more_than_their_window():
    """Every rule's own words fit the window: a text of its least wording has its label."""
    assert len(RULES) > 200 and all(0 <= r.number == i for i, r in enumerate(RULES))
    for r in RULES:
        before, after = r.pattern.split("@", 1)
        assert before.count(" ") <= BEFORE + 1 + 12 and after.count(" ") <= AFTER + 1, r


def test_no_python_in_the_plan(spark, sf, capsys):
    QUERIES["op12_licenses"](spark, sf).explain("formatted")
    plan = capsys.readouterr().out
    assert "Python" not in plan and "Arrow" not in plan and "Window" not in plan


def test_query(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()
    assert sorted(map(tuple, QUERIES["op12_licenses"](spark, sf).collect())) == sorted((i, *brute(t)) for i, t in docs)
