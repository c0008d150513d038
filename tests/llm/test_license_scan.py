import re

from pyspark.sql import functions as F

from tablewright.llm.license_scan import TEMPLATES, marks_of, scan_licenses, template_rows


def pairs_of(text):
    w = re.findall(r"[^\W_]+", text.lower())
    return {f"{a} {b}" for a, b in zip(w, w[1:])}


def test_against_plain_loops(spark):
    mit = TEMPLATES["MIT"][1]
    texts = [
        None, "", "x", "Released under the MIT License.", "a b c\n  released under  the mit licence!\n", "Released under the MIT License. " * 9,
        mit[:150] + "\n" + mit[150:] + "\n\nmore text", mit.replace("free", "gratis").upper(), "Licensed under CC BY-NC 4.0.\r\nLicensed under the Apache License, Version 2.0.",
        "word " * 50_000, "Released under the MIT License.",
    ]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").withColumn("license", F.lit("clash")).withColumn("w", F.lit(1))
    want = set()
    for d, t in enumerate(texts):
        t = re.sub(r"\r\n?", "\n", t or "")
        units = [("line", i, x) for i, x in enumerate(t.split("\n"))]
        units += [("paragraph", i, x) for i, x in enumerate(re.split(r"\n[ \t]*\n", t)) if "\n" in x.strip(" ")]
        for kind, i, x in units:
            a = pairs_of(x)
            for name in {n for n, _ in template_rows()}:
                best = max((2 * len(a & set(p)) / (len(a) + len(p)) for n, p in template_rows() if n == name), default=0) if a else 0
                needed, refused = marks_of(name)
                own = {w for p in a for w in p.split()}
                if best >= 0.8 and set(needed) <= own and not own & set(refused):
                    want.add((d, kind, i, name, round(best, 12)))
    got = [(r.doc_id, r.unit_kind, r.unit_no, r.license, round(r.dice, 12)) for r in scan_licenses(df).collect()]
    assert set(got) == want and len(got) == len(want) and len(want) >= 7
    assert scan_licenses(df.limit(0)).count() == 0


def test_statements_inside_longer_units(spark):
    mit, gpl = TEMPLATES["MIT"][1], TEMPLATES["GPL-3.0"][1]
    texts = [
        "Copyright (c) 2020 Jane Doe. Released under the MIT License.", "free of charge and software " * 40 + mit + " the end " * 99, "a b c " * 50 + mit[:150] + "\n" + mit[150:] + " d e f" * 50,
        "one two three four five. Licensed under CC BY-NC 4.0. six seven eight nine ten\nmore text", "The MIT school is licensed to teach under the law.", mit + " " + gpl + " and more words" * 60,
    ]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = sorted((r.doc_id, r.unit_kind, r.unit_no, r.license) for r in scan_licenses(df).collect())
    assert got == [(0, "line", 0, "MIT"), (1, "line", 0, "MIT"), (2, "paragraph", 0, "MIT"), (3, "line", 0, "CC-BY-NC-4.0"), (5, "line", 0, "GPL-3.0"), (5, "line", 0, "MIT")]


def test_runs_without_python(spark):
    df = spark.createDataFrame([(1, "x")], "doc_id long, text string")
    assert "Python" not in scan_licenses(df)._jdf.queryExecution().executedPlan().toString()


def test_wordings_with_a_word_missing_or_inside_other_text(spark):
    rows, names = [], {}
    for name, texts in TEMPLATES.items():
        for t in texts:
            words = t.split()
            for k in range(0, len(words), 3):
                short = " ".join(words[:k] + words[k + 1 :])
                if len(words) >= 9:
                    for text in (short, f"some words before it, {short} and after it", t.upper(), f"# {t}\n"):
                        names[len(rows)] = name
                        rows.append((len(rows), text))
    found = {(r.doc_id, r.license) for r in scan_licenses(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    # Without a word that tells the license from others (its version), it must not be found; else it should be.
    marked = {d for d, name in names.items() if set(marks_of(name)[0]) <= set(re.findall(r"[^\W_]+", rows[d][1].lower()))}
    assert 0 < len(names) - len(marked) < 12 and all((d, names[d]) not in found for d in names if d not in marked)
    missed = [d for d, name in names.items() if (d, name) not in found and d in marked]
    # Inside other text, a short wording with a word missing can be too unlike the window of the whole wording's length.
    assert len(rows) > 200 and len(missed) <= 0.01 * len(rows)
    assert all(rows[d][1].startswith("some words") for d in missed)


GPL = "This program is free software; you can redistribute it and/or modify it under the terms of the GNU {} as published by the Free Software Foundation; either version {} of the License, or (at your option) any later version."
#: Statements of licenses that are worded like a template, and their license where a template has it.
ALIKE = [
    (GPL.format("General Public License", 2), None), (GPL.format("Lesser General Public License", 3), None), (GPL.format("Affero General Public License", 3), None),
    (GPL.format("Library General Public License", 3), None), (GPL.format("General Public License", 3), "GPL-3.0"), ("This work is licensed under the GNU General Public License, version 2.", None),
    ("This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License.", None), ("This work is licensed under a Creative Commons Attribution-NonCommercial-NoDerivatives 4.0 International License.", None),
    ("This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License.", None), ("This work is licensed under a Creative Commons Attribution 3.0 Unported License.", None),
    ("This work is licensed under a Creative Commons Attribution 3.0 International License.", None), ("This work is licensed under a Creative Commons Attribution 4.0 International License", "CC-BY-4.0"),
    ("Licensed under CC BY-NC-SA 4.0.", None), ("Licensed under CC BY-NC-ND 4.0.", None), ("Licensed under CC BY 4.0.", None), ("Licensed under the Apache License, Version 1.1.", None),
    ("This Source Code Form is subject to the terms of the Mozilla Public License, v. 1.1.", None), ("This program and the accompanying materials are made available under the terms of the Eclipse Public License 1.0", None),
    ("Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:", "BSD"),
]


def test_the_right_license_or_none(spark):
    rows = [(i, text) for i, (text, _) in enumerate(ALIKE)]
    rows += [(100 + i, f"Some words before the statement here. {text} And more words behind it, of no license at all.") for i, (text, _) in enumerate(ALIKE)]
    got = scan_licenses(spark.createDataFrame(rows, "doc_id long, text string")).select("doc_id", "license").distinct().collect()
    found = {}
    for r in got:
        found.setdefault(r.doc_id, set()).add(r.license)
    for i, (text, name) in enumerate(ALIKE):
        assert found.get(i, set()) == ({name} if name else set()), text
        assert found.get(100 + i, set()) <= ({name} if name else set()), text
