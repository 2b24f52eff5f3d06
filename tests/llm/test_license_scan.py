import duckdb

from corpusloom.llm import license_scan as ls


def paragraphs(text):
    """Lines, each with those after it while the one before does not end a sentence and none is blank."""
    out, goes_on = [], False
    for line in text.split("\n"):
        if goes_on and line.strip(" \t\r"):
            out[-1] = out[-1].rstrip(" \t\r") + " " + line.lstrip(" \t")
        else:
            out.append(line)
        end = line.rstrip(" \t\r")
        goes_on = bool(end) and end[-1] not in ".!?" and not end[-1].isspace()
    return out


def brute(texts):
    out = {}
    for i, text in texts:
        lines = paragraphs(text or "")
        row = out.setdefault(i, [0, {}])
        row[0] += sum(bool(x.strip(" ")) for x in lines)
        for line in set(lines):
            family, p, _ = ls.classify(line)
            if family != ls.UNKNOWN:
                row[1][line] = (family, p)
    return {i: (n, len(found), ",".join(sorted({f for f, _ in found.values()})), min(p for _, p in found.values()) if found else None) for i, (n, found) in out.items()}


def rows(df):
    return {r.doc_id: (r.n_paragraphs, r.n_notices, r.families, r.certainty) for r in df.collect()}


def same(got, want):
    assert {k: v[:3] for k, v in got.items()} == {k: v[:3] for k, v in want.items()}
    assert all((got[k][3] is None) == (v[3] is None) and (v[3] is None or abs(got[k][3] - v[3]) < 1e-5) for k, v in want.items())


def test_templates_and_background():
    for family, texts in ls.TEMPLATES.items():
        for text in texts:
            assert ls.classify(text)[0] == family and ls.classify(f"Hello there. {text} More text goes on here.")[0] == family
    for text in [*ls.BACKGROUND, "", "The license", "a free library is licensed", "An ordinary line of text."]:
        assert ls.classify(text)[0] == ls.UNKNOWN


def test_whole_table(spark, sf):
    got = rows(ls.query(spark, sf))
    same(got, brute([(r.doc_id, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]))
    assert {f for r in got.values() for f in r[2].split(",")} >= {"MIT"}


def test_sql(spark, sf):
    con = duckdb.connect()
    con.sql(f"CREATE VIEW documents AS SELECT * FROM '{sf}/documents.parquet'")
    rel = con.sql(ls.sql())
    want = {r[0]: r[1:] for r in rel.select("doc_id, n_paragraphs, n_notices, families, certainty").fetchall()}
    same(rows(ls.query(spark, sf)), want)


def test_odd_rows_and_no_python(spark):
    notice = "Released under the MIT License."
    texts = [(1, notice), (1, f"x\n{notice}\n{notice}"), (None, notice), (2, None), (3, ""), (4, "license " * 30000), (5, " \n\n"), (6, f"É {notice.upper()}"), (7, "Licensed under CC BY-NC 4.0.\nLicensed under CC BY 4.0.")]
    df = spark.createDataFrame([(i, t, "k", "l") for i, t in texts], "doc_id long, text string, key string, line string")
    out = ls.scan(df)
    same(rows(out), brute(texts))
    assert ls.scan(df.limit(0)).collect() == []
    plan = out._jdf.queryExecution().toString()
    assert not any(w in plan for w in ("Python", "Pandas", "Arrow"))


def test_other_licences_are_unknown_and_short_notices_are_found():
    """Licences of no family, some of them in no training text, and notices of one line."""
    others = ["Distributed under the ISC license", "Licensed under the Eclipse Public License, version 2.0.", "Licensed under the EUPL", "Licensed under the PHP License, version 3.01.", "SPDX-License-Identifier: NCSA", "Distributed under the Sleepycat license"]
    assert [ls.classify(t)[0] for t in others] == [ls.UNKNOWN] * len(others)
    found = {"License: MIT": "MIT", "MIT licensed": "MIT", "SPDX-License-Identifier: BSD-3-Clause": "BSD", "This file is covered by the GPLv3": "GPL"}
    assert {t: ls.classify(t)[0] for t in found} == found


def test_families_held_out():
    """Of notices whose family the classifier never saw, how many are called another family."""
    wrong = total = 0
    for family in ("MPL-2.0", "CC0", "MIT"):
        held = ls.TEMPLATES.pop(family)
        ls.train.cache_clear()
        try:
            wrong += sum(ls.classify(t)[0] != ls.UNKNOWN for t in held)
            total += len(held)
        finally:
            ls.TEMPLATES[family] = held
            ls.train.cache_clear()
    assert wrong <= total // 4, (wrong, total)


def test_versions_are_told_apart_and_short_forms_found():
    found = {
        "SPDX-License-Identifier: GPL-2.0-only": "GPL", "License: BSD": "BSD", "License: GPL v2": "GPL", "License: LGPL-2.1": "LGPL", "Apache 2.0 licensed": "Apache-2.0", "License: Apache-2.0": "Apache-2.0",
        "SPDX-License-Identifier: MPL-2.0": "MPL-2.0", "Distributed under the AGPL-3.0 license.": "AGPL", "License: CC0-1.0": "CC0",
        "Mozilla Public License Version 1.1": ls.UNKNOWN, "Apache License, Version 1.1": ls.UNKNOWN, "Licensed under a Creative Commons Attribution-NoDerivatives 4.0 International License": ls.UNKNOWN,
        "License: CC-BY-NC-ND-3.0": ls.UNKNOWN, "SPDX-License-Identifier: MPL-1.1": ls.UNKNOWN,
    }
    assert {t: ls.classify(t)[0] for t in found} == found


def test_licences_in_no_training_text():
    """How many of the notices of licences that no training text names are called a family: below 5 %."""
    names = ["PHP-3.01", "NCSA", "Sleepycat", "W3C", "Python-2.0", "SSPL-1.0", "Elastic-2.0", "CPL-1.0", "IPL-1.0", "Ruby", "Vim", "OSL-3.0", "curl", "LPPL-1.3c", "X11", "NASA-1.3", "JSON", "RPL-1.5", "TCL", "NTP", "HPND", "Zend-2.0", "SISSL", "MulanPSL-2.0", "ECL-2.0"]
    trained = " ".join([*ls.others(), *(t for texts in ls.notices().values() for t in texts)]).lower()
    assert not any(n.lower() in trained for n in names)
    forms = [*ls.FORMS, "This project is licensed under the terms of the {} license.", "Released under {}"]
    wrong = [(t, ls.classify(t)) for n in names for f in forms if ls.classify(t := f.format(n))[0] != ls.UNKNOWN]
    assert len(wrong) < 0.05 * len(names) * len(forms), wrong
