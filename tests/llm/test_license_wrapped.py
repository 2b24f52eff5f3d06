import textwrap

import pytest

from corpusloom.llm import license_scan as ls

GPL, BSD, MIT = ls.TEMPLATES["GPL"][1], ls.TEMPLATES["BSD"][0], ls.TEMPLATES["MIT"][2]


@pytest.mark.parametrize("width", [40, 70])
def test_wrapped_headers(spark, width):
    wrap = lambda t, before="": "\n".join(before + x for x in textwrap.wrap(t, width))
    texts = {
        1: (wrap(GPL), 1, "GPL"), 2: (wrap(BSD, "# "), 1, "BSD"), 3: (wrap(MIT, " * "), 1, "MIT"),
        4: (f"Intro of words.\n{wrap(GPL)}\n\nMore.\n\n{wrap(MIT)}\n", 2, "GPL,MIT"),
        5: (f"{wrap(BSD)}\n\nText.\n\n{wrap(BSD)}", 1, "BSD"), 6: (f"{GPL}\nWords that follow.", 1, "GPL"),
        7: ("\n".join(ls.BACKGROUND), 0, ""), 9: (f"{'word ' * 20}\n{'word ' * 25}\nLicensed under CC BY-NC 4.0.", 1, "CC-BY-NC"), 8: ("under the\n\nGNU General\n\nPublic License", 0, ""),
    }
    df = spark.createDataFrame([(i, t) for i, (t, _, _) in texts.items()], "doc_id long, text string")
    got = {r.doc_id: (r.n_notices, r.families) for r in ls.scan(df).collect()}
    assert got == {i: (n, f) for i, (_, n, f) in texts.items()}
