import math
import re
import textwrap
from collections import Counter

import duckdb
import pytest

from reelproof.llm import license_scan, queries


def cosine(passage):
    idf, other, weights = license_scan.weigh(license_scan.TEMPLATES)
    own = {t: n * idf.get(t, other) for t, n in Counter(re.findall(license_scan.TERM, passage.lower())).items()}
    length = math.sqrt(sum(v * v for v in own.values())) or 1
    out = Counter()
    for k, i, t, w in weights:
        out[k, i] += own.get(t, 0) * w / length
    return out


def test_templates_match_themselves_best():
    for i, (k, t) in enumerate(license_scan.TEMPLATES):
        found = cosine(t)
        assert found[k, i] == pytest.approx(1) and max(v for (o, _), v in found.items() if o != k) < 0.995
        assert re.search(license_scan.LICENCE_WORDS, t.lower())


def wrapped(text, prefix=""):
    return "\n".join(prefix + x for x in textwrap.wrap(text, 72))


def test_files_and_headers(spark):
    texts = license_scan.TEXTS
    files = {
        "mit": f"MIT License\n\nCopyright (c) 2024 Jane Doe\n\n{wrapped(texts['MIT'])}\n",
        "mit-grant": "words before\n" + wrapped(license_scan.GRANT, "// ") + "\nand words after, of no matter",
        "mit-title": "MIT License\nCopyright (c)",
        "bsd3": "Copyright 2020, Some People\nAll rights reserved.\n\n" + wrapped(texts["BSD-3-Clause"]),
        "bsd2": wrapped(texts["BSD-2-Clause"]),
        "isc": wrapped(texts["ISC"]),
        "apache-heading": "                                 Apache License\n                           Version 2.0, January 2004\n                        http://www.apache.org/licenses/\n\n   TERMS AND CONDITIONS FOR USE, REPRODUCTION, AND DISTRIBUTION\n",
        "apache-header": wrapped("Copyright 2021 The Authors. " + texts["Apache-2.0"], " * ") + "\n */\npackage a.b;\nimport c.d;\n" + "int x = f(y);\n" * 40,
        "gpl3": "                    GNU GENERAL PUBLIC LICENSE\n                       Version 3, 29 June 2007\n\n Copyright (C) 2007 Some Foundation\n Everyone is permitted to copy and distribute verbatim copies\n" + "of this document and of many more words\n" * 200,
        "gpl2": wrapped(texts["GPL-2.0"], "# "),
        "spdx": "# SPDX-License-Identifier: Apache-2.0\nimport x",
        "inline": "We thank all who helped with it over the years. Released under the MIT License. The rest of this long line is about other things.",
        "prose": "they were permitted to walk there, and the warrant was shown\nlicensed fishermen met them at the gate",
        "none": "nothing at all",
    }
    want = {"mit": "MIT", "mit-grant": "MIT", "mit-title": "MIT", "bsd3": "BSD-3-Clause", "bsd2": "BSD-2-Clause", "isc": "ISC", "apache-heading": "Apache-2.0", "apache-header": "Apache-2.0", "gpl3": "GPL-3.0", "gpl2": "GPL-2.0", "spdx": "Apache-2.0", "inline": "MIT", "prose": None, "none": None}
    df = spark.createDataFrame(list(files.items()), "path string, text string")
    assert {r.path: r.license_id for r in license_scan.licenses(df).collect()} == want


def test_inheritance(spark):
    mit, gpl = license_scan.NOTICES["MIT"], license_scan.NOTICES["GPL-3.0"]
    rows = [
        ("LICENSE", f"header\n{mit.upper()}\n"), ("a.txt", "plain"), ("d/b.txt", None), ("d/e/LICENSE.md", gpl), ("d/e/c.txt", ""),
        ("d/e/f/g.txt", "x\n" * 3000 + "  # " + mit), ("d/e/f/h.txt", "x"), ("d/e/f/NOTICE", "nothing"), ("d/e/COPYING", mit), (None, "x"), ("a.txt", "plain"),
        ("d/eh.txt", "This work is licensed"),
    ]
    df = spark.createDataFrame([(*r, 1) for r in rows], "path string, text string, score int")
    got = {r.path: (r.license_id, r.origin, r.from_path) for r in license_scan.licenses(df).collect()}
    gpl = ("GPL-3.0", "inherited", "d/e/LICENSE.md")
    assert got == {
        "LICENSE": ("MIT", "own", "LICENSE"), "a.txt": ("MIT", "inherited", "LICENSE"), "d/b.txt": ("MIT", "inherited", "LICENSE"), "d/e/LICENSE.md": ("GPL-3.0", "own", "d/e/LICENSE.md"),
        "d/e/c.txt": gpl, "d/e/f/g.txt": ("MIT", "own", "d/e/f/g.txt"), "d/e/f/h.txt": gpl, "d/e/f/NOTICE": gpl, "d/e/COPYING": ("MIT", "own", "d/e/COPYING"), None: (None, "none", None),
        "d/eh.txt": ("MIT", "inherited", "LICENSE"),
    }
    assert license_scan.licenses(df.limit(0)).count() == 0


def test_query_matches_sql(spark):
    sf = "/root/testdata/sf0.001"
    duckdb.sql(f"CREATE OR REPLACE VIEW documents AS SELECT * FROM '{sf}/documents.parquet'")
    want = duckdb.sql(queries.ORACLES["op2_license_scan"])
    cols = want.columns
    got = [tuple(r[c] for c in cols) for r in queries.op2_license_scan(spark, sf).collect()]
    key = lambda r: r[0]
    assert sorted(got, key=key) == sorted(want.fetchall(), key=key)
    assert {r[cols.index("origin")] for r in got} >= {"own", "none"}
