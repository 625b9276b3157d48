"""Whole texts and lines against known licences, in any spelling."""

import glob
import os
import re
import textwrap

import pytest

from commentflow.llm import licenses

MIT = licenses.KNOWN[0][1]
ROWS = [
    (1, None, None), (2, "", 1), (3, " \n!!\n", 2), (4, MIT, 3), (5, "Copyright (c) 2020 A. B.\n\n" + MIT.upper().replace(", ", " ,\t"), 4),
    (6, "Title\nLicenced under the Apache Licence - version 2.0\nmore", 5), (7, MIT + " and more", 6),
    (8, "(c) 2021 me\nlicensed under CC BY-NC 4.0", 7), (9, "licensed under CC BY 5.0", 8), (8, "(c) 2021 me\nlicensed under CC BY-NC 4.0", 7),
    (None, "Released under the MIT License.", 9), (10, "word " * 300000, 10),
    (11, MIT.replace("sublicense", "sub-licence").replace("conditions: ", "conditions:\n\n"), 11),
]


@pytest.fixture(scope="module")
def found(spark):
    df = spark.createDataFrame(ROWS, "doc_id int, text string, line int").repartition(3)
    return sorted((tuple(r) for r in licenses.scan(df).collect()), key=str)


def test_matches(found):
    assert found == sorted([
        (4, "text", None, "MIT"), (4, "line", 0, "MIT"), (5, "text", None, "MIT"), (5, "line", 2, "MIT"),
        (6, "line", 1, "Apache-2.0"), (8, "text", None, "CC-BY-NC-4.0"), (8, "line", 1, "CC-BY-NC-4.0"),
        (8, "text", None, "CC-BY-NC-4.0"), (8, "line", 1, "CC-BY-NC-4.0"), (11, "text", None, "MIT"),
        (None, "text", None, "MIT"), (None, "line", 0, "MIT"),
    ], key=str)


def test_known_table(spark):
    rows = licenses.known_digests(spark).collect()
    assert len(rows) == len(licenses.KNOWN)
    with pytest.raises(ValueError):
        licenses.known_digests(spark, [("x", "y")] * 10_001)


def test_empty(spark):
    assert licenses.scan(spark.createDataFrame([], "doc_id int, text string")).count() == 0


#: As published by their projects.
BSD3 = """{}All rights reserved.

Redistribution and use in source and binary forms, with or without
modification, are permitted provided that the following conditions are
met:

   * Redistributions of source code must retain the above copyright
notice, this list of conditions and the following disclaimer.
   * Redistributions in binary form must reproduce the above
copyright notice, this list of conditions and the following disclaimer
in the documentation and/or other materials provided with the
distribution.
   * Neither the name of Google Inc. nor the names of its
contributors may be used to endorse or promote products derived from
this software without specific prior written permission.

THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS
"AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT
LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR
A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT
OWNER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL,
SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT
LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE,
DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY
THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT
(INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE
OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE.
"""
SYSTEM = {"Apache-2.0": "Apache-2.0", "BSD": "BSD-3-Clause", "CC0-1.0": "CC0-1.0", "GPL-2": "GPL-2.0-only",
          "GPL-3": "GPL-3.0-only", "LGPL-3": "LGPL-3.0-only", "MPL-2.0": "MPL-2.0"}


def published():
    body = textwrap.fill(MIT, 70)
    out = [
        (f"MIT License\n\nCopyright (c) 2020 A. B.\n\n{body}\n", "MIT"), (f"The MIT License (MIT)\n\nCopyright <YEAR> <HOLDER>\n\n{body}", "MIT"),
        ("# Copyright 2019, The Authors\n#\n" + textwrap.indent(body, "# "), "MIT"),
        ("/*\n * Copyright [yyyy] [name of copyright owner]\n * All rights reserved.\n" + textwrap.indent(body, " * ") + "\n */", "MIT"),
        ("dnl Copyright (C) 2001 me\n" + textwrap.indent(body, "dnl "), "MIT"),
        (BSD3.format("// Copyright 2014 The Go Authors. "), "BSD-3-Clause"),
        ("BSD 2-Clause License\n\n" + re.sub(r"   \* Neither.*?permission\.\n", "", BSD3.format("Copyright (c) 2012, X\n"), flags=re.S), "BSD-2-Clause"),
    ]
    for file, name in SYSTEM.items():
        text = open(f"/usr/share/common-licenses/{file}").read()
        flat = "\n\n".join(" ".join(p.split()) for p in re.split(r"\n\s*\n", text))
        out += [(text, name), (textwrap.indent(text, "-- "), name), *([(flat, name)] if file in ("Apache-2.0", "MPL-2.0") else [])]
        if "END OF TERMS" in text:
            out.append((text[: text.index("END OF TERMS")] + "END OF TERMS AND CONDITIONS", name))
    return out


@pytest.mark.skipif(not os.path.exists("/usr/share/common-licenses/MPL-2.0"), reason="no system licences")
def test_published_files(spark):
    rows = [(i, t) for i, (t, _) in enumerate(published())]
    got = {r.doc_id: r.license for r in licenses.scan(spark.createDataFrame(rows, "doc_id int, text string")).filter("unit = 'text'").collect()}
    assert got == {i: name for i, (_, name) in enumerate(published())}


def test_every_text_is_known(spark):
    files = glob.glob(os.path.join(os.path.dirname(licenses.__file__), "known_licenses", "*.txt"))
    rows = [(os.path.basename(f)[:-4], open(f).read()) for f in files]
    got = licenses.scan(spark.createDataFrame(rows, "doc_id string, text string")).filter("unit = 'text'").collect()
    assert len(rows) == 8 and sorted(r.doc_id for r in got) == sorted(r.license for r in got) == sorted(r[0] for r in rows)


def test_willful(spark):
    known = [("x", "no wilful misconduct")]
    got = licenses.scan(spark.createDataFrame([(1, "No willful misconduct.")], "doc_id int, text string"), known=known)
    assert got.filter("unit = 'text'").count() == 1
