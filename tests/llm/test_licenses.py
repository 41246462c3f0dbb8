"""Real licence texts, headers and SPDX lines; files of one path; inheritance in the query."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from ledgerloom.llm import licenses

MIT_FILE = """MIT License

Copyright (c) 2021 Some Body and others

Permission is hereby granted, free of charge, to any person obtaining a copy
of this software and associated documentation files (the "Software"), to deal
in the Software without restriction, including without limitation the rights
to use, copy, modify, merge, publish, distribute, sublicense, and/or sell
copies of the Software, and to permit persons to whom the Software is
furnished to do so, subject to the following conditions:

The above copyright notice and this permission notice shall be included in all
copies or substantial portions of the Software.

THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR
IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY,
FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE
AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER
LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM,
OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE
SOFTWARE.
"""
GPL_HEADER = """/*
 * frobnicate.c - turns knobs
 *
 * This program is free software: you can redistribute it and/or modify
 * it under the terms of the GNU {}General Public License as published by
 * the Free Software Foundation, either version {} of the License, or
 * (at your option) any later version.
 *
 * This program is distributed in the hope that it will be useful,
 * but WITHOUT ANY WARRANTY; without even the implied warranty of
 * MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE.  See the
 * GNU {}General Public License for more details.
 */
int main(void) {{ return 0; }}
"""
BSD_2 = """Copyright 2020 Some Body

Redistribution and use in source and binary forms, with or without
modification, are permitted provided that the following conditions are met:

1. Redistributions of source code must retain the above copyright notice, this
   list of conditions and the following disclaimer.

2. Redistributions in binary form must reproduce the above copyright notice,
   this list of conditions and the following disclaimer in the documentation
   and/or other materials provided with the distribution.
"""
BSD_3 = (
    BSD_2
    + """
3. Neither the name of the copyright holder nor the names of its contributors
   may be used to endorse or promote products derived from this software
   without specific prior written permission.
"""
)
DISCLAIMER = '\nTHIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES ARE DISCLAIMED.\n'
APACHE_FILE = """
                                 Apache License
                           Version 2.0, January 2004
                        http://www.apache.org/licenses/

   TERMS AND CONDITIONS FOR USE, REPRODUCTION, AND DISTRIBUTION

   1. Definitions.

      "License" shall mean the terms and conditions for use, reproduction,
      and distribution as defined by Sections 1 through 9 of this document.
"""
APACHE_HEADER = """# Copyright 2019 The Authors
#
# Licensed under the Apache License, Version 2.0 (the "License");
# you may not use this file except in compliance with the License.
# You may obtain a copy of the License at
#
#     http://www.apache.org/licenses/LICENSE-2.0
"""
GPL_FILE = """                    GNU GENERAL PUBLIC LICENSE
                       Version {}, {}

 Everyone is permitted to copy and distribute verbatim copies
 of this license document, but changing it is not allowed.
"""
KNOWN = {
    MIT_FILE: "MIT",
    "// " + MIT_FILE.replace("\n", "\n// ") + "code(); " * 400: "MIT",
    GPL_HEADER.format("", 3, ""): "GPL-3.0",
    GPL_HEADER.format("", 2, ""): "GPL-2.0",
    GPL_HEADER.format("Lesser ", 3, "Lesser "): "LGPL-3.0",
    GPL_HEADER.format("Affero ", 3, "Affero "): "AGPL-3.0",
    GPL_FILE.format(3, "29 June 2007"): "GPL-3.0",
    GPL_FILE.format(2, "June 1991"): "GPL-2.0",
    BSD_2 + DISCLAIMER: "BSD-2-Clause",
    BSD_3 + DISCLAIMER: "BSD-3-Clause",
    APACHE_FILE: "Apache-2.0",
    APACHE_HEADER + "x = 1\n" * 50: "Apache-2.0",
    "# SPDX-License-Identifier: Apache-2.0\nimport os\n": "Apache-2.0",
    "/* SPDX-License-Identifier: MIT */ int x;": "MIT",
    "// SPDX-License-Identifier: GPL-3.0-or-later\nclass A {}": "GPL-3.0",
    "-- SPDX-License-Identifier: GPL-2.0-only\nselect 1": "GPL-2.0",
    "-- SPDX-License-Identifier: BSD-3-Clause\nselect 1": "BSD-3-Clause",
    "Intro. Released under the MIT License. And more text follows on this long line": "MIT",
    "Some words; licensed under\nthe Apache License,\nVersion 2.0. More words": "Apache-2.0",
    "This work is licensed under CC BY-NC 4.0.": "CC-BY-NC-4.0",
    "Licensed under a Creative Commons Attribution-ShareAlike 4.0 International License": "CC-BY-SA-4.0",
    "This is free and unencumbered software released into the public domain.\n\nAnyone is free to copy, modify, publish, use, compile, sell, or\ndistribute this software": "Unlicense",
    "This Source Code Form is subject to the terms of the Mozilla Public\nLicense, v. 2.0. If a copy of the MPL was not distributed with this\nfile, You can obtain one at http://mozilla.org/MPL/2.0/.": "MPL-2.0",
    "you need a driving license to drive the car of a person with permission": None,
    "copyright of nothing known whatsoever": None,
    "SPDX-License-Identifier: Something-Else": None,
    "the license plate, and the license of the plate, under the law of this land to use it": None,
    "the sublicense permission waived copyright redistribution " * 3000: None,
    "": None,
}


def test_known_texts(spark):
    cases = list(KNOWN.items())
    df = spark.createDataFrame([(f"d{i}/x", t) for i, (t, _) in enumerate(cases)], "path string, text string")
    got = {r["path"]: (r["license"], r["via"]) for r in licenses.scan_licenses(df).collect()}
    assert {i: got[f"d{i}/x"][0] for i in range(len(cases))} == {i: want for i, (_, want) in enumerate(cases)}


def test_files_of_one_path_keep_their_own(spark):
    rows = [("a/x", "Released under the MIT License."), ("a/x", "This work is licensed under the GNU General Public License, version 3."), ("a/x", "plain"), ("a/x", "plain")]
    df = spark.createDataFrame(rows, "path string, text string").withColumns({c: F.lit("c") for c in ("print", "key", "dir", "words")})
    got = sorted((r["path"], str(r["license"]), r["via"]) for r in licenses.scan_licenses(df).collect())
    assert got == [("a/x", "GPL-3.0", "own"), ("a/x", "MIT", "own"), ("a/x", "None", "none"), ("a/x", "None", "none")]


def test_the_query_inherits(spark):
    got = {r["via"]: r["n"] for r in licenses.op7_license_scan(spark, "/root/testdata/sf0.1").groupBy("via").agg(F.count("*").alias("n")).collect()}
    assert got["own"] >= 250 and got["inherited"] > 0 and sum(got.values()) == 10_000


@pytest.mark.parametrize("name, text", licenses.TEMPLATES)
def test_every_template_has_a_cue(name, text):
    assert licenses.shapes([(name, text)])
