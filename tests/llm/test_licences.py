import re

import duckdb

from gridtrack.llm import licences

MIT = "Permission is hereby granted, free of charge, to any person obtaining a copy of this software. The above copyright notice and this permission notice shall be included in all copies.\nTHE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND."
ROWS = [
    (1, "Some text.\nLicensed under the Apache License, Version 2.0.\nMore", "Apache-2.0", "permissive"),
    (2, MIT, "MIT", "permissive"),
    (3, "\n".join(reversed(MIT.split("\n"))), "", "none"),
    (4, None, "", "none"),
    (5, "", "", "none"),
    (6, "This work is licensed under the GNU General Public License, version 3. All rights reserved.", "GPL-3.0", "copyleft"),
    (12, "Copyright 2020 the authors. All rights reserved.", "All-Rights-Reserved", "restricted"),
    (13, "Licensed under the MIT License or the Apache License, Version 2.0.", "Apache-2.0,MIT", "permissive"),
    (14, "Licensed under the Apache License, Version 2.0 or the MIT License, all rights reserved.", "Apache-2.0,MIT", "permissive"),
    (14, "Licensed under the Apache License, Version 2.0 or the MIT License, all rights reserved.", "Apache-2.0,MIT", "permissive"),
    (15, "We like cats or the MIT License", "", "none"),
    (6, "SPDX-License-Identifier: MIT", "MIT", "permissive"),
    (7, "a licence to nothing. permission denied", "", "none"),
    (None, "Licensed under CC BY-NC 4.0.", "CC-BY-NC-4.0", "restricted"),
    (8, "word " * 50000 + "\nReleased under the MIT License.", "MIT", "permissive"),
    (9, "Licensed under the Apache License, Version 2.01", "", "none"),
]


def test_rules(spark):
    df = spark.createDataFrame([(d, t, "x", 1) for d, t, *_ in ROWS], "doc_id long, text string, ids string, seq int")
    got = sorted(((str(r.doc_id), r.licences, r.family) for r in licences.scanned(df).collect()))
    assert got == sorted((str(d), x, f) for d, _, x, f in ROWS)


def test_sql_gives_the_same(spark):
    con = duckdb.connect()
    con.sql("CREATE TABLE documents (doc_id BIGINT, text VARCHAR)")
    con.executemany("INSERT INTO documents VALUES (?, ?)", [r[:2] for r in ROWS])
    want = con.sql(licences.oracle())
    df = licences.scanned(spark.createDataFrame([r[:2] for r in ROWS], "doc_id long, text string"))
    assert sorted(map(str, map(tuple, df.select(*want.columns).collect()))) == sorted(map(str, want.fetchall()))


def test_every_rule_uses_known_sentences():
    known = {n for n, _ in licences.SENTENCES}
    assert all(set(ids) <= known and family in licences.FAMILIES for _, family, ids, _ in (*licences.RULES, licences.ELSE))


def test_empty(spark):
    assert licences.scanned(spark.createDataFrame([], "doc_id long, text string")).count() == 0


MIT_TEXT = """Copyright (c) 2020 Some Body

Permission is hereby granted, free of charge, to any person obtaining a copy of this software and
associated documentation files (the "Software"), to deal in the Software without restriction,
including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense,
and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so,
subject to the following conditions:

The above copyright notice and this permission notice shall be included in all copies or substantial
portions of the Software.

THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT
LIMITED TO THE WARRANTIES OF MERCHANTABILITY. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE
LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY."""
ISC_TEXT = """Permission to use, copy, modify, and/or distribute this software for any
purpose with or without fee is hereby granted, provided that the above
copyright notice and this permission notice appear in all copies.

THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES
WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF
MERCHANTABILITY AND FITNESS."""
ZERO_BSD_TEXT = ISC_TEXT.replace(", provided that the above\ncopyright notice and this permission notice appear in all copies", "")
APACHE_TEXT = """Licensed under the Apache License, Version 2.0 (the "License");
you may not use this file except in compliance with the License.
You may obtain a copy of the License at

    http://www.apache.org/licenses/LICENSE-2.0

Unless required by applicable law or agreed to in writing, software
distributed under the License is distributed on an "AS IS" BASIS,
WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied."""
GPL3_TEXT = """This program is free software: you can redistribute it and/or modify
it under the terms of the GNU General Public License as published by
the Free Software Foundation, either version 3 of the License, or
(at your option) any later version.

This program is distributed in the hope that it will be useful,
but WITHOUT ANY WARRANTY; without even the implied warranty of
MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE."""
LGPL_TEXT = GPL3_TEXT.replace("General", "Lesser General").replace("version 3", "version 2.1")
MPL_TEXT = """This Source Code Form is subject to the terms of the Mozilla Public
License, v. 2.0. If a copy of the MPL was not distributed with this
file, You can obtain one at https://mozilla.org/MPL/2.0/."""
ZLIB_TEXT = """This software is provided 'as-is', without any express or implied
warranty. In no event will the authors be held liable for any damages.

Permission is granted to anyone to use this software for any purpose,
including commercial applications, and to alter it freely:

1. The origin of this software must not be misrepresented; you must not
   claim that you wrote the original software."""
WRAPPED_MIT = """Permission is hereby granted, free of charge, to any person obtaining a copy
of this software and associated documentation files (the "Software"), to deal
in the Software without restriction, subject to the following conditions:

The above copyright notice and this permission notice shall be included in all
copies or substantial portions of the Software.

THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR
IMPLIED."""
WRAPPED_BSD = """Redistribution and use in source and binary forms, with or without
modification, are permitted provided that the following conditions are met:

1. Redistributions of source code must retain the above copyright notice, this
   list of conditions and the following disclaimer.

2. Redistributions in binary form must reproduce the above copyright notice,
   this list of conditions and the following disclaimer.
{}
THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS"
AND ANY EXPRESS OR IMPLIED WARRANTIES ARE DISCLAIMED."""
ENDORSE = """
3. Neither the name of the copyright holder nor the names of its
   contributors may be used to endorse or promote products derived from
   this software without specific prior written permission.
"""
WRAPPED_GPL = """This program is free software; you can redistribute it and/or modify
it under the terms of the GNU General Public License as published by
the Free Software Foundation.

This program is distributed in the hope that it will be useful,
but WITHOUT ANY WARRANTY."""


def test_wrapped_and_commented(spark):
    wants = [(WRAPPED_MIT, "MIT"), (WRAPPED_BSD.format(""), "BSD-2-Clause"), (WRAPPED_BSD.format(ENDORSE), "BSD-3-Clause"), (WRAPPED_GPL, "GPL")]
    rows, want = [], []
    for text, name in wants:
        for mark in ("", " * ", "# ", "// ", ";; ", "REM ", "dnl "):
            want.append((len(rows), name))
            rows.append((len(rows), "\r\n".join(mark + x for x in text.split("\n")) if mark == "// " else "\n".join(mark + x for x in text.split("\n"))))
    want.append((len(rows), "Apache-2.0,MIT"))
    rows.append((len(rows), "It is licensed under the Apache License, Version 2.0 and under the MIT License."))
    got = licences.scanned(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted((r.doc_id, r.licences) for r in got) == want


NOTICES = [(MIT_TEXT, "MIT"), (ISC_TEXT, "ISC"), (ZERO_BSD_TEXT, "0BSD"), (APACHE_TEXT, "Apache-2.0"), (GPL3_TEXT, "GPL,GPL-3.0-or-later"), (LGPL_TEXT, "LGPL-2.1-or-later"), (MPL_TEXT, "MPL-2.0"), (ZLIB_TEXT, "Zlib")]
NEAR_MISSES = [
    "that is not all rights reserved here",
    "This is not licensed under the Apache License, Version 2.0.",
    "It is no longer under the MIT License",
    MIT_TEXT.replace("The above copyright notice and this permission notice shall be included in all copies", "Keep the notice"),
    WRAPPED_BSD.format("").replace("2. Redistributions in binary form must reproduce", "2. Binaries must show"),
    ISC_TEXT.replace("the author", "nobody").replace("THE AUTHOR", "NOBODY"),
    "\n\n".join(reversed(ZLIB_TEXT.split("\n\n"))),
    GPL3_TEXT.replace("GNU General Public License", "terms below"),
    "the licensed under, the Apache. License version 2.0",
]


def test_notices_and_near_misses_by_query_and_sql(spark):
    rows, want = [], []
    for text, name in NOTICES:
        for mark in ("", " * ", "# ", "// ", ";; ", "REM ", "dnl ", "<!-- "):
            for end in ("\n", "\r\n"):
                rows.append((len(rows), "x = 1\n" + end.join(mark + x for x in text.split("\n")) + "\nMore text."))
                want.append((len(want), name))
        rows.append((len(rows), text.replace("\n\n", "@@").replace("\n", " ").replace("@@", "\n\n")))
        want.append((len(want), name))
    for text in NEAR_MISSES:
        rows.append((len(rows), text))
        want.append((len(want), ""))
    got = licences.scanned(spark.createDataFrame(rows, "doc_id long, text string"))
    assert sorted((r.doc_id, r.licences) for r in got.collect()) == want
    con = duckdb.connect()
    con.sql("CREATE TABLE documents (doc_id BIGINT, text VARCHAR)")
    con.executemany("INSERT INTO documents VALUES (?, ?)", rows)
    sql = con.sql(licences.oracle())
    assert sorted(map(str, map(tuple, got.select(*sql.columns).collect()))) == sorted(map(str, sql.fetchall()))


def test_bsd_with_its_copyright_line_is_permissive(spark):
    head = "Copyright (c) 2019, The Authors.\nAll rights reserved.\n\n"
    rows = [(0, head + WRAPPED_BSD.format("")), (1, head + WRAPPED_BSD.format(ENDORSE))]
    got = licences.scanned(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted((r.licences, r.family) for r in got) == [("BSD-2-Clause", "permissive"), ("BSD-3-Clause", "permissive")]


def test_the_hint_holds_every_known_sentence():
    assert all(re.search(licences.hint(), p) for _, p in licences.SENTENCES)
