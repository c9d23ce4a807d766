"""Openings of licence files, headers, and the registered query with null columns and very long texts."""

from loomlight.llm import licences, queries

MIT = """MIT License

Copyright (c) 2021 Jo Doe

Permission is hereby granted, free of charge, to any person obtaining a copy
of this software and associated documentation files (the "Software"), to deal
in the Software without restriction, including without limitation the rights
to use, copy, modify, merge, publish, distribute, sublicense, and/or sell
copies of the Software, and to permit persons to whom the Software is
furnished to do so, subject to the following conditions:
"""
APACHE = """                                 Apache License
                           Version 2.0, January 2004
                        http://www.apache.org/licenses/

   TERMS AND CONDITIONS FOR USE, REPRODUCTION, AND DISTRIBUTION

   1. Definitions.

      "License" shall mean the terms and conditions for use, reproduction,
      and distribution as defined by Sections 1 through 9 of this document.
"""
GPL = """                    GNU GENERAL PUBLIC LICENSE
                       Version {}

 Copyright (C) 2007 Free Software Foundation, Inc. <https://fsf.org/>
 Everyone is permitted to copy and distribute verbatim copies
 of this license document, but changing it is not allowed.

                            Preamble

  The GNU General Public License is a free, copyleft license for
software and other kinds of works.
"""
BSD = """Copyright 2020 Jo Doe. All rights reserved.

Redistribution and use in source and binary forms, with or without
modification, are permitted provided that the following conditions are met:

1. Redistributions of source code must retain the above copyright notice, this
   list of conditions and the following disclaimer.

2. Redistributions in binary form must reproduce the above copyright notice,
   this list of conditions and the following disclaimer in the documentation
   and/or other materials provided with the distribution.
"""
BSD3 = BSD + """
3. Neither the name of the copyright holder nor the names of its contributors
   may be used to endorse or promote products derived from this software without
   specific prior written permission.
"""
MPL = """Mozilla Public License Version 2.0
==================================

1. Definitions
--------------

1.1. "Contributor"
    means each individual or legal entity that creates, contributes to
    the creation of, or owns Covered Software.
"""
HEADER = """# Licensed under the Apache License, Version 2.0 (the "License");
# you may not use this file except in compliance with the License.
# You may obtain a copy of the License at
#
#     http://www.apache.org/licenses/LICENSE-2.0

import os
"""
FILES = [
    ("mit/LICENSE", MIT, "MIT"), ("apache/LICENSE", APACHE, "Apache-2.0"), ("gpl3/COPYING", GPL.format("3, 29 June 2007"), "GPL-3.0"), ("gpl2/COPYING", GPL.format("2, June 1991"), "GPL-2.0"),
    ("bsd2/LICENSE", BSD, "BSD-2-Clause"), ("bsd3/LICENSE", BSD3, "BSD-3-Clause"), ("mpl/LICENSE", MPL, "MPL-2.0"), ("src/a.py", HEADER, "Apache-2.0"),
    ("prose/LICENSE", "nothing of the kind\n" * 20, None), ("mit/src/deep/x.c", "int x;", "MIT"),
]


def test_openings(spark):
    files = spark.createDataFrame([f[:2] for f in FILES], "path string, text string")
    assert {r.path: r.licence for r in licences.resolve(files).collect()} == {p: licence for p, _, licence in FILES}


def test_registered_query_with_nulls(spark, tmp_path):
    notice = "Released under the MIT License."
    rows = [(1, notice, "en", "web"), (2, "plain", "en", "web"), (None, notice, "en", "web"), (3, "x", None, "web"), (4, None, "en", None), (None, None, None, None), (2, "plain", "en", "web"), (5, "word " * 200_000 + "\n" + notice, "de", "web"), (6, "", "de", "x.y")]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string").write.parquet(f"{tmp_path}/documents.parquet")
    got = queries.op2_license_scan(spark, str(tmp_path)).collect()
    assert sorted((str(r.doc_id), str(r.licence), r.declared) for r in got) == sorted(
        [("1", "MIT", True), ("2", "MIT", False), ("2", "MIT", False), ("None", "MIT", True), ("3", "None", False), ("4", "None", False), ("None", "None", False), ("5", "MIT", True), ("6", "None", False)]
    )
