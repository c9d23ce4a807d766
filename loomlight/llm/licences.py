"""Licence statements by sparse TF-IDF cosine to templates, and inheritance from licence files of ancestor directories.

Three kinds of segments are compared with the templates: every line of a text; the header (the
comment that a file begins with) and its runs of two to four lines, as notices are wrapped; and
licence files as wholes and in such runs. Segments and templates are bags of words; weights are
term frequency times inverse document frequency over all files, counted for the templates' words
(a word outside every template adds to a segment's length with the largest weight). A segment
declares the licence of the most similar template from COSINE on, if it holds the terms that tell that licence
from others of like wording; an SPDX identifier names its licence alone. A licence file that resembles a text as a whole declares that one. A file
without a declaration takes that of the licence file in its nearest ancestor directory.

A segment can only reach COSINE with a template if it shares a word of the template's cover: the
fewest of its heaviest words without which too little weight is left. Texts, lines and runs without
a word of a cover are left out before any bag is made, and so are segments whose words in common
with the templates can't make up the bound; that drops nothing.
"""

from __future__ import annotations

import functools
import math
import re
from collections import Counter

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomlight.llm.shared import cut, sized

COSINE = 0.6
#: Lines at the head of a file that are taken for its header.
HEADER_LINES = 5
FILE_NAMES = r"(?i)^(licen[sc]e|copying|notice|unlicense)(\.\w+)?$"
#: Notices that licences ask for, in short, sought in every line; fixed values.
NOTICES = {
    "MIT": ["Released under the MIT License.", "Licensed under the MIT License.", "SPDX-License-Identifier: MIT", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software"],
    "Apache-2.0": ["Licensed under the Apache License, Version 2.0.", "SPDX-License-Identifier: Apache-2.0", "you may not use this file except in compliance with the License"],
    "GPL-3.0": ["This work is licensed under the GNU General Public License, version 3.", "SPDX-License-Identifier: GPL-3.0", "This program is free software: you can redistribute it under the terms of the GNU General Public License version 3"],
    "GPL-2.0": ["This work is licensed under the GNU General Public License, version 2.", "SPDX-License-Identifier: GPL-2.0"],
    "LGPL-3.0": ["Licensed under the GNU Lesser General Public License, version 3.", "SPDX-License-Identifier: LGPL-3.0"],
    "BSD-3-Clause": ["Released under the BSD 3-Clause License.", "SPDX-License-Identifier: BSD-3-Clause"],
    "BSD-2-Clause": ["Released under the BSD 2-Clause License.", "SPDX-License-Identifier: BSD-2-Clause"],
    "ISC": ["Released under the ISC License.", "SPDX-License-Identifier: ISC"],
    "MPL-2.0": ["This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.", "SPDX-License-Identifier: MPL-2.0"],
    "CC-BY-4.0": ["Licensed under CC BY 4.0.", "Licensed under the Creative Commons Attribution 4.0 International License."],
    "CC-BY-SA-4.0": ["Licensed under CC BY-SA 4.0.", "Licensed under the Creative Commons Attribution-ShareAlike 4.0 International License."],
    "CC-BY-NC-4.0": ["Licensed under CC BY-NC 4.0.", "Licensed under the Creative Commons Attribution-NonCommercial 4.0 International License."],
    "CC0-1.0": ["Dedicated to the public domain under CC0 1.0.", "SPDX-License-Identifier: CC0-1.0"],
    "LGPL-2.1": ["Licensed under the GNU Lesser General Public License, version 2.1.", "SPDX-License-Identifier: LGPL-2.1"],
    "LGPL-2.0": ["Licensed under the GNU Library General Public License, version 2.", "SPDX-License-Identifier: LGPL-2.0"],
    "AGPL-3.0": ["Licensed under the GNU Affero General Public License, version 3.", "SPDX-License-Identifier: AGPL-3.0"],
    "GPL-1.0": ["SPDX-License-Identifier: GPL-1.0"],
    "GFDL-1.2": ["SPDX-License-Identifier: GFDL-1.2"],
    "GFDL-1.3": ["SPDX-License-Identifier: GFDL-1.3"],
    "MPL-1.1": ["SPDX-License-Identifier: MPL-1.1"],
    "Unlicense": ["SPDX-License-Identifier: Unlicense"],
}
_WARRANTY = 'THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.'
_REDISTRIBUTION = "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:"
_SOURCE = "Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer."
_BINARY = "Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution."
_NAMES = "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission."
_FREE = "This program is free software: you can redistribute it and/or modify it under the terms of the GNU {} as published by the Free Software Foundation, either version {} of the License, or (at your option) any later version."
_VERBATIM = "Everyone is permitted to copy and distribute verbatim copies of this license document, but changing it is not allowed."
#: Texts of licences, or the paragraphs that they and the headers they ask for begin with, sought in headers and licence files; fixed values.
TEXTS = {
    "MIT": [
        "MIT License Copyright (c) Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software. " + _WARRANTY,
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software",
    ],
    "Apache-2.0": [
        "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0",
        "Apache License Version 2.0, January 2004 http://www.apache.org/licenses/ TERMS AND CONDITIONS FOR USE, REPRODUCTION, AND DISTRIBUTION",
    ],
    "GPL-3.0": [_FREE.format("General Public License", 3), "GNU GENERAL PUBLIC LICENSE Version 3, 29 June 2007 Copyright (C) 2007 Free Software Foundation, Inc. " + _VERBATIM],
    "GPL-2.0": [_FREE.format("General Public License", 2), "GNU GENERAL PUBLIC LICENSE Version 2, June 1991 Copyright (C) 1989, 1991 Free Software Foundation, Inc. " + _VERBATIM],
    "AGPL-3.0": [_FREE.format("Affero General Public License", 3), "GNU AFFERO GENERAL PUBLIC LICENSE Version 3, 19 November 2007 Copyright (C) 2007 Free Software Foundation, Inc. " + _VERBATIM],
    "LGPL-3.0": [_FREE.format("Lesser General Public License", 3), "GNU LESSER GENERAL PUBLIC LICENSE Version 3, 29 June 2007 Copyright (C) 2007 Free Software Foundation, Inc. " + _VERBATIM],
    "BSD-3-Clause": [" ".join(("BSD 3-Clause License Copyright (c) All rights reserved.", _REDISTRIBUTION, "1.", _SOURCE, "2.", _BINARY, "3.", _NAMES)), _NAMES],
    "BSD-2-Clause": [" ".join(("BSD 2-Clause License Copyright (c) All rights reserved.", _REDISTRIBUTION, "1.", _SOURCE, "2.", _BINARY)), " ".join((_REDISTRIBUTION, "1.", _SOURCE))],
    "ISC": ["ISC License Copyright (c) Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies."],
    "MPL-2.0": [
        "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/.",
        "Mozilla Public License Version 2.0 1. Definitions",
    ],
    "LGPL-2.1": ["GNU LESSER GENERAL PUBLIC LICENSE Version 2.1, February 1999 Copyright (C) 1991, 1999 Free Software Foundation, Inc. " + _VERBATIM],
    "LGPL-2.0": ["GNU LIBRARY GENERAL PUBLIC LICENSE Version 2, June 1991 Copyright (C) 1991 Free Software Foundation, Inc. " + _VERBATIM],
    "GPL-1.0": ["GNU GENERAL PUBLIC LICENSE Version 1, February 1989 Copyright (C) 1989 Free Software Foundation, Inc. " + _VERBATIM],
    "GFDL-1.2": ["GNU Free Documentation License Version 1.2, November 2002 Copyright (C) 2000,2001,2002 Free Software Foundation, Inc. " + _VERBATIM],
    "GFDL-1.3": ["GNU Free Documentation License Version 1.3, 3 November 2008 Copyright (C) 2000, 2001, 2002, 2007, 2008 Free Software Foundation, Inc. " + _VERBATIM],
    "MPL-1.1": ["MOZILLA PUBLIC LICENSE Version 1.1 1. Definitions."],
    "CC0-1.0": ["Creative Commons Legal Code CC0 1.0 Universal"],
    "Artistic-1.0": ['The "Artistic License" Preamble The intent of this document is to state the conditions under which a Package may be copied'],
    "Unlicense": ["This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means."],
}

_GPL, _THREE, _TWO = ("gnu", "gpl", "gpl2", "gpl3", "gplv2", "gplv3"), ("3", "v3", "gpl3", "gplv3", "lgpl3", "lgplv3", "agpl3", "agplv3"), ("2", "v2", "gpl2", "gplv2")
_OTHER_GPL = ("lesser", "library", "affero", "documentation", "lgpl", "agpl", "gfdl", "lgpl3", "lgplv3", "agpl3", "agplv3")
_BSD, _BY = ("bsd", "redistribution", "redistributions"), ("sa", "sharealike", "nc", "noncommercial", "nd", "noderivatives")
#: What tells a licence from others of like wording: groups of terms of each of which a segment must hold one, and terms that it must not hold.
RULES: dict[str, tuple[tuple, tuple]] = {
    "MIT": ((("mit", "permission"), ("mit", "hereby"), ("mit", "charge")), ()),
    "Apache-2.0": ((("apache", "compliance"),), ("mozilla", "mpl", "cddl")),
    "GPL-3.0": ((_GPL, _THREE), _OTHER_GPL),
    "GPL-2.0": ((_GPL, _TWO), _OTHER_GPL),
    "GPL-1.0": ((_GPL, ("1", "v1")), _OTHER_GPL),
    "LGPL-3.0": ((("lesser", "lgpl", "lgpl3", "lgplv3"), _THREE), ("affero",)),
    "LGPL-2.1": ((("lesser", "lgpl"), ("2",), ("1",)), ("affero",)),
    "LGPL-2.0": ((("library", "lgpl"), _TWO), ("lesser", "affero")),
    "AGPL-3.0": ((("affero", "agpl", "agpl3", "agplv3"), _THREE), ()),
    "GFDL-1.2": ((("documentation", "gfdl"), ("1",), ("2",)), ()),
    "GFDL-1.3": ((("documentation", "gfdl"), ("1",), ("3",)), ()),
    "BSD-3-Clause": ((("neither", *_BSD), ("3", "three", "neither")), ()),
    "BSD-2-Clause": ((_BSD,), ("neither", "endorse")),
    "ISC": ((("isc", "permission"), ("isc", "fee")), ()),
    "MPL-2.0": ((("mozilla", "mpl"), ("2", "v2")), ()),
    "MPL-1.1": ((("mozilla", "mpl"), ("1",)), ()),
    "CC-BY-4.0": ((("cc", "creative"),), _BY),
    "CC-BY-SA-4.0": ((("cc", "creative"), ("sa", "sharealike")), ()),
    "CC-BY-NC-4.0": ((("cc", "creative"), ("nc", "noncommercial")), ()),
    "CC0-1.0": ((("cc0",),), ()),
    "Artistic-1.0": ((("artistic",),), ()),
    "Unlicense": ((("unlicense", "unencumbered"),), ()),
}
#: An identifier names its licence alone, whatever else the segment resembles; endings that don't matter here.
SPDX, SPDX_END = r"(?i)SPDX-License-Identifier:\s*([A-Za-z0-9.+-]+)", r"(?i)(-only|-or-later|\+)?\.*$"
#: In a header or licence file, this makes the two clauses three.
ENDORSE = r"(?i)endorse\s+or\s+promote"
#: A licence file that is so similar to a text as a whole declares that one, whatever its parts resemble; a whole that is less similar to any declares nothing.
WHOLE = 0.9
#: Lines that are joined to one segment where notices are wrapped.
RUNS = (2, 3, 4)
_COMMENT = r"^\s*(#|//|/\*|\*|--|;|%|<!--)"


def terms(text: Column) -> Column:
    return F.regexp_extract_all(F.lower(text), F.lit("[a-z0-9]+"), F.lit(0))


#: ASCII but digits and small letters.
_MARKS = "".join(c for c in map(chr, range(128)) if not (c.isdigit() or c.islower()))


def _pieces(text: Column) -> Column:
    """terms, with empty strings between: in ASCII texts without a pattern's cost."""
    low = F.lower(text)
    return F.split(F.when(F.octet_length(text) == F.length(text), F.translate(low, _MARKS, " " * len(_MARKS))).otherwise(F.regexp_replace(low, "[^a-z0-9]+", " ")), " ")


def cover(weights: dict[str, float]) -> list[str]:
    """The fewest words of a template, by their weights, of which every bag at COSINE holds one: by Cauchy, what it lacks may make up 1 - COSINE ** 2 of the squares."""
    left, out = sum(w * w for w in weights.values()), []
    least = COSINE * COSINE * left * (1 - 1e-4)
    for term in sorted(weights, key=lambda t: (-weights[t], t)):
        if left < least:
            break
        out.append(term)
        left -= weights[term] ** 2
    return out


def _holding(words: list[str]) -> str:
    return r"(?i)(?<![A-Za-z0-9])(?:" + "|".join(sorted(words)) + r")(?![A-Za-z0-9])"


def _spdx(text: Column) -> Column:
    """The identifier that a text names first, in small letters, empty without one."""
    return F.lower(F.regexp_replace(F.regexp_extract(text, SPDX, 1), SPDX_END, ""))


def segments(files: DataFrame, text: str, pattern: str) -> DataFrame:
    """row, line and the terms of every line with a match of pattern; row is the file's column `row`."""
    lines = files.where(F.col(text).rlike(pattern)).select("row", F.posexplode(F.split(text, "\n", -1)).alias("line", "s")).where(F.col("s").rlike(pattern))
    return lines.select("row", "line", F.lit(False).alias("whole"), terms(F.col("s")).alias("terms"), _spdx(F.col("s")).alias("spdx"), F.lit(False).alias("endorse"))


def header(text: Column) -> Column:
    """The comment that a text begins with: up to its closing mark, or the leading lines with a comment mark; empty without one."""
    lines = F.split(text, "\n", -1)
    end = F.array_position(F.transform(lines, lambda s: s.rlike(_COMMENT)), F.lit(False)).cast("int")
    leading = F.array_join(F.when(end > 0, F.slice(lines, F.lit(1), end - 1)).otherwise(lines), "\n")
    closed = lambda start, mark: (F.ltrim(text).startswith(start) & text.contains(mark), F.substring_index(text, mark, 1))
    (a, x), (b, y) = closed("/*", "*/"), closed("<!--", "-->")
    return F.when(a, x).when(b, y).otherwise(leading)


def blocks(files: DataFrame, text: str, whole: Column, pattern: str) -> DataFrame:
    """row, line, whole and terms of runs of lines and of the whole, in files' headers or, where whole holds, texts."""
    # the anchored test spares the lines of texts that begin with no comment
    rows = files.where(whole | F.col(text).rlike(_COMMENT)).select("row", whole.alias("all"), F.when(whole, F.col(text)).otherwise(header(F.col(text))).alias("block"))
    rows = rows.where(F.col("block").rlike(pattern))
    lines = F.filter(F.transform(F.split("block", "\n", -1), lambda s, i: F.struct(i.alias("line"), s.alias("s"))), lambda x: F.trim(x["s"]) != "")
    rows = rows.select("row", "all", lines.alias("lines"), F.col("block").rlike(ENDORSE).alias("endorse")).where(F.size("lines") > 0)
    joined = lambda i, n, w: F.struct(F.get("lines", i)["line"].alias("line"), w.alias("whole"), F.array_join(F.slice(F.col("lines")["s"], i + 1, n), " ").alias("s"))
    runs_of = lambda n: F.transform("lines", lambda _, i: joined(i, F.lit(n), F.lit(False)))
    runs = [runs_of(n) for n in RUNS]
    runs.append(F.array(joined(F.lit(0), F.size("lines"), F.col("all"))))
    found = rows.select("row", "endorse", F.explode(F.concat(*runs)).alias("x")).where(F.col("x.s").rlike(pattern))
    return found.select("row", "x.line", "x.whole", terms(F.col("x.s")).alias("terms"), _spdx(F.col("x.s")).alias("spdx"), "endorse").distinct()


def declared(files: DataFrame, text: str = "text", whole: Column | None = None) -> DataFrame:
    """row, licence, cosine, in_header: for each file with a declaration its most similar one; equal ones go to the earlier line, then the licence's name.

    Texts of rows where whole holds are compared as a whole too, and such a match of at least WHOLE
    goes first. Inverse document frequencies count all files, for the words of the templates, of
    which there are a fixed number.
    """
    spark = files.sparkSession
    known = [(f"{name}#{kind}{k}", name, t) for kind, group in (("n", NOTICES), ("t", TEXTS)) for name, texts in group.items() for k, t in enumerate(texts)]
    bags_of = {t: Counter(re.findall("[a-z0-9]+", s.lower())) for t, _, s in known}
    words = sorted(set().union(*bags_of.values()))
    present = files.select(F.array_intersect(_pieces(F.col(text)), F.lit(words)).alias("present"))
    seen = present.select(F.explode_outer("present").alias("term")).groupBy("term").count().collect()
    n = files.count()
    df = {r["term"]: r["count"] for r in seen if r["term"] is not None}
    idf = {w: _idf(n, df.get(w, 0)) for w in words}
    rare = rare_idf = _idf(n, 0)
    vectors = {t: {w: c * idf[w] for w, c in bag.items()} for t, bag in bags_of.items()}
    covers = {t: cover(v) for t, v in vectors.items()}
    in_lines = _holding(sorted({w for t, c in covers.items() if "#n" in t for w in c}))
    in_blocks = _holding(sorted({w for c in covers.values() for w in c}))
    postings = [(w, t, name, x / math.sqrt(sum(y * y for y in vectors[t].values()))) for t, name, _ in known for w, x in vectors[t].items()]
    postings = spark.createDataFrame(postings, "term string, template string, licence string, tw double")
    weights = F.create_map(*(F.lit(x) for pair in idf.items() for x in pair))
    weight = lambda term: F.coalesce(F.try_element_at(weights, term), F.lit(rare))
    found = segments(files, text, in_lines).union(blocks(files, text, F.lit(False) if whole is None else F.coalesce(whole, F.lit(False)), in_blocks))
    # no cosine exceeds the root of the share of a template's squares that the words in common have; of a word, its largest share
    shares: dict[str, float] = {}
    for v in vectors.values():
        squares = sum(y * y for y in v.values())
        for w, x in v.items():
            shares[w] = max(shares.get(w, 0.0), x * x / squares)
    share_of = F.create_map(*(F.lit(x) for pair in shares.items() for x in pair))
    known_terms = F.array_intersect("terms", F.lit(words))
    share = F.aggregate(known_terms, F.lit(0.0), lambda a, w: a + F.coalesce(F.try_element_at(share_of, w), F.lit(0.0)))
    found = found.where(share >= COSINE * COSINE * (1 - 1e-4))
    # nor the root of the share of the segment's own squares that they have: words of no template weigh at least `rare` each
    squares = F.aggregate(known_terms, F.lit(0.0), lambda a, w: a + F.pow(F.size(F.filter("terms", lambda x: x == w)) * weight(w), F.lit(2.0)))
    foreign = F.size(F.array_except("terms", F.lit(words))) * (rare_idf * rare_idf)
    found = found.where(squares >= COSINE * COSINE * (1 - 1e-4) * (squares + foreign))
    # a segment's key: the runs of several lengths begin at the same line
    found = cut(found.select("row", F.struct("line", F.xxhash64("terms").alias("h"), "whole", "spdx").alias("line"), "terms", "endorse").distinct())
    holds = lambda words: F.arrays_overlap("terms", F.array(*map(F.lit, words)))
    fits = F.lit(True)
    for name, (needs, bars) in RULES.items():
        own = [holds(group) for group in needs] + [~holds(bars)] * bool(bars)
        fits = F.when(F.col("licence") == name, functools.reduce(Column.__and__, own)).otherwise(fits)
    fits &= (F.col("line.spdx") == "") | (F.col("line.spdx") == F.lower("licence"))
    fits &= (F.col("licence") != "BSD-2-Clause") | ~F.col("endorse")
    fits &= ~F.col("line.whole") | (F.col("cosine") >= WHOLE)
    bags = found.select("row", "line", F.explode("terms").alias("term")).groupBy("row", "line", "term").count()
    bags = bags.withColumn("w", F.col("count") * weight(F.col("term")))
    lengths = bags.groupBy("row", "line").agg(F.sqrt(F.sum(F.col("w") * F.col("w"))).alias("length"))
    dots = bags.join(F.broadcast(postings), "term").groupBy("row", "line", "licence", "template").agg(F.sum(F.col("w") * F.col("tw")).alias("dot"))  # a fixed number of words
    near = dots.join(lengths, ["row", "line"]).withColumn("cosine", F.round(F.col("dot") / F.col("length"), 6)).where(F.col("cosine") >= COSINE)
    near = near.join(found, ["row", "line"]).where(fits)
    first = (F.col("line.whole") & (F.col("cosine") >= WHOLE) & F.contains("template", F.lit("#t"))).cast("int")
    order = F.struct((-first).alias("first"), (-F.col("cosine")).alias("c"), F.col("line.line").alias("line"), "licence")
    best = near.groupBy("row").agg(F.min(order).alias("b"))
    return best.select("row", F.col("b.licence").alias("licence"), (-F.col("b.c")).alias("cosine"), (F.col("b.line") < HEADER_LINES).alias("in_header"))


def _idf(n: int, df: int) -> float:
    return math.log((1 + n) / (1 + df)) + 1


def resolve(files: DataFrame, path: str = "path", text: str = "text") -> DataFrame:
    """Of every file: path, licence, cosine, declared, inherited_from, steps up to that file's directory.

    Licence files are those of the usual names that declare a licence. A directory with several
    takes the most similar, then the first by licence and path. Null paths inherit nothing, null
    texts declare nothing; equal rows give equal rows; other columns are ignored.
    """
    rows = files.select(F.col(path).cast("string").alias("path"), F.col(text).cast("string").alias("text"))
    keyed = rows.withColumn("row", F.struct("path", F.xxhash64("text").alias("t")))
    own = cut(declared(keyed, whole=F.substring_index(F.col("row.path"), "/", -1).rlike(FILE_NAMES)))
    base = keyed.select("row", "path")
    marked = base.join(sized(own, 96), "row", "left").select("path", "licence", "cosine")
    name, folder = F.substring_index("path", "/", -1), F.expr("substring(path, 1, greatest(0, length(path) - length(substring_index(path, '/', -1)) - 1))")
    notices = own.select(F.col("row.path").alias("path"), "licence", "cosine").where(name.rlike(FILE_NAMES)).withColumn("folder", folder)
    order = F.struct((-F.col("cosine")).alias("c"), "licence", "path")
    by_folder = cut(notices.groupBy("folder").agg(F.min(order).alias("n")).select("folder", F.col("n.licence").alias("up_licence"), F.col("n.path").alias("up_path")))
    missing = marked.where("licence is null and path is not null").select("path", folder.alias("leaf")).distinct()
    folders = missing.select("leaf").distinct()
    parts = F.split("leaf", "/")
    ups = folders.select("leaf", F.explode(F.sequence(F.lit(0), F.size(parts))).alias("steps"))
    ups = ups.withColumn("folder", F.array_join(F.slice(parts, F.lit(1), F.size(parts) - F.col("steps")), "/")).where("steps = 0 or folder != leaf")
    nearest = ups.join(sized(by_folder, 128), "folder").groupBy("leaf").agg(F.min(F.struct("steps", "up_licence", "up_path")).alias("u"))
    nearest = cut(nearest.select("leaf", "u.*"))
    out = marked.withColumn("leaf", F.when(F.col("licence").isNull(), folder)).join(sized(nearest, 128), "leaf", "left")
    return out.select(
        "path",
        F.coalesce("licence", "up_licence").alias("licence"),
        "cosine",
        F.col("licence").isNotNull().alias("declared"),
        F.col("up_path").alias("inherited_from"),
        F.col("steps").cast("long").alias("steps"),
    )
