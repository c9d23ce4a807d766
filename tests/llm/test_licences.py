"""Licence declarations and inheritance against plain Python."""

import math
import re
from collections import Counter

from loomlight.llm import licences

SCHEMA = "path string, text string, licence string, row string, leaf string"


def terms(s):
    return re.findall("[a-z0-9]+", s.lower())


def brute(files):
    """Every line against the notices, and licence files as wholes and in runs against all templates, without any choice of lines."""
    notices, texts = ([(name, terms(t)) for name, ts in group.items() for t in ts] for group in (licences.NOTICES, licences.TEXTS))
    segments, every = {}, notices + texts
    for p, t in files:
        rows = (t or "").split("\n")
        segments[p, t] = [(n, s, list(every), False) for n, s in enumerate(rows)]
        if p is not None and re.search(licences.FILE_NAMES, p.split("/")[-1]):
            full = [(n, s) for n, s in enumerate(rows) if s.strip(" ")]
            runs = [full[k : k + n] for k in range(len(full)) for n in licences.RUNS]
            segments[p, t] += [(r[0][0], " ".join(s for _, s in r), every, False) for r in runs]
            segments[p, t] += [(full[0][0], " ".join(s for _, s in full), every, True)] if full else []
    words = {w for _, t in notices + texts for w in t}
    n = len(files)
    df = Counter(w for _, t in files for w in set(terms(t or "")) if w in words)
    idf = lambda w: math.log((1 + n) / (1 + (df[w] if w in words else 0))) + 1
    vector = lambda t: {w: c * idf(w) for w, c in Counter(t).items()}
    size = lambda v: math.sqrt(sum(x * x for x in v.values()))
    own = {}
    for key, found in segments.items():
        best = []
        for line, text, templates, whole in found:
            s = terms(text)
            v = vector(s)
            spdx = re.search(licences.SPDX, text)
            spdx = re.sub(licences.SPDX_END, "", spdx[1]).lower() if spdx else ""
            endorse = templates is every and bool(re.search(licences.ENDORSE, key[1]))
            for name, t in templates:
                u = vector(t)
                cos = round(sum(x * u.get(w, 0) for w, x in v.items()) / (size(u) * size(v)), 6) if v else 0
                needs, bars = licences.RULES[name]
                fits = all(set(s) & set(group) for group in needs) and not set(s) & set(bars) and (cos >= licences.WHOLE or not whole)
                fits = fits and spdx in ("", name.lower()) and not (endorse and name == "BSD-2-Clause")
                if cos >= licences.COSINE and fits:
                    best.append((-(whole and cos >= licences.WHOLE and (name, t) in texts), -cos, line, name))
        if best:
            own[key] = (min(best)[3], -min(best)[1])
    notices = {}
    for (p, t), (name, cos) in own.items():
        if p is not None and re.search(licences.FILE_NAMES, p.split("/")[-1]):
            notices.setdefault("/".join(p.split("/")[:-1]), []).append((-cos, name, p))
    out = []
    for p, t in files:
        if (p, t) in own:
            out.append((p, own[p, t][0], True, None, None))
            continue
        up, steps, found = "/".join(p.split("/")[:-1]) if p is not None else None, 0, None
        while up is not None:
            if up in notices:
                found = (p, min(notices[up])[1], False, min(notices[up])[2], steps)
                break
            up, steps = ("/".join(up.split("/")[:-1]), steps + 1) if up else (None, 0)
        out.append(found or (p, None, False, None, None))
    return sorted(out, key=str)


def run(spark, files):
    got = licences.resolve(spark.createDataFrame([(*f, "z", "z", "z") for f in files], SCHEMA)).collect()
    return sorted(((r.path, r.licence, r.declared, r.inherited_from, r.steps) for r in got), key=str)


MIT, APACHE, GPL = (licences.NOTICES[k][0] for k in ("MIT", "Apache-2.0", "GPL-3.0"))
FILES = [
    ("LICENSE", MIT), ("a/LICENSE.txt", APACHE), ("a/b/c/file.py", "code\nmore"), ("a/b/c/own.py", f"x\n{GPL}\ny"), ("z/file", None), ("z/y/COPYING", "copyright nobody knows what"), ("z/y/f", ""),
    ("a/NOTICE", GPL), ("a/f", "Licensed under the Apache license version 2.0"), (None, "text"), (None, MIT), ("a/f", "Licensed under the Apache license version 2.0"), ("deep/" * 12 + "f", "no"), ("q/LICENSE", MIT), ("q/LICENSE", MIT), ("q/r/f", "x"), ("", "t"),
]


def test_resolution(spark):
    assert run(spark, FILES) == brute(FILES)
    assert run(spark, []) == []


def test_many_files_of_one_directory(spark):
    files = [("hot/LICENSE", MIT), *((f"hot/sub/{k}", "plain") for k in range(500))]
    got = run(spark, files)
    assert sum(r[1] == "MIT" and r[4] == 1 for r in got) == 500
