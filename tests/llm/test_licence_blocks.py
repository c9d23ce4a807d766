"""Statements of more than one line."""

from loomlight.llm import licences

GPL = """This program is free software: you can redistribute it
under the terms of the GNU General Public
License version {}"""
MIT = """Copyright (c) 2020 Somebody

Permission is hereby granted, free of charge, to any person obtaining a copy
of this software and associated documentation files, to deal in it"""
FILES = [
    ("a/LICENSE", MIT, "MIT"),
    ("a/x.py", "print()", "MIT"),
    ("b/wrapped.py", "\n".join("# " + s for s in GPL.format(3).split("\n")) + "\nprint()", "GPL-3.0"),
    ("b/wrapped.c", f"/* {GPL.format(3)} */\nint x;", "GPL-3.0"),
    ("b/two.c", "// This work is licensed under the GNU\n// General Public License,\n// version 2.\nint x;", "GPL-2.0"),
    ("c/COPYING", "GNU GENERAL PUBLIC LICENSE\nVersion 2", "GPL-2.0"),
    ("d/COPYING", "GNU GENERAL PUBLIC LICENSE", None),
    ("e/f.c", "int x;\n" + GPL.format(3), None),
    ("f/nothing", None, None),
]


def test_blocks(spark):
    files = spark.createDataFrame([f[:2] for f in FILES], "path string, text string")
    got = {r.path: r.licence for r in licences.resolve(files).collect()}
    print(got)
    assert got == {p: licence for p, _, licence in FILES}
