"""Names of whole licence texts and of identifiers, those of like wording too."""

import os

import pytest

from loomlight.llm import licences

FOLDER = "/usr/share/common-licenses"
NAMES = {
    "Apache-2.0": "Apache-2.0", "Artistic": "Artistic-1.0", "BSD": "BSD-3-Clause", "CC0-1.0": "CC0-1.0", "GFDL-1.2": "GFDL-1.2", "GFDL-1.3": "GFDL-1.3", "GPL-1": "GPL-1.0", "GPL-2": "GPL-2.0", "GPL-3": "GPL-3.0",
    "LGPL-2": "LGPL-2.0", "LGPL-2.1": "LGPL-2.1", "LGPL-3": "LGPL-3.0", "MPL-1.1": "MPL-1.1", "MPL-2.0": "MPL-2.0",
}


@pytest.mark.skipif(not os.path.isdir(FOLDER), reason="no licence texts here")
def test_full_texts(spark):
    there = sorted(set(NAMES) & set(os.listdir(FOLDER)))
    files = [(f"{name}/LICENSE", open(f"{FOLDER}/{name}", errors="replace").read()) for name in there] + [(f"plain/{k}", "nothing here " * 20) for k in range(200)]
    found = {r.path.split("/")[0]: r.licence for r in licences.resolve(spark.createDataFrame(files, "path string, text string")).collect()}
    assert {name: found[name] for name in there} == {name: NAMES[name] for name in there} and found["plain"] is None


def test_identifiers_name_their_licence_alone(spark):
    ids = {"LGPL-2.1": "LGPL-2.1", "AGPL-3.0": "AGPL-3.0", "GPL-2.0-only": "GPL-2.0", "GPL-3.0-or-later": "GPL-3.0", "LGPL-3.0+": "LGPL-3.0", "BSD-3-Clause": "BSD-3-Clause", "MIT.": "MIT", "Zlib": None, "GPL-4.0": None, "EPL-2.0": None, "cc0-1.0": "CC0-1.0"}
    files = [(f"{k}/a.py", f"# SPDX-License-Identifier: {x}\nimport os") for k, x in enumerate(ids)] + [(f"plain/{k}", "nothing here") for k in range(50)]
    found = {r.path: r.licence for r in licences.resolve(spark.createDataFrame(files, "path string, text string")).collect()}
    assert [found[f"{k}/a.py"] for k in range(len(ids))] == list(ids.values())


def test_prose_about_licences_declares_nothing(spark):
    texts = ["This report compares the General Public License with other licenses of its time.", "The party hereby grants permission to enter the premises free of charge, subject to the following conditions.", "GNU Lesser General Public License", "Permission to publish was granted to the editor."]
    files = [(f"{k}/LICENSE", t) for k, t in enumerate(texts)] + [(f"plain/{k}", "nothing here") for k in range(50)]
    found = {r.path: r.licence for r in licences.resolve(spark.createDataFrame(files, "path string, text string")).collect()}
    assert not any(found.values())
