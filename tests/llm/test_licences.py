import duckdb
import pytest

from tidewire.llm.licences import SENTENCES, scan
from tidewire.llm.q_licences import ORACLES, op10_licences

MIT = "MIT License\n\nCopyright (c) 2020 X\n\n" + "\n\n".join(SENTENCES[i] + ("" if i == "mit-grant" else ".") for i in ("mit-grant", "mit-condition", "mit-warranty"))


def wrap(text, n=60):
    import textwrap

    return "\n\n".join("\n".join(textwrap.wrap(p, n)) for p in text.split("\n\n"))


CASES = {
    1: ("Foo bar. Released under the MIT License.\nMore.", ["MIT"], 0),
    2: (MIT, ["MIT"], 0),
    3: (wrap(MIT), ["MIT"], 0),
    4: (None, [], 0),
    5: ("", [], 0),
    6: ("licensed under the APACHE license,  version 2.0!\nLicensed under CC BY-NC 4.0.", ["Apache-2.0", "CC-BY-NC-4.0"], 0),
    7: ("See the GNU General Public License for more details.", [], 1),
    8: ("All rights reserved. " * 5000, ["LicenseRef-All-Rights-Reserved"], 0),
    9: ("not Released under the MIT License.", [], 0),
}


@pytest.fixture(scope="module")
def df(spark):
    return spark.createDataFrame([(k, v[0], "x") for k, v in CASES.items()] * 2 + [(None, "MIT License", "x")], "doc_id long, text string, licences string")


def test_cases(df):
    got = [r for r in scan(df, "text", ["doc_id"]).collect() if r.doc_id]
    assert len(got) == 2 * len(CASES)
    for r in got:
        assert (r.licences, r.unmatched) == CASES[r.doc_id][1:], r.doc_id
    assert scan(df.limit(0), "text", ["doc_id"]).count() == 0


@pytest.mark.parametrize("own", [False, True])
def test_equals_sql(spark, df, tmp_path, own):
    folder = "/root/testdata/sf0.01" if not own else str(tmp_path)
    if own:
        df.coalesce(1).write.parquet(f"{folder}/documents.parquet")
    path = f"{folder}/documents.parquet" + ("/*.parquet" if own else "")
    con = duckdb.connect()
    con.execute(f"create view documents as select * from '{path}'")
    want = con.sql(ORACLES["op10_licences"]).fetchall()
    key = lambda r: tuple(map(str, r))
    assert sorted(map(tuple, op10_licences(spark, folder).collect()), key=key) == sorted(want, key=key)


def gnu(name, thing, version, a=";", b=";"):
    return f"""/* This {thing} is free software{a} you can redistribute it and/or modify
 * it under the terms of the {name} as published by
 * the Free Software Foundation{b} either version {version} of the License, or
 * (at your option) any later version.
 *
 * This {thing} is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied
 * warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the {name} for more details.
 */"""


ISC = """Permission to use, copy, modify, and/or distribute this software for any
purpose with or without fee is hereby granted, provided that the above
copyright notice and this permission notice appear in all copies."""
FURTHER = [
    (gnu("GNU General Public License", "program", "2"), "GPL-2.0-or-later"),
    (gnu("GNU General Public License", "library", "3", ":", ","), "GPL-3.0-or-later"),
    (gnu("GNU Lesser General Public License", "library", "2.1"), "LGPL-2.1-or-later"),
    (gnu("GNU Affero General Public License", "program", "3", ":", ","), "AGPL-3.0-or-later"),
    ("This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License version 2 as published by the Free Software Foundation.", "GPL-2.0-only"),
    ("This Source Code Form is subject to the terms of the Mozilla Public\nLicense, v. 2.0. If a copy of the MPL was not distributed with this\nfile, You can obtain one.", "MPL-2.0"),
    (ISC, "ISC"),
    ("This is free and unencumbered software released into the public domain.", "Unlicense"),
    ("Distributed under the Boost Software License, Version 1.0.", "BSL-1.0"),
    ("This work is licensed under a Creative Commons Attribution-NonCommercial-ShareAlike 4.0 International License.", "CC-BY-NC-SA-4.0"),
    ("// SPDX-License-Identifier: LGPL-3.0-or-later", "LGPL-3.0-or-later"),
    ("All rights\nreserved", "LicenseRef-All-Rights-Reserved"),
    ("All  rights   reserved.", "LicenseRef-All-Rights-Reserved"),
]


def test_common_licences_and_wrapped_rights(spark, tmp_path):
    df = spark.createDataFrame([(k, t) for k, (t, _) in enumerate(FURTHER)], "doc_id long, text string")
    got = {r.doc_id: (r.licences, r.unmatched) for r in scan(df, "text", ["doc_id"]).collect()}
    assert got == {k: ([name], 0) for k, (_, name) in enumerate(FURTHER)}
    df.coalesce(1).write.parquet(f"{tmp_path}/documents.parquet")
    con = duckdb.connect()
    con.execute(f"create view documents as select * from '{tmp_path}/documents.parquet/*.parquet'")
    assert sorted(con.sql(ORACLES["op10_licences"]).fetchall()) == sorted(map(tuple, op10_licences(spark, str(tmp_path)).collect()))
