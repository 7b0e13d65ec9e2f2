"""Structured answers: shapes, fields and their faults, and the ledger, against hand-written results."""

import json
from datetime import datetime

import pytest
from pyspark.sql import functions as F

from tidewire.operators import answers as A
from tidewire.operators.answers import Field

FIELDS = [
    Field("label", "label", labels=("A", "B")),
    Field("sure", "share"),
    Field("is", "flag", needed=False, default=False),
    Field("note", "text", needed=False, default="", longest=5),
    Field("slug", "text", needed=False, nullable=True),
    Field("codes", "texts", needed=False, default=["none"], most=2, longest=3),
]
GOOD = {"label": "A", "sure": 0.5}
FILLED = ("A", 0.5, False, "", None, ["none"])

SHAPES = {
    json.dumps(GOOD): ("ok", FILLED),
    f" \n```json\n{json.dumps(GOOD)}\n``` ": ("ok", FILLED),
    f"```JSON{json.dumps(GOOD)}```": ("ok", FILLED),
    f"Yes: {json.dumps(GOOD)} that's it": ("repaired", FILLED),
    json.dumps([GOOD]): ("repaired", FILLED),
    '{"label": "A", "sure": ': ("invalid_json", None),
    '{"label": "A", "label": "B", "sure": 1}': ("invalid_json", None),
    "[1, 2]": ("invalid_shape", None),
    "3": ("invalid_shape", None),
    "null": ("invalid_shape", None),
    "": ("invalid_json", None),
    "} {": ("invalid_json", None),
    "x" * 200_000: ("invalid_json", None),
}


def test_shapes_of_answers(spark):
    rows = spark.createDataFrame([(k,) for k in [*SHAPES, None]], "answer string")
    got = {r.answer: (r.status, r.value and tuple(r.value)) for r in A.checked(rows, "answer", FIELDS).collect()}
    assert got == {**SHAPES, None: ("invalid_json", None)}


@pytest.mark.parametrize(
    "change, faults, value",
    [
        ({"label": "C"}, ["label: label"], None),
        ({"label": 1}, ["label: type"], None),
        ({"label": None}, ["label: type"], None),
        ({"sure": 1.01, "label": "C"}, ["label: label", "sure: range"], None),
        ({"sure": "0.25"}, [], ("A", 0.25, False, "", None, ["none"])),
        ({"sure": 1}, [], ("A", 1.0, False, "", None, ["none"])),
        ({"sure": "high"}, ["sure: type"], None),
        ({"sure": "NaN"}, ["sure: range"], None),
        ({"sure": [0.5]}, ["sure: type"], None),
        ({"is": "yes", "note": "fünf!"}, [], ("A", 0.5, True, "fünf!", None, ["none"])),
        ({"is": 2}, ["is: type"], None),
        ({"note": "sechs!"}, ["note: length"], None),
        ({"note": None}, ["note: type"], None),
        ({"slug": None}, [], FILLED),
        ({"slug": {"a": 1}}, ["slug: type"], None),
        ({"codes": []}, [], ("A", 0.5, False, "", None, [])),
        ({"codes": ["abcd", "e"]}, [], ("A", 0.5, False, "", None, ["abc", "e"])),
        ({"codes": ["a", "b", "c"]}, ["codes: length"], None),
        ({"codes": ["a", 1]}, ["codes: type"], None),
        ({"codes": "a"}, ["codes: type"], None),
        ({"codes": ["a", None]}, ["codes: type"], None),
        ({"more": {"deep": [1]}}, [], FILLED),
    ],
)
def test_fields(spark, change, faults, value):
    rows = spark.createDataFrame([(json.dumps({**GOOD, **change}),)], "answer string")
    r = A.checked(rows, "answer", FIELDS).first()
    assert (r.faults, r.value and tuple(r.value), r.status) == (faults, value, "invalid_fields" if faults else "ok")


def test_the_ledger_and_evidence(spark):
    tasks = spark.createDataFrame([(1, "a"), (1, "a"), (2, "b"), (3, None), (4, "d"), (None, "e")], "n int, h string")
    t = datetime(2024, 1, 2)
    done = spark.createDataFrame([(1, "a", None), (2, "b", t), (2, "b", datetime(2023, 1, 1)), (3, None, datetime(2024, 1, 3)), (5, "z", None)], "n int, h string, ends timestamp")
    left = A.pending(tasks, done, ["n", "h"], F.lit("2024-01-02").cast("timestamp"), "ends").collect()
    assert sorted(map(str, map(tuple, left))) == sorted(map(str, [(2, "b"), (4, "d"), (None, "e")]))
    assert A.pending(tasks, done.limit(0), ["n", "h"], F.current_timestamp(), "ends").count() == 6
    m = spark.createDataFrame([("s", i, i == 7, f"src{i}", " t" * 200, None if i == 2 else "y" * 900 + "z" * (i % 2), f"u{i % 2}" if i else None) for i in range(9)] + [(None, 1, None, None, None, None, "")], "story string, at int, first boolean, source string, title string, text string, url string")
    got = {r.story: r for r in A.evidence(m, "story", "first", "at", "at").collect()}
    assert [x.source for x in got["s"]["items"]] == ["src7", "src0", "src1", "src2", "src3", "src4"] and got["s"].urls == ["u1", "u0"]
    assert got["s"]["items"][0].title == ("t " * 110)[:220] + "…" and [len(x.text) for x in got["s"]["items"]] == [901, 900, 901, 0, 901, 900]
    assert tuple(got[None]["items"][0]) == ("", "", "") and got[None].urls == []
