"""Kept columns that are named like an output: an error of the call in every operator that keeps columns."""

import pytest

from tidewire.llm.html_extraction import main_text
from tidewire.llm.langid import Model, predict
from tidewire.llm.media import read_media, to_media
from tidewire.llm.quality import assess
from tidewire.llm.substrings import dedup


@pytest.mark.parametrize("name", ["words", "spans", "path", "Consensus", "n_bytes", "media", "payload", "rgb", "lang_pred", "rejected", "score", "quality"])
def test_clash_is_told_before_anything_runs(spark, name):
    df = spark.createDataFrame([(1, "a b", "u", b"x", "c")], f"doc_id long, text string, url string, bytes binary, {name} string")
    calls = {
        "words": lambda: dedup(df, "doc_id", "text", ["doc_id", name]),
        "path": lambda: main_text(df, "url", "text", [name]),
        "n_bytes": lambda: to_media(df, "text", [name]),
        "payload": lambda: read_media(df, [name]),
        "lang_pred": lambda: predict(df, Model([], None, [], None), "text", [name]),
        "score": lambda: assess(df, None, "text", [name]),
    }
    of = {"spans": "words", "Consensus": "path", "media": "n_bytes", "rgb": "payload", "rejected": "lang_pred", "quality": "score"}
    with pytest.raises(ValueError, match=name.lower()):
        calls[of.get(name, name)]()
