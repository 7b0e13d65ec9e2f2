import random

import duckdb
import public_tokenizers
import pytest
import sentencepiece

from tidewire.llm.sentencepieces import MARK, Pieces, decode, encode

PATH = public_tokenizers.path("piece_bpe_32k.model")


def brute(pieces, worst, text):
    """Best score over all segmentations, by recursion over prefixes."""
    table = {t: s for t, _, s in pieces}
    best = [0.0]
    for e in range(1, len(text) + 1):
        options = [best[s] + table[text[s:e]] for s in range(e) if text[s:e] in table]
        if text[e - 1] not in table:
            options.append(best[e - 1] + worst)
        best.append(max(options, default=float("-inf")))
    return best[-1]


@pytest.mark.parametrize("seed", range(80))
def test_best_score_equals_brute_force(seed):
    rng = random.Random(seed)
    texts = {"".join(rng.choice("abc") for _ in range(rng.randint(1, 4))) for _ in range(9)}
    model = [(t, i, float(rng.randint(-20, 0))) for i, t in enumerate(sorted(texts))]
    p = Pieces(model, [], len(model))
    text = "".join(rng.choice("abcd") for _ in range(14))
    score = {i: s for _, i, s in model}
    got = p.best(text)
    if brute(model, p.worst, text) > float("-inf"):
        assert sum(score.get(i, p.worst) for i in got) == brute(model, p.worst, text)


def as_unigram() -> bytes:
    """The same model with its trainer's model type set to unigram: field 2 (trainer spec), in it field 3 from 2 to 1."""
    raw = bytearray(open(PATH, "rb").read())
    at = raw.rindex(b"tok_v0") + len(b"tok_v0")
    assert raw[at : at + 2] == b"\x18\x02"
    raw[at + 1] = 1
    return bytes(raw)


def test_equals_the_library_reading_the_pieces_as_unigram():
    lib = sentencepiece.SentencePieceProcessor(model_proto=as_unigram())
    own = Pieces.load(PATH)
    texts = [r[0] for r in duckdb.sql("select text from '/root/testdata/sf0.001/documents.parquet' where n_chars < 3000").fetchall()]
    words = {w for t in texts for w in t.split() if all(own.automaton.exists(c) for c in w)} | {"a", "it", "hest"}
    score = lambda ids: sum(lib.get_score(i) for i in ids)
    for w in words:  # its list of best paths comes from the exact lattice
        best, *_ = lib.nbest_encode(w, nbest_size=3)
        got = own.encode(w).tolist()
        assert score(got) == score(best) and lib.decode(got) == w == own.decode(got)


def test_round_trip_and_defined_cases(spark):
    rows = [(1, "Hello  world\n\tx é", "a"), (2, None, "b"), (3, "", "c"), (4, " 日本🙂\u0000 ", None), (None, "x" * 5000, "d"), (1, "Hello  world\n\tx é", "a")]
    df = spark.createDataFrame(rows, "doc_id long, text string, ids string")
    got = encode(df, PATH, "text", ["doc_id"])
    back = decode(got, PATH, ["doc_id"]).collect()
    assert sorted((r.doc_id or 0, r.text) for r in back) == sorted((a or 0, t or "") for a, t, _ in rows)
    assert encode(df.limit(0), PATH, "text", ["doc_id"]).count() == 0


def test_units_equal_whole_text():
    own = Pieces.load(PATH)
    text = "The  old  mill\nby the river   runs.  "
    assert own.encode(text).tolist() == own.best(MARK + text.replace(" ", MARK))
