import numpy as np
import pytest
from pyspark.sql import functions as F

from tidewire.llm.langid import Settings, bound, counts, fit, predict

WORDS = {"aa": "salo mire tavo kelu", "bb": "xqurt vrznk ptkss wlmpf", "cc": "öäü ßöß äüö"}


def docs(spark):
    rng = np.random.default_rng(3)
    rows = [(i, " ".join(rng.choice(WORDS[k].split(), 12)), k, 0.5) for i in range(240) for k in [list(WORDS)[i % 3]]]
    rows += [(900, None, "aa", 0.5), (901, "", "bb", 0.5), (902, "12 34 !!", "cc", 0.5), (903, "salo", None, 0.5), (None, "salo mire", "aa", 0.5)]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, score double")


def test_held_out_accuracy_and_defined_cases(spark):
    df = docs(spark)
    model = fit(df.where("doc_id % 3 = 0 or doc_id % 5 = 0"), "text", "lang", F.col("doc_id"), Settings(per_language=30))
    got = {r.doc_id: r for r in predict(df.drop("score"), model, "text", ["doc_id", "lang"]).collect()}
    assert len(got) == df.count()
    assert all(got[i].lang_pred == got[i].lang and not got[i].rejected for i in range(240))
    assert all(got[i].lang_pred == "und" and got[i].score == 0 and got[i].rejected for i in (900, 901, 902))
    assert got[903].lang_pred == "aa" and 0 <= got[903].score <= 1


def test_far_text_is_rejected(spark):
    model = fit(docs(spark), "text", "lang", F.col("doc_id"), Settings(per_language=30))
    far = spark.createDataFrame([(1, "ждлорп эюяфыв " * 40)], "doc_id long, text string")
    assert predict(far, model, "text", ["doc_id"]).first().rejected


def test_steps_do_not_change_counts():
    import tidewire.llm.langid as m

    text = "Abc déf, ghi -- jkl.  Mno" * 40
    whole, step = counts(text, 256), m._STEP
    m._STEP = 2048
    try:
        again = counts(text, 256)
    finally:
        m._STEP = step
    assert whole[1] == again[1] and (whole[0] == again[0]).all()


def test_nothing_to_learn_and_empty_table(spark):
    df = docs(spark)
    model = fit(df.limit(0), "text", "lang", F.col("doc_id"))
    assert {r.lang_pred for r in predict(df, model, "text", ["doc_id"]).collect()} == {"und"}
    assert predict(df.limit(0), model, "text", ["doc_id"]).count() == 0


def test_symbols_beyond_the_basic_plane_are_no_letters(spark):
    assert counts("\U0001f642\U0001f680 \U0001f600", 256)[1] == 0 and counts("\U00020000\U0001d400", 256)[1] == 2
    assert (counts("salo\U0001f642mire", 256)[0] == counts("salo mire", 256)[0]).all()
    model = fit(docs(spark), "text", "lang", F.col("doc_id"), Settings(per_language=30))
    got = predict(spark.createDataFrame([(1, "\U0001f642\U0001f680" * 20)], "doc_id long, text string"), model, "text", ["doc_id"]).first()
    assert (got.lang_pred, got.score, got.rejected) == ("und", 0.0, True)


def plain_counts(text, dims):
    """n-gram counts and letters by loops over characters."""
    out, letters, chars = {}, 0, [32]
    for ch in (text or "").lower():
        if ch.isalpha():
            letters += 1
            chars.append(ord(ch))
        elif chars[-1] != 32 or len(chars) == 1:
            chars.append(32)
    for n in (2, 3):
        for i in range(len(chars) - n + 1):
            h = chars[i] * 0x9E3779B1 % 2**32
            for k in range(1, n):
                h = (h ^ chars[i + k]) * 0x85EBCA6B % 2**32
            out[(h >> 16) % dims] = out.get((h >> 16) % dims, 0) + 1
    return out, letters


def test_prediction_equals_a_plain_version(spark):
    """TF-IDF and cosine by loops, for texts of all kinds: ties, repeats, null, empty, symbols, other scripts, very long."""
    model = fit(docs(spark), "text", "lang", F.col("doc_id"), Settings(per_language=30, dims=512))
    texts = ["salo mire", "SALO, mire!", "xqurt", "öäü ßöß", None, "", "12 !?", "a", "salo xqurt öäü", "\U0001f642 salo", "日本語 текст", "tavo " * 50_000, "salo mire", " salo\u00a0mire ", "İI ﬁ ǅ"]
    got = {r.doc_id: r for r in predict(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), model, "text", ["doc_id"]).collect()}
    for i, text in enumerate(texts):
        found, letters = plain_counts(text, 512)
        own = {k: n**0.5 * model.idf[k] for k, n in found.items()}
        norm = sum(x * x for x in own.values()) ** 0.5 or 1
        cos = [sum(x * float(c[k]) for k, x in own.items()) / norm for c in model.centroids]
        want = max(range(len(cos)), key=lambda j: (round(cos[j], 5), -j))
        if not letters:
            assert (got[i].lang_pred, got[i].score, got[i].rejected) == ("und", 0.0, True)
        else:
            assert abs(got[i].score - min(1, max(0, max(cos)))) < 1e-4 and cos[model.languages.index(got[i].lang_pred)] <= max(cos)
            assert got[i].lang_pred == model.languages[want], (text, cos)
            size = min(11, int(np.log2(letters)))
            assert got[i].rejected == (got[i].score < model.floor[size])


def test_learning_is_bounded_with_repeats_and_many_languages(spark):
    rows = [(1, "salo mire tavo", "aa")] * 3000 + [(1, f"xqurt {w}", "bb") for w in WORDS["bb"].split() * 200] + [(i, "kelu", f"z{i:04d}") for i in range(40)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string").repartition(7)
    model = fit(df, "text", "lang", F.col("doc_id"), Settings(per_language=5, languages=3))
    assert set(model.languages) == {"aa", "bb", "z0000"} and len(model.languages) <= 3 * 4
    again = fit(df.repartition(3), "text", "lang", F.col("doc_id"), Settings(per_language=5, languages=3))
    assert again.languages == model.languages and (again.centroids == model.centroids).all()


@pytest.mark.parametrize("n", [1, 799, 800, 801, 10**6, 8 * 10**8, 10**9, 10**12, 10**15])
def test_draw_has_no_size_at_which_a_language_is_lost(n):
    """The expected number of n evenly spread 64-bit hashes up to the bound."""
    share = (bound(n, 400) + (1 << 63) + 1) / 2**64
    assert share * n == pytest.approx(min(n, 800), rel=1e-6)


def test_five_hundred_languages_of_four_hundred_texts(spark):
    """Under the session's limit of 1 GB for results; dense counts of the same texts would be 3.2 GB."""
    assert spark.conf.get("spark.driver.maxResultSize", "1g") == "1g"
    alphabet = F.udf(lambda lang, i: " ".join(chr(0x4E00 + lang * 30 + (i * 7 + k * (1 + i % 5)) % 30) * 2 for k in range(20)), "string")
    rows = spark.range(500 * 400).repartition(16).select((F.col("id") % 500).cast("int").alias("n"), (F.col("id") / 500).cast("int").alias("i"))
    rows = rows.select(F.concat(F.lit("l"), F.lpad(F.col("n").cast("string"), 3, "0")).alias("lang"), F.concat(alphabet("n", "i"), F.lit(" "), F.col("i").cast("string")).alias("text"), F.col("i"))
    model = fit(rows, "text", "lang", F.col("i"), Settings(rounds=2))
    assert len(set(model.languages)) == 500 and len(model.languages) <= 2000
    got = predict(rows.where("i = 5"), model, "text", ["lang"])
    assert got.where("lang = lang_pred").count() >= 495


def test_names_of_outputs_are_not_allowed_in_keep(spark):
    df = docs(spark)
    with pytest.raises(ValueError):
        predict(df, fit(df.limit(0), "text", "lang", F.col("doc_id")), "text", ["score"])
