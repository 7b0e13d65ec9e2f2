"""Text scalars as Column expressions. White space at the ends is stripped by pattern, not with trim(), which takes
spaces only."""

from __future__ import annotations

import html

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

TAG, BREAK, ANY_TAG = r"<[a-zA-Z/][^>]*>", r"(?i)<br\s*/?>|</p>|</div>|</li>", r"<[^>]+>"
# Arabic letters and the Persian ones that replace them.
LETTERS = [("ي", "ی"), ("ى", "ی"), ("ك", "ک"), ("ۀ", "هٔ")]
# Patterns of entities in a text.
URL = r"(?i)https?://[^\s<>\"]+|www\.[^\s<>\"]+"
HASHTAG, MENTION, NUMBER = r"#([\w؀-ۿ]+)", r"@([\w؀-ۿ]{2,64})", r"\d+(?:[.,/]\d+)*"
CURRENCY = (
    r"(?i)(?:[$€£¥₹₽₺]|USD|EUR|GBP|IRR|IRT|تومان|ریال|دلار|یورو)\s?\d[\d.,/]*"
    r"|\d[\d.,/]*\s?(?:USD|EUR|GBP|IRR|IRT|تومان|ریال|دلار|یورو)"
)


def strip(c: Column) -> Column:
    return F.regexp_replace(c, r"^\s+|\s+$", "")


@F.pandas_udf(StringType())
def nfkc(texts: pd.Series) -> pd.Series:
    return texts.str.normalize("NFKC")


@F.pandas_udf(StringType())
def unescape(texts: pd.Series) -> pd.Series:
    return texts.map(html.unescape, na_action="ignore")


def strip_html(c: Column) -> Column:
    """Block ends become line ends, other tags go; entities are decoded. A text without a tag stays as it is."""
    bare = F.when(c.rlike(TAG), F.regexp_replace(F.regexp_replace(c, BREAK, "\n"), ANY_TAG, ""))
    coded = unescape(F.when(F.contains(bare, F.lit("&")), bare))  # only texts with entities go to Python; a null comes back as null
    return F.coalesce(coded, bare, c)


# Control characters but tab and line ends, and marks of direction.
CONTROLS = r"[\x00-\x08\x0b\x0c\x0e-\x1f\x7f-\x9f‎‏‪-‮]"


def tidy(c: Column) -> Column:
    """What normalisation does after markup and NFKC: control and direction marks, letters, joiners, white space."""
    c = F.regexp_replace(c, CONTROLS, "")
    for old, new in LETTERS:
        c = F.replace(c, F.lit(old), F.lit(new))
    c = F.regexp_replace(c, "ـ+", "")
    c = F.regexp_replace(F.regexp_replace(c, "‌{2,}", "‌"), r"\s+‌|‌\s+", " ")
    c = F.regexp_replace(F.regexp_replace(c, r"\r\n|\r", "\n"), r"[^\S\n\r]+", " ")
    return strip(F.regexp_replace(F.regexp_replace(c, r" *\n *", "\n"), r"\n{3,}", "\n\n"))


def normalize(c: Column) -> Column:
    """The normal form for hashing and matching; a null text gives the empty one."""
    c = strip_html(F.coalesce(c, F.lit("")))
    return tidy(F.coalesce(nfkc(F.when(c.rlike(r"[^\x00-\x7f]"), c)), c))  # ASCII is its own NFKC and need not go to Python


def text_hash(c: Column) -> Column:
    """SHA-256 in hex; of an empty or null text the empty string."""
    c = F.coalesce(c, F.lit(""))
    return F.when(c == "", "").otherwise(F.sha2(c, 256))


def row_hash(c: Column) -> Column:
    """SHA-256 of the stripped text, null where that is blank: a blank row must not collide with others."""
    s = strip(c)
    return F.when(s != "", F.sha2(s, 256))


def clustering_text(title: Column, body: Column, title_chars: int = 500, body_chars: int = 2000) -> Column:
    t, b = F.substring(strip(F.coalesce(title, F.lit(""))), 1, title_chars), F.substring(strip(F.coalesce(body, F.lit(""))), 1, body_chars)
    return F.when((t != "") & (b != ""), F.concat(t, F.lit("\n\n"), b)).otherwise(F.concat(t, b))


def tokens(c: Column) -> Column:
    s = F.btrim(F.lower(F.coalesce(c, F.lit(""))), F.lit(" \t\n\x0b\f\r"))  # what \s is, by character and at the true ends only
    return F.when(s == "", F.array().cast("array<string>")).otherwise(F.split(s, r"\s+"))


def bound(value: Column, f) -> Column:
    """f of a value that is computed once, however often f's lambdas use it."""
    return F.transform(F.array(value), f)[0]


def shingles(words: Column, k: int = 5) -> Column:
    """Distinct runs of k words; of fewer words the whole text as one; of none, none."""

    def runs(w):
        n = F.size(w)
        all_runs = F.transform(F.sequence(F.lit(1), F.greatest(n - (k - 1), F.lit(1))), lambda i: F.array_join(F.slice(w, i, k), " "))
        return F.when(n == 0, F.array().cast("array<string>")).otherwise(F.array_distinct(all_runs))

    return bound(words, runs)


def shingle_numbers(words: Column, k: int = 5) -> Column:
    """64-bit numbers of the runs of k words, by place, without making their texts; of fewer words one for the whole."""

    def runs(w):
        n = F.size(w)
        each = F.transform(F.sequence(F.lit(0), F.greatest(n - k, F.lit(0))), lambda i: F.xxhash64(*[F.get(w, i + j) for j in range(k)]))
        return F.when(n == 0, F.array().cast("array<bigint>")).otherwise(each)

    return bound(words, runs)


def shingle_hashes(words: Column, k: int = 5) -> Column:
    """xxhash64 of the texts of the runs of k words, by place; of fewer words of the whole text."""

    def runs(w):
        n = F.size(w)
        each = F.transform(F.sequence(F.lit(0), F.greatest(n - k, F.lit(0))), lambda i: F.xxhash64(F.concat_ws(" ", *[F.get(w, i + j) for j in range(k)])))
        return F.when(n == 0, F.array().cast("array<bigint>")).otherwise(each)

    return bound(words, runs)


def found(c: Column, pattern: str, group: int = 0) -> Column:
    return F.regexp_extract_all(c, F.lit(pattern), F.lit(group))


def host(url: Column) -> Column:
    """Lower-case host without a leading www."""
    h = F.lower(F.regexp_extract(url, r"^(?:[A-Za-z][A-Za-z0-9+.-]*://)?(?:[^/?#@]*@)?([^/?#:]+)", 1))
    return F.regexp_replace(h, r"^www\.", "")


def metadata(title: Column, body: Column) -> Column:
    """urls, domains, hashtags, mentions, numbers, currencies, content_length, media_present."""
    blob = F.concat(F.coalesce(title, F.lit("")), F.lit("\n"), F.coalesce(body, F.lit("")))
    urls = found(blob, URL)
    low = lambda p, n: F.array_sort(F.array_distinct(F.slice(F.transform(found(blob, p, 1), F.lower), 1, n)))
    return F.struct(
        F.slice(urls, 1, 20).alias("urls"),
        F.array_distinct(F.filter(F.transform(urls, host), lambda h: h != "")).alias("domains"),
        low(HASHTAG, 20).alias("hashtags"),
        low(MENTION, 20).alias("mentions"),
        F.slice(found(blob, NUMBER), 1, 40).alias("numbers"),
        F.slice(found(blob, CURRENCY), 1, 20).alias("currencies"),
        F.length(blob).alias("content_length"),
        (F.size(urls) > 0).alias("media_present"),
    )


def content_words(c: Column) -> Column:
    return F.array_distinct(found(F.lower(F.coalesce(c, F.lit(""))), "[a-z]{3,}"))


def fact_key(c: Column) -> Column:
    """The form in which facts are compared: punctuation to spaces, lower case. Its hash is fact_hash."""
    return F.lower(strip(F.regexp_replace(F.regexp_replace(c, r"[^\w\s]", " "), r"\s+", " ")))


def fact_hash(c: Column) -> Column:
    return F.substring(F.sha2(fact_key(c), 256), 1, 16)


def sentences(c: Column, least: int = 15, most: int = 5) -> Column:
    """The first sentences of more than `least` characters, split at full stops."""
    return F.slice(F.filter(F.transform(F.split(c, r"\."), strip), lambda s: F.length(s) > least), 1, most)


def clip(c: Column, n: int) -> Column:
    return F.when(F.length(c) > n, F.concat(F.substring(c, 1, n - 1), F.lit("…"))).otherwise(c)


def truncate_at_sentence(c: Column, n: int) -> Column:
    """At most n characters, cut after the last sentence end, else the last space, in the second half of the room."""
    head = F.substring(c, 1, n)
    back = F.reverse(head)
    ends = [F.lit(n + 1) - F.instr(back, m) for m in (".", "!", "؟")]
    at = F.greatest(*[F.when(F.instr(back, m) > 0, e).otherwise(0) for m, e in zip((".", "!", "؟"), ends)])
    space = F.when(F.instr(back, " ") > 0, F.lit(n) - F.instr(back, " ")).otherwise(0)
    cut = F.when(at > n / 2, at).when(space > n / 2, space).otherwise(F.lit(n))
    return F.when(F.length(c) <= n, c).otherwise(strip(F.substring(head, F.lit(1), cut)))


def escape_html(c: Column) -> Column:
    for old, new in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;")):
        c = F.replace(c, F.lit(old), F.lit(new))
    return c


def balanced_tags(c: Column, names: tuple[str, ...] = ("b", "i", "u", "blockquote", "a")) -> Column:
    """Whether each tag is closed as often as it is opened."""
    ok = F.lit(True)
    for n in names:
        ok = ok & (F.regexp_count(c, F.lit(rf"(?i)<{n}(?:\s[^>]*)?>")) == F.regexp_count(c, F.lit(rf"(?i)</{n}>")))
    return ok


def first_json(c: Column) -> Column:
    """The outermost braces of a text, for model output with words around its JSON; null without them."""
    got = F.regexp_extract(c, r"(?s)\{.*\}", 0)
    return F.when(got != "", got)


#: Persian filler phrases that a draft goes without: fixed values.
FILLERS = [r"لازم به ذکر است(?: که)?", r"شایان ذکر است(?: که)?", "در دنیای امروز", "بدون شک", "همانطور که می‌دانید"]


def persian(text: Column) -> Column:
    """A draft without filler phrases, space before marks, runs of spaces and more than one empty line; null is empty."""
    blank = r"(?U)^\s+|\s+$"
    steps = [*[(f, "") for f in FILLERS], (r"(?U)\s+([.،؛!؟])", "$1"), (r"[ \t]+", " "), (r"\n{3,}", "\n\n"), (blank, "")]
    out = F.regexp_replace(F.coalesce(text, F.lit("")), blank, "")
    for pattern, by in steps:
        out = F.regexp_replace(out, pattern, by)
    return out
