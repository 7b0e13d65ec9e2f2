"""Structured answers: what a model is shown, which tasks are still to be asked, and what its answers hold, field by field.

Answers come from a table. An answer is read as a VARIANT, after fences around it are taken off; if that is no object, what
stands between its first and last brace is tried. Each declared field is then checked by type, range, length or label.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

SPACE = r"[\s\x1c-\x1f\x85\p{Z}]"
TRUE, FALSE = ["true", "1", "yes", "y", "on", "t"], ["false", "0", "no", "n", "off", "f"]
SQL_TYPE = {"text": "string", "share": "double", "flag": "boolean", "label": "string", "texts": "array<string>"}


@dataclass(frozen=True)
class Field:
    """A field of an answer. Kinds: text, label (one of `labels`), share (0 to 1), flag, texts (a list).

    `longest` bounds a text, or each text of a list, which is cut to it; `most` bounds a list. A field that is not needed
    has its default if it is missing; null counts as missing only if the field may be null."""

    name: str
    kind: str
    needed: bool = True
    default: object = None
    nullable: bool = False
    longest: int | None = None
    most: int | None = None
    labels: tuple[str, ...] = ()


def trimmed(text: Column) -> Column:
    return F.regexp_replace(F.coalesce(text, F.lit("")), f"^{SPACE}+|{SPACE}+$", "")


def read(text: Column) -> Column:
    """struct(value, status): the object as a VARIANT; status ok, repaired, invalid_json or invalid_shape.

    A null answer is invalid_json, as is an object that has a key twice."""
    bare = trimmed(text)
    inner = F.regexp_replace(trimmed(F.regexp_replace(bare, "^`+|`+$", "")), "(?i)^json", "")
    whole = F.try_parse_json(trimmed(F.when(bare.startswith("```"), inner).otherwise(bare)))
    within = F.try_parse_json(F.regexp_extract(bare, r"(?s)\{.*\}", 0))
    is_object = lambda v: F.coalesce(F.schema_of_variant(v).startswith("OBJECT"), F.lit(False))
    status = F.when(is_object(whole), "ok").when(is_object(within), "repaired").when(whole.isNull(), "invalid_json").otherwise("invalid_shape")
    return F.struct(F.when(is_object(whole), whole).when(is_object(within), within).alias("value"), status.alias("status"))


def _field(v: Column, f: Field) -> tuple[Column, Column]:
    """(value, fault) of a field; the fault is missing, type, range, length, label or null."""
    at = f"$['{f.name}']"
    kind = F.schema_of_variant(F.try_variant_get(v, at, "variant"))
    is_text = kind == "STRING"
    text = F.try_variant_get(v, at, "string")
    absent = kind.isNull() | ((kind == "VOID") & F.lit(f.nullable))
    if f.kind in ("text", "label"):
        value, typed = text, is_text
        bad = F.when(F.lit(f.kind == "label") & ~text.isin(*f.labels), "label").when(F.char_length(text) > (f.longest or (1 << 31) - 1), "length")
    elif f.kind == "share":
        value = F.when(kind.isin("BOOLEAN"), F.try_variant_get(v, at, "boolean").cast("double")).otherwise(F.when(is_text, trimmed(text)).otherwise(text).try_cast("double"))
        typed = (kind.isin("BIGINT", "DOUBLE", "FLOAT", "STRING", "BOOLEAN") | kind.startswith("DECIMAL")) & value.isNotNull()
        bad = F.when(F.isnan(value) | (value < 0) | (value > 1), "range")
    elif f.kind == "flag":
        low = F.lower(text)
        value = F.when(low.isin(*TRUE), True).when(low.isin(*FALSE), False)
        typed, bad = (is_text | kind.isin("BOOLEAN", "BIGINT")) & value.isNotNull(), F.lit(None).cast("string")
    elif f.kind == "texts":
        value = F.try_variant_get(v, at, "array<string>")
        typed = kind.isin("ARRAY<STRING>", "ARRAY<VOID>") & ~F.exists(value, lambda x: x.isNull())
        bad = F.when(F.size(value) > (f.most or (1 << 31) - 1), "length")
        value = value if f.longest is None else F.transform(value, lambda x: F.substring(x, 1, f.longest))
    else:
        raise ValueError(f"no kind of field is called {f.kind}")
    default = F.array(*map(F.lit, f.default)) if isinstance(f.default, (list, tuple)) else F.lit(f.default)
    fault = F.when(absent, F.lit("missing" if f.needed else None)).when(~F.coalesce(typed, F.lit(False)), "type").otherwise(bad)
    return F.when(absent, default.cast(SQL_TYPE[f.kind])).otherwise(value.cast(SQL_TYPE[f.kind])), fault


def checked(rows: DataFrame, answer: str, fields: list[Field]) -> DataFrame:
    """rows with status, faults and value. status: ok, repaired, invalid_json, invalid_shape or invalid_fields; faults: a
    `field: fault` for each wrong field in order of declaration; value: the fields, null unless the status is ok or repaired."""
    got = rows.withColumn("__read", read(F.col(answer))).withColumn("__v", F.col("__read.value"))
    pairs = [(f, *_field(F.col("__v"), f)) for f in fields]
    faults = F.array_compact(F.array(*[F.when(fault.isNotNull(), F.concat(F.lit(f"{f.name}: "), fault)) for f, _, fault in pairs]))
    got = got.withColumn("faults", F.when(F.col("__v").isNotNull(), faults).otherwise(F.array().cast("array<string>")))
    fine = F.col("__v").isNotNull() & (F.size("faults") == 0)
    status = F.when(F.col("__v").isNotNull() & ~fine, "invalid_fields").otherwise(F.col("__read.status"))
    value = F.when(fine, F.struct(*[value.alias(f.name) for f, value, _ in pairs]))
    return got.withColumn("status", status).withColumn("value", value).drop("__read", "__v")


def pending(tasks: DataFrame, ledger: DataFrame, keys: list[str], as_of: Column, expires: str) -> DataFrame:
    """Tasks that the ledger has no answer to which is still good: without an end, or with one after as_of. A key that is null
    on both sides is the same; tasks of equal keys stay as they are."""
    good = ledger.where(F.col(expires).isNull() | (F.col(expires) > as_of)).select(*[F.col(k).alias(f"__{k}") for k in keys]).distinct()
    same = F.lit(True)
    for k in keys:
        same = same & F.col(k).eqNullSafe(F.col(f"__{k}"))
    return tasks.join(good, same, "left_anti")


def clip(text: Column, most: int) -> Column:
    """The trimmed text, cut to `most` characters and an ellipsis if it is longer."""
    t = trimmed(text)
    return F.when(F.char_length(t) > most, F.concat(F.substring(t, 1, most), F.lit("…"))).otherwise(t)


def evidence(members: DataFrame, story: str, primary: str, added: str, key: str, items: int = 6, urls: int = 12) -> DataFrame:
    """story, items, urls. Of a story's members (with source, title, text, url) the first ones, primary ones before others,
    then by time and key: source, title (220 characters) and text (900) of each, and their different addresses, at most
    `urls`, in order. No more than `items` rows of a story leave a task."""
    by = W.partitionBy(story).orderBy(F.desc(F.coalesce(primary, F.lit(False))), F.asc_nulls_last(added), key)
    some = members.withColumn("n", F.row_number().over(by)).where(F.col("n") <= items)
    one = F.struct("n", F.coalesce("source", F.lit("")).alias("source"), clip(F.col("title"), 220).alias("title"), clip(F.col("text"), 900).alias("text"), "url")
    got = some.groupBy(story).agg(F.array_sort(F.collect_list(one)).alias("all"))
    found = F.array_distinct(F.filter(F.transform("all", lambda x: x["url"]), lambda u: u.isNotNull() & (u != "")))
    return got.select(story, F.transform("all", lambda x: F.struct(x["source"].alias("source"), x["title"].alias("title"), x["text"].alias("text"))).alias("items"), F.slice(found, 1, urls).alias("urls"))
