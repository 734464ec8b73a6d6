"""Structured replies of a summarising model: every field checked by type and bound, then in one canonical shape."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from voxlake.functions.text import canonical_language, fold, strip
from voxlake.functions.variants import is_absent, is_kind, is_object, member, string_of, whole_json

# Bounds in items and characters (fixed values of the reply's contract).
POINTS, POINT, ACTIONS, ACTION, OWNER, DUE, NAMES, NAME, TITLE, OVERVIEW, LANGUAGE = 30, 1000, 30, 1000, 200, 32, 50, 200, 200, 8000, 32
MAP_OVERVIEW, MAP_POINTS, MAP_POINT, TAGS, TAG = 4000, 15, 500, 50, 64
FENCE = r"(?s)\A\s*```(?:json)?\s*(.*?)\s*```\s*\z"


def reply_json(raw: Column) -> Column:
    """The JSON of a reply, which may stand in a fence of three backticks; null if it is no single value."""
    return whole_json(F.when(raw.rlike(FENCE), F.regexp_extract(raw, FENCE, 1)).otherwise(raw))


def _no_text(value: Column, most: int, empty: bool = False) -> Column:
    """Whether a VARIANT is no string of 1 to `most` characters after stripping."""
    text = strip(string_of(value))
    good = text.isNotNull() & (F.length(text) <= most)
    return ~F.coalesce(good if empty else good & (text != ""), F.lit(False))


def _items(value: Column) -> Column:
    """The items of an array; an absent or null one has none."""
    return F.when(is_absent(value), F.array().cast("array<variant>")).otherwise(F.try_variant_get(value, "$", "array<variant>"))


def _no_list(value: Column, most: int, bad) -> Column:
    """Whether a VARIANT is neither absent nor an array of at most `most` items of which none is bad."""
    items = _items(value)
    return items.isNull() | (F.size(items) > most) | F.exists(items, bad)


def _level(item: Column) -> Column:
    value = member(item, "level")
    return F.when(is_kind(value, "BIGINT"), F.try_variant_get(value, "$", "int"))


def _skips(points: Column) -> Column:
    """Whether a numbered point lies more than one level below the numbered one before it; level 0 has no number."""
    numbered = F.filter(F.transform(points, _level), lambda n: n > 0)
    return F.exists(F.zip_with(numbered, F.concat(F.array(F.lit(0)), numbered), lambda n, before: F.coalesce(n > before + 1, F.lit(False))), lambda x: x)


def _texts(value: Column) -> Column:
    return F.transform(_items(value), lambda x: strip(string_of(x)))


def checked_replies(replies: DataFrame, allowed: DataFrame) -> DataFrame:
    """id, fault and the canonical fields of final replies (id, raw, source_language).

    fault: the first field that breaks its rule (malformed_json for what is no object), null if none does; the fields of a reply with a fault are
    null. A known source language counts, whatever the reply says; without one the reply's must be empty or a language tag. Suggested tags
    are matched by folded name with allowed (name_key, name): resolved ones in order, each once, `unknown` only where it is alone; others are rejected.
    """
    v = replies.select("id", canonical_language(F.coalesce("source_language", F.lit(""))).alias("source"), reply_json(F.col("raw")).alias("v"))
    names = ("title", "overview", "key_points", "action_items", "people", "organizations", "topics", "language", "suggested_tags")
    v = v.select("id", "source", is_object(F.col("v")).alias("object"), *(member(F.col("v"), n).alias(n) for n in names))
    col = F.col
    none_or = lambda item, field, most: ~is_absent(member(item, field)) & _no_text(member(item, field), most)
    spoken = F.coalesce(strip(string_of(col("language"))), F.lit(""))
    bad = {
        "title": _no_text(col("title"), TITLE), "overview": _no_text(col("overview"), OVERVIEW),
        "key_points": _no_list(col("key_points"), POINTS, lambda p: ~is_object(p) | _no_text(member(p, "text"), POINT) | ~F.coalesce(_level(p).between(0, 3), F.lit(False))) | _skips(_items(col("key_points"))),
        "action_items": _no_list(col("action_items"), ACTIONS, lambda p: ~is_object(p) | _no_text(member(p, "text"), ACTION) | none_or(p, "owner", OWNER) | none_or(p, "due_date", DUE)),
        **{n: _no_list(col(n), NAMES, lambda x: _no_text(x, NAME)) for n in ("people", "organizations", "topics")},
        "language": col("language").isNotNull() & _no_text(col("language"), LANGUAGE, empty=True) | (col("source") == "") & (spoken != "") & (canonical_language(spoken) == ""),
        "suggested_tags": _no_list(col("suggested_tags"), TAGS, lambda x: _no_text(x, TAG)),
    }
    fault = F.when(~col("object"), "malformed_json")
    for name, is_bad in bad.items():
        fault = fault.when(F.coalesce(is_bad, F.lit(True)), name)
    text = lambda item, field: strip(string_of(member(item, field)))
    points = F.transform(_items(col("key_points")), lambda p: F.struct(text(p, "text").alias("text"), _level(p).alias("level")))
    actions = F.transform(_items(col("action_items")), lambda p: F.struct(*(text(p, f).alias(f) for f in ("text", "owner", "due_date"))))
    language = F.when(col("source") != "", col("source")).otherwise(canonical_language(spoken))
    fields = {"title": strip(string_of(col("title"))), "overview": strip(string_of(col("overview"))), "key_points": points, "action_items": actions, **{n: _texts(col(n)) for n in ("people", "organizations", "topics")}, "language": language, "asked": _texts(col("suggested_tags"))}
    v = v.withColumn("fault", fault)
    v = v.select("id", "fault", *(F.when(col("fault").isNull(), x).alias(n) for n, x in fields.items()))
    each = v.select("id", F.posexplode("asked").alias("at", "name")).withColumn("name_key", fold("name"))
    known = allowed.select("name_key", F.col("name").alias("own")).dropDuplicates(["name_key"])
    met = each.join(known, "name_key", "left").groupBy("id").agg(F.array_sort(F.collect_list(F.struct("at", "name", "name_key", "own"))).alias("met"))  # at most TAGS of a reply
    found = F.array_distinct(F.transform(F.filter("met", lambda m: m["own"].isNotNull()), lambda m: F.struct(m["name_key"].alias("k"), m["own"].alias("own"))))
    real = F.filter(found, lambda m: m["k"] != "unknown")
    chosen = F.transform(F.when((F.size(found) > 1) & (F.size(real) > 0), real).otherwise(found), lambda m: m["own"])
    rejected = F.transform(F.filter("met", lambda m: m["own"].isNull()), lambda m: m["name"])
    none = F.when(col("fault").isNull(), F.array().cast("array<string>"))
    tags = met.select("id", chosen.alias("suggested"), rejected.alias("rejected"))
    return v.drop("asked").join(tags, "id", "left").withColumns({n: F.coalesce(n, none) for n in ("suggested", "rejected")})


def checked_parts(replies: DataFrame) -> DataFrame:
    """id, fault, overview and key_points of replies (id, raw) about a part of a transcript: an overview and a list of texts, with bounds of their own."""
    v = replies.select("id", reply_json(F.col("raw")).alias("v"))
    v = v.select("id", is_object(F.col("v")).alias("object"), *(member(F.col("v"), n).alias(n) for n in ("overview", "key_points")))
    fault = (
        F.when(~F.col("object"), "malformed_json").when(_no_text(F.col("overview"), MAP_OVERVIEW), "overview")
        .when(F.coalesce(_no_list(F.col("key_points"), MAP_POINTS, lambda x: _no_text(x, MAP_POINT)), F.lit(True)), "key_points")
    )
    v = v.withColumn("fault", fault)
    return v.select("id", "fault", F.when(F.col("fault").isNull(), strip(string_of(F.col("overview")))).alias("overview"), F.when(F.col("fault").isNull(), _texts(F.col("key_points"))).alias("key_points"))
