"""JSON values whose types decide, as column expressions over VARIANT."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def whole_json(raw: Column) -> Column:
    """A text as VARIANT if it is one JSON value and nothing else, else null; repeated keys count as no JSON.

    The text is parsed as a member in front of a key that it cannot hold, its own digest: that key is only found if the text ended where its value did.
    """
    end = F.md5(raw)
    held = F.try_parse_json(F.concat(F.lit('{"v":'), raw, F.lit(',"'), end, F.lit('":0}'))).try_cast("map<string, variant>")
    return F.when((F.size(held) == 2) & F.map_contains_key(held, end), held["v"])


def is_kind(value: Column, *kinds: str) -> Column:
    """Whether a VARIANT is of one of these types, as schema_of_variant() names them; null for an absent one."""
    return F.regexp_extract(F.schema_of_variant(value), r"^\w+", 0).isin(*kinds)


def is_absent(value: Column) -> Column:
    """Whether a VARIANT is not there or a JSON null."""
    return F.coalesce(is_kind(value, "VOID"), F.lit(True))


def member(value: Column, path: str, kind: str = "variant") -> Column:
    return F.try_variant_get(value, f"$.{path}", kind)


def string_of(value: Column) -> Column:
    """The text of a JSON string; null for anything else."""
    return F.when(is_kind(value, "STRING"), F.try_variant_get(value, "$", "string"))


def is_object(value: Column) -> Column:
    return F.try_variant_get(value, "$", "map<string, variant>").isNotNull()
