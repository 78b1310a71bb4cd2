"""Text column expressions: normal forms, skeletons, sanitising, redaction."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

from groundtally.functions import fixed_values as V


def normal_form(c: Column) -> Column:
    """Lower case, single spaces, no commas, no trailing period."""
    bare = F.regexp_replace(F.regexp_replace(F.lower(c), r"^\s+|\s+$", ""), r"\.+$", "")
    return F.regexp_replace(F.regexp_replace(bare, ",", ""), r"\s+", " ")


def skeleton(c: Column) -> Column:
    return F.regexp_replace(c, V.NUMBER_RUN, "<N>")


def answer_bucket(c: Column) -> Column:
    return F.when(F.length(c) < V.LONG_ANSWER, c).otherwise(F.lit("<LONG>"))


def sanitise(c: Column, limit: int = V.METADATA_LIMIT) -> Column:
    """Drops control, format, private-use and surrogate characters, squeezes space, caps the length."""
    clean = F.regexp_replace(c, r"[\p{Cc}\p{Cf}\p{Co}\p{Cs}]", "")
    return F.substring(F.trim(F.regexp_replace(clean, r"(?U)\s+", " ")), 1, limit)


def looks_secret(c: Column) -> Column:
    return c.rlike("|".join(V.SECRET_VALUES))


def secret_key(c: Column) -> Column:
    return F.lower(c).rlike("|".join(re.escape(m) for m in V.SECRET_KEY_MARKERS))


def redact_value(c: Column) -> Column:
    return F.when(looks_secret(c), F.lit(V.REDACTED)).otherwise(c)


def redact_map(m: Column) -> Column:
    """Masks values under secret-bearing keys and secret-shaped values anywhere."""
    return F.transform_values(m, lambda k, v: F.when(secret_key(k), F.lit(V.REDACTED)).otherwise(redact_value(v)))


def redact_paths(c: Column, root: str) -> Column:
    """Absolute paths below ``root`` become relative, all others a placeholder."""
    base = re.escape(root.rstrip("/"))
    whole = F.trim(c).rlike(r"^(?:[/\\]|[A-Za-z]:[\\/])")
    inside = F.regexp_extract(F.trim(c), rf"^{base}/(.+)$", 1)
    alone = F.when(inside != "", inside).when(F.trim(c) == root.rstrip("/"), F.lit(".")).otherwise(F.lit(V.EXTERNAL_PATH))
    space = r"(^|(?<=\s))"
    kept = F.regexp_replace(c, rf"{space}{base}/([^\s\"'<>|*?]+)", "$2")
    kept = F.regexp_replace(kept, r"[A-Za-z]:[\\/][^\n\r\"'<>|*?]*|\\\\[^\n\r\"'<>|*?]*", V.EXTERNAL_PATH)
    kept = F.regexp_replace(kept, rf"{space}/[^\s\"'<>|*?]+", V.EXTERNAL_PATH)
    return F.when(whole, alone).otherwise(kept)
