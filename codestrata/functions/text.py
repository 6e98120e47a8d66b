"""Text expressions on columns: tokens, titles and paths, without Python functions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def tokens(text: Column) -> Column:
    """K1: lower-case tokens of two characters or more, split at camel-case borders and other characters; repeats stay."""
    spaced = F.regexp_replace(text, "([a-z])([A-Z])", "$1 $2")
    return F.filter(F.split(F.lower(spaced), "[^a-z0-9]+"), lambda t: F.length(t) > 1)


def title(text: Column) -> Column:
    """Every letter after a non-letter in upper case, all others in lower case (`a-b c3d` gives `A-B C3D`)."""
    chars = F.split(text, "")
    letter = lambda c: c.rlike(r"\p{L}")
    cased = F.transform(chars, lambda c, i: F.when((i > 0) & letter(F.coalesce(F.get(chars, i - 1), F.lit(""))), F.lower(c)).otherwise(F.upper(c)))
    return F.array_join(cased, "")


def component_title(key: Column) -> Column:
    """Last dotted segment of a key, underscores dropped, in title case."""
    out = F.regexp_replace(title(F.regexp_replace(F.element_at(F.split(key, r"\."), -1), "_", " ")), " ", "")
    return F.when((key == "(default)") | (out == ""), "Default").otherwise(out)


def path_matches(a: Column, b: Column) -> Column:
    """Equal paths, or one is the other's end at a slash."""
    a, b = F.regexp_replace(a, r"\\", "/"), F.regexp_replace(b, r"\\", "/")
    return (a == b) | F.endswith(a, F.concat(F.lit("/"), b)) | F.endswith(b, F.concat(F.lit("/"), a))
