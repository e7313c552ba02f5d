"""Text tests: folding, weak descriptions, numbers in sentences."""
from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Texts that stand for a missing description.
PLACEHOLDER = r"(?i)(\b(todo|tbd|lorem ipsum|placeholder|description here|to be (filled|added|defined))\b|^\s*n/a\s*$)"
# Fixed value: a number with optional thousands commas and decimals, not inside a word.
NUMBER = r"(?<![\w.])-?\d[\d,]*(?:\.\d+)?"


def fold(text: Column) -> Column:
    """Lower case, single spaces, no question mark at the end."""
    spaced = F.trim(F.regexp_replace(F.lower(text), r"\s+", " "))
    return F.regexp_replace(spaced, r"\?+$", "")


def squeeze(text: Column) -> Column:
    return F.trim(F.regexp_replace(text, r"\s+", " "))


def letters(text: Column) -> Column:
    return F.regexp_replace(F.lower(F.coalesce(text, F.lit(""))), "[^a-z0-9]", "")


def weak(text: Column, name: Column, minimum: int) -> Column:
    """Why a description is weak: ``missing``, ``short``, ``restates the name``, ``placeholder``, or null."""
    body = F.regexp_replace(text, r"^\s+|\s+$", "")
    return (F.when(text.isNull() | (body == ""), "missing")
            .when(F.length(body) < minimum, "short")
            .when(letters(text).isin(letters(name), F.concat(letters(name), F.lit("s"))), "restates the name")
            .when(text.rlike(PLACEHOLDER), "placeholder"))


def column_minimum(minimum: int) -> int:
    """Shortest accepted column description, given the shortest accepted table description."""
    return max(8, minimum // 2)


def numbers(text: Column) -> Column:
    """Numbers in a text as written, thousands commas removed."""
    return F.transform(F.regexp_extract_all(text, F.lit(NUMBER), F.lit(0)), lambda n: F.replace(n, F.lit(","), F.lit("")))


def short_name(full_name: Column) -> Column:
    return F.substring_index(full_name, ".", -2)


def last_part(full_name: Column) -> Column:
    return F.substring_index(full_name, ".", -1)
