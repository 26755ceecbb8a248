"""Identifier and text expressions, evaluated in the JVM."""

from __future__ import annotations

import json
import re
import unicodedata
from functools import lru_cache

from pyspark.sql import Column, functions as F

from paywarden.schema import UNUSABLE_KEYS

NON_ASCII = "[^\\x00-\\x7F]"

# Characters a sheet cell may not hold.
CELL_ILLEGAL = "[\\x00-\\x08\\x0B\\x0C\\x0E-\\x1F\\x{FFFE}\\x{FFFF}]+"


def plain_identifier(value: object) -> str:
    """Driver-side twin of :func:`normalise`, for column names and tests."""
    if value is None:
        return ""
    decomposed = unicodedata.normalize("NFKD", str(value))
    bare = "".join(ch for ch in decomposed if not unicodedata.combining(ch))
    return re.sub("[^A-Z0-9]", "", bare.upper())


@lru_cache(maxsize=1)
def letter_rules() -> tuple[str, str, dict[str, str]]:
    """What compatibility decomposition makes of every character, by rule.

    Spark has no decomposition function, but the rule works character by
    character: those that become one letter go to ``translate``, those that
    become several (sharp s, ligatures, Roman numerals) go to a map.
    """
    source, target, several = [], [], {}
    for code in range(0x80, 0x20000):
        if 0xD800 <= code <= 0xDFFF:
            continue
        char = chr(code)
        letters = plain_identifier(char)
        if len(letters) == 1:
            source.append(char)
            target.append(letters)
        elif letters:
            several[char] = letters
    return "".join(source), "".join(target), several


def char_class(chars) -> str:
    """A character class as ranges; a class of single characters is tested one by one."""
    ranges: list[list[int]] = []
    for code in sorted(map(ord, chars)):
        if ranges and code == ranges[-1][1] + 1:
            ranges[-1][1] = code
        else:
            ranges.append([code, code])
    return "[" + "".join(f"\\x{{{low:X}}}-\\x{{{high:X}}}" for low, high in ranges) + "]"


def normalise(value: Column) -> Column:
    """Upper-case letters and digits only, accents and compatibility forms resolved."""
    source, target, several = letter_rules()
    text = F.coalesce(value.cast("string"), F.lit(""))
    lookup = F.from_json(F.lit(json.dumps(several)), "map<string,string>")
    spelled_out = F.array_join(
        F.transform(F.split(text, ""), lambda ch: F.coalesce(F.try_element_at(lookup, ch), ch)), ""
    )
    folded = F.translate(F.when(text.rlike(char_class(several)), spelled_out).otherwise(text), source, target)
    ascii_only = F.when(text.rlike(NON_ASCII), folded).otherwise(text)
    return F.regexp_replace(F.upper(ascii_only), "[^A-Z0-9]+", "")


def usable_id(key: Column) -> Column:
    return ~F.coalesce(key, F.lit("")).isin(UNUSABLE_KEYS)


def has_name(key: Column) -> Column:
    return F.coalesce(key, F.lit("")) != ""


def spread_key(key: Column, usable: Column, line_id: Column) -> Column:
    """Join key that sends lines without a usable key to different tasks.

    Such lines match nothing, yet all share one value. Normalised keys hold
    letters and digits only, so a marked line id never equals one of them.
    """
    return F.when(usable, key).otherwise(F.concat(F.lit("~"), line_id))


def person_key(staff_key: Column, name_key: Column, line_id: Column) -> Column:
    """Who a line belongs to: by identifier, else by name, else the line itself."""
    return (
        F.when(usable_id(staff_key), F.concat(F.lit("M:"), staff_key))
        .when(has_name(name_key), F.concat(F.lit("N:"), name_key))
        .otherwise(F.concat(F.lit("L:"), line_id))
    )


def full_name(last: Column, first: Column) -> Column:
    """Names joined by a blank. An empty part keeps its place and is trimmed at the ends."""
    return F.trim(F.concat_ws(" ", F.coalesce(last, F.lit("")), F.coalesce(first, F.lit(""))))


def sanitise(value: Column, longest: int | None = None) -> Column:
    """Text without the characters that sheets refuse; cut only where a length is asked for."""
    clean = F.regexp_replace(value, CELL_ILLEGAL, " ")
    return clean if longest is None else F.substring(clean, 1, longest)
