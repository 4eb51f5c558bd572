"""Text functions: names, numbers, variants, titles."""

from __future__ import annotations

import re
import unicodedata

from pyspark.sql import Column
from pyspark.sql import functions as F

from tarnwick.constants import MECHANICS



def _foldings() -> tuple[str, str, dict[str, str]]:
    """Characters whose compatibility decomposition has ASCII in it: those that fold to one letter, to which; the others."""
    single, to, more = [], [], {}
    for code in range(0x80, 0x20000):
        letter = chr(code)
        if 0xAC00 <= code < 0xE000:  # Hangul, surrogates
            continue
        plain = unicodedata.normalize("NFKD", letter).encode("ascii", "ignore").decode()
        if len(plain) == 1:
            single.append(letter)
            to.append(plain)
        elif plain:
            more[letter] = plain
    return "".join(single), "".join(to), more


MARKED, PLAIN, LIGATURES = _foldings()


def base_name(name: Column, supertype: Column) -> Column:
    """The character of a printing: without an owner (``X's``) and without trailing mechanic tokens.

    Owners are cut for creatures only.  A name of nothing but mechanic tokens stays as it is.
    """
    name = F.trim(name)
    owner = F.when(supertype == "Pokémon", F.regexp_replace(name, r"^.*'s ", "")).otherwise(name)
    tokens = "|".join(map(re.escape, MECHANICS))
    tight = F.trim(F.regexp_replace(owner, r"\s+", " "))
    return F.when(tight.rlike(rf"^(?:{tokens})(?: (?:{tokens}))*$"), owner).otherwise(F.regexp_replace(tight, rf"(?: (?:{tokens}))+$", ""))


def folded(name: Column) -> Column:
    """Lower-case ASCII letters and digits only, marks and compatibility forms folded.

    Names of plain ASCII are not folded.  Ligatures are looked for by ``translate``, whose table is hashed; a pattern
    would try hundreds of characters for each one of a name.
    """
    several = F.create_map(*[F.lit(x) for pair in LIGATURES.items() for x in pair])
    spelled = F.array_join(F.transform(F.split(name, ""), lambda c: F.coalesce(F.element_at(several, c), c)), "")
    plain = F.when(F.translate(name, "".join(LIGATURES), "") != name, spelled).otherwise(name)
    wide = F.octet_length(name) > F.char_length(name)
    return F.regexp_replace(F.when(wide, F.lower(F.translate(plain, MARKED, PLAIN))).otherwise(F.lower(name)), "[^a-z0-9]", "")


def product_base(name: Column) -> Column:
    """The folded part of a product's name before `` - `` and before ``(``."""
    return folded(F.substring_index(F.substring_index(name, " - ", 1), "(", 1))


def card_number(number: Column) -> Column:
    """The part before ``/``, trimmed and in upper case; all digits lose leading zeros."""
    part = F.nullif(F.upper(F.trim(F.substring_index(number, "/", 1))), F.lit(""))
    stripped = F.regexp_replace(part, "^0+(?=[0-9])", "")
    return F.when(part.rlike("^[0-9]+$"), stripped).otherwise(part)


def plain_number(number: Column) -> Column:
    """The whole number, trimmed and in upper case, without leading zeros: the key of the second price source."""
    return F.coalesce(F.nullif(F.regexp_replace(F.upper(F.trim(number)), "^0+", ""), F.lit("")), F.lit("0"))


def variant_name(variant: Column) -> Column:
    """The display subtype of a variant key: the part after the last ``:`` without ``-`` and ``_``."""
    key = F.regexp_replace(F.lower(F.substring_index(variant, ":", -1)), "[-_]", "")
    # Subtype names.
    names = {
        "normal": "Normal", "holofoil": "Holofoil", "reverseholofoil": "Reverse Holofoil", "1steditionholofoil": "1st Edition Holofoil",
        "unlimitedholofoil": "Unlimited Holofoil",
    }
    found = F.try_element_at(F.create_map(*[F.lit(x) for pair in names.items() for x in pair]), key)
    return F.coalesce(found, F.lit("Holofoil"))


def variant_keys(name: Column) -> Column:
    """Lookup keys of a character, most special first: the name, without ``Mega``, without a trailing X, Y or Z."""
    plain = F.regexp_replace(name, "^Mega ", "")
    return F.array_distinct(F.array(name, plain, F.regexp_replace(plain, " [XYZ]$", "")))


def is_graded(title: Column) -> Column:
    """Whether a listing title names a grading service."""
    return F.lower(F.concat(F.lit(" "), title, F.lit(" "))).rlike(" psa | cgc | bgs | sgc |graded")


def search_query(*parts: Column) -> Column:
    """The parts that are not blank, joined by blanks."""
    return F.concat_ws(" ", *[F.nullif(F.trim(p), F.lit("")) for p in parts])


def slash_date(text: Column) -> Column:
    """A date from ``yyyy-MM-dd`` or ``yyyy/MM/dd``; null where it is neither."""
    return F.coalesce(F.try_to_date(text, "yyyy-MM-dd"), F.try_to_date(text, "yyyy/MM/dd"))
