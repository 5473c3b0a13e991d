"""Cleaning expressions for dirty text columns."""

from __future__ import annotations

import string

from pyspark.sql import Column
from pyspark.sql import functions as F

# Abbreviation rules, whole word -> expansion.
ABBREVIATIONS = {
    "sr": "senior",
    "asst": "assistant",
    "coord": "coordinator",
    "mgr": "manager",
    "dir": "director",
    "assoc": "associate",
    "prog": "program",
    "spec": "specialist",
    "supv": "supervisor",
    "tech": "technician",
    "rep": "representative",
    "muni": "municipal",
    "pr": "professor",
    "ops": "operations",
    "lab": "laboratory",
    "ofc": "office",
    "pt": "patient",
    "svc": "service",
    "sys": "system",
    "prac": "practitioner",
    "med": "medical",
    "svcs": "services",
    "clin": "clinical",
    "maint": "maintenance",
    "exec": "executive",
    "rsc": "resource",
    "prgm": "program",
    "aw": "austin water",
    "serv": "service",
    "oper": "operator",
    "vp": "vice president",
    "info": "information",
    "trk": "track",
    "asc": "associate",
    "mgmt": "management",
    "admnstr": "administrative",
    "hr": "human resources",
    "proj": "project",
    "wkr": "worker",
    "dev": "development",
    "comm": "communications",
    "div": "division",
    "spclst": "specialist",
    "adv": "advanced",
    "pract": "practitioner",
    "environ": "environmental",
    "techn": "technician",
    "rsrc": "research",
}
# Words without meaning for the title, and the roman numeral one.
NOISE_WORDS = ("hcpc",)
ROMAN_ONE = "I-ONE"


def clean_title(c: Column, strip_punctuation: bool = True) -> Column:
    """Lower case, punctuation to spaces, runs of two or more blanks to one."""
    c = F.lower(c)
    if strip_punctuation:
        c = F.translate(c, string.punctuation, " " * len(string.punctuation))
    return F.regexp_replace(c, r"(?U)\s\s+", " ")


def clean_matched_title(c: Column) -> Column:
    """``clean_title`` without the one blank that may be left at either end."""
    return F.regexp_replace(clean_title(c), r"(?U)^\s|\s$", "")


def split_camel(c: Column) -> Column:
    """``aB`` becomes ``a B``."""
    return F.regexp_replace(c, "([a-z])([A-Z])", "$1 $2")


def expand_abbrev(c: Column, rules: dict[str, str] | None = None) -> Column:
    """Replace abbreviations by whole word; drop noise words and digits.

    The title is cut once into words and separators and each word looked up in
    a constant map, so the cost does not grow with the number of rules.
    """
    table = dict(ABBREVIATIONS if rules is None else rules)
    table.update({w: "" for w in NOISE_WORDS})
    table["i"] = ROMAN_ONE
    lookup = F.create_map(*[F.lit(x) for kv in table.items() for x in kv])
    pieces = F.regexp_extract_all(F.regexp_replace(c, "[0-9]+", ""), F.lit(r"(?U)(\w+|\W+)"), 1)
    return F.array_join(
        F.transform(pieces, lambda w: F.coalesce(F.try_element_at(lookup, F.lower(w)), w)), ""
    )


def decimal_comma(c: Column) -> Column:
    """``'12,5'`` -> 12.5"""
    return F.replace(c, F.lit(","), F.lit(".")).cast("double")


def money_strip(c: Column) -> Column:
    """``'$12.5'`` -> 12.5"""
    return F.regexp_replace(c, r"^\$+|\$+$", "").cast("double")


def hourly_to_annual(rate: Column, hours: Column, below: float = 300) -> Column:
    """Rates below the limit are hourly and are multiplied by the annual hours."""
    return F.when(rate < below, rate * hours).otherwise(rate)


def seniority_from_date(c: Column, layout: str, year: int = 2019) -> Column:
    """Years since the hiring year, which each layout keeps at a fixed place."""
    places = {"tail": (7, 100), "at6": (7, 4), "last4": (-4, 4)}
    if layout == "two_digit":
        return F.pmod(F.lit(year % 100) - F.substring(c, -2, 2).cast("int"), F.lit(100))
    start, length = places[layout]
    return F.lit(year) - F.substring(c, start, length).cast("int")


def year_of_date(c: Column, fmt: str = "MM/dd/yyyy") -> Column:
    return F.year(F.to_date(c, fmt))


def binarize(c: Column, value) -> Column:
    return (c == F.lit(value)).cast("int")
