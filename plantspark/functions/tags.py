"""Column expressions for instrument tags and procedure texts. Patterns use ASCII classes."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .dims import COMPATIBLE, FIRST_LETTER, PREFIX_CLASS, SECOND_LETTER, list_lookup, lookup

#: Two tag grammars, valve commands and operating parameters.
DRAWING_TAG = "\\b([A-Z]{1,4})[_\\-\\s]?(\\d{1,5}[A-Z]?)\\b"
PROCEDURE_TAG = "\\b([A-Z]{1,4})[_\\-]?(\\d{2,5}[A-Z]?)\\b"
OPEN = "(?i)\\b(?:open|opened?|opening)\\b[^A-Z]{0,15}([A-Z]{1,4}[_\\-]?\\d{2,5}[A-Z]?)"
CLOSE = "(?i)\\b(?:close|closed?|closing|shut|shutoff)\\b[^A-Z]{0,15}([A-Z]{1,4}[_\\-]?\\d{2,5}[A-Z]?)"
PARAMETERS = {
    "pressure": "(?i)(\\d+(?:\\.\\d+)?)\\s*(psi[ga]?|bar[ag]?|kpa|mpa|psig|bara)",
    "temperature": "(?i)(\\d+(?:\\.\\d+)?)\\s*(°[cf]|deg\\s*[cf]|celsius|fahrenheit)",
    "flow": "(?i)(\\d+(?:\\.\\d+)?)\\s*(gpm|lpm|m3/h|bbl/d|scfm|nm3/h)",
}


def drawing_tag(text: Column) -> dict[str, Column]:
    """Prefix, number and normal form of the first tag in a recognised text; nulls if there is none."""
    t = F.upper(F.trim(text))
    prefix, number = F.regexp_extract(t, DRAWING_TAG, 1), F.regexp_extract(t, DRAWING_TAG, 2)
    found = F.regexp_like(t, F.lit(DRAWING_TAG))
    return {
        "prefix": F.when(found, prefix),
        "number": F.when(found, number),
        "tag": F.when(found, F.concat(prefix, F.lit("-"), number)),
    }


def normal_tag(raw: Column) -> Column:
    """'FCV_101' as 'FCV-101'; a text without a tag only trimmed and in upper case."""
    u = F.upper(raw)
    joined = F.concat(F.regexp_extract(u, PROCEDURE_TAG, 1), F.lit("-"), F.regexp_extract(u, PROCEDURE_TAG, 2))
    return F.when(F.regexp_like(u, F.lit(PROCEDURE_TAG)), joined).otherwise(F.trim(u))


def procedure_tags(text: Column) -> Column:
    """All tags of a procedure text, distinct, in order of appearance."""
    return F.array_distinct(F.transform(F.regexp_extract_all(F.upper(text), F.lit(PROCEDURE_TAG), F.lit(0)), normal_tag))


def valve_states(text: Column) -> Column:
    """Array of (tag, state) in order of assignment: all openings, then all closings."""
    made = lambda pattern, state: F.transform(
        F.regexp_extract_all(text, F.lit(pattern), F.lit(1)), lambda x: F.struct(normal_tag(x).alias("tag"), F.lit(state).alias("state"))
    )
    return F.concat(made(OPEN, "open"), made(CLOSE, "closed"))


def parameter(text: Column, name: str) -> Column:
    """The last value and unit of a parameter, the unit in lower case; null if there is none."""
    last = lambda group: F.try_element_at(F.regexp_extract_all(text, F.lit(PARAMETERS[name]), F.lit(group)), F.lit(-1))
    return F.concat(last(1), F.lit(" "), F.lower(last(2)))


def is_upper(text: Column) -> Column:
    """At least one letter with case, and none in lower case."""
    return (F.upper(text) == text) & (F.lower(text) != text)


def is_heading(text: Column, style: Column) -> Column:
    """By style, or by a line in capitals of 6 to 99 characters."""
    named = F.regexp_like(style, F.lit("^Heading [123]"))
    return named | (is_upper(text) & (F.length(text) > 5) & (F.length(text) < 100))


def component_hint(tag: Column) -> Column:
    """What the first two letters of a tag stand for."""
    t = F.upper(tag)
    first, second = lookup(FIRST_LETTER, F.substring(t, 1, 1)), lookup(SECOND_LETTER, F.substring(t, 2, 1))
    return F.coalesce(F.concat(first, F.lit("_"), second), first, F.lit("unknown"))


def prefix_class(prefix: Column) -> Column:
    """The symbol class to assume for a tag prefix."""
    p = F.upper(prefix)
    kind = F.coalesce(lookup(FIRST_LETTER, F.substring(p, 1, 1)), F.lit("flow"))
    ends = lambda letter, name: F.when(F.endswith(p, F.lit(letter)), F.concat(kind, F.lit(f"_{name}")))
    return F.coalesce(lookup(PREFIX_CLASS, p), ends("T", "transmitter"), ends("I", "indicator"), ends("C", "controller"), F.lit("instrument"))


def compatible(prefix: Column, symbol_class: Column) -> Column:
    """Whether the class is acceptable for the longest known start of the prefix; true if none is known."""
    lists = F.coalesce(*(list_lookup(COMPATIBLE, F.upper(F.substring(prefix, 1, n))) for n in (4, 3, 2, 1)))
    return F.coalesce(F.array_contains(lists, F.lower(symbol_class)), F.lit(True))


def expected_classes(prefix: Column) -> Column:
    """The acceptable classes of exactly this prefix, sorted and joined."""
    return F.coalesce(F.array_join(F.array_sort(list_lookup(COMPATIBLE, F.upper(prefix))), " | "), F.lit("unknown"))


def normal_ocr(text: Column) -> Column:
    """Only letters, digits, blanks, '-' and '_', trimmed, in upper case."""
    return F.upper(F.trim(F.regexp_replace(text, "[^A-Za-z0-9\\-_ ]", "")))


def plain_xml(text: Column) -> Column:
    """Text of a word-processor XML: paragraphs as lines, tags out, three entities resolved."""
    lines = F.regexp_replace(F.regexp_replace(text, "<w:p[ >]", "\n"), "<[^>]+>", "")
    for entity, char in (("&amp;", "&"), ("&lt;", "<"), ("&gt;", ">")):
        lines = F.replace(lines, F.lit(entity), F.lit(char))
    return lines


def unfenced(text: Column) -> Column:
    """What stands in the first code fence, else the text."""
    inner = F.regexp_extract(text, "(?s)```(?:json)?(.*?)(?:```|$)", 1)
    return F.regexp_replace(F.when(F.contains(text, F.lit("```")), inner).otherwise(text), "^\\s+|\\s+$", "")
