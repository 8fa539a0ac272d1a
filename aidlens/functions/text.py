"""Column functions over text: identity keys, terms, matching, display."""

import json
from collections.abc import Iterable
from functools import cache, reduce
from html.entities import html5

from pyspark.sql import Column
from pyspark.sql import functions as F

from aidlens import fixed

# Letters whose case folding differs from their lower case, with ASCII results.
FOLDED = {
    "ß": "ss", "ſ": "s", "ﬀ": "ff", "ﬁ": "fi", "ﬂ": "fl", "ﬃ": "ffi", "ﬄ": "ffl", "ﬅ": "st", "ﬆ": "st",
}


def slug(text: Column) -> Column:
    dashed = F.regexp_replace(F.lower(text), "[^a-z0-9]+", "-")
    return F.left(F.btrim(dashed, F.lit("-")), F.lit(fixed.SLUG_CHARS))


def event_key(domain: Column, title: Column, location: Column) -> Column:
    """Stable identity of an event: the head of a hash over three slugs."""
    base = F.concat_ws("|", slug(domain), slug(title), slug(location))
    return F.substring(F.sha2(base, 256), 1, fixed.EVENT_KEY_CHARS)


def record_id(key: Column, source_name: Column, observed_at: Column) -> Column:
    base = F.concat_ws("|", key, source_name, observed_at)
    return F.substring(F.sha2(base, 256), 1, fixed.RECORD_ID_CHARS)


def terms(text: Column) -> Column:
    """Distinct ``[a-z0-9]+`` runs of the lower-case text."""
    return F.array_distinct(F.regexp_extract_all(F.lower(text), F.lit("[a-z0-9]+"), F.lit(0)))


def haystack(*fields: Column) -> Column:
    return F.lower(F.concat_ws(" ", *fields))


def fold_case(text: Column) -> Column:
    """Lower case plus the folded letters that can complete an ASCII word."""
    lowered = F.lower(text)
    folded = reduce(lambda x, kv: F.replace(x, F.lit(kv[0]), F.lit(kv[1])), FOLDED.items(), lowered)
    return F.when(lowered.rlike("[" + "".join(FOLDED) + "]"), folded).otherwise(lowered)


def contains_any(text: str, words: Iterable[str]) -> Column:
    """True when any word is a substring of the SQL expression ``text``."""
    return F.expr(" OR ".join(f"contains({text}, '{w}')" for w in words))


#: All characters that count as white space at the ends of a text.
WHITE = "".join(chr(c) for c in range(0x3001) if chr(c).isspace())


def stripped(value: Column) -> Column:
    """``value`` without white space of any kind at its ends."""
    return F.btrim(value, F.lit(WHITE))


def display_value(value: Column, fallback: str = fixed.NOT_REPORTED) -> Column:
    """``value`` as text, untrimmed, or ``fallback`` when it is missing or blank."""
    shown = value.cast("string")
    blank = shown.isNull() | stripped(shown).isin(fixed.BLANK_VALUES)
    return F.when(blank, F.lit(fallback)).otherwise(shown)


def names_list(names: Column, default: str) -> Column:
    joined = F.array_join(names, ", ")
    return F.coalesce(F.nullif(joined, F.lit("")), F.lit(default))


def links_list(links: Column, default: str) -> Column:
    """Markdown links from an array of ``struct(name, url)``."""
    marked = F.transform(
        links, lambda l: F.concat(F.lit("["), l["name"], F.lit("]("), l["url"], F.lit(")"))
    )
    return F.coalesce(F.nullif(F.array_join(marked, " · "), F.lit("")), F.lit(default))


def title_case(label: Column) -> Column:
    return F.initcap(F.replace(label, F.lit("_"), F.lit(" ")))


def is_json(value: Column) -> Column:
    """True for exactly one JSON value; in brackets, so that text after it does not pass."""
    in_list = F.json_array_length(F.concat(F.lit("["), value, F.lit("]")))
    return F.coalesce(in_list == 1, F.lit(False))


def shortened(text: Column, chars: int = fixed.TITLE_CHARS) -> Column:
    tail = F.when(F.length(text) > chars, F.lit("…")).otherwise(F.lit(""))
    return F.concat(F.left(text, F.lit(chars)), tail)


def thousands(number: Column) -> Column:
    return F.format_number(number, 0)


def magnitude(value: Column) -> Column:
    return F.when(value.isNotNull(), F.format_string("M%.1f", F.bround(value, 1)))


def coordinate(value: Column) -> Column:
    return F.when(value.isNotNull(), F.format_string("%.5f", F.bround(value, 5)))


# A tag's attributes, where a quoted value may hold >; runs are possessive, so a page is read once.
_ATTRIBUTES = r"""(?:[^>=]++|=\s*+(?:"[^"]*+"|'[^']*+')?+)*+"""
# What is no text: comments, raw elements with their content, tags, declarations. What stays open ends with the page.
_MARKUP = (
    r"(?is)<!--(?:-?>|.*?(?:--!?>|\z))"
    rf"|<(script|style|template)(?=[\s/>]){_ATTRIBUTES}(?:>.*?(?:</\1(?=[\s/>])[^>]*+(?:>|\z)|\z)|\z)"
    rf"|</?[a-z]{_ATTRIBUTES}(?:>|\z)"
    r"|<(?:[!?]|/(?!\z))[^>]*+(?:>|\z)"
)
_BLANK = " \t\n\r\f\v"


@cache
def _named_references() -> str:
    """HTML's named references as JSON: first letter, name with its semicolon if it needs one, characters."""
    found: dict[str, dict[str, str]] = {}
    for name, characters in html5.items():
        found.setdefault(name[0], {})[name] = characters
    return json.dumps(found)


def _character(code: Column) -> Column:
    """The character of a code point; what HTML forbids becomes U+FFFD, 128 to 159 are read as Windows-1252."""
    windows = [bytes([c]).decode("cp1252", "replace") for c in range(128, 160)]
    wrong = (code == 0) | code.between(0xD800, 0xDFFF) | (code > 0x10FFFF)
    return (
        F.when(wrong, "\ufffd")
        .when(code.between(128, 159), F.get(F.array(*map(F.lit, windows)), (code - 128).cast("int")))
        .otherwise(F.decode(F.unhex(F.lpad(F.hex(code), 8, "0")), "UTF-32"))
    )


def _dereferenced(piece: Column) -> Column:
    """A piece of text that begins with &, with its reference decoded if it is one."""
    table = F.from_json(F.lit(_named_references()), "map<string, map<string, string>>")
    bare = "|".join(sorted((n for n in html5 if not n.endswith(";")), key=len, reverse=True))
    named = lambda name: F.try_element_at(F.try_element_at(table, F.substring(name, 1, 1)), name)
    decimal = F.regexp_extract(piece, "^&#0*([0-9]+)", 1)
    sixteen = F.regexp_extract(piece, "^&#[xX]0*([0-9a-fA-F]+)", 1)
    whole, part = F.regexp_extract(piece, "^&([A-Za-z][A-Za-z0-9]*;)", 1), F.regexp_extract(piece, f"^&({bare})", 1)
    number = F.when(F.length(decimal) > 7, 1 << 21).when(decimal != "", decimal.cast("int"))
    number = number.when(F.length(sixteen) > 6, 1 << 21).otherwise(F.conv(sixteen, 16, 10).cast("int"))
    after = lambda n: F.substring(piece, n + 1, F.length(piece))
    return (
        F.when(piece.rlike("^&#(?:[0-9]|[xX][0-9a-fA-F])"), F.concat(_character(number), F.regexp_replace(piece, "^&#(?:[0-9]+|[xX][0-9a-fA-F]+);?", "")))
        .when(named(whole).isNotNull(), F.concat(named(whole), after(F.length(whole) + 1)))
        .when(part != "", F.concat(named(part), after(F.length(part) + 1)))
        .otherwise(piece)
    )


def dereferenced(text: Column) -> Column:
    """Text with its character references decoded once, as HTML reads them."""
    pieces = F.transform(F.split(text, "(?=&)"), lambda p: F.when(p.startswith("&"), _dereferenced(p)).otherwise(p))
    return F.when(F.contains(text, F.lit("&")), F.array_join(pieces, "")).otherwise(text)


def visible_text(html: Column) -> Column:
    """The text nodes of a page, trimmed, non-empty, joined by one space; null for a null page."""
    nodes = F.transform(F.split(html, _MARKUP), lambda n: F.btrim(F.translate(dereferenced(n), "\u00a0", " "), F.lit(_BLANK)))
    return F.array_join(F.filter(nodes, lambda n: n != ""), " ")


def filled(template: str, *values: Column) -> Column:
    """A fixed text with columns in place of its ``{}``, in order."""
    first, *rest = template.split("{}")
    return F.concat(F.lit(first), *[part for value, piece in zip(values, rest, strict=True) for part in (value, F.lit(piece))])
