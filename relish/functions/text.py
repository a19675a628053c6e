"""String, list and JSON column functions."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from relish.functions.vectors import bind

# Whitespace removed by strip(), list markers, texts for missing parts.
WHITESPACE = " \t\n\r\x0b\f"
UNKNOWN_NAME = "unknown dish"
NO_DETAILS = "none specified"
LABEL_DESCRIPTIONS = {
    "E": "Exact match - items that directly and precisely match all constraints of the search query",
    "S": "Substitute - items that can be a replacement for the queried item",
    "C": "Complement - items that are related and typically paired together with the queried item",
    "I": "Irrelevant - products that do not satisfy the query in any meaningful way",
}
UNKNOWN_LABEL = "Unknown ESCI label: "


def _c(col: str | Column) -> Column:
    return F.col(col) if isinstance(col, str) else col


def strip(col: str | Column) -> Column:
    """Remove surrounding whitespace of any kind, not only spaces."""
    return F.btrim(_c(col), F.lit(WHITESPACE))


def parse_list(col: str | Column, strict: bool = False) -> Column:
    """A list written in a string cell, JSON or single-quoted; anything else is a one-item list.

    ``strict`` accepts JSON only.  Null stays null, object cells give their keys.
    """
    c = _c(col)
    options = {"allowSingleQuotes": "false" if strict else "true"}
    as_list = F.from_json(c, "array<string>", options)
    head = F.substring(F.ltrim(c), 1, 1)
    return (
        F.when(c.isNull(), F.lit(None).cast("array<string>"))
        .when(head == "[", F.coalesce(as_list, F.array(c)))
        .when(head == "{", F.coalesce(F.json_object_keys(c), F.array(c)))
        .otherwise(F.array(c))
    )


def combine_text(name: str | Column, details: Sequence[str | Column]) -> Column:
    """``name`` newline comma-joined details, lower-cased.

    List cells that parse are joined item by item with blanks dropped; other
    cells are used as they are.
    """
    stripped_name = strip(_c(name))
    title = F.when(F.coalesce(stripped_name, F.lit("")) == "", F.lit(UNKNOWN_NAME)).otherwise(stripped_name)
    parts = []
    for d in details:
        c = _c(d)
        items = F.from_json(c, "array<string>", {"allowSingleQuotes": "true"})
        joined = F.array_join(F.filter(F.transform(items, strip), lambda x: x != ""), ", ")
        value = F.when(c.startswith("[") & items.isNotNull(), joined).otherwise(strip(c))
        parts.append(F.nullif(value, F.lit("")))
    body = F.concat_ws(", ", *parts)
    body = F.when(body == "", F.lit(NO_DETAILS)).otherwise(body)
    return strip(F.lower(F.concat(title, F.lit("\n"), body)))


def combine_for_embedding(name: str | Column, ingredients: str | Column, separator: str = " | Ingredients: ") -> Column:
    """name, separator, ingredients with missing parts empty (the other separator is ``" \\nIngredients:"``)."""
    empty = F.lit("")
    return strip(F.concat(F.coalesce(_c(name), empty), F.lit(separator), F.coalesce(_c(ingredients), empty)))


def valid_json(col: str | Column) -> Column:
    """the JSON text when it parses, else null."""
    c = _c(col)
    return F.when(F.try_parse_json(c).isNotNull(), c)


def render_template(template: str | Column, values: Mapping[str, str | Column]) -> Column:
    """replace literal placeholders, in the given order."""
    out = F.lit(template) if isinstance(template, str) else template
    for marker, value in values.items():
        out = F.replace(out, F.lit(marker), F.lit(value) if isinstance(value, str) else value)
    return out


def label_description(col: str | Column) -> Column:
    """description of a relevance label, or a text naming the unknown label."""
    c = _c(col)
    table = F.create_map(*[F.lit(x) for pair in LABEL_DESCRIPTIONS.items() for x in pair])
    return F.coalesce(table[c], F.concat(F.lit(UNKNOWN_LABEL), F.coalesce(c, F.lit("None"))))


def document_text(title: str | Column, text: str | Column, max_chars: int = 2000) -> Column:
    """trimmed title, space, trimmed text, trimmed and cut to the encoder's input length."""
    empty = F.lit("")
    merged = strip(F.concat(strip(F.coalesce(_c(title), empty)), F.lit(" "), strip(F.coalesce(_c(text), empty))))
    return F.substring(merged, 1, max_chars)


def embedded_json(col: str | Column) -> Column:
    """the JSON object between the first ``{`` and the last ``}``, or ``{}`` when it does not parse."""
    found = F.regexp_extract(_c(col), r"(?s)\{.*\}", 0)
    return F.coalesce(valid_json(found), F.lit("{}"))


def url_suffix(url: str | Column, default: str = ".jpg") -> Column:
    """File suffix of a URL path, or the default."""
    path = F.regexp_extract(_c(url), r"^(?:[A-Za-z][A-Za-z0-9+.-]*:)?(?://[^/?#]*)?([^?#]*)", 1)
    suffix = F.regexp_extract(path, r"[^/]+(\.[^/.]+)/*$", 1)
    return F.when(suffix == "", F.lit(default)).otherwise(suffix)


def end_index(start: Column, limit: Column) -> Column:
    """last index of a run window; null when the limit is absent, ``None`` or zero-length text."""
    return F.coalesce(start.try_cast("long"), F.lit(0)) + limit.try_cast("long") - 1


def percent(part: Column, whole: Column, digits: int = 2) -> Column:
    """F16: rounded percentage, null for an empty whole."""
    return F.round(F.try_divide(part * F.lit(100.0), whole), digits)


def prefixed_to_map(columns: Sequence[str], prefix: str) -> Column:
    """gather flat ``prefix.name`` columns into a map, nulls left out."""
    hits = [c for c in columns if c.startswith(prefix)]
    keys = F.array(*[F.lit(c[len(prefix):]) for c in hits]) if hits else F.lit([]).cast("array<string>")
    values = F.array(*[F.col(f"`{c}`").cast("string") for c in hits]) if hits else F.lit([]).cast("array<string>")
    return F.map_filter(F.map_from_arrays(keys, values), lambda _, v: v.isNotNull())


def word_set(col: str | Column) -> Column:
    """Distinct lower-cased whitespace-separated words of the whole text."""
    words = F.split(F.lower(F.coalesce(_c(col), F.lit(""))), r"\s+")
    return F.array_distinct(F.filter(words, lambda w: w != ""))


def word_ngrams(col: str | Column, n: int) -> Column:
    """Distinct word n-grams; shorter texts give their single whole gram."""
    words = F.filter(F.split(F.lower(F.coalesce(_c(col), F.lit(""))), r"\s+"), lambda w: w != "")

    def grams(w: Column) -> Column:
        starts = F.sequence(F.lit(1), F.greatest(F.size(w) - (n - 1), F.lit(1)))
        all_grams = F.transform(starts, lambda i: F.array_join(F.slice(w, i, n), " "))
        return F.when(F.size(w) == 0, F.lit([]).cast("array<string>")).otherwise(F.array_distinct(all_grams))

    return bind(words, grams)
