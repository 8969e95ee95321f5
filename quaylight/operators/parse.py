"""Free-text queries as predicates. Parsing is on the driver: a query is a sentence."""

from __future__ import annotations

import re
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Phrases of comparison, tried longest first.
COMPARATORS = {
    "greater than or equal to": "gte", "less than or equal to": "lte", "no less than": "gte", "no more than": "lte", "not less than": "gte", "not more than": "lte", "greater than": "gt", "more than": "gt",
    "larger than": "gt", "less than": "lt", "fewer than": "lt", "smaller than": "lt", "at least": "gte", "at most": "lte", "up to": "lte", "above": "gt", "over": "gt", "below": "lt", "under": "lt", "equal to": "eq", "exactly": "eq",
}
FIELDS = {"employees": "numEmployees", "employee": "numEmployees", "staff": "numEmployees", "revenue": "revenue", "revenues": "revenue", "turnover": "revenue", "sales": "revenue"}
_number = r"(\d+(?:\.\d+)?)(?:\s*(bn|b|mn|m|k))?\b"
_units = {"b": 1e9, "bn": 1e9, "m": 1e6, "mn": 1e6, "k": 1e3, None: 1.0}
_compare = re.compile(rf"\b({'|'.join(sorted(COMPARATORS, key=len, reverse=True))})\s+{_number}(?:\s+(?:in\s+)?({'|'.join(FIELDS)}))?", re.I)
_between = re.compile(rf"\bbetween\s+{_number}\s+and\s+{_number}(?:\s+(?:in\s+)?({'|'.join(FIELDS)}))?", re.I)
_field_first = re.compile(rf"\b({'|'.join(FIELDS)})\s+(?:is\s+|of\s+)?(?=between|{'|'.join(sorted(COMPARATORS, key=len, reverse=True))})", re.I)


@dataclass
class Query:
    text: str = ""
    region: str | None = None
    country: str | None = None
    ranges: dict[str, list[tuple[str, float]]] = field(default_factory=dict)


def canonical(text: str) -> str:
    """QRY2: comparison phrases as their short names, the longest phrase first."""
    for phrase in sorted(COMPARATORS, key=len, reverse=True):
        text = re.sub(rf"\b{phrase}\b", COMPARATORS[phrase], text, flags=re.I)
    return text


def tagged(text: str, values: list[str], tag: str) -> tuple[str, list[str]]:
    """QRY1: values replaced by a tag, the longest first, and the originals in the
    order in which their tags stand."""
    if not values:
        return text, []
    pattern = re.compile(r"\b(" + "|".join(re.escape(v) for v in sorted(values, key=len, reverse=True)) + r")\b", re.I)
    found = [m[0] for m in pattern.finditer(text)]
    return pattern.sub(tag, text), found


def parse(text: str, countries: list[str], regions: list[str]) -> Query:
    """QRY3: ranges, at most one region and one country, and what is left as free
    text. Two countries or regions are an error; so is a range without a field."""
    out, rest = Query(), text
    fields = [(m.start(), FIELDS[m[1].lower()]) for m in _field_first.finditer(rest)]

    def named(m: re.Match, own: str | None) -> str:
        if own:
            return FIELDS[own.lower()]
        before = [f for at, f in fields if at < m.start()]
        if not before:
            raise ValueError(f"no field for {m[0]!r}")
        return before[-1]

    for m in _between.finditer(rest):
        out.ranges.setdefault(named(m, m[5]), []).extend([("gte", float(m[1]) * _units[m[2] and m[2].lower()]), ("lte", float(m[3]) * _units[m[4] and m[4].lower()])])
    for m in _compare.finditer(rest):
        out.ranges.setdefault(named(m, m[4]), []).append((COMPARATORS[m[1].lower()], float(m[2]) * _units[m[3] and m[3].lower()]))
    rest = _field_first.sub(" ", _compare.sub(" ", _between.sub(" ", rest)))
    for values, name in ((countries, "country"), (regions, "region")):
        rest, found = tagged(rest, values, "@")
        if len({f.lower() for f in found}) > 1:
            raise ValueError(f"more than one {name}: {found}")
        if found:
            setattr(out, name, next(v for v in values if v.lower() == found[0].lower()))
    rest = re.sub(r"\b(in|from|within)\s+@|@", " ", rest)
    rest = re.sub(r"\b(with|and|having|of|that have|who have)\b(?=\s*($|with\b|and\b|,))", " ", re.sub(r"\s+", " ", rest).strip(" ,.;"))
    while (cut := re.sub(r"\s*\b(with|and|having|or)\s*$", "", rest.strip(" ,.;"))) != rest:
        rest = cut
    out.text = re.sub(r"\s+", " ", rest)
    return out


def predicate(query: Query, columns: dict[str, str]) -> Column:
    """QRY4: the query over columns named by ``columns`` (revenue, numEmployees,
    country, region, text). Free text asks for all its words of three letters and
    more; a query that says nothing is true."""
    compare = {"gt": "__gt__", "gte": "__ge__", "lt": "__lt__", "lte": "__le__", "eq": "__eq__"}
    out = F.lit(True)
    for name, bounds in query.ranges.items():
        for op, value in bounds:
            out = out & getattr(F.col(columns[name]), compare[op])(value)
    for name in ("country", "region"):
        if getattr(query, name):
            out = out & (F.lower(columns[name]) == getattr(query, name).lower())
    if query.text and "text" in columns:
        for word in re.findall(r"\w{3,}", query.text.lower()):
            out = out & F.lower(columns["text"]).contains(word)
    return out


def search(df: DataFrame, text: str, countries: list[str], regions: list[str], columns: dict[str, str]) -> DataFrame:
    """QRY3, QRY4: rows that a sentence asks for; where it can't be parsed, rows that
    hold any of its words in a text column."""
    try:
        return df.where(predicate(parse(text, countries, regions), columns))
    except ValueError:
        words = re.findall(r"\w{3,}", text.lower())
        hit = F.lit(False)
        for c in (columns[k] for k in ("text", "country", "region") if k in columns):
            for w in words:
                hit = hit | F.lower(c).contains(w)
        return df.where(hit)
