"""Conditions with two-valued logic: a missing field is false for every operation."""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, functions as F

from docquery.functions.fields import to_date, to_number
from docquery.functions.scripts import script


@dataclass(frozen=True)
class Cond:
    """Whether a row matches, never null, the score that it gets for it, and the same as a filter.

    A filter drops what is null anyway, so it is kept bare of coalescing: scans can be given its parts.
    """

    match: Column
    score: Column
    filter: Column

    @staticmethod
    def of(match: Column, score: Column | float = 0.0, filter: Column | None = None) -> Cond:
        filter, match = match if filter is None else filter, F.coalesce(match, F.lit(False))
        return Cond(match, F.when(match, score if isinstance(score, Column) else F.lit(float(score))).otherwise(F.lit(0.0)), filter)


def _sides(c: Column, value):
    v = value if isinstance(value, Column) else F.lit(value)
    return c, v


def equal(c: Column, value, text: bool = False) -> Cond:
    """Equality. text columns compare as instants if both sides are dates, else as they are written (F1)."""
    c, v = _sides(c, value)
    return Cond.of(F.coalesce(to_date(c) == to_date(v), c == v) if text else c == v)


def not_equal(c: Column, value, text: bool = False) -> Cond:
    c, v = _sides(c, value)
    return Cond.of(F.coalesce(to_date(c) != to_date(v), c != v) if text else c != v)


def compare(c: Column, op: str, value, text: bool = False) -> Cond:
    """gt, lt, gte or lte; text columns as instants or else as numbers, and never by letters (F2)."""
    c, v = _sides(c, value)
    ask = {"gt": lambda a, b: a > b, "lt": lambda a, b: a < b, "gte": lambda a, b: a >= b, "lte": lambda a, b: a <= b}[op]
    return Cond.of(F.coalesce(ask(to_date(c), to_date(v)), ask(to_number(c), to_number(v.cast("string")))) if text else ask(c, v))


def contains(c: Column, value: str) -> Cond:
    return Cond.of(c.contains(value))


def starts_with(c: Column, value: str) -> Cond:
    return Cond.of(c.startswith(value))


def ends_with(c: Column, value: str) -> Cond:
    return Cond.of(c.endswith(value))


def within_list(c: Column, items: list | str) -> Cond:
    """Membership; a text list is split at commas and its items trimmed."""
    return Cond.of(c.isin([i.strip() for i in items.split(",")] if isinstance(items, str) else items))


def not_within_list(c: Column, items: list | str) -> Cond:
    return Cond.of(~c.isin([i.strip() for i in items.split(",")] if isinstance(items, str) else items))


def within_range(c: Column, start=None, end=None, text: bool = False) -> Cond:
    """From start up to but not end, either may be open; a text field that is a date needs date bounds."""
    if not text:
        asked = [c >= F.lit(start)] * (start is not None) + [c < F.lit(end)] * (end is not None)
        return Cond.of(reduce(lambda a, b: a & b, asked, c.isNotNull()))

    def between(read):
        parts = [read(c) >= read(F.lit(str(start)))] * (start is not None) + [read(c) < read(F.lit(str(end)))] * (end is not None)
        return F.coalesce(reduce(lambda a, b: a & b, parts, read(c).isNotNull()), F.lit(False))

    return Cond.of(F.when(to_date(c).isNotNull(), between(to_date)).otherwise(between(to_number)))


def exists(c: Column) -> Cond:
    return Cond.of(c.isNotNull())


def missing(c: Column) -> Cond:
    return Cond.of(c.isNull())


def expression(code: str) -> Cond:
    """User code that must be true, as a value or a text; all else is false, also what fails in a row (F10): see functions.scripts."""
    return Cond.of(F.lower(F.regexp_replace(script(code).cast("string"), r"[\"'\\\\]", "")) == "true")


def flag(match: Column) -> Cond:
    """A condition from a column of booleans, as an existence join gives it."""
    return Cond.of(match)


def all_of(*conds: Cond) -> Cond:
    both = lambda parts: reduce(lambda a, b: a & b, parts) if parts else F.lit(True)
    return Cond.of(both([c.match for c in conds]), reduce(lambda a, b: a + b, [c.score for c in conds], F.lit(0.0)), both([c.filter for c in conds]))


def one_of(*conds: Cond) -> Cond:
    some = lambda parts: reduce(lambda a, b: a | b, parts) if parts else F.lit(False)
    return Cond.of(some([c.match for c in conds]), F.greatest(F.lit(0.0), F.lit(0.0), *[c.score for c in conds]), some([c.filter for c in conds]))


def none_of(*conds: Cond) -> Cond:
    return Cond.of(~reduce(lambda a, b: a | b, [c.match for c in conds], F.lit(False)))


def negation(cond: Cond) -> Cond:
    return Cond.of(~cond.match)


def boolean(All=(), One=(), None_=(), Not=(), strict: bool = False) -> Cond:
    """The first list that is not empty decides, in this order; no list at all is true.

    Not negates its first condition. strict refuses more than one list.
    """
    given = [(f, x) for f, x in ((all_of, All), (one_of, One), (none_of, None_), (lambda c, *_: negation(c), Not)) if x]
    if strict and len(given) > 1:
        raise ValueError("only the first list would count")
    return given[0][0](*given[0][1]) if given else Cond.of(F.lit(True))


# The kinds of conditions that a case can hold; the first of them that it has decides.
CASE_ORDER = ("bool", "range", "geo_distance", "geo_polygon", "geo_line", "geo_multi_polygon", "nested", "exists", "missing", "template", "match", "match_phrase", "term", "filter")


def case(**given: Cond | None) -> Cond:
    """The one condition of a case that counts, by CASE_ORDER, whatever order they are given in; an empty case is true."""
    if unknown := set(given) - set(CASE_ORDER):
        raise ValueError(f"no such conditions: {sorted(unknown)}")
    return next((given[k] for k in CASE_ORDER if given.get(k) is not None), Cond.of(F.lit(True)))


def nested_any(array: Column, condition) -> Cond:
    """Whether any element of an array of structs matches, with the best score; condition maps an element to a Cond."""
    hits = F.filter(F.coalesce(array, F.array()), lambda x: x.isNotNull() & condition(x).match)
    return Cond.of(F.size(hits) > 0, F.coalesce(F.array_max(F.transform(hits, lambda x: condition(x).score)), F.lit(0.0)))


def readable(user: str, read: Column, write: Column, delete: Column, public: bool = False) -> Cond:
    """Access lists that name the user; public pages also those that name everyone."""
    names = [F.array_contains(x, user) for x in (read, write, delete)] + [F.array_contains(read, "*")] * public
    return Cond.of(reduce(lambda a, b: a | b, [F.coalesce(n, F.lit(False)) for n in names]))


def recent(c: Column, as_of: Column, interval: str = "1 hour") -> Cond:
    """Within the interval before as_of."""
    return Cond.of((c > as_of - F.expr(f"interval {interval}")) & (c <= as_of))


def listing(type_id: str, type_col: Column, attributes: Column | None = None, wanted: dict[str, list] | None = None, features: Column | None = None, names: list[str] = (), near: Column | None = None, title: Cond | None = None) -> Cond:
    """A listing's filter: type, place, each attribute among the values wanted, title, each feature named."""
    conds = [equal(type_col, type_id)]
    if near is not None:
        conds.append(Cond.of(near))
    for name, values in (wanted or {}).items():
        conds.append(Cond.of(_has_value(attributes, name, values)))
    if title is not None:
        conds.append(title)
    for name in names:
        conds.append(Cond.of(_exists(F.flatten(F.transform(features, lambda s: s["terms"])), lambda t: F.lower(t["humanName"]) == name.lower())))
    return all_of(*conds)


def _has_value(attributes: Column, name: str, values: list) -> Column:
    texts = any(isinstance(v, str) for v in values)
    return _exists(attributes, lambda a: (a["name"] == name) & (a["value"].isin(values) if texts else a["intValue"].isin(values)))


def _exists(array: Column, test) -> Column:
    return F.exists(F.coalesce(array, F.array()), lambda x: F.coalesce(test(x), F.lit(False)))
