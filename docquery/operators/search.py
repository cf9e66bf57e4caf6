"""Sorting, paging and the whole search: union, match and score, modifiers, post-filter, facets, hits or aggregations."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F, types as T

from docquery.functions.fields import project, to_number
from docquery.operators.aggregations import bundle, facets
from docquery.operators.predicates import Cond
from docquery.operators.relevance import modified


def order_by(df: DataFrame, sorts: list[tuple[str, str]], tiebreak: list[str] = ()) -> list[Column]:
    """Sort keys: missing values are the smallest; text that reads as numbers comes first, as numbers (O1, O2).

    An order other than asc or desc sorts nothing. The tiebreak makes the order total.
    """
    keys: list[Column] = []
    for name, direction in sorts:
        if direction not in ("asc", "desc"):
            continue
        text = isinstance(df.schema[name].dataType, T.StringType) if name in df.columns else False
        parts = [F.col(name).isNotNull(), to_number(F.col(name)).isNull(), to_number(F.col(name)), F.col(name)] if text else [F.col(name)]
        keys += [p.asc_nulls_first() if direction == "asc" else p.desc_nulls_last() for p in parts]
    return [*keys, *[F.col(t).asc() for t in tiebreak]]


def page(df: DataFrame, order: list[Column], offset: int = 0, limit: int = 0) -> DataFrame:
    """A page of the ordered rows: no limit means all, a negative offset is 0 (O4). Planned as a top-k, not a full sort."""
    out = df.orderBy(*order) if order else df
    out = out.offset(offset) if offset > 0 else out
    return out.limit(limit) if limit > 0 else out


def matched(df: DataFrame, cond: Cond) -> DataFrame:
    """Rows that match, with _score."""
    return df.withColumn("_score", cond.score).where(cond.filter)


def union_all(parts: list[DataFrame]) -> DataFrame:
    """All rows of all parts, by column name."""
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)


def piped(df: DataFrame, *steps: Callable[[DataFrame], DataFrame | None]) -> DataFrame:
    """Each step's rows go to the next (O9); a step that returns None is skipped."""
    for step in steps:
        out = step(df)
        df = df if out is None else out
    return df


#: Rows that list queries give at most, and those over vocabularies: a feature of these listings.
LIST_CAP, VOCABULARY_CAP = 1000, 100


def listed(df: DataFrame, order: list[Column], cap: int = LIST_CAP) -> DataFrame:
    """The first rows of a listing, as many as such a query gives at most."""
    return page(df, order, 0, cap)


@dataclass
class Hooks:
    """What a caller hangs around writes and finds (N11): callables from rows to rows, None for no change."""

    before_save: tuple[Callable[[DataFrame], DataFrame | None], ...] = ()
    after_save: tuple[Callable[[DataFrame], DataFrame | None], ...] = ()
    after_find: tuple[Callable[[DataFrame], DataFrame | None], ...] = ()

    def saved(self, df: DataFrame, save: Callable[[DataFrame], None]) -> DataFrame:
        """The rows after the hooks before the save are saved; what the hooks after it make of them is returned."""
        rows = piped(df, *self.before_save)
        save(rows)
        return piped(rows, *self.after_save)

    def found(self, df: DataFrame) -> DataFrame:
        """A find's rows after its hooks."""
        return piped(df, *self.after_find)


@dataclass
class Controls:
    """What applies to a union of queries: all of it lazy but the plan."""

    sorts: list[tuple[str, str]] = field(default_factory=list)
    tiebreak: list[str] = field(default_factory=list)
    source: list[str] = field(default_factory=list)
    offset: int = 0
    limit: int = 0
    post_filter: Cond | None = None
    modifiers: list[tuple[Column, float]] = field(default_factory=list)
    combine: str = "multiply"
    facets: list[str] = field(default_factory=list)
    aggregations: dict[str, Callable[[DataFrame], DataFrame]] = field(default_factory=dict)


@dataclass
class Result:
    """Lazy frames: hits are None where aggregations are asked for."""

    hits: DataFrame | None
    total: DataFrame
    aggregations: dict[str, DataFrame]
    facets: DataFrame | None


def search(queries: list[tuple[DataFrame, Cond]], controls: Controls | None = None) -> Result:
    """Queries over their own tables, joined as one list of hits."""
    c = controls or Controls()
    rows = union_all([matched(df, cond) for df, cond in queries])
    if c.modifiers:
        rows = rows.withColumn("_score", modified(F.col("_score"), c.modifiers, c.combine))
    if c.post_filter is not None:
        rows = rows.where(c.post_filter.filter)
    hits = None
    if not c.aggregations:
        ordered = page(rows, order_by(rows, c.sorts or [("_score", "desc")], c.tiebreak), c.offset, c.limit)
        hits = project(ordered, c.source) if c.source else ordered
    return Result(hits, rows.agg(F.count("*").alias("total_hits")), bundle(rows, c.aggregations), facets(rows, c.facets) if c.facets else None)
