"""Trees of any depth in JSON documents: their nodes and leaves some levels at a time, and contracts that hold at every node."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, functions as F

from docquery.functions.text import bound
from docquery.session import kept


#: Levels that are opened in a row before its nodes are written.
ROUND = 8


def nodes(df: DataFrame, key: str, tree: Column, children: str) -> DataFrame:
    """(key, path, node, leaf) of every node below a VARIANT tree: an array of nodes or one node; path has its places from 0 on.

    A node is an object; its children are in the array of that name. What is no object, and children that are no array, are
    left out, as are rows whose tree is null.
    """
    return _walked(df, key, tree, children, lambda node, leaf: {"node": node, "leaf": leaf})


def _walked(df: DataFrame, key: str, tree: Column, children: str, made: Callable[[Column, Column], dict[str, Column]], wanted: str = "true") -> DataFrame:
    """(key, path) and what is made of each node and of whether it is a leaf, where wanted, a condition on what is made, holds.

    A round opens ROUND levels and writes what is made of them and the children that are still to be opened, so neither the
    plan nor a row grows with the depth; the rounds end with the deepest tree. All of a node is made once, before it is a row.
    """
    below = lambda v: F.try_variant_get(v, f"$.{children}", "array<variant>")
    leaf = lambda inner: ~F.coalesce(F.exists(inner, _is_object), F.lit(False))

    def opened(values: Column, above: Column) -> Column:
        def entry(v: Column, i: Column) -> Column:
            held = lambda inner: bound(leaf(inner), lambda x: F.struct(F.concat(above, F.array(i)).alias("path"), inner.alias("_below"), (~x).alias("_more"), *[c.alias(n) for n, c in made(v, x).items()]))
            return F.when(_is_object(v), bound(below(v), held))

        return F.filter(F.transform(values, entry), lambda x: x.isNotNull())

    level = df.select(F.col(key), F.coalesce(F.try_variant_get(tree, "$", "array<variant>"), F.when(_is_object(tree), F.array(tree))).alias("_nodes"), F.array().cast("array<int>").alias("path"))
    names = list(made(F.lit(None), F.lit(None)))
    found = None
    for number in range(1 << 20):
        rows = level.select(key, opened(F.col("_nodes"), F.col("path")).alias("_0"))
        for i in range(1, ROUND):
            deeper = F.transform(F.filter(f"_{i - 1}", lambda x: x["_more"]), lambda x: opened(x["_below"], x["path"]))
            rows = rows.select("*", F.flatten(deeper).alias(f"_{i}"))
        levels = F.array(*[F.struct(F.lit(i == ROUND - 1).alias("_last"), F.col(f"_{i}").alias("_level")) for i in range(ROUND)])
        one = rows.select(key, F.inline(levels)).select(key, "_last", F.inline("_level")).withColumn("_more", F.col("_last") & F.col("_more"))
        out = kept(one.select(key, "path", *names, F.expr(wanted).alias("_wanted"), "_more", F.when(F.col("_more"), F.col("_below")).alias("_nodes")).where("_wanted or _more"), f"round{number}")
        here = out.where("_wanted").select(key, "path", *names)
        found = here if found is None else found.unionByName(here)
        level = out.where("_more").select(key, "_nodes", "path")
        if level.isEmpty():
            return found
    raise RuntimeError("a tree without an end")


def _is_object(v: Column) -> Column:
    return F.try_variant_get(v, "$", "struct<>").isNotNull()


def leaves(df: DataFrame, key: str, tree: Column, children: str) -> DataFrame:
    """(key, path, node) of the nodes without children (L1); an attribute tree's and a term tree's alike (L3)."""
    return _walked(df, key, tree, children, lambda node, leaf: {"node": F.when(leaf, node)}, "node is not null")


def tree_errors(df: DataFrame, key: str, tree: Column, children: str, errors: Callable[[Column], Column]) -> DataFrame:
    """(key, path, error) of a contract that refers to itself for a node's children: the contract of one node, at each.

    errors gives a node's errors as an array of texts; children are nodes of their own, which the contract leaves alone.
    """
    found = _walked(df, key, tree, children, lambda node, _: {"_errors": errors(node)}, "size(_errors) > 0")
    return found.select(key, "path", F.explode("_errors").alias("error"))
