"""Entity preparation: flattening, typed values, validation, stamping, change detection and upserts."""

from __future__ import annotations

import re
from decimal import Decimal
from functools import reduce

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F, types as T

from docquery.functions.fields import spare
from docquery.functions.text import bound
from docquery.operators.joins import GRANT_KEYS, with_flag
from docquery.session import kept

# Attribute kinds.
NUMBER, TEXT, COMPLEX, FLOAT = 0, 1, 2, 3
# Formats of text that a contract can name.
FORMATS = {
    "email": r"^[^@\s]+@[^@\s]+\.[^@\s]+$",
    "date": r"^[0-9]{4}-[0-9]{2}-[0-9]{2}$",
    "date-time": r"^[0-9]{4}-[0-9]{2}-[0-9]{2}[Tt ][0-9]{2}:[0-9]{2}:[0-9]{2}(\.[0-9]+)?([Zz]|[+-][0-9]{2}:[0-9]{2})$",
    "uuid": r"^[0-9a-fA-F]{8}(-[0-9a-fA-F]{4}){3}-[0-9a-fA-F]{12}$",
    "uri": r"^[a-zA-Z][a-zA-Z0-9+.-]*:\S+$",
}


def depth_of(kind: T.DataType, children: str) -> int:
    """How many levels of children the type of an array of structs has below its own."""
    below = kind.elementType[children].dataType if isinstance(kind, T.ArrayType) and children in kind.elementType.names else None
    return 0 if below is None else 1 + depth_of(below, children)


def leaves(array: Column, children: str, depth: int = 1) -> Column:
    """Leaves of a tree in an array of structs with so many levels below: a node's leaves, or itself without children (L1).

    Nodes of all levels have the same fields beside their children, which the lowest level has not. A null tree stays null.
    """
    if not depth:
        return array
    some = lambda a: F.size(F.coalesce(a[children], F.array())) > 0
    return F.flatten(F.transform(array, lambda a: F.when(some(a), leaves(a[children], children, depth - 1)).otherwise(F.array(a.dropFields(children)))))


def typed_values(attributes: Column, kind: str = "type", value: str = "value") -> Column:
    """intValue and floatValue from the text by the attribute's kind, 0 where it does not read as one (L2)."""
    whole = lambda a: F.when(a[kind] == NUMBER, F.coalesce(a[value].try_cast("int"), F.lit(0))).otherwise(F.lit(0))
    real = lambda a: F.when(a[kind] == FLOAT, F.coalesce(a[value].try_cast("double"), F.lit(0.0))).otherwise(F.lit(0.0))
    return F.transform(attributes, lambda a: a.withField("intValue", whole(a)).withField("floatValue", real(a)))


def selected_terms(terms: Column, children: str = "terms", only_selected: bool = True, depth: int = 1) -> Column:
    """Leaf terms, optionally those selected (L3)."""
    found = leaves(terms, children, depth)
    return F.filter(found, lambda t: t["selected"]) if only_selected else found


def listing(df: DataFrame) -> DataFrame:
    """Attributes flattened and typed, each feature set's terms flattened to the selected leaves (L4), as deep as they go."""
    inner = df.schema["featureSets"].dataType.elementType["terms"].dataType
    sets = F.transform("featureSets", lambda s: s.withField("terms", selected_terms(s["terms"], depth=depth_of(inner, "terms"))))
    flat = leaves(F.col("attributes"), "attributes", depth_of(df.schema["attributes"].dataType, "attributes"))
    return df.withColumns({"attributes": typed_values(flat), "featureSets": sets})


def required_errors(df: DataFrame, rules: dict[str, list[str]]) -> Column:
    """Messages of rules that fail, an empty array if none does.

    rules: a dotted path to "required", "email", "min:n" or "max:n" checks; a path through an array checks every element.
    """
    out = []
    for path, checks in rules.items():
        for check in checks:
            out.append(F.when(_fails(df.schema, None, path.split("."), check), F.lit(f"{path}: {check}")))
    return F.array_compact(F.array(*out)) if out else F.array().cast("array<string>")


def _fails(schema: T.StructType, at: Column | None, parts: list[str], check: str) -> Column:
    name, rest = parts[0], parts[1:]
    c = F.col(name) if at is None else at[name]
    kind = schema[name].dataType
    if rest and isinstance(kind, T.ArrayType):
        return F.coalesce(F.exists(c, lambda x: _fails(kind.elementType, x, rest, check)), F.lit(False))
    if rest:
        return _fails(kind, c, rest, check)
    if check == "required":
        empty = F.size(c) == 0 if isinstance(kind, (T.ArrayType, T.MapType)) else c == "" if isinstance(kind, T.StringType) else F.lit(False)
        return c.isNull() | F.coalesce(empty, F.lit(False))
    if check == "email":
        return F.coalesce(~c.rlike(FORMATS["email"]), F.lit(False))
    what, n = check.split(":")
    size = F.size(c) if isinstance(kind, T.ArrayType) else F.length(c) if isinstance(kind, T.StringType) else c
    return F.coalesce(size < float(n) if what == "min" else size > float(n), F.lit(False))


def contract_errors(doc: Column, contract: dict, path: str = "$") -> Column:
    """Where a VARIANT document breaks a JSON-Schema contract, an empty array if nowhere.

    Of the schema: type (one or several), required, properties, additionalProperties, enum, const, pattern, format,
    minLength, maxLength, minimum, maximum, exclusiveMinimum, exclusiveMaximum, multipleOf, items, minItems, maxItems,
    uniqueItems, allOf, anyOf, oneOf, not and $ref within the contract; a reference to itself is refused, as a Column has
    no recursion. Elements are named [] and other properties * in messages. No contract passes everything.
    """
    found = _broken(doc, contract, path, path, contract, ())
    return F.array_compact(F.concat(*found)) if found else F.array().cast("array<string>")


def _kind(doc: Column, path: str) -> Column:
    """The schema of a plain value, OBJECT or ARRAY: what is in these is not walked through."""
    got = lambda kind: F.try_variant_get(doc, path, kind)
    return F.when(got("struct<>").isNotNull(), "OBJECT").when(got("array<variant>").isNotNull(), "ARRAY").otherwise(F.schema_of_variant(got("variant")))


def _below(doc: Column, path: str, name: str) -> tuple[Column, str]:
    """Where a property is: by path, or taken out of the object if its name is none that a path can have."""
    if re.fullmatch(r"\w+", name):
        return doc, f"{path}.{name}"
    return F.try_variant_get(doc, path, "map<string,variant>")[name], "$"


def _equals(value, kind: Column, text: Column, number: Column, is_number: Column) -> Column:
    if value is None:
        return kind == "VOID"
    if isinstance(value, bool):
        return (kind == "BOOLEAN") & (text == str(value).lower())
    return is_number & (number == float(value)) if isinstance(value, (int, float)) else (kind == "STRING") & (text == str(value))


def _referred(root: dict, ref: str) -> dict:
    rule = root
    for part in ref.removeprefix("#").split("/")[1:]:
        rule = rule[part.replace("~1", "/").replace("~0", "~")]
    return rule


def _broken(doc: Column, rule: dict | bool, path: str, shown: str, root: dict, opened: tuple[str, ...]) -> list[Column]:
    """Arrays of messages, null where nothing is broken, for what the path leads to in the document; its kind is found once."""
    held: list[Column] = []

    def messages(kind: Column) -> Column:
        held.extend(_messages(doc, kind, rule, path, shown, root, opened))
        return F.concat(*held) if held else F.array().cast("array<string>")

    found = bound(_kind(doc, path), messages)
    return [found] if held else []


def _messages(doc: Column, kind: Column, rule: dict | bool, path: str, shown: str, root: dict, opened: tuple[str, ...]) -> list[Column]:
    there = kind.isNotNull()
    say = lambda bad, what: F.array(F.when(there & F.coalesce(bad, F.lit(False)), F.lit(f"{shown} {what}")))
    if isinstance(rule, bool):
        return [] if rule else [say(F.lit(True), "is not allowed")]
    if "$ref" in rule:
        if rule["$ref"] in opened:
            raise ValueError(f"a contract that refers to itself: {rule['$ref']}")
        return _broken(doc, _referred(root, rule["$ref"]), path, shown, root, (*opened, rule["$ref"]))
    inner = lambda r, d=doc, p=path, s=shown: _broken(d, r, p, s, root, opened)
    fits = lambda r: F.size(F.array_compact(F.concat(*inner(r), F.array().cast("array<string>")))) == 0
    each = lambda values, r, s: F.flatten(F.coalesce(F.transform(values, lambda x: F.concat(*inner(r, x, "$", s))), F.array()))

    text, number = F.try_variant_get(doc, path, "string"), F.try_variant_get(doc, path, "double")
    is_number, is_text = kind.isin("BIGINT", "DOUBLE", "FLOAT") | kind.startswith("DECIMAL"), kind == "STRING"
    is_object, is_array = kind.startswith("OBJECT"), kind.startswith("ARRAY")
    kinds = {"string": is_text, "number": is_number, "integer": is_number & (number == F.floor(number)), "boolean": kind == "BOOLEAN", "object": is_object, "array": is_array, "null": kind == "VOID"}
    wanted = [rule["type"]] if isinstance(rule.get("type"), str) else rule.get("type", [])
    out = [say(~reduce(lambda a, b: a | b, [kinds[k] for k in wanted]), f"is no {' or '.join(wanted)}")] if wanted else []
    for name in rule.get("required", ()):
        out.append(F.array(F.when(there & is_object & _kind(*_below(doc, path, name)).isNull(), F.lit(f"{shown}.{name} is required"))))
    named = rule.get("properties", {})
    for name, below in named.items():
        out += inner(below, *_below(doc, path, name), f"{shown}.{name}")
    others = rule.get("additionalProperties", True)
    if others is not True:
        rest = F.map_filter(F.try_variant_get(doc, path, "map<string,variant>"), lambda k, _: ~k.isin(*named) if named else F.lit(True))
        if others is False:
            out.append(say(F.size(F.map_keys(rest)) > 0, "has other properties"))
        elif inner(others):
            out.append(each(F.map_values(rest), others, f"{shown}.*"))
    if "enum" in rule or "const" in rule:
        values = rule["enum"] if "enum" in rule else [rule["const"]]
        out.append(say(~reduce(lambda a, b: a | b, [F.coalesce(_equals(v, kind, text, number, is_number), F.lit(False)) for v in values], F.lit(False)), "is none of the values"))
    if "pattern" in rule:
        out.append(say(is_text & ~text.rlike(rule["pattern"]), "does not fit the pattern"))
    if rule.get("format") in FORMATS:
        out.append(say(is_text & ~text.rlike(FORMATS[rule["format"]]), f"is no {rule['format']}"))
    elements = F.try_variant_get(doc, path, "array<variant>")
    limits = {
        "minLength": lambda n: is_text & (F.length(text) < n),
        "maxLength": lambda n: is_text & (F.length(text) > n),
        "minimum": lambda n: is_number & (number < n),
        "maximum": lambda n: is_number & (number > n),
        "exclusiveMinimum": lambda n: is_number & (number <= n),
        "exclusiveMaximum": lambda n: is_number & (number >= n),
        "multipleOf": lambda n: is_number & F.coalesce(F.try_mod(number.try_cast("decimal(38,12)"), F.lit(Decimal(str(n)))) != 0, number / n != F.round(number / n)),
        "minItems": lambda n: is_array & (F.size(elements) < n),
        "maxItems": lambda n: is_array & (F.size(elements) > n),
    }
    out += [say(bad(rule[name]), f"breaks {name}") for name, bad in limits.items() if name in rule]
    if rule.get("uniqueItems"):
        out.append(say(F.size(F.array_distinct(F.transform(elements, lambda x: F.to_json(x)))) < F.size(elements), "has equal items"))
    if "items" in rule and inner(rule["items"]):
        out.append(each(elements, rule["items"], f"{shown}[]"))
    for below in rule.get("allOf", ()):
        out += inner(below)
    if "anyOf" in rule:
        out.append(say(~reduce(lambda a, b: a | b, [fits(r) for r in rule["anyOf"]]), "fits none of the choices"))
    if "oneOf" in rule:
        out.append(say(reduce(lambda a, b: a + b, [fits(r).cast("int") for r in rule["oneOf"]]) != 1, "does not fit one of the choices alone"))
    if "not" in rule:
        out.append(say(fits(rule["not"]), "fits what it must not"))
    return out


def stamped(df: DataFrame, owner: str, as_of: Column, key: list[str] | None = None, public: bool = False) -> DataFrame:
    """id, userId, status, createdAt and access lists for new rows (L7). With key columns the id is a hash of them, the same on every run."""
    made = F.substring(F.sha2(F.concat_ws("\u0001", *key), 256), 1, 32) if key else F.uuid()
    lists = F.struct(F.array(F.lit("*" if public else owner)).alias("readUserIds"), F.array(F.lit(owner)).alias("writeUserIds"), F.array(F.lit(owner)).alias("deleteUserIds"))
    return df.withColumns({"id": made, "userId": F.lit(owner), "status": F.lit(1), "createdAt": as_of, "entityPermissions": lists})


def _ordered(c: Column, kind: T.DataType) -> Column:
    """The value with the entries of its maps, at any depth, as arrays in the order of their keys: equal maps come out equal."""
    if isinstance(kind, T.MapType):
        entries = F.array_sort(F.transform(F.map_entries(c), lambda e: F.struct(F.to_json(F.struct(_ordered(e["key"], kind.keyType))).alias("k"), _ordered(e["value"], kind.valueType).alias("v"))), _by_key)
        return entries
    if isinstance(kind, T.ArrayType) and _has_map(kind.elementType):
        return F.transform(c, lambda x: _ordered(x, kind.elementType))
    if isinstance(kind, T.StructType) and _has_map(kind):
        return F.when(c.isNotNull(), F.struct(*[_ordered(c[f.name], f.dataType).alias(f.name) for f in kind]))
    return c


def _by_key(a: Column, b: Column) -> Column:
    return F.when(a["k"] < b["k"], -1).when(a["k"] > b["k"], 1).otherwise(0)


def _has_map(kind: T.DataType) -> bool:
    if isinstance(kind, T.StructType):
        return any(_has_map(f.dataType) for f in kind)
    return _has_map(kind.elementType) if isinstance(kind, T.ArrayType) else isinstance(kind, T.MapType)


def row_hash(df: DataFrame, without: list[str] = ()) -> Column:
    """A hash of all columns by name; the order in which a map's entries came does not count."""
    held = [_ordered(F.col(f"`{f.name}`"), f.dataType).alias(f.name) for f in sorted(df.schema, key=lambda f: f.name) if f.name not in without]
    return F.sha2(F.to_json(F.struct(*held), {"ignoreNullFields": "false"}), 256)


def latest_of(df: DataFrame, key: str, version: str | None = None) -> DataFrame:
    """One row for each key, that of the largest version, then hash; rows without a key stay as they are."""
    order = F.struct(*([version] if version else []), row_hash(df))
    one = df.where(F.col(key).isNotNull()).groupBy(F.col(key).alias("_k")).agg(F.max_by(F.struct(*[F.col(f"`{c}`") for c in df.columns]), order).alias("_r")).select("_r.*")
    return one.unionByName(df.where(F.col(key).isNull()))


def changes(old: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """(key, action): new, changed or same for every new row, gone for keys that only the old version has."""
    a, b = (d.select(F.col(key), row_hash(d).alias(n)) for d, n in ((old, "_old"), (new, "_new")))
    action = F.when(F.col("_old").isNull(), "new").when(F.col("_new").isNull(), "gone").when(F.col("_old") != F.col("_new"), "changed").otherwise("same")
    return a.join(b, key, "full").select(key, action.alias("action"))


def composite_key(df: DataFrame, fields: list[str], name: str = "composite_key") -> DataFrame:
    """Text fields joined by colons; null where one of them is missing or no text."""
    texts = [F.col(f) if isinstance(df.select(f).schema[0].dataType, T.StringType) else F.lit(None).cast("string") for f in fields]
    whole = F.when(~F.array_contains(F.transform(F.array(*texts), lambda t: t.isNull()), True), F.concat_ws(":", *texts))
    return df.withColumn(name, whole)


def upserted(old: DataFrame, new: DataFrame, key: str, version: str) -> DataFrame:
    """The latest version of each key of both."""
    latest, n = F.row_number().over(Window.partitionBy(key).orderBy(F.desc(version))), spare("_n", old, new)
    return old.unionByName(new).withColumn(n, latest).where(F.col(n) == 1).drop(n)


#: Changed keys, or partitions that they touch, that are broadcast; more are joined by a shuffle.
BROADCAST_KEYS = 500_000


def read_index(spark: SparkSession, path: str, key: str = "id", schema: T.StructType | None = None) -> DataFrame:
    """The rows of an index; the row of nulls that keeps an emptied partition is left out.

    An index that is not there yet is empty if its schema is given.
    """
    try:
        found = (spark.read.schema(schema) if schema else spark.read).parquet(path)
        return found.where(F.col(key).isNotNull())
    except AnalysisException as missing:
        if schema is None or missing.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], schema)


def write_changed(old: DataFrame, new: DataFrame, key: str, partition: str, path: str, gone: DataFrame | None = None) -> None:
    """Partitions of an index that new, changed, moved or deleted rows touch, written anew; others stay as they are.

    The index at path is partitioned by its composite key; a row moves where that changes. gone has keys to delete. Rows
    without a key or partition are not indexed, and of rows that repeat a key the one of the largest hash is. Only the keys of the change meet the index, broadcast up to BROADCAST_KEYS,
    and of its rows only touched partitions are read whole. A partition that is left empty holds one row of nulls, which
    read_index leaves out: an overwrite cannot take a folder away. Writing the same change twice changes nothing.
    """
    new = new.where(F.col(key).isNotNull() & F.col(partition).isNotNull() & (F.col(partition) != ""))
    new = kept(latest_of(new, key), "new")
    gone = None if gone is None else kept(gone, "gone")
    keys = (new.select(key) if gone is None else new.select(key).unionByName(gone.select(key))).distinct()
    small = keys.count() <= BROADCAST_KEYS
    near = F.broadcast if small else lambda d: d
    held = old.join(near(keys), key, "left_semi")
    was, now = held.select(F.col(key), F.col(partition).alias("_was"), row_hash(held).alias("_old")), new.select(F.col(key), F.col(partition).alias("_now"), row_hash(new).alias("_new"))
    moves = kept(was.join(now, key, "full").where(~F.col("_old").eqNullSafe(F.col("_new"))), "moves")
    touched = moves.select(key).distinct()
    parts = moves.select(F.explode(F.array_compact(F.array("_was", "_now"))).alias(partition)).distinct()
    others = old.join(near(parts), partition, "left_semi").join(near(touched), key, "left_anti")
    rows = others.unionByName(new.join(near(touched), key, "left_semi"))
    empty = parts.join(rows.select(partition).distinct(), partition, "left_anti")
    nulls = empty.select(*[F.col(c) if c == partition else F.lit(None).cast(new.schema[c].dataType).alias(c) for c in rows.columns])
    rows.unionByName(nulls).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(partition).parquet(path)


def with_timestamps(df: DataFrame) -> DataFrame:
    """Lower-case names, and a timestamp beside each text column for values that are one."""
    texts = [f.name for f in df.schema if isinstance(f.dataType, T.StringType)]
    out = df.withColumns({f"{c}_ts": F.try_to_timestamp(F.col(c), F.lit("yyyy-MM-dd'T'HH:mm:ss[.SSSSSS][.SSS]XXX")) for c in texts})
    return out.toDF(*[c.lower() for c in out.columns])


def expanded(df: DataFrame, array: str | None = None) -> DataFrame:
    """One row for each struct in the table's array of structs, with the other columns beside it."""
    found = array or next(f.name for f in df.schema if isinstance(f.dataType, T.ArrayType) and isinstance(f.dataType.elementType, T.StructType))
    others = [c for c in df.columns if c != found]
    inner = df.schema[found].dataType.elementType.names
    one = spare("_x", df)
    return df.select(*others, F.explode(found).alias(one)).select(*[c for c in others if c not in inner], f"{one}.*")


def writable(df: DataFrame, user: str, owner: str, key: str, grants: DataFrame, kind: int, asset: str, op: int) -> DataFrame:
    """Rows that the user owns or has a grant to write."""
    held = grants.where((F.col("user") == user) & (F.col("type") == kind) & (F.col("asset") == asset) & (F.col("op") == op)).select(GRANT_KEYS[2])
    flag = spare("_granted", df)
    return with_flag(df, flag, key, held, GRANT_KEYS[2]).where((F.col(owner) == user) | F.col(flag)).drop(flag)
