"""Field access and coercion: paths into free-form documents, numbers, dates and keys as text."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F, types as T

#: What reads as a number; a cast alone would also take blanks and type suffixes.
NUMBER = r"^[+-]?([0-9]+\.?[0-9]*|\.[0-9]+)([eE][+-]?[0-9]+)?$"
#: Date layouts, tried in this order.
LAYOUTS = ("yyyy-MM-dd'T'HH:mm:ss[.SSSSSS][.SSS]XXX", "yyyy-MM-dd", "M/d/yyyy", "yyyy-MM-dd HH:mm:ss")


def spare(name: str, *frames: DataFrame) -> str:
    """A column name that none of the frames has, for a step's own use."""
    taken = {c.lower() for df in frames for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def to_number(c: Column) -> Column:
    """A double from number text, else null (N3 has 0 instead, see to_float)."""
    return F.when(c.rlike(NUMBER), c.try_cast("double"))


def to_float(c: Column) -> Column:
    return F.coalesce(to_number(c.cast("string")), F.lit(0.0))


def numeric(c: Column) -> Column:
    """A double from a number or number text, else null: what metrics are made of."""
    return F.when(F.typeof(c) == "string", to_number(c.cast("string"))).otherwise(c.try_cast("double"))


def to_date(c: Column) -> Column:
    """An instant from text in one of LAYOUTS, else null; without an offset it is UTC in a UTC session."""
    return F.coalesce(*[F.try_to_timestamp(c, F.lit(layout)) for layout in LAYOUTS])


def to_time(c: Column) -> Column:
    """An instant from text in the first of LAYOUTS, else the zero time, the first day of year 1."""
    return F.coalesce(F.try_to_timestamp(c, F.lit(LAYOUTS[0])), F.make_timestamp_ltz(F.lit(1), F.lit(1), F.lit(1), F.lit(0), F.lit(0), F.lit(0), F.lit("UTC")))


def number_text(c: Column) -> Column:
    """The shortest decimal text without an exponent: 10.0 is 10, 1e7 is 10000000."""
    whole = (c == F.floor(c)) & (F.abs(c) < 1e15)
    digits = F.coalesce(c.try_cast("decimal(38,18)").cast("string"), c.try_cast("decimal(38,0)").cast("string"), c.cast("string"))
    plain = F.regexp_replace(F.regexp_replace(digits, r"(\.[0-9]*?)0+$", "$1"), r"\.$", "")
    return F.when(whole, c.try_cast("bigint").cast("string")).when(c.cast("string").contains("E"), plain).otherwise(c.cast("string"))


def add(a: Column, b: Column) -> Column:
    return to_float(a) + to_float(b)


def mul(a: Column, b: Column) -> Column:
    return to_float(a) * to_float(b)


def div(a: Column, b: Column) -> Column:
    """0 for a division by 0."""
    return F.coalesce(F.try_divide(to_float(a), to_float(b)), F.lit(0.0))


def key_text(c: Column) -> Column:
    """A bucket's key without white space at its ends."""
    return F.regexp_replace(c, r"^\s+|\s+$", "")


def raw_at(variant: Column, path: str) -> Column:
    """What a dot path leads to in a VARIANT document, null if there is nothing."""
    return F.try_variant_get(variant, "$." + path, "variant")


def text_at(variant: Column, path: str) -> Column:
    """The scalar that a dot path leads to as text; null for none, null, objects and arrays."""
    kind = F.schema_of_variant(raw_at(variant, path))
    number = F.try_variant_get(variant, "$." + path, "double")
    text = F.try_variant_get(variant, "$." + path, "string")
    return F.when(kind == "STRING", text).when(kind == "BOOLEAN", text).when(kind.isin("BIGINT", "DOUBLE") | kind.startswith("DECIMAL"), number_text(number))


def pluck(body: Column, name: str) -> Column:
    """A top-level property of JSON text if it is a string, else empty text (P5)."""
    doc = F.try_parse_json(body)
    return F.coalesce(F.when(F.schema_of_variant(raw_at(doc, name)) == "STRING", F.try_variant_get(doc, "$." + name, "string")), F.lit(""))


def typed_text(df: DataFrame, path: str) -> Column | None:
    """A typed column's dot path as text by the rules of text_at; None where it names no scalar."""
    kind: T.DataType = df.schema
    for part in path.split("."):
        found = next((f for f in kind.fields if f.name == part), None) if isinstance(kind, T.StructType) else None
        if found is None:
            return None
        kind = found.dataType
    if isinstance(kind, (T.StructType, T.ArrayType, T.MapType)):
        return None
    c = F.col(path)
    return number_text(c.cast("double")) if isinstance(kind, (T.FloatType, T.DoubleType)) else c.cast("string")


def project(df: DataFrame, source: list[str]) -> DataFrame:
    """Listed fields that are scalars: top-level ones keep their type, nested ones are text under the dotted name.

    Arrays, objects and unknown names are left out; _score is always kept.
    """
    out = []
    for path in [*source, *(["_score"] if "_score" in df.columns and "_score" not in source else [])]:
        c = typed_text(df, path)
        if c is not None:
            out.append(c.alias(path) if "." in path else F.col(path))
    return df.select(*out)


def unwrapped(df: DataFrame, path: str, item: str) -> DataFrame:
    """The rows in the array that a key path leads to, each one's item taken out."""
    return df.select(F.explode(path).alias("_x")).select(f"_x.{item}.*")
