"""Reading and writing documents, indexes, matrices and landed service responses."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession, functions as F, types as T


@dataclass(frozen=True)
class Index:
    """A named collection: where it is, the fields of its composite key, and its key."""

    path: str
    fields: tuple[str, ...]
    entity: str = ""
    key: str = "id"


def decoded(df: DataFrame, column: str, schema: str) -> tuple[DataFrame, DataFrame]:
    """Rows of base64 JSON as documents, and apart from them the rows that are none."""
    text = F.try_to_binary(column, F.lit("base64")).cast("string")
    parsed = df.withColumn("_text", text).withColumn("_doc", F.when(F.try_parse_json("_text").isNotNull(), F.from_json("_text", schema)))
    return parsed.where("_doc is not null").select("_doc.*"), parsed.where("_doc is null").drop("_doc", "_text")


def static(spark: SparkSession, rows: list, schema: str) -> DataFrame:
    """Rows at hand as a table; none at all is an error."""
    if not rows:
        raise ValueError("no rows")
    return spark.createDataFrame(rows, schema)


def composite(index: Index, values: dict[str, str]) -> str:
    """The composite key that values ask for; a missing one stays empty between its colons (S3)."""
    if not values:
        raise ValueError("no composite key")
    return ":".join(values.get(f, "") for f in index.fields)


def scan(spark: SparkSession, indexes: dict[str, Index], name: str, values: dict[str, str]) -> DataFrame:
    """The documents of one composite key: a pruned partition of the index."""
    index = indexes[name]
    rows = spark.read.parquet(index.path)
    rows = rows.where(F.col(index.key).isNotNull()) if index.key in rows.columns else rows  # see entities.write_changed
    return rows.where(F.col("composite_key") == composite(index, values))


def indexes_of(definitions: DataFrame, entity: str) -> DataFrame:
    """Indexes declared for an entity type."""
    return definitions.where(F.col("entity") == entity)


def matrix(spark: SparkSession, path: str, columns: int) -> DataFrame:
    """A CSV of numbers as row_id and vector; a cell that is none fails the read."""
    schema = T.StructType([T.StructField(f"c{i}", T.DoubleType()) for i in range(columns)])
    return spark.read.schema(schema).option("mode", "FAILFAST").csv(path).select(F.monotonically_increasing_id().alias("row_id"), F.array(*schema.names).alias("v"))


def write_numbers(df: DataFrame, path: str, digits: int = 6, header: bool = False) -> None:
    """Doubles with a fixed number of decimals as CSV."""
    kinds = {f.name: f.dataType for f in df.schema}
    df.select(*[F.format_string(f"%.{digits}f", c).alias(c) if isinstance(kinds[c], T.DoubleType) else F.col(c) for c in df.columns]).write.mode("overwrite").option("header", header).csv(path)


def write_json(df: DataFrame, path: str, compressed: bool = False) -> None:
    """One JSON object a line, optionally gzipped."""
    df.write.mode("overwrite").option("compression", "gzip" if compressed else "none").json(path)


def read_entities(spark: SparkSession, path: str, schema: str | None = None) -> DataFrame:
    """Entities stored as JSON, gzipped or not."""
    return (spark.read.schema(schema) if schema else spark.read).json(path)


def by_ids(df: DataFrame, key: str, ids: DataFrame | list) -> DataFrame:
    """Rows of the given ids (S10): few as a filter, a table of them as a semi join."""
    if isinstance(ids, DataFrame):
        return df.join(ids.select(F.col(ids.columns[0]).alias(key)), key, "left_semi")
    return df.where(F.col(key).isin(ids))


def usage_lines(spark: SparkSession, path: str) -> DataFrame:
    """Report lines of usage logs, with file and place as batch and line number."""
    lines = spark.read.text(path).select(F.input_file_name().alias("batch_id"), F.monotonically_increasing_id().alias("line_no"), F.col("value").alias("message"))
    return lines.where(F.col("message").startswith("REPORT"))


def landed_emissions(df: DataFrame, body: str) -> DataFrame:
    """location and rating of the first element of each landed JSON array."""
    first = F.get(F.from_json(body, "array<struct<location: string, rating: double>>"), F.lit(0))
    return df.select("*", first.alias("_x")).where("_x is not null").select(*[c for c in df.columns if c != body], "_x.*")


def landed_index(df: DataFrame, body: str) -> DataFrame:
    """Grid index responses with typed fields."""
    x = F.from_json(body, "ba string, percent string, moer string, point_time string")
    typed = [F.col("_x.ba").alias("ba"), F.col("_x.percent").try_cast("int").alias("percent"), F.col("_x.moer").try_cast("double").alias("moer"), F.try_to_timestamp("_x.point_time").alias("point_time")]
    return df.select(x.alias("_x")).select(*typed)


def regions(spark: SparkSession, path: str, lines: bool = False) -> DataFrame:
    """The region dimension with numeric coordinates, from a JSON array of objects, or of one object a line."""
    return spark.read.option("multiLine", not lines).json(path).select("RegionName", F.col("Latitude").try_cast("double").alias("lat"), F.col("Longitude").try_cast("double").alias("lon"))


def reports(df: DataFrame, body: str) -> DataFrame:
    """Grid-intensity reports with their map."""
    x = F.from_json(body, "id string, intensities map<string, double>, startDate timestamp, endDate timestamp")
    return df.select(x.alias("_x")).select("_x.*")
