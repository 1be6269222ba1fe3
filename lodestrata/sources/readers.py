"""Sources: Parquet directories with drifting nested fields, JSON, JSON Lines of results, JDBC, listings in HTML."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import links


def parquet(spark: SparkSession, path: str, *columns: str) -> DataFrame:
    df = spark.read.parquet(path)
    return df.select(*columns) if columns else df


def field(df: DataFrame, column: str, path: str) -> Column:
    """A field of a column that is a struct, a map, or JSON text, whichever this file has."""
    kind = dict(df.dtypes).get(column)
    if kind is None:
        return F.lit(None).cast("string")
    if kind.startswith("struct"):
        names = df.schema[column].dataType.names
        return F.col(f"{column}.{path}").cast("string") if path in names else F.lit(None).cast("string")
    if kind.startswith("map"):
        return F.try_element_at(F.col(column), F.lit(path)).cast("string")
    return F.get_json_object(column, f"$.{path}")


def new_rows(rows: DataFrame, target: DataFrame, keys: list[str]) -> DataFrame:
    """Rows whose key the target lacks, one for each key."""
    return rows.dropDuplicates(keys).join(target.select(*keys), keys, "left_anti")


def nested_json(spark: SparkSession, path: str, schema: str, children: str) -> DataFrame:
    """A JSON file of parents with an array of children: a row per child with its place."""
    df = spark.read.schema(schema).json(path, multiLine=True)
    rest = [c for c in df.columns if c != children]
    return df.select(*rest, F.posexplode(children).alias("place", "child")).select(*rest, "place", "child.*")


def json_lines(spark: SparkSession, path: str, schema: str, id_pattern: str = r"-([0-9]+)$") -> DataFrame:
    """Result lines {custom_id, error, body}: the id's number and the parsed body; failed and unreadable lines go."""
    lines = spark.read.text(path).select(F.from_json("value", "custom_id string, error string, body string").alias("v")).select("v.*")
    parsed = lines.where("error is null and custom_id is not null").select(F.try_to_number(F.regexp_extract("custom_id", id_pattern, 1), F.lit("999999999999")).cast("long").alias("id"), F.from_json("body", schema).alias("body"))
    return parsed.where("id is not null and body is not null").select("id", "body.*")


def jdbc(spark: SparkSession, url: str, table: str, key: str, low: int, high: int, partitions: int, **options: str) -> DataFrame:
    """A table read in ranges of its key, side by side."""
    reader = spark.read.format("jdbc").options(url=url, dbtable=table, partitionColumn=key, lowerBound=str(low), upperBound=str(high), numPartitions=str(partitions), **options)
    return reader.load()


def star(fact: DataFrame, inner: list[tuple[DataFrame, str]], outer: list[tuple[DataFrame, str]]) -> DataFrame:
    """A fact with its required and its optional dimensions; Spark broadcasts those that are small enough."""
    for dim, key in inner:
        fact = fact.join(dim, key)
    for dim, key in outer:
        fact = fact.join(dim, key, "left")
    return fact


def listing(pages: DataFrame, html_col: str = "html") -> DataFrame:
    """The links of listing pages, each once."""
    return pages.select(F.explode(links(F.col(html_col))).alias("link")).distinct()


def document(chunks: DataFrame, id_col: str, index_col: str, text_col: str, separator: str = "\n") -> DataFrame:
    """Each document's chunks in order, joined."""
    ordered = F.array_sort(F.collect_list(F.struct(F.col(index_col).alias("i"), F.col(text_col).alias("t"))))
    return chunks.groupBy(id_col).agg(F.array_join(F.transform(ordered, lambda s: s["t"]), separator).alias("content"))


def aliases(curated: DataFrame, found: DataFrame) -> DataFrame:
    """(name, id): found names without their prefix, curated entries winning."""
    from ..operators.fuse import first_by

    both = curated.select("name", "id", F.lit(0).alias("p")).unionByName(found.select("name", "id", F.lit(1).alias("p")))
    return first_by(both, ["name"], F.col("p"), F.col("id")).select("name", "id")
