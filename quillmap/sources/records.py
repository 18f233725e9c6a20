"""Record sources and sinks: JSON with declared schemas, URLs, ordered listings."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

VERTEX = T.StructType([T.StructField("x", T.DoubleType()), T.StructField("y", T.DoubleType()), T.StructField("bulge", T.DoubleType())])
POLYGON = T.ArrayType(VERTEX)
CORRECTION = T.ArrayType(T.StructType([T.StructField(c, T.StringType()) for c in ("id", "floor_id", "space_id", "name", "text")]))


def vertices(raw: Column) -> Column:
    """``ARRAY<ARRAY<DOUBLE>>`` of ``[x, y]`` or ``[x, y, bulge]`` as a polygon; a bulge of 0 becomes null."""
    return F.transform(raw, lambda v: F.struct(F.get(v, F.lit(0)).alias("x"), F.get(v, F.lit(1)).alias("y"), F.nullif(F.get(v, F.lit(2)), F.lit(0.0)).alias("bulge")))


def doors(raw: DataFrame, column: str) -> DataFrame:
    """Doors with their place in the list; one leaf unless they say otherwise."""
    out = raw.select("*", F.posexplode(column).alias("pos", "door")).drop(column)
    return out.select("*", "door.*").drop("door").withColumn("leaves", F.coalesce("leaves", F.lit(1)))


def strict_json(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """JSON that must have the schema; anything else stops the read."""
    return spark.read.schema(schema).option("mode", "FAILFAST").json(path)


def stored_list(text: Column) -> Column:
    """A stored JSON list of corrections; malformed text is an empty list and rows without an id go."""
    return F.filter(F.coalesce(F.from_json(text, CORRECTION), F.from_json(F.lit("[]"), CORRECTION)), lambda c: c.id.isNotNull())


def route(url: Column) -> tuple[Column, Column]:
    """The first part of a URL's path, and its last part, without query and fragment."""
    path = F.regexp_extract(url, r"^[a-z]+://[^/?#]*([^?#]*)", 1)
    return F.regexp_extract(path, r"^/([^/]*)", 1), F.regexp_extract(path, r"([^/]*)/?$", 1)


def with_parameter(url: Column, name: str, value: Column) -> Column:
    """``url`` with one query parameter set, or taken out where ``value`` is null; other parameters stay."""
    base, query = F.substring_index(url, "?", 1), F.when(F.instr(url, "?") > 0, F.regexp_extract(url, r"\?(.*)$", 1)).otherwise(F.lit(""))
    rest = F.filter(F.split(query, "&"), lambda p: (p != "") & ~F.startswith(p, F.lit(f"{name}=")))
    parts = F.when(value.isNull(), rest).otherwise(F.concat(rest, F.array(F.concat(F.lit(f"{name}="), value))))
    return F.concat(base, F.when(F.size(parts) > 0, F.concat(F.lit("?"), F.array_join(parts, "&"))).otherwise(F.lit("")))


def write_ordered(df: DataFrame, path: str, *order: str, by: str | None = None) -> None:
    """JSON lines in order, in one folder per value of ``by`` if it is given."""
    w = df.orderBy(*order).write
    (w.partitionBy(by) if by else w).json(path)


def patch_problems(lines: Column, doors: Column, guides: Column) -> Column:
    """What is wrong with a patch: lines of fewer than four values, doors of fewer than two, guides of other than three points.

    Lists are arrays of arrays, guides a map of names to arrays of points; null lists are empty.
    """

    def short(items: Column, least: int, what: str) -> Column:
        places = F.transform(items, lambda v, i: F.when(F.coalesce(F.size(v), F.lit(0)) < least, F.concat(F.lit(f"{what} "), (i + 1).cast("string"), F.lit(f" needs {least} values"))))
        return F.coalesce(F.array_compact(places), F.array().cast("array<string>"))

    odd = F.transform(F.filter(F.map_entries(guides), lambda g: F.coalesce(F.size(g.value), F.lit(0)) != 3), lambda g: F.concat(F.lit("guide "), g.key, F.lit(" needs 3 points")))
    return F.concat(short(lines, 4, "line"), short(doors, 2, "door"), F.coalesce(odd, F.array().cast("array<string>")))


def module_rows(spark: SparkSession, path: str, name: str) -> DataFrame:
    """``file, line, row``: the rows of the list constant ``name`` in code modules that hold one ``[..],`` row a line.

    A row is an array of its elements as JSON text (plain text for strings, null for ``undefined``), to be read with the
    schema of its place. Lines are numbered in their file's list from 0. A line that does not parse stops the read; files
    without the list give no rows.
    """
    text = spark.read.text(path, wholetext=True).select(F.input_file_name().alias("file"), F.col("value").alias("v"))
    body = F.regexp_extract("v", rf"(?s)\b{name}\b[^=\n]*= \[\r?\n(.*?)\n\];", 1)
    lines = text.select("file", F.posexplode(F.filter(F.transform(F.split(body, r"\r?\n"), lambda x: F.trim(x)), lambda x: x.startswith("["))).alias("line", "raw"))

    def as_json(part: Column) -> Column:
        inner = F.replace(F.regexp_replace(part, r"^'|'$", ""), F.lit('"'), F.lit('\\"'))
        quoted = F.concat(F.lit('"'), F.replace(inner, F.lit("\\'"), F.lit("'")), F.lit('"'))
        bare = F.regexp_replace(F.regexp_replace(part, r"([{,] ?)(\w+):", '$1"$2":'), r"\bundefined\b", "null")
        return F.when(part.startswith("'"), quoted).otherwise(bare)

    parts = F.transform(F.regexp_extract_all("raw", F.lit(r"'(?:[^'\\]|\\.)*'|[^']+"), F.lit(0)), as_json)
    json = F.regexp_replace(F.array_join(parts, ""), r",\s*$", "")
    return lines.select("file", "line", F.from_json(json, T.ArrayType(T.StringType()), {"mode": "FAILFAST"}).alias("row"))


def module_frame(spark: SparkSession, path: str, name: str) -> DataFrame:
    """``file, x, y`` of the constant ``name = { x: .., y: .. }`` in code modules; null where a file has none."""
    number = r"(-?[\d.]+)"
    pattern = rf"\b{name}\b = \{{ x: {number}, y: {number} \}}"
    text = spark.read.text(path, wholetext=True)
    return text.select(F.input_file_name().alias("file"), *[F.nullif(F.regexp_extract("value", pattern, k), F.lit("")).cast("double").alias(c) for k, c in enumerate("xy", 1)])
