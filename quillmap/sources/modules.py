"""Text of any encoding, level modules as typed tables, level modules as a sorted sink, and patch files.

Everything is read and written by Spark's own readers and writers, so that a folder may be on any file system and each file
is a task of its own.
"""

from __future__ import annotations

from functools import reduce

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quillmap.sources.records import patch_problems

#: A patch file: lines of four numbers and a note, polygons by name, doors of a place, a name and what they snap to, guides of three points.
PATCH = "floor string, lines array<array<string>>, areas map<string,array<array<double>>>, doors array<array<string>>, guides map<string,array<array<double>>>"


def text_files(spark: SparkSession, path: str, charset: str = "UTF-8") -> DataFrame:
    """``file, text`` of whole files; in UTF-8, bytes that are none become replacement characters. Empty files give no row, as Spark reads none."""
    raw = spark.read.format("binaryFile").load(path)
    text = F.make_valid_utf8(F.col("content").cast("string")) if charset.upper().replace("-", "") == "UTF8" else F.decode("content", charset)
    return raw.select(F.col("path").alias("file"), text.alias("text"))


def _file_name(file: Column) -> Column:
    """The name without folder and ending."""
    return F.regexp_extract(file, r"([^/]+?)(?:\.[^./]*)?$", 1)


def typed(row: Column, schema: str) -> list[Column]:
    """The elements of a row of JSON texts as columns of a schema; missing and undefined ones are null, others that don't parse stop the read."""
    out = []
    for k, f in enumerate(T.StructType.fromDDL(schema).fields):
        raw, kind = F.get(row, F.lit(k)), f.dataType
        nested = isinstance(kind, (T.ArrayType, T.MapType, T.StructType))
        out.append((F.from_json(raw, kind, {"mode": "FAILFAST"}) if nested else raw.cast(kind)).alias(f.name))
    return out


def level_rows(rows: DataFrame, schema: str) -> DataFrame:
    """``level, line`` and typed columns of ``records.module_rows`` over all files of a folder; the level is the folder's ``level`` or the file's name."""
    level = F.col("file")
    inside = F.regexp_extract(level, r"/level=([^/]+)/", 1)
    return rows.select(F.when(inside != "", inside).otherwise(_file_name(level)).alias("level"), "line", *typed(F.col("row"), schema))


def numbers(spark: SparkSession, path: str, name: str, *fields: str) -> DataFrame:
    """``file`` and the number of each field of the constant ``name = { field: number, .. }``, in any order; null where there is none."""
    body = F.regexp_extract("text", rf"\b{name}\b[^=\n]*= \{{([^}}]*)\}}", 1)
    return text_files(spark, path).select("file", *[F.nullif(F.regexp_extract(body, rf"(?:^|[\s,]){f}: (-?[\d.]+)", 1), F.lit("")).cast("double").alias(f) for f in fields])


def literal(value: Column, kind: str) -> Column:
    """A value as it stands in a module: text quoted, null ``undefined``, lists in brackets, all else as JSON writes it."""
    if kind == "string":
        escaped = F.replace(F.replace(value, F.lit("\\"), F.lit("\\\\")), F.lit("'"), F.lit("\\'"))
        shown = F.concat(F.lit("'"), escaped, F.lit("'"))
    else:
        shown = F.to_json(F.array(value)).substr(F.lit(2), F.length(F.to_json(F.array(value))) - 2)
    return F.when(value.isNull(), "undefined").otherwise(shown)


def section(rows: DataFrame, level: str, number: int, name: str, columns: list[str], order: list[str]) -> DataFrame:
    """``level, part, head, sort, line``: the lines of the list constant ``name``, opened and closed, for every level of ``rows``."""
    kinds = dict(rows.dtypes)
    shown = F.concat(F.lit("  ["), F.concat_ws(", ", *[literal(F.col(c), kinds[c]) for c in columns]), F.lit("],"))
    key = F.struct(*[F.col(c) for c in order])
    body = rows.where(F.col(level).isNotNull()).select(F.col(level).cast("string").alias("level"), F.lit(number).alias("part"), F.lit(1).alias("head"), key.alias("sort"), shown.alias("line"))
    ends = body.select("level", "part").distinct()
    kind = body.schema["sort"].dataType
    frame = [ends.select("level", "part", F.lit(h).alias("head"), F.lit(None).cast(kind).alias("sort"), F.lit(text).alias("line")) for h, text in ((0, f"export const {name} = ["), (2, "];"))]
    return reduce(DataFrame.unionByName, [body, *frame])


def write_levels(sections: list[DataFrame], path: str) -> None:
    """One text file for each level: its sections in the order given, each sorted; a second write replaces the first.

    Rows are dealt by level and sorted there, so a level's file is one task's, as one file must be.
    """
    # sort keys of sections differ in kind; they become ranks inside their own section first
    rows = [s.repartition("level").sortWithinPartitions("level", "head", "sort").select("level", "part", "head", F.monotonically_increasing_id().alias("at"), "line") for s in sections]
    out = reduce(DataFrame.unionByName, rows).repartition("level").sortWithinPartitions("level", "part", "head", "at")
    out.select("level", "line").write.mode("overwrite").option("maxRecordsPerFile", 0).partitionBy("level").text(path)


def patches(spark: SparkSession, path: str, strict: bool = True) -> DataFrame:
    """The patch files (JSON lines) of a folder; a folder that is not there is an empty table.

    With ``strict`` a patch that ``records.patch_problems`` finds fault with stops the read and is named, as does text that is
    no JSON; without, faulty patches come with their problems.
    """
    kind = T.StructType.fromDDL(PATCH)
    try:
        raw = spark.read.schema(kind).option("mode", "FAILFAST" if strict else "PERMISSIVE").json(path)
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        raw = spark.createDataFrame([], kind)
    problems = patch_problems(F.coalesce("lines", F.array().cast("array<array<string>>")), F.coalesce("doors", F.array().cast("array<array<string>>")), F.col("guides"))
    found = raw.withColumn("problems", problems)
    if not strict:
        return found
    stop = F.raise_error(F.concat(F.coalesce("floor", F.lit("?")), F.lit(": "), F.array_join("problems", "; "))).cast("string")
    return found.withColumn("floor", F.when(F.size("problems") > 0, stop).otherwise(F.col("floor"))).drop("problems")
