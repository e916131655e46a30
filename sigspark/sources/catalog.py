"""Recording catalogue from file names, and relabelling."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sigspark.functions.text import name_parts
from sigspark.schema import values_table


def catalog_of(names: DataFrame, column: str = "file_name") -> DataFrame:
    """Catalogue columns beside each file name; names of another form are left out."""
    parts = F.col("_parts")
    return (
        names.withColumn("_parts", name_parts(F.col(column))).where(F.size("_parts") >= 3)
        .withColumns({
            "recording_id": F.regexp_replace(column, r"\.csv$", ""),
            "ts": parts[0],
            "label": parts[1].try_cast("int"),
            "activity": parts[2],
            "sample_no": F.try_element_at(parts, F.lit(4)).try_cast("int"),
        })
        .drop("_parts")
    )


def recording_catalog(spark: SparkSession, path: str, split_from: str | None = None) -> DataFrame:
    """Catalogue of the ``.csv`` files under a folder; the files themselves are not read.

    ``split_from`` is a pattern whose first group finds the split in the file path.
    """
    files = (
        spark.read.format("binaryFile").option("pathGlobFilter", "*.csv")
        .option("recursiveFileLookup", True).load(path).select("path")
    )
    split = F.regexp_extract("path", split_from, 1) if split_from else F.lit(None).cast("string")
    named = files.select(F.element_at(F.split("path", "/"), -1).alias("file_name"), split.alias("split"))
    return catalog_of(named)


def relabel_rules(spark: SparkSession) -> DataFrame:
    """The one rule in use."""
    return values_table(spark, "activity, new_label", [("Resting-Normal", 0)])


def relabel(recordings: DataFrame, rules: DataFrame) -> DataFrame:
    """Add ``new_label``, and the file's old and new name for the rows the rules cover."""
    joined = recordings.join(rules, "activity", "left")
    tail = F.when(F.col("sample_no").isNull(), "").otherwise(F.format_string("_%04d", "sample_no"))

    def file_name(label: str):
        return F.concat(
            F.col("ts"), F.lit("_"), F.col(label).cast("string"), F.lit("_"), F.col("activity"), tail, F.lit(".csv")
        )

    return (
        joined.withColumn("old_name", file_name("label"))
        .withColumn("new_label", F.coalesce("new_label", "label"))
        .withColumn("new_name", file_name("new_label"))
    )
