"""Format readers: XML, CSV, JSON lines and fixed width, by asserted format and explicit schema."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: The feed's records; an element with xsi:nil is absent, not empty.
FEED = T.StructType(
    [
        T.StructField("_uid", T.StringType()),
        T.StructField("_category", T.StringType()),
        T.StructField("_e-i", T.StringType()),
        T.StructField(
            "person",
            T.StructType(
                [
                    T.StructField(
                        "names",
                        T.StructType(
                            [
                                T.StructField("first_name", T.StringType()),
                                T.StructField("last_name", T.StringType()),
                                T.StructField("aliases", T.StructType([T.StructField("alias", T.ArrayType(T.StringType()))])),
                            ]
                        ),
                    ),
                    T.StructField("dob", T.StructType([T.StructField("_VALUE", T.StringType()), T.StructField("_nil", T.BooleanType())])),
                ]
            ),
        ),
        T.StructField("details", T.StructType([T.StructField("further_information", T.StringType())])),
        T.StructField("_corrupt_record", T.StringType()),
    ]
)


def read_xml(spark: SparkSession, path: str, schema: T.StructType = FEED, row_tag: str = "record") -> DataFrame:
    """Records of any length; attributes by local name; malformed ones keep their text in _corrupt_record."""
    options = {"rowTag": row_tag, "ignoreNamespace": "true", "mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_corrupt_record"}
    return spark.read.format("xml").options(**options).schema(schema).load(path)


def read_csv(spark: SparkSession, path: str, schema: T.StructType, separator: str = ",") -> DataFrame:
    return spark.read.csv(path, schema=schema, header=True, sep=separator, mode="PERMISSIVE", columnNameOfCorruptRecord="_corrupt_record")


def read_json(spark: SparkSession, path: str, schema: T.StructType, array: bool = False) -> DataFrame:
    return spark.read.json(path, schema=schema, multiLine=array, mode="PERMISSIVE", columnNameOfCorruptRecord="_corrupt_record")


def read_fixed_width(spark: SparkSession, path: str, columns: list[tuple[str, int, int]]) -> DataFrame:
    """Columns (name, first character from 1, length), without surrounding blanks; blank is null."""
    cut = lambda at, n: F.nullif(F.trim(F.substring("value", at, n)), F.lit(""))
    return spark.read.text(path).select(*[cut(at, n).alias(name) for name, at, n in columns])


READERS = {"xml": read_xml, "csv": read_csv, "json": read_json, "fixed_width": read_fixed_width}


def resolve(format_id: str):
    """The reader of an asserted format; an unknown format is an error at configuration time."""
    if format_id not in READERS:
        raise KeyError(f"no reader for format {format_id!r}; known: {', '.join(READERS)}")
    return READERS[format_id]


def narratives(feed: DataFrame) -> DataFrame:
    """uid, category and the trimmed narrative of feed records that have one."""
    text = F.regexp_replace("details.further_information", r"^[\x00-\x20]+|[\x00-\x20]+$", "")
    rows = feed.select(F.col("_uid").alias("uid"), F.col("_category").alias("category"), text.alias("narrative"))
    return rows.filter("narrative <> ''")


def checksums(spark: SparkSession, path: str) -> DataFrame:
    """(path, length, sha256) of the files of a delivery."""
    files = spark.read.format("binaryFile").load(path)
    return files.select("path", "length", F.sha2("content", 256).alias("sha256"))
