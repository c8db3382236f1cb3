"""Text forms of graphs, vectors and codes."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.vector import vec_from_text, vec_to_text


def read_adjacency(spark: SparkSession, path: str) -> DataFrame:
    """CSV with header ``id,neighbor``; neighbor is a list literal ``[1, 2]`` or ``{1,2}``."""
    raw = spark.read.csv(path, header=True, schema="id long, neighbor string", escape='"')
    ids = F.from_json(F.translate("neighbor", "{}", "[]"), "array<bigint>")
    return raw.select("id", ids.alias("nbs"))


def write_adjacency(graph: DataFrame, path: str) -> None:
    """The same CSV, one file per partition."""
    graph.select("id", F.to_json("nbs").alias("neighbor")).write.csv(path, header=True, escape='"')


def read_edges(spark: SparkSession, path: str, header: bool = True) -> DataFrame:
    """One ``id,neighbor`` line per directed edge."""
    return spark.read.csv(path, header=header, schema="id long, neighbor long")


def read_vectors(
    spark: SparkSession, path: str, element: str = "float", sep: str = ",", header: bool = True
) -> DataFrame:
    """``id<sep>vector`` lines, the vector a quoted list literal; ``element='int'`` for codes."""
    raw = spark.read.csv(path, header=header, sep=sep, schema="id long, data string", escape='"')
    parsed = F.from_json(F.translate("data", "{}", "[]"), f"array<{element}>")
    return raw.select("id", parsed.alias("data"))


def write_vectors(df: DataFrame, path: str, sep: str = ",") -> None:
    """Vectors or codes as ``id<sep>vector`` lines."""
    df.select("id", vec_to_text("data").alias("data")).write.csv(path, header=True, sep=sep, escape='"')


def read_dotted(spark: SparkSession, path: str) -> DataFrame:
    """``id.vector.a1`` lines after one header line. The dot separates fields, so the vectors
    must be integer valued; a line with more fields fails the read instead of losing digits."""
    raw = spark.read.csv(
        path, header=True, sep=".", schema="id long, data string, a1 int", escape='"',
        mode="FAILFAST",
    )
    return raw.select("id", vec_from_text("data").alias("data"), "a1")


def write_dotted(df: DataFrame, path: str) -> None:
    df.select("id", vec_to_text("data").alias("data"), "a1").write.csv(
        path, header=True, sep=".", escape='"')
