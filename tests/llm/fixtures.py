"""Small tables for the operators: nulls, empty texts, ties, repeated rows and columns with clashing names."""

from pyspark.sql import DataFrame, SparkSession

EXTRA = "doc_id long, text string, name string, size long, sha string, head string, fp long, n_rows long, `a.b` int"


def documents(spark: SparkSession, rows: list[tuple]) -> DataFrame:
    """``rows`` of (doc_id, text) with further columns whose names the operators use inside."""
    full = [(i, t, "name", 7, None, "head", -1, 0, None) for i, t in rows]
    return spark.createDataFrame(full, EXTRA)


ODD = [
    (1, "Hello World, this is a text."),
    (2, "hello world, THIS is a text."),
    (3, None),
    (4, ""),
    (None, "a row without an id"),
    (None, "a row without an id"),
    (5, "é" * 3000 + " long text " * 3000),
    (6, "é" * 3000 + " long text " * 2999 + " long texT "),
    (7, "é" * 3000 + " long text " * 2999 + " long texx "),
    (8, "repeated row"),
    (8, "repeated row"),
    (9, "repeated row"),
    (2**61 + 1, "a very large id"),
    (2**61 + 2, "a very large id"),
    (-3, " \t\n"),
]
