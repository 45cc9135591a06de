"""Exact deduplication by deterministic block naming, with DataFrame operations only.

A text (A-Z lower-cased, UTF-8) is cut into blocks of a fixed number of bytes. The distinct blocks are
sorted and get integer names in that order. Then adjacent names are paired, the distinct pairs are sorted
and named in turn, and so on until one name is left for each text. Texts of one length pass through the
same number of rounds, so ``(size, level, name)`` identifies a text without any chance of a collision.

Round 0 names ``(size, first bytes)``. A text alone with that name is identified already and needs no
further round; all others are named over their whole length. The first shuffle carries a few bytes of each
text, the second each text once, the later ones names only. A group of copies of any size meets only in
aggregates with map-side combining and in equi-joins against unique names, whose hot partitions adaptive
execution splits.

Defined results: null text is the empty text, and empty texts are equal to each other. A null id counts as
smaller than any other. Of rows with the same id and equal texts one is kept, the first by its columns as
JSON. An empty table gives an empty table. Columns other than the two named ones play no part else.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from promptgauge.llm.columns import ascii_lower, same_columns
from promptgauge.session import written

BLOCK = 4096
HEAD = 64
_ROW = ["doc_id", "sha", "n_rows", "size"]
_NAME = ["size", "level", "name"]


def _same_row(a: DataFrame, b: DataFrame) -> Column:
    return a["doc_id"].eqNullSafe(b["doc_id"]) & (a["sha"] == b["sha"])


def _bodies(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    body = ascii_lower(F.col(text_col).cast("string")).cast("binary")
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), body.alias("body")).withColumns(
        {"size": F.octet_length("body").cast("long"), "sha": F.unhex(F.sha2("body", 256))}
    )


def _name(things: DataFrame, label: str, *order: Column) -> DataFrame:
    """The distinct rows in sorted order with increasing integers. Written, so that no retry can renumber them.

    ``order`` is a short first sort key for wide rows: the bounds of the sort's partitions are sampled to the driver.
    """
    rows = things.distinct()
    ranked = rows.repartitionByRange(*order).sortWithinPartitions(*order, *things.columns) if order else rows.orderBy(*things.columns)
    return written(ranked.withColumn("name", F.monotonically_increasing_id()), label)


def identities(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", block: int = BLOCK, head: int = HEAD) -> DataFrame:
    """``doc_id, sha, n_rows, size, level, name`` for each distinct (id, text); texts are equal where the last three are."""
    bodies = _bodies(docs, id_col, text_col)
    first = F.substring("body", 1, head).alias("head")
    rows = written(bodies.select("doc_id", "sha", "size", first).groupBy("doc_id", "sha", "size", "head").agg(F.count("*").alias("n_rows")), "rows")
    heads = written(rows.groupBy("size", "head").agg(F.count("*").alias("n")).orderBy("size", "head").withColumn("name", F.monotonically_increasing_id()), "heads")
    placed = written(rows.join(heads, ["size", "head"]).select(*_ROW, "n", "name"), "placed")
    found = placed.filter("n = 1").select(*_ROW, F.lit(0).alias("level"), "name")

    shared = placed.filter("n > 1").select("doc_id", "sha", "n_rows")
    whole = bodies.join(shared, _same_row(bodies, shared)).select(shared["doc_id"], shared["sha"], "n_rows", "size", "body")
    starts = F.sequence(F.lit(0), F.greatest(F.ceil(F.col("size") / block) - 1, F.lit(0)).cast("int"))
    piece = F.col("body").substr(F.col("at") * block + 1, F.lit(block)).alias("piece")
    blocks = written(whole.select("*", F.explode(starts).alias("at")).select(*_ROW, "at", piece), "blocks")
    named = written(blocks.join(_name(blocks.select("piece"), "names", F.substring("piece", 1, 8), F.xxhash64("piece")), "piece").drop("piece"), "named")
    level, covered = 1, block
    while True:
        done = named.filter(F.col("size") <= covered).select(*_ROW, F.lit(level).alias("level"), "name").distinct()
        found, rest = found.unionByName(done), named.filter(F.col("size") > covered)
        if rest.isEmpty():
            return found
        side = F.col("at") % 2
        pairs = rest.groupBy(*_ROW, F.expr("at div 2").cast("int").alias("at")).agg(
            F.max(F.when(side == 0, F.col("name"))).alias("left"),
            F.coalesce(F.max(F.when(side == 1, F.col("name"))), F.lit(-1).cast("long")).alias("right"),
        )
        pairs = written(pairs, "pairs")
        named = written(pairs.join(_name(pairs.select("left", "right"), "names"), ["left", "right"]).drop("left", "right"), "named")
        level, covered = level + 1, covered * 2


def decisions(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per distinct (id, text): ``doc_id, sha, n_rows, keep_id, group_size``; the largest id of equal texts stays."""
    known = identities(docs, id_col, text_col)
    groups = known.groupBy(*_NAME).agg(F.max("doc_id").alias("keep_id"), F.sum("n_rows").alias("group_size"))
    return known.join(groups, _NAME).select("doc_id", "sha", "n_rows", "keep_id", "group_size")


def exact_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of ``docs``: ``doc_id, keep_id, group_size, kept, text_sha256``."""
    copies = decisions(docs, id_col, text_col).select("*", F.explode(F.sequence(F.lit(1).cast("long"), "n_rows")).alias("copy"))
    kept = F.col("doc_id").eqNullSafe(F.col("keep_id")) & (F.col("copy") == 1)
    return copies.select("doc_id", "keep_id", "group_size", kept.alias("kept"), F.lower(F.hex("sha")).alias("text_sha256"))


def without_exact_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` that stay, all columns unchanged."""
    stay = decisions(docs, id_col, text_col).filter(F.col("doc_id").eqNullSafe(F.col("keep_id")))
    stay = stay.select(F.col("doc_id").alias("__id"), F.col("sha").alias("__sha"), F.col("n_rows").alias("__n"))
    sha = F.unhex(F.sha2(ascii_lower(F.col(text_col).cast("string")).cast("binary"), 256))
    found = docs.join(stay, F.col(id_col).cast("long").eqNullSafe(F.col("__id")) & (sha == F.col("__sha")))
    one = Window.partitionBy("__id", "__sha").orderBy(F.to_json(F.struct(*[F.col(f"`{c}`") for c in docs.columns])))
    repeated = found.filter("__n > 1").withColumn("__at", F.row_number().over(one)).filter("__at = 1")
    return same_columns(found.filter("__n = 1"), docs).unionByName(same_columns(repeated, docs))
