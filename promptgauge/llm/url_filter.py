"""URL rules matched by expansion and hash-prefix joins, with DataFrame operations only.

Each url is expanded into its host suffixes times its path prefixes (up to the depth that any rule has).
Expressions and rules meet in an equi-join on the first four bytes of their SHA-256; a match counts only
when the whole digests agree. Of the confirmed rules the longest expression wins, of equally long ones the greatest in
code-point order; a url without one gets the default verdict. The rule table is data: the join strategy is Spark's choice by its size.

Rules: ``action`` (allow or block), ``host``, ``path``; a path must begin and end in ``/``, other rules raise an error.
If two rules state the same host and path, block wins. Null rules are ignored.

Defined results: host is the part after the first ``://`` up to ``/``, ``?``, ``#`` or the end, with A-Z
lower-cased; path goes on from there up to ``?``, ``#`` or the end. A null url or one without ``://`` has an
empty host and path. Rows that repeat an id are judged each on its own; equal (id, url) rows come out as
often as they went in. An empty table gives an empty table.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from promptgauge.llm.columns import ascii_lower
from promptgauge.session import spread

PREFIX_BYTES = 4
ALLOW, BLOCK = "allow", "block"


def host_and_path(url: Column) -> tuple[Column, Column]:
    place = F.instr(url, "://")
    rest = F.when(place > 0, F.substr(url, place + 3, F.length(url)))
    address = F.regexp_extract(F.coalesce(rest, F.lit("")), r"^([^/?#]*)([^?#]*)", 1)
    path = F.regexp_extract(F.coalesce(rest, F.lit("")), r"^([^/?#]*)([^?#]*)", 2)
    return ascii_lower(address), path


def rule_table(rules: DataFrame) -> DataFrame:
    """Checked, deduplicated rules: ``rule, action, digest, prefix``."""
    fits = F.col("path").startswith("/") & F.col("path").endswith("/") & F.col("action").isin(ALLOW, BLOCK)
    checked = rules.filter("host is not null and path is not null and action is not null").select(
        F.when(fits, F.concat(ascii_lower(F.col("host")), F.col("path"))).otherwise(F.raise_error(F.lit("a rule needs a path from / to / and the action allow or block"))).alias("rule"),
        "action",
    )
    one = checked.groupBy("rule").agg(F.max("action").alias("action"))
    return _digested(one, "rule")


def _digested(df: DataFrame, col: str) -> DataFrame:
    return df.withColumn("digest", F.unhex(F.sha2(col, 256))).withColumn("prefix", F.substring("digest", 1, PREFIX_BYTES))


def _depth(rules: DataFrame) -> tuple[int, int]:
    """The most host labels and path segments of any rule: two numbers for the whole rule table."""
    host, path = F.substring_index("rule", "/", 1), F.length("rule") - F.length(F.replace("rule", F.lit("/"), F.lit("")))
    row = rules.agg(F.max(F.size(F.split(host, r"\."))).alias("labels"), F.max(path).alias("segments")).first()
    return row["labels"] or 0, row["segments"] or 0


def expressions(host: Column, path: Column, labels: int, segments: int) -> Column:
    """Host suffixes of at most ``labels`` labels times path prefixes that end in ``/``."""
    parts, pieces = F.split(host, r"\."), F.split(path, "/")
    n_suffixes, n_prefixes = F.least(F.size(parts), F.lit(labels)), F.least(F.size(pieces) - 1, F.lit(segments))
    suffixes = F.transform(F.sequence(F.lit(1), n_suffixes), lambda i: F.array_join(F.slice(parts, -i, i), "."))
    prefixes = F.transform(F.sequence(F.lit(1), n_prefixes), lambda i: F.concat(F.array_join(F.slice(pieces, F.lit(1), i), "/"), F.lit("/")))
    every = F.flatten(F.transform(suffixes, lambda s: F.transform(prefixes, lambda p: F.concat(s, p))))
    return F.when(path.startswith("/") & (n_prefixes > 0) & (n_suffixes > 0), every)


def judged_urls(pages: DataFrame, rules: DataFrame, id_col: str = "page_id", url_col: str = "url", default: str = ALLOW) -> DataFrame:
    """One row per row of ``pages``: ``page_id, host, path, rule, verdict``."""
    table = rule_table(rules)
    labels, segments = _depth(table)
    host, path = host_and_path(F.col("url"))
    urls = pages.select(F.col(id_col).cast("long").alias("page_id"), F.col(url_col).cast("string").alias("url")).select("page_id", host.alias("host"), path.alias("path"))
    # equal (host, path) pairs are judged once, however many pages have them
    distinct = spread(urls.select("host", "path").distinct(), "host", "path")  # few bytes that the expansion multiplies
    expanded = _digested(distinct.select("host", "path", F.explode(expressions(F.col("host"), F.col("path"), labels, segments)).alias("expression")), "expression")
    hits = expanded.join(table.withColumnRenamed("digest", "full"), "prefix").filter(F.col("digest") == F.col("full"))
    best = hits.groupBy("host", "path").agg(F.max_by(F.struct("rule", "action"), F.struct(F.length("rule"), "rule")).alias("best"))
    judged = urls.join(best, ["host", "path"], "left")
    return judged.select("page_id", "host", "path", F.col("best.rule").alias("rule"), F.coalesce("best.action", F.lit(default)).alias("verdict"))
