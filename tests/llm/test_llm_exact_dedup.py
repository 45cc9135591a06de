import hashlib
from collections import defaultdict

import pytest
from fixtures import ODD, documents

from promptgauge.llm import exact_dedup as op
from promptgauge.llm.columns import ASCII_LOWER


def brute(rows):
    groups = defaultdict(list)
    for i, t in rows:
        groups[(t or "").translate(ASCII_LOWER)].append(i)
    out, seen = [], set()
    for i, t in rows:
        body = (t or "").translate(ASCII_LOWER)
        keep = max((x for x in groups[body] if x is not None), default=None)
        first = (i, body) not in seen
        seen.add((i, body))
        out.append((i, keep, len(groups[body]), i == keep and first, hashlib.sha256(body.encode()).hexdigest()))
    return sorted(map(repr, out))


def test_odd_rows(spark):
    found = op.exact_duplicates(documents(spark, ODD))
    assert sorted(repr(tuple(r)) for r in found.collect()) == brute(ODD)


@pytest.mark.parametrize("block", [1, 3, 7])
def test_names_are_free_of_collisions(spark, block):
    texts = ["abc" * n + tail for n in range(6) for tail in ("", "x", "y", "é", "xy")]
    rows = [(i, t) for i, t in enumerate(texts * 2)]
    known = op.identities(documents(spark, rows), block=block, head=2).collect()
    assert len(known) == len(rows)
    names = defaultdict(set)
    for r in known:
        names[r["size"], r["level"], r["name"]].add(dict(rows)[r["doc_id"]])
    assert all(len(v) == 1 for v in names.values()) and len(names) == len(set(texts))


def test_names_follow_the_sorted_order(spark):
    rows = [(i, t) for i, t in enumerate(["bb", "aa", "cc", "ab"])]
    things = documents(spark, rows).select("text")
    named = {r["text"]: r["name"] for r in op._name(things, "names").collect()}
    assert sorted(named, key=named.get) == sorted(named)


def test_kept_rows_keep_their_columns(spark):
    docs = documents(spark, ODD)
    left = op.without_exact_duplicates(docs)
    assert left.columns == docs.columns
    assert sorted(map(repr, (r["doc_id"] for r in left.collect()))) == sorted(map(repr, [2, 4, None, 6, 7, 9, 2**61 + 2, -3]))


def test_empty_table(spark):
    docs = documents(spark, [])
    assert op.exact_duplicates(docs).collect() == [] and op.without_exact_duplicates(docs).collect() == []


def test_one_large_group(spark):
    rows = [(i, "the same text " * 500) for i in range(300)] + [(1000 + i, f"text {i}") for i in range(300)]
    found = op.exact_duplicates(documents(spark, rows)).collect()
    assert sum(r["kept"] for r in found) == 301 and {r["group_size"] for r in found} == {1, 300}


def test_plan_has_no_python(spark):
    plan = op.exact_duplicates(documents(spark, ODD[:4]))._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Pandas" not in plan


def test_the_row_kept_of_a_repeated_id_is_the_same_each_time(spark):
    docs = spark.createDataFrame([(1, t, n) for n in range(9) for t in ("Abc", "ABC")], "doc_id long, text string, size long")
    for parts in (1, 3, 8):
        assert [tuple(r) for r in op.without_exact_duplicates(docs.repartition(parts)).collect()] == [(1, "ABC", 0)]
