import random
import re
from itertools import combinations
from math import comb

import pytest
import xxhash
from fixtures import ODD, documents

from promptgauge.llm import simhash as op
from promptgauge.llm.columns import ASCII_LOWER


def plain_fingerprint(text):
    words = re.findall("[^\x20\x09-\x0d]+", (text or "").translate(ASCII_LOWER))
    if not words:
        return 0
    grams = [" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))]
    hashes = [xxhash.xxh64_intdigest(g.encode(), 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def components(prints):
    parent = {f: f for f in prints}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in combinations(parent, 2):
        if (a ^ b).bit_count() <= 2:
            parent[max(root(a), root(b))] = min(root(a), root(b))
    return {f: root(f) for f in parent}


def test_fingerprints_and_groups(spark):
    found = op.simhash_groups(documents(spark, ODD)).collect()
    prints = [(i, plain_fingerprint(t)) for i, t in ODD]
    group = components({f for _, f in prints})
    least = {}
    for i, f in prints:
        if i is not None:
            least[group[f]] = min(i, least.get(group[f], i))
    expected = sorted(repr((i, f"{f:016x}", least.get(group[f]))) for i, f in prints)
    assert sorted(repr(tuple(r)) for r in found) == expected


def test_links_against_all_pairs(spark):
    rng = random.Random(4)
    prints = {0, (1 << 64) - 1}
    for _ in range(40):
        f = rng.getrandbits(64)
        for _ in range(rng.choice([1, 2, 150])):  # chains of near fingerprints, some in long lists
            prints.add(f)
            f ^= 1 << rng.randrange(64 if rng.random() < 0.2 else 16)
            f ^= 1 << rng.randrange(16) if rng.random() < 0.5 else 0
    signed = [(f - (1 << 64) if f >> 63 else f,) for f in prints]
    nodes = spark.createDataFrame([(i, f) for i, (f,) in enumerate(signed)], "node long, fp long")
    edges = op.links(nodes, 2).collect()
    order = [f % (1 << 64) for (f,) in signed]
    parent = list(range(len(order)))

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in edges:
        parent[root(a)] = root(b)
    group = components(prints)
    pairs = {(i, j) for i, j in combinations(range(len(order)), 2) if group[order[i]] == group[order[j]]}
    assert pairs == {(i, j) for i, j in combinations(range(len(order)), 2) if root(i) == root(j)}
    assert len(edges) < 28 * len(order)


@pytest.mark.parametrize("together,most", [(1, 64), (2, 64), (3, 64), (4, 8), (2, 3), (6, 2)])
def test_tally_against_all_pairs(spark, monkeypatch, together, most):
    """Every pair's tally is the number of choices out of the bytes it shares; no pair at the minimum is missing."""
    monkeypatch.setattr(op, "LIST", most)
    rng = random.Random(together)
    prints = {0, (1 << 64) - 1}
    for _ in range(60):
        f = rng.getrandbits(64)
        for _ in range(rng.choice([1, 3, 12])):
            prints.add(f)
            f ^= 1 << rng.randrange(64)
    ordered = sorted(prints)
    nodes = spark.createDataFrame([(i, f - (1 << 64) if f >> 63 else f) for i, f in enumerate(ordered)], "node long, fp long")
    found = {(r.a, r.b): (r.bits, r.shared) for r in op.tallied(nodes, 2, together).collect()}
    dense = {a for (a, b), (bits, _) in found.items() if bits < 0}
    for i, j in combinations(range(len(ordered)), 2):
        shared = sum((ordered[i] ^ ordered[j]) >> 8 * k & 255 == 0 for k in range(8))
        if i in dense and j in dense:
            continue
        assert found.get((i, j), (None, 0))[1] == comb(shared, together)
        if comb(shared, together):
            assert found[i, j][0] == (ordered[i] ^ ordered[j]).bit_count()
    group = components(prints)
    edges = components_of(op.links(nodes, 2).collect(), len(ordered))
    assert all((edges[i] == edges[j]) == (group[ordered[i]] == group[ordered[j]]) for i, j in combinations(range(len(ordered)), 2))


def components_of(edges, n):
    label = list(range(n))
    changed = True
    while changed:
        changed = False
        for a, b in edges:
            low = min(label[a], label[b])
            changed |= label[a] != low or label[b] != low
            label[a] = label[b] = low
    return label


def test_positions_grow_with_the_table():
    assert [op.positions_together(n) for n in (10, 2000, 100_000, 10**7, 10**9, 10**12)] == [1, 2, 3, 4, 5, 6]


def test_one_stays(spark):
    docs = documents(spark, ODD)
    left = op.without_near_duplicates(docs)
    assert left.columns == docs.columns
    groups = {r["component_id"] for r in op.simhash_groups(docs).collect()}
    assert sorted(map(repr, (r["doc_id"] for r in left.collect()))) == sorted(map(repr, groups))


def test_rows_with_no_id_or_a_shared_id_stay_apart(spark):
    texts = ["the first text is about rivers", "a second one tells of old bridges", "nothing of that sort stands in the third", "the fourth lists every tool in the shed"]
    near = texts[0].upper()
    assert len(components({plain_fingerprint(t) for t in texts})) == len({*components({plain_fingerprint(t) for t in texts}).values()}) == 4

    def left(rows):
        return sorted(map(repr, (tuple(r)[:2] for r in op.without_near_duplicates(documents(spark, rows)).collect())))

    # no id at all: one row of each group stays; a row with an id goes before one without
    found = left([(None, t) for t in texts] * 2 + [(None, near), (7, texts[3])])
    assert len(found) == 4 and repr((7, texts[3])) in found and {repr((None, t)) for t in texts[1:3]} < set(found)
    # one id for all texts
    assert left([(5, t) for t in texts] * 2) == sorted(repr((5, t)) for t in texts)
    # a shared id is the lowest in one group only: the other text with it is a near copy and goes
    assert left([(5, texts[1]), (5, texts[0]), (2, near)]) == sorted(map(repr, [(5, texts[1]), (2, near)]))


def test_the_row_kept_is_the_same_each_time(spark):
    docs = spark.createDataFrame([(None, "one text", i % 7) for i in range(40)], "doc_id long, text string, size long")
    for parts in (1, 3, 8):
        assert [tuple(r) for r in op.without_near_duplicates(docs.repartition(parts)).collect()] == [(None, "one text", 0)]


def test_empty_table(spark):
    docs = documents(spark, [])
    assert op.simhash_groups(docs).collect() == [] and op.without_near_duplicates(docs).collect() == []
