import random
import re
import zlib
from collections import Counter

import pytest
from fixtures import ODD, documents

from promptgauge.llm import spelling as op

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def one_edit(a, b):
    a, b = sorted((a, b), key=len)
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    return len(b) == len(a) + 1 and any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def counted(rows, shortest, least, one_in):
    found = Counter()
    for doc_id, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = run.translate(LOWER)
            h = zlib.crc32(f"{'' if doc_id is None else doc_id}:{run}".encode())
            if h % one_in == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            found[run] += 1
    return {w: n for w, n in found.items() if len(w) >= shortest and n >= least}


def expected(rows, shortest=5, least=3, ratio=2, one_in=97):
    """Plain form: every word against all words one deletion away."""
    n = counted(rows, shortest, least, one_in)
    by_gap = {}
    for w in n:
        for i in range(len(w)):
            by_gap.setdefault((w[:i], w[i + 1 :]), set()).add(w)  # replaced
            by_gap.setdefault(w[:i] + w[i + 1 :], set()).add(w)  # deleted
    near = {w: set() for w in n}
    for gap, words in by_gap.items():
        if isinstance(gap, tuple):
            for w in words:
                near[w] |= words - {w}
        elif gap in n:
            near[gap] |= words
            for w in words:
                near[w].add(gap)
    form = {}
    for w in n:
        best = min(near[w], key=lambda v: (-n[v], v), default=None)
        form[w] = best if best is not None and n[best] >= ratio * n[w] else None
    out = []
    for w in n:
        root = w
        while form[root] is not None:
            root = form[root]
        out.append((w, form[w], root, n[w], len(near[w]), n[form[w]] if form[w] else None))
    return sorted(out)


def rows_of(df):
    return sorted(tuple(r) for r in df.select("word", "form", "root", "n", "n_near", "form_n").collect())


@pytest.mark.parametrize("letters", ["ab", "abc", "abcdefgh", "aé÷z"])
def test_composition_against_all_pairs(letters):
    rng = random.Random(letters)
    for _ in range(60):
        words = sorted({"".join(rng.choice(letters) for _ in range(rng.randint(5, 9))) for _ in range(rng.randint(0, 60))})
        found = [tuple(sorted(p)) for side in ("prefix", "suffix") for p in op._pairs(side, words)]
        assert len(found) == len(set(found))
        assert set(found) == {(a, b) for i, a in enumerate(words) for b in words[i + 1 :] if one_edit(a, b)}


def test_acceptor_is_minimal_and_accepts_its_words():
    words = ["taps", "tops", "tap", "top", "stops", "staps"]
    found = op.Acceptor(words)

    def behind(s):
        return ([""] if found.ends[s] else []) + [x + r for x, t in found.arcs[s].items() for r in behind(t)]

    assert sorted(behind(found.start)) == sorted(words)
    reached, open_ = set(), [found.start]
    while open_:
        s = open_.pop()
        if s not in reached:
            reached.add(s)
            open_ += found.arcs[s].values()
    languages = [frozenset(behind(s)) for s in reached]
    assert len(languages) == len(set(languages)) == 9


def vocabulary(rng, size):
    stems = ["".join(rng.choice("abcdeé") for _ in range(rng.randint(5, 8))) for _ in range(size // 6)]
    words = {}
    for s in stems:
        words[s] = rng.randint(3, 400)
        for _ in range(5):
            i = rng.randrange(len(s))
            v = rng.choice([s[:i] + s[i + 1 :], s[:i] + "x" + s[i:], s[:i] + "y" + s[i + 1 :]])
            if len(v) >= 5:
                words.setdefault(v, rng.randint(3, 40))
    return words


@pytest.mark.parametrize("together,most", [(20_000, 60_000), (50, 40), (7, 4)])
def test_partitions_and_crowded_start_states_lose_no_pair(spark, together, most):
    words = vocabulary(random.Random(3), 300)
    words |= {"abcde" + x + y: 5 for x in "abcdefgh" for y in "abcdefgh"}  # one start state holds many
    table = spark.createDataFrame(list(words.items()), "word string, n long")
    found = [tuple(r) for r in op.near_words(table, together, most).collect()]
    ordered = sorted(words)
    expected = {(a, words[a], b, words[b]) for a in ordered for b in ordered if a != b and one_edit(a, b)}
    assert len(found) == len(set(found)) and set(found) == expected


def test_odd_rows(spark):
    rows = [*ODD, (20, "Nothing NOTHING nothing nothin nothin nothin Études études"), (None, "nothing nothing repeat repeat repeats repeats")]
    got = op.spelling_forms(documents(spark, rows), least=1)
    assert rows_of(got) == expected(rows, least=1)
    few = op.spelling_forms(documents(spark, rows), least=2, one_in=3)  # many runs lose a symbol
    assert rows_of(few) == expected(rows, least=2, one_in=3)


def test_ties_and_chains(spark):
    words = {"aaaab": 3, "aaaac": 7, "aaaad": 7, "aaaax": 14, "aaaaxy": 28, "aaaaxyz": 57, "zzzzz": 3}
    rows = [(i, (w + " ") * n) for i, (w, n) in enumerate(words.items())]
    got = {r["word"]: r for r in op.spelling_forms(documents(spark, rows), one_in=1 << 40).collect()}
    assert got["aaaab"]["form"] == "aaaax" and got["aaaab"]["root"] == "aaaaxyz" and got["aaaab"]["form_n"] == 14
    assert got["aaaac"]["form"] == "aaaax" and got["aaaax"]["form"] == "aaaaxy" and got["aaaaxy"]["root"] == "aaaaxyz"
    assert got["aaaaxyz"]["form"] is None and got["aaaaxyz"]["root"] == "aaaaxyz"
    assert got["zzzzz"]["n_near"] == 0 and got["zzzzz"]["form_n"] is None
    tied = [(1, "aaaab " * 3 + "aaaac " * 7 + "aaaad " * 7)]
    assert {r["word"]: r["form"] for r in op.spelling_forms(documents(spark, tied), one_in=1 << 40).collect()}["aaaab"] == "aaaac"


def test_empty_table(spark):
    assert op.spelling_forms(documents(spark, [])).collect() == []
    assert op.spelling_forms(documents(spark, [(1, None), (2, "")])).collect() == []


def test_whole_table(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    assert rows_of(op.spelling_forms(docs)) == expected([(r["doc_id"], r["text"]) for r in docs.collect()])
