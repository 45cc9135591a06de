import random
import re

import pytest
from fixtures import ODD, documents

from promptgauge.llm import pii as op


def brute(text):
    found = []
    patterns = {
        "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
        "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
        "card": "[0-9]([\x20-]?[0-9])+",
        "phone": "\\+[0-9][\x20().0-9-]+[0-9]",
    }
    for kind, pattern in patterns.items():
        for m in re.finditer(pattern, text):
            digits = re.sub("[^0-9]", "", m[0])
            if kind == "ip" and any(int(x) > 255 for x in m[0].split(".")):
                continue
            if kind == "card" and not (12 <= len(digits) <= 19 and sum(sum(divmod(int(d) * (1 + i % 2), 10)) for i, d in enumerate(reversed(digits))) % 10 == 0):
                continue
            if kind == "phone" and not 9 <= len(digits) <= 15:
                continue
            found.append((kind, *m.span()))
    return sorted(found, key=lambda s: (s[1], op.KINDS.index(s[0])))


def test_plain_against_brute_force():
    rng = random.Random(3)
    parts = ["a", "b.", "@", "1", "23", "4.", "-", " ", "+", "(", "é", "x@y.z", "0000 0000 0000 0000", "1.2.3.4", "+1 234 567 890", "256.1.1.1", "00012.1.1.1"]
    for _ in range(20_000):
        text = "".join(rng.choice(parts) for _ in range(rng.randint(0, 14)))
        assert sorted(op.plain_spans(text), key=lambda s: (s[1], op.KINDS.index(s[0]))) == brute(text), text


@pytest.mark.parametrize(
    "text,kind,span",
    [
        ("mail john at example dot com now", "email", "john at example dot com"),
        ("john.doe (at) mail.example [dot] org", "email", "john.doe (at) mail.example [dot] org"),
        ("write j＠ｅｘａｍｐｌｅ．com!", "email", "j＠ｅｘａｍｐｌｅ．com"),
        ("аdmin@exаmple.com", "email", "аdmin@exаmple.com"),
        ("x a\u200b@b.com y", "email", "a\u200b@b.com"),
        ("user[@]host.net", "email", "user[@]host.net"),
        ("call plus four four two zero seven nine four six zero nine five eight ok", "phone", "plus four four two zero seven nine four six zero nine five eight"),
        ("card " + " ".join(["four two"] * 8) + " end", "card", " ".join(["four two"] * 8)),
        ("at 192 [dot] 168 [dot] 0 [dot] 1 now", "ip", "192 [dot] 168 [dot] 0 [dot] 1"),
        ("uno dos tres cuatro cinco seis siete ocho nueve cero uno dos dos cero cuatro", "card", None),
    ],
)
def test_disguises_map_back(text, kind, span):
    found = [(k, text[a:b]) for k, a, b, disguised in op.all_spans(text) if disguised]
    assert found == ([(kind, span)] if span else [])


@pytest.mark.parametrize("text", ["look at the dot on the map", "we met at example.com today", "one two three four", "the price at 1.5 dot", "Привет мир"])
def test_prose_stays_clean(text):
    assert op.all_spans(text) == [] and op.redacted_text(text) == text


def test_long_hostile_text_is_linear():
    text = "1" * 100_000 + "@" * 50_000 + "+1(" * 50_000 + "a" * 100_000 + " one" * 20_000 + "a.@" * 20_000
    assert [s for s in op.all_spans(text) if s[0] == "ip"] == []


def test_odd_rows(spark):
    rows = [*ODD, (20, "a@b.cc 1.2.3.4"), (20, "a@b.cc 1.2.3.4"), (21, "é😀 x@y.zz")]
    found = op.identifiers(documents(spark, rows)).collect()
    assert sorted(map(repr, (r["doc_id"] for r in found))) == sorted(repr(i) for i, _ in rows)
    spans = {r["doc_id"]: [tuple(s) for s in r["spans"]] for r in found}
    assert spans[20] == [("email", 0, 6, False), ("ip", 7, 14, False)] and spans[21] == [("email", 3, 9, False)] and spans[3] == []


def test_redaction(spark):
    rows = [(1, "to a@b.cc or 1.2.3.4"), (2, None), (3, ""), (4, "clean"), (None, "mail j at e dot com"), (4, "clean")]
    docs = documents(spark, rows)
    left = op.redacted(docs, length_col="size")
    assert left.schema == docs.schema
    found = sorted(map(repr, ((r["doc_id"], r["text"], r["size"]) for r in left.collect())))
    assert found == sorted(map(repr, [(1, "to [EMAIL] or [IP]", 18), (2, None, 7), (3, "", 0), (4, "clean", 5), (4, "clean", 5), (None, "mail [EMAIL]", 12)]))


def test_overlapping_kinds_become_one():
    assert op.redacted_text("+1.2.3.4567890 x") in {"[PHONE] x", "[IP]7890 x"}


def test_empty_table(spark):
    assert op.identifiers(documents(spark, [])).collect() == [] and op.redacted(documents(spark, [])).collect() == []
