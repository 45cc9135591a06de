
from promptgauge.operators import answers, reshape
from promptgauge.plans.jobs import collect_answers

CASES = {
    '{"prompts":["a","b"]}': ("valid", ["a", "b"]),
    "{'prompts': ['a']}": ("valid", ["a"]),
    '{prompts: ["a"]}': ("valid", ["a"]),
    '{"prompts":["a", "b",]}': ("valid", ["a", "b"]),
    '{"prompts":["a"] /* note */}': ("valid", ["a"]),
    'thoughts assistantfinal  {"prompts":["a"]} ': ("valid", ["a"]),
    'x assistantfinal {"prompts":["a"]} assistantfinal {"prompts":[]}': ("valid", ["a"]),
    '{"prompts":[]}': ("empty", None),
    '{"prompts":["a",1]}': ("not_text", None),
    '{"prompts":[1,2]}': ("not_text", None),
    '{"prompts":["a",null]}': ("not_text", None),
    '{"prompts":["a",["b"]]}': ("not_text", None),
    '{"prompts":[null]}': ("not_text", None),
    '{"prompts":[true]}': ("not_text", None),
    '{"prompts":"a"}': ("not_list", None),
    '{"prompts":{}}': ("not_list", None),
    '{"prompts":3}': ("not_list", None),
    '{"prompts":null}': ("not_list", None),
    '{"items":["a"]}': ("no_prompts", None),
    '["a"]': ("not_object", None),
    "no json": ("not_json", None),
    "": ("not_json", None),
    None: ("not_json", None),
}


def test_rule_table(spark):
    df = spark.createDataFrame([(i, raw) for i, raw in enumerate(CASES)], "request_id int, raw string")
    got = {r.raw: (r.reason, r.prompts) for r in answers.validated(df).collect()}
    assert got == CASES
    checked = answers.validated(df)
    valid, invalid = answers.split_valid(checked)
    assert valid.count() == 7 and invalid.count() == len(CASES) - 7
    assert all(r.n_returned == len(r.prompts) for r in valid.collect())


def test_generate_survives_failures(spark):
    def fn(texts, attempt):
        if any(t == "bad" for t in texts):
            raise RuntimeError("call failed")
        return [f"{t}:{attempt}" for t in texts]

    df = spark.createDataFrame([(1, "x"), (2, "bad"), (3, "y")], "request_id int, input_prompt string").coalesce(1)
    got = {r.request_id: r.raw for r in answers.generate(df, fn, 4).collect()}
    assert got == {1: "x:4", 2: "", 3: "y:4"}


def test_retry_asks_only_what_is_invalid(spark, tmp_path):
    log = tmp_path / "asked"
    log.mkdir()

    def fn(texts, attempt):
        for t in texts:
            (log / f"{t}-{attempt}").touch()
        return ['{"prompts":["%s"]}' % t if int(t) <= attempt else "?" for t in texts]

    df = spark.createDataFrame([(i, str(i)) for i in range(6)], "request_id int, input_prompt string")
    accepted = answers.retried(df, fn, attempts=3)
    full = {r.request_id: (r.attempt, r.is_valid, r.prompts) for r in answers.restored(df, accepted).collect()}
    assert full == {i: (i, True, [str(i)]) if i <= 3 else (None, False, None) for i in range(6)}
    assert {p.name for p in log.iterdir()} == {f"{t}-{a}" for t in range(6) for a in range(4) if a <= t}


def test_collect_answers(spark):
    planned = spark.createDataFrame(
        [("r1", 2, ["t1", "t2"], "kind", "", "", "ask one"), ("r2", 2, ["t3"], "kind", "d", "eng", "ask two")],
        "request_id string, n int, task_mteb_names array<string>, task_description string, dataset_description string, language string, input_prompt string",
    )

    def fn(texts, attempt):
        return ['{"prompts":["p","q"]}' if t == "ask one" else "?" for t in texts]

    rows = collect_answers(planned, fn, 1)
    assert sorted((r.task, r.generated_prompt, r.generation_meta.prompt) for r in rows.collect()) == [
        (t, p, "ask one") for t in ("t1", "t2") for p in ("p", "q")
    ]
    kept = collect_answers(planned, fn, 0, drop_unanswered=False)
    assert [(r.task, r.generated_prompt) for r in kept.collect() if r.task == "t3"] == [("t3", None)]
    assert "input_prompt" not in kept.columns


def test_empty_list_stays_as_a_row(spark):
    df = spark.createDataFrame([(["t"], [])], "task_mteb_names array<string>, generated_prompts array<string>")
    assert [(r.task, r.generated_prompt) for r in reshape.explode_prompts(df).collect()] == [("t", None)]


def test_nested_prompts(spark):
    df = spark.createDataFrame(
        [(1, ["a", "b"], (["x", "y"],)), (2, ["b"], (["z"],))],
        "row_id int, task_mteb_names array<string>, generated_prompts struct<prompts:array<string>>",
    )
    got = reshape.nested_prompts(df, "row_id", "b").orderBy("row_id", "pos").collect()
    assert [r.prompt for r in got] == ["x", "y", "z"]
    assert reshape.nested_prompts(df, "row_id").count() == 5
