import pytest
from pyspark.sql import functions as F

from promptgauge.functions.wording import EXAMPLES
from promptgauge.operators.requests import expand_context_levels, request_text, task_rules
from promptgauge.plans.jobs import plan_requests

TASKS = ["retrieval", "classification", "semantic-similarity", "clustering"]


def rules(spark, task, language, about):
    df = spark.createDataFrame([(task, language, about)], "task string, language string, about string")
    return df.select(task_rules(F.col("task"), F.col("language"), F.col("about")).alias("r")).first().r


@pytest.mark.parametrize("task", TASKS)
def test_rule_section(spark, task):
    plain = rules(spark, task, "", "")
    assert plain.startswith("\n## TASK CONSISTENCY RULE (CRITICAL)\n\n") and plain.endswith("DO NOT generate it.\n")
    assert f'- The task is: "{task}"\n' in plain and f'Preserve the original task ("{task}")' in plain
    assert "### VALID PROMPTS (correct behavior)\n\n- \"" + '"\n- "'.join(EXAMPLES[task]["valid"]) + '"\n\n###' in plain
    assert "semantic drift:\n- \"" + '"\n- "'.join(EXAMPLES[task]["invalid"]) + '"\n\n###' in plain
    spoken = '\n### LANGUAGE CONSTRAINT\n\n- All prompts MUST explicitly specify the language: "eng"\n- The language must be clearly mentioned in each prompt (e.g., "in eng")\n'
    grounded = (
        '\n### DATASET GROUNDING\n\n- Prompts should reflect the dataset context when possible\n'
        '- Use only information explicitly present: "Tweets {n}"\n- Do NOT introduce new domains or entities beyond this description\n'
    )
    assert rules(spark, task, "eng", "") == plain + spoken
    assert rules(spark, task, " \t", "Tweets {n}") == plain + grounded
    assert rules(spark, task, "eng", "Tweets {n}") == plain + spoken + grounded


def test_task_is_stripped_and_lowered(spark):
    assert rules(spark, "\t Retrieval\n", "", "") == rules(spark, "retrieval", "", "")


def test_unknown_task_is_an_error(spark):
    with pytest.raises(Exception, match="Unsupported task: Reranking"):
        rules(spark, "Reranking", "", "")


def test_request_text(spark):
    df = spark.createDataFrame([(5, " Clustering", "About {language}", "")], "n int, t string, d string, l string")
    text = df.select(request_text(F.col("n"), F.col("t"), F.col("d"), F.col("l")).alias("x")).first().x
    assert text.startswith("You are generating instruction prefixes for embedding models.\n\n")
    assert "Generate EXACTLY 5 prompts.\n\n---\n\n\n## TASK" in text and "* If not exactly 5, fix the list" in text
    assert '{\n"prompts": [\n"...",\n"...",\n...\n]\n}' in text
    assert text.endswith("Task:  Clustering\nLanguage: \nDataset: About {language}")


def test_context_levels(spark):
    rows = [(t, f"{t}{i}", f"about {t}{i}") for t in TASKS for i in range(3)]
    planned = expand_context_levels(spark.createDataFrame(rows, "task_type string, task string, description string"), 5, "eng")
    got = planned.collect()
    assert len(got) == len({r.request_id for r in got}) == 28
    assert sum(len(r.task_mteb_names) for r in got) * 5 == 12 * 15
    broad = [r for r in got if not r.dataset_description]
    assert len(broad) == 4 and all(len(r.task_mteb_names) == 3 and r.language == "" for r in broad)
    assert sorted(r.language for r in got) == [""] * 16 + ["eng"] * 12
    assert plan_requests(spark.createDataFrame(rows, "task_type string, task string, description string")).count() == 28
