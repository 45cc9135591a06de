"""For each registered query that SQL can state: the same result in DuckDB SQL over the same tables."""

from __future__ import annotations

from promptgauge.functions.wording import DATASET_SECTION, EXAMPLES, LANGUAGE_SECTION, REQUEST, RULE_SECTION
from promptgauge.operators.requests import listed
from promptgauge.plans.queries import CHUNKS, DRAWS, EXCLUDED, LETTERS, TOP
from promptgauge.plans.tables import LABELS, TASK_NAMES


def _quoted(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def _template(text: str, **values: str) -> str:
    """A fixed text as an SQL literal with the marks replaced by expressions."""
    out = _quoted(text)
    for name, expression in values.items():
        out = out.replace("{" + name + "}", f"' || {expression} || '")
    return f"({out})"


def _case(column: str, values: dict[str, str]) -> str:
    return f"CASE {column} " + " ".join(f"WHEN {_quoted(k)} THEN {_quoted(v)}" for k, v in values.items()) + " END"


_CATALOGUE = f"""catalogue AS (
  SELECT DISTINCT {_case('p_type', TASK_NAMES)} AS task_type, p_type || ' ' || p_brand AS task, 'Texts about ' || p_brand AS description
  FROM part)"""

_REQUESTS = f"""{_CATALOGUE}, requests AS (
  SELECT md5(task_type || '|task|') AS request_id, 5 AS n, string_agg(task, ',' ORDER BY task) AS task_mteb_names,
         task_type AS task_description, '' AS dataset_description, '' AS language
  FROM catalogue GROUP BY task_type
  UNION ALL
  SELECT md5(task_type || '|' || level || '|' || task), 5, task, task_type, description, lang
  FROM catalogue, (VALUES ('dataset', ''), ('language', 'eng')) AS levels(level, lang))"""


def _rules(task_type: str, language: str, description: str) -> str:
    task = f"trim(lower({task_type}))"
    section = _template(
        RULE_SECTION,
        task=task,
        valid=_case(task, {k: listed(v["valid"]) for k, v in EXAMPLES.items()}),
        invalid=_case(task, {k: listed(v["invalid"]) for k, v in EXAMPLES.items()}),
    )
    spoken = f"CASE WHEN trim({language}) <> '' THEN {_template(LANGUAGE_SECTION, language=language)} ELSE '' END"
    grounded = f"CASE WHEN trim({description}) <> '' THEN {_template(DATASET_SECTION, dataset_description=description)} ELSE '' END"
    return f"({section} || {spoken} || {grounded})"


_REQUEST_TEXT = _template(
    REQUEST,
    n="n",
    add_rules=_rules("task_description", "language", "dataset_description"),
    task_description="task_description",
    language="language",
    dataset_description="dataset_description",
)

_RAW = """raw AS (
  SELECT p_partkey AS request_id, p_type AS task, p_partkey % 8 AS shape,
         CASE WHEN p_partkey % 8 <= 2 THEN '{"prompts":["' || p_name || '","' || p_type || '"]}'
              WHEN p_partkey % 8 = 3 THEN '{"prompts":[]}'
              WHEN p_partkey % 8 = 4 THEN '{"prompts":["' || p_name || '",' || p_size || ']}'
              WHEN p_partkey % 8 = 5 THEN '{"items":["' || p_name || '"]}'
              WHEN p_partkey % 8 = 6 THEN p_name
              ELSE 'analysis assistantfinal {"prompts":["' || p_name || '"]}' END AS raw
  FROM part), cut AS (
  SELECT *, CASE WHEN contains(raw, 'assistantfinal') THEN trim(split_part(raw, 'assistantfinal', 2)) ELSE raw END AS content FROM raw),
parsed AS (
  SELECT *, CASE WHEN json_valid(content) THEN content::JSON END AS doc FROM cut),
checked AS (
  SELECT *, CASE WHEN doc IS NULL THEN 'not_json'
                 WHEN json_type(doc) <> 'OBJECT' THEN 'not_object'
                 WHEN json_extract(doc, '$.prompts') IS NULL THEN 'no_prompts'
                 WHEN json_type(doc, '$.prompts') <> 'ARRAY' THEN 'not_list'
                 WHEN json_array_length(doc, '$.prompts') = 0 THEN 'empty'
                 WHEN len(list_filter(CAST(json_extract(doc, '$.prompts') AS JSON[]), lambda x: json_type(x) <> 'VARCHAR')) > 0 THEN 'not_text'
                 ELSE 'valid' END AS reason
  FROM parsed), answered AS (
  SELECT *, CASE WHEN reason = 'valid' THEN CAST(json_extract(doc, '$.prompts') AS VARCHAR[]) END AS prompts FROM checked)"""

_DISTANCE = "CASE WHEN {a} = {b} THEN 0.0 ELSE levenshtein({a}, {b})::DOUBLE / greatest(length({a}), length({b})) END"


def _near(ppm: int) -> str:
    return f"""texts AS (
  SELECT p_type AS task, p_name AS text, min(p_partkey) AS text_id, count(*) AS weight FROM part GROUP BY 1, 2),
pairs AS (
  SELECT x.task, x.text_id AS a, y.text_id AS b, {_DISTANCE.format(a='x.text', b='y.text')} AS distance
  FROM texts x JOIN texts y ON x.task = y.task AND x.text_id < y.text_id
  WHERE levenshtein(x.text, y.text) * 1000000 < {ppm} * greatest(length(x.text), length(y.text)))"""


_CLUSTERS = f"""{_near(300000)}, links AS (
  SELECT a, b FROM pairs UNION ALL SELECT b, a FROM pairs),
reach(text_id, root) AS (
  SELECT text_id, text_id FROM texts UNION SELECT l.b, r.root FROM reach r JOIN links l ON l.a = r.text_id),
clusters AS (SELECT text_id, min(root) AS cluster FROM reach GROUP BY 1),
members AS (SELECT * FROM texts JOIN clusters USING (text_id)),
means AS (
  SELECT x.cluster, x.text_id, round(sum(y.weight * ({_DISTANCE.format(a='x.text', b='y.text')})) / sum(y.weight), 12) AS mean
  FROM members x JOIN members y ON x.cluster = y.cluster GROUP BY 1, 2),
medoids AS (
  SELECT cluster, text_id AS kept_id FROM means QUALIFY row_number() OVER (PARTITION BY cluster ORDER BY mean, text_id) = 1),
decisions AS (
  SELECT p.p_partkey AS id, m.task, m.cluster, d.kept_id, {_DISTANCE.format(a='m.text', b='k.text')} AS distance
  FROM part p JOIN members m ON m.task = p.p_type AND m.text = p.p_name
  JOIN medoids d ON d.cluster = m.cluster JOIN texts k ON k.text_id = d.kept_id)"""

def _linked(link: str) -> str:
    """Clusters by merging the closest pair of each task while it is under the threshold, one merge a step, lowest ids first among equals."""
    return f"""{_near(300000)}, dist AS (
  SELECT x.task, x.text_id AS a, y.text_id AS b, x.weight * y.weight AS w, {_DISTANCE.format(a='x.text', b='y.text')} AS d
  FROM texts x JOIN texts y ON x.task = y.task AND x.text_id <> y.text_id),
steps AS (
  SELECT 0 AS step, task, text_id, text_id AS cluster FROM texts
  UNION ALL
  SELECT s.step + 1, s.task, s.text_id, CASE WHEN s.cluster = m.high THEN m.low ELSE s.cluster END
  FROM steps s JOIN (
    SELECT x.task, x.cluster AS low, y.cluster AS high, round({link}, 12) AS link
    FROM steps x JOIN steps y ON x.task = y.task AND x.cluster < y.cluster JOIN dist ON dist.a = x.text_id AND dist.b = y.text_id
    GROUP BY 1, 2, 3 QUALIFY row_number() OVER (PARTITION BY x.task ORDER BY link, low, high) = 1 AND link < 0.3) m ON m.task = s.task),
last AS (SELECT task, text_id, cluster FROM steps QUALIFY step = max(step) OVER (PARTITION BY task))
SELECT p_partkey AS id, cluster FROM part JOIN texts ON task = p_type AND text = p_name JOIN last USING (task, text_id)"""


_PROMPTS = (
    "SELECT p_partkey AS id, p_size AS n, p_type AS task, p_brand AS task_description, '' AS dataset_description, "
    "'' AS language, p_name AS generated_prompt FROM part"
)

_TEXTS = """texts AS (
  SELECT *, CASE WHEN task IN ('SMALL', 'LARGE') THEN role END AS prompt_type FROM (
    SELECT doc_id AS text_id, 'document' AS role, text,
           CASE lang WHEN 'en' THEN 'SMALL' WHEN 'fr' THEN 'ECONOMY' WHEN 'de' THEN 'LARGE' ELSE 'MEDIUM' END AS task FROM documents
    UNION ALL SELECT item_id, 'query', text, 'SMALL' FROM benchmark)),
every AS (SELECT DISTINCT p_type AS task, 'Find ' || p_brand AS prompt FROM part),
resolved AS (
  SELECT t.*, f.prompt AS given, CASE WHEN prompt_type = 'document' THEN NULL ELSE f.prompt END AS prompt FROM texts t JOIN every f USING (task))"""

_EXPERIMENTS = """assigned AS (
  SELECT 'org/m' || s_nationkey AS model, s_nationkey AS nation, p_type AS task,
         CASE WHEN p_type IN ('SMALL', 'LARGE') THEN 'Retrieval' ELSE p_type END AS task_class, p_name AS prompt,
         bool_and(l_linestatus = 'F') AS finished
  FROM lineitem JOIN part ON p_partkey = l_partkey JOIN supplier ON s_suppkey = l_suppkey GROUP BY ALL),
keyed AS (
  SELECT *, 'exp_' || substr(sha256(CASE WHEN task_class = 'Retrieval'
    THEN '[{"key":"' || task || '-query","value":"' || prompt || '"},{"key":"query","value":"' || prompt || '"}]'
    ELSE '[{"key":"' || task || '","value":"' || prompt || '"}]' END), 1, 16) AS experiment_id FROM assigned),
experiments AS (
  SELECT model, nation, task, task_class, false AS is_baseline, experiment_id, prompt, finished FROM keyed
  UNION ALL SELECT model, nation, task, task_class, true, NULL, NULL, bool_or(finished) FROM keyed GROUP BY 1, 2, 3, 4)"""

_VECTORS = """v AS (SELECT vec_id, label, embedding::DOUBLE[] AS vector,
  substr(md5(vec_id::VARCHAR), 1, 1) IN ('0', '1', '2') AS is_test FROM embeddings)"""

_HITS = f"""{_VECTORS}, scored AS (
  SELECT q.vec_id AS query_id, d.vec_id AS doc_id, (q.label = d.label)::INT AS relevant,
         round(list_cosine_similarity(q.vector, d.vector), 9) AS similarity
  FROM v q JOIN v d ON q.vec_id <> d.vec_id),
hits AS (
  SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY similarity DESC, doc_id)::INT AS rank FROM scored QUALIFY rank <= {TOP})"""

_PREDICTED = f"""{_VECTORS}, parts AS (
  SELECT label, unnest(vector) AS x, generate_subscripts(vector, 1) AS spot FROM v WHERE NOT is_test),
means AS (SELECT label, spot, avg(x) AS x FROM parts GROUP BY 1, 2),
centroids AS (SELECT label, list(x ORDER BY spot) AS vector FROM means GROUP BY 1),
predictions AS (
  SELECT t.vec_id, t.label::BIGINT AS label, c.label::BIGINT AS predicted FROM v t CROSS JOIN centroids c WHERE t.is_test
  QUALIFY row_number() OVER (PARTITION BY t.vec_id ORDER BY round(list_cosine_similarity(t.vector, c.vector), 9) DESC, c.label) = 1)"""

_RUNS = """runs AS (
  SELECT 'org/m' || (user_id % 6) AS model, event_type AS task, 'exp_' || substr(sha256(event_type || '|' || props), 1, 16) AS experiment_id,
         CASE WHEN event_id % 3 = 0 THEN 256 ELSE 32 END AS batch_size, CASE WHEN user_id % 2 = 0 THEN '2.18.1' ELSE '2.18.0' END AS library
  FROM events)"""

_SCORES = """scores AS (
  SELECT 'm' || (user_id % 6) AS model, event_type AS task, event_id AS experiment_id, value AS score,
         row_number() OVER (PARTITION BY user_id % 6, event_type ORDER BY ts, event_id) = 1 AS is_baseline FROM events),
base AS (SELECT model, task, avg(score) AS baseline FROM scores WHERE is_baseline GROUP BY 1, 2)"""

_REPORTED = f"""{_SCORES}, reported AS (
  SELECT *, rank() OVER (ORDER BY mean_baseline DESC)::INT AS reported_rank
  FROM (SELECT model, round(avg(baseline), 9) AS mean_baseline FROM base GROUP BY 1))"""

_INFLATION = f"""{_SCORES}, inflation AS (
  SELECT model, task, any_value(baseline) AS baseline, avg(score) AS mean, any_value(baseline) - avg(score) AS gap,
         avg((score < baseline)::INT) AS share_below, stddev_samp(score) AS sd
  FROM scores JOIN base USING (model, task) WHERE NOT is_baseline GROUP BY 1, 2)"""


def _letters(text: str) -> str:
    """The toy encoder: length and letter counts. Counts of two joined texts add up."""
    counts = [f"length({text})", *(f"length({text}) - length(replace({text}, '{c}', ''))" for c in LETTERS)]
    return f"[{', '.join(counts)}]::DOUBLE[]"


_FACT = f"""bodies AS (SELECT doc_id AS item_id, lang, coalesce(text, '') AS text FROM documents),
items AS (
  SELECT item_id, 'Search' AS task, 'document' AS role, NULL::DOUBLE AS gold, text FROM bodies WHERE lang = 'en'
  UNION ALL SELECT item_id, 'Search', 'query', NULL, coalesce(text, '') FROM benchmark
  UNION ALL SELECT item_id, 'Source', 'item', NULL, text FROM bodies WHERE lang = 'fr'
  UNION ALL SELECT item_id, 'Group', 'item', NULL, text FROM bodies WHERE lang = 'de'
  UNION ALL SELECT item_id, 'Alike', 'left', length(text), substr(text, 1, length(text) // 2) FROM bodies WHERE lang = 'es'
  UNION ALL SELECT item_id, 'Alike', 'right', length(text), substr(text, length(text) // 2 + 1) FROM bodies WHERE lang = 'es'),
shipped AS (
  SELECT DISTINCT 'org/m' || n_regionkey AS model, n_regionkey % 2 = 0 AS instruct, 'Find ' || p_brand AS prompt
  FROM lineitem JOIN part ON p_partkey = l_partkey JOIN supplier ON s_suppkey = l_suppkey JOIN nation ON n_nationkey = s_nationkey),
plan AS (
  SELECT model, instruct, task, prompt FROM (SELECT * FROM shipped UNION ALL SELECT DISTINCT model, instruct, NULL FROM shipped), (SELECT DISTINCT task FROM items)),
runs AS (
  SELECT *, prompt IS NULL AS is_baseline,
    CASE WHEN prompt IS NOT NULL THEN 'exp_' || substr(sha256(CASE WHEN task = 'Search'
      THEN '[{{"key":"Search-query","value":"' || prompt || '"}},{{"key":"query","value":"' || prompt || '"}}]'
      ELSE '[{{"key":"' || task || '","value":"' || prompt || '"}}]' END), 1, 16) END AS experiment_id FROM plan),
shown AS (
  SELECT model, r.task, experiment_id, is_baseline, role, item_id, item_id % {LABELS} AS label, gold,
    substr(md5(item_id::VARCHAR), 1, 1) IN ('0', '1', '2') AS is_test, text,
    CASE WHEN prompt IS NULL THEN CASE WHEN instruct OR r.task <> 'Search' THEN '' WHEN role = 'query' THEN 'search: ' ELSE 'passage: ' END
         WHEN role = 'document' THEN '' WHEN instruct THEN 'Instruct: ' || prompt || chr(10) || 'Query: ' ELSE prompt END AS prefix
  FROM runs r JOIN items i USING (task)),
counted AS (SELECT task, role, item_id, {_letters('text')} AS own FROM items),
before AS (SELECT prefix, {_letters('prefix')} AS added FROM (SELECT DISTINCT prefix FROM shown)),
e AS (
  SELECT model, task, experiment_id, is_baseline, coalesce(experiment_id, '') AS x, role, item_id, label, gold, is_test,
    list_transform(list_zip(own, added), lambda p: p[1] + p[2]) AS vector
  FROM shown JOIN counted USING (task, role, item_id) JOIN before USING (prefix)),
found AS (
  SELECT q.model, q.x, q.item_id AS query_id, (q.label = d.label)::INT AS relevant,
    row_number() OVER (PARTITION BY q.model, q.x, q.item_id ORDER BY round(list_cosine_similarity(q.vector, d.vector), 9) DESC, d.item_id) AS rank
  FROM e q JOIN e d ON q.model = d.model AND q.x = d.x AND q.role = 'query' AND d.role = 'document' QUALIFY rank <= {TOP}),
sizes AS (SELECT label, count(*) AS n_relevant FROM items, LATERAL (SELECT item_id % {LABELS} AS label) WHERE role = 'document' GROUP BY 1),
ideal AS (SELECT i AS n, (SELECT sum(1 / log2(j + 1)) FROM range(1, i + 1) AS r(j)) AS best FROM range(1, {TOP + 1}) AS s(i)),
ndcg AS (
  SELECT f.model, 'Search' AS task, f.x, count(DISTINCT query_id) AS n_items, sum(relevant / log2(rank + 1) / best) / count(DISTINCT query_id) AS score
  FROM found f JOIN sizes ON sizes.label = query_id % {LABELS} JOIN ideal ON n = least(n_relevant, {TOP}) GROUP BY 1, 2, 3),
means AS (
  SELECT model, x, label, list(m ORDER BY spot) AS centre FROM (
    SELECT model, x, label, spot, avg(v) AS m FROM (SELECT model, x, label, unnest(vector) AS v, generate_subscripts(vector, 1) AS spot FROM e WHERE task = 'Source' AND NOT is_test)
    GROUP BY 1, 2, 3, 4) GROUP BY 1, 2, 3),
guessed AS (
  SELECT e.model, e.x, e.item_id, e.label, m.label AS predicted FROM e JOIN means m ON e.model = m.model AND e.x = m.x WHERE task = 'Source' AND is_test
  QUALIFY row_number() OVER (PARTITION BY e.model, e.x, e.item_id ORDER BY round(list_cosine_similarity(vector, centre), 9) DESC, m.label) = 1),
accuracy AS (SELECT model, 'Source' AS task, x, count(*) AS n_items, avg((label = predicted)::INT) AS score FROM guessed GROUP BY 1, 2, 3),
led AS (SELECT model, x, label, list_position(vector[2:7], list_max(vector[2:7])) AS cluster FROM e WHERE task = 'Group'),
cells AS (SELECT model, x, cluster, label, count(*)::DOUBLE AS n FROM led GROUP BY ALL),
entropies AS (
  SELECT model, x, sum(n) AS n, sum(n * ln(n)) AS joint,
    (SELECT sum(c * ln(c)) FROM (SELECT sum(n) AS c FROM cells i WHERE i.model = o.model AND i.x = o.x GROUP BY cluster)) AS by_cluster,
    (SELECT sum(c * ln(c)) FROM (SELECT sum(n) AS c FROM cells i WHERE i.model = o.model AND i.x = o.x GROUP BY label)) AS by_label
  FROM cells o GROUP BY 1, 2),
agreed AS (
  SELECT model, x, n, CASE WHEN ln(n) - by_label / n > 0 THEN 1 - ((by_cluster - joint) / n) / (ln(n) - by_label / n) ELSE 1 END AS h,
    CASE WHEN ln(n) - by_cluster / n > 0 THEN 1 - ((by_label - joint) / n) / (ln(n) - by_cluster / n) ELSE 1 END AS c FROM entropies),
v_measure AS (SELECT model, 'Group' AS task, x, n::BIGINT AS n_items, CASE WHEN h + c > 0 THEN 2 * h * c / (h + c) ELSE 0 END AS score FROM agreed),
pairs AS (
  SELECT l.model, l.x, l.gold, round(list_cosine_similarity(l.vector, r.vector), 9) AS cosine
  FROM e l JOIN e r ON l.model = r.model AND l.x = r.x AND l.item_id = r.item_id AND l.role = 'left' AND r.role = 'right'),
ranked AS (
  SELECT model, x, rank() OVER (PARTITION BY model, x ORDER BY cosine) + (count(*) OVER (PARTITION BY model, x, cosine) - 1) / 2.0 AS r,
    rank() OVER (PARTITION BY model, x ORDER BY gold) + (count(*) OVER (PARTITION BY model, x, gold) - 1) / 2.0 AS g FROM pairs),
spearman AS (SELECT model, 'Alike' AS task, x, count(*) AS n_items, corr(r, g) AS score FROM ranked GROUP BY 1, 2, 3),
measured AS (
  SELECT *, 'ndcg_at_{TOP}' AS metric FROM ndcg UNION ALL SELECT *, 'accuracy' FROM accuracy UNION ALL SELECT *, 'v_measure' FROM v_measure
  UNION ALL SELECT *, 'spearman' FROM spearman),
fact AS (
  SELECT r.model, 'r1' AS revision, r.task, r.experiment_id, r.is_baseline, metric, n_items, score
  FROM runs r JOIN measured m ON m.model = r.model AND m.task = r.task AND m.x = coalesce(r.experiment_id, ''))"""


def _distribution(source: str) -> str:
    names = {"p5": 0.05, "p25": 0.25, "median": 0.5, "p75": 0.75, "p95": 0.95}
    quantiles = ", ".join(f"quantile_cont(score, {p}) AS {name}" for name, p in names.items())
    return (
        f"SELECT model, task, count(*) AS n, avg(score) AS mean, stddev_samp(score) AS sd, min(score) AS min, max(score) AS max, "
        f"{quantiles}, max(score) - min(score) AS range FROM {source} GROUP BY 1, 2"
    )


def _six(columns: str) -> str:
    return ", ".join(f"round({c}, 6) AS {c}" for c in columns.split())


_SPREAD = _six("mean sd min max p5 p25 median p75 p95 range")


def _favourable(rivals: str) -> str:
    return f"""WITH {_REPORTED}, own AS (
  SELECT model, task, max(score) AS best, min(score) AS worst, avg(score) FILTER (WHERE is_baseline) AS baseline FROM scores GROUP BY 1, 2),
means AS (SELECT model, round(avg(best), 9) AS best, round(avg({rivals}), 9) AS rival FROM own GROUP BY 1),
placed AS (
  SELECT t.model, t.best AS best_mean, (1 + count(r.model))::INT AS favourable_rank
  FROM means t LEFT JOIN means r ON r.model <> t.model AND r.rival > t.best GROUP BY 1, 2)
SELECT model, round(best_mean, 6) AS best_mean, favourable_rank, reported_rank, favourable_rank = 1 AS can_be_first
FROM placed JOIN reported USING (model)"""


_EXCLUDED = ", ".join(_quoted(x) for x in EXCLUDED)
_FIRST = "('0x' || substr(md5(p_name), 1, 1))::INT % 4"

ORACLES: dict[str, str] = {
    "prompt_table_roundtrip_o1_o3": "SELECT p_partkey AS id, p_size AS n, p_type AS task, p_name AS generated_prompt FROM part",
    "prompt_array_o1": "SELECT p_partkey AS id, p_size AS n, p_type AS task, p_name AS generated_prompt FROM part",
    "run_tree_o5": """WITH e AS (SELECT 'org/m' || (user_id % 6) AS model, 'rev' || (event_id % 2) AS revision, event_type AS task, user_id, value FROM events),
results AS (
  SELECT model, revision, 'exp_' || substr(sha256(task || '|' || user_id), 1, 16) AS experiment_id, task, round(avg(value), 6) AS score, count(*) AS n_items
  FROM e GROUP BY model, revision, task, user_id
  UNION ALL SELECT model, revision, NULL, task, round(avg(value), 6), count(*) FROM e GROUP BY model, revision, task)
SELECT model, revision, experiment_id, experiment_id IS NULL AS is_baseline, task, score, n_items FROM results WHERE revision = 'rev1'""",
    "prompt_union_o2": "SELECT p_partkey AS id, p_name AS generated_prompt, source FROM part, (VALUES ('org-one-gen-prompts.json'), "
    "('org-two-gen-prompts.json'), ('org-three-gen-prompts.json')) AS s(source)",
    "dedup_sinks_o4": f"WITH RECURSIVE {_CLUSTERS} SELECT task, CASE WHEN id = kept_id THEN 'kept' ELSE 'removed' END AS part, "
    "count(*) AS n_rows FROM decisions GROUP BY 1, 2",
    "run_paths_o5": "SELECT event_id, 'org/m' || (user_id % 6) AS model, 'rev' || user_id AS revision, "
    "'exp_' || substr(md5(event_id::VARCHAR), 1, 16) AS experiment_id FROM events",
    "nested_prompts_o6": "SELECT p_partkey AS row_id, task, pos::INT AS pos, prompt FROM part, LATERAL (VALUES (p_type), (p_brand)) AS t(task), "
    "LATERAL (VALUES (0, p_name), (1, p_type)) AS l(pos, prompt)",
    "one_task_type_o7": "SELECT p_partkey AS id, p_type AS task, p_name AS generated_prompt FROM part WHERE p_brand = 'Brand#7'",
    "task_types_o8": "SELECT p_type AS task, count(*) AS n_prompts FROM part WHERE p_type IN ('SMALL', 'PROMO') GROUP BY 1",
    "exclusion_status_o9": f"SELECT p_partkey AS id, CASE WHEN p_type IN ({_EXCLUDED}) THEN 'SKIPPED: ' ELSE 'DONE: ' END || p_type AS status FROM part",
    "explode_prompts_o10_o11_o13": f"""WITH {_RAW}, tasked AS (
  SELECT p_partkey AS request_id, p_size AS n, p_name, unnest(CASE WHEN p_size > 25 THEN [p_type, p_brand] ELSE [p_type] END) AS task FROM part)
SELECT request_id, n, t.task, unnest(coalesce(prompts, [NULL])) AS generated_prompt, 'Write prompts for ' || p_name AS sent
FROM tasked t JOIN answered a USING (request_id)""",
    "tasks_o12": "SELECT p_type AS task, count(*) AS n_prompts FROM part GROUP BY 1",
    "requests_o14": f"WITH {_REQUESTS} SELECT * FROM requests",
    "task_rules_o15": f"WITH {_CATALOGUE} SELECT task_type, task, {_rules('task_type', _quoted('eng'), 'description')} AS rules FROM catalogue",
    "request_texts_o16": f"WITH {_REQUESTS} SELECT request_id, md5({_REQUEST_TEXT}) AS text_digest, length({_REQUEST_TEXT})::INT AS text_length FROM requests",
    "generated_o17": f"SELECT p_partkey AS id, 1 AS attempt, CASE WHEN {_FIRST} <= 1 THEN '{{\"prompts\":[\"' || p_name || '\"]}}' ELSE 'no answer' END AS raw FROM part",
    "marker_cut_o18": f"WITH {_RAW} SELECT request_id, content FROM cut",
    "json_kind_o19": f"WITH {_RAW} SELECT request_id, doc IS NOT NULL AS is_json, json_extract_string(doc, '$.prompts[0]') AS first_prompt FROM parsed",
    "validated_o20": f"WITH {_RAW} SELECT request_id, reason, reason = 'valid' AS is_valid, array_to_string(prompts, '|') AS prompts, "
    "len(prompts)::INT AS n_returned FROM answered",
    "validity_counts_o21": f"WITH {_RAW} SELECT task, reason, count(*) AS n_answers FROM checked GROUP BY 1, 2",
    "retried_o22_o23": f"""SELECT p_partkey AS request_id, CASE WHEN {_FIRST} <= 2 THEN ({_FIRST})::INT END AS attempt,
  {_FIRST} <= 2 AS is_valid, CASE WHEN {_FIRST} <= 2 THEN p_name END AS prompts FROM part""",
    "name_distance_o24": f"SELECT p_partkey AS id, round({_DISTANCE.format(a='lower(p_type)', b='p_name')}, 6) AS distance FROM part",
    "near_pairs_o25": f"WITH {_near(400000)} SELECT task, a, b, round(distance, 6) AS distance FROM pairs",
    "near_pair_counts_o26": f"WITH {_near(200000)} SELECT task, count(*) AS n_pairs FROM pairs GROUP BY 1",
    "single_clusters_o27": f"WITH RECURSIVE {_CLUSTERS} SELECT id, cluster FROM decisions",
    "average_clusters_o27": f"WITH RECURSIVE {_linked('sum(w * d) / sum(w)')}",
    "complete_clusters_o27": f"WITH RECURSIVE {_linked('max(d)')}",
    "medoids_o28": f"WITH RECURSIVE {_CLUSTERS} SELECT cluster, kept_id FROM medoids",
    "kept_rows_o29": f"WITH RECURSIVE {_CLUSTERS} SELECT p.* FROM ({_PROMPTS}) p JOIN medoids ON p.id = kept_id",
    "removed_rows_o30": f"WITH RECURSIVE {_CLUSTERS} SELECT task, id AS removed_id, kept_id, round(distance, 6) AS distance, "
    "round(1 - distance, 6) AS similarity FROM decisions WHERE id <> kept_id",
    "dedup_summary_o31": f"WITH RECURSIVE {_CLUSTERS} SELECT task, count(*) AS original, count(*) FILTER (WHERE id = kept_id) AS kept, "
    "count(*) FILTER (WHERE id <> kept_id) AS removed FROM decisions GROUP BY 1",
    "prompt_maps_o32": "SELECT p_partkey AS id, CASE WHEN p_type IN ('SMALL', 'LARGE') THEN p_type || '-query' ELSE p_type END AS key, p_name AS prompt FROM part "
    "UNION ALL SELECT p_partkey, 'query', p_name FROM part WHERE p_type IN ('SMALL', 'LARGE')",
    "resolved_prompts_o33": f"WITH {_TEXTS} SELECT role, task, given AS prompt, prompt AS resolved, count(*) AS n_texts FROM resolved GROUP BY 1, 2, 3, 4",
    "prompted_texts_o34": f"""WITH {_TEXTS}, shown AS (
  SELECT role, task, given, CASE WHEN prompt IS NULL THEN '' WHEN task IN ('SMALL', 'MEDIUM') THEN 'Instruct: ' || prompt || chr(10) || 'Query: '
    ELSE prompt END || text AS shown FROM resolved)
SELECT role, task, given AS prompt, count(*) AS n_texts, sum(length(shown))::BIGINT AS characters,
  sum(('0x' || substr(md5(shown), 1, 8))::BIGINT)::BIGINT AS digest_sum FROM shown GROUP BY 1, 2, 3""",
    "experiment_prompts_o33": f"""WITH {_TEXTS}, {_EXPERIMENTS}, own AS (SELECT DISTINCT task, prompt FROM experiments WHERE NOT is_baseline)
SELECT role, task, own.prompt, CASE WHEN prompt_type = 'document' THEN NULL ELSE own.prompt END AS resolved, count(*) AS n_texts
FROM texts JOIN own USING (task) GROUP BY 1, 2, 3, 4""",
    "experiment_texts_o34": f"""WITH {_TEXTS}, {_EXPERIMENTS}, own AS (
  SELECT DISTINCT task, prompt, CASE WHEN nation % 2 = 0 THEN 'instruct' ELSE 'prefix' END AS wrapper FROM experiments WHERE NOT is_baseline),
shown AS (
  SELECT role, task, own.prompt, wrapper, CASE WHEN prompt_type = 'document' THEN '' WHEN wrapper = 'instruct' THEN 'Instruct: ' || own.prompt || chr(10) || 'Query: '
    ELSE own.prompt END || text AS shown FROM texts JOIN own USING (task))
SELECT role, task, prompt, wrapper, count(*) AS n_texts, sum(length(shown))::BIGINT AS characters,
  sum(('0x' || substr(md5(shown), 1, 8))::BIGINT)::BIGINT AS digest_sum FROM shown GROUP BY 1, 2, 3, 4""",
    "effective_prompts_o35": f"""WITH {_EXPERIMENTS}, wrapped AS (
  SELECT *, CASE WHEN nation % 2 = 0 THEN 'instruct' ELSE 'prefix' END AS wrapper FROM experiments)
SELECT model, task, experiment_id, wrapper, CASE WHEN task_class = 'Retrieval' THEN task || '-query' ELSE task END AS key, prompt FROM wrapped WHERE NOT is_baseline
UNION ALL SELECT model, task, experiment_id, wrapper, 'query', prompt FROM wrapped WHERE NOT is_baseline AND task_class = 'Retrieval'
UNION ALL SELECT model, task, experiment_id, wrapper, NULL, NULL FROM wrapped WHERE is_baseline AND wrapper = 'instruct'
UNION ALL SELECT model, task, experiment_id, wrapper, key, prompt2 FROM wrapped, (VALUES ('query', 'search: '), ('document', 'passage: ')) AS b(key, prompt2)
WHERE is_baseline AND wrapper = 'prefix'""",
    "experiments_o36": f"WITH {_EXPERIMENTS} SELECT model, task, task_class, is_baseline, count(*) AS n_experiments FROM experiments GROUP BY 1, 2, 3, 4",
    "experiment_keys_o37": f"WITH {_EXPERIMENTS} SELECT model, task, is_baseline, experiment_id FROM experiments",
    "remaining_runs_o38": f"WITH {_EXPERIMENTS} SELECT model, revision, task, is_baseline, experiment_id FROM experiments, "
    "(VALUES ('r1'), ('r2')) AS r(revision) WHERE revision = 'r2' OR NOT finished",
    "chunks_o39": f"SELECT p_partkey AS id, p_type AS task, ntile({CHUNKS}) OVER (ORDER BY p_partkey) AS chunk FROM part",
    "chunk_run_o40": f"SELECT p_partkey AS id, ntile({CHUNKS}) OVER (ORDER BY p_partkey) AS chunk, length(p_name)::DOUBLE AS characters, "
    "(length(p_name) - length(replace(p_name, 'e', '')))::DOUBLE AS es FROM part",
    "chunk_summary_o41": f"""WITH work AS (SELECT ntile({CHUNKS}) OVER (ORDER BY p_partkey) AS chunk,
  CASE WHEN p_type IN ({_EXCLUDED}) THEN 'SKIPPED: ' ELSE 'DONE: ' END || p_type AS status FROM part)
SELECT chunk, status, count(*) AS n_rows FROM work GROUP BY 1, 2""",
    "similarity_o42": f"""WITH {_VECTORS}, pairs AS (
  SELECT 'label_' || a.label AS experiment, -abs(a.label - b.label) AS gold, round(list_cosine_similarity(a.vector, b.vector), 9) AS cosine
  FROM v a JOIN v b ON b.vec_id = a.vec_id + 1), ranked AS (
  SELECT experiment,
    rank() OVER (PARTITION BY experiment ORDER BY cosine) + (count(*) OVER (PARTITION BY experiment, cosine) - 1) / 2.0 AS r,
    rank() OVER (PARTITION BY experiment ORDER BY gold) + (count(*) OVER (PARTITION BY experiment, gold) - 1) / 2.0 AS g FROM pairs)
SELECT experiment, count(*) AS n_pairs, round(corr(r, g), 6) AS spearman FROM ranked GROUP BY 1""",
    "nearest_o43": f"WITH {_HITS} SELECT query_id, doc_id, rank, round(similarity, 6) AS similarity, relevant FROM hits",
    "retrieval_o43": f"""WITH {_HITS}, ideal AS (
  SELECT i AS n, (SELECT sum(1 / log2(j + 1)) FROM range(1, i + 1) AS r(j)) AS best FROM range(1, {TOP + 1}) AS s(i)),
sizes AS (SELECT label, count(*) - 1 AS n_relevant FROM v GROUP BY 1),
gained AS (
  SELECT query_id, sum(relevant / log2(rank + 1)) AS dcg, sum(relevant) AS found, min(rank) FILTER (WHERE relevant = 1) AS first FROM hits GROUP BY 1)
SELECT v.vec_id AS query_id, round(CASE WHEN n_relevant > 0 THEN coalesce(dcg, 0) / best ELSE 0 END, 6) AS ndcg,
  round(CASE WHEN n_relevant > 0 THEN coalesce(found, 0) / n_relevant::DOUBLE ELSE 0 END, 6) AS recall, round(coalesce(1.0::DOUBLE / first, 0), 6) AS mrr
FROM v JOIN sizes USING (label) LEFT JOIN gained ON query_id = v.vec_id LEFT JOIN ideal ON n = least(n_relevant, {TOP})""",
    "centroid_predictions_o44": f"WITH {_PREDICTED} SELECT vec_id, label, predicted FROM predictions",
    "centroid_classification_o44": f"""WITH {_PREDICTED}, labels AS (SELECT label AS c FROM predictions UNION SELECT predicted FROM predictions),
f AS (SELECT c, 2.0 * count(*) FILTER (WHERE label = c AND predicted = c) / (count(*) FILTER (WHERE label = c) + count(*) FILTER (WHERE predicted = c)) AS f1
  FROM labels, predictions GROUP BY 1)
SELECT (SELECT count(*) FROM predictions) AS n, (SELECT round(avg((label = predicted)::INT), 6) FROM predictions) AS accuracy,
  (SELECT round(avg(f1), 6) FROM f) AS macro_f1""",
    "clustering_o45": """WITH assigned AS (SELECT label, list_position(embedding[1:10], list_max(embedding[1:10])) AS cluster FROM embeddings),
cells AS (SELECT cluster, label, count(*)::DOUBLE AS n FROM assigned GROUP BY 1, 2),
c AS (SELECT cluster, sum(n) AS n FROM cells GROUP BY 1), l AS (SELECT label, sum(n) AS n FROM cells GROUP BY 1),
h AS (SELECT (SELECT sum(n) FROM cells) AS n, (SELECT -sum(n / t * ln(n / t)) FROM c, (SELECT sum(n) AS t FROM c)) AS hc,
  (SELECT -sum(n / t * ln(n / t)) FROM l, (SELECT sum(n) AS t FROM l)) AS hl,
  (SELECT -sum(n / t * ln(n / t)) FROM cells, (SELECT sum(n) AS t FROM l)) AS hj),
s AS (SELECT n, 1 - (hj - hc) / hl AS homogeneity, 1 - (hj - hl) / hc AS completeness FROM h)
SELECT n::BIGINT AS n, round(homogeneity, 6) AS homogeneity, round(completeness, 6) AS completeness,
  round(2 * homogeneity * completeness / (homogeneity + completeness), 6) AS v_measure FROM s""",
    "experiment_vectors_o33_o34_o40": f"""WITH {_FACT} SELECT model, 'r1' AS revision, task, experiment_id, is_baseline, role, count(*) AS n_vectors,
  sum(vector[1])::BIGINT AS characters, sum(vector[2])::BIGINT AS letters_e, sum(vector[3])::BIGINT AS letters_a FROM e GROUP BY ALL""",
    "score_fact_o42_o45": f"WITH {_FACT} SELECT * REPLACE (round(score, 6) AS score) FROM fact",
    "fact_leaderboard_o51_o52": f"""WITH {_FACT}, own AS (
  SELECT model, task, max(score) AS best, avg(score) FILTER (WHERE is_baseline) AS baseline FROM fact GROUP BY 1, 2),
by_model AS (SELECT model, round(avg(best), 9) AS best, round(avg(baseline), 9) AS rival FROM own GROUP BY 1),
reported AS (SELECT model, rank() OVER (ORDER BY rival DESC)::INT AS reported_rank FROM by_model),
placed AS (
  SELECT t.model, t.best AS best_mean, (1 + count(r.model))::INT AS favourable_rank FROM by_model t LEFT JOIN by_model r ON r.model <> t.model AND r.rival > t.best GROUP BY 1, 2)
SELECT model, round(best_mean, 6) AS best_mean, favourable_rank, reported_rank, favourable_rank = 1 AS can_be_first FROM placed JOIN reported USING (model)""",
    "coverage_o46": f"WITH {_RUNS} SELECT model, task, count(DISTINCT experiment_id) AS n_experiments FROM runs GROUP BY 1, 2",
    "coverage_grid_o46": f"WITH {_RUNS} SELECT model, "
    + ", ".join(f"count(DISTINCT experiment_id) FILTER (WHERE task = '{x}') AS {x}" for x in ["click", "error", "purchase", "signup", "view"])
    + " FROM runs GROUP BY 1",
    "coverage_grown_o46": f"WITH {_RUNS} SELECT model, task, count(DISTINCT experiment_id) AS n_experiments FROM runs GROUP BY 1, 2",
    "coverage_gaps_o46": f"""WITH {_RUNS}, plan AS (
  SELECT model, task, experiment_id FROM runs UNION
  SELECT 'org/m' || ((user_id + 1) % 6), event_type, 'exp_' || substr(sha256(event_type || '|' || props), 1, 16) FROM events)
SELECT model, task, experiment_id FROM plan EXCEPT SELECT model, task, experiment_id FROM runs""",
}

for _name, _key in (("model_drift_o47", "model"), ("experiment_drift_o47", "experiment_id")):
    ORACLES[_name] = f"""WITH {_RUNS} SELECT {_key}, count(*) AS n_runs, count(DISTINCT batch_size) AS n_batch_sizes, count(DISTINCT library) AS n_libraries,
  array_to_string(list_sort(list(DISTINCT batch_size)), ',') AS batch_sizes,
  count(DISTINCT batch_size) > 1 OR count(DISTINCT library) > 1 AS drifts FROM runs GROUP BY 1"""

ORACLES |= {
    "coverage_gap_bits_o46": ORACLES["coverage_gaps_o46"],
    "common_bits_o48": f"""WITH {_RUNS} SELECT experiment_id FROM runs GROUP BY 1
HAVING count(DISTINCT model) = (SELECT count(DISTINCT model) FROM runs)""",
    "left_out_tasks_o51": """WITH s AS (
  SELECT DISTINCT 'm' || (l_suppkey % 6) AS model, l_returnflag || l_linestatus AS task, l_linestatus = 'F' AS of_baselines FROM lineitem),
need AS (SELECT task, of_baselines, model FROM (SELECT DISTINCT task FROM s), (SELECT DISTINCT of_baselines, model FROM s))
SELECT task, of_baselines, string_agg(model, ',' ORDER BY model) AS lacking
FROM (SELECT task, of_baselines, model FROM need EXCEPT SELECT task, of_baselines, model FROM s) GROUP BY 1, 2""",
    "common_experiments_o48": f"""WITH {_RUNS}, held AS (
  SELECT experiment_id FROM runs GROUP BY 1 HAVING count(DISTINCT model) = (SELECT count(DISTINCT model) FROM runs))
SELECT task, experiment_id, count(*) AS n_runs FROM runs WHERE experiment_id IN (SELECT experiment_id FROM held) GROUP BY 1, 2""",
    "score_distribution_o49": f"WITH {_SCORES} SELECT model, task, n, {_SPREAD} FROM ({_distribution('(SELECT * FROM scores WHERE NOT is_baseline)')})",
    "line_score_distribution_o49": f"""WITH scores AS (SELECT 'm' || (l_suppkey % 6) AS model, l_returnflag || l_linestatus AS task,
  round(l_discount + l_tax, 2) AS score FROM lineitem) SELECT model, task, n, {_SPREAD} FROM ({_distribution('scores')})""",
    "inflation_o50": f"""WITH {_INFLATION} SELECT model, task, {_six('baseline mean gap share_below')},
  round(CASE WHEN sd > 0 THEN gap / sd END, 6) AS z,
  CASE WHEN gap > 0 THEN 'inflated' WHEN gap < 0 THEN 'deflated' ELSE 'equal' END AS label FROM inflation""",
    "reported_leaderboard_o51": f"WITH {_REPORTED} SELECT model, round(mean_baseline, 6) AS mean_baseline, reported_rank AS rank FROM reported",
    "favourable_leaderboard_o52": _favourable("baseline"),
    "favourable_against_worst_o52": _favourable("worst"),
    "prompt_hacking_o53": f"WITH {_INFLATION} SELECT model, round(avg((gap > 0)::INT), 6) AS share_inflated, round(avg(gap), 6) AS mean_gap FROM inflation GROUP BY 1",
    "simulated_leaderboards_o54": f"""WITH {_SCORES}, numbered AS (
  SELECT *, row_number() OVER (PARTITION BY model, task ORDER BY substr(sha256(experiment_id::VARCHAR), 1, 2), experiment_id) - 1 AS spot
  FROM scores WHERE NOT is_baseline), totals AS (SELECT model, task, count(*) AS total FROM numbered GROUP BY 1, 2),
drawn AS (
  SELECT model, task, draw, ('0x' || substr(sha256(model || '|' || task || '|' || draw), 1, 15))::BIGINT % total AS spot
  FROM totals, range(0, {DRAWS}) AS d(draw)),
boards AS (SELECT draw, model, round(avg(score), 9) AS mean_score FROM drawn JOIN numbered USING (model, task, spot) GROUP BY 1, 2),
ranked AS (SELECT *, rank() OVER (PARTITION BY draw ORDER BY mean_score DESC) AS rank FROM boards)
SELECT model, round(avg((rank = 1)::INT), 6) AS p_first, round(avg(rank), 6) AS mean_rank FROM ranked GROUP BY 1""",
    "robust_leaderboard_o55": f"""WITH {_REPORTED}, per_model AS (
  SELECT model, round(avg(mean), 9) AS mean, round(avg(p5), 9) AS p5, round(avg(min), 9) AS worst
  FROM ({_distribution('(SELECT * FROM scores WHERE NOT is_baseline)')}) GROUP BY 1),
ranked AS (
  SELECT *, rank() OVER (ORDER BY mean DESC)::INT AS rank_mean, rank() OVER (ORDER BY p5 DESC)::INT AS rank_p5,
    rank() OVER (ORDER BY worst DESC)::INT AS rank_worst FROM per_model)
SELECT model, reported_rank, round(mean, 6) AS mean, round(p5, 6) AS p5, round(worst, 6) AS worst, rank_mean, rank_p5, rank_worst,
  (reported_rank - rank_mean)::INT AS shift_mean, (reported_rank - rank_p5)::INT AS shift_p5, (reported_rank - rank_worst)::INT AS shift_worst
FROM ranked JOIN reported USING (model)""",
}
