import json
import random

import pytest
from pyspark.sql.datasource import EqualTo, GreaterThan, In

from promptgauge.sources import json_ranges
from promptgauge.sources.json_ranges import json_array_texts, read_json_array
from promptgauge.sources.run_tree import Part, RunTreeReader, read_tree, write_tree

def awkward(rng):
    text = "".join(rng.choice(['"', "\\", "{", "}", "[", "]", ",", " ", "\n", "a", "é", "𝄞", "}}", '\\"']) for _ in range(rng.randint(0, 30)))
    return rng.choice([{"n": rng.randint(0, 9), "text": text, "deep": {"list": [[1, {"x": text}], []]}}, {"text": text}, {}, {"n": None, "text": "}]"}])


@pytest.fixture
def small_ranges(spark, monkeypatch):
    """The array is read in splits of 64 bytes, as it would be of 128 MB; the tables written in between are not."""
    pieces, small = json_ranges._pieces, {"spark.sql.files.maxPartitionBytes": "64", "spark.sql.files.openCostInBytes": "1"}
    old = {k: spark.conf.get(k) for k in small}

    def cut(*args):
        try:
            for k, v in small.items():
                spark.conf.set(k, v)
            return pieces(*args)
        finally:
            for k, v in old.items():
                spark.conf.set(k, v)

    monkeypatch.setattr(json_ranges, "_pieces", cut)
    return cut


@pytest.mark.parametrize("seed,indent,piece", [(1, None, 1 << 18), (2, 2, 1 << 18), (3, None, 10)])
def test_array_cut_into_ranges_equals_the_whole(spark, tmp_path, small_ranges, seed, indent, piece):
    rng = random.Random(seed)
    rows = [awkward(rng) for _ in range(14)]
    (tmp_path / "a.json").write_text(" \n" + json.dumps(rows, indent=indent, ensure_ascii=seed == 2) + "\n ", encoding="utf-8")
    texts = json_array_texts(spark, str(tmp_path), piece).orderBy("number").collect()
    assert [json.loads(r.text) for r in texts] == rows and [r.number for r in texts] == list(range(1, 15))
    fields = "n int, text string"
    whole = spark.read.schema(fields).option("multiLine", True).json(str(tmp_path))
    assert sorted(map(repr, read_json_array(spark, str(tmp_path), fields, piece).collect())) == sorted(map(repr, whole.collect()))


def test_many_tasks_read_one_array(spark, tmp_path, small_ranges):
    (tmp_path / "a.json").write_text(json.dumps([{"n": i} for i in range(150)]))
    assert small_ranges(spark, str(tmp_path), 1 << 18).select("start").distinct().count() > 20


def test_arrays_of_other_values_several_files_and_empty_ones(spark, tmp_path):
    for name, text in {"a": '[1, "x, [y]", null, [2, {"z": 3}] ]', "b": "[]", "c": " [ ] \n", "d": "[{}]", "e": '[{"a": 1}]'}.items():
        (tmp_path / f"{name}.json").write_text(text)
    found = {}
    for r in json_array_texts(spark, str(tmp_path)).orderBy("file", "number").collect():
        found.setdefault(r.file[-6], []).append(json.loads(r.text))
    assert found == {"a": [1, "x, [y]", None, [2, {"z": 3}]], "d": [{}], "e": [{"a": 1}]}


@pytest.mark.parametrize("text", ["[1], 2", "[1] [2]", "1, [2]", "[1] x", "{} [1]", '{"a": [1, 2]}', "[1]]"])
def test_text_around_the_array_is_an_error(spark, tmp_path, text):
    (tmp_path / "a.json").write_text(text)
    with pytest.raises(Exception, match="JSON array"):
        json_array_texts(spark, str(tmp_path)).collect()


ROWS = [
    ("o/m1", "r1", None, True, "A.json", '{"score": 1}'),
    ("o/m1", "r1", "exp_1", False, "A.json", '{"score": 2}'),
    ("o/m1", "r2", "exp_1", False, "A.json", '{"score": 3}'),
    ("o/m2", "r1", "exp_1", False, "B.json", "é\n"),
    ("o/m2", "r1", "exp_2", False, "B.json", None),
]
TREE = "model string, revision string, experiment_id string, is_baseline boolean, name string, body string"


def test_tree_round_trip_and_pruning(spark, tmp_path):
    root = tmp_path / "results"
    write_tree(spark.createDataFrame(ROWS, TREE).repartition(3), f"file://{root}")
    write_tree(spark.createDataFrame(ROWS[:1], TREE), str(root))  # again: same place
    assert (root / "o__m1/r1/A.json").read_text() == '{"score": 1}' and (root / "o__m2/r1/experiments/exp_1/B.json").exists()
    (root / "o__m1/r1/notes.txt").write_text("not a result")
    key = lambda r: tuple(map(str, r))
    assert sorted(map(tuple, read_tree(spark, str(root)).collect()), key=key) == sorted((r[:5] + (r[5] or "",) for r in ROWS), key=key)
    tree = read_tree(spark, str(root))
    assert {r.revision for r in tree.filter("model = 'o/m1' AND revision IN ('r2', 'r3')").collect()} == {"r2"}
    assert tree.filter("experiment_id = 'exp_1'").count() == 3 and tree.filter("is_baseline").count() == 1
    assert read_tree(spark, str(root), "B.json").count() == 2 and read_tree(spark, str(tmp_path / "none")).collect() == []


def test_folders_outside_the_filter_are_not_listed(tmp_path, monkeypatch):
    from promptgauge.sources import run_tree

    for model, revision in (("o__m1", "r1"), ("o__m2", "r1"), ("o__m2", "r2")):
        (tmp_path / model / revision).mkdir(parents=True)
        (tmp_path / model / revision / "A.json").write_text("x" * 100)
    listed = []
    selector = run_tree.fs.FileSelector
    monkeypatch.setattr(run_tree.fs, "FileSelector", lambda path, **more: listed.append(path) or selector(path, **more))
    reader = RunTreeReader({"path": str(tmp_path)})
    left = list(reader.pushFilters([EqualTo(("model",), "o/m2"), In(("revision",), ("r2", "r9")), GreaterThan(("name",), "A")]))
    assert [type(f) for f in left] == [GreaterThan]
    assert [f[0] for p in reader.partitions() for f in p.files] == [f"{tmp_path}/o__m2/r2/A.json"]
    assert not any("o__m1" in p or "/r1" in p for p in listed)


def test_tasks_get_a_bounded_number_of_bytes(tmp_path):
    for i in range(20):
        (tmp_path / "m" / "r" / "experiments" / f"e{i:02d}").mkdir(parents=True)
        (tmp_path / "m" / "r" / "experiments" / f"e{i:02d}" / "A.json").write_text("x" * 1000)
    parts = RunTreeReader({"path": str(tmp_path), "part_bytes": str(5 * (1000 + (64 << 10)))}).partitions()
    assert [len(p.files) for p in parts] == [5] * 4 and isinstance(parts[0], Part)


def test_places_outside_the_tree_are_refused(spark, tmp_path):
    with pytest.raises(Exception, match="run tree"):
        write_tree(spark.createDataFrame([("m", "..", None, True, "a.json", "")], TREE), str(tmp_path))
    with pytest.raises(Exception, match="only added to"):
        read_tree(spark, str(tmp_path)).limit(0).write.format("runtree").option("path", str(tmp_path)).mode("overwrite").save()
