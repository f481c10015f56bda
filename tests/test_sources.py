import json

import pytest
from pyspark.sql import functions as F

from gradus.plans import config, reports
from gradus.sources import contracts as V
from gradus.sources import manifests as M

FIELDS = {"id": "string", "score": "int"}


def written(tmp_path, *lines):
    path = tmp_path / "rows.jsonl"
    path.write_text("\n".join(lines) + "\n")
    return str(path)


@pytest.mark.parametrize(
    ("line", "rule"),
    [("", "blank line"), ("{", "invalid JSON"), ('{"id": "a", "id": "b", "score": 1}', "invalid JSON"), ('{"id": "x", "score": NaN}', "invalid JSON"), ("[1]", "not an object"), ('{"id": "x"}', "missing keys: score"), ('{"id": "x", "score": 1, "z": 0, "y": 0}', "unknown keys: y, z"), ('{"id": "x", "score": 1.0}', "score must be int"), ('{"id": "x", "score": true}', "score must be int"), ('{"id": 5, "score": 1}', "id must be string"), ('{"id": " ", "score": 1}', "id is empty"), ('{"id": "ok", "score": 2}', "duplicate id: ok"), ('{"id": "x", "score": null}', "score must be int")],
)
def test_broken_lines(spark, tmp_path, line, rule):
    path = written(tmp_path, '{"id": "ok", "score": 1}', line, '{"id": "last", "score": 1}')
    found = V.violations(V.parsed(V.lines(spark, path)), FIELDS).collect()
    assert rule in {r["rule"] for r in found} and {r["line"] for r in found} == {2}
    with pytest.raises(V.ContractError, match=r"rows.jsonl:2"):
        V.load(spark, path, FIELDS)


def test_good_lines(spark, tmp_path):
    path = written(tmp_path, '{"score": 1, "id": "a"}', '{"id": "b", "score": 80, "note": null}')
    assert [(r["id"], r["score"], r["line"]) for r in V.load(spark, path, FIELDS, {"note": "string"}).orderBy("line").collect()] == [("a", 1, 1), ("b", 80, 2)]


def test_attempts(spark, tmp_path):
    path = written(tmp_path, '{"id": "a", "score": 1}', '{"id": "b", "score": "high"}', '{"id": "c"}')
    assert [(r["id"], r["score"], r["format_error"]) for r in V.load_attempts(spark, path, FIELDS).orderBy("id").collect()] == [("a", 1, None), ("b", None, "score must be int"), ("c", None, "missing keys: score")]
    with pytest.raises(V.ContractError):
        V.load_attempts(spark, written(tmp_path, '{"score": 1}'), FIELDS)
    with pytest.raises(V.ContractError):
        V.load_attempts(spark, written(tmp_path, '{"id": "a", "score": 1}', '{"id": "a", "score": 2}'), FIELDS)


def test_predicates(spark):
    rows = spark.createDataFrame([("p/a.png", [0, 0, 5, 5]), ("p/../a", [5, 0, 5, 5]), ("q/a", [0, 0, 50, 5]), ("p/a/b", [0, 0, 1])], "path string, box array<int>")
    assert [r[0] for r in rows.select(V.inside(F.col("path"), "p")).collect()] == [True, False, False, False]
    assert [bool(r[0]) for r in rows.select(V.box_holds(F.col("box"), F.lit(10), F.lit(10))).collect()] == [True, False, False, False]
    names = spark.createDataFrame([(["A", "b"],), (["A", "a"],), ([],), ([" "],)], "v array<string>")
    assert [r[0] for r in names.select(V.unique_normalised(F.col("v"), lambda x: F.trim(F.lower(x)))).collect()] == [True, False, False, False]


def test_manifests(spark, tmp_path):
    path = written(tmp_path, '{"a": 1}', '{"a": 2}')
    sha = M.digest(spark, path).first()["sha256"]
    assert [r["index"] for r in M.numbered(spark, path, 2, sha).orderBy("index").collect()] == [0, 1]
    with pytest.raises(V.ContractError):
        M.numbered(spark, path, 3)
    with pytest.raises(V.ContractError):
        M.numbered(spark, path, 2, "0" * 64)
    rows = M.training_rows(M.fixture(spark), "/data/m").orderBy("id").collect()
    assert rows[0]["image"] == "/data/m/b.png" and json.loads(rows[0]["example_payload"])["id"] == "dev-1" and "three" not in rows[0]["prompt"][1]["content"][1]["text"]
    assert M.id_list('["b", "a"]') == M.id_list('{"subset_ids": ["b", "a"]}') == M.id_list('{"id": "b"}\n{"id": "a"}') == ["b", "a"]
    for bad in ('["a", "a"]', "[]", "[1]"):
        with pytest.raises(V.ContractError):
            M.id_list(bad)
    pack = spark.createDataFrame([("a", 0, "v2", [1], "0" * 64), ("b", 2, "v1", [-1], "x")], "example_id string, index int, proxy_output_protocol string, completion_ids array<int>, prompt_token_sha256 string")
    assert sorted(r["rule"] for r in V.rules_table(pack, "example_id", M.pack_rules()).collect()) == ["prompt digest is SHA-256", "token ids are not negative"]
    assert sorted(tuple(r) for r in M.pack_mismatches(pack, {"selected_ids": ["a", "b", "c"]}, "v2").collect()) == [("b", "has its place"), ("b", "has the version"), ("c", "has its place"), ("c", "has the version"), ("c", "is in the pack")]


def test_reports(spark, tmp_path):
    one = spark.range(1).select(F.lit(1.5).alias("b"), F.lit(float("nan")).alias("a"))
    assert reports.as_json(one) == '{\n  "a": null,\n  "b": 1.5\n}\n'
    rows = spark.createDataFrame([("x<y", 0.1, 0.2, 0.9), ("z", None, None, None)], "name string, low double, mid double, high double")
    assert "| z | NA | NA | NA |" in reports.as_markdown(rows, "T")
    assert reports.range_svg(rows, "name", "low", "mid", "high").count("<circle") == 1
    counts = spark.createDataFrame([("s", 0, 3), ("s", 1, 1)], "s string, bin int, n int")
    # Shares 3/4 and 1/4 in a panel whose top is the largest share.
    chart = reports.frequency_svg(counts, "s", "bin", "n", "a & b")
    assert "40.0,30.0 620.0,123.3" in chart and ">s (4)<" in chart and "a &amp; b" in chart and ">0.75<" in chart
    path = f"{tmp_path}/once.txt"
    reports.write_new(spark, path, "one é\n")
    with pytest.raises(FileExistsError):
        reports.write_new(spark, path, "two")
    assert (tmp_path / "once.txt").read_text() == "one é\n" and not list(tmp_path.glob("*.tmp"))
    reports.write_manifest(M.fixture(spark), str(tmp_path / "m"))
    assert spark.read.json(str(tmp_path / "m")).count() == 2
    with pytest.raises(Exception, match="(?i)exists"):
        reports.write_manifest(M.fixture(spark), str(tmp_path / "m"))


def test_manifest_rows(spark, tmp_path):
    path = written(tmp_path, '{"id": "a", "split": "dev", "student_image": "s.png", "teacher_image": "/t.png", "question": "Q?", "required_visual_facts": {"c": "red"}, "accepted_answers": ["é"]}', "  ", '{"id": "b", "split": "train", "student_image": "x.png", "teacher_image": "x.png", "question": "Q?", "required_visual_facts": {"c": {"canonical": "red", "aliases": ["r"]}}, "accepted_answers": ["1"]}')
    rows = M.scanned(spark, path)
    made = M.gold_rows(V.examples(rows), "/d").orderBy("example_id")
    first = made.first()
    assert json.loads(first["example_payload"]) == {"id": "a", "split": "dev", "student_image": "/d/s.png", "teacher_image": "/t.png", "question": "Q?", "required_visual_facts": {"c": {"canonical": "red", "aliases": []}}, "accepted_answers": ["é"]}
    assert first["example_payload"] == json.dumps(json.loads(first["example_payload"]), sort_keys=True, ensure_ascii=False)
    assert sorted(map(tuple, M.manifest_problems(made).collect())) == [("b", "images differ"), ("b", "there is one split")]
    with pytest.raises(V.ContractError, match="no such ids: z"):
        M.rows_listed(made, '["z"]', "example_id")
    with pytest.raises(V.ContractError, match="no records"):
        M.scanned(spark, written(tmp_path, " "))
    with pytest.raises(V.ContractError, match="must be a JSON object"):
        M.scanned(spark, written(tmp_path, "[1]"))


def test_configs():
    good = {"answer_utility": 1.0, "rho_answer": 1, "rho_visual": 0.5, "format_penalty": 0}
    config.check_reward(good)
    config.check_batches({"group_size": 4, "world_size": 2, "micro_batch": 1, "accumulation": 2})
    config.check_tracking({"project": "p", "run": "r", "every": 5, "tags": ["a"]})
    config.check_proxy({"alpha": 0.5, "baseline_weight": 1, "temperature": 0.5, "min_tokens": 8})
    for check, bad in ((config.check_reward, good | {"rho_answer": 2}), (config.check_reward, good | {"x": 1}), (config.check_reward, good | {"rho_visual": True}), (config.check_batches, {"group_size": 4, "world_size": 1, "micro_batch": 1, "accumulation": 2}), (config.check_tracking, {"project": "p", "run": " ", "every": 5}), (config.check_proxy, {"alpha": 2, "baseline_weight": 1, "temperature": 1, "min_tokens": 1})):
        with pytest.raises(config.ConfigError):
            check(bad)
