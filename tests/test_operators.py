import json

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from marlspike import catalog, providers
from marlspike.operators import drift, evaluate, patch, profile, scenario, schema, synthetic, validation
from marlspike.operators.contract import issues_column, normalised_output
from marlspike.plans.compile import compile_program
from marlspike.plans.ir import Program
from marlspike.sources import readers, writers
from marlspike.streaming.mapping import map_stream, watch_drift, write_split

PROGRAM = {
    "source_refs": [{"id": "task_name", "path": "task_name", "dtype": "str"}],
    "steps": [{"id": "n", "operation": {"kind": "copy", "source_ref": "task_name"}}],
    "assignments": [{"step_id": "n", "target_path": "name"}],
}


def test_csv(spark, tmp_path):
    (tmp_path / "a.csv").write_text('Task ID;zone\n1;"a ""q"""\n2;\n3;x;surplus\n4\n')
    d = readers.load_dataset(spark, str(tmp_path / "a.csv"))
    assert [tuple(r) for r in d.records.collect()] == [("1", 'a "q"'), ("2", None), ("3", "x"), ("4", None)]
    assert d.original_names == {"task_id": "Task ID", "zone": "zone"}
    (tmp_path / "b.csv").write_text("Task ID,task_id\n1,2\n")
    with pytest.raises(ValueError, match="clash"):
        readers.load_dataset(spark, str(tmp_path / "b.csv"))
    with pytest.raises(ValueError, match="unsupported"):
        readers.load_dataset(spark, "x.xml")


def test_csv_with_a_long_header(spark, tmp_path):
    names = [f"a rather long name of column {i:04}" for i in range(400)] + ['in "two"\nlines; ' + "x" * 5000, "last"]
    quoted = ";".join('"' + n.replace('"', '""') + '"' if "\n" in n else n for n in names)
    (tmp_path / "w.csv").write_text("\n" + quoted + "\n" + ";".join(str(i) for i in range(402)) + "\n")
    d = readers.load_dataset(spark, str(tmp_path / "w.csv"))
    assert list(d.original_names.values()) == names and len(d.records.columns) == 402
    (row,) = d.records.collect()
    assert list(row) == [str(i) for i in range(402)]


def test_json_roots(spark, tmp_path):
    for name, text, root, n in (("o", '{"a": 1}', "object", 1), ("l", '[{"a": 1}, {"a": 2}]', "list", 2), ("v", "[1, 2]", "list", 1), ("s", "3", "object", 1)):
        (tmp_path / f"{name}.json").write_text(text)
        d = readers.load_dataset(spark, str(tmp_path / f"{name}.json"))
        assert (d.root, d.records.count()) == (root, n)
        assert d.records.columns == (["a"] if name in "ol" else ["value"])
    (tmp_path / "x.jsonl").write_text('{"a": 1}\n\n{"a": null}\n')
    assert readers.load_dataset(spark, str(tmp_path / "x.jsonl")).records.count() == 2
    assert readers.read_variant_lines(spark, str(tmp_path / "x.jsonl")).count() == 2


def test_contract(spark):
    want = T.StructType([T.StructField("id", T.LongType(), False), T.StructField("kind", T.StringType(), True, {"enum": ["a"], "default": "a"}), T.StructField("n", T.IntegerType(), True, {"ge": 1}), T.StructField("deep", T.StructType([T.StructField("x", T.StringType(), False)]))])
    df = spark.createDataFrame([("1", "a", 2.0, (None,)), (None, "b", 0.5, None), ("x", None, 0.0, ("y",))], "id string, kind string, n double, deep struct<x:string>")
    rows = df.select(issues_column(F.struct(*df.columns), df.schema, want).alias("i"), normalised_output(F.struct(*df.columns), df.schema, want).alias("o")).collect()
    assert [[(i.code, i.path) for i in r.i] for r in rows] == [[("missing", "deep.x")], [("missing", "id"), ("literal_error", "kind"), ("int_parsing", "n"), ("greater_than_equal", "n")], [("int_parsing", "id"), ("greater_than_equal", "n")]]
    assert rows[0].o.id == 1 and rows[2].o.kind == "a"


def test_profile_and_fingerprint(spark):
    rows = [("1", ["a", "b"], (1.5,)), ("2", [], (None,)), ("3", None, (2.5,))]
    df = spark.createDataFrame(rows, "id string, tags array<string>, m struct<v:double>")
    p = profile.profile(df)
    got = {r.path: r for r in p.fields.collect()}
    assert set(got) == {"id", "tags", "tags[]", "m.v"}
    assert got["id"].candidate_id and got["id"].present_ratio == 1.0
    assert got["tags[]"].max_array_length == 2 and round(got["tags[]"].present_ratio, 3) == 0.667
    assert round(got["m.v"].null_ratio, 3) == 0.333 and got["m.v"].numeric_max == 2.5
    assert got["m.v"].sample_values == ["1.5", "2.5", "None"]
    again = spark.createDataFrame(rows[::-1] * 2, df.schema)
    assert profile.profile(again).fingerprint == p.fingerprint
    assert profile.profile(df.drop("m")).fingerprint != p.fingerprint


def test_presence_below_nested_lists(spark):
    schema = "id int, tasks array<struct<name:string,tags:array<string>,deep:array<array<int>>>>"
    rows = [(1, [("a", None, [[]]), ("b", ["x", "y"], None)]), (2, [None, ("c", ["z"], [None, [1]])]), (3, [("d", [], None)]), (4, None), (5, [])]
    got = {r.path: r for r in profile.profile(spark.createDataFrame(rows, schema)).fields.collect()}
    want = {"id": 5, "tasks": 5, "tasks[]": 1, "tasks[].name": 3, "tasks[].tags": 3, "tasks[].tags[]": 3, "tasks[].deep": 3, "tasks[].deep[]": 2, "tasks[].deep[][]": 2}
    assert {p: round(r.present_ratio * 5) for p, r in got.items()} == want
    assert [t.type for t in got["tasks[].tags[]"].observed_types] == ["list", "str"] and got["tasks[].tags[]"].sample_values == ["[]", "x", "y", "z"]
    picks = profile.representative_samples(spark.createDataFrame(rows, schema), "id", 1)
    assert "tasks[].tags[]" in picks[0]["covered_paths"]


def test_samples_and_evidence(spark):
    df = spark.createDataFrame([(0, "a", None), (1, "b", [1]), (2, "c", None)], "rid int, x string, y array<int>")
    picks = profile.representative_samples(df, "rid", 2)
    assert picks[0]["rid"] == 1 and "y[]" in picks[0]["covered_paths"]
    assert len(profile.representative_samples(df, "rid", 0)) == 3
    p = profile.profile(df.drop("rid"))
    packed = profile.pack_evidence(p, picks, 1800, "compact")
    assert packed["estimated_size"] <= 1800 and packed["samples"] and len(packed["fields"]) <= 5
    with pytest.raises(profile.EvidenceBudgetExceeded):
        profile.pack_evidence(p, picks, 10)


def test_variant_goes_below_planned_levels(spark):
    df = spark.sql("""SELECT 1 AS rid, parse_json('{"a":{"b":{"c":{"d":[{"e":5}]}}}}') AS record""")
    got = sorted((r.path, r.type) for r in profile.flatten_variant(df, depth=2).collect())
    assert got == [("a.b.c.d", "list"), ("a.b.c.d[].e", "int")]


def test_variant_tells_missing_from_null(spark):
    df = spark.createDataFrame([(1, '{"a": null, "b": [1, 2.5]}'), (2, '{"b": []}')], "rid int, t string").select("rid", F.parse_json("t").alias("record"))
    got = sorted((r.rid, r.path, r.type) for r in profile.flatten_variant(df, depth=3).collect())
    assert got == [(1, "a", "null"), (1, "b", "list"), (1, "b[]", "float"), (1, "b[]", "int"), (2, "b", "list")]


def signature(spark, *rows):
    return spark.createDataFrame(list(rows), "path string, dominant_type string, present_ratio double, null_ratio double, cardinality string, enum_values array<string>")


def test_drift_and_patch_roundtrip(spark):
    base = signature(spark, ("task_id", "str", 1.0, 0.0, "one", []), ("task_name", "str", 1.0, 0.0, "one", []))
    renamed = signature(spark, ("task_id", "str", 1.0, 0.0, "one", []), ("taskName", "str", 1.0, 0.0, "one", []), ("prio", "str", 1.0, 0.0, "one", []))
    report = drift.classify_drift(base, renamed)
    assert [(d.kind, d.classification) for d in report.drifts] == [("added", "additive_compatible"), ("renamed", "rename_compatible")]
    assert report.compatible
    assert drift.classify_drift(base, base.where("path <> 'task_id'")).classification == "breaking_change"
    s = schema.SourceSchema("s", tuple(schema.SourceField(p) for p in ("task_id", "task_name"))).normalised()
    program = Program.read(PROGRAM)
    found = patch.propose_patch(report, s, program)
    assert not found.unresolved
    assert "taskname" in patch.apply_to_schema(s, found.patch).by_path()["taskName"].aliases
    df = spark.createDataFrame([("1", "n")], "task_id string, taskName string")
    keyed = patch.apply_to_program(program, found.patch)
    out = compile_program(keyed, df.schema).transform(df).first()
    assert (out.target.name, keyed.source_refs[0].path) == ("n", "taskName")
    with pytest.raises(patch.PatchError):
        patch.apply_to_program(program, patch.Patch(program=(("retarget", "zz", "x"),)))


def test_synthetic_durations(spark):
    df = spark.createDataFrame([(0, 7, ("x y",)), (1, 1, ("z",))], "i int, days int, o struct<n:string>")
    out, manifest = synthetic.apply_drift(df, {"drift_id": "d", "drift_type": "t", "severity": "high", "compatibility_class": "breaking_change", "operators": [{"kind": "change_value_format", "path": "days", "format_style": "duration_text"}, {"kind": "split_field", "path": "o.n", "new_paths": ["a", "b"]}]}, "i")
    assert [tuple(r) for r in out.orderBy("i").select("days", "a", "b").collect()] == [("7 days", "x", "y"), ("1 day", "z", "")]
    assert manifest["changed_paths"] == ["days", "o.n", "a", "b"]


def test_repair_loop(spark):
    df = spark.createDataFrame([("a",)], "task_name string")
    want = T.StructType([T.StructField("name", T.StringType(), False)])
    broken = Program.read({**PROGRAM, "assignments": [{"step_id": "n", "target_path": "other"}]})
    history = validation.repair_loop(broken, df, want, [], lambda p, r, e: Program.read(PROGRAM))
    assert [h.decision for h in history] == ["patched", "accepted"]
    assert [h.decision for h in validation.repair_loop(broken, df, want, [], lambda *a: None)] == ["strategy_declined"]
    assert validation.repair_loop(broken, df, want, [], lambda p, *a: p, 1)[-1].decision == "max_iterations_reached"
    assert validation.preflight(broken, want)["missing_required"] == ["name"]


def test_repeated_runs_and_reports(spark, tmp_path):
    rows = spark.createDataFrame([("run-1", 0.25), ("run-2", 0.5), ("run-3", 1.0)], "run_id string, value double").withColumn("k", F.lit("k"))
    s = evaluate.summary_stats(rows, ["k"]).first()
    assert (s.run_count, s.median, s.q1, s.q3, s.iqr) == (3, 0.5, 0.375, 0.75, 0.375)
    df = spark.createDataFrame([("a", "x", ("x",)), ("b", "y", ("z",))], "name string, t string, expected struct<title:string>")
    p = Program.read({"source_refs": [{"id": "t", "path": "t"}], "steps": [{"id": "s", "operation": {"kind": "copy", "source_ref": "t"}}], "assignments": [{"step_id": "s", "target_path": "title"}]})
    good = evaluate.Subject.from_program("p", lambda kind: compile_program(p, kind))
    bad = evaluate.Subject("broken", lambda: 1 / 0)
    cases, telemetry = evaluate.run_repeated([good, bad], [evaluate.Scenario("s", df, ("bundle_kind:drift", "severity:high"))], 2)
    got = {(r.subject_name): (r.micro_accuracy, r.execution_success_rate) for r in evaluate.run_metrics(cases, ["subject_name"]).collect()}
    assert got == {"p": (0.5, 1.0), "broken": (0.0, 0.0)}
    wide = evaluate.tag_dimensions(evaluate.run_metrics(cases, ["run_id", "scenario_name", "subject_name", "tags"]))
    summary = evaluate.summarise(evaluate.metric_rows(wide, ["micro_accuracy"]))
    assert {r.group_type for r in summary.collect()} == {"scenario", "bundle_kind", "severity"} | {"drift_type", "compatibility"} & set()
    writers.export_experiment(cases, summary, telemetry, str(tmp_path), "exp")
    assert "micro_accuracy" in (tmp_path / "report.md").read_text()
    assert "seconds" not in (tmp_path / "manifest.json").read_text()


def test_bundles(spark, tmp_path):
    b = scenario.build_bundle(11, 3, {"wrap_task_object": True, "shape_variants": {"variants": [{}, {"aliases": {"name": "title"}}]}})
    assert b == scenario.build_bundle(11, 3, b["template"])
    assert "title" in b["l0"]["records"][1]["task"]
    scenario.save_bundle(b, str(tmp_path))
    assert json.dumps(scenario.load_bundle(str(tmp_path / b["bundle_id"])), sort_keys=True) == json.dumps(json.loads(json.dumps(b)), sort_keys=True)
    assert scenario.bulk_tasks(spark, 5).count() == 5
    with pytest.raises(ValueError):
        scenario.sample_scenario(1, 11)


def test_export_layout_and_telemetry(spark, tmp_path):
    cases = spark.createDataFrame([("run-1", "s", "p", ["a"], True, None, None), ("run-2", "s", "p", ["a"], False, True, None)], "run_id string, scenario_name string, subject_name string, tags array<string>, execution_success boolean, structural_validity boolean, semantic_validity boolean")
    zero = F.struct(*[F.lit(0).cast("long").alias(c) for c in ("matched", "total", "matched_required", "total_required")], F.lit(0.0).alias("ratio"), F.lit(0.0).alias("required_ratio"))
    cases = cases.withColumn("accuracy", zero)
    rows = evaluate.tag_dimensions(evaluate.observation_metrics(cases, ["run_id", "scenario_name", "subject_name"]).withColumn("tags", F.array(F.lit("bundle_kind:drift"), F.lit("severity:high"))))
    got = {(r.run_id, r.metric_name): r.value for r in rows.collect()}
    assert got["run-1", "stage.runtime_validity_rate"] == 1.0 and got["run-2", "stage.structural_validity_rate"] == 1.0
    assert ("run-1", "stage.structural_validity_rate") not in got
    times = [{"run_id": r, "scenario_name": "s", "subject_name": "p", "metric_name": m, "value": v} for r, v in (("run-1", 0.5), ("run-2", 0.7)) for m in ("preparation_seconds", "runtime_seconds")]
    times.append({"run_id": "run-1", "scenario_name": "s", "subject_name": "p", "case_name": "c", "metric_name": "case_runtime_seconds", "value": 0.1})
    folder = f"file://{tmp_path}/out"
    manifest = writers.export_experiment(cases, evaluate.summarise(rows), times, folder, "e", rows)
    assert [r["run_id"] for r in manifest["runs"]] == ["run-1", "run-2"] and (tmp_path / "out/runs/run-2/cases").is_dir()
    assert spark.read.option("header", True).csv(f"{folder}/summary").columns == list(writers.SUMMARY_COLUMNS) and len(writers.SUMMARY_COLUMNS) == 24
    box = spark.read.option("header", True).csv(f"{folder}/boxplot")
    assert box.columns == list(writers.BOXPLOT_COLUMNS) and len(box.columns) == 16 and {(r.experiment_name, r.tags) for r in box.collect()} == {("e", "bundle_kind:drift;severity:high")}
    read = readers.telemetry_rows(spark, f"{folder}/runs/*/telemetry.json").collect()
    assert {(r.run_id, r.case_name, r.metric_name, r.value) for r in read} == {(t["run_id"], t.get("case_name"), t["metric_name"], t["value"]) for t in times}


def test_cases_of_bundles(spark):
    base = scenario.build_bundle(3, 2)
    drifted = scenario.drift_bundle(base, base["l0"], {"drift_id": "d1", "drift_type": "rename", "severity": "low", "compatibility_class": "rename_compatible", "operator_sequence": []})
    gold = T.StructType([T.StructField("tasks", T.ArrayType(T.StructType([T.StructField("id", T.StringType()), T.StructField("name", T.StringType())])))])
    s = evaluate.scenario_of_bundles(spark, "s", [base, drifted], "records array<struct<task_id:string,task_name:string>>", gold, ("more",))
    assert {"synthetic", "base", "drift", "drift_type:rename", "compatibility:rename_compatible", "more"} <= set(s.tags)
    pairs = evaluate.zip_with_gold(s.df.withColumn("gold", F.col("expected.tasks")), "records", "gold", ["name"]).collect()
    assert len(pairs) == 4 and all(p.raw.task_id == p.gold.id and p.raw.task_name == p.gold.name for p in pairs)
    with pytest.raises(Exception, match="same length"):
        evaluate.zip_with_gold(s.df.withColumn("gold", F.slice("expected.tasks", 1, 1)), "records", "gold").collect()
    with pytest.raises(TypeError, match="must be objects"):
        evaluate.scenario_of_bundles(spark, "s", [{**base, "l0": []}], "records array<string>", gold)


def test_candidates_and_traces(spark):
    rows = [("b", ["x", "y"], 1.0, 0.5), ("a", ["x", "y"], 1.0, 0.5), ("c", ["z"], 0.1, 0.1), ("d", [], None, 0.0)]
    picks = profile.select_candidates(spark.createDataFrame(rows, "record_id string, paths array<string>, completeness double, rarity double"), 3)
    assert [(p["record_id"], p["covered_paths"]) for p in picks] == [("a", ["x", "y"]), ("b", []), ("c", ["z"])]
    assert profile.select_candidates(spark.createDataFrame(rows, "record_id string, paths array<string>, completeness double, rarity double"), 0) == []
    t = writers.trace_artifact("repair", validation.Attempt(1, Program.read(PROGRAM), {"case_count": 2, "runtime_seconds": 1.0}, None, "patched"))
    assert t["version"] == "1.0" and t["payload"]["decision"] == "patched" and t["payload"]["report"] == {"case_count": 2} and t["payload"]["program"]["steps"][0]["id"] == "n"
    assert json.loads(json.dumps(t)) == t


def test_template_gates(tmp_path):
    gates = lambda payload, accepted=(): [(g["gate"], g["passed"]) for g in providers.check_template(providers.Reply(True, payload), set(accepted))[1]]
    whole = [(g, True) for g in ("parse", "policy", "dry_run", "serialization", "diversity")]
    good = {"aliases": {"name": "title"}, "wrap_task_object": True}
    assert gates(good) == whole and gates({"root_mode": "list"}) == whole
    assert gates("text") == [("parse", False)]
    for wrong in ({"records_key": " "}, {"aliases": {"name": ""}}, {"aliases": {"name": "task_id"}}, {"wrap_task_object": True, "task_object_key": ""}, {"shape_variants": {"variants": [{}, {"aliases": {"status": "task_id"}}]}}):
        assert gates(wrong)[-1] == ("policy", False)
    assert gates({"hidden_fields": ["status"]})[-1] == ("dry_run", False)
    assert all(gates({"extra_fields": {"x": x}})[-1] == ("serialization", False) for x in ({1, 2}, (1, 2)))
    assert gates(good, [providers.TemplateCache.key(template=good)])[-1] == ("diversity", False)
    cache = providers.TemplateCache(str(tmp_path))
    make = lambda model, *replies: providers.generate_template(providers.PreparedAdapter(list(replies)), cache, {"seed": 1}, model=model)
    assert make("m", {"aliases": {"name": ""}}, good) == good == make("m")
    assert make("other") is None  # another model's template is not served


def test_schema_cards():
    want = T.StructType([T.StructField("a", T.ArrayType(T.StructType([T.StructField("b", T.IntegerType(), True, {"default": 3})])), True)])
    cards = schema.target_card(want)
    assert cards[0]["children"][0]["path"] == "a.b" and cards[0]["type"] == "list[object]"
    assert schema.schema_of_card(cards).simpleString() == want.simpleString()


def test_providers(tmp_path):
    ledger = providers.BudgetLedger(providers.PreparedAdapter([PROGRAM, "no program", PROGRAM]), {"mapping": 2})
    s = schema.SourceSchema("s", (schema.SourceField("task_name"),))
    ranked = providers.synthesise(ledger, s, ["name"], 2)
    assert len(ranked) == 1 and ranked[0].valid
    with pytest.raises(providers.BudgetExceeded):
        ledger.complete(providers.render_prompt("repair", program={}, failures=[]))
    cache = providers.TemplateCache(str(tmp_path))
    make = lambda a: providers.generate_template(a, cache, {"seed": 1}, [lambda t: None if "ok" in t else "bad"])
    assert make(providers.PreparedAdapter([{"x": 1}, {"ok": 1}])) == {"ok": 1}
    assert make(providers.PreparedAdapter([])) == {"ok": 1}


def test_streams(spark, tmp_path):
    src = str(tmp_path / "in")
    spark.createDataFrame([("1", "a"), ("2", None)], "task_id string, task_name string").write.parquet(src)
    batch = spark.read.parquet(src)
    p = compile_program({**PROGRAM, "preconditions": [{"ref": "task_name"}]}, batch.schema)
    stream = spark.readStream.schema(batch.schema).parquet(src)
    write_split(map_stream(stream, p, ["task_id"]), f"{tmp_path}/good", f"{tmp_path}/bad", f"{tmp_path}/c1").awaitTermination()
    assert [r.task_id for r in spark.read.parquet(f"{tmp_path}/good").collect()] == ["1"]
    assert [r.task_id for r in spark.read.parquet(f"{tmp_path}/bad").collect()] == ["2"]
    reports = []
    watch_drift(stream.drop("task_id"), profile.profile(batch), lambda n, r: reports.append(r.classification), f"{tmp_path}/c2").awaitTermination()
    assert reports == ["breaking_change"]


def test_the_mapped_stream_stays_in_files(spark, tmp_path):
    events = spark.read.parquet("/root/testdata/sf0.001/events.parquet")
    events.repartition(3).write.parquet(f"{tmp_path}/some/events.parquet")
    events.limit(0).write.parquet(f"{tmp_path}/none/events.parquet")
    out, again = (catalog.queries()["stream_map_equiv"](spark, f"{tmp_path}/some") for _ in range(2))
    assert out.inputFiles() and set(out.inputFiles()).isdisjoint(again.inputFiles())  # a memory sink holds all rows on the driver
    want = sorted(events.selectExpr("event_id", "event_type", "value * 2").collect())
    assert sorted(out.collect()) == want == sorted(again.collect())
    assert catalog.queries()["stream_map_equiv"](spark, f"{tmp_path}/none").count() == 0
