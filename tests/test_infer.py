"""Distributed inference and checking against the plain fold."""

import gzip
import json
import random

import pytest

from typeloom.api import infer_values
from typeloom.operators.check import check_files, check_lines
from typeloom.operators.infer import _Walk, fold_stream, infer_files, infer_frame, simplify_text
from typeloom.plans.declarations import read, root_of
from typeloom.plans.fold import Folder
from typeloom.plans.nodes import NEVER, Context, decode, encode, structure
from typeloom.plans.settings import Options
from typeloom.sources.jsonl import expand, read_lines, with_validity


def any_value(r, depth=0):
    kind = r.random()
    if depth > 2 or kind < 0.5:
        return r.choice([None, 1, 2.5, "x", "550e8400-e29b-41d4-a716-446655440000", "a/b", True, "y" * 60])
    if kind < 0.65:
        return [any_value(r, depth + 1) for _ in range(r.randint(0, 3))]
    out = {k: any_value(r, depth + 1) for k in r.sample(["a", "b", "c", "d", "/p/q", "/r"], r.randint(0, 3))}
    if r.random() < 0.4:
        out[r.choice(["type", "kind"])] = r.choice(["u", "v", 1, None])
    return out


@pytest.mark.parametrize("seed", range(40))
def test_walk_equals_fold(seed):
    """The walk over structures gives the ordered fold's type, whatever the order."""
    r = random.Random(seed)
    pool = [any_value(r) for _ in range(12)]
    values = [r.choice(pool) for _ in range(60)]
    folder = Folder(Context())
    keys = [structure(folder.of(v)) for v in values]
    nodes = {k: folder.of(v) for k, v in zip(keys, values)}

    def firsts(place):
        out = {}
        for i, k in enumerate(keys):
            if place is None or i > place:
                out.setdefault(k, i)
        return out

    assert structure(_Walk(folder, nodes, firsts).run()) == structure(folder.fold(values))


@pytest.mark.parametrize("seed", range(30))
def test_two_copies_are_enough(seed):
    """Leaving out third copies of options doesn't show in the declarations."""
    r = random.Random(1000 + seed)
    pool = [any_value(r) for _ in range(8)]
    values = [r.choice(pool) for _ in range(40)]
    from typeloom.api import finish
    from typeloom.plans.settings import settle

    s = settle(Options())
    short, full = (finish(Folder(s.context, bounded=b).fold(values), s)[0].text() for b in (True, False))
    assert short == full


def test_codec():
    node = Folder().fold([{"a": [1, "x", None, {"type": "q"}]}, {"a": [], "b": {"/x": 1}}])
    assert encode(decode(encode(node))) == encode(node)


def test_stream_of_many_partitions(spark):
    rows = [(i, "a" if i % 3 else "b", i if i % 5 else None) for i in range(500)]
    df = spark.createDataFrame(rows, "type_id int, kind string, extra int").repartition(7)
    from typeloom.sources.jsonl import lines_of_frame

    lines = lines_of_frame(df)
    text = [r.line for r in lines.orderBy("block", "id").collect()]
    got = fold_stream(lines, Context())
    assert structure(got) == structure(Folder().fold(map(json.loads, text)))
    assert infer_frame(df).text() == infer_values(map(json.loads, text))


def test_files(spark, tmp_path):
    (tmp_path / "a.jsonl").write_text('{"x":1}\r\n\n{"x":2,"y":"q"}\nnot json\n{"x":NaN}')
    (tmp_path / "b.jsonl").write_text('{"kind":0,"v":{"m":[]}}\n{"kind":2,"k":["m"],"v":{"role":"user"}}\n')
    with gzip.open(tmp_path / "c.jsonl.gz", "wt") as f:
        f.write('{"x":5}\n')
    with gzip.open(tmp_path / "d.gzip", "wt") as f:
        f.write('{"z":5}\n')
    seen = {}
    doc = infer_files(spark, [f"{tmp_path}/*.jsonl", f"{tmp_path}/c.*", f"{tmp_path}/d.gzip"], Options(root_name="R", header=""), lambda f, n: seen.update({f.rsplit("/", 1)[1]: n}))
    assert seen == {"a.jsonl": 2, "b.jsonl": 2, "c.jsonl.gz": 1, "d.gzip": 1}
    assert "x?" not in doc.text() and "y?: string" in doc.text() and "m: " in doc.text()
    flags = with_validity(read_lines(spark, [f"{tmp_path}/a.jsonl"])).orderBy("block", "id").collect()
    assert [r.valid for r in flags] == [True, None, True, False, False]
    with pytest.raises(ValueError, match="no input files"):
        infer_files(spark, [f"{tmp_path}/nothing*"])


def test_expand(tmp_path, capsys):
    for n in ("b.jsonl", "a.jsonl", "c.txt"):
        (tmp_path / n).write_text("")
    assert [f.rsplit("/", 1)[1] for f in expand([f"{tmp_path}/*.jsonl"])] == ["a.jsonl", "b.jsonl"]
    assert [f.rsplit("/", 1)[1] for f in expand([f"{tmp_path}/{{c,a}}.*"])] == ["a.jsonl", "c.txt"]
    assert expand([f"{tmp_path}/gone/*.x"]) == [] and "no files matched" in capsys.readouterr().err
    assert expand(["/plain/path"]) == ["/plain/path"]


SCHEMA = 'export type A = {\n  kind: "a";\n  x: number;\n};\n\nexport type B = {\n  kind: "b";\n  y?: string;\n};\n\nexport type Root = A | B;\n'


def test_check(spark, tmp_path):
    rows = [{"kind": "a", "x": 1}, {"kind": "b"}, {"kind": "a", "x": "no"}, {"kind": "c"}, {"kind": "b", "y": "t", "z": 1}]
    (tmp_path / "r.jsonl").write_text("\n".join(map(json.dumps, rows)))
    report = check_files(spark, [f"{tmp_path}/r.jsonl"], SCHEMA)
    assert (report.total, report.failed) == (5, 2)
    assert report.failures[0][1:] == (2, '[kind="a"] x: expected number, got string')
    assert report.failures[1][1] == 3 and "no union variant matched (2 tries)" in report.failures[1][2]
    assert report.fields["z (extra)"] == (1, ["number"]) and report.fields["kind"][0] >= 5
    assert report.types['"a"'] == 2 and report.text(True).startswith("FAIL 3/5 records\ntypes: ")


def test_check_replays_logs(spark, tmp_path):
    (tmp_path / "log.jsonl").write_text('{"kind":0,"v":{"n":1}}\n{"kind":1,"k":["n"],"v":2}\n')
    report = check_files(spark, [f"{tmp_path}/log.jsonl"], "export type R = { n: number };")
    assert (report.total, report.failed) == (1, 0)
    raw = check_lines(read_lines(spark, [f"{tmp_path}/log.jsonl"]), root_of("export type R = { n: number };")[1], adapters=()).report()
    assert (raw.total, raw.failed) == (2, 2)


def test_declarations():
    named = read('// c\nexport type Uuid = string;\n/** d */\nexport type T = { a?: Uuid[]; "b-c": Record<Uuid, T>; d: -1.5 | "x\\"y" | null };')
    t = named["T"]
    assert t.properties["a"].present == 0 and t.properties["b-c"].node.key == "Uuid"
    assert type(t.properties["b-c"].node.value).__name__ == "Anything"
    assert list(t.properties["d"].node.numbers) == [-1.5] and list(t.properties["d"].node.words) == ['x"y']
    with pytest.raises(ValueError):
        read("export type X = #")


def test_simplify_is_stable():
    once = simplify_text(SCHEMA)
    assert simplify_text(once) == once and once.count("export type") == 3
    with pytest.raises(ValueError):
        simplify_text("// nothing")


def test_never():
    assert Folder().join(NEVER, NEVER) is NEVER
