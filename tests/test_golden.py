"""End-to-end cases: records in, exact declarations out. Expected texts follow from the rules of folding, passes and printing."""

import json

import pytest

from typeloom.api import infer_text, infer_values
from typeloom.plans.settings import COPILOT_CLI, Options

#: What it shows: (options, records, declarations).
CASES = {
    "optional properties": (
        {},
        [{"city": "Oslo", "size": 7, "river": None}, {"city": "Bern", "size": 9}, {"city": "Rome", "size": 4, "port": False}],
        """
/** Variant */
export type Variant_0a11de5b = {
  city: string;
  river?: null;
  size: number;
};

/** Variant */
export type Variant_0a11de5b_2 = {
  city: string;
  port: boolean;
  size: number;
};

export type Root = Variant_0a11de5b | Variant_0a11de5b_2;
""",
    ),
    "kinds told apart by a tag": (
        {"root_name": "Shape"},
        [{"kind": "disc", "radius": 2}, {"kind": "box", "width": 3, "height": 4}, {"kind": "disc", "radius": 5, "filled": True}, {"kind": "path", "points": [0.5, 1]}],
        """
/** disc */
export type Disc_0ca56772 = {
  filled?: boolean;
  kind: "disc";
  radius: number;
};

/** box */
export type Box_bbe3bb29 = {
  height: number;
  kind: "box";
  width: number;
};

/** path */
export type Path_41df4a13 = {
  kind: "path";
  points: number[];
};

export type Shape = Disc_0ca56772 | Box_bbe3bb29 | Path_41df4a13;
""",
    ),
    "objects keyed by a format": (
        {},
        [{"rates": {"2024-03-01": {"bid": 1.5}, "2024-03-02": {"bid": 1.6, "ask": 1.7}}}, {"rates": {"2024-03-03": {"ask": 2, "bid": 1.9}}}],
        """
export type IsoDate = string;

export type Root = {
  rates: Record<IsoDate, {
    ask?: number;
    bid: number;
  }>;
};
""",
    ),
    "kinds inside a list": (
        {"root_name": "Order"},
        [{"lines": [{"op": "add", "sku": "x1"}, {"op": "clear"}]}, {"lines": [{"op": "add", "sku": "x2", "count": 3}]}, {"lines": []}],
        """
/** lines[] -> add */
export type Lines_Add_72f9bd5b = {
  count?: number;
  op: "add";
  sku: string;
};

/** lines[] -> clear */
export type Lines_Clear_9df9e8d6 = {
  op: "clear";
};

export type Order = {
  lines: Array<Lines_Add_72f9bd5b | Lines_Clear_9df9e8d6>;
};
""",
    ),
    "a log of changes": (
        {"root_name": "Board"},
        [{"kind": 0, "v": {"rows": [], "owner": {"since": "2025-05-05"}}}, {"kind": 1, "k": ["owner", "name"], "v": "Ann"}, {"kind": 2, "k": ["rows"], "v": {"type": "task", "done": False}}, {"kind": 2, "k": ["rows"], "v": {"type": "note", "lines": []}}],
        """
export type IsoDate = string;

/** rows[] -> task */
export type Rows_Task_fc3f4339 = {
  done: boolean;
  type: "task";
};

/** rows[] -> note */
export type Rows_Note_44cf5fb5 = {
  lines: never[];
  type: "note";
};

export type Board = {
  owner: {
    name: string;
    since: IsoDate;
  };
  rows: Array<Rows_Task_fc3f4339 | Rows_Note_44cf5fb5>;
};
""",
    ),
    "no records": (
        {"root_name": "Nothing"},
        [],
        """
export type Nothing = never;
""",
    ),
    "order decides what splits": (
        {"root_name": "Reading"},
        [{"at": 1, "low": 0.5}, {"at": 2, "high": 9, "low": None}, {"at": 3, "high": 8}, {"at": 4, "unit": "C"}],
        """
/** Variant */
export type Variant_fa4a64c8 = {
  at: number;
  high?: number;
  low?: number | null;
};

/** Variant */
export type Variant_fa4a64c8_2 = {
  at: number;
  unit: string;
};

export type Reading = Variant_fa4a64c8 | Variant_fa4a64c8_2;
""",
    ),
    "one kind, two contents": (
        {"root_name": "Feed"},
        [{"items": [{"type": "card", "body": {"title": "a", "image": {}}}]}, {"items": [{"type": "card", "body": {"title": "b", "link": "l", "clicks": 2}}, {"type": "gap"}]}],
        """
/** items[] -> card.body -> Variant */
export type Body_Variant_58d9df4a = {
  clicks: number;
  link: string;
  title: string;
};

/** items[] -> card.body -> Variant */
export type Body_Variant_58d9df4a_2 = {
  image: Record<string, unknown>;
  title: string;
};

/** items[] -> card */
export type Items_Card_8bac0463 = {
  body: Body_Variant_58d9df4a | Body_Variant_58d9df4a_2;
  type: "card";
};

/** items[] -> gap */
export type Items_Gap_61e1b1cf = {
  type: "gap";
};

export type Feed = {
  items: Array<Items_Card_8bac0463 | Items_Gap_61e1b1cf>;
};
""",
    ),
    "a tree": (
        {"root_name": "Menu"},
        [{"top": {"type": "dir", "label": "a", "inside": [{"type": "dir", "label": "b", "inside": [{"type": "dir", "label": "c", "inside": [{"type": "leaf", "go": "x"}]}]}]}}, {"top": {"type": "dir", "label": "d", "inside": [{"type": "leaf", "go": "y"}]}}],
        """
/** top.inside[] -> dir.inside[] -> leaf */
export type Inside_Leaf_882a8d76 = {
  go: string;
  type: "leaf";
};

/** top.inside[] -> dir */
export type Inside_Dir_69ba7264 = {
  inside: Array<Inside_Dir_69ba7264 | Inside_Leaf_882a8d76>;
  label: string;
  type: "dir";
};

export type Menu = {
  top: {
    inside: Array<Inside_Dir_69ba7264 | Inside_Leaf_882a8d76>;
    label: string;
    type: "dir";
  };
};
""",
    ),
    "a plug-in's format": (
        {"plugins": (COPILOT_CLI,)},
        [{"spent": {"gpt-5": {"calls": 3}, "claude-3.5": {"calls": 1, "failed": 1}}, "not-a-name": True}],
        """
export type ModelId = string;

export type Root = {
  "not-a-name": boolean;
  spent: Record<ModelId, {
    calls: number;
    failed?: number;
  }>;
};
""",
    ),
}


@pytest.mark.parametrize("name", CASES)
def test_golden(name):
    options, records, expected = CASES[name]
    text = "".join(json.dumps(r) + "\n" for r in records)
    assert infer_text(text, Options(header="", **options)) == expected.removeprefix("\n")


def test_nested_objects_stay_inline():
    value = {"leaf": True}
    for depth in range(15):
        value = {f"level{depth}": value}
    out = infer_values([value], Options(root_name="Nest"))
    assert out.count("{") == out.count("}") == 16 and "leaf: boolean;" in out and out.count("export type") == 1


def test_bare_cycle_gets_a_name():
    """Objects that hold themselves without a choice in between are declared."""
    inner = {"type": "dir", "label": "c", "inside": []}
    out = infer_values([{"top": {"type": "dir", "label": "a", "inside": [{"type": "dir", "label": "b", "inside": [inner]}]}}])
    assert "<again>" not in out and out.count("export type") == 2


def test_policies():
    """Conditions of rules on pairs of objects, and on what isn't an object."""
    from typeloom.plans.fold import Folder
    from typeloom.plans.policy import ALIKE, STREAM, Conditions, Policy

    folder = Folder()
    c = Conditions(folder.context, lambda a, b: True)
    of = folder.of
    small, large, tagged, other = of({"a": 1, "b": 2}), of({"a": 1, "b": 2, "c": 3}), of({"type": "x", "a": 1}), of({"type": "y", "a": 1})
    told = {
        "any": (1, 1), "same-keys": (0, 1), "subset-keys": (1, 1), "overlap-min 2": (1, 1), "overlap-min 3": (0, 0), "keys-lt 3": (0, 1),
        "keys-gt 1": (1, 1), "no-tag": (1, 0), "tag-present": (0, 0), "tag-strict": (0, 0), "tag-loose": (1, 0), "name-prefix": (1, 1), "nullable-compat": (0, 0), "types-match": (1, 1),
    }
    for words, (untagged, kinds) in told.items():
        assert bool(c.test(words)(small, large)) == bool(untagged), words
        assert bool(c.test(words)(tagged, other)) == bool(kinds), words
    scalar = of(1)
    assert not c.test("no-tag")(scalar, small) and c.test("same-keys")(scalar, small) and c.test("any")(scalar, scalar)
    assert STREAM.compiled(c)(small, large) and not STREAM.compiled(c)(tagged, other) and not ALIKE.compiled(c)(tagged, other)
    assert Policy(("keys-gt 9", "same-keys and no-tag")).compiled(c)(small, of({"b": 0, "a": 0}))
    with pytest.raises(ValueError):
        c.test("other")


@pytest.mark.parametrize("combine", ["deep", "deep-safe", "shallow", "structural", "rename-only"])
def test_combine_modes(combine):
    from typeloom.plans.emit import Option, Signatures
    from typeloom.plans.fold import Folder
    from typeloom.plans.unite import Recipe, Uniter, picked

    folder = Folder()
    a, b = folder.of({"x": 1, "y": "s"}), folder.of({"x": 2, "y": "t", "z": True})
    group, becomes = [Option(a), Option(b)], {}
    main = Uniter(folder, Signatures(folder.context)).unite(group, Recipe(combine, "most-fields"), becomes)
    assert main.shape is b and becomes == {a: b}
    assert b.total == (1 if combine in ("structural", "rename-only") else 2) and list(b.properties) == (["x", "y", "z"])
    assert picked(group, "first").shape is a and picked(group, "highest-occur").shape in (a, b) and picked(group, "", target=b).shape is b
