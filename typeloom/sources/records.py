"""Strict JSON records, and patch logs that replay into one."""

from __future__ import annotations

import copy
import json
from collections.abc import Iterable

from typeloom.plans.fold import HOLE, Folder
from typeloom.plans.nodes import NEVER, Listing, Node, Property, Shape

TRIM = "".join(map(chr, [*range(9, 14), 32, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000, 0xFEFF]))


def _reject(name: str):
    raise ValueError(f"{name} isn't JSON")


def parse(text: str):
    """One JSON value, as strictly as JavaScript reads it; numbers are doubles."""
    return json.loads(text, parse_constant=_reject, parse_int=lambda s: int(s) if len(s) < 16 else float(s))


# ---------------------------------------------------------------- patch logs


def step_of(key) -> str | int | None:
    if isinstance(key, str):
        return key
    if isinstance(key, int | float) and not isinstance(key, bool) and key >= 0 and key == int(key):
        return int(key)
    return None


def _get(box, key):
    if isinstance(box, list) and isinstance(key, int):
        return box[key] if key < len(box) else HOLE
    if isinstance(box, dict) and isinstance(key, str):
        return box.get(key, HOLE)
    return HOLE


def _put(box, key, value) -> None:
    if isinstance(box, list) and isinstance(key, int):
        box.extend([HOLE] * (key + 1 - len(box)))
        box[key] = value
    elif isinstance(box, dict) and isinstance(key, str):
        box[key] = value


def _is_number(key) -> bool:
    return isinstance(key, int | float) and not isinstance(key, bool)


def _new_box(next_key):
    return [] if _is_number(next_key) else {}


def _reach(root, path: list, last):
    """What stands at path; missing parts are made, the last of them as a copy of last."""
    now = root
    for i, raw in enumerate(path):
        key = step_of(raw)
        if key is None:
            return now
        end = i + 1 == len(path)
        child = _get(now, key)
        if child is HOLE or child is None or not end and not isinstance(child, list | dict):
            child = copy.deepcopy(last) if end else _new_box(path[i + 1])
            _put(now, key, child)
        now = child
    return now


def set_at(state, path: list, value):
    if not path:
        return value
    state = _new_box(path[0]) if state is HOLE else state
    key = step_of(path[-1])
    if key is not None:
        _put(_reach(state, path[:-1], _new_box(key)), key, value)
    return state


def append_at(state, path: list, value):
    state = (_new_box(path[0]) if path else {}) if state is HOLE else state
    target = _reach(state, path, [])
    if isinstance(target, list):
        target.extend(value if isinstance(value, list) else [value])
    return state


def is_patch(record) -> bool:
    kind = record.get("kind")
    whole = _is_number(kind) and kind in (0, 1, 2) and "v" in record
    return whole and (kind == 0 or isinstance(record.get("k"), list))


class PatchLog:
    """kind 0 sets the state, 1 a value at a path, 2 appends at a path. A log shows in its first SAMPLE objects."""

    name = "vscode-patch"
    SAMPLE = 20

    @classmethod
    def recognises(cls, records: Iterable) -> bool:
        some = []
        for r in records:
            if isinstance(r, dict):
                some.append(r)
                if len(some) == cls.SAMPLE:
                    break
        good = sum(map(is_patch, some))
        return len(some) >= 2 and good >= 2 and good >= 0.8 * len(some) and any(_is_number(r.get("kind")) and r["kind"] == 0 for r in some)

    def __init__(self, folder: Folder | None = None):
        self.state, self.folder = HOLE, folder
        self.seen: dict[str, tuple[list, Node]] = {}

    def add(self, record) -> None:
        if not isinstance(record, dict):
            return
        kind, path, value = record.get("kind"), record.get("k"), record.get("v", HOLE)
        if not _is_number(kind):
            return
        if kind == 0:
            self.state = copy.deepcopy(value) if value is not HOLE else HOLE
        elif kind in (1, 2) and isinstance(path, list):
            if self.folder:
                self._note(path, value, kind == 2)
            self.state = (set_at if kind == 1 else append_at)(self.state, path, copy.deepcopy(value) if value is not HOLE else HOLE)

    def _note(self, path: list, value, append: bool) -> None:
        node = self.folder.of(value)
        if append and not isinstance(value, list):
            node = Listing(node)
        key = json.dumps(path, ensure_ascii=False)
        before = self.seen.get(key)
        self.seen[key] = (path, self.folder.join(before[1], node) if before else node)

    def records(self) -> list:
        return [] if self.state is HOLE else [self.state]

    def node(self) -> Node | None:
        """The state's type, with every type that was ever written to a path."""
        if self.state is HOLE:
            return None
        out = self.folder.of(self.state)
        for path, node in self.seen.values():
            out = self._graft(out, path, node)
        return out

    def _graft(self, root: Node, path: list, node: Node) -> Node:
        if not path:
            return self.folder.join(root, node)
        key = step_of(path[0])
        if isinstance(key, int) and isinstance(root, Listing):
            return Listing(self._graft(root.item, path[1:], node))
        if isinstance(key, str) and isinstance(root, Shape):
            own = root.properties.get(key)
            child = Property(self._graft(own.node if own else NEVER, path[1:], node), own.present if own else root.total)
            return Shape(root.total, {**root.properties, key: child})
        return root


class CodexRollout:
    """A place for a rollout format; leaves every file to the plain fold."""

    name = "codex-rollout"

    @classmethod
    def recognises(cls, records: Iterable) -> bool:
        return False


#: Ways to read a file as one state, by priority.
ADAPTERS = (PatchLog, CodexRollout)


def node_of_records(records: list, folder: Folder, adapters=ADAPTERS) -> Node:
    """The type of one file's records."""
    for adapter in adapters:
        if adapter.recognises(records):
            log = adapter(folder)
            for r in records:
                log.add(r)
            if (node := log.node()) is not None:
                return node
    return folder.fold(records)


def states_of_records(records: list, adapters=ADAPTERS) -> list:
    for adapter in adapters:
        if adapter.recognises(records):
            log = adapter()
            for r in records:
                log.add(r)
            return log.records() or records
    return records
