"""Manifests: named targets, each some inputs, an output and options."""

from __future__ import annotations

import json
import os
from dataclasses import dataclass
from pathlib import Path

from typeloom.plans.settings import PARAMETERS, PLUGINS, Options, plugins_by_name, with_parameters

#: Names of manifests that are looked for; find() takes others.
NAMES = ("typeloom.json",)
#: Keys of a target's options, and what they are called here.
KEYS = {"rootName": "root_name", "userTagKey": "user_tag", "header": "header", "dedupHints": "dedup_hints", "recordHints": "record_hints", "multiTagHints": "tag_hints", "adapters": "adapters"}


@dataclass(frozen=True)
class Target:
    name: str
    inputs: tuple[str, ...]
    output: str
    options: Options

    def paths(self, manifest: str) -> tuple[list[str], str]:
        """Inputs and output; relative ones stand in the manifest's folder, ~ is left to the reader."""
        base = Path(manifest).resolve().parent
        place = lambda p: p if p.startswith("~") or os.path.isabs(p) else str(base / p)
        return [place(p) for p in self.inputs], str(base / self.output)


def find(start: str = ".", names: tuple[str, ...] = NAMES) -> str | None:
    """The nearest manifest upwards, of one of the names."""
    here = Path(start).resolve()
    return next((str(d / n) for d in (here, *here.parents) for n in names if (d / n).exists()), None)


def _options(raw: dict, where: str) -> Options:
    """Without a list of plug-ins a target has none."""
    known: dict = {KEYS[k]: v for k, v in raw.items() if k in KEYS and v is not None}
    for key in ("record_hints", "tag_hints", "adapters"):
        if key in known:
            known[key] = tuple(json.loads(json.dumps(known[key])))
    if "dedup_hints" in known:
        known["dedup_hints"] = tuple(map(tuple, known["dedup_hints"]))
    if "record_hints" in known:
        from typeloom.plans.settings import RecordHint

        known["record_hints"] = tuple(map(RecordHint.of, known["record_hints"]))
    names = raw.get("plugins", [])
    if not isinstance(names, list) or not all(isinstance(n, str) for n in names):
        raise ValueError(f"{where}.options.plugins: expected string[]")
    numbers = raw.get("parameters", {})
    if not isinstance(numbers, dict):
        raise ValueError(f"{where}.options.parameters: expected object<string, number>")
    try:
        plugins = plugins_by_name(names)
    except ValueError as e:
        raise ValueError(f"{where}.options.plugins: {e}") from e
    try:
        parameters = with_parameters({}, numbers)
    except ValueError as e:
        raise ValueError(f"{where}.options.parameters: {e}") from e
    return Options(plugins=plugins, parameters=parameters, **known)


def _target(raw, where: str) -> Target:
    if not isinstance(raw, dict):
        raise ValueError(f"{where}: expected object")
    for key in ("name", "output"):
        if not isinstance(raw.get(key), str) or not raw[key]:
            raise ValueError(f"{where}.{key}: expected non-empty string")
    inputs = [raw["input"]] if isinstance(raw.get("input"), str) else raw.get("input")
    if not isinstance(inputs, list) or not all(isinstance(x, str) for x in inputs):
        raise ValueError(f"{where}.input: expected string or string[]")
    options = raw.get("options", {})
    if not isinstance(options, dict | list):
        raise ValueError(f"{where}.options: expected object")
    return Target(raw["name"], tuple(inputs), raw["output"], _options(options if isinstance(options, dict) else {}, where))


def parse(text: str) -> list[Target]:
    try:
        raw = json.loads(text)
    except ValueError as e:
        raise ValueError(f"manifest: invalid JSON: {e}") from e
    if not isinstance(raw, dict):
        raise ValueError("manifest: expected object at top level")
    if not isinstance(raw.get("targets"), list):
        raise ValueError("manifest.targets: expected array")
    return [_target(t, f"manifest.targets[{i}]") for i, t in enumerate(raw["targets"])]


def load(path: str) -> list[Target]:
    return parse(Path(path).read_text(encoding="utf-8"))


def json_schema() -> dict:
    """A JSON schema of manifests, for editors: made of the option names, plug-ins and parameters that there are."""
    words = {"type": "array", "items": {"type": "string"}}
    record_hint = {"oneOf": [{"type": "string"}, {"type": "object", "required": ["field", "key"], "properties": {"field": {"type": "string"}, "key": {"type": "string"}}}]}
    kinds = {
        "root_name": {"type": "string"}, "user_tag": {"type": "string"}, "header": {"type": "string"}, "tag_hints": words, "adapters": words,
        "dedup_hints": {"type": "array", "items": {"type": "array", "items": {"type": "string"}, "minItems": 2, "maxItems": 2}}, "record_hints": {"type": "array", "items": record_hint},
    }
    options = {outer: kinds[inner] for outer, inner in KEYS.items()}
    options["plugins"] = {"type": "array", "items": {"type": "string", "enum": sorted(PLUGINS)}}
    options["parameters"] = {"type": "object", "additionalProperties": False, "properties": {k: {"type": "integer", "minimum": 0, "default": v} for k, v in PARAMETERS.items()}}
    target = {
        "type": "object", "required": ["name", "input", "output"],
        "properties": {
            "name": {"type": "string", "minLength": 1}, "output": {"type": "string", "minLength": 1},
            "input": {"oneOf": [{"type": "string"}, words]}, "options": {"type": "object", "properties": options},
        },
    }
    return {"$schema": "http://json-schema.org/draft-07/schema#", "type": "object", "required": ["targets"], "properties": {"targets": {"type": "array", "items": target}}}
