"""Options of a run, plug-ins, and numeric parameters."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Mapping
from dataclasses import dataclass, field

from typeloom.functions.formats import FORMATS, MODEL_ID, Format
from typeloom.plans.nodes import Context, Node, Shape

# The numeric parameters and their defaults.
PARAMETERS = {
    "hoist-shared.min-keys": 2,
    "hoist-shared.min-refs": 2,
    "pipeline.convergence-cap": 4,
    "structural-dedupe.max-passes": 16,
    "check.failure-cap": 20,
}


def with_parameters(base: Mapping[str, int], over: Mapping[str, object] | None) -> dict[str, int]:
    out = dict(base)
    for key, value in (over or {}).items():
        if key not in PARAMETERS:
            raise ValueError(f'unknown parameter "{key}". Known: {", ".join(sorted(PARAMETERS))}')
        if isinstance(value, bool) or not isinstance(value, int | float) or value < 0 or value != value or value == float("inf") or value != int(value):
            raise ValueError(f'parameter "{key}": expected non-negative integer, got {value}')
        out[key] = int(value)
    return out


def parse_parameter(text: str) -> tuple[str, int]:
    """key=value of the command line."""
    key, equals, value = text.partition("=")
    if not (key and equals and value):
        raise ValueError(f'--param expects "key=value", got: {text}')
    key = key.strip()
    try:
        number: object = float(value.strip())
    except ValueError:
        number = value.strip()
    if key in PARAMETERS and isinstance(number, str):
        raise ValueError(f'parameter "{key}": expected non-negative integer, got "{number}"')
    return key, with_parameters({}, {key: number})[key]


@dataclass(frozen=True)
class RecordHint:
    """Objects of this field are maps from keys of this format."""

    field: str
    key: str = "string"

    @classmethod
    def of(cls, hint) -> RecordHint:
        return hint if isinstance(hint, cls) else cls(hint) if isinstance(hint, str) else cls(hint["field"], hint["key"])


@dataclass(frozen=True)
class Match:
    """What a plug-in says of an object: a name, and whether to declare it."""

    name: str | None = None
    declare: bool = False


@dataclass(frozen=True)
class Plugin:
    """Knowledge of a domain. match(node, field) names objects; the first plug-in that answers counts."""

    name: str
    tag_hints: tuple[str, ...] = ()
    dedup_hints: tuple[tuple[str, str], ...] = ()
    record_hints: tuple = ()
    formats: tuple[Format, ...] = ()
    parameters: Mapping[str, int] = field(default_factory=dict)
    match: Callable[[Node, str], Match | None] | None = None


# Names of objects by the one number of their $mid.
MID_NAMES = {1: "VscodeUri", 20: "VscodeLanguageModelToolResult", 21: "VscodeLanguageModelTextPart", 23: "VscodeLanguageModelPromptTsxPart"}


def _by_mid(node: Node, under: str) -> Match | None:
    tag = node.scalar_tag("$mid") if isinstance(node, Shape) else None
    numbers = list(tag.numbers or ()) if tag is not None else []
    name = MID_NAMES.get(numbers[0]) if len(numbers) == 1 else None
    return Match(name, True) if name else None


# The scopes, names and fields that the built-in plug-ins hint at.
_TOOL_RESULTS = "CopilotChat_1_V_Variant_Metadata_ToolCallResults_Value_Content"
VSCODE = Plugin("vscode", ("$mid",), ((_TOOL_RESULTS, "Children_1"), (_TOOL_RESULTS, "Children_2")), ("UserSelectedTools", "modelMetrics"), match=_by_mid)
COPILOT_CLI = Plugin("copilot-cli", record_hints=(RecordHint("modelMetrics", "ModelId"),), formats=(MODEL_ID,))
DEFAULT_PLUGINS = (VSCODE,)
PLUGINS = {p.name: p for p in (COPILOT_CLI, VSCODE)}


def plugins_by_name(names: Iterable[str]) -> tuple[Plugin, ...]:
    out = []
    for n in names:
        if n not in PLUGINS:
            raise ValueError(f'unknown plugin "{n}". Known built-ins: {", ".join(PLUGINS) or "(none)"}')
        out.append(PLUGINS[n])
    return tuple(out)


@dataclass(frozen=True)
class Options:
    """What a caller may set. Hints of plug-ins stand before the caller's own."""

    root_name: str = "Root"
    user_tag: str | None = None
    dedup_hints: tuple[tuple[str, str], ...] = ()
    record_hints: tuple = ()
    tag_hints: tuple[str, ...] = ()
    adapters: tuple | None = None
    plugins: tuple[Plugin, ...] = DEFAULT_PLUGINS
    formats: tuple[Format, ...] = ()
    parameters: Mapping[str, int] = field(default_factory=dict)
    header: str | None = None


@dataclass(frozen=True)
class Settings:
    """Options with the plug-ins' contributions and the defaults worked in."""

    options: Options
    context: Context
    dedup_hints: tuple[tuple[str, str], ...]
    record_hints: tuple[RecordHint, ...]
    tag_hints: tuple[str, ...]
    parameters: dict[str, int]


def settle(options: Options | None = None) -> Settings:
    options = options or Options()
    parameters: dict[str, int] = dict(PARAMETERS)
    # A later plug-in's format replaces an earlier one's of that name in its place.
    formats: dict[str, Format] = {}
    for plugin in options.plugins:
        formats |= {f.name: f for f in plugin.formats}
        try:
            parameters = with_parameters(parameters, plugin.parameters)
        except ValueError as e:
            raise ValueError(f'plugin "{plugin.name}": {e}') from e
    own: dict[str, Format] = {}
    for f in (*options.formats, *formats.values(), *FORMATS):
        own.setdefault(f.name, f)
    join = lambda what: tuple(dict.fromkeys(x for p in options.plugins for x in getattr(p, what)))
    hints = tuple(dict.fromkeys(RecordHint.of(h) for p in options.plugins for h in p.record_hints))
    return Settings(
        options,
        Context(tuple(own.values()), options.user_tag),
        (*join("dedup_hints"), *options.dedup_hints),
        (*hints, *map(RecordHint.of, options.record_hints)),
        (*join("tag_hints"), *options.tag_hints),
        with_parameters(parameters, options.parameters),
    )
