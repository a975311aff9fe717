"""Simplification of a type graph: eleven phases, of which four repeat until nothing changes.

A phase looks at the graph and says what nodes become, which objects get declarations of
their own, and under which names. Phases change the objects that others become in place.
"""

from __future__ import annotations

import sys
import time
from collections.abc import Callable, Iterable
from dataclasses import dataclass, field

from typeloom.functions.formats import common_format, utf16_key
from typeloom.functions.naming import Place, not_a_digit, number_text, pascal, short_hash
from typeloom.plans.emit import Option, Signatures, options_of, tag_text
from typeloom.plans.fold import Folder
from typeloom.plans.joining import join_scalars
from typeloom.plans.nodes import NEVER, TAG_KEYS, Choice, Listing, Mapping, Node, Scalar, Shape, nodes_with_field
from typeloom.plans.settings import Settings
from typeloom.plans.policy import overlap
from typeloom.plans.unite import AMONG_INLINE, BY_HINT, INTO_NAMED, SAME_KEYS, WHOLE, Uniter, linked_groups, replaced


@dataclass
class Found:
    """What a phase found."""

    becomes: dict[Node, Node] = field(default_factory=dict)
    declared: dict[Node, None] = field(default_factory=dict)
    names: dict[Node, str] = field(default_factory=dict)
    root: Node | None = None


@dataclass(frozen=True)
class TraceRow:
    round: int
    phase: str
    ms: float
    rewrites: int
    declared: int
    new_root: bool


def value_text(x) -> str:
    return x if isinstance(x, str) else number_text(x)


def grouped(pairs: Iterable[tuple[object, object]]) -> dict:
    out: dict = {}
    for key, value in pairs:
        if key is not None:
            out.setdefault(key, []).append(value)
    return out


class Simplifier:
    def __init__(self, root: Node, settings: Settings):
        self.settings = settings
        self.root = root
        self.root_name = settings.options.root_name
        self.declared: dict[Node, None] = {}
        self.names: dict[Node, str] = {}
        self.trace: list[TraceRow] = []
        self.folder = Folder(settings.context)
        self.signature = Signatures(settings.context)
        self.uniter = Uniter(self.folder, self.signature)

    # ------------------------------------------------------------ the run

    def run(self) -> Simplifier:
        for phase in PHASES:
            self._do(phase, 0)
        cap = self.settings.parameters["pipeline.convergence-cap"]
        for turn in range(1, cap + 1):
            if not any([self._do(phase, turn) for phase in PHASES if phase.repeats]):
                break
        else:
            print(f"[simplify] not settled after {cap} rounds", file=sys.stderr)
        self._name_bare_cycles()
        return self

    def _do(self, phase: Phase, turn: int) -> bool:
        began = time.perf_counter()
        found = phase.look(self)
        new_root = found.root is not None and found.root is not self.root
        if found.root is not None:
            self.root = found.root
        if found.becomes:
            self.root = replaced(self.root, found.becomes)
        new = [n for n in found.declared if n not in self.declared]
        self.declared |= dict.fromkeys(new)
        self.names |= found.names
        if phase.prunes:
            for old, now in found.becomes.items():
                self.declared.pop(old, None)
                if name := self.names.pop(old, None):
                    self.names.setdefault(now, name)
        self.trace.append(TraceRow(turn, phase.name, round(1000 * (time.perf_counter() - began), 2), len(found.becomes), len(new), new_root))
        return bool(found.becomes or new or new_root)

    def _options(self) -> list[Option]:
        return list(options_of(self.root, self.root_name))

    def _name_bare_cycles(self) -> None:
        """Declare objects that hold themselves without a choice or a declaration in between."""
        done: set[Node] = set()
        trail: dict[Node, None] = {}

        def visit(top: Node) -> None:
            stack: list[tuple[Node, bool]] = [(top, False)]
            while stack:
                node, leave = stack.pop()
                if leave:
                    trail.pop(node, None)
                    done.add(node)
                elif node in trail:
                    shape = node if isinstance(node, Shape) else next((n for n in list(trail)[list(trail).index(node) :] if isinstance(n, Shape)), None)
                    if shape is not None:
                        self.declared[shape] = None
                elif node not in done:
                    trail[node] = None
                    stack.append((node, True))
                    for _, child in node.children():
                        if not (isinstance(node, Choice) and isinstance(child, Shape)) and child not in self.declared:
                            stack.append((child, False))

        visit(self.root)
        for node in [n for n, _ in nodes_with_field(self.root) if isinstance(n, Shape)]:
            if node not in done:
                visit(node)

    # ------------------------------------------------------------ phases

    def maps(self) -> Found:
        """Objects whose keys share a format, or that a hint names, become maps."""
        out = Found()
        seen: set[Node] = set()

        def hinted(place: Place) -> str | None:
            last = place.chain.rsplit("_", 1)[-1]
            for hint in self.settings.record_hints:
                if place.field == hint.field or pascal(hint.field) in (pascal(place.field), last):
                    return hint.key
            return None

        stack: list[tuple[Node, Place, bool]] = [(self.root, Place(self.root_name), False)]
        while stack:
            node, place, after = stack.pop()
            if after:
                key = hinted(place)
                if key is None:
                    key = common_format(node.properties, self.settings.context.formats)
                    if key == "string":
                        continue
                value: Node = NEVER
                for _, child in node.children():
                    value = self.folder.join(value, child)
                out.becomes[node] = Mapping(key, value)
                continue
            if node in seen:
                continue
            seen.add(node)
            if isinstance(node, Shape) and node.properties:
                stack.append((node, place, True))
            below = []
            for key, child in node.children():
                if isinstance(node, Shape):
                    own = place.property(key)
                elif isinstance(node, Choice):
                    own = place.option(tag_text(child) if isinstance(child, Shape) else None)
                else:
                    own = place.item() if isinstance(node, Listing) else place.value()
                below.append((child, own, False))
            stack.extend(below[::-1])
        return out

    def hinted_options(self) -> Found:
        """Options under a hinted place that share keys become one."""
        out = Found()
        options = self._options()
        for scope, prefix in self.settings.dedup_hints:
            some = [o for o in options if o.chain.startswith(scope) and o.prefix() == prefix]
            for group in linked_groups(len(some), lambda a, b: overlap(some[a].shape, some[b].shape) > 0):
                self.uniter.unite([some[i] for i in group], WHOLE, out.becomes)
        return out

    def nested_options(self) -> Found:
        """Options of one field and tag that lie within each other become one."""
        out = Found()
        by_tag = grouped(((o.field, tag[0], value_text(tag[1])) if (tag := o.shape.tag()) else None, o) for o in self._options())
        for group in by_tag.values():
            if len(group) < 2:
                continue
            below = [{n for _, child in o.shape.children() for n, _ in nodes_with_field(child)} for o in group]
            for o, nodes in zip(group, below):
                nodes.discard(o.shape)
            inside = lambda a, b: group[b].shape in below[a] or group[a].shape in below[b]
            for part in linked_groups(len(group), inside):
                self.uniter.unite([group[i] for i in part], WHOLE, out.becomes)
        return out

    def _by_literal(self, keys: Iterable[str], with_field: bool) -> dict:
        """Objects with one literal at the first of keys that has one, by field (if asked for), key and value."""

        def mark(node: Node, under: str):
            if isinstance(node, Shape):
                for key in keys:
                    tag = node.scalar_tag(key)
                    values = list((tag.literals() if tag is not None else None) or ())
                    if len(values) == 1:
                        return (under if with_field else None, key, value_text(values[0]))
            return None

        return grouped((mark(n, under), Option(n, field=under)) for n, under in nodes_with_field(self.root))

    def field_tags(self) -> Found:
        """Tagged objects of one field and tag become one if they are alike."""
        out = Found()
        for group in self._by_literal(TAG_KEYS, True).values():
            self.uniter.unite(group, AMONG_INLINE, out.becomes)
        return out

    def tag_hints(self) -> Found:
        """All objects of one value of a hinted tag become one declaration."""
        out = Found()
        for (_, key, value), group in self._by_literal(dict.fromkeys(self.settings.tag_hints), False).items():
            main = group[0] if len(group) == 1 else self.uniter.unite(group, BY_HINT, out.becomes)
            if main:
                out.declared[main.shape] = None
                out.names[main.shape] = not_a_digit(f"{key}_{value}_{short_hash(f'{key}\0{value}')}")
        return out

    def inline_tags(self) -> Found:
        """Tagged objects outside choices join the option of their tag, or each other."""
        out = Found()
        named: dict = {}
        options = self._options()
        mark = lambda shape: (tag[0], value_text(tag[1])) if (tag := shape.tag()) else None
        for o in options:
            named.setdefault(mark(o.shape), o)
        inside = {o.shape for o in options}
        loose = [n for n, _ in nodes_with_field(self.root) if isinstance(n, Shape) and n not in inside and n.tag()]
        rest = []
        for shape in loose:
            if shape in out.becomes:
                continue
            key = mark(shape)
            if key in named:
                self.uniter.unite([named[key], Option(shape)], INTO_NAMED, out.becomes)
            else:
                rest.append((key, Option(shape)))
        for group in grouped(rest).values():
            if main := self.uniter.unite(group, AMONG_INLINE, out.becomes):
                out.declared[main.shape] = None
        return out

    def inline_keys(self) -> Found:
        """Untagged objects of the same keys become one declaration if their types match."""
        out = Found()
        inside = {o.shape for o in self._options()}
        plain = [(n, under) for n, under in nodes_with_field(self.root) if isinstance(n, Shape) and len(n.properties) > 1 and self.folder.tagless(n)]
        by_keys = grouped(("\0".join(sorted(n.properties, key=utf16_key)), Option(n, field=under)) for n, under in plain)
        for keys, group in by_keys.items():
            main = self.uniter.unite(group, SAME_KEYS, out.becomes)
            if main and main.shape not in inside:
                out.declared[main.shape] = None
                out.names[main.shape] = not_a_digit("_".join([*([pascal(main.field)] if main.field else []), "Type", short_hash(keys)]))
        return out

    def equal_objects(self) -> Found:
        """Objects that look the same become one, a declared one if there is one."""
        out = Found()
        objects = dict.fromkeys(n for n, _ in nodes_with_field(self.root) if isinstance(n, Shape) and n.properties)
        objects |= {n: None for n in self.declared if n not in objects}
        for group in grouped((self.signature(n), n) for n in objects).values():
            main = next((n for n in group if n in self.declared), group[0])
            out.becomes |= {n: main for n in group if n is not main}
        return out

    def equal_options(self) -> Found:
        """Options (and declared objects) of one tag and the same keys become one, over and over."""
        out = Found(root=self.root)
        for _ in range(self.settings.parameters["structural-dedupe.max-passes"]):
            shapes = dict.fromkeys(o.shape for o in options_of(out.root, self.root_name)) | self.declared
            mark = lambda s: (tag[0], value_text(tag[1]), ",".join(sorted(s.properties, key=utf16_key))) if (tag := s.tag()) else None
            step: dict[Node, Node] = {}
            for group in grouped((mark(s), s) for s in shapes).values():
                main = group[0]
                for other in group[1:]:
                    for key, p in main.properties.items():
                        p.node = self._either(p.node, other.properties[key].node, out.becomes)
                        p.present += other.properties[key].present
                    main.total += other.total
                    step[other] = main
            if not step:
                break
            out.becomes |= step
            out.root = replaced(out.root, step)
        return out

    def _either(self, a: Node, b: Node, becomes: dict[Node, Node]) -> Node:
        """One type of two, without going into them."""
        if a is b:
            return a
        if isinstance(a, Scalar) and isinstance(b, Scalar):
            return join_scalars(a, b)
        flat = list(dict.fromkeys(o for n in (a, b) for o in _flat(n)))
        kept: dict[str, Node] = {}
        for node in flat:
            if kept.setdefault(self.signature(node), node) is not node:
                becomes[node] = kept[self.signature(node)]
        options = list(kept.values())
        return options[0] if len(options) == 1 else Choice(options)

    def shared_objects(self) -> Found:
        """Objects that several places refer to get declarations."""
        out = Found()
        tagged = {o.shape for o in options_of(self.root, "Root") if o.leaf != "Variant"}
        uses: dict[Node, int] = {self.root: 1} if isinstance(self.root, Shape) else {}
        under: dict[Node, str] = {}
        for node, place in nodes_with_field(self.root):
            for key, child in node.children():
                if isinstance(child, Shape):
                    uses[child] = uses.get(child, 0) + 1
                    if where := key or place:
                        under.setdefault(child, where)
        least_uses, least_keys = (self.settings.parameters[f"hoist-shared.min-{k}"] for k in ("refs", "keys"))
        some = [n for n, _ in nodes_with_field(self.root) if n in uses and uses[n] >= least_uses and len(n.properties) >= least_keys and n not in self.declared and n not in tagged]
        used: set[str] = set()
        for node in sorted(some, key=lambda n: (-uses[n], self.signature(n))):
            base = "_".join([*([pascal(under[node])] if node in under else []), "Shared", short_hash(self.signature(node))])
            name, n = not_a_digit(base), 2
            while name in used:
                name, n = f"{base}_{n}", n + 1
            used.add(name)
            out.declared[node] = None
            out.names[node] = name
        return out

    def plugin_names(self) -> Found:
        out = Found()
        for node, under in nodes_with_field(self.root):
            if isinstance(node, Shape):
                match = next((m for p in self.settings.options.plugins if p.match and (m := p.match(node, under))), None)
                if match and match.declare:
                    out.declared[node] = None
                if match and match.name:
                    out.names[node] = match.name
        return out


def _flat(node: Node) -> Iterable[Node]:
    return [x for o in node.options for x in _flat(o)] if isinstance(node, Choice) else [node]


@dataclass(frozen=True)
class Phase:
    """prunes: what becomes something else loses its declaration. repeats: until nothing changes."""

    name: str
    look: Callable[[Simplifier], Found]
    repeats: bool = False
    prunes: bool = False


PHASES = (
    Phase("recordify", Simplifier.maps),
    Phase("hint-dedup", Simplifier.hinted_options),
    Phase("auto-recursive", Simplifier.nested_options),
    Phase("field-tag", Simplifier.field_tags),
    Phase("tag-hints", Simplifier.tag_hints),
    Phase("inline-unify", Simplifier.inline_tags, repeats=True),
    Phase("inline-samekeys", Simplifier.inline_keys, repeats=True),
    Phase("inline-equivalent", Simplifier.equal_objects, repeats=True, prunes=True),
    Phase("structural-dedupe", Simplifier.equal_options, repeats=True, prunes=True),
    Phase("hoist-shared", Simplifier.shared_objects),
    Phase("apply-plugins", Simplifier.plugin_names),
)
