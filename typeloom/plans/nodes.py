"""Nodes of the type graph. Nodes are compared by identity: passes share and replace them."""

from __future__ import annotations

import json
from collections.abc import Iterator
from dataclasses import dataclass, field

from typeloom.functions.formats import BLOB_OVER, FORMATS, Format

# Keys whose values tell kinds of objects apart, by priority.
TAG_KEYS = ("type", "kind", "tag", "role", "$type", "$mid", "event", "op")
#: More literals than this make a plain type.
MOST_LITERALS = 64


@dataclass(frozen=True)
class Context:
    """What folding and rendering depend on besides the data."""

    formats: tuple[Format, ...] = FORMATS
    user_tag: str | None = None

    def is_tag(self, key: str) -> bool:
        return key in TAG_KEYS or key == self.user_tag


class Node:
    __slots__ = ("__weakref__",)

    def children(self) -> Iterator[tuple[str | None, Node]]:
        """(property key or None, node) of each child, in order."""
        return iter(())


class Never(Node):
    __slots__ = ()


class Anything(Node):
    __slots__ = ()


NEVER = Never()


@dataclass(eq=False, slots=True)
class TextFacts:
    """What is known of all strings of a place."""

    fits: dict[str, bool]
    evidence: dict[str, bool]
    shortest: int

    @classmethod
    def of(cls, text: str, size: int, formats) -> TextFacts:
        return cls({f.name: bool(f.test(text)) for f in formats}, {f.name: bool(f.evidence(text)) for f in formats if f.evidence}, size)

    def both(self, other: TextFacts) -> TextFacts:
        fits = {k: v and other.fits.get(k, True) for k, v in self.fits.items()}
        return TextFacts(fits, {k: v or other.evidence.get(k, False) for k, v in self.evidence.items()}, min(self.shortest, other.shortest))


@dataclass(eq=False, slots=True, weakref_slot=True)
class Scalar(Node):
    """Strings, numbers, booleans and nulls; words and numbers hold the literals of tags."""

    kinds: dict[str, None]
    words: dict[str, None] | None = None
    numbers: dict[float, None] | None = None
    text: TextFacts | None = None

    def literals(self) -> dict | None:
        return self.words if self.words is not None else self.numbers


@dataclass(eq=False, slots=True, weakref_slot=True)
class Listing(Node):
    item: Node

    def children(self):
        yield None, self.item


@dataclass(eq=False, slots=True)
class Property:
    node: Node
    present: int


@dataclass(eq=False, slots=True, weakref_slot=True)
class Shape(Node):
    """An object seen total times."""

    total: int
    properties: dict[str, Property] = field(default_factory=dict)

    def children(self):
        for key, p in self.properties.items():
            yield key, p.node

    def scalar_tag(self, key: str) -> Scalar | None:
        p = self.properties.get(key)
        return p.node if p is not None and isinstance(p.node, Scalar) else None

    def _always(self, key: str) -> dict | None:
        """The literals of a tag that every object has, all of one kind."""
        p = self.properties.get(key)
        if p is None or p.present != self.total or not isinstance(p.node, Scalar) or len(p.node.kinds) != 1:
            return None
        return p.node.words if "string" in p.node.kinds else p.node.numbers if "number" in p.node.kinds else None

    def tag_key(self) -> str | None:
        return next((k for k in TAG_KEYS if self._always(k)), None)

    def tag(self) -> tuple[str, str | float] | None:
        """The first tag with one literal only, as (key, value)."""
        for key in TAG_KEYS:
            found = self._always(key)
            if found and len(found) == 1:
                return key, next(iter(found))
        return None




@dataclass(eq=False, slots=True, weakref_slot=True)
class Mapping(Node):
    """A map from keys of a format to values of one type."""

    key: str
    value: Node

    def children(self):
        yield None, self.value


@dataclass(eq=False, slots=True, weakref_slot=True)
class Choice(Node):
    options: list[Node]

    def children(self):
        for option in self.options:
            yield None, option


# ---------------------------------------------------------------- transport


def encode(node: Node) -> str:
    """A tree (before passes share nodes) as JSON."""

    def plain(n: Node):
        match n:
            case Never():
                return ["n"]
            case Anything():
                return ["a"]
            case Scalar():
                t = n.text
                return ["s", list(n.kinds), None if n.words is None else list(n.words), None if n.numbers is None else list(n.numbers), None if t is None else [t.fits, t.evidence, t.shortest]]
            case Listing():
                return ["l", plain(n.item)]
            case Shape():
                return ["o", n.total, [[k, p.present, plain(p.node)] for k, p in n.properties.items()]]
            case Mapping():
                return ["m", n.key, plain(n.value)]
            case Choice():
                return ["c", [plain(o) for o in n.options]]

    return json.dumps(plain(node))


def structure(node: Node) -> str:
    """All that later folding and rendering depend on: a tree without its counts, and lengths as long or short."""

    def plain(n: Node):
        match n:
            case Scalar():
                t = n.text
                return ["s", sorted(n.kinds), None if n.words is None else sorted(n.words), None if n.numbers is None else sorted(n.numbers), None if t is None else [t.fits, t.evidence, t.shortest > BLOB_OVER]]
            case Listing():
                return ["l", plain(n.item)]
            case Shape():
                return ["o", [[k, p.present == n.total, plain(p.node)] for k, p in n.properties.items()]]
            case Mapping():
                return ["m", n.key, plain(n.value)]
            case Choice():
                return ["c", [plain(o) for o in n.options]]
        return [type(n).__name__]

    return json.dumps(plain(node))


def decode(text: str) -> Node:
    def node(x) -> Node:
        match x:
            case ["n"]:
                return NEVER
            case ["a"]:
                return Anything()
            case ["s", kinds, words, numbers, text]:
                return Scalar(dict.fromkeys(kinds), None if words is None else dict.fromkeys(words), None if numbers is None else dict.fromkeys(numbers), None if text is None else TextFacts(*text))
            case ["l", item]:
                return Listing(node(item))
            case ["o", total, properties]:
                return Shape(total, {k: Property(node(v), present) for k, present, v in properties})
            case ["m", key, value]:
                return Mapping(key, node(value))
            case ["c", options]:
                return Choice([node(o) for o in options])
        raise ValueError(f"not a node: {x!r}")

    return node(json.loads(text))


# ---------------------------------------------------------------- walks


def nodes_with_field(root: Node) -> Iterator[tuple[Node, str]]:
    """Each node once, parents first, with the property that it stands under."""
    stack: list[tuple[Node, str]] = [(root, "")]
    seen: set[Node] = set()
    while stack:
        node, under = stack.pop()
        if node in seen:
            continue
        seen.add(node)
        yield node, under
        stack.extend([(child, under if key is None else key) for key, child in node.children()][::-1])
