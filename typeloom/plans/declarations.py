"""Reading the declarations that typeloom writes (a narrow part of TypeScript's grammar)."""

from __future__ import annotations

import re
from dataclasses import dataclass

from typeloom.plans.fold import number_literal
from typeloom.plans.nodes import Anything, Choice, Listing, Mapping, Never, Node, Property, Scalar, Shape

TOKEN = re.compile(
    r"""(?P<skip>[ \t\n\r]+|//[^\n]*|/\*.*?(?:\*/|\Z))|(?P<text>"(?:\\.|[^"\\])*(?:"|\Z)|'(?:\\.|[^'\\])*(?:'|\Z))
    |(?P<number>-[0-9.]*|[0-9][0-9.]*)|(?P<name>[A-Za-z_$][A-Za-z0-9_$]*)|(?P<mark>[{}\[\]<>(),;:|&=?.])""",
    re.S | re.X,
)
ESCAPED = {"n": "\n", "t": "\t", "r": "\r"}
KEYWORDS = ("export", "type")


@dataclass(frozen=True)
class Token:
    kind: str
    text: str

    def __str__(self):
        return f"{self.kind} {self.text!r}"


def tokens(source: str) -> list[Token]:
    out, at = [], 0
    while at < len(source):
        m = TOKEN.match(source, at)
        if not m:
            raise ValueError(f"unexpected character {source[at]!r} at offset {at}")
        at = m.end()
        if m.lastgroup == "text":
            body = m[0][1:-1] if len(m[0]) > 1 and m[0][-1] == m[0][0] else m[0][1:]
            out.append(Token("text", re.sub(r"(?s)\\(.)", lambda e: ESCAPED.get(e[1], e[1]), body)))
        elif m.lastgroup != "skip":
            out.append(Token("keyword" if m[0] in KEYWORDS else m.lastgroup, m[0]))
    return out


class Reference(Node):
    """A name that isn't looked up yet."""

    __slots__ = ("name",)

    def __init__(self, name: str):
        self.name = name


def _plain(kind: str) -> Scalar:
    return Scalar({kind: None})


# Names of the grammar.
NAMES = {
    "string": lambda: _plain("string"), "number": lambda: _plain("number"), "boolean": lambda: _plain("boolean"), "null": lambda: _plain("null"),
    "true": lambda: _plain("boolean"), "false": lambda: _plain("boolean"), "never": Never, "unknown": Anything, "any": Anything,
}


class Reader:
    def __init__(self, source: str):
        self.left = tokens(source)[::-1]

    def _at(self, mark: str) -> bool:
        return bool(self.left) and self.left[-1] == Token("mark", mark)

    def _take(self, *wanted: Token, kind: str | None = None) -> Token:
        if not self.left:
            raise ValueError("unexpected end of declarations")
        token = self.left.pop()
        if wanted and token not in wanted or kind and token.kind != kind:
            raise ValueError(f"expected {kind or ' or '.join(map(str, wanted))}, got {token}")
        return token

    def _skip(self, *marks: str) -> bool:
        hit = any(map(self._at, marks))
        if hit:
            self.left.pop()
        return hit

    def declarations(self) -> dict[str, Node]:
        out = {}
        while self.left:
            for word in KEYWORDS:
                self._take(Token("keyword", word))
            name = self._take(kind="name").text
            self._take(Token("mark", "="))
            out.pop(name, None)
            out[name] = self.choice()
            self._skip(";")
        return out

    def choice(self) -> Node:
        self._skip("|")
        parts = [self.listing()]
        while self._skip("|"):
            parts.append(self.listing())
        return parts[0] if len(parts) == 1 else one_scalar(parts)

    def listing(self) -> Node:
        node = self.single()
        while self._skip("["):
            self._take(Token("mark", "]"))
            node = Listing(node)
        return node

    def single(self) -> Node:
        token = self._take()
        if token.kind == "text":
            return Scalar({"string": None}, words={token.text: None})
        if token.kind == "number":
            try:
                value = number_literal(token.text)
            except ValueError:
                value = float("nan")
            return Scalar({"number": None}, numbers={value: None})
        if token == Token("mark", "{"):
            return self.shape()
        if token == Token("mark", "("):
            inner = self.choice()
            self._take(Token("mark", ")"))
            return inner
        if token.kind != "name":
            raise ValueError(f"unexpected {token}")
        if token.text in NAMES:
            return NAMES[token.text]()
        if not self._skip("<"):
            return Reference(token.text)
        inside = [self.choice()]
        while self._skip(","):
            inside.append(self.choice())
        self._take(Token("mark", ">"))
        if token.text == "Array":
            return Listing(inside[0])
        if token.text == "Record" and len(inside) > 1:
            return Mapping(inside[0].name if isinstance(inside[0], Reference) else "string", inside[1])
        return Reference(token.text)

    def shape(self) -> Shape:
        out = Shape(1)
        while not self._skip("}"):
            key = self._take()
            if key.kind not in ("name", "keyword", "text"):
                raise ValueError(f"expected a key, got {key}")
            optional = self._skip("?")
            self._take(Token("mark", ":"))
            out.properties[key.text] = Property(self.choice(), 0 if optional else 1)
            self._skip(";", ",")
        return out


def one_scalar(parts: list[Node]) -> Node:
    """All scalars of a choice are one, in front."""
    scalars = [p for p in parts if isinstance(p, Scalar)]
    others = [p for p in parts if not isinstance(p, Scalar)]
    if scalars:
        union = lambda sets: {k: None for s in sets for k in s} if (sets := [s for s in sets if s is not None]) else None
        kinds = {k: None for s in scalars for k in s.kinds}
        others.insert(0, Scalar(kinds, union(s.words for s in scalars), union(s.numbers for s in scalars)))
    return others[0] if len(others) == 1 else Choice(others)


def resolved(named: dict[str, Node]) -> dict[str, Node]:
    """Each declaration with all names looked up. Unknown names and names inside themselves are unknown types.

    Every use is a copy of its own, as passes change nodes in place.
    """

    def look(node: Node, inside: frozenset[str]) -> Node:
        if isinstance(node, Reference):
            if node.name in inside or node.name not in named:
                return Anything()
            return look(named[node.name], inside | {node.name})
        if isinstance(node, Listing):
            return Listing(look(node.item, inside))
        if isinstance(node, Mapping):
            return Mapping(node.key, look(node.value, inside))
        if isinstance(node, Choice):
            return Choice([look(o, inside) for o in node.options])
        if isinstance(node, Shape):
            return Shape(node.total, {k: Property(look(p.node, inside), p.present) for k, p in node.properties.items()})
        if isinstance(node, Scalar):
            return Scalar(dict(node.kinds), node.words and dict(node.words), node.numbers and dict(node.numbers), node.text)
        return node

    return {name: look(node, frozenset([name])) for name, node in named.items()}


def read(source: str) -> dict[str, Node]:
    """Name to type of every declaration, in order; the last is the root by convention."""
    return resolved(Reader(source).declarations())


def root_of(source: str, name: str | None = None, strict: bool = True) -> tuple[str, Node]:
    named = read(source)
    if not named:
        raise ValueError("no `export type` declarations found")
    if name in named:
        return name, named[name]
    if name and strict:
        raise ValueError(f'root "{name}" not found')
    return list(named.items())[-1]
