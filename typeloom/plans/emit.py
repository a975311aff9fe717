"""Writing a type graph as TypeScript declarations."""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field

from typeloom.functions.formats import BLOB_OVER, utf16_key
from typeloom.functions.naming import Place, is_identifier, number_text, pascal, not_a_digit, quoted
from typeloom.plans.nodes import Anything, Choice, Context, Listing, Mapping, Never, Node, Scalar, Shape

HEADER = "// Generated by typeloom. Changes made by hand will be lost.\n"
#: Stands for an object inside itself where no name is at hand.
AGAIN = "<again>"


def tag_text(shape: Shape) -> str | None:
    tag = shape.tag()
    return None if tag is None else tag[1] if isinstance(tag[1], str) else number_text(tag[1])


@dataclass
class Declaration:
    name: str
    body: str
    docs: list[str]


@dataclass(eq=False)
class Option:
    """An object that is an option of a choice, and where."""

    shape: Shape
    chain: str = ""
    leaf: str = ""
    field: str = ""
    shown: str = ""

    def prefix(self) -> str:
        return not_a_digit("_".join([*([pascal(self.field)] if self.field else []), pascal(self.leaf)]))


def options_of(root: Node, root_name: str) -> Iterator[Option]:
    """All objects that stand in choices, in the order of a walk; shared ones once for each choice."""
    seen: set[Node] = set()
    stack: list[tuple[Node, Place, bool]] = [(root, Place(root_name), False)]
    while stack:
        node, place, listed = stack.pop()
        if not listed:
            if node in seen:
                continue
            seen.add(node)
        if isinstance(node, Listing):
            below = [(node.item, place.item(), False)]
        elif isinstance(node, Mapping):
            below = [(node.value, place.value(), False)]
        elif isinstance(node, Shape):
            if listed:
                tag = tag_text(node)
                own = place.option(tag)
                yield Option(node, own.chain, "Variant" if tag is None else tag, place.field, own.shown)
                place = own
            below = [(child, place.property(key), False) for key, child in node.children()]
        elif isinstance(node, Choice):
            below = [(o, place, True) if isinstance(o, Shape) else (o, place.option(None), False) for o in node.options]
        else:
            continue
        stack.extend(below[::-1])


@dataclass
class Printer:
    """Renders nodes; collects the declarations and formats that they need."""

    context: Context
    promoted: dict[Node, None] = field(default_factory=dict)
    names: dict[Node, str] = field(default_factory=dict)
    used: set[str] = field(default_factory=set)
    declarations: list[Declaration] = field(default_factory=list)
    formats: set[str] = field(default_factory=set)
    _known: dict[Node, str] = field(default_factory=dict)
    _open: set[Node] = field(default_factory=set)

    def unique(self, base: str) -> str:
        name, n = base, 2
        while name in self.used:
            name, n = f"{base}_{n}", n + 1
        self.used.add(name)
        return name

    def show(self, node: Node, place: Place = Place()) -> str:
        if isinstance(node, Scalar):
            return " | ".join(self._scalar(node)) or "never"
        if isinstance(node, Listing):
            inner = self.show(node.item, place.item())
            return f"Array<{inner}>" if _is_compound(node.item) else f"{inner}[]"
        if isinstance(node, Mapping):
            inner = self.show(node.value, place.value())
            if node.key != "string":
                self.formats.add(node.key)
            return f"Record<{node.key}, {inner}>"
        if isinstance(node, Choice):
            parts = [self._named(o, place, False) if isinstance(o, Shape) else self.show(o, place.option(None)) for o in node.options]
            return " | ".join(dict.fromkeys(parts))
        if isinstance(node, Shape):
            return self._named(node, place, True) if node in self.promoted else self._body(node, place)
        return "never" if isinstance(node, Never) else "unknown"

    def _scalar(self, node: Scalar) -> Iterator[str]:
        if "string" in node.kinds:
            if node.words:
                yield from map(quoted, sorted(node.words, key=utf16_key))
            else:
                yield self._text(node)
        if "number" in node.kinds:
            if node.numbers:
                yield from map(number_text, sorted(node.numbers))
            else:
                yield "number"
        yield from (k for k in ("boolean", "null") if k in node.kinds)

    def _text(self, node: Scalar) -> str:
        """The format of strings that nothing but null stands beside."""
        facts = node.text
        if facts is None or node.kinds.keys() & {"number", "boolean"}:
            return "string"
        fit = (f.name for f in self.context.formats if facts.fits.get(f.name) and (not f.evidence or facts.evidence.get(f.name)))
        name = next(fit, "Blob" if facts.shortest > BLOB_OVER else "string")
        if name != "string":
            self.formats.add(name)
        return name

    def _named(self, shape: Shape, place: Place, outside: bool) -> str:
        """The name of an object's declaration, which is made at its first use. outside: not in a choice."""
        if shape not in self._known:
            given, tag = self.names.get(shape), tag_text(shape)
            name = self._known[shape] = self.unique(given or place.option_name(tag))
            own = place.option(None if outside and given else tag)
            body = self._body(shape, own)
            self.declarations.append(Declaration(name, body, [own.shown] if own.shown else []))
        return self._known[shape]

    def _body(self, shape: Shape, place: Place) -> str:
        if not shape.properties:
            return "Record<string, unknown>"
        if shape in self._open and shape not in self._known:
            return AGAIN
        self._open.add(shape)
        lines = ["{"]
        for key in sorted(shape.properties, key=utf16_key):
            p = shape.properties[key]
            label = (key if is_identifier(key) else quoted(key)) + ("?" if p.present < shape.total else "")
            lines.append(f"{label}: {self.show(p.node, place.property(key))};".replace("\n", "\n  "))
        self._open.discard(shape)
        return "\n  ".join(lines) + "\n}"


def _is_compound(node: Node) -> bool:
    if isinstance(node, Scalar):
        return len(node.kinds) + len(node.words or ()) + len(node.numbers or ()) > 1
    return isinstance(node, Choice)


class Signatures:
    """What each node looks like when first asked for; later changes don't show."""

    def __init__(self, context: Context):
        self.context, self.known = context, {}

    def __call__(self, node: Node) -> str:
        if node not in self.known:
            self.known[node] = Printer(self.context).show(node)
        return self.known[node]


# ---------------------------------------------------------------- the document


def merge_twins(declarations: Iterable[Declaration], root: str) -> tuple[list[Declaration], str]:
    """Declarations of one name but for the hash and of one body become the one of the smallest hash."""
    left = list(declarations)
    while True:
        groups: dict[tuple[str, str], list[Declaration]] = {}
        for d in left:
            if m := re.fullmatch("(?s)(.*)_([0-9a-f]{8})", d.name):
                groups.setdefault((m[1], d.body), []).append(d)
        rename: dict[str, str] = {}
        for group in groups.values():
            first, *others = sorted(group, key=lambda d: d.name[-8:])
            if others:
                first.docs = list(dict.fromkeys(doc for d in (first, *others) for doc in d.docs))
                rename |= {d.name: first.name for d in others}
        if not rename:
            return left, root
        names = re.compile(rf"(?<!\w)({'|'.join(map(re.escape, rename))})(?!\w)", re.ASCII)
        swap = lambda text: names.sub(lambda m: rename[m[1]], text)
        left = [Declaration(d.name, swap(d.body), d.docs) for d in left if d.name not in rename]
        root = swap(root)


def comment(docs: list[str]) -> str:
    if len(docs) < 2:
        return "".join(f"/** {d} */\n" for d in docs)
    return "".join(["/**\n", *(f" * {d}\n" for d in docs), " */\n"])


@dataclass
class Document:
    """formats, then the declarations, then the root, as text or as rows."""

    root_name: str
    root: str
    declarations: list[Declaration]
    formats: list[str]
    header: str = HEADER

    def rows(self) -> list[tuple[int, str, str, list[str]]]:
        named = [(f, "string", []) for f in self.formats] + [(d.name, d.body, d.docs) for d in self.declarations] + [(self.root_name, self.root, [])]
        return [(i, *x) for i, x in enumerate(named)]

    def text(self) -> str:
        blocks = ["\n".join(f"export type {f} = string;" for f in self.formats)] if self.formats else []
        blocks += [f"{comment(d.docs)}export type {d.name} = {d.body};" for d in self.declarations]
        return self.header + "\n\n".join([*blocks, f"export type {self.root_name} = {self.root};\n"])


def document(root: Node, root_name: str, context: Context, promoted: dict[Node, None], names: dict[Node, str], header: str | None = None) -> Document:
    printer = Printer(context, promoted, names, {root_name})
    text = printer.show(root, Place(root_name))
    declarations, text = merge_twins(printer.declarations, text)
    formats = [name for name in dict.fromkeys([*(f.name for f in context.formats), "Blob"]) if name in printer.formats]
    return Document(root_name, text, declarations, formats, HEADER if header is None else header)
