"""How two types become one, apart from who asks.

meeting() says what a pair comes to: a finished node, nothing (the two don't fit), or the
parts that have to be joined first and what is built of them. The fold and the passes join
the parts each in their own way.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from typeloom.functions.formats import is_path_key
from typeloom.plans.nodes import MOST_LITERALS, Anything, Listing, Mapping, Never, Node, Property, Scalar, Shape
from typeloom.plans.policy import Test


@dataclass(frozen=True)
class Meeting:
    parts: list[tuple[Node, Node]]
    build: Callable[[list[Node]], Node]


def _literals(a: dict | None, b: dict | None) -> dict | None:
    both = {**(a or {}), **(b or {})}
    return None if a is b is None or len(both) > MOST_LITERALS else both


def join_scalars(a: Scalar, b: Scalar) -> Scalar:
    text = a.text.both(b.text) if a.text and b.text else a.text or b.text
    return Scalar({**a.kinds, **b.kinds}, _literals(a.words, b.words), _literals(a.numbers, b.numbers), text)


def _listings(a: Listing, b: Listing) -> Meeting:
    return Meeting([(a.item, b.item)], lambda joined: Listing(joined[0]))


def _mappings(a: Mapping, b: Mapping) -> Meeting:
    return Meeting([(a.value, b.value)], lambda joined: Mapping(a.key if a.key == b.key else "string", joined[0]))


def _shapes(a: Shape, b: Shape) -> Meeting:
    shared = [k for k in a.properties if k in b.properties]

    def build(joined: list[Node]) -> Shape:
        out = Shape(a.total + b.total, {k: Property(p.node, p.present) for k, p in a.properties.items()})
        for k, node in zip(shared, joined):
            out.properties[k] = Property(node, a.properties[k].present + b.properties[k].present)
        out.properties |= {k: Property(p.node, p.present) for k, p in b.properties.items() if k not in out.properties}
        return out

    return Meeting([(a.properties[k].node, b.properties[k].node) for k in shared], build)


def meeting(a: Node, b: Node, admits: Test) -> Meeting | Node | None:
    """What two types that aren't choices come to."""
    for one, other in ((a, b), (b, a)):
        if isinstance(one, Never):
            return other
    if isinstance(a, Anything) or isinstance(b, Anything):
        return Anything()
    if type(a) is not type(b):
        return None
    match a:
        case Scalar():
            return join_scalars(a, b)
        case Listing():
            return _listings(a, b)
        case Mapping():
            return _mappings(a, b)
        case Shape():
            return _shapes(a, b) if admits(a, b) else None
    return None


def mapping_and_shape(a: Node, b: Node) -> tuple[Mapping, Shape] | None:
    """The two in this order, if they are a map and an object."""
    pair = (a, b) if isinstance(a, Mapping) else (b, a)
    return pair if isinstance(pair[0], Mapping) and isinstance(pair[1], Shape) else None


def is_path_shape(shape: Shape) -> bool:
    return all(map(is_path_key, shape.properties))
