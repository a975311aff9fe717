"""Folding of records into one type, in order.

The fold isn't associative: an option of a choice takes a record only if its properties
are admitted at that moment, by the policy of streams.
"""

from __future__ import annotations

from functools import reduce

from typeloom.functions.formats import utf16_length
from typeloom.plans.joining import Meeting, is_path_shape, mapping_and_shape, meeting
from typeloom.plans.nodes import NEVER, TAG_KEYS, Anything, Choice, Context, Listing, Mapping, Never, Node, Property, Scalar, Shape, TextFacts, structure
from typeloom.plans.policy import STREAM, Conditions

#: An object without properties, in a structure.
EMPTY_OBJECT = '["o", []]'


class Missing:
    """A hole of a sparse array."""


HOLE = Missing()


def number_literal(x) -> float | int:
    """A number as a double; whole ones print as integers."""
    f = float(x)
    return int(f) if f == f and abs(f) < 2**63 and f == int(f) else f


def entries(obj: dict) -> list[tuple[str, object]]:
    """Properties as JavaScript lists them: array indexes first, ascending."""
    index = sorted((k for k in obj if k.isascii() and k.isdigit() and (k == "0" or k[0] != "0") and int(k) < 2**32 - 1), key=int)
    if not index:
        return list(obj.items())
    first = set(index)
    return [(k, obj[k]) for k in index] + [(k, v) for k, v in obj.items() if k not in first]


class Folder:
    def __init__(self, context: Context | None = None, bounded: bool = True):
        self.context, self.bounded = context or Context(), bounded
        self.conditions = Conditions(self.context)
        self.admits, self.tagless = STREAM.compiled(self.conditions), self.conditions.untagged

    # ------------------------------------------------------------ one record

    def of(self, value, tagged: bool = False) -> Node:
        """The type of one JSON value."""
        if value is None:
            return Scalar({"null": None})
        if isinstance(value, bool):
            return Scalar({"boolean": None})
        if isinstance(value, str):
            facts = TextFacts.of(value, utf16_length(value), self.context.formats)
            return Scalar({"string": None}, words={value: None} if tagged else None, text=facts)
        if isinstance(value, int | float):
            return Scalar({"number": None}, numbers={number_literal(value): None} if tagged else None)
        if isinstance(value, list):
            item: Node = NEVER
            for x in value:
                item = self.join(item, self.of(x))
            return Listing(item)
        if isinstance(value, dict):
            return Shape(1, {k: Property(self.of(v, k in TAG_KEYS), 1) for k, v in entries(value)})
        return Anything()

    # ------------------------------------------------------------ joining

    def join(self, a: Node, b: Node) -> Node:
        """The type of what was a before, with b added; two that don't fit stand beside each other."""
        if (isinstance(a, Choice) or isinstance(b, Choice)) and not isinstance(a, Never | Anything) and not isinstance(b, Never | Anything):
            return self._chosen(a, b) if isinstance(a, Choice) else self._chosen(b, a)
        met = meeting(a, b, self.admits)
        if isinstance(met, Meeting):
            return met.build([self.join(x, y) for x, y in met.parts])
        if met is not None:
            return met
        if pair := mapping_and_shape(a, b):
            return self.absorb(*pair)
        return Choice([a, b])

    def _chosen(self, choice: Choice, extra: Node) -> Node:
        """A choice with extra (or each of its options) in the first option that admits it, or behind all."""
        now: Node = choice
        for new in extra.options if isinstance(extra, Choice) else (extra,):
            now = self._placed(now, new) if isinstance(now, Choice) else self.join(now, new)
        return now

    def _placed(self, choice: Choice, new: Node) -> Node:
        if isinstance(new, Never | Anything):
            return self.join(choice, new)
        for spot, option in enumerate(choice.options):
            if self.admits(option, new):
                both = self.join(option, new)
                options = list(choice.options)
                options[spot : spot + 1] = both.options if isinstance(both, Choice) else [both]
                return Choice(options) if len(options) > 1 else options[0]
        return choice if self._twice(choice, new) else Choice([*choice.options, new])

    def _twice(self, choice: Choice, extra: Node) -> bool:
        """Whether options of extra's structure stand there twice: a third prints the same and takes no record.

        Without this a null or a text beside objects would add an option with every record.
        """
        own = structure(extra) if self.bounded else EMPTY_OBJECT
        if EMPTY_OBJECT in own:  # empty objects in choices are all declared
            return False
        alike = (o for o in choice.options if type(o) is type(extra) and structure(o) == own)
        return next(alike, None) is not None and next(alike, None) is not None

    def absorb(self, mapping: Mapping, shape: Shape) -> Node:
        """A map takes an object whose keys all look like paths."""
        if not is_path_shape(shape):
            return Choice([mapping, shape])
        value = reduce(self.join, (p.node for p in shape.properties.values()), mapping.value)
        own = self.conditions.key_format(shape) if shape.properties else mapping.key
        return Mapping(own if own == mapping.key else "string", value)

    def fold(self, values, start: Node = NEVER) -> Node:
        for value in values:
            start = self.join(start, self.of(value))
        return start
