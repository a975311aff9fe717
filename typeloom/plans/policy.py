"""Which objects may become one, as values: a policy admits a pair if all conditions of one of its rules hold.

A condition is a word, or a word and a number ("overlap-min 3"). Pairs that aren't two
objects meet no gate but "any" and every likeness.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from typeloom.functions.formats import common_format
from typeloom.plans.nodes import TAG_KEYS, Context, Node, Shape

Test = Callable[[Node, Node], bool]


def subset_keys(a: Shape, b: Shape) -> bool:
    small, large = sorted((a.properties.keys(), b.properties.keys()), key=len)
    return small <= large


def overlap(a: Shape, b: Shape) -> int:
    return len(a.properties.keys() & b.properties.keys())


def same_tags(a: Shape, b: Shape) -> bool:
    """Whether the literals of every tag key overlap, where either side has some."""
    told = lambda side, key: s.literals() if (s := side.scalar_tag(key)) is not None else None
    pairs = ((told(a, key), told(b, key)) for key in TAG_KEYS)
    return all(x is not None and y is not None and not x.keys().isdisjoint(y) for x, y in pairs if x is not None or y is not None)


class Conditions:
    """The words that rules are made of."""

    def __init__(self, context: Context, types_match: Test | None = None):
        self.context, self.types_match = context, types_match

    def untagged(self, shape: Shape) -> bool:
        return not any(map(self.context.is_tag, shape.properties))

    def key_format(self, shape: Shape) -> str:
        return common_format(shape.properties, self.context.formats)

    def _same_format(self, a: Shape, b: Shape) -> bool:
        return bool(a.properties and b.properties) and "string" != self.key_format(a) == self.key_format(b)

    def _strict(self, a: Shape, b: Shape) -> bool:
        return a.tag() is not None and a.tag() == b.tag()

    #: Gates ask for two objects; for likenesses anything else is alike.
    GATES = {"tag-strict", "tag-present", "tag-loose", "no-tag"}

    def test(self, words: str) -> Test:
        word, _, number = words.partition(" ")
        n = int(number) if number else 0
        both = lambda side: lambda a, b: side(a) and side(b)
        known: dict[str, Test] = {
            "any": lambda a, b: True,
            "name-prefix": lambda a, b: True,
            "nullable-compat": lambda a, b: False,
            "tag-strict": self._strict,
            "tag-present": lambda a, b: a.tag_key() is not None and b.tag_key() is not None and same_tags(a, b),
            "tag-loose": lambda a, b: same_tags(a, b),
            "no-tag": both(self.untagged),
            "same-keys": lambda a, b: a.properties.keys() == b.properties.keys(),
            "subset-keys": subset_keys,
            "alias-keys-compat": self._same_format,
            "overlap-min": lambda a, b: overlap(a, b) >= n,
            "keys-lt": both(lambda s: len(s.properties) < n),
            "keys-gt": both(lambda s: len(s.properties) > n),
            "types-match": self.types_match or (lambda a, b: False),
        }
        if word not in known:
            raise ValueError(f"unknown condition {word!r}")
        told = known[word]
        if word in ("any", "name-prefix", "nullable-compat", "types-match"):
            return told
        otherwise = word not in self.GATES
        return lambda a, b: told(a, b) if isinstance(a, Shape) and isinstance(b, Shape) else otherwise


@dataclass(frozen=True)
class Policy:
    """rules: each a text of conditions joined by " and "."""

    rules: tuple[str, ...] = ("any",)

    def compiled(self, conditions: Conditions) -> Test:
        rules = [[conditions.test(words) for words in rule.split(" and ")] for rule in self.rules]
        return lambda a, b: any(all(test(a, b) for test in rule) for rule in rules)


#: Records of one stream; tagged kinds; objects of the same keys.
STREAM = Policy(("tag-present", "no-tag and subset-keys", "no-tag and alias-keys-compat"))
ALIKE = Policy(("tag-loose and overlap-min 3", "tag-loose and keys-lt 5 and subset-keys and overlap-min 2"))
TWINS = Policy(("keys-gt 3 and same-keys and no-tag and types-match",))
