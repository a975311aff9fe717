"""Types of values in memory, without Spark."""

from __future__ import annotations

from collections.abc import Iterable

from typeloom.plans.emit import Document, document
from typeloom.plans.fold import Folder
from typeloom.plans.nodes import Node
from typeloom.plans.settings import Options, Settings, settle
from typeloom.plans.simplify import Simplifier
from typeloom.sources.records import ADAPTERS, TRIM, node_of_records, parse


def finish(root: Node, settings: Settings) -> tuple[Document, Simplifier]:
    """Simplify a type and write it down."""
    done = Simplifier(root, settings).run()
    o = settings.options
    return document(done.root, o.root_name, settings.context, done.declared, done.names, o.header), done


def infer_values(values: Iterable, options: Options | None = None) -> str:
    """Declarations of parsed JSON values; no adapters."""
    settings = settle(options)
    return finish(Folder(settings.context).fold(values), settings)[0].text()


def infer_text(jsonl: str, options: Options | None = None) -> str:
    """Declarations of the lines of a text, as of one file."""
    settings = settle(options)
    records = []
    for line in jsonl.split("\n"):
        if line := line.strip(TRIM):
            try:
                records.append(parse(line))
            except ValueError:
                continue
    adapters = ADAPTERS if settings.options.adapters is None else settings.options.adapters
    return finish(node_of_records(records, Folder(settings.context), adapters), settings)[0].text()
