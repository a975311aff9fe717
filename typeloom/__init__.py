"""Spark-native structural type inference, profiling and validation for JSON records."""

import sys

from pyspark import cloudpickle

# Functions of this package travel to executors with their code, so a cluster needs no installed copy.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

#: Public names and the modules that hold them; loaded when they are asked for.
_EXPORTS = {
    "infer_values": "typeloom.api",
    "infer_text": "typeloom.api",
    "infer_frame": "typeloom.operators.infer",
    "infer_files": "typeloom.operators.infer",
    "infer_lines": "typeloom.operators.infer",
    "simplify_text": "typeloom.operators.infer",
    "check_lines": "typeloom.operators.check",
    "check_files": "typeloom.operators.check",
    "parse_declarations": "typeloom.plans.declarations",
    "Options": "typeloom.plans.settings",
    "Plugin": "typeloom.plans.settings",
    "RecordHint": "typeloom.plans.settings",
    "Format": "typeloom.functions.formats",
    "Policy": "typeloom.plans.policy",
    "LiveType": "typeloom.streaming.live",
}
__all__ = list(_EXPORTS)


def __getattr__(name: str):
    from importlib import import_module

    if name not in _EXPORTS:
        raise AttributeError(f"module {__name__!r} has no attribute {name!r}")
    return getattr(import_module(_EXPORTS[name]), "read" if name == "parse_declarations" else name)
