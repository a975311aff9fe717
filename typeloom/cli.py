"""python -m typeloom gen | check | simplify"""

from __future__ import annotations

import argparse
import sys
from dataclasses import replace
from pathlib import Path

from typeloom.plans.settings import PARAMETERS, Options, RecordHint, parse_parameter
from typeloom.sources import manifest


def _pair(text: str) -> tuple[str, str]:
    scope, colon, name = text.partition(":")
    if not colon:
        raise argparse.ArgumentTypeError("expected SCOPE:NAME")
    return scope, name


def _record(text: str) -> RecordHint:
    name, equals, key = text.partition("=")
    return RecordHint(name, key) if equals else RecordHint(name)


def _parameter(text: str) -> tuple[str, int]:
    try:
        return parse_parameter(text)
    except ValueError as e:
        raise argparse.ArgumentTypeError(str(e)) from e


def parser() -> argparse.ArgumentParser:
    top = argparse.ArgumentParser(prog="typeloom", description="Types of JSON lines, with Spark.", allow_abbrev=False)
    modes = top.add_subparsers(dest="mode", required=True)
    gen = modes.add_parser("gen", help="declarations of files, of - (standard input), or of a manifest's targets", allow_abbrev=False)
    gen.add_argument("files", nargs="*")
    gen.add_argument("--name", "--root-name", dest="root_name")
    gen.add_argument("--out")
    gen.add_argument("--tag")
    gen.add_argument("--dedup-hint", type=_pair, action="append")
    gen.add_argument("--record-hint", "--hint", type=_record, action="append")
    gen.add_argument("--tag-hint", "--multi-tag", action="append")
    gen.add_argument("--no-adapters", action="store_true")
    gen.add_argument("--no-plugins", action="store_true")
    gen.add_argument("--trace-pipeline", action="store_true")
    check = modes.add_parser("check", help="check files against declarations", allow_abbrev=False)
    check.add_argument("files", nargs="*")
    check.add_argument("--schema")
    check.add_argument("--root")
    check.add_argument("--detail", action="store_true")
    simplify = modes.add_parser("simplify", help="simplify declarations", allow_abbrev=False)
    simplify.add_argument("--in", dest="source", required=True)
    simplify.add_argument("--out")
    simplify.add_argument("--name", dest="root_name")
    for mode in (gen, check, simplify):
        mode.add_argument("--param", type=_parameter, action="append", default=[], metavar="KEY=VALUE", help=", ".join(PARAMETERS))
    for mode in (gen, check):
        mode.add_argument("--manifest", "--config")
        mode.add_argument("--quiet", action="store_true")
    return top


def _merged(base: Options, args) -> Options:
    """Hints of the command line replace a target's; parameters are added to them."""
    given = {"root_name": args.root_name, "user_tag": args.tag, "dedup_hints": args.dedup_hint, "record_hints": args.record_hint, "tag_hints": args.tag_hint}
    own: dict = {k: tuple(v) if isinstance(v, list) else v for k, v in given.items() if v is not None}
    if args.no_adapters:
        own["adapters"] = ()
    if args.no_plugins:
        own["plugins"] = ()
    return replace(base, parameters={**base.parameters, **dict(args.param)}, **own)


def _write(text: str, out: str | None) -> None:
    if out:
        Path(out).write_text(text, encoding="utf-8")
    else:
        sys.stdout.write(text)


def _session():
    from pyspark.sql import SparkSession

    spark = SparkSession.builder.appName("typeloom").config("spark.ui.showConsoleProgress", "false").getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def _targets(args) -> tuple[str, list[manifest.Target]]:
    path = args.manifest or manifest.find()
    if not path:
        raise ValueError("no files are given and there is no manifest")
    return path, manifest.load(path)


def _gen(args) -> int:
    from typeloom.operators.infer import infer_lines
    from typeloom.sources.jsonl import expand, read_lines

    def one(patterns: list[str], options: Options) -> str:
        files = expand(patterns)
        if not files:
            raise ValueError("no input files matched")
        doc, done, counts = infer_lines(read_lines(_session(), files), options)
        if not args.quiet:
            for i, f in enumerate(files):
                print(f"[{f}] processed {counts[i]} records", file=sys.stderr)
        if args.trace_pipeline:
            for t in done.trace:
                print(f"[pipeline] {t.round or 'init':<5} {t.phase:<20} {t.ms:>8} {t.rewrites:>8} {t.declared:>7}  {'swap' if t.new_root else '.'}", file=sys.stderr)
        return doc.text()

    if args.files == ["-"]:
        from typeloom.api import infer_text

        _write(infer_text(sys.stdin.read(), _merged(Options(), args)), args.out)
    elif args.files:
        _write(one(args.files, _merged(Options(), args)), args.out)
    else:
        path, targets = _targets(args)
        for target in targets:
            inputs, output = target.paths(path)
            _write(one(inputs, _merged(target.options, args)), output)
    return 0


def _check(args) -> int:
    from typeloom.operators.check import check_files

    cap = dict(args.param).get("check.failure-cap", PARAMETERS["check.failure-cap"])
    if args.files:
        if not args.schema:
            print("check: --schema is needed with files", file=sys.stderr)
            return 2
        report = check_files(_session(), args.files, Path(args.schema).read_text(encoding="utf-8"), args.root, cap)
        sys.stdout.write(report.text(args.detail))
        return 0 if report.passed else 1
    failed = False
    path, targets = _targets(args)
    for target in targets:
        inputs, output = target.paths(path)
        try:
            report = check_files(_session(), inputs, Path(output).read_text(encoding="utf-8"), args.root, cap)
        except (ValueError, OSError) as e:
            print(f"[{target.name}] {e}", file=sys.stderr)
            failed = True
            continue
        if not args.quiet or not report.passed:
            sys.stdout.write(f"[{target.name}] {report.text(args.detail)}")
        failed |= not report.passed
    return int(failed)


def _simplify(args) -> int:
    from typeloom.operators.infer import simplify_text

    options = Options(parameters=dict(args.param), **({"root_name": args.root_name} if args.root_name else {}))
    _write(simplify_text(Path(args.source).read_text(encoding="utf-8"), options), args.out)
    return 0


def main(argv: list[str] | None = None) -> int:
    try:
        args = parser().parse_args(argv)
    except SystemExit as e:
        return int(e.code or 0)
    try:
        return {"gen": _gen, "check": _check, "simplify": _simplify}[args.mode](args)
    except (ValueError, OSError) as e:
        print(f"typeloom: {e}", file=sys.stderr)
        return 1
