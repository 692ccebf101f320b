"""Command line: python -m orebed.cli [--json] [--workspace DIR] COMMAND ..."""

from __future__ import annotations

import argparse
import json
import sys
from pathlib import Path

from .errors import EngineError
from .plans import lower, runtime
from .plans.checker import compile_source


def page_size(text: str) -> int:
    n = int(text)
    if not 1 <= n <= 100:
        raise argparse.ArgumentTypeError("must be 1 through 100")
    return n


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="orebed")
    p.add_argument("--json", action="store_true")
    p.add_argument("--workspace", default=".")
    sub = p.add_subparsers(dest="command", required=True)

    def add(name: str, *arguments: str, paged: bool = False) -> argparse.ArgumentParser:
        c = sub.add_parser(name)
        for a in arguments:
            c.add_argument(a)
        if paged:
            c.add_argument("--limit", type=page_size, default=100)
            c.add_argument("--after")
        return c

    for name in ("init", "stats", "info", "verify", "plugins", "transforms"):
        add(name)
    c = add("import")
    c.add_argument("paths", nargs="+")
    c.add_argument("--recursive", action="store_true")
    add("summary").add_argument("--limit", type=page_size, default=10)
    add("assets", paged=True).add_argument("--prefix")
    add("recipes", paged=True).add_argument("--transform")
    add("search", "query").add_argument("--limit", type=page_size, default=100)
    inspect = add("inspect", "kind", "id")
    inspect.description = "kind: content, recipe or artifact"
    add("materialize", "content", "target")
    add("expression", "recipe").add_argument("--input")
    add("pipeline", "expression")
    c = add("run", "program")
    c.add_argument("--record", action="append", default=[])
    c.add_argument("--stock-intermediates", action="store_true")
    c.add_argument("--engine", choices=("interpreter", "columns"), default="interpreter")
    c = add("replay", "recipe")
    c.add_argument("--program")
    c.add_argument("--snapshot", action="store_true")
    add("trace", "recipe")
    add("check", "program")
    return p


def observation_key(key: bytes) -> dict:
    try:
        return {"utf8": key.decode()}
    except UnicodeDecodeError:
        return {"hex": key.hex()}


def show(value) -> object:
    if isinstance(value, runtime.Outer):
        return runtime.outer_json(value)
    if isinstance(value, dict):
        return {k: show(v) for k, v in value.items()}
    if isinstance(value, (list, tuple)):
        return [show(v) for v in value]
    return observation_key(value) if isinstance(value, bytes) else value


def execute(a: argparse.Namespace) -> object:
    if a.command == "check":
        m = compile_source(Path(a.program).read_text())
        return {"transforms": [{"name": n, "id": t.id, "mode": lower.strategy(m, n)[0]} for n, t in m.transforms.items()]}
    from .session import session
    from .workspace import Workspace

    spark = session()
    if a.command == "init":
        Workspace.init(spark, a.workspace)
        return {"workspace": a.workspace}
    w = Workspace(spark, Workspace.discover(a.workspace))
    commands = {
        "stats": w.stats, "info": w.info, "verify": w.verify, "plugins": lambda: w.transforms("workspace"), "transforms": w.transforms,
        "import": lambda: w.import_paths(a.paths, a.recursive), "summary": lambda: w.summary(a.limit),
        "assets": lambda: w.assets(a.limit, a.after, a.prefix), "recipes": lambda: w.recipes(a.limit, a.after, a.transform),
        "search": lambda: w.search(a.query, a.limit), "materialize": lambda: w.materialize(a.content, a.target),
        "inspect": lambda: {"content": w.inspect_content, "recipe": w.inspect_recipe, "artifact": w.inspect_artifact}[a.kind](a.id),
        "expression": lambda: w.expression(a.recipe, a.input), "pipeline": lambda: w.pipeline(a.expression),
        "run": lambda: w.run(Path(a.program).read_text(), tuple(a.record), a.stock_intermediates),
        "replay": lambda: w.replay(a.recipe, Path(a.program).read_text() if a.program else "", a.snapshot), "trace": lambda: w.trace(a.recipe),
    }
    return commands[a.command]()


def main(argv: list[str] | None = None) -> int:
    a = parser().parse_args(argv)
    try:
        out = show(execute(a))
    except (EngineError, KeyError, OSError, ValueError) as e:
        print(json.dumps({"error": str(e)}) if a.json else f"error: {e}", file=sys.stderr)
        return 1
    print(json.dumps(out, ensure_ascii=False) if a.json or not isinstance(out, str) else out)
    return 0


if __name__ == "__main__":
    sys.exit(main())
