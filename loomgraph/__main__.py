"""python -m loomgraph generate --schema FILE --out FOLDER"""

import argparse
from pathlib import Path

from .codegen import generate
from .schema import GraphSchema


def main(args: list[str] | None = None) -> None:
    p = argparse.ArgumentParser(prog="loomgraph")
    commands = p.add_subparsers(dest="command", required=True)
    g = commands.add_parser("generate", help="check a schema against its lock and generate files")
    g.add_argument("--schema", required=True)
    g.add_argument("--out", required=True)
    given = p.parse_args(args)
    schema = GraphSchema.load(given.schema)
    schema.check_lock(str(Path(given.schema).parent / ".schema.lock"))
    for name in generate(schema, given.out):
        print(name)


if __name__ == "__main__":
    main()
