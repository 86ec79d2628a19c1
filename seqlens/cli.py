"""Run a registered query over a folder of tables: python -m seqlens.cli QUERY IN OUT."""

from __future__ import annotations

import argparse
import sys

from seqlens.plans import catalog
from seqlens.session import local_session


def main(argv: list[str] | None = None) -> int:
    parser = argparse.ArgumentParser(prog="seqlens", allow_abbrev=False)
    parser.add_argument("query", choices=sorted(catalog.queries()))
    parser.add_argument("tables")
    parser.add_argument("output")
    args = parser.parse_args(argv)
    try:
        catalog.queries()[args.query](local_session(), args.tables).write.parquet(args.output, mode="errorifexists")
    except ValueError as e:
        print(e, file=sys.stderr)
        return 1
    return 0


if __name__ == "__main__":
    sys.exit(main())
