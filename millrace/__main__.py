"""python -m millrace [--db DIR] ["SQL"]: runs a statement, or reads statements from a prompt."""

from __future__ import annotations

import argparse
import sys

from millrace import Engine, build_session


def main(argv: list[str] | None = None) -> int:
    p = argparse.ArgumentParser(prog="millrace")
    p.add_argument("--db", help="folder of the tables")
    p.add_argument("sql", nargs="?")
    a = p.parse_args(argv)
    spark = build_session()
    spark.sparkContext.setLogLevel("ERROR")
    engine = Engine(spark, a.db)
    if a.sql:
        engine.execute(a.sql).show(1000, truncate=False)
        return 0
    buffer = ""
    for line in sys.stdin:
        buffer += line
        if buffer.strip() in (".quit", ".exit"):
            break
        if buffer.rstrip().endswith(";"):
            try:
                engine.execute(buffer).show(1000, truncate=False)
            except Exception as e:  # noqa: BLE001 - a prompt says what went wrong and goes on
                print(f"error: {str(e).splitlines()[0]}", file=sys.stderr)
            buffer = ""
    return 0


if __name__ == "__main__":
    sys.exit(main())
