"""python -m ledgerline QUERY SF_DIR shows a catalogue query's rows; a stage's name runs that stage (see ledgerline.cli); nothing lists both."""

import sys

from ledgerline import cli
from ledgerline.plans import catalogue, ingest_queries, operator_queries  # noqa: F401


def main(args: list[str]) -> int:
    if args and args[0] in cli.STAGES:
        return cli.main(args)
    if len(args) < 2:
        print("\n".join(["stages: " + ", ".join(cli.STAGES), *sorted(catalogue.queries())]))
        return 0
    if args[0] not in catalogue.queries():
        print(f"no query or stage named {args[0]}", file=sys.stderr)
        return 2
    from pyspark.sql import SparkSession

    catalogue.queries()[args[0]](SparkSession.builder.getOrCreate(), args[1]).show(50, truncate=False)
    return 0


if __name__ == "__main__":
    sys.exit(main(sys.argv[1:]))
