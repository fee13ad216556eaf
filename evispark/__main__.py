"""``python -m evispark analyze FOLDER OUT --source NAME [--elderly-care-only]`` and ``python -m evispark verify FOLDER``.

Exit status: 0 clean, 2 with gaps (notices without a document; changed artifacts), 1 on failure.
"""

from __future__ import annotations

import argparse
import sys

from pyspark.sql import SparkSession

from evispark.plans import pipelines
from evispark.sources.files import markdown


def main(argv: list[str] | None = None) -> int:
    parser = argparse.ArgumentParser(prog="evispark", description=__doc__)
    commands = parser.add_subparsers(dest="command", required=True)
    analyze = commands.add_parser("analyze")
    analyze.add_argument("folder")
    analyze.add_argument("out")
    analyze.add_argument("--source", required=True)
    analyze.add_argument("--elderly-care-only", action="store_true")
    commands.add_parser("verify").add_argument("folder")
    args = parser.parse_args(argv)
    spark = SparkSession.builder.appName("evispark").getOrCreate()
    try:
        if args.command == "verify":
            bad = pipelines.verify(spark, args.folder)
            print(markdown(bad, ["path", "expected", "found"]))
            return 2 if not bad.isEmpty() else 0
        years = pipelines.analyze(spark, args.folder, args.out, args.source, args.elderly_care_only)
        print(markdown(years, ["year", "n_notices", "n_documents", "n_explicit_swedish", "n_language_related"]))
        return 2 if not years.where("n_documents < n_notices").isEmpty() else 0
    except (ValueError, OSError) as error:
        print(error, file=sys.stderr)
        return 1


if __name__ == "__main__":
    sys.exit(main())
