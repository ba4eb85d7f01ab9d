"""kinfold INPUT[:kind]... --config NAME_OR_FILE [--output FILE | --output-folder FOLDER]"""

from __future__ import annotations

import argparse
import os
import sys

from pyspark.sql import SparkSession

from kinfold.operators import project, rejects
from kinfold.plans import config as configs
from kinfold.plans import pipeline
from kinfold.sources.inputs import Input, read_all


def main(argv: list[str] | None = None) -> int:
    """Exit code 0, or 2 for a bad configuration."""
    parser = argparse.ArgumentParser(prog="kinfold", description="Merge records of the same people from several sources.")
    parser.add_argument("inputs", nargs="+", help="path or URL, with :kind where it does not tell")
    parser.add_argument("--config", default="default", help="default, custom or a JSON file")
    parser.add_argument("--output", help="file for the indented JSON array; on standard output one record a line otherwise")
    parser.add_argument("--output-folder", help="folder for JSON lines, written by the workers")
    parser.add_argument("--as-of-year", type=int, help="year up to which resumes' experience counts")
    args = parser.parse_args(argv)
    try:
        config = configs.load(args.config)
    except configs.ConfigError as error:
        print(error, file=sys.stderr)
        return 2
    spark = SparkSession.builder.appName("kinfold").getOrCreate()
    extracted = read_all(spark, [Input.parse(x) for x in args.inputs], args.as_of_year)
    records = pipeline.canonical(extracted.profiles)
    for path, reason in extracted.skipped:
        print(f"skipped {path}: {reason}", file=sys.stderr)
    for what, rows in (("left out of the inputs", extracted.rejects), ("records left out", project.rejected(records, config))):
        for row in rejects.counted(rows).orderBy("reason").collect():
            print(f"{what}: {row['n']} ({row['reason']})", file=sys.stderr)
    if args.output_folder:
        pipeline.write_json(records, config, args.output_folder)
        return 0
    if args.output:
        pipeline.write_array(records, config, args.output if ":" in args.output else f"file://{os.path.abspath(args.output)}")
        return 0
    for piece in pipeline.json_array(records, config):
        sys.stdout.write(piece)
    sys.stdout.write("\n")
    return 0


if __name__ == "__main__":
    sys.exit(main())
