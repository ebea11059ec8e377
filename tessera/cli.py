"""Command line: python -m tessera.cli extract SNAPSHOTS --out DIR [--formats css,json] | compare A B --out DIR.

Exit codes: 0 done, 2 wrong use, 3 no usable capture, 4 failed, 130 interrupted.
"""

from __future__ import annotations

import argparse
import sys

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .operators.diffs import scale_diff
from .plans import analysis, claims, exports
from .session import ship
from .sources import snapshots

DONE, USAGE, EMPTY, FAILED, INTERRUPTED = 0, 2, 3, 4, 130


def _parser() -> argparse.ArgumentParser:
    parser = argparse.ArgumentParser(prog="tessera")
    commands = parser.add_subparsers(dest="command", required=True)
    extract = commands.add_parser("extract", help="tokens and evidence from capture snapshots")
    extract.add_argument("snapshots")
    extract.add_argument("--out", required=True)
    extract.add_argument("--formats", default="all")
    compare = commands.add_parser("compare", help="token scales of two sets of snapshots, by analysis")
    compare.add_argument("before")
    compare.add_argument("after")
    compare.add_argument("--out", required=True)
    return parser


def _tokens(spark: SparkSession, path: str) -> dict[str, DataFrame]:
    return analysis.analyse(snapshots.read_snapshots(spark, path))


def run(spark: SparkSession, args: list[str]) -> int:
    try:
        given = _parser().parse_args(args)
    except SystemExit as e:
        return DONE if e.code in (0, None) else USAGE
    ship(spark)
    try:
        if given.command == "extract":
            names = list(exports.FORMATS) if given.formats == "all" else given.formats.split(",")
            if set(names) - set(exports.FORMATS):
                return USAGE
            captures = snapshots.read_snapshots(spark, given.snapshots)
            tables = analysis.analyse(captures)
            if tables["usage"].isEmpty():
                return EMPTY
            for name, df in tables.items():
                df.write.mode("overwrite").parquet(f"{given.out}/{name}")
            tokens, named = (spark.read.parquet(f"{given.out}/{t}") for t in ("tokens", "colors"))
            for name, df in claims.claims_of(captures, tokens, named).items():
                df.write.mode("overwrite").parquet(f"{given.out}/{name}")
            shades = named.select("analysisId", F.lit("colors").alias("group"), F.row_number().over(Window.partitionBy("analysisId").orderBy("name")).alias("ord"), "name", "value")
            tokens = tokens.select("analysisId", "group", "ord", F.lit(None).cast("string").alias("name"), "value").unionByName(shades)
            for name, df in exports.export(tokens, ["analysisId"], ",".join(names)).items():
                df.write.mode("overwrite").parquet(f"{given.out}/export-{name}")
        else:
            a, b = (_tokens(spark, p)["tokens"].select("analysisId", "group", "value", F.col("ord").alias("place")) for p in (given.before, given.after))
            scale_diff(a, b, ["analysisId", "group"], "value", "place").write.mode("overwrite").parquet(f"{given.out}/changes")
    except KeyboardInterrupt:
        return INTERRUPTED
    except Exception as e:  # noqa: BLE001  the exit code is the contract
        print(f"tessera: {e}", file=sys.stderr)
        return FAILED
    return DONE


def main() -> None:
    sys.exit(run(SparkSession.builder.appName("tessera").getOrCreate(), sys.argv[1:]))


if __name__ == "__main__":
    main()
