"""Command line: python -m molquarry.cli -i in.csv -o out_dir [-d name,...] [--smiles-col NAME | INDEX]."""

from __future__ import annotations

import argparse

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from molquarry import catalog
from molquarry.operators.profile import profile
from molquarry.sources.csv_ranges import read_csv_ranges
from molquarry.sources.csv import read_csv, smiles_column, write_csv


def main(args: list[str] | None = None) -> int:
    parser = argparse.ArgumentParser(description="Molecular descriptors of a CSV file with a SMILES column.")
    parser.add_argument("-i", "--input")
    parser.add_argument("-o", "--output")
    parser.add_argument("-d", "--descriptors", help="names, separated by commas; all if left out")
    parser.add_argument("--smiles-col", default="SMILES", help="name in any case, or index")
    parser.add_argument("--list-descriptors", action="store_true")
    parser.add_argument("--profile", action="store_true", help="profile the columns of the input instead")
    parser.add_argument("--reference-col")
    parser.add_argument("--delimiter", default=",")
    parser.add_argument("--one-line-rows", action="store_true", help="no field holds a line end, so that large files can be split")
    parser.add_argument("--ranges", action="store_true", help="read large files by many tasks although fields may hold line ends; rows are not kept in order")
    parser.add_argument("-q", "--quiet", action="store_true")
    a = parser.parse_args(args)
    if a.list_descriptors:
        by: dict[str, list[str]] = {}
        for e in catalog.entries().values():
            by.setdefault(e.category, []).append(e.name)
        for category, names in sorted(by.items()):
            print(f"{category} ({len(names)})", *(f"  {n}" for n in sorted(names)), sep="\n")
        return 0
    if not a.input or not (a.output or a.profile):
        parser.error("-i and -o are needed")
    spark = SparkSession.builder.getOrCreate()
    rows = read_csv_ranges(spark, a.input, a.delimiter) if a.ranges else read_csv(spark, a.input, a.delimiter, split=a.one_line_rows)
    if not rows.columns:
        # A file without even a header has no rows to describe.
        if a.output:
            spark.createDataFrame([], "value string").write.mode("overwrite").text(a.output)
        return 0
    if a.profile:
        found = profile(rows, a.reference_col)
        found.show(len(rows.columns), truncate=False)
        return 0
    names = catalog.resolve(a.descriptors.split(",") if a.descriptors else None)
    out = catalog.describe(rows, F.col(f"`{smiles_column(rows, a.smiles_col)}`"), names)
    write_csv(out.drop("parse_ok"), a.output, names, a.delimiter)
    if not a.quiet:
        print(f"{len(names)} descriptors written to {a.output}")
    return 0


if __name__ == "__main__":
    raise SystemExit(main())
