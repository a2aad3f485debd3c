"""The catalog of descriptors and the one call that computes any of them."""

from __future__ import annotations

import warnings
from collections.abc import Callable, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from molquarry.functions import bits, molecules, strings, tokens
from molquarry.functions.acidity import ACIDITY
from molquarry.functions.electronegativity import ELECTRONEGATIVITY
from molquarry.functions.family import extend_families

TEXT_FAMILIES = (strings.STRING_COUNTS, strings.STRING_PATTERNS, strings.STRING_RATIOS, strings.CHAR_FRACTIONS, strings.PATTERN_SHARES, strings.STRING_DOCUMENTED, ELECTRONEGATIVITY, ACIDITY, tokens.TOKEN_CLOSED)


@dataclass(frozen=True)
class Entry:
    name: str
    category: str
    needs: str


def entries() -> dict[str, Entry]:
    """Every descriptor by name; where two families share a name the registered text family wins."""
    found: dict[str, Entry] = {}
    for f in TEXT_FAMILIES:
        for n in f.names():
            found.setdefault(n, Entry(n, f.category, "text"))
    for n in strings.SCANS:
        found.setdefault(n, Entry(n, "SmilesText", "scan"))
    for n in tokens.PLANE_STATISTICS:
        found.setdefault(n, Entry(n, "TokenInteraction", "planes"))
    for f, names in molecules.NAMES.items():
        for n in names:
            found.setdefault(n, Entry(n, molecules.FAMILIES[f].category, "molecule"))
    for n in (*bits.NAMES, *bits.DOCUMENTED):
        found.setdefault(n, Entry(n, "Bits", "bits"))
    return found | {n: e for n, (e, _, _) in _registered.items()}


Builder = Callable[[DataFrame, Column], Column]
_registered: dict[str, tuple[Entry, Builder, tuple[str, ...]]] = {}


def register(name: str, category: str, build: Builder, needs: Sequence[str] = ()) -> None:
    """Add a descriptor, or replace one: ``build`` makes its column from the table and the text column.

    ``needs`` names other descriptors, given or registered, that the column reads as columns of the table. They
    are worked out before it, once, whether they are asked for or not. A name that isn't known, and a
    descriptor that would need itself in the end, are refused.
    """
    if not name.isidentifier() or name.startswith("__"):
        raise ValueError(f"not a name of a descriptor: {name!r}")
    if not callable(build):
        raise TypeError("build has to be a function of the table and the text column")
    known = set(entries()) | {name}
    if unknown := [n for n in needs if n not in known]:
        raise ValueError(f"{name} needs unknown descriptors {unknown}")
    after, seen = list(needs), set()
    while after:
        n = after.pop()
        if n == name:
            raise ValueError(f"{name} would need itself")
        if n not in seen:
            seen.add(n)
            after += _registered[n][2] if n in _registered else ()
    _registered[name] = Entry(name, category, "registered"), build, tuple(needs)


def unregister(name: str) -> None:
    """Take a registered descriptor out again; a given one of the same name comes back. One that others need stays."""
    if users := [n for n, (_, _, needs) in _registered.items() if name in needs]:
        raise ValueError(f"{name} is needed by {users}")
    _registered.pop(name, None)


def closed(names: Sequence[str]) -> tuple[list[str], list[list[str]]]:
    """The given descriptors that names need in the end, and the registered ones level by level, each after what it needs."""
    depth: dict[str, int] = {}
    given: dict[str, None] = {}

    def level(name: str) -> int:
        if name not in _registered:
            given[name] = None
            return 0
        if name not in depth:
            depth[name] = 1 + max((level(n) for n in _registered[name][2]), default=0)
        return depth[name]

    for n in names:
        level(n)
    return list(given), [[n for n, d in depth.items() if d == k] for k in range(1, max(depth.values(), default=0) + 1)]


def resolve(names: Sequence[str] | None) -> list[str]:
    """Known names in the order asked for, with or without the suffix Descriptor; unknown ones are warned of."""
    known = entries()
    if names is None:
        return sorted(known)
    out: list[str] = []
    for n in names:
        short = n.removesuffix("Descriptor")
        pick = n if n in known else short if short in known else f"ATSd{short}" if f"ATSd{short}" in known else None
        if pick is None:
            warnings.warn(f"unknown descriptor {n}", stacklevel=2)
        elif pick not in out:
            out.append(pick)
    return out


def describe(df: DataFrame, smiles: Column, names: Sequence[str] | None = None) -> DataFrame:
    """``df`` with the descriptors as columns, in the order asked for. Rows are never moved or dropped.

    What registered descriptors need is worked out once for all of them, in the same pass.
    """
    wanted = resolve(names)
    known = entries()
    given, levels = closed(wanted)
    of = lambda need: [n for n in given if known[n].needs == need]
    # Each family's columns are carried as one struct up to the end: taken out and packed again from step to step, plans grow with the square of all columns.
    out = df.select(F.struct(*[df[c] for c in df.columns]).alias("__row"), smiles.alias("__smiles"), F.coalesce(smiles, F.lit("")).alias("s"))
    text = F.col("__smiles")
    left = set(of("text"))
    families = []
    for f in TEXT_FAMILIES:
        if its := [n for n in f.names() if n in left]:
            families.append((f, its))
            left -= set(its)
    made: dict[str, list[str]] = {}
    if families:
        out, made = extend_families(out, families)
    if its := of("scan"):
        out, made["__scans"] = out.withColumn("__scans", strings.scans(text, its)), its
    if its := of("planes"):
        out, made["__planes"] = out.withColumn("__planes", tokens.planes_of(text, its)), its
    if its := of("molecule"):
        out, made["__mol"] = molecules.extend_molecules(out, text, its, "__mol"), ["parse_ok", *its]
    if its := of("bits"):
        out, made["__bits"] = out.withColumn("__bits", bits.bits(text, its)), its
    out = out.select("__row.*", "__smiles", *[F.col(f"{part}.{n}").alias(n) for part, its in made.items() for n in its])
    for level in levels:
        out = out.withColumns({n: _registered[n][1](out, text) for n in level})
    flag = ["parse_ok"] if "parse_ok" in out.columns else []
    return out.select(*df.columns, *flag, *wanted)


def listing(spark: SparkSession) -> DataFrame:
    """The catalog as a table."""
    return spark.createDataFrame([(e.name, e.category, e.needs) for e in entries().values()], "name string, category string, needs string").orderBy("category", "name")
