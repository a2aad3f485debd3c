"""Families of descriptors: stages of shared columns, then one column per descriptor."""

from __future__ import annotations

import re
from collections.abc import Callable, Sequence
from dataclasses import dataclass, field

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from molquarry.functions.batch import Texts, add_counts, add_values
from molquarry.functions.dialect import DUCK, Counted, Dialect

Declared = Callable[[Dialect], dict[str, str]]


@dataclass(frozen=True)
class Family:
    """Descriptors over a text column.

    ``stages`` are computed one after the other, each seeing the earlier ones and the text as ``s``;
    ``outputs`` are the descriptors. What they count in the text is counted for a whole Arrow batch at once;
    the arithmetic over the counts is Spark's. A family with ``values`` is worked out in the batch altogether,
    and its expressions are then only what the values are held against.
    """

    name: str
    category: str
    outputs: Declared
    stages: Sequence[Declared] = field(default_factory=tuple)
    values: Callable[[Texts, Sequence[str]], dict[str, np.ndarray]] | None = None

    def names(self) -> list[str]:
        return list(self.outputs(Counted()))

    def extend(self, inner: DataFrame, wanted: Sequence[str], out: str) -> DataFrame:
        """``inner``, which has the text as ``s``, with a struct column ``out`` of the wanted descriptors. No row is moved."""
        if self.values:
            return add_values(inner, F.col("s"), wanted, self.values, out)
        d = Counted()
        declared, stages = self.outputs(d), [stage(d) for stage in self.stages]
        # Only what the wanted descriptors, or a stage, read is counted.
        used = set(map(int, re.findall(r"__counts\[(\d+)\]", " ".join([declared[n] for n in wanted] + [e for stage in stages for e in stage.values()]))))
        at = {k: j for j, k in enumerate(sorted(used))}
        here = lambda e: re.sub(r"__counts\[(\d+)\]", lambda m: f"__counts[{at[int(m[1])]}]", e)
        columns = inner.columns
        if at:
            inner = add_counts(inner, F.col("s"), [d.wanted[k] for k in sorted(used)], "__counts")
        for stage in stages:
            inner = inner.select("*", *[F.expr(here(e)).alias(c) for c, e in stage.items()])
        return inner.select(*columns, F.struct(*[F.expr(here(d.number(declared[n]))).alias(n) for n in wanted]).alias(out))

    def add_to(self, df: DataFrame, text: Column, names: Sequence[str] | None = None) -> DataFrame:
        """``df`` with the descriptors added as columns; null texts count as empty."""
        known = self.names()
        wanted = known if names is None else [n for n in names if n in set(known)]
        return add_families(df, text, [(self, wanted)])

    def sql(self, table: str, keys: Sequence[str], text: str, names: Sequence[str] | None = None) -> str:
        """The same as DuckDB SQL, stage by stage."""
        declared = self.outputs(DUCK)
        wanted = list(declared) if names is None else [n for n in names if n in declared]
        steps = [f"stage_0 AS MATERIALIZED (SELECT {', '.join(keys)}, coalesce({text}, '') AS s FROM {table})"]
        for k, stage in enumerate(self.stages):
            steps.append(f"stage_{k + 1} AS MATERIALIZED (SELECT *, {', '.join(f'{e} AS {c}' for c, e in stage(DUCK).items())} FROM stage_{k})")
        values = [f"{DUCK.number(declared[n])} AS {n}" for n in wanted]
        return f"WITH {', '.join(steps)} SELECT {', '.join([*keys, *values])} FROM stage_{len(self.stages)}"


def add_families(df: DataFrame, text: Column, wanted: Sequence[tuple[Family, Sequence[str]]]) -> DataFrame:
    """``df`` with descriptors of several families as columns.

    The columns of ``df`` are carried as one, so that no name of theirs can clash and plans stay small; families
    without stages are counted together, in one pass over the texts.
    """
    inner = df.select(F.struct(*[df[c] for c in df.columns]).alias("__row"), F.coalesce(text, F.lit("")).alias("s"))
    inner, made = extend_families(inner, wanted)
    return inner.select("__row.*", *[f"{out}.*" for out in made])


def extend_families(inner: DataFrame, wanted: Sequence[tuple[Family, Sequence[str]]]) -> tuple[DataFrame, dict[str, list[str]]]:
    """``inner``, which has the text as ``s``, with struct columns of descriptors of several families, and what each of them holds."""
    flat = [(f, names) for f, names in wanted if not f.stages and not f.values]
    parts = [(f, list(names)) for f, names in wanted if f.stages or f.values]
    if flat:
        parts.append((Family("flat", "", lambda d: {n: e for f, _ in flat for n, e in f.outputs(d).items()}), [n for _, names in flat for n in names]))
    for k, (f, names) in enumerate(parts):
        inner = f.extend(inner, names, f"__out{k}")
    return inner, {f"__out{k}": names for k, (_, names) in enumerate(parts)}
