"""The utility library as functions of columns: of a parsed molecule (``molecules.parsed``), and of vectors of atom values.

``molecule`` is a column with the struct of a parsed text. Distances and pairs need one that was parsed with its
paths, and with pairs listed as far as they are asked for (``listed``). Everything is null for a text that is no molecule.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping

from pyspark.sql import Column
from pyspark.sql import functions as F

from molquarry.functions import elements as E

Value = Callable[[Column], Column]


def element_value(table: Mapping[int, float]) -> Value:
    """What an atom has by its element in one of the tables of ``elements``; 0 where the table has none."""
    values = [float(table.get(z, 0.0)) for z in range(max(table) + 1)]
    return lambda atom: F.coalesce(F.get(F.array(*map(F.lit, values)), atom["z"]), F.lit(0.0))


ELECTRONEGATIVITY, POLARIZABILITY, COVALENT_RADIUS = map(element_value, (E.PAULING, E.POLARIZABILITY, E.COVALENT_RADIUS))


def property_vector(molecule: Column, value: Value) -> Column:
    """The values of all atoms, in the order of the text."""
    return F.transform(molecule["atoms"], lambda x: value(x).cast("double"))


def count_atoms(molecule: Column, test: Value) -> Column:
    return F.size(F.filter(molecule["atoms"], test))


def count_bonds(molecule: Column, test: Value) -> Column:
    return F.size(F.filter(molecule["bonds"], test))


def atom_fraction(molecule: Column, test: Value) -> Column:
    return count_atoms(molecule, test) / F.nullif(F.size(molecule["atoms"]), F.lit(0))


def bond_fraction(molecule: Column, test: Value) -> Column:
    """0 without bonds."""
    return F.when(molecule.isNotNull(), F.coalesce(count_bonds(molecule, test) / F.nullif(F.size(molecule["bonds"]), F.lit(0)), F.lit(0.0)))


def pairs_at_distance(molecule: Column, distance: int) -> Column:
    """The pairs of atoms at a distance, i before j; at 0 each atom with itself."""
    if distance == 0:
        return F.transform(molecule["atoms"], lambda x, k: F.struct(k.alias("i"), k.alias("j")))
    return F.when(molecule.isNotNull(), F.coalesce(F.get(molecule["pairs"], F.lit(distance - 1)), F.array().cast("array<struct<i:int,j:int>>")))


def atoms_at_distance(molecule: Column, atom: int | Column, distance: int) -> Column:
    """How many atoms are at a distance from one."""
    a = F.lit(atom) if isinstance(atom, int) else atom
    return F.size(F.filter(pairs_at_distance(molecule, distance), lambda p: (p["i"] == a) | (p["j"] == a)))


def atom_distance(molecule: Column, a: int | Column, b: int | Column) -> Column:
    """Bonds between two atoms, -1 where no path of listed length joins them."""
    i, j = (F.lit(x) if isinstance(x, int) else x for x in (a, b))
    low, high = F.least(i, j), F.greatest(i, j)
    there = F.transform(molecule["pairs"], lambda at: F.exists(at, lambda p: (p["i"] == low) & (p["j"] == high)))
    found = F.array_position(there, F.lit(True))
    return F.when(molecule.isNotNull(), F.when(i == j, 0).when(found > 0, found).otherwise(-1)).cast("int")


def autocorrelation(molecule: Column, value: Value, most: int) -> Column:
    """Sums of products of a value over the pairs at each distance from 0 to ``most``, without centring."""
    v = property_vector(molecule, value)
    of = lambda d: F.aggregate(pairs_at_distance(molecule, d), F.lit(0.0), lambda s, p: s + F.get(v, p["i"]) * F.get(v, p["j"]))
    return F.when(molecule.isNotNull(), F.array(*[of(d) for d in range(most + 1)]))


def combined(a: Column, b: Column, by: Callable[[Column, Column], Column]) -> Column:
    """Two vectors value by value, up to the end of the shorter one."""
    n = F.least(F.size(a), F.size(b))
    return F.zip_with(F.slice(a, F.lit(1), n), F.slice(b, F.lit(1), n), by)


def _sum(v: Column) -> Column:
    return F.aggregate(v, F.lit(0.0), lambda s, x: s + x)


def vector_mean(v: Column) -> Column:
    return F.when(F.size(v) > 0, _sum(v) / F.size(v)).when(v.isNotNull(), F.lit(0.0))


def vector_variance(v: Column) -> Column:
    """Of the population, 0 for up to one value; by sums of deviations from the first value."""
    first = F.coalesce(F.get(v, F.lit(0)), F.lit(0.0))
    moved = F.transform(v, lambda x: x - first)
    squares = _sum(F.transform(v, lambda x: (x - first) * (x - first)))
    return F.when(F.size(v) > 1, F.greatest(squares / F.size(v) - F.pow(_sum(moved) / F.size(v), 2), F.lit(0.0))).when(v.isNotNull(), F.lit(0.0))


def vector_std(v: Column) -> Column:
    return F.sqrt(vector_variance(v))


def vector_min(v: Column) -> Column:
    return F.when(v.isNotNull(), F.coalesce(F.array_min(v), F.lit(0.0)))


def vector_max(v: Column) -> Column:
    return F.when(v.isNotNull(), F.coalesce(F.array_max(v), F.lit(0.0)))


def vector_range(v: Column) -> Column:
    return vector_max(v) - vector_min(v)


def harmonic_mean(v: Column) -> Column:
    """Over the values that aren't 0; 0 for none."""
    some = F.filter(v, lambda x: x != 0)
    return F.when(F.size(some) > 0, F.size(some) / _sum(F.transform(some, lambda x: 1 / x))).when(v.isNotNull(), F.lit(0.0))


def geometric_mean(v: Column) -> Column:
    """Over the positive values; 0 for none."""
    some = F.filter(v, lambda x: x > 0)
    return F.when(F.size(some) > 0, F.exp(_sum(F.transform(some, F.ln)) / F.size(some))).when(v.isNotNull(), F.lit(0.0))


def property_histogram(v: Column, width: float) -> Column:
    """A map of bins, floor(value / width), to the numbers of values in them."""
    binned = F.transform(v, lambda x: F.floor(x / F.lit(float(width))))
    return F.map_from_entries(F.transform(F.array_distinct(binned), lambda b: F.struct(b.alias("key"), F.size(F.filter(binned, lambda y: y == b)).alias("value"))))


def property_entropy(v: Column, width: float) -> Column:
    """Bits of the histogram; 0 for no values."""
    shares = F.transform(F.map_values(property_histogram(v, width)), lambda c: c / F.size(v))
    return F.aggregate(shares, F.lit(0.0), lambda s, p: s - p * F.log2(p))
