"""One expression language for descriptors, written out as Spark SQL or as DuckDB SQL.

Descriptors are declared once over a dialect. Spark runs them inside Catalyst; the other form is what the
results are held against.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Sequence


def overlaps_itself(literal: str) -> bool:
    """Whether two occurrences of a literal can overlap."""
    return any(literal.startswith(literal[k:]) for k in range(1, len(literal)))


class Dialect:
    """What both dialects share; texts are SQL expressions unless named otherwise."""

    def text(self, value: str) -> str:
        raise NotImplementedError

    def matches(self, s: str, pattern: str) -> str:
        raise NotImplementedError

    def number(self, x: str) -> str:
        return f"CAST({x} AS DOUBLE)"

    def count(self, s: str, literal: str) -> str:
        """Occurrences that don't overlap."""
        gone = f"length({s}) - length(replace({s}, {self.text(literal)}, ''))"
        return f"({gone})" if len(literal) == 1 else f"(({gone}) / {len(literal)})"

    def total(self, s: str, literals: Sequence[str]) -> str:
        return "(" + " + ".join(self.count(s, x) for x in literals) + ")"

    def ratio(self, a: str, b: str) -> str:
        """a / b, and 0 where b is 0."""
        return f"CASE WHEN ({b}) = 0 THEN 0.0 ELSE {self.number(a)} / ({b}) END"

    def when(self, *cases: tuple[str, str], other: str = "0.0") -> str:
        return "CASE " + " ".join(f"WHEN {c} THEN {v}" for c, v in cases) + f" ELSE {other} END"

    def flag(self, condition: str) -> str:
        return f"CASE WHEN {condition} THEN 1 ELSE 0 END"

    def has(self, s: str, literal: str) -> str:
        return f"contains({s}, {self.text(literal)})"

    # Lists of numbers; sums, means and extremes of an empty one are 0.
    def mean(self, xs: str) -> str:
        return self.ratio(self.sum(xs), self.size(xs))

    def range(self, xs: str) -> str:
        return f"({self.max(xs)} - {self.min(xs)})"

    def variance(self, xs: str, mean: str | None = None) -> str:
        """Population variance, 0 for fewer than two; a mean that is a column saves taking it for every value."""
        m = mean or self.mean(xs)
        return f"CASE WHEN {self.size(xs)} < 2 THEN 0.0 ELSE {self.sum(self.map(xs, lambda x: f'({x} - {m}) * ({x} - {m})'))} / {self.size(xs)} END"

    def std(self, xs: str, mean: str | None = None) -> str:
        return f"sqrt({self.variance(xs, mean)})"

    def entropy(self, counts: str) -> str:
        """Bits of a list of counts, from the sum and the sum of c log c; the list should be a column."""
        n = self.sum(counts)
        logs = self.sum(self.map(counts, lambda c: f"CASE WHEN {c} > 0 THEN {c} * log2({c}) ELSE 0.0 END"))
        return f"CASE WHEN {n} = 0 THEN 0.0 ELSE greatest(log2({n}) - ({logs}) / ({n}), 0.0) END"


class Spark(Dialect):
    name = "spark"

    def text(self, value: str) -> str:
        return "r'" + value + "'" if "'" not in value and not value.endswith("\\") else "'" + value.replace("\\", "\\\\").replace("'", "\\'") + "'"

    def matches(self, s, pattern):
        return f"regexp_count({s}, {self.text(pattern)})"

    def like(self, s, pattern):
        return f"regexp_like({s}, {self.text(pattern)})"

    def overlapping(self, s, literal):
        return self.matches(s, f"(?={re.escape(literal)})") if overlaps_itself(literal) else self.count(s, literal)

    def without(self, s, pattern):
        return f"regexp_replace({s}, {self.text(pattern)}, '')"

    def found(self, s, pattern):
        return f"regexp_extract_all({s}, {self.text(pattern)}, 0)"

    def group(self, s, pattern, k=1):
        return f"regexp_extract({s}, {self.text(pattern)}, {k})"

    def letters(self, s):
        return f"filter(split({s}, ''), c -> c != '')"

    def positions(self, n):
        """1 to n, empty for n < 1."""
        return f"CASE WHEN {n} < 1 THEN slice(array(1), 1, 0) ELSE sequence(1, CAST({n} AS INT)) END"

    def map(self, xs, body: Callable[[str], str], var="x"):
        return f"transform({xs}, {var} -> {body(var)})"

    def keep(self, xs, body: Callable[[str], str], var="x"):
        return f"filter({xs}, {var} -> {body(var)})"

    def size(self, xs):
        return f"size({xs})"

    def sum(self, xs):
        return f"aggregate({xs}, CAST(0 AS DOUBLE), (acc, v) -> acc + v)"

    def max(self, xs):
        return f"coalesce(array_max({xs}), 0)"

    def min(self, xs):
        return f"coalesce(array_min({xs}), 0)"

    def product_log(self, xs):
        return self.sum(self.map(xs, lambda x: f"ln({x})"))

    def distinct(self, xs):
        return f"array_distinct({xs})"

    def sorted(self, xs):
        return f"sort_array({xs})"

    def slice(self, xs, first, length):
        return f"slice({xs}, {first}, CAST(greatest({length}, 0) AS INT))"

    def at(self, xs, k):
        """The k-th, from 1; null past the end."""
        return f"try_element_at({xs}, CAST({k} AS INT))"

    def lookup(self, table: dict[str, float], key: str) -> str:
        pairs = ", ".join(f"'{k}', CAST({v} AS DOUBLE)" for k, v in table.items())
        return f"try_element_at(map({pairs}), {key})"

    def struct(self, **fields):
        return "named_struct(" + ", ".join(f"'{k}', {v}" for k, v in fields.items()) + ")"

    def bytes_of(self, s):
        return f"octet_length({s})"

    def array(self, *xs):
        return f"array({', '.join(xs)})"

    def join(self, xs):
        return f"array_join({xs}, '')"

    def integer(self, x):
        return f"CAST({x} AS INT)"


class Counted(Spark):
    """Spark SQL in which what is counted in the text ``s`` is read from an array of counts, told by ``wanted``."""

    def __init__(self) -> None:
        self.wanted: list[tuple[str, str]] = []

    def _told(self, kind: str, what: str) -> str:
        if (kind, what) not in self.wanted:
            self.wanted.append((kind, what))
        return f"__counts[{self.wanted.index((kind, what))}]"

    def count(self, s, literal):
        return self._told("literal", literal) if s == "s" else super().count(s, literal)

    def matches(self, s, pattern):
        return self._told("pattern", pattern) if s == "s" else super().matches(s, pattern)

    def like(self, s, pattern):
        return f"({self._told('pattern', pattern)} > 0)" if s == "s" else super().like(s, pattern)

    def position_sum(self, s, characters):
        return self._told("sum", characters)

    def position_squares(self, s, characters):
        return self._told("squares", characters)

    def position_spread(self, s, characters):
        return self._told("spread", characters)


class Duck(Dialect):
    name = "duckdb"

    def _positions(self, characters: str, value: str) -> str:
        letters = ", ".join(self.text(c) for c in characters)
        return f"list_transform(cs, lambda c, i: CASE WHEN c IN ({letters}) THEN {value} END)"

    def position_sum(self, s, characters):
        return f"coalesce(list_sum({self._positions(characters, 'i')}), 0)::BIGINT"

    def position_squares(self, s, characters):
        return f"coalesce(list_sum({self._positions(characters, 'i * i')}), 0)::BIGINT"

    def position_spread(self, s, characters):
        return f"coalesce(list_max({self._positions(characters, 'i')}) - list_min({self._positions(characters, 'i')}), 0)"

    def over_runs(self, s: str, pattern: str, value: str) -> str:
        """The sum of a value of each match's length n."""
        return f"coalesce(list_sum(list_transform(regexp_extract_all({s}, {self.text(pattern)}), lambda x: {value.replace('n', 'length(x)')})), 0)::BIGINT"

    def text(self, value: str) -> str:
        return "'" + value.replace("'", "''") + "'"

    def count(self, s, literal):
        gone = f"length({s}) - length(replace({s}, {self.text(literal)}, ''))"
        return f"({gone})" if len(literal) == 1 else f"(({gone}) // {len(literal)})"

    def matches(self, s, pattern):
        return f"len(regexp_extract_all({s}, {self.text(pattern)}))"

    def like(self, s, pattern):
        return f"regexp_matches({s}, {self.text(pattern)}, 's')" if "\n" in pattern else f"regexp_matches({s}, {self.text(pattern)})"

    def overlapping(self, s, literal):
        if not overlaps_itself(literal):
            return self.count(s, literal)
        shifts = [k for k in range(1, len(literal)) if literal.startswith(literal[k:])]
        if all(k % shifts[0] == 0 for k in shifts):
            # All overlapping occurrences lie in runs of what is before the second one.
            head, rest = re.escape(literal[: shifts[0]]), literal[shifts[0] :]
            return self.over_runs(s, f"(?:{head})+{re.escape(rest)}", f"(n - {len(rest)}) // {shifts[0]}")
        return f"CASE WHEN {self.has(s, literal)} THEN len(list_filter(range(1, length({s}) + 1), lambda i: substr({s}, i, {len(literal)}) = {self.text(literal)})) ELSE 0 END"

    def without(self, s, pattern):
        return f"regexp_replace({s}, {self.text(pattern)}, '', 'g')"

    def found(self, s, pattern):
        return f"regexp_extract_all({s}, {self.text(pattern)})"

    def group(self, s, pattern, k=1):
        return f"regexp_extract({s}, {self.text(pattern)}, {k})"

    def letters(self, s):
        return f"list_filter(string_split({s}, ''), lambda c: c <> '')"

    def positions(self, n):
        return f"range(1, CAST({n} AS BIGINT) + 1)"

    def map(self, xs, body, var="x"):
        return f"list_transform({xs}, lambda {var}: {body(var)})"

    def keep(self, xs, body, var="x"):
        return f"list_filter({xs}, lambda {var}: {body(var)})"

    def size(self, xs):
        return f"len({xs})"

    def sum(self, xs):
        return f"coalesce(list_sum({xs}), 0.0)"

    def max(self, xs):
        return f"coalesce(list_max({xs}), 0)"

    def min(self, xs):
        return f"coalesce(list_min({xs}), 0)"

    def distinct(self, xs):
        return f"list_distinct({xs})"

    def sorted(self, xs):
        return f"list_sort({xs})"

    def slice(self, xs, first, length):
        return f"({xs})[{first}:({first}) + greatest({length}, 0) - 1]"

    def at(self, xs, k):
        return f"({xs})[CAST({k} AS BIGINT)]"

    def lookup(self, table, key):
        keys, values = ", ".join(f"'{k}'" for k in table), ", ".join(f"{v}::DOUBLE" for v in table.values())
        return f"([{values}])[list_position([{keys}], {key})]"

    def struct(self, **fields):
        return "{" + ", ".join(f"'{k}': {v}" for k, v in fields.items()) + "}"

    def bytes_of(self, s):
        return f"strlen({s})"

    def array(self, *xs):
        return f"[{', '.join(xs)}]"

    def join(self, xs):
        return f"array_to_string({xs}, '')"

    def integer(self, x):
        return f"CAST(trunc({x}) AS INT)"


SPARK, DUCK = Spark(), Duck()
