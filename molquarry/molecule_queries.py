"""Queries over molecules and their SQL.

The molecules are made from the keys of the table ``part``: a base, a chain and an end. The SQL makes the same texts
and reads them by itself: tokens, branches, ring closures, smallest rings, electrons, hydrogens and
hybridisation are joins and windows there, so it shares nothing with the library's parser or expressions but the element data. Of the texts of this table,
those with aromatic letters outside aromatic rings have no Kekulé form either and are no molecules.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from molquarry.functions import elements, molecules

#: Decimals of doubles in query results: what engines that sum in another order differ by is less, and hardly any value lies half-way.
DIGITS = 12
QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}

#: Bases of many kinds, and some that are no molecule: chains, rings, fused and spiro rings, halides, charges, salts, aromatic rings in both spellings.
BASES = (
    "C", "CCO", "CC(=O)O", "c1ccccc1", "Cc1ccccc1", "Oc1ccccc1", "Nc1ccccc1", "c1ccncc1", "c1c[nH]cn1", "C1CC1", "C1CCC2(CC1)CCCC2", "c1ccc2ccccc2c1", "c1ccc2[nH]ccc2c1", "ClC(Cl)(Cl)Cl", "CCI", "N[C@@H](C)C(=O)[O-]", "[Na+].[Cl-]",
    "C%10CCCC%10", "F/C=C/F", "CC#N", "C#C", "CC(=O)Nc1ccc(O)cc1", "CC(=O)Oc1ccccc1C(=O)O", "Cn1cnc2c1c(=O)n(C)c(=O)n2C", "CC(C)Cc1ccc(cc1)C(C)C(=O)O", "O=S(=O)(N)c1ccc(N)cc1", "OP(=O)(O)O", "C1CC2CCC1C2", "FC(F)(F)c1ccccc1", "CN(C)C",
    "C1=CC=CC=C1", "O=C1CCC(=O)N1", "S1C=CC=C1", "BrCCBr", "CSC", "CC(C)(C)C", "[NH4+]", "C1CCCCCCC1", "OC[C@H]1OC(O)[C@H](O)[C@@H](O)[C@@H]1O", "[O-][N+](=O)c1ccccc1", "", "C1", "not a smiles", "C1=CC=C2C=CC=C2C=C1", "C1=CC2=CC=CN2C=C1", "O=C1C=CC=CN1",
)
ENDS = ("", "O", "N", "S", "F", "Cl", "C(=O)O")
CHAINS = 7


#: Bytes for each core up to which a table is dealt out to all cores.
SMALL = 64 << 20


def spread(df: DataFrame) -> DataFrame:
    """A table of few bytes for each core, dealt out to all cores: it may lie in one file that one task would read. A larger one stays as it is read."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    size = int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    return df.repartition(cores) if size < SMALL * cores else df


def by_text(rows: DataFrame, text: str, described: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """``rows`` with what ``described`` adds to the table of their different texts, joined back by text; a null text is empty.

    Columns whose texts repeat, as types, brands and generated molecules do, are worked out once for each text. Where
    all texts differ this costs a shuffle of keys and texts.
    """
    texts = rows.select(F.coalesce(text, F.lit("")).alias(text)).distinct()
    found = described(dealt(texts)).withColumnRenamed(text, "__key")
    return rows.withColumn("__key", F.coalesce(text, F.lit(""))).join(found, "__key").drop("__key")


def dealt(texts: DataFrame) -> DataFrame:
    """Different texts dealt out to all cores: working them out takes longer than their few bytes tell."""
    spark = texts.sparkSession
    return texts.repartition(max(spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions"))))


def molecule_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """mol_id and smiles, one row for each part."""
    pick = lambda texts, at: f"element_at(array({', '.join(map(repr, texts))}), CAST({at} + 1 AS INT))"
    smiles = f"concat({pick(BASES, f'p_partkey % {len(BASES)}')}, repeat('C', CAST(p_partkey DIV {len(BASES)} % {CHAINS} AS INT)), {pick(ENDS, f'p_partkey DIV {len(BASES) * CHAINS} % {len(ENDS)}')})"
    return spread(spark.read.parquet(f"{sf_dir}/part.parquet").select(F.col("p_partkey").alias("mol_id"), F.expr(smiles).alias("smiles")))


_PICK = lambda texts, at: f"([{', '.join(map(repr, texts))}])[{at} + 1]"
#: The same texts, in DuckDB's SQL.
MOLECULE_SQL = f"(SELECT p_partkey AS mol_id, {_PICK(BASES, f'p_partkey % {len(BASES)}')} || repeat('C', (p_partkey // {len(BASES)} % {CHAINS})::INT) || {_PICK(ENDS, f'p_partkey // {len(BASES) * CHAINS} % {len(ENDS)}')} AS smiles FROM part)"


def rounded(df: DataFrame, names: Sequence[str]) -> DataFrame:
    return df.select(*[c for c in df.columns if c not in names], *[(F.round(n, DIGITS) + F.lit(0.0)).alias(n) for n in names])


def rounded_sql(sql: str, keys: Sequence[str], names: Sequence[str]) -> str:
    return f"SELECT {', '.join([*keys, *(f'round({n}::DOUBLE, {DIGITS}) + 0.0 AS {n}' for n in names)])} FROM ({sql})"


def _family_query(family: str) -> None:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        names = molecules.NAMES[family]
        return by_text(molecule_table(spark, sf_dir), "smiles", lambda t: rounded(molecules.add_molecules(t, F.col("smiles"), names), names)).drop("smiles")

    QUERIES[f"molecule_{family}"] = run


for _name in molecules.NAMES:
    _family_query(_name)


def _elements() -> str:
    sql = lambda v: "NULL" if v is None else f"'{v}'" if isinstance(v, str) else str(v)
    scales = (elements.MASS, elements.PAULING, elements.COVALENT_RADIUS, elements.VDW_RADIUS, elements.POLARIZABILITY, elements.IONIZATION)
    symbols = {z: s for s, z in elements.ATOMIC_NUMBER.items()} | {53: "I"}
    rows = [(z, symbols.get(z), *(float(t.get(z, 0.0)) for t in scales), elements.group(z), elements.period(z), z in elements.HALOGENS, z in elements.NON_METALS) for z in sorted(symbols)]
    return ", ".join("(" + ", ".join(map(sql, r)) + ")" for r in rows)


#: Texts read in SQL; ``mol_id`` numbers the different texts up to the last step.
_READ = rf"""texts AS MATERIALIZED (SELECT * FROM {MOLECULE_SQL}),
    u AS MATERIALIZED (SELECT row_number() OVER (ORDER BY smiles) AS mol_id, smiles AS s FROM (SELECT DISTINCT smiles FROM texts)),
    elements(z, symbol, mass, pauling, r_cov, r_vdw, pol, ion, grp, period, halogen, non_metal) AS (VALUES {_elements()}),
    tokens AS (SELECT mol_id, s, regexp_extract_all(s, '\[[^\]]*\]|Cl|Br|[BCNOPSFI*bcnops]|[=#$:/~\-]|%[0-9][0-9]|[0-9]|[().]') AS ks FROM u),
    tok AS (SELECT mol_id, unnest(range(1, len(ks) + 1)) AS pos, unnest(ks) AS k FROM tokens WHERE s <> '' AND array_to_string(ks, '') = s),
    deep AS MATERIALIZED (SELECT *, sum(CASE k WHEN '(' THEN 1 WHEN ')' THEN -1 ELSE 0 END) OVER w AS depth, count(*) FILTER (WHERE k = '.') OVER w AS part, lag(k) OVER w AS before,
        CASE WHEN regexp_matches(k, '^[A-Za-z*\[]') THEN 'atom' WHEN regexp_matches(k, '^[%0-9]') THEN 'ring' END AS kind FROM tok WINDOW w AS (PARTITION BY mol_id ORDER BY pos)),
    named AS (SELECT mol_id, row_number() OVER (PARTITION BY mol_id ORDER BY pos) - 1 AS i, pos, depth, part, before, k, k[1] = '[' AS bracket, regexp_extract(k, '^\[?([A-Z][a-z]?|[a-z]+)', 1) AS sym FROM deep WHERE kind = 'atom'),
    atom0 AS MATERIALIZED (SELECT named.*, z, sym = lower(sym) AS low, contains(k, '@') AS chiral,
        CASE WHEN NOT bracket THEN 0 WHEN contains(k, '+') THEN 1 WHEN contains(k, '-') THEN -1 ELSE 0 END AS charge,
        CASE WHEN NOT bracket THEN NULL WHEN regexp_matches(k, 'H[0-9]') THEN regexp_extract(k, 'H([0-9])', 1)::INT WHEN contains(k, 'H') THEN 1 ELSE 0 END AS given
        FROM named JOIN elements ON symbol = upper(sym[1]) || sym[2:]),
    spans AS (SELECT x.mol_id, x.i AS b, y.i AS a, x.before FROM atom0 x JOIN atom0 y ON x.mol_id = y.mol_id AND y.pos < x.pos AND y.part = x.part AND y.depth <= x.depth
        JOIN deep d ON d.mol_id = x.mol_id AND d.pos BETWEEN y.pos AND x.pos GROUP BY x.mol_id, x.i, y.i, y.depth, x.before HAVING min(d.depth) >= y.depth),
    closures AS (SELECT r.mol_id, r.k, r.pos, r.before, max(y.i) AS i, row_number() OVER (PARTITION BY r.mol_id, r.k ORDER BY r.pos) AS n FROM deep r JOIN atom0 y ON y.mol_id = r.mol_id AND y.pos < r.pos WHERE r.kind = 'ring' GROUP BY r.mol_id, r.k, r.pos, r.before),
    marked AS (SELECT mol_id, a, b, before AS mark FROM spans QUALIFY row_number() OVER (PARTITION BY mol_id, b ORDER BY a DESC) = 1
        UNION ALL SELECT o.mol_id, o.i, c.i, CASE WHEN o.before IN ('-', '=', '#', ':', '/', '') THEN o.before ELSE c.before END FROM closures o JOIN closures c ON c.mol_id = o.mol_id AND c.k = o.k AND c.n = o.n + 1 AND o.n % 2 = 1),
    bond0 AS MATERIALIZED (SELECT m.mol_id, m.a, m.b, mark IN ('/', '') AS stereo, (CASE mark WHEN '=' THEN 2 WHEN '#' THEN 3 ELSE CASE WHEN x.low AND y.low AND coalesce(mark, '') NOT IN ('-', '/', '') THEN 1.5 ELSE 1 END END)::DOUBLE AS ord
        FROM marked m JOIN atom0 x ON x.mol_id = m.mol_id AND x.i = m.a JOIN atom0 y ON y.mol_id = m.mol_id AND y.i = m.b),
    step AS MATERIALIZED (SELECT mol_id, a, b, ord FROM bond0 UNION ALL SELECT mol_id, b, a, ord FROM bond0),
    degrees AS (SELECT mol_id, a AS i, count(*) AS degree FROM step GROUP BY ALL),
    cyclic AS (SELECT mol_id, (SELECT count(*) FROM bond0 WHERE bond0.mol_id = a.mol_id) - count(*) + max(part) + 1 AS c FROM atom0 a GROUP BY mol_id),
    tours(mol_id, tour) AS (SELECT mol_id, [i] FROM atom0 JOIN cyclic USING (mol_id) WHERE c > 0
        UNION ALL SELECT w.mol_id, list_append(tour, s.b) FROM tours w JOIN step s ON s.mol_id = w.mol_id AND s.a = w.tour[-1] WHERE s.b > tour[1] AND NOT list_contains(tour, s.b) AND len(tour) < 9),
    cycles AS (SELECT t.mol_id, tour FROM tours t JOIN step s ON s.mol_id = t.mol_id AND s.a = t.tour[-1] AND s.b = t.tour[1] WHERE len(tour) > 2 AND tour[2] < tour[-1]),
    rings AS MATERIALIZED (SELECT mol_id, tour, row_number() OVER (PARTITION BY mol_id ORDER BY len(tour), list_sort(tour)) AS ring FROM cycles JOIN cyclic USING (mol_id) QUALIFY ring <= c),
    around AS MATERIALIZED (SELECT mol_id, ring, unnest(tour) AS a, unnest(list_append(tour[2:], tour[1])) AS b FROM rings),
    ring_bonds AS MATERIALIZED (SELECT mol_id, ring, least(a, b) AS a, greatest(a, b) AS b FROM around),
    in_rings AS (SELECT mol_id, a, b, count(*) AS rings FROM ring_bonds GROUP BY ALL),
    bond1 AS MATERIALIZED (SELECT x.mol_id, x.a, x.b, x.ord, x.stereo, coalesce(rings, 0) AS rings FROM bond0 x LEFT JOIN in_rings r ON r.mol_id = x.mol_id AND r.a = least(x.a, x.b) AND r.b = greatest(x.a, x.b)),
    turned AS MATERIALIZED (SELECT mol_id, a, b, ord, rings FROM bond1 UNION ALL SELECT mol_id, b, a, ord, rings FROM bond1),
    doubled AS (SELECT t.mol_id, t.a AS i, max(y.z) FILTER (WHERE ord = 2 AND rings = 0) AS out_z, coalesce(bool_or(ord = 2 AND rings > 0), false) AS inside FROM turned t JOIN atom0 y ON y.mol_id = t.mol_id AND y.i = t.b GROUP BY ALL),
    gives AS MATERIALIZED (SELECT x.mol_id, x.i, CASE WHEN out_z IS NOT NULL THEN CASE WHEN z = 6 AND (low OR NOT inside) THEN CASE WHEN out_z IN (7, 8, 16) THEN 0 ELSE 1 END END
            WHEN z = 6 THEN CASE WHEN low OR inside THEN 1 END
            WHEN z IN (7, 15) THEN CASE WHEN low THEN CASE WHEN charge = 0 AND (coalesce(given, 0) > 0 OR degree = 3) THEN 2 ELSE 1 END WHEN inside THEN 1 WHEN charge <= 0 THEN 2 END
            WHEN z IN (8, 16) THEN CASE WHEN charge = 0 AND (low OR NOT inside) THEN 2 END END AS e
        FROM atom0 x JOIN doubled USING (mol_id, i) JOIN degrees USING (mol_id, i) WHERE EXISTS (SELECT 1 FROM around r WHERE r.mol_id = x.mol_id AND r.a = x.i)),
    judged AS MATERIALIZED (SELECT mol_id, ring, bool_and(e IS NOT NULL) AS fit, sum(e) % 4 = 2 AS full_ FROM around r JOIN gives g USING (mol_id) WHERE g.i = r.a GROUP BY ALL),
    unions AS (SELECT p.mol_id, p.ring AS one, q.ring AS other FROM judged p JOIN judged q ON p.mol_id = q.mol_id AND p.ring < q.ring AND p.fit AND q.fit AND NOT (p.full_ AND q.full_)
        WHERE EXISTS (SELECT 1 FROM ring_bonds x JOIN ring_bonds y USING (mol_id, a, b) WHERE x.mol_id = p.mol_id AND x.ring = p.ring AND y.ring = q.ring)),
    full_unions AS (SELECT mol_id, one, other FROM (SELECT DISTINCT un.mol_id, one, other, r.a FROM unions un JOIN around r ON r.mol_id = un.mol_id AND r.ring IN (one, other)) JOIN gives g USING (mol_id) WHERE g.i = a GROUP BY ALL HAVING sum(e) % 4 = 2),
    aromatic_bonds AS MATERIALIZED (SELECT DISTINCT mol_id, a, b FROM ring_bonds JOIN judged USING (mol_id, ring) WHERE fit AND full_
        UNION SELECT f.mol_id, a, b FROM full_unions f JOIN ring_bonds r ON r.mol_id = f.mol_id AND r.ring IN (one, other) GROUP BY f.mol_id, one, other, a, b HAVING count(*) = 1),
    bond2 AS MATERIALIZED (SELECT x.mol_id, x.a, x.b, x.rings, x.stereo, x.ord AS written, CASE WHEN r.a IS NOT NULL THEN 1.5 WHEN x.ord = 1.5 THEN 1 ELSE x.ord END AS ord
        FROM bond1 x LEFT JOIN aromatic_bonds r ON r.mol_id = x.mol_id AND r.a = least(x.a, x.b) AND r.b = greatest(x.a, x.b)),
    sides AS MATERIALIZED (SELECT mol_id, a AS i, b AS j, ord, written FROM bond2 UNION ALL SELECT mol_id, b, a, ord, written FROM bond2),
    bonded AS (SELECT x.mol_id, x.i, count(j) AS degree, coalesce(bool_or(s.ord = 1.5), false) AS aromatic, coalesce(bool_or(s.ord > 1), false) AS pi, count(*) FILTER (WHERE s.ord = 2) AS doubles, count(*) FILTER (WHERE s.ord = 3) AS triples,
        coalesce(CASE WHEN any_value(low) THEN sum(CASE WHEN s.ord = 1.5 THEN 1 ELSE s.ord END) + (CASE WHEN any_value(e) = 1 AND count(*) FILTER (WHERE s.ord = 2) = 0 THEN 1 ELSE 0 END) ELSE sum(written) END, 0)::INT AS used
        FROM atom0 x LEFT JOIN sides s ON s.mol_id = x.mol_id AND s.i = x.i LEFT JOIN gives g ON g.mol_id = x.mol_id AND g.i = x.i GROUP BY ALL),
    filled AS MATERIALIZED (SELECT x.*, degree, aromatic, pi, doubles, triples, used,
        coalesce(given, (SELECT min(v) FROM (SELECT unnest(CASE WHEN z = 5 THEN [3] WHEN z = 6 THEN [4] WHEN z IN (7, 15) THEN [3, 5] WHEN z = 8 THEN [2] WHEN z = 16 THEN [2, 4, 6] WHEN z IN (9, 17, 35, 53) THEN [1] END) AS v) WHERE v >= used) - used) AS hydrogens
        FROM atom0 x JOIN bonded USING (mol_id, i)),
    good AS MATERIALIZED (SELECT mol_id FROM filled GROUP BY mol_id HAVING bool_and(hydrogens IS NOT NULL AND (aromatic OR NOT low) AND used + hydrogens <= CASE WHEN NOT bracket THEN 9 WHEN z IN (17, 35, 53) AND charge = -1 THEN 0 WHEN z BETWEEN 5 AND 9 AND charge <> 0 THEN 4 - abs(z - charge - 6) WHEN z = 6 THEN 4 WHEN z = 7 THEN 5 WHEN z = 8 THEN 2 ELSE 9 END)
        EXCEPT SELECT mol_id FROM closures GROUP BY mol_id, k HAVING count(*) % 2 = 1),
    conj AS MATERIALIZED (SELECT o.*, o.ord = 1.5 OR (o.ord = 1 AND ((x.pi AND y.pi) OR (x.pi AND y.z IN (7, 8, 16) AND y.charge <= 0) OR (y.pi AND x.z IN (7, 8, 16) AND x.charge <= 0))) AS c
        FROM bond2 o JOIN filled x ON x.mol_id = o.mol_id AND x.i = o.a JOIN filled y ON y.mol_id = o.mol_id AND y.i = o.b),
    ends_c AS (SELECT mol_id, a AS i, c, ord FROM conj UNION ALL SELECT mol_id, b, c, ord FROM conj),
    single_side AS (SELECT mol_id, i, bool_or(c AND ord = 1) AS single_c FROM ends_c GROUP BY ALL),
    conj2 AS MATERIALIZED (SELECT o.*, c OR (ord = 2 AND (x.single_c OR y.single_c)) AS conjugated FROM conj o JOIN single_side x ON x.mol_id = o.mol_id AND x.i = o.a JOIN single_side y ON y.mol_id = o.mol_id AND y.i = o.b),
    touched AS (SELECT mol_id, i, bool_or(conjugated) AS any_c FROM (SELECT mol_id, a AS i, conjugated FROM conj2 UNION ALL SELECT mol_id, b, conjugated FROM conj2) GROUP BY ALL),
    plain AS MATERIALIZED (SELECT f.mol_id, f.i, z, degree, EXISTS (SELECT 1 FROM around r WHERE r.mol_id = f.mol_id AND r.a = f.i) AS in_ring, aromatic, charge,
        CASE WHEN z = 1 THEN 's' WHEN triples > 0 OR doubles > 1 THEN 'sp' WHEN pi OR (z IN (7, 8, 16) AND coalesce(any_c, false)) THEN 'sp2' ELSE 'sp3' END AS hybrid, used + hydrogens AS valence, hydrogens, chiral, part
        FROM filled f JOIN good USING (mol_id) LEFT JOIN touched t ON t.mol_id = f.mol_id AND t.i = f.i),
    bonds AS MATERIALIZED (SELECT o.mol_id, a, b, ord, rings, stereo, ord = 1 AND NOT conjugated AND rings = 0 AND x.degree > 1 AND y.degree > 1 AND x.z <> 1 AND y.z <> 1 AS rotatable
        FROM conj2 o JOIN plain x ON x.mol_id = o.mol_id AND x.i = o.a JOIN plain y ON y.mol_id = o.mol_id AND y.i = o.b),
    atoms AS MATERIALIZED (SELECT plain.*, coalesce(mass, 0) AS mass, coalesce(pauling, 0) AS en, coalesce(r_cov, 0) AS r_cov, coalesce(r_vdw, 0) AS r_vdw, coalesce(pol, 0) AS pol, coalesce(ion, 0) AS ion,
        coalesce(grp, 0) AS grp, coalesce(period, 0) AS period, coalesce(halogen, false) AS halogen, coalesce(non_metal, false) AS non_metal FROM plain LEFT JOIN elements USING (z))"""


def _oracle(family: str, steps: str, by_name: dict[str, str], source: str) -> None:
    """SQL of a family: expressions over the rows of each molecule; texts that are no molecule have nulls."""
    names = molecules.NAMES[family]
    assert set(names) == set(by_name), set(names) ^ set(by_name)
    values = ", ".join(f"({by_name[n]})::DOUBLE AS {n}" for n in names)
    body = f"""WITH RECURSIVE {_READ}{steps}, v AS (SELECT mol_id AS t, {values} FROM {source} GROUP BY mol_id)
        SELECT texts.mol_id, v.t IS NOT NULL AS parse_ok, {', '.join(names)} FROM texts JOIN u ON u.s = texts.smiles LEFT JOIN v ON v.t = u.mol_id"""
    ORACLES[f"molecule_{family}"] = rounded_sql(body, ["mol_id", "parse_ok"], names)


_RATIO = "CASE WHEN ({1}) = 0 THEN 0 ELSE ({0}) / ({1}) END"
#: Pairs of atoms and the number of bonds between them, by doubling the reach: a longer path passes an atom at exactly the reach.
_WALKS = ", near1 AS MATERIALIZED (SELECT mol_id, i, i AS j, 0 AS d FROM plain UNION ALL SELECT mol_id, a, b, 1 FROM bonds UNION ALL SELECT mol_id, b, a, 1 FROM bonds)" + "".join(
    f", near{2 * k} AS MATERIALIZED (SELECT mol_id, i, j, min(d) AS d FROM (SELECT * FROM near{k} UNION ALL SELECT x.mol_id, x.i, y.j, {k} + y.d FROM near{k} x JOIN near{k} y ON y.mol_id = x.mol_id AND y.i = x.j WHERE x.d = {k} AND y.d > 0) GROUP BY ALL)" for k in (1, 2, 4, 8, 16)
) + ", near AS (SELECT * FROM near32)"


def _bond_oracle() -> None:
    count, share = (lambda c: f"count(*) FILTER (WHERE {c})"), (lambda c: _RATIO.format(f"count(*) FILTER (WHERE {c})", "count(ord)"))
    either, both = (lambda c: f"({c.format('x')} OR {c.format('y')})"), (lambda c: f"({c.format('x')} AND {c.format('y')})")
    order = {"Single": 1, "Double": 2, "Triple": 3, "Aromatic": 1.5}
    out = {f"{k}BondCount": count(f"ord = {v}") for k, v in order.items()} | {"BondCount": "count(ord)", "RotatableBondCount": count("rotatable"), "FractionRotatableBonds": share("rotatable"), "AromaticBondFraction": share("ord = 1.5")}
    out |= {"DoubleToSingleBondRatio": _RATIO.format(count("ord = 2"), count("ord = 1")), "TripleToSingleBondRatio": _RATIO.format(count("ord = 3"), count("ord = 1"))}
    out |= {"MaxBondPolarity": "coalesce(max(pol), 0)", "MinBondPolarity": "coalesce(min(pol), 0)", "MaxBondOrder": "coalesce(max(ord), 0)", "MinBondOrder": "coalesce(min(ord), 0)"}
    out |= {"UniqueBondOrderCount": "count(DISTINCT ord)", "UniqueBondPolarityCount": "count(DISTINCT tenth)", "MostCommonBondOrder": "coalesce(max(common), 0)", "MostCommonBondPolarity": "coalesce(max(common_tenth), 0)"}
    hetero = "({0}z NOT IN (1, 6))"
    out |= {"FractionBondsToHeteroatoms": share(either(hetero)), "FractionBondsBetweenHeteroatoms": share(both(hetero)), "FractionCCBonds": share("xz = 6 AND yz = 6")}
    out |= {"FractionRingBonds": share("rings > 0"), "FractionSingleRingBonds": share("rings > 0 AND ord = 1"), "FractionDoubleRingBonds": share("rings > 0 AND ord = 2")}
    out |= {"FractionBondsWithAromaticAtom": share("xar OR yar"), "FractionBondsBothAromaticAtoms": share("xar AND yar"), "FractionBondsWithRingAtom": share("xring OR yring"), "FractionBondsBothRingAtoms": share("xring AND yring"), "FractionBondsRingToNonRing": share("xring <> yring"), "FractionBondsWithHalogen": share("xhal OR yhal")}
    for name, h in (("Sp3", "sp3"), ("Sp2", "sp2"), ("Sp", "sp")):
        out |= {f"FractionBondsWith{name}Atom": share(f"xh = '{h}' OR yh = '{h}'"), f"FractionBondsBoth{name}Atoms": share(f"xh = '{h}' AND yh = '{h}'")}
    steps = """, j AS (SELECT good.mol_id, ord, rings, rotatable, x.z AS xz, y.z AS yz, x.aromatic AS xar, y.aromatic AS yar, x.in_ring AS xring, y.in_ring AS yring, x.halogen AS xhal, y.halogen AS yhal, x.hybrid AS xh, y.hybrid AS yh,
            abs(x.en - y.en) AS pol, trunc(abs(x.en - y.en) * 10 + 0.5) / 10 AS tenth
            FROM good LEFT JOIN bonds USING (mol_id) LEFT JOIN atoms x ON x.mol_id = good.mol_id AND x.i = a LEFT JOIN atoms y ON y.mol_id = good.mol_id AND y.i = b),
        o AS (SELECT mol_id, arg_min(ord, (-c) * 1000 + ord) AS common FROM (SELECT mol_id, ord, count(*) AS c FROM j WHERE ord IS NOT NULL GROUP BY ALL) GROUP BY mol_id),
        t AS (SELECT mol_id, arg_min(tenth, (-c) * 1000 + tenth) AS common_tenth FROM (SELECT mol_id, tenth, count(*) AS c FROM j WHERE ord IS NOT NULL GROUP BY ALL) GROUP BY mol_id),
        wide AS (SELECT * FROM j LEFT JOIN o USING (mol_id) LEFT JOIN t USING (mol_id))"""
    _oracle("bonds", steps, out, "wide")


def _radius_oracle() -> None:
    part = lambda c: _RATIO.format(f"coalesce(sum(r_cov) FILTER (WHERE {c}), 0)", "sum(r_cov)")
    out = {"SumHeteroCovalentRadii": "coalesce(sum(r_cov) FILTER (WHERE z NOT IN (1, 6)), 0)", "BondingToAtomicRadiusRatio": _RATIO.format("0.85 * sum(r_cov)", "sum(mass / 10)")}
    for name, c in (("Hetero", "z NOT IN (1, 6)"), ("Aromatic", "aromatic"), ("Ring", "in_ring")):
        out |= {f"Fraction{name}VdwRadii": part(c), f"Fraction{name}CovalentRadii": part(c)}
    _oracle("radius", "", out, "atoms")


def _autocorrelation_oracle() -> None:
    value = {"d": "degree", "e": "en", "m": "mass * 6.022e26", "p": "pol", "i": "ion * 1e18", "r": "r_cov * 1e10", "s": "valence", "v": "4.0 / 3 * pi() * (r_vdw * 1e10) ** 3", "z": "z"}
    steps = f"""{_WALKS}, p AS (SELECT mol_id, i, {', '.join(f'({e})::DOUBLE AS {k}' for k, e in value.items() if k not in ('i',))}, (ion * 1e18)::DOUBLE AS io FROM atoms),
        mean AS (SELECT mol_id, {', '.join(f'avg({"io" if k == "i" else k}) AS m{k}' for k in value)} FROM p GROUP BY mol_id),
        pairs AS (SELECT mean.*, near.d AS lag, {', '.join(f'(x.{"io" if k == "i" else k} - m{k}) * (y.{"io" if k == "i" else k} - m{k}) AS q{k}' for k in value)}
                  FROM mean LEFT JOIN near ON near.mol_id = mean.mol_id AND near.i < near.j LEFT JOIN p x ON x.mol_id = mean.mol_id AND x.i = near.i LEFT JOIN p y ON y.mol_id = mean.mol_id AND y.i = near.j)"""
    _oracle("autocorrelation", steps, {f"ATSd{k}{lag}": f"coalesce(avg(q{k}) FILTER (WHERE lag = {lag}), 0)" for k in value for lag in range(1, 9)}, "pairs")


def _weight_oracle() -> None:
    flags = {
        "HeavyAtom": "z > 1", "Carbon": "z = 6", "Hydrogen": "z = 1", "Nitrogen": "z = 7", "Oxygen": "z = 8", "Sulfur": "z = 16", "Phosphorus": "z = 15", "Boron": "z = 5", "Silicon": "z = 14", "Halogen": "halogen", "Fluorine": "z = 9", "Chlorine": "z = 17", "Bromine": "z = 35",
        "Iodine": "z = 53", "Metal": "z > 0 AND NOT non_metal", "Aromatic": "aromatic", "Aliphatic": "NOT aromatic", "Ring": "in_ring", "NonRing": "NOT in_ring", "Heteroatom": "z NOT IN (1, 6)", "MainGroup": "grp IN (1, 2, 13, 14, 15, 16, 17, 18)",
        "TransitionMetal": "period >= 4 AND grp BETWEEN 3 AND 12", "Sp3": "hybrid = 'sp3'", "Sp2": "hybrid = 'sp2'", "Sp": "hybrid = 'sp'", "PositiveCharge": "charge > 0", "NegativeCharge": "charge < 0", "Polar": "en > 2.5", "NonPolar": "en <= 2.5",
        "AlkaliMetal": "grp = 1 AND z > 2", "AlkalineEarth": "grp = 2 AND z > 2", "NobleGas": "grp = 18", "BasicNitrogen": "z = 7 AND NOT aromatic AND charge = 0 AND valence = 3", "AcidicOxygen": "acid",
    }
    f = {k: _RATIO.format(f"coalesce(sum(w) FILTER (WHERE {c}), 0)", "sum(w)") for k, c in flags.items()}
    c = {k: f"(count(*) FILTER (WHERE {v}) / count(*))" for k, v in flags.items()}
    over = lambda a, b: f"(({a}) / (({b}) + 1e-6))"
    spread = lambda *ks: f"list_stddev_pop([{', '.join(f[k] for k in ks)}])"
    out = {f"{k}WeightFraction": v for k, v in f.items()}
    out |= {
        "WeightFractionDiversity": spread("Carbon", "Hydrogen", "Nitrogen", "Oxygen", "Sulfur", "Phosphorus"), "HeavyToLightWeightRatio": over(f["HeavyAtom"], f"1 - {f['HeavyAtom']}"), "AromaticToAliphaticWeightRatio": over(f["Aromatic"], f["Aliphatic"]),
        "MetalToNonMetalWeightRatio": over(f["Metal"], f"1 - {f['Metal']}"), "PolarToNonPolarWeightRatio": over(f["Polar"], f["NonPolar"]), "SpHybridizationWeightRatio": over(f["Sp"], f"{f['Sp2']} + {f['Sp3']}"), "BasicToAcidicWeightRatio": over(f["BasicNitrogen"], f["AcidicOxygen"]),
        "HalogenWeightDiversity": spread("Fluorine", "Chlorine", "Bromine", "Iodine"), "NonMetalToMetalWeightRatio": over(f"1 - {f['Metal']}", f["Metal"]), "SpHybridizationDominance": over(f"{f['Sp3']} + {f['Sp2']}", f["Sp"]), "RingAtomWeightRatio": over(f["Ring"], f["NonRing"]),
        "HeteroToCarbonWeightRatio": over(f["Heteroatom"], f["Carbon"]), "MainGroupDominanceCount": over(c["MainGroup"], c["TransitionMetal"]), "PolarAtomCountRatio": over(c["Polar"], c["NonPolar"]), "ChargedAtomImbalance": f"{c['PositiveCharge']} - {c['NegativeCharge']}",
        "SpHybridizationCountBalance": over(c["Sp"], f"{c['Sp2']} + {c['Sp3']}"), "ChargeImbalanceWeightRatio": over(f"{f['PositiveCharge']} - {f['NegativeCharge']}", f"{f['PositiveCharge']} + {f['NegativeCharge']}"),
    }
    steps = """, ends AS (SELECT mol_id, a, b, ord FROM bonds UNION ALL SELECT mol_id, b, a, ord FROM bonds),
        acids AS (SELECT DISTINCT e.mol_id, e.a AS i FROM ends e JOIN atoms o ON o.mol_id = e.mol_id AND o.i = e.a AND o.z = 8 AND o.degree = 1 JOIN atoms c ON c.mol_id = e.mol_id AND c.i = e.b AND c.z = 6
                  WHERE e.ord = 2 AND (SELECT count(*) FROM ends f JOIN atoms p ON p.mol_id = f.mol_id AND p.i = f.b WHERE f.mol_id = e.mol_id AND f.a = e.b AND p.z = 8) > 1),
        weighed AS (SELECT atoms.*, acids.i IS NOT NULL AS acid, CASE WHEN atoms.z = 53 THEN 126.904 ELSE mass * 6.022e26 END AS w FROM atoms LEFT JOIN acids USING (mol_id, i))"""
    _oracle("weight", steps, out, "weighed")


def _graph_oracle() -> None:
    """Degrees, paths and rings of each molecule, one row each, from joins and groupings of atoms, bonds and rings."""
    r = lambda a, b: _RATIO.format(a, b)
    out = {"NumAtoms": "n", "NumBonds": "nb", "NumHeavyAtomsGraph": "heavy", "EdgeNodeRatio": r("nb", "n"), "GraphDensity": r("2.0 * nb", "n * (n - 1)"), "WienerIndex": "wiener", "MeanWienerIndex": r("wiener", "n * (n - 1) / 2"), "HararyIndex": "harary"}
    out |= {"GraphDiameter": "diameter", "MaxAtomEccentricity": "diameter", "GraphRadius": "radius", "MinAtomEccentricity": "radius", "MeanAtomEccentricity": "mean_ecc", "VarianceAtomEccentricity": "var_ecc", "PetitjeanIndex": r("diameter - radius", "radius")}
    out["BalabanJIndex"] = "CASE WHEN n > 2 AND nb - n + 1 > 0 THEN (nb + 0.5) * coalesce(reach, 0) / (nb - n + 1) ELSE 0 END"
    out |= {"MinAtomDegree": "min_d", "MaxAtomDegree": "max_d", "MeanAtomDegree": "mean_d", "VarianceAtomDegree": "var_d"}
    for k, name in enumerate(("Zero", "One", "Two", "Three", "Four", "FivePlus")):
        out |= {f"NumDegree{name}Atoms": f"d{k}", f"FractionDegree{name}Atoms": f"d{k} / n"}
    out |= {"PlattIndex": "m1", "QuadraticIndex": "m1", "ZagrebIndexM1": "m1", "ZagrebIndexM2": "m2", "MeanZagrebIndexM1": "m1 / n", "MeanZagrebIndexM2": "m2 / n", "MeanBondDegreeSum": "mean_sum", "VarianceBondDegreeSum": "var_sum", "RandicIndex": "randic"}
    kappa = lambda k: f"(CASE WHEN n > {k} THEN s * s / (n * (n - {k})) ELSE 0 END)"
    out |= {f"KierKappa{k}": kappa(k) for k in (1, 2, 3)} | {"KierAlpha": "alpha", "KierPhi": r(f"{kappa(1)} * {kappa(3)}", f"{kappa(2)} * {kappa(2)}")}
    out |= {"CyclomaticNumber": "nb - n + 1", "NumRings": "rings", "NumFusedRingsEstimate": "fused", "NumAromaticRings": "aromatic_rings", "NumSpiroAtoms": "spiro", "NumBridgeheadAtoms": "heads"}
    out |= {"NumAliphaticRings": "rings - aromatic_rings", "NumAliphaticCarbocycles": "ali_c", "NumAliphaticHeterocycles": "rings - aromatic_rings - ali_c", "NumAromaticCarbocycles": "aro_c", "NumAromaticHeterocycles": "aromatic_rings - aro_c"}
    out |= {"NumSaturatedRings": "sat", "NumSaturatedCarbocycles": "sat_c", "NumSaturatedHeterocycles": "sat - sat_c", "FractionAtomsInRings": "ring_atoms / n", "FractionBondsInRings": r("ring_bonds", "nb")}
    out |= {"MinRingSize": "min_ring", "MaxRingSize": "max_ring", "MeanRingSize": "mean_ring", "NumTerminalNodes": "terminal", "FractionTerminalNodes": r("terminal", "heavy"), "NumBranchingNodes": "forks", "FractionBranchingNodes": r("forks", "heavy")}
    for k in range(3, 9):
        name = f"{k}Plus" if k == 8 else str(k)
        out |= {f"NumRingSize{name}": f"r{k}", f"FractionRingSize{name}": r(f"r{k}", "rings")}
    out["BertzCT"] = "(n * h_atoms + nb * h_bonds) * ln(n + 1)"
    steps = f"""{_WALKS}, far AS (SELECT mol_id, i, max(d) AS e, sum(d) AS total FROM near GROUP BY ALL),
        pairs AS (SELECT near.mol_id, sum(d) AS wiener, sum(1.0 / d) AS harary, sum(1 / sqrt(x.total * y.total)) AS reach FROM near JOIN far x ON x.mol_id = near.mol_id AND x.i = near.i JOIN far y ON y.mol_id = near.mol_id AND y.i = near.j WHERE near.i < near.j GROUP BY near.mol_id),
        ecc AS (SELECT mol_id, max(e) AS diameter, coalesce(min(e) FILTER (WHERE e > 0), 0) AS radius, avg(e) AS mean_ecc, var_pop(e) AS var_ecc FROM far GROUP BY mol_id),
        per_atom AS (SELECT mol_id, count(*) AS n, count(*) FILTER (WHERE z > 1) AS heavy, min(degree) AS min_d, max(degree) AS max_d, avg(degree) AS mean_d, var_pop(degree) AS var_d, sum(degree * degree) AS m1, {', '.join(f'count(*) FILTER (WHERE least(degree, 5) = {k}) AS d{k}' for k in range(6))},
            coalesce(sum(1 / sqrt(nullif(degree, 0))), 0) AS s, sum(CASE z WHEN 6 THEN 0.05 WHEN 7 THEN 0.15 WHEN 8 THEN 0.2 WHEN 16 THEN 0.25 ELSE 0.1 END) AS alpha, count(*) FILTER (WHERE in_ring) AS ring_atoms,
            count(*) FILTER (WHERE z > 1 AND degree = 1) AS terminal, count(*) FILTER (WHERE z > 1 AND degree > 2) AS forks, entropy(z * 1000 + degree * 100 + 10 * aromatic::INT + charge + 5) AS h_atoms FROM atoms GROUP BY mol_id),
        per_bond AS (SELECT bonds.mol_id, count(*) AS nb, sum(x.degree * y.degree) AS m2, avg(x.degree + y.degree) AS mean_sum, var_pop(x.degree + y.degree) AS var_sum, sum(1 / sqrt(x.degree * y.degree)) AS randic, count(*) FILTER (WHERE bonds.rings > 0) AS ring_bonds,
            sum(greatest(0, bonds.rings - 1)) AS fused, entropy(ord) AS h_bonds FROM bonds JOIN atoms x ON x.mol_id = bonds.mol_id AND x.i = a JOIN atoms y ON y.mol_id = bonds.mol_id AND y.i = b GROUP BY bonds.mol_id),
        ring AS (SELECT around.mol_id, ring, count(*) AS size, bool_and(o.ord = 1.5) AS aro, bool_and(t.z = 6) AS carbon, bool_and(o.ord = 1) AS saturated FROM around JOIN bonds o ON o.mol_id = around.mol_id AND ((o.a = around.a AND o.b = around.b) OR (o.a = around.b AND o.b = around.a))
            JOIN atoms t ON t.mol_id = around.mol_id AND t.i = around.a GROUP BY around.mol_id, ring),
        per_ring AS (SELECT mol_id, count(*) AS rings, count(*) FILTER (WHERE aro) AS aromatic_rings, count(*) FILTER (WHERE NOT aro AND carbon) AS ali_c, count(*) FILTER (WHERE aro AND carbon) AS aro_c, count(*) FILTER (WHERE saturated) AS sat, count(*) FILTER (WHERE saturated AND carbon) AS sat_c,
            min(size) AS min_ring, max(size) AS max_ring, avg(size) AS mean_ring, {', '.join(f'count(*) FILTER (WHERE least(size, 8) = {k}) AS r{k}' for k in range(3, 9))} FROM ring GROUP BY mol_id),
        shared AS (SELECT x.mol_id, x.ring AS one, y.ring AS other, x.a AS i, count(*) OVER (PARTITION BY x.mol_id, x.ring, y.ring) AS c FROM around x JOIN around y ON x.mol_id = y.mol_id AND x.ring < y.ring AND x.a = y.a),
        corners AS (SELECT mol_id, count(DISTINCT i) FILTER (WHERE c = 1) AS spiro, count(DISTINCT i) FILTER (WHERE c > 2 AND (SELECT count(*) FROM step JOIN shared q ON q.mol_id = step.mol_id AND q.i = step.b WHERE step.mol_id = shared.mol_id AND step.a = shared.i AND q.one = shared.one AND q.other = shared.other) = 1) AS heads FROM shared GROUP BY mol_id),
        per_molecule AS (SELECT per_atom.*, coalesce(nb, 0) AS nb, coalesce(m2, 0) AS m2, coalesce(mean_sum, 0) AS mean_sum, coalesce(var_sum, 0) AS var_sum, coalesce(randic, 0) AS randic, coalesce(ring_bonds, 0) AS ring_bonds, coalesce(fused, 0) AS fused, coalesce(h_bonds, 0) AS h_bonds,
            coalesce(wiener, 0) AS wiener, coalesce(harary, 0) AS harary, reach, diameter, radius, mean_ecc, var_ecc, {', '.join(f'coalesce({c}, 0) AS {c}' for c in ('rings', 'aromatic_rings', 'ali_c', 'aro_c', 'sat', 'sat_c', 'min_ring', 'max_ring', 'mean_ring', *(f'r{k}' for k in range(3, 9)), 'spiro', 'heads'))}
            FROM per_atom LEFT JOIN per_bond USING (mol_id) LEFT JOIN pairs USING (mol_id) LEFT JOIN ecc USING (mol_id) LEFT JOIN per_ring USING (mol_id) LEFT JOIN corners USING (mol_id))"""
    _oracle("graph", steps, {n: f"any_value({e})" if e.isidentifier() else f"max({e})" for n, e in out.items()}, "per_molecule")



def _library_oracle() -> None:
    one = lambda s: f"any_value({s})"
    area = "CASE z WHEN 7 THEN CASE WHEN hydrogens > 0 THEN 17.5 ELSE 15.6 END WHEN 8 THEN CASE WHEN hydrogens > 0 THEN 17.0 ELSE 13.1 END WHEN 15 THEN 13.6 WHEN 16 THEN 25.3 ELSE 0 END"
    steps = f"""{_WALKS}, far AS (SELECT mol_id, i, max(d) AS e, sum(d) AS total FROM near GROUP BY ALL),
        per_far AS (SELECT mol_id, max(e) AS diameter, coalesce(min(e) FILTER (WHERE e > 0), 0) AS radius, sum(total) / 2 AS wiener FROM far GROUP BY mol_id),
        ring AS (SELECT mol_id, ring, bool_and(aromatic) AS lettered FROM around JOIN plain USING (mol_id) WHERE plain.i = around.a GROUP BY ALL),
        per_ring AS (SELECT mol_id, count(*) AS rings, count(*) FILTER (WHERE lettered) AS lettered FROM ring GROUP BY mol_id),
        per_bond AS (SELECT b.mol_id, count(*) AS nb, count(*) FILTER (WHERE rotatable) AS rot, count(*) FILTER (WHERE ord = 1 AND rings > 0) AS ring_rot, bool_or(stereo) AS stereo, max(abs(x.en - y.en)) AS most, sum(1 / sqrt(x.degree * y.degree)) AS randic,
            sum(1 / sqrt(p.total * q.total)) AS reach, count(DISTINCT ord) AS orders FROM bonds b JOIN atoms x ON x.mol_id = b.mol_id AND x.i = a JOIN atoms y ON y.mol_id = b.mol_id AND y.i = b.b JOIN far p ON p.mol_id = b.mol_id AND p.i = a JOIN far q ON q.mol_id = b.mol_id AND q.i = b.b GROUP BY b.mol_id),
        wide AS (SELECT atoms.*, coalesce(nb, 0) AS nb, coalesce(rot, 0) AS rot, coalesce(ring_rot, 0) AS ring_rot, coalesce(stereo, false) AS stereo, coalesce(most, 0) AS most, coalesce(randic, 0) AS randic, coalesce(reach, 0) AS reach, coalesce(orders, 0) AS orders, coalesce(rings, 0) AS rings, coalesce(lettered, 0) AS lettered,
            diameter, radius, wiener FROM atoms JOIN per_far USING (mol_id) LEFT JOIN per_bond USING (mol_id) LEFT JOIN per_ring USING (mol_id))"""
    cyc = f"({one('nb')} - count(*) + max(part) + 1)"
    size = f"({one('nb')} + count(*))"
    _oracle("library", steps, {
        "mol_fragment_count": "max(part) + 1", "mol_ring_count": one("rings"), "mol_aromatic_ring_count": one("lettered"), "mol_heavy_atom_count": "count(*) FILTER (WHERE z > 1)", "mol_bond_count": one("nb"), "mol_rotatable_bond_count": one("rot"), "mol_ring_rotatable_bond_count": one("ring_rot"),
        "mol_has_stereo": f"(bool_or(chiral) OR {one('stereo')})::INT", "mol_average_mass": "avg(mass * 6.022e23)", "mol_average_electronegativity": "coalesce(avg(en) FILTER (WHERE en > 0), 0)", "mol_max_electronegativity_difference": one("most"),
        "mol_sum_electronegativity": "sum(en)", "mol_sum_polarizability": "sum(pol)", "mol_sum_covalent_radii": "sum(r_cov)", "mol_eccentricity": one("diameter"), "mol_diameter": one("diameter"), "mol_radius": one("radius"), "mol_wiener": one("wiener"), "mol_randic": one("randic"),
        "mol_balaban_j": f"CASE WHEN {cyc} > 0 THEN {one('reach')} * {one('nb')} / {cyc} ELSE 0 END", "mol_fsp3": _RATIO.format("count(*) FILTER (WHERE z = 6 AND degree > 2 AND NOT aromatic AND hybrid NOT IN ('sp', 'sp2'))", "count(*) FILTER (WHERE z = 6)"),
        "mol_bertz": f"{size} * ln({size}) * (1 + greatest({cyc}, 0)) * count(DISTINCT z) * {one('orders')}", "mol_vdw_volume": "sum(4.0 / 3 * pi() * (r_vdw * 1e10) ** 3)", "mol_surface_area": "sum(2 * pi() * (r_vdw * 1e10) ** 2)", "mol_polar_surface_area": f"sum({area})",
    }, "wide")


def _vectors_oracle() -> None:
    out, parts = {}, []
    for name, v, width in (("electronegativity", "en", 0.5), ("polarizability", "pol", 1.0)):
        out |= {f"mol_{name}_{k}": e for k, e in {"mean": f"avg({v})", "variance": f"var_pop({v})", "std": f"stddev_pop({v})", "min": f"min({v})", "max": f"max({v})", "range": f"max({v}) - min({v})"}.items()}
        out |= {f"mol_{name}_harmonic_mean": f"coalesce(count(*) FILTER (WHERE {v} <> 0) / sum(1 / nullif({v}, 0)), 0)", f"mol_{name}_geometric_mean": f"coalesce(exp(avg(ln({v})) FILTER (WHERE {v} > 0)), 0)", f"mol_{name}_entropy": f"entropy(floor({v} / {width}))", f"mol_{name}_bins": f"count(DISTINCT floor({v} / {width}))"}
        out |= {f"mol_{name}_autocorrelation_0": f"sum({v} * {v})"} | {f"mol_{name}_autocorrelation_{d}": f"coalesce(any_value({v}{d}), 0)" for d in range(1, 5)}
        parts += [f"sum(x.{v} * y.{v}) FILTER (WHERE d = {d}) AS {v}{d}" for d in range(1, 5)]
    steps = f"""{_WALKS}, pairs AS (SELECT near.mol_id, {', '.join(parts)}, count(*) FILTER (WHERE d = 2) AS two, count(*) FILTER (WHERE d = 2 AND near.i = 0) AS from_first FROM near JOIN atoms x ON x.mol_id = near.mol_id AND x.i = near.i JOIN atoms y ON y.mol_id = near.mol_id AND y.i = near.j WHERE near.i < near.j GROUP BY near.mol_id),
        last AS (SELECT mol_id, max(i) AS last FROM plain GROUP BY mol_id), reach AS (SELECT last.mol_id, max(d) AS reach FROM last JOIN near ON near.mol_id = last.mol_id AND near.i = 0 AND near.j = last GROUP BY ALL),
        per_bond AS (SELECT mol_id, count(*) AS nb, count(*) FILTER (WHERE ord = 2) AS doubles, sum(CASE ord WHEN 2 THEN 1.7 WHEN 3 THEN 2.2 ELSE 0 END) AS of_bonds FROM bonds GROUP BY mol_id),
        wide AS (SELECT * FROM atoms LEFT JOIN pairs USING (mol_id) LEFT JOIN reach USING (mol_id) LEFT JOIN per_bond USING (mol_id))"""
    case = lambda table: "sum(CASE z " + " ".join(f"WHEN {z} THEN CASE WHEN aromatic THEN {b} ELSE {a} END" for z, (a, b) in table.items()) + " ELSE 0 END)"
    out |= {"mol_sum_product": "sum(en * pol)", "mol_pairs_at_2": "coalesce(any_value(two), 0)", "mol_atoms_at_2_of_first": "coalesce(any_value(from_first), 0)", "mol_distance_first_last": "coalesce(any_value(reach), -1)", "mol_carbons": "count(*) FILTER (WHERE z = 6)", "mol_carbon_fraction": "avg((z = 6)::INT)"}
    out |= {"mol_double_bonds": "coalesce(any_value(doubles), 0)", "mol_double_bond_fraction": "coalesce(any_value(doubles) / any_value(nb), 0)", "mol_log_p": case(molecules.LOG_P), "mol_refractivity": f"{case(molecules.REFRACTIVITY)} + coalesce(any_value(of_bonds), 0)"}
    _oracle("vectors", steps, out, "wide")


def _topology_oracle() -> None:
    steps = f"""{_WALKS}, w AS (SELECT *, (CASE WHEN z = 6 THEN 1 WHEN z IN (7, 8) THEN 2 WHEN z IN (15, 16) THEN 3 WHEN halogen THEN 4 ELSE 1.5 END) * (CASE WHEN aromatic THEN 1.5 ELSE 1 END) AS w FROM atoms),
        far AS (SELECT mol_id, i, max(d) AS e, sum(d) AS total FROM near GROUP BY ALL),
        pairs AS (SELECT near.mol_id, sum(x.w * y.w / d) AS etap, coalesce(avg(d) FILTER (WHERE d <= 10), 0) AS path FROM near JOIN w x ON x.mol_id = near.mol_id AND x.i = near.i JOIN w y ON y.mol_id = near.mol_id AND y.i = near.j WHERE near.i < near.j GROUP BY near.mol_id),
        n AS (SELECT mol_id, count(*) AS n FROM plain GROUP BY mol_id), close AS (SELECT mol_id, i, coalesce((n - 1) / nullif(total, 0), 0) AS close FROM far JOIN n USING (mol_id)), means AS (SELECT mol_id, avg(close) AS mean FROM close GROUP BY mol_id),
        core AS (SELECT mol_id, count(*) AS core, avg(degree) AS core_degree FROM close JOIN means USING (mol_id) JOIN plain USING (mol_id, i) WHERE close * (1 - 1e-12) > mean GROUP BY mol_id),
        ends AS (SELECT mol_id, a, b, ord FROM bonds UNION ALL SELECT mol_id, b, a, ord FROM bonds),
        beside AS (SELECT e.mol_id, e.a AS i, count(*) FILTER (WHERE z = 6) AS carbons, bool_or(z = 7) AS nitrogen, bool_or(z = 8 AND ord = 2) AS carbonyl FROM ends e JOIN plain p ON p.mol_id = e.mol_id AND p.i = e.b GROUP BY ALL),
        per_bond AS (SELECT o.mol_id, count(*) AS nb, count(*) FILTER (WHERE rings > 1) AS fused, count(*) FILTER (WHERE ord = 2 AND ((x.z = 6 AND y.z = 8) OR (x.z = 8 AND y.z = 6))) AS carbonyls FROM bonds o JOIN plain x ON x.mol_id = o.mol_id AND x.i = a JOIN plain y ON y.mol_id = o.mol_id AND y.i = b GROUP BY o.mol_id),
        ring AS (SELECT r.mol_id, ring, CASE WHEN bool_and(aromatic) THEN CASE WHEN bool_or(z NOT IN (1, 6)) THEN 2.5 ELSE 2 END ELSE 1.5 END AS score FROM around r JOIN plain p ON p.mol_id = r.mol_id AND p.i = r.a GROUP BY r.mol_id, ring), per_ring AS (SELECT mol_id, count(*) AS rings, sum(score) AS score FROM ring GROUP BY mol_id),
        kinds AS (SELECT mol_id, sum(c * c) AS c2 FROM (SELECT mol_id, z, count(*) AS c FROM plain GROUP BY ALL) GROUP BY mol_id),
        wide AS (SELECT w.*, e, total, coalesce(etap, 0) AS etap, coalesce(path, 0) AS path, coalesce(core, 0) AS core, coalesce(core_degree, 0) AS core_degree, coalesce(carbons, 0) AS carbons, coalesce(nitrogen, false) AS nitrogen, coalesce(carbonyl, false) AS carbonyl, coalesce(nb, 0) AS nb, coalesce(fused, 0) AS fused, coalesce(carbonyls, 0) AS carbonyls,
            coalesce(rings, 0) AS rings, coalesce(score, 0) AS score, c2 FROM w JOIN far USING (mol_id, i) LEFT JOIN pairs USING (mol_id) LEFT JOIN core USING (mol_id) LEFT JOIN beside USING (mol_id, i) LEFT JOIN per_bond USING (mol_id) LEFT JOIN per_ring USING (mol_id) JOIN kinds USING (mol_id))"""
    one = lambda s: f"any_value({s})"
    polar = "z IN (7, 8, 15, 16)"
    _oracle("topology", steps, {
        "TopologyEtap": f"{one('etap')} / count(*)", "MolecularMesh": f"0.4 * ({_RATIO.format(one('nb'), 'count(*) * (count(*) - 1) / 2')}) + 0.6 * avg(w * degree)", "McsIndex": f"0.5 * {one('c2')} / (count(*) * count(*)) + 0.5 * avg(degree) / 2 / 3", "VertexEdgePath": one("path"),
        "McFarlandComplexity": "avg(1.5 * aromatic::INT + 2 * (z NOT IN (1, 6))::INT + in_ring::INT + 2.5 * (degree > 2)::INT)", "CycleConnectivity": _RATIO.format(one("fused"), one("rings")),
        "FragmentComplexity": f"({one('score')} + 2 * count(*) FILTER (WHERE z = 6 AND carbonyl AND nitrogen) + count(*) FILTER (WHERE z = 8 AND degree = 2 AND carbons = 2) + 1.5 * {one('carbonyls')}) / count(*)",
        "TopologicalPolarBsa": _RATIO.format(f"count(*) FILTER (WHERE {polar} AND degree > 0 AND carbons > 0.5 * degree)", f"count(*) FILTER (WHERE {polar})"), "EccentricDistance": "sum(e * total) / (count(*) * count(*))", "MolecularScaffolding": f"0.6 * {one('core')} / count(*) + 0.4 * {one('core_degree')} / 4",
    }, "wide")


for _of in (_bond_oracle, _graph_oracle, _radius_oracle, _autocorrelation_oracle, _weight_oracle, _library_oracle, _vectors_oracle, _topology_oracle):
    _of()


#: Descriptors that SQL works out from tables of atoms and bonds.
_BOND_NAMES = ("BondCount", "SingleBondCount", "DoubleBondCount", "TripleBondCount", "AromaticBondCount", "MaxBondOrder", "MinBondOrder", "UniqueBondOrderCount", "MostCommonBondOrder", "FractionCCBonds", "FractionRingBonds", "FractionBondsToHeteroatoms", "FractionBondsBetweenHeteroatoms", "DoubleToSingleBondRatio", "ZagrebIndexM2", "RandicIndex", "MeanBondDegreeSum")
_ATOM_NAMES = ("NumAtoms", "NumHeavyAtomsGraph", "MinAtomDegree", "MaxAtomDegree", "MeanAtomDegree", "VarianceAtomDegree", "ZagrebIndexM1", "FractionAtomsInRings", "NumTerminalNodes", "NumBranchingNodes", "KierAlpha")
_PATH_NAMES = ("WienerIndex", "HararyIndex", "GraphDiameter", "GraphRadius", "MeanAtomEccentricity", "ATSdz1", "ATSdz2", "ATSdd3")



#: The numbers that the reading gives to different texts.
_NUMBERED = f"SELECT mol_id, dense_rank() OVER (ORDER BY smiles) AS t FROM {MOLECULE_SQL}"


def _graph_query(name: str, names: tuple[str, ...]) -> None:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        described = lambda t: rounded(molecules.add_molecules(t, F.col("smiles"), names).where("parse_ok").drop("parse_ok"), names)
        return by_text(molecule_table(spark, sf_dir), "smiles", described).drop("smiles")

    QUERIES[name] = run


def _graph_oracles() -> None:
    """A part of the values by plain groupings of atoms, bonds and pairs."""
    out = {}
    r = lambda e, n: f"round(CAST({e} AS DOUBLE), {DIGITS}) + 0.0 AS {n}"
    share = lambda c: f"coalesce(avg(CASE WHEN {c} THEN 1.0 ELSE 0.0 END) FILTER (WHERE ord IS NOT NULL), 0)"
    count = lambda o: f"count(*) FILTER (WHERE ord = {o})"
    exprs = ("count(ord)", count(1), count(2), count(3), count(1.5), "coalesce(max(ord), 0)", "coalesce(min(ord), 0)", "count(DISTINCT ord)", "coalesce(max(common), 0)", share("za = 6 AND zb = 6"), share("rings > 0"), share("za NOT IN (1, 6) OR zb NOT IN (1, 6)"), share("za NOT IN (1, 6) AND zb NOT IN (1, 6)"),
             f"CASE WHEN {count(1)} = 0 THEN 0 ELSE {count(2)} / {count(1)} END", "coalesce(sum(da * db), 0)", "coalesce(sum(1 / sqrt(da * db)), 0)", "coalesce(avg(da + db), 0)")
    out["graph_bonds"] = f"""
        WITH RECURSIVE {_READ}, tally AS (SELECT mol_id, ord, count(*) AS c FROM bonds GROUP BY ALL), modes AS (SELECT mol_id, arg_min(ord, (-c) * 1000 + ord) AS common FROM tally GROUP BY mol_id),
        j AS (SELECT m.mol_id, ord, rings, x.z AS za, y.z AS zb, x.degree AS da, y.degree AS db, common FROM (SELECT DISTINCT mol_id FROM atoms) m LEFT JOIN bonds USING (mol_id) LEFT JOIN modes USING (mol_id)
              LEFT JOIN atoms x ON x.mol_id = m.mol_id AND x.i = a LEFT JOIN atoms y ON y.mol_id = m.mol_id AND y.i = b)
        SELECT mol_id, {', '.join(r(e, n) for e, n in zip(exprs, _BOND_NAMES, strict=True))} FROM j GROUP BY mol_id"""
    exprs = ("count(*)", "count(*) FILTER (WHERE z > 1)", "min(degree)", "max(degree)", "avg(degree)", "var_pop(degree)", "sum(degree * degree)", "avg(CASE WHEN in_ring THEN 1.0 ELSE 0.0 END)", "count(*) FILTER (WHERE z > 1 AND degree = 1)", "count(*) FILTER (WHERE z > 1 AND degree > 2)",
             "sum(CASE z WHEN 6 THEN 0.05 WHEN 7 THEN 0.15 WHEN 8 THEN 0.2 WHEN 16 THEN 0.25 ELSE 0.1 END)")
    out["graph_atoms"] = f"WITH RECURSIVE {_READ} SELECT mol_id, {', '.join(r(e, n) for e, n in zip(exprs, _ATOM_NAMES, strict=True))} FROM atoms GROUP BY mol_id"
    ats = lambda p, lag: f"coalesce(avg((x{p} - m{p}) * (y{p} - m{p})) FILTER (WHERE d = {lag} AND i < j), 0)"
    exprs = ("coalesce(sum(d) FILTER (WHERE i < j), 0)", "coalesce(sum(1.0 / d) FILTER (WHERE i < j), 0)", "coalesce(max(d), 0)", "coalesce(min(e) FILTER (WHERE e > 0), 0)", "coalesce(max(mean_e), 0)", ats("z", 1), ats("z", 2), ats("d", 3))
    out["graph_paths"] = f"""
        WITH RECURSIVE {_READ}{_WALKS}, ecc AS (SELECT mol_id, i, max(d) AS e FROM near GROUP BY ALL), mean_ecc AS (SELECT mol_id, avg(e) AS mean_e FROM ecc GROUP BY mol_id),
        means AS (SELECT mol_id, avg(z) AS mz, avg(degree) AS md FROM atoms GROUP BY mol_id),
        p AS (SELECT near.mol_id, near.i, near.j, nullif(d, 0) AS d, e, mean_e, mz, md, x.z AS xz, y.z AS yz, x.degree AS xd, y.degree AS yd FROM near JOIN ecc USING (mol_id, i) JOIN mean_ecc USING (mol_id) JOIN means USING (mol_id)
              JOIN atoms x ON x.mol_id = near.mol_id AND x.i = near.i JOIN atoms y ON y.mol_id = near.mol_id AND y.i = near.j)
        SELECT mol_id, {', '.join(r(e, n) for e, n in zip(exprs, _PATH_NAMES, strict=True))} FROM p GROUP BY mol_id"""


    for name, sql in out.items():
        ORACLES[name] = f"SELECT texts.mol_id, g.* EXCLUDE (mol_id) FROM ({sql}) g JOIN ({_NUMBERED}) texts ON texts.t = g.mol_id"


for _name, _names in (("graph_bonds", _BOND_NAMES), ("graph_atoms", _ATOM_NAMES), ("graph_paths", _PATH_NAMES)):
    _graph_query(_name, _names)
_graph_oracles()

#: Element data by atomic number.
_TABLES = {"mass_kg": elements.MASS, "pauling": elements.PAULING, "allred_rochow": elements.ALLRED_ROCHOW, "ionization": elements.IONIZATION, "affinity": elements.AFFINITY, "r_cov": elements.COVALENT_RADIUS, "r_vdw": elements.VDW_RADIUS, "polarizability": elements.POLARIZABILITY, "density": elements.DENSITY, "thermal": elements.THERMAL_CONDUCTIVITY, "specific_heat": elements.SPECIFIC_HEAT, "molar_volume": elements.MOLAR_VOLUME}


def _parsed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The different molecules, parsed, and how often each is found."""
    texts = molecule_table(spark, sf_dir).groupBy("smiles").agg(F.count(F.lit(1)).alias("times"))
    return dealt(texts).select("times", molecules.parsed(F.col("smiles"), 0, False).alias("m"))


def element_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Element properties and classes, with the atoms and molecules of the table that are of each element."""
    flags = {"main_group": elements.is_main_group, "transition_metal": elements.is_transition_metal, "alkali": elements.is_alkali_metal, "alkaline_earth": elements.is_alkaline_earth, "noble_gas": elements.is_noble_gas, "metal": elements.is_metal}
    rows = [(z, s, elements.group(z), elements.period(z), *(float(t.get(z, 0.0)) for t in _TABLES.values()), z in elements.HALOGENS, *(f(z) for f in flags.values())) for s, z in elements.ATOMIC_NUMBER.items()]
    schema = "z int, symbol string, grp int, period int, " + ", ".join(f"{n} double" for n in _TABLES) + ", halogen boolean, " + ", ".join(f"{n} boolean" for n in flags)
    counts = _parsed(spark, sf_dir).select("times", F.explode(molecules.element_counts(F.col("m"))).alias("z", "c")).groupBy("z").agg(F.sum(F.col("c") * F.col("times")).alias("atoms"), F.sum("times").alias("molecules"))
    found = spark.createDataFrame(rows, schema).join(F.broadcast(counts), "z", "left")
    return found.withColumns({c: F.coalesce(c, F.lit(0)) for c in ("atoms", "molecules")})


def ring_sizes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of each ring size: rings, molecules that have one, and most in one molecule, from the molecules' maps."""
    return _parsed(spark, sf_dir).select("times", F.explode(molecules.ring_sizes(F.col("m"))).alias("size", "c")).groupBy("size").agg(F.sum(F.col("c") * F.col("times")).alias("rings"), F.sum("times").alias("molecules"), F.max("c").alias("most"))


QUERIES["element_table"], QUERIES["ring_sizes"] = element_table, ring_sizes


def _count_oracles() -> None:
    given = ", ".join("(" + ", ".join([str(z), f"'{s}'", *(f"{float(t.get(z, 0.0))!r}::DOUBLE" for t in _TABLES.values())]) + ")" for s, z in elements.ATOMIC_NUMBER.items())
    per_text = "JOIN (SELECT s, mol_id AS t FROM u) n ON n.s = texts.smiles"
    # Periods end with the noble gases; the places in a period, and the gap after the second one of a short period, give the group.
    ORACLES["element_table"] = f"""
        WITH RECURSIVE {_READ}, e(z, symbol, {', '.join(_TABLES)}) AS (VALUES {given}),
        p AS (SELECT *, CASE WHEN z <= 2 THEN 1 WHEN z <= 10 THEN 2 WHEN z <= 18 THEN 3 WHEN z <= 36 THEN 4 ELSE 5 END AS period FROM e),
        g AS (SELECT *, z - ([0, 2, 10, 18, 36])[period] AS place FROM p),
        k AS (SELECT *, CASE WHEN period = 1 THEN (CASE z WHEN 1 THEN 1 ELSE 18 END) WHEN place <= 2 OR period > 3 THEN place ELSE place + 10 END AS grp FROM g),
        tally AS (SELECT z, count(*) AS atoms, count(DISTINCT texts.mol_id) AS molecules FROM texts {per_text} JOIN plain ON plain.mol_id = n.t GROUP BY z)
        SELECT z::INT AS z, symbol, grp::INT AS grp, period::INT AS period, {', '.join(_TABLES)}, z IN (9, 17, 35, 53, 85) AS halogen, grp <= 2 OR grp >= 13 AS main_group, period >= 4 AND grp BETWEEN 3 AND 12 AS transition_metal,
               grp = 1 AND z > 2 AS alkali, grp = 2 AND z > 2 AS alkaline_earth, grp = 18 AS noble_gas, symbol NOT IN ('H', 'He', 'B', 'C', 'N', 'O', 'F', 'Ne', 'Si', 'P', 'S', 'Cl', 'Ar', 'Ge', 'As', 'Se', 'Br', 'Kr') AS metal,
               coalesce(atoms, 0) AS atoms, coalesce(molecules, 0) AS molecules FROM k LEFT JOIN tally USING (z)"""
    ORACLES["ring_sizes"] = f"""
        WITH RECURSIVE {_READ}, each AS (SELECT texts.mol_id, len(tour) AS size, count(*) AS c FROM texts {per_text} JOIN good ON good.mol_id = n.t JOIN rings ON rings.mol_id = n.t GROUP BY ALL)
        SELECT size, sum(c)::BIGINT AS rings, count(*) AS molecules, max(c) AS most FROM each GROUP BY size"""


_count_oracles()
