import numpy as np
import pytest
from pyspark.sql import functions as F

from molquarry.functions import strings
from molquarry.functions.electronegativity import ELECTRONEGATIVITY
from molquarry.functions.tokens import TOKEN_CLOSED, plane_statistics, planes


def values(spark, family, smiles):
    df = spark.createDataFrame([(smiles,)], "smiles string")
    return family.add_to(df, F.col("smiles")).first().asDict()


def test_counts(spark):
    v = values(spark, strings.STRING_COUNTS, "CC(=O)Oc1ccccc1Cl")
    assert v["SmilesCarbonCount"] == 9 and v["SmilesChlorineCount"] == 1 and v["SmilesEsterCount"] == 1 and v["SmilesHalogenCount"] == 1 and v["SmilesBranchOpenCount"] == 1


def test_electronegativity_stops_at_the_first_mark(spark):
    v = values(spark, ELECTRONEGATIVITY, "CCO(N)")
    assert v["SmilesPaulingENSum"] == pytest.approx(2.55 * 2 + 3.44)
    assert v["SmilesENMaxMinRatio"] == pytest.approx(3.44 / 2.55)
    assert values(spark, ELECTRONEGATIVITY, "")["SmilesPaulingENMean"] == 0


def test_null_and_empty_texts_count_as_empty(spark):
    df = spark.createDataFrame([(1, None), (2, "")], "k long, smiles string")
    for family in (strings.STRING_COUNTS, strings.STRING_RATIOS, strings.CHAR_FRACTIONS, TOKEN_CLOSED):
        a, b = family.add_to(df.drop("k"), F.col("smiles")).drop("smiles").collect()
        assert a == b and all(x is not None for x in a)


@pytest.mark.parametrize("smiles", ["CCO", "Clc1ccc2[nH]cc(C#N)c2c1.Br", "C1CC1C=C%10CC%10", "=", "11C", "[Na+].[Cl-]"])
def test_closed_forms_are_those_of_the_planes(spark, smiles):
    v = values(spark, TOKEN_CLOSED, smiles)
    t, ty = planes(smiles)
    n = len(ty)
    if n < 2:
        return
    assert v["SpitActivationDensity"] == pytest.approx((t > 1e-12).mean())
    assert v["SpitMeanOfFeaturePlanes"] == pytest.approx(t.mean())
    assert v["SpitVarianceOfFeaturePlanes"] == pytest.approx(np.mean([p.var(ddof=1) for p in t]))
    assert v["SpitRingParticipationIndexPerToken"] == pytest.approx(t[2].sum(axis=1).max())
    assert v["SpitMatchingTokenPairCount"] == pytest.approx((t[0].sum() - n) / 2)
    sign = (-1.0) ** np.add.outer(np.arange(n), np.arange(n))
    assert v["SpitCheckerboardPatternStrength"] == pytest.approx(abs((sign * t[0]).sum()) / n / n)


def test_class_shares_add_up(spark):
    df = spark.createDataFrame([("CC(=O)Nc1ccc(O)cc1",)], "s string")
    r = plane_statistics(df, F.col("s")).first()
    assert r["SpitIntraClassInteractionRatio"] + r["SpitInterClassInteractionRatio"] == pytest.approx(1)
