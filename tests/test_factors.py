import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st

from sparkloom.operators import factors as fx


def factor(spark, names, cells):
    return spark.createDataFrame(
        [(*key, float(p)) for key, p in cells.items()], ", ".join(f"{n} string" for n in names) + ", p double"
    )


AB = {"TT": .3, "TF": .7, "FT": .9, "FF": .1}
BC = {"TT": .2, "TF": .8, "FT": .6, "FF": .4}


def as_dict(df, names):
    return {"".join(r[n] for n in names): round(r["p"], 9) for r in df.collect()}


def test_product_shared_variable(spark):
    got = fx.product(factor(spark, "AB", AB), factor(spark, "BC", BC))
    assert as_dict(got, "ABC") == {
        "TTT": .06, "TTF": .24, "TFT": .42, "TFF": .28, "FTT": .18, "FTF": .72, "FFT": .06, "FFF": .04}


def test_product_disjoint_pairs(spark):
    got = as_dict(fx.product(factor(spark, "AB", AB), factor(spark, "CD", BC)), "ABCD")
    assert len(got) == 16
    for key, value in {"TTTT": .06, "TTTF": .24, "TTFT": .18, "TTFF": .12, "FTTF": .72, "FFFF": .04}.items():
        assert got[key] == value


def test_product_disjoint_singles(spark):
    got = fx.product(factor(spark, "A", {"T": .3, "F": .7}), factor(spark, "B", {"T": .2, "F": .8}))
    assert as_dict(got, "AB") == {"TT": .06, "TF": .24, "FT": .14, "FF": .56}


def test_product_single_with_pair(spark):
    got = fx.product(factor(spark, "A", {"T": .3, "F": .7}), factor(spark, "BC", BC))
    assert as_dict(got, "ABC") == {
        "TTT": .06, "TTF": .24, "TFT": .18, "TFF": .12, "FTT": .14, "FTF": .56, "FFT": .42, "FFF": .28}


def test_sum_out(spark):
    joint = fx.product(factor(spark, "AB", AB), factor(spark, "BC", BC))
    assert as_dict(fx.sum_out(joint, "B"), "AC") == {"TT": .48, "TF": .52, "FT": .24, "FF": .76}
    assert round(fx.sum_out(joint, "A", "B", "C").first()["p"], 9) == 2.0
    with pytest.raises(ValueError):
        fx.sum_out(joint, "Z")


def test_zero_pruning_and_restrict(spark):
    f = factor(spark, "AB", {"TT": 0, "TF": 1, "FT": .5, "FF": .5})
    g = factor(spark, "A", {"T": .5, "F": .5})
    assert len(as_dict(fx.product_all([f, g]), "AB")) == 3
    assert len(as_dict(fx.product_all([f, g], keep_zeros=True), "AB")) == 4
    assert as_dict(fx.restrict(f, {"A": "F", "Q": "x"}), "AB") == {"FT": .5, "FF": .5}


def test_normalise(spark):
    f = factor(spark, "AB", {"TT": 1, "TF": 3, "FT": 2, "FF": 2})
    assert as_dict(fx.normalise(f), "AB") == {"TT": .125, "TF": .375, "FT": .25, "FF": .25}
    assert as_dict(fx.normalise(f, within=["A"]), "AB") == {"TT": .25, "TF": .75, "FT": .5, "FF": .5}


@settings(max_examples=5, deadline=None, suppress_health_check=list(HealthCheck))
@given(st.lists(st.integers(1, 20), min_size=8, max_size=8))
def test_product_commutes(spark, weights):
    keys = ["TT", "TF", "FT", "FF"]
    f = factor(spark, "AB", dict(zip(keys, weights[:4])))
    g = factor(spark, "BC", dict(zip(keys, weights[4:])))
    assert as_dict(fx.product(f, g), "ABC") == as_dict(fx.product(g, f), "ABC")


def test_elimination_order_does_not_matter(spark):
    f, g = factor(spark, "AB", AB), factor(spark, "BC", BC)
    h = factor(spark, "CD", AB)
    whole = fx.sum_out(fx.product_all([f, g, h]), "B", "C")
    rest = fx.product_all(fx.eliminate([f, g, h], ["B", "C"]))
    assert as_dict(rest, "AD") == as_dict(whole, "AD")
