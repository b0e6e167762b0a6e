import pytest
from pyspark.sql import functions as F

from candor.functions import algebra as A
from candor.functions import series


@pytest.fixture(scope="module")
def one(spark):
    rows = [({"SCA_1": 3, "SCB_1": 5, "SCA_2": 4, "SCB_3": 2}, {"SCA_1": 1, "PK_9": 1}, [{"SCA_1": 1}, {}, {"SCB_2": 2, "PK_1": 1}])]
    return spark.createDataFrame(rows, "p map<string,int>, q map<string,int>, poly array<map<string,int>>").cache()


def value(df, column):
    return df.select(column.alias("x")).first()["x"]


def test_product_adds_exponents_and_null_is_the_constant(one):
    assert value(one, A.times(F.col("p"), F.col("q"))) == {"SCA_1": 4, "SCB_1": 5, "SCA_2": 4, "SCB_3": 2, "PK_9": 1}
    assert value(one, A.times(F.col("p"), F.lit(None).cast(A.VARS_TYPE))) == value(one, F.col("p"))
    assert value(one, A.degree(F.col("p"))) == 14 and value(one, A.cardinality(F.col("p"))) == 4


def test_products_of_polynomials_are_one_monomial(one):
    assert value(one, A.product(F.col("poly"))) == {"SCA_1": 1, "SCB_2": 2, "PK_1": 1}


def test_sum_concatenates_and_drops_constants(one):
    assert value(one, A.plus(F.array("poly", "poly"))) == [{"SCA_1": 1}, {"SCB_2": 2, "PK_1": 1}] * 2
    assert value(one, A.degree_sum(F.col("poly"))) == 4 and value(one, A.max_degree(F.col("poly"))) == 3


def test_simplify_cancels_simultaneous_violations(one, spark):
    assert value(one, A.simplify(F.col("p"), "SCA", "SCB")) == {"SCB_1": 2, "SCA_2": 4, "SCB_3": 2}
    equal = spark.createDataFrame([({"SCA_1": 3, "SCB_1": 3},)], "p map<string,int>")
    assert value(equal, A.simplify(F.col("p"), "SCA", "SCB")) == {}


def test_exponents_slide_and_quantifier(one):
    assert sorted(value(one, A.exponents(F.col("p"), "SCA"))) == [3, 4]
    assert value(one, A.exponents(F.col("p"), "XX")) == [0]
    assert value(one, A.slide(F.col("p"), F.lit(1), F.lit(3))) == {"SCA_1": 3, "SCB_1": 5, "SCA_2": 4}
    assert value(one, A.quantify_without(F.col("poly"), ["SCA", "PK"])) == 1


def test_text_is_canonical_and_leaves_out_exponents_below_one(one, spark):
    assert value(one, A.text(F.col("q"))) == "1<PK_9>^1<SCA_1>^1" and value(one, A.poly_text(F.col("poly"))) == "1<SCA_1>^1+1+1<PK_1>^1<SCB_2>^2"
    odd = spark.createDataFrame([({"SC_1": 0, "SC_2": -3},)], "p map<string,int>")
    assert value(odd, A.text(F.col("p"))) == "1"


def test_durations(spark):
    assert [series.parse_duration(x) for x in ("250", "90s", "1h30m", "2d1ms")] == [250, 90_000, 5_400_000, 172_800_001]
    with pytest.raises(ValueError, match="not a duration"):
        series.parse_duration("soon")
    df = spark.createDataFrame([("250",), ("1h30m",), ("soon",)], "t string")
    assert [r["x"] for r in df.select(series.parse_duration_column(F.col("t")).alias("x")).collect()] == [250, 5_400_000, None]
