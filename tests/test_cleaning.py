import datetime as dt

import pytest
from pyspark.sql import functions as F

from comarca import functions as fn
from comarca.operators import cleaning


def values(df):
    return [tuple(r) for r in df.collect()]


def texts(spark, *items):
    return spark.createDataFrame([(i, v) for i, v in enumerate(items)], "i int, v string").orderBy("i")


def apply(spark, func, *items):
    return [r[0] for r in texts(spark, *items).select(func(F.col("v"))).collect()]


def test_spelling_variants_become_one_name(spark):
    got = apply(spark, fn.normalize_text, "Córdoba", "CORDOBA", " córdoba ", "Tierra\n del\t Fuego", None)
    assert got == ["cordoba", "cordoba", "cordoba", "tierra del fuego", None]


def test_codes_are_padded_or_rejected_never_cut(spark):
    got = apply(spark, lambda c: fn.standardize_id(c, 2), "2", "02", " 7 ", "2007", "x1", "", None)
    assert got == ["02", "02", "07", None, None, None, None]


def test_composed_code_needs_both_parts(spark):
    df = spark.createDataFrame([("02", "007"), ("02", None)], "p string, d string")
    assert values(df.select(fn.compose_id(F.col("p"), F.col("d")))) == [("02007",), (None,)]


def test_email_domain(spark):
    got = apply(spark, fn.email_domain, None, "no address", "A@B.com", "a@b.com; c@d.org", "x@y")
    assert got == [None, None, "b.com", "b.com", None]


def test_email_domains(spark):
    assert apply(spark, fn.email_domains, "a@b.com; c@D.org", "none") == [["b.com", "D.org"], []]


@pytest.mark.parametrize("formats", [["yyyy-MM-dd", "dd/MM/yyyy"], ["d/M/yyyy", "yyyy-MM-dd"], ["d MMM yyyy", "yyyyMMdd"], ["dd'/'MM'/'yyyy"]])
def test_dates_read_the_same_with_and_without_shape(spark, formats):
    items = [
        "1950-01-01", "01/02/1950", "1/2/1950", "31/02/1950", "1950-13-01", "1950-1-1", "3 Feb 1950",
        "19500101", "", "no date", None, "1950-01-01x", "1950-01-01\n",
    ]
    guarded = apply(spark, lambda c: fn.parse_date(c, formats), *items)
    plain = apply(spark, lambda c: F.coalesce(*[F.try_to_date(fn.strip(c), f) for f in formats]), *items)
    assert guarded == plain
    assert any(guarded)


def test_integers_read_the_same_with_and_without_shape(spark):
    items = ["12", "-3", "+4", "007", "1.5", "xx", "", None, "99999999999999999999", "1e3", "12L", "--1"]
    for kind in ("int", "bigint"):
        got = apply(spark, lambda c: fn.parse_integer(c, kind), *items)
        assert got == apply(spark, lambda c: c.try_cast(kind), *items)


def test_unify_gives_null_for_what_does_not_fit(spark):
    df = spark.createDataFrame(
        [(" 012", "1950-01-01", "2.5"), ("xx", "01/02/1950", "y"), (None, "never", None)],
        "n string, d string, r string",
    )
    got = values(cleaning.unify(df, {"n": "bigint", "d": ["yyyy-MM-dd", "dd/MM/yyyy"], "r": "double"}))
    assert got == [
        (12, dt.date(1950, 1, 1), 2.5), (None, dt.date(1950, 2, 1), None), (None, None, None)
    ]


def test_null_treatment(spark):
    df = texts(spark, "S/D", "", " S/D ", None, "ok", " ok")
    nulls = cleaning.null_sentinel(df, ["v"], ["S/D", ""])
    assert [r.v for r in nulls.collect()] == [None, None, None, None, "ok", " ok"]
    assert [r.v for r in cleaning.null_fill(nulls, {"v": "-"}).collect()][:4] == ["-"] * 4
    assert cleaning.null_drop(nulls, ["v"]).count() == 2
    assert sorted(values(cleaning.null_profile(nulls))) == [("i", 6, 0), ("v", 6, 4)]


def test_since_is_inclusive_and_unreadable_dates_are_counted_apart(spark):
    df = texts(spark, "1949-12-31", "1950-01-01", "2000-05-05", "unreadable", None)
    dated = df.withColumn("founded", fn.parse_date(F.col("v"), ["yyyy-MM-dd"]))
    since = cleaning.filter_since(dated, "founded", 1950)
    assert [r.v for r in since.collect()] == ["1950-01-01", "2000-05-05"]
    tally = cleaning.since_tally(dated, "v", "founded", 1950).first()
    assert tally.asDict() == {"n_since": 2, "n_before": 1, "n_unreadable": 1, "n_missing": 1}


def test_rates_and_logarithms_at_zero(spark):
    df = spark.createDataFrame([(5, 1000), (5, 0), (0, 10)], "n long, pop long")
    rate = fn.per_thousand(F.col("n"), F.col("pop"))
    got = values(df.select(rate, fn.log10_safe(rate)))
    assert got[0] == (5.0, pytest.approx(0.69897, abs=1e-5))
    assert got[1:] == [(None, None), (0.0, None)]


def test_founding_year(spark):
    df = spark.createDataFrame([(dt.date(1950, 1, 1),), (None,)], "d date")
    assert values(df.select(fn.founding_year(F.col("d")))) == [(1950,), (None,)]


def test_outer_white_space_and_line_ends_are_no_part_of_a_value(spark):
    spaced = ["12", " 12", "12\t", "\u00a012\n", "12\r\n", "1 2", "12x"]
    assert apply(spark, fn.parse_integer, *spaced) == [12, 12, 12, 12, 12, None, None]
    assert apply(spark, lambda c: fn.standardize_id(c, 2), "7\n", "7\r", "\t7 ", "007", "7a\n") == ["07", "07", "07", None, None]


def test_one_spelling_for_composed_and_decomposed_letters(spark):
    names = ["C\u00f3rdoba", "Co\u0301rdoba", "CO\u0301RDOBA\u00a0", "\u00a0 C\u00f3rdoba"]
    assert set(apply(spark, fn.normalize_text, *names)) == {"cordoba"}
    assert apply(spark, fn.normalize_text, "Fran\u00e7a\u00a0 \u00c2vila") == ["franca avila"]


def test_a_default_must_be_of_the_columns_kind(spark):
    df = spark.createDataFrame([(1, None)], "n int, t string")
    with pytest.raises(TypeError):
        cleaning.null_fill(df, {"n": "none"})
    assert cleaning.null_fill(df, {"t": "none"}).first().t == "none"
