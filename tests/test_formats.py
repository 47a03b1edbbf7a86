from comarca.operators.formats import mine_formats

SCHEMA = "value string, level string"


def found(spark, values, **settings):
    df = spark.createDataFrame([(v, None) for v in values], SCHEMA)
    return {tuple(r) for r in mine_formats(df, ["value", "level"], **settings).collect()}


def test_formats_and_placeholders(spark):
    dates = [f"{1 + i % 28:02}/{1 + i % 12:02}/{1900 + i % 90}" for i in range(300)]
    years = [str(1900 + i % 90) for i in range(150)]
    names = ["".join("xyz"[j % 3] for j in range(3 + i)) + " " + str(i) for i in range(40)]
    mixed = [f"{chr(65 + i % 26)}{i}b{i}" * (1 + i // 9) + "!" for i in range(30)]
    got = found(spark, dates + years + names + mixed + ["s/d"] * 20 + [None] * 50 + ["", "?!"], share=0.04, placeholder_share=0.02)
    assert got == {
        ("value", 0, "99/99/9999", 300, len(set(dates)), min(dates), False),
        ("value", 0, "9999", 150, 90, "1900", False),
        ("value", 0, "a/a", 20, 1, "s/d", True),
        ("value", 1, "a+ 9+", 40, 40, min(names), False),
        ("value", 2, "w+!", 30, 30, min(mixed), False),
        ("value", 3, "*", 2, 2, "", False),
    }


def test_one_value_is_no_placeholder(spark):
    assert found(spark, ["N/A"] * 9) == {("value", 0, "A/A", 9, 1, "N/A", False)}


def test_letters_of_any_script(spark):
    assert found(spark, ["Ñu", "Éa", "٣", "語"], share=0.2) == {
        ("value", 0, "Aa", 2, 2, "Éa" if "Éa" < "Ñu" else "Ñu", False), ("value", 0, "9", 1, 1, "٣", True), ("value", 0, "A", 1, 1, "語", True)}


def test_nothing(spark):
    assert found(spark, []) == set() and found(spark, [None]) == set()
