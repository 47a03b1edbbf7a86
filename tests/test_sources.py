import pytest

from comarca.sources import CORRUPT, read_model, register_model, scan_csv, work_folder, write_model

AWKWARD = [
    ("02", 'Córdoba, ""x""\nl2'), ("007", "  outer spaces  "), ("1", 'one "quote"'), ("2", "back\\slash"),
    ("3", "a,b;c\td"), ("4", None),
]


def test_csv_round_trip_keeps_codes_quotes_breaks_and_spaces(spark, tmp_path):
    df = spark.createDataFrame(AWKWARD, "code string, name string")
    write_model(df, str(tmp_path), "t")
    back = scan_csv(spark, f"{tmp_path}/t.csv", df.schema, multi_line=True)
    assert sorted((r.code, r.name) for r in back.collect()) == sorted(AWKWARD)
    assert [r[CORRUPT] for r in back.collect()] == [None] * len(AWKWARD)
    stored = read_model(spark, str(tmp_path), "t")
    assert sorted(tuple(r) for r in stored.collect()) == sorted(AWKWARD)


def test_short_rows_and_bad_numbers_are_flagged(spark, tmp_path):
    path = tmp_path / "register.csv"
    path.write_text("code,name,n\n02,a,1\n04,c\n05,d,xx\n")
    rows = scan_csv(spark, str(path), "code string, name string, n int").collect()
    assert [(r.code, r.name, r.n, r[CORRUPT]) for r in rows] == [
        ("02", "a", 1, None), ("04", "c", None, "04,c"), ("05", "d", None, "05,d,xx")
    ]


@pytest.mark.parametrize("columns", ["name string, code string, n int", "code string, name string"])
def test_another_header_fails_the_read(spark, tmp_path, columns):
    path = tmp_path / "register.csv"
    path.write_text("code,name,n\n02,a,1\n")
    with pytest.raises(Exception, match="FAILED_READ_FILE"):
        scan_csv(spark, str(path), columns).collect()


def test_csv_files_are_kept_small(spark, tmp_path):
    write_model(spark.range(0, 250, 1, 1), str(tmp_path), "t", rows_per_file=100)
    assert len(list((tmp_path / "t.csv").glob("part-*"))) == 3


def test_registered_tables_answer_sql(spark, tmp_path):
    write_model(spark.range(7), str(tmp_path), "libraries")
    register_model(spark, str(tmp_path), {"libraries": "id bigint"}, prefix="t_")
    assert spark.sql("select count(*), max(id) from t_libraries").first() == (7, 6)


def test_work_folder_lies_in_the_shared_folder(spark):
    shared = spark.conf.get("spark.checkpoint.dir")
    first, second = work_folder(spark), work_folder(spark)
    assert first.startswith(shared + "/") and first != second


class ClusterWithoutFolder:
    """Stands in for a session on a cluster that names no shared folder."""

    class conf:
        get = staticmethod(lambda key, default: default)

    class sparkContext:
        master = "yarn"


def test_no_machine_local_folder_on_a_cluster():
    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        work_folder(ClusterWithoutFolder)
