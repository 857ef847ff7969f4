import pytest
from pyspark.errors import AnalysisException
from pyspark.sql import functions as F

from prioscope.operators import cleaning as C
from prioscope.sources import files

SCHEMA = "`Ticket Subject` string, `Ticket Description` string, `Ticket Priority` string, `Resolution Time` string"


def raw(spark, rows):
    return spark.createDataFrame(rows, SCHEMA)


def test_priorities(spark):
    given = ["URGENT", " very HIGH ", "normal", "low PRIORITY", "not specified", None, "critical", "\tHigh\n"]
    df = raw(spark, [("s", "d", p, "1") for p in given])
    got = [r.priority for r in C.clean_tickets(df).collect()]
    assert sorted(got) == sorted(["Critical", "Critical", "Medium", "Low", "Critical", "High"])


def test_hours_are_parsed_or_filled_with_the_median_of_kept_rows(spark):
    given = ["12", " 12 ", "1e2", "12 hours", "1d", "0x1p3", "n/a", "-3", "0", None, ".5", "5.", "+7", "1_0"]
    rows = [("s", str(i), "Low", h) for i, h in enumerate(given)] + [("s", "dropped", "nope", "1000000")]
    got = {r.description: r.resolution_hours for r in C.clean_tickets(raw(spark, rows)).collect()}
    known = sorted([12, 12, 100, -3, 0, 0.5, 5, 7])
    middle = (known[3] + known[4]) / 2
    assert got["0"] == 12 and got["1"] == 12 and got["2"] == 100 and got["7"] == -3 and got["12"] == 7
    for i in (3, 4, 5, 6, 9, 13):
        assert got[str(i)] == pytest.approx(middle)
    assert "dropped" not in got


def test_ids_are_numbered_before_the_filter(spark, tmp_path):
    rows = [("s", str(i), "Low" if i % 3 else "nope", "1") for i in range(30)]
    path = str(tmp_path / "t")
    raw(spark, rows).coalesce(1).write.csv(path, header=True)
    got = {r.description: r.ticket_id for r in C.clean_tickets(files.read_tickets(spark, path)).collect()}
    assert len(got) == 20
    assert got["1"] == "TKT-00002" and got["29"] == "TKT-00030"


def test_numbering_in_scan_order_over_many_files(spark, tmp_path):
    path = str(tmp_path / "many")
    spark.range(0, 1000, numPartitions=7).write.parquet(path)
    from prioscope.operators.ordering import number_as_read

    rows = number_as_read(spark.read.parquet(path), "n").collect()
    assert sorted(r.n for r in rows) == list(range(1, 1001))


@pytest.mark.parametrize("gone", ["Ticket Subject", "Ticket Description", "Ticket Priority", "Resolution Time"])
def test_absent_columns(spark, gone):
    df = raw(spark, [(" A ", "B", "High", "3"), (None, None, "Low", None)]).drop(gone)
    rows = C.clean_tickets(df).collect()
    assert len(rows) == 2
    first = [r for r in rows if r.resolution_hours is not None]
    assert len(first) == 2
    for r in rows:
        assert r.channel == r.ticket_type == r.customer_email == r.product == "Unknown"
        if gone == "Ticket Priority":
            assert r.priority == "Medium"
        if gone == "Resolution Time":
            assert r.resolution_hours == 24.0
        if gone == "Ticket Subject":
            assert r.subject == ""
    assert {r.combined_text for r in rows} <= {"", "a b", "a", "b"}


def test_all_hours_missing_and_empty_table(spark):
    rows = C.clean_tickets(raw(spark, [("s", "d", "Low", None)])).collect()
    assert rows[0].resolution_hours is None
    assert C.clean_tickets(raw(spark, [])).count() == 0


def test_counts_and_observation(spark):
    from pyspark.sql import Observation

    df = raw(spark, [("s", "d", p, "1") for p in ("Low", "x", "High")])
    row = C.cleaning_counts(df).first()
    assert (row.rows_before, row.rows_after) == (3, 2)
    seen = Observation("r")
    C.observe_rows(C.clean_tickets(df), seen).collect()
    assert seen.get["rows"] == 2


def test_csv_round_trip_with_missing_tokens(spark, tmp_path):
    rows = [('say "hi", twice', "line one\nline two", "High", "NaN"), ("", "NULL", "Low", "3"), (" pad ", "None", "N/A", "<NA>")]
    path = str(tmp_path / "csv")
    files.write_csv(raw(spark, rows), path)
    back = {r["Ticket Subject"]: r for r in files.read_ticket_csv(spark, path).collect()}
    assert back['say "hi", twice']["Ticket Description"] == "line one\nline two"
    assert back['say "hi", twice']["Resolution Time"] is None
    assert back[None]["Ticket Description"] is None
    assert back[" pad "]["Ticket Priority"] is None and back[" pad "]["Resolution Time"] is None


def test_missing_file_raises(spark, tmp_path):
    with pytest.raises(AnalysisException):
        files.read_tickets(spark, str(tmp_path / "absent.csv"))


def test_display_columns_keep_what_is_there(spark):
    df = spark.createDataFrame([("1", "s")], "ticket_id string, subject string")
    assert files.display_columns(df).columns == ["ticket_id", "subject"]


def test_preview_is_ordered(spark):
    df = spark.range(100).orderBy(F.desc("id"))
    assert [r.id for r in C.preview(df, "id", 3).collect()] == [0, 1, 2]
