import pytest

from namesift.session import stage, stage_root
from namesift.sources import read_table, write_table

SCHEMA = "row int, sentence string, country string"
ROWS = [(0, 'say "cases", please', "france"), (1, "", None), (2, "é, two", "peru")]


def test_csv_round_trip_keeps_quotes_nulls_and_empty_strings(spark, tmp_path):
    df = spark.createDataFrame(ROWS, SCHEMA)
    write_table(df, str(tmp_path / "t"), "csv")
    back = read_table(spark, str(tmp_path / "t"), "csv", SCHEMA)
    assert sorted(map(tuple, back.collect())) == ROWS


def test_csv_options(spark, tmp_path):
    path = tmp_path / "plain.csv"
    path.write_text('0,"a ""b"", c",x\n1,d,\n')
    df = read_table(spark, str(path), "csv", SCHEMA, header=False, index="rename")
    assert df.columns == ["id", "sentence", "country"]
    assert sorted(map(tuple, df.collect())) == [(0, 'a "b", c', "x"), (1, "d", None)]
    assert read_table(spark, str(path), "csv", SCHEMA, header=False, index="drop").columns == ["sentence", "country"]


def test_line_breaks_in_quotes_need_the_option(spark, tmp_path):
    path = tmp_path / "lines.csv"
    path.write_text('row,sentence,country\n0,"a\nb",x\n')
    df = read_table(spark, str(path), "csv", SCHEMA, multiline=True)
    assert [r["sentence"] for r in df.collect()] == ["a\nb"]


def test_a_csv_needs_a_schema(spark):
    with pytest.raises(ValueError):
        read_table(spark, "x.csv", "csv")
    with pytest.raises(ValueError):
        read_table(spark, "x", "xml")


def test_catalog_table_is_overwritten(spark):
    write_table(spark.createDataFrame(ROWS, SCHEMA), "sentences_out", "table")
    write_table(spark.createDataFrame(ROWS[:1], SCHEMA), "sentences_out", "table")
    assert read_table(spark, "sentences_out", "table").count() == 1
    spark.sql("DROP TABLE sentences_out")


def test_parquet_is_overwritten(spark, tmp_path):
    for rows in (ROWS, ROWS[1:]):
        write_table(spark.createDataFrame(rows, SCHEMA), str(tmp_path / "p"))
    assert read_table(spark, str(tmp_path / "p")).count() == 2


def test_stage_uses_the_shared_folder(spark):
    staged = stage(spark.createDataFrame(ROWS, SCHEMA), "check")
    assert all(f.startswith("file://" + stage_root(spark)) for f in staged.inputFiles())
    assert staged.count() == 3


def test_escaped_csv_keeps_line_breaks_on_one_line(spark, tmp_path):
    data = [(1, 'a "b", c\nd\r\n\\n \\b \\\\ e', None), (2, "", "\\"), (3, "\n", "\\nb")]
    df = spark.createDataFrame(data, "id int, text string, other string")
    write_table(df, str(tmp_path / "t"), "csv", escaped=True)
    assert spark.read.text(str(tmp_path / "t" / "*.csv")).filter("value not like 'id,%'").count() == 3
    back = read_table(spark, str(tmp_path / "t"), "csv", df.schema, escaped=True)
    assert sorted(map(tuple, back.collect())) == data
