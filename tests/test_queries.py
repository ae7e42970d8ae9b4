import pytest
from oracle import SF, TABLES, compare

from pagemill.queries import QUERIES


@pytest.mark.parametrize("name", [k for k, (_, sql) in QUERIES.items() if sql])
def test_query_equals_sql(spark, name):
    query, sql = QUERIES[name]
    compare(query(spark, SF), sql)


def test_entry(spark):
    import __spark_entry__ as e

    assert e.entry(spark).count() > 0
    assert set(e.oracle_sql()) <= set(e.queries())


def tables_as_folders(top):
    """Tables are files, folders of files and folders of such folders in turn."""
    for k, t in enumerate(TABLES):
        at = top / f"{t}.parquet" / ("", "part-0.parquet", "k=1/part-0.parquet")[k % 3]
        at.parent.mkdir(parents=True, exist_ok=True)
        at.write_bytes(b"PAR1")
    return str(top)


def test_drop_lists_tables_that_are_folders(spark, tmp_path):
    (tmp_path / ".hidden.parquet").mkdir()
    (tmp_path / "folder").mkdir()
    query, sql = QUERIES["listing_drop"]
    assert compare(query(spark, tables_as_folders(tmp_path)), sql) == len(TABLES)
    (tmp_path / "none.parquet").mkdir()
    assert [tuple(r) for r in query(spark, str(tmp_path)).where("NOT has_bytes").collect()] == [("none.parquet", False)]


def test_picker_lists_tables_that_are_folders(spark, tmp_path):
    query, sql = QUERIES["listing_picker"]
    assert compare(query(spark, tables_as_folders(tmp_path)), sql) == len(TABLES)
    (tmp_path / ".hidden.parquet").mkdir()
    (tmp_path / ".hidden.parquet" / "part-0.parquet").write_bytes(b"PAR1")
    assert [tuple(r) for r in query(spark, str(tmp_path)).where("file_name LIKE '.%'").collect()] == [(".hidden.parquet", True)]
