import __spark_entry__


def test_the_entry_runs(spark):
    assert __spark_entry__.entry(spark).columns == ["event_id", "user_id", "event_type", "last_view", "last_click"]


def test_every_sql_has_its_query():
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())


def test_the_entry_is_imported_without_a_session():
    import subprocess
    import sys
    from pathlib import Path

    subprocess.run([sys.executable, "-c", "import __spark_entry__ as e; assert e.queries().keys() >= e.oracle_sql().keys()"], cwd=Path(__file__).resolve().parents[1], check=True, timeout=120)
