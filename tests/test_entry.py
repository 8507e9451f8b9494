import __spark_entry__ as entry


def test_entry_has_rows(spark):
    assert entry.entry(spark).count() > 0


def test_every_sql_has_a_query():
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_nothing_outside_imports_the_optional_subpackage():
    import pathlib
    import re

    root = pathlib.Path(entry.__file__).parent
    for p in root.glob("opinara/**/*.py"):
        if "llm" not in p.parts:
            assert not re.search(r"opinara\.llm|corpus_pipeline", p.read_text()), p
