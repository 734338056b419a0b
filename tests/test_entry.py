import __spark_entry__ as entry


def test_flagship(spark):
    assert entry.entry(spark).count() == 500


def test_registered_names():
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_core_does_not_need_the_corpus_package():
    from pathlib import Path

    root = Path(entry.__file__).parent / "vectorloom"
    for path in root.rglob("*.py"):
        if "llm" not in path.parts:
            assert "llm" not in path.read_text(), path
