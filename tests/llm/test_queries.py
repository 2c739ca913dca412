import pytest
from conftest import canonical

from quireforge.llm import queries


@pytest.mark.parametrize("name", sorted(queries.QUERIES))
def test_query(spark, small, duck, name):
    df = queries.QUERIES[name](spark, small)
    if name in queries.ORACLES:
        got, want = df.toPandas(), duck.execute(queries.ORACLES[name]).df()
        assert sorted(got.columns) == sorted(want.columns) and canonical(got) == canonical(want)
    else:
        df.write.format("noop").mode("overwrite").save()


def test_the_rest_does_not_need_this_package():
    import pathlib

    root = pathlib.Path(queries.__file__).parents[1]
    for f in root.rglob("*.py"):
        if "llm" not in f.relative_to(root).parts:
            assert "llm" not in f.read_text(), f
