import pytest
from oracle import SF, same

from tilewright import catalog


@pytest.mark.parametrize("name", sorted(catalog.queries()))
def test_query(spark, name):
    query, sql = catalog.queries()[name], catalog.oracle_sql().get(name)
    if sql:
        same(spark, SF, name, query, sql)
    else:
        assert query(spark, SF).count() > 0


def test_entry(spark):
    import __spark_entry__ as e

    assert e.entry(spark).count() > 0
    assert set(e.oracle_sql()) <= set(e.queries())


def test_an_error_inside_the_optional_part_is_not_hidden():
    import subprocess
    import sys

    root = __import__("oracle").__file__.rsplit("/", 2)[0]
    import importlib.util

    if importlib.util.find_spec("tilewright.llm") is None:
        pytest.skip("the optional part is not here")
    raises = "import sys; sys.modules['pyarrow.compute'] = None; import __spark_entry__"
    done = subprocess.run([sys.executable, "-c", raises], capture_output=True, cwd=root)
    assert done.returncode != 0 and b"Error" in done.stderr


def test_rest_stands_without_the_optional_part():
    import subprocess
    import sys

    block = "import sys; sys.modules['tilewright.llm'] = None; import __spark_entry__ as e; assert e.queries() and not any(k.startswith('op') for k in e.queries())"
    subprocess.run([sys.executable, "-c", block], check=True, cwd=__import__("oracle").__file__.rsplit("/", 2)[0])
