import os
import subprocess
import sys

import pytest
from conftest import SF, duck, same

from graphloom.plans import catalog, end_to_end  # noqa: F401  it adds its queries


@pytest.mark.parametrize("name", sorted(catalog.ORACLES))
def test_same_rows_as_duckdb(spark, name):
    rows = [r.asDict() for r in catalog.QUERIES[name](spark, SF).collect()]
    assert same(rows, duck(catalog.ORACLES[name]))


def test_entry(spark):
    import __spark_entry__ as e

    assert e.entry(spark).count() > 0
    assert set(e.oracle_sql()) <= set(e.queries())
    assert os.path.isdir(SF)


def test_rows_only(spark):
    catalog.QUERIES["q_annotate_extract"](spark, SF).collect()


def test_entry_without_a_package_that_others_made():
    """The core queries stay if something that only the training-data operators need isn't installed."""
    code = "import sys; sys.modules['xxhash'] = None; sys.modules['public_tokenizers'] = None; import __spark_entry__ as e; assert 'q_sentences' in e.queries() and not any(k.startswith('op') for k in e.queries()); print('ok')"
    assert subprocess.run([sys.executable, "-c", code], capture_output=True, text=True, check=True).stdout == "ok\n"
