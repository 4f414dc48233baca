import pathlib

import pytest

from corpweave import registry
from tests.util import same


@pytest.mark.parametrize("name", sorted(registry.oracle_sql()))
def test_query_equals_its_oracle(spark, sf, duck, name):
    same(registry.queries()[name](spark, sf), duck.sql(registry.oracle_sql()[name]))


@pytest.mark.parametrize("name", sorted(set(registry.queries()) - set(registry.oracle_sql())))
def test_query_without_oracle_is_compared_elsewhere(name):
    assert any(f'"{name}"' in f.read_text() for f in pathlib.Path(__file__).parent.glob("test_*.py") if f.name != pathlib.Path(__file__).name)
