import pytest

from nearledger.plans.oracles import ORACLES
from nearledger.plans.queries import QUERIES

from .compare import DATA, check

pytestmark = pytest.mark.skipif(not DATA.exists(), reason="the driver's tables are not here")


def test_every_query_has_sql():
    assert QUERIES.keys() == ORACLES.keys()


@pytest.mark.parametrize("name", QUERIES)
def test_query_against_sql(spark, name):
    check(spark, QUERIES[name], ORACLES[name])
