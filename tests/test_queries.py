import pytest

import __spark_entry__
from corpusmill.plans import catalogue
from tests.compare import same

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(catalogue.QUERIES))
def test_same_rows_as_sql(spark, name):
    same(catalogue.QUERIES[name](spark, SF), SF, catalogue.ORACLES[name])


def test_entry(spark):
    assert __spark_entry__.entry(spark).count() > 0


def test_every_query_of_the_catalogue_is_registered():
    assert set(catalogue.QUERIES) <= set(__spark_entry__.queries())
    assert set(catalogue.ORACLES) == set(catalogue.QUERIES)
