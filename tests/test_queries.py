"""Every query against its SQL, at the smallest scale."""

import pytest
from pairs import same

from opsgrain.plans import anomaly_queries, data_queries, search_queries, stream_queries

SF = "/root/testdata/sf0.001"
CASES = [(m, n) for m in (anomaly_queries, search_queries, data_queries, stream_queries) for n in m.QUERIES]


@pytest.mark.parametrize("module,name", CASES, ids=[n for _, n in CASES])
def test_query(spark, module, name):
    if name in module.SQL:
        same(spark, module.QUERIES[name], module.SQL[name], SF)
    else:
        assert module.QUERIES[name](spark, SF).count() > 0
