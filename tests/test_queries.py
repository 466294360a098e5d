"""Every registered core query that has SQL equals it on the smallest tables; the others run and give rows."""

import importlib
import os

import pytest
from compare import check_query

SF = "/root/testdata/sf0.001"
MODULES = [importlib.import_module(f"strainloom.queries.{m}") for m in ("training_data", "network", "diversity", "association", "attribution", "stability", "inference", "details")]
NAMES = [(m, n) for m in MODULES for n in m.QUERIES]
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")


@pytest.mark.parametrize("module,name", NAMES, ids=[n for _, n in NAMES])
def test_query(spark, module, name):
    if name in module.SQL:
        check_query(spark, name, module.QUERIES[name], module.SQL[name], SF)
    else:
        df = module.QUERIES[name](spark, SF)
        assert df.columns and df.count() > 0
