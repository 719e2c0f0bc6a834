"""Documentation stays in step with the registry."""

import os

from conftest import ROOT


def test_every_query_is_documented():
    import __spark_entry__ as E
    readme = open(os.path.join(ROOT, "README.md"), encoding="utf-8").read()
    missing = [name for name in E.queries() if name not in readme]
    assert not missing, missing
