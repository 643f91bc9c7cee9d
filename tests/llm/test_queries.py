"""The queries of the subpackage run over whole tables; those with SQL agree with it."""

from pathlib import Path

import pytest

from noticeworks.llm.queries import ORACLE, QUERIES
from tests.compare import both


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, root, name):
    if name.startswith("p2_"):  # messages must recur in three sources, which the smallest tables are too small for
        root = root.replace("sf0.001", "sf0.01")
    if name in ORACLE:
        ours, theirs = both(spark, root, QUERIES[name], ORACLE[name])
        assert ours == theirs
    else:
        df = QUERIES[name](spark, root)
        assert df.count() > 0 or name == "p6_groups"
        if name.endswith("_found"):
            assert df.count() == df.distinct().count()


def test_core_does_not_import_the_subpackage():
    import noticeworks

    home = Path(noticeworks.__file__).parent
    assert not [p for p in home.rglob("*.py") if "llm" not in p.relative_to(home).parts and "noticeworks.llm" in p.read_text()]
