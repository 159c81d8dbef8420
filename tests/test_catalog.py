import pytest

from geomlake.plans import catalog, registry
from tests.compare import differences

SF = "/root/testdata/sf0.001"
QUERIES = catalog.queries()


@pytest.mark.parametrize("name", [n for n in QUERIES if n in registry.SQL])
def test_equals_sql(spark, name):
    assert not differences(QUERIES[name](spark, SF), registry.SQL[name], SF)


#: These run in test_models.
SLOW = {"model_grid", "dimension_choice"}


@pytest.mark.parametrize("name", [n for n in QUERIES if n not in registry.SQL and n not in SLOW])
def test_runs_without_sql(spark, name):
    rows = QUERIES[name](spark, SF).collect()
    assert rows and all(v is not None for v in rows[0])


def test_operators_built_in_part_are_not_claimed():
    claimed = {c for covers in registry.COVERS.values() for c in covers}
    assert not claimed & {"S11", "S18", "S19", "K09", "K11"} and "H08" not in registry.COVERS["tfce_scores"]


def test_banded_ridge_partition_searches_the_whole_grid(spark, monkeypatch):
    from geomlake.operators import models

    seen = []
    monkeypatch.setattr(models, "banded_ridge", lambda design, groups, targets, n_draws=20, penalties=None: seen.append((n_draws, penalties)))
    QUERIES["banded_ridge_partition"](spark, SF)
    assert seen == [(20, None)] and "M04" not in registry.COVERS["banded_ridge_partition"] and "M04" in registry.COVERS["connective_ridge"]


def test_entry_contract(spark):
    import __spark_entry__ as e

    assert e.entry(spark).count() == 10
    assert set(e.oracle_sql()) <= set(e.queries())


def test_library_does_without_the_llm_package(tmp_path):
    """A copy without the llm package and the pipeline still gives the library's queries."""
    import shutil
    import subprocess
    import sys
    from pathlib import Path

    root = Path(__file__).resolve().parents[1]
    shutil.copytree(root / "geomlake", tmp_path / "geomlake", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    shutil.copy(root / "__spark_entry__.py", tmp_path)
    code = "import __spark_entry__ as e; q = e.queries(); assert 'rdm_label_summary' in q and not any(n.startswith('op') or n == 'pipeline' for n in q), q"
    subprocess.run([sys.executable, "-c", code], cwd=tmp_path, check=True)
