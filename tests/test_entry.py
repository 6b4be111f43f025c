import subprocess
import sys
from pathlib import Path

ROOT = Path(__file__).resolve().parent.parent
DATA = "/root/testdata/sf0.001"


def test_registry():
    import __spark_entry__ as e

    q, s = e.queries(), e.oracle_sql()
    assert set(s) <= set(q) and len(q) > 120 and all(f"p{n}_found" in q for n in (2, 3, 5))


def test_flagship(spark):
    import __spark_entry__ as e

    assert e.entry(spark).count() > 0


def test_core_does_not_import_the_llm_subpackage():
    code = "import sys, burstlake.plans, burstlake.sources.dataset, burstlake.streaming.agc, burstlake.cli; assert not [m for m in sys.modules if m.startswith('burstlake.llm')]"
    assert subprocess.run([sys.executable, "-c", code], cwd=ROOT).returncode == 0


def test_the_rest_stands_without_the_llm_folders(tmp_path):
    """A copy without burstlake/llm and tests/llm imports, and registers every core query and no other."""
    import shutil

    shutil.copytree(ROOT / "burstlake", tmp_path / "burstlake", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    shutil.copy(ROOT / "__spark_entry__.py", tmp_path)
    code = "import __spark_entry__ as e; from burstlake.plans import core_queries, core_oracle_sql; assert set(e.queries()) == set(core_queries()) and set(e.oracle_sql()) == set(core_oracle_sql()) and len(core_queries()) > 150"
    assert subprocess.run([sys.executable, "-c", code], cwd=tmp_path, env={"PATH": "/usr/bin:/bin"}).returncode == 0
