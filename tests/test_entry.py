"""The driver's contract holds, also without the pipeline subpackage."""

import subprocess
import sys
from pathlib import Path

ROOT = Path(__file__).resolve().parents[1]


def test_imports_without_a_session():
    out = subprocess.run([sys.executable, "-c", "import __spark_entry__ as e; q, s = e.queries(), e.oracle_sql(); assert set(s) <= set(q); print(len(q), len(s))"], cwd=ROOT, capture_output=True, text=True)
    assert out.returncode == 0, out.stderr
    assert tuple(map(int, out.stdout.split()[-2:])) >= (74, 71)


def test_nothing_outside_the_subpackage_imports_it():
    for p in (ROOT / "shellspark").rglob("*.py"):
        if "llm" not in p.parts:
            assert "llm" not in p.read_text(), p


def test_flagship(spark):
    import __spark_entry__

    df = __spark_entry__.entry(spark)
    assert df.columns == ["bin", "d", "mddf", "coordination_number"] and df.count() == 100
