"""The driver's contract."""

import shutil
import subprocess
import sys
from pathlib import Path

import __spark_entry__

ROOT = Path(__file__).resolve().parent.parent


def test_every_sql_has_its_query():
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())


def test_entry_gives_a_falling_spectrum(spark):
    got = __spark_entry__.entry(spark).orderBy("mode").collect()
    assert len(got) == 20 and all(a["sigma"] >= b["sigma"] for a, b in zip(got, got[1:], strict=False))


def test_the_rest_stands_alone(tmp_path):
    """Without the text part everything else is still there."""
    for name in ("modewave", "__spark_entry__.py"):
        src = ROOT / name
        (shutil.copytree if src.is_dir() else shutil.copy)(src, tmp_path / name)
    shutil.rmtree(tmp_path / "modewave" / "llm", ignore_errors=True)
    code = "import __spark_entry__ as e; q = e.queries(); assert 'leading_modes' in q and not any(k.startswith('op') and k[2].isdigit() or k == 'pipeline' for k in q)"
    subprocess.run([sys.executable, "-c", code], cwd=tmp_path, check=True, env={"PATH": "/usr/bin:/bin"})
