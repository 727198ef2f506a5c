"""The driver's entry module: every query has a stable shape and works without the text subpackage."""

import subprocess
import sys
from pathlib import Path

import __spark_entry__ as entry

ROOT = Path(__file__).resolve().parents[1]


def test_entry(spark):
    assert entry.entry(spark).count() > 0


def test_every_oracle_has_a_query():
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_imports_without_the_text_subpackage(tmp_path):
    for name in ("__spark_entry__.py",):
        (tmp_path / name).symlink_to(ROOT / name)
    (tmp_path / "pixelframe").mkdir()
    for p in (ROOT / "pixelframe").iterdir():
        if p.name not in ("llm", "__pycache__"):
            (tmp_path / "pixelframe" / p.name).symlink_to(p)
    code = "import __spark_entry__ as e; q = e.queries(); assert q and not any(n.startswith('op') for n in q) and 'pipeline' not in q"
    subprocess.run([sys.executable, "-c", code], cwd=tmp_path, check=True, env={"PATH": "/usr/bin:/bin", "PYTHONDONTWRITEBYTECODE": "1"})
