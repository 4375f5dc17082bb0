"""The driver's entry: names, twins, and that it works without the corpus subpackage."""

from __future__ import annotations

import subprocess
import sys
from pathlib import Path

import __spark_entry__

ROOT = Path(__file__).resolve().parent.parent


def test_names_and_twins():
    queries, oracles = __spark_entry__.queries(), __spark_entry__.oracle_sql()
    assert set(oracles) <= set(queries) and len(queries) > 100


def test_entry_has_rows(spark):
    df = __spark_entry__.entry(spark)
    assert df.columns == ["group_label", "n", "n_alerts"] and df.count() >= 2


def test_works_without_the_corpus_part(tmp_path):
    for name in ("__spark_entry__.py", "alertloom"):
        (tmp_path / name).symlink_to(ROOT / name) if name.endswith(".py") else _copy(ROOT / name, tmp_path / name)
    code = "import __spark_entry__ as e; q = e.queries(); assert q and not [n for n in q if n.startswith('op') and n[2].isdigit()] and 'pipeline' not in q and e.oracle_sql()"
    subprocess.run([sys.executable, "-c", code], cwd=tmp_path, check=True, env={"PYTHONPATH": str(tmp_path), "PATH": "/usr/bin:/bin"})


def _copy(source: Path, target: Path) -> None:
    for file in source.rglob("*.py"):
        relative = file.relative_to(source)
        if relative.parts[0] != "llm":
            (target / relative).parent.mkdir(parents=True, exist_ok=True)
            (target / relative).write_text(file.read_text())


def test_nothing_else_imports_the_corpus_part():
    for file in (ROOT / "alertloom").rglob("*.py"):
        if "llm" not in file.relative_to(ROOT / "alertloom").parts:
            assert "alertloom.llm" not in file.read_text(), file
