"""Rules, features and triggers must not reach the look-ahead label module."""

import ast
from pathlib import Path

ROOT = Path(__file__).resolve().parents[1] / "tickloom"
GUARDED = ["functions", "streaming", "operators/features.py", "operators/triggers.py",
           "operators/rolling.py", "operators/asof.py", "plans/backtest.py", "plans/grid.py"]


def _imports(path: Path):
    for node in ast.walk(ast.parse(path.read_text())):
        if isinstance(node, ast.ImportFrom):
            yield from (f"{node.module}.{a.name}" for a in node.names)
        elif isinstance(node, ast.Import):
            yield from (a.name for a in node.names)


def test_guarded_modules_do_not_import_labels():
    files = []
    for g in GUARDED:
        p = ROOT / g
        files += list(p.rglob("*.py")) if p.is_dir() else [p]
    assert len(files) > 10
    for f in files:
        assert not any("labels" in name for name in _imports(f)), f
