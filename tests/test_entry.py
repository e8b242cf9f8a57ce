import importlib
import subprocess
import sys


def test_entry_runs(spark):
    import __spark_entry__ as e

    assert e.entry(spark).count() == 1
    assert set(e.oracle_sql()) <= set(e.queries())


def test_core_imports_without_the_text_package():
    code = "import sys; sys.modules['tallyforge.llm'] = None\nimport __spark_entry__ as e\nassert e.queries() and not [q for q in e.queries() if q.startswith('p7')]"
    root = importlib.import_module("conftest").os.path.dirname(importlib.import_module("tallyforge").__path__[0])
    assert subprocess.run([sys.executable, "-c", code], cwd=root, check=False).returncode == 0
