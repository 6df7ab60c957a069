import os
import shutil
import subprocess
import sys

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))


def test_entry_works_without_the_optional_subpackage(tmp_path):
    shutil.copytree(f"{ROOT}/hearthline", tmp_path / "hearthline", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    shutil.copy(f"{ROOT}/__spark_entry__.py", tmp_path)
    code = "import __spark_entry__ as e; q = e.queries(); assert q and not any(n.startswith('op') for n in q); assert set(e.oracle_sql()) <= set(q)"
    subprocess.run([sys.executable, "-c", code], cwd=tmp_path, check=True, env={**os.environ, "PYTHONPATH": str(tmp_path)})


def test_entry_is_lazy_and_has_rows(spark):
    import __spark_entry__

    df = __spark_entry__.entry(spark)
    assert df.columns == ["r", "c", "cls"] and df.limit(1).count() == 1
