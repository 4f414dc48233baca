import pathlib

import pytest


def test_entry_and_registries(spark):
    import __spark_entry__ as e

    assert e.entry(spark).count() == 10
    assert set(e.oracle_sql()) <= set(e.queries()) and len(e.queries()) > 150


def test_nothing_else_imports_the_optional_subpackage():
    import re

    root = pathlib.Path(__file__).resolve().parent.parent
    for f in (root / "corpweave").rglob("*.py"):
        if "llm" not in f.relative_to(root).parts:
            assert not re.search(r"corpweave\.llm|corpus_pipeline", f.read_text()), f


def test_other_queries_stay_without_the_optional_packages():
    """As if neither the subpackage nor what it imports were installed."""
    import subprocess
    import sys

    code = """
import importlib.abc, sys
class Blocked(importlib.abc.MetaPathFinder):
    def find_spec(self, name, path=None, target=None):
        if name.split('.')[0] in {blocked!r} or name in {blocked!r}:
            raise ModuleNotFoundError(name)
sys.meta_path.insert(0, Blocked())
import __spark_entry__ as e
print(len(e.queries()), len(e.oracle_sql()), [n for n in e.queries() if n.startswith('op')])
"""
    for blocked in (["ahocorasick"], ["public_tokenizers"], ["corpus_pipeline"], ["corpweave.llm"]):
        out = subprocess.run([sys.executable, "-c", code.format(blocked=blocked)], capture_output=True, text=True, cwd=pathlib.Path(__file__).resolve().parent.parent)
        n, oracles, ops = out.stdout.split(" ", 2)
        assert int(n) > 150 and int(oracles) > 150 and ops.strip() == "[]", (blocked, out.stderr)


def test_a_cluster_needs_a_shared_folder():
    from corpweave.session import shared_dir

    class Conf:
        def get(self, name, default):
            return default

    class Context:
        master = "spark://host:7077"

        def getCheckpointDir(self):
            return None

    class Session:
        conf, sparkContext = Conf(), Context()

    with pytest.raises(RuntimeError, match="spark.checkpoint.dir"):
        shared_dir(Session())
