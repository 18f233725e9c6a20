"""The entry's contract, and the core without the corpus operators."""

import subprocess
import sys
from pathlib import Path

import pytest

import __spark_entry__ as entry
from quillmap.plans import storage

ROOT = str(Path(__file__).resolve().parents[1])
BLOCKED = """
import sys
class Block:
    def find_spec(self, name, path=None, target=None):
        if name in {names!r} or name.startswith("{prefix}."):
            raise ModuleNotFoundError("blocked", name=name)
sys.meta_path.insert(0, Block())
sys.path.insert(0, {root!r})
import __spark_entry__ as e
names = e.queries().keys()
assert len(names) > 90 and "pipeline" not in names and not any(n.startswith("op1_") for n in names), sorted(names)
assert e.oracle_sql().keys() <= names
"""


@pytest.mark.parametrize("names", [("quillmap.llm", "corpus_pipeline"), ("quillmap.llm",), ("public_tokenizers",), ("regex",)])
def test_core_stands_alone(names):
    code = BLOCKED.format(names=set(names), prefix=names[0], root=ROOT)
    assert subprocess.run([sys.executable, "-c", code], timeout=120).returncode == 0


def test_oracles_belong_to_queries():
    assert entry.oracle_sql().keys() <= entry.queries().keys()


def test_kept_tables_are_removed(spark):
    before = storage.kept()
    a = storage.keep(spark.range(5), "t")
    assert a.count() == 5 and storage.kept() == before + 1
    path = Path(storage._written[-1].removeprefix("file:"))
    assert path.exists()
    storage.remove_kept(spark, before)
    assert not path.exists() and storage.kept() == before


def test_a_cluster_must_name_its_folder():
    class Context:
        master = "spark://h:7077"

        def getConf(self):
            return {}

        def getCheckpointDir(self):
            return None

    class Session:
        conf, sparkContext = {}, Context()

    with pytest.raises(ValueError, match="checkpoint"):
        storage.shared_folder(Session())
