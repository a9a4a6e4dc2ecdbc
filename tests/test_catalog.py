"""The catalog is plain text until a query is called."""

import subprocess
import sys
from pathlib import Path

ROOT = Path(__file__).resolve().parent.parent

PROBE = """
import zipfile, pathlib, pyspark
from pyspark.sql import SparkSession

def refuse(*_, **__):
    raise AssertionError("the catalog must not need this")

zipfile.ZipFile.__init__ = refuse
SparkSession.Builder.getOrCreate = refuse
glob = pathlib.Path.glob
pathlib.Path.glob = lambda self, p, **k: iter(()) if "jars" in self.parts else glob(self, p, **k)
from mailwatch import catalog
queries, sql = catalog.load()
print(len(queries), len(sql))
"""


def test_catalog_needs_neither_jar_nor_session():
    done = subprocess.run([sys.executable, "-c", PROBE], cwd=ROOT, capture_output=True, text=True, timeout=120)
    assert done.returncode == 0, done.stderr
    queries, sql = map(int, done.stdout.split())
    assert queries >= 188 and sql >= 171
