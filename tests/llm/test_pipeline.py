"""The pipeline's stages on a small table, and the repository without the subpackage."""

import os
import shutil
import subprocess
import sys

import corpus_pipeline as p

ROOT = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
SMALL = "/root/testdata/sf0.001"


def test_stages(spark):
    assert [n for n, _ in p.STAGES] == ["language", "near duplicates", "repeats", "mixing", "packing"]
    docs = p.documents(spark, SMALL)
    for i, (name, stage) in enumerate(p.STAGES):
        out = p.written(stage(spark, docs, SMALL), "stage")
        if i < 4:
            assert out.columns == docs.columns and dict(out.dtypes) == dict(docs.dtypes), name
            assert out.count() > 0
        if name in ("language", "near duplicates"):
            assert out.exceptAll(docs).count() == 0
        docs = out
    assert p.run(spark, SMALL).columns == docs.columns


def test_entry_without_the_subpackage(tmp_path):
    shutil.copytree(f"{ROOT}/sylva", tmp_path / "sylva", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    shutil.copy(f"{ROOT}/__spark_entry__.py", tmp_path)
    code = "import __spark_entry__ as e; q = e.queries(); assert 'pipeline' not in q and not any(k.startswith('op') and '_' in k and k[2].isdigit() for k in q); assert len(e.oracle_sql()) > 50"
    subprocess.run([sys.executable, "-c", code], cwd=tmp_path, check=True, env={**os.environ, "PYTHONPATH": ""})
