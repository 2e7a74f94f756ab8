"""The pipeline's stages on the smallest tables: decisions take effect, columns stay, clean documents stay."""

import os
import subprocess
import sys
from pathlib import Path

import pandas as pd
import pytest

import corpus_pipeline
from linkspark.llm import decontaminate, neardup
from linkspark.llm.common import documents, words_of
from test_llm_operators import brute_classes

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def stages(spark, tmp_path_factory):
    out, docs = [], documents(spark, SF)
    for k, (_, f) in enumerate(corpus_pipeline.STAGES):
        path = f"{tmp_path_factory.mktemp('stage')}/{k}"
        f(spark, docs, SF).write.parquet(path)
        docs = spark.read.parquet(path)
        out.append(docs)
    return out


def test_columns_and_shrinking(spark, stages):
    columns = documents(spark, SF).columns
    assert all(s.columns == columns for s in stages[:-1])
    sizes = [documents(spark, SF).count(), *[s.count() for s in stages]]
    assert all(a >= b for a, b in zip(sizes, sizes[1:])) and sizes[-1] == sizes[-2] > 0


def test_good_documents_pass_quality(stages):
    lab = pd.read_parquet(f"{SF}/labels.parquet")
    kept = set(stages[0].toPandas().doc_id)
    good, bad = set(lab[lab.quality == 1].doc_id), set(lab[lab.quality == 0].doc_id)
    assert good <= kept and len(bad & kept) <= 0.2 * len(bad)


def test_one_document_of_each_class_stays(stages):
    rows = [(r.doc_id, r.text) for r in stages[1].orderBy("doc_id").collect()]
    assert {r.doc_id for r in stages[2].collect()} == set(brute_classes(rows).values())


def test_contaminated_documents_go(spark, stages):
    bench = spark.read.parquet(f"{SF}/benchmark.parquet")
    assert decontaminate.contamination(stages[3], bench).filter("contaminated").count() == 0
    gone = stages[2].join(stages[3], "doc_id", "left_anti")
    assert decontaminate.contamination(gone, bench).filter("not contaminated").count() == 0


def test_pieces_restore_texts(stages):
    assert stages[4].filter("not round_trip").count() == 0 and stages[4].filter("size(piece_ids) <> n_pieces").count() == 0


def test_run_equals_the_stages(spark, stages):
    assert sorted(tuple(r) for r in corpus_pipeline.run(spark, SF).drop("piece_ids").collect()) == sorted(tuple(r) for r in stages[4].drop("piece_ids").collect())


def test_entry_works_without_the_subpackage(tmp_path):
    root = Path(corpus_pipeline.__file__).parent
    (tmp_path / "linkspark").mkdir()
    for p in (root / "linkspark").iterdir():
        if p.name not in ("llm", "__pycache__"):
            os.symlink(p, tmp_path / "linkspark" / p.name)
    os.symlink(root / "__spark_entry__.py", tmp_path / "__spark_entry__.py")
    code = "import __spark_entry__ as e; q = e.queries(); assert len(q) > 50 and not [n for n in q if n.startswith('op') and n[2].isdigit()], list(q); assert set(e.oracle_sql()) <= set(q)"
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    subprocess.run([sys.executable, "-c", code], cwd=tmp_path, env=env, check=True, timeout=120)


def test_near_duplicate_helper_is_the_stage(spark):
    assert corpus_pipeline.STAGES[2][1](spark, documents(spark, SF), SF).count() == neardup.representatives(documents(spark, SF)).count()
    assert words_of(None) == []
