import importlib
import os
import subprocess
import sys
import zlib

import numpy as np
from tokenizers import Tokenizer

import corpus_pipeline as cp
from corpusloom.llm import jaccard_join, quality
from corpusloom.llm._shared import read_table, saved
from corpusloom.llm.token_codes import tokenizer_path
from tests.llm.test_decontaminate import brute as contaminated

ROOT = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


def test_stage_by_stage(spark, sf):
    docs = read_table(spark, sf, "documents")
    columns, states = docs.columns, []
    for k, (name, stage) in enumerate(cp.STAGES):
        out = saved(stage(spark, docs, sf), name)
        states.append((docs.collect(), out.collect()))
        assert k == len(cp.STAGES) - 1 or out.columns == columns
        docs = out
    labels = {r.doc_id: r for r in read_table(spark, sf, "labels").collect()}
    # What the classifier scores below its threshold goes, and nothing else.
    given, kept = states[0]
    scores = {r.doc_id: r.predicted for r in quality.query(spark, sf).collect()}
    assert sorted(r.doc_id for r in kept) == sorted(r.doc_id for r in given if scores[r.doc_id])
    given, kept = states[1]
    classes = jaccard_join.brute_force([(r.doc_id, r.text) for r in given])
    assert sorted(r.doc_id for r in kept) == sorted({c[1] for c in classes}) and len(kept) < len(given)
    given, kept = states[2]
    found = contaminated([(r.doc_id, r.text) for r in given], [(r.item_id, r.text) for r in read_table(spark, sf, "benchmark").collect()])
    assert sorted(r.doc_id for r in kept) == sorted(f[0] for f in found if not f[5]) and len(kept) < len(given)
    given, kept = states[3]
    assert {tuple(r) for r in kept} <= {tuple(r) for r in given}
    clean = [r.doc_id for r in given if r.doc_id in labels and labels[r.doc_id].quality == 1 and labels[r.doc_id].toxic == 0]
    assert np.mean([i in {r.doc_id for r in kept} for i in clean]) > 0.95
    given, kept = states[4]
    t = Tokenizer.from_file(tokenizer_path())
    want = sorted((r.doc_id, zlib.crc32(np.array([*t.encode(r.text or "", add_special_tokens=False).ids, 2], "<u4").tobytes())) for r in given)
    assert sorted((r.doc_id, r.ids_crc32) for r in kept) == want
    assert sorted(r.start for r in kept) == np.cumsum([0, *[r.n_tokens for r in sorted(kept, key=lambda r: r.start)]])[:-1].tolist()


def test_without_the_subpackage(tmp_path):
    """The entry file works where the subpackage and the pipeline are gone."""
    for name in ("__spark_entry__.py", "corpusloom"):
        subprocess.run(["cp", "-r", os.path.join(ROOT, name), tmp_path], check=True)
    subprocess.run(["rm", "-r", tmp_path / "corpusloom" / "llm"], check=True)
    said = subprocess.run([sys.executable, "-c", "import __spark_entry__ as e; print(len(e.queries()), [q for q in e.queries() if q.startswith('op')], 'pipeline' in e.queries(), len(e.oracle_sql()))"], cwd=tmp_path, env=os.environ | {"PYTHONPATH": str(tmp_path)}, capture_output=True, text=True, check=True)
    assert said.stdout.split("\n")[-2].startswith("7") and "[] False" in said.stdout


def test_registered():
    entry = importlib.import_module("__spark_entry__")
    names = list(entry.queries())
    assert [n.split("_")[0] for n in names if n.startswith("op")] == [f"op{k}" for k in range(1, 14)] and "pipeline" in names
    assert set(entry.oracle_sql()) <= set(names)
