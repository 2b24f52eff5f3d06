import numpy as np
import pytest

from corpusloom.operators import vector_index as vi
from corpusloom.operators import vectors as vc
from corpusloom.operators.incremental import delete_by_source, paths_holding

VECTORS = "vec_id long, embedding array<float>"


def frame(spark, rows):
    return spark.createDataFrame([(int(k), None if v is None else [float(x) for x in v]) for k, v in rows], VECTORS)


@pytest.mark.parametrize("metric", ["cosine", "l2"])
def test_clustered_rows_need_few_probes(spark, tmp_path, metric):
    rng = np.random.default_rng(5)
    centres = rng.normal(size=(40, 16)) * 4
    rows = frame(spark, enumerate(centres[rng.integers(0, 40, 4000)] + rng.normal(size=(4000, 16)) * 0.3))
    vi.build(rows, str(tmp_path / "i"), metric=metric, lists=40)
    index = vi.load(spark, str(tmp_path / "i"))
    assert index.metric == metric and index.recalls[index.probes - 1] >= 0.97 and index.shares[index.probes - 1] < 0.2
    assert index.rows(spark).count() == 4000
    asked = rows.where("vec_id % 50 = 0").withColumnRenamed("vec_id", "query_id")
    exact = vc.topk_batch(rows, asked, metric=metric)
    found = vi.search(index, asked)
    assert vi.recall(found, exact) >= 0.95
    # What is found has the same scores; with all lists probed, it is exact.
    scores = {(r.query_id, r.vec_id): r.score for r in exact.collect()}
    assert all(scores.get((r.query_id, r.key), r.score) == r.score for r in found.collect())
    whole = vi.search(index, asked, probes=40, query_bytes=2000)
    key = lambda rows: sorted((r[0], r[1], r[3]) for r in rows)
    assert key(whole.collect()) == key(exact.select("query_id", "vec_id", "score", "rank").collect())


def test_only_probed_lists_are_read(spark, tmp_path):
    rng = np.random.default_rng(1)
    rows = frame(spark, enumerate(rng.normal(size=(2000, 8))))
    index = vi.build(rows, str(tmp_path / "i"), lists=20)
    one = rows.where("vec_id = 7").withColumnRenamed("vec_id", "query_id")
    plan = vi.search(index, one, probes=2)._jdf.queryExecution().executedPlan().toString()
    line = next(x for x in plan.splitlines() if "PartitionFilters" in x)
    assert "list#" in line.split("PartitionFilters:")[1] and plan.count("FileScan") == 1
    files = {int(p.name.split("=")[1]) for p in (tmp_path / "i" / "lists").iterdir() if p.name.startswith("list=")}
    assert len(files) == 20


def test_odd_rows(spark, tmp_path):
    same = [1.0, 0.0]
    rows = frame(spark, [(1, None), (2, [0.0, 0.0]), (2, same), *[(k, same) for k in range(3, 400)], (400, [0.0, 1.0])])
    index = vi.build(rows, str(tmp_path / "i"), lists=3)
    asked = frame(spark, [(9, same), (8, None)]).withColumnRenamed("vec_id", "query_id")
    got = [(r.key, r["rank"]) for r in vi.search(index, asked, k=3).orderBy("rank").collect()]
    assert got == [(2, 1), (3, 2), (4, 3)]
    assert vi.search(index, asked.limit(0)).collect() == []
    empty = vi.build(rows.limit(0), str(tmp_path / "e"))
    assert vi.search(empty, asked).collect() == []
    with pytest.raises(ValueError, match="metric"):
        vi.build(rows, str(tmp_path / "x"), metric="ip")


def test_kmeans_keeps_all_centroids():
    rows = np.repeat(np.eye(4), 10, axis=0)
    assert len(np.unique(vi.kmeans(rows, 4).round(6), axis=0)) == 4


def test_scores_in_small_blocks(spark, monkeypatch):
    rng = np.random.default_rng(2)
    rows = frame(spark, [*enumerate(rng.normal(size=(300, 5))), (300, None)])
    asked = rows.where("vec_id % 20 = 0").withColumnRenamed("vec_id", "query_id")
    want = sorted(map(tuple, vc.topk_batch(rows, asked).collect()))
    monkeypatch.setattr(vc, "BLOCK_SCORES", 7)
    assert sorted(map(tuple, vc.topk_batch(rows, asked, query_bytes=100).collect())) == want and len(want) == 60


def test_parts_of_paths(spark):
    paths = ["en/a1.md", "en/a10.md", "fr/a1.md", "x", "", None, "Été/ß.md", "long/" + "y" * 300 + "/z.md", "en/a1.md", "aaaaaaa", "abcabcabc"]
    frame_of = lambda rows: spark.createDataFrame([(p,) for p in rows], "file_path string")
    for parts in (["a1."], ["en/a1"], ["a"], ["/"], ["x"], ["ß"], ["yyyyyyyyy"], ["aaaaaaaa"], ["abcabcabc"], ["cabcab", "q"], [], [None], [None, "md"], ["en/a1.md", "z.", "a1"], ["a.c"], ["%"]):
        want = sorted({p for p in paths if p is not None and any(q is not None and q in p for q in parts)})
        assert sorted(r.path for r in paths_holding(frame_of(paths), frame_of(parts)).collect()) == want
        assert sorted(r.path for r in paths_holding(frame_of(paths), frame_of(parts), gram=2).collect()) == want
        left = sorted((r.file_path for r in delete_by_source(frame_of(paths), frame_of(parts), substring=True).collect()), key=str)
        assert left == sorted((p for p in paths if p not in want), key=str)
    assert {r.path for r in paths_holding(frame_of(paths), frame_of(["", "q"])).collect()} == {p for p in paths if p is not None}


def test_plan_has_no_nested_loop(spark):
    rows = spark.createDataFrame([("en/file.md", 1)], "file_path string, k int")
    plan = delete_by_source(rows, rows.select("file_path"), substring=True)._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan
