import numpy as np

from tidende.operators import community, compaction


def planted():
    a = np.zeros((12, 12))
    for block in (range(6), range(6, 12)):
        for i in block:
            for j in block:
                a[i, j] = i != j
    return a


def test_objective_never_rises_and_blocks_are_found():
    a = planted()
    rng = np.random.default_rng(3)
    w, seen = community.factorize(a, np.maximum(community.FLOOR, rng.integers(0, 2, (12, 2)).astype(float)), max_iter=200, least_step=1e-9)
    assert all(y <= x for x, y in zip(seen, seen[1:], strict=False)) and seen[-1] < seen[0]
    inside = np.exp(-(w @ w.T))[:6, :6][~np.eye(6, dtype=bool)].mean()
    across = np.exp(-(w @ w.T))[:6, 6:].mean()
    assert inside < across


def test_bipartite_objective():
    m = np.kron(np.eye(2), np.ones((4, 3)))
    rng = np.random.default_rng(1)
    _, _, seen = community.bipartite(m, rng.random((8, 2)) + 0.1, rng.random((6, 2)) + 0.1)
    assert all(y <= x for x, y in zip(seen, seen[1:], strict=False))


FILES = "doc_id string, text string, file_path string, loaded_at timestamp_ntz, k int, late boolean"


def test_compaction_keeps_every_record_once(spark, tmp_path):
    import datetime as d

    t = d.datetime(2020, 1, 1)
    rows = [("a", "x", "p1", t, 1, True), ("a", "y", "p0", t, 2, None), ("b", None, "p2", None, 3, None), ("b", " ", "p3", t, 4, None), (None, "n", "p4", None, None, None), (None, "n", "p5", None, None, None), ("c", "æ" * 200_000, "p6", t, 5, None)]
    spark.createDataFrame(rows, FILES).repartition(7).write.parquet(str(tmp_path / "in"))
    files = spark.read.parquet(str(tmp_path / "in"))
    out = compaction.compact(files, f"file://{tmp_path}/out")
    assert sorted(r.file_path for r in out.collect()) == ["p0", "p3", "p4", "p5", "p6"]
    assert out.columns == files.columns and len(out.inputFiles()) == 1
    assert sorted(r.file_path for r in compaction.adds_nothing(files).collect()) == ["p1", "p2"]


def test_compaction_of_an_empty_table(spark, tmp_path):
    spark.createDataFrame([], FILES).write.parquet(str(tmp_path / "in"))
    files = spark.read.parquet(str(tmp_path / "in"))
    assert compaction.compact(files, f"file://{tmp_path}/out").count() == 0
    assert compaction.adds_nothing(files).count() == 0


def test_compaction_of_many_small_files(spark, tmp_path):
    import pyarrow as pa
    import pyarrow.parquet as pq

    (tmp_path / "in").mkdir()
    for k in range(20_000):
        table = pa.table({"doc_id": [f"d{k % 19_000}"], "text": [f"tekst {k}"], "file_path": [f"p{k:05}"], "loaded_at": pa.array([k], pa.timestamp("us"))})
        pq.write_table(table, tmp_path / "in" / f"{k}.parquet", compression="none")
    files = spark.read.schema("doc_id string, text string, file_path string, loaded_at timestamp_ntz").parquet(f"file://{tmp_path}/in")
    out = compaction.compact(files, f"file://{tmp_path}/out")
    assert out.count() == 19_000 and out.select("doc_id").distinct().count() == 19_000 and len(out.inputFiles()) <= 2


def test_compaction_that_died_while_publishing(spark, tmp_path):
    rows = lambda *names: spark.createDataFrame([(n, "x", n, None, 1, None) for n in names], FILES)
    target = f"file://{tmp_path}/out"
    compaction.compact(rows("a"), target, input_bytes=1)
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs
    fs = hadoop.Path(target).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    # Between the two renames: the table is put aside, the new one not yet in its place.
    assert fs.rename(hadoop.Path(target), hadoop.Path(target + ".before"))

    class Dies:
        def __getattr__(self, name):
            return getattr(fs, name)

        def rename(self, a, b):
            if str(a).endswith(".staging"):
                raise KeyboardInterrupt
            return fs.rename(a, b)

    import pytest

    assert not fs.exists(hadoop.Path(target))
    with pytest.raises(KeyboardInterrupt):
        compaction.publish(Dies(), hadoop.Path(target + ".staging"), hadoop.Path(target), hadoop.Path(target + ".before"))
    done = compaction.compact(rows("b"), target, input_bytes=1)
    assert [r.doc_id for r in done.collect()] == ["b"] and not fs.exists(hadoop.Path(target + ".before"))


def test_split_packing_puts_settings_back(spark):
    before = spark.conf.get("spark.sql.files.maxPartitionBytes", None)
    with compaction.split_packing(spark, 1234567, 1000):
        assert spark.conf.get("spark.sql.files.maxPartitionBytes") == "1234567"
    assert spark.conf.get("spark.sql.files.maxPartitionBytes", None) == before


def test_the_queries_follow_the_number_of_documents(spark, sf):
    import os

    import pytest
    from pyspark.sql import functions as F

    from tidende.plans import maps

    if not os.path.isdir(sf):
        pytest.skip("test data absent")
    terms = maps._entity_terms(spark, sf)
    sizes = terms.groupBy("slice").agg(F.countDistinct("doc_id").alias("n_docs"))
    want = community.communities(community.cooccurrence(terms, share=0.0), sizes)
    key = lambda df: sorted((r.slice, r.term, round(r.weight, 9)) for r in df.collect())
    got = maps.QUERIES["community_nmf"](spark, sf)
    assert key(got) == key(want) and got.count() > 0
