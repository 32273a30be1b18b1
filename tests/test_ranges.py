"""Sources read by ranges, and fits of streams that stop and go on."""

import hashlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from mensura.sources import ranges
from mensura.streaming import fits


def test_blocks_of_a_file_by_ranges(spark, tmp_path):
    data = np.random.default_rng(1).bytes(1_000_003)
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.bin").write_bytes(data)
    (tmp_path / "in" / "empty").write_bytes(b"")
    (tmp_path / "in" / "_SUCCESS").write_bytes(b"x")
    for block, size in ((1000, 7000), (4096, 4096), (2_000_000, 1)):
        for path in (f"{tmp_path}/in", f"file://{tmp_path}/in", f"{tmp_path}/in/a.bin"):
            df = ranges.byte_blocks(spark, path, block, size)
            got = sorted(df.collect(), key=lambda r: r["block"])
            assert b"".join(bytes(r["bytes"]) for r in got) == data and max(len(r["bytes"]) for r in got) <= block
            assert [r["block"] for r in got] == list(range(-(-len(data) // block)))
            assert df.rdd.getNumPartitions() == -(-len(got) // max(1, size // block))  # a range is a task
    assert ranges.byte_blocks(spark, f"{tmp_path}/in/empty").count() == 0
    with pytest.raises(Exception):
        ranges.byte_blocks(spark, f"{tmp_path}/none").count()


@pytest.mark.parametrize("kind", ["float32", "float64", "int16"])
def test_slabs_hold_no_more_than_the_budget(spark, tmp_path, kind):
    x = (np.random.default_rng(2).random((257, 3, 5)) * 100).astype(kind)
    np.save(tmp_path / "x.npy", x)
    for budget, rows in ((15 * 8 * 10, 0), (1, 0), (1 << 20, 100)):
        got = sorted(ranges.array_slabs(spark, str(tmp_path), budget, rows).collect(), key=lambda r: r["start"])
        assert all(len(r["values"]) * 8 <= max(budget, 15 * 8) and r["width"] == 15 for r in got)
        assert np.array_equal(np.concatenate([r["values"] for r in got]).reshape(x.shape), x.astype(float))
        assert [(r["start"], r["stop"]) for r in got] == [(a, min(a + (rows or max(1, budget // 120)), 257)) for a in range(0, 257, rows or max(1, budget // 120))]


def test_arrays_by_column_are_refused(spark, tmp_path):
    np.save(tmp_path / "x.npy", np.asfortranarray(np.ones((4, 3))))
    with pytest.raises(Exception, match="rows of numbers"):
        ranges.array_slabs(spark, str(tmp_path)).count()


def test_saved_arrays_come_back(spark, tmp_path):
    df = spark.createDataFrame([(i, i // 4, [float(i), i / 2]) for i in range(10)], "i long, f long, v array<double>").repartition(3)
    assert sorted(map(tuple, ranges.save_arrays(df, f"{tmp_path}/out", "v", "i", "f", "float64").collect())) == [(0, 4), (1, 4), (2, 2)]
    assert np.load(tmp_path / "out" / "rows-00000001.npy").tolist() == [[4.0, 2.0], [5.0, 2.5], [6.0, 3.0], [7.0, 3.5]]


def write_csv(path, rows):
    path.parent.mkdir(exist_ok=True)
    path.write_text("g,a,b,y\n" + "".join(f"{g},{a!r},{b!r},{y!r}\n" for g, a, b, y in rows))


def made(n, seed):
    rng = np.random.default_rng(seed)
    return [("xy"[i % 2], float(a), float(b), float(1 + 2 * a - 3 * b + e)) for i, (a, b, e) in enumerate(rng.normal(size=(n, 3)) * [1, 1, 0.1])]


def check(state, rows):
    got = {r["g"]: r for r in state.fit().collect()}
    for g in "xy":
        mine = [r for r in rows if r[0] == g]
        x = np.array([[1, a, b] for _, a, b, _ in mine])
        y = np.array([r[3] for r in mine])
        b, *_ = np.linalg.lstsq(x, y, rcond=None)
        assert got[g]["rows_seen"] == len(mine) and np.allclose([got[g]["intercept"], *got[g]["coefficients"]], b, rtol=1e-9)
        assert abs(got[g]["rmse"] - np.sqrt(((y - x @ b) ** 2).mean())) < 1e-8


def test_fit_goes_on_from_its_checkpoint_and_counts_each_batch_once(spark, tmp_path):
    rows = made(200, 5)
    state = fits.FitState(spark, f"file://{tmp_path}/state", ["a", "b"], "y", "g")
    stream = lambda: fits.csv_stream(spark, f"{tmp_path}/in", "g string, a double, b double, y double", files_per_batch=1)
    for i in range(3):
        write_csv(tmp_path / "in" / f"{i}.csv", rows[i * 40 : i * 40 + 40])
    fits.run_fit(stream(), state, f"{tmp_path}/checkpoint")
    check(state, rows[:120])
    for i in range(3, 5):
        write_csv(tmp_path / "in" / f"{i}.csv", rows[i * 40 : i * 40 + 40])
    again = fits.FitState(spark, f"file://{tmp_path}/state", ["a", "b"], "y", "g")
    fits.run_fit(stream(), again, f"{tmp_path}/checkpoint")
    check(again, rows)
    # the last batch runs again, as after a failure between its state and its commit
    last = again.batches()[-1]
    frame = spark.read.schema("g string, a double, b double, y double").option("header", True).csv(f"{tmp_path}/in/4.csv")
    commits = sorted((tmp_path / "checkpoint" / "commits").iterdir())
    for f in commits:
        if f.name.strip(".").split(".")[0] == str(last):
            f.unlink()
    fits.run_fit(stream(), again, f"{tmp_path}/checkpoint")
    check(again, rows)
    assert again.batches()[-1] == last and frame.count() == 40 and len(again.batches()) <= 2


def test_half_written_states_and_bad_cells(spark, tmp_path):
    state = fits.FitState(spark, f"file://{tmp_path}/state", ["a", "b"], "y")
    with pytest.raises(ValueError, match="no batch"):
        state.fit()
    frame = spark.createDataFrame(made(30, 1), "g string, a double, b double, y double")
    state.merge(frame, 0)
    (tmp_path / "state" / "batch-000000000001").mkdir()
    assert state.batches() == [0]
    state.merge(frame.limit(0), 1)
    assert state.batches() == [0, 1] and state.fit().first()["rows_seen"] == 30
    with pytest.raises(Exception, match="an empty cell in a"):
        state.merge(frame.withColumn("a", F.lit(None).cast("double")), 2)
    flat = fits.FitState(spark, f"file://{tmp_path}/flat", ["a", "b"], "y")
    flat.merge(frame.withColumn("b", F.col("a")), 0)
    with pytest.raises(Exception, match="singular"):
        flat.fit().collect()


def test_hash_of_blocks_is_the_hash_of_bytes(spark, tmp_path):
    (tmp_path / "a").write_bytes(b"abcdef")
    got = ranges.byte_blocks(spark, f"{tmp_path}/a", 4).select("block", F.sha2("bytes", 256).alias("h")).collect()
    assert {r["block"]: r["h"] for r in got} == {0: hashlib.sha256(b"abcd").hexdigest(), 1: hashlib.sha256(b"ef").hexdigest()}


def test_a_cluster_needs_a_shared_folder():
    from types import SimpleNamespace

    from mensura.sources.tables import shared_dir

    def session(master, **conf):
        return SimpleNamespace(conf=SimpleNamespace(get=lambda k, d=None: conf.get(k, d)), sparkContext=SimpleNamespace(master=master, applicationId=f"{master}{conf}"))

    for where in ("file:/tmp/warehouse", "/tmp/warehouse"):
        with pytest.raises(ValueError, match="spark.checkpoint.dir"):
            shared_dir(session("spark://host:7077", **{"spark.sql.warehouse.dir": where}))
    assert shared_dir(session("yarn", **{"spark.sql.warehouse.dir": "hdfs://x/w/"})) == "hdfs://x/w"
    assert shared_dir(session("yarn", **{"spark.checkpoint.dir": "hdfs://x/c/"})) == "hdfs://x/c"
    assert shared_dir(session("local[4]")).startswith("file:///")
