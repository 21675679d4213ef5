"""The endless shuffled stream: each row once an epoch, the same order after a restart, bounded reads."""

import pytest

from tablewright.sources import shuffled


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("rows") / "in")
    spark.range(1_000).selectExpr("id", "concat('r', id) as name", "if(id % 7 = 0, null, id * 0.5) as x").repartition(3).write.option("parquet.block.size", 4096).parquet(path)
    return path


def order_of(df):
    return {(r["epoch"], r["position"]): r["id"] for r in df.collect()}


def test_order_is_a_function_of_the_place():
    order = shuffled.Order(1_003, 100, 5)
    for epoch in range(3):
        turn, begins = order.blocks(epoch)
        assert sorted(turn) == list(range(11)) and begins[-1] == 1_003
        assert sorted(x for b in turn for x in order.inside(epoch, b)) == list(range(1_003))
    assert order.blocks(0)[0].tolist() != order.blocks(1)[0].tolist() and order.inside(0, 3).tolist() != order.inside(1, 3).tolist()


def test_restart_gives_the_order_of_one_run(spark, folder, tmp_path):
    make = lambda step: shuffled.repeated(spark, folder, seed=3, buffer=64, rows_per_batch=step, epochs=3)
    whole = order_of(shuffled.run_until(make(1_700), f"{tmp_path}/a", f"{tmp_path}/ca", 3_000))
    assert len(whole) == 3_000
    for epoch in range(3):
        ids = [whole[epoch, p] for p in range(1_000)]
        assert sorted(ids) == list(range(1_000)) and ids != sorted(ids)
    assert [whole[0, p] for p in range(1_000)] != [whole[1, p] for p in range(1_000)]
    cut = order_of(shuffled.run_until(make(333), f"{tmp_path}/b", f"{tmp_path}/cb", 900))
    assert 900 <= len(cut) < 3_000 and set(cut) == set(sorted(whole)[: len(cut)])
    again = order_of(shuffled.run_until(make(450), f"{tmp_path}/b", f"{tmp_path}/cb", 3_000 - len(cut)))
    assert again == whole and cut.items() <= whole.items()


def test_values_and_empty_files(spark, folder, tmp_path):
    rows = shuffled.run_until(shuffled.repeated(spark, folder, buffer=5_000, rows_per_batch=1_000, epochs=1), f"{tmp_path}/a", f"{tmp_path}/ca", 1_000).collect()
    assert all(r["name"] == f"r{r['id']}" and r["x"] == (None if r["id"] % 7 == 0 else r["id"] * 0.5) for r in rows) and len(rows) == 1_000
    spark.range(0).write.parquet(f"{tmp_path}/none")
    reader = shuffled.Reader(spark.range(0).schema, {"path": f"{tmp_path}/none"})
    assert reader.latestOffset() == reader.initialOffset() and reader.partitions(reader.initialOffset(), reader.latestOffset()) == []


def test_a_batch_is_cut_at_buffers(folder):
    reader = shuffled.Reader(None, {"path": folder, "buffer": 100, "rowsPerBatch": 250, "epochs": 2})
    start = reader.initialOffset()
    for _ in range(10):
        end = reader.latestOffset()
        parts = reader.partitions(start, end)
        assert sum(p.end - p.begin for p in parts) == 250 * (start != end) and all(p.end - p.begin <= 100 for p in parts)
        start = end
    assert end == {"epoch": 2, "position": 0}
