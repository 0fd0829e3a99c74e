import datetime
import os

import pandas as pd

from tallyforge.plans import source_queries

from .conftest import at


def test_late_rows_and_repeats_over_many_files(spark, tmp_path):
    folder = tmp_path / "crawl_logs.parquet"
    folder.mkdir()
    want = set()
    for k in range(120):  # three micro-batches, each older than the one before by days; 20 ids of the first come again in the last
        rows = [(k, at(200 - k)), (1000 + k % 100, at(200 - k) + datetime.timedelta(hours=1)), (5000 + k, None), (None, at(1))]
        want |= {k, 1000 + k % 100}
        path = folder / f"part-{k:03d}.parquet"
        frame = pd.DataFrame(rows, columns=["id", "started_at"]).astype({"id": "Int64", "started_at": "datetime64[us]"})
        frame.to_parquet(path)
        os.utime(path, (1_700_000_000 + k, 1_700_000_000 + k))
    assert sorted(r.id for r in source_queries.q_stream_dedupe(spark, str(tmp_path)).collect()) == sorted(want)


def test_upserts_go_on_after_a_restart_and_keep_what_was_late(spark, tmp_path):
    """A second run at the same place reads only new files and still knows the first run's rows."""
    from tallyforge.streaming import incremental

    folder, place, want = tmp_path / "rows.parquet", str(tmp_path / "place"), {}
    folder.mkdir()

    def land(k, rows):
        pd.DataFrame(rows, columns=["key", "t", "v"]).astype({"t": "datetime64[us]", "v": "Int64"}).to_parquet(folder / f"part-{k}.parquet")
        for key, t, v in rows:
            if key is not None and (key not in want or (t or at(-9999)) > want[key][0]):
                want[key] = (t or at(-9999), v)

    def run():
        path = incremental.upsert_stream(incremental.read_files(spark, str(folder), 1), "key", "t", ["v"], place)
        return {r.key: r.v for r in spark.read.parquet(path).collect()}

    land(0, [("a", at(5), 1), ("b", at(9), 2), (None, at(1), 3)])
    land(1, [("a", at(3), 4), ("c", None, 5)])
    assert run() == {k: v for k, (_, v) in want.items()} == {"a": 1, "b": 2, "c": 5}
    land(2, [("b", at(1), 6), ("c", at(2), 7), ("d", at(1), 8)])
    assert run() == {k: v for k, (_, v) in want.items()} == {"a": 1, "b": 2, "c": 7, "d": 8}
