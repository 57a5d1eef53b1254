"""Files too long for a column of their bytes, as arriving files of the directory stream."""

import hashlib
import os
import shutil

from tests.oracle import TABLES

GIVEN = "/root/testdata/sf0.001"


def test_sync_stream_takes_files_beyond_two_gigabytes(spark, tmp_path):
    from lakesearch import catalog
    from lakesearch.sources import files

    for name in TABLES:
        shutil.copy(f"{GIVEN}/{name}.parquet", tmp_path)
    with open(tmp_path / "long.parquet", "wb") as file:  # takes no room on disk
        file.truncate((2 << 30) + 7)
    rows = catalog.QUERIES["z05_sync_stream"](spark, str(tmp_path)).collect()
    assert {(r.source_uri, r.action) for r in rows} == {(f"sync://root/{n}", "add") for n in os.listdir(tmp_path) if n.endswith(".parquet")}
    assert len(rows) == len(TABLES) + 1

    (tmp_path / "long.parquet").unlink()
    found = files.scan_stream(spark, str(tmp_path), "*.parquet").writeStream.format("memory").queryName("hashes").trigger(availableNow=True).start()
    found.awaitTermination()
    want = {hashlib.sha256((tmp_path / f"{name}.parquet").read_bytes()).hexdigest() for name in TABLES}
    assert {r.content_hash for r in spark.table("hashes").collect()} == want
