"""What archives shuffle, spill and write beside their input, with joins as they are where tables are too large to be sent to all tasks."""

import base64
import contextlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from blockloom.operators import chunk, dedup, ecc
from blockloom.plans import catalog
from tests import compare


@contextlib.contextmanager
def counted(spark):
    """A dict that has MB shuffled, spilled and written by the stages that ran inside."""
    sc, java = spark.sparkContext._jsc.sc(), spark.sparkContext._jvm
    no, out = spark.sparkContext._gateway.new_array(java.double, 0), {}

    def total():
        sc.listenerBus().waitUntilEmpty()
        stages = sc.statusStore().stageList(None, False, False, no, java.java.util.ArrayList())
        return {stages.apply(k).stageId(): stages.apply(k).shuffleWriteBytes() + stages.apply(k).diskBytesSpilled() + stages.apply(k).outputBytes() for k in range(stages.size())}

    before = total()
    yield out
    out["mb"] = sum(v for k, v in total().items() if k not in before) / 1e6


@pytest.fixture(scope="module")
def texts(spark, tmp_path_factory):
    """300 documents of 10 kB that compress to three quarters, as a folder of tables; and their MB."""
    folder, rng = str(tmp_path_factory.mktemp("texts")), np.random.default_rng(5)
    rows = [(k, base64.b64encode(rng.bytes(7500)).decode()) for k in range(300)]
    spark.createDataFrame(rows, "doc_id long, text string").coalesce(2).write.parquet(f"{folder}/documents.parquet")
    return folder, sum(len(t) for _, t in rows) / 1e6


#: Bytes that each query may move for each byte of text.
MOST = {
    "archive_merge": 7,
    "archive_incremental": 5,
    "archive_time_travel": 5.5,
    "archive_split_join": 6.2,
    "archive_repair": 5.3,
    "archive_roundtrip": 5.5,
    "archive_repair_partly": 5,
    "archive_restore": 3.5,
    "archive_convert": 4.2,
    "archive_incremental_stats": 3.8,
    "archive_append_log": 3.8,
    "archive_diff": 3.8,
    "archive_append_stats": 3.8,
    "archive_info": 2.1,
    "archive_heal": 5.3,
}


@pytest.mark.parametrize("name", sorted(MOST))
def test_moved(spark, texts, name):
    folder, mb = texts
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "20k")
    try:
        with counted(spark) as found:
            got = catalog.queries()[name](spark, folder).toPandas()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    con = compare.duckdb.connect()
    con.sql(f"CREATE VIEW documents AS SELECT * FROM '{folder}/documents.parquet/*.parquet'")
    assert compare.rows(got) == compare.rows(con.sql(catalog.oracle_sql()[name]).df())
    assert found["mb"] < MOST[name] * mb


def test_numbers_of_rows_in_any_order(spark):
    """Numbers that follow row ids, and numbers that don't, within and across words of 64 rows."""
    rng = np.random.default_rng(3)
    ids = sorted({int(x) for x in rng.integers(0, 1000, 400)} | {63, 64, 127, 128, (5 << 33) + 63, (5 << 33) + 64, (1 << 60) + 1})
    rows = spark.createDataFrame([(i, f"v{i}") for i in range(1000)] + [(i, f"v{i}") for i in ids if i >= 1000], "_row long, value string")
    for numbers in (list(range(7, 7 + len(ids))), [int(x) for x in rng.permutation(len(ids))]):
        table = spark.createDataFrame(list(zip(ids, numbers, strict=True)), "_row long, n long")
        assert {(r.value, r.n) for r in dedup.placed(rows, table, "n").collect()} == {(f"v{i}", n) for i, n in zip(ids, numbers, strict=True)}
    found = dedup.marked(rows, table, "hit").collect()
    assert len(found) == rows.count() and {r.value for r in found if r.hit} == {f"v{i}" for i in ids}


@pytest.mark.parametrize("ordered", [True, False])
def test_parity_of_stored_blocks(spark, tmp_path, ordered):
    """The same parity whether groups lie whole in a file, apart, or in no order."""
    rows = [(k // 10, k, bytearray(np.random.default_rng(k).bytes(50 + 13 * k % 97))) for k in range(237)]
    table = spark.createDataFrame(rows, "group_id long, block_seq long, payload binary")
    table = table.repartitionByRange(3, "block_seq").sortWithinPartitions("block_seq") if ordered else table.repartition(5, F.xxhash64("block_seq"))
    table.write.parquet(str(tmp_path / "blocks"))
    stored = spark.read.parquet(str(tmp_path / "blocks"))
    key = lambda df: sorted((r.group_id, r.parity_idx, r.shard_size, r.hash, bytes(r.payload)) for r in df.collect())
    assert key(ecc.parity_of_stored(stored, 2)) == key(ecc.parity_blocks(stored, 2)) and ecc.parity_of_stored(stored, 2).count() == 48


def test_a_worker_gathers_little_of_its_input():
    """Whatever goes in, 4 MB of chunks and parity leave at once, and the end of one batch more."""
    files = pa.RecordBatch.from_pydict({"seq": list(range(40)), "content": [bytes(1_000_000)] * 40})
    sizes = [sum(map(len, b.column("chunk").to_pylist())) for b in chunk._cut(1 << 27, 1 << 28, 1 << 29, [files])]
    assert sum(sizes) == 40_000_000 and max(sizes) <= 5_000_000
    blocks = pa.RecordBatch.from_pydict({"group_id": [k // 10 for k in range(200)], "block_seq": list(range(200)), "payload": [bytes(500_000)] * 200})
    sizes = [b.column("payload").nbytes for b in ecc._whole_groups(2, 199, 10, [blocks])]
    assert max(sizes) <= 6_000_000
