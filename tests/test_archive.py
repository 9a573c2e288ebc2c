import io
import os
import tarfile

import duckdb
import numpy as np
import pytest
import zstandard
from pyspark.sql import functions as F

from blockloom.operators import chunk, codec, dedup, ecc, merkle
from blockloom.operators.archive import Archive, Options, convert, join, merge
from blockloom.plans import catalog
from blockloom.sources import files as sources
from blockloom.sources import records
from tests import compare

SMALL = Options(least=64, average=256, most=1024)
SCHEMA = "seq long, path string, content binary"


def frame(spark, contents):
    return spark.createDataFrame([(k, p, bytearray(c)) for k, (p, c) in enumerate(contents.items())], SCHEMA)


def contents(df):
    return {r.path: bytes(r.content) for r in df.collect()}


@pytest.fixture(scope="module")
def base(spark, tmp_path_factory):
    data = {f"f{i}": f"content {i % 7} ".encode() * 300 for i in range(20)} | {"empty": b"", "noise": os.urandom(9000)}
    path = str(tmp_path_factory.mktemp("a") / "archive")
    return data, Archive.create(frame(spark, data), path, SMALL)


def test_round_trip_and_dedup(base):
    data, a = base
    assert contents(a.extract()) == data
    assert a.cat("f3") == data["f3"]
    info = a.info().first()
    assert info.files == 22 and info.unique_blocks < info.block_count
    with pytest.raises(FileNotFoundError):
        a.cat("missing")


def test_append_log_diff_time_travel(spark, tmp_path):
    g0, g1 = {"stable": b"s" * 500, "modify": b"version 1", "remove": b"r"}, {"stable": b"s" * 500, "modify": b"version 2 longer", "added": b"n"}
    a = Archive.create(frame(spark, g0), str(tmp_path / "a"), SMALL).append(frame(spark, g1))
    assert contents(a.extract(0)) == g0 and contents(a.extract()) == g1
    assert [tuple(r) for r in a.diff(0, 1).collect()] == [("remove", "removed"), ("modify", "modified"), ("added", "added"), ("stable", "unchanged")]
    assert [r.files for r in a.log().collect()] == [3, 3]
    with pytest.raises(ValueError):
        a.manifest(5)


def test_incremental(spark, base, tmp_path):
    data, a = base
    more = data | {"new": os.urandom(3000)}
    i = a.incremental(frame(spark, more), str(tmp_path / "i"))
    assert contents(i.extract()) == more
    assert i.blocks().agg(F.sum("uncompressed_size")).first()[0] == 3000


def test_merge_newer_wins(spark, tmp_path):
    def make(name, data, times):
        df = frame(spark, data).withColumn("mtime_ns", F.element_at(F.create_map(*[F.lit(x) for kv in times.items() for x in kv]), F.col("path")))
        return Archive.create(df, str(tmp_path / name), SMALL)

    a = make("a", {"x": b"ax", "y": b"ay", "z": b"az"}, {"x": 1, "y": 5, "z": 3})
    b = make("b", {"x": b"bx", "y": b"by", "z": b"bz", "w": b"bw"}, {"x": 2, "y": 4, "z": 3, "w": 0})
    assert contents(merge(a, b, str(tmp_path / "m")).extract()) == {"x": b"bx", "y": b"ay", "z": b"az", "w": b"bw"}


def test_verify_and_repair(spark, base, tmp_path):
    import shutil

    data, a = base
    shutil.copytree(a.path, tmp_path / "d")
    shutil.rmtree(tmp_path / "d" / "blocks")
    a.blocks().withColumn("payload", F.when(F.col("block_seq") % 10 < 2, F.unhex(F.lit("00FF"))).otherwise(F.col("payload"))).write.parquet(str(tmp_path / "d" / "blocks"))
    d = Archive(spark, str(tmp_path / "d"))
    found = d.verify().first()
    assert found.corrupted == found.recoverable > 0
    assert contents(d.extract()) == data  # parity restores them on the way
    r = d.repair(str(tmp_path / "r"))
    assert contents(r.extract()) == data
    counts = d.repairs(r).first()
    assert counts.recovered == counts.corrupted == found.corrupted and counts.unrecoverable == 0
    shutil.rmtree(tmp_path / "d" / "blocks")
    a.blocks().withColumn("payload", F.when(F.col("block_seq") < 3, F.unhex(F.lit("00FF"))).otherwise(F.col("payload"))).write.parquet(str(tmp_path / "d" / "blocks"))
    assert Archive(spark, str(tmp_path / "d")).verify().first().recoverable == 0
    with pytest.raises(Exception, match="damaged"):
        Archive(spark, str(tmp_path / "d")).extract().collect()


def test_verify_sees_what_is_missing_or_changed(spark, base, tmp_path):
    import shutil

    data, a = base
    whole = a.verify().first()
    assert (whole.corrupted, whole.missing, whole.affected_files, whole.manifest_ok, whole.root_ok) == (0, 0, 0, True, True)
    shutil.copytree(a.path, tmp_path / "d")
    shutil.rmtree(tmp_path / "d" / "blocks")
    a.blocks().filter("block_seq <> 3").write.parquet(str(tmp_path / "d" / "blocks"))
    found = Archive(spark, str(tmp_path / "d")).verify().first()
    assert found.missing == 1 and found.corrupted == 0 and found.affected_files >= 1 and found.manifest_ok and not found.root_ok
    shutil.rmtree(tmp_path / "d" / "manifest")
    a.entries().withColumn("mode", F.lit(0)).write.partitionBy("generation").parquet(str(tmp_path / "d" / "manifest"))
    assert not Archive(spark, str(tmp_path / "d")).verify().first().manifest_ok


def test_manifest_copy(spark, base, tmp_path):
    import shutil

    data, a = base
    shutil.copytree(a.path, tmp_path / "d")
    for f in (tmp_path / "d" / "manifest").rglob("*.parquet"):
        f.write_bytes(f.read_bytes()[:-9] + b"x" * 9)
    for f in (tmp_path / "d" / "manifest").rglob("*.crc"):
        f.unlink()
    d = Archive(spark, str(tmp_path / "d"))
    assert contents(d.extract()) == data and d.index == "manifest_copy"


def test_stats_and_offsets(spark, tmp_path):
    data = {"a": b"a" * 500, "b": b"a" * 500, "c": b"c" * 300, "none": b""}
    a = Archive.create(frame(spark, data), str(tmp_path / "a"), SMALL)
    s = a.stats().first()
    pieces = [p for c in data.values() for p in cut(c)]
    assert (s.files, s.dirs, s.input_bytes, s.block_count) == (4, 0, 1300, len(pieces))
    assert s.new_blocks == len(set(pieces)) and s.reused_blocks == len(pieces) - len(set(pieces))
    assert s.dedup_savings == 1300 - sum(map(len, set(pieces)))
    rows = {r.hash: r for r in a.blocks().collect()}
    at, want = 16, {}
    for group in sorted({r.group_id for r in rows.values()}):
        mine = sorted((r for r in rows.values() if r.group_id == group), key=lambda r: r.block_seq)
        for r in mine:
            want[r.hash], at = at, at + 48 + r.compressed_size
        at += 2 * (48 + max(r.compressed_size for r in mine))
    assert {r.hash: r.offset for r in a.manifest().selectExpr("inline(block_refs)").collect()} == want
    assert s.archive_size == at + 76
    inc = a.incremental(frame(spark, data | {"d": b"d" * 100}), str(tmp_path / "i")).stats().first()
    assert (inc.new_blocks, inc.reused_blocks) == (1, s.block_count)
    more = a.append(frame(spark, data | {"d": b"d" * 100}))
    assert [(r.generation, r.new_blocks) for r in more.stats().collect()] == [(0, s.new_blocks), (1, 1)]


def cut(content):
    ends = chunk.cut_points(content, 64, 256, 1024)
    return [content[x:y] for x, y in zip([0, *ends], ends, strict=False)]


def test_null_and_empty_content(spark, tmp_path):
    rows = spark.createDataFrame([(1, "null", None), (1 << 62, "empty", bytearray(b"")), ((1 << 62) + 5, "some", bytearray(b"x" * 3000))], SCHEMA)
    assert contents(Archive.create(rows, str(tmp_path / "a"), SMALL).extract()) == {"null": b"", "empty": b"", "some": b"x" * 3000}
    table = spark.createDataFrame([(1, None), (2, ""), (3, "text" * 40_000)], "doc_id long, text string")
    table.write.parquet(f"{tmp_path}/documents.parquet")
    for name in ("extract_roundtrip", "content_roundtrip", "manifest_refs", "dedup_block_refs", "dedup_stats", "archive_roundtrip", "file_totals", "archive_list", "archive_create_stats", "archive_verify"):
        con = duckdb.connect()
        con.sql(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/documents.parquet/*.parquet'")
        got, want = catalog.queries()[name](spark, str(tmp_path)).toPandas(), con.sql(catalog.oracle_sql()[name]).df()
        assert sorted(got.columns) == sorted(want.columns) and compare.rows(got) == compare.rows(want), name


def test_rekey(spark, tmp_path):
    data = {"s": b"secret data " * 100}
    a = Archive.create(frame(spark, data), str(tmp_path / "e"), Options(least=64, average=256, most=1024, passphrase="right", ecc="none"))
    with pytest.raises(ValueError):
        a.rekey("wrong", "new")
    assert contents(a.rekey("right", "new").extract()) == data
    with pytest.raises(ValueError):
        Archive(spark, str(tmp_path / "e")).unlock("right")
    assert contents(Archive(spark, str(tmp_path / "e")).unlock("new").extract()) == data


def test_hard_links_and_owners(spark, tmp_path):
    with tarfile.open(tmp_path / "a.tar", "w") as tar:
        for name, kind, link in (("f", tarfile.REGTYPE, ""), ("l", tarfile.LNKTYPE, "f"), ("gone", tarfile.LNKTYPE, "missing")):
            info = tarfile.TarInfo(name)
            info.size, info.type, info.linkname, info.uid, info.gid = 3 if link == "" else 0, kind, link, 7, 9
            tar.addfile(info, io.BytesIO(b"abc"))
    a = convert(spark, str(tmp_path / "a.tar"), str(tmp_path / "archive"))
    assert {(r.path, r.kind, r.uid, r.gid) for r in a.manifest().collect()} == {("f", "file", 7, 9), ("l", "hardlink", 7, 9), ("gone", "hardlink", 7, 9)}
    a.restore(str(tmp_path / "out"))
    assert os.path.samefile(tmp_path / "out" / "f", tmp_path / "out" / "l") and not (tmp_path / "out" / "gone").exists()


def test_nested_ignore_files(spark, tmp_path):
    tree = {".gitignore": "*.log\n/only_here\nbuild/\n!keep.log\n", "a.log": "", "keep.log": "", "only_here": "", "sub/only_here": "", "sub/.gitignore": "!b.log\nx/**/z\n", "sub/b.log": "", "sub/x/y/z": "", "sub/x/z": "", "sub/z": "", "build/o": "", "sub/build": "", ".git/info/exclude": "private\n", "private": "", "odd [1].txt": "x", "sub/.ignore": "z\n"}
    for name, text in tree.items():
        (tmp_path / name).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / name).write_text(text)
    os.symlink("a.log", tmp_path / "link")
    rows = sources.walk(spark, str(tmp_path)).orderBy("seq").collect()
    want = {".gitignore", "keep.log", "sub", "sub/only_here", "sub/.gitignore", "sub/b.log", "sub/x", "sub/x/y", "sub/build", "odd [1].txt", "sub/.ignore", "link"}
    assert {r.path for r in rows} == want and [r.path for r in rows] == sorted(want)
    assert {r.path: bytes(r.content) for r in rows if r.kind == "file"}["odd [1].txt"] == b"x"
    assert all(r.uid == os.getuid() for r in rows)
    assert [r.path for r in sources.walk(spark, str(tmp_path / "keep.log")).collect()] == ["keep.log"]


def test_gear_hashes_byte_by_byte(monkeypatch):
    data = np.random.default_rng(3).integers(0, 256, 5000, dtype=np.uint8)
    want, h = [], 0
    for b in data.tolist():
        h = ((h << 1) + int(chunk.gear_table()[b])) % (1 << 64)
        want.append(h)
    assert chunk.gear_hashes(data).tolist() == want
    ends = chunk.cut_points(data.tobytes(), 64, 256, 1024)
    monkeypatch.setattr(chunk, "WINDOW", 100)
    assert chunk.cut_points(data.tobytes(), 64, 256, 1024) == ends


def test_records(spark, base, tmp_path):
    data, a = base
    assert records.write_records(a.blocks().repartition(2), f"file://{tmp_path}/r") == a.blocks().count()
    files = sorted((tmp_path / "r").iterdir())
    want = {r.hash: bytes(r.payload) for r in a.blocks().collect()}
    read = lambda: {r.hash: bytes(r.payload) for r in records.scan_records(spark, str(tmp_path / "r")).collect() if r.hash}
    assert len(files) == 2 and read() == want
    whole = files[0].read_bytes()
    at, size, again = records.read_footer(whole[-76:])[:3]
    for lost in (range(at + 9, at + 10), range(len(whole) - 3, len(whole)), range(at, len(whole))):  # first index, footer, both
        files[0].write_bytes(bytes(255 - b if k in lost else b for k, b in enumerate(whole)))
        assert read() == want
    files[0].write_bytes(bytes(255 - b if k == 20 else b for k, b in enumerate(whole)))  # the first record's head
    assert len(read()) == len(want) - 1
    for spoiled in (b"x" + whole[1:], whole[:6] + b"x" + whole[7:], whole[:10]):
        files[0].write_bytes(spoiled)
        with pytest.raises(Exception):
            read()
    with pytest.raises(ValueError, match="later"):
        records.read_header(b"BLMR\xff\xff" + bytes(10))


def test_lossy_text(spark):
    from blockloom.functions import scalar

    raw = [b"plain", "é".encode(), b"a\xffb", b"\xe2\x82", b""]
    df = spark.createDataFrame([(bytearray(x),) for x in raw], "raw binary")
    assert [r[0] for r in df.select(scalar.lossy_text(F.col("raw"))).collect()] == [x.decode(errors="replace") for x in raw]


def test_islands_over_ranges(spark):
    rng = np.random.default_rng(2)
    kinds = [bool(x) for x in rng.integers(0, 2, 300)]
    want, group = [], 0
    for k, parity in enumerate(kinds):
        group += k > 0 and not parity and kinds[k - 1]
        want.append(group)
    df = spark.createDataFrame([(7 * k, p) for k, p in enumerate(kinds)], "offset long, is_parity boolean").repartition(5)
    assert [r.group_no for r in ecc.islands(df).orderBy("offset").collect()] == want


def test_numbers_over_any_values(spark):
    rng = np.random.default_rng(4)
    rows = sorted({(int(a), int(b)) for a, b in zip(rng.integers(-(1 << 62), 1 << 62, 200), rng.integers(0, 9, 200), strict=True)} | {(5, k) for k in range(100)})
    df = spark.createDataFrame(rows, "a long, b long").repartition(3)
    got = dedup.numbered(df, ["a", "b"], {"n": F.lit(1), "s": F.col("b")}).collect()
    assert sorted((r.n, r.a, r.b) for r in got) == [(k, a, b) for k, (a, b) in enumerate(rows)]
    assert all(r.s == sum(b for _, b in rows[: r.n]) for r in got)


def test_a_broken_subpackage_leaves_the_rest(tmp_path):
    import subprocess
    import sys

    here = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    for name in ("__spark_entry__.py", "blockloom"):
        os.symlink(os.path.join(here, name), tmp_path / name) if name.endswith(".py") else None
    (tmp_path / "blockloom").mkdir()
    for name in os.listdir(os.path.join(here, "blockloom")):
        if name != "llm":
            os.symlink(os.path.join(here, "blockloom", name), tmp_path / "blockloom" / name)
    entry = (tmp_path / "__spark_entry__.py").read_text()
    (tmp_path / "__spark_entry__.py").unlink()
    (tmp_path / "__spark_entry__.py").write_text(entry)
    for broken in (None, "import does_not_exist\n"):
        if broken:
            (tmp_path / "blockloom" / "llm").mkdir()
            (tmp_path / "blockloom" / "llm" / "__init__.py").write_text(broken)
        code = "import __spark_entry__ as e; q = e.queries(); print(len(q), len(e.oracle_sql()), any(k.startswith('op') for k in q))"
        out = subprocess.run([sys.executable, "-c", code], cwd=tmp_path, env={k: v for k, v in os.environ.items() if k != "PYTHONPATH"}, capture_output=True, text=True)
        n, sql, ops = out.stdout.split()[-3:]
        assert int(n) == len(catalog.queries()) and int(sql) == len(catalog.oracle_sql()) and ops == "False"


def test_encryption(spark, tmp_path):
    data = {"s": b"secret data " * 100}
    Archive.create(frame(spark, data), str(tmp_path / "e"), Options(least=64, average=256, most=1024, passphrase="right", ecc="none"))
    assert contents(Archive(spark, str(tmp_path / "e")).unlock("right").extract()) == data
    with pytest.raises(ValueError):
        Archive(spark, str(tmp_path / "e")).extract()
    with pytest.raises(Exception):
        Archive(spark, str(tmp_path / "e")).unlock("wrong").extract().collect()


def test_reed_solomon():
    shards = [bytes([i]) * (1000 + 100 * i) for i in range(10)]
    parity, sizes = ecc.encode(shards, 2), [len(s) for s in shards]
    lost = [None if i in (0, 3) else s for i, s in enumerate(shards)]
    assert ecc.reconstruct(lost, sizes, parity) == shards
    with pytest.raises(ValueError):
        ecc.reconstruct([None if i < 3 else s for i, s in enumerate(shards)], sizes, parity)
    part = shards[:3]
    assert ecc.reconstruct([part[0], None, part[2]], sizes[:3], ecc.encode(part, 2)) == part


def test_cut_points():
    noise = np.random.default_rng(1).integers(0, 256, 300_000, dtype=np.uint8).tobytes()
    ends = chunk.cut_points(noise, 1 << 10, 1 << 12, 1 << 14)
    sizes = np.diff([0, *ends])
    assert ends[-1] == len(noise) and sizes.max() <= 1 << 14 and sizes[:-1].min() >= 1 << 10 and 2000 < sizes.mean() < 9000
    moved = chunk.cut_points(b"inserted" + noise, 1 << 10, 1 << 12, 1 << 14)
    assert len({e + 8 for e in ends} & set(moved)) > len(ends) // 2
    assert chunk.cut_points(b"", 1, 2, 4) == [] and chunk.cut_points(b"abc", 64, 256, 1024) == [3]


def test_codecs(spark):
    data = [("a", bytearray(b"x" * 5000)), ("b", bytearray(os.urandom(500))), ("c", bytearray(b"tiny"))]
    df = spark.createDataFrame(data, "id string, chunk binary").select(F.sha2("chunk", 256).alias("hash"), "chunk")
    for name in ("zstd", "lz4", "none"):
        assert codec.decompress_blocks(codec.compress_blocks(df, name)).filter("intact").count() == 3
    with pytest.raises(ValueError):
        codec.compress_blocks(df, "odd")


def test_tar_sources(spark, tmp_path):
    raw = io.BytesIO()
    with tarfile.open(fileobj=raw, mode="w") as tar:
        for name, data in (("hello.txt", b"hi"), ("d/second.txt", b"two")):
            info = tarfile.TarInfo(name)
            info.size = len(data)
            tar.addfile(info, io.BytesIO(data))
    (tmp_path / "a.tar").write_bytes(raw.getvalue())
    (tmp_path / "b.tar.zst").write_bytes(zstandard.ZstdCompressor().compress(raw.getvalue()))
    (tmp_path / "no.txt").write_bytes(b"plain text")
    rows = sources.read_tars(spark, str(tmp_path)).collect()
    assert sorted((r.path, bytes(r.content)) for r in rows) == sorted([("hello.txt", b"hi"), ("d/second.txt", b"two")] * 2)


def test_convert_and_restore(spark, tmp_path):
    with tarfile.open(tmp_path / "a.tar.gz", "w:gz") as tar:
        for name, data, kind in (("d", b"", tarfile.DIRTYPE), ("d/one.txt", b"one" * 500, tarfile.REGTYPE), ("empty", b"", tarfile.REGTYPE), ("d/link", b"", tarfile.SYMTYPE)):
            info = tarfile.TarInfo(name)
            info.size, info.type, info.mtime, info.mode, info.linkname = len(data), kind, 1_600_000_000, 0o750, "../empty" if kind == tarfile.SYMTYPE else ""
            tar.addfile(info, io.BytesIO(data))
    a = convert(spark, str(tmp_path / "a.tar.gz"), str(tmp_path / "archive"))
    out = tmp_path / "out"
    assert {r.kind: r.n for r in a.restore(str(out)).collect()} == {"dir": 1, "file": 2, "symlink": 1}
    assert (out / "d/one.txt").read_bytes() == b"one" * 500 and (out / "empty").read_bytes() == b""
    assert os.readlink(out / "d/link") == "../empty"
    assert (out / "d").stat().st_mtime == (out / "d/one.txt").stat().st_mtime == 1_600_000_000 and (out / "d/one.txt").stat().st_mode & 0o777 == 0o750
    assert sorted(os.listdir(out)) == ["d", "empty"]


@pytest.mark.parametrize("path,kind,target", [("../x", "file", None), ("/x", "file", None), ("d/l", "symlink", "../../x"), ("l", "symlink", "/etc/passwd")])
def test_restore_refuses_to_leave(spark, tmp_path, path, kind, target):
    rows = spark.createDataFrame([(1, path, kind, target, bytearray(b"x"))], "seq long, path string, kind string, target string, content binary")
    with pytest.raises(ValueError):
        Archive.create(rows, str(tmp_path / "a"), SMALL).restore(str(tmp_path / "out"))
    assert not (tmp_path / "out").exists()


def test_split_and_join(spark, base, tmp_path):
    import shutil

    data, a = base
    n = a.split(str(tmp_path / "v"), 2048)
    assert n >= 3
    assert contents(join(spark, str(tmp_path / "v"), str(tmp_path / "j")).extract()) == data
    shutil.rmtree(tmp_path / "v" / "volumes" / "volume_no=2")
    with pytest.raises(ValueError, match="1 volumes"):
        join(spark, str(tmp_path / "v"), str(tmp_path / "k"))


def test_same_path_from_two_sources(spark, tmp_path):
    rows = spark.createDataFrame([(1, "p", bytearray(b"a" * 3000)), (2, "p", bytearray(b"b" * 3000))], SCHEMA)
    got = Archive.create(rows, str(tmp_path / "t"), SMALL).extract().collect()
    assert sorted(bytes(r.content) for r in got) == [b"a" * 3000, b"b" * 3000]


def test_walk(spark, tmp_path):
    for name, text in ((".gitignore", "*.log\n"), ("keep.txt", "k"), ("drop.log", "d"), (".git/config", "c"), ("sub/x", "x")):
        (tmp_path / name).parent.mkdir(exist_ok=True)
        (tmp_path / name).write_text(text)
    assert [r.path for r in sources.walk(spark, str(tmp_path)).collect()] == [".gitignore", "keep.txt", "sub", "sub/x"]
    assert "drop.log" in [r.path for r in sources.walk(spark, str(tmp_path), respect_ignore=False).collect()]


def test_merkle_and_empty(spark):
    import hashlib

    def fold(h):
        while len(h) > 1:
            h = [hashlib.sha256((h[i] + h[i + 1]).encode()).hexdigest() if i + 1 < len(h) else h[i] for i in range(0, len(h), 2)]
        return h[0]

    leaves = [hashlib.sha256(bytes([i])).hexdigest() for i in range(13)]
    df = spark.createDataFrame(list(enumerate(leaves)), "i long, hash string")
    assert merkle.merkle_root(df).first().root == fold(leaves)
    none = spark.createDataFrame([], "seq long, hash string, len long")
    assert dedup.block_refs(none).count() == 0


def test_stream_of_generations(spark, tmp_path):
    import time

    from blockloom.streaming.generations import append_stream
    from blockloom.streaming.progress import Progress

    (tmp_path / "in").mkdir()
    frame(spark, {"a": b"one"}).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = lambda: append_stream(spark.readStream.schema(SCHEMA).parquet(str(tmp_path / "in")), str(tmp_path / "ar"), str(tmp_path / "cp"), SMALL)
    progress = Progress()
    spark.streams.addListener(progress)
    stream().awaitTermination(120)
    frame(spark, {"b": b"two"}).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream().awaitTermination(120)
    assert contents(Archive(spark, str(tmp_path / "ar")).extract(0)) == {"a": b"one"}
    assert contents(Archive(spark, str(tmp_path / "ar")).extract()) == {"b": b"two"}
    for _ in range(100):  # events come later than the end of a query
        if progress.ended == 2:
            break
        time.sleep(0.1)
    assert progress.rows == 2 and progress.batches >= 2 and progress.left(2) == 0 and progress.left(4) > 0
    spark.streams.removeListener(progress)


def test_dedup_with_bounded_state(spark, tmp_path):
    from blockloom.streaming.generations import first_seen_within

    rows = [("2024-01-01 00:00:00", "a"), ("2024-01-01 00:00:05", "a"), ("2024-01-01 00:00:06", "b")]
    later = [("2024-01-01 00:00:07", "b"), ("2024-01-01 02:00:00", "c")]
    last = [("2024-01-01 02:00:01", "a"), ("2024-01-01 02:00:02", "c")]
    out = []
    for k, part in enumerate((rows, later, last)):
        spark.createDataFrame(part, "ts string, hash string").selectExpr("cast(ts as timestamp) ts", "hash").coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        stream = spark.readStream.schema("ts timestamp, hash string").parquet(str(tmp_path / "in"))
        first_seen_within(stream, "ts", "10 minutes").writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start().awaitTermination(120)
        out.append(sorted(r.hash for r in spark.read.parquet(str(tmp_path / "out")).collect()))
    assert out == [["a", "b"], ["a", "b", "c"], ["a", "a", "b", "c"]]  # a is forgotten two hours later
