"""Named queries over the test tables, each with the SQL that must give the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from blockloom import schema as S
from blockloom.functions import scalar
from blockloom.operators import chunk, codec, dedup, ecc, merkle, versions, volumes
from blockloom.operators.archive import Archive, Options, convert, join, merge
from blockloom.scratch import new_folder
from blockloom.sources.files import table_files
from blockloom.sources.records import scan_records, write_records
from blockloom.sources.restore import link_stays_inside, write_tars

CHUNK, CAP, VOLUME, PARITY, RENAMED = 1024, 100, 200_000, 2, 1_000_000_000_000


def _read(spark: SparkSession, d: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{table}.parquet")


def _files(spark: SparkSession, d: str) -> DataFrame:
    return table_files(_read(spark, d, "documents"), "doc_id", "text")


def _chunks(spark: SparkSession, d: str) -> DataFrame:
    """Whole documents as chunks: seq, hash, len."""
    return _files(spark, d).select("seq", "hash", F.col("size").alias("len"))


def _versions(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    """Two manifests of all documents: in b some have another name, another time or another text."""
    a = _files(spark, d).select(F.col("seq").alias("path"), "hash", "size", (F.col("seq") * 1000).alias("mtime"))
    b = a.select(
        F.expr(f"path + case when path % 3 = 0 then {RENAMED} else 0 end").alias("path"),
        F.when(F.col("path") % 7 == 0, F.sha2(F.concat("hash", F.lit("v2")), 256)).otherwise(F.col("hash")).alias("hash"),
        "size",
        F.expr("mtime + case path % 5 when 0 then 10 when 1 then -10 else 0 end").alias("mtime"),
    )
    return a, b


def _runs(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    """All documents as a later run sees them, two thirds of them edited since, and as the base run saw them."""
    base = _files(spark, d).select("seq", "hash", "size")
    return base.withColumn("hash", F.when(F.col("seq") % 3 != 0, F.sha2(F.concat("hash", F.lit("v2")), 256)).otherwise(F.col("hash"))), base


def _events(spark: SparkSession, d: str) -> DataFrame:
    e = _read(spark, d, "events")
    text = F.concat_ws("|", "event_type", "props")
    return e.select(F.col("user_id").alias("path"), F.datediff(F.to_date("ts"), F.lit("2024-01-01").cast("date")).cast("long").alias("day"), "ts", "event_id", F.sha2(text, 256).alias("hash"), F.octet_length(text).cast("long").alias("size"))


def _generations(spark: SparkSession, d: str) -> DataFrame:
    """A generation for each day from the first event's to the last one's: one row a day."""
    events = _events(spark, d)
    days = events.agg(F.min("day").alias("low"), F.max("day").alias("high")).select(F.explode(F.sequence("low", "high")).alias("generation"))
    return versions.as_of(events, days)


def _damaged(spark: SparkSession, d: str) -> DataFrame:
    blocks = dedup.unique_blocks(_chunks(spark, d))
    return blocks.withColumns({"group_id": F.floor(F.col("block_seq") / 10), "corrupted": F.col("block_seq") % 13 == 0})


def _scan(spark: SparkSession, d: str) -> DataFrame:
    """A linear scan of data blocks with parity rows after each group."""
    blocks = dedup.unique_blocks(_chunks(spark, d)).select((F.col("block_seq") * 100).alias("offset"), F.lit(False).alias("is_parity"), (F.col("block_seq") % 10 == 9).alias("last"))
    parity = blocks.filter("last").select(F.explode(F.array(F.col("offset") + 1, F.col("offset") + 2)).alias("offset"), F.lit(True).alias("is_parity"))
    return blocks.select("offset", "is_parity").union(parity)


# ---- queries ----


def dedup_block_refs(s, d):
    return dedup.block_refs(_chunks(s, d))


def dedup_unique_blocks(s, d):
    return dedup.unique_blocks(_chunks(s, d))


def dedup_stats(s, d):
    return dedup.dedup_stats(_chunks(s, d))


def dedup_cap_overflow(s, d):
    return dedup.capped_stats(_chunks(s, d), CAP)


def block_offsets(s, d):
    return dedup.unique_blocks(_chunks(s, d)).select("block_seq", "hash", "offset")


def ecc_group_plan(s, d):
    return dedup.ecc_plan(dedup.unique_blocks(_chunks(s, d)))


def ecc_overhead(s, d):
    levels = s.createDataFrame([(x,) for x in ("low", "Medium", "med", "high", "none", "OFF", "odd")], "level string")
    parity = scalar.ecc_parity(F.col("level"))
    return levels.select("level", F.coalesce(parity, F.lit(-1)).alias("parity"), F.coalesce(scalar.ecc_overhead(parity).cast("double"), F.lit(-1.0)).alias("overhead"))


def fixed_chunks(s, d):
    return chunk.fixed_chunks(_files(s, d), CHUNK).select("seq", "pos", "hash", "len")


def chunk_dedup_stats(s, d):
    c = chunk.fixed_chunks(_files(s, d), CHUNK)
    return dedup.dedup_stats(c.select(F.col("seq"), "hash", "len"))


def manifest_refs(s, d):
    """Ordered chunk hashes of each file, as one fingerprint."""
    c = chunk.fixed_chunks(_files(s, d), CHUNK).groupBy("seq").agg(F.sort_array(F.collect_list(F.struct("pos", "hash"))).alias("r"))
    c = _files(s, d).select("seq").join(c, "seq", "left")  # an empty file has no chunks and stays
    return c.select("seq", F.coalesce(F.size("r"), F.lit(0)).cast("long").alias("n_refs"), F.sha2(F.coalesce(F.array_join(F.transform("r", lambda x: x["hash"]), ""), F.lit("")), 256).alias("fingerprint"))


def _rebuilt(s, d):
    """Files put together again from references and unique blocks."""
    c = chunk.fixed_chunks(_files(s, d), CHUNK)
    store = c.groupBy("hash").agg(F.min("chunk").alias("chunk"))
    rows = c.select("seq", "pos", "hash").join(store, "hash").groupBy("seq").agg(chunk.joined(F.collect_list(F.struct("pos", "chunk")), "chunk", "string").alias("content"))
    return _files(s, d).select("seq").join(rows, "seq", "left").select("seq", F.coalesce("content", F.lit("")).alias("content"))


def extract_roundtrip(s, d):
    return _rebuilt(s, d).select("seq", F.sha2("content", 256).alias("hash"), F.octet_length("content").cast("long").alias("size"))


def cat_one(s, d):
    """One file only: the filter reaches the scan before chunks are made."""
    f = _files(s, d).filter("seq = 7")
    c = chunk.fixed_chunks(f, CHUNK).groupBy("seq").agg(chunk.joined(F.collect_list(F.struct("pos", "chunk")), "chunk", "string").alias("content"))
    return f.select("seq").join(c, "seq", "left").select("seq", F.coalesce("content", F.lit("")).alias("content"))


def list_short(s, d):
    return _files(s, d).select("path").orderBy("path")


def list_long(s, d):
    o = _read(s, d, "orders")
    kind = F.when(F.col("o_orderkey") % 7 == 0, "dir").when(F.col("o_orderkey") % 11 == 0, "symlink").otherwise("file")
    return o.select(F.col("o_orderkey").alias("path"), scalar.type_char(kind).alias("type"), scalar.octal_mode(F.col("o_orderkey") % 4096).alias("mode"))


def file_totals(s, d):
    f = _files(s, d)
    return f.agg(F.count("*").alias("files"), F.sum("size").alias("original_bytes"), F.countDistinct("hash").alias("unique_blocks"), F.max("size").alias("largest"))


def archive_flags(s, d):
    return s.range(16).select(F.col("id").alias("flags"), scalar.flag_list(F.col("id")).alias("names"))


def generation_log(s, d):
    return _generations(s, d).groupBy("generation").agg(F.count("*").alias("files"), F.sum("size").alias("total_size"))


def generation_at(s, d):
    return _generations(s, d).filter("generation = 12").select("path", "hash", "size")


def generation_diff(s, d):
    g = _generations(s, d)
    return versions.diff(g.filter("generation = 3"), g.filter("generation = 20"))


def diff_summary(s, d):
    a, b = _versions(s, d)
    return versions.diff(a, b).groupBy("change").agg(F.count("*").alias("n"))


def append_new_blocks(s, d):
    """New and reused blocks of each generation against the one before it only."""
    g = _generations(s, d).select("generation", "path", "hash")
    before = g.select((F.col("generation") + 1).alias("generation"), "hash").distinct().withColumn("known", F.lit(1))
    hashes = g.groupBy("generation", "hash").agg(F.count("*").alias("refs"))
    rows = hashes.join(before, ["generation", "hash"], "left")
    return rows.groupBy("generation").agg(F.sum(F.when(F.col("known").isNull(), 1).otherwise(0)).alias("new_blocks"), F.sum(F.when(F.col("known").isNull(), F.col("refs") - 1).otherwise(F.col("refs"))).alias("reused"))


def incremental_refs(s, d):
    r = versions.incremental_refs(*_runs(s, d))
    return r.withColumn("base_seq", F.coalesce("base_seq", F.lit(-1)))


def incremental_stats(s, d):
    r = incremental_refs(s, d)
    return r.agg(F.count("*").alias("files"), F.count_if("external").alias("reused"), F.countDistinct(F.when(~F.col("external"), F.col("hash"))).alias("new_blocks"), F.sum("size").alias("input_bytes"))


def incremental_new_blocks(s, d):
    return versions.new_blocks(*_runs(s, d))


def merge_winners(s, d):
    return versions.merge_winners(*_versions(s, d))


def merge_conflicts(s, d):
    return versions.merge_conflicts(*_versions(s, d))


def merge_blocks(s, d):
    a, b = _versions(s, d)
    return versions.merge_blocks(versions.merge_winners(a, b), a, b)


def split_points(s, d):
    return volumes.split_points(dedup.unique_blocks(_chunks(s, d)), VOLUME)


def volume_assignment(s, d):
    blocks = dedup.unique_blocks(_chunks(s, d))
    return volumes.assign(blocks, volumes.split_points(blocks, VOLUME)).groupBy("volume_no").agg(F.count("*").alias("blocks"), F.sum("len").alias("bytes"), F.min("offset").alias("first_offset"))


def verify_damage_map(s, d):
    """Files that refer to damaged blocks."""
    bad = _damaged(s, d).filter("corrupted").select("hash", "block_seq")
    return _chunks(s, d).join(bad, "hash").select("seq", "block_seq")


def verify_recoverable(s, d):
    g = _damaged(s, d).groupBy("group_id").agg(F.count_if("corrupted").alias("c"))
    return g.agg(F.sum("c").alias("corrupted"), F.sum(F.when(F.col("c").between(1, PARITY), F.col("c")).otherwise(0)).alias("recoverable"))


def ecc_islands(s, d):
    return ecc.islands(_scan(s, d)).groupBy("group_no").agg(F.count_if(~F.col("is_parity")).alias("data"), F.count_if("is_parity").alias("parity"))


def merkle_root(s, d):
    """Root over all blocks: hex digests joined and hashed."""
    b = dedup.unique_blocks(_chunks(s, d))
    return merkle.merkle_root(b.select(F.col("block_seq").alias("i"), "hash"))


_PATHS = ["/etc/passwd", "../../../etc/passwd", "foo/../../bar", "src/main.rs", "a/b/c/d.txt", "a\\..\\b", "\\x", "..a/b.."]
_SIZES = ["1K", "1M", "1G", "4G", "500", "", "abc", "1.5m", "2k"]
_VERSIONS = [("0.3.0", "0.4.0"), ("0.3.0", "1.0.0"), ("0.3.0", "0.3.1"), ("0.3.0", "0.3.0"), ("0.4.0", "0.3.0"), ("1.x.2", "1.3"), ("1", "1.0")]


def path_safety(s, d):
    p = s.createDataFrame([(x,) for x in _PATHS], "path string")
    return p.select("path", scalar.safe_path(F.col("path")).alias("safe"), scalar.normal_path(F.col("path")).alias("normal"))


def size_parse(s, d):
    return s.createDataFrame([(x,) for x in _SIZES], "text string").select("text", F.coalesce(scalar.parse_size(F.col("text")), F.lit(-1)).alias("bytes"))


def version_compare(s, d):
    return s.createDataFrame(_VERSIONS, "current string, other string").select("current", "other", scalar.version_newer(F.col("current"), F.col("other")).alias("newer"))


def url_versions(s, d):
    """Versions at the end of release addresses made from parts; every fifth has none."""
    parts = F.when(F.col("p_partkey") % 5 == 0, "latest").otherwise(F.format_string("v%d.%d.%d", "p_size", F.col("p_partkey") % 10, F.col("p_partkey") % 3))
    urls = _read(s, d, "part").select("p_partkey", F.concat(F.lit("https://x.example/releases/"), parts).alias("url"))
    return urls.select("p_partkey", scalar.version_from_url(F.col("url")).alias("version"))


_NAMES = ["zstd", "ZSTANDARD", "lz4", "none", "Store", "brotli", ""]
_LINES = ["AB12  tool.tar.gz", "cd34 *tool.zip", "ef56", " 7890\tname with blanks "]
_LINKS = [("a/l", "../b"), ("a/l", "../../b"), ("l", "b/../c"), ("l", "/etc/passwd"), ("a/b/l", "./../../../x"), ("l", "..")]


def codec_names(s, d):
    """Ids of codec names (-1: unknown) and the names of ids."""
    names = s.createDataFrame([(x,) for x in _NAMES], "name string")
    return names.select("name", F.coalesce(scalar.codec_id(F.col("name")), F.lit(-1)).alias("codec"), F.coalesce(scalar.codec_name(scalar.codec_id(F.col("name"))), F.lit("unknown")).alias("canonical"))


def checksum_lines(s, d):
    lines = s.createDataFrame([(x,) for x in _LINES], "line string")
    return lines.select("line", scalar.checksum_line(F.col("line")).alias("c")).select("line", "c.hash", F.coalesce("c.name", F.lit("")).alias("name"))


def checksum_lookup(s, d):
    """The checksum of each page's file in a list of lines "hash  name" or "hash *name"; pages that the list lacks have none."""
    pages = _read(s, d, "pages").select("page_id", F.format_string("page-%d.html", "page_id").alias("name"), F.sha2(F.coalesce("html", F.lit("")), 256).alias("hash"))
    mark = F.when(F.col("page_id") % 2 == 0, "  ").otherwise(" *")
    lines = pages.filter("page_id % 7 <> 3").select(scalar.checksum_line(F.concat(F.upper("hash"), mark, "name")).alias("c")).select("c.name", F.col("c.hash").alias("listed"))
    return pages.join(lines, "name", "left").select("page_id", F.coalesce("listed", F.lit("")).alias("listed"), F.coalesce(F.col("listed") == F.col("hash"), F.lit(False)).alias("agrees"))


def link_escape(s, d):
    """Whether a link stays below the root that it is restored to."""
    return s.createDataFrame(_LINKS, "path string, target string").select("path", "target", link_stays_inside(F.col("path"), F.col("target")).alias("inside"))


def size_format(s, d):
    """Customers' numbers cubed as sizes in binary units."""
    n = F.col("c_custkey") * F.col("c_custkey") * F.col("c_custkey")
    return _read(s, d, "customer").select("c_custkey", scalar.format_size(n).alias("text"))


def volume_names(s, d):
    return _read(s, d, "supplier").select("s_suppkey", scalar.volume_name(F.lit("set"), F.col("s_suppkey"), F.lit(".blk")).alias("name"))


def eta_texts(s, d):
    """Time left after a job's first parts, as text ('' below a tenth)."""
    o = _read(s, d, "orders")
    return o.select("o_orderkey", F.coalesce(scalar.eta_text(F.col("o_orderkey") % 100 + 1, F.lit(100), F.col("o_custkey")), F.lit("")).alias("eta"))


def header_checksum(s, d):
    """The first eight bytes of each text's hash, as a header keeps them."""
    return _read(s, d, "documents").select("doc_id", scalar.short_checksum(F.col("text")).alias("checksum"))


def throughput(s, d):
    """Ratio of distinct to whole bytes, and MB for each second of a given time, by source of the documents."""
    docs = _read(s, d, "documents").select("source", F.sha2("text", 256).alias("hash"), F.octet_length("text").cast("long").alias("len"))
    blocks = docs.groupBy("source", "hash").agg(F.sum("len").alias("bytes"), F.min("len").alias("len"))
    sums = blocks.groupBy("source").agg(F.sum("bytes").alias("input_bytes"), F.sum("len").alias("unique_bytes"))
    return sums.select("source", "input_bytes", "unique_bytes", scalar.ratio(F.col("input_bytes"), F.col("unique_bytes")).alias("ratio"), scalar.megabytes_per_second(F.col("input_bytes"), F.lit(2.0)).alias("mb_per_second"))


def slice_bounds(s, d):
    """Slices of blocks: those that reach past the block's end are told, others are cut."""
    f = _files(s, d).select("seq", "content", F.length("content").alias("n"), (F.col("seq") * 37 % 500).cast("int").alias("start"))
    inside = F.col("start") + 400 <= F.col("n")
    return f.select("seq", inside.alias("inside"), F.when(inside, F.sha2(F.substring(F.col("content"), F.col("start") + 1, F.lit(400)), 256)).otherwise("").alias("hash"))


def block_source(s, d):
    """Where an incremental archive's references lead: to the base, or to its own blocks."""
    return incremental_refs(s, d).groupBy(F.when(F.col("external"), "base").otherwise("own").alias("source")).agg(F.count("*").alias("refs"), F.countDistinct("hash").alias("blocks"))


def repair_counts(s, d):
    """Blocks scanned, damaged, recovered and lost when a group can lose as many as it has parity."""
    g = _damaged(s, d).groupBy("group_id").agg(F.count("*").alias("n"), F.count_if("corrupted").alias("c"))
    good = F.col("c") <= PARITY
    return g.agg(F.sum("n").alias("scanned"), F.sum("c").alias("corrupted"), F.sum(F.when(good, F.col("c")).otherwise(0)).alias("recovered"), F.sum(F.when(good, 0).otherwise(F.col("c"))).alias("lost"))


def verify_files(s, d):
    """Each file that a damaged block touches, once, with how many such blocks it has."""
    bad = _damaged(s, d).filter("corrupted").select("hash")
    return _chunks(s, d).join(bad, "hash").groupBy("seq").agg(F.count("*").alias("bad_blocks"))


def page_formats(s, d):
    """Magic-byte detection over page bytes."""
    return _read(s, d, "pages").groupBy(F.coalesce(scalar.legacy_format(F.encode("html", "UTF-8")), F.lit("none")).alias("format")).agg(F.count("*").alias("n"))


def lineitem_dedup(s, d):
    """Row-hash dedup at volume."""
    li = _read(s, d, "lineitem")
    key = F.sha2(F.concat_ws("|", "l_returnflag", "l_linestatus", F.date_format("l_shipdate", "yyyy-MM-dd"), F.col("l_quantity").cast("int").cast("string")), 256)
    rows = li.select(key.alias("hash"), F.col("l_linenumber").cast("long").alias("len"), F.col("l_orderkey").alias("seq"))
    return rows.groupBy("hash").agg(F.count("*").alias("uses"), F.min("seq").alias("first_seq"), F.sum("len").alias("bytes"))


def content_chunks(s, d):
    return chunk.content_chunks(_files(s, d), 256, 1024, 4096).select("seq", "pos", "hash", "len")


def content_roundtrip(s, d):
    """Content-defined chunks put together again hash to the source's hash."""
    c = chunk.content_chunks(_files(s, d), 256, 1024, 4096).groupBy("seq").agg(chunk.joined(F.collect_list(F.struct("pos", "chunk")), "chunk").alias("content"))
    return _files(s, d).select("seq").join(c, "seq", "left").select("seq", F.sha2(F.coalesce("content", F.lit(b"")), 256).alias("hash"))


#: Each file up to 128 MB is one chunk, so that SQL can tell blocks; the round trip cuts files into many.
WHOLE = Options(least=1 << 27, average=1 << 28, most=1 << 29)


def _archive_files(s, d, edited: bool = False) -> DataFrame:
    """All documents as files; edited: two thirds of them with a line more, and every fifth with another name."""
    f = _files(s, d).select("seq", "path", "content", (F.col("seq") * 1000).alias("mtime_ns"))
    if edited:
        content = F.when(F.col("seq") % 3 != 0, F.concat("content", F.lit("\nv2"))).otherwise(F.col("content"))
        path = F.when(F.col("seq") % 5 == 0, F.concat(F.lit("new/"), "path")).otherwise(F.col("path"))
        f = f.select("seq", path.alias("path"), content.alias("content"), F.expr("mtime_ns + case seq % 4 when 0 then 10 when 1 then -10 else 0 end").alias("mtime_ns"))
    return f.withColumn("content", F.encode("content", "UTF-8"))


def _archive(s, d, options: Options = WHOLE, edited: bool = False) -> Archive:
    return Archive.create(_archive_files(s, d, edited), f"{new_folder(s)}/archive", options)


def _told(archive: Archive, generation: int | None = None) -> DataFrame:
    return archive.extract(generation).select("path", F.sha2("content", 256).alias("hash"), F.octet_length("content").cast("long").alias("size"))


def archive_roundtrip(s, d):
    """Documents written as an archive of many chunks each and read back from it."""
    return _told(_archive(s, d, Options(least=256, average=1024, most=4096)))


def archive_create_stats(s, d):
    return _archive(s, d).stats().drop("stored_bytes", "archive_size")


def archive_info(s, d):
    return _archive(s, d).info().drop("stored_bytes", "ratio")


def archive_list(s, d):
    return _archive(s, d).list(long=True)


def archive_append_log(s, d):
    return _archive(s, d).append(_archive_files(s, d, True)).log()


def archive_append_stats(s, d):
    """New and reused blocks of two generations; the second sees the first one's blocks."""
    return _archive(s, d).append(_archive_files(s, d, True)).stats().select("generation", "input_bytes", "block_count", "new_blocks", "reused_blocks", "dedup_savings")


def archive_time_travel(s, d):
    return _told(_archive(s, d).append(_archive_files(s, d, True)), 0)


def archive_diff(s, d):
    return _archive(s, d).append(_archive_files(s, d, True)).diff(0, 1)


def archive_incremental(s, d):
    """Files read back from an archive that holds only what its base lacks."""
    return _told(_archive(s, d).incremental(_archive_files(s, d, True), f"{new_folder(s)}/incremental"))


def archive_incremental_stats(s, d):
    return _archive(s, d).incremental(_archive_files(s, d, True), f"{new_folder(s)}/incremental").stats().select("files", "input_bytes", "block_count", "new_blocks", "reused_blocks")


def archive_merge(s, d):
    return _told(merge(_archive(s, d), _archive(s, d, edited=True), f"{new_folder(s)}/merged"))


def archive_split_join(s, d):
    """Files read back after the blocks went into volumes and out of them."""
    volumes_at = new_folder(s)
    _archive(s, d).split(volumes_at, VOLUME)
    return _told(join(s, volumes_at, f"{new_folder(s)}/joined"))


def _broken(s, d, modulus: int, parts: tuple[int, ...], options: Options = WHOLE) -> Archive:
    """An archive of all documents in which some blocks have lost their last byte."""
    sound, path = _archive(s, d, options), f"{new_folder(s)}/broken"
    hit = (F.col("block_seq") % modulus).isin(*parts)
    cut = F.when(hit, F.substring(F.col("payload"), F.lit(1), F.octet_length("payload") - 1)).otherwise(F.col("payload"))
    sound.blocks().withColumn("payload", cut).write.parquet(f"{path}/blocks")
    sound._copy(path, "manifest", "parity", "meta")
    return Archive(s, path)


def archive_verify(s, d):
    return _broken(s, d, 13, (0, 1)).verify()


def archive_repair(s, d):
    broken = _broken(s, d, 10, (2, 7))
    return broken.repairs(broken.repair(f"{new_folder(s)}/repaired"))


def archive_repair_partly(s, d):
    """Groups that lost more blocks than they have parity stay damaged."""
    broken = _broken(s, d, 20, (2, 7, 8, 13))
    return broken.repairs(broken.repair(f"{new_folder(s)}/repaired"))


def archive_heal(s, d):
    """Files read from an archive with damaged blocks, which parity restores on the way."""
    return _told(_broken(s, d, 10, (2, 7)))


def archive_encrypted(s, d):
    """Files read from an encrypted archive after its passphrase was changed."""
    return _told(_archive(s, d, Options(passphrase="first", ecc="none")).rekey("first", "second"))


def archive_convert(s, d):
    """Documents as tar files, and these as an archive."""
    tars = new_folder(s)
    write_tars(_archive_files(s, d), tars)
    return _told(convert(s, tars, f"{new_folder(s)}/converted", WHOLE))


def archive_restore(s, d):
    return _archive(s, d).restore(f"{new_folder(s)}/out")


def archive_block_offsets(s, d):
    """Where references point: no two blocks of an archive share a place, and each has room for the one before it."""
    a = _archive(s, d)
    refs = a.manifest().select(F.explode("block_refs").alias("r")).select("r.hash", "r.offset").distinct()
    placed = refs.join(a.blocks().select("hash", "block_seq", "group_id", "compressed_size"), "hash")
    groups = placed.groupBy("group_id").agg(F.min("offset").alias("first"), F.max(F.col("offset") + F.col("compressed_size")).alias("last"), F.sum(F.col("compressed_size") + S.BLOCK_HEADER_SIZE).alias("bytes"), F.count("*").alias("blocks"))
    return groups.select("group_id", "blocks", (F.col("last") - F.col("first") == F.col("bytes") - S.BLOCK_HEADER_SIZE).alias("gapless"))


def records_roundtrip(s, d):
    """An archive's blocks as binary files, scanned and decoded again."""
    folder = new_folder(s)
    write_records(_archive(s, d).blocks(), folder)
    rows = scan_records(s, folder)
    return codec.decompress_blocks(rows.select("hash", "payload", "codec", "uncompressed_size")).select("hash", "intact", F.octet_length("chunk").cast("long").alias("len"))


def codec_roundtrip(s, d):
    c = chunk.fixed_chunks(_files(s, d), CHUNK).groupBy("hash").agg(F.min("chunk").alias("chunk"))
    return codec.decompress_blocks(codec.compress_blocks(c)).select("hash", "intact", F.octet_length("chunk").cast("long").alias("len"))


def parity_repair(s, d):
    """Blocks lost by twos from each group of ten come back from four parity blocks."""
    f = _files(s, d).select("hash", F.encode("content", "UTF-8").alias("payload")).groupBy("hash").agg(F.min("payload").alias("payload"))
    blocks = dedup.unique_blocks(_chunks(s, d)).select("hash", "block_seq", F.floor(F.col("block_seq") / 10).alias("group_id")).join(f, "hash")
    rows = blocks.select("group_id", "block_seq", "payload", F.octet_length("payload").alias("size"), (~(F.col("block_seq") % 10).isin(2, 7)).alias("intact"))
    fixed = ecc.repair_groups(rows, ecc.parity_blocks(blocks, 4))
    return fixed.select("block_seq", "repaired", F.sha2("payload", 256).alias("hash"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    first = list(globals()).index("dedup_block_refs")
    return {k: f for k, f in list(globals().items())[first:] if callable(f) and k[0] != "_" and k not in ("queries", "oracle_sql")}


# ---- SQL ----

_C = "c AS (SELECT doc_id AS seq, sha256(coalesce(text, '')) AS hash, CAST(strlen(coalesce(text, '')) AS BIGINT) AS len FROM documents)"
_B = f"""{_C}, f AS (SELECT hash, min(seq) AS seq, count(*) AS uses FROM c GROUP BY hash),
b AS (SELECT c.seq, c.hash, c.len, uses, row_number() OVER (ORDER BY c.seq) - 1 AS block_seq,
      CAST({S.HEADER_SIZE} + coalesce(sum(c.len + {S.BLOCK_HEADER_SIZE}) OVER (ORDER BY c.seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS "offset" FROM c JOIN f USING (seq, hash))"""
_K = f"""k AS (SELECT doc_id AS seq, CAST(i AS INTEGER) AS pos, substring(coalesce(text, ''), CAST(i * {CHUNK} + 1 AS BIGINT), {CHUNK}) AS chunk
     FROM (SELECT doc_id, text, unnest(range(0, CAST(ceil(length(coalesce(text, '')) / {CHUNK}.0) AS BIGINT))) AS i FROM documents))"""
_V = f"""f AS (SELECT doc_id AS path, sha256(coalesce(text, '')) AS hash, CAST(strlen(coalesce(text, '')) AS BIGINT) AS size, doc_id * 1000 AS mtime FROM documents),
a AS (SELECT * FROM f),
b AS (SELECT path + CASE WHEN path % 3 = 0 THEN {RENAMED} ELSE 0 END AS path, CASE WHEN path % 7 = 0 THEN sha256(hash || 'v2') ELSE hash END AS hash, size, mtime + CASE path % 5 WHEN 0 THEN 10 WHEN 1 THEN -10 ELSE 0 END AS mtime FROM f)"""
_A = """t0 AS (SELECT doc_id, coalesce(text, '') AS text FROM documents),
t1 AS (SELECT doc_id, CASE WHEN doc_id % 3 <> 0 THEN text || chr(10) || 'v2' ELSE text END AS text FROM t0),
a0 AS (SELECT CAST(doc_id AS VARCHAR) AS path, doc_id * 1000 AS mtime, sha256(text) AS hash, CAST(strlen(text) AS BIGINT) AS size FROM t0),
a1 AS (SELECT CASE WHEN doc_id % 5 = 0 THEN 'new/' ELSE '' END || CAST(doc_id AS VARCHAR) AS path, doc_id * 1000 + CASE doc_id % 4 WHEN 0 THEN 10 WHEN 1 THEN -10 ELSE 0 END AS mtime, sha256(text) AS hash, CAST(strlen(text) AS BIGINT) AS size FROM t1),
b0 AS (SELECT sha256(text) AS hash, min(strlen(text)) AS size, row_number() OVER (ORDER BY min(doc_id)) - 1 AS k FROM t0 WHERE text <> '' GROUP BY text)"""
_I = f"""{_C}, x AS (SELECT seq, len, CASE WHEN seq % 3 <> 0 THEN sha256(hash || 'v2') ELSE hash END AS hash FROM c), n AS (SELECT hash, min(seq) AS base_seq FROM c GROUP BY hash)"""
_W = f"""{_V}, w AS (SELECT path, src, mtime, hash, size FROM (SELECT *, row_number() OVER (PARTITION BY path ORDER BY mtime DESC, src) AS k
     FROM (SELECT 'a' AS src, * FROM a UNION ALL SELECT 'b', * FROM b)) WHERE k = 1)"""
_G = """e AS (SELECT user_id AS path, datediff('day', DATE '2024-01-01', CAST(ts AS DATE)) AS day, ts, event_id, sha256(concat_ws('|', event_type, props)) AS hash, CAST(strlen(concat_ws('|', event_type, props)) AS BIGINT) AS size FROM events),
g AS (SELECT generation, path, hash, size FROM (SELECT generation, e.*, row_number() OVER (PARTITION BY generation, path ORDER BY ts DESC, event_id DESC) AS k FROM (SELECT unnest(range((SELECT min(day) FROM e), (SELECT max(day) + 1 FROM e))) AS generation) r JOIN e ON day <= generation) WHERE k = 1)"""
_DEPTH = """p AS (SELECT path, target, list_filter(string_split(regexp_replace(path, '[^/]*$', '') || target, '/'), lambda x: x NOT IN ('', '.')) AS c FROM v),
w AS (SELECT path, target, list_transform(range(1, len(c) + 1), lambda i: list_sum(list_transform(c[1:i], lambda x: CASE WHEN x = '..' THEN -1 ELSE 1 END))) AS d FROM p)"""
_DIFF = "CASE WHEN y.path IS NULL THEN 'removed' WHEN x.path IS NULL THEN 'added' WHEN x.hash = y.hash AND x.size = y.size THEN 'unchanged' ELSE 'modified' END"
_CUTS = f"""o AS (SELECT row_number() OVER (ORDER BY "offset") AS i, "offset" + len + {S.BLOCK_HEADER_SIZE} AS boundary FROM b),
r(i, start, n, cut) AS (SELECT CAST(0 AS BIGINT), CAST(0 AS BIGINT), CAST(0 AS BIGINT), CAST(NULL AS BIGINT) UNION ALL
  SELECT o.i, CASE WHEN boundary - start >= {VOLUME} THEN boundary ELSE start END, n + CASE WHEN boundary - start >= {VOLUME} THEN 1 ELSE 0 END, CASE WHEN boundary - start >= {VOLUME} THEN boundary END
  FROM r JOIN o ON o.i = r.i + 1),
cuts AS (SELECT n AS volume_no, cut FROM r WHERE cut IS NOT NULL)"""
_STATS = "SELECT count(*) AS block_count, count(DISTINCT hash) AS unique_blocks, CAST(sum(len) AS BIGINT) AS input_bytes, CAST((SELECT sum(len) FROM (SELECT hash, min(len) AS len FROM {t} GROUP BY hash)) AS BIGINT) AS unique_bytes, CAST(sum(len) - (SELECT sum(len) FROM (SELECT hash, min(len) AS len FROM {t} GROUP BY hash)) AS BIGINT) AS dedup_savings FROM {t}"


def _values(rows: list, *names: str) -> str:
    quote = lambda x: "'" + x.replace("'", "''") + "'"
    return f"v({', '.join(names)}) AS (VALUES {', '.join('(' + ', '.join(map(quote, r if isinstance(r, tuple) else (r,))) + ')' for r in rows)})"


def oracle_sql() -> dict[str, str]:
    bad = "d AS (SELECT *, block_seq // 10 AS group_id, block_seq % 13 = 0 AS corrupted FROM b)"
    versions_sql = lambda c: f"list_filter(list_transform(string_split({c}, '.'), lambda x: TRY_CAST(x AS BIGINT)), lambda x: x IS NOT NULL)"
    told = "SELECT path, hash, size FROM {}"
    size = r"regexp_extract(text, '^\s*([0-9]+(?:\.[0-9]+)?)\s*[KMGkmg]?\s*$', 1)"
    return {
        "dedup_block_refs": f'WITH {_B} SELECT c.seq, c.hash, c.len, c.seq = b.seq AS is_new, b."offset" FROM c JOIN b USING (hash)',
        "dedup_unique_blocks": f"WITH {_B} SELECT * FROM b",
        "dedup_stats": f"WITH {_C} {_STATS.format(t='c')}",
        "dedup_cap_overflow": f"WITH {_C}, f AS (SELECT hash, row_number() OVER (ORDER BY min(seq)) AS r, count(*) AS uses FROM c GROUP BY hash) SELECT CAST(sum(CASE WHEN r <= {CAP} THEN 1 ELSE uses END) AS BIGINT) AS written, CAST(sum(CASE WHEN r <= {CAP} THEN uses - 1 ELSE 0 END) AS BIGINT) AS hits, CAST(sum(CASE WHEN r <= {CAP} THEN 0 ELSE uses END) AS BIGINT) AS overflow FROM f",
        "block_offsets": f'WITH {_B} SELECT block_seq, hash, "offset" FROM b',
        "ecc_group_plan": f"WITH {_B} SELECT block_seq // 10 AS group_id, count(*) AS shards, max(len) AS shard_size, CAST(sum(len) AS BIGINT) AS data_bytes FROM b GROUP BY 1",
        "ecc_overhead": "WITH v(level, parity) AS (VALUES ('low', 2), ('Medium', 4), ('med', 4), ('high', 6), ('none', 0), ('OFF', 0), ('odd', NULL)) SELECT level, coalesce(parity, -1) AS parity, coalesce(CAST(parity * 10 AS DOUBLE), -1) AS overhead FROM v",
        "fixed_chunks": f"WITH {_K} SELECT seq, pos, sha256(chunk) AS hash, CAST(strlen(chunk) AS BIGINT) AS len FROM k",
        "chunk_dedup_stats": f"WITH {_K}, c AS (SELECT sha256(chunk) AS hash, CAST(strlen(chunk) AS BIGINT) AS len FROM k) {_STATS.format(t='c')}",
        "manifest_refs": f"WITH {_K} SELECT doc_id AS seq, count(k.seq) AS n_refs, sha256(coalesce(string_agg(sha256(chunk), '' ORDER BY pos), '')) AS fingerprint FROM documents LEFT JOIN k ON k.seq = doc_id GROUP BY doc_id",
        "extract_roundtrip": f"WITH {_C} SELECT seq, hash, len AS size FROM c",
        "cat_one": "SELECT doc_id AS seq, coalesce(text, '') AS content FROM documents WHERE doc_id = 7",
        "list_short": "SELECT CAST(doc_id AS VARCHAR) AS path FROM documents",
        "list_long": "SELECT o_orderkey AS path, CASE WHEN o_orderkey % 7 = 0 THEN 'd' WHEN o_orderkey % 11 = 0 THEN 'l' ELSE '-' END AS type, printf('%o', o_orderkey % 4096) AS mode FROM orders",
        "file_totals": f"WITH {_C} SELECT count(*) AS files, CAST(sum(len) AS BIGINT) AS original_bytes, count(DISTINCT hash) AS unique_blocks, max(len) AS largest FROM c",
        "archive_flags": "SELECT range AS flags, CASE WHEN range = 0 THEN 'none' ELSE concat_ws(', ', CASE WHEN range & 1 <> 0 THEN 'encrypted' END, CASE WHEN range & 2 <> 0 THEN 'erasure-coded' END, CASE WHEN range & 4 <> 0 THEN 'append-only' END, CASE WHEN range & 8 <> 0 THEN 'incremental' END) END AS names FROM range(16)",
        "generation_log": f"WITH {_G} SELECT generation, count(*) AS files, CAST(sum(size) AS BIGINT) AS total_size FROM g GROUP BY 1",
        "generation_at": f"WITH {_G} SELECT path, hash, size FROM g WHERE generation = 12",
        "generation_diff": f"WITH {_G}, x AS (SELECT * FROM g WHERE generation = 3), y AS (SELECT * FROM g WHERE generation = 20) SELECT coalesce(x.path, y.path) AS path, {_DIFF} AS change FROM x FULL JOIN y ON x.path = y.path",
        "diff_summary": f"WITH {_V} SELECT {_DIFF} AS change, count(*) AS n FROM a x FULL JOIN b y ON x.path = y.path GROUP BY 1",
        "append_new_blocks": f"WITH {_G}, h AS (SELECT generation, hash, count(*) AS refs FROM g GROUP BY ALL) SELECT h.generation, CAST(sum(CASE WHEN p.hash IS NULL THEN 1 ELSE 0 END) AS BIGINT) AS new_blocks, CAST(sum(CASE WHEN p.hash IS NULL THEN h.refs - 1 ELSE h.refs END) AS BIGINT) AS reused FROM h LEFT JOIN h p ON p.generation + 1 = h.generation AND p.hash = h.hash GROUP BY 1",
        "incremental_refs": f"WITH {_I} SELECT x.seq, x.hash, x.len AS size, coalesce(base_seq, -1) AS base_seq, base_seq IS NOT NULL AS external FROM x LEFT JOIN n USING (hash)",
        "incremental_stats": f"WITH {_I} SELECT count(*) AS files, count(base_seq) AS reused, count(DISTINCT CASE WHEN base_seq IS NULL THEN hash END) AS new_blocks, CAST(sum(len) AS BIGINT) AS input_bytes FROM x LEFT JOIN n USING (hash)",
        "incremental_new_blocks": f"WITH {_I} SELECT hash, min(seq) AS seq FROM x WHERE hash NOT IN (SELECT hash FROM n) GROUP BY hash",
        "merge_winners": f"WITH {_W} SELECT * FROM w",
        "merge_conflicts": f"WITH {_V} SELECT count(*) AS overlaps, count(*) FILTER (b.mtime >= a.mtime) AS conflicts FROM a JOIN b USING (path)",
        "merge_blocks": f"WITH {_W} SELECT hash, min(src) AS src FROM (SELECT hash, 'a' AS src FROM a UNION ALL SELECT hash, 'b' FROM b) WHERE hash IN (SELECT hash FROM w) GROUP BY hash",
        "split_points": f"WITH RECURSIVE {_B}, {_CUTS} SELECT * FROM cuts",
        "volume_assignment": f'WITH RECURSIVE {_B}, {_CUTS} SELECT 1 + (SELECT count(*) FROM cuts WHERE cut <= b."offset") AS volume_no, count(*) AS blocks, CAST(sum(len) AS BIGINT) AS bytes, min("offset") AS first_offset FROM b GROUP BY 1',
        "verify_damage_map": f"WITH {_B}, {bad} SELECT c.seq, d.block_seq FROM c JOIN d USING (hash) WHERE corrupted",
        "verify_recoverable": f"WITH {_B}, {bad}, g AS (SELECT group_id, count(*) FILTER (corrupted) AS c FROM d GROUP BY 1) SELECT CAST(sum(c) AS BIGINT) AS corrupted, CAST(sum(CASE WHEN c BETWEEN 1 AND {PARITY} THEN c ELSE 0 END) AS BIGINT) AS recoverable FROM g",
        "ecc_islands": f"WITH {_B} SELECT block_seq // 10 AS group_no, count(*) AS data, CASE WHEN count(*) = 10 THEN 2 ELSE 0 END::BIGINT AS parity FROM b GROUP BY 1",
        "merkle_root": f"""WITH RECURSIVE {_B}, l(n, h) AS (SELECT count(*), list(hash ORDER BY block_seq) FROM b UNION ALL
            SELECT (n + 1) // 2, list_transform(range(1, (n + 1) // 2 + 1), lambda i: CASE WHEN 2 * i <= n THEN sha256(h[2 * i - 1] || h[2 * i]) ELSE h[2 * i - 1] END) FROM l WHERE n > 1)
            SELECT h[1] AS root FROM l WHERE n = 1""",
        "path_safety": f"WITH {_values(_PATHS, 'path')} SELECT path, NOT (regexp_matches(path, '^[/\\\\]') OR list_contains(string_split_regex(path, '[/\\\\]'), '..')) AS safe, regexp_replace(replace(path, '\\', '/'), '^/+', '') AS normal FROM v",
        "size_parse": f"WITH {_values(_SIZES, 'text')} SELECT text, coalesce(CAST(floor(TRY_CAST({size} AS DOUBLE) * CASE upper(regexp_extract(text, '([KMGkmg])\\s*$', 1)) WHEN 'K' THEN 1024 WHEN 'M' THEN 1048576 WHEN 'G' THEN 1073741824 ELSE 1 END) AS BIGINT), -1) AS bytes FROM v",
        "version_compare": f'WITH {_values(_VERSIONS, "current", "other")} SELECT "current", other, {versions_sql("other")} > {versions_sql(chr(34) + "current" + chr(34))} AS newer FROM v'.replace("v(current", 'v("current"'),
        "url_versions": "SELECT p_partkey, CASE WHEN p_partkey % 5 <> 0 THEN printf('%d.%d.%d', p_size, p_partkey % 10, p_partkey % 3) END AS version FROM part",
        "page_formats": "SELECT CASE WHEN strlen(html) < 4 THEN 'none' WHEN substr(html, 258, 5) = 'ustar' THEN 'tar' ELSE 'none' END AS format, count(*) AS n FROM pages GROUP BY 1",
        "lineitem_dedup": "SELECT sha256(concat_ws('|', l_returnflag, l_linestatus, strftime(l_shipdate, '%Y-%m-%d'), CAST(CAST(l_quantity AS INTEGER) AS VARCHAR))) AS hash, count(*) AS uses, min(l_orderkey) AS first_seq, CAST(sum(l_linenumber) AS BIGINT) AS bytes FROM lineitem GROUP BY 1",
        "codec_names": f"WITH {_values(_NAMES, 'name')}, i AS (SELECT name, CASE WHEN lower(name) IN ('none', 'store') THEN 0 WHEN lower(name) IN ('zstd', 'zstandard') THEN 1 WHEN lower(name) = 'lz4' THEN 2 ELSE -1 END AS codec FROM v) SELECT name, codec, CASE codec WHEN 0 THEN 'none' WHEN 1 THEN 'zstd' WHEN 2 THEN 'lz4' ELSE 'unknown' END AS canonical FROM i",
        "checksum_lines": f"WITH {_values(_LINES, 'line')} SELECT line, lower(regexp_extract(trim(line), '^[^\\s]+')) AS hash, regexp_extract(trim(line), '^[^\\s]+\\s+[*]?(.*)$', 1) AS name FROM v",
        "link_escape": f"WITH {_values(_LINKS, 'path', 'target')}, {_DEPTH} SELECT path, target, target NOT LIKE '/%' AND list_min(d) >= 0 AS inside FROM w",
        "size_format": "WITH n AS (SELECT c_custkey, c_custkey * c_custkey * c_custkey AS n FROM customer) SELECT c_custkey, CASE WHEN n >= 1099511627776 THEN printf('%.2f TiB', n / 1099511627776.0) WHEN n >= 1073741824 THEN printf('%.2f GiB', n / 1073741824.0) WHEN n >= 1048576 THEN printf('%.2f MiB', n / 1048576.0) WHEN n >= 1024 THEN printf('%.2f KiB', n / 1024.0) ELSE printf('%d B', n) END AS text FROM n",
        "volume_names": "SELECT s_suppkey, printf('set.%03d.blk', s_suppkey) AS name FROM supplier",
        "eta_texts": "WITH t AS (SELECT o_orderkey, o_orderkey % 100 + 1 AS k, o_custkey AS s FROM orders), l AS (SELECT o_orderkey, k, CAST(floor(s * (100 - k) / k) AS BIGINT) AS x FROM t) SELECT o_orderkey, CASE WHEN k < 10 THEN '' WHEN x < 60 THEN printf('ETA %ds', x) WHEN x < 3600 THEN printf('ETA ~%dm', x // 60) ELSE printf('ETA ~%dh%02dm', x // 3600, x % 3600 // 60) END AS eta FROM l",
        "header_checksum": "SELECT doc_id, substr(sha256(text), 1, 16) AS checksum FROM documents",
        "throughput": "WITH h AS (SELECT source, sum(strlen(text)) AS b, min(strlen(text)) AS l FROM documents GROUP BY source, sha256(text)) SELECT source, CAST(sum(b) AS BIGINT) AS input_bytes, CAST(sum(l) AS BIGINT) AS unique_bytes, CAST(sum(b) AS DOUBLE) / CAST(sum(l) AS DOUBLE) AS ratio, CAST(sum(b) AS DOUBLE) / 1048576.0 / 2.0 AS mb_per_second FROM h GROUP BY source",
        "slice_bounds": "WITH f AS (SELECT doc_id AS seq, coalesce(text, '') AS text, doc_id * 37 % 500 AS st, doc_id * 37 % 500 + 400 <= length(coalesce(text, '')) AS inside FROM documents) SELECT seq, inside, CASE WHEN inside THEN sha256(substring(text, st + 1, 400)) ELSE '' END AS hash FROM f",
        "block_source": f"WITH {_I} SELECT CASE WHEN base_seq IS NULL THEN 'own' ELSE 'base' END AS source, count(*) AS refs, count(DISTINCT hash) AS blocks FROM x LEFT JOIN n USING (hash) GROUP BY 1",
        "repair_counts": f"WITH {_B}, {bad}, g AS (SELECT group_id, count(*) AS n, count(*) FILTER (corrupted) AS c FROM d GROUP BY 1) SELECT CAST(sum(n) AS BIGINT) AS scanned, CAST(sum(c) AS BIGINT) AS corrupted, CAST(sum(CASE WHEN c <= {PARITY} THEN c ELSE 0 END) AS BIGINT) AS recovered, CAST(sum(CASE WHEN c > {PARITY} THEN c ELSE 0 END) AS BIGINT) AS lost FROM g",
        "verify_files": f"WITH {_B}, {bad} SELECT c.seq, count(*) AS bad_blocks FROM c JOIN d USING (hash) WHERE corrupted GROUP BY 1",
        "archive_roundtrip": f"WITH {_A} {told.format('a0')}",
        "archive_create_stats": f"WITH {_A} SELECT CAST(0 AS BIGINT) AS generation, count(*) AS files, CAST(0 AS BIGINT) AS dirs, CAST(sum(size) AS BIGINT) AS input_bytes, count(*) FILTER (size > 0) AS block_count, (SELECT count(*) FROM b0) AS new_blocks, count(*) FILTER (size > 0) - (SELECT count(*) FROM b0) AS reused_blocks, CAST(sum(size) - (SELECT sum(size) FROM b0) AS BIGINT) AS dedup_savings, (SELECT {PARITY} * count(DISTINCT k // 10) FROM b0) AS parity_blocks FROM a0",
        "archive_info": f"WITH {_A} SELECT count(*) AS files, CAST(0 AS BIGINT) AS dirs, CAST(sum(size) AS BIGINT) AS original_bytes, count(*) FILTER (size > 0) AS block_count, (SELECT count(*) FROM b0) AS unique_blocks, 'erasure-coded' AS flags, 1 AS generations, 'low' AS ecc FROM a0",
        "archive_list": f"WITH {_A} SELECT '-' AS type, '644' AS mode, size, path FROM a0",
        "archive_append_log": f"WITH {_A} SELECT g AS generation, count(*) AS files, CAST(0 AS BIGINT) AS dirs, CAST(sum(size) AS BIGINT) AS total_size FROM (SELECT CAST(0 AS BIGINT) AS g, size FROM a0 UNION ALL SELECT 1, size FROM a1) GROUP BY g",
        "archive_append_stats": f"""WITH {_A}, r AS (SELECT CAST(0 AS BIGINT) AS generation, hash, size, false AS known FROM a0 UNION ALL SELECT 1, hash, size, hash IN (SELECT hash FROM b0) FROM a1),
            n AS (SELECT generation, hash, size FROM r WHERE size > 0 AND NOT known GROUP BY ALL)
            SELECT r.generation, CAST(sum(size) AS BIGINT) AS input_bytes, count(*) FILTER (size > 0) AS block_count, (SELECT count(*) FROM n WHERE n.generation = r.generation) AS new_blocks,
            count(*) FILTER (size > 0) - (SELECT count(*) FROM n WHERE n.generation = r.generation) AS reused_blocks, CAST(sum(size) - (SELECT sum(size) FROM n WHERE n.generation = r.generation) AS BIGINT) AS dedup_savings FROM r GROUP BY r.generation""",
        "archive_time_travel": f"WITH {_A} {told.format('a0')}",
        "archive_diff": f"WITH {_A}, x AS (SELECT path, hash, size FROM a0), y AS (SELECT path, hash, size FROM a1) SELECT coalesce(x.path, y.path) AS path, {_DIFF} AS change FROM x FULL JOIN y ON x.path = y.path",
        "archive_incremental": f"WITH {_A} {told.format('a1')}",
        "archive_incremental_stats": f"WITH {_A} SELECT count(*) AS files, CAST(sum(size) AS BIGINT) AS input_bytes, count(*) FILTER (size > 0) AS block_count, count(DISTINCT hash) FILTER (size > 0 AND hash NOT IN (SELECT hash FROM b0)) AS new_blocks, count(*) FILTER (size > 0 AND hash IN (SELECT hash FROM b0)) AS reused_blocks FROM a1",
        "archive_merge": f"WITH {_A}, w AS (SELECT path, hash, size, row_number() OVER (PARTITION BY path ORDER BY mtime DESC, src) AS k FROM (SELECT 0 AS src, * FROM a0 UNION ALL SELECT 1, * FROM a1)) SELECT path, hash, size FROM w WHERE k = 1",
        "archive_split_join": f"WITH {_A} {told.format('a0')}",
        "archive_verify": f"WITH {_A}, x AS (SELECT *, k % 13 IN (0, 1) AS bad FROM b0), g AS (SELECT count(*) FILTER (bad) AS c FROM x GROUP BY k // 10) SELECT (SELECT count(*) FROM x) AS blocks, (SELECT count(*) FROM x WHERE NOT bad) AS ok, (SELECT count(*) FROM x WHERE bad) AS corrupted, CAST(0 AS BIGINT) AS missing, CAST((SELECT sum(c) FROM g WHERE c <= {PARITY}) AS BIGINT) AS recoverable, (SELECT count(*) FROM a0 WHERE hash IN (SELECT hash FROM x WHERE bad)) AS affected_files, true AS manifest_ok, true AS root_ok",
        "archive_repair": f"WITH {_A}, x AS (SELECT k % 10 IN (2, 7) AS bad FROM b0) SELECT count(*) AS scanned, count(*) FILTER (bad) AS corrupted, count(*) FILTER (bad) AS recovered, CAST(0 AS BIGINT) AS unrecoverable FROM x",
        "archive_repair_partly": f"WITH {_A}, x AS (SELECT k, k % 20 IN (2, 7, 8, 13) AS bad FROM b0), g AS (SELECT count(*) AS n, count(*) FILTER (bad) AS c FROM x GROUP BY k // 10) SELECT CAST(sum(n) AS BIGINT) AS scanned, CAST(sum(c) AS BIGINT) AS corrupted, CAST(sum(CASE WHEN c <= {PARITY} THEN c ELSE 0 END) AS BIGINT) AS recovered, CAST(sum(CASE WHEN c > {PARITY} THEN c ELSE 0 END) AS BIGINT) AS unrecoverable FROM g",
        "archive_heal": f"WITH {_A} {told.format('a0')}",
        "archive_encrypted": f"WITH {_A} {told.format('a0')}",
        "archive_convert": f"WITH {_A} {told.format('a0')}",
        "records_roundtrip": f"WITH {_A} SELECT hash, true AS intact, CAST(size AS BIGINT) AS len FROM b0",
        "checksum_lookup": "SELECT page_id, CASE WHEN page_id % 7 <> 3 THEN sha256(coalesce(html, '')) ELSE '' END AS listed, page_id % 7 <> 3 AS agrees FROM pages",
        "archive_restore": "SELECT 'file' AS kind, count(*) AS n FROM documents",
        "archive_block_offsets": f"WITH {_A} SELECT k // 10 AS group_id, count(*) AS blocks, true AS gapless FROM b0 GROUP BY 1",
        "content_roundtrip": f"WITH {_C} SELECT seq, hash FROM c",
        "codec_roundtrip": f"WITH {_K} SELECT DISTINCT sha256(chunk) AS hash, true AS intact, CAST(strlen(chunk) AS BIGINT) AS len FROM k",
        "parity_repair": f"WITH {_B} SELECT block_seq, true AS repaired, hash FROM b WHERE block_seq % 10 IN (2, 7)",
    }
