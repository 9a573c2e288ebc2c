"""Archives as directories of Parquet tables: blocks, manifest (by generation, and a copy), parity; and small ones of JSON: meta, and stats with roots."""

from __future__ import annotations

import hashlib
import json
from dataclasses import asdict, dataclass

from py4j.protocol import Py4JJavaError
from pyspark.errors import PySparkException
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from blockloom import schema as S
from blockloom.functions import scalar
from blockloom.operators import chunk, codec, dedup, ecc, merkle, versions, volumes
from blockloom.scratch import delete, discard, small_batches, store
from blockloom.sources.files import read_tars
from blockloom.sources.restore import write_entries

BLOCK_COLUMNS = [c.split()[0] for c in S.BLOCKS.split(", ")]
_META = "options string, salt string, wrapped string, generation long, version long, flags int, base string"
_STATS = "generation long, files long, dirs long, input_bytes long, block_count long, new_blocks long, reused_blocks long, dedup_savings long, stored_bytes long, parity_blocks long, archive_size long, header string, manifest string, root string"


@dataclass(frozen=True)
class Options:
    codec: str = "zstd"
    level: int = 9
    ecc: str = "low"
    least: int = 64 << 10
    average: int = 256 << 10
    most: int = 1 << 20
    passphrase: str | None = None

    @property
    def parity(self) -> int:
        return S.ECC_PARITY.get(self.ecc.lower(), 0)


def _with_defaults(files: DataFrame) -> DataFrame:
    """files(seq, path, content) with kind, target, mode, mtime_ns, uid and gid where absent."""
    defaults = {"kind": F.lit("file"), "target": F.lit(None).cast("string"), "mode": F.lit(0o644), "mtime_ns": F.lit(0).cast("long"), "uid": F.lit(0).cast("long"), "gid": F.lit(0).cast("long")}
    return files.withColumns({k: v for k, v in defaults.items() if k not in files.columns})


class Archive:
    """One archive. Tables are immutable files; the meta row of a generation is written last and so commits it."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path
        meta = spark.read.schema(_META).json(f"{path}/meta").orderBy(F.col("generation").desc(), F.col("version").desc()).first()
        self.options, self.salt, self.base = Options(**{k: v for k, v in json.loads(meta["options"]).items() if k != "passphrase"}), bytes.fromhex(meta["salt"]), meta["base"]
        self.flags, self.generation, self.version, self.wrapped, self.key = meta["flags"], meta["generation"], meta["version"], bytes.fromhex(meta["wrapped"]), None
        self.index: str | None = None

    # ---- write ----

    @classmethod
    def create(cls, files: DataFrame, path: str, options: Options | None = None) -> Archive:
        """files: seq, path, content, and kind, target, mode, mtime_ns, uid, gid where known. Null content is empty."""
        options = options or Options()
        spark, salt, key, wrapped = files.sparkSession, codec.new_salt(), None, b""
        if options.passphrase:
            key = codec.new_key()
            wrapped = codec.wrap(spark, key, codec.derive_key(options.passphrase, salt))
        flags = (S.ENCRYPTED if key else 0) | (S.ERASURE_CODED if options.parity else 0)
        _write(files, path, options, key, 0, None, flags)
        _meta(spark, path, options, salt, wrapped, 0, 0, flags, "")
        return cls(spark, path).unlock(options.passphrase)

    def append(self, files: DataFrame) -> Archive:
        """A new generation: blocks of the one before it are referred to, others are written."""
        if self.flags & S.ENCRYPTED:
            raise ValueError("an encrypted archive cannot be appended to")
        last = store(self.manifest().select(F.explode("block_refs").alias("r")).select("r.hash", "r.offset").groupBy("hash").agg(F.min("offset").alias("offset")), "known")
        _write(files, self.path, self.options, None, self.generation + 1, last, self.flags | S.APPEND_ONLY)
        discard(last)
        _meta(self.spark, self.path, self.options, self.salt, b"", self.generation + 1, 0, self.flags | S.APPEND_ONLY, self.base)
        return Archive(self.spark, self.path)

    def incremental(self, files: DataFrame, path: str) -> Archive:
        """An archive at path that holds only blocks that this one lacks; references to the rest are external."""
        if self.flags & S.ENCRYPTED:
            raise ValueError("an encrypted archive cannot be a base")
        known = store(_offsets(self.blocks(), self.options.parity).groupBy("hash").agg(F.min("offset").alias("offset")), "known")
        flags = (self.flags & S.ERASURE_CODED) | S.INCREMENTAL
        _write(files, path, self.options, None, 0, known, flags, external=True)
        discard(known)
        _meta(self.spark, path, self.options, self.salt, b"", 0, 0, flags, self.path)
        return Archive(self.spark, path)

    def unlock(self, passphrase: str | None) -> Archive:
        """The content key is kept under the passphrase's key. A wrong passphrase raises."""
        if passphrase:
            self.key = codec.unwrap(self.spark, self.wrapped, codec.derive_key(passphrase, self.salt))
            if self.key is None:
                raise ValueError("wrong passphrase")
        return self

    def rekey(self, old: str, new: str) -> Archive:
        """Another passphrase for the same content key: no block is written again."""
        salt = codec.new_salt()
        wrapped = codec.wrap(self.spark, self.unlock(old).key, codec.derive_key(new, salt))
        _meta(self.spark, self.path, self.options, salt, wrapped, self.generation, self.version + 1, self.flags, self.base)
        return Archive(self.spark, self.path).unlock(new)

    # ---- read ----

    def entries(self) -> DataFrame:
        """All generations' entries, from the manifest or, where that can't be read, from its copy."""
        if self.index is None:
            self.index = "manifest" if self._readable("manifest") else "manifest_copy"
        return self.spark.read.schema(S.MANIFEST).parquet(f"{self.path}/{self.index}").filter(F.col("generation") <= self.generation)

    def _readable(self, name: str) -> bool:
        """Whether all footers and columns of a table can be read, by hashing what its rows say; rows are few beside blocks."""
        try:
            rows = self.spark.read.schema(S.MANIFEST).parquet(f"{self.path}/{name}")
            return rows.agg(F.bit_xor(F.xxhash64(*rows.columns))).first() is not None
        except (Py4JJavaError, PySparkException):
            return False

    def manifest(self, generation: int | None = None) -> DataFrame:
        wanted = self.generation if generation is None else generation
        if not 0 <= wanted <= self.generation:
            raise ValueError(f"generation {wanted} not found (0 to {self.generation})")
        return self.entries().filter(F.col("generation") == wanted)

    def blocks(self) -> DataFrame:
        return self.spark.read.schema(S.BLOCKS).parquet(f"{self.path}/blocks")

    def parity(self) -> DataFrame:
        return self.spark.read.schema(S.PARITY).parquet(f"{self.path}/parity")

    def _sound(self) -> DataFrame:
        """Stored blocks; those whose payload fails its checksum as parity restores them, or not at all."""
        own = self.blocks()
        if not self.options.parity:
            return own
        whole = F.coalesce(F.crc32("payload") == F.col("checksum"), F.lit(False))
        bad = store(own.filter(~whole).select("group_id").distinct(), "damaged")
        if bad.isEmpty():
            discard(bad)
            return own
        keep = tuple(c for c in BLOCK_COLUMNS if c not in ("block_seq", "payload", "group_id"))
        rows = own.select("group_id", "block_seq", "payload", F.col("compressed_size").alias("size"), whole.alias("intact"), *keep)
        fixed = ecc.repair_groups(rows, self.parity(), bad, keep).filter("repaired").withColumn("group_id", F.floor(F.col("block_seq") / S.ECC_DATA))
        return own.filter(whole).unionByName(fixed.select(*BLOCK_COLUMNS).filter(F.crc32("payload") == F.col("checksum")))

    def _plain(self) -> DataFrame:
        """Blocks as stored, decrypted, with those of the base."""
        own = self._sound()
        if self.flags & S.ENCRYPTED:
            if self.key is None:
                raise ValueError("this archive needs a passphrase")
            own = own.withColumn("payload", codec.decrypt(F.col("payload"), self.key))
        return own.unionByName(Archive(self.spark, self.base)._plain()) if self.base else own

    def extract(self, generation: int | None = None, path: str | None = None) -> DataFrame:
        """path, content of all files, or of the first one with a path. Damaged blocks are repaired from parity; what can't be repaired raises."""
        files = self.manifest(generation).filter("kind = 'file'").select("seq", "path", "block_refs")
        if path is not None:
            files = files.filter(scalar.normal_path(F.col("path")) == scalar.normal_path(F.lit(path))).orderBy("seq").limit(1)
        return self._contents(files).select("path", "content")

    def _contents(self, files: DataFrame) -> DataFrame:
        """files(seq, path, block_refs, ...) with content in place of block_refs.

        Blocks move as they are stored: to the files that refer to them, and again to where files of more than one piece are put together.
        """
        small_batches(self.spark)
        kept = [c for c in files.columns if c != "block_refs"]
        refs = files.select(*kept, F.size("block_refs").alias("pieces"), F.posexplode("block_refs").alias("pos", "ref")).select(*kept, "pieces", "pos", "ref.hash", "ref.slice_start", "ref.slice_len")
        wanted = self._plain().select("hash", "payload", "codec", "uncompressed_size").join(refs.select("hash").distinct(), "hash", "left_semi").dropDuplicates(["hash"])
        rows = refs.join(wanted, "hash", "left")
        none = files.filter(F.size("block_refs") < 1).select(*kept, *[F.lit(None).cast(k).alias(c) for c, k in rows.dtypes if c not in kept])
        many = rows.filter("pieces > 1").repartition("seq").sortWithinPartitions("seq", "path", "pos")
        return codec.assemble(rows.filter("pieces = 1").unionByName(none), kept).unionByName(codec.assemble(many, kept))

    def restore(self, folder: str, generation: int | None = None) -> DataFrame:
        """Write all entries below a folder that every executor sees; kind and count of what was written."""
        entries = self.manifest(generation)
        rows = entries.filter("kind = 'file'").groupBy("path").agg(F.min(F.struct("seq", "mode", "mtime_ns", "block_refs")).alias("w"))
        return write_entries(entries, self._contents(rows.select("path", "w.*")), folder)

    def cat(self, path: str) -> bytes:
        row = self.extract(path=path).first()
        if row is None:
            raise FileNotFoundError(path)
        return bytes(row["content"])

    def list(self, long: bool = False) -> DataFrame:
        m = self.manifest().orderBy("seq")
        return m.select(scalar.type_char(F.col("kind")).alias("type"), scalar.octal_mode(F.col("mode")).alias("mode"), "size", "path") if long else m.select("path")

    def info(self) -> DataFrame:
        sizes = self.blocks().agg(F.count("*").alias("unique_blocks"), F.coalesce(F.sum("compressed_size"), F.lit(0)).alias("stored_bytes"))
        m = self.manifest().agg(F.count_if(F.col("kind") != "dir").alias("files"), F.count_if(F.col("kind") == "dir").alias("dirs"), F.coalesce(F.sum(F.when(F.col("kind") == "file", F.col("size"))), F.lit(0)).alias("original_bytes"), F.coalesce(F.sum(F.size("block_refs")), F.lit(0)).cast("long").alias("block_count"))
        ratio = F.when(F.col("stored_bytes") > 0, F.col("original_bytes") / F.col("stored_bytes"))
        more = {"ratio": ratio, "flags": scalar.flag_list(F.lit(self.flags)), "generations": F.lit(self.generation + 1), "ecc": F.lit(self.options.ecc if self.options.parity else "none")}
        return m.crossJoin(F.broadcast(sizes)).withColumns(more)  # one row each

    def log(self) -> DataFrame:
        m = self.entries()
        return m.groupBy("generation").agg(F.count_if(F.col("kind") != "dir").alias("files"), F.count_if(F.col("kind") == "dir").alias("dirs"), F.sum(F.when(F.col("kind") == "file", F.col("size")).otherwise(0)).alias("total_size")).orderBy("generation")

    def stats(self) -> DataFrame:
        """What each generation's write did: files, input, blocks new and reused, savings, stored bytes, parity, size of the archive."""
        return self._stats().filter(F.col("generation") <= self.generation).drop("header", "manifest", "root").orderBy("generation")

    def _stats(self) -> DataFrame:
        return self.spark.read.schema(_STATS).json(f"{self.path}/stats")

    def _prints(self, generation: int | None) -> DataFrame:
        fingerprint = F.sha2(F.array_join(F.transform("block_refs", lambda r: r["hash"]), ""), 256)
        return self.manifest(generation).filter("kind = 'file'").select("path", fingerprint.alias("hash"), "size")

    def diff(self, old: int, new: int) -> DataFrame:
        return versions.diff(self._prints(old), self._prints(new)).orderBy(*versions.diff_order())

    # ---- care ----

    def damage(self) -> DataFrame:
        """hash, block_seq, group_id, intact of every stored block."""
        source = self.blocks()
        if self.flags & S.ENCRYPTED:
            if self.key is None:
                raise ValueError("this archive needs a passphrase")
            source = source.withColumn("payload", codec.decrypt(F.col("payload"), self.key))
        return codec.decompress_blocks(source).select("hash", "block_seq", "group_id", F.coalesce("intact", F.lit(False)).alias("intact"))

    def missing(self) -> DataFrame:
        """hash, offset of blocks that any generation refers to and that neither this archive nor its base holds."""
        refs = self.entries().select(F.explode("block_refs").alias("r")).groupBy("r.hash").agg(F.min("r.offset").alias("offset"))
        held = self.blocks().select("hash")
        at = self
        while at.base:
            at = Archive(self.spark, at.base)
            held = held.union(at.blocks().select("hash"))
        return refs.join(held, "hash", "left_anti")

    def verify(self) -> DataFrame:
        """One row: blocks, ok, corrupted, missing, recoverable, affected_files, manifest_ok, root_ok.

        affected_files counts the last generation's files that refer to a corrupted or missing block; the root covers
        the header, all block hashes in order and the manifest, so a block that was put in, taken out or moved is seen.
        """
        damage = store(self.damage(), "damage")
        lost = store(self.missing(), "missing")
        bad = damage.filter("NOT intact")
        parity = self.parity().groupBy("group_id").agg(F.count_if(F.sha2("payload", 256) == F.col("hash")).alias("k")) if self.options.parity else None
        gone = bad.select("hash").union(lost.select("hash"))
        hit = self.manifest().select("path", F.explode("block_refs").alias("r")).select("path", "r.hash").join(gone, "hash", "left_semi").agg(F.countDistinct("path").alias("affected_files"))
        groups = bad.groupBy("group_id").agg(F.count("*").alias("c"))
        groups = groups.join(parity, "group_id", "left") if parity is not None else groups.withColumn("k", F.lit(0))
        recoverable = groups.agg(F.coalesce(F.sum(F.when(F.col("c") <= F.col("k"), F.col("c"))), F.lit(0)).alias("recoverable"))
        counts = damage.agg(F.count("*").alias("blocks"), F.count_if("intact").alias("ok"), F.count_if(~F.col("intact")).alias("corrupted"))
        want = self._stats().filter(F.col("generation") == self.generation).first()
        header, manifest, root = self.roots()
        checks = {"manifest_ok": F.lit(manifest == want["manifest"]), "root_ok": F.lit((header, root) == (want["header"], want["root"]))}
        return counts.crossJoin(lost.agg(F.count("*").alias("missing"))).crossJoin(recoverable).crossJoin(hit).withColumns(checks)  # one row each

    def roots(self) -> tuple[str, str, str]:
        """Digests of the header, of all entries, and the root over header, blocks in order of writing, and entries."""
        return _roots(self.spark, self.path, self.entries(), self.flags)

    def repair(self, path: str) -> Archive:
        """A new archive at path in which every recoverable block is sound; others stay as they are. What it did: repairs()."""
        if self.options.parity:
            bad = store(self.damage().filter("NOT intact").select("block_seq", "group_id"), "bad")
            groups = store(bad.select("group_id").distinct(), "groups")
            rows = dedup.marked(self.blocks().withColumn("_row", F.col("block_seq")), bad.select(F.col("block_seq").alias("_row")), "bad")
            keep = tuple(c for c in BLOCK_COLUMNS if c not in ("block_seq", "payload", "group_id"))
            some = rows.select("group_id", "block_seq", "payload", F.col("compressed_size").alias("size"), (~F.col("bad")).alias("intact"), *keep)
            fixed = ecc.repair_groups(some, self.parity(), groups, keep, as_is=True).withColumn("group_id", F.floor(F.col("block_seq") / S.ECC_DATA))
            rows.filter("NOT bad").select(*BLOCK_COLUMNS).unionByName(fixed.select(*BLOCK_COLUMNS)).write.parquet(f"{path}/blocks")
            discard(bad, groups)
        else:
            self.blocks().write.parquet(f"{path}/blocks")
        self._copy(path, "parity", "manifest", "meta")
        return Archive(self.spark, path)

    def repairs(self, repaired: Archive) -> DataFrame:
        """One row: scanned, corrupted, recovered, unrecoverable blocks of a repair of this archive."""
        before, after = self.damage(), repaired.damage().select("block_seq", F.col("intact").alias("now"))
        both = before.join(after, "block_seq")
        return both.agg(F.count("*").alias("scanned"), F.count_if(~F.col("intact")).alias("corrupted"), F.count_if(~F.col("intact") & F.col("now")).alias("recovered"), F.count_if(~F.col("now")).alias("unrecoverable"))

    # ---- volumes ----

    def split(self, folder: str, max_size: int) -> int:
        """Write volumes of about max_size stored bytes and the other tables below folder; how many volumes there are."""
        sizes = self.blocks().select("hash", "block_seq", F.col("compressed_size").alias("len"))
        placed = dedup.running(sizes, "block_seq", {"offset": F.col("len") + S.BLOCK_HEADER_SIZE}, 1 << 20)
        numbers = volumes.assign(placed, volumes.split_points(placed, max_size)).select(F.col("block_seq").alias("_row"), "volume_no")
        dedup.placed(self.blocks().withColumn("_row", F.col("block_seq")), numbers, "volume_no").repartition("volume_no").write.partitionBy("volume_no").parquet(f"{folder}/volumes")
        found = volumes.inventory(self.spark, folder)
        found.write.parquet(f"{folder}/inventory")
        self._copy(folder, "manifest", "parity", "meta")
        return self.spark.read.parquet(f"{folder}/inventory").count()

    def _copy(self, path: str, *tables: str) -> None:
        if "parity" in tables and self.options.parity:
            self.parity().write.parquet(f"{path}/parity")
        if "manifest" in tables:
            _save_entries(self.entries(), path)
        if "meta" in tables:
            for name, columns in (("meta", _META), ("stats", _STATS)):
                self.spark.read.schema(columns).json(f"{self.path}/{name}").coalesce(1).write.json(f"{path}/{name}")


def join(spark: SparkSession, folder: str, path: str) -> Archive:
    """The archive whose volumes lie below folder, as one at path. A missing or short volume raises."""
    volumes.check(spark, folder)
    spark.read.parquet(f"{folder}/volumes").select(*BLOCK_COLUMNS).write.parquet(f"{path}/blocks")
    Archive(spark, folder)._copy(path, "manifest", "parity", "meta")
    return Archive(spark, path)


def convert(spark: SparkSession, tar: str, path: str, options: Options | None = None) -> Archive:
    """An archive of the entries of a tar, tar.gz or tar.zst file, or of all below a folder; without parity unless options ask for it."""
    entries = store(read_tars(spark, tar).withColumn("_row", F.monotonically_increasing_id()), "entries")
    numbers = dedup.numbered(entries.select("_row", "tar", F.col("seq").alias("k")), ["tar", "k"], {"seq": F.lit(1)})
    files = dedup.placed(entries.drop("tar", "seq"), numbers, "seq")
    archive = Archive.create(files, path, options or Options(ecc="none"))
    discard(entries)
    return archive


def merge(a: Archive, b: Archive, path: str) -> Archive:
    """Entries of both in order of path, the newer one where both have a path (a tie: a's); blocks are copied as stored."""
    if any(x.flags & (S.ENCRYPTED | S.INCREMENTAL) for x in (a, b)):
        raise ValueError("encrypted and incremental archives cannot be merged")
    spark = a.spark
    rows = a.manifest().withColumn("own", F.lit(1)).unionByName(b.manifest().withColumn("own", F.lit(0)))
    columns = [c for c in rows.columns if c not in ("path", "mtime_ns", "own")]
    best = rows.groupBy("path").agg(F.max(F.struct("mtime_ns", "own", F.struct(*columns).alias("row"))).alias("w"))
    merged = dedup.numbered(best.select("path", "w.mtime_ns", "w.row.*").drop("seq"), ["path"], {"seq": F.lit(1)}).withColumn("generation", F.lit(0).cast("long"))
    merged = store(merged, "merged")
    needed = merged.select(F.explode("block_refs").alias("r")).select("r.hash").distinct()
    stored = a.blocks().withColumn("src", F.lit(0)).unionByName(b.blocks().withColumn("src", F.lit(1)))
    row = (F.col("src").cast("long") * (1 << 60) + F.col("block_seq")).alias("_row")  # in the order in which both were written
    first = stored.groupBy("hash").agg(F.min(row).alias("_row")).join(needed, "hash", "left_semi")
    numbers = dedup.numbered(first.select("_row"), ["_row"], {"block_seq": F.lit(1)})
    stored = dedup.placed(stored.withColumn("_row", row).drop("block_seq", "group_id"), numbers, "block_seq").withColumn("group_id", F.floor(F.col("block_seq") / S.ECC_DATA))
    stored.select(*BLOCK_COLUMNS).write.parquet(f"{path}/blocks")
    blocks = spark.read.schema(S.BLOCKS).parquet(f"{path}/blocks")
    if a.options.parity:
        ecc.parity_of_stored(blocks, a.options.parity).write.parquet(f"{path}/parity")
    _save_entries(_with_refs(merged, _offsets(blocks, a.options.parity)), path)
    discard(merged)
    flags = S.ERASURE_CODED if a.options.parity else 0
    _note(spark, path, 0, a.options, flags, None)
    _meta(spark, path, a.options, a.salt, b"", 0, 0, flags, "")
    return Archive(spark, path)


# ---- what writers share ----


def _json(spark: SparkSession, path: str, name: str, row: tuple, columns: str) -> None:
    spark.createDataFrame([row], columns).coalesce(1).write.mode("append").json(f"{path}/{name}")


def _meta(spark: SparkSession, path: str, options: Options, salt: bytes, wrapped: bytes, generation: int, version: int, flags: int, base: str | None) -> None:
    row = {k: v for k, v in asdict(options).items() if k != "passphrase"}
    _json(spark, path, "meta", (json.dumps(row), salt.hex(), wrapped.hex(), generation, version, flags, base or ""), _META)


def _save_entries(entries: DataFrame, path: str, generation: int | None = None) -> None:
    """The manifest, of one generation or of all of them, and its copy from what was written. What a failed try left goes first."""
    spark = entries.sparkSession
    columns = ["seq", "path", "kind", "target", "mode", "mtime_ns", "uid", "gid", "size", "block_refs", "generation"]
    for name in ("manifest", "manifest_copy"):
        if generation is not None:
            delete(spark, f"{path}/{name}/generation={generation}")
        entries.select(*columns).write.mode("append").partitionBy("generation").parquet(f"{path}/{name}")
        entries = spark.read.schema(S.MANIFEST).parquet(f"{path}/manifest")
        entries = entries if generation is None else entries.filter(F.col("generation") == generation)


def _offsets(blocks: DataFrame, parity: int) -> DataFrame:
    """hash, block_seq, offset: where each block would lie in one file, after a header, with each group's parity behind it."""
    slim = blocks.select("hash", "block_seq", "group_id", (F.col("compressed_size") + S.BLOCK_HEADER_SIZE).alias("len"))
    groups = slim.groupBy("group_id").agg((F.sum("len") + parity * F.max("len")).alias("bytes"))
    starts = dedup.running(groups, "group_id", {"start": F.col("bytes")}).select("group_id", "start")
    inside = Window.partitionBy("group_id").orderBy("block_seq").rowsBetween(Window.unboundedPreceding, -1)  # ten rows
    return slim.withColumn("before", F.coalesce(F.sum("len").over(inside), F.lit(0))).join(starts, "group_id").select("hash", "block_seq", (F.col("start") + F.col("before") + S.HEADER_SIZE).alias("offset"))


def _with_refs(entries: DataFrame, offsets: DataFrame) -> DataFrame:
    """Entries whose references have the offsets of a table(hash, offset)."""
    refs = entries.select("generation", "seq", F.posexplode("block_refs").alias("pos", "r")).select("generation", "seq", "pos", "r.hash", "r.slice_start", "r.slice_len", "r.flags").join(offsets, "hash", "left")
    ref = F.struct("hash", "offset", "slice_start", "slice_len", "flags")
    refs = refs.groupBy("generation", "seq").agg(F.transform(F.sort_array(F.collect_list(F.struct("pos", ref.alias("ref")))), lambda x: x["ref"]).alias("block_refs"))
    return entries.drop("block_refs").join(refs, ["generation", "seq"], "left").withColumn("block_refs", F.coalesce("block_refs", F.array().cast(f"array<{S.REF}>")))


def _digest(rows: DataFrame) -> str:
    """A digest of a table's rows that does not depend on their order: the rows' SHA-256, added bit by bit. One partial aggregate."""
    row = F.sha2(F.to_json(F.struct(*rows.columns)), 256)
    lanes = [F.bit_xor(F.conv(F.substring(row, 1 + 15 * k, 15), 16, 10).cast("long")).alias(f"lane{k}") for k in range(4)]
    return hashlib.sha256(json.dumps(rows.agg(F.count("*").alias("n"), *lanes).first().asDict()).encode()).hexdigest()


def _roots(spark: SparkSession, path: str, entries: DataFrame, flags: int) -> tuple[str, str, str]:
    header = hashlib.sha256(f"{S.FORMAT_VERSION}/{flags}".encode()).hexdigest()
    manifest = _digest(entries)
    blocks = spark.read.schema(S.BLOCKS).parquet(f"{path}/blocks").select("block_seq", "hash")
    leaves = dedup.running(blocks, "block_seq", {"i": F.lit(1)}).select("i", "hash")
    found = merkle.merkle_root(leaves).first()
    return header, manifest, hashlib.sha256("/".join([header, found["root"] if found else "", manifest]).encode()).hexdigest()


def _note(spark: SparkSession, path: str, generation: int, options: Options, flags: int, slim: DataFrame | None, start: int = 0, known: DataFrame | None = None) -> None:
    """Stats and root of a generation that has just been written. slim: hash, len of its chunks."""
    entries = spark.read.schema(S.MANIFEST).parquet(f"{path}/manifest")
    mine = entries.filter(F.col("generation") == generation)
    total = lambda c, where: F.coalesce(F.sum(F.when(where, F.col(c))), F.lit(0))
    files = mine.agg(F.count_if(F.col("kind") != "dir"), F.count_if(F.col("kind") == "dir"), total("size", F.col("kind") == "file")).first()
    fresh = F.col("block_seq") >= start
    new = spark.read.schema(S.BLOCKS).parquet(f"{path}/blocks").agg(F.count_if(fresh), total("compressed_size", fresh), total("uncompressed_size", fresh), F.count("*"), total("compressed_size", F.lit(True))).first()
    if slim is None:
        slim = mine.select(F.explode("block_refs").alias("r")).select("r.hash", F.col("r.slice_len").alias("len"))
    chunks = slim.agg(F.count("*"), total("len", F.lit(True))).first()
    reused = slim.join(known.select("hash"), "hash", "left_semi").count() if flags & S.INCREMENTAL else chunks[0] - new[0]
    parity = spark.read.schema(S.PARITY).parquet(f"{path}/parity").agg(F.count("*"), total("shard_size", F.lit(True))).first() if options.parity else (0, 0)
    size = S.HEADER_SIZE + S.FOOTER_SIZE + S.BLOCK_HEADER_SIZE * (new[3] + parity[0]) + new[4] + parity[1]
    stats = (generation, *files, chunks[0], new[0], reused, chunks[1] - new[2], new[1], parity[0], size)
    _json(spark, path, "stats", (*stats, *_roots(spark, path, entries, flags)), _STATS)


def _write(files: DataFrame, path: str, options: Options, key: bytes | None, generation: int, known: DataFrame | None, flags: int, external: bool = False) -> None:
    """Chunk once, dedup against known hashes, compress, encrypt, add parity; then the manifest with offsets, stats and root."""
    spark = files.sparkSession
    files = _with_defaults(files)
    pieces = store(chunk.content_chunks(files.filter("kind = 'file'"), options.least, options.average, options.most).withColumn("_row", F.monotonically_increasing_id()), "pieces")
    slim = pieces.select("seq", "pos", "hash", "len")
    first = pieces.groupBy("hash").agg(F.min(F.struct("seq", "pos", "_row")).alias("f")).select("hash", "f.*")
    if known is not None:
        first = first.join(known.select("hash"), "hash", "left_anti")
    start = 0
    if generation:
        start = (spark.read.parquet(f"{path}/blocks").agg(F.max("block_seq")).first()[0] or 0) + S.ECC_DATA
        start -= start % S.ECC_DATA  # a generation begins its own parity groups
    order = dedup.numbered(first.select("seq", "pos", "_row"), ["seq", "pos"], {"block_seq": F.lit(1)})
    fresh = dedup.placed(pieces.select("_row", "hash", "chunk"), order, "block_seq").select("hash", (F.col("block_seq") + start).alias("block_seq"), "chunk")
    rows = codec.compress_blocks(fresh, options.codec, options.level).withColumn("group_id", F.floor(F.col("block_seq") / S.ECC_DATA))
    if key:
        rows = rows.withColumn("payload", codec.encrypt(F.col("payload"), F.col("hash"), F.col("codec"), key, options.level))
    rows = rows.withColumns({"compressed_size": F.octet_length("payload").cast("long"), "checksum": F.crc32("payload")})
    rows.select(*BLOCK_COLUMNS).write.mode("append").parquet(f"{path}/blocks")
    blocks = spark.read.schema(S.BLOCKS).parquet(f"{path}/blocks")
    if options.parity:
        ecc.parity_of_stored(blocks.filter(F.col("block_seq") >= start), options.parity).write.mode("append").parquet(f"{path}/parity")
    own = _offsets(blocks, options.parity).filter(F.col("block_seq") >= start).select("hash", "offset", F.lit(0).alias("flags"))
    if known is not None:
        own = own.unionByName(known.select("hash", "offset", F.lit(S.REF_EXTERNAL if external else 0).alias("flags")))
    ref = F.struct("hash", "offset", F.lit(0).alias("slice_start"), F.col("len").cast("int").alias("slice_len"), "flags")
    refs = slim.join(own, "hash", "left").groupBy("seq").agg(F.transform(F.sort_array(F.collect_list(F.struct("pos", ref.alias("ref")))), lambda x: x["ref"]).alias("block_refs"), F.sum("len").alias("bytes"))
    manifest = files.select(F.lit(generation).cast("long").alias("generation"), F.col("seq").cast("long"), "path", "kind", "target", F.col("mode").cast("int"), *[F.col(c).cast("long") for c in ("mtime_ns", "uid", "gid")])
    manifest = manifest.join(refs, "seq", "left").withColumns({"size": F.coalesce("bytes", F.lit(0)).cast("long"), "block_refs": F.coalesce("block_refs", F.array().cast(f"array<{S.REF}>"))})
    _save_entries(manifest, path, generation)
    _note(spark, path, generation, options, flags, slim, start, known)
    discard(pieces)
