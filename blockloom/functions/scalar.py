"""Scalar functions as Spark columns: sizes, names, paths, versions, flags."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from blockloom import schema as S


def parse_size(text: Column) -> Column:
    """Bytes of "4G", "1.5M", "500K" or "500" (any case); null if it is none of these."""
    number = F.regexp_extract(text, r"^\s*([0-9]+(?:\.[0-9]+)?)\s*[KMGkmg]?\s*$", 1)
    unit = F.upper(F.regexp_extract(text, r"([KMGkmg])\s*$", 1))
    power = F.when(unit == "K", 1024).when(unit == "M", 1024**2).when(unit == "G", 1024**3).otherwise(1)
    return F.floor(number.try_cast("double") * power).cast("long")


def format_size(n: Column) -> Column:
    """Binary units with two decimals, rounded from the double's exact value, an exact half to the even digit as printf does."""
    out = F.format_string("%d B", n)
    # format_string rounds the double's shortest decimal half up; a quotient by a power of two is exact, so integers tell its hundredths
    whole = F.coalesce(n.cast("double").try_cast("long"), n)
    for k, unit in enumerate(("KiB", "MiB", "GiB", "TiB"), 1):
        below = whole.bitwiseAND(1024**k - 1) * 100
        rest, cents = below.bitwiseAND(1024**k - 1), F.shiftright(below, 10 * k)
        up = (rest > 1024**k // 2) | ((rest == 1024**k // 2) & (cents % 2 == 1))
        total = F.shiftright(whole, 10 * k) * 100 + cents + F.when(up, 1).otherwise(0)
        text = F.format_string(f"%d.%02d {unit}", ((total - total % 100) / 100).cast("long"), total % 100)
        out = F.when(n >= 1024**k, text).otherwise(out)
    return out


def octal_mode(mode: Column) -> Column:
    return F.lower(F.conv(mode.bitwiseAND(0o7777).cast("string"), 10, 8))


def type_char(kind: Column) -> Column:
    return F.when(kind == "dir", "d").when(kind == "symlink", "l").when(kind == "hardlink", "h").otherwise("-")


def flag_list(flags: Column) -> Column:
    names = F.array_compact(F.array(*[F.when(flags.bitwiseAND(bit) != 0, name) for bit, name in S.FLAG_NAMES.items()]))
    return F.when(F.size(names) == 0, "none").otherwise(F.array_join(names, ", "))


def normal_path(path: Column) -> Column:
    """Separators as "/", none in front."""
    return F.regexp_replace(F.translate(path, "\\", "/"), "^/+", "")


def safe_path(path: Column) -> Column:
    """False for absolute paths and for any ".." component."""
    return ~(path.rlike(r"^[/\\]") | F.exists(F.split(path, r"[/\\]"), lambda c: c == ".."))


def resolve_path(path: Column) -> Column:
    """Lexical resolution of "." and ".."; null if it leaves the root."""
    parts = F.filter(F.split(F.translate(path, "\\", "/"), "/"), lambda c: ~c.isin("", "."))
    start = F.struct(F.array().cast("array<string>").alias("stack"), F.lit(False).alias("out"))

    def step(acc: Column, part: Column) -> Column:
        up = part == ".."
        empty = F.size(acc["stack"]) == 0
        stack = F.when(up, F.slice(acc["stack"], F.lit(1), F.greatest(F.size(acc["stack"]) - 1, F.lit(0)))).otherwise(F.concat(acc["stack"], F.array(part)))
        return F.struct(stack.alias("stack"), (acc["out"] | (up & empty)).alias("out"))

    return F.aggregate(parts, start, step, lambda a: F.when(~a["out"], F.array_join(a["stack"], "/")))


def version_newer(current: Column, other: Column) -> Column:
    """Whether other is newer: numeric parts compared in order, parts that are no number left out."""
    parts = lambda v: F.filter(F.transform(F.split(v, r"\."), lambda x: x.try_cast("long")), lambda x: x.isNotNull())
    return parts(other) > parts(current)


def version_from_url(url: Column) -> Column:
    found = F.regexp_extract(url, r"/v?([0-9][^/]*)$", 1)
    return F.when(found != "", found)


def checksum_line(line: Column) -> Column:
    """struct(hash, name) of "hash  *name"."""
    parts = F.split(F.trim(line), r"\s+", 2)
    return F.struct(F.lower(parts[0]).alias("hash"), F.regexp_replace(F.trim(F.try_element_at(parts, F.lit(2))), r"^\*", "").alias("name"))


def short_checksum(content: Column) -> Column:
    """The first eight bytes of the SHA-256, in hex."""
    return F.substring(F.sha2(content, 256), 1, 16)


def ratio(whole: Column, stored: Column) -> Column:
    """How many times smaller; null where nothing is stored."""
    return F.when(stored > 0, whole.cast("double") / stored.cast("double"))


def megabytes_per_second(n: Column, seconds: Column) -> Column:
    return F.when(seconds > 0, n.cast("double") / F.lit(1048576.0) / seconds)


def codec_id(name: Column) -> Column:
    out = F.lit(None).cast("int")
    for k, v in S.CODECS.items():
        out = F.when(F.lower(name) == k, v).otherwise(out)
    return out


def codec_name(codec: Column) -> Column:
    return F.when(codec == 0, "none").when(codec == 1, "zstd").when(codec == 2, "lz4")


def ecc_parity(level: Column) -> Column:
    """Parity blocks for a level's name; 0 when switched off, null if unknown."""
    out = F.when(F.lower(level).isin("none", "off", "false"), 0)
    for k, v in S.ECC_PARITY.items():
        out = out.when(F.lower(level) == k, v)
    return out


def ecc_overhead(parity: Column) -> Column:
    return parity * 100.0 / S.ECC_DATA


def volume_name(stem: Column, number: Column, ext: Column) -> Column:
    return F.format_string("%s.%03d%s", stem, number, ext)


def eta_text(done: Column, total: Column, seconds: Column) -> Column:
    """Nothing below a tenth; then seconds, minutes, or hours and minutes left."""
    left = F.floor(seconds * (total - done) / done).cast("long")
    text = F.when(left < 60, F.format_string("ETA %ds", left)).when(left < 3600, F.format_string("ETA ~%dm", F.floor(left / 60))).otherwise(F.format_string("ETA ~%dh%02dm", F.floor(left / 3600), F.floor(left % 3600 / 60)))
    return F.when(done * 10 >= total, text)


def legacy_format(content: Column) -> Column:
    """tar.zst, tar.gz or tar by magic bytes, else null."""
    head = F.hex(F.substring(content, 1, 4))
    return F.when(F.octet_length(content) < 4, None).when(head == "28B52FFD", "tar.zst").when(F.substring(head, 1, 4) == "1F8B", "tar.gz").when(F.hex(F.substring(content, 258, 5)) == "7573746172", "tar")


def lossy_text(raw: Column) -> Column:
    """Bytes as text; what is no UTF-8 becomes replacement characters."""
    return F.make_valid_utf8(raw.cast("string"))
