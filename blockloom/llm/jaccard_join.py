"""Operator 4: size-aware heavy-light Jaccard join on word shingles, and its connected groups.

Documents with equal shingle sets become one node. A set of n shingles can only link to a set with
which it shares t = ceil(threshold * n) shingles, so under one global order, rarest first, two
linked sets share at least one of their first n - t + 1 shingles, and at least two of their first
n - t + 2.

- Light sets are found by their 2-subsets: every pair of those n - t + 2 shingles is a key.
- Heavy sets are found by inverted lists: each of the n - t + 1 shingles is a key, for heavy sets
  and for those light ones that are large enough to link to a heavy one. So are sets small enough to
  link by a single shared shingle (t = 1), which no 2-subset finds.
- The boundary is the size at which, summed over all sets, 2-subsets cost more keys than the
  list entries and comparisons that they replace.

Keys gather candidates; they never emit all pairs of a key. First each set of a key is compared
with the key's smallest node. Sets that this connects need no further comparison. Where a key still
holds several components, its small rest is compared pairwise across components, and a large rest in
bounded blocks inside numpy, from which only links come out.

The order comes from a sketch of shingle counts over all documents; any order gives the same links,
rarest first gives the fewest candidates.
"""

from __future__ import annotations

from functools import partial

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from blockloom.llm.common import LOWER_AZ, Memory, discard, emit, hold, id_and_text, slices, store
from blockloom.llm.components import connected_components

_MIX = np.uint64(0x9E3779B97F4A7C15)
#: 64-bit hashes of words.
_HASHES = Memory(xxhash.xxh3_64_intdigest)


def shingle_set(text: str | None, words: int) -> np.ndarray:
    """Sorted distinct 64-bit hashes of a text's shingles. Two different shingles of a pair of documents
    get one hash with a chance of about 1e-19 each."""
    found = (text or "").encode().translate(LOWER_AZ).split()
    if not found:
        return np.zeros(0, np.uint64)
    h = np.fromiter(map(_HASHES.__getitem__, found), np.uint64, len(found))
    size = min(words, len(h))
    n = len(h) - size + 1
    s = np.full(n, size, np.uint64)
    for k in range(size):
        s = (s ^ h[k : k + n]) * _MIX
        s ^= s >> np.uint64(29)
    s *= np.uint64(0xBF58476D1CE4E5B9)
    s ^= s >> np.uint64(32)
    s.sort()
    return s[np.append(True, s[1:] != s[:-1])]


def needed(n, percent: int):
    """Shared shingles that a set of n needs with any set it links to."""
    return -(-percent * n // 100)


# ---- passes over the texts ------------------------------------------------------------------------

SETS = pa.schema([("doc_id", pa.int64()), ("n", pa.int64()), ("digest", pa.binary()), ("sketch", pa.binary())])
PREFIX = pa.schema([("node", pa.int64()), ("n", pa.int64()), ("digest", pa.binary()), ("prefix", pa.list_(pa.int64()))])
FULL = pa.schema([("node", pa.int64()), ("shingles", pa.list_(pa.int64()))])


def _measure(words: int, bits: int, batches):
    """Size and digest of every set, then this task's counts of shingles by their first bits."""
    hold("jaccard", _HASHES.clear)
    sketch = np.zeros(1 << bits, np.uint32)
    shift = np.uint64(64 - bits)
    for b in slices(batches):
        n, digest = [], []
        for text in b.column("text").to_pylist():
            s = shingle_set(text, words)
            n.append(len(s))
            digest.append(xxhash.xxh3_128_digest(s.tobytes()) if len(s) else None)
            # shingles are distinct, but two may share a counter
            np.add.at(sketch, (s >> shift).astype(np.int64), 1)
        yield emit(SETS, doc_id=b.column("doc_id"), n=n, digest=digest, sketch=[None] * len(n))
    yield emit(SETS, doc_id=[None], n=[None], digest=[None], sketch=[sketch.tobytes()])


def _sum_sketches(batches):
    total = None
    for b in batches:
        for raw in b.column("sketch"):
            part = np.frombuffer(raw.as_py(), np.uint32)
            total = part.copy() if total is None else total + part
    if total is not None:
        yield pa.RecordBatch.from_arrays([pa.array([total.tobytes()], pa.binary())], names=["sketch"])


def _sketch(parts: DataFrame) -> np.ndarray:
    """Sum of all tasks' sketches, sixteen at a time: one array of fixed size."""
    while (k := parts.rdd.getNumPartitions()) > 16:
        parts = store(parts.coalesce(-(-k // 16)).mapInArrow(_sum_sketches, "sketch binary"), "sketch")
    rows = parts.coalesce(4).mapInArrow(_sum_sketches, "sketch binary").collect()
    return np.sum([np.frombuffer(r["sketch"], np.uint32) for r in rows], axis=0, dtype=np.uint32)


def _prefixes(words: int, percent: int, shared, batches):
    hold("jaccard", _HASHES.clear)
    counts = shared.value
    shift = np.uint64(64 - int(len(counts)).bit_length() + 1)
    for b in slices(batches):
        out = []
        for doc, text in zip(b.column("doc_id").to_pylist(), b.column("text").to_pylist(), strict=True):
            s = shingle_set(text, words)
            n = len(s)
            if doc is None or 100 * n < percent * (n + 1):  # only an equal set can link to it, no larger one
                continue
            k = n - needed(n, percent) + 2
            order = np.argsort(counts[(s >> shift).astype(np.int64)], kind="stable")[:k]  # ties in order of the hash
            out.append((doc, n, xxhash.xxh3_128_digest(s.tobytes()), s[order].view(np.int64)))
        yield emit(PREFIX, **{name: [r[i] for r in out] for i, name in enumerate(PREFIX.names)})


def _sets(words: int, batches):
    hold("jaccard", _HASHES.clear)
    for b in slices(batches):
        yield emit(FULL, node=b.column("doc_id"), shingles=[shingle_set(t, words).view(np.int64) for t in b.column("text").to_pylist()])


def _among(table: DataFrame, column: str, wanted: DataFrame, wanted_column: str) -> DataFrame:
    """Rows of table whose column is in wanted, and few others, without a shuffle of table.

    Each wanted value sets one bit of a bitmap of 2^20 to 2^26 bits, some sixteen bits for each value. The
    bitmap is broadcast as words of 64 bits: 2^20 rows at most. With more values than it has room for it
    only lets more rows pass.
    """
    n = wanted.count()
    bits = min(26, max(20, (16 * n).bit_length()))
    place = lambda c: F.pmod(F.xxhash64(c), F.lit(1 << bits))
    one = lambda c: F.expr(f"shiftleft(1L, cast(pmod(xxhash64({c}), {1 << bits}) & 63 as int))")
    words = wanted.groupBy(F.shiftright(place(wanted_column), 6).alias("filter_word")).agg(F.bit_or(one(wanted_column)).alias("filter_bits"))
    hit = (F.shiftright(place(column), 6) == F.col("filter_word")) & (F.col("filter_bits").bitwiseAND(one(column)) != 0)
    return table.join(F.broadcast(words), hit, "left_semi")


def _sets_of(rows: DataFrame, nodes: DataFrame, words: int) -> DataFrame:
    """Whole shingle sets of some nodes (and of few other documents)."""
    wanted = store(nodes.distinct(), "wanted")
    found = _among(rows.filter("doc_id IS NOT NULL").select("doc_id", "text"), "doc_id", wanted, "node")
    sets = store(found.mapInArrow(partial(_sets, words), "node long, shingles array<long>"), "sets")
    discard(wanted)
    return sets


# ---- candidates -----------------------------------------------------------------------------------


def _boundary(live: DataFrame, prefix_len) -> int:
    """Largest size of light sets: where all costs together are least. At most some rows for each power of two come to the driver.

    A list entry costs two rows, itself and its comparison with the list's smallest node, as no list is
    compared pairwise as a whole; a 2-subset costs one, as sets that share one are rarely compared in vain.
    """
    node = live.groupBy("node", "n").agg(F.sum(F.when(F.col("pos") < prefix_len - 1, 2).otherwise(0)).alias("lists"), F.count("*").alias("k"))
    step = F.greatest(F.lit(1), F.pow(F.lit(2), F.floor(F.log2("n")) - 3).cast("long"))
    costs = node.groupBy((F.floor(F.col("n") / step) * step + step - 1).alias("size")).agg(F.sum("lists").alias("lists"), F.sum(F.col("k") * (F.col("k") - 1) / 2).alias("subsets"))
    rows = sorted(costs.collect(), key=lambda r: r["size"])
    best, at, total = 0, 0, 0.0
    for r in rows:
        total += r["subsets"] - r["lists"]
        if total < best:
            best, at = total, r["size"]
    return int(at)


def _buckets(prefixes: DataFrame, percent: int, boundary: int | None) -> DataFrame:
    """(key, node, n, pos, pivot, pivot_n, pivot_pos, members) of keys that two sets or more share."""
    length = F.col("n") - F.ceil(F.col("n") * percent / 100) + 2
    posts = prefixes.select("node", "n", F.posexplode("prefix").alias("pos", "shingle"))
    shared = store(posts.groupBy("shingle").agg(F.count("*").alias("df")).filter("df > 1"), "shared")
    live = store(_among(posts, "shingle", shared, "shingle").join(shared, "shingle"), "live")
    if boundary is None:
        boundary = _boundary(live, length)
    listed = (F.col("n") * 100 >= (boundary + 1) * percent) | (F.col("n") * percent <= 100)
    lists = live.filter(listed & (F.col("pos") < length - 1)).select(F.col("shingle").alias("key"), "node", "n", "pos")
    light = live.filter(F.col("n") <= boundary).groupBy("node", "n").agg(F.sort_array(F.collect_list(F.struct("pos", "shingle"))).alias("s"))
    pairs = F.flatten(F.transform("s", lambda x, i: F.transform(F.slice("s", i + 2, F.size("s")), lambda y: F.struct(F.xxhash64(x["shingle"], y["shingle"]).alias("key"), x["pos"].alias("pos")))))
    subsets = light.select("node", "n", F.explode(pairs).alias("p")).select("p.key", "node", "n", "p.pos")
    found = store(lists.unionByName(subsets), "keys")
    discard(live, shared)
    first = F.min(F.struct("node", "n", "pos")).alias("first")
    keys = store(found.groupBy("key").agg(F.count("*").alias("members"), first).filter("members > 1").select("key", "members", F.col("first.node").alias("pivot"), F.col("first.n").alias("pivot_n"), F.col("first.pos").alias("pivot_pos")), "pivots")
    buckets = store(found.join(keys, "key"), "buckets")
    discard(found, keys)
    return buckets


def _may_link(na, pa_, nb, pb, percent: int):
    """Whether sizes and places of a shared shingle leave room for a link."""
    least = F.ceil((na + nb) * percent / (100.0 + percent) - 1e-9)
    return (F.least(na - pa_, nb - pb) >= least) & (F.least(na, nb) * 100 >= F.greatest(na, nb) * percent)


def _plausible(pairs: DataFrame, prefixes: DataFrame, percent: int) -> DataFrame:
    """Of stored pairs (a, b) those that their first shingles leave possible; takes their place.

    Up to the last shingle that both prefixes hold, all common shingles are known: what stands before it in
    one prefix and not in the other is in one set only.
    """
    nodes = store(pairs.select(F.col("a").alias("node")).union(pairs.select(F.col("b").alias("node"))).distinct(), "wanted")
    known = store(_among(prefixes, "node", nodes, "node"), "known")
    a = known.select(F.col("node").alias("a"), F.col("n").alias("na"), F.col("prefix").alias("pa"))
    b = known.select(F.col("node").alias("b"), F.col("n").alias("nb"), F.col("prefix").alias("pb"))
    both = pairs.join(b, "b").join(a, "a").withColumn("both", F.array_intersect("pa", "pb"))
    last = F.try_element_at("both", F.lit(-1))
    most = F.size("both") + F.least(F.col("na") - F.array_position("pa", last), F.col("nb") - F.array_position("pb", last))
    left = store(both.filter(most * (100 + percent) >= (F.col("na") + F.col("nb")) * percent).select("a", "b"), "plausible")
    discard(pairs, nodes, known)
    return left


def _verified(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Pairs (a, b) whose whole sets link. Each side's sets are cut to that side's nodes before they move."""
    a = _among(sets, "node", pairs.select(F.col("a").alias("side")).distinct(), "side").select(F.col("node").alias("a"), F.col("shingles").alias("sa"))
    b = _among(sets, "node", pairs.select(F.col("b").alias("side")).distinct(), "side").select(F.col("node").alias("b"), F.col("shingles").alias("sb"))
    both = F.size(F.array_intersect("sa", "sb"))
    return pairs.join(b, "b").join(a, "a").filter(both * (100 + percent) >= (F.size("sa") + F.size("sb")) * percent).select("a", "b")


LINKS = pa.schema([("a", pa.int64()), ("b", pa.int64())])


def links_in_block(rows: pa.Table, percent: int) -> pa.Table:
    """Links across components among the sets of two blocks (or within one), by counting shared shingles: of those that
    join the same components, one. rows: node, label, block, lo, hi, shingles; a node may be repeated."""
    lo, hi = rows.column("lo")[0].as_py(), rows.column("hi")[0].as_py()
    node, label, part = (rows.column(c).to_numpy() for c in ("node", "label", "block"))
    flat = rows.column("shingles").combine_chunks()
    flat = flat if isinstance(flat, pa.ListArray) else flat.chunk(0)
    begin, values = flat.offsets.to_numpy(), flat.values.to_numpy()
    once = np.zeros(len(node), bool)
    once[np.unique(node, return_index=True)[1]] = True

    def side(which: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        at = np.flatnonzero(once & (part == which))
        sizes = begin[at + 1] - begin[at]
        return at, sizes, np.concatenate([values[begin[i] : begin[i + 1]] for i in at] or [values[:0]])

    (la, na, fa), (lb, nb, fb) = side(lo), side(hi)
    out: list[tuple[int, int]] = []
    if len(la) and len(lb):
        common = np.intersect1d(fa, fb)
        ra, rb = np.repeat(np.arange(len(na)), na), np.repeat(np.arange(len(nb)), nb)
        ka, kb = np.isin(fa, common), np.isin(fb, common)
        ra, ca, rb, cb = ra[ka], np.searchsorted(common, fa[ka]), rb[kb], np.searchsorted(common, fb[kb])
        both = np.zeros((len(na), len(nb)), np.float32)
        for at in range(0, len(common), 4096):
            ma, mb = np.zeros((len(na), 4096), np.float32), np.zeros((len(nb), 4096), np.float32)
            ia, ib = (ca >= at) & (ca < at + 4096), (cb >= at) & (cb < at + 4096)
            ma[ra[ia], ca[ia] - at] = 1
            mb[rb[ib], cb[ib] - at] = 1
            both += ma @ mb.T
        ok = (both * (100 + percent) >= (na[:, None] + nb[None, :]) * percent) & (label[la][:, None] != label[lb][None, :])
        parent: dict[int, int] = {}

        def root(x: int) -> int:
            while parent.setdefault(x, x) != x:
                parent[x] = x = parent[parent[x]]
            return x

        for x, y in np.argwhere(ok).tolist():
            if (p := root(int(label[la[x]]))) != (q := root(int(label[lb[y]]))):
                parent[p] = q
                out.append((int(node[la[x]]), int(node[lb[y]])))
    return pa.Table.from_arrays([pa.array([x[k] for x in out], pa.int64()) for k in (0, 1)], schema=LINKS)


def _rest(buckets: DataFrame, labels: DataFrame, prefixes: DataFrame, rows: DataFrame, words: int, percent: int, small: int, block: int) -> DataFrame | None:
    """Links between components that a key still holds together."""
    named = store(buckets.join(labels.select("node", "label"), "node", "left").withColumn("label", F.coalesce("label", "node")), "named")
    mixed = store(named.groupBy("key").agg(F.min("label").alias("low"), F.max("label").alias("high")).filter("low < high").select("key"), "mixed")
    rest = store(named.join(mixed, "key"), "rest")
    discard(named, mixed)
    few = rest.filter((F.col("members") <= small) & (F.col("node") > F.col("pivot")))
    other = few.select("key", F.col("node").alias("b"), F.col("n").alias("nb"), F.col("pos").alias("pb"), F.col("label").alias("lb"))
    pairs = few.select("key", F.col("node").alias("a"), "n", "pos", "label").join(other, "key").filter((F.col("a") < F.col("b")) & (F.col("label") != F.col("lb")) & _may_link(F.col("n"), F.col("pos"), F.col("nb"), F.col("pb"), percent))
    pairs = _plausible(store(pairs.select("a", "b").distinct(), "pairs"), prefixes, percent)
    many = store(rest.filter(F.col("members") > small).select("pivot", "node", "label").distinct(), "many")
    discard(rest)
    nodes = pairs.select(F.col("a").alias("node")).union(pairs.select(F.col("b").alias("node"))).union(many.select("node"))
    if not nodes.limit(1).count():
        return None
    sets = _sets_of(rows, nodes, words)
    found = _verified(pairs, sets, percent)
    counts = many.groupBy("pivot").agg(F.count("*").alias("m"))
    dealt = many.join(counts, "pivot").withColumn("blocks", F.ceil(F.col("m") / block)).withColumn("block", F.pmod(F.xxhash64("node"), F.col("blocks")))
    dealt = dealt.withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)))
    dealt = dealt.select("pivot", "node", "label", "block", F.least("block", "other").alias("lo"), F.greatest("block", "other").alias("hi")).join(sets, "node")

    def links(rows: pa.Table) -> pa.Table:
        return links_in_block(rows, percent)

    blocks = dealt.groupBy("pivot", "lo", "hi").applyInArrow(links, "a long, b long")
    both = store(found.union(blocks), "links")
    discard(pairs, many, sets)
    return both


def jaccard_components(docs: DataFrame, words: int = 5, percent: int = 80, id_col: str = "doc_id", text_col: str = "text", boundary: int | None = None, sketch_bits: int = 20, small: int = 48, block: int = 256) -> DataFrame:
    """Groups of documents whose shingle sets have a Jaccard similarity of percent / 100 or more: doc_id, n_shingles, component_id.

    A text of fewer words than a shingle has one shingle, all its words. boundary forces the largest light
    size; by default costs choose it. Null or empty text, or one without words: no shingles, its own
    component. Repeated rows are equal sets and share a component. doc_ids are taken to be unique; rows that
    repeat one with another text may be joined through it. A row without doc_id takes part in no link and
    has no component_id. Other columns are not looked at. Empty table: empty result.
    """
    spark = docs.sparkSession
    rows = id_and_text(docs, id_col, text_col)
    measured = store(rows.mapInArrow(partial(_measure, words, sketch_bits), "doc_id long, n long, digest binary, sketch binary"), "measured")
    own = measured.filter("n IS NOT NULL").select("doc_id", "n", "digest")
    counts = spark.sparkContext.broadcast(_sketch(measured.filter("sketch IS NOT NULL").select("sketch")))
    nodes = store(own.filter("digest IS NOT NULL AND doc_id IS NOT NULL").groupBy("digest").agg(F.min("doc_id").alias("node")), "nodes")
    prefixes = rows.mapInArrow(partial(_prefixes, words, percent, counts), "node long, n long, digest binary, prefix array<long>")
    prefixes = store(prefixes.join(nodes, ["node", "digest"], "left_semi").drop("digest"), "prefixes")
    counts.unpersist()
    buckets = _buckets(prefixes, percent, boundary)
    star = buckets.filter((F.col("node") != F.col("pivot")) & _may_link(F.col("n"), F.col("pos"), F.col("pivot_n"), F.col("pivot_pos"), percent))
    star = store(star.select(F.col("pivot").alias("a"), F.col("node").alias("b")).distinct(), "star")
    star = _plausible(star, prefixes, percent)
    sets = _sets_of(rows, star.select(F.col("a").alias("node")).union(star.select(F.col("b").alias("node"))), words)
    links = store(_verified(star, sets, percent), "links")
    discard(star, sets)
    labels = connected_components(links)
    more = _rest(buckets, labels, prefixes, rows, words, percent, small, block)
    discard(buckets, prefixes)
    if more is not None and more.limit(1).count():
        discard(labels)
        labels = connected_components(links.union(more))
    named = store(nodes.join(labels.select("node", "label"), "node", "left").select("digest", F.coalesce("label", "node").alias("component_id")), "components")
    discard(nodes, labels)
    linked = own.filter("digest IS NOT NULL").join(named, "digest", "left")
    alone = own.filter("digest IS NULL").withColumn("component_id", F.col("doc_id"))
    columns = ["doc_id", F.col("n").alias("n_shingles"), F.when(F.col("doc_id").isNotNull(), F.col("component_id")).alias("component_id")]
    return linked.select(*columns).union(alone.select(*columns))
