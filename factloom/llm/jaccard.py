"""N-gram Jaccard join: size-banded tiles, bitmap signatures that bound the overlap, exact intersection.

Equal sets are one class. Sizes fall into bands; the scheme of a band cuts the hash range into
more segments than two sets of the band that link can differ in, so they agree on a whole
segment. Classes that share a segment's content are candidates; whatever candidates connect is
one tile. Tiles are gone through twice: first with bitmap signatures alone, whose bit counts
bound the overlap from above and leave few classes, then with the sets of those, whose sorted
arrays are intersected. Texts stay where they are read: sets are sent of those classes only. No link is lost: segments that are empty are left out only where agreeing
ones that aren't must remain.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.graphs import components as connected
from . import common

#: Sizes of a band grow by this factor.
BAND = 1.35
#: Classes that one tile holds; larger candidate groups are split into tiles by shared segment.
TILE = 4096
#: Shingles that one tile holds, 8 bytes each.
ROOM = 4_000_000
#: Segment contents held in a task before they are sent on.
FLUSH = 1_000_000


class Bands:
    """Band limits and segment counts for links at percent/100 or more."""

    def __init__(self, percent: int):
        self.percent, self.low, self.high, self.segments, self.spare = percent, [], [], [], []

    def _grow(self, size: int) -> None:
        while not self.high or self.high[-1] < size:
            lo = self.high[-1] + 1 if self.high else 1
            hi = max(lo, int(lo * BAND))
            differ = 2 * hi * (100 - self.percent) // (100 + self.percent)
            spare = 1
            while True:  # room for the segments that chance leaves empty in the smallest set of the scheme
                m = differ + spare
                empty = m * math.exp(-max(1, lo * self.percent // 100) / m) if m > 1 else 0.0
                if spare > empty + 3 * math.sqrt(empty) or spare > 4 * (differ + 1):
                    break
                spare += 1
            self.low.append(lo)
            self.high.append(hi)
            self.segments.append(differ + spare)
            self.spare.append(spare)

    def of(self, sizes: np.ndarray) -> np.ndarray:
        self._grow(int(sizes.max(initial=1)) * 100 // self.percent + 1)
        return np.searchsorted(self.high, sizes)


def signatures(values: np.ndarray, at: np.ndarray, bands: Bands, some: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """(segment content hash, row) for sets given flat and sorted with offsets, or some of them; a
    set takes part in its own band's scheme and in those of the bands that hold larger sets it may
    link with."""
    sizes = np.diff(at)
    full = np.flatnonzero(sizes if some is None else (sizes > 0) & some)
    keys, rows = [np.zeros(0, np.uint64)], [np.zeros(0, np.int64)]
    if not len(full):
        return keys[0], rows[0]
    sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(common.mix(values), dtype=np.uint64)])
    first, last = bands.of(sizes[full]), bands.of(sizes[full] * 100 // bands.percent)
    for i, lo, hi in zip(full, first, last, strict=True):
        own = values[at[i] : at[i + 1]]
        for b in range(lo, hi + 1):
            m, spare = bands.segments[b], bands.spare[b]
            cuts = ((np.arange(1, m, dtype=np.uint64) << np.uint64(32)) // np.uint64(m)) << np.uint64(32)
            edges = np.empty(m + 1, np.int64)
            edges[0], edges[m] = at[i], at[i + 1]
            edges[1:m] = at[i] + np.searchsorted(own, cuts)
            total = sums[edges[1:]] - sums[edges[:-1]]
            there = edges[1:] > edges[:-1]
            seg = np.arange(m, dtype=np.uint64) + np.uint64((b + 1) << 32)
            key = common.mix(common.mix(total) + seg * np.uint64(0x9E3779B97F4A7C15))
            if m - int(there.sum()) < spare:  # of spare agreeing segments, one isn't empty
                key = key[there]
            keys.append(key)
            rows.append(np.full(len(key), i, np.int64))
    return np.concatenate(keys), np.concatenate(rows)


def class_keys(values: np.ndarray, at: np.ndarray) -> np.ndarray:
    """A number that names each set; 0 names none. Different sets share one with chance 2**-64."""
    sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(common.mix(values), dtype=np.uint64)])
    key = common.mix(sums[at[1:]] - sums[at[:-1]] + np.diff(at).astype(np.uint64)).view(np.int64)
    return np.where(key == 0, 1, key)


def _sets(batch_text, k: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    for lo, buf, offs in common.slices(batch_text, common.FINE_BYTES):
        h, _, _, rows = common.words(buf, offs, True)
        n = len(offs) - 1
        yield (lo, *common.distinct_by_row(*common.shingles(h, rows, n, k), n))


def classes(docs: DataFrame, k: int) -> DataFrame:
    """(doc_id, mark, cls, n_shingles, bits) of every row; cls is null for a set without shingles."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo, values, at in _sets(batch["text"], k):
                sizes = np.diff(at)
                n = len(sizes)
                bits = [bitmap(values[at[i] : at[i + 1]]).tobytes() for i in range(n)]
                yield pa.RecordBatch.from_arrays([batch["doc_id"][lo : lo + n], batch["mark"][lo : lo + n], pa.array(class_keys(values, at), mask=sizes == 0), pa.array(sizes.astype(np.int64)), pa.array(bits, pa.binary())], names=["doc_id", "mark", "cls", "n_shingles", "bits"])

    return docs.mapInArrow(run, "doc_id long, mark long, cls long, n_shingles long, bits binary")


def _pack5(x: np.ndarray) -> bytes:
    return np.ascontiguousarray(x.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :5]).tobytes()


def _unpack5(x: bytes) -> np.ndarray:
    out = np.zeros((len(x) // 5, 8), np.uint8)
    out[:, :5] = np.frombuffer(x, np.uint8).reshape(-1, 5)
    return out.view("<u8").reshape(-1)


def shared_segments(docs: DataFrame, k: int, percent: int, parts: int) -> DataFrame:
    """(sig, cls, first): the classes of each segment content that two classes or more share.

    Tasks pack contents by part into binary rows; a part is looked through as sorted arrays. Of a
    content 40 bits are sent, beside the part that its upper bits name: contents confused by that
    are candidates more, which the exact intersection parts. A task sends a class once a row.
    """

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bands = Bands(percent)
        held, n_held, names, n_names, seen = [], 0, [], 0, set()

        def rows() -> pa.RecordBatch:
            keys, owner = np.concatenate([x[0] for x in held]), np.concatenate([x[1] for x in held])
            held.clear()
            order, at = common.split_by(common.part_of(keys, parts), parts)  # owners stay in order within a part
            keys, owner = keys[order], owner[order]
            table, out = np.concatenate(names), []
            for p in range(parts):
                own, times = np.unique(owner[at[p] : at[p + 1]], return_counts=True)
                if len(own):
                    out.append((p, _pack5(keys[at[p] : at[p + 1]]), times.astype("<u2" if times.max() < 65536 else "<u4").tobytes(), table[own].tobytes()))
            names.clear()
            seen.clear()
            return pa.RecordBatch.from_arrays([pa.array([o[0] for o in out], pa.int32()), *[pa.array([o[i] for o in out], pa.binary()) for i in (1, 2, 3)]], names=["part", "keys", "times", "names"])

        for batch in batches:
            for _, values, at in _sets(batch["text"], k):
                name = class_keys(values, at)
                fresh = np.zeros(len(name), bool)
                for i, x in enumerate(name.tolist()):
                    if x not in seen:
                        seen.add(x)
                        fresh[i] = True
                key, row = signatures(values, at, bands, fresh)
                if not len(key):
                    continue
                held.append((key, (row + n_names).astype(np.int32)))
                names.append(name)
                n_names += len(name)
                n_held += len(key)
                if n_held > FLUSH:
                    yield rows()
                    n_held = n_names = 0
        if held:
            yield rows()

    def match(table: pa.Table) -> pa.Table:
        keys, owners = [], []
        for x, t, o in zip(table["keys"], table["times"], table["names"], strict=True):
            name, times = np.frombuffer(o.as_py(), "<i8"), t.as_py()
            times = np.frombuffer(times, "<u2" if len(times) == 2 * len(name) else "<u4")
            keys.append(_unpack5(x.as_py()))
            owners.append(np.repeat(name, times))
        keys, c = np.concatenate(keys), np.concatenate(owners)
        owners.clear()
        order = np.argsort(keys, kind="stable")
        keys, c = keys[order], c[order]
        same = np.zeros(len(keys), bool)
        same[1:] = keys[1:] == keys[:-1]
        same[:-1] |= same[1:]
        keys, c = keys[same], c[same]
        order = np.lexsort((c, keys))
        keys, c = keys[order], c[order]
        new = np.ones(len(keys), bool)
        new[1:] = (keys[1:] != keys[:-1]) | (c[1:] != c[:-1])
        keys, c = keys[new], c[new]
        starts = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]])) if len(keys) else np.zeros(0, np.int64)
        sizes = np.diff(np.append(starts, len(keys)))
        keep = np.repeat(sizes > 1, sizes)
        first = np.repeat(c[starts], sizes)[keep]
        sig = keys[keep].astype(np.int64) | (np.int64(table["part"][0].as_py()) << np.int64(40))
        return pa.table({"sig": pa.array(sig), "cls": pa.array(c[keep]), "first": pa.array(first)})

    packed = docs.select("text").mapInArrow(pack, "part int, keys binary, times binary, names binary")
    return packed.groupBy("part").applyInArrow(match, "sig long, cls long, first long")


def bitmap(values: np.ndarray) -> np.ndarray:
    """Hashed bits of a set: a power of two of them, twice its size or more, so that they tell large sets apart too."""
    bits = np.zeros(max(256, 1 << (2 * len(values) - 1).bit_length()), bool)
    bits[(values & np.uint64(len(bits) - 1)).astype(np.int64)] = True
    return np.packbits(bits, bitorder="little").view(np.uint64)


def folded(bits: np.ndarray, words: int) -> np.ndarray:
    """Rows of longer bitmaps as the bitmaps of that many words that their sets would have."""
    while bits.shape[1] > words:
        half = bits.shape[1] // 2
        bits = bits[:, :half] | bits[:, half:]
    return bits


def link_tile(size: np.ndarray, bits: list[np.ndarray], percent: int, sets: list[np.ndarray] | None = None) -> np.ndarray:
    """Component of each set of a tile, by sizes and bitmaps, under links of pairs that may reach
    percent/100 by the bound, or, with the sets given, that do.

    A pair already connected is not looked at again.
    """
    order = np.argsort(size, kind="stable")
    size, bits = size[order], [bits[i] for i in order]
    root = np.arange(len(size))
    # Longer bitmaps belong to larger sets, so those of one length stand together.
    length = np.array([len(x) for x in bits])
    starts = np.flatnonzero(np.concatenate([[True], length[1:] != length[:-1]])) if len(bits) else np.zeros(0, int)
    stops = np.append(starts[1:], len(bits))
    levels = [np.stack(bits[a:b]) for a, b in zip(starts.tolist(), stops.tolist(), strict=True)]
    for level, (a, b) in enumerate(zip(starts.tolist(), stops.tolist(), strict=True)):
        # All sets from this length on that one of this length may link with, as bitmaps of this length.
        reach = int(np.searchsorted(size, size[b - 1] * 100 // percent, "right"))
        same = np.concatenate([folded(x, levels[level].shape[1]) for x, at in zip(levels[level:], starts[level:], strict=True) if at < reach])
        for i in range(a, b):
            # Larger sets of the size band: percent * larger <= 100 * smaller.
            hi = int(np.searchsorted(size, size[i] * 100 // percent, "right"))
            js = np.arange(i + 1, hi)
            js = js[root[js] != root[i]]
            if not len(js):
                continue
            apart = np.bitwise_count(same[js - a] ^ same[i - a]).sum(1, dtype=np.int64)
            most = (size[js] + size[i] - apart) // 2  # the overlap can't be larger
            for j in js[100 * most >= percent * (size[js] + size[i] - most)]:
                if root[j] == root[i]:
                    continue
                if sets is not None:
                    shared = len(np.intersect1d(sets[order[i]], sets[order[j]], assume_unique=True))
                    if 100 * shared < percent * (size[i] + size[j] - shared):
                        continue
                root[root == root[j]] = root[i]
    out = np.empty(len(size), np.int64)
    out[order] = root
    return out


def _tile_links(table: pa.Table, percent: int) -> pa.Table:
    """(a, b): links that span the components of the tile's classes, from bits or shingles."""
    cls, at = np.unique(table["cls"].to_numpy(), return_index=True)
    if "shingles" in table.column_names:
        sets = [np.frombuffer(table["shingles"][int(i)].as_py(), np.uint64) for i in at]
        size, bits = np.array([len(x) for x in sets]), [bitmap(x) for x in sets]
    else:
        sets, size = None, table["n"].to_numpy()[at]
        bits = [np.frombuffer(table["bits"][int(i)].as_py(), np.uint64) for i in at]
    comp = link_tile(size, bits, percent, sets)
    order = np.argsort(comp, kind="stable")
    comp, cls = comp[order], cls[order]
    first = np.concatenate([[True], comp[1:] != comp[:-1]])
    head = cls[np.maximum.accumulate(np.where(first, np.arange(len(cls)), 0))]
    return pa.table({"a": pa.array(head[~first]), "b": pa.array(cls[~first])})


def _dealt(groups: DataFrame, found: DataFrame, sizes: DataFrame, tile: int, room: int) -> tuple[DataFrame, DataFrame]:
    """(cls, root) of groups (node, root) that are one tile, and (cls, sig, x, y) of larger ones.

    A tile holds tile classes and room shingles at most. In a larger group, the classes of each
    segment content make tiles, one for each pair of blocks, each class in one block; contents with
    the same classes are taken once.
    """
    held = groups.withColumnRenamed("node", "cls").join(sizes, "cls")
    weight = held.groupBy("root").agg(F.count(F.lit(1)).alias("members"), F.sum("n").alias("weight"))
    fits = (F.col("members") <= tile) & (F.col("weight") <= room)
    marked = common.cut(held.join(weight.select("root", fits.alias("fits")), "root"))
    large = marked.where("not fits").select("cls", "n")
    rows = found.select("sig", "cls").join(large, "cls")
    alike = rows.groupBy("sig").agg(F.count(F.lit(1)).alias("members"), F.sum("n").alias("weight"), F.sum(F.xxhash64("cls").cast("decimal(38,0)")).alias("mark"))
    once = alike.where("members > 1").groupBy("members", "weight", "mark").agg(F.min("sig").alias("sig"))
    blocks = F.greatest(F.ceil(F.col("members") * 2 / F.lit(tile)), F.ceil(F.col("weight") * 2 / F.lit(room))).cast("int")
    rows = rows.join(once.select("sig", blocks.alias("blocks")), "sig")
    rows = rows.withColumn("block", F.pmod(F.xxhash64("cls"), F.col("blocks")).cast("int"))
    rows = rows.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    return marked.where("fits").select("cls", "root"), rows.select("cls", "sig", F.least("block", "other").alias("x"), F.greatest("block", "other").alias("y"))


def _spanning(small: DataFrame, large: DataFrame, facts: DataFrame, percent: int) -> tuple[DataFrame, DataFrame]:
    """(a, b): links that span the components in tiles as dealt, small and large, by facts (cls and bits or shingles)."""
    links = lambda t: _tile_links(t, percent)
    near = small.join(facts, "cls").groupBy("root").applyInArrow(links, "a long, b long")
    far = large.join(facts, "cls").groupBy("sig", "x", "y").applyInArrow(links, "a long, b long")
    return near, far


def _rooted(df: DataFrame, k: int, percent: int, id_col: str, text_col: str, tile: int, room: int = ROOM) -> DataFrame:
    """doc_id, mark, n_shingles, cls, root of every row of df: a hash of its text, its class and one
    class of its component; null for an empty set.
    """
    spark = df.sparkSession
    common.bound_batches(spark)
    docs = common.ensure_text(df, id_col, text_col).select("doc_id", "text", F.xxhash64(F.coalesce("text", F.lit(""))).alias("mark"))
    named = common.cut(classes(docs, k))
    found = common.cut(shared_segments(docs, k, percent, common.shuffle_parts(spark)))
    groups = connected(found.where("cls <> first").select(F.col("first").alias("a"), F.col("cls").alias("b")))
    # A class is represented by one row: the least of its ids, or any without one.
    one = named.where("cls is not null").groupBy("cls").agg(F.min("doc_id").alias("doc_id"), F.min("n_shingles").alias("n"), F.min("bits").alias("bits"))
    one = common.cut(one.join(groups.select(F.col("node").alias("cls")), "cls", "left_semi"))
    small, large = _dealt(groups, found, one.select("cls", "n"), tile, room)
    # Signatures alone: what the bound can't part.
    near, far = _spanning(small, large, one.select("cls", "n", "bits"), percent)
    near, far = common.cut(near), common.cut(far)
    # What the bound connects: a tile's links are stars already, those of larger groups go on from tile to tile.
    ends = near.select(F.col("a").alias("node"), F.col("a").alias("root")).unionByName(near.select(F.col("b").alias("node"), F.col("a").alias("root"))).distinct()
    may = common.cut(ends.unionByName(connected(far)))
    small, large = _dealt(may, found, one.select("cls", "n"), tile, room)
    wanted = one.join(may.select(F.col("node").alias("cls")), "cls", "left_semi")

    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        common.trim()
        sent: set[int] = set()
        for batch in batches:
            for _, values, at in _sets(batch["text"], k):
                keys = class_keys(values, at)
                # Rows of one text share an id where it is null or repeated: a task sends a class's set once.
                own = [i for i in np.flatnonzero(np.diff(at)).tolist() if not ((c := int(keys[i])) in sent or sent.add(c))]
                yield pa.RecordBatch.from_arrays([pa.array(keys[own]), pa.array([values[at[i] : at[i + 1]].tobytes() for i in own], pa.binary())], names=["cls", "shingles"])
                if len(sent) > FLUSH:
                    sent.clear()

    h = F.xxhash64("doc_id")
    some = common.among(docs.select("doc_id", "text"), h, wanted.select(h.alias("h")), "met").where("met")
    held = some.select("text").mapInArrow(sets, "cls long, shingles binary")
    near, far = _spanning(small, large, held, percent)
    joined = connected(near.unionByName(far))
    rows = named.drop("bits").join(joined.withColumnRenamed("node", "cls"), "cls", "left")
    return rows.withColumn("root", F.coalesce("root", "cls"))


def near_duplicates(df: DataFrame, k: int = 5, percent: int = 80, id_col: str = "doc_id", text_col: str = "text", tile: int = TILE) -> DataFrame:
    """doc_id, n_shingles, component_id of every row of df.

    A row's set is its distinct shingles of k words, A-Z lower-cased; fewer words are one shingle,
    none (or null text) an empty set that links with nothing. Rows link when the Jaccard
    similarity of their sets is percent/100 or more; component_id is the smallest id that links
    reach, a row's own included. Rows with a null id don't name a component but connect others;
    if no row of a component has an id it is null. Repeated rows are one class. An empty table
    gives no rows.
    """
    rows = _rooted(df, k, percent, id_col, text_col, tile)
    least = rows.where("cls is not null").groupBy("root").agg(F.min("doc_id").alias("component_id"))
    return rows.join(least, "root", "left").select("doc_id", "n_shingles", F.coalesce("component_id", "doc_id").alias("component_id"))


def keep_one(df: DataFrame, k: int = 5, percent: int = 80) -> DataFrame:
    """The rows of df without near-duplicates: of each component one row, the first by doc_id, null last, then class.

    Different texts under one id are documents of their own. Texts without words are in no
    component and stay, once for each id that isn't null. Null text is a text without words; an
    empty table gives no rows; columns of any name stay as they are. Rows that are alone in their
    component pass without a shuffle: a fixed number of bits tells which rows can't be among the
    others, and those others are looked up exactly.
    """
    names = df.columns
    rows = _rooted(df, k, percent, "doc_id", "text", TILE)
    # A row without words stands for itself and its id; without an id too, it isn't compared.
    rows = rows.where("cls is not null or doc_id is not null")
    rows = rows.select(F.col("doc_id").isNull().alias("noid"), F.coalesce("doc_id", F.lit(0)).alias("id"), F.coalesce("cls", F.lit(0)).alias("cls"), "mark", F.when(F.col("cls").isNull(), F.col("doc_id")).alias("bare"), "root")
    group = rows.groupBy("root", "bare").agg(F.count(F.lit(1)).alias("members"), F.min(F.struct("noid", "id", "cls", "mark")).alias("first")).where("members > 1")
    same = F.col("r.root").eqNullSafe(F.col("g.root")) & F.col("r.bare").eqNullSafe(F.col("g.bare"))
    held = rows.alias("r").join(group.alias("g"), same)
    held = common.cut(held.select("r.noid", "r.id", "r.mark", (F.struct("r.noid", "r.id", "r.cls", "r.mark") == F.col("g.first")).alias("stays")).groupBy("noid", "id", "mark").agg(F.max("stays").alias("stays")))
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    key = ["noid", "id", "mark"]
    own = df.select(F.struct(*[F.col(f"`{c}`") for c in names]).alias("row"), F.col("doc_id").isNull().alias("noid"), F.coalesce(F.col("doc_id").cast("long"), F.lit(0)).alias("id"), F.xxhash64(text).alias("mark"), (F.col("doc_id").isNotNull() | text.rlike(common.WORD)).alias("compared"))
    own = common.among(own, F.xxhash64(*key), held.select(F.xxhash64(*key).alias("h")), "met").withColumn("met", F.col("met") & F.col("compared"))
    # Rows of one id and text are always among those held, so none but those are folded here.
    others = own.where("met").dropDuplicates(key).join(held.hint("merge"), key, "left").where(F.coalesce("stays", F.lit(True)))
    whole = own.where("not met").select("row").unionByName(others.select("row"))
    return whole.select(*[F.col("row")[c].alias(c) for c in names])


def op8_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(common.table(spark, sf_dir, "documents"), k=3, percent=90)
