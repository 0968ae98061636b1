"""Near-duplicates: min-max hashing, exact confirmation, components.

Each text is the set of its distinct word shingles. Under every permutation both the minimum and the
maximum are kept, so a signature of N values costs N / 2 hash evaluations per shingle. Bands of the
signature find texts that may be alike; those meet again with their full sets, in groups of bounded
size, and only links that the full sets confirm count.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .bytesops import MIX, mix64, shingle_set, utf8_rows
from .common import discard, materialise, tidy
from .graph import connected_components
from .url_filter import build_filter, probe

SHINGLE = 5
#: Links: PERCENT * union <= 100 * intersection.
PERCENT = 85
#: Permutations of a band (2 values each), and the share of pairs right at the threshold that may meet in no band.
PERMUTATIONS_PER_BAND, MISSED = 3, 1e-6
#: Shingles that a task holds of either side when full sets are compared (8 bytes each).
BLOCK_SHINGLES = 1 << 18
#: Bits for each id of the filter that says whose full sets are needed, and the filter's largest size (32 MB). Beyond, an id
#: gets fewer bits, down to LEAST_BITS; with yet more ids they are joined.
FILTER_BITS_PER_ID, MOST_FILTER, LEAST_BITS = 64, 1 << 28, 4
#: Band keys that more than one in so many rows share, and more rows than this, are joined apart: there are at most HOT_SHARE a band.
HOT_SHARE, LEAST_HOT = 2_000, 1_000
#: Rows of the plan for groups that are cut into blocks (some 50 bytes each) up to which it is sent to the tasks.
BROADCAST_PLAN = 100_000
#: Up to so many ids (8 bytes each) are sent to the tasks to leave rows out.
BROADCAST_IDS = 1 << 20


def bands_for(percent: int) -> int:
    """The fewest bands that keep to MISSED: 30 at 85 % (of pairs at 0.3, 2 in 100 meet), 46 at 80 %."""
    if not 50 <= percent <= 100:
        raise ValueError("similarities from 50 % to 100 %")
    return max(1, math.ceil(math.log(MISSED) / math.log1p(-((min(percent, 99) / 100) ** (2 * PERMUTATIONS_PER_BAND)))))


@cache
def _multipliers(bands: int) -> np.ndarray:
    return np.random.Generator(np.random.PCG64(7)).integers(1, 2**63, bands * PERMUTATIONS_PER_BAND, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def signature(s: np.ndarray, bands: int = bands_for(PERCENT)) -> np.ndarray:
    """2 * permutations values: minima and maxima of the set under each permutation x -> a * x modulo 2**64."""
    a = _multipliers(bands)[:, None]
    low = np.full(len(a), np.iinfo(np.uint64).max, np.uint64)
    high = np.zeros(len(a), np.uint64)
    for i in range(0, len(s), 2048):
        x = s[None, i : i + 2048] * a
        np.minimum(low, x.min(axis=1), out=low)
        np.maximum(high, x.max(axis=1), out=high)
    return np.stack([low, high])


def band_keys(s: np.ndarray, bands: int = bands_for(PERCENT)) -> np.ndarray:
    """One 64-bit key a band; the band's number is part of it."""
    sig = signature(s, bands).reshape(2, bands, PERMUTATIONS_PER_BAND)
    h = np.arange(1, bands + 1, dtype=np.uint64) * MIX[15]
    for side in range(2):
        for j in range(PERMUTATIONS_PER_BAND):
            h = mix64(h + sig[side, :, j] * MIX[3 * side + j])
    return h.view(np.int64)


def _lists(values: list[np.ndarray], nulls: bool = False) -> pa.Array:
    """An Arrow column of lists, empty ones as nulls if asked for."""
    offsets = np.concatenate(([0], np.cumsum([len(v) for v in values]))).astype(np.int32)
    flat = np.concatenate(values) if values else np.zeros(0, np.int64)
    mask = np.append(np.diff(offsets) == 0, False) if nulls else None
    return pa.ListArray.from_arrays(pa.array(offsets, mask=mask), pa.array(flat.astype(np.int64, copy=False)))


def signatures(docs: DataFrame, k: int = SHINGLE, percent: int = PERCENT) -> DataFrame:
    """(id, n, f1, f2, bands): set size, 128-bit hash of the set, band keys (null for the empty set)."""
    n_bands = bands_for(percent)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            n, f1, f2, bands = [], [], [], []
            for view in utf8_rows(b.column(1)):
                s = shingle_set(view, k)
                n.append(len(s))
                f1.append(int(np.bitwise_xor.reduce(mix64(s * MIX[5])).view(np.int64)) if len(s) else 0)
                f2.append(int(np.add.reduce(mix64(s * MIX[6])).view(np.int64)) if len(s) else 0)
                bands.append(band_keys(s, n_bands) if len(s) else s.view(np.int64))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(n, pa.int64()), pa.array(f1, pa.int64()), pa.array(f2, pa.int64()), _lists(bands, nulls=True)], names=["id", "n", "f1", "f2", "bands"])

    return docs.mapInArrow(tidy(run), "id long, n long, f1 long, f2 long, bands array<long>")


def id_filter(ids: DataFrame, bits: int) -> np.ndarray:
    """A bitmap of hashed ids. It only spares work: an id that is let through by chance does no harm."""
    spot = F.pmod(F.xxhash64("id"), F.lit(bits).cast("long"))
    words = ids.select(F.floor(spot / 64).cast("int").alias("word"), F.call_function("shiftleft", F.lit(1).cast("long"), F.pmod(spot, F.lit(64)).cast("int")).alias("bit"))
    rows = words.groupBy("word").agg(F.bit_or("bit").alias("bits")).toPandas()  # at most bits / 64 rows
    out = np.zeros(bits // 64, np.int64)
    out[rows["word"].to_numpy()] = rows["bits"].to_numpy()
    return out


def full_sets(docs: DataFrame, ids: DataFrame, k: int = SHINGLE) -> DataFrame:
    """(id, shingles) of the documents that the filter of ``ids`` lets through: all of ids, and some more by chance.

    The filter grows with the number of ids; past MOST_FILTER / LEAST_BITS ids the texts wanted are found by a join.
    """
    n = ids.count()
    bits = min(MOST_FILTER, max(1 << 16, 1 << int(FILTER_BITS_PER_ID * n).bit_length()))
    if LEAST_BITS * n > MOST_FILTER:
        docs, shared = docs.join(ids.select("id").distinct(), "id", "left_semi"), None
    else:
        shared = docs.sparkSession.sparkContext.broadcast(id_filter(ids, bits).tobytes())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        have = None if shared is None else np.frombuffer(shared.value, np.int64)
        for b in batches:
            spot = b.column(2).to_numpy()
            wanted = np.arange(len(spot)) if have is None else np.flatnonzero((have[spot >> 6] >> (spot & 63)) & 1)
            for at in range(0, len(wanted), 256):
                part = b.take(pa.array(wanted[at : at + 256]))
                yield pa.RecordBatch.from_arrays([part.column(0), _lists([shingle_set(v, k).view(np.int64) for v in utf8_rows(part.column(1))])], names=["id", "shingles"])

    spot = F.pmod(F.xxhash64("id"), F.lit(bits).cast("long"))
    return docs.select("id", "text", spot.alias("spot")).mapInArrow(tidy(run), "id long, shingles array<long>")


def band_groups(reps: DataFrame) -> DataFrame:
    """(a, b): every text that shares a band key with a text of smaller id, once for each such smallest id.

    Keys that a large share of the rows have (a large group of near copies) are few, and go to where the rows lie; the
    others are joined by shuffle, which no key can then dominate.
    """
    rows = reps.where("bands is not null").select("id", F.explode("bands").alias("key"))
    first = materialise(rows.groupBy("key").agg(F.min("id").alias("a"), F.count(F.lit(1)).alias("c")).where("c > 1"), "minhash-keys")
    least = max(LEAST_HOT, reps.count() // HOT_SHARE)
    hot, cold = first.where(F.col("c") > least).select("key", "a"), first.where(F.col("c") <= least).select("key", "a")
    here = rows.join(F.broadcast(hot.withColumnRenamed("a", "h")), "key", "left")
    near = here.where("h is not null").select("h", "id").union(here.where("h is null").select("id", "key").join(cold, "key").select("a", "id"))
    return near.toDF("a", "b").where("a <> b").distinct()


def _links(ids: np.ndarray, sets: list[np.ndarray], side: np.ndarray, percent: int) -> list[tuple[int, int]]:
    """A spanning forest of the confirmed links among the rows; of pairs on different sides if there are two.

    Of two sets that are linked, either shares percent / 100 of its shingles with the other. So they meet among the rarest
    1 - percent / 100 (and one more) of either, in the order of rarity among the rows: only those are listed, by
    shingle and by tree of the forest, and a tree that a row has joined is passed over as a whole. Texts that share no
    more than a common passage are never compared, those of one tree hardly.
    """
    up = list(range(len(ids)))

    def top(x: int) -> int:
        while up[x] != x:
            up[x] = up[up[x]]
            x = up[x]
        return x

    out, two = [], len(set(side.tolist())) > 1
    if not len(ids):
        return out
    flat = np.concatenate(sets)
    _, code, count = np.unique(flat, return_inverse=True, return_counts=True)
    rank = np.empty(len(count), np.int64)
    rank[np.argsort(count, kind="stable")] = np.arange(len(count))
    ranks = np.split(rank[code], np.cumsum([len(s) for s in sets])[:-1])
    ranks = [np.sort(r) for r in ranks]
    size = [len(r) for r in ranks]
    listed: dict[int, dict[int, list[int]]] = {}
    sides = side.tolist()
    for i in sorted(range(len(ids)), key=lambda i: size[i]):
        tried: set[int] = set()
        mine = ranks[i][: size[i] - -(-size[i] * percent // 100) + 1].tolist()
        for g in mine:
            trees = listed.get(g)
            for tree, members in trees.items() if trees else ():
                if top(tree) == top(i):
                    continue
                for j in members:
                    if j in tried or two and sides[i] == sides[j] or size[j] * 100 < percent * size[i]:
                        continue
                    tried.add(j)
                    both = len(np.intersect1d(ranks[i], ranks[j], assume_unique=True))
                    if 100 * both >= percent * (size[i] + size[j] - both):
                        up[top(i)] = top(j)
                        out.append((int(ids[i]), int(ids[j])))
                        break
        home = top(i)
        for g in mine:
            listed.setdefault(g, {}).setdefault(home, []).append(i)
    return out


def confirmed_links(reps: DataFrame, sets: DataFrame, groups: DataFrame, percent: int = PERCENT) -> DataFrame:
    """(a, b): links between texts of one group, confirmed on the full sets, as many as connect what is linked.

    ``groups`` (id, component) says who meets whom at all. A group of more than BLOCK_SHINGLES shingles is cut by
    set size, into classes that a link can leave for a neighbouring class only, and each class into blocks by a
    hash of the id; a task compares two blocks. So no task holds more than two blocks, nobody is left out, and
    pairs are never rows: a text is a row for each block that its own block meets.
    """
    ratio = math.log(100 / percent) * (1 + 1e-6)  # a little wide, so that rounding cannot put linked sizes two classes apart
    cls = F.floor(F.log(F.col("n").cast("double")) / ratio).cast("long")
    member = reps.select("id", "n").join(groups, "id").select("id", "n", "component", cls.alias("cls"))
    sizes = member.groupBy("component", "cls").agg(F.sum("n").alias("total"))
    whole = sizes.groupBy("component").agg(F.sum("total").alias("total")).where(F.col("total") > BLOCK_SHINGLES).select("component")
    classes = sizes.join(whole, "component", "left_semi").select("component", "cls", F.ceil(F.col("total") / BLOCK_SHINGLES).cast("long").alias("blocks"))
    classes = materialise(classes, "minhash-blocks")
    near = lambda by, name: classes.select("component", (F.col("cls") - by).alias("cls"), F.col("blocks").alias(name))
    plan = classes.join(near(1, "above"), ["component", "cls"], "left").join(near(-1, "below"), ["component", "cls"], "left")
    # A row for each class of the groups that are cut, of which there are few: members look theirs up without being moved to their group.
    side = F.broadcast(plan) if classes.limit(BROADCAST_PLAN + 1).count() <= BROADCAST_PLAN else plan
    member = member.join(side, ["component", "cls"], "left").withColumn("mine", F.pmod(F.xxhash64("id"), F.col("blocks")))
    upto = lambda c, make: F.when(F.col(c) > 0, F.transform(F.sequence(F.lit(0).cast("long"), F.col(c) - 1), make)).otherwise(F.array().cast("array<struct<t:struct<component:bigint,cls:bigint,i:bigint,next:bigint,j:bigint>,side:int>>"))

    def spot(cls_, i, nxt, j, side):
        return F.struct(F.struct(F.col("component"), cls_.cast("long").alias("cls"), i.cast("long").alias("i"), F.lit(nxt).cast("long").alias("next"), j.cast("long").alias("j")).alias("t"), side.cast("int").alias("side"))

    own = upto("blocks", lambda x: spot(F.col("cls"), F.least("mine", x), 0, F.greatest("mine", x), F.when(F.col("mine") <= x, 0).otherwise(1)))
    # A block meets itself once, as one side.
    ups = upto("above", lambda x: spot(F.col("cls"), F.col("mine"), 1, x, F.lit(0)))
    downs = upto("below", lambda x: spot(F.col("cls") - 1, x, 1, F.col("mine"), F.lit(1)))
    alone = F.array(spot(F.lit(-1), F.lit(0), 0, F.lit(0), F.lit(0)))
    tasks = member.select("id", F.explode(F.when(F.col("blocks").isNull(), alone).otherwise(F.concat(own, ups, downs))).alias("s"))
    tasks = tasks.select("id", F.col("s.t").alias("task"), F.col("s.side").alias("side")).join(sets, "id")

    def compare(batches):
        t = pa.Table.from_batches(list(batches)) if not isinstance(batches, pa.Table) else batches
        ids = t.column("id").to_numpy()
        lists = t.column("shingles").combine_chunks()
        order = np.argsort(ids)
        links = _links(ids[order], [lists[int(i)].values.to_numpy() for i in order], t.column("side").to_numpy()[order], percent)
        return pa.table({"a": pa.array([a for a, _ in links], pa.int64()), "b": pa.array([b for _, b in links], pa.int64())})

    cols = tasks.select(F.xxhash64("task").alias("task"), "id", "side", "shingles")
    return cols.groupBy("task").applyInArrow(compare, "a long, b long")


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", percent: int = PERCENT, k: int = SHINGLE) -> DataFrame:
    """(id, n_shingles, component_id, kept) for every row of docs.

    Texts with fewer than k words are one shingle as a whole. Null, empty and blank texts have no shingles and are
    linked with nothing: each is its own component. Equal sets are found by a 128-bit hash, and one of each goes on.
    Ids are integers of any width, since the smallest names a component; others are an error. They are taken to be
    unique; rows that repeat an id are one document to the links, and each gets its row. A null id is kept and takes part in no link.
    """
    if dict(docs.dtypes)[id_col] not in ("tinyint", "smallint", "int", "bigint"):
        raise TypeError(f"{id_col}: near duplicates need integer ids, number the rows first")
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    sig = materialise(signatures(rows, k, percent), "minhash-signatures")
    classes = sig.where("n > 0 and id is not null").groupBy("f1", "f2", "n").agg(F.min("id").alias("id"), F.min_by("bands", "id").alias("bands"))
    reps = materialise(classes, "minhash-classes")
    loose = connected_components(band_groups(reps))
    links = materialise(confirmed_links(reps, full_sets(rows, loose.select("id"), k), loose, percent), "minhash-links")
    comp = connected_components(links)
    discard(loose, links)
    named = reps.join(comp, "id", "left").select("f1", "f2", F.col("n").alias("m"), F.coalesce("component", "id").alias("component"))
    joined = sig.join(named, (sig["f1"] == named["f1"]) & (sig["f2"] == named["f2"]) & (F.col("n") == F.col("m")) & (F.col("n") > 0) & F.col("id").isNotNull(), "left")
    comp_id = F.coalesce("component", "id")
    return joined.select(F.col("id").cast(docs.schema[id_col].dataType).alias(id_col), F.col("n").alias("n_shingles"), comp_id.alias("component_id"), F.coalesce(F.col("id") == comp_id, F.lit(True)).alias("kept"))


def without(docs: DataFrame, gone: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """docs less the rows whose id is in ``gone`` (id_col), nearly all of them judged where they lie: texts do not move.

    Up to BROADCAST_IDS ids are sent to the tasks. More go into a blocked Bloom filter; what it turns away stays at once, and
    only possible hits, nearly all of which go, are joined exactly. Rows with a null id stay; an empty ``gone`` changes nothing.
    """
    gone = materialise(gone.select(F.col(id_col).alias("key")).where("key is not null").distinct(), "gone-ids")
    n = gone.count()
    listed, match = gone.withColumnRenamed("key", "__gone"), F.col("__id") == F.col("__gone")
    rows = docs.withColumn("__id", F.col(id_col))
    if n <= BROADCAST_IDS:
        return rows.join(F.broadcast(listed), match, "left_anti").drop("__id")
    probed = probe(rows, "__id", *build_filter(gone, n))
    rest = probed.where("not __possible").select(*docs.columns)
    return rest.unionByName(probed.where("__possible").join(listed, match, "left_anti").select(*docs.columns))
