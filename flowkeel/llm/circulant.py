"""Near-duplicate groups by circulant MinHash, with exact confirmation.

Two permutations of 2^21 bins make the whole signature: the first scatters the shingle
hashes, the second is read from a document's bins onwards, coordinate k being the
minimum of the second permutation shifted by k. A bin's coordinates are thus one
contiguous slice. Bands of the signature name candidates; every candidate is
confirmed on the full shingle sets.

Defined cases: null and white-space-only texts have no shingles and are linked with
nothing, each its own group. Equal shingle sets are one node, so exact copies and repeated
rows share a group and never multiply. A null id never leads a group with other ids. The
input may carry any further columns, which are not read.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from functools import lru_cache
from itertools import count

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from flowkeel.llm import text as T
from flowkeel.llm.frames import same_row, sieved, sized
from flowkeel.llm.graph import components
from flowkeel.session import bucketed, fresh_path, materialise, ship_package

BINS = 1 << 21
ROWS = 5
MISS = 1e-7
MEETINGS = 16
#: Hubs that are broadcast, of about 250 bytes each.
HUB_ROWS = 10_000


def bands_for(percent: int, rows: int = ROWS, miss: float = MISS) -> int:
    """Bands needed to overlook a pair at the threshold with probability `miss`."""
    return math.ceil(math.log(miss) / math.log(1 - (percent / 100) ** rows))


@lru_cache(maxsize=2)
def permutations(width: int) -> tuple[np.ndarray, np.ndarray]:
    rng = np.random.default_rng(8191)
    scatter = rng.permutation(BINS).astype(np.int32)
    order = rng.permutation(BINS).astype(np.int32)
    return scatter, np.concatenate([order, order[:width]])


def signatures(sets: np.ndarray, first: np.ndarray, width: int) -> np.ndarray:
    """One row of `width` minima per text; texts without shingles keep the largest value."""
    scatter, order = permutations(width)
    shifted = np.lib.stride_tricks.sliding_window_view(order, width)
    out = np.full((len(first) - 1, width), BINS, np.int32)
    bins = scatter[(sets >> np.uint64(43)).astype(np.int64)]
    owner = np.repeat(np.arange(len(first) - 1), np.diff(first))
    for lo in range(0, len(bins), 4096):
        own = owner[lo:lo + 4096]
        starts = np.flatnonzero(np.concatenate([[True], own[1:] != own[:-1]]))
        low = np.minimum.reduceat(shifted[bins[lo:lo + 4096]], starts, axis=0)
        rows = own[starts]
        out[rows] = np.minimum(out[rows], low)
    return out


def band_hashes(sig: np.ndarray, rows: int) -> np.ndarray:
    n, width = sig.shape
    parts = sig.reshape(n, width // rows, rows).astype(np.uint64) + np.uint64(1)
    return T.mix((parts * T.powers(0xA24BAED4963EE407, rows + 1)[1:]).sum(axis=2, dtype=np.uint64))


def set_keys(sets: np.ndarray, first: np.ndarray) -> list[bytes]:
    """128 bits naming a shingle set."""
    n = np.diff(first)
    total = [np.concatenate([np.zeros(1, np.uint64), np.cumsum(T.mix(sets * np.uint64(m)), dtype=np.uint64)])
             for m in (0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9)]
    pair = np.stack([T.mix((c[first[1:]] - c[first[:-1]]) + n.astype(np.uint64)) for c in total], axis=1)
    raw = np.ascontiguousarray(pair).tobytes()
    return [raw[16 * i:16 * i + 16] for i in range(len(n))]


def sketcher(width: int, rows: int, signer: Callable = signatures):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in T.blocks(batches, "text"):
            data, at = T.text_buffers(batch.column(2))
            sets, first = T.shingle_sets(*T.word_hashes(data, at))
            keys = band_hashes(signer(sets, first, width), rows).view(np.int64)
            n = np.diff(first)
            some = np.flatnonzero(n)
            where = np.concatenate([[0], np.cumsum(np.where(n > 0, keys.shape[1], 0))]).astype(np.int32)
            names = set_keys(sets, first)
            yield pa.RecordBatch.from_arrays([
                batch.column(0), batch.column(1), pa.array(n, pa.int64()),
                pa.array([k if m else None for k, m in zip(names, n, strict=True)], pa.binary()),
                pa.ListArray.from_arrays(pa.array(where), pa.array(keys[some].ravel()))],
                names=["doc_id", "text_hash", "n_shingles", "node", "bands"])
    return run


NAMED = "node binary, text string"


def name_sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Texts with the names of their shingle sets, as `sketcher` names them."""
    for batch in T.blocks(batches, "text"):
        sets, first = T.shingle_sets(*T.word_hashes(*T.text_buffers(batch.column(0))))
        yield pa.RecordBatch.from_arrays([pa.array(set_keys(sets, first), pa.binary()), batch.column(0)], names=["node", "text"])


INFO = "a binary, b binary, both long, size_a long, size_b long, differ array<long>"


def compared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sizes of a's and b's full sets and of what both have, and the shingles that only one of them has."""
    known, known_set = None, None
    for batch in T.blocks(batches, "text_b"):
        heads = batch.column(0).to_pylist()
        data, at = T.text_buffers(batch.column(3))
        sets, first = T.shingle_sets(*T.word_hashes(data, at))
        both, size_a, differ = np.zeros(len(heads), np.int64), np.zeros(len(heads), np.int64), []
        for i, head in enumerate(heads):
            if head != known:
                one = T.shingle_sets(*T.word_hashes(*T.text_buffers(batch.column(2).slice(i, 1))))
                known, known_set = head, one[0]
            other = sets[first[i]:first[i + 1]]
            near = np.minimum(np.searchsorted(known_set, other), len(known_set) - 1)
            same = known_set[near] == other
            both[i], size_a[i] = same.sum(), len(known_set)
            lacked = np.ones(len(known_set), bool)
            lacked[near[same]] = False
            differ.append(np.concatenate([other[~same], known_set[lacked]]))
        cuts = np.concatenate([[0], np.cumsum([len(d) for d in differ])]).astype(np.int32)
        yield pa.RecordBatch.from_arrays([
            batch.column(0), batch.column(1), pa.array(both), pa.array(size_a), pa.array(np.diff(first)),
            pa.ListArray.from_arrays(pa.array(cuts), pa.array(np.concatenate(differ).view(np.int64)))],
            names=["a", "b", "both", "size_a", "size_b", "differ"])


def compare(pairs: DataFrame, texts: DataFrame) -> DataFrame:
    """The pairs (a, b) of nodes with what their full sets have in common.

    `texts` has buckets of nodes and is not shuffled: the pairs come to it. From there b's text travels to a's key once
    per pair and the hubs' texts once; adaptive execution splits the rows of a hub that many pairs name.
    """
    b = texts.select(F.col("node").alias("b"), F.col("text").alias("text_b"))
    # Stored, the hubs' texts are without buckets, whose rows adaptive execution could not split.
    hubs = materialise(texts.join(pairs.select(F.col("a").alias("node")).distinct(), "node", "left_semi"), "hubs")
    a = hubs.select(F.col("node").alias("a"), F.col("text").alias("text_a"))
    return pairs.join(b, "b").join(a, "a").select("a", "b", "text_a", "text_b").mapInArrow(compared, INFO)


def mixed(members: DataFrame) -> DataFrame:
    """Members of the buckets that hold more than one component."""
    open_ = members.groupBy("band", "hash").agg(F.min("root").alias("lo"), F.max("root").alias("hi")).filter(
        F.col("lo") != F.col("hi")).select("band", "hash")
    return members.join(open_, ["band", "hash"], "left_semi")


def met_by_hubs(members: DataFrame) -> DataFrame:
    """What a bucket's hub has to meet, with the hub's name and whether the bucket stays open.

    The hub is the asking member with the largest buckets, or a member that alone stands apart from the
    bucket's only other component. A bucket is open while members that may still ask each other span components;
    in the hub's last meeting members of its own component have nothing to tell.
    """
    by_root = members.groupBy("band", "hash", "root").agg(F.count("*").alias("n"), F.max(F.struct("asks", "weight", "node", "root")).alias("best"))
    hubs = by_root.groupBy("band", "hash").agg(
        F.when(F.sum("n") - F.max("n") == 1, F.min_by("best", F.struct("n", "root"))).otherwise(F.max("best")).alias("h")).select(
        "band", "hash", F.col("h.node").alias("hub"), F.col("h.root").alias("hub_root"))
    rest = members.join(hubs, ["band", "hash"]).filter(F.col("node") != F.col("hub"))
    state = rest.groupBy("band", "hash").agg(((F.min("root") != F.max("root")) & F.max("asks")).alias("open"))
    return rest.join(state, ["band", "hash"]).filter(F.col("open") | (F.col("root") != F.col("hub_root"))).drop("hub_root")


def still_open(rest: DataFrame) -> DataFrame:
    """The members, each once for every hub it has met, of the open buckets that still span components."""
    return mixed(rest.filter("open")).select("hub", "node", "weight", "root").dropDuplicates(["hub", "node"])


def every_pair(members: DataFrame, most: int) -> DataFrame | None:
    """All pairs (a, b) that members may still link, if these are `most` or fewer.

    They are only listed where the buckets make at most `MEETINGS` times as many, as the same two meet in several buckets.
    """
    made = members.groupBy("band", "hash").agg(F.count("*").alias("n")).agg(F.sum(F.expr("n * (n - 1) div 2"))).first()[0] or 0
    if made > MEETINGS * most:
        return None
    a = members.select("band", "hash", F.col("node").alias("a"), F.col("root").alias("root_a"), F.col("asks").alias("asks_a"))
    b = members.select("band", "hash", F.col("node").alias("b"), F.col("root").alias("root_b"), F.col("asks").alias("asks_b"))
    pairs = materialise(a.join(b, ["band", "hash"]).filter("a < b and root_a <> root_b and (asks_a or asks_b)").select("a", "b").distinct(), "every")
    return pairs if pairs.count() <= most else None


def next_members(rest: DataFrame, info: DataFrame, percent: int, turn: int) -> DataFrame:
    """Who may still be linked across components once a bucket's hub has met all others, in new buckets.

    `rest` has the open buckets' members (`still_open`). Let D(x) be the shingles that x or the
    hub has but not both. What x and y differ in is what D(x) and D(y) differ in, so x and y are linked
    if and only if D(x) and D(y) have (g(x) + g(y)) / (2 * (100 + percent)) shingles in common, with
    g(x) = (100 + percent) * |D(x)| - (100 - percent) * |x|. That number is above 0 unless the hub
    links both. Two linked members meet in what stands first in both when D is taken in one order, all but so
    many; rare shingles come first. Of a pair the one with the smaller g asks, and knows that its partner's is not below; the
    other one answers, and allows for the least g of any other component. Shingles where nobody asks make no bucket. So what
    all share, or all have changed alike, brings nobody together, and copies that differ from a lost
    original each in their own way never meet.
    """
    # Members are as many as the corpus makes them, so they are not broadcast: bitmaps of their pairs keep the other pairs' differences out of the shuffle.
    asked = rest.withColumns({"a": F.least("hub", "node"), "b": F.greatest("hub", "node")})
    size = F.when(F.col("node") == F.col("a"), F.col("size_a")).otherwise(F.col("size_b"))
    one = asked.join(sieved(info, ["a", "b"], asked), ["a", "b"]).select(
        "hub", "node", "weight", "root", "differ", F.size("differ").alias("n"), ((100 + percent) * F.size("differ") - (100 - percent) * size).alias("g"))
    one = materialise(one.withColumn("id", F.monotonically_increasing_id()), "seen")
    by_root = one.groupBy("hub", "root").agg(F.min("g").alias("g"))
    lowest = by_root.withColumn("nth", F.row_number().over(Window.partitionBy("hub").orderBy("g", "root"))).filter("nth <= 2")
    two = F.struct("g", "root")
    hubs = lowest.groupBy("hub").agg(F.min(two).alias("first"), F.max(two).alias("second"), F.count("*").alias("roots")).filter("roots = 2").drop("roots")
    least = F.when(F.col("root") == F.col("first.root"), F.col("second.g")).otherwise(F.col("first.g"))

    def reach(partner):
        return F.col("n") - F.ceil((F.col("g") + partner) / F.lit(2 * (100 + percent))) + 1

    able = one.join(sized(hubs, HUB_ROWS), "hub").withColumns({"answers": reach(least), "asking": reach(F.greatest("g", least))}).filter("answers > 0")
    own = able.select("id", "hub", F.explode("differ").alias("shingle")).select("id", F.xxhash64("hub", "shingle").alias("hash"))
    # What a member alone differs in comes first in its order and makes no bucket: it is counted (`n - common`) and not sent on.
    held = own.withColumn("holders", F.count("*").over(Window.partitionBy("hash"))).filter("holders > 1")
    each = Window.partitionBy("id")
    held = held.withColumns({"common": F.count("*").over(each), "nth": F.row_number().over(each.orderBy("holders", "hash"))})
    place = F.col("n") - F.col("common") + F.col("nth")
    outside = held.join(able.select("id", "node", "weight", "root", "n", "answers", "asking"), "id").filter(place <= F.col("answers")).select(
        F.lit(-1 - turn).alias("band"), "hash", "node", "weight", "root", (place <= F.col("asking")).alias("asks"))
    # Stored: what asks and what spans components is found from it without sending all differences again.
    outside = materialise(outside, "outside")
    asked = outside.groupBy("band", "hash").agg(F.max("asks").alias("any")).filter("any").select("band", "hash")
    return mixed(outside.join(asked, ["band", "hash"], "left_semi"))


def near_groups(docs: DataFrame, percent: int = 80, signer: Callable = signatures) -> DataFrame:
    """Groups of documents linked by 100 * intersection >= percent * union of 5-word shingles.

    Returns one row per row of `docs` (doc_id, text): doc_id, text_hash, n_shingles,
    group (hex; null where there is nothing to compare), component_id, kept.

    In a bucket of band-equal nodes only the hub, the node whose buckets are largest, meets
    the others; members that it links need no links among themselves. A bucket that still
    spans components gives up its hub, whose pairs are done. The others meet again only where
    they differ from the hub alike (`next_members`), in buckets with hubs of their own, until none
    spans components, or until all pairs left are at most twice those compared: these then are the last. No pair is compared twice, in either direction.
    """
    spark = docs.sparkSession
    ship_package(spark)
    rows, width = ROWS, bands_for(percent) * ROWS
    source = docs.select("doc_id", F.xxhash64("text").alias("text_hash"), "text")
    sketch = materialise(source.mapInArrow(
        sketcher(width, rows, signer), "doc_id long, text_hash long, n_shingles long, node binary, bands array<long>"), "sketch")
    nodes = materialise(sketch.filter("node is not null").groupBy("node").agg(
        F.min("doc_id").alias("lead"), F.min(F.struct("doc_id", "text_hash")).alias("rep"),
        F.any_value("bands").alias("bands")), "nodes")
    spread = nodes.select("node", F.posexplode("bands").alias("band", "hash"))
    sizes = materialise(spread.groupBy("band", "hash").agg(F.count("*").alias("m")).filter("m > 1"), "sizes")
    shared = materialise(sieved(spread, ["band", "hash"], sizes).join(sizes, ["band", "hash"]), "buckets")
    weight = shared.groupBy("node").agg(F.sum("m").alias("weight"))
    members = materialise(shared.drop("m").join(weight, "node").withColumns(
        {"root": F.col("node"), "asks": F.lit(True)}), "members")
    reps = nodes.join(weight.select("node"), "node", "left_semi").select(
        "node", F.col("rep.doc_id").alias("rid"), F.col("rep.text_hash").alias("rhash"))
    reps = materialise(reps, "reps")
    wanted = sieved(source, ["text_hash", "doc_id"], reps.select(F.col("rhash").alias("text_hash"), F.col("rid").alias("doc_id")))
    # Named anew, the texts go to their nodes' buckets at once, and not to their rows' ids before.
    texts = wanted.select("text").mapInArrow(name_sets, NAMED).join(reps.select("node"), "node", "left_semi").dropDuplicates(["node"])
    texts = bucketed(texts, "texts", int(spark.conf.get("spark.sql.shuffle.partitions")), "node")

    info = roots = None
    folders: list[str] = []
    for turn in count():
        pairs = every_pair(members, 2 * info.count()) if info is not None else None
        last = pairs is not None
        if last:
            pairs = pairs.select("a", "b", F.col("a").alias("lo"), F.col("b").alias("hi"))
        else:
            rest = materialise(met_by_hubs(members), "rest")
            pairs = rest.groupBy(F.least("hub", "node").alias("lo"), F.greatest("hub", "node").alias("hi")).agg(F.min("hub").alias("a")).withColumn(
                "b", F.when(F.col("a") == F.col("lo"), F.col("hi")).otherwise(F.col("lo")))
        if info is not None:
            known = info.select(F.col("a").alias("lo"), F.col("b").alias("hi"))
            pairs = pairs.join(known, ["lo", "hi"], "left_anti")
        # Stored, few pairs are sent to the texts, and not all texts to the pairs.
        pairs = materialise(pairs.select("a", "b"), "pairs")
        turned = F.col("a") > F.col("b")
        found = compare(pairs, texts).select(
            F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"), "both", F.when(turned, F.col("size_b")).otherwise(F.col("size_a")).alias("size_a"),
            F.when(turned, F.col("size_a")).otherwise(F.col("size_b")).alias("size_b"), "differ")
        folders.append(fresh_path(spark, "compared"))
        (found.drop("differ") if last else found).write.parquet(folders[-1])
        # One scan of all turns' folders: a union would make every turn's plans larger, and the driver compile them anew.
        info = spark.read.schema(found.schema).parquet(*folders)
        found = spark.read.schema(found.schema).parquet(folders[-1])
        linked = 100 * F.col("both") >= percent * (F.col("size_a") + F.col("size_b") - F.col("both"))
        if roots is None or found.filter(linked).limit(1).count():
            roots = components(info.filter(linked))
        if last or not rest.limit(1).count():
            break
        known = roots.withColumnRenamed("root", "new_root")
        rest = rest.drop("asks").join(known, "node", "left").withColumn("root", F.coalesce("new_root", "node")).drop("new_root")
        left = materialise(still_open(rest), "open")
        if not left.limit(1).count():
            break
        members = materialise(next_members(left, info, percent, turn), "members")
        if not members.limit(1).count():
            break

    grouped = nodes.select("node", "lead").join(roots, "node", "left").withColumn(
        "root", F.coalesce("root", "node"))
    leads = grouped.groupBy("root").agg(F.min("lead").alias("component"))
    named = grouped.join(leads, "root").select("node", "root", "component")
    return sketch.drop("bands").join(named, "node", "left").select(
        "doc_id", "text_hash", "n_shingles", F.lower(F.hex("root")).alias("group"),
        F.when(F.col("node").isNull(), F.col("doc_id")).otherwise(F.col("component")).alias("component_id"),
    ).withColumn("kept", F.col("doc_id").eqNullSafe(F.col("component_id")))


def one_per_group(docs: DataFrame, percent: int = 80) -> DataFrame:
    """The rows of docs, with all their columns, that lead their group; of equal rows one. Texts without words all stay.

    A group leads with its smallest id, or with one of its rows where none has an id.
    """
    found = materialise(near_groups(docs, percent).select("doc_id", "text_hash", "group"), "groups")
    first = F.min(F.struct(F.col("doc_id").isNull().alias("unknown"), "doc_id", "text_hash")).alias("first")
    leads = found.filter("group is not null").groupBy("group").agg(first).select("first.doc_id", "first.text_hash", F.lit(False).alias("free"))
    kept = leads.union(found.filter("group is null").select("doc_id", "text_hash", F.lit(True)).distinct())
    rows = docs.withColumn("text_hash", F.xxhash64("text"))
    both = rows.join(kept, same_row(rows, kept)).select(*[rows[c] for c in docs.columns], rows["text_hash"], "free")
    place = F.row_number().over(Window.partitionBy("doc_id", "text_hash").orderBy(F.lit(1)))
    return both.withColumn("_place", place).filter(F.col("free") | (F.col("_place") == 1)).select(*docs.columns)
