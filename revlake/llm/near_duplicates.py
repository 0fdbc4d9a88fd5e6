"""Near duplicates by a MinHash LSH forest, confirmed on the full shingle sets.

1. Every document's set of word shingles gives a digest and a signature of 128 minima. Documents
   with one digest form a class; one member stands for it from here on.
2. Forest: 32 orders of the signature, each beginning at another place. Sorted by an order, classes that
   share a prefix of four minima, a region, lie together; neighbours in a region are candidates.
   The sort goes on beyond the prefix, so that in crowded regions the neighbours are those with the
   longest common prefix: the depth follows the region. Classes of a similarity of 0.8 share a region
   of some order except with a probability of (1 - 0.8^4)^32 < 5e-8.
3. Candidates whose signatures agree in 76 of 128 minima or more tie classes together to clusters. A
   region that then still holds several clusters is gone through again: all signatures outside its largest cluster
   are compared with all others of the region, in tiles of bounded size. So classes that share a region and agree are
   in one cluster, whatever lies between them. Classes of a similarity of 0.8 agree in fewer minima with a
   probability below 3e-8. A cluster only says where links can be.
4. Inside a cluster all links are decided on the full sets. Large clusters are dealt out in blocks with
   a few members in common. What is not in a cluster's largest component is then dealt out in pieces of a
   block's size, and every piece meets every block in a task of its own, which holds these two only. So
   every pair is compared except those known to be connected.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import materialize
from .components import components
from .words import Words, bounded_batches, mix, rows_of, shingles

MINIMA, ORDERS, PREFIX = 128, 32, 4
AGREE = 76  # of MINIMA
#: Signatures of a region that a task compares with as many others.
REGION = 2048
#: Up to so many regions (under 50 bytes each) are broadcast to the classes.
SENT_REGIONS = 200_000
#: Members of a cluster that one task compares, and members that all blocks of a larger one share.
BLOCK, SHARED = 1500, 24
#: Shingles of such a block together, unless a single set has more.
BLOCK_SHINGLES = 2_000_000
#: Up to so many members of clusters (under 100 bytes each) are broadcast to the texts.
SENT_MEMBERS = 200_000
_RANDOM = np.random.default_rng(99)
_A = (_RANDOM.integers(0, 2**32, MINIMA, dtype=np.uint32) | np.uint32(1))[:, None]
_B = _RANDOM.integers(0, 2**32, MINIMA, dtype=np.uint32)[:, None]


def _signature(own: np.ndarray) -> np.ndarray:
    """128 minima of a set of 64-bit hashes, in pieces of bounded size."""
    low = (own >> np.uint64(32)).astype(np.uint32)
    out = np.full(MINIMA, 2**32 - 1, np.uint32)
    for at in range(0, len(low), 2048):
        part = low[None, at : at + 2048] * _A
        part += _B
        part ^= part >> np.uint32(15)
        part *= np.uint32(0x2C1B3C6D)
        np.minimum(out, part.min(axis=1), out=out)
    return out


def _sets(column: pa.Array, size: int) -> Iterator[np.ndarray]:
    words = Words(column, lower=True)
    h, number = shingles(words.hashes(), words.per_row, size)
    return (np.unique(r) for r in rows_of(h, number))


def signatures(docs: DataFrame, size: int) -> DataFrame:
    """doc_id, th, n (set size), d1 and d2 (digest), low (a byte of each minimum) and keys (hash of each order's prefix)."""
    bounded_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n, d1, d2, low, keys = [], [], [], [], []
            for own in _sets(batch.column(2), size):
                n.append(len(own))
                d1.append(int(np.bitwise_xor.reduce(own).view(np.int64)) if len(own) else 0)
                d2.append(int(mix(own ^ np.uint64(0x5851F42D4C957F2D)).sum().view(np.int64)) if len(own) else 0)
                sig = _signature(own)
                low.append((sig >> np.uint32(12)).astype(np.uint8).tobytes())
                wide = sig.astype(np.uint64).reshape(ORDERS, PREFIX)
                key = np.arange(ORDERS, dtype=np.uint64)
                for k in range(PREFIX):
                    key = mix(key * np.uint64(0x9E3779B97F4A7C15) + wide[:, k])
                keys.append(key.view(np.int64))
            flat = np.concatenate(keys) if keys else np.zeros(0, np.int64)
            ends = pa.array(np.arange(len(n) + 1) * ORDERS, pa.int32())
            columns = [
                batch.column(0), batch.column(1), pa.array(n, pa.int64()), pa.array(d1, pa.int64()), pa.array(d2, pa.int64()),
                pa.array(low, pa.binary()), pa.ListArray.from_arrays(ends, pa.array(flat)),
            ]
            yield pa.record_batch(columns, ["doc_id", "th", "n", "d1", "d2", "low", "keys"])

    rows = docs.select("doc_id", F.xxhash64("text").alias("th"), "text")
    kind = rows.schema["doc_id"].dataType.simpleString()
    return rows.mapInArrow(run, f"doc_id {kind}, th long, n long, d1 long, d2 long, low binary, keys array<long>")


def _neighbours(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Pairs of classes next to each other in a sorted order, if they share a prefix; the task's ends as pairs with themselves."""
    part = TaskContext.get().partitionId()
    tail = np.zeros((2, 0), np.int64)

    def ends(key: np.ndarray, own: np.ndarray, side: int) -> pa.RecordBatch:
        return pa.record_batch([pa.array(own), pa.array(own), pa.array(key), pa.array([2 * part + side])], ["u", "v", "key", "place"])

    for batch in batches:
        if not batch.num_rows:
            continue
        key = np.r_[tail[0], batch.column(0).to_numpy(zero_copy_only=False)]
        own = np.r_[tail[1], batch.column(1).to_numpy(zero_copy_only=False)]
        if not tail.size:
            yield ends(key[:1], own[:1], 0)
        near = np.flatnonzero(key[:-1] == key[1:])
        pair = own[near], own[near + 1]
        none = pa.nulls(len(near), pa.int64())
        yield pa.record_batch([pa.array(np.maximum(*pair)), pa.array(np.minimum(*pair)), pa.array(key[near]), none], ["u", "v", "key", "place"])
        tail = np.stack([key[-1:], own[-1:]])
    if tail.size:
        yield ends(tail[0], tail[1], 1)


def _agreeing(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Whether the signatures of pairs agree often enough."""
    for batch in batches:
        if not batch.num_rows:
            continue
        a, b = (np.frombuffer(b"".join(batch.column(k).to_pylist()), np.uint8).reshape(-1, MINIMA) for k in (2, 3))
        yield pa.record_batch([*batch.columns[:2], pa.array((a == b).sum(axis=1) >= AGREE)], ["u", "v", "agree"])


def region_ties(label: np.ndarray, low: np.ndarray, probe: np.ndarray) -> list[tuple[int, int]]:
    """Pairs of a probe and another row that agree, as many as are needed to join all labels that have such a pair."""
    label, ties, others = label.copy(), [], np.flatnonzero(~probe)
    for i in np.flatnonzero(probe):
        far = others[label[others] != label[i]]
        for j in far[(low[far] == low[i]).sum(axis=1) >= AGREE].tolist():
            if label[j] != label[i]:
                ties.append((int(i), j))
                label[label == label[j]] = label[i]
    return ties


def _tiles(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (key, tile, cid, label, probe, low), sorted by key and tile: ties between the labels of each tile."""

    def decide(held: list[tuple]) -> pa.RecordBatch:
        cid, label, probe, low = zip(*held)
        ties = region_ties(np.array(label), np.frombuffer(b"".join(low), np.uint8).reshape(-1, MINIMA), np.array(probe))
        return pa.record_batch([pa.array([cid[pair[at]] for pair in ties], pa.int64()) for at in (0, 1)], ["u", "v"])

    at, held = None, []
    for batch in batches:
        for key, tile, *row in zip(*(c.to_pylist() for c in batch.columns)):
            if (key, tile) != at:
                if held:
                    yield decide(held)
                at, held = (key, tile), []
            held.append(row)
    if held:
        yield decide(held)


def _region_pairs(classes: DataFrame, open_pairs: DataFrame, roots: DataFrame) -> DataFrame:
    """(u, v): ties between clusters that share a region, for all regions of ``open_pairs`` (u, v in different clusters)."""
    spark = classes.sparkSession
    keys = classes.select("cid", "keys")
    both = open_pairs.join(keys.toDF("u", "keys_u"), "u").join(keys.toDF("v", "keys_v"), "v")
    regions = materialize(both.select(F.explode(F.array_intersect("keys_u", "keys_v")).alias("key")).distinct(), "regions")
    few = regions.count() <= SENT_REGIONS
    labelled = classes.select("cid", "low", "keys").join(roots.toDF("cid", "root"), "cid", "left")
    labelled = labelled.select("cid", "low", F.coalesce("root", "cid").alias("label"), F.explode("keys").alias("key"))
    members = materialize(labelled.join(F.broadcast(regions) if few else regions, "key", "left_semi"), "region_members")

    sizes = members.groupBy("key", "label").agg(F.count("*").alias("n"))
    sizes = sizes.groupBy("key").agg(F.sum("n").alias("m"), F.max("n").alias("most"), F.max_by("label", F.struct("n", "label")).alias("main"))
    blocks, pieces = (F.ceil(n / F.lit(REGION)).cast("int") for n in (F.col("m"), F.col("m") - F.col("most")))
    sizes = materialize(sizes.filter("m > most").select("key", "main", blocks.alias("blocks"), pieces.alias("pieces")), "region_sizes")
    placed = members.join(F.broadcast(sizes) if few else sizes, "key")
    home, piece = F.pmod(F.xxhash64("cid"), F.col("blocks")), F.pmod(F.xxhash64("cid", F.lit(1)), F.col("pieces"))
    every_block, every_piece = (F.explode(F.sequence(F.lit(0).cast("bigint"), F.col(c).cast("bigint") - 1)) for c in ("blocks", "pieces"))
    own = placed.select("key", home.alias("block"), every_piece.alias("piece"), "cid", "label", F.lit(False).alias("probe"), "low")
    outside = placed.filter("label <> main").select("key", every_block.alias("block"), piece.alias("piece"), "cid", "label", F.lit(True).alias("probe"), "low")
    tile = (F.shiftleft("block", 32) + F.col("piece")).alias("tile")
    rows = own.unionByName(outside).select("key", tile, "cid", "label", "probe", "low")
    dealt = rows.repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), "key", "tile").sortWithinPartitions("key", "tile", "cid", "probe")
    return dealt.mapInArrow(_tiles, "u long, v long")


def clusters(classes: DataFrame) -> DataFrame:
    """(node, root): classes tied together by candidates of the forest."""
    spark = classes.sparkSession
    following = F.transform(
        F.sequence(F.lit(0), F.lit(ORDERS - 1)),
        lambda t: F.struct(
            F.get("keys", t).alias("key"),
            F.get("keys", (t + 1) % ORDERS).alias("k2"), F.get("keys", (t + 2) % ORDERS).alias("k3"),
        ),
    )
    rows = classes.select("cid", F.inline(following)).select("key", "cid", "k2", "k3")
    ordered = rows.repartitionByRange(int(spark.conf.get("spark.sql.shuffle.partitions")), "key", "k2", "k3", "cid").sortWithinPartitions("key", "k2", "k3", "cid")
    near = materialize(ordered.select("key", "cid").mapInArrow(_neighbours, "u long, v long, key long, place long"), "neighbours")
    # a region can go on in the next task: two rows of each task, in the order of the tasks
    follow = Window.orderBy("place")
    ends = near.filter("place IS NOT NULL").select("u", F.lead("u").over(follow).alias("v"), "key", F.lead("key").over(follow).alias("next_key"))
    across = ends.filter("key = next_key AND u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    pairs = near.filter("place IS NULL AND u <> v").select("u", "v").unionByName(across).distinct()
    low = classes.select("cid", "low")
    tried = pairs.join(low.toDF("u", "low_u"), "u").join(low.toDF("v", "low_v"), "v")
    tried = tried.select("u", "v", "low_u", "low_v").mapInArrow(_agreeing, "u long, v long, agree boolean")
    tried = materialize(tried, "tried")
    found = components(tried.filter("agree").select("u", "v"))
    at_u, at_v = found.toDF("u", "root_u"), found.toDF("v", "root_v")
    apart = tried.filter("NOT agree").join(at_u, "u", "left").join(at_v, "v", "left")
    apart = apart.filter(F.coalesce("root_u", "u") != F.coalesce("root_v", "v")).select("u", "v")
    apart = materialize(apart, "apart")
    if apart.isEmpty():
        return found
    more = _region_pairs(classes, apart, found)
    return components(found.toDF("u", "v").unionByName(more))


class _Block:
    """Sets of one block with an inverted index; finds all documents that one is linked with."""

    def __init__(self, sets: list[np.ndarray], percent: int):
        self.size = np.array([len(s) for s in sets])
        self.percent = percent
        doc = np.repeat(np.arange(len(sets)), self.size)
        _, term = np.unique(np.concatenate(sets), return_inverse=True)
        self.terms = np.split(term, np.cumsum(self.size)[:-1])
        self.postings = doc[np.argsort(term, kind="stable")]
        self.ends = np.cumsum(np.bincount(term))

    def linked(self, i: int) -> np.ndarray:
        t = self.terms[i]
        end = self.ends[t]
        count = end - np.where(t > 0, self.ends[t - 1], 0)
        at = np.arange(count.sum()) + np.repeat(end - np.cumsum(count), count)
        common = np.bincount(self.postings[at], minlength=len(self.size))
        return np.flatnonzero(100 * common >= self.percent * (self.size[i] + self.size - common))


def block_components(sets: list[np.ndarray], percent: int, probes: np.ndarray | None = None) -> np.ndarray:
    """Component number (smallest member) of each set by all its links; with ``probes``, by theirs only."""
    label = np.arange(len(sets))
    if len(sets) < 2:
        return label
    block, done = _Block(sets, percent), np.zeros(len(sets), bool)
    if probes is not None:
        for i in probes:
            label = _joined(label, block.linked(i))
        return label
    while True:
        main = np.bincount(label).argmax()  # links inside it need no search
        rest = np.flatnonzero((label != main) & ~done)
        if not len(rest):
            return label
        done[rest[0]] = True
        label = _joined(label, block.linked(rest[0]))


def _joined(label: np.ndarray, linked: np.ndarray) -> np.ndarray:
    own = np.unique(label[linked])
    return np.where(np.isin(label, own), own[0], label) if len(own) > 1 else label


def _compare(percent: int):
    """Rows (root, block, cid, probe, shingles), sorted by block: each block's classes with the smallest of their component."""

    def decide(cids: list[int], probes: list[bool], sets: list[np.ndarray]) -> pa.RecordBatch:
        own = np.array(cids)
        order = np.argsort(own, kind="stable")
        chosen = np.flatnonzero(np.array(probes)[order]) if any(probes) else None
        label = block_components([sets[k] for k in order], percent, chosen)
        own = own[order]
        return pa.record_batch([pa.array(own), pa.array(own[label])], ["u", "v"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, cids, probes, sets = None, [], [], []
        seen = set()
        for batch in batches:
            roots, blocks, own, probe = (batch.column(k).to_pylist() for k in range(4))
            lists = batch.column(4)
            ends, flat = np.asarray(lists.offsets), np.asarray(lists.values)
            for k in range(batch.num_rows):
                if (roots[k], blocks[k]) != at:
                    if cids:
                        yield decide(cids, probes, sets)
                    at, cids, probes, sets = (roots[k], blocks[k]), [], [], []
                    if at in seen:
                        raise ValueError(f"block {at} is not in one piece")
                    seen.add(at)
                cids.append(own[k])
                probes.append(probe[k])
                sets.append(flat[ends[k] : ends[k + 1]].copy())
        if cids:
            yield decide(cids, probes, sets)

    return run


def _blocks(rows: DataFrame, percent: int) -> DataFrame:
    ordered = rows.repartition(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")), "root", "block").sortWithinPartitions("root", "block")
    return ordered.select("root", "block", "cid", "probe", "shingles").mapInArrow(_compare(percent), "u long, v long")


def exact_labels(docs: DataFrame, classes: DataFrame, clustered: DataFrame, size: int, percent: int, block: int = BLOCK) -> DataFrame:
    """(cid, label) of the classes in clusters: label is the smallest class of the component of exact links."""
    bounded_batches(docs.sparkSession)
    clustered = materialize(clustered, "clusters")
    sized = clustered.withColumnRenamed("node", "cid").join(classes.select("cid", "n"), "cid")
    blocks = F.greatest(F.count("*") / block, F.sum("n") / F.lit(BLOCK_SHINGLES))
    many = sized.groupBy("root").agg(F.ceil(blocks).cast("int").alias("blocks"))
    inside = clustered.join(many, "root").select(F.col("node").alias("cid"), "root", "blocks")
    wanted = classes.join(inside, "cid").select("cid", "root", "blocks", F.col("rep").alias("doc_id"), "th")
    wanted = materialize(wanted, "members")
    texts = docs.select(F.col("doc_id").alias("id"), F.xxhash64("text").alias("hash"), "text")
    # short rows, counted: up to a bound they go to the texts, beyond it the texts are shuffled to them
    side = F.broadcast(wanted) if wanted.count() <= SENT_MEMBERS else wanted
    chosen = texts.join(side, texts["id"].eqNullSafe(wanted["doc_id"]) & (texts["hash"] == wanted["th"]))

    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            own = [s.view(np.int64) for s in _sets(batch.column(3), size)]
            ends = pa.array(np.cumsum([0, *map(len, own)]), pa.int32())
            flat = pa.array(np.concatenate(own) if own else np.zeros(0, np.int64))
            yield pa.record_batch([*batch.columns[:3], pa.ListArray.from_arrays(ends, flat)], ["cid", "root", "blocks", "shingles"])

    # a repeated row has the same text: one stands for its class
    full = chosen.select("cid", "root", "blocks", "text").dropDuplicates(["cid"]).mapInArrow(sets, "cid long, root long, blocks int, shingles array<long>")
    full = materialize(full, "sets")
    no = F.lit(False).alias("probe")
    small = full.filter("blocks = 1").select("root", F.lit(0).alias("block"), "cid", no, "shingles")
    labels = _blocks(small, percent)
    if wanted.filter("blocks > 1").isEmpty():
        return labels.toDF("cid", "label")

    large = full.filter("blocks > 1")
    home = F.pmod(F.xxhash64("cid"), F.col("blocks")).cast("int")
    all_blocks = F.sequence(F.lit(0), F.col("blocks") - 1)
    # members whose hash falls into a small share are in all blocks
    shared = F.pmod(F.xxhash64("cid", F.lit(1)), F.col("blocks") * block) < SHARED
    places = F.explode(F.when(shared, all_blocks).otherwise(F.array(home))).alias("block")
    first = materialize(_blocks(large.select("root", places, "cid", no, "shingles"), percent), "first")
    parts = components(first)
    found = large.select("cid", "root", F.size("shingles").alias("n")).join(parts.toDF("cid", "part"), "cid", "left")
    found = found.select("cid", "root", "n", F.coalesce("part", "cid").alias("part"))
    sizes = materialize(found.groupBy("root", "part").agg(F.count("*").alias("n")), "parts")
    main = sizes.groupBy("root").agg(F.max_by("part", F.struct("n", "part")).alias("main"))
    outside = found.join(main, "root").filter("part <> main").select("root", "cid", "n")
    pieces = F.greatest(F.count("*") / block, F.sum("n") / F.lit(BLOCK_SHINGLES))
    pieces = outside.groupBy("root").agg(F.ceil(pieces).cast("int").alias("pieces"))
    outside = outside.join(F.broadcast(pieces), "root").select("cid", F.pmod(F.xxhash64("cid", F.lit(2)), F.col("pieces")).cast("int").alias("piece"))
    # a row for each large cluster: small enough to send along
    all_pieces = F.sequence(F.lit(0), F.col("pieces") - 1)
    marked = large.join(F.broadcast(pieces), "root").join(outside, "cid", "left")
    # every tile, a piece and a block, has what is outside as probes; a member of both comes once
    guests = marked.filter("piece IS NOT NULL").select("root", F.explode(all_blocks).alias("block"), "piece", "cid", F.lit(True).alias("probe"), "shingles")
    own = marked.select("root", home.alias("block"), F.explode(all_pieces).alias("tile"), F.col("piece").alias("own_piece"), "cid", no, "shingles")
    own = own.filter("own_piece IS NULL OR own_piece <> tile")
    number = F.shiftleft(F.col("block").cast("long"), 32)
    own = own.select("root", (number + F.col("tile")).alias("block"), "cid", "probe", "shingles")
    guests = guests.select("root", (number + F.col("piece")).alias("block"), "cid", "probe", "shingles")
    # written, so that the blocks are dealt out anew whatever partitioning the plan above has
    again = materialize(own.unionByName(guests), "again")
    second = _blocks(again, percent)
    whole = components(first.unionByName(second))
    alone = large.select(F.col("cid").alias("u"), F.col("cid").alias("v"))
    big = alone.join(whole.toDF("u", "root"), "u", "left").select("u", F.coalesce("root", "v").alias("v"))
    return labels.unionByName(big).toDF("cid", "label")


def near_duplicates(docs: DataFrame, size: int = 5, percent: int = 80, block: int = BLOCK) -> DataFrame:
    """Components of documents whose sets of ``size``-word shingles have a Jaccard similarity of ``percent`` % or more.

    Words are lower-cased (A-Z); a text with fewer words than ``size`` is one shingle of its whole
    sequence. Returns doc_id, th (hash of the text), n_shingles, component_id (the smallest doc_id reachable) and kept
    (doc_id = component_id) for each row. Texts without words, empty and null texts have no shingle and
    are linked with nothing: their component is their own id. A null doc_id takes part in links but never
    names a component unless all its ids are null, and is kept only then. Repeated rows all keep their row and verdict.
    Other columns are not read. All tables of all documents stay in Spark.
    """
    rows = materialize(signatures(docs, size), "signatures")
    filled = rows.filter("n > 0")
    classes = filled.groupBy("d1", "d2").agg(
        F.min(F.struct(F.col("doc_id").isNull().alias("no"), "doc_id", "th")).alias("m"),
        F.first("n").alias("n"), F.first("low").alias("low"), F.first("keys").alias("keys"),
    )
    classes = classes.select(
        F.monotonically_increasing_id().alias("cid"), "d1", "d2", F.col("m.doc_id").alias("rep"), F.col("m.th").alias("th"), "n", "low", "keys"
    )
    classes = materialize(classes, "classes")  # fixes the numbers
    labels = exact_labels(docs, classes, clusters(classes), size, percent, block)
    named = classes.select("cid", "d1", "d2", "rep").join(labels, "cid", "left").withColumn("label", F.coalesce("label", "cid"))
    named = materialize(named, "labels")
    least = named.groupBy("label").agg(F.min("rep").alias("component_id"))
    ids = named.join(least, "label").select("d1", "d2", "component_id")
    full = rows.select("doc_id", "th", "n", "d1", "d2").join(ids.withColumn("found", F.lit(True)), ["d1", "d2"], "left")
    component = F.when(F.col("n") > 0, F.col("component_id")).otherwise(F.col("doc_id"))
    return full.select(
        "doc_id", "th", F.col("n").alias("n_shingles"), component.alias("component_id"),
        F.col("doc_id").eqNullSafe(component).alias("kept"),
    )


def drop_near_duplicates(docs: DataFrame, size: int = 5, percent: int = 80) -> DataFrame:
    """``docs`` with one document of each component of near duplicates, the one of the smallest doc_id.

    Repeated rows of that document stay with it; rows without words stay.
    """
    judged = near_duplicates(docs, size, percent)
    out = judged.filter("NOT kept").select(F.col("doc_id").alias("gone_id"), F.col("th").alias("gone_th")).distinct()
    out = materialize(out, "copies")
    same = docs["doc_id"].eqNullSafe(out["gone_id"]) & F.xxhash64(docs["text"]).eqNullSafe(out["gone_th"])
    return docs.join(out, same, "left_anti")
