"""MinHash near-duplicate detection: one-permutation hashing, bands, stars.

1. One pass over the texts gives each document the size and a 128-bit digest of
   its set of word shingles, and the hashes of its MinHash bands. The MinHash is
   one-permutation hashing (Li, Owen and Zhang, 2012) with optimal densification
   (Shrivastava, 2017).
2. Documents with equal sets form a class, which has a number of its own and
   goes on as one node. Classes that share a document id are one document's.
3. Band hashes are buckets. Each bucket links its members to one centre, the
   member that shares most buckets with others, so a bucket of m members gives
   m - 1 candidates and not m * (m - 1) / 2.
4. Candidates are confirmed on full shingle sets; confirmed links give
   components.
5. Where members of a bucket are still in different components, those outside
   the centre's component are compared with the others of its star, block
   against block. A member comes as its symmetric difference to the centre's
   set, which is short among near copies and gives any two members' intersection
   exactly. Only links are emitted, and of those only a spanning forest. So no
   pair that shares a bucket is lost, and no pairs are listed to find out.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import hot_limit, join_one_row_per_key, keep_ids, materialize, ship_package, text_buffer, text_pieces
from .graph import connected_components
from .shingles import distinct_shingles, mix

#: Bands and rows of each: a pair at similarity 0.8 shares no bucket with
#: probability (1 - 0.8 ** 5) ** 32 = 3e-6, one at 0.9 with 2e-13.
BANDS, BAND_ROWS = 32, 5
BINS = BANDS * BAND_ROWS
#: Members of a star in a block of step 5, and shingles of their sets.
BLOCK, BLOCK_SHINGLES = 256, 1 << 20
#: Shared tokens that a comparison of blocks holds at a time.
MATCHES = 1 << 19

_PROBES = np.random.default_rng(5).integers(0, BINS, (4096, BINS))


def _densify(minimum: np.ndarray, filled: np.ndarray) -> np.ndarray:
    """Give each empty bin the value of a filled one, drawn by its own probes."""
    if filled.sum() == 1:
        return np.full(BINS, minimum[filled.argmax()])
    out, empty, at = minimum.copy(), np.flatnonzero(~filled), 0
    while len(empty):
        hit = filled[_PROBES[at : at + 16, empty]]
        found = hit.any(axis=0)
        out[empty[found]] = minimum[_PROBES[at + hit.argmax(axis=0)[found], empty[found]]]
        empty, at = empty[~found], (at + 16) % len(_PROBES)
    return out


def band_hashes(shingles: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """One row of band hashes for each non-empty set of sorted shingle hashes."""
    rows = []
    for s, e in zip(offsets[:-1], offsets[1:]):
        if s == e:
            continue
        u = mix(shingles[s:e], 11)
        bins = ((u >> np.uint64(32)) % np.uint64(BINS)).astype(np.int64)
        minimum = np.full(BINS, np.uint64(2**64 - 1))
        np.minimum.at(minimum, bins, u)
        filled = np.zeros(BINS, bool)
        filled[bins] = True
        rows.append(minimum if filled.all() else _densify(minimum, filled))
    if not rows:
        return np.zeros((0, BANDS), np.uint64)
    out = np.array(rows).reshape(-1, BANDS, BAND_ROWS)
    with np.errstate(over="ignore"):
        total = np.arange(BANDS, dtype=np.uint64) * np.uint64(0x2545F4914F6CDD1D)
        for j in range(BAND_ROWS):
            total = mix(total + out[:, :, j], j + 20)
    return total


#: What tells a class: the size of its set and a digest of two numbers.
CLASS = ["d1", "d2", "n_shingles"]
_DIGEST = "doc_id bigint, n_shingles bigint, d1 bigint, d2 bigint"


def _digested(k: int, last: str, values):
    """The digest of each text's set, and what ``values`` makes of the sets."""
    schema = pa.schema([("doc_id", pa.int64()), ("n_shingles", pa.int64()), ("d1", pa.int64()), ("d2", pa.int64()), (last, pa.list_(pa.int64()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for piece in text_pieces(batches, "text"):
            shingles, offsets = distinct_shingles(*text_buffer(piece.column("text")), k)
            size = np.diff(offsets)
            some = size > 0
            sums = [np.zeros(len(size), np.uint64), np.zeros(len(size), np.uint64)]
            if some.any():
                for salt, out in enumerate(sums):
                    out[some] = np.add.reduceat(mix(shingles, 3 + salt), offsets[:-1][some])
            ends, listed = values(shingles, offsets)
            yield pa.RecordBatch.from_arrays([piece.column("doc_id"), pa.array(size, pa.int64()), pa.array(sums[0].view(np.int64)), pa.array(sums[1].view(np.int64)), pa.ListArray.from_arrays(pa.array(ends.astype(np.int32)), pa.array(listed.view(np.int64)))], schema=schema)

    return run


def _bands(shingles: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    ends = np.concatenate([[0], np.cumsum(np.diff(offsets) > 0) * BANDS])
    return ends, band_hashes(shingles, offsets).ravel()


def _sets(shingles: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    return offsets, shingles


def _with_sets(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """Pairs (a, b, spread, ...) with the full sets of both as (left, right).

    ``a`` may be the centre of a great many pairs. Its set is copied once for
    each sub-key, and a sub-key is made for about every 128 members of the
    buckets that gave the pairs.
    """
    part = F.pmod(F.xxhash64("b"), 1 + F.floor(F.col("spread") / 128)).cast("bigint")
    pairs = pairs.withColumn("sub", F.xxhash64("a", part))
    keys = pairs.groupBy("a", "sub").agg(F.count(F.lit(1)).alias("__n")).drop("__n")
    centres = keys.join(sets.select(F.col("rep").alias("a"), F.col("shingles").alias("left")), "a").select(F.col("sub").alias("s"), "left")
    members = pairs.join(sets.select(F.col("rep").alias("b"), F.col("shingles").alias("right")), "b")
    return members.join(centres, F.col("sub") == F.col("s")).drop("sub", "s")


def _confirm(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Pairs (a, b, spread) whose full sets reach the similarity, as (a, b)."""
    found = _with_sets(pairs, sets).withColumn("both", F.size(F.array_intersect("left", "right")))
    union = F.size("left") + F.size("right") - F.col("both")
    return found.filter(100 * F.col("both") >= percent * union).select("a", "b")


def _block_links(percent: int):
    """Links between the left and the right members of one pair of blocks."""

    def run(table: pa.Table) -> pa.Table:
        is_left = table.column("is_left").to_numpy()
        left, right = table.filter(pa.array(is_left)), table.filter(pa.array(~is_left))
        names = ("b", "root", "size")
        b, root, size = (left.column(c).to_numpy() for c in names)
        b2, root2, size2 = (right.column(c).to_numpy() for c in names)
        lists, lists2 = (t.column("delta").combine_chunks() for t in (left, right))
        far, far2 = (x.value_lengths().to_numpy().astype(np.int64) for x in (lists, lists2))
        token2, owner2 = lists2.flatten().to_numpy(), np.repeat(np.arange(len(b2)), far2)
        order = np.argsort(token2)
        token2, owner2 = token2[order], owner2[order]
        group: dict[int, int] = {}

        def top(x: int) -> int:
            while (up := group.get(x, x)) != x:
                group[x] = x = group.get(up, up)
            return x

        links = []
        token, owner = lists.flatten().to_numpy(), np.concatenate([[0], np.cumsum(far)])
        lo, n = np.searchsorted(token2, token), np.searchsorted(token2, token, "right")
        n -= lo
        matches = np.concatenate([[0], np.cumsum(n)])[owner]
        at = 0
        while at < len(b):
            # as many members at once as share MATCHES tokens with the others
            to = int(np.clip(np.searchsorted(matches, matches[at] + MATCHES, "right") - 1, at + 1, min(at + 64, len(b))))
            part, own = slice(at, to), slice(owner[at], owner[to])
            row = np.repeat(np.arange(to - at), np.diff(matches[at : to + 1]))
            place = np.repeat(lo[own] - (np.cumsum(n[own]) - n[own]), n[own]) + np.arange(len(row))
            shared = np.bincount(row * len(b2) + owner2[place], minlength=(to - at) * len(b2)).reshape(-1, len(b2))
            total = size[part, None] + size2[None, :]
            both = (total - (far[part, None] + far2[None, :] - 2 * shared)) // 2
            close = (100 * both >= percent * (total - both)) & (root[part, None] != root2[None, :])
            for i, j in zip(*np.nonzero(close)):
                one, two = top(int(root[at + i])), top(int(root2[j]))
                if one != two:
                    group[one] = two
                    links.append((b[at + i], b2[j]))
            at = to
        out = np.array(links, np.int64).reshape(-1, 2)
        return pa.table({"a": out[:, 0], "b": out[:, 1]})

    return run


def _centred(members: DataFrame, hot: int) -> DataFrame:
    """Members (rep, size, band, bucket, n, support) with their bucket's centre."""
    rank = F.struct("support", (-F.col("rep")).alias("low"), "size")
    first = members.groupBy("bucket").agg(F.max(rank).alias("c"), F.count(F.lit(1)).alias("in_bucket"))
    first = first.select("bucket", (-F.col("c.low")).alias("centre"), F.col("c.size").alias("c_size"), "in_bucket")
    return join_one_row_per_key(members, first, ["bucket"], "in_bucket", hot, "rep")


def _star_pairs(centred: DataFrame, percent: int) -> DataFrame:
    """(a, b, spread): each member with its centre, if their sizes allow a link."""
    near = centred.filter("rep <> centre").filter(100 * F.least("size", "c_size") >= percent * F.greatest("size", "c_size"))
    return near.groupBy(F.col("centre").alias("a"), F.col("rep").alias("b")).agg(F.max("n").alias("spread"))


def _rest(centred: DataFrame, roots: DataFrame, sets: DataFrame, hot: int, percent: int) -> DataFrame:
    """Links (a, b) across components that the stars did not show."""
    placed = centred.join(roots.withColumnRenamed("node", "rep"), "rep", "left").withColumn("root", F.coalesce("root", "rep"))
    mixed = placed.groupBy("bucket").agg(F.min("root").alias("lo"), F.max("root").alias("hi"), F.count(F.lit(1)).alias("rows")).filter("lo <> hi")
    placed = join_one_row_per_key(placed, mixed.select("bucket", "rows"), ["bucket"], "rows", hot, "rep")
    pairs = placed.groupBy(F.col("centre").alias("a"), F.col("rep").alias("b")).agg(F.max("n").alias("spread"), F.first("root").alias("root"), F.first("size").alias("size"))
    pairs = materialize(pairs, "apart")
    stars = pairs.groupBy("a").agg(F.count(F.lit(1)).alias("rows"), F.sum("size").alias("weight"), F.max(F.when(F.col("a") == F.col("b"), F.col("root"))).alias("a_root"))
    pairs = join_one_row_per_key(pairs, stars, ["a"], "rows", hot, "b")
    delta = F.concat(F.array_except("left", "right"), F.array_except("right", "left"))
    known = _with_sets(pairs, sets).select("a", "b", "root", "size", "rows", "weight", (F.col("root") != F.col("a_root")).alias("outside"), delta.alias("delta"))
    known = materialize(known, "differences")
    blocks = F.greatest(F.ceil(F.col("rows") / BLOCK), F.ceil(F.col("weight") / BLOCK_SHINGLES)).cast("bigint")
    own, every = F.pmod(F.xxhash64("b"), blocks), F.explode(F.sequence(F.lit(0).cast("bigint"), blocks - 1))
    columns = ["b", "root", "size", "delta"]
    left = known.filter("outside").select("a", own.alias("i"), every.alias("j"), F.lit(True).alias("is_left"), *columns)
    right = known.select("a", every.alias("i"), own.alias("j"), F.lit(False).alias("is_left"), *columns)
    return left.union(right).groupBy("a", "i", "j").applyInArrow(_block_links(percent), "a bigint, b bigint")


def _same_id(some: DataFrame, classes: DataFrame, hot: int) -> DataFrame:
    """Links (a, b) between the classes of rows that share a document id."""
    own = F.struct(*CLASS)
    clash = some.groupBy("doc_id").agg(F.min(own).alias("lo"), F.max(own).alias("hi")).filter("lo <> hi").select("doc_id")
    clash = materialize(clash, "clashes")
    if clash.isEmpty():
        return clash.select(F.col("doc_id").alias("a"), F.col("doc_id").alias("b"))
    rows = keep_ids(some, clash, "doc_id").select("doc_id", *CLASS).distinct()
    rows = materialize(rows.join(classes.select("rep", *CLASS), CLASS).select("doc_id", "rep"), "shared-ids")
    first = rows.groupBy("doc_id").agg(F.min("rep").alias("a"), F.count(F.lit(1)).alias("rows"))
    return join_one_row_per_key(rows, first, ["doc_id"], "rows", hot, "rep").select("a", F.col("rep").alias("b"))


def near_duplicates(docs: DataFrame, k: int = 5, percent: int = 80) -> DataFrame:
    """Group documents whose sets of k-word shingles are alike.

    Takes (doc_id bigint, text string, ...) and returns (doc_id, n_shingles,
    component_id, kept), one row for each row of ``docs``. Two documents are
    linked when 100 * intersection >= percent * union of their sets;
    ``component_id`` is the smallest id reachable, ``kept`` marks that document.
    Words are lower-cased (A-Z) runs without ASCII white space.

    A null or wordless text has the empty set and is linked with nothing. Rows
    that repeat an id are one document, linked with what any of its texts is
    linked with, and have one component; wordless ones among them have their own
    id. A null id gives a null component, kept. Other columns are ignored,
    whatever their names.
    """
    spark = docs.sparkSession
    ship_package(spark)
    docs = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text"))
    feats = materialize(docs.mapInArrow(_digested(k, "bands", _bands), _DIGEST + ", bands array<bigint>"), "minhash")
    hot = hot_limit(feats.count())
    some = feats.filter("n_shingles > 0 AND doc_id IS NOT NULL")
    classes = some.groupBy(*CLASS).agg(F.min("doc_id").alias("doc_id"), F.count(F.lit(1)).alias("copies"), F.first("bands").alias("bands"))
    # written at once, so that the numbers stay
    classes = materialize(classes.withColumn("rep", F.monotonically_increasing_id()), "classes")
    reps = classes.select("rep", F.col("n_shingles").alias("size"), "bands")

    bands = reps.select("rep", "size", F.explode("bands").alias("bucket"))
    buckets = bands.groupBy("bucket").agg(F.count(F.lit(1)).alias("n")).filter("n > 1")
    members = materialize(join_one_row_per_key(bands, buckets, ["bucket"], "n", hot, "rep"), "members")
    support = members.groupBy("rep").agg(F.sum("n").alias("support"))
    members = materialize(members.join(support, "rep"), "supported")
    wanted = classes.join(support.select("rep"), "rep", "left_semi").select("rep", "doc_id", *CLASS)
    texts = keep_ids(docs, wanted, "doc_id").withColumn("t", F.xxhash64("text")).dropDuplicates(["doc_id", "t"])
    sets = texts.mapInArrow(_digested(k, "shingles", _sets), _DIGEST + ", shingles array<bigint>")
    # where an id has several texts of one set, any of them will do
    sets = materialize(sets.join(wanted, ["doc_id", *CLASS]).dropDuplicates(["rep"]).select("rep", "shingles"), "sets")

    centred = _centred(members, hot)
    edges = materialize(_confirm(_star_pairs(centred, percent), sets, percent), "links")
    roots = connected_components(edges)

    edges = edges.union(materialize(_rest(centred, roots, sets, hot, percent), "links")).union(_same_id(some, classes, hot))
    roots = connected_components(edges)

    joined = roots.join(classes.select(F.col("rep").alias("node"), "doc_id"), "node")
    least = joined.groupBy("root").agg(F.min("doc_id").alias("component_id"), F.count(F.lit(1)).alias("rows"))
    joined = join_one_row_per_key(joined, least, ["root"], "rows", hot, "node").select(F.col("node").alias("rep"), "component_id")
    placed = classes.join(joined, "rep", "left").select(*CLASS, F.coalesce("component_id", "doc_id").alias("component_id"), "copies")
    out = join_one_row_per_key(feats.select("doc_id", *CLASS), placed, CLASS, "copies", hot, "doc_id", how="left")
    component = F.when(F.col("n_shingles") > 0, F.col("component_id")).otherwise(F.col("doc_id"))
    component = F.when(F.col("doc_id").isNotNull(), component)
    return out.select("doc_id", "n_shingles", component.alias("component_id")).withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)))
