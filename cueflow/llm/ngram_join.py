"""N-gram Jaccard self join by grouped prefixes.

A document's set holds its distinct k-word shingles (64-bit fingerprints).  Two documents
link when their sets' Jaccard similarity reaches a threshold.  The join

1. collapses documents with equal sets into one node;
2. orders each set by one global order, rare shingles first, and keeps its prefix: linked
   sets share a shingle of their prefixes;
3. collapses nodes with identical prefix and size into one group;
4. joins groups on prefix shingles under the length and position filters;
5. expands group pairs to members and verifies their whole sets.

The global order: shingles with a fingerprint in the low ``POOL`` part of the range come
first, by document frequency, then by fingerprint; all others follow by fingerprint.  Any
global order gives the same links; this one needs frequencies of the pool only, and they
are counted over all documents.

Large groups of near copies don't become all pairs: a first pass compares every group of a
bucket with the bucket's centre (the group with the fewest shingles of its own) and every
group's members with its first.  Buckets and groups whose members are in one component then
are done; of the others, small ones compare what is apart, if its parity signatures
(SIGNATURE bits; each shingle flips one) differ in no more bits than linked sets may differ
in shingles, and large ones go on by their differences from centres (``stars``).  All this
leaves out pairs that can't matter: components come out as if all pairs had been verified.

Defined results: null or blank text has an empty set and no link; repeated rows count as
copies; a repeated doc_id with different texts gives a node per text; an empty table gives
an empty result; further columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cueflow.llm import wordhash
from cueflow.llm.shared import connected_components, maybe_among, scratch, stored
from cueflow.llm.stars import bucket_links, near_parity

#: The pool's part of the fingerprint range, as a multiple of (1 - threshold).
POOL = 1.6
#: Bits of a parity signature, and the 64-bit words that hold them.
SIGNATURE = 512
WORDS = SIGNATURE // 64


def shingle_sets(data: np.ndarray, offsets: np.ndarray, k: int) -> Iterator[np.ndarray]:
    """The sorted distinct shingle fingerprints of each row of a chunk."""
    starts, ends, rows = wordhash.cut_words(data, offsets)
    words = wordhash.span_hashes(data, starts, ends, lower=True)
    shingles = wordhash.shingle_hashes(words, k)
    for a, z in zip(rows[:-1], rows[1:], strict=True):
        if z - a >= k:
            yield np.unique(shingles[a : z - k + 1])
        else:
            yield wordhash.shingle_hashes(words[a:z], z - a) if z > a else np.zeros(0, np.uint64)


def prefix_length(n: int, percent: int) -> int:
    """Shingles of a set of n that any partner must share one of."""
    return n - -(-percent * n // 100) + 1


def smallest_size(percent: int) -> int:
    """The smallest set that can link with a different one: n against n + 1 shingles."""
    return math.ceil(percent / (100 - percent)) if percent < 100 else 1 << 62


#: Flips fingerprints so that signed order (Spark's) is the unsigned order.
_FLIP = np.uint64(1 << 63)


def _node(values: np.ndarray) -> np.uint64:
    """A fingerprint of a whole set."""
    n = np.uint64(len(values))
    return wordhash.mix(values.sum(keepdims=True) + np.bitwise_xor.reduce(wordhash.mix(values + n), keepdims=True))[0] if n else np.uint64(0)


def _sketch(k: int, percent: int):
    least, pool = smallest_size(percent), np.uint64(min(2**64 - 1, int(POOL * (100 - percent) / 100 * 2**64)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, data, offsets in wordhash.chunks(batches):
            sizes, nodes, tokens, pools, parities, ends = [], [], [], [], [], [0]
            for values in shingle_sets(data, offsets, k):
                n = len(values)
                sizes.append(n)
                nodes.append(_node(values))
                pools.append(int(np.searchsorted(values, pool)))
                keep = max(pools[-1], prefix_length(n, percent)) if n >= least else 0
                tokens.append(values[:keep] ^ _FLIP)
                ends.append(ends[-1] + keep)
                flips = np.bincount((values & np.uint64(SIGNATURE - 1)).astype(np.int64), minlength=SIGNATURE) & 1
                parities.append(np.packbits(flips.astype(np.uint8)).view(np.int64))
            flat = np.concatenate(tokens).view(np.int64) if tokens else np.zeros(0, np.int64)
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), batch.column("text_hash"), pa.array(sizes, pa.int64()), pa.array(pools, pa.int64()), pa.array(np.array(nodes, np.uint64).view(np.int64)), pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(flat)), pa.ListArray.from_arrays(pa.array(np.arange(len(sizes) + 1) * WORDS, pa.int32()), pa.array(np.concatenate(parities) if parities else np.zeros(0, np.int64)))],
                names=["doc_id", "text_hash", "n_shingles", "n_pool", "node", "tokens", "parity"],
            )

    return run


def _set_blobs(k: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, data, offsets in wordhash.chunks(batches):
            sets = list(shingle_sets(data, offsets, k))
            same = pa.array([int(_node(v).view(np.int64)) == n for v, n in zip(sets, batch.column("node").to_pylist(), strict=True)], pa.bool_())
            yield pa.RecordBatch.from_arrays([batch.column("node"), pa.array([v.tobytes() for v in sets], pa.binary())], names=["node", "items"]).filter(same)

    return run


def _overlap(percent: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            hits = []
            for x, y in zip(batch.column("items_a"), batch.column("items_b"), strict=True):
                x, y = np.frombuffer(x.as_buffer(), np.uint64), np.frombuffer(y.as_buffer(), np.uint64)
                both = np.concatenate([x, y])
                both.sort()
                common = int(np.count_nonzero(both[1:] == both[:-1]))
                hits.append(100 * common >= percent * (len(both) - common))
            yield batch.filter(pa.array(hits, pa.bool_())).select(["a", "b"])

    return run


def _differences(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sizes of both sets of a pair (a, b), and the shingles that only one of them has."""
    for batch in batches:
        n_a, n_b, parts, ends = [], [], [np.zeros(0, np.uint64)], [0]
        for x, y in zip(batch.column("items_a"), batch.column("items_b"), strict=True):
            x, y = np.frombuffer(x.as_buffer(), np.uint64), np.frombuffer(y.as_buffer(), np.uint64)
            both = np.concatenate([x, y])
            both.sort()
            same = both[1:] == both[:-1]
            parts.append(both[~(np.append(same, False) | np.append(False, same))])
            n_a.append(len(x))
            n_b.append(len(y))
            ends.append(ends[-1] + len(parts[-1]))
        delta = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(np.concatenate(parts).view(np.int64)))
        yield pa.RecordBatch.from_arrays([batch.column("a"), batch.column("b"), pa.array(n_a, pa.int32()), pa.array(n_b, pa.int32()), delta], names=["c", "x", "n_c", "n", "delta"])


def _with_sets(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    a, b = sets.select(F.col("node").alias("a"), F.col("items").alias("items_a")), sets.select(F.col("node").alias("b"), F.col("items").alias("items_b"))
    return pairs.join(b, "b").join(a, "a")


def _verified(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) of nodes whose whole sets reach the threshold."""
    return _with_sets(pairs, sets).mapInArrow(_overlap(percent), "a long, b long")


def _deltas(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    return _with_sets(pairs.select(F.col("c").alias("a"), F.col("x").alias("b")), sets).mapInArrow(_differences, "c long, x long, n_c int, n int, delta array<long>")


def _may_link(percent: int) -> Column:
    """Length and position filter: both sets can still share enough from the shared shingle on."""
    return F.expr(
        f"least(n - pos, m - qos) >= ((n + m) * {percent} + {99 + percent}) div {100 + percent}"
        f" and m * 100 >= n * {percent} and n * 100 >= m * {percent}"
    )


def _renamed(df: DataFrame, **names: str) -> DataFrame:
    """Only the named columns, under new names."""
    return df.select(*[F.col(old).alias(new) for old, new in names.items()])


def _prefixes(classes: DataFrame, percent: int) -> DataFrame:
    """node, n, p (length of the prefix), once (shingles of the pool in no other class), prefix: its shingles of more than one class, with positions."""
    tokens = classes.select("node", "n_pool", F.posexplode("tokens").alias("at", "token"))
    shared = tokens.groupBy("token").agg(F.count("*").alias("df")).where("df > 1")
    seen = (
        tokens.join(shared, "token").withColumn("outside", F.col("at") >= F.col("n_pool"))
        .groupBy("node")
        .agg(F.array_sort(F.collect_list(F.struct("outside", F.when(F.col("outside"), 0).otherwise(F.col("df")).alias("df"), "token", "at"))).alias("seen"))
    )
    # The pool's shingles seen once come first, then the others by frequency; those outside
    # the pool stand where their fingerprint puts them.
    once = F.expr("n_pool - size(filter(seen, s -> not s.outside))")
    place = F.expr(
        "filter(transform(seen, (s, i) -> struct(s.token as token, cast(if(s.outside, s.at, once + i) as int) as pos)), x -> x.pos < p)"
    )
    return (
        seen.join(classes.select("node", "n", "n_pool"), "node").withColumn("once", once)
        .withColumn("p", F.expr(f"n - (n * {percent} + 99) div 100 + 1"))
        .select("node", "n", "p", "once", place.alias("prefix")).where(F.size("prefix") > 0)
    )


def _ranked_classes(source: DataFrame, k: int, percent: int) -> tuple[DataFrame, DataFrame, DataFrame]:
    """All rows' nodes; the classes of equal sets (node, parity, copy); and their prefixes."""
    schema = "doc_id long, text_hash long, n_shingles long, n_pool long, node long, tokens array<long>, parity array<long>"
    with scratch(source.sparkSession):
        sketch = stored(source.mapInArrow(_sketch(k, percent), schema), "sketch")
        nodes = stored(sketch.select("doc_id", "text_hash", "n_shingles", "node"), "nodes", result=True)
        copy = F.min(F.struct("doc_id", "text_hash")).alias("copy")
        firsts = [F.first(c).alias(a) for c, a in (("n_shingles", "n"), ("n_pool", "n_pool"), ("tokens", "tokens"), ("parity", "parity"))]
        whole = stored(sketch.where(F.size("tokens") > 0).groupBy("node").agg(*firsts, copy), "classes")
        # Groups have the same size and the same prefix, none of whose shingles is the node's own.
        alike = F.when(F.size("prefix") == F.col("p"), F.xxhash64("n", "prefix")).otherwise(F.col("node"))
        ranked = stored(_prefixes(whole, percent).withColumn("alike", alike), "prefixes", result=True)
        classes = stored(whole.join(ranked.select("node"), "node", "left_semi").select("node", "parity", "copy"), "class-copies", result=True)
        return nodes, classes, ranked


def ngram_links(documents: DataFrame, k: int = 3, percent: int = 90) -> tuple[DataFrame, DataFrame]:
    """Nodes (doc_id, text_hash, n_shingles, node) of all documents, and components (node, root).

    Nodes that link with no other node have no row in the components.
    """
    source = documents.select("doc_id", "text", F.xxhash64("text").alias("text_hash"))
    nodes, classes, ranked = _ranked_classes(source, k, percent)
    first = ranked.groupBy("alike").agg(F.min("node").alias("g"))
    members = stored(ranked.select("alike", "node", "n").join(first, "alike").select("g", "node", "n"), "members")
    groups = ranked.join(members.where("g = node").select("node"), "node", "left_semi")
    postings = groups.select(F.col("node").alias("g"), "n", "once", F.inline("prefix"))
    met = postings.groupBy("token").agg(F.count("*").alias("c")).where("c > 1").select("token")
    postings = stored(postings.join(met, "token"), "postings")

    # First pass: each bucket's groups against its centre, each group's members against its first.
    rank = F.struct("once", F.xxhash64("g").alias("o"), F.col("g").alias("h"), F.col("n").alias("m"), F.col("pos").alias("qos"))
    centre = postings.groupBy("token").agg(F.min(rank).alias("c")).select("token", "c.h", "c.m", "c.qos")
    star = postings.join(centre, "token").where("g <> h").where(_may_link(percent)).select(F.least("g", "h").alias("a"), F.greatest("g", "h").alias("b"))
    inside = members.where("g <> node").select(F.least("g", "node").alias("a"), F.greatest("g", "node").alias("b"))
    star = stored(star.unionByName(inside).distinct(), "star")
    busy = postings.select("g").unionByName(members.where("g <> node").select("g")).distinct()
    wanted = members.join(busy, "g", "left_semi").select("node")
    copies = stored(classes.join(wanted, "node", "left_semi").select("node", "copy.*").withColumnRenamed("doc_id", "id"), "copies")
    texts = maybe_among(source, "text_hash", copies.select("text_hash")).join(copies, "text_hash").where("doc_id <=> id").dropDuplicates(["node"]).select("node", "text")
    sets = stored(texts.mapInArrow(_set_blobs(k), "node long, items binary"), "sets")
    links = stored(_verified(star, sets, percent), "links")

    # Second pass: only what isn't in one component yet.
    found = connected_components(links)
    rooted = members.join(found, "node", "left").select("g", "node", "n", F.coalesce("root", "node").alias("root"))
    mixed = stored(rooted.groupBy("g").agg(F.min("root").alias("low"), F.max("root").alias("high")), "mixed")
    apart = postings.select("token", "g").join(mixed, "g").groupBy("token").agg(F.min("low").alias("l"), F.max("high").alias("h")).where("l <> h").select("token")
    by_token = postings.join(apart, "token").select(F.xxhash64("token", F.lit("token")).alias("bucket"), "g")
    by_group = mixed.where("low <> high").select(F.xxhash64("g", F.lit("group")).alias("bucket"), "g")
    rows = stored(by_token.unionByName(by_group).join(members.select("g", F.col("node").alias("x")), "g").select("bucket", "x"), "buckets")
    wanted = stored(rows.select(F.col("x").alias("node")).distinct(), "apart")
    marks = stored(_renamed(members.join(wanted, "node").join(classes.select("node", "parity"), "node"), node="x", n="n", parity="parity"), "marks")

    def asked(pairs: DataFrame, a: str, b: str) -> tuple[DataFrame, DataFrame]:
        """The pairs, stored, and the sets that they need, with a few others."""
        pairs = stored(pairs, "asked")
        return pairs, maybe_among(sets, "node", pairs.select(F.col(a).alias("node")).unionByName(pairs.select(F.col(b).alias("node"))))

    def verified(pairs: DataFrame) -> DataFrame:
        return _verified(*asked(near_parity(pairs.join(star, ["a", "b"], "left_anti"), marks, percent, WORDS), "a", "b"), percent)

    links = bucket_links(rows, links, verified, lambda pairs: _deltas(*asked(pairs, "c", "x")), percent, found)
    return nodes, connected_components(links)


def labelled_nodes(documents: DataFrame, k: int = 3, percent: int = 90) -> DataFrame:
    """doc_id, text_hash, n_shingles, node, root and component_id (smallest doc_id reachable) of every row."""
    with scratch(documents.sparkSession):
        nodes, found = ngram_links(documents, k, percent)
        worded = nodes.where("n_shingles > 0")
        classes = worded.groupBy("node").agg(F.min("doc_id").alias("least")).join(found, "node", "left").withColumn("root", F.coalesce("root", "node"))
        classes = stored(classes, "class-roots")
        least = classes.groupBy("root").agg(F.min("least").alias("component_id"))
        final = classes.join(least, "root").select("node", "root", "component_id")
        # Documents without words are linked with nothing.
        blank = nodes.where("n_shingles = 0").select("*", F.lit(None).cast("long").alias("root"), F.col("doc_id").alias("component_id"))
        labelled = worded.join(final, "node").select(*nodes.columns, "root", "component_id").unionByName(blank)
        return stored(labelled, "labelled", result=True)


def ngram_components(documents: DataFrame, k: int = 3, percent: int = 90) -> DataFrame:
    """doc_id, n_shingles and component_id of every row of ``documents``."""
    return labelled_nodes(documents, k, percent).select("doc_id", "n_shingles", "component_id")


def one_of_each_component(documents: DataFrame, k: int = 5, percent: int = 80) -> DataFrame:
    """``documents`` without all but the first row of each component (smallest doc_id, then text).

    Documents without words all stay, repeated rows too; of equal rows with words one stays.
    """
    with scratch(documents.sparkSession):
        labelled = labelled_nodes(documents, k, percent)
        worded = labelled.where("n_shingles > 0")
        repeated = not worded.groupBy("doc_id", "text_hash").count().where("count > 1").isEmpty()
        first = worded.groupBy("root").agg(F.min(F.struct("doc_id", "text_hash")).alias("first")).select("first.*")
        blank = labelled.where("n_shingles = 0").select("doc_id", "text_hash").distinct()
        kept = first.select("*", F.lit(True).alias("worded")).unionByName(blank.select("*", F.lit(False).alias("worded")))
        kept = stored(_renamed(kept, doc_id="kept_id", text_hash="kept_hash", worded="worded"), "kept", result=True)
    row = F.struct(*[F.col(f"`{c}`") for c in documents.columns]).alias("row")
    rows = documents.select(row, "doc_id", F.xxhash64("text").alias("text_hash"))
    same = (F.col("text_hash") == F.col("kept_hash")) & F.col("doc_id").eqNullSafe(F.col("kept_id"))
    found = rows.join(kept, same)
    if repeated:
        found = found.where("worded").dropDuplicates(["doc_id", "text_hash"]).unionByName(found.where("not worded"))
    return found.select("row.*")
