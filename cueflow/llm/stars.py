"""Links inside large buckets of near copies, without all pairs.

Many sets of nearly equal content share a bucket, and some of them only link through
others.  First, STARS times, each bucket's members are compared with one centre of another
component, which joins most of what links.  In what is still apart each bucket elects a
centre, and every member x is described by its difference from it: delta(x), the elements that only one of the two sets has, d(x) in number.  Two
members differ in d(x) + d(y) - 2 |delta(x) & delta(y)| elements, so

* members that link with the centre are in its component;
* any other pair that links shares elements of its deltas, a number that follows from
  d(x), d(y) and the sizes.  The deltas are ordered, rare elements first (counted within
  the centre's members), and the prefix filter makes smaller buckets of (centre, element).

The centre is the member closest to what most of them hold, found from the differences from
any of them.  What the members have in common with their centre plays no further part, so the buckets
shrink fast.  Buckets whose members all are in one component go; those of up to PAIRED
members are compared pair by pair; the others elect their own centre in the next round.
Each round takes at least the centre out of a bucket.  As soon as all pairs that are left
are no more than buckets of PAIRED members would give (PAIRED / 2 a row), they are compared,
large buckets in salted blocks.  Components come out as if all pairs had been compared.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cueflow.llm.shared import connected_components, stored

#: Buckets of up to so many members compare all pairs; rounds until the rest is taken pair by pair; members in a block of a large bucket.
PAIRED, ROUNDS, BLOCK = 32, 8, 1024
#: Rounds of comparisons with one centre before any other.
STARS = 2


def allowed(n: Column | str, m: Column | str, percent: int) -> Column:
    """In how many elements sets of these sizes may differ and still link."""
    return F.expr(f"(({n}) + ({m})) * {100 - percent} div {100 + percent}")


def near_parity(pairs: DataFrame, marks: DataFrame, percent: int, words: int) -> DataFrame:
    """The pairs (a, b) whose parity signatures allow a link: sets differ in as many elements as bits at least.

    marks(x, n, parity): sizes of the sets, and ``words`` 64-bit words, of which each element flips one bit.
    """
    side = lambda x, n, p: marks.select(F.col("x").alias(x), F.col("n").alias(n), F.col("parity").alias(p))
    both = pairs.join(side("a", "n", "p"), "a").join(side("b", "m", "q"), "b")
    differing = F.expr(" + ".join(f"bit_count(p[{i}] ^ q[{i}])" for i in range(words)))
    return both.where(differing <= allowed("n", "m", percent)).select("a", "b")


def open_buckets(rows: DataFrame, roots: DataFrame) -> DataFrame:
    """rows(bucket, x, ...) with ``root`` and ``c`` (members), without buckets whose members are in one component."""
    rooted = rows.join(roots.select(F.col("node").alias("x"), "root"), "x", "left").withColumn("root", F.coalesce("root", "x"))
    mixed = rooted.groupBy("bucket").agg(F.count("*").alias("c"), F.min("root").alias("r0"), F.max("root").alias("r1")).where("r0 <> r1").select("bucket", "c")
    return rooted.join(mixed, "bucket")


def all_pairs(rows: DataFrame) -> DataFrame:
    """Distinct pairs (a < b) of a bucket's members in different components.

    Of buckets with over BLOCK members one side is dealt over blocks, the other copied to each.
    """
    n = F.ceil(F.col("c") / BLOCK)
    blocks = F.sequence(F.lit(0).cast("long"), n - 1)
    block = F.pmod(F.xxhash64("x"), n)
    left = rows.select("bucket", F.col("x").alias("a"), F.col("root").alias("ra"), block.alias("block"))
    right = rows.select("bucket", F.col("x").alias("b"), F.col("root").alias("rb"), F.explode(blocks).alias("block"))
    return left.join(right, ["bucket", "block"]).where("a < b and ra <> rb").select("a", "b").distinct()


def bucket_links(rows: DataFrame, links: DataFrame, verified: Callable[[DataFrame], DataFrame], deltas: Callable[[DataFrame], DataFrame], percent: int, roots: DataFrame | None = None) -> DataFrame:
    """``links`` (a, b), with components ``roots``, and more: those that join what rows(bucket, x) share and the links leave apart.

    ``verified``: the pairs (a, b) that link.  ``deltas``: for pairs (c, x) also n_c and n,
    the sizes of both sets, and delta, the elements that one of them has.
    """
    rows = rows.select("bucket", "x")
    roots = connected_components(links) if roots is None else roots
    for level in range(STARS):
        rows = stored(open_buckets(rows, roots), "open-buckets")
        if rows.isEmpty():
            return links
        centre = rows.groupBy("bucket").agg(F.min(F.struct(F.xxhash64("x", F.lit(-1 - level)).alias("o"), "x", "root")).alias("o")).select("bucket", F.col("o.x").alias("c0"), F.col("o.root").alias("r0"))
        star = rows.join(centre, "bucket").where("root <> r0").select(F.least("x", "c0").alias("a"), F.greatest("x", "c0").alias("b")).distinct()
        links = links.unionByName(stored(verified(star), "star-links"))
        roots = connected_components(links)
        rows = rows.select("bucket", "x")
    for level in range(ROUNDS + 1):
        rows = stored(open_buckets(rows, roots), "open-buckets")
        count, pairs = rows.agg(F.count("*"), F.coalesce(F.sum(F.col("c") - 1), F.lit(0)) / 2).first()
        if not count:
            return links
        last = level == ROUNDS or pairs <= count * PAIRED / 2
        links = links.unionByName(stored(verified(all_pairs(rows if last else rows.where(F.col("c") <= PAIRED))), "bucket-links"))
        if last:
            return links
        large = rows.where(F.col("c") > PAIRED)
        # One order for all buckets of a round: buckets with much in common elect the same centre.
        centre = large.groupBy("bucket").agg(F.min(F.struct(F.xxhash64("x", F.lit(level)).alias("o"), "x")).alias("o")).select("bucket", F.col("o.x").alias("c0"))
        asked = large.join(centre, "bucket").where("x <> c0").select(F.col("c0").alias("c"), "x").distinct()
        found = _recentred(stored(deltas(asked), "deltas")).withColumn("d", F.size("delta"))
        found = stored(found.withColumn("near", F.col("d") <= allowed("n", "n_c", percent)), "recentred")
        links = links.unionByName(stored(found.where("near").select(F.col("c").alias("a"), F.col("x").alias("b")), "centre-links"))
        roots = connected_components(links)
        rows = stored(_smaller_buckets(found, roots, percent), "smaller-buckets")
    return links


def _recentred(found: DataFrame) -> DataFrame:
    """The same members (c, x, n_c, n, delta) around the one of them that is closest to what most of them hold.

    Elements that most deltas have are rather the centre's own; two deltas from one centre
    give the difference of their sets.
    """
    whole = found.select("c", "x", "n", "delta").unionByName(found.groupBy("c").agg(F.first("n_c").alias("n")).select("c", F.col("c").alias("x"), "n", F.array().cast("array<long>").alias("delta")))
    tokens = found.select("c", "x", F.explode("delta").alias("token"))
    most = tokens.groupBy("c", "token").agg(F.count("*").alias("df")).join(whole.groupBy("c").agg(F.count("*").alias("members")), "c").where("2 * df > members")
    hits = tokens.join(most, ["c", "token"]).groupBy("c", "x").agg(F.count("*").alias("hits"))
    cost = whole.join(hits, ["c", "x"], "left").withColumn("cost", F.size("delta") - 2 * F.coalesce("hits", F.lit(0)))
    best = cost.groupBy("c").agg(F.min(F.struct("cost", "x")).alias("b")).select("c", F.col("b.x").alias("x"))
    centre = whole.join(best, ["c", "x"]).select("c", F.col("x").alias("x0"), F.col("n").alias("n_c"), F.col("delta").alias("delta0"))
    delta = F.concat(F.array_except("delta", "delta0"), F.array_except("delta0", "delta"))
    return whole.join(centre, "c").where("x <> x0").select(F.col("x0").alias("c"), "x", "n_c", "n", delta.alias("delta")).dropDuplicates(["c", "x"])


def _smaller_buckets(found: DataFrame, roots: DataFrame, percent: int) -> DataFrame:
    """(bucket, x) for the prefixes of the deltas of members that may still link with another component."""
    whole = found.select("c", "x").unionByName(found.select("c", F.col("c").alias("x")).distinct())
    open_ = open_buckets(whole.withColumnRenamed("c", "bucket"), roots).select(F.col("bucket").alias("c")).distinct()
    found = found.join(open_, "c", "left_semi")
    sizes = found.groupBy("c").agg(F.max(F.greatest("n", "n_c")).alias("largest"), F.min(F.when(~F.col("near"), F.col("d"))).alias("far_d"))
    tokens = found.select("c", "x", F.explode("delta").alias("token"))
    shared = tokens.groupBy("c", "token").agg(F.count("*").alias("df")).where("df > 1")
    ordered = tokens.join(shared, ["c", "token"]).groupBy("c", "x").agg(F.sort_array(F.collect_list(F.struct("df", "token"))).alias("seen"))
    members = found.select("c", "x", "n", "d", "near").join(ordered, ["c", "x"]).join(sizes, "c").where("far_d is not null")
    members = members.withColumn("most", allowed("n", f"least(largest, n * 100 div {percent})", percent))
    # The least number of common elements, given the least d of a partner: a prefix of what is left.
    keep = lambda partner: F.size("seen") - F.greatest(F.lit(1), F.ceil((F.col("d") + F.greatest(partner, F.col("d") - F.col("most")) - F.col("most")) / 2)) + 1
    near = stored(members.where("near").withColumn("keep", keep(F.col("far_d"))).where("keep > 0"), "near-members")
    near_d = near.groupBy("c").agg(F.min("d").alias("near_d"))
    far = members.where("not near").join(near_d, "c", "left").withColumn("keep", keep(F.least("far_d", F.coalesce("near_d", "far_d")))).where("keep > 0")
    kept = near.select("c", "x", "seen", "keep").unionByName(far.select("c", "x", "seen", "keep"))
    prefix = kept.select("c", "x", F.explode(F.slice("seen", F.lit(1), F.col("keep").cast("int"))).alias("s"))
    return prefix.select(F.xxhash64("c", "s.token").alias("bucket"), "x").distinct()
