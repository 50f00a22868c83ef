"""The prefix trie of conversations, by peeling turns off their ends.

A node is a distinct sequence of first turns, named by a chained 128-bit hash of them.  The
peel descends from the greatest depth: at each level the conversations that end there join
the nodes that survive from below, all are grouped by what their last turn and those before
spell, and each group is stripped of that turn and goes on as a part of its parent.  Counts,
smallest members, leaves and savings add up on the way, so the nodes are found and aggregated
in the one descent.

Equal conversations enter as one, with a weight.  Below the last node that a conversation
shares with another one its nodes have no other members: these turns come off at once, before
the descent, so that one conversation of many turns doesn't make as many levels.  Rows of the
descent carry hashes and lengths of the shared turns only, never texts.  LEVELS levels are
one job, whose result is written to the shared folder.

No group is gathered in one place: groups are sums and minima, combined before they shuffle.
The lists of members that end in a node (their digest is asked for) are cut in pieces of
PIECE by a range partitioning, and the pieces of a node are hashed as a stream.  The hashes
of one conversation's turns are chained in a stream too.

Defined results: a null role or text is empty; turns sort by turn (nulls first), then role,
then digest of role and text; repeated rows are repeated turns; rows without a conv_id belong
to no conversation; ids are taken modulo 100 by the sign of the id; a conversation whose
rebuilt form has no turns is a member of the root only; an empty table has no nodes; further
columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cueflow.llm.shared import scratch, stored

#: Levels of a job, members of a piece, and the share of all nodes from which on a parent's children are many.
LEVELS, PIECE, MANY = 8, 1024, 1000
#: Conversations of one hundred share up to HEAD - 1 first turns.
HUNDRED, HEAD = 100, 6
ROOT = b"\0" * 16
SUMS = ("n_convs", "n_children", "n_leaves", "saved_tokens")


def digested(conversations: DataFrame) -> DataFrame:
    """conv_id, k (from 1, by turn), digest of role and text, chars of the text."""
    role, text = F.coalesce("role", F.lit("")), F.coalesce("text", F.lit(""))
    digest = F.unhex(F.substring(F.sha2(F.concat(F.length(role).cast("string"), F.lit(":"), role, text), 256), 1, 32))
    turns = conversations.where("conv_id is not null").select(F.col("conv_id").cast("long").alias("conv_id"), "turn", role.alias("role"), digest.alias("digest"), F.length(text).cast("long").alias("chars"))
    order = Window.partitionBy("conv_id").orderBy(F.col("turn").asc_nulls_first(), "role", "digest")
    return turns.select("conv_id", F.row_number().over(order).alias("k"), "digest", "chars")


def rebuilt(turns: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Each conversation with the first h turns of its hundred's first one for its own: ids(conv_id), turns(conv_id, k, digest, chars)."""
    ids = turns.select("conv_id").distinct()
    h = F.crc32(F.col("conv_id").cast("string").cast("binary")) % HEAD
    heads = turns.where((F.col("conv_id") % HUNDRED == 0) & (F.col("k") < HEAD)).withColumnRenamed("conv_id", "base")
    # A head goes to a hundred conversations at most.
    given = ids.withColumn("base", F.col("conv_id") - F.col("conv_id") % HUNDRED).join(heads, "base").where(F.col("k") <= h)
    columns = ["conv_id", "k", "digest", "chars"]
    return ids, given.select(*columns).unionByName(turns.where(F.col("k") > h).select(*columns))


_CHAIN = pa.schema([("conv_id", pa.int64()), ("depth", pa.int64()), ("h", pa.binary()), ("parent", pa.binary()), ("chars", pa.int64()), ("total", pa.int64()), ("last", pa.bool_())])


def _chained(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows by conversation and k, each with the hash of its prefix and of the one before."""
    held, last = None, None
    for batch in batches:
        out = []
        for conv, _, digest, chars in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            if held is not None:
                out.append((*held, held[0] != conv))
            if held is None or held[0] != conv:
                last = (0, ROOT, 0)
            depth, before, total = last
            h = hashlib.blake2b(before + digest, digest_size=16).digest()
            last = (depth + 1, h, total + chars)
            held = (conv, depth + 1, h, before, chars, total + chars)
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(c, type=f.type) for c, f in zip(zip(*out, strict=True), _CHAIN, strict=True)], schema=_CHAIN)
    if held is not None:
        yield pa.RecordBatch.from_arrays([pa.array([x], type=f.type) for x, f in zip((*held, True), _CHAIN, strict=True)], schema=_CHAIN)


def chained(turns: DataFrame) -> DataFrame:
    """conv_id, depth, h, parent, chars, total (chars so far), last: a row for every prefix of every conversation."""
    ordered = turns.select("conv_id", F.col("k").cast("long").alias("k"), "digest", "chars").repartition("conv_id").sortWithinPartitions("conv_id", "k")
    return ordered.mapInArrow(_chained, "conv_id long, depth long, h binary, parent binary, chars long, total long, last boolean")


def _pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Runs of up to PIECE ids of one node, joined."""
    node, ids = None, []
    for batch in batches:
        out = []
        for h, conv in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            if ids and (h != node or len(ids) == PIECE):
                out.append((node, ids[0], ",".join(map(str, ids))))
                ids = []
            node = h
            ids.append(conv)
        yield _rows(out, pa.binary(), pa.int64(), pa.string())
    yield _rows([(node, ids[0], ",".join(map(str, ids)))] if ids else [], pa.binary(), pa.int64(), pa.string())


def _hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """SHA-256 over the pieces of each node, one after the other."""
    node, state = None, None
    for batch in batches:
        out = []
        for h, _, ids in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            if state is not None and h == node:
                state.update(b",")
            else:
                if state is not None:
                    out.append((node, state.hexdigest()))
                node, state = h, hashlib.sha256()
            state.update(ids.encode())
        yield _rows(out, pa.binary(), pa.string())
    yield _rows([(node, state.hexdigest())] if state is not None else [], pa.binary(), pa.string())


def _rows(rows: list[tuple], *kinds: pa.DataType) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], type=kind) for i, kind in enumerate(kinds)], names=[f"c{i}" for i in range(len(kinds))])


def ends_digests(ends: DataFrame) -> DataFrame:
    """h, ends_sha256 of ends(h, conv_id): the digest of each node's ids in ascending order."""
    ordered = ends.select("h", "conv_id").repartitionByRange("h", "conv_id").sortWithinPartitions("h", "conv_id")
    pieces = ordered.mapInArrow(_pieces, "h binary, first long, ids string")
    return pieces.repartition("h").sortWithinPartitions("h", "first").mapInArrow(_hashed, "h binary, ends_sha256 string")


def _entries(ids: DataFrame, prefixes: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Where every conversation ends (h, conv_id), and the distinct ones: conv_id (the smallest), weight, length, chars."""
    last = prefixes.where("last").select("conv_id", "h", "depth", "total")
    ended = ids.join(last, "conv_id", "left").select("conv_id", F.coalesce("h", F.lit(ROOT)).alias("h"), F.coalesce("depth", F.lit(0)).alias("depth"), F.coalesce("total", F.lit(0)).alias("total"))
    distinct = ended.groupBy("h").agg(F.min("conv_id").alias("conv_id"), F.count("*").alias("weight"), F.min("depth").alias("length"), F.min("total").alias("all_chars"))
    return ended.select("h", "conv_id"), distinct.select("conv_id", "weight", "length", "all_chars")


def _level(rows: DataFrame, level: int) -> DataFrame:
    """One step of the descent: nodes of this level (``done``), and what they bring to the level above.

    ``rows``: done nodes of lower levels, which pass, and parts(path, conv_id, sums) of this one.
    """
    key = F.when(F.col("done").isNotNull(), F.col("h")).otherwise(F.col("path")[level - 1]["h"] if level else F.lit(ROOT))
    grouped = rows.groupBy(key.alias("h"), "done").agg(F.first("path").alias("path"), F.first("parent").alias("parent"), F.min("conv_id").alias("conv_id"), *[F.sum(c).alias(c) for c in SUMS])
    live = F.col("done").isNull()
    chars = F.when(live, (F.col("path")[level - 1]["chars"] if level else F.lit(0)) * (F.col("n_convs") - 1)).otherwise(0)
    nodes = grouped.withColumns({"n_leaves": F.when(live & (F.col("n_children") == 0), 1).otherwise(F.col("n_leaves")).cast("long"), "saved_tokens": F.col("saved_tokens") + chars})

    def row(done: Column, h: Column, parent: Column, path: Column, children: Column) -> Column:
        sums = [F.col(c).alias(c) if c != "n_children" else children.cast("long").alias(c) for c in SUMS]
        return F.struct(done.cast("long").alias("done"), h.alias("h"), parent.alias("parent"), path.alias("path"), F.col("conv_id").alias("conv_id"), *sums)

    nothing, kind = F.lit(None).cast("binary"), rows.schema["path"].dataType
    before = (F.col("path")[level - 2]["h"] if level > 1 else F.lit(ROOT)) if level else nothing
    own = row(F.when(live, level).otherwise(F.col("done")), F.col("h"), F.when(live, before).otherwise(F.col("parent")), F.lit(None).cast(kind), F.col("n_children"))
    stripped = row(F.lit(None), nothing, nothing, F.slice("path", F.lit(1), F.lit(max(level - 1, 0))), F.lit(1))
    both = F.array(own, stripped) if level else F.array(own)
    return nodes.select(F.inline(F.when(live, both).otherwise(F.array(own))))


def _peeled(starts: DataFrame, top: int) -> DataFrame:
    """The nodes that distinct conversations share, from starts(path, depth, conv_id, sums)."""
    nothing = {"done": F.lit(None).cast("long"), "h": F.lit(None).cast("binary"), "parent": F.lit(None).cast("binary")}
    columns = ["done", "h", "parent", "path", "conv_id", *SUMS]
    entering = lambda low, high: starts.where(F.col("depth").between(low, high)).withColumns(nothing)
    found, rows = [], None
    for high in range(top, -1, -LEVELS):
        for level in range(high, max(high - LEVELS, -1), -1):
            new = entering(level, level).select(*columns)
            rows = _level(new if rows is None else rows.unionByName(new), level)
        written = stored(rows, "trie")
        found.append(written.where("done is not null"))
        rows = written.where("done is null")
    return _union(found)


def _union(frames: list[DataFrame]) -> DataFrame:
    """Unions in pairs, so that the plan stays shallow."""
    while len(frames) > 1:
        frames = [a.unionByName(frames[i + 1]) if i + 1 < len(frames) else a for i, a in list(enumerate(frames))[::2]]
    return frames[0]


def _linked(nodes: DataFrame, parents: DataFrame) -> DataFrame:
    """nodes with the conv_id of their parents.

    A parent with more than one in MANY of all nodes as children is in a table of at most MANY
    rows, which is broadcast; no other key of the join has so many rows.
    """
    total = parents.agg(F.sum("n_children")).first()[0] or 0
    named = parents.select(F.col("h").alias("parent"), F.col("conv_id").alias("parent_conv_id"), (F.col("n_children") * MANY > total).alias("large"))
    large, small = named.where("large").drop("large"), named.where("not large").drop("large")
    at_large = nodes.join(F.broadcast(large), "parent")
    others = nodes.join(F.broadcast(large.select("parent")), "parent", "left_anti").join(small, "parent", "left")
    return at_large.unionByName(others)


def prefix_trie(conversations: DataFrame) -> DataFrame:
    """A row per node: conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256."""
    with scratch(conversations.sparkSession):
        ids, turns = rebuilt(stored(digested(conversations), "turns"))
        prefixes = stored(chained(turns), "prefixes")
        ended, entries = _entries(ids, prefixes)
        ended, entries = stored(ended, "ended"), stored(entries, "entries")
        chains = stored(entries.join(prefixes.drop("last"), "conv_id"), "chains")
        # The first depth at which a conversation is alone.
        alone = chains.groupBy("h").agg(F.count("*").alias("n"), F.min("conv_id").alias("conv_id"), F.min("depth").alias("depth")).where("n = 1")
        shared = alone.groupBy("conv_id").agg((F.min("depth") - 1).alias("shared"))
        placed = chains.join(shared, "conv_id", "left").withColumn("shared", F.coalesce("shared", "length"))

        step = F.struct("depth", "h", "chars")
        paths = placed.where("depth <= shared").groupBy("conv_id").agg(F.sort_array(F.collect_list(step)).alias("path"))
        known = entries.join(shared, "conv_id", "left").join(paths, "conv_id", "left")
        path = F.transform(F.coalesce("path", F.array().cast(paths.schema["path"].dataType)), lambda s: F.struct(s["h"].alias("h"), s["chars"].alias("chars")))
        begun = known.select("conv_id", path.alias("path"), F.coalesce("shared", "length").alias("depth"), F.col("weight").alias("n_convs"), "length", "all_chars")
        below = (F.col("length") > F.col("depth")).cast("long")
        kept = F.aggregate("path", F.lit(0).cast("long"), lambda s, x: s + x["chars"])
        starts = stored(begun.select("conv_id", "path", "depth", "n_convs", below.alias("n_children"), below.alias("n_leaves"), ((F.col("n_convs") - 1) * (F.col("all_chars") - kept)).alias("saved_tokens")), "starts")

        tails = placed.where("depth > shared").select(
            "h", "parent", "conv_id", "depth", (F.col("depth") == F.col("shared") + 1).alias("first"), F.col("weight").alias("n_convs"), (F.col("depth") < F.col("length")).cast("long").alias("n_children"),
            F.lit(1).cast("long").alias("n_leaves"), ((F.col("weight") - 1) * (F.col("all_chars") - F.col("total") + F.col("chars"))).alias("saved_tokens"),
        )
        top = starts.agg(F.max("depth")).first()[0]
        columns = ["h", "parent", "conv_id", "depth", *SUMS]
        if top is None:
            return stored(tails.select("conv_id", "depth", F.col("conv_id").alias("parent_conv_id"), *SUMS, F.lit("").alias("ends_sha256")).limit(0), "nodes", result=True)
        peeled = _peeled(starts, int(top)).withColumn("depth", F.col("done")).select(*columns)
        within = tails.where("not first").select(*columns).withColumn("parent_conv_id", F.col("conv_id"))
        nodes = _linked(peeled.unionByName(tails.where("first").select(*columns)), peeled).unionByName(within)
        whole = nodes.join(ends_digests(ended), "h", "left")
        none = hashlib.sha256(b"").hexdigest()
        return stored(whole.select("conv_id", "depth", "parent_conv_id", *SUMS, F.coalesce("ends_sha256", F.lit(none)).alias("ends_sha256")), "nodes", result=True)
