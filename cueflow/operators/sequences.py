"""Window functions and ordered folds over the cues of a clip.

Hard boundaries (gaps, punctuation, changes of speaker) become islands by ``lag`` and a
running sum.  Caps restart greedily, which window functions can't express: inside an island
(a sentence or a turn, so a short array) a fold over the ordered cues places them.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cueflow.functions.text import word_count, words
from cueflow.operators.joins import assign_segment
from cueflow.operators.predicates import drop_blank_cues, min_duration

CLIP = ("video_id", "clip_index")
#: Rows of a piece of a fold; least and greatest number of cues of a chunk.
PIECE, CHUNKS = 256, (1_024, 8_192)
# Caps and gaps of windows, voices and frames.
MAX_CUES, MAX_WORDS, MAX_GAP_MS, REAL_PAUSE_MS = 6, 40, 1500, 30
SHORT_CUE_MS, MERGED_WORDS = 1200, 12
FRAME_MS, BRIDGED_FRAMES = 30, 11
PITCHES = ("+0Hz", "-14Hz", "-28Hz", "-42Hz")


def _order(by: str = "cue_ord", keys: tuple[str, ...] = CLIP) -> Window:
    return Window.partitionBy(*keys).orderBy(by)


def dedupe_rolling(clip_cues: DataFrame) -> DataFrame:
    """Each cue without the longest start that repeats the end of the cue before it.

    Words compare in lower case; the cue before is the last raw one with a word.
    """
    raw = clip_cues.withColumn("_words", words(F.col("text"))).where(F.size("_words") > 0).withColumn("_low", F.transform("_words", lambda w: F.lower(w)))
    seen = raw.withColumn("_before", F.coalesce(F.lag("_low").over(_order()), F.array().cast("array<string>")))
    cut = _overlap(F.col("_before"), F.col("_low"))
    left = F.slice("_words", cut + 1, F.greatest(F.size("_words") - cut, F.lit(0)))
    return seen.withColumn("text", F.array_join(left, " ")).where(F.col("text") != "").drop("_words", "_low", "_before")


def _overlap(before: Column, own: Column) -> Column:
    """Length of the longest start of ``own`` that ends ``before``; both are columns or variables, as each is read often.

    Only lengths at which the words at both ends agree are compared in full.
    """
    n, most = F.size(before), F.least(F.size(before), F.size(own))
    lengths = F.when(most > 0, F.sequence(most, F.lit(1), F.lit(-1)))
    ends = lambda k: (F.get(own, k - 1) == F.get(before, n - 1)) & (F.get(own, F.lit(0)) == F.get(before, n - k))
    fits = F.filter(lengths, lambda k: ends(k) & (F.slice(before, n - k + 1, k) == F.slice(own, F.lit(1), k)))
    return F.coalesce(F.get(fits, F.lit(0)), F.lit(0))


def once(made: Column, use: Callable[[Column], Column]) -> Column:
    """``use(made)``, with ``made`` evaluated once however often it is used: as the element of an array."""
    return F.get(F.transform(F.array(made), use), F.lit(0))


def folded(rows: Column, zero: Column, step: Callable[[Column, Column], Column], out: str) -> Column:
    """What ``step(state, row)`` (a struct: next ``state``, ``out``) puts out for each of ordered ``rows``.

    Outputs are appended within pieces of PIECE rows, and pieces to each other, so that a long
    array isn't copied once a row.  ``out``: the type of an output.
    """
    size = F.ceil(F.size(rows) / PIECE).cast("int")
    pieces = F.transform(F.when(size > 0, F.sequence(F.lit(1), size)).otherwise(F.array().cast("array<int>")), lambda i: F.slice(rows, (i - 1) * PIECE + 1, F.lit(PIECE)))

    def added(acc: Column) -> Callable[[Column], Column]:
        return lambda x: F.struct(x["state"].alias("state"), F.array_append(acc["out"], x["out"]).alias("out"))

    def piece(acc: Column, part: Column) -> Column:
        inner = F.aggregate(part, F.struct(acc["state"].alias("state"), F.array().cast(f"array<{out}>").alias("out")), lambda a, row: once(step(a["state"], row), added(a)))
        return once(inner, added(acc))

    return F.aggregate(pieces, F.struct(zero.alias("state"), F.array().cast(f"array<array<{out}>>").alias("out")), piece, lambda acc: F.flatten(acc["out"]))


def merge_short_cues(clip_cues: DataFrame) -> DataFrame:
    """Cues that last less than SHORT_CUE_MS take the next ones in, up to MERGED_WORDS words.

    Wherever the cue before is sure to close, whatever it has taken in, an island begins: it
    reaches SHORT_CUE_MS even from the latest start so far, or the words of two neighbours are
    too many.  A fold over each island says which cues open; texts are joined behind it.
    Null times or words don't merge; a null text adds nothing.
    """
    keys = [c for c in (*CLIP, "clip_start_ms", "clip_end_ms") if c in clip_cues.columns]
    order = Window.partitionBy(*keys).orderBy("cue_ord")
    latest = F.max("start_ms").over(order)
    timed = clip_cues.select(*keys, F.col("cue_ord").cast("int").alias("cue_ord"), F.col("start_ms").cast("long").alias("start_ms"), F.col("end_ms").cast("long").alias("end_ms"), "text", word_count(F.col("text")).alias("n"))
    closed = timed.withColumns({"_closes": F.col("end_ms") - latest >= SHORT_CUE_MS, "_many": F.lag("n").over(order) + F.col("n") > MERGED_WORDS})
    cut = F.coalesce(F.lag("_closes").over(order), F.lit(False)) | F.coalesce("_many", F.lit(False))
    islands = closed.withColumn("_cut", cut.cast("int")).withColumn("_island", F.sum("_cut").over(order))
    rows = F.sort_array(F.collect_list(F.struct("cue_ord", "start_ms", "end_ms", "text", "n")))

    def step(last: Column, c: Column) -> Column:
        fits = F.coalesce((last["end_ms"] - last["start_ms"] < SHORT_CUE_MS) & (last["n"] + c["n"] <= MERGED_WORDS), F.lit(False))
        start, n = F.when(fits, last["start_ms"]).otherwise(c["start_ms"]), F.when(fits, last["n"]).otherwise(0) + c["n"]
        return F.struct(F.struct(start.alias("start_ms"), c["end_ms"].alias("end_ms"), n.alias("n")).alias("state"), (~fits).cast("int").alias("out"))

    nothing = F.lit(None).cast("struct<start_ms:bigint,end_ms:bigint,n:int>")
    opened = islands.groupBy(*keys, "_island").agg(rows.alias("_rows")).withColumn("_opens", folded(F.col("_rows"), nothing, step, "int"))
    cues = opened.select(*keys, F.inline(F.zip_with("_rows", "_opens", lambda r, o: F.struct(r["cue_ord"].alias("cue_ord"), r["start_ms"].alias("start_ms"), r["end_ms"].alias("end_ms"), r["text"].alias("text"), o.alias("_open")))))
    merged = cues.withColumn("_cue", F.sum("_open").over(order)).groupBy(*keys, "_cue").agg(F.sort_array(F.collect_list(F.struct("cue_ord", "start_ms", "end_ms", "text"))).alias("c"))
    first, last = F.element_at("c", 1), F.element_at("c", -1)
    return merged.select(*keys, first["cue_ord"].alias("cue_ord"), first["start_ms"].alias("start_ms"), last["end_ms"].alias("end_ms"), F.array_join(F.transform("c", lambda x: x["text"]), " ").alias("text"))


def _capped(islands: DataFrame, start: Column) -> DataFrame:
    """``window_id`` from islands (``_island``): a window closes behind a cue that reaches a cap.

    ``start``: whether a window may open at a cue when caps are reached (turns only cut at
    pauses).  What an open window lets follow depends on its number of cues alone (FULL when a
    cap is reached), as the words of so many last cues are known at each cue.  So a chunk of
    an island is a function of that number; where a chunk starts follows from the functions of
    those before it, and no array is longer than a chunk: about the root of an island's
    length, and between CHUNKS' bounds.  Rows travel with their chunk; one shuffle does for all.
    """
    full = MAX_CUES
    own = Window.partitionBy(*CLIP, "_island")
    said = [F.col("_n")]
    for k in range(1, full - 1):
        said.append(said[-1] + F.coalesce(F.lag("_n", k).over(_order()), F.lit(0)))
    reach = F.lit(full)
    for k in range(full - 1, 0, -1):
        reach = F.when(said[k - 1] >= MAX_WORDS, k).otherwise(reach)
    counted = islands.withColumns({"_reach": reach, "_may": start, "_pos": F.row_number().over(own.orderBy("cue_ord")) - 1, "_size": F.count("*").over(own)})
    length = F.greatest(F.lit(CHUNKS[0]), F.least(F.lit(CHUNKS[1]), F.ceil(F.sqrt("_size")))).cast("int")
    columns = [c for c in islands.columns if c not in (*CLIP, "_island", "_n")]
    row = F.struct("cue_ord", *[c for c in columns if c != "cue_ord"], "_reach", "_may")
    chunks = counted.groupBy(*CLIP, "_island", F.floor(F.col("_pos") / length).alias("_chunk")).agg(F.sort_array(F.collect_list(row)).alias("_rows"), (F.first("_size") > F.first(length)).alias("_long"))

    def after(state: Column, r: Column) -> Column:
        cues = F.when((state == full) & ~r["_may"], full).when(state == full, 1).otherwise(state + 1)
        return F.when(cues >= r["_reach"], full).otherwise(cues)

    every = F.array(*[F.lit(k) for k in range(full + 1)])
    function = F.when(F.col("_long"), F.aggregate("_rows", every, lambda states, r: F.transform(states, lambda s: after(s, r))))
    before = F.collect_list("_function").over(own.orderBy("_chunk").rowsBetween(Window.unboundedPreceding, -1))
    entered = chunks.withColumn("_function", function).withColumn("_entry", F.aggregate(before, F.lit(0), lambda s, f: F.get(f, s)))
    opens = folded(F.col("_rows"), F.col("_entry"), lambda s, r: F.struct(after(s, r).alias("state"), ((s == 0) | ((s == full) & r["_may"])).cast("int").alias("out")), "int")
    placed = entered.withColumn("_opens", opens).select(*CLIP, F.inline(F.zip_with("_rows", "_opens", lambda r, o: F.struct(*[r[c].alias(c) for c in columns], o.alias("_open")))))
    return placed.select(*CLIP, *columns, (F.sum("_open").over(_order()) - 1).cast("int").alias("window_id"))


def _islands(cues: DataFrame, boundary: Column) -> DataFrame:
    """Cues with their words (``_n``) and a running number of the boundaries before them."""
    marked = cues.withColumn("_n", word_count(F.col("text"))).withColumn("_cut", F.coalesce(boundary, F.lit(False)).cast("int"))
    return marked.withColumn("_island", F.sum("_cut").over(_order())).drop("_cut")


def _gap() -> Column:
    return F.col("start_ms") - F.lag("end_ms").over(_order())


def _before(column: str) -> Column:
    return F.lag(column).over(_order())


def _not_first() -> Column:
    return F.row_number().over(_order()) > 1


def translation_windows(cues: DataFrame) -> DataFrame:
    """Windows close behind a sentence end or a cap, and before a gap; blank cues are in none."""
    ended = _before("text").rlike(r"(?U)[.!?]\s*$")
    return _capped(_islands(drop_blank_cues(cues), (_gap() > MAX_GAP_MS) | ended), F.lit(True))


def dub_windows_fallback(cues: DataFrame) -> DataFrame:
    """Windows close before a gap or another speaker (none is a speaker too), and at caps."""
    change = ~F.col("speaker_label").eqNullSafe(_before("speaker_label"))
    return _capped(_islands(drop_blank_cues(cues), (_gap() > MAX_GAP_MS) | (change & _not_first())), F.lit(True))


def dub_windows_by_segment(cues: DataFrame, segments: DataFrame) -> DataFrame:
    """Windows follow speech turns: an over-long turn is cut at real pauses only, cues outside
    any turn by gaps and caps.  The label is the turn's."""
    placed = assign_segment(drop_blank_cues(cues), segments)
    labels = segments.select(*CLIP, F.col("seg_idx").alias("segment"), F.col("speaker_label").alias("_label"))
    turns = placed.join(labels, [*CLIP, "segment"], "left").drop("speaker_label").withColumnRenamed("_label", "speaker_label")
    change = ~F.col("segment").eqNullSafe(_before("segment"))
    outside = F.col("segment").isNull()
    marked = turns.withColumn("_pause", outside | F.coalesce(_gap() > REAL_PAUSE_MS, F.lit(True)))
    islands = _islands(marked, (change & _not_first()) | (outside & (_gap() > MAX_GAP_MS)))
    return _capped(islands, F.col("_pause")).drop("_pause")


def dub_windows(cues: DataFrame, segments: DataFrame) -> DataFrame:
    """By segment in clips that have segments, otherwise by the cues' own speakers."""
    known = segments.select(*CLIP).distinct()
    with_turns, without = cues.join(known, list(CLIP), "left_semi"), cues.join(known, list(CLIP), "left_anti")
    columns = [*CLIP, "cue_ord", "start_ms", "end_ms", "text", "speaker_label", "window_id"]
    return dub_windows_by_segment(with_turns, segments).select(*columns).unionByName(dub_windows_fallback(without).select(*columns))


def speech_islands(frames: DataFrame) -> DataFrame:
    """Speech intervals of voiced 30 ms frames; pauses of up to 300 ms are bridged."""
    voiced = frames.where("voiced")
    order = _order("frame_no")
    cut = F.coalesce(F.col("frame_no") - F.lag("frame_no").over(order) > BRIDGED_FRAMES, F.lit(False)).cast("int")
    grouped = voiced.withColumn("_cut", cut).withColumn("island", F.sum("_cut").over(order))
    spans = grouped.groupBy(*CLIP, "island").agg((F.min("frame_no") * FRAME_MS).alias("start_ms"), ((F.max("frame_no") + 1) * FRAME_MS).alias("end_ms"))
    kept = min_duration(spans)
    return kept.select(*CLIP, (F.row_number().over(_order("start_ms")) - 1).alias("seg_idx"), "start_ms", "end_ms")


def number_speakers(clusters: DataFrame) -> DataFrame:
    """``Speaker N`` by order of first being heard, for clusters(first_ms)."""
    order = Window.partitionBy(*CLIP).orderBy("first_ms", "cluster_id")
    return clusters.withColumn("speaker_label", F.concat(F.lit("Speaker "), F.row_number().over(order).cast("string")))


def assign_voices(segments: DataFrame) -> DataFrame:
    """Voice and pitch per speaker: each gender's speakers go down the pitches, the last repeats."""
    speakers = segments.groupBy(*CLIP, "speaker_label").agg(F.min("seg_idx").alias("first_idx"), F.min_by("gender", "seg_idx").alias("gender"))
    voice = F.when(F.col("gender") == "male", "male").otherwise("female")
    order = Window.partitionBy(*CLIP, "voice").orderBy("first_idx")
    rank = F.least(F.row_number().over(order), F.lit(len(PITCHES)))
    return speakers.withColumn("voice", voice).withColumn("pitch", F.element_at(F.array(*[F.lit(p) for p in PITCHES]), rank)).select(*CLIP, "speaker_label", "voice", "pitch")


def reindex_clips(pairs: DataFrame) -> DataFrame:
    """Dense 1-based clip_index over kept pairs(pair_no, label_no), and their labels."""
    index = F.row_number().over(Window.partitionBy("video_id").orderBy("pair_no"))
    numbered = pairs.withColumn("clip_index", index)
    return numbered.withColumn("label", F.concat(F.lit("Clip "), F.coalesce("label_no", F.col("clip_index").cast("string")))).drop("pair_no", "label_no")


def concat_timeline(results: DataFrame) -> DataFrame:
    """Start offset of every finished clip in the merged output."""
    done = results.where("status = 'Done' and output_path is not null")
    before = Window.partitionBy("video_id").orderBy("clip_index").rowsBetween(Window.unboundedPreceding, -1)
    return done.withColumn("offset_ms", F.coalesce(F.sum("actual_duration_ms").over(before), F.lit(0)))


def merge_rolling_text(clip_cues: DataFrame) -> DataFrame:
    """The excerpt of each clip: cue after cue without the longest overlap with what is there.

    An overlap is no longer than the cue, so the fold keeps as many last words as the longest
    cue has, and only says how many words of each cue go; the rest is joined once.  Lengths are
    tried where the words at both ends fit: the work is in proportion to the words, but in
    cues that repeat one word over and over.
    """
    own = words(F.col("text"))
    rows = F.sort_array(F.collect_list(F.struct("cue_ord", own.alias("w"), F.transform(own, lambda w: F.lower(w)).alias("low"))))

    most = F.col("_most")

    def step(tail: Column, cue: Column) -> Column:
        low = cue["low"]

        def grown(cut: Column) -> Column:
            return once(F.concat(tail, F.slice(low, cut + 1, F.size(low))), lambda t: F.struct(F.when(F.size(t) > most, F.slice(t, -most, most)).otherwise(t).alias("state"), cut.alias("out")))

        return once(_overlap(tail, low), grown)

    cuts = folded(F.col("_cues"), F.array().cast("array<string>"), step, "int")
    kept = F.flatten(F.zip_with("_cues", "_cuts", lambda c, k: F.slice(c["w"], k + 1, F.greatest(F.size(c["w"]) - k, F.lit(0)))))
    merged = clip_cues.groupBy(*CLIP).agg(rows.alias("_cues"), F.max(F.size(own)).alias("_most")).withColumn("_cuts", cuts).withColumn("_words", kept)
    return merged.select(*CLIP, F.array_join("_words", " ").alias("excerpt"), F.size("_words").alias("n_words"))


def word_shares(counts: Column, total_words: Column) -> Column:
    """How many of total_words each cue with these word counts gets: in proportion, one each while possible."""

    def shared(total: Column, weights: Column, weight: Column) -> Column:
        n = F.size(weights)

        def step(s: Column, c: Column) -> Column:
            i = F.size(s["out"])
            share = F.greatest(F.lit(1), F.rint(total * c / weight).cast("int"))
            share = F.greatest(F.least(share, total - s["sum"] - (n - i - 1)), F.lit(0))
            share = F.when(i == n - 1, total - s["sum"]).otherwise(share)
            return once(share, lambda x: F.struct((s["sum"] + x).alias("sum"), F.array_append(s["out"], x).alias("out")))

        return F.aggregate(weights, F.struct(F.lit(0).alias("sum"), F.array().cast("array<int>").alias("out")), step, lambda s: s["out"])

    # Counts and totals are made once, not once a cue.
    summed = lambda w: F.struct(w.alias("w"), F.aggregate(w, F.lit(0), lambda s, c: s + c).alias("sum"))
    weighed = once(F.transform(counts, lambda c: F.greatest(c, F.lit(1))), summed)
    return once(F.struct(total_words.alias("total"), weighed.alias("weights")), lambda x: shared(x["total"], x["weights"]["w"], x["weights"]["sum"]))


def split_by_word_ratio(windows: DataFrame) -> DataFrame:
    """windows(cues: array of (cue_ord, text, ...), translated) to one row per cue, with all it has and its part."""
    own = words(F.col("translated"))
    counted = windows.withColumn("_w", own).withColumn("_shares", word_shares(F.transform("cues", lambda c: word_count(c["text"])), F.size(own)))
    starts = F.transform(F.sequence(F.lit(1), F.size("_shares")), lambda i: F.aggregate(F.slice("_shares", F.lit(1), i - 1), F.lit(0), lambda s, x: s + x))
    parts = counted.withColumn("_at", starts).select("*", F.posexplode("cues").alias("_i", "_cue"))
    share = F.get("_shares", F.col("_i"))
    part = F.when(F.size("cues") == 1, F.col("translated")).otherwise(F.array_join(F.slice("_w", F.get("_at", F.col("_i")) + 1, F.greatest(share, F.lit(0))), " "))
    return parts.withColumn("part", part).select(*CLIP, "window_id", "_cue.*", "part")


def srt_numbering(clip_cues: DataFrame) -> DataFrame:
    """1-based number of each cue in its clip, by time."""
    return clip_cues.withColumn("srt_no", F.row_number().over(Window.partitionBy(*CLIP).orderBy("rel_start_ms", "cue_ord")))
