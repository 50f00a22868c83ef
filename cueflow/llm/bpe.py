"""Byte-level BPE by dynamic programming over prefixes.

Every byte prefix of a piece has one encoding, and so one last token: the longest token that
ends there and may follow the last token of the prefix before it.  Two tokens may follow each
other if no merge crosses them: the tokens that the end of the left one and the start of the
right one go through while they are built are paired in the order of their ranks, and none of
these pairs merges before one of the two grows.  A table of last tokens is therefore the whole
state of an encoding: ids are read from it backwards, an addition goes on behind its last
entry, and an edit keeps everything up to the edit and everything behind the first place where
the pieces fall together again.

A text is cut into pieces by a pattern, each encoded by itself.  Here a pattern must cover
every character, must not look back, and looks at most three characters past the start and
two past the end of a piece (a run of white space gives its last one back).

Texts pass an Arrow batch at a time, without a shuffle; long ones are cut in windows, so that
only ids grow with a text.  Encodings of pieces and verdicts on pairs are kept per worker, at
most CACHED of each.  The vocabulary (ranks, under a megabyte here) is the only thing sent to
the workers.

Defined results: a null text is empty and has no ids; bytes that aren't UTF-8 are encoded as
they are and come back; a piece that is a token is that token; repeated rows are encoded
each; rows keep a null id; an empty table gives an empty one; further columns are ignored.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator

import numpy as np
import public_tokenizers
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

VOCABULARY = "byte_bpe_multi_50k.tiktoken"
CACHED = 400_000
#: Characters of a window; the largest piece that is kept.
WINDOW, KEPT_CHARS = 1 << 18, 64
#: What a pattern may look at: characters from the start, and from the end, of a piece.
AHEAD, BEHIND = 3, 2
NEVER = 1 << 62
#: Marks the first byte of a piece in a table of last tokens.
FIRST = 1 << 31


class Vocabulary:
    """Ranks of a byte-level BPE and what may follow what."""

    def __init__(self, file: bytes, pattern: str):
        pairs = (line.split() for line in file.splitlines() if line.strip())
        self.rank = {base64.b64decode(token): int(rank) for token, rank in pairs}
        self.bytes = {rank: token for token, rank in self.rank.items()}
        #: Every end of a token: the token that it is, or -1.
        self.ends = {token[k:]: self.rank.get(token[k:], -1) for token in self.rank for k in range(len(token))}
        self.pattern = regex.compile(pattern)
        self._growth: dict[int, tuple | None] = {}
        self._fits: dict[int, bool] = {}
        self._ids: dict[str, bytes] = {}
        if any(bytes([b]) not in self.rank for b in range(256)):
            raise ValueError("every byte must be a token")

    def _merged(self, data: bytes) -> tuple[bytes, ...]:
        """The two parts that the last merge of a token joins; fewer or more where it has none."""
        parts = [data[i : i + 1] for i in range(len(data))]
        while len(parts) > 2:
            rank, at = min((self.rank.get(parts[i] + parts[i + 1], NEVER), i) for i in range(len(parts) - 1))
            if rank == NEVER:
                break
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
        return tuple(parts)

    def growth(self, token: int) -> tuple[list[int], list[int]] | None:
        """The tokens that its first and its last byte are in while a token is built; None if merges don't build it."""
        if token not in self._growth:
            parts = self._merged(self.bytes[token])
            made = None
            if len(parts) == 1:
                made = ([token], [token])
            elif len(parts) == 2:
                left, right = (self.growth(self.rank[p]) for p in parts)
                made = (left[0] + [token], right[1] + [token]) if left and right else None
            self._growth[token] = made
        return self._growth[token]

    def fits(self, a: int, b: int) -> bool:
        """May token b follow token a?"""
        key = a << 32 | b
        known = self._fits.get(key)
        if known is None:
            if len(self._fits) >= CACHED:
                self._fits.clear()
            known = self._fits[key] = self._no_merge_crosses(a, b)
        return known

    def _no_merge_crosses(self, a: int, b: int) -> bool:
        left, right = self.growth(a), self.growth(b)
        if left is None or right is None:
            return False
        ends, starts, i, j = left[1], right[0], 0, 0
        while True:
            grows_left = ends[i + 1] if i + 1 < len(ends) else NEVER
            grows_right = starts[j + 1] if j + 1 < len(starts) else NEVER
            crossing = self.rank.get(self.bytes[ends[i]] + self.bytes[starts[j]], NEVER)
            # Of equal ranks the leftmost merges first.
            if crossing < grows_left and crossing <= grows_right and crossing != NEVER:
                return False
            if grows_left == grows_right == NEVER:
                return True
            if grows_left <= grows_right:
                i += 1
            else:
                j += 1

    def extend(self, data: bytes, last: list[int]) -> None:
        """Adds the last token of every further prefix of a piece to ``last``."""
        ends, fits, known = self.ends.get, self.fits, self._fits.get
        for end in range(len(last) + 1, len(data) + 1):
            start, longer = end - 1, []
            token = ends(data[start:end])
            while token is not None:
                if token >= 0:
                    longer.append((start, token))
                start -= 1
                token = ends(data[start:end]) if start >= 0 else None
            for start, token in reversed(longer):
                if start == 0:
                    fit = self.growth(token) is not None
                else:
                    before = last[start - 1]
                    fit = known(before << 32 | token)
                    if fit is None:
                        fit = fits(before, token)
                if fit:
                    last.append(token)
                    break

    def read(self, data: bytes, last: list[int]) -> list[int]:
        """Ids of a piece from its last tokens."""
        whole = self.rank.get(data)
        if whole is not None:
            return [whole]
        ids, at = [], len(last)
        while at:
            ids.append(last[at - 1])
            at -= len(self.bytes[ids[-1]])
        return ids[::-1]

    def piece_ids(self, piece: str) -> bytes:
        """Ids of a piece as little-endian unsigned 32-bit integers."""
        known = self._ids.get(piece)
        if known is None:
            data, last = to_bytes(piece), []
            if data not in self.rank:
                self.extend(data, last)
            known = np.array(self.read(data, last), dtype="<u4").tobytes()
            if len(piece) <= KEPT_CHARS:
                if len(self._ids) >= CACHED:
                    self._ids.clear()
                self._ids[piece] = known
        return known

    def pieces(self, text: str) -> Iterator[list[str]]:
        """The pieces of a text, some at a time."""
        at, width = 0, WINDOW
        while at < len(text):
            stop = min(len(text), at + width)
            found = self.pattern.findall(text, at, stop)
            if stop < len(text):
                end = stop
                while found and (end + BEHIND > stop or end - len(found[-1]) + AHEAD > stop):
                    end -= len(found.pop())
                if not found:
                    width *= 2
                    continue
                at, width = end, WINDOW
            else:
                at = stop
            yield found

    def encode(self, text: str) -> bytes:
        ids, known = [], self._ids.get
        for found in self.pieces(text):
            ids.append(b"".join([known(piece) or self.piece_ids(piece) for piece in found]))
        return b"".join(ids)

    def decode(self, ids: bytes) -> bytes:
        return b"".join(map(self.bytes.__getitem__, np.frombuffer(ids, dtype="<u4").tolist()))

    def table(self, text: str) -> np.ndarray:
        """The last token at every byte of a text, with FIRST at the first byte of a piece."""
        return revised(self, "", np.zeros(0, dtype="<u4"), 0, 0, text)[1]

    def table_ids(self, data: bytes, last: np.ndarray) -> bytes:
        """Ids of a text from its table."""
        starts = [*np.flatnonzero(last & FIRST).tolist(), len(data)]
        tokens = (last & (FIRST - 1)).tolist()
        return np.array([t for a, z in zip(starts, starts[1:], strict=False) for t in self.read(data[a:z], tokens[a:z])], dtype="<u4").tobytes()


def to_bytes(text: str) -> bytes:
    return text.encode("utf-8", "surrogateescape")


def to_text(data: bytes | None) -> str:
    return (data or b"").decode("utf-8", "surrogateescape")


def revised(vocabulary: Vocabulary, text: str, last: np.ndarray, start: int, stop: int, new: str) -> tuple[str, np.ndarray, int]:
    """The text with [start, stop) replaced by ``new``, its table, and how many bytes were encoded for it.

    Pieces that end before the edit and saw nothing of it stay, as do all from the first one
    behind the edit that starts where one started before.
    """
    begin, end = len(to_bytes(text[:start])), len(to_bytes(text[:stop]))
    changed = text[:start] + new + text[stop:]
    data, behind = to_bytes(changed), begin + len(to_bytes(new))
    shift = behind - end
    starts = np.flatnonzero(last & FIRST)
    ends = np.append(starts[1:], len(last))
    settled = int(np.count_nonzero((ends + 4 * BEHIND <= begin) & (starts + 4 * AHEAD <= begin)))
    at = int(ends[settled - 1]) if settled else 0
    old_starts = set(starts[settled:].tolist())
    parts, encoded = [last[:at]], 0
    where = len(data[:at].decode("utf-8", "surrogateescape"))
    for found in vocabulary.pieces(changed[where:]):
        for piece in found:
            if at >= behind and at - shift in old_starts:
                parts.append(last[at - shift :])
                return changed, np.concatenate(parts), encoded
            own = to_bytes(piece)
            same = min(at + len(own), begin) - at if at in old_starts else 0
            kept = (last[at : at + max(same, 0)] & (FIRST - 1)).tolist()
            # Of the old piece that started here only the part that the new one shares.
            until = int(ends[np.searchsorted(starts, at)]) - at if kept else 0
            kept = kept[:until]
            encoded += len(own) - len(kept)
            vocabulary.extend(own, kept)
            row = np.array(kept, dtype="<u4")
            row[0] |= FIRST
            parts.append(row)
            at += len(own)
    return changed, np.concatenate(parts), encoded


_known: dict[bytes, Vocabulary] = {}


def _vocabulary(file: bytes, pattern: str) -> Vocabulary:
    """The vocabulary of this worker."""
    key = hashlib.sha256(file + pattern.encode()).digest()
    if key not in _known:
        _known.clear()
        _known[key] = Vocabulary(file, pattern)
    return _known[key]


class Tokenizer:
    """A rank file and a pattern; its methods work on DataFrames.

    ``path``: the rank file, read on the driver only.
    """

    def __init__(self, path: str | None = None, pattern: str | None = None):
        with open(path or public_tokenizers.path(VOCABULARY), "rb") as file:
            self.file = file.read()
        self.pattern = pattern or public_tokenizers.PATTERN

    def _mapped(self, df: DataFrame, row, made: str, kinds: tuple) -> DataFrame:
        """``doc_id`` and what ``row(vocabulary, *other columns)`` gives, batch by batch."""
        file, pattern = df.sparkSession.sparkContext.broadcast(self.file), self.pattern

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            vocabulary = _vocabulary(file.value, pattern)
            for batch in batches:
                ids, *columns = batch.columns
                # A few rows at a time: texts can be long.
                for at in range(0, len(ids), 64):
                    rows = [row(vocabulary, *(c[i].as_py() for c in columns)) for i in range(at, min(at + 64, len(ids)))]
                    arrays = [pa.array([r[k] for r in rows], type=kind) for k, kind in enumerate(kinds)]
                    yield pa.RecordBatch.from_arrays([ids[at : at + 64], *arrays], names=["doc_id", *names])

        names = [part.split()[0] for part in made.split(", ")]
        return df.mapInArrow(run, f"doc_id {df.schema['doc_id'].dataType.simpleString()}, {made}")

    def encoded(self, documents: DataFrame) -> DataFrame:
        """doc_id, ids: the ids of each text, as little-endian unsigned 32-bit integers."""
        rows = documents.select("doc_id", F.col("text").cast("binary").alias("text"))
        return self._mapped(rows, lambda v, text: (v.encode(to_text(text)),), "ids binary", (pa.binary(),))

    def decoded(self, encodings: DataFrame) -> DataFrame:
        """doc_id, ids, bytes: the text that ids stand for."""
        rows = encodings.select("doc_id", "ids")
        return self._mapped(rows, lambda v, ids: (ids, v.decode(ids or b"")), "ids binary, bytes binary", (pa.binary(), pa.binary()))

    def tables(self, documents: DataFrame) -> DataFrame:
        """doc_id, text, last: the last token at every byte (with FIRST where a piece starts), the state that edits need."""
        rows = documents.select("doc_id", F.col("text").cast("binary").alias("text"))
        return self._mapped(rows, lambda v, text: (text or b"", v.table(to_text(text)).tobytes()), "text binary, last binary", (pa.binary(), pa.binary()))

    def edited(self, tables: DataFrame, edits: DataFrame) -> DataFrame:
        """tables with edits(doc_id, start, stop, new) applied: doc_id, text, last, n_encoded.

        ``start`` and ``stop`` are code points, cut to the text; nulls are the text's end, a
        null ``new`` is empty.  A document without an edit stays as it is; each has at most
        one edit.  n_encoded counts the bytes that were encoded anew.
        """
        changes = edits.select("doc_id", F.col("start").cast("long").alias("start"), F.col("stop").cast("long").alias("stop"), F.col("new").cast("binary").alias("new"), F.lit(True).alias("edit"))
        rows = tables.select("doc_id", "text", "last").join(changes, "doc_id", "left").select("doc_id", "text", "last", "start", "stop", "new", "edit")
        return self._mapped(rows, _edit, "text binary, last binary, n_encoded long", (pa.binary(), pa.binary(), pa.int64()))

    def appended(self, tables: DataFrame, additions: DataFrame) -> DataFrame:
        """tables with additions(doc_id, addition) behind their texts, as ``edited`` gives them."""
        end = F.lit(None).cast("long")
        return self.edited(tables, additions.select("doc_id", end.alias("start"), end.alias("stop"), F.col("addition").alias("new")))

    def table_ids(self, tables: DataFrame) -> DataFrame:
        """doc_id, ids of tables."""
        rows = tables.select("doc_id", "text", "last")
        return self._mapped(rows, lambda v, text, last: (v.table_ids(text, np.frombuffer(last, dtype="<u4")),), "ids binary", (pa.binary(),))


def _edit(vocabulary: Vocabulary, data: bytes, last: bytes, start: int | None, stop: int | None, new: bytes | None, edit: bool | None) -> tuple[bytes, bytes, int]:
    if not edit:
        return data, last, 0
    text = to_text(data)
    start = len(text) if start is None else min(max(start, 0), len(text))
    stop = len(text) if stop is None else min(max(stop, start), len(text))
    changed, table, encoded = revised(vocabulary, text, np.frombuffer(last, dtype="<u4"), start, stop, to_text(new))
    return to_bytes(changed), table.tobytes(), encoded


def token_digests(documents: DataFrame, path: str | None = None) -> DataFrame:
    """doc_id, n_tokens, and the digests of the ids and of the bytes that they decode to."""
    tokenizer = Tokenizer(path)
    back = tokenizer.decoded(tokenizer.encoded(documents))
    return back.select("doc_id", (F.octet_length("ids") / 4).cast("long").alias("n_tokens"), F.sha2("ids", 256).alias("ids_sha256"), F.sha2("bytes", 256).alias("decoded_sha256"))
