"""The prefix trie, hard negatives and byte-level BPE against brute force and another library."""

import base64
import hashlib
import math
import random
import zlib
from collections import defaultdict

import duckdb
import numpy as np
import public_tokenizers
import pytest
import tiktoken
from pyspark.sql import functions as F

from cueflow.llm import bpe, hard_negatives, prefix_trie
from cueflow.llm import queries as Q

NODE = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]
TURN = "conv_id long, turn long, role string, text string"


def ordered(rows):
    return sorted(rows, key=lambda r: tuple((x is not None, x if x is not None else 0) for x in r))


def trie(rows):
    own = defaultdict(list)
    for c, t, r, x in rows:
        if c is not None:
            own[c].append(((t is not None, t or 0), r or "", x or ""))
    digest = lambda r, x: hashlib.sha256(f"{len(r)}:{r}{x}".encode()).digest()[:16]
    own = {c: [(r, x) for _, r, x in sorted(v, key=lambda q: (q[0], q[1], digest(q[1], q[2])))] for c, v in own.items()}
    full = {}
    for c, v in own.items():
        h = zlib.crc32(str(c).encode()) % 6
        full[c] = tuple(own.get(c - c % 100, [])[:h] + v[h:])
    nodes, children, leaves, saved = defaultdict(list), defaultdict(set), defaultdict(int), defaultdict(int)
    for c, v in full.items():
        for d in range(len(v) + 1):
            nodes[v[:d]].append(c)
    for n in nodes:
        if n:
            children[n[:-1]].add(n)
    for n, m in nodes.items():
        for d in range(len(n) + 1):
            leaves[n[:d]] += not children[n]
            saved[n[:d]] += (len(m) - 1) * (len(n[-1][1]) if n else 0)
    ends = lambda n, m: hashlib.sha256(",".join(map(str, sorted(c for c in m if full[c] == n))).encode()).hexdigest()
    return ordered((min(m), len(n), min(nodes[n[:-1]]) if n else None, len(m), len(children[n]), leaves[n], saved[n], ends(n, m)) for n, m in nodes.items())


def nodes_of(spark, rows):
    return ordered(tuple(r) for r in prefix_trie.prefix_trie(spark.createDataFrame(rows, TURN)).select(*NODE).collect())


@pytest.fixture(scope="module")
def talks():
    rng = random.Random(2)
    rows = []
    for c in [*range(30), *range(100, 115), *range(205, 230)]:
        for t in range(rng.choice([1, 2, 3, 3, 7, 14])):
            rows.append((c, t, rng.choice(["user", "assistant"]) if rng.random() < 0.1 else "user", f"m{t}" if rng.random() < 0.93 else rng.choice(["x", None, "é😀", ""])))
    # Nulls, ties, repeated turns, an exact copy of a long one, and two that part late.
    rows += [(None, 1, "a", "b"), (300, None, None, None), (300, 0, "u", "q"), (300, 0, "u", "q"), (300, 0, "u", "r")]
    rows += [(c, t, "user", f"long {t if t < 17 else c * t}") for c in (401, 402, 403) for t in range(20)] + [(404, t, "user", f"long {t if t < 17 else 401 * t}") for t in range(20)]
    return rows


def test_trie_is_the_brute_force_one(spark, talks):
    assert nodes_of(spark, talks) == trie(talks)


def test_trie_of_nothing_of_one_and_with_clashing_columns(spark, talks):
    empty = spark.createDataFrame([], TURN)
    assert prefix_trie.prefix_trie(empty).count() == 0
    one = [(5, t, "user", "y" * t) for t in range(200)]
    assert nodes_of(spark, one) == trie(one)
    few = spark.createDataFrame(talks[:60], TURN)
    clash = few.select("*", *[F.lit("clash").alias(x) for x in ("k", "h", "parent", "path", "depth", "done", "digest", "chars", "n_convs", "base")])
    assert ordered(tuple(r) for r in prefix_trie.prefix_trie(clash).select(*NODE).collect()) == trie(talks[:60])


def test_digests_of_many_members(spark):
    n = 2 * prefix_trie.PIECE + 5
    ends = spark.range(n).select(F.lit(b"a").alias("h"), (F.col("id") * 3 - 50).alias("conv_id")).union(spark.createDataFrame([(b"b", 7)], "h binary, conv_id long")).repartition(3)
    want = hashlib.sha256(",".join(str(i * 3 - 50) for i in range(n)).encode()).hexdigest()
    assert {bytes(r.h): r.ends_sha256 for r in prefix_trie.ends_digests(ends).collect()} == {b"a": want, b"b": hashlib.sha256(b"7").hexdigest()}


def negatives(rows):
    data = {}
    for i, e, label in rows:
        if i is None or label is None or e is None or any(x is None or not math.isfinite(x) for x in e):
            continue
        label = (label + 1) % 10 if i % 7 == 0 else label
        v = [math.floor(256 * x) for x in e]
        if sum(float(x) * x for x in v) < hard_negatives.LONGEST:
            data[i] = min(data.get(i, (label, v)), (label, v))
    out = []
    for a, (own, va) in data.items():
        if a % 50 == 0:
            score = {i: sum(x * y for x, y in zip(va, v)) for i, (_, v) in data.items()}
            best = lambda keep: sorted((i for i in data if keep(i)), key=lambda i: (-score[i], i))  # noqa: B023, E731
            others = best(lambda i: data[i][0] != own)
            for p in best(lambda i: data[i][0] == own and i != a)[:5]:
                fit = [i for i in others if 50 * score[p] <= 100 * score[i] <= 95 * score[p]][:3]
                out += [(a, p, r + 1, i, score[p], score[i]) for r, i in enumerate(fit)]
    return sorted(out)


PAIR = ["anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"]


def test_negatives_are_the_brute_force_ones(spark):
    rng = random.Random(4)
    # Few values make ties; vectors of other lengths, nulls, huge ones, and one id twice.
    rows = [(i, [rng.choice([-1.0, 0.0, 0.5, 0.25, 1.0]) for _ in range(rng.choice([3, 3, 3, 2, 0]))], rng.randint(0, 3)) for i in range(400)]
    rows += [(401, None, 1), (402, [1.0, None, 2.0], 1), (403, [float("nan"), 1.0], 2), (404, [float("inf")], 2), (450, [1.0, 1.0, 1.0], None), (None, [1.0], 1), (550, [1e30, 1.0], 1)]
    rows += [(1000, [8e6, 1.0, 1.0], 1), (1001, [7e6, 2.0, 1.0], 1), (1002, [5e6, 2.0, 1.0], 2), (1003, [5e6 + 1, 2.0, 1.0], 2), (7, [1.0, 1.0, 1.0], 3), (7, [1.0, 1.0, 1.0], 3)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int").select("*", *[F.lit("clash").alias(x) for x in ("v", "x", "g", "kind", "score", "rank", "anchor_id")])
    kept, want = hard_negatives.usable(df, hard_negatives.every_seventh_moved()), negatives(rows)
    for groups in (1, 3):
        assert sorted(tuple(r) for r in hard_negatives.hard_negatives(kept, F.col("vec_id") % 50 == 0, groups).select(*PAIR).collect()) == want
    assert hard_negatives.mined(df.limit(0)).count() == 0


def test_bounds_hold_the_scores():
    rng = np.random.default_rng(1)
    vectors = [*rng.integers(-300, 300, (150, 16)).tolist(), [0] * 16, [1] * 16, [1] * 16, [-1] * 16, [2**26] * 16]
    rows = hard_negatives.Vectors(list(range(len(vectors))), [0] * len(vectors), vectors, np.array([[1.0] + [0.0] * 15, [0.25] * 16]))
    low, high = hard_negatives.bounds(rows, rows)
    score = hard_negatives.scores(rows, rows)
    assert (low <= score).all() and (score <= high).all() and (score == rows.v.astype(object) @ rows.v.T.astype(object)).all()


def test_negatives_filter_by_angles(spark):
    """Rows of another direction get no inner product."""
    seen = []
    kept, hard_negatives.scores = hard_negatives.scores, lambda a, b: seen.append(len(a.ids) * len(b.ids)) or kept(a, b)
    try:
        axes = np.eye(8)
        rng = np.random.default_rng(3)
        near, far = rng.normal(0, 1, (50, 8)) + 500 * axes[0], rng.normal(0, 1, (400, 8)) + 500 * axes[7]
        anchors = hard_negatives.Vectors([0], [1], [[500] + [0] * 7], axes)
        rows = hard_negatives.Vectors(list(range(1, 451)), [2] * 450, np.floor(np.vstack([near, far])).astype(int).tolist(), axes)
        search = hard_negatives._Search(anchors, 1, 3)
        search.meet(rows, np.ones((1, 450), dtype=bool), np.array([[200_000]]), np.array([[10**6]]))
        assert 0 < sum(seen) <= 50 and len(list(search.found())) == 3
    finally:
        hard_negatives.scores = kept


@pytest.fixture(scope="module")
def library():
    with open(public_tokenizers.path(bpe.VOCABULARY), "rb") as file:
        lines = file.read().splitlines()
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


def ids_of(library, text):
    return np.array(library.encode_ordinary(text), dtype="<u4").tobytes()


def scrap(rng, n):
    return "".join(rng.choice(["a", "e", " ", "  ", "\n", "'", "'s", "'ll", "'r", "12", "é", "漢字", "😀", "!", "ß", "th", "ing", " ", "\xa0", "\x1c"]) for _ in range(n))


def test_tokens_are_the_library_s(spark, documents, rows, library):
    clash = documents.select("*", *[F.lit("clash").alias(x) for x in ("ids", "bytes", "n_tokens", "last")])
    got = sorted((repr(r.doc_id), r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in bpe.token_digests(clash).collect())
    sha = lambda b: hashlib.sha256(b).hexdigest()
    assert got == sorted((repr(r[0]), len(x) // 4, sha(x), sha((r[1] or "").encode())) for r in rows for x in [ids_of(library, r[1] or "")])
    assert bpe.token_digests(documents.limit(0)).count() == 0


def test_bytes_that_are_no_text_come_back(spark):
    df = spark.sql("SELECT 1L AS doc_id, cast(unhex('61ff20c3') AS string) AS text")
    tokenizer = bpe.Tokenizer()
    assert bytes(tokenizer.decoded(tokenizer.encoded(df)).first().bytes) == b"a\xff \xc3"


def test_long_texts_and_windows(library, monkeypatch):
    vocabulary = bpe._vocabulary(bpe.Tokenizer().file, public_tokenizers.PATTERN)
    for text in ("a" * 200_000, " " * 100_000 + "x", "ab" * 50_000 + " 漢" * 1000):
        assert vocabulary.encode(text) == ids_of(library, text) if len(text) < 1000 else vocabulary.decode(vocabulary.encode(text)) == text.encode()
    rng = random.Random(6)
    monkeypatch.setattr(bpe, "WINDOW", 7)
    for _ in range(500):
        text = scrap(rng, rng.randint(0, 40))
        assert vocabulary.encode(text) == ids_of(library, text)


def test_every_prefix_has_its_last_token(library):
    vocabulary = bpe._vocabulary(bpe.Tokenizer().file, public_tokenizers.PATTERN)
    for piece in ("internationalization", " Donaudampfschifffahrt", "aaaaaaaaaaaa", " straßenbahn"):
        last = []
        vocabulary.extend(piece.encode(), last)
        for k in range(1, len(piece) + 1):
            part = piece[:k]
            assert last[len(part.encode()) - 1] == library.encode_ordinary(part)[-1]


def test_edits_and_additions_equal_encoding_anew(spark, library):
    rng = random.Random(5)
    vocabulary = bpe._vocabulary(bpe.Tokenizer().file, public_tokenizers.PATTERN)
    for _ in range(1500):
        text, new = scrap(rng, rng.randint(0, 30)), scrap(rng, rng.randint(0, 4))
        start = rng.choice([len(text), rng.randint(0, len(text))])
        stop = min(len(text), start + rng.randint(0, 4))
        changed, table, _ = bpe.revised(vocabulary, text, vocabulary.table(text), start, stop, new)
        assert changed == text[:start] + new + text[stop:] and np.array_equal(table, vocabulary.table(changed))
        assert vocabulary.table_ids(changed.encode(), table) == ids_of(library, changed)

    long = "some words of a text, and more of them. " * 2000
    df = spark.createDataFrame([(1, long), (2, "short"), (3, None), (4, "un")], "doc_id long, text string")
    tokenizer = bpe.Tokenizer()
    tables = tokenizer.tables(df)
    edits = spark.createDataFrame([(1, 40_000, 40_003, "XY"), (2, None, None, "er"), (3, 5, 9, "new"), (9, 0, 0, "nobody")], "doc_id long, start long, stop long, new string")
    edited = tokenizer.edited(tables, edits)
    want = {1: long[:40_000] + "XY" + long[40_003:], 2: "shorter", 3: "new", 4: "un"}
    got = {r.doc_id: r for r in edited.collect()}
    assert {i: bytes(r.text).decode() for i, r in got.items()} == want
    assert got[1].n_encoded < 60 and got[4].n_encoded == 0
    assert {r.doc_id: bytes(r.ids) for r in tokenizer.table_ids(edited).collect()} == {i: ids_of(library, x) for i, x in want.items()}
    added = tokenizer.appended(tables, spark.createDataFrame([(1, "and an end"), (4, "believable")], "doc_id long, addition string"))
    got = {r.doc_id: r for r in added.collect()}
    assert bytes(got[1].text).decode() == long + "and an end" and got[1].n_encoded < 30 and bytes(got[4].text) == b"unbelievable"
    assert {r.doc_id: bytes(r.ids) for r in tokenizer.table_ids(added).collect()}[4] == ids_of(library, "unbelievable")


@pytest.mark.parametrize("name", ["op11_conversation_prefix_trie", "op12_hard_negative_mining"])
def test_queries_agree_with_sql(spark, sf_dir, name):
    con = duckdb.connect()
    for t in ("conversations", "embeddings"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf_dir}/{t}.parquet')")
    cursor = con.execute(Q.ORACLE_SQL[name])
    columns = [d[0] for d in cursor.description]
    want = ordered(cursor.fetchall())
    got = Q.QUERIES[name](spark, sf_dir)
    assert sorted(got.columns) == sorted(columns) and want
    assert ordered(tuple(r) for r in got.select(*columns).collect()) == want
