"""The operators over documents against brute force."""

import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from cueflow.llm.decontamination import contaminated, decontaminated
from cueflow.llm.draws import communication_matrix, hypergeometric, permuted
from cueflow.llm.lines import deduplicated_lines, without_repeated_lines
from cueflow.llm.mixing import mixed, mixture
from cueflow.llm.ngram_join import ngram_components, one_of_each_component
from cueflow.llm import passages
from cueflow.llm.passages import repeated_passages
from cueflow.llm.quality import judged, quality_filter
from cueflow.llm.shared import maybe_among
from cueflow.llm.sharding import document_shards, sharded

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def lower(text):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text)


def sets_of(rows, k):
    out = []
    for _, text, *_ in rows:
        w = WORD.findall(lower(text or ""))
        out.append({tuple(w[i : i + k]) for i in range(len(w) - k + 1)} if len(w) >= k else ({tuple(w)} if w else set()))
    return out


def components(rows, k, percent):
    sets = sets_of(rows, k)
    parent = list(range(len(rows)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i, a in enumerate(sets):
        for j in range(i):
            b = sets[j]
            if a and b and 100 * len(a & b) >= percent * len(a | b):
                parent[find(i)] = find(j)
    groups = defaultdict(list)
    for i in range(len(rows)):
        groups[find(i)].append(i)
    return sets, groups


def test_ngram_components(spark, documents, rows, clashing, nothing):
    for k, percent in ((3, 90), (5, 80), (3, 60)):
        sets, groups = components(rows, k, percent)
        want = Counter()
        for members in groups.values():
            ids = [rows[i][0] for i in members if rows[i][0] is not None]
            want.update((rows[i][0], len(sets[i]), min(ids, default=None) if sets[i] else rows[i][0]) for i in members)
        assert Counter(tuple(r) for r in ngram_components(documents, k, percent).collect()) == want
    assert Counter(tuple(r) for r in ngram_components(clashing, 3, 60).collect()) == want
    assert ngram_components(nothing).count() == 0


def test_one_of_each_component(documents, rows, clashing, nothing):
    sets, groups = components(rows, 5, 80)
    kept = one_of_each_component(documents)
    assert kept.columns == documents.columns
    want = sum(len({rows[i][:2] for i in m}) if not sets[m[0]] else 1 for m in groups.values())
    assert kept.count() == want == one_of_each_component(clashing).count()
    assert one_of_each_component(nothing).count() == 0


def test_repeated_rows_of_one_component(spark):
    """Rows without words all stay, whatever else is repeated."""
    for text_rows in (1, 2):
        rows = [(1, None), (1, None), (3, " ")] + [(2, "some text")] * text_rows
        kept = one_of_each_component(spark.createDataFrame(rows, "doc_id long, text string")).collect()
        assert sorted((r.doc_id, r.text or "") for r in kept) == [(1, ""), (1, ""), (2, "some text"), (3, " ")]


def test_rows_that_a_join_drops_stay_out(spark):
    """All chosen rows pass the filter of slots, and next to none of the others; negative keys and nulls too."""
    rows = spark.range(-20000, 20000).selectExpr("if(id = 7, null, id) as node", "id as other")
    chosen = spark.range(-20000, 20000, 100).selectExpr("id as node")
    got = {r.node for r in maybe_among(rows, "node", chosen).collect()}
    assert set(range(-20000, 20000, 100)) <= got and len(got) < 420
    assert maybe_among(rows, "node", chosen.where("node > 90000")).count() == 0


def test_large_groups_of_near_copies(spark):
    """A bucket of hundreds whose members link through others only."""
    base = [f"w{i}" for i in range(120)]
    rows = []
    for i in range(300):
        words = list(base)
        for e in range(i % 5):
            words[(i * 7 + e * 31) % 120] = f"u{i}_{e}"
        rows.append((i, " ".join(words)))
    rows += [(1000 + i, " ".join(base[: 100 + i % 20])) for i in range(40)]
    got = {r.doc_id: r.component_id for r in ngram_components(spark.createDataFrame(rows, "doc_id long, text string"), 3, 90).collect()}
    _, groups = components(rows, 3, 90)
    want = {rows[i][0]: min(rows[j][0] for j in m) for m in groups.values() for i in m}
    assert got == want


def test_repeated_passages(spark, documents, rows, clashing, nothing):
    texts = defaultdict(list)
    for d, text, *_ in rows:
        texts[tuple(WORD.findall(lower(text or "")))].append(d)
    runs = defaultdict(set)
    for words in texts:
        for i in range(len(words) - 49):
            runs[words[i : i + 50]].add(words)
    out = repeated_passages(documents).collect()
    covered = defaultdict(set)
    for r in out:
        for p in r.passages:
            covered[r.doc_id] |= set(range(p.first, p.last))
    for words, ids in texts.items():
        need = {j for i in range(len(words) - 49) if len(runs[words[i : i + 50]]) > 1 for j in range(i, i + 50)}
        for d in ids:
            assert need <= covered[d]
    assert repeated_passages(clashing).count() == len(out)
    assert repeated_passages(nothing).count() == 0


def test_common_lines_are_no_passages(spark):
    """A line of 30 words in many texts is too short; a passage of 55 words among them is found."""
    line, passage = " ".join(f"l{i}" for i in range(30)), " ".join(f"p{i}" for i in range(55))
    rows = [(i, " ".join(f"a{i}_{j}" for j in range(40)) + f" {line} " + " ".join(f"b{i}_{j}" for j in range(40))) for i in range(80)]
    rows += [(100 + i, " ".join(f"c{i}_{j}" for j in range(7 * i + 3)) + f" {passage} {line} d{i}") for i in range(3)]
    got = {r.doc_id for r in repeated_passages(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {100, 101, 102}


def test_recall_of_near_passages(spark):
    """Planted passages of 100 words, a word changed in each: pairs without an equal run of 50, and groups of 6 and 40."""
    rng = random.Random(12)
    vocabulary = ["".join(rng.choice("abcdefghijklmnop") for _ in range(rng.randint(2, 8))) for _ in range(3000)]
    words = lambda n: [rng.choice(vocabulary) for _ in range(n)]
    rows, members, passages_of = [], {}, {}
    for size, groups in ((2, 100), (6, 20), (40, 3)):
        for g in range(groups):
            passage = words(100)
            for k in range(size):
                # Pairs have no run of 50 equal words; in groups some have.
                near = list(passage)
                near[rng.randint(35, 49) if k % 2 else rng.randint(51, 65)] = f"z{len(rows)}"
                members.setdefault((size, g), []).append(len(rows))
                passages_of[len(rows)] = near
                rows.append((len(rows), " ".join(words(rng.randint(20, 120)) + near + words(rng.randint(20, 120)))))
    clean = [(10_000 + i, " ".join(words(200))) for i in range(60)]
    found = {r.doc_id for r in repeated_passages(spark.createDataFrame(rows + clean, "doc_id long, text string")).collect()}
    shingles = {i: {tuple(w[k : k + 5]) for k in range(96)} for i, w in passages_of.items()}
    recall = {}
    for (size, _), ids in members.items():
        for i in ids:
            if any(len(shingles[i] & shingles[j]) >= 0.8 * len(shingles[i] | shingles[j]) for j in ids if j != i):
                recall.setdefault(size, []).append(i in found)
    recall = {k: sum(v) / len(v) for k, v in recall.items()}
    assert min(recall.values()) >= 0.9, recall
    assert all(i < 10_000 for i in found)


def test_near_passages_of_large_groups(spark):
    """Originals of 60 words and 21 copies each, a word changed at another place: copies are alike enough to their original only."""
    rng = random.Random(17)
    words = lambda n: ["".join(rng.choice("abcdefghijklmnop") for _ in range(6)) for _ in range(n)]
    around = lambda x: " ".join(words(80) + x + words(80))
    rows, copies = [], set()
    for _ in range(12):
        original = words(60)
        rows.append((len(rows), around(original)))
        for at in range(20, 41):
            copies.add(len(rows))
            rows.append((len(rows), around(original[:at] + words(1) + original[at + 1 :])))
    clean = [(len(rows) + i, around(words(60))) for i in range(50)]
    out = repeated_passages(spark.createDataFrame(rows + clean, "doc_id long, text string")).collect()
    assert {r.doc_id for r in out} <= set(range(len(rows)))
    share = sum(r.doc_id in copies for r in out) / len(copies)
    assert share >= 0.9, share


def test_two_changed_words_in_large_groups(spark):
    """Originals of 100 words with 30, 60 and 100 copies, two words changed in each: alike enough to the original only."""
    rng = random.Random(5)
    words = lambda n: ["".join(rng.choice("abcdefghijklmnop") for _ in range(6)) for _ in range(n)]
    around = lambda x: " ".join(words(80) + x + words(80))
    rows, copies = [], defaultdict(list)
    for size in (30, 30, 60, 100):
        original = words(100)
        rows.append((len(rows), around(original)))
        for _ in range(size):
            near = list(original)
            near[rng.randint(30, 38)], near[rng.randint(62, 70)] = words(2)
            copies[size].append(len(rows))
            rows.append((len(rows), around(near)))
    clean = [(len(rows) + i, around(words(60))) for i in range(50)]
    found = {r.doc_id for r in repeated_passages(spark.createDataFrame(rows + clean, "doc_id long, text string")).collect()}
    assert found <= set(range(len(rows)))
    recall = {size: sum(i in found for i in ids) / len(ids) for size, ids in copies.items()}
    assert min(recall.values()) >= 0.9, recall


def test_windows_left_over_meet_all_members(spark, monkeypatch):
    """Pairs of near copies among many texts that share 45 of their 60 words, and so most minima, but aren't alike enough."""
    monkeypatch.setattr(passages, "BLOCK", 8, raising=False)
    rng = random.Random(23)
    words = lambda n: ["".join(rng.choice("abcdefghijklmnop") for _ in range(6)) for _ in range(n)]
    common, rows = words(45), []
    for _ in range(40):
        own = words(8) + common + words(7)
        near = own[:30] + words(1) + own[31:]
        rows += [(len(rows), " ".join(own)), (len(rows) + 1, " ".join(near))]
    links = {(r.doc_id, p.partner) for r in repeated_passages(spark.createDataFrame(rows, "doc_id long, text string")).collect() for p in r.passages}
    found = {a for a, b in links if a // 2 == b // 2}
    assert len(found) >= 0.9 * len(rows), len(found)


def test_lines_in_common_leave_no_meetings(spark, monkeypatch):
    """Windows around a line of 13 words that all texts have, and nothing else, hold no passage, so they meet nobody in the end."""
    met, remaining = [], passages._remaining

    def counted(members, bare):
        out = remaining(members, bare)
        met.append(out.count())
        return out

    monkeypatch.setattr(passages, "_remaining", counted)
    rng = random.Random(31)
    words = lambda n: ["".join(rng.choice("abcdefghijklmnop") for _ in range(6)) for _ in range(n)]
    line = words(13)
    rows = [(i, " ".join(words(30) + line + words(30))) for i in range(60)]
    assert repeated_passages(spark.createDataFrame(rows, "doc_id long, text string")).count() == 0
    assert met == [0]


def test_near_passages_share_a_sampled_run():
    """Of words, of words repeated a dozen times and of sentences repeated: pairs of passages alike enough share a sample."""
    rng = random.Random(37)
    words = lambda n: ["".join(rng.choice("abcdefghijklmnop") for _ in range(6)) for _ in range(n)]
    kinds, missed = (lambda: words(60), lambda: [w for w in words(6) for _ in range(rng.randint(6, 14))], lambda: words(14) * 5, lambda: words(120)), 0
    tried = 0
    while tried < 400:
        own = kinds[tried % 4]()
        near = list(own)
        if tried % 4 == 1:
            near = [w for w in dict.fromkeys(own) for _ in range(rng.randint(6, 14))]
        for _ in range(1 + (len(own) > 100)):
            if tried % 4 != 1 or rng.random() < 0.2:
                near[rng.randrange(len(near))] = words(1)[0]
        texts = [passages._shingles(" ".join(words(20) + x + words(20))) for x in (own, near)]
        whole = [set(passages._shingles(" ".join(x)).tolist()) for x in (own, near)]
        if min(len(own), len(near)) < 50 or 100 * len(whole[0] & whole[1]) < passages.PERCENT * len(whole[0] | whole[1]):
            continue
        tried += 1
        first, second = (set(passages.run_samples(x, np.array([0, len(x)]))[0].tolist()) for x in texts)
        missed += not first & second
    assert missed == 0


def test_equal_runs_around_covered_minima(spark):
    """Texts that share a passage of 50 words with many texts, and it with 20 words more with one: all 70 words are covered."""
    rng = random.Random(41)
    words = lambda n: ["".join(rng.choice("abcdefghijklmnop") for _ in range(6)) for _ in range(n)]
    rows, pairs = [], []
    for _ in range(12):
        common = words(50)
        rows += [(len(rows) + i, " ".join(words(60) + common + words(60))) for i in range(20)]
        for _ in range(8):
            own = common + words(20)
            pairs += [len(rows), len(rows) + 1]
            rows += [(len(rows) + i, " ".join(words(60) + own + words(60))) for i in range(2)]
    out = {r.doc_id: {j for p in r.passages for j in range(p.first, p.last)} for r in repeated_passages(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert [i for i in pairs if not set(range(60, 130)) <= out[i]] == []


def test_functions_of_small_and_large_groups_agree(spark):
    """Near copies of 64 words, 30 of which many texts have: functions of large and small groups agree, and the densest part alone is too short."""
    rng = random.Random(43)
    words = lambda n: ["".join(rng.choice("abcdefghijklmnop") for _ in range(6)) for _ in range(n)]
    line = words(30)
    rows = [(i, " ".join(words(60) + line + words(60))) for i in range(60)]
    pairs = []
    for _ in range(150):
        own = words(17) + line + words(17)
        near = list(own)
        near[rng.choice((14, 49))] = words(1)[0]
        pairs.append(len(rows))
        rows += [(len(rows), " ".join(words(60) + own + words(60))), (len(rows) + 1, " ".join(words(60) + near + words(60)))]
    found = {r.doc_id for r in repeated_passages(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    missed = [i for i in pairs if i not in found]
    assert len(missed) <= 0.05 * len(pairs), len(missed)


def test_partners_are_shingled_once(monkeypatch):
    """A partner that comes again with another text isn't cut into shingles again."""
    calls, shingled = [], passages._shingles
    monkeypatch.setattr(passages, "_shingles", lambda text: calls.append(text) or shingled(text))
    text = " ".join(f"w{i}" for i in range(60))
    hits = [{"f": f, "la": 0, "ca": 20, "ra": 55, "lb": 0, "cb": 20, "rb": 55} for f in range(2)]
    kinds = pa.list_(pa.struct([(x, pa.int32()) for x in ("f", "la", "ca", "ra", "lb", "cb", "rb")]))
    columns = [pa.array([1, 2, 3]), pa.array([9, 9, 9]), pa.array([text] * 3), pa.array([text] * 3), pa.array([hits] * 3, kinds)]
    found = [r for b in passages._check(iter([pa.RecordBatch.from_arrays(columns, names=["a", "b", "text_a", "text_b", "hits"])])) for r in b.to_pylist()]
    assert {(r["node"], r["first"], r["last"], r["partner"]) for r in found} == {(a, 0, 60, 9) for a in (1, 2, 3)} | {(9, 0, 60, a) for a in (1, 2, 3)}
    assert len(calls) == 4


def test_remaining_windows_meet_once(spark, monkeypatch):
    """Every bare window meets every member of its key in another text, once, in blocks of any size."""
    columns = "key long, f int, node long, l int, c int, r int"
    members = [(1, 0, n, 0, 5, 60) for n in range(40)] + [(2, 1, n, 0, 5, 60) for n in range(3)]
    bare = [m for m in members if m[2] % 3 == 0]
    for block in (1, 7, 1024):
        monkeypatch.setattr(passages, "BLOCK", block)
        got = [(r.key, *sorted((r.a, r.b))) for r in passages._remaining(spark.createDataFrame(members, columns), spark.createDataFrame(bare, columns)).collect()]
        want = {(m[0], *sorted((m[2], x[2]))) for m in members for x in bare if m[0] == x[0] and m[2] != x[2]}
        assert sorted(got) == sorted(want), block


def test_quality_statistics(documents, rows, clashing, nothing):
    want = Counter()
    for d, text, *_ in rows:
        text = text or ""
        w = WORD.findall(text)
        lines, dup = set(), 0
        for line in text.split("\n"):
            if WORD.search(line):
                dup += line in lines
                lines.add(line)
        counts = Counter(tuple(w[i : i + 5]) for i in range(len(w) - 4))
        covered = {j for i in range(len(w) - 4) if counts[tuple(w[i : i + 5])] > 1 for j in range(i, i + 5)}
        want[d, len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in text), dup, len(covered), len(w) < 10 or 100 * len(covered) > 20 * len(w)] += 1
    columns = ["doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed"]
    out = judged(documents)
    assert Counter(tuple(r) for r in out.select(*columns).collect()) == want
    assert out.where("base_failed and kept").count() == 0
    assert judged(clashing).where("kept").count() == out.where("kept").count() == quality_filter(documents).count() == quality_filter(clashing).count()
    assert judged(nothing).count() == 0 and quality_filter(nothing).count() == 0


def test_outliers_are_rejected_and_clean_rows_kept(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    rates = judged(docs).where("not base_failed").join(labels, "doc_id").groupBy("quality").agg(F.avg(F.col("kept").cast("int")).alias("kept")).collect()
    by = {r.quality: r.kept for r in rates}
    assert by[1] >= 0.97 and by.get(0, 0) <= 0.1
    assert [tuple(r) for r in judged(docs).orderBy("doc_id").select("doc_id", "kept").collect()] == [tuple(r) for r in judged(docs.repartition(5)).orderBy("doc_id").select("doc_id", "kept").collect()]


def targets(sizes):
    """Targets by filling up one source after the other."""
    sources = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    weight = {s: (3, 1, 2)[i % 3] for i, s in enumerate(sources)}
    target, full, left = {}, set(), 1.5 * sum(sizes.values())
    while True:
        open_ = [s for s in sources if s not in full]
        level = left / sum(weight[s] for s in open_) if open_ else 0
        over = [s for s in open_ if weight[s] * level > 2 * sizes[s] + 1e-9]
        if not over:
            return target | {s: weight[s] * level for s in open_}
        for s in over:
            target[s] = 2.0 * sizes[s]
            left -= target[s]
            full.add(s)


def test_mixture(documents, rows, clashing, nothing):
    out = mixture(documents).join(documents.select("doc_id", "source").distinct(), "doc_id").collect()
    sizes = Counter()
    for _, text, _, source, _ in rows:
        sizes[source] += len(WORD.findall(text or ""))
    want = targets(sizes)
    taken = Counter()
    for r in mixture(documents).collect():
        assert 0 <= r.taken <= 2 * r.size
    seen = set()
    for r in out:
        assert r.source_size == sizes[r.source] and abs(r.target - want[r.source]) < 1e-6
        if (r.doc_id, r.taken, r.size) not in seen or r.doc_id == 4:
            taken[r.source] += r.taken
    for source in {r.source for r in out if r.doc_id is not None}:
        assert abs(taken[source] - want[source]) <= 600
    first = Counter(tuple(r) for r in mixture(documents).collect())
    assert first == Counter(tuple(r) for r in mixture(documents.repartition(7)).collect()) == Counter(tuple(r) for r in mixture(clashing).collect())
    assert mixture(nothing).count() == 0 and mixed(nothing).count() == 0
    assert mixed(documents).columns == documents.columns and mixed(documents).count() > len(rows)


def test_shards(documents, rows, clashing, nothing):
    out = document_shards(documents).collect()
    assert Counter((r.doc_id, r.size, r.text_crc32) for r in out) == Counter((d, len((t or "").encode()) + 8, zlib.crc32((t or "").encode())) for d, t, *_ in rows)
    slots = defaultdict(list)
    for r in out:
        slots[r.shard].append(r.slot)
    assert set(slots) == set(range(24)) and all(sorted(s) == list(range(len(s))) for s in slots.values())
    assert max(map(len, slots.values())) - min(map(len, slots.values())) <= 1
    assert Counter(out) == Counter(document_shards(documents.repartition(9)).collect()) == Counter(document_shards(clashing).collect())
    full = sharded(documents)
    assert full.columns == [*documents.columns, "shard", "slot"] and full.count() == len(rows)
    assert document_shards(nothing).count() == 0 and sharded(nothing).count() == 0
    # Columns named as the operator's own come through as they are.
    own = [c for c in clashing.columns if c not in ("shard", "slot")]
    out = sharded(clashing)
    assert out.columns == [*own, "shard", "slot"] and out.where("_key = 'clash' and _part = 'clash' and row = 'clash'").count() == len(rows)
    assert Counter(tuple(r) for r in out.select(*documents.columns, "shard", "slot").collect()) == Counter(tuple(r) for r in full.collect())
    mix = mixed(clashing)
    assert mix.columns == clashing.columns and mix.where("_key = 'clash' and _copies = 'clash'").count() == mixed(documents).count()


def test_a_row_repeated_without_end(spark):
    out = sharded(spark.range(5000).selectExpr("7L AS doc_id", "'x' AS text")).groupBy("shard").agg(F.count("*").alias("c"), F.countDistinct("slot").alias("d"), F.max("slot").alias("m")).collect()
    assert len(out) == 24 and all(r.c == r.d == r.m + 1 and r.c in (208, 209) for r in out)


def test_places_are_uniform(spark):
    """Over many seeds each row falls into each shard equally often, whatever its part."""
    rows = spark.range(240).selectExpr("id AS doc_id", "'x' AS text")
    hits = Counter()
    for seed in range(12):
        from cueflow.llm.sharding import shuffled_into_shards

        for r in shuffled_into_shards(rows, [F.col("doc_id")], 4, seed).collect():
            hits[r.doc_id % 4, r.shard] += 1
    # 180 expected in each of the 16 cells.
    assert sum((n - 180) ** 2 / 180 for n in hits.values()) < 30 and len(hits) == 16


def test_draws():
    import numpy as np

    matrix = communication_matrix([5, 0, 7, 8], [10, 4, 6], 3)
    assert matrix.sum(axis=0).tolist() == [10, 4, 6] and matrix.sum(axis=1).tolist() == [5, 0, 7, 8]
    huge = communication_matrix([10**10, 10**10], [7 * 10**9, 13 * 10**9], 1)
    assert huge.sum(axis=1).tolist() == [10**10, 10**10] and huge.sum(axis=0).tolist() == [7 * 10**9, 13 * 10**9]
    # Beyond numpy's range the draws keep the exact mean and variance.
    good, bad, taken = 6 * 10**9, 4 * 10**9, 3 * 10**9
    drawn = np.array([hypergeometric(np.random.default_rng(i), good, bad, taken) for i in range(3000)], float)
    mean, total = taken * 0.6, good + bad
    variance = taken * 0.6 * 0.4 * (total - taken) / (total - 1)
    assert abs(drawn.mean() - mean) < 4 * (variance / len(drawn)) ** 0.5
    assert 0.9 < drawn.var() / variance < 1.1
    assert all(hypergeometric(np.random.default_rng(i), 10**10, 5, 10**10 + 3) in range(10**10 - 2, 10**10 + 1) for i in range(20))
    for size in (1, 2, 3, 10, 257):
        got = permuted(np.arange(size), np.full(size, size), np.full(size, 99))
        assert sorted(got.tolist()) == list(range(size))


def test_decontamination(spark, nothing):
    item = "Alice has 12 apples and gives Bob 5 of them at the market, how many kg of apples does Alice keep for the 12 pies?"
    changed = item.replace("Alice", "Maria").replace("Bob", "Peter").replace("12", "40").replace("5", "7")
    torn = changed.replace("for the 40 pies", "for the 41 pies")
    filler = " ".join(f"word{i}" for i in range(40))
    rows = [(1, f"{filler}. {item} {filler}"), (2, f"So {changed} {filler}"), (3, f"So {torn} {filler}"), (4, filler), (5, None), (6, ""), (7, item.upper()), (8, " ".join(item.split()[:6]))]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    bench = spark.createDataFrame([(9, item), (10, None), (11, "too short")], "item_id long, text string")
    got = {r.doc_id for r in contaminated(docs, bench).collect()}
    assert {1, 2} <= got and not got & {3, 4, 5, 6, 8}
    import cueflow.llm.decontamination as module

    limit, module.BROADCAST_WINDOWS = module.BROADCAST_WINDOWS, 0
    try:
        assert {r.doc_id for r in contaminated(docs, bench).collect()} == got
    finally:
        module.BROADCAST_WINDOWS = limit
    assert {r.doc_id for r in decontaminated(docs, bench).collect()} == {r[0] for r in rows} - got
    clash = docs.select("*", *[F.lit("clash").alias(x) for x in ("_leaked", "row", "item_id", "window", "pos", "k", "slots", "best", "coverage")])
    assert {(r.doc_id, r._leaked, r.row) for r in decontaminated(clash, bench).collect()} == {(r[0], "clash", "clash") for r in rows if r[0] not in got}
    assert decontaminated(clash, bench).columns == clash.columns and {r.doc_id for r in contaminated(clash, bench.union(bench)).collect()} == got
    assert contaminated(nothing, bench).count() == 0 and contaminated(docs, bench.limit(0)).count() == 0


def test_each_occurrence_of_an_item_is_judged_on_its_own(spark):
    item = "Alice has 12 apples and gives Bob 5 of them at the market, how many kg of apples does Alice keep for the 12 pies?"
    changed = item.replace("Alice", "Maria").replace("Bob", "Peter").replace("12", "40").replace("5", "7")
    torn = changed.replace("for the 40 pies", "for the 41 pies")
    longer = changed.replace("at the market", "at the old market")
    # A template window that occurs twice in the item, with different values.
    twice = "one may add 3 to the sum of all, then one may add 4 to the sum of all"
    filler = " ".join(f"word{i}" for i in range(40))
    rows = [
        (1, f"{item} {filler} {changed}"), (2, f"{filler} {changed} {torn}"), (3, f"{torn} {filler} {torn}"), (4, f"{filler} {twice} {filler}"),
        (5, f"{item} {changed} {item} {filler}"), (6, f"{longer} {filler} {item}"), (None, f"{item} {changed}"), (7, torn), (7, f"so {filler} {changed}"),
    ]
    bench = spark.createDataFrame([(1, item), (2, twice)], "item_id long, text string")
    got = {(r.doc_id, r.item_id) for r in contaminated(spark.createDataFrame(rows, "doc_id long, text string"), bench).collect()}
    assert got == {(1, 1), (2, 1), (4, 2), (5, 1), (6, 1), (None, 1), (7, 1)}


def test_copies_without_a_template(spark):
    """Word for word copies of items dense in numbers, units and names, of short items, and in other case."""
    items = {
        1: "12 + 7 = 19 and 30 - 4 = 26 then 5 kg * 3 kg", 2: "Anna Berta Clara Dora Emma Frida Gerda Hanna Ida Jutta", 3: "The Capital City Of The Small Country Of Liechtenstein Is Called What", 4: "What is the capital of Peru?", 5: "Why not?",
        6: "Today Alice Smith met Bob Jones and Carl Brown near Old Town while Dora Evans and Finn Green left",
    }
    filler = " ".join(f"word{i}" for i in range(40))
    rows = [(100 * form + i, f"{filler} {change(t)} {filler}") for i, t in items.items() for form, change in enumerate((str, str.lower, str.upper, str.title))]
    rows += [(900, "why NOT"), (901, f"{filler} what is the capital of {filler}"), (902, "12 7 19"), (903, " ".join(reversed(items[2].split()))), (904, None), (905, "")]
    bench = spark.createDataFrame([*items.items(), (10, None), (11, " ")], "item_id long, text string")
    import cueflow.llm.decontamination as module

    docs = spark.createDataFrame(rows, "doc_id long, text string")
    want = {(100 * form + i, i) for i in items if i != 5 for form in range(4)} | {(900, 5)}
    assert {(r.doc_id, r.item_id) for r in contaminated(docs, bench).collect()} == want
    limit, module.BROADCAST_WINDOWS = module.BROADCAST_WINDOWS, 0
    try:
        assert {(r.doc_id, r.item_id) for r in contaminated(docs, bench).collect()} == want
    finally:
        module.BROADCAST_WINDOWS = limit


def test_leaks_of_the_given_benchmark(spark, sf_dir):
    docs, bench = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("documents", "benchmark"))
    words = lambda t: [w for w in (re.sub(r"[!-/:-@\[-`{-~]", "", x) for x in lower(t or "").split()) if w]
    items = {r.item_id: words(r.text) for r in bench.collect()}
    runs = defaultdict(set)
    for i, w in items.items():
        for k in range(len(w) - 19):
            runs[tuple(w[k : k + 20])].add(i)
    want = set()
    for r in docs.collect():
        w = words(r.text)
        want |= {(r.doc_id, i) for k in range(len(w) - 19) for i in runs.get(tuple(w[k : k + 20]), ())}
    got = {(r.doc_id, r.item_id) for r in contaminated(docs, bench).collect()}
    assert want <= got


def test_line_dedup(documents, rows, clashing, nothing):
    out = deduplicated_lines(documents).where("doc_id is not null and doc_id <> 4").collect()
    first = {}
    for d, text, *_ in sorted((r for r in rows if r[0] is not None), key=lambda r: r[0]):
        for p, line in enumerate((text or "").split("\n")):
            if WORD.search(line):
                first.setdefault(line, (d, p))
    by = {r.doc_id: r for r in out}
    for d, text, *_ in rows:
        if d in by:
            lines = [(p, x) for p, x in enumerate((text or "").split("\n")) if WORD.search(x)]
            assert by[d].n_lines == len(lines)
            assert {p for p, x in lines if first[x] != (d, p)} <= set(by[d].dropped)
    assert deduplicated_lines(clashing).count() == deduplicated_lines(documents).count()
    assert deduplicated_lines(nothing).count() == 0
    assert without_repeated_lines(documents).count() == len(rows)


def test_near_lines(spark):
    line = "all rights reserved by the owners of this page and its many friends since two thousand"
    near = line.replace("many", "good")
    other = "some entirely different sentence of about as many words as the one that stands above it"
    rows = [(1, f"{line}\nhello"), (2, f"x\n{near}\n{other}"), (3, line), (4, "x\n\n x"), (5, None)]
    out = {r.doc_id: r.dropped for r in deduplicated_lines(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert out == {1: [], 2: [1], 3: [0], 4: [0]}
    cleaned = {r.doc_id: r.text for r in without_repeated_lines(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert cleaned == {1: rows[0][1], 2: f"x\n{other}", 3: "", 4: "\n x", 5: None}


