"""Multiprobe search, resampling and the prefix trie against plain versions."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest

from pulsetrace.llm import importance, multiprobe, prefix_trie, queries

FOLDER = "/root/testdata/sf0.001"

# --- multiprobe search


def product(v, w):
    """In order and uncompensated, unlike ``sum``."""
    total = 0.0
    for a, b in zip(v, w):
        total += a * b
    return total


def plain_search(rows, every, k):
    """Distinct nearest ids of each query by plain sums."""
    fine = [(i, v) for i, v in rows if i is not None and v and None not in v and any(v) and all(map(math.isfinite, v))]
    first = {}
    for i, v in fine:
        if i % every == 0:
            first[i] = min(v, first.get(i, v))
    out = {}
    for q, v in first.items():
        best = {}
        for i, w in fine:
            if i != q and len(w) == len(v):
                best[i] = max(product(v, w), best.get(i, -math.inf))
        out[q] = sorted(best.items(), key=lambda x: (-x[1], x[0]))[:k]
    return out


def found(df):
    out = defaultdict(list)
    for r in sorted(df.collect(), key=lambda r: (r.query_id, r.rank)):
        assert r.rank == len(out[r.query_id]) + 1
        out[r.query_id].append((r.id, r.score))
    return out


def test_perturbations_are_whole_and_in_order():
    rng = np.random.default_rng(3)
    low, weights = rng.uniform(size=6), rng.integers(1, 1 << 60, 6, np.int64).view(np.uint64)
    every = []
    for code in range(3**6):
        moves = [code // 3**i % 3 - 1 for i in range(6)]
        cost = sum((0, (1 - x) ** 2, x * x)[m] for m, x in zip(moves, low))
        every.append((cost, sum(m * int(w) for m, w in zip(moves, weights)) % 2**64))
    wanted = [c for _, c in sorted(x for x in every if x[0] <= 0.7)]
    got = multiprobe.perturbed(low, weights, 0.7).tolist()
    assert len(got) == len(wanted) and set(got) == set(wanted) and got[0] == 0
    cost_of = {c: s for s, c in every}
    assert all(cost_of[a] <= cost_of[b] + 1e-12 for a, b in zip(got, got[1:]))


def test_recall_scores_and_hot_buckets(spark):
    rng = np.random.default_rng(5)
    rows = [(i, v.tolist()) for i, v in enumerate(rng.normal(size=(1500, 16)) * rng.uniform(0.2, 3, (1500, 1)))]
    heart = rng.normal(size=16)
    rows += [(2000 + i, (heart + 0.001 * rng.normal(size=16)).tolist()) for i in range(700)]
    rows += [(3000 + i, heart.tolist()) for i in range(50)]
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    settings = multiprobe.Index(k=10, tile_vectors=300, tile_queries=40, bucket_rows=16)
    got, wanted = found(multiprobe.nearest(frame, 20, settings)), plain_search(rows, 20, 10)
    values = dict(rows)
    assert set(got) == set(wanted) and all(len(x) == 10 for x in got.values())
    for q, hits in got.items():
        assert hits == sorted(hits, key=lambda x: (-x[1], x[0]))
        for i, score in hits:
            assert score == product(values[q], values[i])
    hit = [len(set(got[q]) & set(wanted[q])) / 10 for q in wanted]
    assert np.mean(hit) >= 0.9


def test_odd_vectors(spark):
    rows = [(0, [1.0, 0.0]), (0, [0.5, 0.5]), (1, [1.0, 1.0]), (1, [3.0, 1.0]), (2, [1.0, 1.0]), (3, None), (4, [0.0, 0.0]),
            (5, [float("nan"), 1.0]), (6, [float("inf"), 1.0]), (7, [None, 1.0]), (None, [1.0, 1.0]), (20, [1.0, 2.0, 3.0]),
            (40, [-1.0, 0.5]), (8, []), (9, [1.0, 1.0]), (9, [1.0, 1.0])]
    frame = spark.createDataFrame([(i, v, "x", 1) for i, v in rows], "vec_id long, embedding array<float>, score string, t int")
    got = found(multiprobe.nearest(frame, 20, multiprobe.Index(k=3)))
    wanted = plain_search(rows, 20, 3)
    assert got == {q: hits for q, hits in wanted.items() if hits}  # 20 has no candidate of its length
    assert multiprobe.nearest(frame.where("vec_id = 3")).count() == multiprobe.nearest(frame.limit(0)).count() == 0


def test_search_of_the_table(spark):
    rows = [(r.vec_id, r.embedding) for r in spark.read.parquet(f"{FOLDER}/embeddings.parquet").collect()]
    got = defaultdict(list)
    for r in queries.op11_multiprobe_ann(spark, FOLDER).collect():
        got[r.query_id].append(r.vec_id)
    wanted = plain_search(rows, 20, 20)
    assert {q: len(x) for q, x in got.items()} == {q: 20 for q in wanted}
    assert np.mean([len(set(got[q]) & {i for i, _ in wanted[q]}) / 20 for q in wanted]) >= 0.9


# --- resampling


def plain_words(text):
    return re.findall("[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def plain_resample(docs, target, buckets, longest, least, percent):
    def cells(text):
        w = plain_words(text)
        return [zlib.crc32(" ".join(w[i: i + n]).encode()) % buckets for n in range(1, longest + 1) for i in range(len(w) - n + 1)]

    raw, aim = Counter(), Counter()
    for _, text in docs:
        raw.update(cells(text))
    for text in target:
        aim.update(cells(text))
    s, t = sum(raw.values()), sum(aim.values())
    rows = []
    for i, text in docs:
        c = cells(text)
        total = sum(math.floor(1000 * math.log((aim[x] + 1) * (s + buckets) / ((raw[x] + 1) * (t + buckets)))) for x in c)
        h = int(hashlib.sha256(f"2024:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        weight = total // len(c) if c else 0
        rows.append((i, len(c), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), len(plain_words(text))))
    order = sorted((r for r in rows if r[4] >= least), key=lambda r: (-r[3], r[0] is None, r[0] or 0))
    drawn = order[: percent * len(order) // 100]
    return Counter(r[:4] for r in rows), [r[:4] for r in drawn]


@pytest.mark.parametrize("longest", [1, 3])
def test_resampling_equals_a_plain_version(spark, odd_docs, make_docs, longest):
    rng = random.Random(7)
    vocabulary = ["Alpha", "beta", "GAMMA", "ünï", "漢字", "x1", "é", "don't", "a-b", "\u0080z"]
    docs = odd_docs.union(make_docs([(100 + i, " ".join(rng.choices(vocabulary, k=rng.randint(0, 60))), "en", "a") for i in range(150)]))
    target = spark.createDataFrame([(1, "alpha beta 漢字"), (2, None), (3, "x1 x1 é")], "item_id long, text string")
    settings = importance.Resampling(buckets=500, longest=longest, min_words=10, percent=30)
    got = importance.resample(docs, target, settings).collect()
    rows, drawn = plain_resample([(r.doc_id, r.text) for r in docs.collect()], [r.text for r in target.collect()], 500, longest, 10, 30)
    assert Counter(tuple(r[:4]) for r in got) == rows
    ranked = sorted((r for r in got if r.rank is not None), key=lambda r: r.rank)
    assert [r.rank for r in ranked] == list(range(1, len(drawn) + 1))
    assert [r.score for r in ranked] == [r[3] for r in drawn] and Counter(tuple(r[:4]) for r in ranked) == Counter(drawn)


def test_long_texts_are_split_at_gaps_only():
    text = "ab cd " * 40_000 + "e" * 150_000 + " , f"
    splitter = importance.Splitter()
    assert [w for w, _ in splitter.words(text)] == plain_words(text)


def test_resampling_of_nothing(spark, odd_docs):
    target = spark.createDataFrame([], "item_id long, text string")
    assert importance.resample(odd_docs.limit(0), target).count() == 0
    assert importance.resample(odd_docs, target).count() == odd_docs.count()


# --- prefix trie


def plain_trie(rows, group=5, most=9):
    own = defaultdict(list)
    for c, turn, role, text in rows:
        if c is not None:
            text = text or ""
            mark = hashlib.md5(f"{len((role or '').encode())}:{role or ''}{text}".encode()).hexdigest()
            own[c].append(((turn is not None, turn or 0, role or "", mark), (role or "", text)))
    own = {c: [t for _, t in sorted(x, key=lambda p: p[0])] for c, x in own.items()}
    members, size = defaultdict(list), {}
    ends = defaultdict(list)
    for c, turns in own.items():
        h = zlib.crc32(str(c).encode()) % most
        whole = tuple(own.get(c - int(math.fmod(c, group)), [])[:h] + turns[h:])
        ends[whole].append(c)
        for d in range(len(whole) + 1):
            members[whole[:d]].append(c)
    out = []
    for p, convs in members.items():
        below = [q for q in members if q[: len(p)] == p]
        leaves = [q for q in below if not any(len(r) == len(q) + 1 and r[:-1] == q for r in members)]
        saved = sum((len(members[q]) - 1) * len(q[-1][1].encode()) for q in below if q)
        out.append((min(convs), len(p), min(members[p[:-1]]) if p else None, len(convs),
                    sum(len(q) == len(p) + 1 for q in below), len(leaves), saved,
                    hashlib.sha256(",".join(map(str, sorted(ends.get(p, [])))).encode()).hexdigest()))
    return Counter(out)


def conversations(spark, rows):
    return spark.createDataFrame([(*r, "extra", 1) for r in rows], "conv_id long, turn long, role string, text string, depth string, shard int")


@pytest.mark.parametrize("seed, shard_turns", [(1, 1 << 19), (2, 40), (3, 12)])
def test_trie_equals_a_plain_version(spark, seed, shard_turns):
    rng = random.Random(seed)
    rows = []
    for c in [*range(-12, 90), *range(1000, 1030)]:
        if c >= 1000:  # one conversation many times over, so that its end group spans shards
            rows += [(c, t, "user", f"same {t}") for t in range(3)]
            continue
        for t in range(rng.randint(0, 10)):
            rows.append((c, None if rng.random() < 0.1 else t, rng.choice(["user", "assistant", None]), rng.choice(["a", "é", "", None, "long text"])))
    rows += [(None, 0, "user", "x"), rows[0], rows[0]]
    settings = prefix_trie.Trie(shard_turns=shard_turns, block=8, piece=40)
    got = prefix_trie.nodes(conversations(spark, rows), settings).collect()
    assert Counter(map(tuple, got)) == plain_trie(rows)


def test_trie_of_one_long_conversation_and_of_nothing(spark):
    rows = [(7, t, "user", f"t{t}") for t in range(3000)]
    got = prefix_trie.nodes(conversations(spark, rows)).collect()
    kept = 3000 - zlib.crc32(b"7") % 9  # its start is that of conversation 5, which has none
    assert sorted(r.depth for r in got) == list(range(kept + 1)) and {(r.n_convs, r.n_leaves) for r in got} == {(1, 1)}
    assert prefix_trie.nodes(conversations(spark, []), prefix_trie.Trie()).count() == 0


def test_find_close_on_random_parentheses():
    rng = random.Random(4)
    for block in (2, 8, 64):
        bits, depth = [1], 1
        while len(bits) < 5000:
            bit = 1 if depth == 1 or rng.random() < 0.53 else 0
            bits.append(bit)
            depth += 2 * bit - 1
        bits += [0] * depth
        stack, close = [], {}
        for i, b in enumerate(bits):
            if b:
                stack.append(i)
            else:
                close[stack.pop()] = i
        tree = prefix_trie.Parentheses(np.array(bits, np.uint8), block)
        assert tree.find_close(tree.opens).tolist() == [close[i] for i in tree.opens.tolist()]
