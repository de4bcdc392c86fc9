"""Byte-level BPE against the public library, periodic runs and hard negatives against brute force."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sentrymill.llm import byte_pairs, negatives, periodic, queries

tiktoken = pytest.importorskip("tiktoken")


@pytest.fixture(scope="module")
def ranks():
    with open(byte_pairs.RANKS, "rb") as file:
        return byte_pairs.Ranks.read(file.read())


@pytest.fixture(scope="module")
def public(ranks):
    return tiktoken.Encoding("own", pat_str=byte_pairs.PATTERN, mergeable_ranks=ranks.ranks, special_tokens={})


SIGNS = "ab cde'st \n\t\x0b\x0c\r\x1c\x1d\x1e\x1f\x85\xa0​　é漢字١²Ⅷ😀ß!?#-  1234 'll 're"


def texts_of(seed, n):
    rng = random.Random(seed)
    return ["".join(rng.choice(SIGNS) for _ in range(rng.randint(0, 40))) for _ in range(n)]


def test_pattern_is_that_of_the_tokenizer():
    import public_tokenizers
    assert byte_pairs.PATTERN == public_tokenizers.PATTERN


def test_byte_pairs_equal_the_public_library(ranks, public, monkeypatch):
    texts = [*texts_of(1, 3000), "a" * 50_000, "ab" * 3000 + "é" * 2000, "漢" * 5000, " ".join(texts_of(2, 500))]
    for piece, kept, together in ((byte_pairs.PIECE, byte_pairs.KEPT, byte_pairs.TOGETHER), (7, 2_000, 10)):
        monkeypatch.setattr(byte_pairs, "PIECE", piece)
        monkeypatch.setattr(byte_pairs, "KEPT", kept)
        monkeypatch.setattr(byte_pairs, "TOGETHER", together)
        for text, ids in zip(texts, ranks.encode(texts), strict=True):
            got = np.frombuffer(ids, "<u4").tolist()
            assert got == public.encode_ordinary(text)
            assert ranks.decode(got) == text.encode()


def test_hash_finds_entries_and_nothing_else(ranks):
    names = list(ranks.ranks)[::7]
    assert ranks.whole(names) == [ranks.ranks[n] for n in names]
    strange = [n + b"\xff\xfe\x00" for n in names]
    assert ranks.whole(strange) == [-1] * len(strange)
    assert sorted(ranks.rank.tolist()) == sorted(ranks.names)  # minimal: one slot an entry


def test_byte_pairs_of_tables(spark, public):
    texts = [None, "", " ", *texts_of(3, 40), "x" * 200_000, "same", "same"]
    rows = [(i, t, 5, [1], b"d", "k") for i, t in enumerate(texts)] + [(None, "no id", 5, [1], b"d", "k")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, IDS int, decoded_ array<int>, decoded binary, `a.b c` string").repartition(3)
    for packed in (False, True):
        found = byte_pairs.decoded(byte_pairs.encoded(docs, packed=packed))
        assert found.columns == ["doc_id", "text", "decoded_", "a.b c", "ids", "decoded"]
        out = found.collect()
        assert len(out) == len(rows)
        for r in out:
            ids = np.frombuffer(r["ids"], "<u4").tolist() if packed else r["ids"]
            assert ids == public.encode_ordinary(r["text"] or "")
            assert bytes(r["decoded"]) == (r["text"] or "").encode()
            assert r["a.b c"] == "k"
    assert byte_pairs.decoded(byte_pairs.encoded(docs.where("false"))).count() == 0
    odd = spark.createDataFrame([(None,), ([],), ([70, 999_999, None],)], "ids array<int>")
    got = [r["decoded"] and bytes(r["decoded"]) for r in byte_pairs.decoded(odd).collect()]
    assert got == [None, bytearray(), public.decode_bytes([70]) + 2 * byte_pairs.UNKNOWN]


def brute_runs(words, least=12):
    """All runs by their definition."""
    n, out = len(words), set()
    for q in range(1, n // 2 + 1):
        i = 0
        while i < n - q:
            if words[i] != words[i + q]:
                i += 1
                continue
            start = i
            while i < n - q and words[i] == words[i + q]:
                i += 1
            length = i - start + q
            x = words[start:start + length]
            if length >= max(least, 2 * q) and not any(x[p:] == x[:-p] for p in range(1, q)):
                out.add((start, length, q))
    return sorted(out, key=lambda r: (r[0], r[2]))


def repetitive(seed):
    rng = random.Random(seed)
    k, words = rng.choice([1, 2, 2, 3, 5]), []
    while len(words) < rng.randint(0, 200):
        part = [rng.randrange(k) for _ in range(rng.randint(1, 30))]
        words += (part * rng.randint(1, 6))[:rng.randint(1, 120)]
    return words


def test_runs_against_their_definition():
    for seed in range(400):
        words = repetitive(seed)
        for least in (12, 6, 4):
            expected = brute_runs(words, least)
            for most in (periodic.PAIRS, 40):
                got = periodic.runs(np.array(words, np.int64), least, most)
                assert list(zip(*(a.tolist() for a in got), strict=True)) == expected
    with pytest.raises(ValueError):
        periodic.runs(np.zeros(3, np.int64), 7)


def test_runs_of_one_word_repeated_need_few_pairs(monkeypatch):
    pairs = []
    real = periodic.seeds

    def counting(*args):
        for lag, place in real(*args):
            pairs.append(len(lag))
            yield lag, place

    monkeypatch.setattr(periodic, "seeds", counting)
    n = 50_000
    start, length, period = periodic.runs(np.zeros(n, np.int64))
    assert (start.tolist(), length.tolist(), period.tolist()) == ([0], [n], [1])
    assert sum(pairs) < 40 * n


def test_periodic_runs_of_tables(spark):
    rng = random.Random(5)
    texts = [None, "", " \n\t", "a " * 11, "a " * 12, "A a " * 30, "é x " * 40, "x" * 100_000, "word " * 30_000]
    for seed in range(60):
        texts.append("\n".join(f"w{w}" for w in repetitive(seed)) + rng.choice(["", " ", "\x0b"]))
    rows = [(i, t, 1, "r", "k") for i, t in enumerate(texts)] + [(7, texts[5], 1, "r", "k")] * 2 + [(None, texts[5], 1, "r", "k")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, N_WORDS int, runs string, `a.b c` string").repartition(3)
    found = periodic.periodic_runs(docs)
    assert found.columns == ["doc_id", "text", "a.b c", "n_words", "runs", "collapsed"]
    out = found.withColumn("best", periodic.longest(F.col("runs"))).collect()
    assert len(out) == len(rows)
    for r in out:
        words = (r["text"] or "").encode().split()
        if len(words) > 5000:
            expected = [(0, len(words), 1)]
        else:
            expected = brute_runs(words)
        assert [tuple(x) for x in r["runs"]] == expected
        gone = set()
        for s, n, q in expected:
            gone.update(range(s + q, s + n))
        assert r["collapsed"] == b" ".join(w for i, w in enumerate(words) if i not in gone).decode()
        assert r["n_words"] == len(words)
        best = min(expected, key=lambda x: (-x[1], x[0], x[2]), default=None)
        assert (r["best"] and tuple(r["best"])) == best
    assert periodic.periodic_runs(docs.where("false")).count() == 0


def test_planted_runs_follow_their_rule(spark):
    import zlib
    docs = spark.createDataFrame([(i, None if i % 50 == 49 else " \n".join(f"w{j}" for j in range(i % 37))) for i in range(400)], "doc_id long, text string")
    for before, after in zip(docs.collect(), queries.with_planted_runs(docs).collect(), strict=True):
        words = (before["text"] or "").split()
        h, n = zlib.crc32(str(before["doc_id"]).encode()), len(words)
        if h % 10 == 0 and n:
            a = h // 10 % n
            p = 1 + (n - a) // (3 + h // 10 % 8)
            words = [words[i] if i < a else words[a + (i - a) % p] for i in range(n)]
        assert (after["text"] or "").split() == words


def brute_negatives(rows, anchor, positives=5, negatives=10, low=30, high=90):
    """``rows`` are (id, label, whole-number vector)."""
    out = []
    for own, label, q in rows:
        if not anchor(own):
            continue
        scored = sorted((-sum(a * b for a, b in zip(q, v, strict=True)), i, lab) for i, lab, v in rows if i != own and len(v) == len(q))
        for minus, pos, _ in [x for x in scored if x[2] == label][:positives]:
            hits = [x for x in scored if x[2] != label and low * -minus <= -100 * x[0] <= high * -minus][:negatives]
            out += [(own, pos, nth, i, -minus, -s) for nth, (s, i, _) in enumerate(hits, 1)]
    return sorted(out)


def clustered(seed, n, dim, centres=12):
    rng = np.random.default_rng(seed)
    base = rng.normal(size=(centres, dim))
    return [(base[i % centres] * rng.uniform(0.3, 2) + 0.2 * rng.normal(size=dim)).tolist() for i in range(n)]


def test_hard_negatives(spark):
    vectors = clustered(1, 500, 10)
    rng = random.Random(2)
    rows = [(i, rng.choice([1, 1, 1, 2, 3, i]), v) for i, v in enumerate(vectors)]
    rows += [(600 + i, i % 3, vectors[7]) for i in range(40)]  # ties
    odd = [(700, None, vectors[0]), (701, 1, None), (None, 1, vectors[0]), (702, 1, [None, *vectors[0][1:]]), (703, 1, []),
           (704, 1, [float("nan")] * 10), (705, 1, [float("inf")] * 10)]
    zero, short = [(710, 1, [0.0] * 10)], [(720 + i, i % 2, vectors[i][:4]) for i in range(6)]
    taking_part = rows + zero + short
    df = spark.createDataFrame([(*r, "x", 4) for r in [*taking_part, *odd, rows[3], rows[3]]],
                               "vec_id long, label int, embedding array<double>, ID string, `a.b` int").repartition(3)
    whole = [(i, lab, [int(np.floor(256 * x)) for x in v]) for i, lab, v in taking_part]
    expected = brute_negatives(whole, lambda i: i % 5 == 0)
    assert len(expected) > 1000
    for block, tasks, groups in ((2048, 4000, 3), (32, 20, 5)):
        got = negatives.hard_negatives(df, F.col("id") % 5 == 0, block=block, anchors_of_task=tasks, groups=groups)
        assert got.columns == ["anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"]
        assert got.schema["rank"].dataType == T.IntegerType()
        assert sorted(map(tuple, got.collect())) == expected
    few = negatives.hard_negatives(df, F.col("id") % 5 == 0, positives=2, negatives=3, low_pct=-20, high_pct=60, groups=2)
    assert sorted(map(tuple, few.collect())) == brute_negatives(whole, lambda i: i % 5 == 0, 2, 3, -20, 60)
    assert negatives.hard_negatives(df.where("false"), F.col("id") % 5 == 0, groups=2).count() == 0
    assert negatives.hard_negatives(df, F.lit(False), groups=2).count() == 0


def test_scores_beyond_doubles_are_exact(spark):
    big = [(i, i % 2, [float(2 ** 21 + 7 * i), float(2 ** 21 - i), 1.0 + i]) for i in range(30)]
    df = spark.createDataFrame(big, "vec_id long, label int, embedding array<double>")
    whole = [(i, lab, [int(np.floor(256 * x)) for x in v]) for i, lab, v in big]
    got = negatives.hard_negatives(df, F.lit(True), low_pct=90, high_pct=110, groups=2)
    assert sorted(map(tuple, got.collect())) == brute_negatives(whole, lambda i: True, low=90, high=110)


def tree_of(vectors, labels=None, leaf=8):
    import pyarrow as pa
    x = np.array(vectors)
    batch = pa.RecordBatch.from_arrays(
        [pa.array([1] * len(x)), pa.array(range(len(x))), pa.array(labels or [0] * len(x)), pa.array([v.tobytes() for v in x])],
        ["block", "id", "label", "vector"])
    (rows,) = negatives._treed(iter([batch]), leaf)
    return negatives.Tree(rows)


def test_cover_tree_covers_and_leaves_nodes_out():
    x = np.floor(256 * np.array(clustered(3, 1500, 6, 60)))
    order, nodes = negatives.cover_tree(x)
    assert sorted(order.tolist()) == list(range(len(x)))
    unit, norm = negatives._sphere(x)
    assert np.allclose(unit[:, :-1] * norm, x)
    unit = unit[order]
    by_depth = {}
    for depth, start, end, radius in nodes:
        assert negatives._angles(unit[start:end], unit[start]).max() <= radius + 1e-9
        by_depth.setdefault(depth, []).append((start, end, radius))
    for depth, level in by_depth.items():
        for start, end, radius in level:
            below = [n for n in by_depth.get(depth + 1, []) if start <= n[0] < end]
            if below:  # children lie side by side, with half the radius
                assert sorted(i for s, e, _ in below for i in range(s, e)) == list(range(start, end))
                assert all(r <= radius / 2 + 1e-12 for _, _, r in below)
            else:
                assert end - start <= negatives.LEAF or radius == 0
    tree = tree_of(x)
    seen = 0
    for q in x[::50]:
        window = negatives.Window(-negatives._LONG, negatives._LONG, 5)
        seen += negatives.search(tree, q, -1, 1, False, [window])
        scores = x @ q
        best = sorted(zip((-scores).tolist(), range(len(x)), strict=True))[:5]
        assert [(-s, i) for s, i in best] == list(zip(window.score.tolist(), window.id.tolist(), strict=True))
    assert seen < 0.5 * len(x) * len(x[::50])  # most rows are never looked at
