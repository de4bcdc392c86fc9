"""Line dedup, n-gram Jaccard, mixing, quality, SentencePiece and toxicity, each against brute force or a round trip."""

import collections
import heapq
import itertools
import re

import numpy as np
import pandas as pd
import pytest

from pyspark.sql import functions as F

from sentrymill.llm import common, jaccard, lines, mixing, quality, tokens, toxicity

SCHEMA = "doc_id long, text string, source string, N_LINES int, `a.b c` string, class_id string, score string, taken int, ids string"
WORDS = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu nu xi omicron pi rho sigma tau upsilon".split()


def prose(rng, n):
    return " ".join(rng.choice(WORDS) + str(int(rng.integers(0, 50))) for _ in range(n))


@pytest.fixture(scope="module")
def rows():
    rng = np.random.default_rng(1)
    passage = "A passage that many documents share, " + prose(rng, 30)
    texts = [None, "", "   \n\t", "one", "short words here", "é" * 9, "é" * 10 + "\n" + "É" * 10]
    texts += [prose(rng, 60) + "\n" + prose(rng, 20) for _ in range(20)]
    near = prose(rng, 120).split()
    for i in range(12):  # near copies, most pairs above the threshold
        changed = list(near)
        changed[i * 3] = "changed%d" % i
        texts.append(" ".join(changed))
    texts += ["same text of quite a few words\nAnd  a second LINE "] * 5
    texts += [f"  {passage.upper()} \n{prose(rng, 50)}\n{passage}" for _ in range(8)]
    texts += [prose(rng, 30_000), "x" * 200_000]
    out = [(i * 3 % 1000 + (i * 3 // 1000), t, [None, "b", "a", "é"][i % 4], 1, "k", "c", "s", 2, "z") for i, t in enumerate(texts)]
    out += [out[10], out[10]]  # repeated rows
    out.append((None, "a row without an id\nand two lines here", "b", 1, "k", "c", "s", 2, "z"))
    return out


@pytest.fixture(scope="module")
def docs(spark, rows):
    return spark.createDataFrame(rows, SCHEMA).repartition(3)


@pytest.fixture(scope="module")
def nothing(spark):
    return spark.createDataFrame([], SCHEMA)


def test_line_dedup(docs, rows, nothing):
    def keys(text):
        out = []
        for line in (text or "").split("\n"):
            k = re.sub("[A-Z]+", lambda m: m[0].lower(), line.strip(" \t\n\x0b\x0c\r"))
            out.append((line, k if len(k) >= 10 else None))
        return out

    holders = collections.defaultdict(set)
    for r in rows:
        if r[0] is not None:
            for _, k in keys(r[1]):
                holders[k].add(r[0])
    expected = []
    for r in rows:
        kept = [line for line, k in keys(r[1]) if k is None or r[0] is None or len(holders[k]) < 2 or min(holders[k]) == r[0]]
        n = len(keys(r[1]))
        expected.append((r[0], n, n - len(kept), "\n".join(kept)))
    for options in ({}, {"shard_lines": 7, "probes": 5}):  # many shards, many copies
        got = lines.dedup_lines(docs, **options)
        assert [c.lower() for c in got.columns].count("n_lines") == 1 and "a.b c" in got.columns
        found = [(r["doc_id"], r["n_lines"], r["n_dropped"], r["text"] or "") for r in got.collect()]
        assert collections.Counter(found) == collections.Counter(expected)
    assert lines.dedup_lines(nothing).count() == 0


def test_minimal_perfect_hash():
    rng = np.random.default_rng(4)
    for n in (0, 1, 2, 1000, 30_000):
        hi, lo = rng.integers(-2**63, 2**63 - 1, (2, n))
        sizes, bits, slot = lines.build(hi, lo)
        assert sorted(slot.tolist()) == list(range(n))
        assert np.array_equal(lines.probe(sizes, bits, hi, lo), slot)
    same_hi = np.zeros(50, np.int64)
    assert sorted(lines.build(same_hi, np.arange(50))[2].tolist()) == list(range(50))


def sets_of(rows, n=5):
    by_id = {}
    for r in rows:
        w = [x.lower() for x in (r[1] or "").encode().split()]
        s = frozenset(tuple(w[i:i + n]) for i in range(len(w) - n + 1)) if len(w) >= n else frozenset([tuple(w)] if w else [])
        by_id[r[0]] = s
    by_id.pop(None)
    return by_id


def reach(nodes, edges):
    label = {n: n for n in nodes}
    changed = True
    while changed:
        changed = False
        for a, b in edges:
            low = min(label[a], label[b])
            changed |= label[a] != low or label[b] != low
            label[a] = label[b] = low
    return label


def test_jaccard_groups(docs, rows, nothing):
    sets = sets_of(rows)
    edges = [(a, b) for a, b in itertools.combinations(sorted(sets), 2) if sets[a] and sets[b]
             and 10 * len(sets[a] & sets[b]) >= 8 * len(sets[a] | sets[b])]
    assert len(edges) > 30
    label, links = reach(sets, edges), collections.Counter(itertools.chain(*edges))
    for block in (400, 3):  # a group of copies as one cell, and dealt into parts
        got = jaccard.jaccard_groups(docs, block=block).collect()
        assert len(got) == len(rows)
        for r in got:
            if r["doc_id"] is None:
                assert (r["n_links"], r["group_id"], r["kept"]) == (0, None, True)
            else:
                assert (r["n_links"], r["group_id"], r["kept"]) == (links[r["doc_id"]], label[r["doc_id"]], label[r["doc_id"]] == r["doc_id"])
    assert jaccard.jaccard_groups(nothing).count() == 0


def test_paths_split_large_buckets(spark):
    """Recall over the recursion itself: buckets of three at most until the last depth."""
    rng = np.random.default_rng(8)
    texts, pairs = [], 150
    for _ in range(pairs):
        w = prose(rng, 100).split()
        texts.append(" ".join(w))
        w[40] = "other"
        texts.append(" ".join(w))
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string")
    sketch = common.stored(jaccard.sketched(df, "doc_id", "text").withColumnRenamed("key", "id"))
    met = set()
    buckets = collections.defaultdict(list)
    for r in jaccard.buckets(sketch, jaccard.runs_for(), small=2).collect():
        buckets[r["node"]].append(r["id"])
    for ids in buckets.values():
        met |= {i // 2 for i in ids if i ^ 1 in ids}
    assert len(met) >= 0.98 * pairs


def test_shingles_match_sets():
    texts = [b"", b" a b c d e f a b c d e ", "ä Ö ü ß é x".encode(), b"one two", b"A B c D e\nf"]
    grams, counts = jaccard.shingles(texts)
    assert counts.tolist() == [0, 6 + 1 - 1, 2, 1, 2]
    parts = np.split(grams, np.cumsum(counts)[:-1])
    assert set(parts[4]) <= set(parts[1])  # case is folded, line breaks are blanks


def test_mixing(docs, rows, nothing):
    once = {(r[0], r[2], r[1] or "") for r in rows}
    sizes = collections.Counter()
    for _, source, text in once:
        sizes[source] += len(text.encode().split())
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    target = dict(zip(order, mixing.targets([sizes[s] for s in order], [(5, 2, 1)[i % 3] for i in range(len(order))]), strict=True))
    assert sum(target.values()) == pytest.approx(1.5 * sum(sizes.values()))
    documents, mix = mixing.mixed_pieces(docs, block=64)
    got = mixing.taken(documents, mix).collect()
    assert len(got) == len(once)
    taken = collections.Counter()
    for r in got:
        assert (r["source_size"], r["target"]) == (sizes[r["source"]], pytest.approx(target[r["source"]]))
        assert 0 <= r["taken"] <= 2 * r["size"]
        taken[r["source"]] += r["taken"]
    assert all(abs(taken[s] - target[s]) <= 1 for s in order)
    slots = sorted(r["slot"] for r in mix.select("slot").distinct().collect())
    assert slots[0] == 0 and len(slots) >= sum(target.values()) // 64
    again = mixing.taken(*mixing.mixed_pieces(docs.repartition(5), block=64)).collect()
    assert sorted(map(str, got)) == sorted(map(str, again))
    whole = mixing.mixed_documents(docs.dropDuplicates(["doc_id", "source", "text"]), block=64)
    assert whole.columns == docs.columns
    assert sum(len(r["text"].encode().split()) for r in whole.collect()) == sum(taken.values())
    assert mixing.taken(*mixing.mixed_pieces(nothing)).count() == 0


def test_repeated_rows_are_mixed_once(docs, rows):
    documents, mix = mixing.mixed_pieces(docs, block=64)
    used = {(r["doc"], r["source"], r["of"]): r["taken"] for r in mixing.taken(documents, mix).collect()}
    whole = mixing.mixed_documents(docs, block=64)  # with its repeated rows
    assert whole.columns == docs.columns
    words, size = collections.Counter(), collections.Counter()
    for r in whole.collect():
        words[r["source"]] += len(r["text"].encode().split())
        size[r["doc_id"], r["source"]] += len(r["text"].encode().split())
    of_source = collections.Counter()
    for (_, source, _), n in used.items():
        of_source[source] += n
    assert words == +of_source
    assert sum(size.values()) == sum(used.values()) and len(rows) > len(set(rows))
    again = mixing.mixed_documents(docs.unionByName(docs).repartition(5), block=64)
    assert collections.Counter(map(str, again.collect())) == collections.Counter(map(str, whole.collect()))


def test_near_copies_leave_one_row(spark):
    import corpus_pipeline

    rng = np.random.default_rng(12)
    a, b, c, d = (prose(rng, 60) for _ in range(4))
    data = [(7, a), (7, a), (7, a), (3, b), (3, b), (9, b), (9, c), (9, d), (None, d), (None, d), (None, a + " end"), (11, c), (12, None), (12, None)]
    df = spark.createDataFrame([(i, t, "s") for i, t in data], "doc_id long, text string, source string").repartition(3)
    got = corpus_pipeline.one_of_near_copies(spark, df, "")
    assert got.columns == df.columns
    assert collections.Counter((r["doc_id"], r["text"]) for r in got.collect()) == collections.Counter([(7, a), (3, b), (9, c), (9, d), (12, None)])


def test_targets_share_and_stop():
    assert mixing.targets([10, 10], [5, 2]) == [20.0, 10.0]
    assert mixing.targets([], []) == [] and mixing.targets([0, 5], [5, 2]) == [0.0, 7.5]
    assert mixing.first_words(b" a  b\nc d", 2) == b" a  b" and mixing.first_words(b"a b", 2) == b"a b"


def test_schedule_spreads_sources(spark):
    got = sorted(mixing.schedule(spark, [6400, 3200, 640], block=64, chunk=16).collect())
    assert collections.Counter(r["at"] for r in got) == {0: 100, 1: 50, 2: 10}
    for at in range(3):
        assert [r["rank"] for r in got if r["at"] == at] == list(range({0: 100, 1: 50, 2: 10}[at]))
    early = collections.Counter(r["at"] for r in got[:80])
    assert abs(early[0] - 50) <= 3 and abs(early[1] - 25) <= 3  # any stretch has about the target weights


def test_quality_statistics():
    assert quality.statistics(b"") == (0, 0, 0, 0, 0)
    assert quality.statistics("ä b\n\nä b\n  \n  \n#*é".encode()) == (5, 7, 2, 1, 0)
    rng = np.random.default_rng(3)
    for _ in range(100):
        words = [b"%d" % i for i in rng.integers(0, rng.integers(1, 4), rng.integers(0, 40))]
        count = collections.Counter(tuple(words[i:i + 8]) for i in range(len(words) - 7))
        held = {i + k for i in range(len(words) - 7) if count[tuple(words[i:i + 8])] > 1 for k in range(8)}
        assert quality.repeated_words(words) == len(held)


def test_boosted_trees_learn_and_stay_monotonic():
    rng = np.random.default_rng(2)
    x = rng.uniform(0, 1, (3000, 3))
    y = ((x[:, 0] < 0.5) ^ (rng.uniform(0, 1, 3000) < 0.05)).astype(float)
    y[x[:, 1] > 0.9] = 1
    model = quality.boost(x, y, [-1, 0, 0], trees=30)
    assert ((model.score(x) > 0.5) == (x[:, 0] < 0.5))[x[:, 1] < 0.9].mean() > 0.97
    line = np.linspace(0, 1, 200)
    for a, b in rng.uniform(0, 1, (20, 2)):
        s = model.score(np.stack([line, np.full(200, a), np.full(200, b)], 1))
        assert (np.diff(s) <= 1e-12).all()
    assert quality.boost(x, np.ones(3000), [0, 0, 0]).score(x).min() > 0.99


def test_quality_query(docs, rows, nothing, spark):
    labels = spark.createDataFrame([(r[0], i % 2, None) for i, r in enumerate(rows)], "doc_id long, quality int, toxic int")
    got = quality.judged(docs, quality.fitted(docs, labels)).collect()
    assert len(got) == len(rows)
    for r in got:
        assert r["base_failed"] == (r["n_words"] < 20 or 100 * r["n_repeat_words"] > 30 * r["n_words"])
        assert not (r["kept"] and r["base_failed"])
    empty = quality.fitted(docs, labels.where("false"))
    assert all(r["kept"] != r["base_failed"] for r in quality.judged(docs, empty).collect())
    assert quality.judged(nothing, empty).count() == 0


TOY = [("<unk>", 0.0, 2), *[(f"<0x{b:02X}>", 0.0, 6) for b in range(256)], ("▁", -3.0, 1), ("a", -2.0, 1), ("b", -2.5, 1),
       ("ab", -3.0, 1), ("▁a", -2.7, 1), ("▁ab", -5.1, 1), ("ba", -3.3, 1), ("aba", -5.0, 1), ("▁▁", -4.0, 1), ("c", -9.0, 3)]


def toy():
    return tokens.Pieces([p[0] for p in TOY], [p[1] for p in TOY], [p[2] for p in TOY])


def all_segmentations(pieces, text):
    """(score, ids) of every way through the lattice."""
    if not text:
        return [(0.0, [])]
    out = []
    for end in range(1, len(text) + 1):
        for i, (name, kind) in enumerate(zip(pieces.names, pieces.kinds, strict=True)):
            if name == text[:end] and kind == 1:
                out += [(pieces.scores[i] + s, [i, *ids]) for s, ids in all_segmentations(pieces, text[end:])]
    if text[0] not in [n for n, k in zip(pieces.names, pieces.kinds, strict=True) if k == 1]:
        out += [(pieces.worst + s, [*pieces.without_piece(text[0]), *ids]) for s, ids in all_segmentations(pieces, text[1:])]
    return out


@pytest.mark.parametrize("text", ["ab", "abab ba", "  ab a", "a\nb", "é ab", "cab", " ", "ababa"])
def test_nbest_matches_every_segmentation(text):
    pieces = toy()
    whole = "".join(pieces.words(text))
    expected = [s for s, _ in heapq.nlargest(6, all_segmentations(pieces, whole), key=lambda x: x[0])]
    got = pieces.nbest(text, 6)
    assert [s for s, _ in got] == pytest.approx(expected)
    assert all(pieces.decode(ids) == text for _, ids in got)


def test_forward_pass_over_tables_matches_single_words():
    import random

    random_of = random.Random(4)
    signs = "▁▁aabbcé☃\0\U0001f600."
    words = ["", "a" * 300, "ab" * 32, *["".join(random_of.choices(signs, k=random_of.randint(1, 80))) for _ in range(500)]]
    for pieces in (toy(), tokens.load(), tokens.Pieces(["<unk>"], [0.0], [2])):
        for word, (packed, score, gap) in zip(words, pieces.solved(words), strict=True):
            ids, expected, loss = pieces.two_best(word)
            assert np.frombuffer(packed, np.int32).tolist() == list(ids) and score == expected
            assert gap == (np.inf if loss is None else loss)


@pytest.mark.parametrize("n", [1, 2, 3, 6])
def test_texts_from_kept_words_match_whole_lattices(n, monkeypatch):
    monkeypatch.setattr(tokens, "WORDS", 40)  # words are forgotten between runs of texts
    monkeypatch.setattr(tokens, "DEEP", 3)
    monkeypatch.setattr(tokens, "TOGETHER", 200)
    rng = np.random.default_rng(n)
    pieces = tokens.load()
    texts = ["", "the", "the the. the", "\n\n", "a" * 150, *[prose(rng, int(rng.integers(1, 40))) + ", and so on." for _ in range(60)]]
    known = tokens.Words(pieces, n)
    got = [x for run in tokens._together([t.encode() for t in texts]) for x in known.encoded(run)]
    assert len(got) == len(texts)
    for text, (lists, scores, sound) in zip(texts, got, strict=True):
        best = pieces.nbest(text, n)
        assert scores == pytest.approx([s for s, _ in best]) and sound and len(set(lists)) == len(best)
        for ids, score in zip(lists, scores, strict=True):
            ids = np.frombuffer(ids, np.int32).tolist()
            assert pieces.decode(ids) == text
            if all(pieces.kinds[i] != 6 for i in ids):  # bytes cost as a character, not as pieces
                assert sum(pieces.scores[i] for i in ids) == pytest.approx(score)


def test_nbest_matches_public_library():
    """The same vocabulary as a unigram model of the public library."""
    import sentencepiece

    with open(tokens.MODEL, "rb") as f:
        data = f.read() + b"\x12\x02\x18\x01"  # one more trainer message, which is merged: model_type is unigram
    public = sentencepiece.SentencePieceProcessor()
    public.LoadFromSerializedProto(data)
    ours = tokens.load()
    for text in ("The quick brown fox", "Grüße aus Köln", "of the and with"):
        best = ours.nbest(text, 3)
        assert ours.decode(best[0][1]) == text
        theirs = public.NBestEncodeAsIds(text, 3)
        score = lambda ids: sum(ours.scores[i] for i in ids)
        assert [score(ids) for _, ids in best] == pytest.approx([score(ids) for ids in theirs])


def test_encoded_round_trip(docs, rows, nothing):
    got = tokens.encoded(docs, n=2).collect()
    assert len(got) == len(rows) and all(r["round_trip"] for r in got)
    pieces = tokens.load()
    some = next(r for r in got if r["text"] == "short words here")
    assert [s for s, _ in pieces.nbest("short words here", 2)] == pytest.approx(some["scores"]) and pieces.decode(some["ids"]) == some["text"]
    assert tokens.encoded(nothing).count() == 0


def test_encoded_keeps_and_decodes_all_segmentations(spark):
    pieces = tokens.load()
    texts = ["the reading of the reading room, and the end.", "one", "", None, "naïve\n  lines ☃ here", "a sign ▁ inside", "the the the the"]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r["doc_id"]: r for r in tokens.encoded(df).collect()}
    for i, text in enumerate(texts):
        best = pieces.nbest(text or "", 3)
        assert got[i]["scores"] == pytest.approx([s for s, _ in best]) and len(got[i]["nbest_ids"]) == len(best)
        assert len({tuple(x) for x in got[i]["nbest_ids"]}) == len(best) and got[i]["ids"] == got[i]["nbest_ids"][0] == best[0][1]
        if all(0 <= pieces.kinds[x] != 6 for ids in got[i]["nbest_ids"] for x in ids):  # bytes cost as a character, not as pieces
            assert [sum(pieces.scores[x] for x in ids) for ids in got[i]["nbest_ids"]] == pytest.approx(got[i]["scores"])
        assert got[i]["round_trip"] == (i != 5)
    each = tokens.encoded(df).select("doc_id", "text", F.explode("nbest_ids").alias("ids"))
    back = tokens.decoded(each).collect()
    assert len(back) == sum(len(r["scores"]) for r in got.values()) > 12
    assert all(r["decoded"] == (r["text"] or "").replace("▁", " ") for r in back)
    odd = spark.createDataFrame([(1, None), (2, [10**6, None]), (3, [])], "n long, ids array<int>")
    assert [r["decoded"] for r in tokens.decoded(odd).orderBy("n").collect()] == [None, pieces.decode([0, 0]), ""]


def test_toxicity_learns_stems(spark, nothing):
    rng = np.random.default_rng(6)
    bad = ["stupid", "worthless", "idiot"]
    data = []
    for i in range(600):
        words = prose(rng, int(rng.integers(30, 300))).split()
        toxic = i % 5 == 0
        if toxic:
            for _ in range(max(2, len(words) // 40)):
                words[int(rng.integers(0, len(words)))] = str(rng.choice(bad))
        data.append((i, " ".join(words), int(toxic)))
    df = spark.createDataFrame(data, "doc_id long, text string, toxic int")
    extra = spark.createDataFrame([(None, "stupidd worthlesss idioot " * 3), (9001, None), (9002, "")], "doc_id long, text string")
    docs = df.select("doc_id", "text").unionByName(extra)
    model = toxicity.fitted(docs, df.select("doc_id", "toxic"))
    got = toxicity.scored(docs, model).withColumn("h", toxicity.held_out(F.col("doc_id"))).toPandas()
    held = got[got.h].merge(pd.DataFrame(data, columns=["doc_id", "t", "toxic"]), on="doc_id")
    assert len(held) > 80 and (held.predicted == held.toxic).mean() > 0.97
    assert got.score.between(0, 1).all()
    assert got[got.text.fillna("").str.startswith("stupidd")].predicted.tolist() == [1]  # unseen misspellings
    assert (got[got.doc_id >= 9001].predicted == 0).all()
    none = toxicity.fitted(docs, df.select("doc_id", "toxic").where("false"))
    assert toxicity.scored(docs, none).where("predicted = 1").count() == 0
    assert toxicity.scored(nothing, none).count() == 0




def test_words_and_bytes_as_columns():
    """Words side by side are those alone, full stops and characters without a piece included; ids decode as their pieces do."""
    pieces = tokens.load()
    words = ["▁the", "▁end.", "end.", ".", "▁a,b", "▁naïve:", "▁", "\n", "▁\U0001f600x.", "▁" + "long" * 40 + ";", "▁the"]
    known = tokens.Words(pieces, 3)
    known.add(words[:4])
    known.add(words)
    assert sorted(known.names) == sorted(set(words))
    for word in words:
        k = known.number[word]
        best, second = [*tokens._ways(pieces, word, 2), None][:2]
        assert known.ids[k] == np.array(best[1], np.int32).tobytes() and abs(known.scores[k] - best[0]) < 1e-9
        assert abs(known.gaps[k] - (best[0] - second[0])) < 1e-9 if second else known.gaps[k] == np.inf
    ids, scores, gaps = pieces.columns([])
    assert ids == [] and len(scores) == len(gaps) == 0
    for ids in ([], [0], list(range(len(pieces.plain)))[::-1]):
        assert pieces.plain_bytes(ids) == b"".join(pieces.plain[i] for i in ids)
