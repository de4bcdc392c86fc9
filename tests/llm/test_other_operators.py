"""Vectors, WARC, quotations, secrets, and the pipeline's frame."""

import collections
import gzip
import hashlib
import itertools
import os
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from sentrymill.llm import groups, mixing, quotes, secret_forest, vectors, warc


def test_near_vectors(spark):
    rng = np.random.default_rng(1)
    base = rng.normal(size=(40, 24))
    rows = [(i, v.tolist()) for i, v in enumerate(base)]
    for i in range(60):
        rows.append((100 + i, (base[i % 7] + 0.05 * rng.normal(size=24)).tolist()))
    rows += [(300 + i, base[3].tolist()) for i in range(5)] + [(310, (base[3] * 1e-200).tolist()), (311, (base[3] * 1e200).tolist())]
    rows += [(320, None), (321, []), (322, [0.0] * 24), (323, [None, *base[3].tolist()[1:]]), (324, [float("nan")] * 24),
             (325, [float("inf")] * 24), (326, base[3].tolist()[:12]), (None, base[3].tolist())]
    rows += [rows[50], rows[50]]
    df = spark.createDataFrame([(*r, 7, "x") for r in rows], "vec_id long, embedding array<double>, n_links int, `a b` string").repartition(3)

    def unit(v):
        if v is None or len(v) != 24 or any(x is None or not np.isfinite(x) for x in v) or not any(v):
            return None
        v = np.array(v) / np.abs(v).max()
        return v / np.linalg.norm(v)

    units = {i: unit(v) for i, v in rows if i is not None}
    edges = [(a, b) for a, b in itertools.combinations(sorted(units), 2) if units[a] is not None and units[b] is not None
             and units[a] @ units[b] >= 0.95]
    assert len(edges) > 100
    label = {i: i for i in units}
    for _ in range(10):
        for a, b in edges:
            label[a] = label[b] = min(label[a], label[b])
    links = collections.Counter(itertools.chain(*edges))
    for block in (1000, 4):
        got = vectors.near_vectors(df, block=block).collect()
        assert len(got) == len(rows)
        for r in got:
            i = r["vec_id"]
            assert (r["n_links"], r["component_id"]) == ((links[i], label[i]) if i is not None else (0, None))
            assert r["kept"] == (i is None or label[i] == i)
    assert vectors.near_vectors(df.where("false")).count() == 0


def test_hashing_meets_as_planned():
    tables, order = vectors.plan(100_000, 64)
    rng = np.random.default_rng(9)
    a = rng.normal(size=(500, 64))
    a /= np.linalg.norm(a, axis=1, keepdims=True)
    b = rng.normal(size=(500, 64))
    b -= (a * b).sum(1, keepdims=True) * a
    b = 0.95 * a + np.sqrt(1 - 0.95 ** 2) * b / np.linalg.norm(b, axis=1, keepdims=True)
    ka, kb = vectors.keys_of(a, tables, order), vectors.keys_of(b, tables, order)
    assert (ka[:, :, :, None] == kb[:, :, None, :]).any((1, 2, 3)).mean() > 0.995
    assert order >= 3 and np.allclose(vectors.hadamard(vectors.hadamard(a)) / 64, a)


def test_components_of_a_long_path(spark):
    rng = np.random.default_rng(2)
    path = rng.permutation(300).tolist()
    edges = [(path[i], path[i + 1]) for i in range(199)] + [(path[i], path[i + 1]) for i in range(200, 299)]
    got = {r["node"]: r["component"] for r in groups.components(spark.createDataFrame(edges, "id long, root long")).collect()}
    assert got == {n: min(path[:200]) for n in path[:200]} | {n: min(path[200:]) for n in path[200:]}
    assert groups.components(spark.createDataFrame([], "id long, root long")).count() == 0


@pytest.fixture(scope="module")
def pages(spark):
    rng = np.random.default_rng(5)
    noise = "".join(map(chr, rng.integers(32, 1000, 300_000)))  # hardly compressible, more than a range below
    big = "é" * 600
    rows = [(1, "http://a.example/\r\nX", big), (2, None, big), (9, "u", big), (3, "u", "small"), (4, "u", "small"), (5, "u", None), (6, "u", ""),
            (7, "u", noise), (8, "u", "WARC/1.1\r\n\r\n\x1f\x8b\x08 looks like a member" * 50), (None, "u", big + "!" * 9), (10, "u", "z" * (17 << 20)),
            (11, "u", "w" * 1000), (11, "u", "w" * 1000)]
    return rows, spark.createDataFrame([(*r, "extra") for r in rows], "page_id long, url string, html string, headers string").repartition(3)


def test_warc_round_trip(spark, pages, tmp_path):
    rows, df = pages
    folder = str(tmp_path / "archives")
    warc.write_archives(df, folder)
    records = 0
    for name in os.listdir(folder):
        if name.startswith("part"):
            data = gzip.open(os.path.join(folder, name)).read()  # plain gzip readers take the files
            records += data.count(b"WARC/1.1\r\nWARC-Type")
    assert records == len(rows)
    for span in (1_000, 8 << 20):
        got = warc.pages_of(warc.read_archives(spark, folder, span=span)).collect()
        assert sorted(str(r["page_id"]) for r in got) == sorted(str(r[0]) for r in rows)
        text = {r[0]: (r[2] or "").encode() for r in rows}
        for r in got:
            full = text[r["page_id"]]
            assert (r["payload_bytes"], r["payload_digest"]) == (len(full), hashlib.sha1(full).hexdigest())
            first = 9 if r["page_id"] in (1, 2) else None
            assert (r["record_type"], r["refers_to"]) == ("revisit" if first else "response", first)
            assert bytes(r["payload"]) == (b"" if first else full) and r["digest_ok"] == (None if first else True)
    warc.write_archives(df.where("false"), str(tmp_path / "none"))
    assert warc.read_archives(spark, str(tmp_path / "none")).count() == 0


def test_reader_skips_damage(tmp_path):
    good = [warc.member(warc.record("response", str(i), "u", b"x" * i, hashlib.sha1(b"x" * i).hexdigest(), None)) for i in range(5)]
    data = b"junk\x1f\x8b\x08junk" + good[0] + good[1][:-20] + good[2] + warc.member(b"not a record") + good[3] + good[4][:30]
    path = tmp_path / "x"
    path.write_bytes(data)
    for span in (1, 7, 100, len(data)):
        found = []
        with open(path, "rb") as f:
            for start in range(0, len(data), span):
                found += [warc.parsed(d)[0]["x-page-id"] for _, d in warc.members_in(f, len(data), start, start + span)]
        assert found == ["0", "2", "3"]


MAIL = [
    (1, 0, "Shall we meet on Monday?\nI have time after lunch.\n"),
    (1, 1, "> Shall we meet on Monday?\n> I have time after lunch.\nMonday is fine with me."),
    (1, 2, "> I have   TIME after lunch.\nAfter lunch is better for all of us."),
    (1, 3, ">> Shall we meet on Monday?\n>> I have time after lunch.\n> Monday is fine with me.\nThen let us say Monday."),
    (1, 4, "No quote at all in this one."),
    (1, 5, "> a passage that nobody wrote before\nWho said that?"),
    (2, 7, None), (2, 8, ""), (2, 9, "> short\nok"), (2, 9, "> short\nok"), (None, 3, "> quoted text of nobody\nalone"), (3, None, "no turn"),
]


def test_quotations(spark):
    df = spark.createDataFrame([(*r, "u", 5) for r in MAIL], "conv_id long, turn long, text string, role string, depth int")
    got = quotes.reply_ordered(df).collect()
    assert len(got) == len(MAIL) and "role" in got[0].asDict()
    one = {r["turn"]: r for r in got if r["conv_id"] == 1}
    assert [one[t]["parent"] for t in range(6)] == [None, 0, 0, 1, 3, 4]
    assert [one[t]["depth"] for t in range(6)] == [0, 1, 1, 2, 3, 4]
    assert [one[t]["position"] for t in range(6)] == [0, 1, 2, 3, 4, 5]
    assert [one[t]["n_linked"] for t in range(6)] == [0, 1, 1, 2, 0, 0]
    assert [one[t]["quote_levels"] for t in range(6)] == [0, 1, 1, 2, 0, 1]
    assert one[3]["own_text"] == "Then let us say Monday." and one[0]["own_text"] == "Shall we meet on Monday?\nI have time after lunch."
    two = sorted((r["place"], r["parent"], r["own_text"]) for r in got if r["conv_id"] == 2)
    assert [(p, q) for p, q, _ in two][1:] == [(1, 0), (2, 1), (3, 2)]
    alone = next(r for r in got if r["conv_id"] is None)
    assert (alone["place"], alone["parent"], alone["own_text"], alone["quote_levels"]) == (0, None, "alone", 1)
    assert quotes.reply_ordered(df.where("false")).count() == 0


def test_short_quotes_link(spark):
    mail = [(0, "Yes, please"), (1, "Which day suits you all?\nNo idea\nTell me soon, it is urgent."), (2, "Let us ask the others."),
            (3, "> yes,  PLEASE\nGood."), (4, "> Good.\n>> Yes, please\nOk"), (5, "> No idea\nA line of a longer passage is too short."),
            (6, "> Ok\nNo."), (7, "> \n> never said\nBlank and unknown"), (8, "> No.\n> Ok\nNot a passage of anyone")]
    df = spark.createDataFrame([(1, *r) for r in mail], "conv_id long, turn long, text string")
    got = {r["turn"]: r for r in quotes.reply_ordered(df).collect()}
    assert [got[t]["parent"] for t in range(9)] == [None, 0, 1, 0, 3, 4, 4, 6, 7]
    assert [got[t]["n_linked"] for t in range(9)] == [0, 0, 0, 1, 2, 0, 1, 0, 0]
    assert got[3]["depth"] == 1 and got[4]["depth"] == 2
    low = {r["turn"]: r for r in quotes.reply_ordered(df, least=3).collect()}
    assert (low[5]["parent"], low[5]["n_linked"], low[8]["parent"]) == (1, 1, 6)


def test_quoted_view_links_back(spark):
    turns = spark.createDataFrame([(c, t, "user", f"Message number {c * 100 + t} of this talk.\nIts second line {c}-{t} ends.")
                                   for c in range(3) for t in range(20)], "conv_id long, turn long, role string, text string")
    mail = quotes.with_quotes(turns)
    got = quotes.reply_ordered(mail).collect()
    assert all(r["parent"] == (r["turn"] - 1 if r["turn"] else None) and r["depth"] == r["turn"] for r in got)
    assert {(r["conv_id"], r["turn"]): r["own_text"] for r in got} == {(r["conv_id"], r["turn"]): r["text"] for r in turns.collect()}
    plan = quotes.reply_ordered(mail)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan


def test_secret_forest(spark):
    rng = np.random.default_rng(3)
    digits = "0123456789abcdef"
    text, labels = [], []
    for i in range(400):
        value = "".join(rng.choice(list(digits), 40))
        secret = i % 2 == 0
        line = f'the api token = "{value}" end' if secret else f"see order id12345customerorder{i:06d} for the report of the day"
        text.append((i, f"plain words of the report before {line} and words of the day after", "src/app" if secret else "docs/test"))
        labels.append((i, int(secret)))
    text += [(900, None, None), (901, "", "x"), (902, "no candidates at all", "x"), (None, 'token = "0123456789abcdef0123"', None)]
    docs = spark.createDataFrame([(*r, 1) for r in text], "doc_id long, text string, source string, at int")
    found = secret_forest.candidates(docs)
    train = found.join(spark.createDataFrame(labels, "id long, label int").where("id % 4 < 2"), "id")
    got = secret_forest.secret_findings(docs, labelled=train).toPandas()
    held = got[(got.id % 4 >= 2) & (got.id < 400)]
    assert len(held) == 200 and (held.is_secret == (held.id % 2 == 0)).mean() > 0.98
    assert got[got.id.isna()].is_secret.tolist() == [True]
    assert not set(got.id.dropna()) & {900, 901, 902}
    unlabelled = secret_forest.secret_findings(docs)  # labels from the context of the findings
    assert unlabelled.where("is_secret").count() >= 200
    empty = secret_forest.secret_findings(docs.where("false"))
    assert empty.count() == 0
    plan = unlabelled._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan


def test_every_run_of_a_word_is_a_candidate(spark):
    a, b = "9f8e7d6c5b4a39281706", "0a1b2c3d4e5f60718293"
    texts = [f'private_key="{a}"', f'client_secret:"{a}"', f"see https://dashboard-internal.example.com/?token={a}&key={b} there",
             f'secrets {{"api_token":"{a}","client_secret":"{b}"}} end', "dashboard-internal.example-company 12345", f"Bearer {a}.{b}.{a}"]
    docs = spark.createDataFrame([(i, t, "x") for i, t in enumerate(texts)], "doc_id long, text string, source string")
    got = [tuple(r) for r in secret_forest.candidates(docs).select("id", "at", "run", "candidate").orderBy("id", "at", "run").collect()]
    assert got == [(0, 0, 0, a), (1, 0, 0, a), (2, 1, 0, f"token={a}"), (2, 1, 1, f"key={b}"), (3, 1, 0, a), (3, 1, 1, b),
                   (5, 1, 0, a), (5, 1, 1, b), (5, 1, 2, a)]
    label = {(r["id"], r["run"]): r["label"] for r in secret_forest.candidates(docs).withColumn("label", secret_forest.context_label()).collect()}
    assert [label[k] for k in ((0, 0), (1, 0), (3, 0), (3, 1))] == [1, 1, 1, 1]
    assert 0 not in (label[5, 1], label[5, 2])  # parts of what the word before names
    line = ",".join(f'"k{i}":"{a}{i}"' for i in range(3_000))  # minified JSON, a long word in front of another
    long = secret_forest.candidates(spark.createDataFrame([(1, f"{{{line}}}\n{{{line}}}", "x")], "doc_id long, text string, source string"))
    assert long.count() == 6_000
    assert long.select(F.sum(F.length(F.concat_ws("", "before2", "before", "lead", "tail", "after")))).first()[0] < 5 * 2 * len(line)
    found = secret_forest.secret_findings(docs)
    assert found.count() == len(got) and found.select("id", "at", "run").distinct().count() == len(got)


def test_pipeline_frame(spark, tmp_path):
    import corpus_pipeline

    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "line_dedup", "ngram_jaccard", "mixing", "sentencepiece"]
    rng = np.random.default_rng(4)
    words = "alpha beta gamma delta epsilon zeta eta theta iota kappa".split()
    body = [" ".join(str(w) + str(int(n)) for w, n in zip(rng.choice(words, 60), rng.integers(0, 99, 60), strict=True)) for _ in range(40)]
    body = [b + " worthless idiot stupid worthless idiot" if i % 4 == 0 else b for i, b in enumerate(body)]
    rows = [(i, b, "en", "s%d" % (i % 3), len(b)) for i, b in enumerate(body)] + [(50, body[1], "en", "s1", 0), (51, None, None, None, None)]
    path = str(tmp_path)
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame([(i, 1, int(i % 4 == 0)) for i in range(40)], "doc_id long, quality int, toxic int").write.parquet(f"{path}/labels.parquet")
    docs = spark.read.parquet(f"{path}/documents.parquet")
    kept = corpus_pipeline.STAGES[0][1](spark, docs, path)
    assert kept.columns == docs.columns and {r["doc_id"] for r in kept.collect()} >= {i for i in range(40) if i % 4}
    out = corpus_pipeline.run(spark, path)
    assert out.where(~F.col("round_trip")).count() == 0
    # the later stages by brute force, over what the classifier kept
    texts = {r["doc_id"]: (r["text"] or "", r["source"]) for r in kept.collect()}
    keys = {i: [re.sub("[A-Z]+", lambda m: m[0].lower(), line.strip()) for line in t.split("\n")] for i, (t, _) in texts.items()}
    first = {}
    for i in sorted(texts):
        for k in keys[i]:
            first.setdefault(k, i)
    texts = {i: ("\n".join(line for line, k in zip(t.split("\n"), keys[i], strict=True) if len(k) < 10 or first[k] == i), s)
             for i, (t, s) in texts.items()}
    grams = {i: {tuple(t.lower().split()[j:j + 5]) for j in range(len(t.split()) - 4)} for i, (t, _) in texts.items()}
    label = {i: i for i in texts}
    for _ in range(5):
        for a, b in itertools.combinations(sorted(texts), 2):
            if grams[a] and 10 * len(grams[a] & grams[b]) >= 8 * len(grams[a] | grams[b]):
                label[a] = label[b] = min(label[a], label[b])
    texts = {i: x for i, x in texts.items() if label[i] == i}
    sizes = collections.Counter()
    for t, s in texts.values():
        sizes[s] += len(t.split())
    order = sorted((s for s in sizes), key=lambda s: (s is None, s or ""))
    target = dict(zip(order, mixing.targets([sizes[s] for s in order], [(5, 2, 1)[i % 3] for i in range(len(order))]), strict=True))
    got, rows_of = collections.Counter(), collections.Counter()
    for r in out.collect():
        whole = texts[r["doc_id"]][0]
        assert whole.startswith(r["text"]) and r["n_chars"] == len(r["text"])
        got[r["source"]] += len(r["text"].split())
        rows_of[r["doc_id"]] += 1
    assert all(abs(got[s] - target[s]) <= 1 for s in order) and max(rows_of.values()) <= 2
    assert 50 not in rows_of and 51 not in rows_of  # a copy, and a row without text


def test_pipeline_keeps_columns_of_any_name(spark, tmp_path):
    import corpus_pipeline

    rng = np.random.default_rng(6)
    extra = ["kept", "_place", "Score", "a.b", "PREDICTED", "n_lines", "_body", "group_id", "c1_", "_key", "a b`c", "TEXT_"]
    rows = [(i, " ".join(f"w{int(x)}" for x in rng.integers(0, 500, 40)), "s", *[f"{c}{i}" for c in extra]) for i in range(20)]
    schema = "doc_id long, text string, source string, " + ", ".join("`" + c.replace("`", "``") + "` string" for c in extra)
    docs = spark.createDataFrame(rows, schema).repartition(2)
    spark.createDataFrame([(i, 1, i % 2) for i in range(20)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, str(tmp_path))
        assert out.columns[:len(docs.columns)] == docs.columns
        got = out.collect()
        assert got or name == "toxicity"
        for r in got:
            assert r[3:3 + len(extra)] == tuple(f"{c}{r[0]}" for c in extra)
        assert stage(spark, docs.where("false"), str(tmp_path)).count() == 0
    clash = docs.withColumn("IDS", F.lit(1))
    out = corpus_pipeline.encoded(spark, clash, "")
    assert out.columns == [*docs.columns, *corpus_pipeline.RESULTS]


def test_warc_null_ids_revisit_and_ranges_are_tasks(spark, tmp_path):
    rows = [(None, "u", "x" * 2000), (5, "u", "x" * 2000), (9, "u", "x" * 2000), (None, "u", "y" * 2000), (None, "u", "y" * 2000), (7, "u", "short")]
    rng = np.random.default_rng(8)
    rows += [(100 + i, "u", "".join(map(chr, rng.integers(97, 123, 3000)))) for i in range(40)]
    folder = str(tmp_path / "archives")
    warc.write_archives(spark.createDataFrame(rows, "page_id long, url string, html string").coalesce(1), folder)
    records = warc.read_archives(spark, folder, span=4096)
    found = [(r["page_id"], r["record_type"], r["refers_to"]) for r in warc.pages_of(records).collect()]
    assert collections.Counter(f for f in found if f[0] is None or f[0] < 100) == collections.Counter(
        [(None, "revisit", 9), (5, "revisit", 9), (9, "response", None), (None, "response", None), (None, "response", None), (7, "response", None)])
    length = sum(os.path.getsize(os.path.join(folder, f)) for f in os.listdir(folder) if f.startswith("part-"))
    assert length > 10 * 4096 and records.rdd.getNumPartitions() >= length // 4096
