"""Vectors, archives, the two models and the pipeline."""

import random
import zlib
from collections import Counter
from math import log2, log10

import numpy as np
import public_tokenizers
import pytest

import corpus_pipeline
from hourgrain.llm import embeddings, lm, quality, queries, warc
from hourgrain.llm.common import components
from tests.llm.test_text import groups

SF = "/root/testdata/sf0.001"


def test_components_of_long_chains(spark):
    rng = random.Random(3)
    ids = list(range(400))
    rng.shuffle(ids)
    edges = list(zip(ids[:300], ids[1:301])) + [(5, 5), (ids[350], ids[351])]
    got = {r["node"]: r["component"] for r in components(spark.createDataFrame(edges, "a bigint, b bigint")).collect()}
    want = groups(ids, edges)
    assert got == {i: want[i] for i in got} and len(got) == 303
    assert components(spark.createDataFrame([], "a bigint, b bigint")).count() == 0


@pytest.mark.parametrize("block", [16, 4096])
def test_embeddings_equal_brute_force(spark, block):
    rng = np.random.default_rng(block)
    centres = rng.standard_normal((12, 24))
    x = np.concatenate([centres[rng.integers(0, 12, 150)] + 0.35 * rng.standard_normal((150, 24)), np.repeat(centres[:2], 30, axis=0), rng.standard_normal((20, 24))])
    vectors = [(i, [float(a) for a in v], "c", 1) for i, v in enumerate(x)]
    odd = [None, [], [0.0] * 24, [float("nan")] * 24, [None] * 24, [float("inf")] * 24, [1.0] * 3, [2.0] * 3, [1e300] * 24, [1e-300] * 24]
    vectors += [(1000 + n, v, "c", 1) for n, v in enumerate(odd)] + [(1500, [3.0] * 3, "c", 1), (None, [4.0] * 3, "c", 1)]
    df = spark.createDataFrame(vectors, "vec_id bigint, embedding array<double>, component_id string, n_links int")
    good = {i: np.array(v, dtype=float) for i, v, *_ in vectors if v and i is not None and all(a is not None and np.isfinite(a) for a in v) and any(v)}
    unit = {i: (v / abs(v).max()) / np.linalg.norm(v / abs(v).max()) for i, v in good.items()}
    linked = [(a, b) for a in unit for b in unit if a != b and len(unit[a]) == len(unit[b]) and unit[a] @ unit[b] >= 0.9]
    count, want = Counter(a for a, _ in linked), groups([i for i, *_ in vectors if i is not None], linked)
    for i in (1006, 1007, 1500):
        count[i] += 1  # the vector without id is linked and counted
    rows = {r["vec_id"]: (r["n_links"], r["component_id"], r["kept"]) for r in embeddings.near_duplicates(df, block=block).collect()}
    assert rows.pop(None) == (3, 1006, False)
    assert rows == {i: (count[i], want[i], want[i] == i) for i, *_ in vectors if i is not None}
    assert embeddings.near_duplicates(df.limit(0)).count() == 0


def test_embeddings_of_lengths_that_a_block_lacks(spark):
    rng = np.random.default_rng(12)
    rows = [(i, [float(x) for x in rng.normal(size=8)]) for i in range(60)] + [(60, [1.0, 2.0, 3.0]), (61, [1.0, 2.0, 3.1])]
    rows += [(70 + i, [1.01 * x for x in rows[i][1]]) for i in range(3)]
    df = spark.createDataFrame(rows, "vec_id bigint, embedding array<double>")
    unit = {i: np.array(v) / np.linalg.norm(v) for i, v in rows}
    want = {i: sum(j != i and len(unit[j]) == len(unit[i]) and float(unit[i] @ unit[j]) >= 0.9 for j in unit) for i in unit}
    for block in (10, 7, 3):
        assert {r["vec_id"]: r["n_links"] for r in embeddings.near_duplicates(df, block=block).collect()} == want


def test_quantisation_bounds_hold():
    rng = np.random.default_rng(5)
    x = rng.standard_normal((300, 1500))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    q, s, e = embeddings.quantised(x)
    gap = np.abs(x @ x.T - embeddings.exact_products(q, q) * s[:, None] * s[None, :])
    assert (gap <= (1 + e[:, None]) * (1 + e[None, :]) - 1 + 1e-12).all()
    assert (embeddings.exact_products(q, q) == (q.astype(np.int64) @ q.astype(np.int64).T)).all()


def test_archive_round_trip(spark):
    big = "<html>" + "x" * 700_000
    rows = [(1, "http://a/ b", "é" * 100), (5, "u", "é" * 100), (3, None, None), (4, "u", ""), (9, "u", "s" * 99), (8, "u", "s" * 99), (None, "u", "é" * 100), (7, "u", big), (7, "u", big), (6, "u", "a\r\n\r\nWARC/1.1\r\n" * 20)]
    pages = spark.createDataFrame([(*r, "x") for r in rows], "page_id bigint, url string, html string, record_type string")
    folder = "file://" + warc.scratch_path(spark, "warc-test").removeprefix("file:").replace("//", "/")
    index = warc.write(pages, folder)
    back = warc.read(spark, folder, index).collect()
    assert len(back) == len(rows)
    kinds = Counter((r["page_id"], r["record_type"], r["refers_to"]) for r in back)
    assert kinds[5, "revisit", 1] == 1 and kinds[7, "response", None] == 2 and kinds[None, "response", None] == 1 and kinds[9, "response", None] == kinds[8, "response", None] == 1
    text = {r[0]: (r[2] or "").encode() for r in rows}
    assert all(bytes(r["payload"]) == (b"" if r["record_type"] == "revisit" else text[r["page_id"]]) for r in back if r["page_id"])
    for place in index.collect():  # every record by its own frame alone
        with open(f"{folder.removeprefix('file://')}/{place['bundle']}", "rb") as f:
            head, _ = warc.read_record(f.read(), place["frame"], place["record_offset"])
        assert head.get("X-Page-ID") == (None if place["page_id"] is None else str(place["page_id"]))
    assert warc.archive(pages.limit(0)).count() == 0


def brute_model(texts):
    """Interpolated modified Kneser-Ney trigrams by dictionaries; returns the bits of a text's words and end."""
    c3 = Counter()
    for text in texts:
        w = ["<", "<", *text.lower().split(), ">"]
        c3.update(zip(w, w[1:], w[2:]))
    c2, c1 = Counter((b, c) for _, b, c in c3), None
    c1 = Counter(c for _, c in c2)

    def table(counts, context):
        n = Counter(counts.values())
        y = n[1] / (n[1] + 2 * n[2]) if n[1] + n[2] else 0
        d = [max(0, min(i, i - (i + 1) * y * n[i + 1] / n[i])) if n[i] and n[i + 1] else i / 2 for i in (1, 2, 3)]
        total, left = Counter(), Counter()
        for g, c in counts.items():
            total[context(g)] += c
            left[context(g)] += d[min(c, 3) - 1]
        return {g: (c - d[min(c, 3) - 1]) / total[context(g)] for g, c in counts.items()}, {h: left[h] / total[h] for h in total}

    (p3, g3), (p2, g2), (p1, g1) = table(c3, lambda g: g[:2]), table(c2, lambda g: g[0]), table(c1, lambda g: 0)
    rest = g1[0] / (len(c1) + 1)

    def bits(text):
        w = ["<", "<", *text.lower().split(), ">"]
        out = 0.0
        for a, b, c in zip(w, w[1:], w[2:]):
            one = p1.get(c, 0) + rest
            two = p2.get((b, c), 0) + g2.get(b, 1) * one
            out -= log2(p3.get((a, b, c), 0) + g3.get((a, b), 1) * two)
        return out / (len(w) - 2)

    return bits


def test_quality_perplexities_equal_brute_force(spark):
    docs = [(r["doc_id"], r["text"], r["lang"]) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    ids = [i for i, *_ in docs if i % 3]
    got = quality.classify(spark.createDataFrame([(*d, 1) for d in docs], "doc_id bigint, text string, lang string, threshold int"), spark.createDataFrame([(i,) for i in ids], "doc_id bigint"), sample_docs=40).collect()
    halves = {r["doc_id"]: r["h"] for r in spark.createDataFrame([(i,) for i in ids], "doc_id bigint").selectExpr("doc_id", "xxhash64(doc_id) h").collect()}
    sample = sorted((i for i in ids if halves[i] % 2 == 0), key=lambda i: halves[i])[:40]
    bits = brute_model([t for i, t, _ in docs if i in sample])
    text = {i: t for i, t, _ in docs}
    assert len(got) == len(docs) and all(abs(log2(r["perplexity"]) - bits(text[r["doc_id"]])) < 1e-9 for r in got)
    for lang in {d[2] for d in docs}:
        held = sorted(bits(t) for i, t, own in docs if own == lang and i in ids and halves[i] % 2)
        if held:
            limit = np.ceil(held[int(np.ceil(len(held) * 0.98)) - 1] * 1000) / 1000 + 1
            assert all(r["accepted"] == (bits(text[r["doc_id"]]) <= limit) for r in got if r["lang"] == lang)


def test_quality_held_out_accuracy(spark):
    judged = queries.QUERIES["op10_quality_classifier"](spark, "/root/testdata/sf0.01").join(spark.read.parquet("/root/testdata/sf0.01/labels.parquet"), "doc_id").collect()
    clean, junk = [r for r in judged if r["quality"] == 1], [r for r in judged if r["quality"] == 0]
    assert sum(r["accepted"] for r in clean) >= 0.98 * len(clean) and sum(not r["accepted"] for r in junk) >= 0.7 * len(junk)


def test_quality_edges(spark):
    schema = "doc_id bigint, text string, lang string"
    docs = spark.createDataFrame([(1, None, "en"), (2, "", "en"), (3, "some words here", None), (3, "some words here", None), (None, "more words", "fr")], schema)
    none = spark.createDataFrame([], "doc_id bigint")
    rows = {r["doc_id"]: r for r in quality.classify(docs, none).collect()}
    assert len(rows) == 4 and not rows[1]["accepted"] and rows[1]["perplexity"] is None and rows[3]["accepted"] and rows[None]["accepted"] and rows[3]["threshold"] is None
    assert quality.classify(docs.limit(0), none).count() == 0
    trusted = spark.createDataFrame([(i,) for i in (1, 2, 3)], "doc_id bigint")
    assert quality.classify(docs, trusted).count() == 4


def test_lm_base_and_fold(spark):
    rows = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()] + [(None, None), (7000, ""), (7000, ""), (7001, "unseenword " * 3)]
    out = lm.scores(spark.createDataFrame([(*r, 1.0) for r in rows], "doc_id bigint, text string, score double"), public_tokenizers.path("byte_bpe_50k.tiktoken")).collect()
    words = [(i, lm.words_of(t) + [lm.END]) for i, t in rows]
    held = lambda i: zlib.crc32(("" if i is None else str(i)).encode()) % 5 == 1
    c = Counter(w for i, own in words if not held(i) for w in own)
    n, v = sum(c.values()), len(c)
    want = sorted((str(i), held(i), len(own), sum(w in c for w in own), n, round(sum(log10((c[w] + 0.5) / (n + 0.5 * (v + 1))) for w in own), 6)) for i, own in words)
    assert sorted((str(r["doc_id"]), r["held_out"], r["n_tokens"], r["n_known"], r["train_tokens"], round(r["base_score"], 6)) for r in out) == want
    assert all(np.isfinite(r["score"]) and r["score"] < 0 for r in out)
    assert lm.scores(spark.createDataFrame([], "doc_id bigint, text string"), public_tokenizers.path("byte_bpe_50k.tiktoken")).count() == 0


def test_lm_training_visits_every_window(spark):
    rng = np.random.default_rng(2)
    sizes = [3, 40 * lm.SPAN + 5, 25 * lm.SPAN]
    rows = [(i, bytes(rng.integers(0, lm.CLASSES, n, dtype=np.uint8))) for i, n in enumerate(sizes)]
    per_pass = [sum(int((lm.windows(np.frombuffer(c, dtype=np.uint8).astype(np.int16), lm.SPAN, (i + t) % min(lm.VISIT, -(-len(c) // lm.SPAN)), lm.VISIT)[1] >= 0).sum()) for i, c in rows) for t in range(lm.ROUNDS)]
    assert sum(per_pass) >= sum(sizes)
    trained = lm.train(spark.createDataFrame(rows, "row bigint, classes binary").coalesce(1))
    assert np.isfinite(lm.flat(trained)).all() and not np.array_equal(lm.flat(trained), lm.flat(lm.start_parameters()))


def test_lm_scores_do_not_depend_on_the_broadcast_list(spark, monkeypatch):
    docs = spark.read.parquet(f"{SF}/documents.parquet").where("doc_id < 60")
    score = lambda: {r["doc_id"]: r["score"] for r in lm.scores(docs, public_tokenizers.path("byte_bpe_50k.tiktoken")).collect()}
    whole = score()
    monkeypatch.setattr(lm, "COMMON", 20)
    joined = score()
    assert set(whole) == set(joined) and all(abs(whole[i] - joined[i]) < 0.01 + 1e-4 * abs(whole[i]) for i in whole)


def test_lm_windows_score_every_token_once():
    rng = np.random.default_rng(0)
    p = lm.start_parameters() | {"pairs": rng.standard_normal((lm.CLASSES + 1, lm.CLASSES)).astype(np.float32)}
    documents = [rng.integers(0, lm.CLASSES, n) for n in (1, 31, 32, 33, 200)]
    token = lm.log_probabilities(p, documents)
    assert len(token) == sum(map(len, documents))
    last = documents[-1]
    at = 150  # one token by hand: its window's context reaches back to a multiple of STEP, less CONTEXT
    start = at // lm.STEP * lm.STEP - lm.CONTEXT
    x = np.concatenate([last[start - 1 : start - 1 + lm.SPAN]])[None, :]
    z, _ = lm.forward(p, x, slice(0, lm.SPAN))
    assert abs(z[0, at - start, last[at]] - token[sum(map(len, documents[:-1])) + at]) < 1e-4
    assert abs(np.exp(z[0]).sum(axis=1) - 1).max() < 1e-4


def test_lm_gradients():
    rng = np.random.default_rng(1)
    p = {k: x.astype(np.float64) + 0.05 * rng.standard_normal(x.shape) for k, x in lm.start_parameters().items()}
    x, y = rng.integers(0, lm.CLASSES + 1, (2, lm.SPAN)), rng.integers(0, lm.CLASSES, (2, lm.SPAN))
    real = rng.random(y.shape) < 0.8
    b, t = np.indices(y.shape)
    loss = lambda: -(lm.forward(p, x, slice(0, lm.SPAN))[0][b, t, y] * real).sum() / real.sum()
    for name, g in lm.gradients(p, x, y, real).items():
        i = (x[0, 5], 3) if name == "embed" else tuple(rng.integers(0, n) for n in p[name].shape)
        was, e = p[name][i], 1e-5
        p[name][i] = was + e
        up = loss()
        p[name][i] = was - e
        down = loss()
        p[name][i] = was
        assert abs((up - down) / (2 * e) - g[i]) < 1e-5 + 1e-3 * abs(g[i]), name


def test_pipeline_stages_take_effect(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").withColumnRenamed("source", "gone_id")
    columns, ids = docs.columns, []
    for name, stage in corpus_pipeline.STAGES:
        before = {r["doc_id"]: r for r in docs.collect()}
        docs = corpus_pipeline.stored(stage(spark, docs, SF), f"test-{name}")
        after = {r["doc_id"]: r for r in docs.collect()}
        ids.append(set(after))
        if name != "bpe":
            assert docs.columns == columns
        if name == "quality":
            accepted = {r["doc_id"] for r in queries.QUERIES["op10_quality_classifier"](spark, SF).where("accepted").collect()}
            assert set(after) == accepted and after == {i: before[i] for i in accepted}
        if name == "simhash":
            from tests.llm.test_near import brute_set, jaccard

            sets = {i: brute_set(r["text"]) for i, r in before.items()}
            want = groups(list(sets), [(a, b) for a in sets for b in sets if a < b and jaccard(sets[a], sets[b]) >= 0.8])
            assert set(after) == set(want.values())
        if name == "suffix":
            assert set(after) == set(before) and all(len(after[i]["text"]) == after[i]["n_chars"] <= len(before[i]["text"]) for i in after)
            assert sum(after[i]["n_chars"] for i in after) < sum(len(r["text"]) for r in before.values())
        if name == "decontamination":
            assert ids[-1] < ids[-2]
        if name == "bpe":
            assert set(after) == set(before)
    empty = spark.read.parquet(f"{SF}/documents.parquet").limit(0)
    for _, stage in corpus_pipeline.STAGES:
        empty = stage(spark, empty, SF)
    assert empty.count() == 0
