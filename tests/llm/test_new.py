"""Fill-in-the-middle, filter audit and toxicity against brute force; their stated edge cases."""

import hashlib
import itertools
import random
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from hourgrain.llm import filter_audit, fim, toxicity

SF = "/root/testdata/sf0.001"
TYPES = "doc_id bigint, text string, source string, n int, part string, mask int, id int, toxic int"


def documents(spark, *rows):
    """Rows (id, text, source) among columns whose names clash with those of results and of steps between."""
    return spark.createDataFrame([(i, t, s, 7, "x", 3, 5, 1) for i, t, s in rows], TYPES)


EDGES = [(1, None, "a"), (2, "", None), (None, "one <P> two", ""), (3, "one two", "a"), (3, "one two", "a"), (4, "é" * 300_000 + "x", "b"), (5, "word 中 " * 20_000, "b"), (6, "<", "c"), (7, "a<S>b", "c")]


def by_id(df):
    return sorted(map(tuple, df.collect()), key=str)


# fill-in-the-middle


def plain_transform(doc_id, text):
    """The contract, by a regular expression over code points."""
    units = re.findall(r"[A-Za-z]+|[^A-Za-z]", text)
    digest = hashlib.sha256(f"1:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h1, h2, h3, h4 = (int(digest[i : i + 8], 16) for i in (0, 8, 16, 24))
    n = len(units)
    a, b = sorted((h1 % (n + 1), h2 % (n + 1)))
    p, m, s = "".join(units[:a]), "".join(units[a:b]), "".join(units[b:])
    if not text or any(x in text for x in ("<P>", "<S>", "<M>")) or h3 % 100 >= 90:
        return n, "plain", None, None, text
    if h4 % 100 < 20:
        return n, "spm", len(p), len(m), f"<S>{s}<P>{p}<M>{m}"
    return n, "psm", len(p), len(m), f"<P>{p}<S>{s}<M>{m}"


def test_fill_in_middle_equals_the_definition(monkeypatch):
    rng = random.Random(5)
    texts = ["".join(rng.choice(["ab", "Z", "é", "中", "😀", " ", "<", "<S", ">", "P>", "\x00", "\n", "9"]) for _ in range(rng.randint(0, 60))) for _ in range(1500)]
    for slice_bytes in (1 << 20, 5, 1):
        monkeypatch.setattr(fim, "SLICE", slice_bytes)
        forms = set()
        for i, text in enumerate(texts):
            n, form, prefix, middle, output = fim.transform(text.encode(), fim.hashes(i, 1))
            assert (n, form, prefix, middle, output.decode()) == plain_transform(i, text)
            assert fim.restore(output, form) == text.encode()
            forms.add(form)
        assert forms == {"plain", "psm", "spm"}


def test_byte_index_converts_both_ways(monkeypatch):
    text = "aé中😀 b" * 40 + "plain" * 30
    raw = text.encode()
    for slice_bytes in (1 << 20, 7):
        monkeypatch.setattr(fim, "SLICE", slice_bytes)
        index = fim.ByteIndex(raw)
        assert len(index.byte_at) == 120 and index.n_chars == len(text)
        for c in range(len(text) + 1):
            b = len(text[:c].encode())
            assert index.chars(b) == c and index.bytes(c) == b


def test_fill_in_middle_edge_cases(spark):
    got = by_id(fim.fill_in_middle(documents(spark, *EDGES)).drop("output"))
    want = []
    for i, text, _ in EDGES:
        n, form, p, m, output = plain_transform(i, text or "")
        want.append((i, n, form, p, m, hashlib.sha256(output.encode()).hexdigest(), hashlib.sha256((text or "").encode()).hexdigest()))
    assert got == sorted(want, key=str)
    outputs = fim.fill_in_middle(documents(spark, *EDGES)).select("doc_id", "output").collect()
    assert sorted(map(tuple, outputs), key=str) == sorted(((i, plain_transform(i, t or "")[4]) for i, t, _ in EDGES), key=str)
    assert fim.fill_in_middle(documents(spark, *EDGES).where("false")).count() == 0


# filter audit


def brute_audit(rows, labels):
    """Every order applied filter by filter, document by document; rows (id, text, part)."""
    texts = [(i, t or "", p or "") for i, t, p in rows]
    good = {i for i, q, _ in labels if q == 1 and i is not None}
    toxic = {i for i, _, x in labels if x == 1 and i is not None}

    def fails(i, t):
        w = re.findall(r"[^\x20\x09-\x0D]+", t)
        own = "A" * (len(w) < 50) + "B" * (100 * len(set(w)) < 65 * len(w)) + "C" * (100 * len(re.findall("[A-Z]", t)) > 5 * len(t)) + "D" * bool(re.search(r"[#$%&*|]", t))
        return own + "E" * any(t == u and i is not None and j is not None and j < i for j, u, _ in texts)

    out = []
    for part in {p for _, _, p in texts}:
        docs = [(i, fails(i, t)) for i, t, p in texts if p == part]
        found, shares = [], dict.fromkeys("ABCDE", 0)
        for order in itertools.permutations("ABCDE"):
            left = docs
            for step, f in enumerate(order, start=1):
                gone = [d for d in left if f in d[1]]
                left = [d for d in left if f not in d[1]]
                redundant = sum(f in d[1] for d in docs) - len(gone)
                found.append([part, "".join(order), step, len(left), len(gone), redundant, sum(d[1] == f for d in docs), sum(d[0] in good for d in gone), sum(d[0] in toxic for d in gone)])
                shares[f] += len(gone)
        out += [(*row, shares[row[1][row[2] - 1]]) for row in found]
    return sorted(out)


def test_filter_audit_equals_brute_force(spark):
    rng = random.Random(8)
    some = ["word", "Word", "WORD", "a", "b", "c", "#", "x|y", "é", "\x0b", " "]
    rows = [(i, " ".join(rng.choice(some[: rng.choice((3, 6, 11))]) for _ in range(rng.choice((3, 30, 80)))), rng.choice(("p", "q", None, ""))) for i in range(90)]
    rows += [(i + 100, rows[rng.randint(0, 89)][1], "q") for i in range(40)] + [(i + 200, " ".join(f"w{k}" for k in range(60)), "r") for i in range(4)]
    rows += [(None, rows[0][1], "p"), (3, rows[3][1], rows[3][2]), (300, None, "p"), (301, "", "p"), (299, None, "s")]
    labels = [(i, rng.choice((0, 1, None)), rng.choice((0, 1, None))) for i in range(150)] + [(5, 1, 1), (5, 0, 0), (None, 1, 1)]
    table = spark.createDataFrame(labels, "doc_id bigint, quality int, toxic int")
    got = filter_audit.audit(documents(spark, *rows), table)
    assert got.columns == ["part", "filter_order", "step", "kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley"]
    assert sorted(map(tuple, got.collect())) == brute_audit(rows, labels)


def test_survivors_of_all_subsets():
    cells = np.random.default_rng(1).integers(0, 9, (32, 2))
    left = filter_audit.survivors(cells)
    for subset in range(32):
        assert (left[subset] == sum((cells[m] for m in range(32) if not m & subset), np.zeros(2))).all()


def test_filter_audit_edge_cases(spark):
    labels = spark.createDataFrame([], "doc_id bigint, quality int, toxic int")
    got = filter_audit.audit(documents(spark, *EDGES), labels)
    assert sorted(map(tuple, got.collect())) == brute_audit(EDGES, [])
    assert filter_audit.audit(documents(spark, *EDGES).where("false"), labels).count() == 0


# toxicity


def all_readings(token, i=0):
    """Every path through the lattice from place ``i``: (what is written, the channel's value)."""
    if i == len(token):
        return [("", 0.0)]
    return [(written + rest, cost + more) for to, written, cost in toxicity.arcs(token, i) for rest, more in all_readings(token, to)]


def value_of(written, model):
    """The letters' value of a reading, word by word."""
    total = 0.0
    for word in written.split():
        s = [0, 0, *(int(toxicity.SYMBOLS[ord(x)]) for x in word), 0]
        total += sum(model[s[k] * 4096 + s[k + 1] * 64 + s[k + 2]] for k in range(len(s) - 2))
    return total


def test_decoder_finds_the_best_path():
    rng = random.Random(2)
    model = toxicity.letter_model(np.random.default_rng(3).integers(0, 50, 64**3).astype(float))
    decoder = toxicity.Decoder(model)
    for _ in range(300):
        token = "".join(rng.choice("abss1!0$$. -9") for _ in range(rng.randint(1, 7)))
        best = max(cost + value_of(written, model) for written, cost in all_readings(token))
        read = decoder.best(token)
        same = max(cost for written, cost in all_readings(token) if written.split() == read.split())
        assert same + value_of(read, model) == pytest.approx(best, abs=1e-9)


def test_letter_counts_equal_a_plain_count(spark):
    texts = ["Ab ab. c", None, "", "éß中 x1y", "  zz  "]
    got = toxicity.letter_counts(spark.createDataFrame([(t,) for t in texts], "text string"))
    want = np.zeros(64**3)
    for text in texts:
        for word in re.findall(r"[^\W\d_]+", (text or "").lower()):
            s = [0, 0, *(int(toxicity.SYMBOLS[ord(x)]) for x in word), 0]
            for k in range(len(s) - 2):
                want[s[k] * 4096 + s[k + 1] * 64 + s[k + 2]] += 1
    assert (got == want).all()


def test_pieces_keep_tokens_and_spaced_words_whole():
    text = "some words i d i o t and more " * 200 + "x" * 500 + " tail"
    for size in (1, 7, 50):
        parts = list(toxicity.pieces(text, size))
        assert "".join(parts) == text and len(parts) > 5
        whole = text.split()
        assert [t for p in parts for t in p.split()] == whole
        assert [r for p in parts for r in toxicity.spaced_runs(p.split())] == toxicity.spaced_runs(whole)


BAD = ["idiot", "moron", "worthless", "scum"]
FORMS = ["1d10t", "m0r0n", "w0rthl3ss", "s c u m", "stay i d i o t", "mooooron", "!diot", "i.d.i.o.t", "$cum"]


def toxic_corpus(n=600):
    rng = random.Random(6)
    syllables = ["an", "the", "re", "on", "ti", "st", "er", "wo", "mi", "lo"]
    word = lambda: "".join(rng.choice(syllables) for _ in range(rng.randint(1, 3)))
    rows, labels = [], []
    for i in range(n):
        words = [word() for _ in range(40)]
        if i % 5 == 0:
            words[rng.randint(0, 39)] = rng.choice(BAD)
            words[rng.randint(0, 39)] = rng.choice(BAD)
        rows.append((i, " ".join(words), "s"))
        labels.append((i, int(i % 5 == 0)))
    planted = {n + k: " ".join([*(word() for _ in range(20)), x, *(word() for _ in range(20))]) for k, x in enumerate(FORMS)}
    clean = {n + 100 + k: " ".join(word() for _ in range(40)) + " 2024-01-02 a$$$ 10.5% st@rt" for k in range(30)}
    return rows + [(i, t, "s") for i, t in {**planted, **clean}.items()], labels, planted, clean


def test_toxicity_restores_disguised_words(spark):
    rows, labels, planted, clean = toxic_corpus()
    table = spark.createDataFrame(labels, "doc_id bigint, toxic int")
    got = {r.doc_id: r for r in toxicity.scores(documents(spark, *rows), table).collect()}
    truth = dict(labels)
    held = [i for i in truth if got[i].held_out]
    assert {i for i in truth if got[i].held_out} == {i for i in truth if zlib.crc32(str(i).encode()) % 4 == 2}
    assert sum(got[i].predicted for i in held if truth[i]) / sum(truth[i] for i in held) > 0.95
    assert not any(got[i].predicted for i in held if not truth[i])
    assert sum(got[i].predicted for i in planted) >= len(planted) - 1
    assert not any(got[i].predicted for i in clean)
    assert all(r.predicted == (r.score >= 0.3) and 0 <= r.score <= 1 for r in got.values())


def test_toxicity_never_reads_held_out_labels_or_other_columns(spark):
    rows, labels, *_ = toxic_corpus(200)
    flipped = [(i, 1 - x if zlib.crc32(str(i).encode()) % 4 == 2 else x) for i, x in labels]
    run = lambda own, docs: by_id(toxicity.scores(docs, spark.createDataFrame(own, "doc_id bigint, toxic int")).select("doc_id", F.round("score", 9)))
    docs = documents(spark, *rows)
    assert run(labels, docs) == run(flipped, docs) == run(labels, docs.withColumn("source", F.lit("z")))


def test_toxicity_edge_cases(spark):
    docs = documents(spark, *EDGES)
    none = spark.createDataFrame([], "doc_id bigint, toxic int")
    got = toxicity.scores(docs, none).collect()
    assert len(got) == len(EDGES) and all(r.score < 1e-9 and r.predicted == 0 for r in got)
    assert toxicity.scores(docs.where("false"), none).count() == 0
    one = spark.createDataFrame([(1, 0), (3, 0), (3, None), (None, 1)], "doc_id bigint, toxic int")
    assert all(r.predicted == 0 for r in toxicity.scores(docs, one).collect())
    both = spark.createDataFrame([(1, 0), (3, 1), (4, 1), (5, 0), (6, 1), (7, 0)], "doc_id bigint, toxic int")
    got = toxicity.scores(docs, both).collect()
    assert len(got) == len(EDGES) and {r.score for r in got if r.doc_id == 3} and [r.held_out for r in got if r.doc_id is None] == [False]


@pytest.mark.parametrize("token", ["#" * 50_000 + "a" + "$" * 50_000, "1a" * 20_000, "a." * 20_000, "!" * 30_000])
def test_long_odd_tokens_are_read_whole(token):
    reader = toxicity.Reader(toxicity.letter_model(np.ones(64**3)))
    assert isinstance(reader.features(token), tuple)
