"""Tokenizers, fingerprints, repeats and contamination against brute force; the stated edge cases."""

import hashlib
import random
import re
import unicodedata

import numpy as np
import public_tokenizers
import pytest
import xxhash
from tokenizers import Tokenizer

from hourgrain.llm import bpe, decontaminate, kmers, simhash, substring, suffix
from hourgrain.llm.common import table
from hourgrain.llm.token_counts import LATE_CAPITALS, Counts, alone, lowered, token_counts

SF = "/root/testdata/sf0.001"
DOCS = "doc_id bigint, text string, n_tokens int, fingerprint string, id int"
ODD = ["a", "B", "é", "É", "ß", "İ", "Σ", "ς", "́", "ﬁ", " ", "\n", "\t", "\xa0", "　", "\x0b", "\x85", "1", "²", "½", "'s", "'LL", "’", "!", "<|endoftext|>", "<|startoftext|>", "<|", "中", "😀", "\x00", "ſ", "don't"]


@pytest.fixture(scope="module")
def texts():
    rng = random.Random(4)
    return ["".join(rng.choice(ODD) for _ in range(rng.randint(0, 40))) for _ in range(1500)] + ["x" * 20000, "ab" * 9000, "the cat " * 3000]


def documents(spark, *rows):
    """Rows (id, text) among columns whose names clash with those of results."""
    return spark.createDataFrame([(i, t, 7, "x", 3) for i, t in rows], DOCS)


EDGES = [(1, None), (2, ""), (None, "one two three four"), (3, "one two three four"), (3, "one two three four"), (4, "y" * 300_000), (5, "word " * 20_000)]


def by_id(df):
    return sorted(map(tuple, df.collect()), key=str)


def test_token_counts_equal_the_library(texts):
    path = public_tokenizers.path("word_bpe_49k.json")
    vocabulary = bpe.Vocabulary(path)
    certain = alone(vocabulary)
    counts = Counts(vocabulary, certain)
    library = Tokenizer.from_file(path)
    assert [counts.count(t) for t in texts] == [len(e.ids) for e in library.encode_batch(texts, add_special_tokens=False)]
    assert len(certain) > 30_000 and all(len(library.encode(w, add_special_tokens=False).ids) == 1 for w in list(counts.certain)[:500] if w == w.lower().strip())


def test_capitals_of_all_planes_equal_the_library():
    path = public_tokenizers.path("word_bpe_49k.json")
    library = Tokenizer.from_file(path)
    vocabulary = bpe.Vocabulary(path)
    counts = Counts(vocabulary, alone(vocabulary))
    letters = [c for c in map(chr, range(0x80, 0x20000)) if not 0xD800 <= ord(c) < 0xE000 and not c.isspace() and c == unicodedata.normalize("NFC", c)]
    assert lowered("".join(f"1{c}" for c in letters)) == "".join(library.normalizer.normalize_str("1" + c) for c in letters)
    late = [f"a{c}b {c}{c} {c}1" for c in map(chr, LATE_CAPITALS)]
    assert [counts.count(t) for t in late] == [len(e.ids) for e in library.encode_batch(late, add_special_tokens=False)]


def test_ids_and_decoding_equal_the_library(texts):
    path = public_tokenizers.path("byte_bpe_50k.json")
    own, library = bpe.ByteBPE(bpe.Vocabulary(path)), Tokenizer.from_file(path)
    for text in texts:
        ids = np.frombuffer(own.encode(text), "<u4").tolist()
        assert ids == library.encode(text, add_special_tokens=False).ids
        assert own.decode(own.encode(text)) == library.decode(ids, skip_special_tokens=False)
    assert own.decode(np.array([0, 5, 50000, 220, 33, 1020], "<u4").tobytes()) == library.decode([0, 5, 50000, 220, 33, 1020], skip_special_tokens=False)


def test_encoders_edge_cases(spark):
    docs = documents(spark, *EDGES)
    rows = by_id(token_counts(docs, public_tokenizers.path("word_bpe_49k.json")))
    assert len(rows) == len(EDGES) and (1, 0, 0, False) in rows and rows.count((3, 18, 4, False)) == 2
    out = bpe.encode(docs, public_tokenizers.path("byte_bpe_50k.json")).collect()
    texts = {r["doc_id"]: r for r in out}
    assert len(out) == len(EDGES) and texts[1]["n_tokens"] == 0 and texts[1]["ids"] == []
    assert all(texts[i]["decoded"] == t for i, t in EDGES if t)
    assert token_counts(docs.limit(0), public_tokenizers.path("word_bpe_49k.json")).count() == 0
    assert bpe.encode(docs.limit(0), public_tokenizers.path("byte_bpe_50k.json")).count() == 0


def brute_fingerprint(text):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    words = re.findall(r"[^\x20\x09-\x0D]+", low)
    if not words:
        return 0
    grams = [" ".join(words[i : i + 3]) for i in range(len(words) - 2)] or [" ".join(words)]
    hashes = [xxhash.xxh64_intdigest(g.encode(), 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def groups(ids, linked):
    """Smallest member of each id's component."""
    root = {i: i for i in ids}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in linked:
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    return {i: find(i) for i in ids}


def test_simhash_equals_brute_force(spark):
    docs = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    rng = random.Random(1)
    docs += [(10_000 + n, t[: rng.randint(0, len(t))] + "!") for n, (_, t) in enumerate(docs[:60])]
    prints = {i: brute_fingerprint(t) for i, t in docs}
    want = groups(list(prints), [(a, b) for a in prints for b in prints if a < b and (prints[a] ^ prints[b]).bit_count() <= 2])
    got = {r["doc_id"]: (r["fingerprint"], r["component_id"]) for r in simhash.near_duplicates(documents(spark, *docs)).collect()}
    assert got == {i: (f"{prints[i]:016x}", want[i]) for i in prints}
    assert len(set(want.values())) < len(want)


def test_simhash_links_chains_and_edges(spark):
    chain = [(i, p) for i, p in zip((9, 4, 7, 1, 5), (0, 3, 15, 63, 0xFF00))]
    links = simhash.links(spark.createDataFrame(chain, "id bigint, fp bigint"), 1).collect()
    assert groups([i for i, _ in chain], [(r["a"], r["b"]) for r in links]) == {9: 1, 4: 1, 7: 1, 1: 1, 5: 5}
    rows = by_id(simhash.near_duplicates(documents(spark, *EDGES)))
    assert len(rows) == len(EDGES) and (1, "0" * 16, 1) in rows and (2, "0" * 16, 1) in rows
    assert [r[2] for r in rows if r[0] in (None, 3)] == [3, 3, 3]
    assert simhash.near_duplicates(documents(spark, *EDGES).limit(0)).count() == 0


def brute_words(docs, window):
    cut = {i: re.findall(r"[^\x20\x09-\x0D]+", t or "") for i, t in docs}
    starts = {}
    for i, words in cut.items():
        for s in range(len(words) - window + 1):
            starts.setdefault(tuple(words[s : s + window]), []).append((i, s))
    gone = {i: set() for i in cut}
    for places in starts.values():
        for i, s in places if len(places) > 1 else ():
            gone[i].update(range(s, s + window))
    return {i: (len(w), len(gone[i]), hashlib.sha256(" ".join(x for n, x in enumerate(w) if n not in gone[i]).encode()).hexdigest()) for i, w in cut.items()}


@pytest.mark.parametrize("seed", [0, 1])
def test_repeated_windows_equal_brute_force(spark, seed):
    rng = random.Random(seed)
    parts = [" ".join(rng.choice("a b c dd ee the of in\tx é".split(" ")) for _ in range(rng.randint(1, 40))) for _ in range(8)] + ["z " * 60]
    docs = [(i, " ".join(rng.choice(parts) for _ in range(rng.randint(0, 5)))) for i in range(60)] + [(100, None), (101, "")]
    got = {r["doc_id"]: (r["n_words"], r["n_removed"], r["kept_sha256"]) for r in substring.remove_repeats(documents(spark, *docs), window=12, gram=4).collect()}
    assert got == brute_words(docs, 12)


def test_repeated_windows_edges(spark):
    rows = by_id(substring.remove_repeats(documents(spark, *EDGES), window=3, gram=2))
    assert len(rows) == len(EDGES)
    assert [r[1:3] for r in rows if r[0] == 3] == [(4, 4), (4, 4)]
    assert [r[1:3] for r in rows if r[0] == 5] == [(20_000, 20_000)]
    assert [r[1:3] for r in by_id(substring.remove_repeats(documents(spark, EDGES[3], EDGES[4]), window=3, gram=2))] == [(4, 4), (4, 4)]
    assert [r[1:3] for r in by_id(substring.remove_repeats(documents(spark, EDGES[3], EDGES[4]), window=5, gram=2))] == [(4, 0), (4, 0)]
    mixed = documents(spark, (7, "a b c"), (7, "a b c"), (7, "d e f g"), (None, "x y z"), (None, "x y z"), (None, "u v w"), (8, "b c"))
    assert sorted((r["text"] or "", r["n_removed"]) for r in substring.remove_repeats(mixed, window=3, gram=2).withColumnRenamed("kept_text", "text").collect()) == [
        ("", 3), ("", 3), ("", 3), ("", 3), ("b c", 0), ("d e f g", 0), ("u v w", 0)]
    assert substring.remove_repeats(documents(spark, *EDGES).limit(0)).count() == 0


def test_window_classes_survive_hash_collisions(monkeypatch):
    w = np.array([1, 2, 3, 1, 2, 4, 1, 2, 3], dtype=np.int32)
    monkeypatch.setattr(kmers, "grams", lambda h, m: np.zeros(len(h) - m + 1, dtype=np.uint64))
    classes = substring.window_classes(w, np.array([0, 3, 6]), 3)
    assert classes[0] == classes[2] != classes[1]


def test_suffix_array():
    rng = random.Random(2)
    for _ in range(400):
        s = [rng.randint(1, rng.choice([1, 2, 4])) for _ in range(rng.randint(0, 40))] + [0]
        assert suffix.suffix_array(np.array(s)).tolist() == sorted(range(len(s)), key=lambda i: s[i:])


def brute_bytes(docs, window):
    seen, out = set(), {}
    for i, t in sorted(docs, key=lambda d: d[0]):
        raw = (t or "").encode()
        gone = bytearray(len(raw))
        for s in range(len(raw) - window + 1):
            if raw[s : s + window] in seen:
                gone[s : s + window] = b"\1" * window
            seen.add(raw[s : s + window])
        kept = bytes(b for b, g in zip(raw, gone) if not g)
        out[i] = (len(raw), sum(gone), len(re.findall(b"\1+", bytes(gone))), hashlib.sha256(kept).hexdigest())
    return out


@pytest.mark.parametrize("chunk", [300, 4 << 20])
def test_earlier_bytes_equal_brute_force(spark, chunk, monkeypatch):
    monkeypatch.setattr(suffix, "CHUNK_BYTES", chunk)
    rng = random.Random(chunk)
    words = ["the", "tion", "of", "a", "ing!", "été", "  ", "\n", "z" * 30, "q."]
    parts = [" ".join(rng.choice(words) for _ in range(rng.randint(0, 60))) for _ in range(6)] + ["ab" * 150, "x" * 250]
    docs = [(i, "".join(rng.choice(parts)[rng.randint(0, 30) : rng.randint(30, 400)] for _ in range(rng.randint(0, 4)))) for i in range(50)] + [(100, None), (101, "")]
    got = {r["doc_id"]: (r["n_bytes"], r["n_removed"], r["n_spans"], r["kept_sha256"]) for r in suffix.remove_earlier(documents(spark, *docs), window=60).collect()}
    assert got == brute_bytes(docs, 60)


def test_earlier_bytes_edges(spark):
    text = "one two three four " * 3 + "é" * 30
    docs = documents(spark, (2, text), (1, text), (None, text), (2, text), (3, None))
    rows = by_id(suffix.remove_earlier(docs, window=40, carry=["n_tokens", "fingerprint"]))
    whole = len(text.encode())
    assert {(r[0], r[1], r[2]) for r in rows if r[0] != 1} == {(None, whole, whole), (2, whole, whole), (3, 0, 0)}
    assert all(r[-2:] == (7, "x") for r in rows) and len(rows) == 5
    assert suffix.remove_earlier(docs.limit(0)).count() == 0
    long = suffix.remove_earlier(documents(spark, *EDGES)).collect()
    assert {r["doc_id"]: r["n_removed"] for r in long}[4] == 300_000 - 1


ITEMS = [(1, "If Anna drives 60 miles in 2 hours then how many miles does Anna drive in 5 hours without a stop?"), (2, "short item"), (3, None), (1, "If Anna drives 60 miles in 2 hours then how many miles does Anna drive in 5 hours without a stop?")]


def test_contamination(spark):
    benchmark = spark.createDataFrame([(i, t, 0) for i, t in ITEMS], "item_id bigint, text string, doc_id int")
    docs = documents(
        spark, (10, "Noise first. If Anna drives 60 miles in 2 hours then how many miles does Anna drive in 5 hours without a stop? Noise last."),
        (11, "Well. If Bob drives 90 miles in 3 hours then how many miles does Bob drive in 7 hours without a stop?"),
        (12, "Well. If Bob drives 90 miles in 3 hours then how many miles does Carl drive in 7 hours without a stop?"),
        (13, "A clean text about nothing that the benchmark asks for, with 60 miles and 2 hours in it."), (14, None), (15, ""), (None, "if anna drives 60 miles in 2 hours then how many miles does anna drive"),
        (16, "5 km 5 km 5 km 5 km 5 km 5 km 5 km 5 km"),
    )
    rows = {r["doc_id"]: r for r in decontaminate.matches(docs, benchmark).collect()}
    assert set(rows) == {10, 11, None} and not rows[10]["reparameterised"] and rows[11]["reparameterised"]
    assert rows[10]["first_word"] == 7 and rows[10]["item_id"] == 1
    assert decontaminate.matches(docs.limit(0), benchmark).count() == 0 and decontaminate.matches(docs, benchmark.limit(0)).count() == 0


NAMES_ITEM = "Marie Curie, Pierre Curie and Henri Becquerel shared the Nobel Prize in Physics in 1903"
PLAIN_ITEM = "the slow river carries brown leaves past the old mill and under a stone bridge"


def contaminated(spark, items, docs):
    benchmark = spark.createDataFrame(list(enumerate(items)), "item_id bigint, text string")
    return {(r["doc_id"], r["item_id"]): r for r in decontaminate.matches(documents(spark, *docs), benchmark).collect()}


def test_contamination_by_verbatim_copies(spark):
    docs = [(1, "Look here: " + PLAIN_ITEM.title()), (2, "look " + PLAIN_ITEM.upper()), (3, "So it was that " + NAMES_ITEM + " at last."), (4, "and " + NAMES_ITEM.upper()), (5, "a river and an old mill")]
    rows = contaminated(spark, [PLAIN_ITEM, NAMES_ITEM], docs)
    assert set(rows) == {(1, 0), (2, 0), (3, 1), (4, 1)} and not any(r["reparameterised"] for r in rows.values())
    assert rows[1, 0]["n_windows"] == 8 and rows[1, 0]["first_word"] == 2


def test_contamination_by_other_names_and_number_words(spark):
    marbles = "Anna has 12 red marbles. Ben has 7 blue marbles. Anna gives Ben 3 marbles."
    stairs = "count all the sixteen wooden stairs that lead below"
    eight = "Anna walks along the quiet river every morning"
    rank = "who came in at the second place of that long race"
    docs = [
        (1, "Carl has 40 red marbles. Dora has 9 blue marbles. Carl gives Dora 5 marbles."), (2, "now count all the seventeen wooden stairs that lead below"),
        (3, "Question: Anna walks along the quiet river every morning"), (4, "Question: Dora walks along the quiet river every morning"),
        (5, "who came in at the third place of that long race"), (6, "now count all the twenty-one wooden stairs that lead below"),
        (7, "Carl has 40 red marbles. Dora has 9 blue marbles. Dora gives Dora 5 marbles."),
    ]
    rows = contaminated(spark, [marbles, stairs, eight, rank], docs)
    assert set(rows) >= {(1, 0), (2, 1), (3, 2), (4, 2), (5, 3), (6, 1)}
    assert rows[1, 0]["reparameterised"] and not rows[3, 2]["reparameterised"]


def test_spans_are_stored_before_the_chunks_meet_them(spark):
    table(spark, SF, "documents")
    assert spark.conf.get("spark.sql.classic.shuffleDependency.fileCleanup.enabled") == "true"
    text = "one string of some length that is written here twice, without any other sign of life. " * 4
    out = suffix.remove_earlier(documents(spark, (1, text), (2, text)))
    assert any("suffix-spans" in f for f in out.inputFiles()) and {r["doc_id"]: r["n_removed"] for r in out.collect()}[2] == len(text)


@pytest.mark.parametrize("block", [7, 64, 1 << 14])
def test_minimisers_do_not_depend_on_blocks(block, monkeypatch):
    """Found block by block: each window's leftmost least gram, as if all grams were hashed at once."""
    monkeypatch.setattr(kmers, "BLOCK", block)
    h = kmers.mixed(np.random.default_rng(3).integers(0, 4, 500).astype(np.uint64))
    for k, m in ((100, 40), (35, 12), (9, 9), (500, 1)):
        gram, least = kmers.minimisers(h, k, m)
        r = 0x9E3779B97F4A7C15
        plain = kmers.mixed(np.array([sum(int(x) * pow(r, m - 1 - j, 1 << 64) for j, x in enumerate(h[i : i + m])) % (1 << 64) for i in range(len(h) - m + 1)], dtype=np.uint64))
        assert (gram == plain).all()
        assert least.tolist() == [i + int(np.argmin(plain[i : i + k - m + 1] >> kmers.PLACE_BITS)) for i in range(len(h) - k + 1)]


def test_strings_without_repeated_windows_need_no_suffix_array(monkeypatch):
    """Strings may share a minimiser and yet no window; only those with a window that occurs twice are sorted."""
    rng = np.random.default_rng(5)
    raw = lambda n: rng.integers(97, 123, n, dtype=np.uint8).tobytes()
    shared, longer = raw(60), raw(130)
    strings = [raw(90) + shared + raw(20), raw(20) + shared + raw(90), longer + raw(30), raw(40) + longer]
    assert suffix.with_repeats(b"".join(strings), np.array([len(s) - 99 for s in strings]), 100).tolist() == [False, False, True, True]
    sorted_texts, plain = [], suffix.window_classes
    monkeypatch.setattr(suffix, "window_classes", lambda text, *rest: sorted_texts.append(text.tobytes()) or plain(text, *rest))
    ends = np.cumsum([len(s) for s in strings])
    n = np.arange(4)
    columns = {"id": n, "chunk": n, "row": n, "start": n * 0, "count": np.array([len(s) - 99 for s in strings], dtype=np.int32), "key": np.ones(4, dtype=np.uint64), "from": ends - [len(s) for s in strings], "to": ends}
    spans = suffix.later(columns, b"".join(strings), 100).to_pylist()
    assert sorted_texts == [strings[2] + strings[3]] and spans == [{"chunk": 3, "row": 3, "start": 40, "end": 170}]


def test_texts_without_pairs_of_an_item_are_left_out(spark, monkeypatch):
    """The texts that pass hold every match, by name, number, capital or copy; the result is that of all texts."""
    item = "A cyclist from Norwich slowly covers about sixty miles against strong wind."
    texts = ["The cyclist from Exeter slowly covers about seventy miles against strong wind", item.upper(), "wind strong against miles sixty about covers slowly norwich from cyclist a", "the wind in the miles against some of strong weather and of the rest", None, ""]
    docs, items = documents(spark, *enumerate(texts)), spark.createDataFrame([(7, item)], "item_id bigint, text string")
    seen, plain = [], decontaminate.promising
    monkeypatch.setattr(decontaminate, "promising", lambda *a: seen.append(sorted(r["id"] for r in plain(*a).collect())) or plain(*a))
    found = sorted(decontaminate.matches(docs, items).collect())
    monkeypatch.setattr(decontaminate, "LISTED", 0)
    assert sorted(decontaminate.matches(docs, items).collect()) == found and {r["doc_id"] for r in found} == {0, 1}
    assert seen == [[0, 1], list(range(6))]
