"""Quality classifier: perplexity under an interpolated modified Kneser-Ney trigram model of trusted text.

The trusted documents are halved by a hash of their id. The model is counted over all documents of the first half, or, if
``sample_docs`` is given, over at most so many of them (those of least hash). A batch of texts sends its distinct trigrams packed to the bucket of
their middle word, which has all that its contexts, pairs and back-offs are counted from; words meet the buckets by a join. The trigrams of
middle words with more than ``HOT`` places are counted by sharded group-bys and joins of count tables instead, so that no bucket grows with one word.

A place (w1, w2, w3) costs the logarithms of its word, of the back-off of w2, of its pair, of the back-off of (w1, w2) and of its
trigram, each as the difference to what the shorter ones give, so that a document's score is a plain sum over the keys that the model has,
which is stored as (key, value). Counting is done in ``SLICES`` parts of the middle words and scoring in as many parts of the keys, one
after the other, so what is shuffled at a time is a part of the whole. A batch of texts sends its keys packed by bucket, in runs of one
text; in the bucket they are looked up among its part of the model, and each run's sum goes back to its text.

A document is accepted if its perplexity is at most its language's threshold: ``margin`` bits a word above the
``quantile`` of all documents of the second half in that language, which the model has not seen. Quantiles are exact on a grid of 1/1000 bit.

Defined results: a null or wordless text has no perplexity and is rejected; a null language is a language of its own; a
language without trusted documents takes the threshold of all trusted documents; with none at all, everything with words is
accepted (threshold null); rows that share an id are scored as one document, rows without id as one too; an empty table gives
an empty result; only the named columns are read.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import reduce
from math import log2

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from hourgrain.llm.common import cut_lineage, forget, hinted, row_batches, stored
from hourgrain.llm.kmers import bucket_count, mixed
from hourgrain.llm.suffix import BYTE_HASHES

#: Places before the first word and after the last one; words cannot contain a space.
BEGIN, END = (np.uint64(xxhash.xxh64_intdigest(x, 42)) for x in (b" <", b" >"))
GRID = 1000
#: Parts of the words, and of the keys, that are counted and scored one after the other.
SLICES = 4
BATCH_BYTES = 1 << 20
#: Text whose looked-up keys meet in one bucket, and the least number of buckets.
BUCKET_BYTES, BUCKETS = 32 << 20, 24
#: Trusted text whose trigrams meet in a bucket, for all parts; places from which on a middle word's trigrams are counted by joins instead.
GRAM_BYTES, HOT = 16 << 20, 500_000
#: Bytes that are hashed at a time; longer words than ``LONG`` bytes are hashed by themselves.
BLOCK, LONG = 1 << 16, 64
ODD = 0x9E3779B97F4A7C15
POWERS, BACK = (np.multiply.accumulate(np.array([1] + [x] * (BLOCK + LONG), dtype=np.uint64)) for x in (ODD, pow(ODD, -1, 1 << 64)))


def hashed(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
    """(hashes of the words of all texts, how many words each has); words are lower-cased and end at ASCII white space."""
    raw = [(text or "").lower().encode() for text in texts]
    joined = b"\n".join(raw)
    data = np.frombuffer(joined, dtype=np.uint8)
    inside = np.concatenate([[False], (data != 32) & ((data < 9) | (data > 13)), [False]])
    edges = np.flatnonzero(inside[1:] != inside[:-1])
    starts, ends = edges[::2], edges[1::2]
    out, at = np.empty(len(starts), dtype=np.uint64), 0
    while at < len(starts):
        low = int(starts[at])
        upto = int(np.searchsorted(starts, low + BLOCK))
        first, last = starts[at:upto] - low, np.minimum(ends[at:upto], starts[at:upto] + LONG) - low
        own = BYTE_HASHES[data[low : low + int(last[-1])]]
        sums = np.concatenate([np.zeros(1, dtype=np.uint64), np.cumsum(own * POWERS[: len(own)], dtype=np.uint64)])
        out[at:upto] = mixed((sums[last] - sums[first]) * BACK[first])
        at = upto
    for i in np.flatnonzero(ends - starts > LONG).tolist():
        out[i] = xxhash.xxh64_intdigest(joined[starts[i] : ends[i]], 42)
    stops = np.cumsum(np.array([len(x) + 1 for x in raw], dtype=np.int64))
    return out, np.diff(np.searchsorted(starts, stops), prepend=0)


def places(texts: list[str | None]) -> tuple[np.ndarray, ...]:
    """(row, first, prev, word) of every word of every text and of its end, as hashes."""
    words, counts = hashed(texts)
    row = np.repeat(np.arange(len(counts)), counts)
    flat = np.full(len(words) + 3 * len(counts), BEGIN, dtype=np.uint64)
    flat[np.arange(len(words)) + 3 * row + 2] = words
    ends = np.cumsum(counts + 3) - 1
    flat[ends] = END
    real = np.ones(len(flat), dtype=bool)
    starts = ends - counts - 2
    real[starts] = real[starts + 1] = False
    at = np.flatnonzero(real)
    return np.repeat(np.arange(len(counts)), counts + 1), flat[at - 2], flat[at - 1], flat[at]


def pair_keys(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return mixed(a * np.uint64(0x9E3779B97F4A7C15) + b)


def gram_keys(context: Column, pair: Column) -> Column:
    return F.shiftleft(context, 21).bitwiseOR(F.shiftrightunsigned(context, 43)).bitwiseXOR(pair)


def in_part(words: np.ndarray, part: int) -> np.ndarray:
    return words.view(np.int64) % SLICES == part


def frequent(texts: DataFrame) -> np.ndarray:
    """Sorted hashes of the middle words with more than ``HOT`` places, counted where they are a thousandth of a batch or more."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in row_batches(batches, "text", BATCH_BYTES):
            words, n = np.unique(places(batch.column("text").to_pylist())[2], return_counts=True)
            many = n * 1000 >= n.sum()
            yield pa.RecordBatch.from_arrays([pa.array(words[many].view(np.int64)), pa.array(n[many], pa.int64())], ["word", "n"])

    found = texts.select("text").mapInArrow(run, "word bigint, n bigint").groupBy("word").agg(F.sum("n").alias("n")).where(F.col("n") > HOT)
    return np.sort(np.array([r["word"] for r in found.collect()], dtype=np.int64).view(np.uint64))  # a thousand for each thousand batches at most


def among(words: np.ndarray, hot: np.ndarray) -> np.ndarray:
    return hot[np.minimum(np.searchsorted(hot, words), len(hot) - 1)] == words if len(hot) else np.zeros(len(words), dtype=bool)


def packed_grams(texts: DataFrame, part: int, buckets: int, hot: np.ndarray) -> DataFrame:
    """(bucket, grams): trigrams (first, prev, word, c) of a batch, those whose middle word is of that part and not ``hot``, by its bucket."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        forget()
        for batch in row_batches(batches, "text", BATCH_BYTES):
            _, first, prev, word = places(batch.column("text").to_pylist())
            own = in_part(prev, part)
            own[own] = ~among(prev[own], hot)
            first, prev, word = first[own], prev[own], word[own]
            _, at, c = np.unique(pair_keys(pair_keys(first, prev), word), return_index=True, return_counts=True)
            bucket = (prev[at] >> np.uint64(20)) % np.uint64(buckets)
            order = np.argsort(bucket, kind="stable")
            at, c, bucket = at[order], c[order].astype(np.uint64), bucket[order].astype(np.int64)
            cuts = np.flatnonzero(np.diff(bucket, prepend=-1))
            blobs = [np.stack([first[i], prev[i], word[i], n]).tobytes() for i, n in zip(np.split(at, cuts[1:]), np.split(c, cuts[1:]))] if len(at) else []
            yield pa.RecordBatch.from_arrays([pa.array(bucket[cuts], pa.int64()), pa.array(blobs, pa.binary())], ["bucket", "grams"])

    return texts.select("text").mapInArrow(run, "bucket bigint, grams binary")


class Counted:
    """The distinct trigrams of a bucket, sorted by pair, and their pairs, contexts and middle words; all of a middle word's are there."""

    def __init__(self, group: pa.Table):
        first, prev, word, c = np.concatenate([np.zeros((4, 0), dtype=np.uint64), *(np.frombuffer(x, dtype=np.uint64).reshape(4, -1) for x in group.column("grams").to_pylist())], axis=1)
        context, pair = pair_keys(first, prev), pair_keys(prev, word)
        order = np.lexsort((context, pair))
        context, pair, c = context[order], pair[order], c[order].astype(np.int64)
        fresh = np.ones(len(pair), dtype=bool)
        fresh[1:] = (pair[1:] != pair[:-1]) | (context[1:] != context[:-1])
        heads = np.flatnonzero(fresh)
        self.context, self.pair, self.c = context[heads], pair[heads], np.add.reduceat(c, heads) if len(heads) else c
        of_pair = np.ones(len(heads), dtype=bool)
        of_pair[1:] = self.pair[1:] != self.pair[:-1]
        self.pair_of, at = np.cumsum(of_pair) - 1, np.flatnonzero(of_pair)
        self.c2 = np.diff(at, append=len(heads))
        self.prev, self.word = prev[order][heads][at], word[order][heads][at]
        self.pairs = self.pair[at]


def grams(texts: DataFrame, part: int, hot: np.ndarray | None = None) -> DataFrame:
    """(context, pair, prev, word, c): the counted trigrams whose middle word is of that part, and among ``hot`` if given."""
    if hot is not None and not len(hot):
        texts = texts.where(F.lit(False))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        forget()
        for batch in row_batches(batches, "text", BATCH_BYTES):
            _, first, prev, word = places(batch.column("text").to_pylist())
            own = in_part(prev, part)
            if hot is not None:
                own &= among(prev, hot)
            first, prev, word = first[own], prev[own], word[own]
            columns = [pair_keys(first, prev), pair_keys(prev, word), prev, word]
            yield pa.RecordBatch.from_arrays([pa.array(x.view(np.int64)) for x in columns], ["context", "pair", "prev", "word"])

    rows = texts.select("text").mapInArrow(run, "context bigint, pair bigint, prev bigint, word bigint")
    return rows.groupBy("context", "pair", "prev", "word").agg(F.count("*").alias("c"))


def looked_up(texts: list[str | None], part: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, key, n): the keys of that part that every text looks up: trigrams, pairs, and its words once each, how often."""
    row, first, prev, word = places(texts)
    context, pair = pair_keys(first, prev), pair_keys(prev, word)
    gram = (context << np.uint64(21) | context >> np.uint64(43)) ^ pair
    last = np.flatnonzero(np.diff(row, append=-1))  # the end is a word too, and the pair before it no context
    start = np.flatnonzero(np.diff(row, prepend=-1))  # the first context is no pair
    words, owners = np.concatenate([prev, word[last]]), np.concatenate([row, row[last]])
    own = in_part(words, part)
    words, owners = words[own], owners[own]
    order = np.lexsort((words, owners))
    words, owners = words[order], owners[order]
    new = np.flatnonzero((np.diff(words.view(np.int64), prepend=0) != 0) | (np.diff(owners, prepend=-1) != 0))
    singles, rows = np.concatenate([gram, pair, context[start]]), np.concatenate([row, row, row[start]])
    own = in_part(singles, part)
    n = np.concatenate([np.ones(own.sum(), dtype=np.int64), np.diff(new, append=len(words))])
    return np.concatenate([rows[own], owners[new]]), np.concatenate([singles[own], words[new]]), n


def asked(docs: DataFrame, part: int, buckets: int) -> DataFrame:
    """(bucket, ids, sizes, keys, n): what the rows (id, text) of a batch look up in a bucket of that part, ``sizes`` keys for each id."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        forget()
        for batch in row_batches(batches, "text", BATCH_BYTES):
            row, key, n = looked_up(batch.column("text").to_pylist(), part)
            if not len(row):
                continue
            group = (key >> np.uint64(20)) % np.uint64(buckets) * np.uint64(batch.num_rows) + row.astype(np.uint64)
            order = np.argsort(group, kind="stable")
            group, key, n = group[order].astype(np.int64), key[order], n[order].astype(np.int32)
            heads = np.flatnonzero(np.diff(group, prepend=-1))
            sizes = np.diff(heads, append=len(group)).astype(np.int32)
            bucket, owner = np.divmod(group[heads], batch.num_rows)
            ids = batch.column("id").take(pa.array(owner))
            cuts = np.flatnonzero(np.diff(bucket, prepend=-1))
            to = np.append(cuts[1:], len(heads))
            at, end = heads[cuts].tolist(), np.append(heads[cuts[1:]], len(group)).tolist()
            columns = [
                pa.array(bucket[cuts], pa.int64()), pa.ListArray.from_arrays(pa.array(np.append(cuts, len(heads)), pa.int32()), ids),
                pa.array([sizes[a:b].tobytes() for a, b in zip(cuts.tolist(), to.tolist())], pa.binary()),
                pa.array([key[a:b].tobytes() for a, b in zip(at, end)], pa.binary()), pa.array([n[a:b].tobytes() for a, b in zip(at, end)], pa.binary()),
            ]
            yield pa.RecordBatch.from_arrays(columns, ["bucket", "ids", "sizes", "keys", "n"])

    return docs.select("id", "text").mapInArrow(run, "bucket bigint, ids array<bigint>, sizes binary, keys binary, n binary")


def opened(group: pa.Table) -> Iterator[tuple[pa.Array, np.ndarray, np.ndarray, np.ndarray]]:
    """(id of each run of keys, keys of each run, keys, n) of each row of ``asked``."""
    for batch in group.to_batches():
        for i in range(batch.num_rows):
            sizes, key, n = (np.frombuffer(batch.column(c)[i].as_buffer(), dtype=kind) for c, kind in (("sizes", np.int32), ("keys", np.int64), ("n", np.int32)))
            yield batch.column("ids")[i].values, sizes, key, n


def keys(docs: DataFrame, part: int, buckets: int = BUCKETS) -> DataFrame:
    """(id, key, n): rows of ``asked`` opened."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for ids, sizes, key, n in opened(pa.Table.from_batches([batch])):
                owners = ids.take(pa.array(np.repeat(np.arange(len(sizes)), sizes)))
                yield pa.RecordBatch.from_arrays([owners, pa.array(key), pa.array(n.astype(np.int64))], ["id", "key", "n"])

    return asked(docs, part, buckets).mapInArrow(run, "id bigint, key bigint, n bigint")


def answers(group: pa.Table, known: pa.Table) -> pa.Table:
    """(id, total): for each run of keys of a bucket, the sum of n times the values (key, value) that the model has."""
    none = pa.table({"id": pa.array([], pa.int64()), "total": pa.array([], pa.float64())})
    if not group.num_rows or not known.num_rows:
        return none
    held, value = known.column("key").to_numpy(), known.column("value").to_numpy()
    order = np.argsort(held)
    held, value = held[order], value[order]
    heads = np.flatnonzero(np.concatenate([[True], held[1:] != held[:-1]]))
    held, value = held[heads], np.add.reduceat(value, heads)
    tables = [none]
    for ids, sizes, key, n in opened(group):
        at = np.minimum(np.searchsorted(held, key), len(held) - 1)
        each = np.where(held[at] == key, n * value[at], 0.0)
        tables.append(pa.table({"id": ids, "total": pa.array(np.add.reduceat(each, np.cumsum(sizes, dtype=np.int64) - sizes))}))
    return pa.concat_tables(tables)


def lengths(docs: DataFrame) -> DataFrame:
    """(id, lang, n, total): the words of every row and its end; a total of zero."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in row_batches(batches, "text", BATCH_BYTES):
            n = pa.array(hashed(batch.column("text").to_pylist())[1] + 1, pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column("id"), batch.column("lang"), n, pa.array(np.zeros(len(n)))], ["id", "lang", "n", "total"])

    return docs.select("id", "lang", "text").mapInArrow(run, "id bigint, lang string, n bigint, total double")


def discounts(n: list[int]) -> list[float]:
    """Modified Kneser-Ney discounts of a table in which ``n[i]`` rows have count i + 1; 0.5, 1, 1.5 where they are undefined."""
    y = n[0] / (n[0] + 2 * n[1]) if n[0] + n[1] else 0.0
    return [max(0.0, min(float(i), i - (i + 1) * y * n[i] / n[i - 1])) if n[i - 1] and n[i] else i / 2 for i in (1, 2, 3)]


def taken(c: str, d: list[float]) -> Column:
    return F.when(F.col(c) == 1, d[0]).when(F.col(c) == 2, d[1]).otherwise(d[2])


def having(c: str, name: str) -> list[Column]:
    return [F.count_if(F.col(c) == i).alias(f"{name}{i}") for i in range(1, 5)]


def counted_words(texts: DataFrame, part: int, buckets: int, hot: np.ndarray) -> DataFrame:
    """(bucket, word, n, three1.., two1..): the pairs that end in a word, those of frequent middle words without bucket; counts of counts, to be summed."""
    threes, twos = [f"three{i}" for i in range(1, 5)], [f"two{i}" for i in range(1, 5)]

    def count(group: pa.Table) -> pa.Table:
        own = Counted(group)
        word, n = np.unique(own.word, return_counts=True)
        totals = np.zeros((8, len(word)), dtype=np.int64)
        totals[:, :1] = np.array([[(x == i).sum()] for x in (own.c, own.c2) for i in range(1, 5)])
        columns = [np.full(len(word), group.column("bucket")[0].as_py()), word.view(np.int64), n, *totals]
        return pa.table([pa.array(x, pa.int64()) for x in columns], names=["bucket", "word", "n", *threes, *twos])

    cold = packed_grams(texts, part, buckets, hot).groupBy("bucket").applyInArrow(count, ", ".join(f"{c} bigint" for c in ("bucket", "word", "n", *threes, *twos)))
    if not len(hot):
        return cold
    pairs = grams(texts, part, hot).groupBy("pair").agg(F.first("word").alias("word"), F.count("*").alias("c"), *having("c", "three"))
    counted = pairs.groupBy("word").agg(F.count("*").alias("n"), *(F.sum(x).alias(x) for x in threes), *having("c", "two"))
    return cold.union(counted.select(F.lit(None).cast("bigint"), "word", "n", *threes, *twos))


def train(texts: DataFrame) -> tuple[DataFrame, float]:
    """(key, value) in log2 and log2 of an unseen word's probability: a place's values add up to what its own is above that."""
    texts = stored(texts.select("text"), "quality-texts")
    threes, twos = [f"three{i}" for i in range(1, 5)], [f"two{i}" for i in range(1, 5)]
    buckets, hot = bucket_count(texts, "text", GRAM_BYTES, BUCKETS), frequent(texts)
    parts = [stored(counted_words(texts, part, buckets, hot), "quality-words") for part in range(SLICES)]
    words = cut_lineage(reduce(DataFrame.union, parts).groupBy("word").agg(*(F.sum(x).alias(x) for x in ("n", *threes, *twos))))
    sums = words.agg(*(F.coalesce(F.sum(x), F.lit(0)).alias(x) for x in (*threes, *twos, "n")), F.count("*").alias("rows"), *having("n", "one")).first()
    d1 = discounts([sums[f"one{i}"] for i in range(1, 5)])
    few = [sums["one1"], sums["one2"]]
    left = sum(d * n for d, n in zip(d1, (*few, sums["rows"] - sum(few))))
    rest = (left / sums["n"] / (sums["rows"] + 1) if sums["n"] else 0) or 1e-9
    ones = cut_lineage(words.select("word", ((F.col("n") - taken("n", d1)) / F.lit(sums["n"] or 1) + rest).alias("p1")))
    d3, d2 = discounts([sums[x] for x in threes]), discounts([sums[x] for x in twos])
    found = []
    for part, counted in enumerate(parts):
        # neither join is broadcast: every part would send all words through the driver once more
        needed = counted.where("bucket IS NOT NULL").select("bucket", "word").join(ones.hint("shuffle_hash"), "word")
        cold = packed_grams(texts, part, buckets, hot).groupBy("bucket").cogroup(needed.groupBy("bucket")).applyInArrow(bucket_values(d3, d2), "key bigint, value double")
        found.append(stored(cold.union(values(grams(texts, part, hot), ones, d3, d2)), "quality-values"))
    return reduce(DataFrame.union, found).union(ones.select("word", F.log2("p1") - log2(rest))), log2(rest)


def bucket_values(d3: list[float], d2: list[float]) -> Callable[[pa.Table, pa.Table], pa.Table]:
    """What ``values`` gives, for the trigrams of one bucket and the (word, p1) of its words."""
    log = lambda x: np.log2(np.where(x > 0, x, 1.0))
    off = lambda c, d: np.array([0.0, *d])[np.minimum(c, 3)]

    def run(group: pa.Table, known: pa.Table) -> pa.Table:
        own = Counted(group)
        word, p1 = known.column("word").to_numpy().view(np.uint64), known.column("p1").to_numpy()
        order = np.argsort(word)
        p1 = p1[order][np.searchsorted(word[order], own.word)]
        contexts, of = np.unique(own.context, return_inverse=True)
        total = np.bincount(of, own.c, len(contexts))
        gamma2 = np.bincount(of, off(own.c, d3), len(contexts)) / total
        prevs, of_prev = np.unique(own.prev, return_inverse=True)
        total1 = np.bincount(of_prev, own.c2, len(prevs))
        gamma1 = np.bincount(of_prev, off(own.c2, d2), len(prevs)) / total1
        p2 = (own.c2 - off(own.c2, d2)) / total1[of_prev] + gamma1[of_prev] * p1
        lower = p2[own.pair_of]
        p3 = (own.c - off(own.c, d3)) / total[of] + gamma2[of] * lower
        gram = (own.context << np.uint64(21) | own.context >> np.uint64(43)) ^ own.pair
        keys = np.concatenate([gram, own.pairs, contexts, prevs])
        found = np.concatenate([np.log2(p3) - log(gamma2)[of] - np.log2(lower), np.log2(p2) - log(gamma1)[of_prev] - np.log2(p1), log(gamma2), log(gamma1)])
        return pa.table({"key": pa.array(keys.view(np.int64)), "value": pa.array(found)})

    return run


def values(three: DataFrame, ones: DataFrame, d3: list[float], d2: list[float]) -> DataFrame:
    """(key, value) of the trigrams of a part, their pairs and contexts, and the back-off of its words."""
    log = lambda c: F.coalesce(F.log2(c), F.lit(0.0))
    # every use reads all columns of the counts, so that Spark shuffles them once
    contexts = three.groupBy("context").agg(F.sum("c").alias("total"), (F.sum(taken("c", d3)) / F.sum("c")).alias("gamma2"))
    pairs = three.where("c > 0").groupBy("pair").agg(F.count("*").alias("c2"), F.first("prev").alias("prev"), F.first("word").alias("word"))
    prevs = pairs.groupBy("prev").agg(F.sum("c2").alias("total"), (F.sum(taken("c2", d2)) / F.sum("c2")).alias("gamma1"))
    two = pairs.join(prevs, "prev").join(ones, "word").withColumn("p2", (F.col("c2") - taken("c2", d2)) / F.col("total") + F.col("gamma1") * F.col("p1"))
    p3 = (F.col("c") - taken("c", d3)) / F.col("total") + F.col("gamma2") * F.col("p2")
    joined = three.select("context", "pair", "c").join(two.select("pair", "p2"), "pair").join(contexts, "context")
    return (
        joined.select(gram_keys(F.col("context"), F.col("pair")).alias("key"), (F.log2(p3) - log("gamma2") - F.log2("p2")).alias("value"))
        .union(two.select("pair", F.log2("p2") - log("gamma1") - F.log2("p1")))
        .union(contexts.select("context", log("gamma2")))
        .union(prevs.select("prev", log("gamma1")))
    )


def bits(docs: DataFrame, model: tuple[DataFrame, float]) -> DataFrame:
    """(id, lang, n, bits): the mean surprise of a word or the end, for rows (id, lang, text)."""
    known, unseen = model
    parts, buckets = [stored(lengths(docs), "quality-lengths")], bucket_count(docs, "text", BUCKET_BYTES, BUCKETS)
    bucket = F.pmod(F.shiftrightunsigned("key", 20), F.lit(buckets)).alias("bucket")
    for part in range(SLICES):
        own = known.where(F.pmod("key", F.lit(SLICES)) == part).select(bucket, "key", "value")
        met = asked(docs, part, buckets).groupBy("bucket").cogroup(own.groupBy("bucket")).applyInArrow(answers, "id bigint, total double")
        sums = met.groupBy("id").agg(F.sum("total").alias("total"))
        parts.append(stored(sums.select("id", F.lit(None).cast("string").alias("lang"), F.lit(0).cast("bigint").alias("n"), "total"), "quality-sums"))
    sums = reduce(DataFrame.union, parts).groupBy("id").agg(F.min("lang").alias("lang"), F.sum("n").alias("n"), F.sum("total").alias("total"))
    return sums.select("id", "lang", "n", (-F.lit(unseen) - F.col("total") / F.col("n")).alias("bits"))


def thresholds(scored: DataFrame, quantile: float, margin: float) -> DataFrame:
    """(lang, threshold) in bits from rows (lang, bits) of trusted documents; lang null with ``every`` stands for all of them."""
    cells = scored.select("lang", F.lit(False).alias("every"), F.ceil(F.col("bits") * GRID).alias("cell"))
    cells = cells.union(cells.select(F.lit(None).cast("string"), F.lit(True), "cell")).groupBy("every", "lang", "cell").agg(F.count("*").alias("n"))
    to = Window.partitionBy("every", "lang").orderBy("cell")
    ranked = cells.withColumn("upto", F.sum("n").over(to)).withColumn("all", F.sum("n").over(Window.partitionBy("every", "lang")))
    return ranked.where(F.col("upto") >= F.ceil(F.col("all") * quantile)).groupBy("every", "lang").agg((F.min("cell") / GRID + margin).alias("threshold"))


def classify(docs: DataFrame, trusted: DataFrame, sample_docs: int | None = None, quantile: float = 0.98, margin: float = 1.0, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """One row per document: id, lang, n_words, perplexity, threshold (a perplexity), accepted. ``trusted``: ids of trusted documents."""
    rows = docs.select(docs[id_col].cast("bigint").alias("id"), docs[lang_col].cast("string").alias("lang"), docs[text_col].cast("string").alias("text"))
    ids = trusted.select(trusted[id_col].cast("bigint").alias("id")).where("id IS NOT NULL").distinct()
    halves = ids.withColumn("half", F.pmod(F.xxhash64("id"), F.lit(2)))
    first = halves.where("half = 0").select("id")
    first = cut_lineage(first if sample_docs is None else first.orderBy(F.xxhash64("id"), "id").limit(sample_docs))
    model = train(rows.join(hinted(first, first.count()), "id", "left_semi"))
    scored = cut_lineage(bits(rows, model))
    held = scored.where("n > 1").join(halves.where("half = 1"), "id", "left_semi")
    limits = cut_lineage(thresholds(held, quantile, margin))
    own = limits.where("NOT every").select(F.col("lang").alias("lang_"), F.col("threshold").alias("own"))
    every = limits.agg(F.max(F.when(F.col("every"), F.col("threshold"))).alias("every"))
    out = scored.join(own, F.col("lang").eqNullSafe(F.col("lang_")), "left").crossJoin(F.broadcast(every))  # one row for all documents
    limit = F.coalesce("own", "every")
    has = F.col("n") > 1
    return out.select(
        F.col("id").alias(id_col), F.col("lang").alias(lang_col), (F.col("n") - 1).alias("n_words"), F.when(has, F.pow(F.lit(2.0), "bits")).alias("perplexity"),
        F.pow(F.lit(2.0), limit).alias("threshold"), (has & (limit.isNull() | (F.col("bits") <= limit))).alias("accepted"),
    )
