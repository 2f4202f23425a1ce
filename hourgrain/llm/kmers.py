"""Super-k-mers: consecutive windows of a sequence that share a minimiser, and how they travel to their bucket.

Elements are words or bytes, given by 64-bit hashes. The minimiser of a window of ``k`` elements is the least hash among its
grams of ``m`` elements. Equal windows have equal minimisers, so they meet in the bucket of their minimiser. Each window is in
exactly one super-k-mer: the consecutive windows whose leftmost minimiser stands at one place. Two windows of one
super-k-mer are never equal, since that place is at different distances from their starts. Nothing is decided by a hash here: hashes only choose where strings meet.
"""

from __future__ import annotations

import pickle
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hourgrain.llm.common import cut_lineage, hinted

#: Stands for a null id, which so comes after every other.
NO_ID = (1 << 63) - 1


def mixed(x: np.ndarray) -> np.ndarray:
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def paired(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return mixed(a * np.uint64(0x9E3779B97F4A7C15) + b)


#: Grams that are hashed at a time, so that the arrays stay in a core's cache; below 2**PLACE_BITS with the windows' overlap.
BLOCK, PLACE_BITS = 1 << 14, np.uint64(20)


def grams(h: np.ndarray, m: int) -> np.ndarray:
    """Hashes of all runs of ``m`` elements: polynomials, by doubling, mixed once."""
    if len(h) < m:
        return h[:0]
    power, power_of_rest = 0x9E3779B97F4A7C15, 1
    out, size, rest, done = h, 1, None, 0  # rest: the polynomials of the last ``done`` elements of a run
    while True:
        if m & size:
            n = len(h) - done - size + 1
            rest = out[:n] if rest is None else out[:n] * np.uint64(power_of_rest) + rest[size : size + n]
            done, power_of_rest = done + size, power_of_rest * power % (1 << 64)
        if done == m:
            return mixed(rest)
        out = out[: len(out) - size] * np.uint64(power) + out[size:]
        size, power = size * 2, power * power % (1 << 64)


def sliding_argmin(h: np.ndarray, w: int) -> np.ndarray:
    """Where the least of each ``w`` consecutive values stands, the leftmost among those equal but for their last PLACE_BITS bits."""
    at = (h >> PLACE_BITS << PLACE_BITS) | np.arange(len(h), dtype=np.uint64)
    size = 1
    while size < w:
        step = min(size, w - size)
        at = np.minimum(at[: len(at) - step], at[step:])
        size += step
    return at.astype(np.int64) & ((1 << int(PLACE_BITS)) - 1)


def minimisers(h: np.ndarray, k: int, m: int) -> tuple[np.ndarray, np.ndarray]:
    """(hashes of all grams of ``m``, where the minimiser of each window of ``k`` elements stands)."""
    n = len(h) - k + 1
    gram, least = np.empty(len(h) - m + 1, dtype=np.uint64), np.empty(n, dtype=np.int64)
    for at in range(0, n, BLOCK):
        own = grams(h[at : at + BLOCK + k - 1], m)
        gram[at : at + len(own)] = own
        places = sliding_argmin(own, k - m + 1)
        least[at : at + len(places)] = places + at
    return gram, least


def super_kmers(h: np.ndarray, starts: np.ndarray, ends: np.ndarray, k: int, m: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(first window, number of windows, minimiser) of the super-k-mers of sequences ``h[start:end]`` that lie end to end."""
    n = len(h) - k + 1
    empty = np.zeros(0, dtype=np.int64)
    long = ends - starts >= k
    if n < 1 or not long.any():
        return empty, empty, np.zeros(0, dtype=np.uint64)
    gram, least = minimisers(h, k, m)
    inside = np.zeros(n + 1, dtype=np.int8)
    inside[starts[long]] = 1
    np.subtract.at(inside, ends[long] - k + 1, 1)
    inside = np.cumsum(inside[:n], dtype=np.int8).astype(bool)
    fresh = inside.copy()
    fresh[1:] &= (least[1:] != least[:-1]) | ~inside[:-1]
    fresh[starts[long]] = True
    first = np.flatnonzero(fresh)
    bounds = np.concatenate([first, [n]])
    before = np.concatenate([[0], np.cumsum(inside)])
    return first, before[bounds[1:]] - before[first], gram[least[first]]


def range_hashes(h: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Polynomial hashes of ``h[a:b]``, equal for equal runs wherever they stand."""
    r = np.uint64(0x9E3779B97F4A7C15 | 1)
    back = np.uint64(pow(int(r), -1, 1 << 64))
    powers = np.multiply.accumulate(np.concatenate([[np.uint64(1)], np.full(len(h), r, dtype=np.uint64)]))
    sums = np.concatenate([[np.uint64(0)], np.cumsum(h * powers[:-1], dtype=np.uint64)])
    undo = np.multiply.accumulate(np.concatenate([[np.uint64(1)], np.full(len(h), back, dtype=np.uint64)]))
    return (sums[b] - sums[a]) * undo[a]


def same_strings(kinds: np.ndarray, strings) -> np.ndarray:
    """For each index the first index with an equal string; only indices of equal ``kinds`` are compared, byte by byte."""
    head = np.arange(len(kinds))
    order = np.argsort(kinds, kind="stable")
    again = np.flatnonzero(kinds[order][1:] == kinds[order][:-1])
    seen: dict[bytes, int] = {}
    for i in np.unique(np.concatenate([order[again], order[again + 1]])).tolist():
        head[i] = seen.setdefault(strings(i), i)
    return head


def packed(content) -> bytes:
    return zstandard.ZstdCompressor(level=3).compress(pickle.dumps(content, protocol=5))


def unpacked(data: bytes):
    return pickle.loads(zstandard.ZstdDecompressor().decompress(data))


def bucket_blobs(buckets: int, key: np.ndarray, columns: dict[str, np.ndarray], string) -> Iterator[tuple[int, bytes]]:
    """One blob for each bucket that has super-k-mers; in it they are sorted by minimiser."""
    own = (mixed(key ^ np.uint64(0xA0761D6478BD642F)) % np.uint64(buckets)).astype(np.int64)
    order = np.lexsort((key, own))
    cuts = np.flatnonzero(np.diff(own[order])) + 1
    for part in np.split(order, cuts):
        if len(part):
            strings = [string(i) for i in part.tolist()]
            content = {"key": key[part], **{c: v[part] for c, v in columns.items()}, "size": np.array([len(s) for s in strings], dtype=np.int32), "text": b"".join(strings)}
            yield int(own[part[0]]), packed(content)


def gathered(blobs: list[bytes]) -> tuple[dict[str, np.ndarray], bytes, list[dict]]:
    """The columns of all blobs of a bucket with the bounds of each string in the joined text, and blobs of another kind."""
    contents = [unpacked(b) for b in blobs]
    own, others = [c for c in contents if "key" in c], [c for c in contents if "key" not in c]
    if not own:
        return {}, b"", others
    out = {c: np.concatenate([x[c] for x in own]) for c in own[0] if c != "text"}
    end = np.cumsum(out["size"], dtype=np.int64)
    return out | {"from": end - out["size"], "to": end}, b"".join(x["text"] for x in own), others


def bucket_count(docs: DataFrame, text_col: str, bytes_each: int, least: int = 64) -> int:
    """Buckets of about ``bytes_each`` of text, in proportion to the whole input, ``least`` at least."""
    total = docs.agg(F.sum(F.octet_length(docs[text_col].cast("string")))).first()[0] or 0
    return int(max(least, -(-total // bytes_each)))


def keyed(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(id, print, text): rows with equal id and text share one result, and are told from others with their id by the text's hash."""
    text = F.coalesce(docs[text_col].cast("string"), F.lit(""))
    return docs.select(F.coalesce(docs[id_col].cast("bigint"), F.lit(NO_ID)).alias("id"), F.xxhash64(text).alias("print"), text.alias("text"))


def repeated_rows(rows: DataFrame) -> DataFrame:
    """(id, print) of the documents of ``keyed`` that come in two rows or more; texts are read for repeated ids alone."""
    ids = cut_lineage(rows.groupBy("id").count().where("count > 1").select("id"))
    return rows.join(hinted(ids, ids.count()), "id", "left_semi").groupBy("id", "print").count().where("count > 1").select("id", "print")


def with_spans(rows: DataFrame, spans: DataFrame) -> DataFrame:
    """Rows of ``keyed`` with their spans, an array of (start, end), and ``again``: whether an equal row exists; null if neither is so."""
    marked = spans.select("id", "print", F.struct("start", "end").alias("span"), F.lit(False).alias("again"))
    marked = marked.union(repeated_rows(rows).select("id", "print", F.lit(None).alias("span"), F.lit(True).alias("again")))
    lists = marked.groupBy("id", "print").agg(F.collect_list("span").alias("spans"), F.max("again").alias("again"))
    return rows.join(lists, ["id", "print"], "left").select(F.when(F.col("id") != NO_ID, F.col("id")).alias("id"), "text", "spans", "again")


SPANS = "id bigint, print bigint, start bigint, end bigint"


def span_table(ids: np.ndarray, prints: np.ndarray, start: np.ndarray, end: np.ndarray) -> pa.Table:
    return pa.table({"id": pa.array(ids, pa.int64()), "print": pa.array(prints, pa.int64()), "start": pa.array(start, pa.int64()), "end": pa.array(end, pa.int64())})


def covered(n: int, spans) -> np.ndarray:
    """Which of n positions the spans cover."""
    edge = np.zeros(n + 1, dtype=np.int64)
    if spans:
        np.add.at(edge, [s["start"] for s in spans], 1)
        np.add.at(edge, [s["end"] for s in spans], -1)
    return np.cumsum(edge[:n]) > 0


def runs(marked: np.ndarray, group: np.ndarray, start: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(group, start, end) of the elements under marked windows; consecutive windows of a group become one span."""
    at = np.flatnonzero(marked)
    if not len(at):
        return at, at, at
    fresh = np.concatenate([[True], (group[at][1:] != group[at][:-1]) | (start[at][1:] != start[at][:-1] + 1)])
    first = np.flatnonzero(fresh)
    last = np.concatenate([first[1:], [len(at)]]) - 1
    return group[at][first], start[at][first], start[at][last] + k
