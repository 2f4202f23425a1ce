"""Removal of repeated word windows by super-k-mer partitioning.

Each task cuts its texts into super-k-mers (``kmers``), each a packed string of the words under consecutive windows that share
a minimiser. Of super-k-mers that are equal within a batch of the task, one travels with a mark and the places of all
are settled at once, so a passage that a third of all documents share sends one string a batch, not one a document. In
its bucket a super-k-mer whose minimiser nothing else has holds no repeated window; the windows of the others are sorted and
counted exactly, equal neighbours being compared word by word. The spans go back to their documents by one join.

Defined results: a null text has no words; texts with fewer words than the window keep everything; rows with equal id and
text repeat each other, so all their words under windows go; a null id comes after all others; an empty table gives an empty
result; other columns are not read. Texts are treated whole; a long one is cut into overlapping pieces only inside a task.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame

from hourgrain.llm import kmers
from hourgrain.llm.common import row_batches

BATCH_BYTES, BUCKET_BYTES = 8 << 20, 16 << 20
REMEMBERED = 400_000


class WordHashes(dict):
    def __missing__(self, word: bytes) -> int:
        if len(self) >= REMEMBERED:
            self.clear()
        h = self[word] = xxhash.xxh64_intdigest(word)
        return h


def cut(ids: list[int], prints: list[int], texts: list[str], window: int, gram: int, buckets: int) -> Iterator[tuple[int, bytes]]:
    """Blobs for the buckets from one batch of distinct documents."""
    hashes, words, lengths = WordHashes(), [], []
    for text in texts:
        own = text.encode().split()
        lengths.append(len(own))
        words += own
    h = np.fromiter(map(hashes.__getitem__, words), dtype=np.uint64, count=len(words))
    ends = np.cumsum(lengths, dtype=np.int64)
    starts = ends - lengths
    first, count, key = kmers.super_kmers(h, starts, ends, window, gram)
    if not len(first):
        return
    stop = first + count + window - 1
    doc = np.searchsorted(ends, first, side="right")
    joined = b" ".join(words)
    at = np.concatenate([[0], np.cumsum(np.fromiter(map(len, words), dtype=np.int64, count=len(words)) + 1)])
    a, b = at[first].tolist(), (at[stop] - 1).tolist()
    string = lambda i: joined[a[i] : b[i]]
    head = kmers.same_strings(kmers.paired(key, kmers.range_hashes(h, first, stop)), string)
    times = np.bincount(head, minlength=len(head))
    many = times[head] > 1
    columns = {"id": np.array(ids, dtype=np.int64)[doc], "print": np.array(prints, dtype=np.int64)[doc], "start": first - starts[doc], "count": count.astype(np.int32), "many": many}
    if many.any():
        settled = {c: columns[c][many] for c in ("id", "print", "start")} | {"end": (stop - starts[doc])[many]}
        yield int(abs(prints[0]) % buckets), kmers.packed(settled)
    kept = np.flatnonzero(times)
    yield from kmers.bucket_blobs(buckets, key[kept], {c: v[kept] for c, v in columns.items()}, lambda i: string(int(kept[i])))


def repeated(columns: dict[str, np.ndarray], text: bytes, window: int) -> pa.Table:
    """Spans of the windows of a bucket that start at two places or more."""
    _, back, times = np.unique(columns["key"], return_inverse=True, return_counts=True)
    keep = np.flatnonzero((times[back] > 1) | columns["many"])
    # a document that came in two rows sends everything twice; one stays, with the mark if either has it
    order = keep[np.lexsort((~columns["many"][keep], columns["start"][keep], columns["print"][keep], columns["id"][keep]))]
    if len(order):
        place = [columns[c][order] for c in ("id", "print", "start")]
        order = order[np.concatenate([[True], np.any([x[1:] != x[:-1] for x in place], axis=0)])]
    if not len(order):
        return kmers.span_table(*[np.zeros(0, dtype=np.int64)] * 4)
    number: dict[bytes, int] = {}
    words: list[int] = []
    lengths = []
    for a, b in zip(columns["from"][order].tolist(), columns["to"][order].tolist()):
        own = text[a:b].split(b" ")
        lengths.append(len(own))
        words += [number.setdefault(w, len(number)) for w in own]
    w = np.array(words, dtype=np.int32)
    base = np.cumsum(lengths) - lengths
    counts = columns["count"][order].astype(np.int64)
    group = np.repeat(np.arange(len(order)), counts)
    offset = np.arange(len(group)) - np.repeat(np.cumsum(counts) - counts, counts)
    at = base[group] + offset
    weight = 1 + columns["many"][order][group].astype(np.int64)
    classes = window_classes(w, at, window)
    twice = np.bincount(classes, weight) > 1
    g, start, end = kmers.runs(twice[classes], group, columns["start"][order][group] + offset, window)
    return kmers.span_table(columns["id"][order][g], columns["print"][order][g], start, end)


def window_classes(w: np.ndarray, at: np.ndarray, window: int) -> np.ndarray:
    """A number for each window, equal exactly for equal windows: sorted by hash, equal neighbours compared word by word."""
    h = kmers.grams(kmers.mixed(w.astype(np.uint64) + np.uint64(1)), window)[at]
    order = np.argsort(h, kind="stable")
    fresh = np.ones(len(h), dtype=bool)
    fresh[1:] = h[order][1:] != h[order][:-1]
    for part in np.array_split(np.flatnonzero(~fresh), max(1, len(h) // 100_000)):
        this, last = at[order[part]], at[order[part - 1]]
        same = np.ones(len(part), dtype=bool)
        for i in range(window):
            same &= w[this + i] == w[last + i]
        if not same.all():  # unequal windows of one hash: sort such runs by their words
            return np.unique(np.lib.stride_tricks.sliding_window_view(w, window)[at], axis=0, return_inverse=True)[1].ravel()
    classes = np.empty(len(h), dtype=np.int64)
    classes[order] = np.cumsum(fresh) - 1
    return classes


def spans(rows: DataFrame, buckets: int, window: int, gram: int) -> DataFrame:
    """(id, print, start, end) in words, for rows of ``kmers.keyed``."""

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in row_batches(batches, "text", BATCH_BYTES):
            found = {(i, p): t for i, p, t in zip(*(batch.column(c).to_pylist() for c in ("id", "print", "text")))}
            blobs = list(cut([i for i, _ in found], [p for _, p in found], list(found.values()), window, gram, buckets))
            if blobs:
                yield pa.RecordBatch.from_arrays([pa.array([b for b, _ in blobs], pa.int32()), pa.array([x for _, x in blobs], pa.binary())], ["bucket", "blob"])

    def meet(group: pa.Table) -> pa.Table:
        columns, text, settled = kmers.gathered(group.column("blob").to_pylist())
        tables = [kmers.span_table(x["id"], x["print"], x["start"], x["end"]) for x in settled]
        return pa.concat_tables([repeated(columns, text, window), *tables] if columns else tables)

    return rows.mapInArrow(send, "bucket int, blob binary").groupBy("bucket").applyInArrow(meet, kmers.SPANS)


def remove_repeats(docs: DataFrame, window: int = 35, gram: int = 8, id_col: str = "doc_id", text_col: str = "text", texts: bool = True) -> DataFrame:
    """One row per row of ``docs``: id, n_words, n_removed, kept_sha256 (of the kept words joined by a space) and, with
    ``texts``, kept_text. A word goes if a window of ``window`` words that covers it also starts anywhere else.
    """
    rows = kmers.keyed(docs, id_col, text_col)
    found = spans(rows, kmers.bucket_count(docs, text_col, BUCKET_BYTES), window, gram)

    def finish(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in row_batches(batches, "text", BATCH_BYTES):
            n, removed, digests, kept_texts = [], [], [], []
            for text, own, again in zip(*(batch.column(c).to_pylist() for c in ("text", "spans", "again"))):
                words = text.encode().split()
                if again and len(words) >= window:  # every window also starts in the equal row
                    own = [{"start": 0, "end": len(words)}]
                gone = kmers.covered(len(words), own)
                kept = b" ".join([w for w, g in zip(words, gone.tolist()) if not g] if own else words)
                n.append(len(words))
                removed.append(int(gone.sum()))
                digests.append(hashlib.sha256(kept).hexdigest())
                if texts:
                    kept_texts.append(kept.decode())
            out = [batch.column("id"), pa.array(n, pa.int64()), pa.array(removed, pa.int64()), pa.array(digests, pa.string())]
            yield pa.RecordBatch.from_arrays(out + [pa.array(kept_texts, pa.string())] * texts, ["id", "n_words", "n_removed", "kept_sha256", *["kept_text"] * texts])

    schema = "id bigint, n_words bigint, n_removed bigint, kept_sha256 string" + ", kept_text string" * texts
    return kmers.with_spans(rows, found).mapInArrow(finish, schema).withColumnRenamed("id", id_col)
