"""Removal of byte strings that occur earlier, by suffix arrays built with linear grouping.

Texts are stored once in chunks of some megabytes. Windows of 100 bytes are dealt to buckets by super-k-mers (``kmers``);
equal windows meet in one bucket. First each chunk sends its distinct minimisers alone and learns which of them
another super-k-mer has; only super-k-mers with such a minimiser travel, equal ones of a part of a chunk once. In the bucket, strings all of whose
windows have hashes of their own go; the text of the others becomes a string of phrases, whose
boundaries depend on the 16 bytes before them only: a boundary follows every byte that is no letter, and every byte
when 16 letters went before. So equal windows have equal boundaries from their 16th byte on, and a window is told by
its first boundary there: a phrase suffix to the right of it and at most 32 bytes to the left.

The phrase suffixes are sorted by grouping in linear time (Baier's construction). Phase one takes the groups of suffixes with
one Lyndon prefix in descending order; each suffix of a group points to the last smaller one before it (the pointers
of groups already done are followed), and the suffixes pointed to move, by how often they are, into new groups right after
their own. Phase two walks the order as it emerges and puts every suffix that ends at the current one, along its pointers, at
the front of what is left of its group. Nothing is renamed and nothing recurses.

Windows with one boundary offset are equal if no common prefix between their suffixes is shorter than what is left of the
window, and the bytes before the boundary agree. Of equal windows the first in (id, start) stays.

Defined results: a null text has no bytes; shorter texts than the window stay whole; repeated rows and rows with equal ids are
documents of their own, one of which counts as the earlier one; a null id comes after all others; an empty table gives an empty result; other columns are not read. Kept text is decoded without
characters that a removed byte has broken. Texts are treated whole; a long one is cut into overlapping pieces inside a task.
"""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hourgrain.llm import kmers
from hourgrain.llm.common import forget, row_batches, stored
from hourgrain.llm.kmers import NO_ID

#: Text of a chunk, of a part of it that is hashed at once, and of a bucket.
CHUNK_BYTES, PIECE_BYTES, BUCKET_BYTES = 4 << 20, 2 << 20, 2 << 20
#: Bytes before a boundary that decide it; a window's boundary stands ``CONTEXT`` to ``2 * CONTEXT`` bytes from its start.
CONTEXT = 16
BYTE_HASHES = kmers.mixed(np.arange(1, 257, dtype=np.uint64))


def suffix_array(symbols: np.ndarray) -> np.ndarray:
    """Order of the suffixes of ``symbols``; the last symbol must be smaller than all others and stand there only."""
    n = len(symbols)
    order = np.argsort(symbols, kind="stable")
    inverse = np.empty(n, dtype=np.int64)
    inverse[order] = np.arange(n)
    by_rank = symbols[order]
    fresh = np.concatenate([[True], by_rank[1:] != by_rank[:-1]])
    start_of = np.flatnonzero(fresh)[np.cumsum(fresh) - 1]
    group = np.empty(n, dtype=np.int64)
    group[order] = start_of
    sizes = np.bincount(start_of, minlength=n)
    line, place, group, size = order.tolist(), inverse.tolist(), group.tolist(), sizes.tolist()
    smaller = [-1] * n

    end = n - 1
    while end > 0:
        s = line[end]
        start = group[s]
        if start == end:  # a group of one: at most one suffix moves, to the end of its group
            p = s - 1
            while p >= 0 and place[p] > end:
                p = smaller[p]
            smaller[s] = p
            if p >= 0 and size[g := group[p]] > 1:
                left = size[g] = size[g] - 1
                last = g + left
                q, at = line[last], place[p]
                line[at], place[q] = q, at
                line[last] = p
                place[p] = group[p] = last
                size[last] = 1
            end -= 1
            continue
        members = sorted(line[start : end + 1])
        pointed: dict[int, int] = {}
        for s in members:
            p = s - 1
            while p >= 0 and place[p] > end:
                p = smaller[p]
            if p >= 0 and place[p] >= start:  # of the same group and before s: its pointer leads out of the group
                p = smaller[p]
            smaller[s] = p
            if p >= 0:
                pointed[p] = pointed.get(p, 0) + 1
        by_times: dict[int, list[int]] = {}
        for p, times in pointed.items():
            by_times.setdefault(times, []).append(p)
        for times in sorted(by_times, reverse=True):
            wave = by_times[times]
            for p in wave:  # to the end of its group
                g = group[p]
                left = size[g] = size[g] - 1
                last = g + left
                q, at = line[last], place[p]
                line[at], place[q] = q, at
                line[last], place[p] = p, last
            fresh_groups = [group[p] + size[group[p]] for p in wave]
            for p, new in zip(wave, fresh_groups):
                group[p] = new
                size[new] += 1
        end = start - 1

    out, filled, done = [-1] * n, list(range(n)), bytearray(n)
    out[0] = n - 1
    done[n - 1] = 1
    for i in range(n):
        j = out[i] - 1
        while j >= 0 and not done[j]:
            g = group[j]
            out[filled[g]] = j
            filled[g] += 1
            done[j] = 1
            j = smaller[j]
    return np.array(out, dtype=np.int64)


def boundaries(text: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """Where phrases begin, in increasing order; the first ``CONTEXT`` places of each string are left out."""
    n = len(text)
    lower = text | 0x20
    letter = ((lower >= ord("a")) & (lower <= ord("z"))) | (text >= 0x80)
    run = np.concatenate([[0], np.cumsum(~letter)])
    at = np.zeros(n, dtype=bool)
    at[1:] = ~letter[:-1]
    at[CONTEXT:] |= run[CONTEXT:n] == run[: n - CONTEXT]
    for i in range(CONTEXT):
        inner = starts + i
        at[inner[inner < n]] = False
    return np.flatnonzero(at)


def common_bytes(eight: np.ndarray, a: np.ndarray, b: np.ndarray, most: np.ndarray) -> np.ndarray:
    """Bytes that the text has in common from ``a`` and from ``b``, up to ``most``; ``eight``: the 8 bytes from each place."""
    out = np.zeros(len(a), dtype=np.int64)
    on = np.arange(len(a))
    step = 0
    while len(on):
        apart = eight[a[on] + step] ^ eight[b[on] + step]
        bits = apart & (~apart + np.uint64(1))
        out[on] = step + np.where(apart == 0, 8, np.log2(np.maximum(bits, 1).astype(np.float64)).astype(np.int64) // 8)
        step += 8
        on = on[(apart == 0) & (most[on] > step)]
    return np.minimum(out, most)


def window_classes(text: np.ndarray, starts: np.ndarray, ends: np.ndarray, window: int) -> tuple[np.ndarray, np.ndarray]:
    """(start, class) of all windows of the strings ``text[start:end]``; a class holds equal windows, all of them."""
    at = boundaries(text, starts)
    owner = np.searchsorted(ends, at, side="right")
    padded = np.concatenate([text, np.zeros(16, dtype=np.uint8)])
    eight = np.lib.stride_tricks.sliding_window_view(padded, 8)[: len(text) + 8].copy().view("<u8").ravel()
    # phrases: from a boundary to the next one or to the end of the string; after each string comes a separator
    after = np.append(at[1:], len(text))
    stop = np.minimum(after, ends[owner])
    raw = text.tobytes()
    phrases = [raw[a:b] for a, b in zip(at.tolist(), stop.tolist())]
    rank = {p: i for i, p in enumerate(sorted(set(phrases)), start=2)}
    ranks = np.fromiter(map(rank.__getitem__, phrases), dtype=np.int64, count=len(phrases))
    last_of_string = np.append(owner[1:] != owner[:-1], True)
    symbols = np.ones(len(at) + int(last_of_string.sum()) + 1, dtype=np.int64)
    where = np.arange(len(at)) + np.concatenate([[0], np.cumsum(last_of_string)[:-1]])
    symbols[where] = ranks
    symbols[-1] = 0
    back = np.full(len(symbols), -1, dtype=np.int64)
    back[where] = np.arange(len(at))
    sorted_at = back[suffix_array(symbols)]
    sorted_at = sorted_at[sorted_at >= 0]
    place = at[sorted_at]
    left = ends[owner[sorted_at]] - place
    common = np.concatenate([[0], common_bytes(eight, place[:-1], place[1:], np.minimum(np.minimum(left[:-1], left[1:]), window))])
    begin = starts[owner[sorted_at]]
    since = place - np.where((sorted_at > 0) & (owner[sorted_at] == owner[sorted_at - 1]), at[sorted_at - 1], begin)
    # the boundary before the first one of a string may be inside the part without boundaries; only the first 16 starts see it
    first = ~((sorted_at > 0) & (owner[sorted_at] == owner[sorted_at - 1]))
    all_starts, all_keys = [], []
    for head in range(CONTEXT, 2 * CONTEXT + 1):
        start = place - head
        fits = (start >= begin) & (left >= window - head) & (first | (head < CONTEXT + since))
        group = np.cumsum(common < window - head)[fits].astype(np.uint64)
        s = start[fits]
        heads = kmers.paired(kmers.paired(eight[s], eight[s + 8]), kmers.paired(eight[s + head - 16], eight[s + head - 8]))
        all_starts.append(s)
        all_keys.append(kmers.paired(kmers.paired(group, heads), np.full(len(s), head, dtype=np.uint64)))
    found, keys = np.concatenate(all_starts), np.concatenate(all_keys)
    order = np.argsort(keys, kind="stable")
    found, keys = found[order], keys[order]
    fresh = np.concatenate([[True], keys[1:] != keys[:-1]]) if len(keys) else np.zeros(0, dtype=bool)
    again = np.flatnonzero(~fresh)
    for step in (0, 8, 16, 24):  # the bytes before the boundary, compared themselves; what follows agrees by the suffixes
        if (eight[found[again] + step] != eight[found[again - 1] + step]).any():
            raise ValueError("two heads of one hash")
    return found, np.cumsum(fresh) - 1


def with_repeats(joined: bytes, count: np.ndarray, window: int) -> np.ndarray:
    """Which strings, that have so many windows and lie end to end, may hold a window that occurs twice; the hash of a window of any other is its alone."""
    if not len(count):
        return np.zeros(0, dtype=bool)
    before = np.cumsum(count) - count
    at = np.arange(count.sum()) + np.repeat(np.arange(len(count)) * (window - 1), count)
    hashes = kmers.minimisers(BYTE_HASHES[np.frombuffer(joined, dtype=np.uint8)], window, window)[0][at]
    ordered = np.sort(hashes)
    marked = np.zeros(1 << 22, dtype=bool)
    low = np.uint64(len(marked) - 1)
    marked[ordered[1:][ordered[1:] == ordered[:-1]] & low] = True
    return np.logical_or.reduceat(marked[hashes & low], before)


def later(columns: dict[str, np.ndarray], text: bytes, window: int) -> pa.Table:
    """Spans of the windows of a bucket that also start earlier."""
    order = np.lexsort((columns["start"], columns["row"], columns["chunk"], columns["id"]))
    chunk, row, start, count = (columns[c][order] for c in ("chunk", "row", "start", "count"))
    a, b = columns["from"][order].tolist(), columns["to"][order].tolist()
    head = kmers.same_strings(columns["key"][order], lambda i: text[a[i] : b[i]])
    copy = head != np.arange(len(head))  # all its windows start earlier, in the first of the equal strings
    tables = [span_table(chunk[copy], row[copy], start[copy], (start + count + window - 1)[copy])]
    own = np.flatnonzero(~copy)
    own = own[with_repeats(b"".join(text[a[i] : b[i]] for i in own.tolist()), count[own].astype(np.int64), window)]
    if not len(own):
        return tables[0]
    joined = np.frombuffer(b"".join(text[a[i] : b[i]] for i in own.tolist()), dtype=np.uint8)
    ends = np.cumsum(count[own].astype(np.int64) + window - 1)
    starts = ends - count[own] - window + 1
    at, classes = window_classes(joined, starts, ends, window)
    # strings lie in the order (id, chunk, row, start), so places in the joined text are in that order too
    least = np.full(int(classes.max(initial=-1)) + 1, len(joined), dtype=np.int64)
    np.minimum.at(least, classes, at)
    gone = np.zeros(len(joined), dtype=bool)
    gone[at[least[classes] < at]] = True
    places = np.flatnonzero(gone)
    string = np.searchsorted(ends, places, side="right")
    g, s, e = kmers.runs(np.ones(len(places), dtype=bool), string, start[own][string] + places - starts[string], window)
    tables.append(span_table(chunk[own][g], row[own][g], s, e))
    return pa.concat_tables(tables)


SPANS = "chunk bigint, row int, start bigint, end bigint"


def span_table(chunk: np.ndarray, row: np.ndarray, start: np.ndarray, end: np.ndarray) -> pa.Table:
    return pa.table({"chunk": pa.array(chunk, pa.int64()), "row": pa.array(row, pa.int32()), "start": pa.array(start, pa.int64()), "end": pa.array(end, pa.int64())})


def pieces(texts: list[bytes], window: int, gram: int) -> Iterator[tuple[bytes, np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """Super-k-mers of the texts, about PIECE_BYTES at a time: (joined text, place in it, row, start in the row's text, windows, minimiser)."""
    parts = [(d, at) for d, text in enumerate(texts) for at in range(0, max(1, len(text) - window + 1), PIECE_BYTES)]
    group: list[tuple[int, int]] = []
    total = 0
    for i, (d, at) in enumerate(parts):
        group.append((d, at))
        total += min(len(texts[d]) - at, PIECE_BYTES + window - 1)
        if total < PIECE_BYTES and i + 1 < len(parts):
            continue
        joined = b"".join(texts[d][at : at + PIECE_BYTES + window - 1] for d, at in group)
        h = BYTE_HASHES[np.frombuffer(joined, dtype=np.uint8)]
        ends = np.cumsum([min(len(texts[d]) - at, PIECE_BYTES + window - 1) for d, at in group], dtype=np.int64)
        starts = np.concatenate([[0], ends[:-1]])
        first, count, key = kmers.super_kmers(h, starts, ends, window, gram)
        piece = np.searchsorted(ends, first, side="right")
        row = np.array([d for d, _ in group], dtype=np.int64)[piece]
        yield joined, first, row, first - starts[piece] + np.array([at for _, at in group], dtype=np.int64)[piece], count, key
        group, total = [], 0


def own_keys(texts: list[bytes], window: int, gram: int) -> tuple[np.ndarray, np.ndarray]:
    """The distinct minimisers of a chunk's super-k-mers, and which of them it has twice or more."""
    keys = np.concatenate([np.zeros(0, dtype=np.uint64), *(key for *_, key in pieces(texts, window, gram))])
    distinct, times = np.unique(keys, return_counts=True)
    return distinct, times > 1


def bucket_of(keys: np.ndarray, buckets: int) -> np.ndarray:
    return (kmers.mixed(keys ^ np.uint64(0xA0761D6478BD642F)) % np.uint64(buckets)).astype(np.int64)


def candidates(chunk: int, ids: np.ndarray, texts: list[bytes], repeated: np.ndarray, window: int, gram: int, buckets: int) -> Iterator[tuple[int, bytes]]:
    """Blobs for the buckets: the super-k-mers whose minimiser is among ``repeated`` (sorted); equal ones of a piece once."""
    for joined, first, row, start, count, key in pieces(texts, window, gram):
        if not len(repeated) or not len(key):
            continue
        found = np.flatnonzero(repeated[np.minimum(np.searchsorted(repeated, key), len(repeated) - 1)] == key)
        if not len(found):
            continue
        found = found[np.lexsort((start[found], row[found], ids[row[found]]))]
        first, row, start, count, key = (x[found] for x in (first, row, start, count, key))
        a, b = first.tolist(), (first + count + window - 1).tolist()
        string = lambda i: joined[a[i] : b[i]]  # noqa: B023, E731
        head = kmers.same_strings(kmers.paired(key, count.astype(np.uint64)), string)
        copy = head != np.arange(len(head))
        if copy.any():
            yield chunk % buckets, kmers.packed({"settled": (row[copy], start[copy], (start + count + window - 1)[copy]), "chunk_id": chunk})
        kept = np.flatnonzero(~copy)
        columns = {"id": ids[row], "chunk": np.full(len(row), chunk, dtype=np.int64), "row": row.astype(np.int32), "start": start, "count": count.astype(np.int32)}
        yield from kmers.bucket_blobs(buckets, key[kept], {c: v[kept] for c, v in columns.items()}, lambda i: string(int(kept[i])))  # noqa: B023


def serialised(batch: pa.RecordBatch) -> bytes:
    out = pa.BufferOutputStream()
    with pa.ipc.new_stream(out, batch.schema) as writer:
        writer.write_batch(batch)
    return out.getvalue().to_pybytes()


def chunked(rows: DataFrame) -> DataFrame:
    """Stored chunks of about CHUNK_BYTES of text: (chunk, content), the content being the packed ids and texts of some rows.

    A row is known by its chunk and its place there from here on, so repeated rows and ids stay apart.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        forget()
        for batch in row_batches(batches, "text", CHUNK_BYTES):
            ids = np.array([NO_ID if i is None else i for i in batch.column("id").to_pylist()], dtype=np.int64)
            texts = [(t or "").encode() for t in batch.column("text").to_pylist()]
            others = [c for c in batch.schema.names if c not in ("id", "text")]
            carried = serialised(batch.select(others)) if others else None
            chunk = uuid.uuid4().int >> 66  # made once and stored; a repeated task's output replaces that of the lost one
            yield pa.RecordBatch.from_arrays([pa.array([chunk], pa.int64()), pa.array([kmers.packed((ids, texts, carried))], pa.binary())], ["chunk", "content"])

    return stored(rows.mapInArrow(run, "chunk bigint, content binary"), "suffix-chunks")


def repeated_keys(chunks: DataFrame, buckets: int, window: int, gram: int) -> DataFrame:
    """(chunk, parts): for each chunk the minimisers that it shares with others or has twice, packed by bucket.

    A chunk sends each minimiser once, so a hot one costs its bucket one entry a chunk.
    """

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        forget()
        for batch in batches:
            for chunk, content in zip(batch.column(0).to_pylist(), batch.column(1)):
                keys, many = own_keys(kmers.unpacked(content.as_py())[1], window, gram)
                own = bucket_of(keys, buckets)
                order = np.argsort(own, kind="stable")
                parts = np.split(order, np.flatnonzero(np.diff(own[order])) + 1) if len(order) else []
                yield pa.RecordBatch.from_arrays(
                    [pa.array([int(own[p[0]]) for p in parts], pa.int32()), pa.array([chunk] * len(parts), pa.int64()), pa.array([keys[p].tobytes() for p in parts], pa.binary()), pa.array([keys[p][many[p]].tobytes() for p in parts], pa.binary())],
                    ["bucket", "chunk", "keys", "many"],
                )

    def meet(group: pa.Table) -> pa.Table:
        keys = [np.frombuffer(x, dtype=np.uint64) for x in group.column("keys").to_pylist()]
        distinct, times = np.unique(np.concatenate(keys), return_counts=True)
        shared = distinct[times > 1]
        found = [np.union1d(np.intersect1d(k, shared, assume_unique=True), np.frombuffer(m, dtype=np.uint64)).tobytes() for k, m in zip(keys, group.column("many").to_pylist())]
        return pa.table({"chunk": group.column("chunk"), "repeated": pa.array(found, pa.binary())})

    sent = chunks.mapInArrow(send, "bucket int, chunk bigint, keys binary, many binary")
    return sent.groupBy("bucket").applyInArrow(meet, "chunk bigint, repeated binary").groupBy("chunk").agg(F.collect_list("repeated").alias("parts"))


def spans(chunks: DataFrame, buckets: int, window: int, gram: int) -> DataFrame:
    """(chunk, row, start, end) in bytes of what occurs earlier."""

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        forget()
        for batch in batches:
            for chunk, content, parts in zip(batch.column("chunk").to_pylist(), batch.column("content"), batch.column("parts").to_pylist()):
                ids, texts, _ = kmers.unpacked(content.as_py())
                repeated = np.sort(np.frombuffer(b"".join(parts or []), dtype=np.uint64))
                for bucket, blob in candidates(chunk, ids, texts, repeated, window, gram, buckets):
                    yield pa.RecordBatch.from_arrays([pa.array([bucket], pa.int32()), pa.array([blob], pa.binary())], ["bucket", "blob"])

    def meet(group: pa.Table) -> pa.Table:
        columns, text, settled = kmers.gathered(group.column("blob").to_pylist())
        tables = [span_table(np.full(len(x["settled"][0]), x["chunk_id"]), *x["settled"]) for x in settled]
        return pa.concat_tables([later(columns, text, window), *tables] if columns else tables)

    known = chunks.join(stored(repeated_keys(chunks, buckets, window, gram), "suffix-keys"), "chunk")
    return known.mapInArrow(send, "bucket int, blob binary").groupBy("bucket").applyInArrow(meet, SPANS)


def remove_earlier(docs: DataFrame, window: int = 100, gram: int = 40, id_col: str = "doc_id", text_col: str = "text", texts: bool = True, carry: list[str] = ()) -> DataFrame:
    """One row per row of ``docs``: id, n_bytes, n_removed, n_spans (maximal removed runs), kept_sha256, with
    ``texts`` also kept_text and the removed spans in bytes, and the columns ``carry`` as they are. A byte goes if a string of ``window`` bytes that covers it also
    starts earlier: in a document of smaller id, or earlier in its own. ``window`` is at least 40.
    """
    if window < 2 * CONTEXT + 8 or gram > window:
        raise ValueError("the window is too short for the boundaries' context or the gram")
    others = [docs[c].alias(f"carried_{i}") for i, c in enumerate(carry)]
    chunks = chunked(docs.select(docs[id_col].cast("bigint").alias("id"), docs[text_col].cast("string").alias("text"), *others))
    found = spans(chunks, kmers.bucket_count(docs, text_col, BUCKET_BYTES), window, gram)
    # stored, so that what was shuffled to find the spans can go before the chunks meet them
    lists = stored(found.groupBy("chunk").agg(F.collect_list(F.struct("row", "start", "end")).alias("spans")), "suffix-spans")

    def finish(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for content, own in zip(batch.column("content"), batch.column("spans").to_pylist()):
                ids, all_texts, carried = kmers.unpacked(content.as_py())
                by_row: dict[int, list] = {}
                for span in own or []:
                    by_row.setdefault(span["row"], []).append(span)
                out: list[tuple] = []
                for row, raw in enumerate(all_texts):
                    kept, cuts = raw, []
                    if row in by_row:
                        gone = kmers.covered(len(raw), by_row[row])
                        edge = np.flatnonzero(np.diff(np.concatenate([[False], gone, [False]])))
                        cuts = list(zip(edge[::2].tolist(), edge[1::2].tolist()))
                        kept = np.frombuffer(raw, dtype=np.uint8)[~gone].tobytes()
                    line = (None if ids[row] == NO_ID else int(ids[row]), len(raw), len(raw) - len(kept), len(cuts), hashlib.sha256(kept).hexdigest())
                    out.append(line + (kept.decode(errors="ignore"), [{"start": a, "end": b} for a, b in cuts]) if texts else line)
                types = [pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))]
                names = ["id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "kept_text", "removed"]
                columns = [pa.array(x, t) for x, t in zip(zip(*out), types)]
                names = names[: len(columns)]
                if carried is not None:
                    batch = pa.ipc.open_stream(carried).read_next_batch()
                    columns, names = [*columns, *batch.columns], [*names, *batch.schema.names]
                yield pa.RecordBatch.from_arrays(columns, names)

    schema = "id bigint, n_bytes bigint, n_removed bigint, n_spans bigint, kept_sha256 string" + ", kept_text string, removed array<struct<start: bigint, end: bigint>>" * texts
    schema += "".join(f", carried_{i} {docs.schema[c].dataType.simpleString()}" for i, c in enumerate(carry))
    out = chunks.join(lists, "chunk", "left").mapInArrow(finish, schema)
    return out.withColumnsRenamed({"id": id_col} | {f"carried_{i}": c for i, c in enumerate(carry)})
