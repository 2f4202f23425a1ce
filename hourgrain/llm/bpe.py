"""Byte-level BPE encoding and decoding with a segment tree over the ranks of adjacent pairs.

``encode`` takes documents to token ids and back to text. The tokenizer file is a parameter and is read by the driver
once; executors get its tables with the function (their size is that of the vocabulary, never of the data).

Defined results: a null text counts as empty and gives no ids; an empty text gives no ids and decodes to the empty
text; repeated rows and repeated or null ids are encoded row by row; an empty table gives an empty result. Only the named id
and text columns are read, so further columns, whatever their names, change nothing. Texts are never cut: a text is a
sequence of pre-tokens, and one of n symbols costs n log n steps however long it is.
"""

from __future__ import annotations

import hashlib
import json
import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from hourgrain.llm.common import MEMORIES

#: Fixed value: the pattern of byte-level pre-tokens that the tokenizer file names by ``use_regex``.
BYTE_LEVEL_PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"

#: Pre-tokens whose ids a worker remembers; beyond this it starts anew.
REMEMBERED = 300_000
#: Children of an inner node of the segment tree, and the key of a leaf without a mergeable pair.
FAN, NO_PAIR = 32, 1 << 62
BATCH_BYTES = 4 << 20


def byte_letters() -> list[str]:
    """The printable letter that stands for each byte: printable Latin-1 stands for itself, the rest from 256 on."""
    plain = {*range(33, 127), *range(161, 173), *range(174, 256)}
    rest = iter(range(256, 512))
    return [chr(b) if b in plain else chr(next(rest)) for b in range(256)]


def least_rank_merges(ids: list[int], ranks: dict[int, int], merged: list[int]) -> list[int]:
    """Apply merges until no adjacent pair has a rank, always the lowest rank first and the leftmost among equals.

    ``ranks``: pair, as ``left << 24 | right``, -> rank; ``merged``: rank -> id of the merged symbol. Leaf ``i`` of the
    segment tree holds the key of the pair that starts at symbol ``i``: its rank times the number of symbols plus
    ``i``, so the minimum at the root is the lowest rank and, among equal ranks, the leftmost pair. Every inner node is
    the minimum of ``FAN`` children; a merge changes three leaves, and each change climbs one node per level.
    """
    n = len(ids)
    if n < 2:
        return ids
    get = ranks.get
    keys = []
    at, left = 0, ids[0]
    for right in ids[1:]:
        rank = get(left << 24 | right)
        keys.append(NO_PAIR if rank is None else rank * n + at)
        left = right
        at += 1
    tree = [keys]
    while len(tree[-1]) > FAN:
        below = tree[-1]
        tree.append([min(below[i : i + FAN]) for i in range(0, len(below), FAN)])
    top, deep = tree[-1], len(tree) > 1
    key = min(top)
    if key == NO_PAIR:
        return ids
    ids = list(ids)
    after, before = list(range(1, n + 1)), list(range(-1, n - 1))
    keys.append(NO_PAIR)
    while key != NO_PAIR:
        rank, i = divmod(key, n)
        j = after[i]
        whole = ids[i] = merged[rank]
        ids[j] = -1
        k = after[i] = after[j]
        keys[j] = NO_PAIR
        if k < n:
            before[k] = i
            rank = get(whole << 24 | ids[k])
            keys[i] = NO_PAIR if rank is None else rank * n + i
        else:
            keys[i] = NO_PAIR
        h = before[i]
        if h >= 0:
            rank = get(ids[h] << 24 | whole)
            keys[h] = NO_PAIR if rank is None else rank * n + h
        if deep:
            for level in range(1, len(tree)):
                below, nodes = tree[level - 1], tree[level]
                for at in {i // FAN**level, j // FAN**level, max(h, 0) // FAN**level}:
                    if at < len(nodes):
                        nodes[at] = min(below[at * FAN : at * FAN + FAN])
        key = min(top)
    return [x for x in ids if x >= 0]


class Vocabulary:
    """Tables of a tokenizer file: ids of strings, ranked pairs, added tokens."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            file = json.load(f)
        model = file["model"]
        self.ids: dict[str, int] = model["vocab"]
        self.suffix: str = model.get("end_of_word_suffix") or ""
        self.added: dict[str, int] = {x["content"]: x["id"] for x in file["added_tokens"]}
        self.ranks: dict[int, int] = {}
        self.merged: list[int] = []
        for rank, merge in enumerate(model["merges"]):
            left, right = merge if isinstance(merge, list) else merge.split(" ")
            self.ranks[self.ids[left] << 24 | self.ids[right]] = rank
            self.merged.append(self.ids[left + right])

    def split_added(self):
        """A pattern that matches the added tokens in raw text, or None."""
        return regex.compile("|".join(regex.escape(x) for x in sorted(self.added, key=len, reverse=True))) if self.added else None


class ByteBPE(dict):
    """Encoder and decoder of a byte-level vocabulary; a map from pre-tokens to their ids as little-endian 32-bit bytes."""

    def __init__(self, vocabulary: Vocabulary):
        super().__init__()
        letters = byte_letters()
        self.vocabulary = vocabulary
        self.start = [vocabulary.ids[x] for x in letters]
        back = {x: b for b, x in enumerate(letters)}
        size = max([*vocabulary.ids.values(), *vocabulary.added.values()]) + 1
        self.strings: list[bytes] = [b""] * size
        for text, i in vocabulary.ids.items():
            self.strings[i] = bytes(back[x] for x in text) if all(x in back for x in text) else text.encode()
        for text, i in vocabulary.added.items():
            self.strings[i] = text.encode()
        self.pieces = regex.compile(BYTE_LEVEL_PATTERN).findall
        self.added = vocabulary.split_added()

    def __missing__(self, piece: str) -> bytes:
        ids = least_rank_merges([*map(self.start.__getitem__, piece.encode())], self.vocabulary.ranks, self.vocabulary.merged)
        packed = struct.pack(f"<{len(ids)}I", *ids)
        if len(piece) <= 64:
            if len(self) >= REMEMBERED:
                self.clear()
            self[piece] = packed
        return packed

    def plain(self, text: str) -> bytes:
        return b"".join(map(self.__getitem__, self.pieces(text)))

    def encode(self, text: str) -> bytes:
        """Packed ids of the text; added tokens that stand in it become their own ids, as is the library's default."""
        if self.added is None:
            return self.plain(text)
        parts, at = [], 0
        for match in self.added.finditer(text):
            parts += [self.plain(text[at : match.start()]), struct.pack("<I", self.vocabulary.added[match.group()])]
            at = match.end()
        return b"".join([*parts, self.plain(text[at:])])

    def decode(self, packed: bytes) -> str:
        return b"".join(map(self.strings.__getitem__, np.frombuffer(packed, "<u4").tolist())).decode("utf-8", errors="replace")


_LOADED: dict[str, object] = {}
MEMORIES.append(_LOADED)


def loaded(kind: type, key: str, vocabulary: Vocabulary):
    """The worker's encoder; kept between tasks so that its remembered pre-tokens serve the next one."""
    if key not in _LOADED:
        _LOADED[key] = kind(vocabulary)
    return _LOADED[key]


def encode(docs: DataFrame, tokenizer: str, id_col: str = "doc_id", text_col: str = "text", outputs: bool = True) -> DataFrame:
    """One row per row of ``docs``: id, n_tokens, ids_sha256, decoded_sha256 and, with ``outputs``, ids and decoded text.

    ``ids_sha256`` is over the ids as little-endian unsigned 32-bit integers, ``decoded_sha256`` over the UTF-8 bytes of
    the text decoded from the ids. The work is one pass without a shuffle; tasks hold a batch of texts at a time.
    """
    from hourgrain.llm.common import row_batches

    vocabulary = docs.sparkSession.sparkContext.broadcast(Vocabulary(tokenizer))
    key = f"byte {tokenizer}"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = loaded(ByteBPE, key, vocabulary.value)
        for batch in row_batches(batches, "text", BATCH_BYTES):
            counts, digests, decoded_digests, all_ids, texts = [], [], [], [], []
            for text in batch.column("text").to_pylist():
                ids = bpe.encode(text or "")
                back = bpe.decode(ids)
                counts.append(len(ids) // 4)
                digests.append(hashlib.sha256(ids).hexdigest())
                decoded_digests.append(hashlib.sha256(back.encode()).hexdigest())
                if outputs:
                    all_ids.append(np.frombuffer(ids, "<i4"))
                    texts.append(back)
            columns = [batch.column("id"), pa.array(counts, pa.int64()), pa.array(digests, pa.string()), pa.array(decoded_digests, pa.string())]
            names = ["id", "n_tokens", "ids_sha256", "decoded_sha256"]
            if outputs:
                columns += [pa.array(all_ids, pa.list_(pa.int32())), pa.array(texts, pa.string())]
                names += ["ids", "decoded"]
            yield pa.RecordBatch.from_arrays(columns, names)

    schema = "id bigint, n_tokens bigint, ids_sha256 string, decoded_sha256 string" + (", ids array<int>, decoded string" if outputs else "")
    rows = docs.select(docs[id_col].cast("bigint").alias("id"), docs[text_col].cast("string").alias("text"))
    return rows.mapInArrow(run, schema).withColumnRenamed("id", id_col)
