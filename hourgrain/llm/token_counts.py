"""Token counts of texts under a lower-casing word BPE, with a whole-token shortcut.

Which strings are one token when they stand alone is proved once on the driver from the tokenizer file alone: every
vocabulary string that ends a word is taken apart into its byte letters and merged again by the file's own ranks; if one id
remains, the string is certain. A pre-token in that table counts one token without any merging; the others are merged
(see ``bpe.least_rank_merges``) and their counts remembered for the worker's lifetime.

Defined results: a null text counts as empty (0 bytes, 0 tokens); repeated rows and repeated or null ids are counted row by
row; an empty table gives an empty result; other columns are not read. Texts are counted whole.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame

from hourgrain.llm.bpe import BATCH_BYTES, REMEMBERED, Vocabulary, byte_letters, least_rank_merges, loaded
from hourgrain.llm.common import row_batches

#: Fixed value: the pattern of word pre-tokens in the tokenizer file; what it does not match is dropped.
WORD_PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"

#: Capitals that the library lower-cases but Python's older character tables do not.
LATE_CAPITALS = {0x1C89: 0x1C8A, 0xA7CB: 0x0264, 0xA7CC: 0xA7CD, 0xA7CE: 0xA7CF, 0xA7D2: 0xA7D3, 0xA7D4: 0xA7D5, 0xA7DA: 0xA7DB, 0xA7DC: 0x019B}
LATE_CAPITALS |= {x: x + 0x20 for x in range(0x10D50, 0x10D66)} | {x: x + 0x1B for x in range(0x16EA0, 0x16EB9)}
_LATE = regex.compile("[" + "".join(map(chr, LATE_CAPITALS)) + "]")


def alone(vocabulary: Vocabulary) -> set[str]:
    """The vocabulary strings, without the end mark, that encode alone as exactly one token."""
    ids, suffix, certain = vocabulary.ids, vocabulary.suffix, set()
    for text, i in ids.items():
        if not text.endswith(suffix) or text == suffix:
            continue
        body = text[: len(text) - len(suffix)]
        letters = [ids.get(x) for x in body[:-1]] + [ids.get(body[-1] + suffix)]
        if None not in letters and least_rank_merges(letters, vocabulary.ranks, vocabulary.merged) == [i]:
            certain.add(body)
    return certain


class Counts(dict):
    """Tokens of a pre-token: certain ones are 1 from the start, others are merged when first met."""

    def __init__(self, vocabulary: Vocabulary, certain: set[str]):
        letters = byte_letters()
        back = {x: b for b, x in enumerate(letters)}
        whole = {}
        for body in certain:
            try:
                whole[bytes(back[x] for x in body).decode()] = 1
            except (KeyError, UnicodeDecodeError):  # not the letters of a whole text: no pre-token can equal it
                continue
        super().__init__(whole)
        self.certain = whole
        self.ranks, self.merged, ids, suffix = vocabulary.ranks, vocabulary.merged, vocabulary.ids, vocabulary.suffix
        self.inner = [ids[x] for x in letters]
        self.last = [ids[x + suffix] for x in letters]
        self.pieces = regex.compile(WORD_PATTERN).findall
        self.added = vocabulary.split_added()

    def __missing__(self, piece: str) -> int:
        raw = piece.encode()
        n = len(least_rank_merges([*(self.inner[b] for b in raw[:-1]), self.last[raw[-1]]], self.ranks, self.merged))
        if len(self) >= len(self.certain) + REMEMBERED:
            self.clear()
            self.update(self.certain)
        if len(piece) <= 64:
            self[piece] = n
        return n

    def plain(self, text: str) -> int:
        if not text:
            return 0
        text = lowered(unicodedata.normalize("NFC", text))
        return sum(map(self.__getitem__, self.pieces(text)))

    def count(self, text: str) -> int:
        if self.added is None or "<|" not in text:
            return self.plain(text)
        parts = self.added.split(text)
        return len(parts) - 1 + sum(map(self.plain, parts))


def lowered(text: str) -> str:
    """Character by character, as the file's normaliser lower-cases: without the rule for a final sigma."""
    if not text.isascii() and _LATE.search(text):
        text = text.translate(LATE_CAPITALS)
    return text.lower() if "Σ" not in text else "σ".join(x.lower() for x in text.split("Σ"))


def token_counts(docs: DataFrame, tokenizer: str, limit: int = 2048, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of ``docs``: id, n_bytes (UTF-8), n_tokens, over_limit (n_tokens > limit). One pass, no shuffle."""
    vocabulary = Vocabulary(tokenizer)
    shared = docs.sparkSession.sparkContext.broadcast((vocabulary, alone(vocabulary)))
    key = f"word {tokenizer}"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = loaded(lambda v: Counts(*v), key, shared.value)
        for batch in row_batches(batches, "text", BATCH_BYTES):
            texts = [x or "" for x in batch.column("text").to_pylist()]
            tokens = [counts.count(x) for x in texts]
            sizes = pc.fill_null(pc.binary_length(batch.column("text")), 0).cast(pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column("id"), sizes, pa.array(tokens, pa.int64()), pa.array([n > limit for n in tokens], pa.bool_())], ["id", "n_bytes", "n_tokens", "over_limit"])

    rows = docs.select(docs[id_col].cast("bigint").alias("id"), docs[text_col].cast("string").alias("text"))
    return rows.mapInArrow(run, "id bigint, n_bytes bigint, n_tokens bigint, over_limit boolean").withColumnRenamed("id", id_col)
