"""Fill-in-the-middle transformation of texts, cut at unit boundaries, with a sparse index between characters and bytes.

Texts stay UTF-8 bytes. ``ByteIndex`` records only the multibyte characters: where each starts and how many bytes it has beyond
one. A byte offset minus the excess before it is a character offset, and the other way round; the excess comes from one
``searchsorted`` in the record, and where a text is ASCII the record is empty and both offsets are the same number.

A unit is a run of A-Z and a-z or any other single character. Two hashes choose the cuts among the ``n + 1`` unit boundaries, two
more the form: ``plain`` (the text), ``psm`` (``<P>`` prefix ``<S>`` suffix ``<M>`` middle) or ``spm`` (``<S>`` suffix ``<P>`` prefix
``<M>`` middle). Empty texts and texts that contain a mark stay plain, so an output always parses back in one way.

Defined results: a null text counts as empty; a null id hashes as an empty string; repeated rows and ids are transformed row by row;
an empty table gives an empty result; other columns are not read. Texts are cut whole; tasks hold a batch of texts at a time and
nothing is shuffled.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from hourgrain.llm.common import row_batches

PREFIX, SUFFIX, MIDDLE = b"<P>", b"<S>", b"<M>"
BATCH_BYTES = 4 << 20
#: Units are searched in slices of so many bytes, so that the arrays of a long text stay small.
SLICE = 1 << 20

LETTER = np.zeros(256, dtype=bool)
LETTER[[*range(65, 91), *range(97, 123)]] = True


class ByteIndex:
    """Character and byte offsets of UTF-8 bytes, by their multibyte characters alone."""

    def __init__(self, raw: bytes):
        self.n_bytes = len(raw)
        found, excess = [], []
        if not raw.isascii():
            data = np.frombuffer(raw, np.uint8)
            for at in range(0, len(data), SLICE):
                part = data[at : at + SLICE]
                own = np.flatnonzero(part >= 0xC0)
                lead = part[own]
                found.append(own + at)
                excess.append(1 + (lead >= 0xE0).astype(np.int64) + (lead >= 0xF0))
        self.byte_at = np.concatenate(found) if found else np.zeros(0, dtype=np.int64)
        self.excess = np.concatenate([[0], np.cumsum(np.concatenate(excess))]) if excess else np.zeros(1, dtype=np.int64)
        self.char_at = self.byte_at - self.excess[:-1]
        self.n_chars = self.n_bytes - int(self.excess[-1])

    def chars(self, byte: int) -> int:
        """Characters before the byte offset of a character's start."""
        return byte - int(self.excess[np.searchsorted(self.byte_at, byte)])

    def bytes(self, char: int) -> int:
        """Bytes before the character offset."""
        return char + int(self.excess[np.searchsorted(self.char_at, char)])


def unit_starts(raw: bytes) -> Iterator[tuple[int, np.ndarray]]:
    """(offset, starts relative to it) of the units, slice by slice."""
    data, before = np.frombuffer(raw, np.uint8), False
    for at in range(0, len(data), SLICE):
        part = data[at : at + SLICE]
        letter = LETTER[part]
        start = (part & 0xC0) != 0x80  # no continuation byte
        start[1:] &= ~(letter[1:] & letter[:-1])
        start[0] &= not (letter[0] and before)
        before = bool(letter[-1])
        yield at, np.flatnonzero(start).astype(np.int32)


def cuts(raw: bytes, choose: tuple[int, int]) -> tuple[int, int, int]:
    """Number of units and the byte offsets after ``choose % (n + 1)`` units, the smaller one first."""
    found = list(unit_starts(raw))
    upto = np.cumsum([len(x) for _, x in found]) if found else np.zeros(1, dtype=np.int64)
    n = int(upto[-1])

    def offset(unit: int) -> int:
        if unit == n:
            return len(raw)
        k = int(np.searchsorted(upto, unit, side="right"))
        at, starts = found[k]
        return at + int(starts[unit - (upto[k] - len(starts))])

    a, b = sorted(x % (n + 1) for x in choose)
    return n, offset(a), offset(b)


def hashes(doc_id: int | None, seed: int) -> tuple[int, ...]:
    """The first four 32-bit numbers of the hash of ``seed:id``."""
    digest = hashlib.sha256(f"{seed}:{'' if doc_id is None else doc_id}".encode()).digest()
    return tuple(int.from_bytes(digest[i : i + 4], "big") for i in (0, 4, 8, 12))


def transform(raw: bytes, h: tuple[int, ...], plain_from: int = 90, spm_below: int = 20) -> tuple[int, str, int | None, int | None, bytes]:
    """(units, form, prefix_chars, middle_chars, output)."""
    n, a, b = cuts(raw, h[:2])
    if not raw or any(mark in raw for mark in (PREFIX, SUFFIX, MIDDLE)) or h[2] % 100 >= plain_from:
        return n, "plain", None, None, raw
    index = ByteIndex(raw)
    prefix, middle = index.chars(a), index.chars(b) - index.chars(a)
    form = "spm" if h[3] % 100 < spm_below else "psm"
    parts = (SUFFIX, raw[b:], PREFIX, raw[:a]) if form == "spm" else (PREFIX, raw[:a], SUFFIX, raw[b:])
    return n, form, prefix, middle, b"".join([*parts, MIDDLE, raw[a:b]])


def restore(output: bytes, form: str) -> bytes:
    """The text that ``transform`` was given."""
    if form == "plain":
        return output
    inner = SUFFIX if form == "psm" else PREFIX
    first, _, rest = output[3:].partition(inner)
    second, _, middle = rest.partition(MIDDLE)
    prefix, suffix = (first, second) if form == "psm" else (second, first)
    return prefix + middle + suffix


def fill_in_middle(docs: DataFrame, seed: int = 1, id_col: str = "doc_id", text_col: str = "text", outputs: bool = True) -> DataFrame:
    """One row per row of ``docs``: id, n, form, prefix_chars, middle_chars, output_sha256, restored_sha256 and, with ``outputs``, output."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in row_batches(batches, "text", BATCH_BYTES):
            columns: list[list] = [[] for _ in range(7)]
            for doc_id, raw in zip(batch.column("id").to_pylist(), batch.column("text").to_pylist()):
                n, form, prefix, middle, output = transform(raw or b"", hashes(doc_id, seed))
                digests = (hashlib.sha256(x).hexdigest() for x in (output, restore(output, form)))
                for column, value in zip(columns, (n, form, prefix, middle, *digests, output)):
                    column.append(value)
            kinds = [pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string()][: 6 + outputs]
            arrays = [pa.array(x, pa.binary()).cast(kind) if i == 6 else pa.array(x, kind) for i, (x, kind) in enumerate(zip(columns, kinds))]
            yield pa.RecordBatch.from_arrays([batch.column("id"), *arrays], names[: 7 + outputs])

    names = ["id", "n", "form", "prefix_chars", "middle_chars", "output_sha256", "restored_sha256", "output"]
    schema = "id bigint, n bigint, form string, prefix_chars bigint, middle_chars bigint, output_sha256 string, restored_sha256 string" + ", output string" * outputs
    rows = docs.select(docs[id_col].cast("bigint").alias("id"), docs[text_col].cast("string").cast("binary").alias("text"))
    return rows.mapInArrow(run, schema).withColumnRenamed("id", id_col)
