"""Toxicity scores of texts whose words may be disguised: noisy-channel restoring, then a linear model of the restored words.

Restoring. A disguised token is a lattice: a sign that looks like letters may be any of them or itself, a letter repeated three times or
more may stand for one or two, a separator between single characters may end a word or mean nothing. ``Decoder`` finds the
lattice's best path by Viterbi search, where a path's value is the channel's log-probability of its choices plus that of its letters under
a character trigram model. The model (64 symbols: word boundary, Latin letters, any other letter) is counted over all texts; its
262,144 sums are what the driver reads. Tokens without such signs have one path and are not searched.

Scoring. A document is the set of its restored words and their prefixes of four to seven letters. Features that stand in toxic training
texts significantly more often than their share (``least_z`` standard deviations, ``least_toxic`` texts) enter a logistic
regression with a small penalty; the score is its probability. The fit uses at most ``fit_docs`` distinct labelled texts, those of least
hash; the bound is a parameter, so the model and its features are bounded too. Labels, language, source and ids are no features.

Defined results: a null text counts as empty, an empty text has the score of the intercept; null labels are none; the labels of an id are
read by their maximum; rows without id have no label and are not held out; rows that share an id are scored row by row; without any
label of one of the two classes the score is the share of toxic labels, 0 without labels; an empty table gives an empty result;
other columns are not read. Texts are decoded and scored whole.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import CountVectorizerModel
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hourgrain.llm.common import cut_lineage, hinted, row_batches, stored

#: Letters with a symbol of their own, and the letters that a sign may stand for.
LETTERS = "abcdefghijklmnopqrstuvwxyzàáâãäåæçèéêëìíîïñòóôõöøùúûüýßœ"
LOOKS = {"0": "o", "1": "il", "3": "e", "4": "a", "5": "s", "7": "t", "8": "b", "@": "a", "$": "s", "!": "i", "|": "li", "+": "t", "€": "e", "£": "l"}
OTHER = 63
#: Log-probabilities of the channel: a sign for a letter, a sign for itself, a repeated letter for one or two, a separator for a word's end.
SIGN, ITSELF, REPEATED, ENDS = -1.5, -6.0, -1.0, -1.0
#: Weight of the shorter context in the trigram model, in counts.
BACKOFF = 5.0

BATCH_BYTES = 2 << 20
PIECE = 1 << 20
REMEMBERED = 200_000
PREFIXES = (4, 5, 6, 7)

SYMBOLS = np.zeros(1 << 16, dtype=np.int64)
for _i in range(1 << 16):
    if chr(_i).isalpha():
        SYMBOLS[_i] = OTHER
for _i, _x in enumerate(LETTERS, start=1):
    SYMBOLS[ord(_x)] = _i

_SIGNS = re.escape("".join(LOOKS))
WORDS = re.compile(r"[^\W\d_]+").findall
#: What may be disguised: a sign beside a letter, a letter three times, four single characters between separators.
DISGUISED = re.compile(rf"[^\W\d_][{_SIGNS}]|[{_SIGNS}][^\W\d_]|([^\W\d_])\1\1|(?:^|[^\w])[\w{_SIGNS}](?:[^\w][\w{_SIGNS}]){{3}}(?:[^\w]|$)").search
#: Marks before a token, and after it (read backwards), that stand for no letter: ordinary punctuation, and any sign three times or more.
BEFORE = re.compile(r"(?:[^\w@$!|+€£]|([@$!|+€£])\1\1++)+").match
AFTER = re.compile(r"(?:[^\w@$|+€£]|([@$|+€£])\1\1++)+").match
SPACE = re.compile(r"\S\S\s").finditer


def symbols(text: str) -> np.ndarray:
    """The text's symbols, boundaries not repeated, one at either end."""
    points = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), "<u4")
    found = np.concatenate([[0], np.where(points < 1 << 16, SYMBOLS[points & 0xFFFF], 0), [0]])
    return found[np.concatenate([[True], (found[1:] != 0) | (found[:-1] != 0)])]


def bare(token: str) -> str:
    """The token without the marks around it."""
    if found := BEFORE(token):
        token = token[found.end() :]
    if found := AFTER(token[::-1]):
        token = token[: len(token) - found.end()]
    return token


def trigrams(text: str) -> np.ndarray:
    """Codes of the text's trigrams; what follows a boundary is counted after two of them."""
    s = symbols(text)
    s = np.concatenate([[0], s])
    first = np.where(s[1:-1] == 0, 0, s[:-2])
    own = first * 4096 + s[1:-1] * 64 + s[2:]
    return own[(s[1:-1] != 0) | (s[2:] != 0)]


def pieces(text: str, size: int = PIECE) -> Iterator[str]:
    """The text in pieces of about ``size`` characters, cut after a word of two letters or more, so that no spaced word is cut."""
    at = 0
    while len(text) - at > size:
        cut = next((m.end() for m in SPACE(text, at + size)), len(text))
        yield text[at:cut]
        at = cut
    yield text[at:]


def letter_counts(texts: DataFrame) -> np.ndarray:
    """Trigram counts over all rows (text), summed in the tasks and then by Spark."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(64**3, dtype=np.int64)
        for batch in row_batches(batches, "text", BATCH_BYTES):
            for text in batch.column("text").to_pylist():
                for piece in pieces(text or ""):
                    total += np.bincount(trigrams(piece.lower()), minlength=64**3)
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at.astype(np.int32)), pa.array(total[at])], ["code", "n"])

    sums = texts.mapInArrow(run, "code int, n bigint").groupBy("code").agg(F.sum("n").alias("n")).toPandas()  # 64 ** 3 rows at most
    total = np.zeros(64**3)
    total[sums["code"].to_numpy(np.int64)] = sums["n"].to_numpy(np.float64)
    return total


def letter_model(counts: np.ndarray) -> np.ndarray:
    """Log-probabilities of a symbol after two others, interpolated with shorter contexts."""
    c3 = counts.reshape(64, 64, 64)
    c2 = c3.sum(axis=0)
    c1 = c2.sum(axis=0)
    p1 = (c1 + 1.0) / (c1.sum() + 64.0)
    p2 = (c2 + BACKOFF * p1) / (c2.sum(axis=1, keepdims=True) + BACKOFF)
    p3 = (c3 + BACKOFF * p2[None]) / (c3.sum(axis=2, keepdims=True) + BACKOFF)
    return np.log(p3).reshape(-1)


def arcs(token: str, i: int) -> list[tuple[int, str, float]]:
    """Ways on from place ``i``: (place, what is written, log-probability); a space is the end of a word."""
    x = token[i]
    out = []
    run = 1
    if i == 0 or token[i - 1] != x:
        while i + run < len(token) and token[i + run] == x:
            run += 1
    if x.isalpha():
        out.append((i + 1, x, 0.0))
        if run >= 3:
            out += [(i + run, x, REPEATED), (i + run, x + x, REPEATED)]
    elif x in LOOKS:
        out.append((i + 1, " ", ITSELF))
        for letter in LOOKS[x]:
            out.append((i + 1, letter, SIGN))
            if run >= 2:
                out.append((i + run, letter, SIGN + REPEATED))
    else:
        out.append((i + 1, " ", ITSELF if x.isalnum() else ENDS))
        if not x.isalnum():
            out.append((i + 1, "", 0.0))
    return out


class Decoder:
    """Best reading of a token under the channel and the letters' model."""

    def __init__(self, model: np.ndarray):
        self.model = model.tolist()

    def step(self, state: int, value: float, written: str) -> tuple[int, float]:
        """``state``: 64 times the symbol before the last plus the last one; 0 at a word's start."""
        for x in written:
            if x == " ":
                if state:
                    value, state = value + self.model[state * 64], 0
            else:
                s = int(SYMBOLS[ord(x)]) if ord(x) < 1 << 16 else OTHER
                value += self.model[state * 64 + s]
                state = state % 64 * 64 + s
        return state, value

    def best(self, token: str) -> str:
        """The best path's letters, words divided by one space. Ties take the path found first."""
        places: list[dict[int, tuple[float, tuple | None]] | None] = [None] * (len(token) + 1)
        places[0] = {0: (0.0, None)}
        for i in range(len(token)):
            here, places[i] = places[i], None
            if not here:
                continue
            for to, written, cost in arcs(token, i):
                there = places[to]
                if there is None:
                    there = places[to] = {}
                for state, (value, path) in here.items():
                    after, total = self.step(state, value + cost, written)
                    if after not in there or total > there[after][0]:
                        there[after] = (total, (path, written) if written else path)
        ends = [(self.step(state, value, " ")[1], path) for state, (value, path) in places[len(token)].items()]
        path = max(ends, key=lambda end: end[0])[1]
        written = []
        while path is not None:
            path, x = path
            written.append(x)
        return " ".join("".join(reversed(written)).split())


def spaced_runs(tokens: list[str]) -> list[str]:
    """Runs of four or more single-character tokens, each as one token with spaces."""
    alone = [i for i, token in enumerate(tokens) if len(token) == 1]
    runs, start = [], 0
    for k in range(1, len(alone) + 1):
        if k == len(alone) or alone[k] != alone[k - 1] + 1:
            if k - start >= 4:
                runs.append(" ".join(tokens[alone[start] : alone[k - 1] + 1]))
            start = k
    return runs


class Reader:
    """Features of texts; those of a token are remembered in two generations, so that memory stays bounded."""

    def __init__(self, model: np.ndarray, chosen: dict[str, int] | None = None):
        self.decoder, self.chosen = Decoder(model), chosen
        self.young: dict[str, tuple] = {}
        self.old: dict[str, tuple] = {}

    def words(self, token: str) -> list[str]:
        """Restored words of a lower-case token."""
        core = bare(token)
        if core.isalpha() and not DISGUISED(core):
            return [core]
        return WORDS(self.decoder.best(core)) if DISGUISED(core) else WORDS(core)

    def features(self, token: str) -> tuple:
        """The words and prefixes of a token; with ``chosen``, the numbers of those among them."""
        found = self.young.get(token)
        if found is None:
            found = self.old.get(token)
            if found is None:
                names = {name for word in self.words(token) for name in (f"={word}", *(word[:k] for k in PREFIXES if k <= len(word)))}
                found = tuple(names) if self.chosen is None else tuple({self.chosen[x] for x in names if x in self.chosen})
            if len(token) <= 64:
                if len(self.young) >= REMEMBERED:
                    self.old, self.young = self.young, {}
                self.young[token] = found
        return found

    def document(self, text: str | None) -> set:
        """The features of a whole text."""
        out: set = set()
        for piece in pieces(text or ""):
            tokens = piece.lower().split()
            out.update(*map(self.features, set(tokens)), *map(self.features, spaced_runs(tokens)))
        return out


def labelled_sample(rows: DataFrame, labels: DataFrame, fit_docs: int, held_out: int) -> DataFrame:
    """(id, toxic) of at most ``fit_docs`` rows (id, text): one for each distinct labelled training text, those of least hash."""
    known = labels.where("id IS NOT NULL AND toxic IS NOT NULL").groupBy("id").agg(F.max("toxic").cast("int").alias("toxic"))
    known = cut_lineage(known.where(F.pmod(F.crc32(F.col("id").cast("string")), F.lit(4)) != held_out))
    texts = rows.select("id", F.xxhash64("text", F.length("text")).alias("key")).join(hinted(known, known.count()), "id")
    distinct = texts.groupBy("key").agg(F.max_by("id", F.struct("toxic", -F.col("id"))).alias("id"), F.max("toxic").alias("toxic"))
    return cut_lineage(distinct.orderBy(F.xxhash64("key"), "key").limit(fit_docs).select("id", "toxic"))


def fit(rows: DataFrame, sample: DataFrame, letters, penalty: float, least_z: float, least_toxic: int) -> tuple[dict[str, int], np.ndarray, float]:
    """(number of each chosen feature, weights, intercept) from the texts of ``sample``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        reader = Reader(letters.value)
        for batch in row_batches(batches, "text", BATCH_BYTES):
            found = [list(reader.document(text)) for text in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("toxic"), pa.array(found, pa.list_(pa.string()))], ["toxic", "features"])

    n, toxic = sample.agg(F.count("*"), F.coalesce(F.sum("toxic"), F.lit(0))).first()
    if toxic in (0, n):
        return {}, np.zeros(0), math.inf if n and toxic else -math.inf
    texts = rows.join(F.broadcast(sample), "id").dropDuplicates(["id"]).select("text", "toxic")  # the sample is bounded
    found = stored(texts.mapInArrow(run, "toxic int, features array<string>"), "toxicity-features")
    each = lambda df: df.select("toxic", F.explode("features").alias("feature"))
    often = cut_lineage(each(found.where("toxic = 1")).groupBy("feature").agg(F.count("*").alias("t")).where(F.col("t") >= least_toxic))
    counted = each(found).join(hinted(often, often.count()), "feature").groupBy("feature").agg(F.first("t").alias("t"), F.count("*").alias("n"))
    share = toxic / n
    z = (F.col("t") - F.col("n") * share) / F.sqrt(F.col("n") * share * (1 - share))
    names = [r.feature for r in counted.where(z >= least_z).select("feature").orderBy("feature").collect()]  # from a bounded sample
    if not names:
        return {}, np.zeros(0), math.log(toxic / (n - toxic))
    vectors = CountVectorizerModel.from_vocabulary(names, "features", "v").setBinary(True).transform(found).select(F.col("toxic").cast("double").alias("toxic"), "v")
    model = LogisticRegression(featuresCol="v", labelCol="toxic", regParam=penalty / n, standardization=False, maxIter=200).fit(cut_lineage(vectors))
    return {name: i for i, name in enumerate(names)}, model.coefficients.toArray(), float(model.intercept)


def scores(docs: DataFrame, labels: DataFrame, threshold: float = 0.3, held_out: int = 2, fit_docs: int = 12_000, penalty: float = 0.3, least_z: float = 4.0, least_toxic: int = 3,
           id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic") -> DataFrame:
    """One row per row of ``docs``: id, held_out (crc32 of the id modulo 4), score, predicted."""
    rows = docs.select(docs[id_col].cast("bigint").alias("id"), docs[text_col].cast("string").alias("text"))
    marks = labels.select(labels[id_col].cast("bigint").alias("id"), labels[label_col].alias("toxic"))
    context = docs.sparkSession.sparkContext
    letters = context.broadcast(letter_model(letter_counts(rows.select("text"))).astype(np.float32))
    model = context.broadcast(fit(rows, labelled_sample(rows, marks, fit_docs, held_out), letters, penalty, least_z, least_toxic))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        chosen, weights, intercept = model.value
        reader = Reader(letters.value, chosen)
        for batch in row_batches(batches, "text", BATCH_BYTES):
            sums = [intercept + sum(weights[i] for i in sorted(reader.document(text))) for text in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array([1 / (1 + math.exp(-max(-700.0, min(700.0, x)))) for x in sums], pa.float64())], ["id", "score"])

    out = rows.mapInArrow(run, "id bigint, score double")
    return out.select(
        F.col("id").alias(id_col), F.coalesce(F.pmod(F.crc32(F.col("id").cast("string")), F.lit(4)) == held_out, F.lit(False)).alias("held_out"),
        "score", (F.col("score") >= threshold).cast("int").alias("predicted"),
    )
