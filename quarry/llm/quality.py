"""Quality classifier: weak labels from overlapping heuristics, a hashed linear scorer trained on their posteriors."""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from operator import eq

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import stored

#: Most texts that the scorer is fitted on; the labellers' accuracies are estimated over all.
SAMPLE = 6_000
WEIGHTS = 1 << 14
SLICE = 128
#: Words of a window in which distinct words are counted.
SPAN = 1000
BAD, GOOD, NONE = 0, 1, 2


def _classes() -> bytes:
    """A for upper-case letters, a for other letters (all bytes of non-ASCII characters), 0 for digits, a blank for white space."""
    out = bytearray(range(256))
    for i in range(256):
        c = chr(i)
        out[i] = ord("A") if "A" <= c <= "Z" else ord("a") if "a" <= c <= "z" or i > 127 else ord("0") if c.isdigit() else ord(" ") if i <= 32 else i
    return bytes(out)


CLASSES = _classes()


def shape(text: str) -> tuple[np.ndarray, list[bytes], list[str]]:
    """Class bytes of a text, the shapes of its words (runs of a class as one), its words."""
    b = np.frombuffer(text.encode("utf-8", "surrogatepass").translate(CLASSES), np.uint8)
    runs = b[np.append(True, b[1:] != b[:-1])] if len(b) else b
    return b, runs.tobytes().split(), text.split()


def distinct_share(words: list[str]) -> float:
    """Mean share of distinct words over consecutive windows of SPAN words (the last may be shorter), so that a text's length
    makes no difference; each window weighs by its words."""
    return sum(len(set(words[i : i + SPAN])) for i in range(0, len(words), SPAN)) / max(1, len(words))


def votes(text: str) -> list[int]:
    """What each labeller says: BAD, GOOD or NONE. A labeller compares one measure with two thresholds."""
    b, shapes, words = shape(text)
    n, counts = max(1, len(shapes)), np.bincount(b, minlength=128)
    letters = max(1, int(counts[ord("A")] + counts[ord("a")]))
    marks = int(counts[33:48].sum() + counts[58:65].sum() + counts[91:97].sum() + counts[123:127].sum() - counts[ord(".")] - counts[ord(",")])
    plain = sum(s in PLAIN for s in shapes)

    def vote(x: float, good: float, bad: float) -> int:
        return (GOOD if x <= good else BAD if x >= bad else NONE) if good < bad else (GOOD if x >= good else BAD if x <= bad else NONE)

    few = len(words) < 20
    return [
        vote(marks / max(1, len(b)), 0.02, 0.06),
        vote(int(counts[ord("A")]) / letters, 0.12, 0.3),
        vote(sum(1 for s in shapes if not (b"a" in s or b"A" in s or b"0" in s)) / n, 0.02, 0.12),
        NONE if few else vote(sum(map(eq, words, words[1:])) / n, 0.02, 0.15),
        vote(int(counts[ord("!")]) / n, 0.05, 0.3),
        vote(plain / n, 0.85, 0.6),
        NONE if few else vote(distinct_share(words), 0.45, 0.25),
    ]


PLAIN = {b"a", b"Aa", b"A", b"a.", b"a,", b"Aa,", b"Aa.", b"0", b"0.", b"0,", b"A.", b"A,", b"a'a", b"a-a", b"Aa-Aa", b"a;", b"a:", b"a?", b"a!"} - {b"A", b"A.", b"A,"}
LABELLERS = 7


def estimate(patterns: np.ndarray, counts: np.ndarray, rounds: int = 100) -> tuple[np.ndarray, float, np.ndarray]:
    """Expectation-maximisation: from vote patterns and how often each occurs, each labeller's distribution of votes given the
    class, the share of good rows, and each pattern's probability of being good. A labeller knows one defect, so the start calls
    a pattern with any vote for bad probably bad."""
    post = np.where((patterns == BAD).any(axis=1), 0.1, 0.9)
    for _ in range(rounds):
        share = float(np.clip((post * counts).sum() / counts.sum(), 0.02, 0.98))
        table = np.empty((2, patterns.shape[1], 3))
        for c, w in ((0, (1 - post) * counts), (1, post * counts)):
            for v in range(3):
                table[c, :, v] = ((patterns == v) * w[:, None]).sum(axis=0) + 0.5
        table /= table.sum(axis=2, keepdims=True)
        k = np.arange(patterns.shape[1])
        odds = np.log(share / (1 - share)) + np.log(table[1, k, patterns] / table[0, k, patterns]).sum(axis=1)
        new = 1 / (1 + np.exp(-np.clip(odds, -40, 40)))
        if np.abs(new - post).max() < 1e-7:
            break
        post = new
    return table, share, post


def features(text: str, memo: dict) -> tuple[np.ndarray, np.ndarray]:
    """Hashed features, with their shares: word shapes, pairs of them, repeated words."""
    _, shapes, words = shape(text)
    if not shapes:
        return np.array([], np.int64), np.array([])
    ids = []
    for s in shapes:
        i = memo.get(s)
        if i is None:
            i = zlib.crc32(s)
            if len(memo) < 50_000:
                memo[s] = i
        ids.append(i)
    one = np.array(ids, np.uint64)
    two = (one[:-1] * np.uint64(0x9E3779B1) + one[1:] * np.uint64(0x85EBCA77)) >> np.uint64(7)
    again = sum(map(eq, words, words[1:]))
    spots, shares = np.unique(np.concatenate([one, two]) % np.uint64(WEIGHTS - 2), return_counts=True)
    return np.append(spots.astype(np.int64), [WEIGHTS - 2]), np.append(shares / len(shapes), again / len(shapes) * 10)


def fit(rows: list[tuple[np.ndarray, np.ndarray]], target: np.ndarray, rounds: int = 500, rate: float = 0.5, decay: float = 1e-5) -> np.ndarray:
    """Weights of a logistic scorer for soft targets, by full-batch AdaGrad; the last weight is the bias."""
    at = np.concatenate([r[0] for r in rows])
    x = np.concatenate([r[1] for r in rows])
    row = np.repeat(np.arange(len(rows)), [len(r[0]) for r in rows])
    used, at = np.unique(at, return_inverse=True)
    w, bias, g2, b2 = np.zeros(len(used)), 0.0, np.full(len(used), 1e-8), 1e-8
    mean = np.clip(target.mean(), 0.02, 0.98)
    weight = np.where(target > 0.5, 0.5 / mean, 0.5 / (1 - mean))
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(np.bincount(row, x * w[at], len(rows)) + bias, -40, 40)))
        e = (p - target) * weight / len(rows)
        g = np.bincount(at, e[row] * x, len(used)) + decay * w
        g2 += g * g
        b2 += e.sum() ** 2
        w -= rate * g / np.sqrt(g2)
        bias -= rate * e.sum() / np.sqrt(b2)
    out = np.zeros(WEIGHTS)
    out[used] = w
    out[-1] = bias
    return out


def train(docs: DataFrame, sample: int = SAMPLE) -> np.ndarray | None:
    """The scorer's weights; None where no text has a word.

    The labellers vote on all texts. The scorer's texts are drawn by a hash of id and text, so neither null nor repeated ids
    bring all rows or none; a draw that finds none, which takes rows that are all alike, is repeated with a wider bound.
    """

    def voted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            codes = [sum(v * 3**k for k, v in enumerate(votes(t))) if t.strip() else -1 for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(codes, pa.int32())], ["spot", "code"])

    def made(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        memo: dict = {}
        for batch in batches:
            codes = [sum(v * 3**k for k, v in enumerate(votes(t))) for t in batch.column(1).to_pylist()]
            found = [features(t, memo) for t in batch.column(1).to_pylist()]
            at, x = ([f[i].astype(kind).tobytes() for f in found] for i, kind in ((0, "<i4"), (1, "<f8")))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(codes, pa.int32()), pa.array(at, pa.binary()), pa.array(x, pa.binary())], ["spot", "code", "at", "x"])

    text = F.coalesce(docs["text"], F.lit(""))
    slim = docs.select(F.xxhash64(docs["doc_id"].cast("long"), text, F.lit("quality")).alias("spot"), text.alias("text"))
    codes = slim.mapInArrow(voted, "spot long, code int").where("code >= 0").groupBy("code").count().toPandas()  # 3 ** LABELLERS rows at most
    if not len(codes):
        return None
    patterns = np.array([[c // 3**k % 3 for k in range(LABELLERS)] for c in codes["code"]])
    counts = codes["count"].to_numpy(float)
    _, _, post = estimate(patterns, counts)
    good = dict(zip(codes["code"], post))
    share, rows, target = 1.1 * sample / counts.sum(), [], []
    while not rows:
        bound = min(-(2**63) + int(2**64 * min(1.0, share)) - 1, 2**63 - 1)
        chosen = slim.where((F.col("spot") <= F.lit(bound)) & (F.length(F.trim("text")) > 0)).mapInArrow(made, "spot long, code int, at binary, x binary").orderBy("spot", "code", "at").limit(sample).toArrow()
        for code, at, x in zip(*(chosen.column(i) for i in (1, 2, 3))):
            if len(at.as_py()):
                rows.append((np.frombuffer(at.as_py(), "<i4").astype(np.int64), np.frombuffer(x.as_py(), "<f8")))
                target.append(good.get(code.as_py(), 0.5))
        if share >= 1:
            break
        share *= 16
    return fit(rows, np.array(target)) if rows else None


def score(docs: DataFrame, weights: np.ndarray | None, threshold: float = 0.5) -> DataFrame:
    """docs with quality (0 to 1) and accepted added: of a text without words 0 and false, and of all texts where weights are
    None, as nothing was fitted. Other columns stay, those named so are replaced."""
    from pyspark.sql import types as T

    docs = docs.drop("quality", "accepted")
    schema = T.StructType([*docs.schema.fields, T.StructField("quality", T.DoubleType())])
    if weights is None:
        return docs.withColumn("quality", F.lit(0.0)).withColumn("accepted", F.lit(False))
    w = weights

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        memo: dict = {}
        for batch in batches:
            for at in range(0, batch.num_rows, SLICE):
                part = batch.slice(at, SLICE)
                out = []
                for text in part.column(part.schema.get_field_index("text")).to_pylist():
                    i, x = features(text or "", memo)
                    out.append(float(1 / (1 + np.exp(-np.clip(w[i] @ x + w[-1], -40, 40)))) if len(i) else 0.0)
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(out, pa.float64())], [*part.schema.names, "quality"])

    return docs.mapInArrow(run, schema).withColumn("accepted", (F.col("quality") >= threshold) & (F.col("quality") > 0))


def classify(docs: DataFrame, sample: int = SAMPLE, threshold: float = 0.5) -> DataFrame:
    """docs with quality and accepted added.

    Seven heuristics each call a text bad or good or say nothing, over all rows; expectation-maximisation over the counts of
    their vote patterns gives each one's accuracy and each pattern's posterior. A linear scorer over hashed word shapes is
    fitted to the posteriors of `sample` texts (those whose hash of doc_id and text is smallest) and scores every whole text. A null
    text, and one of white space only, has quality 0 and isn't accepted. Repeated rows get the same score; null or repeated ids change nothing.
    An empty table gives no rows.
    """
    return score(docs, train(docs, sample), threshold)
