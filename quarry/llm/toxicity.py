"""Toxicity: subword-bag embeddings, averaged, into a linear softmax; embeddings and softmax are trained jointly in numpy."""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import stored

#: Most toxic texts that the model is fitted on (and twice as many others), the rows of its embedding table, and how many of them
#: are trained: those whose shares differ most between the classes, so that few texts aren't learnt by heart by many weights.
SAMPLE, BUCKETS, SIZE, KEPT = 2_500, 1 << 16, 8, 1024
#: Mini-batches, rows of one (half of each class), share of entries left out of each.
STEPS, BATCH, DROP = 1_500, 64, 0.5
SLICE = 128
TOKEN = re.compile(r"[^\W_]+")


def subwords(word: str) -> list[int]:
    """Buckets of a word: itself and its character 3- to 5-grams with marks at both ends."""
    marked = f"<{word}>"
    grams = [marked, *(marked[i : i + n] for n in (3, 4, 5) for i in range(len(marked) - n + 1))]
    return [zlib.crc32(g.encode("utf-8", "surrogatepass")) % BUCKETS for g in grams]


def bag(text: str) -> tuple[np.ndarray, np.ndarray]:
    """Buckets of a text's subwords and the share that each has of them."""
    seen: dict = {}
    for w in TOKEN.findall(text.lower()):
        seen[w] = seen.get(w, 0) + 1
    if not seen:
        return np.array([], np.int64), np.array([], np.float32)
    spots = [np.array(subwords(w)) for w in seen]
    # each word weighs the same, however many subwords it has
    at = np.concatenate(spots)
    x = np.repeat(np.fromiter(seen.values(), float, len(seen)) / [len(s) for s in spots], [len(s) for s in spots])
    at, back = np.unique(at, return_inverse=True)
    return at, (np.bincount(back, x) / sum(seen.values())).astype(np.float32)


def loss(e: np.ndarray, w: np.ndarray, b: np.ndarray, at: np.ndarray, x: np.ndarray, sizes: np.ndarray, labels: np.ndarray) -> tuple:
    """Mean cross-entropy of softmax(mean of e . w + b), and its gradients by e's rows used (with which those are), w and b."""
    starts = np.cumsum(sizes) - sizes
    h = np.add.reduceat(e[at] * x[:, None], starts)
    z = h @ w + b
    p = np.exp(z - z.max(axis=1, keepdims=True))
    p /= p.sum(axis=1, keepdims=True)
    each = np.arange(len(labels))
    value = -np.log(np.maximum(p[each, labels], 1e-12)).mean()
    p[each, labels] -= 1
    p /= len(labels)
    used, back = np.unique(at, return_inverse=True)
    g = np.repeat(p @ w.T, sizes, axis=0) * x[:, None]
    de = np.stack([np.bincount(back, g[:, d], len(used)) for d in range(e.shape[1])], axis=1)
    return value, used, de, h.T @ p, p.sum(axis=0)


def fit(bags: list, labels: np.ndarray, steps: int = STEPS, rate: float = 0.5, drop: float = DROP, seed: int = 7) -> tuple[np.ndarray, float]:
    """Trains embeddings E and softmax (W, b) by AdaGrad with falling steps over a fixed number of mini-batches, half of each class; a
    score is softmax(W . mean of E + b). As the mean is linear, what is kept is each bucket's share of the log-odds,
    E . (W1 - W0), and the bias. Buckets that no bag has keep 0. With one class only the bias is fitted."""
    rng = np.random.default_rng(seed)
    e = np.zeros((BUCKETS, SIZE), np.float32)
    met = np.unique(np.concatenate([b[0] for b in bags]))
    e[met] = rng.normal(0, 0.02, (len(met), SIZE))
    w = rng.normal(0, 0.5, (SIZE, 2)).astype(np.float32)
    b = np.zeros(2, np.float32)
    ge, gw, gb = np.full(BUCKETS, 1e-6, np.float32), np.full(w.shape, 1e-6, np.float32), np.full(2, 1e-6, np.float32)
    scale = np.float32(20.0)  # a mean over many words is small
    classes = [np.flatnonzero(labels == c) for c in (0, 1)]
    if not len(classes[0]) or not len(classes[1]):
        return np.zeros(BUCKETS, np.float32), 4.0 if len(classes[1]) else -4.0
    for step in range(steps):
        pick = np.concatenate([rng.choice(c, BATCH // 2) for c in classes])
        now = rate * (1 - step / steps)
        x = np.concatenate([bags[i][1] for i in pick]) * scale
        x *= (rng.random(len(x)) >= drop) / (1 - drop)
        _, used, de, dw, db = loss(e, w, b, np.concatenate([bags[i][0] for i in pick]), x, np.array([len(bags[i][0]) for i in pick]), labels[pick])
        ge[used] += (de * de).mean(axis=1)
        gw += dw * dw
        gb += db * db
        e[used] -= now * de / np.sqrt(ge[used])[:, None]
        w -= now * 0.2 * dw / np.sqrt(gw)
        b -= now * 0.2 * db / np.sqrt(gb)
    return (e @ (w[:, 1] - w[:, 0]) * scale).astype(np.float32), float(b[1] - b[0])


def informative(sums: np.ndarray, squares: np.ndarray, rows: np.ndarray, most: int = KEPT) -> np.ndarray:
    """The buckets whose mean shares differ most between the classes, by Welch's statistic; sums and squares: a row a class."""
    n = np.maximum(rows, 1)[:, None]
    mean = sums / n
    spread = np.maximum(squares / n - mean**2, 0) / n
    z = np.abs(mean[1] - mean[0]) / np.sqrt(spread.sum(axis=0) + 1e-12)
    order = np.argsort(-z, kind="stable")[:most]
    return np.sort(order[z[order] > 0])


def held_out(doc_id):
    return F.coalesce(F.pmod(F.crc32(doc_id.cast("string").cast("binary")), F.lit(5)) == 0, F.lit(False))


def train(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> tuple[np.ndarray, float]:
    """The model, from labelled rows that aren't held out: `sample` toxic and twice as many others, those whose hash is smallest."""
    known = labels.where(labels["toxic"].isin(0, 1) & labels["doc_id"].isNotNull()).where(~held_out(F.col("doc_id")))
    known = known.groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.max("toxic").cast("int").alias("toxic")).withColumn("spot", F.xxhash64("doc_id", F.lit("toxicity")))
    chosen = None
    for c in (0, 1):
        few = known.where(F.col("toxic") == c).orderBy("spot", "doc_id").limit(sample * (2 - c))
        chosen = few if chosen is None else chosen.unionByName(few)

    def bags(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [bag(t) for t in batch.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array([f[0].astype(np.int32).tobytes() for f in found], pa.binary()), pa.array([f[1].tobytes() for f in found], pa.binary())], ["doc_id", "toxic", "at", "x"])

    def parted(at: bytes, x: bytes) -> tuple[np.ndarray, np.ndarray]:
        return np.frombuffer(at, np.int32), np.frombuffer(x, np.float32)

    def summed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        totals = np.zeros((4, BUCKETS))
        for batch in batches:
            for toxic, at, x in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), batch.column(3).to_pylist()):
                at, x = parted(at, x)
                totals[toxic][at] += x
                totals[2 + toxic][at] += x.astype(np.float64) ** 2
        where = np.flatnonzero(totals.any(axis=0))
        if len(where):
            yield pa.RecordBatch.from_arrays([pa.array(where.astype(np.int32)), *(pa.array(t[where]) for t in totals)], ["at", "s0", "s1", "q0", "q1"])

    ids = stored(chosen)  # 3 * sample rows at most
    texts = docs.select(docs["doc_id"].cast("long").alias("doc_id"), F.coalesce(docs["text"], F.lit("")).alias("text"))
    made = texts.join(F.broadcast(ids.select("doc_id", "toxic")), "doc_id").select("doc_id", "toxic", "text").mapInArrow(bags, "doc_id long, toxic int, at binary, x binary").where(F.octet_length("at") > 0)
    # of rows that repeat an id one counts
    made = stored(made.groupBy("doc_id", "toxic").agg(F.min(F.struct("at", "x")).alias("b")).select("doc_id", "toxic", "b.at", "b.x"))
    rows = np.array([made.where(F.col("toxic") == c).count() for c in (0, 1)])
    if not rows.any():
        return np.zeros(BUCKETS, np.float32), 0.0
    totals = np.zeros((4, BUCKETS))
    found = made.mapInArrow(summed, "at int, s0 double, s1 double, q0 double, q1 double").groupBy("at").agg(*[F.sum(c).alias(c) for c in ("s0", "s1", "q0", "q1")]).toPandas()  # BUCKETS rows at most
    for k, c in enumerate(("s0", "s1", "q0", "q1")):
        totals[k][found["at"].to_numpy(np.int64)] = found[c].to_numpy()
    keep = np.zeros(BUCKETS, bool)
    keep[informative(totals[:2], totals[2:], rows) if rows.all() else found["at"].to_numpy(np.int64)[:KEPT]] = True
    packed = np.packbits(keep).tobytes()

    def slim(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        mask = np.unpackbits(np.frombuffer(packed, np.uint8)).astype(bool)
        for batch in batches:
            pairs = [parted(at, x) for at, x in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist())]
            pairs = [(at[mask[at]], x[mask[at]]) for at, x in pairs]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array([a.tobytes() for a, _ in pairs], pa.binary()), pa.array([x.tobytes() for _, x in pairs], pa.binary())], ["doc_id", "toxic", "at", "x"])

    # KEPT entries a row at most, whatever a text's length
    few = made.mapInArrow(slim, "doc_id long, toxic int, at binary, x binary").where(F.octet_length("at") > 0).orderBy("doc_id").collect()
    if not few:
        return np.zeros(BUCKETS, np.float32), 0.0
    return fit([parted(r["at"], r["x"]) for r in few], np.array([r["toxic"] for r in few]))


def toxicity(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> DataFrame:
    """doc_id, held_out, score, predicted of each row of docs, by its whole text.

    The model learns from labelled rows whose crc32 of the id is not divisible by 5, at most 3 * `sample` of them, and uses
    nothing but texts. Of all subword buckets of those rows the KEPT that tell the classes apart best are trained, so what comes
    to the driver doesn't grow with texts. Of rows that repeat a labelled id one is learnt from. A null, empty or wordless text has the score of the bias alone. Null ids aren't held out. Labels other
    than 0 and 1, and null ones, are left out; of repeated labels the larger holds. Without labels every score is 0.5; an empty
    table gives no rows. Other columns are not read.
    """
    table, bias = train(docs, labels, sample)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        memo: dict = {}
        for batch in batches:
            for lo in range(0, batch.num_rows, SLICE):
                part = batch.slice(lo, SLICE)
                out = []
                for text in part.column(1).to_pylist():
                    total = n = 0
                    for w in TOKEN.findall(text.lower()):
                        v = memo.get(w)
                        if v is None:
                            v = float(table[subwords(w)].mean())
                            if len(memo) < 300_000:
                                memo[w] = v
                        total += v
                        n += 1
                    out.append(float(1 / (1 + np.exp(-np.clip(total / max(1, n) + bias, -40, 40)))))
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(out, pa.float64())], ["doc_id", "score"])

    slim = docs.select(docs["doc_id"].cast("long").alias("doc_id"), F.coalesce(docs["text"], F.lit("")).alias("text"))
    out = slim.mapInArrow(run, "doc_id long, score double")
    return out.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
