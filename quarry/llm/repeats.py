"""Runs of words that repeat with a period, found by harmonic grid probing."""

from __future__ import annotations

import math
from collections import defaultdict
from collections.abc import Iterator
from itertools import count

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import SPACES

#: A run has at least LEAST words and TIMES periods.
LEAST, TIMES = 24, 3
#: Grid points probed at a time, words that a survivor has to keep on repeating before it is extended, first chunk of an
#: extension, bytes of text split at a time, documents in an output batch.
GRID, CHECK, CHUNK, PIECE, SLICE = 1 << 20, 8, 64, 1 << 20, 256
RUN = "struct<start:bigint,length:bigint,period:bigint>"


def numbered(text: bytes) -> tuple[np.ndarray, list[bytes]]:
    """Words of a UTF-8 text as numbers, equal for equal words, and the words by number. Only distinct words are kept as objects:
    a long text is split piece by piece, each cut at white space."""
    numbers: dict[bytes, int] = defaultdict(count().__next__)
    ids, at = [], 0
    while at < len(text):
        end = at + PIECE
        while end < len(text) and text[end] not in b" \t\n\v\f\r":
            end += 1
        ids.append(np.fromiter(map(numbers.__getitem__, text[at:end].split()), np.int32))
        at = end
    return (np.concatenate(ids) if ids else np.empty(0, np.int32)), list(numbers)


def _grid(n: int, times: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Periods p and grid points jp with (j+1)p < n, in order of period and place, about GRID at a time or one period."""
    p, last = 1, n // times
    while p <= last:
        to = max(p + 1, min(last + 1, int(p * math.exp(min(GRID / n, 40.0)))))  # the sum of n / p is n times a logarithm
        periods = np.arange(p, to, dtype=np.int64)
        points = (n - 1) // periods
        period = np.repeat(periods, points)
        yield period, (np.arange(len(period)) - np.repeat(np.cumsum(points) - points, points)) * period
        p = to


def _reach(w: np.ndarray, at: int, period: int, step: int) -> int:
    """How far from `at`, in the direction of `step`, words equal those a period on: chunks are compared as arrays, each twice
    as long as the one before."""
    far, size, n = 0, CHUNK, len(w)
    while True:
        size_ = min(size, (n - period - at - far) if step > 0 else at - far)
        if size_ <= 0:
            return far
        lo = at + far if step > 0 else at - far - size_
        same = w[lo : lo + size_] == w[lo + period : lo + period + size_]
        if not same.all():
            return far + int(np.argmin(same if step > 0 else same[::-1]))
        far, size = far + size_, size * 2


def runs_of(w: np.ndarray, least: int = LEAST, times: int = TIMES) -> list[tuple[int, int, int]]:
    """(start, length, period) of each maximal stretch of `w` with smallest period p and length of at least `least` and `times`
    periods, by start, then period.

    Words that equal those p on form a stretch of at least times - 1 periods in such a run, so it holds a grid point jp whose
    word equals that at (j+1)p and that has less than a period of the stretch before it. Points that pass, and whose next words
    repeat as well, are extended both ways. Periods are tried from the smallest. A pair of grid points in a run of period q
    found before is skipped if q divides p and the run is at least p + q long: there the stretch of period p has period q too
    (Fine and Wilf), so it is that run. Hence text that repeats one word n times is one run and no n of them.
    """
    n = len(w)
    if n < least or times < 3:
        if times < 3:
            raise ValueError("runs of less than three periods need another grid")
        return []
    low, high, size = np.zeros(n, np.int64), np.zeros(n, np.int64), np.ones(n, np.int64)  # the longest run found over each word
    found: dict[tuple[int, int], int] = {}

    def known(period: np.ndarray, at: np.ndarray) -> np.ndarray:
        return (at + period < high[at]) & (period % size[at] == 0) & (high[at] - low[at] >= period + size[at])

    for period, at in _grid(n, times):
        hit = w[at] == w[at + period]
        period, at = period[hit], at[hit]
        # of the stretch at least this many words lie at and after its first grid point
        ahead = np.minimum(CHECK, np.maximum(least - 2 * period + 1, (times - 2) * period + 1))
        for k in range(1, CHECK):
            there = at + period + k < n
            go = (ahead <= k) | (there & (w[np.minimum(at + k, n - 1)] == w[np.minimum(at + period + k, n - 1)]))
            period, at, ahead = period[go], at[go], ahead[go]
        new = ~known(period, at)
        period, at = period[new], at[new]
        while len(at):
            p, i = int(period[0]), int(at[0])
            start = i - _reach(w, i, p, -1)
            end = i + _reach(w, i, p, 1) + p
            skip = (period == p) & (at < end - p)
            if end - start >= max(least, times * p) and (start, end) not in found:
                found[start, end] = p
                longer = start + np.flatnonzero(high[start:end] - low[start:end] < end - start)
                low[longer], high[longer], size[longer] = start, end, p
                skip |= known(period, at)
            skip[0] = True
            period, at = period[~skip], at[~skip]
    return sorted((s, e - s, p) for (s, e), p in found.items())


def kept_words(n: int, runs: list[tuple[int, int, int]]) -> np.ndarray:
    """Which words stay when of each run only its first period does."""
    edges = np.zeros(n + 1, np.int64)
    for start, length, period in runs:
        edges[start + period] += 1
        edges[start + length] -= 1
    return np.cumsum(edges[:n]) == 0


def with_repeats(docs: DataFrame, least: int = LEAST, times: int = TIMES) -> DataFrame:
    """docs with n_words, runs (start, length, period; by start, then period) and collapsed added.

    Words are separated by ASCII white space, numbered from 0. A run is a stretch of words with smallest period p, at least
    `least` words and `times` (3 or more) periods long, that can't be extended; runs of different periods may overlap.
    collapsed is the text, joined by one space, without the words that a run holds after its first period. A null or empty text
    has no words, no runs and an empty collapsed. Rows that repeat are worked on each; other columns stay, those named as the
    added ones are replaced; an empty table gives no rows. Each document is read by one task and nothing is shuffled; a long
    one costs a few bytes a word.
    """
    text = F.coalesce(F.col("text").cast("string"), F.lit("")).cast("binary")
    docs = docs.drop("n_words", "runs", "collapsed").withColumn("n_words", text)  # where the result goes
    names = docs.columns
    last = len(names) - 1

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo in range(0, batch.num_rows, SLICE):
                part = batch.slice(lo, SLICE)
                lengths, offsets, flat, out = [], [0], [], []
                for text in part.column(last):
                    w, words = numbered(text.as_py())
                    found = runs_of(w, least, times)
                    keep = kept_words(len(w), found)
                    out.append(b" ".join(map(words.__getitem__, w[keep].tolist())))
                    lengths.append(len(w))
                    flat.extend(found)
                    offsets.append(len(flat))
                columns = np.array(flat, np.int64).reshape(-1, 3).T
                runs = pa.StructArray.from_arrays([pa.array(c, pa.int64()) for c in columns], ["start", "length", "period"])
                arrays = [pa.array(lengths, pa.int64()), pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), runs), pa.array(out, pa.binary()).cast(pa.string())]
                yield pa.RecordBatch.from_arrays([*part.columns[:last], *arrays], [*names[:last], "n_words", "runs", "collapsed"])

    from pyspark.sql import types as T

    added = T._parse_datatype_string(f"n_words bigint, runs array<{RUN}>, collapsed string")
    return docs.mapInArrow(run, T.StructType([*docs.schema.fields[:last], *added.fields]))


def strongest(runs: Column) -> Column:
    """Of runs in order the first with the greatest length by period, compared exactly; null where there is none."""
    return F.aggregate(runs, F.lit(None).cast(RUN), lambda best, x: F.when(best.isNull() | (x["length"] * best["period"] > best["length"] * x["period"]), x).otherwise(best))


def with_planted(docs: DataFrame) -> DataFrame:
    """docs in which one text in ten goes on repeating itself: with h the CRC-32 of the decimal doc_id and g = h / 10, where
    h % 10 is 0 each word i >= a is word a + (i - a) % p, a = g % n, p = 1 + (n - a) / (3 + g % 8). A row without an id stays."""
    h = F.crc32(F.col("doc_id").cast("string").cast("binary"))
    g = F.floor(h / 10).cast("long")
    words = F.filter(F.split(F.col("text"), SPACES), lambda x: x != "")
    n = F.size(words).cast("long")

    def planted(words: Column, n: Column) -> Column:
        a = g % n
        p = 1 + F.floor((n - a) / (3 + g % 8)).cast("long")
        place = lambda i: F.when(i >= a, a + (i - a) % p).otherwise(i)
        return F.array_join(F.transform(F.sequence(F.lit(0).cast("long"), n - 1), lambda i: F.get(words, place(i).cast("int"))), " ")

    # the array is made once, and only for the texts that need it
    some = F.when(h % 10 == 0, F.array(words)).otherwise(F.array().cast("array<array<string>>"))
    new = F.transform(some, lambda x: F.when(F.size(x) > 0, planted(x, F.size(x).cast("long"))))
    return docs.withColumn("text", F.coalesce(F.get(new, F.lit(0)), F.col("text")))


def digests(found: DataFrame) -> DataFrame:
    """doc_id and what tells one result from another: how many runs, the strongest, digests of all runs and of what is left."""
    best = strongest(F.col("runs"))
    lines = F.array_join(F.transform("runs", lambda r: F.concat(F.concat_ws(",", r["start"].cast("string"), r["length"].cast("string"), r["period"].cast("string")), F.lit("\n"))), "")
    rows = found.select("doc_id", F.size("runs").cast("long").alias("n_runs"), best.alias("best"), F.sha2(lines, 256).alias("runs_sha256"), F.sha2(F.col("collapsed"), 256).alias("collapsed_sha256"))
    milli = F.expr("1000 * best.length div best.period")
    return rows.select("doc_id", "n_runs", "best.start", "best.length", "best.period", milli.alias("exponent_milli"), "runs_sha256", "collapsed_sha256")


def brute_force(words: list, least: int = LEAST, times: int = TIMES) -> list[tuple[int, int, int]]:
    """Runs by comparing every word with every later one, for small fixtures."""
    out, n = [], len(words)
    for start in range(n):
        for p in range(1, n // times + 1):
            if start and start - 1 + p < n and words[start - 1] == words[start - 1 + p]:
                continue
            end = start + p
            while end < n and words[end] == words[end - p]:
                end += 1
            part = words[start:end]
            if end - start >= max(least, times * p) and not any(all(part[i] == part[i + q] for i in range(len(part) - q)) for q in range(1, p)):
                out.append((start, end - start, p))
    return sorted(out, key=lambda r: (r[0], r[2]))
