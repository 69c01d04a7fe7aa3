"""SentencePiece encoding and decoding, with a max-plus parallel scan over the chunks of giant documents."""

from __future__ import annotations

import pickle
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import stored
from .pieces import borders, compose, default_model, vocabulary

SLICE = 128
#: Chunk matrices that are multiplied to one before a document's product is taken.
BLOCK = 64


def _lists(values: list) -> pa.Array:
    sizes = np.fromiter((len(v) for v in values), np.int64, len(values))
    flat = np.concatenate([np.asarray(v, np.int32) for v in values]) if len(values) else np.array([], np.int32)
    return pa.ListArray.from_arrays(pa.array(np.append(0, np.cumsum(sizes)).astype(np.int32)), pa.array(flat, pa.int32()))


def product(matrices: list[list]) -> list:
    """The product of the matrices of neighbouring chunks, in order."""
    out = matrices[0]
    for m in matrices[1:]:
        out = compose(out, m)
    return out


def inside(matrices: list[list], enter: tuple[int, int], leave: tuple[int, int]) -> list[tuple[int, int]]:
    """The state at each border of a block, whose first and last are known."""
    ahead = [{enter}]
    for rows in matrices:
        ahead.append({q for ins, outs in rows if ahead[-1] & set(ins) for q in outs})
    states = [leave]
    for k in range(len(matrices) - 1, 0, -1):
        states.append(next(iter({q for ins, outs in matrices[k] if states[-1] in outs for q in ins} & ahead[k])))
    return [enter, *states[::-1]]


def scan(matrices: list[list]) -> list[tuple[int, int]]:
    """The state at each border of a document: blocks of matrices are multiplied, the blocks' borders solved, then each block's own."""
    blocks = [matrices[i : i + BLOCK] for i in range(0, len(matrices), BLOCK)]
    outer = borders([product(block) for block in blocks])
    return [outer[0], *(q for block, enter, leave in zip(blocks, outer, outer[1:]) for q in inside(block, enter, leave)[1:])]


def encode(docs: DataFrame, model: bytes | None = None, chunk: int = 16_384, giant: int = 32_768) -> DataFrame:
    """Adds piece_ids array<int> to doc_id and text: the ids that the library gives for each whole text.

    Texts of more than `giant` characters are dealt out in chunks. Each chunk yields, from its own characters and one longest
    piece to either side, the matrix of which border states at its start lead to which at its end; the matrices of a document
    are multiplied (the product is associative), which leaves one state at each border, and each chunk is then traced back by
    itself. Products are taken of blocks of BLOCK chunks, each a task of its own; the few products of a document then give the states at its
    blocks' borders, and these the states inside each block. Shorter texts are one chunk each. A null or empty text has no ids. Rows are told apart by their place in the
    input, stored before they are used, so repeated rows and null ids stay as they are. An empty table gives no rows.
    """
    proto = model or default_model()
    slim = docs.select(docs["doc_id"].cast("long").alias("doc_id"), F.coalesce(docs["text"], F.lit("")).alias("text"))
    long = F.length("text") > giant
    context = 2 * vocabulary(proto).longest

    def short_texts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = vocabulary(proto)
        for batch in batches:
            for at in range(0, batch.num_rows, SLICE):
                part = batch.slice(at, SLICE)
                ids = words.encode_many(part.column(1).to_pylist())
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), _lists(ids)], ["doc_id", "text", "piece_ids"])

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = vocabulary(proto)
        for batch in batches:
            for row in batch.to_pylist():
                normal = words.normalize(row["text"])
                for k, a in enumerate(range(0, len(normal), chunk)):
                    lo, hi = max(0, a - context), min(len(normal), a + chunk + context)
                    yield pa.RecordBatch.from_pylist([{"rid": row["rid"], "k": k, "a": a - lo, "b": min(a + chunk, len(normal)) - lo, "ends": hi == len(normal) and a + chunk >= len(normal), "part": normal[lo:hi]}], schema=chunk_schema)

    chunk_schema = pa.schema([("rid", pa.int64()), ("k", pa.int32()), ("a", pa.int32()), ("b", pa.int32()), ("ends", pa.bool_()), ("part", pa.string())])

    def matrices(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = vocabulary(proto)
        for batch in batches:
            for at in range(0, batch.num_rows, 16):
                part = batch.slice(at, 16)
                found = [pickle.dumps(words.transfer(r["part"], r["a"], r["b"])) for r in part.to_pylist()]
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(found, pa.binary())], ["rid", "k", "matrix"])

    def products(group: pd.DataFrame) -> pd.DataFrame:
        whole = pickle.dumps(product([pickle.loads(m) for m in group.sort_values("k")["matrix"]]))
        return pd.DataFrame({"rid": group["rid"].iloc[:1].to_numpy(), "block": group["block"].iloc[:1].to_numpy(), "matrix": [whole]})

    def ends(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values("block")
        at = borders([pickle.loads(m) for m in group["matrix"]])
        return pd.DataFrame({"rid": group["rid"].to_numpy(), "block": group["block"].to_numpy(), "enter": [list(q) for q in at[:-1]], "leave": [list(q) for q in at[1:]]})

    def states(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values("k")
        at = inside([pickle.loads(m) for m in group["matrix"]], tuple(int(x) for x in group["enter"].iloc[0]), tuple(int(x) for x in group["leave"].iloc[0]))
        return pd.DataFrame({"rid": group["rid"].to_numpy(), "k": group["k"].to_numpy(), "s0": [q[0] for q in at[:-1]], "e0": [q[1] for q in at[:-1]], "s1": [q[0] for q in at[1:]], "e1": [q[1] for q in at[1:]]})

    def traced(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = vocabulary(proto)
        for batch in batches:
            for at in range(0, batch.num_rows, 16):
                part = batch.slice(at, 16)
                ids = [words.backtrace(r["part"], r["a"], r["b"], (r["s0"], r["e0"]), (r["s1"], r["e1"])) for r in part.to_pylist()]
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), _lists(ids)], ["rid", "k", "ids"])

    done = slim.where(~long).mapInArrow(short_texts, "doc_id long, text string, piece_ids array<int>")
    # numbered once, and spread over all tasks however few of the input's hold them
    rows = stored(slim.where(long).withColumn("rid", F.monotonically_increasing_id()))
    chunks = stored(rows.mapInArrow(cut, "rid long, k int, a int, b int, ends boolean, part string").repartition("rid", "k"))
    found = stored(chunks.mapInArrow(matrices, "rid long, k int, matrix binary").withColumn("block", F.floor(F.col("k") / BLOCK).cast("int")))
    outer = found.groupBy("rid", "block").applyInPandas(products, "rid long, block int, matrix binary").groupBy("rid").applyInPandas(ends, "rid long, block int, enter array<int>, leave array<int>")
    found = found.join(outer, ["rid", "block"]).groupBy("rid", "block").applyInPandas(states, "rid long, k int, s0 int, e0 int, s1 int, e1 int")
    pieces = chunks.join(found, ["rid", "k"]).mapInArrow(traced, "rid long, k int, ids array<int>")
    whole = pieces.groupBy("rid").agg(F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("k", "ids"))), lambda x: x["ids"])).alias("piece_ids"))
    return done.unionByName(rows.join(whole, "rid").select("doc_id", "text", "piece_ids"))


def decode(encoded: DataFrame, model: bytes | None = None, ids: str = "piece_ids", out: str = "decoded") -> DataFrame:
    """Adds the text that the library decodes from a column of ids; null or no ids: the empty text. Other columns stay."""
    proto = model or default_model()
    from pyspark.sql import types as T

    schema = T.StructType([*[f for f in encoded.schema.fields if f.name != out], T.StructField(out, T.StringType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        full = vocabulary(proto).full
        for batch in batches:
            at = batch.schema.get_field_index(ids)
            names = [n for n in batch.schema.names if n != out]
            for lo in range(0, batch.num_rows, SLICE):
                part = batch.slice(lo, SLICE)
                held = part.column(at)  # a slice: offsets are its own, values the whole column's
                offsets, values = held.offsets.to_numpy(), held.values.to_numpy()
                texts = [full.decode(values[i:j].tolist()) if j > i else "" for i, j in zip(offsets[:-1], offsets[1:])]
                yield pa.RecordBatch.from_arrays([*[part.column(n) for n in names], pa.array(texts, pa.string())], [*names, out])

    return encoded.mapInArrow(run, schema)
