"""Tables that grow by what changed: a log of deltas with tombstones, the newest row of a key winning when they are read."""

from __future__ import annotations

import json
import uuid
from functools import reduce

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from .hadoop import Folder

#: Parts that rows are dealt to by their keys, deltas after which, and the share of the whole (in bytes) beyond which they are made one.
PARTS, DELTAS, SHARE = 8, 8, 0.5


class DeltaLog:
    """Rows by key on a path that driver and executors share.

    Each write is a folder of its own, which a numbered entry of the log names; the entry comes to be by one rename, so a reader
    sees all of a write or nothing of it. What a write costs follows the rows that it brings. When deltas are many or large, one
    write makes them a new whole; folders of the whole before stay until the next, for readers that began before. `kind` says what
    rows of the table mean: a log of another kind is as if it were empty, and the next write starts it anew.
    """

    def __init__(self, spark: SparkSession, path: str, keys: list[str], kind: str):
        self.spark, self.keys, self.kind = spark, keys, kind
        self.folder = Folder(spark, path)

    def entries(self) -> list[dict]:
        """The entries of the log that count, the whole first."""
        out: list[dict] = []
        for name in reversed([n for n in self.folder.names("log") if n.endswith(".json")]):
            try:
                entry = json.loads(self.folder.read(f"log/{name}") or "")
                if entry["kind"] != self.kind:
                    break
                out.insert(0, {**entry, "number": int(name.split(".")[0])})
                if entry["whole"]:
                    return out
            except (ValueError, KeyError, TypeError):
                break  # what can't be read is as if it were not there
        return []

    def read(self, entries: list[dict] | None = None) -> DataFrame | None:
        """The newest row of each key, without those that are gone; None where nothing is known."""
        entries = self.entries() if entries is None else entries
        if not entries:
            return None
        part = lambda e: self.spark.read.schema(StructType.fromJson(e["schema"])).parquet(f"{self.folder.path}/{e['folder']}").withColumn("_n", F.lit(e["number"]))
        whole, deltas = part(entries[0]), [part(e) for e in entries[1:]]
        if deltas:
            new = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), deltas)
            newest = Window.partitionBy("_part", *self.keys).orderBy(F.desc("_n"))
            new = new.withColumn("_nth", F.row_number().over(newest)).where("_nth = 1").drop("_nth")
            same = lambda c: whole[c].eqNullSafe(new[c])
            old = whole.join(new.select("_part", *self.keys), reduce(lambda a, b: a & b, [whole["_part"] == new["_part"], *map(same, self.keys)]), "left_anti")
            whole = old.unionByName(new, allowMissingColumns=True)
        return whole.where("NOT _gone").drop("_part", "_gone", "_n")

    def write(self, rows: DataFrame, gone: DataFrame | None = None) -> int:
        """Adds rows (one a key; those of known keys take their place) and tombstones for the keys in `gone`. The bytes written."""
        entries = self.entries()
        written = self._put(self._dealt(rows, gone if entries else None), whole=not entries)
        entries = self.entries()
        if len(entries) > 1 and (len(entries) > DELTAS or sum(e["bytes"] for e in entries[1:]) > SHARE * entries[0]["bytes"]):
            written += self._put(self._dealt(self.read(entries), None), whole=True, seen=entries[-1]["number"])
            self._forget()
        return written

    def _dealt(self, rows: DataFrame, gone: DataFrame | None) -> DataFrame:
        part = F.pmod(F.xxhash64(*self.keys), F.lit(PARTS)).cast("int")
        out = rows.withColumn("_gone", F.lit(False))
        if gone is not None:
            out = out.unionByName(gone.select(*self.keys).withColumn("_gone", F.lit(True)), allowMissingColumns=True)
        return out.withColumn("_part", part)

    def _put(self, rows: DataFrame, whole: bool, seen: int | None = None) -> int:
        """Writes a folder and an entry that names it; a whole only if nothing came after what it holds."""
        folder = f"data/{uuid.uuid4().hex}"
        rows.write.partitionBy("_part").parquet(f"{self.folder.path}/{folder}")
        size = self.folder.size(folder)[1] if any(n.startswith("_part=") for n in self.folder.names(folder)) else 0
        if not size and not whole:  # nothing changed
            self.folder.delete(folder)
            return 0
        while True:
            names = [n for n in self.folder.names("log") if n.endswith(".json")]
            last = int(names[-1].split(".")[0]) if names else 0
            if seen is not None and last != seen:
                self.folder.delete(folder)
                return 0
            if self.folder.create(f"log/{last + 1:010d}.json", json.dumps({"kind": self.kind, "whole": whole, "folder": folder, "bytes": size, "schema": rows.schema.jsonValue()})):
                return size

    def _forget(self) -> None:
        """Deletes what only wholes before the last two need."""
        names = [n for n in self.folder.names("log") if n.endswith(".json")]
        entries = [(n, json.loads(self.folder.read(f"log/{n}") or "{}")) for n in names]
        wholes = [i for i, (_, e) in enumerate(entries) if e.get("whole")]
        for name, entry in entries[: wholes[-2]] if len(wholes) > 1 else []:
            self.folder.delete(f"log/{name}")
            if entry.get("folder"):
                self.folder.delete(entry["folder"])

    def clear(self) -> bool:
        """Whether there was anything."""
        return self.folder.delete()

    def info(self) -> dict:
        files, size = self.folder.size("data")
        return {"files": files, "bytes": size, "writes": len(self.entries())}
