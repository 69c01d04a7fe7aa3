"""Ordered text documents of any size: executors write numbered fragments, which are joined as streams or left with a manifest."""

from __future__ import annotations

import json
import os
import re
import uuid
from collections.abc import Iterator
from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarry.sources.hadoop import Folder
from quarry.sources.store import shared_dir

@dataclass
class Section:
    """head, then the lines of rows (`line`, by `order`), each but the first after `between`."""

    head: str
    rows: DataFrame | None = None
    order: list = field(default_factory=list)
    between: str = ""

    def fragments(self, path: str) -> list[str]:
        """Writes the lines as text files in a folder: range partitions by order, so that the names' order is the rows' order. Each
        line begins with `between`. The names of those that aren't empty."""
        by = [*self.order, F.xxhash64("line")]
        dealt = self.rows.repartitionByRange(*by).sortWithinPartitions(*by)
        dealt.select(F.concat(F.lit(self.between), "line")).write.text(path)
        folder = Folder(self.rows.sparkSession, path)
        return [n for n in folder.names() if n.startswith("part-") and folder.size(n)[1]]


@dataclass
class Document:
    sections: list[Section]
    tail: str = ""

    def _written(self, base: str) -> list[list[str]]:
        return [[f"{k}/{n}" for n in s.fragments(f"{base}/{k}")] if s.rows is not None else [] for k, s in enumerate(self.sections)]

    @property
    def _spark(self):
        return next(s.rows.sparkSession for s in self.sections if s.rows is not None)

    def _shared(self) -> str:
        return f"{shared_dir(self._spark)}/documents/{uuid.uuid4().hex}"

    def write(self, path: str) -> None:
        """One file at path, by streams of bounded size: it comes to be by a rename, whole or not at all."""
        base = self._shared()
        names = self._written(base)
        path = path if re.match(r"[a-z][a-z0-9+.-]*:", path) else "file://" + os.path.abspath(path)
        where, name = path.rsplit("/", 1)
        pieces: list = []
        for s, parts in zip(self.sections, names):
            pieces.append(s.head + "\n" if s.head else "")
            pieces += [(part, len(s.between.encode()) if k == 0 else 0) for k, part in enumerate(parts)]
        source = Folder(self._spark, base)
        Folder(self._spark, where).joined(name, [*pieces, self.tail + "\n" if self.tail else ""], source)
        source.delete()

    def publish(self, path: str) -> None:
        """A folder of fragments with a manifest that names them in order: for documents that nothing should gather."""
        names = self._written(path)
        doc = {"sections": [{"head": s.head, "between": s.between, "fragments": n} for s, n in zip(self.sections, names)], "tail": self.tail}
        Folder(self._spark, path).create("_manifest.json", json.dumps(doc))

    def lines(self) -> Iterator[str]:
        """The document's lines, for a terminal: one is in memory at a time."""
        base = self._shared()
        names, folder = self._written(base), Folder(self._spark, base)
        for s, parts in zip(self.sections, names):
            if s.head:
                yield s.head
            cut = len(s.between)
            for name in parts:
                for line in folder.lines(name):
                    yield line[cut:]
                    cut = 0
        if self.tail:
            yield self.tail
        folder.delete()
