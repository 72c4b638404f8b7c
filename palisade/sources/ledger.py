"""Batches that can be written again, and audit lines that can be checked.

A batch is written to a folder of its own attempt and counts once its line stands in the ledger: a retried writer finds the
line and leaves, and what a failed attempt left behind is never read. An audit batch is sealed too: its lines' digests are
stored beside it, a tree of digests gives its root, and the ledger chains every root to the one before.
"""

from __future__ import annotations

import json
import re
import uuid
from dataclasses import dataclass
from hashlib import sha256

from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from palisade.operators.ranking import group_positions
from palisade.storage import materialize

ARITY = 1024  # digests that one node of a seal's tree holds


@dataclass(frozen=True)
class BatchLedger:
    """Batches below ``base``, one writer a batch. Names are letters, digits, ``-``, ``_`` and ``=``."""

    spark: SparkSession
    base: str

    def _files(self) -> tuple[fs.FileSystem, str]:
        return fs.FileSystem.from_uri(self.base)

    def entries(self) -> list[dict]:
        """Lines of the ledger in the order they were written; one small line a batch."""
        system, inner = self._files()
        found = system.get_file_info(fs.FileSelector(f"{inner}/ledger", allow_not_found=True))
        lines = [json.loads(system.open_input_file(f.path).read()) for f in found if f.path.endswith(".json")]
        return sorted(lines, key=lambda e: (e["turn"], e["batch"]))

    def entry(self, batch: str) -> dict | None:
        return next((e for e in self.entries() if e["batch"] == batch), None)

    def write(self, df: DataFrame, batch: str, **facts: object) -> dict:
        """Write ``df`` as ``batch`` unless it is there; returns its line. ``facts`` go into the line."""
        if not re.fullmatch(r"[\w=-]+", batch):
            raise ValueError(f"not a name of a batch: {batch}")
        known = self.entries()
        for entry in known:
            if entry["batch"] == batch:
                return entry
        path = f"{self.base}/data/{batch}/{uuid.uuid4().hex}"
        df.write.parquet(path)
        entry = {"batch": batch, "turn": len(known), "path": path, **facts}
        system, inner = self._files()
        system.create_dir(f"{inner}/ledger", recursive=True)
        waiting = f"{inner}/ledger/{uuid.uuid4().hex}.tmp"
        with system.open_output_stream(waiting) as file:
            file.write(json.dumps(entry).encode())
        system.move(waiting, f"{inner}/ledger/{batch}.json")
        return entry

    def latest(self, schema: str) -> DataFrame:
        """The batch written last: each one is whole before its line is there, so a reader never meets half of one."""
        known = self.entries()
        return self.spark.read.schema(schema).parquet(known[-1]["path"]) if known else self.spark.createDataFrame([], schema)

    def read(self, schema: str) -> DataFrame:
        """All batches with a line, with the batch's name in ``batch``; ``schema`` is that of the written rows."""
        found = None
        for entry in self.entries():
            part = self.spark.read.schema(schema).parquet(entry["path"]).withColumn("batch", F.lit(entry["batch"]))
            found = part if found is None else found.unionByName(part)
        return self.spark.createDataFrame([], f"{schema}, batch string") if found is None else found


def digest_root(digests: DataFrame) -> str:
    """Root over ``digests(position, digest)``: SHA-256 of the children's digests, ``ARITY`` at a time, up to one node."""
    level = digests.select("position", "digest")
    while True:
        kids = F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("position", "digest"))), lambda x: x["digest"]), "")
        level = materialize(level.groupBy(F.floor(F.col("position") / ARITY).alias("position")).agg(F.sha2(kids, 256).alias("digest")), "seal")
        tops = level.limit(2).collect()
        if len(tops) < 2:
            return tops[0]["digest"] if tops else sha256(b"").hexdigest()


def chained(before: str, batch: str, rows: int, root: str) -> str:
    return sha256(f"{before}|{batch}|{rows}|{root}".encode()).hexdigest()


LINES = "position long, line string"
SEALS = "position long, digest string"


@dataclass(frozen=True)
class AuditLog:
    """Audit lines below ``base``, sealed batch by batch."""

    spark: SparkSession
    base: str

    @property
    def lines(self) -> BatchLedger:
        return BatchLedger(self.spark, f"{self.base}/lines")

    @property
    def seals(self) -> BatchLedger:
        return BatchLedger(self.spark, f"{self.base}/seals")

    def append(self, rows: DataFrame, batch: str, line: str, order: list[str]) -> dict:
        """Write the lines of a batch in the order of ``order`` and seal them; a batch that is there stays as it is.

        The lines come first. A writer that fails before the seal finds them when it comes again, and seals what was written.
        """
        numbered = group_positions(rows.select(F.lit(0).alias("_all"), *order, F.col(line).alias("_line")), "_all", [*order, "_line"])
        written = self.lines.write(numbered.select("position", F.col("_line").alias("line")), batch)
        known = self.seals.entry(batch)
        if known:
            return known
        stored = self.spark.read.schema(LINES).parquet(written["path"])
        digests = materialize(stored.select("position", F.sha2(F.coalesce("line", F.lit("")), 256).alias("digest")), "digests")
        before = self.seals.entries()
        root, count = digest_root(digests), digests.count()
        chain = chained(before[-1]["chain"] if before else "", batch, count, root)
        return self.seals.write(digests, batch, root=root, rows=count, chain=chain)

    def broken_seals(self) -> list[tuple[str, str]]:
        """``(batch, what)`` of seals whose digests don't give their root, or whose root isn't chained to the one before."""
        found, chain = [], ""
        for entry in self.seals.entries():
            digests = self.spark.read.schema(SEALS).parquet(entry["path"])
            if digest_root(digests) != entry["root"] or digests.count() != entry["rows"]:
                found.append((entry["batch"], "root"))
            chain = chained(chain, entry["batch"], entry["rows"], entry["root"])
            if chain != entry["chain"]:
                found.append((entry["batch"], "chain"))
                chain = entry["chain"]
        return found

    def verify(self, lines: DataFrame | None = None) -> DataFrame:
        """``(batch, position, problem)`` of every line unlike its seal: changed, moved, removed or added.

        ``lines(batch, position, line)`` are checked instead of the stored ones where given. A moved line stands at another
        place of its batch than it was sealed at.
        """
        given = self.lines.read(LINES) if lines is None else lines
        now = given.select("batch", "position", F.sha2(F.coalesce("line", F.lit("")), 256).alias("now"))
        sealed = self.seals.read(SEALS).select("batch", "position", F.col("digest").alias("sealed"))
        unlike = materialize(sealed.join(now, ["batch", "position"], "full").filter(~F.col("sealed").eqNullSafe(F.col("now"))), "unlike")
        known = unlike.filter("sealed IS NOT NULL").select("batch", F.col("sealed").alias("now"), F.lit(True).alias("elsewhere")).distinct()
        problem = (
            F.when(F.col("now").isNull(), "removed").when(F.col("elsewhere"), "moved").when(F.col("sealed").isNull(), "added").otherwise("changed")
        )
        return unlike.join(known, ["batch", "now"], "left").select("batch", "position", problem.alias("problem"))
