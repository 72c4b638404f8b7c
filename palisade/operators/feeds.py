"""Rule and black-list feeds of any size.

A feed of regular expressions has no join key, but nearly every expression demands some literal text. The literals become
Aho-Corasick automata, built by tasks in shards of bounded size and kept in the shared folder. Rows are scanned once: a task
looks for all literals of all shards at a time, and only the expressions whose literal a row holds are tried on it, by a join
on the literal. So neither the driver nor a plan carries the feed. Expressions that demand no literal are counted and run
apart, in blocks of a bounded number.
"""

from __future__ import annotations

import pickle
import re
import uuid
from collections import OrderedDict
from collections.abc import Iterator, Mapping
from dataclasses import dataclass

import pandas as pd
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from palisade.operators.rules import pattern_names
from palisade.storage import materialize, scratch_path

LEAST = 3  # characters of a literal worth looking for
SHARD = 100_000  # literals of an automaton
HELD = 4  # automata that a worker keeps
BUFFER = 32 << 20  # characters that are looked through for one load of the automata
PIECES = 50_000  # of subjects in a batch
APART = 500  # expressions without a literal in one scan

_CAPITALS = {ord(c): c.lower() for c in "ABCDEFGHIJKLMNOPQRSTUVWXYZ"}
_FLAGS = re.compile(r"\(\?([a-zA-Z-]*)[:)]")
_COUNT = re.compile(r"\{([0-9]+)(,[0-9]*)?\}")
# Escapes that stand for one character or a place; any other letter or digit takes part of what follows it.
_SHORT_ESCAPES = frozenset("dDsSwWbBAzZGtnrfaehHvVRX")


def folded(text: str) -> str:
    """``text`` with the letters A-Z in lower case: what ignoring case means to an expression without Unicode flags."""
    return text.lower() if text.isascii() else text.translate(_CAPITALS)


def _class_end(pattern: str, at: int) -> int | None:
    """The place after a character class that starts at ``at``; None where that is not plain to see."""
    depth, i = 0, at
    while i < len(pattern):
        c = pattern[i]
        if c == "\\":
            i += 1
        elif c == "[":
            depth += 1
            if pattern.startswith(("[]", "[^]"), i):
                return None
        elif c == "]":
            depth -= 1
            if not depth:
                return i + 1
        i += 1
    return None


def _group_end(pattern: str, at: int) -> int | None:
    """The place after a group that starts at ``at``."""
    depth, i = 0, at
    while i < len(pattern):
        c = pattern[i]
        if c == "\\":
            i += 1
        elif c == "[":
            end = _class_end(pattern, i)
            if end is None:
                return None
            i = end - 1
        elif c in "()":
            depth += 1 if c == "(" else -1
            if not depth:
                return i + 1
        i += 1
    return None


def required_literal(pattern: str | None, least: int = LEAST) -> str | None:
    """The longest text that every match of the expression holds, folded; None where none of ``least`` characters is certain.

    Groups, classes of several characters and whatever may be absent end a piece of text. Alternatives at the top, quotations,
    numbered escapes and flags other than i, m and s give None: such an expression is tried on every row.
    """
    if pattern is None or "\\Q" in pattern or any(set(flags) - set("ims") for flags in _FLAGS.findall(pattern)):
        return None
    pieces: list[str] = [""]
    i = 0
    while i < len(pattern):
        c, step, plain = pattern[i], 1, None
        if c == "|":
            return None
        if c == "(":
            end = _group_end(pattern, i)
            if end is None:
                return None
            step = end - i
        elif c == "[":
            end = _class_end(pattern, i)
            if end is None:
                return None
            step = end - i
            if step == 3 and pattern[i + 1] not in "^\\":
                plain = pattern[i + 1]
        elif c == "\\":
            if i + 1 == len(pattern):
                return None
            step = 2
            if not pattern[i + 1].isalnum():
                plain = pattern[i + 1]
            elif pattern[i + 1] not in _SHORT_ESCAPES:
                return None
        elif c in "*+?{":  # without anything to repeat
            return None
        elif c not in "^$.)":
            plain = c
        elif c == ")":
            return None
        i += step
        counted = _COUNT.match(pattern, i)
        repeat = pattern[i : i + 1] if pattern[i : i + 1] in ("*", "+", "?") else None
        if pattern[i : i + 1] == "{" and not counted:
            return None
        if plain is not None and not (repeat in ("*", "?") or (counted and int(counted[1]) == 0)):
            pieces[-1] += plain
        if plain is None or repeat or counted:
            pieces.append("")
        if repeat or counted:
            i = counted.end() if counted else i + 1
            i += pattern[i : i + 1] in ("?", "+")  # as few as possible, or without giving back
    longest = folded(max(pieces, key=len))
    return longest if len(longest) >= least else None


@dataclass(frozen=True)
class PatternFeed:
    """Expressions by type with their literals, and the automata that look for these, if a worker can keep them."""

    anchored: DataFrame
    apart: DataFrame
    shards: tuple[tuple[str, str], ...]
    n_anchored: int
    n_apart: int

    def hits(self, df: DataFrame, key: str, subjects: Mapping[str, Column]) -> DataFrame:
        """``(key, type, name)`` for each name with an expression found in the row's subject of its type, once each.

        ``subjects`` maps a type to the column its expressions look at. A null subject meets nothing; rows that share a key
        are one. A subject travels with each literal found in it, so subjects are addresses, paths and the like.
        """
        kinds = [k for k in subjects if any(k == kind for kind, _ in self.shards)]
        found = None
        if kinds:
            asked = df.select(F.col(key).alias("key"), *[subjects[k].cast("string").alias(f"s{i}") for i, k in enumerate(kinds)])
            out = T.StructType([asked.schema["key"], *T.StructType.fromDDL("type string, subject string, literals array<string>")])
            met = asked.mapInArrow(_look_for(kinds, self.shards), out).withColumn("literal", F.explode("literals"))
            tried = met.join(self.anchored, ["type", "literal"]).where(F.rlike("subject", "pattern"))
            found = tried.select("key", "type", "name")
        elif self.n_anchored and not self.shards:
            found = self._joined(df, key, subjects)
        if self.n_apart:
            for block in _blocks(self.apart, APART):
                for kind, subject in subjects.items():
                    pairs = [(r["name"], r["pattern"]) for r in block if r["type"] == kind]
                    if pairs:
                        part = df.select(F.col(key).alias("key"), F.lit(kind).alias("type"), F.explode(pattern_names(subject, pairs)).alias("name"))
                        found = part if found is None else found.union(part)
        if found is None:
            found = df.select(F.col(key).alias("key"), F.lit("").alias("type"), F.lit("").alias("name")).limit(0)
        return found.distinct().withColumnRenamed("key", key)

    def _joined(self, df: DataFrame, key: str, subjects: Mapping[str, Column]) -> DataFrame | None:
        """Hits of the anchored expressions by a join of the subjects' pieces with the literals.

        A piece carries a hash of its subject; the expression decides on the subject itself, so equal hashes do no harm.
        """
        sizes = {r["type"]: sorted(r["sizes"]) for r in self.anchored.groupBy("type").agg(F.collect_set(F.length("literal")).alias("sizes")).collect()}
        entries = [F.struct(F.lit(k).alias("type"), s.cast("string").alias("subject")) for k, s in subjects.items() if k in sizes]
        if not entries:
            return None
        asked = df.select(F.col(key).alias("key"), F.explode(F.array(*entries)).alias("e")).select("key", "e.type", "e.subject").where("subject IS NOT NULL")
        known = asked.select("type", "subject", F.xxhash64("subject").alias("hash")).distinct()
        pieces = known.mapInArrow(_pieces_of(sizes), "type string, hash long, literal string")
        near = pieces.join(self.anchored, ["type", "literal"]).select("type", "hash", "name", "pattern")
        met = known.join(near, ["type", "hash"]).where(F.rlike("subject", "pattern")).select("type", "subject", "name").distinct()
        return asked.join(met, ["type", "subject"]).select("key", "type", "name")


def _pieces_of(sizes: Mapping[str, list[int]]):
    """Batch function that gives the different pieces of each subject with the lengths of its type's literals."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows: list[tuple] = []
            for kind, subject, number in zip(*(batch[c].to_pylist() for c in ("type", "subject", "hash"))):
                text = folded(subject)
                for size in sizes[kind]:
                    rows += [(kind, number, piece) for piece in {text[i : i + size] for i in range(len(text) - size + 1)}]
                    if len(rows) >= PIECES:
                        yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*rows)], ["type", "hash", "literal"])
                        rows = []
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*rows)], ["type", "hash", "literal"])

    return run


def _blocks(rows: DataFrame, size: int) -> Iterator[list]:
    """Rows in lists of at most ``size``; the driver holds one list at a time."""
    block: list = []
    for row in rows.toLocalIterator():
        block.append(row)
        if len(block) == size:
            yield block
            block = []
    if block:
        yield block


def _look_for(kinds: list[str], shards: tuple[tuple[str, str], ...]):
    """Batch function that gives the literals found in each subject."""
    paths = {k: [path for kind, path in shards if kind == k] for k in kinds}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: OrderedDict[str, object] = OrderedDict()

        def automaton(path: str):
            if path not in held:
                while len(held) >= HELD:
                    held.popitem(last=False)
                system, inner = fs.FileSystem.from_uri(path)
                with system.open_input_file(inner) as file:
                    held[path] = pickle.loads(file.read())
            held.move_to_end(path)
            return held[path]

        def look(waiting: list[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for place, kind in enumerate(kinds):
                texts = [[s and folded(s) for s in batch[f"s{place}"].to_pylist()] for batch in waiting]
                found = [[set() if s else None for s in column] for column in texts]
                for path in paths[kind]:
                    search = automaton(path).iter
                    for column, sets in zip(texts, found):
                        for text, literals in zip(column, sets):
                            if text:
                                literals.update(literal for _, literal in search(text))
                for batch, sets in zip(waiting, found):
                    rows = [i for i, literals in enumerate(sets) if literals]
                    if rows:
                        part = batch.take(pa.array(rows))
                        lists = pa.array([sorted(sets[i]) for i in rows], pa.list_(pa.string()))
                        yield pa.RecordBatch.from_arrays([part["key"], pa.array([kind] * len(rows)), part[f"s{place}"], lists], ["key", "type", "subject", "literals"])

        waiting, size = [], 0
        for batch in batches:
            waiting.append(batch)
            size += batch.nbytes
            if size >= BUFFER:
                yield from look(waiting)
                waiting, size = [], 0
        if waiting:
            yield from look(waiting)

    return run


def prepare_feed(patterns: DataFrame, least: int = LEAST, shard: int = SHARD) -> PatternFeed:
    """A feed from ``patterns(type, name, pattern)``; repeated rows count once, rows without a pattern never match.

    Literals are taken from the expressions by tasks, the automata are built by tasks, one for each shard of about ``shard``
    literals; the driver only learns where they lie. Feeds of more than ``HELD`` shards are joined instead and need none.
    """
    spark = patterns.sparkSession

    def with_literals(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            literals = pa.array([required_literal(p, least) for p in batch["pattern"].to_pylist()], pa.string())
            yield pa.RecordBatch.from_arrays([batch["type"], batch["name"], batch["pattern"], literals], ["type", "name", "pattern", "literal"])

    known = patterns.where("pattern IS NOT NULL").select(*[F.col(c).cast("string") for c in ("type", "name", "pattern")]).distinct()
    table = materialize(known.mapInArrow(with_literals, "type string, name string, pattern string, literal string"), "feed")
    folder = scratch_path(spark, "automata")

    def build(rows: pd.DataFrame) -> pd.DataFrame:
        import ahocorasick

        found = ahocorasick.Automaton()
        for literal in rows["literal"]:
            found.add_word(literal, literal)
        found.make_automaton()
        system, inner = fs.FileSystem.from_uri(folder)
        system.create_dir(inner, recursive=True)
        name = f"{uuid.uuid4().hex}.automaton"  # of this attempt; the table of shards names those that count
        with system.open_output_stream(f"{inner}/{name}") as file:
            file.write(pickle.dumps(found))
        return pd.DataFrame({"type": [rows["type"].iloc[0]], "path": [f"{folder}/{name}"]})

    anchored, apart = table.where("literal IS NOT NULL"), table.where("literal IS NULL")
    counts = {r["known"]: r["n"] for r in table.groupBy(F.col("literal").isNotNull().alias("known")).agg(F.count(F.lit(1)).alias("n")).collect()}
    pieces = -(-counts.get(True, 0) // shard)
    shards: tuple[tuple[str, str], ...] = ()
    if 0 < pieces <= HELD:
        literals = anchored.select("type", "literal").distinct().withColumn("shard", F.pmod(F.xxhash64("literal"), F.lit(pieces)))
        built = materialize(literals.groupBy("type", "shard").applyInPandas(build, "type string, path string"), "shards")
        shards = tuple(sorted((r["type"], r["path"]) for r in built.collect()))  # a row for each shard
    return PatternFeed(anchored, apart, shards, counts.get(True, 0), counts.get(False, 0))


def feed_rule_hits(df: DataFrame, key: str, subjects: Mapping[str, Column], rules: DataFrame) -> DataFrame:
    """``(key, name)`` for each active rule met, for rule tables of any size.

    Rules of type ``hash`` are equal to their subject, case folded, and are joined; all others are expressions of a feed.
    """
    active = rules.filter("active")
    feed = prepare_feed(active.filter("type <> 'hash'").select("type", "name", "pattern"))
    found = feed.hits(df, key, {k: s for k, s in subjects.items() if k != "hash"}).select(key, "name")
    if "hash" in subjects:
        digests = active.filter("type = 'hash'").select(F.lower("pattern").alias("_digest"), "name").distinct()
        asked = df.select(key, F.lower(subjects["hash"]).alias("_digest"))
        found = found.union(asked.join(digests, "_digest").select(key, "name")).distinct()
    return found


def feed_blacklist_matches(samples: DataFrame, key: str, blacklist: DataFrame, url: str, parts: Column, names: Column) -> DataFrame:
    """``(key, kind, value)`` for each entry of ``blacklist(kind, value)`` met, for lists of any size.

    Domains match the host or its registered domain and addresses the host, by one join on kind and value; patterns match the
    whole URL through a feed.
    """
    entry = lambda kind, value: F.struct(F.lit(kind).alias("kind"), value.alias("value"))
    asked = F.array(entry("domain", parts["host"]), entry("domain", names["registered_domain"]), entry("ip", parts["host"]))
    by_name = samples.select(key, F.explode(F.array_distinct(asked)).alias("e")).select(key, "e.kind", "e.value")
    listed = blacklist.filter(F.col("kind").isin("domain", "ip")).select("kind", F.lower("value").alias("value")).distinct()
    patterns = blacklist.filter("kind = 'pattern'").select(F.col("kind").alias("type"), F.col("value").alias("name"), F.col("value").alias("pattern"))
    by_pattern = prepare_feed(patterns).hits(samples, key, {"pattern": F.col(url)})
    return by_name.join(listed, ["kind", "value"]).select(key, "kind", "value").distinct().union(by_pattern.select(key, "type", "name"))
