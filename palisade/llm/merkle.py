"""Merkle manifest of a dataset: a tree per source, a tree over the sources, and a proof for every row.

Built levels are stored as node rows linked to their parents. A recursive query starts at every leaf, meets its parent's row,
appends the siblings found there, folds the leaf's own (perhaps tampered) hash with them, and goes on to the next parent.

Rows are numbered in the order of the tree. A node's row is repeated for every block of ``BLOCK`` such numbers below it, and
a leaf meets the copy of its own block: so the root, which every leaf meets, is no hot key. A step climbs two levels and
carries only the hash folded so far; the siblings of each step are rows of the result and are put together once at the end.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from palisade.llm.registry import query
from palisade.storage import materialize

ARITY = 3
BLOCK = 8192
SOURCES = -1  # the group whose leaves are the roots of all other groups
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")


def hexed(digest: Column) -> Column:
    return F.lower(F.hex(digest))


def digest(value: Column) -> Column:
    """SHA-256 as 32 bytes."""
    return F.unhex(F.sha2(value, 256))


def leaf_digest(values: list[Column]) -> Column:
    """Digest of a row: each value as its length in UTF-8 bytes, a colon and its text; ``-`` for null."""
    written = [value.cast("string") for value in values]
    return digest(F.encode(F.concat(*[F.coalesce(F.concat(F.octet_length(w).cast("string"), F.lit(":"), w), F.lit("-")) for w in written]), "UTF-8"))


def numbered(rows: DataFrame, group: str, order: list[str]) -> DataFrame:
    """``rows`` with ``at``, a number over all rows in the order of group and ``order``, and ``pos``, the same inside the group.

    Rows are spread by range and sorted where they are. Only the bounds of each group in each partition are added up, so no
    group passes through one task. Null groups come first; equal rows are numbered in any order.
    """
    spread = rows.withColumn("tie", F.monotonically_increasing_id()).repartitionByRange(group, *order, "tie").sortWithinPartitions(group, *order, "tie").drop("tie")
    placed = materialize(spread.withColumn("turn", F.monotonically_increasing_id()), "numbered")
    part = F.shiftright("turn", 33)
    spans = placed.groupBy(part.alias("part"), F.col(group).alias("span_group")).agg(F.min("turn").alias("first"), F.count(F.lit(1)).alias("n"))
    parts = spans.groupBy("part").agg(F.sum("n").alias("n"))
    before = parts.select("part", (F.sum("n").over(Window.orderBy("part")) - F.col("n")).alias("before"))
    inside = F.sum("n").over(Window.partitionBy("span_group").orderBy("part")) - F.col("n")
    spans = spans.join(before, "part").select("part", "span_group", "before", (inside - F.col("first")).alias("shift"))
    joined = placed.join(spans, (part == F.col("part")) & F.col(group).eqNullSafe(F.col("span_group")))
    at = F.col("before") + F.col("turn").bitwiseAND(F.lit((1 << 33) - 1))
    return joined.select(*rows.columns, at.alias("at"), (F.col("turn") + F.col("shift")).alias("pos"))


def levels(leaves: DataFrame, label: str) -> DataFrame:
    """All nodes above ``leaves(g, pos, n, first, last, digest)``, level by level, until each group has one node.

    ``n`` is the number of nodes of the group on that level, ``first`` and ``last`` bound the rows below a node. A node's row
    holds the digests of its children, one after the other. The number of rounds is the logarithm of the largest group.
    """
    found, level, current = None, 0, leaves
    largest = leaves.agg(F.max("n")).first()[0] or 0
    while largest > 1:
        level += 1
        kids = F.sort_array(F.collect_list(F.struct("pos", "digest")))["digest"]
        runs = (
            current.where("n > 1")
            .groupBy("g", F.floor(F.col("pos") / ARITY).alias("run"))
            .agg(F.first("n").alias("n"), F.min("first").alias("first"), F.max("last").alias("last"), kids.alias("kids"))
        )
        joined = runs.select(
            "g", F.lit(level).alias("level"), F.col("run").alias("pos"), F.ceil(F.col("n") / ARITY).alias("n"), "first", "last",
            F.unhex(F.array_join(F.transform("kids", F.hex), "")).alias("kids"),
        )
        current = materialize(joined.withColumn("digest", digest(hexed(F.col("kids")))), label)
        found = current if found is None else found.union(current)
        largest = -(-largest // ARITY)
    return leaves.sparkSession.createDataFrame([], "g long, level int, pos long, n long, first long, last long, kids binary, digest binary") if found is None else found


def parent_links(nodes: DataFrame, sources: int) -> DataFrame:
    """Node rows linked to their parents, a copy for every block of rows below the node.

    A row holds its own children's digests, its place below its parent, the parent's children's digests, and the parent's own
    link, so that one look-up climbs two levels. The root of a group is a leaf of the tree of sources; the root of all has no
    parent.
    """
    top = F.col("n") == 1
    leaf_of_sources = top & (F.col("g") != SOURCES) & F.lit(sources > 1)
    linked = nodes.select(
        "g", "level", "pos", "kids", "first", "last",
        F.when(leaf_of_sources, F.lit(SOURCES)).when(~top, F.col("g")).cast("long").alias("up_g"),
        F.when(leaf_of_sources, F.lit(1)).when(~top, F.col("level") + 1).cast("int").alias("up_level"),
        F.when(leaf_of_sources, F.col("g")).when(~top, F.col("pos")).cast("long").alias("up_from"),
    )
    blocks = F.explode(F.sequence(F.floor(F.col("first") / BLOCK), F.floor(F.col("last") / BLOCK)))
    rows = linked.select(
        blocks.alias("block"), "g", "level", "pos", "kids", "up_g", "up_level",
        F.floor(F.col("up_from") / ARITY).alias("up_pos"), (F.col("up_from") % ARITY).cast("int").alias("up_place"),
    )
    # a leaf's path takes every second row of its group, each of which also holds the row above
    above = rows.select(
        "block", F.col("g").alias("up_g"), F.col("level").alias("up_level"), F.col("pos").alias("up_pos"), F.col("kids").alias("up_kids"),
        F.col("up_g").alias("next_g"), F.col("up_level").alias("next_level"), F.col("up_pos").alias("next_pos"), F.col("up_place").alias("next_place"),
    )
    taken = rows.where((F.col("g") == SOURCES) | (F.col("level") % 2 == 1))
    return taken.join(above, ["block", "up_g", "up_level", "up_pos"], "left").drop("up_g", "up_level", "up_pos")


def _siblings(kids: str, place: str) -> tuple[str, str]:
    """SQL for the digests before and after a place."""
    return f"substring({kids}, 1, 32 * {place})", f"substring({kids}, 32 * {place} + 33)"


def _fold(kids: str, place: str, own: str) -> str:
    """SQL for the parent's digest, with ``own`` at its place among the children."""
    before, after = _siblings(kids, place)
    return f"unhex(sha2(lower(hex(concat({before}, {own}, {after}))), 256))"


_PARENT = _fold("n.kids", "c.place", "c.digest")
CLIMB = f"""
WITH RECURSIVE climb MAX RECURSION LEVEL 200 AS (
  SELECT at, 0 AS step, g, level, pos, place, digest, CAST('' AS BINARY) AS siblings FROM {{starts}}
  UNION ALL
  SELECT c.at, c.step + 1, n.next_g, n.next_level, n.next_pos, n.next_place,
    CASE WHEN n.up_kids IS NULL THEN {_PARENT} ELSE {_fold("n.up_kids", "n.up_place", _PARENT)} END,
    CASE WHEN n.up_kids IS NULL THEN concat({", ".join(_siblings("n.kids", "c.place"))})
      ELSE concat({", ".join(_siblings("n.kids", "c.place") + _siblings("n.up_kids", "n.up_place"))}) END
  FROM climb c JOIN {{nodes}} n ON n.block = c.at DIV {BLOCK} AND n.g = c.g AND n.level = c.level AND n.pos = c.pos
)
SELECT at, step, digest, siblings FROM climb
"""


def climb(starts: DataFrame, nodes: DataFrame) -> DataFrame:
    """``(at, folded, proof)`` for ``starts(at, g, level, pos, place, digest)``: the recursive query over the linked node rows.

    ``proof`` is the digest of all siblings met, from the leaf to the root. A start without a parent folds to itself.
    """
    spark = starts.sparkSession
    spark.conf.set("spark.sql.cteRecursionRowLimit", "-1")  # rows of the recursion grow with the input
    steps = spark.sql(CLIMB, starts=starts, nodes=nodes)
    met = F.sort_array(F.collect_list(F.struct("step", "siblings")))["siblings"]
    return steps.groupBy("at").agg(F.max_by("digest", "step").alias("folded"), met.alias("met")).select(
        "at", "folded", digest(F.lower(F.array_join(F.transform("met", F.hex), ""))).alias("proof")
    )


def manifest(
    docs: DataFrame, tampered: dict[str, Column] | None = None, fields: tuple[str, ...] = FIELDS, group_col: str = "source", order_col: str = "doc_id"
) -> DataFrame:
    """``(key, leaf, subroot, root, proof, folded, verified)`` per row of ``docs``; digests are 32 bytes.

    ``tampered`` replaces fields by other columns before the rows are folded again; the trees are those of the rows as they
    are. Null fields and null groups are values like others, null groups come first; null keys come first in their group.
    Repeated rows and keys are leaves of their own. A group of one row is its own root. Texts of any length are hashed where
    they are read, and nothing after that carries a text. An empty table gives no rows; other columns are ignored.
    """
    changed = tampered or {}
    plain, bent = ([values.get(f, F.col(f)) for f in fields] for values in ({}, changed))
    leaves = docs.select(
        F.col(group_col).cast("string").alias("source_group"),
        F.col(order_col).alias("key"),
        leaf_digest(plain).alias("leaf"),
        *([leaf_digest(bent).alias("bent")] if changed else []),
    )
    leaves = materialize(leaves.withColumn("bent", F.when(F.col("bent") != F.col("leaf"), F.col("bent"))) if changed else leaves.withColumn("bent", F.lit(None).cast("binary")), "leaves")
    rows = numbered(leaves, "source_group", ["key", "leaf"])
    sizes = rows.groupBy("source_group").agg(F.count(F.lit(1)).alias("n"), F.min("at").alias("first"), F.max("at").alias("last"))
    groups = materialize(numbered(sizes.withColumn("all", F.lit(0)), "all", ["source_group"]).select("source_group", "n", "first", "last", F.col("pos").alias("g")), "groups")
    sources = groups.count()
    named = groups.select(F.col("source_group").alias("name"), "n", "g")
    rows = materialize(rows.join(named, F.col("source_group").eqNullSafe(F.col("name"))).select("at", "key", "g", "pos", "n", "leaf", "bent"), "rows")
    lower = levels(rows.select("g", "pos", "n", F.col("at").alias("first"), F.col("at").alias("last"), F.col("leaf").alias("digest")), "level")
    single = rows.where("n = 1").select("g", F.col("leaf").alias("digest"))
    subroots = materialize(lower.where("n = 1").select("g", "digest").union(single), "subroots")
    tops = groups.join(subroots, "g").select(
        F.lit(SOURCES).cast("long").alias("g"), F.col("g").alias("pos"), F.lit(sources).cast("long").alias("n"), "first", "last", "digest"
    )
    upper = levels(tops, "level")
    top = (upper.where("n = 1") if sources > 1 else subroots).select("digest").first()  # the root: one row, none for an empty table
    root = F.lit(bytes(top[0]) if top else None).cast("binary")
    nodes = materialize(parent_links(lower.union(upper), sources), "nodes")
    alone, any_parent = F.col("n") == 1, (F.col("n") > 1) | F.lit(sources > 1)
    start = F.when(alone, F.col("g")).otherwise(F.col("pos"))
    starts = rows.where(any_parent).select(
        "at", F.when(alone, F.lit(SOURCES)).otherwise(F.col("g")).cast("long").alias("g"), F.lit(1).alias("level"),
        F.floor(start / ARITY).alias("pos"), (start % ARITY).cast("int").alias("place"), F.coalesce("bent", "leaf").alias("digest"),
    )
    lonely = rows.where(~any_parent).select("at", F.coalesce("bent", "leaf").alias("folded"), digest(F.lit("")).alias("proof"))
    folded = climb(starts, nodes).union(lonely)
    return (
        rows.join(subroots.withColumnRenamed("digest", "subroot"), "g")
        .join(folded, "at")
        .select("key", "leaf", "subroot", root.alias("root"), "proof", "folded", (F.col("folded") == root).alias("verified"))
    )


ORACLE = r"""
WITH RECURSIVE docs AS (
  SELECT doc_id, source, lang, n_chars, text,
    CASE WHEN (xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(string_split(doc_id::VARCHAR, ''), lambda c: ascii(c)::BIGINT)),
      lambda crc, b: list_reduce(list_prepend(xor(crc, b), range(8)), lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END)), 4294967295)) % 2 = 0
      THEN replace(text, chr(10), '') ELSE text END AS bent
  FROM documents
), leaves AS (
  SELECT doc_id, source, row_number() OVER (PARTITION BY source ORDER BY doc_id) - 1 AS p, count(*) OVER (PARTITION BY source) AS n, sha256(head || body) AS leaf, sha256(head || bent_body) AS start
  FROM (SELECT *,
    coalesce(strlen(doc_id::VARCHAR) || ':' || doc_id::VARCHAR, '-') || coalesce(strlen(source) || ':' || source, '-') || coalesce(strlen(lang) || ':' || lang, '-')
      || coalesce(strlen(n_chars::VARCHAR) || ':' || n_chars::VARCHAR, '-') AS head,
    coalesce(strlen(text) || ':' || text, '-') AS body, coalesce(strlen(bent) || ':' || bent, '-') AS bent_body FROM docs)
), low(l, source, p, n, d) AS (
  SELECT 0, source, p, n, leaf FROM leaves
  UNION ALL
  SELECT l + 1, source, p // 3, any_value((n + 2) // 3), sha256(string_agg(d, '' ORDER BY p)) FROM low WHERE n > 1 GROUP BY l, source, p // 3
), subs AS (
  SELECT source, d AS subroot, row_number() OVER (ORDER BY source NULLS FIRST) - 1 AS p, count(*) OVER () AS n FROM low WHERE n = 1
), high(l, p, n, d) AS (
  SELECT 0, p, n, subroot FROM subs
  UNION ALL
  SELECT l + 1, p // 3, any_value((n + 2) // 3), sha256(string_agg(d, '' ORDER BY p)) FROM high WHERE n > 1 GROUP BY l, p // 3
), climb(doc_id, source, p, l, n, folded, proof) AS (
  SELECT doc_id, source, p, 0, n, start, '' FROM leaves
  UNION ALL
  SELECT doc_id, source, p // 3, l + 1, (n + 2) // 3, sha256(before || folded || after), proof || before || after
  FROM (
    SELECT c.doc_id, c.source, c.p, c.l, c.n, c.folded, c.proof,
      coalesce(string_agg(s.d, '' ORDER BY s.p) FILTER (s.p < c.p), '') AS before, coalesce(string_agg(s.d, '' ORDER BY s.p) FILTER (s.p > c.p), '') AS after
    FROM climb c JOIN low s ON s.source IS NOT DISTINCT FROM c.source AND s.l = c.l AND s.p // 3 = c.p // 3
    WHERE c.n > 1 GROUP BY ALL
  )
), rise(doc_id, p, l, n, folded, proof) AS (
  SELECT c.doc_id, s.p, 0, s.n, c.folded, c.proof FROM climb c JOIN subs s ON s.source IS NOT DISTINCT FROM c.source WHERE c.n = 1
  UNION ALL
  SELECT doc_id, p // 3, l + 1, (n + 2) // 3, sha256(before || folded || after), proof || before || after
  FROM (
    SELECT c.doc_id, c.p, c.l, c.n, c.folded, c.proof,
      coalesce(string_agg(s.d, '' ORDER BY s.p) FILTER (s.p < c.p), '') AS before, coalesce(string_agg(s.d, '' ORDER BY s.p) FILTER (s.p > c.p), '') AS after
    FROM rise c JOIN high s ON s.l = c.l AND s.p // 3 = c.p // 3
    WHERE c.n > 1 GROUP BY ALL
  )
)
SELECT v.doc_id, v.leaf, s.subroot, h.d AS root, sha256(r.proof) AS proof_sha256, r.folded AS folded_root, r.folded = h.d AS verified
FROM leaves v JOIN subs s ON s.source IS NOT DISTINCT FROM v.source JOIN rise r ON r.doc_id = v.doc_id AND r.n = 1 JOIN high h ON h.n = 1
"""


@query("op12_recursive_manifest", ORACLE)
def op12_recursive_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    even = F.crc32(F.encode(F.col("doc_id").cast("string"), "UTF-8")) % 2 == 0
    bent = F.when(even, F.replace("text", F.lit("\n"), F.lit(""))).otherwise(F.col("text"))
    found = manifest(docs, {"text": bent})
    digests = [hexed(F.col(c)).alias(name) for c, name in (("leaf", "leaf"), ("subroot", "subroot"), ("root", "root"), ("proof", "proof_sha256"), ("folded", "folded_root"))]
    return found.select(F.col("key").alias("doc_id"), *digests, "verified")
