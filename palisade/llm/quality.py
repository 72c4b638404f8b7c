"""Quality rules as a bitmask ledger, in DataFrame expressions only.

Every rule is evaluated once per document. The ledger stores the measurements and one bit per failed rule; versioned policies
and ablations are bit operations on the ledger and never read a text again.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from palisade.llm.registry import query

SPACES = " \t\n\x0b\x0c\r"
SYMBOLS = "#*$%&|<>"
WINDOW = 5


@dataclass(frozen=True)
class Rule:
    """A named rule; it fails where ``fails``, over a struct of measurements, is true."""

    name: str
    fails: Callable[[Column], Column]


#: Bit i of the ledger belongs to rule i; only append, so that stored ledgers keep their meaning.
RULES = (
    Rule("too_few_words", lambda m: m["n_words"] < 10),
    Rule("repeated_windows", lambda m: 100 * m["n_repeat_words"] > 20 * m["n_words"]),
    Rule("many_symbols", lambda m: 10 * m["n_symbols"] > 3 * m["n_words"]),
    Rule("repeated_lines", lambda m: 2 * m["n_dup_lines"] > m["n_lines"]),
    Rule("shouting", lambda m: 2 * m["n_upper"] > m["n_letters"]),
    Rule("few_letters", lambda m: 2 * m["n_letters"] < m["word_chars"]),
    Rule("long_words", lambda m: m["word_chars"] > 25 * m["n_words"]),
    Rule("exclamations", lambda m: 5 * m["n_exclamations"] > m["n_words"]),
)

#: Versions of the policy: the rules that reject a document.
POLICIES = {
    "base": ("too_few_words", "repeated_windows"),
    "v1": ("too_few_words", "repeated_windows", "many_symbols", "repeated_lines"),
    "v2": tuple(rule.name for rule in RULES),
}


def mask(names: tuple[str, ...], rules: tuple[Rule, ...] = RULES) -> int:
    """Bits of the named rules."""
    places = {rule.name: i for i, rule in enumerate(rules)}
    return sum(1 << places[name] for name in set(names))


def _without(text: Column, characters: str) -> Column:
    for character in characters:
        text = F.replace(text, F.lit(character), F.lit(""))
    return text


def repeated_words(words: Column, window: int = WINDOW) -> Column:
    """Words inside windows of ``window`` words that occur twice or more, each word counted once.

    Windows are compared by a 64-bit hash. Only a text with a repeated window pays for sorting: its windows are sorted by
    hash, neighbours with equal hashes give their positions, and the union of the spans at the sorted positions is summed.
    """
    hashes = F.transform(F.sequence(F.lit(1), F.size(words) - (window - 1)), lambda i: F.xxhash64(F.slice(words, i, F.lit(window))))

    def covered(found: Column) -> Column:
        marked = F.array_sort(F.transform(found, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))

        def spans(order: Column) -> Column:
            def repeated(x: Column, k: Column) -> Column:
                return (F.get(order, k - 1)["h"] == x["h"]) | (F.get(order, k + 1)["h"] == x["h"])

            kept = F.filter(F.transform(order, lambda x, k: F.when(repeated(x, k), x["i"])), lambda i: i.isNotNull())
            return _bind(F.array_sort(kept), lambda at: F.aggregate(
                F.transform(at, lambda i, k: F.least(F.coalesce(F.get(at, k + 1) - i, F.lit(window)), F.lit(window))), F.lit(0), lambda a, b: a + b))

        return _bind(marked, spans)

    return F.when(F.size(words) < window + 1, F.lit(0)).otherwise(
        _bind(hashes, lambda found: F.when(F.size(F.array_distinct(found)) == F.size(found), F.lit(0)).otherwise(covered(found)))
    ).cast("long")


def _bind(value: Column, use) -> Column:
    """``use(value)`` with ``value`` evaluated once."""
    return F.transform(F.array(value), use)[0]


def measurements(text: Column) -> Column:
    """Struct of all measurements of a whole text; a null text measures as empty."""
    whole = F.coalesce(text, F.lit(""))

    def measured(t: Column) -> Column:
        words = F.filter(F.split(t, f"[{SPACES}]+"), lambda w: w != "")
        lines = F.filter(F.split(t, "\n"), lambda line: F.btrim(line, F.lit(SPACES)) != "")
        letters = F.length(t) - F.length(F.regexp_replace(t, r"\p{L}+", ""))
        # an upper-case letter is one that lower-casing changes; whole runs are taken away at a time
        upper = F.length(t) - F.length(F.regexp_replace(t, r"\p{Lu}+", ""))

        def over_words(w: Column) -> Column:
            return F.struct(
                F.size(w).cast("long").alias("n_words"),
                F.length(F.array_join(w, "")).cast("long").alias("word_chars"),
                (F.length(t) - F.length(_without(t, SYMBOLS))).cast("long").alias("n_symbols"),
                F.size(lines).cast("long").alias("n_lines"),
                (F.size(lines) - F.size(F.array_distinct(lines))).cast("long").alias("n_dup_lines"),
                repeated_words(w).alias("n_repeat_words"),
                letters.cast("long").alias("n_letters"),
                upper.cast("long").alias("n_upper"),
                (F.length(t) - F.length(F.replace(t, F.lit("!"), F.lit("")))).cast("long").alias("n_exclamations"),
            )

        return _bind(words, over_words)

    return _bind(whole, measured)


def failure_bits(m: Column, rules: tuple[Rule, ...] = RULES) -> Column:
    """One bit per failed rule, over a struct of measurements."""
    bits = F.lit(0).cast("long")
    for place, rule in enumerate(rules):
        bits = bits.bitwiseOR(F.when(rule.fails(m), F.lit(1 << place).cast("long")).otherwise(F.lit(0).cast("long")))
    return bits


def ledger(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """``(id, measurements..., failed)``, a row per row of ``docs``, in one narrow pass.

    Null text measures as empty and fails the rule on few words. Null and repeated ids keep their rows, an empty table gives
    an empty ledger, other columns are ignored whatever their names.
    """
    measured = docs.select(F.col(id_col).alias("id"), measurements(F.col(text_col)).alias("m"))
    return measured.select("id", "m.*", failure_bits(F.col("m"), rules).alias("failed"))


def apply_policy(ledger_rows: DataFrame, names: tuple[str, ...], rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """The ledger with ``kept``: true where none of the named rules failed."""
    return ledger_rows.withColumn("kept", F.col("failed").bitwiseAND(F.lit(mask(names, rules))) == 0)


def ablations(ledger_rows: DataFrame, policies: dict[str, tuple[str, ...]] = POLICIES, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """``(version, rule, n_failed, n_only, n_kept, n_kept_without)`` for every rule of every policy.

    Documents are first counted by their bit pattern, at most two to the number of rules; everything else is bit
    operations on that table. ``n_only``: rejected by this rule alone, so that leaving the rule out would keep them.
    """
    patterns = ledger_rows.groupBy("failed").agg(F.count(F.lit(1)).alias("n"))
    entries = [F.struct(F.lit(version).alias("version"), F.lit(name).alias("rule"), F.lit(mask(names, rules)).alias("mask"), F.lit(mask((name,), rules)).alias("bit"))
               for version, names in policies.items() for name in names]
    each = patterns.select("failed", "n", F.explode(F.array(*entries)).alias("p")).select("failed", "n", "p.*")
    hit = F.col("failed").bitwiseAND(F.col("mask"))

    def total(condition: Column) -> Column:
        return F.coalesce(F.sum(F.when(condition, F.col("n"))), F.lit(0))

    return each.groupBy("version", "rule").agg(
        total(F.col("failed").bitwiseAND(F.col("bit")) != 0).alias("n_failed"),
        total(hit == F.col("bit")).alias("n_only"),
        total(hit == 0).alias("n_kept"),
        total((hit == 0) | (hit == F.col("bit"))).alias("n_kept_without"),
    )


def keep_good(docs: DataFrame, text_col: str = "text", version: str = "v2") -> DataFrame:
    """Rows of ``docs`` that the policy keeps, with the columns of ``docs`` as they are.

    Null and empty texts have too few words and go. Repeated rows are judged alike and each stays or goes; an empty table stays
    empty. Columns of any names come through untouched.
    """
    failed = _bind(measurements(F.col(text_col)), lambda m: failure_bits(m))
    return docs.where(failed.bitwiseAND(F.lit(mask(POLICIES[version]))) == 0)


ORACLE = r"""
WITH t AS (SELECT doc_id, coalesce(text, '') AS text FROM documents),
w AS (
  SELECT doc_id, text, list_filter(regexp_split_to_array(text, '[ \t\n\x0b\x0c\r]+'), lambda x: x <> '') AS words,
    list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^ \t\n\x0b\x0c\r]')) AS lines FROM t
), g AS (
  SELECT doc_id, unnest(range(1, len(words) - 3)) AS i, unnest(list_transform(range(1, len(words) - 3), lambda i: array_to_string(words[i:i + 4], ' '))) AS gram FROM w WHERE len(words) > 4
), twice AS (SELECT doc_id, gram FROM g GROUP BY doc_id, gram HAVING count(*) > 1),
covered AS (
  SELECT doc_id, count(DISTINCT i + k) AS n FROM g JOIN twice USING (doc_id, gram), (SELECT unnest(range(0, 5)) AS k) GROUP BY doc_id
), m AS (
  SELECT w.doc_id, len(words)::BIGINT AS n_words, length(array_to_string(words, ''))::BIGINT AS word_chars,
    (length(text) - length(regexp_replace(text, '[#*$%&|<>]', '', 'g')))::BIGINT AS n_symbols,
    len(lines)::BIGINT AS n_lines, (len(lines) - len(list_distinct(lines)))::BIGINT AS n_dup_lines, coalesce(n, 0)::BIGINT AS n_repeat_words,
    length(text) - length(regexp_replace(text, '\p{L}', '', 'g')) AS n_letters, length(text) - length(regexp_replace(text, '\p{Lu}', '', 'g')) AS n_upper,
    length(text) - length(replace(text, '!', '')) AS n_exclamations
  FROM w LEFT JOIN covered c ON c.doc_id = w.doc_id
), b AS (SELECT *, n_words < 10 OR 100 * n_repeat_words > 20 * n_words AS base_failed FROM m)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
  NOT (base_failed OR 10 * n_symbols > 3 * n_words OR 2 * n_dup_lines > n_lines OR 2 * n_upper > n_letters OR 2 * n_letters < word_chars
    OR word_chars > 25 * n_words OR 5 * n_exclamations > n_words) AS kept
FROM b
"""


@query("op2_rule_ledger", ORACLE)
def op2_rule_ledger(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = ledger(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    failed = F.col("failed")
    return rows.select(
        F.col("id").alias("doc_id"), "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
        (failed.bitwiseAND(F.lit(mask(POLICIES["base"]))) != 0).alias("base_failed"),
        (failed.bitwiseAND(F.lit(mask(POLICIES["v2"]))) == 0).alias("kept"),
    )
