"""Rule bitmask ledger for text quality.

``ledger`` measures every text once and stores, next to the measurements, one
failure bit for each rule. A policy is a named, versioned set of rules: a mask.
``apply_policy`` keeps a row when none of its failure bits is in the mask, and
``ablations`` aggregates the masks (one row a distinct mask, then bit operations)
into what each policy keeps and what it would keep without each of its rules.
Changing a policy therefore never touches a text again.

All measurements are column expressions of the row's own text: no explode, no
shuffle. Words are ``[^\\x20\\x09-\\x0D]+``; lines are split at ``\\n``.

Defined results: null and empty texts have no words and fail ``few_words``; null
ids are carried through, repeated rows get equal results, other columns pass
unchanged (``ledger`` replaces columns of its own names); empty tables give no
rows; long texts cost n log n.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

WORD = r"[^\x20\x09-\x0D]+"
BLANKS = " \t\n\x0b\x0c\r"
SYMBOLS = "#*$%&|<>"

#: Rule name -> SQL condition of failure on the measurements; the position is the bit.
RULES: dict[str, str] = {
    "few_words": "n_words < 50",
    "repeated_words": "100 * n_repeat_words > 50 * n_words",
    "symbols": "100 * n_symbols > 10 * word_chars",
    "short_words": "word_chars < 2 * n_words",
    "long_words": "word_chars > 20 * n_words",
    "repeated_lines": "10 * n_dup_lines > 3 * n_lines",
}
#: Policy name and version -> its rules.
POLICIES: dict[str, tuple[str, ...]] = {
    "base_v1": ("few_words", "repeated_words"),
    "default_v1": ("few_words", "repeated_words", "symbols", "short_words", "long_words"),
    "default_v2": tuple(RULES),
}
CURRENT = "default_v2"
MEASURES = ("n_words", "word_chars", "n_symbols", "n_lines", "n_dup_lines", "n_repeat_words")


def mask(rules) -> int:
    return sum(1 << list(RULES).index(r) for r in rules)


def _let(value: Column, body) -> Column:
    """``body(value)`` with ``value`` computed once."""
    return F.transform(F.array(value), body)[0]


def _covered(starts: Column, width: int) -> Column:
    """Positions covered by windows of ``width`` at the ascending ``starts``."""
    gaps = F.zip_with(starts, F.slice(starts, 2, F.greatest(F.size(starts) - 1, F.lit(0))),
                      lambda a, b: F.least(F.coalesce(b - a, F.lit(width)), F.lit(width)))
    return F.aggregate(gaps, F.lit(0), lambda acc, x: acc + x)


def _repeat_words(words: Column) -> Column:
    """Words in 3-word windows that occur at least twice in the text."""
    def windows(w):
        return F.transform(F.sequence(F.lit(1), F.size(w) - 2), lambda i: F.xxhash64(F.element_at(w, i.cast("int")), F.element_at(w, (i + 1).cast("int")), F.element_at(w, (i + 2).cast("int"))))

    def located(h):
        """Start positions of repeated windows, from the windows sorted with their places."""
        pairs = F.sort_array(F.transform(h, lambda x, i: F.struct(x.alias("x"), i.alias("i"))))
        return _let(pairs, lambda p: _let(
            F.zip_with(p, F.slice(p, 2, F.size(p) - 1), lambda a, b: a["x"].eqNullSafe(b["x"])),
            lambda same: F.sort_array(F.filter(F.transform(p, lambda x, k: F.when(
                F.element_at(same, k + 1) | ((k > 0) & F.element_at(same, F.greatest(k, F.lit(1)))), x["i"])), lambda i: i.isNotNull()))))

    return F.when(F.size(words) < 4, F.lit(0)).otherwise(_let(windows(words), lambda h: F.when(
        F.size(F.array_distinct(h)) == F.size(h), F.lit(0)).otherwise(_let(located(h), lambda s: _covered(s, 3)))))


def measure(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """``docs`` with the measurements (``MEASURES``), all bigint."""
    t = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    length = F.char_length(t)
    words = F.regexp_extract_all(t, F.lit(f"({WORD})"), 1)
    lines = F.filter(F.split(t, "\n"), lambda x: F.char_length(F.translate(x, BLANKS, "")) > 0)
    got = F.struct(
        _let(words, lambda w: F.struct(F.size(w).alias("n"), _repeat_words(w).alias("r"))).alias("w"),
        F.char_length(F.translate(t, BLANKS, "")).alias("c"),
        (length - F.char_length(F.translate(t, SYMBOLS, ""))).alias("s"),
        _let(lines, lambda x: F.struct(F.size(x).alias("n"), (F.size(x) - F.size(F.array_distinct(x))).alias("d"))).alias("l"))
    keep = [F.col(f"`{c}`") for c in docs.columns if c not in MEASURES]
    m = F.col("_measured")
    return docs.select(*keep, got.alias("_measured")).select(
        *keep, m["w"]["n"].cast("bigint").alias("n_words"), m["c"].cast("bigint").alias("word_chars"), m["s"].cast("bigint").alias("n_symbols"),
        m["l"]["n"].cast("bigint").alias("n_lines"), m["l"]["d"].cast("bigint").alias("n_dup_lines"), m["w"]["r"].cast("bigint").alias("n_repeat_words"))


def ledger(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """``docs`` with measurements and ``fail_bits``: every rule evaluated once."""
    bits = " | ".join(f"CASE WHEN {cond} THEN {1 << k}L ELSE 0L END" for k, cond in enumerate(RULES.values()))
    return measure(docs, text_col).withColumn("fail_bits", F.expr(bits))


def apply_policy(rows: DataFrame, policy: str = CURRENT) -> DataFrame:
    """A ledger with ``kept`` under a policy."""
    return rows.withColumn("kept", F.col("fail_bits").bitwiseAND(F.lit(mask(POLICIES[policy]))) == 0)


def ablations(rows: DataFrame) -> DataFrame:
    """policy, rule, docs, kept, kept_without, only_this: per policy and rule.

    ``only_this`` counts rows that fail this rule and no other of the policy.
    """
    masks = rows.groupBy("fail_bits").agg(F.count(F.lit(1)).alias("n"))
    plan = [(p, r, mask(rs), 1 << list(RULES).index(r)) for p, rs in POLICIES.items() for r in rs]
    each = F.explode(F.array(*[F.struct(F.lit(p).alias("policy"), F.lit(r).alias("rule"), F.lit(m).cast("bigint").alias("mask"), F.lit(b).cast("bigint").alias("bit")) for p, r, m, b in plan]))
    hit = F.col("fail_bits").bitwiseAND(F.col("e.mask"))
    return masks.select("fail_bits", "n", each.alias("e")).groupBy("e.policy", "e.rule").agg(
        F.sum("n").alias("docs"), F.sum(F.when(hit == 0, F.col("n")).otherwise(0)).alias("kept"),
        F.sum(F.when(hit.bitwiseAND(F.bitwise_not("e.bit")) == 0, F.col("n")).otherwise(0)).alias("kept_without"),
        F.sum(F.when(hit == F.col("e.bit"), F.col("n")).otherwise(0)).alias("only_this"))
