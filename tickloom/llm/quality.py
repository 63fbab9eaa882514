"""Quality rules kept in a bitmask ledger.

Every rule is evaluated once for each document. The ledger stores what was measured and one bit per failed rule; policies are
versioned sets of rules applied to the bits later, and ablations (what a policy would lose or keep without one of its rules)
are bitwise aggregates over the ledger, so neither reads a text again.

Defined cases: a null text has no words and fails the rules that an empty one fails; repeated rows are judged each; an empty
table gives an empty ledger; columns named like a result are replaced; a text of any length is measured whole.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tickloom.llm.common import SPACE, WORD, once

SYMBOLS = "#*$%&|<>"
MEASURES = ["n_words", "word_chars", "n_symbols", "n_lines", "n_dup_lines", "n_repeat_words"]

#: Each rule's bit, name and failing condition.
RULES: list[tuple[str, str]] = [
    ("few_words", "n_words < 50"),
    ("repeated_windows", "100 * n_repeat_words > 50 * n_words"),
    ("symbols", "10 * n_symbols > n_words"),
    ("repeated_lines", "2 * n_dup_lines > n_lines"),
    ("short_words", "word_chars < 2 * n_words"),
    ("long_words", "word_chars > 20 * n_words"),
    ("many_words", "n_words > 100000"),
]
BIT = {name: 1 << i for i, (name, _) in enumerate(RULES)}

#: Policies by version.
POLICIES: dict[str, list[str]] = {
    "base": ["few_words", "repeated_windows"],
    "v1": ["few_words", "repeated_windows", "symbols", "repeated_lines", "short_words", "long_words"],
}


def mask(policy: str) -> int:
    return sum(BIT[name] for name in POLICIES[policy])


def measure(docs: DataFrame, text: str = "text") -> DataFrame:
    """Adds the measurements (all long).

    Words in repeated windows: the windows' hashes are sorted with their places; places whose neighbour in that order has
    the same hash are repeated, and each adds the words up to the next such place, three at most.
    """
    lines = F.filter(F.split(F.col("_t"), "\n"), lambda x: x.rlike(WORD))
    kept = [c for c in docs.columns if c not in MEASURES]  # under names of their own meanwhile
    d = docs.select(*[docs[f"`{c}`"].alias(f"_{k}") for k, c in enumerate(kept)], F.coalesce(F.col(text), F.lit("")).alias("_t"))
    d = once(d, _w=F.filter(F.split("_t", SPACE), lambda x: x != ""), _l=lines)
    n = F.size("_w")
    windows = F.transform(F.sequence(F.lit(1), n - 2), lambda i: F.xxhash64(F.get("_w", i - 1), F.get("_w", i), F.get("_w", i + 1)))
    d = once(d, _h=F.when(n > 2, windows).otherwise(F.array().cast("array<bigint>")))
    placed = F.sort_array(F.transform("_h", lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
    d = once(d, _p=F.when(F.size(F.array_distinct("_h")) < F.size("_h"), placed).otherwise(F.array().cast("array<struct<h:bigint,i:int>>")))
    same = lambda x, k: F.coalesce((F.get("_p", k - 1)["h"] == x["h"]) | (k == -1), F.lit(False)) | F.coalesce(F.get("_p", k + 1)["h"] == x["h"], F.lit(False))
    d = once(d, _s=F.sort_array(F.transform(F.filter("_p", same), lambda x: x["i"])))
    covered = F.aggregate(
        F.zip_with("_s", F.slice("_s", 2, F.greatest(F.size("_s") - 1, F.lit(0))), lambda a, b: F.least(F.coalesce(b - a, F.lit(3)), F.lit(3))),
        F.lit(0).cast("bigint"), lambda total, x: total + x)
    values = {
        "n_words": n.cast("long"),
        "word_chars": F.length(F.regexp_replace("_t", SPACE, "")).cast("long"),
        "n_symbols": (F.length("_t") - F.length(F.translate("_t", SYMBOLS, ""))).cast("long"),
        "n_lines": F.size("_l").cast("long"),
        "n_dup_lines": (F.size("_l") - F.size(F.array_distinct("_l"))).cast("long"),
        "n_repeat_words": covered,
    }
    return d.select(*[F.col(f"_{k}").alias(c) for k, c in enumerate(kept)], *[v.alias(c) for c, v in values.items()])


def ledger(docs: DataFrame, text: str = "text") -> DataFrame:
    """``docs`` with the measurements and ``failures``, a long with one bit per failed rule."""
    d = measure(docs, text)
    bits = [F.when(F.expr(rule), F.lit(BIT[name])).otherwise(0) for name, rule in RULES]
    return d.withColumn("failures", sum(bits[1:], bits[0]).cast("long"))


def apply_policy(rows: DataFrame, policy: str, out: str = "kept") -> DataFrame:
    return rows.withColumn(out, F.col("failures").bitwiseAND(F.lit(mask(policy))) == 0)


def ablations(rows: DataFrame, policy: str, *by: str) -> DataFrame:
    """Per rule of the policy (and group): documents that fail it, that fail it alone (kept without it), and that another rule
    of the policy rejects too; with the bits that any and all documents of the group fail."""
    m = mask(policy)
    per = rows.groupBy(*by, F.col("failures").bitwiseAND(F.lit(m)).alias("bits")).agg(F.count(F.lit(1)).alias("n"))
    rule = F.explode(F.array(*[F.struct(F.lit(name).alias("rule"), F.lit(BIT[name]).alias("bit")) for name in POLICIES[policy]])).alias("r")
    hit = F.col("bits").bitwiseAND(F.col("r.bit")) != 0
    total = lambda c: F.coalesce(F.sum(F.when(c, F.col("n"))), F.lit(0)).alias
    return per.select(*by, "bits", "n", rule).groupBy(*by, F.col("r.rule").alias("rule")).agg(
        total(hit)("failed"), total(F.col("bits") == F.col("r.bit"))("alone"), total(hit & (F.col("bits") != F.col("r.bit")))("shared"),
        F.sum("n").alias("documents"), F.bit_or("bits").alias("any_bits"), F.bit_and("bits").alias("all_bits"))


ORACLE = r"""
WITH t AS (SELECT doc_id, coalesce(text, '') AS text FROM documents),
w AS (SELECT doc_id, text, regexp_extract_all(text, '[^\x20\x09-\x0D]+') AS w,
             list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS l FROM t),
p AS (SELECT row_number() OVER () AS row_no, * FROM w),
g AS (SELECT row_no, i, w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] AS gram
      FROM (SELECT row_no, w, unnest(range(1, len(w) - 1)) AS i FROM p)),
r AS (SELECT row_no, i FROM (SELECT row_no, i, count(*) OVER (PARTITION BY row_no, gram) AS n FROM g) WHERE n > 1),
c AS (SELECT row_no, sum(least(3, coalesce(next - i, 3)))::BIGINT AS n_repeat_words
      FROM (SELECT row_no, i, lead(i) OVER (PARTITION BY row_no ORDER BY i) AS next FROM r) GROUP BY row_no),
m AS (SELECT doc_id, len(w)::BIGINT AS n_words, length(regexp_replace(text, '[\x20\x09-\x0D]+', '', 'g'))::BIGINT AS word_chars,
             (length(text) - length(translate(text, '#*$%&|<>', '')))::BIGINT AS n_symbols, len(l)::BIGINT AS n_lines,
             (len(l) - len(list_distinct(l)))::BIGINT AS n_dup_lines, coalesce(n_repeat_words, 0) AS n_repeat_words
      FROM p LEFT JOIN c USING (row_no)),
b AS (SELECT *, ((n_words < 50)::INT + 2 * (100 * n_repeat_words > 50 * n_words)::INT + 4 * (10 * n_symbols > n_words)::INT
                 + 8 * (2 * n_dup_lines > n_lines)::INT + 16 * (word_chars < 2 * n_words)::INT + 32 * (word_chars > 20 * n_words)::INT
                 + 64 * (n_words > 100000)::INT)::BIGINT AS failures FROM m)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, (failures & 3) > 0 AS base_failed, (failures & 63) = 0 AS kept,
       n_lines, failures FROM b
"""
