"""Document fingerprints as invertible Bloom lookup sketches, in column expressions only.

A text is the set of digests of its paragraphs: lines, in pieces of a few words. Every digest goes to three cells; a cell holds
how many came, the xor of the digests and the xor of their checks. Subtracting the sketches of two versions leaves the
digests that differ. A cell that one digest is left in gives it away; taking it out of its other cells frees more of them. If
cells are left over in the end, both sketches are built again with more cells, and after the largest size the sets themselves
are compared, so that a result is always exact.

Long texts are cut into sections by digest, each with a sketch of its own, which bounds the work per sketch.

Defined cases: null, empty and blank texts have no digests; two such texts are alike (1.0); repeated paragraphs count once;
repeated rows are handled each; an empty table gives an empty table; columns named like a result are replaced.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import window as W

from tickloom.llm.common import WORD, once

#: Words of a piece of a paragraph, digests per section, cells (per hash function) of the stored fingerprint, rounds of peeling.
PIECE, SECTION, CELLS, ROUNDS = 32, 256, 4, 24
PIECES = rf"{WORD}(?:[\x20\x09\x0B-\x0D]+{WORD}){{0,{PIECE - 1}}}"
#: Cells per digest that may differ, by retry. Three hash functions need 1.23 in the long run, small sets more.
RETRIES = (0.7, 1.5, 2.5)
#: Rows of one range of ids.
RANGE_ROWS = 1000

_CELL = "struct<c:int,n:int,key:bigint,chk:bigint>"
_NONE = f"array<{_CELL}>"


def digests(text: Column) -> Column:
    """The sorted distinct digests of a text's paragraph pieces: runs of words within a line."""
    found = F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(PIECES), F.lit(0))
    return F.sort_array(F.array_distinct(F.transform(found, lambda piece: F.xxhash64(piece))))


def _check(key: Column) -> Column:
    return F.xxhash64(key, F.lit(7))


def _entries(key: Column, n: Column, cells: Column) -> Column:
    """A digest's three cells, one in each third."""
    return F.array(*[F.named_struct(F.lit("c"), (F.pmod(F.xxhash64(key, F.lit(k)), cells) + cells * k).cast("int"), F.lit("n"), n,
                                    F.lit("key"), key, F.lit("chk"), _check(key)) for k in range(3)])


def _fold(entries: Column) -> Column:
    """Entries of equal cells are added up; cells that hold nothing go."""
    start = F.struct(F.array().cast(_NONE).alias("done"), F.lit(None).cast(_CELL).alias("cur"))

    def add(acc: Column, x: Column) -> Column:
        cur = acc["cur"]
        both = F.named_struct(F.lit("c"), x["c"], F.lit("n"), cur["n"] + x["n"], F.lit("key"), cur["key"].bitwiseXOR(x["key"]), F.lit("chk"), cur["chk"].bitwiseXOR(x["chk"]))
        return F.when(cur["c"] == x["c"], F.named_struct(F.lit("done"), acc["done"], F.lit("cur"), both)).otherwise(
            F.named_struct(F.lit("done"), _with(acc["done"], cur), F.lit("cur"), x))

    return F.aggregate(F.sort_array(entries), start, add, lambda acc: _with(acc["done"], acc["cur"]))


def _with(done: Column, cell: Column) -> Column:
    empty = cell.isNull() | ((cell["n"] == 0) & (cell["key"] == 0) & (cell["chk"] == 0))
    return F.when(empty, done).otherwise(F.concat(done, F.array(cell)))


def sketch(keys: Column, cells: Column, sign: int = 1) -> Column:
    """The non-empty cells of a set of digests, with 3 x ``cells`` cells in all."""
    return _fold(F.flatten(F.transform(keys, lambda k: _entries(k, F.lit(sign), cells))))


def subtract(a: Column, b: Column) -> Column:
    minus = F.transform(b, lambda x: F.named_struct(F.lit("c"), x["c"], F.lit("n"), -x["n"], F.lit("key"), x["key"], F.lit("chk"), x["chk"]))
    return _fold(F.concat(a, minus))


def peel(difference: Column, cells: Column) -> Column:
    """struct(cells: what is left, found: digests with the side they are on, 1 or -1)."""
    start = F.struct(difference.alias("cells"), F.array().cast("array<struct<n:int,key:bigint>>").alias("found"), F.lit(True).alias("live"))
    state3 = lambda cells, found, live: F.named_struct(F.lit("cells"), cells, F.lit("found"), found, F.lit("live"), live)

    def step(state: Column, _: Column) -> Column:
        pure = F.filter(state["cells"], lambda x: (F.abs(x["n"]) == 1) & (x["chk"] == _check(x["key"])))
        new = F.array_distinct(F.transform(pure, lambda x: F.named_struct(F.lit("n"), x["n"], F.lit("key"), x["key"])))
        gone = lambda s: F.flatten(F.transform(s, lambda k: _entries(k["key"], -k["n"], cells)))
        on = lambda s: F.when(F.size(s) == 0, state3(state["cells"], state["found"], F.lit(False))).otherwise(
            state3(_fold(F.concat(state["cells"], gone(s))), F.concat(state["found"], s), F.lit(True)))
        return F.when(~state["live"] | (F.size(state["cells"]) == 0), state).otherwise(F.get(F.transform(F.array(new), on), F.lit(0)))

    return F.aggregate(F.sequence(F.lit(1), F.lit(ROUNDS)), start, step)


def _sections(a: Column, b: Column) -> Column:
    return F.greatest(F.ceil(F.greatest(F.size(a), F.size(b)) / SECTION), F.lit(1)).cast("int")


def _attempt(a: Column, b: Column, per_digest: float) -> Column:
    """Per section: what is left after peeling the difference, and the digests found. Sketches are linear, so both sides' entries
    are added up at once, one side's negative."""
    n = _sections(a, b)
    bound = lambda value, use: F.get(F.transform(F.array(value), use), F.lit(0))

    def section(s: Column) -> Column:
        mine = lambda keys: F.when(n == 1, keys).otherwise(F.filter(keys, lambda k: F.pmod(F.xxhash64(k, F.lit(11)), n) == s))
        all_of = lambda x: F.concat(*[F.flatten(F.transform(x[side], lambda k: _entries(k, F.lit(sign), x["cells"]))) for side, sign in (("a", 1), ("b", -1))])  # noqa: E731, B023
        sized = lambda x: F.named_struct(F.lit("a"), x["a"], F.lit("b"), x["b"], F.lit("cells"), F.ceil((F.size(x["a"]) + F.size(x["b"]) + 6) * per_digest / 3).cast("int"))
        return bound(F.named_struct(F.lit("a"), mine(a), F.lit("b"), mine(b)), lambda x: bound(sized(x), lambda y: peel(_fold(all_of(y)), y["cells"])))

    return F.transform(F.sequence(F.lit(0), n - 1), section)


def with_difference(df: DataFrame, a: str, b: str, out: str) -> DataFrame:
    """Adds ``out``: struct(only_a, only_b: digests; retries), from the columns of digests ``a`` and ``b``."""
    failed = lambda t: t.isNull() | F.exists(t, lambda s: F.size(s["cells"]) > 0)
    d = df
    for k, size in enumerate(RETRIES):
        trial = _attempt(F.col(a), F.col(b), size)
        d = once(d, _try=F.when(failed(F.col("_try")), trial).otherwise(F.col("_try")) if k else trial,
                 _retries=F.when(failed(F.col("_try")), F.lit(k)).otherwise(F.col("_retries")) if k else F.lit(0))
    side = lambda n: F.transform(F.filter(F.flatten(F.transform("_try", lambda s: s["found"])), lambda x: x["n"] == n), lambda x: x["key"])
    peeled = F.struct(side(1).alias("only_a"), side(-1).alias("only_b"), F.col("_retries").alias("retries"))
    plain = F.struct(F.array_except(a, b).alias("only_a"), F.array_except(b, a).alias("only_b"), F.lit(len(RETRIES)).alias("retries"))
    return once(d, **{out: F.when(failed(F.col("_try")), plain).otherwise(peeled)}).drop("_try", "_retries")


def likeness(a: str, b: str, difference: str) -> Column:
    """Common digests by all digests; 1 where there are none."""
    gone = F.size(f"{difference}.only_a") + F.size(f"{difference}.only_b")
    every = (F.size(a) + F.size(b) + gone) / 2
    return F.when(every == 0, F.lit(1.0)).otherwise((every - gone) / every)


def fingerprint(keys: Column) -> Column:
    """A sketch of a fixed number of cells as text: the number of digests, then cell, count, digests and checks of each."""
    cell = lambda x: F.concat(F.hex(x["c"]), F.lit("."), F.hex(x["n"]), F.lit("."), F.lpad(F.hex(x["key"]), 16, "0"), F.lit("."), F.lpad(F.hex(x["chk"]), 16, "0"))
    return F.concat_ws(":", F.size(keys).cast("string"), F.array_join(F.transform(sketch(keys, F.lit(CELLS)), cell), ":"))


def with_next(docs: DataFrame, column: str, out: str, doc_id: str = "doc_id", rows: int = RANGE_ROWS) -> DataFrame:
    """Adds ``out``: ``column`` of the next row by descending id (after the last: of the first); null ids come last, equal ids
    by descending value. Ids are cut into ranges of about ``rows``; only first rows go from one range to another. All rows
    without an id are one range."""
    n, lo, hi = docs.agg(F.count(doc_id), F.min(doc_id), F.max(doc_id)).first()
    ranges = max(1, -(-n // rows))
    width = max(1, -(-((hi or 0) - (lo or 0) + 1) // ranges))
    part = F.coalesce(F.floor((F.col(doc_id) - F.lit(lo or 0)) / F.lit(width)).cast("long"), F.lit(-1))
    d = docs.withColumn("_part", part).repartition("_part")
    order = W.Window.partitionBy("_part").orderBy(F.desc_nulls_last(doc_id), F.desc_nulls_last(column))
    value = F.struct(F.col(column).alias("v"))
    heads = d.groupBy("_part").agg(F.max_by(value, F.struct(F.col(doc_id), F.col(column))).alias("_head"))
    parts = d.groupBy("_part").agg(F.count(F.lit(1)).alias("_rows"))
    follow = W.Window.orderBy(F.desc("_part"))
    after = parts.select("_part", F.coalesce(F.lead("_part").over(follow), F.max("_part").over(W.Window.partitionBy())).alias("_after"))
    heads = after.join(heads.withColumnRenamed("_part", "_after"), "_after").drop("_after")
    d = d.withColumn("_lead", F.lead(value).over(order)).join(heads, "_part")
    return d.withColumn(out, F.coalesce("_lead", "_head")["v"]).drop("_part", "_lead", "_head")
