"""License scan as an exact set-similarity join of text blocks (lines) with notice templates.

A block matches a template if it contains at least the threshold's share of the template's distinct words. Template words are
ordered by their frequency over all blocks of the corpus, rare first. A template can only be met by a block that has one
of its first ``size - needed + 1`` words (prefix filter), enough template words at all (length filter), and enough of them
left, on both sides, behind the first shared word (positional filter). What passes is verified once.

With ``wrapped``, runs of words that go over line ends are blocks as well, up to ``SPREAD`` times as long as the template, so
that a notice is found however its lines are wrapped. They are looked for in overlapping pieces of a text's words; a piece that
has a prefix word of a template and enough of its words (prefix and length filter) is verified run by run.

Defined cases: null and empty texts have no words and no labels; repeated rows are scanned each; blocks may be of any length;
an empty table gives an empty table; columns not asked for are not read. The row number that ties the parts of a row together
needs an input that reads the same again, such as files.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tickloom.llm.common import ascii_lower

#: What separates words once A-Z is lower-cased; words are ASCII letters and digits and everything beyond ASCII.
GAP = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"

#: Labels and notices. The words of each are matched as a set within a line.
TEMPLATES: list[tuple[str, str]] = [
    ("apache", "licensed under the apache license version"),
    ("bsd", "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met"),
    ("bsd", "released under the bsd license"),
    ("cc-by", "licensed under cc by"),
    ("cc-by", "this work is licensed under a creative commons attribution international license"),
    ("cc-by-nc", "licensed under cc by nc"),
    ("cc-by-sa", "licensed under cc by sa"),
    ("gpl", "licensed under the gnu general public license version"),
    ("gpl", "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license"),
    ("lgpl", "licensed under the gnu lesser general public license version"),
    ("mit", "released under the mit license"),
    ("mit", "licensed under the mit license"),
    ("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files"),
    ("mpl", "this source code form is subject to the terms of the mozilla public license"),
    ("public-domain", "this work is released into the public domain"),
    ("reserved", "all rights reserved"),
]
#: Share of a template's words that a block must contain, in percent.
THRESHOLD = 90
#: How many times as many words as a template has a run of words over line ends may have; words from one piece of a text to the next.
SPREAD, PIECE = 2, 256
#: Phrases that give a label wherever their words stand together.
PHRASES: list[tuple[str, str]] = [("cc by", "cc-by"), ("general public license", "gpl"), ("all rights reserved", "reserved")]


def needed(size: int, percent: int) -> int:
    return (size * percent + 99) // 100


def _spaced(text: Column) -> Column:
    """The words with one space between, before and behind them."""
    return F.concat(F.lit(" "), F.trim(F.regexp_replace(text, GAP, " ")), F.lit(" "))


def _spaces(text: Column) -> Column:
    return (F.length(text) - F.length(F.replace(text, F.lit(" "), F.lit("")))).cast("long")


def _strings(values: Sequence[str]) -> Column:
    return F.array(*map(F.lit, values)).cast("array<string>")


def _none() -> Column:
    return F.array().cast("array<struct<line:int,label:string,containment:double>>")


def block_words(text: Column, words: Sequence[str]) -> Column:
    """Per line: the distinct words that are in ``words``."""
    known = _strings(words)
    return F.transform(F.split(ascii_lower(text), "\n"), lambda line: F.array_intersect(F.split(F.regexp_replace(line, GAP, " "), " "), known))


def rare_first(docs: DataFrame, templates: Sequence[tuple[str, str]], text: str = "text") -> list[str]:
    """The templates' words by the number of blocks in the corpus that have them; as many rows as the templates have words."""
    words = sorted({w for _, notice in templates for w in notice.split()})
    blocks = docs.select(F.explode(block_words(F.col(text), words)).alias("b")).where(F.size("b") > 0)
    count = {r.w: r.n for r in blocks.select(F.explode("b").alias("w")).groupBy("w").agg(F.count(F.lit(1)).alias("n")).collect()}
    return sorted(words, key=lambda w: (count.get(w, 0), w))


def over_lines(words: Column, templates: Sequence[tuple[str, str]], percent: int, first_words: Sequence[str]) -> Column:
    """Per template that a run of ``words`` (a text's, in order) matches: no line, label, containment. Each piece goes on for as
    many words as the longest run has, so every run lies in one piece."""
    notices = [(label, sorted(set(notice.split())), SPREAD * len(notice.split())) for label, notice in templates]
    longest = max((n for *_, n in notices), default=1)
    known = F.array(*[F.struct(F.lit(label).alias("label"), _strings(t).alias("t"), F.lit(needed(len(t), percent)).alias("need"), F.lit(n).alias("n")) for label, t, n in notices])
    starts = F.sequence(F.lit(1), F.greatest(F.size(words), F.lit(1)), F.lit(PIECE))
    pieces = F.filter(F.transform(starts, lambda k: F.slice(words, k, F.lit(PIECE + longest))), lambda p: F.arrays_overlap(p, _strings(first_words)))

    def best(p: Column, x: Column) -> Column:
        runs = F.transform(F.sequence(F.lit(1), F.size(p)), lambda k: F.size(F.array_intersect(F.slice(p, k, x["n"]), x["t"])))
        return F.struct(F.lit(None).cast("int").alias("line"), x["label"].alias("label"), F.array_max(runs).alias("share"), x["need"].alias("need"), F.size(x["t"]).alias("size"))

    found = F.flatten(F.transform(pieces, lambda p: F.transform(F.filter(known, lambda x: F.size(F.array_intersect(p, x["t"])) >= x["need"]), lambda x: best(p, x))))
    return F.array_distinct(F.transform(F.filter(found, lambda m: m["share"] >= m["need"]),
                                        lambda m: F.struct(m["line"].alias("line"), m["label"].alias("label"), (m["share"] / m["size"]).alias("containment"))))


def scan(docs: DataFrame, templates: Sequence[tuple[str, str]] = TEMPLATES, percent: int = THRESHOLD, phrases: Sequence[tuple[str, str]] = PHRASES,
         text: str = "text", keep: Sequence[str] = ("doc_id",), wrapped: bool = False) -> DataFrame:
    """One row per row of ``docs``: the kept columns, n_words, n_base, first_word, last_word, base_labels and labels (arrays),
    matches (line, label, containment of each matching template) and score. With ``wrapped``, notices over line ends match
    too; their line is null, and they are left out where a line has the label with the same containment or a higher one."""
    spark = docs.sparkSession
    order = rare_first(docs, templates, text)
    place = {w: i + 1 for i, w in enumerate(order)}
    index = []
    for label, notice in templates:
        words = sorted({place[w] for w in notice.split()})
        need = needed(len(words), percent)
        index += [(label, words, need, i, w) for i, w in enumerate(words[: len(words) - need + 1])]
    first_words, shortest = sorted({r[4] for r in index}), min((r[2] for r in index), default=1)
    # a row for each prefix word of each template, whatever the input
    prefix = F.broadcast(spark.createDataFrame(index, "label string, t array<int>, need int, i int, word int"))

    ranks = F.transform(block_words(F.col("_text"), order), lambda b: F.sort_array(F.transform(b, lambda w: F.array_position(_strings(order), w).cast("int"))))
    lines = F.filter(F.transform(ranks, lambda b, k: F.named_struct(F.lit("line"), k, F.lit("b"), b)),
                     lambda x: (F.size(x["b"]) >= shortest) & F.arrays_overlap(x["b"], F.array(*map(F.lit, first_words)).cast("array<int>")))
    any_phrase = "(?<= )(?:" + "|".join(p for p, _ in phrases) + ")(?= )"
    d = docs.select(F.monotonically_increasing_id().alias("_row"), F.struct(*keep).alias("_keep"), F.coalesce(F.col(text), F.lit("")).alias("_text"))
    d = d.select("_row", "_keep", lines.alias("_lines"), F.contains("_text", F.lit("\n")).alias("_ends"), F.explode(F.array(_spaced(ascii_lower(F.col("_text"))))).alias("_s"))
    before = lambda c: _spaces(c) - 1
    over = _none()
    if wrapped and templates:
        over = over_lines(F.split(F.trim("_s"), " "), templates, percent, [order[w - 1] for w in first_words])
        over = F.when(F.col("_ends"), over).otherwise(_none())
    d = d.withColumn("n_base", F.regexp_count("_s", F.lit(any_phrase)).cast("long"))
    base = F.struct(
        F.greatest(F.when(F.length("_s") > 2, _spaces(F.col("_s")) - 1).otherwise(0), F.lit(0)).cast("long").alias("n_words"), "n_base",
        F.when(F.col("n_base") > 0, before(F.expr("substring(_s, 1, regexp_instr(_s, '" + any_phrase + "') - 1)"))).alias("first_word"),
        F.when(F.col("n_base") > 0, before(F.regexp_extract("_s", "(?s)^(.*)" + any_phrase, 1))).alias("last_word"),
        F.when(F.col("n_base") > 0, F.array_sort(F.array_distinct(F.array_compact(F.array(*[F.when(F.contains("_s", F.lit(f" {p} ")), F.lit(label)) for p, label in phrases])))))
        .otherwise(_strings([])).alias("base_labels"),
        over.alias("over"), "_keep")
    d = d.select("_row", "_lines", base.alias("base")).select("_row", "base", F.explode_outer("_lines").alias("l"))
    d = d.select("_row", "base", "l.line", "l.b", F.posexplode_outer("l.b").alias("j", "word"))
    small = (F.size("b") >= F.col("need")) & (F.least(F.size("t") - F.col("i"), F.size("b") - F.col("j")) >= F.col("need"))
    d = d.join(prefix, "word", "left").withColumn("try", F.coalesce(small & (F.size(F.array_intersect(F.slice("b", F.lit(1), F.col("j")), F.slice("t", F.lit(1), F.col("i")))) == 0), F.lit(False)))
    share = F.size(F.array_intersect("b", "t"))
    d = d.withColumn("match", F.when(F.col("try") & (share >= F.col("need")), F.struct("line", "label", (share / F.size("t")).alias("containment"))))
    d = d.groupBy("_row").agg(F.first("base").alias("b"), F.collect_set("match").alias("matches"))
    more = F.filter("b.over", lambda o: ~F.exists("matches", lambda m: (m["label"] == o["label"]) & (m["containment"] >= o["containment"])))
    d = d.select("b", F.concat("matches", more).alias("matches"))
    own = [c for c in keep if c not in ("n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "matches", "score")]
    labels = F.array_sort(F.array_distinct(F.concat("b.base_labels", F.transform("matches", lambda m: m["label"]))))
    best = F.coalesce(F.array_max(F.transform("matches", lambda m: m["containment"])), F.lit(0.0))
    return d.select(*[F.col(f"b._keep.{c}").alias(c) for c in own], *[f"b.{c}" for c in ("n_words", "n_base", "first_word", "last_word", "base_labels")],
                    labels.alias("labels"), "matches", F.when(F.col("b.n_base") > 0, F.lit(1.0)).otherwise(best).alias("score"))


def oracle() -> str:
    rows = ", ".join(f"('{label}', string_split('{notice}', ' '))" for label, notice in TEMPLATES)
    hits = {p: " AND ".join(f"w[i + {k}] = '{x}'" for k, x in enumerate(p.split())) for p, _ in PHRASES}
    places = ", ".join(f"list_filter(range(1, len(w) + 1), lambda i: {cond})" for cond in hits.values())
    labels = ", ".join(f"CASE WHEN len(list_filter(range(1, len(w) + 1), lambda i: {hits[p]})) > 0 THEN '{label}' END" for p, label in PHRASES)
    word = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
    return rf"""
WITH t AS (SELECT label, list_distinct(words) AS words FROM (VALUES {rows}) v(label, words)),
d AS (SELECT row_number() OVER () AS row_no, doc_id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS text FROM documents),
w AS (SELECT row_no, doc_id, regexp_extract_all(text, '{word}') AS w FROM d),
b AS (SELECT row_no, doc_id, w, flatten([{places}]) AS p, list_sort(list_distinct(list_filter([{labels}], lambda x: x IS NOT NULL))) AS base FROM w),
l AS (SELECT row_no, list_distinct(regexp_extract_all(line, '{word}')) AS words FROM (SELECT row_no, unnest(string_split(text, chr(10))) AS line FROM d)),
m AS (SELECT row_no, label, len(list_intersect(l.words, t.words)) / len(t.words) AS share FROM l, t
      WHERE len(list_intersect(l.words, t.words)) >= (len(t.words) * {THRESHOLD} + 99) // 100),
g AS (SELECT row_no, list(label) AS labels, max(share) AS share FROM m GROUP BY row_no)
SELECT doc_id, len(w)::BIGINT AS n_words, len(p)::BIGINT AS n_base, (list_min(p) - 1)::BIGINT AS first_word, (list_max(p) - 1)::BIGINT AS last_word,
       array_to_string(base, ',') AS base_labels, array_to_string(list_sort(list_distinct(list_concat(base, coalesce(labels, [])))), ',') AS labels,
       CASE WHEN len(p) > 0 THEN 1.0 ELSE coalesce(share, 0) END::DOUBLE AS score
FROM b LEFT JOIN g USING (row_no)
"""
