"""Quality rules as a short-circuit cascade ordered by rejection per cost."""
from __future__ import annotations

import time
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gridlake.llm.shared import SPACE, text_or_empty

SYMBOLS = r"[#*$%&|<>]+"


@dataclass(frozen=True)
class Rule:
    """A name and a condition over the columns of `measured`; a true condition rejects the document."""

    name: str
    rejects: Column | str

    def condition(self) -> Column:
        column = F.expr(self.rejects) if isinstance(self.rejects, str) else self.rejects
        return F.coalesce(column, F.lit(False))


#: Thresholds follow the published heuristics for web text; each reads whole texts.
RULES = (
    Rule("symbols", "10 * n_symbols > n_words"),
    Rule("repeated lines", "2 * n_dup_lines > n_lines"),
    Rule("word length", "word_chars < 2 * n_words or word_chars > 15 * n_words"),
    Rule("capitals", r"2 * char_length(regexp_replace(t, '\\P{Lu}+', '')) > char_length(regexp_replace(t, '\\P{L}+', ''))"),
    Rule("shouting", "4 * regexp_count(t, '!') > n_words"),
    Rule("letters", r"10 * size(filter(words, w -> w rlike '\\p{L}')) < 7 * n_words"),
    Rule("few words", "n_words >= 200 and 20 * size(array_distinct(words)) < n_words"),
)


def measured(docs: DataFrame) -> DataFrame:
    """Adds t (the text, null as empty), its words and the base measures.

    Three-word windows are compared by 64-bit hashes within one text. All work is one
    expression per row, so nothing is shuffled and a long text costs n log n."""
    blanks = F.regexp_replace("t", SPACE, "")
    rows = (docs.withColumn("t", text_or_empty())
            .withColumn("words", F.array_remove(F.split("t", SPACE), ""))
            .withColumn("lines", F.filter(F.split("t", "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]")))
            .withColumn("n_words", F.size("words").cast("long"))
            .withColumn("n_lines", F.size("lines").cast("long"))
            .withColumn("word_chars", F.char_length(blanks).cast("long"))
            .withColumn("n_symbols", (F.char_length("t") - F.char_length(F.regexp_replace("t", SYMBOLS, ""))).cast("long"))
            .withColumn("n_dup_lines", F.col("n_lines") - F.size(F.array_distinct("lines")))
            .drop("lines"))
    rows = rows.withColumn("windows", F.expr(
        "case when n_words < 3 then array() else "
        "transform(sequence(0, cast(n_words as int) - 3), i -> xxhash64(words[i], words[i + 1], words[i + 2])) end"))
    rows = rows.withColumn("placed", F.expr(
        "case when size(array_distinct(windows)) < size(windows) then "
        "sort_array(transform(windows, (h, i) -> struct(h, i))) else array() end")).drop("windows")
    rows = rows.withColumn("hits", F.expr(
        "sort_array(transform(filter(placed, (x, j) -> coalesce(x.h = get(placed, j - 1).h, false) "
        "or coalesce(x.h = get(placed, j + 1).h, false)), x -> x.i))")).drop("placed")
    return rows.withColumn("n_repeat_words", F.expr(
        "aggregate(transform(hits, (p, j) -> least(3, coalesce(get(hits, j + 1) - p, 3))), 0L, (a, b) -> a + b)")).drop("hits")


def cascade_order(rows: DataFrame, rules=RULES, sample_rows: int = 512) -> list[Rule]:
    """The rules by rejected share per second, estimated on the first `sample_rows` rows.

    Only the order of evaluation depends on the sample and the clock, never a verdict:
    a document passes if no rule rejects it. A rule that rejects nothing in the sample
    goes last, cheapest first."""
    sample = rows.limit(sample_rows).persist()
    try:
        sample.count()
        figures = []
        for rule in rules:
            began = time.perf_counter()
            share = sample.agg(F.avg(rule.condition().cast("int"))).first()[0] or 0.0
            figures.append((share, max(time.perf_counter() - began, 1e-6), rule))
    finally:
        sample.unpersist()
    return [rule for share, cost, rule in sorted(figures, key=lambda x: (-x[0] / x[1], x[1]))]


def quality_cascade(docs: DataFrame, rules=RULES, sample_rows: int = 512) -> DataFrame:
    """All rows and columns of `docs` with the base measures, base_failed, rejected_by and kept.

    The rules stand in one CASE in the estimated order, so a rule runs only for texts that
    all earlier rules let pass. Null text counts as empty, has no words and fails the base
    rule. rejected_by is 'base', the first rejecting rule in cascade order, or null. Columns
    of `docs` with the names of the results are replaced; repeated rows stay, each judged."""
    made = ["t", "words", "n_words", "n_lines", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
            "base_failed", "rejected_by", "kept", "_row"]
    rows = measured(docs.drop(*made, "lines", "windows", "placed", "hits")).withColumn(
        "base_failed", F.expr("n_words < 50 or 100 * n_repeat_words > 50 * n_words"))
    order = cascade_order(rows, rules, sample_rows)
    # a row number keeps filters on the verdict above the measures, which otherwise are copied into them many times over
    rows = rows.withColumn("_row", F.monotonically_increasing_id())
    verdict = F.when(F.col("base_failed") | (F.col("_row") < 0), F.lit("base"))
    for rule in order:
        verdict = verdict.when(rule.condition(), F.lit(rule.name))
    return (rows.withColumn("rejected_by", verdict).withColumn("kept", F.col("rejected_by").isNull())
            .drop("t", "words", "_row"))
