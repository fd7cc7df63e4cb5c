"""Quality rules by a learned decision list, with DataFrame functions only.

Each text gets its statistics in one pass of built-in expressions. From the statistics of labelled rows
sequential covering learns rules for the class "poor": a rule grows by the threshold condition with the
greatest gain on the growing rows, is pruned to its best prefix on the other rows, and is kept if it
is precise enough there; rows that it covers are then set aside. The rules, in order, become one
conditional expression.

The learner sees ``SAMPLE`` labelled rows at most, picked by a hash of the id, as counts by quantile cells;
the driver gets the counts of single conditions only. Null and empty texts have no words; rows with null labels
aren't learned from; of repeated labels the lowest holds. With no labels or no rule good enough, the list is
empty and keeps everything that the base rule keeps. Repeated rows are rows of their own.
"""

from __future__ import annotations

from math import log2

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import stored, table

NAME = "op7_quality"
SAMPLE = 20_000
QUANTILES = 24
MAX_RULES, MAX_TERMS = 8, 3
#: Least precision of a rule, and least rows that it covers, on the rows that prune it.
PRECISION, LEAST = 0.9, 3
_WORD = r"([^\\x20\\x09-\\x0D]+)"
_BLANKS = " \t\n\x0b\x0c\r"
FEATURES = ["n_words", "word_length", "symbols", "dup_lines", "repeats", "capitals", "marks"]

#: Sorted (part of a window's hash, position) numbers: only windows with an equal neighbour can be repeats. These are sorted by their
#: words (which hold no blank), and equal neighbours are repeated windows; then the words that these cover.
_REPEATS = f"""
transform(array(regexp_extract_all(t, '{_WORD}', 1)), w -> if(size(w) < 4, 0L,
  transform(array(length(bin(size(w)))), bits ->
    transform(array(sort_array(transform(sequence(0, size(w) - 3), i -> shiftleft(xxhash64(w[i], w[i + 1], w[i + 2]), bits) | cast(i AS bigint)))), keys ->
      transform(array(sort_array(transform(
        filter(keys, (k, j) ->
          (j > 0 AND shiftright(k, bits) = shiftright(keys[if(j > 0, j - 1, 0)], bits))
          OR (j < size(keys) - 1 AND shiftright(k, bits) = shiftright(keys[if(j < size(keys) - 1, j + 1, j)], bits))),
        k -> transform(array(cast(k & (shiftleft(1L, bits) - 1) AS int)), p -> named_struct('s', concat_ws(' ', w[p], w[p + 1], w[p + 2]), 'p', cast(p AS bigint)))[0]))), full ->
        transform(array(sort_array(transform(
          filter(full, (x, j) ->
            (j > 0 AND x.s = full[if(j > 0, j - 1, 0)].s)
            OR (j < size(full) - 1 AND x.s = full[if(j < size(full) - 1, j + 1, j)].s)),
          x -> x.p))), pos ->
          aggregate(transform(pos, (p, j) -> if(j < size(pos) - 1, least(3L, pos[if(j < size(pos) - 1, j + 1, j)] - p), 3L)), 0L, (a, x) -> a + x)
        )[0])[0])[0])[0]))[0]
"""


def _without(text: Column, letters: str) -> Column:
    return F.length(F.translate(text, letters, "")).cast("bigint")


def statistics(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """One row of counts for each text, and how many lines it has."""
    rows = docs.select(F.col(id_column).alias(id_column), F.coalesce(F.col(text_column), F.lit("")).alias("t"))
    t = F.col("t")
    size = F.length(t).cast("bigint")
    lines = F.filter(F.split(t, "\n", -1), lambda x: F.length(F.translate(x, _BLANKS, "")) > 0)
    return rows.select(
        id_column,
        F.regexp_count(t, F.lit(r"[^\x20\x09-\x0D]+")).cast("bigint").alias("n_words"),
        _without(t, _BLANKS).alias("word_chars"),
        (size - _without(t, "#*$%&|<>")).alias("n_symbols"),
        F.transform(F.array(lines), lambda x: F.size(x) - F.size(F.array_distinct(x)))[0].cast("bigint").alias("n_dup_lines"),
        F.expr(_REPEATS).cast("bigint").alias("n_repeat_words"),
        (size - _without(t, "ABCDEFGHIJKLMNOPQRSTUVWXYZ")).alias("n_capitals"),
        (size - _without(t, "!?")).alias("n_marks"),
        (size - _without(t, "\n") + 1).alias("n_lines"),
    )


def features() -> dict[str, Column]:
    words = F.greatest(F.col("n_words"), F.lit(1))
    per = lambda c: F.col(c) / words
    return {
        "n_words": F.col("n_words").cast("double"),
        "word_length": per("word_chars"),
        "symbols": per("n_symbols"),
        "dup_lines": F.col("n_dup_lines") / F.col("n_lines"),
        "repeats": per("n_repeat_words"),
        "capitals": F.col("n_capitals") / F.greatest(F.col("word_chars"), F.lit(1)),
        "marks": per("n_marks"),
    }


def base_failed() -> Column:
    return (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))


def _cell_test(term: tuple[str, bool, int]) -> Column:
    f, above, cell = term
    return F.col(f) > cell if above else F.col(f) <= cell


def _all(terms, test) -> Column:
    out = F.lit(True)
    for t in terms:
        out = out & test(t)
    return out


def _best_term(rows: DataFrame, covered: Column, terms: list) -> tuple | None:
    """The condition with the greatest gain on the rows that ``terms`` cover, from the counts of cells."""
    cells = rows.where(~covered & _all(terms, _cell_test)).select("poor", "n", F.explode(F.array(*[F.struct(F.lit(f).alias("f"), F.col(f).alias("cell")) for f in FEATURES])).alias("x"))
    got = cells.groupBy("x.f", "x.cell").agg(F.sum(F.when(F.col("poor"), F.col("n")).otherwise(0)).alias("p"), F.sum("n").alias("n")).collect()
    counts: dict[str, dict[int, tuple[int, int]]] = {}
    for r in got:
        counts.setdefault(r["f"], {})[r["cell"]] = (r["p"], r["n"])
    best, most = None, 1e-9
    for f in FEATURES:
        here = counts.get(f, {})
        p_all, n_all = sum(p for p, _ in here.values()), sum(n for _, n in here.values())
        if not p_all or p_all == n_all:
            continue
        p = n = 0
        for cell in sorted(here)[:-1]:
            p, n = p + here[cell][0], n + here[cell][1]
            for above, pp, nn in ((False, p, n), (True, p_all - p, n_all - n)):
                gain = pp * (log2(pp / nn) - log2(p_all / n_all)) if pp else 0
                if gain > most:
                    best, most = (f, above, cell), gain
    return best


def learn(stats: DataFrame, labels: DataFrame, id_column: str = "doc_id", sample: int = SAMPLE) -> list[list[tuple[str, bool, float]]]:
    """Rules as lists of (feature, above?, threshold); ``labels`` has ``id_column`` and ``quality`` (0 is poor)."""
    known = labels.where(f"quality IS NOT NULL AND `{id_column}` IS NOT NULL").groupBy(id_column).agg((F.min("quality") == 0).alias("poor"))
    n = known.count()
    if not n:
        return []
    draw = F.pmod(F.xxhash64(id_column, F.lit(1)), F.lit(1 << 30)) < int(min(1.0, sample / n) * (1 << 30))
    seen = stored(stats.join(known.where(draw), id_column).select("poor", (F.pmod(F.xxhash64(id_column, F.lit(2)), F.lit(3)) > 0).alias("grows"), *[c.alias(f) for f, c in features().items()]), "labelled")
    cuts = seen.agg(*[F.percentile_approx(f, [i / QUANTILES for i in range(1, QUANTILES)], 10_000).alias(f) for f in FEATURES]).first()
    if cuts[0] is None:
        return []
    steps = {f: sorted(set(cuts[f])) for f in FEATURES}
    cell = lambda f: F.size(F.filter(F.array(*[F.lit(float(x)) for x in steps[f]]), lambda x: x < F.col(f)))
    cells = seen.select("poor", "grows", *[cell(f).alias(f) for f in FEATURES])
    cells = stored(cells.groupBy("poor", "grows", *FEATURES).agg(F.count(F.lit(1)).alias("n")).coalesce(1), "cells")
    grow, prune = cells.where("grows"), cells.where("NOT grows")
    rules: list = []
    covered = F.lit(False)
    while len(rules) < MAX_RULES:
        terms: list = []
        while len(terms) < MAX_TERMS and (term := _best_term(grow, covered, terms)):
            terms.append(term)
        if not terms:
            break
        tests = [_all(terms[: k + 1], _cell_test) for k in range(len(terms))]
        got = prune.where(~covered).agg(*[F.coalesce(F.sum(F.when(t & c, F.col("n"))), F.lit(0)).alias(f"c{i}{j}") for i, t in enumerate(tests) for j, c in enumerate((F.lit(True), F.col("poor")))]).first()
        worth = [((2 * got[f"c{i}1"] - got[f"c{i}0"]) / max(got[f"c{i}0"], 1), -i) for i in range(len(terms))]
        i = -max(worth)[1]
        if got[f"c{i}0"] < LEAST or got[f"c{i}1"] < PRECISION * got[f"c{i}0"]:
            break
        rules.append(terms[: i + 1])
        covered = covered | tests[i]
    # more than k cells lie below a value that is above step k; the threshold goes half-way to the next value seen
    value = lambda f, k: float(steps[f][k]) if k < len(steps[f]) else float("inf")
    ends = [(f, value(f, k)) for terms in rules for f, _, k in terms]
    if not ends:
        return []
    near = seen.agg(*[x for i, (f, v) in enumerate(ends) for x in (F.max(F.when(F.col(f) <= v, F.col(f))).alias(f"a{i}"), F.min(F.when(F.col(f) > v, F.col(f))).alias(f"b{i}"))]).first()
    middle = iter([v if near[f"a{i}"] is None or near[f"b{i}"] is None else (near[f"a{i}"] + near[f"b{i}"]) / 2 for i, (_, v) in enumerate(ends)])
    return [[(f, above, next(middle)) for f, above, _ in terms] for terms in rules]


def verdict(rules: list) -> Column:
    """Number of the first rule that holds, as an ordered conditional expression; null if none does."""
    f = features()
    out = F.lit(None).cast("int")
    for i in range(len(rules) - 1, -1, -1):
        out = F.when(_all(rules[i], lambda t: f[t[0]] > t[2] if t[1] else f[t[0]] <= t[2]), F.lit(i + 1)).otherwise(out)
    return out


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    stats = stored(statistics(table(spark, sf_dir, "documents")), "statistics")
    rules = learn(stats, table(spark, sf_dir, "labels"))
    out = stats.withColumn("rule", verdict(rules)).withColumn("base_failed", base_failed())
    kept = ~F.col("base_failed") & F.col("rule").isNull()
    return out.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", kept.alias("kept"), "rule")
