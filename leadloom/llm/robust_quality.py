"""Quality rules: fixed rules, and robust multivariate outliers per language and source.

Each text gives five counts; transformed and rounded to thousandths they form a vector.  Per group a minimum covariance
determinant estimate is found by concentration steps: distances from the current estimate are put into fine bins, one
combined aggregate gives count, sums and products per bin, and the moments of the nearest part follow by prefix sums over
bins.  Of several starts the one with the least determinant stays.  Texts far from the estimate are rejected.

Everything is column expressions.  Texts are read once; each step reads the narrow vectors and shuffles at most one row
per group, start and bin from every task, so a group with a third of all rows is no heavier than any other.
"""

from __future__ import annotations

from itertools import combinations_with_replacement

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from leadloom.llm.common import GAP, row_key, sha, words
from leadloom.session import stage

WINDOW = 8
MIN_WORDS = 20
MOST_REPEATED = 30
SYMBOLS = r"[^#*$%&|<>]+"

DIMS = 5
PAIRS = tuple(combinations_with_replacement(range(DIMS), 2))
#: Least spread per dimension in thousandths, added to every covariance: smaller differences never make an outlier.
FLOORS = (600.0, 120.0, 80.0, 200.0, 160.0)
SUPPORT = 0.75
STEPS = 5
MIN_ROWS = 60
#: Quantiles of chi-square with five degrees of freedom: the median, and the one that leaves one row in a million out.
CHI_MEDIAN, CHI_FAR = 4.351, 35.89
BINS_PER_OCTAVE = 16


def text_counts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", extra: dict[str, Column] | None = None) -> DataFrame:
    """``id, n_words, word_chars, n_symbols, n_lines, n_dup_lines, n_repeat_words`` per row, and ``extra`` columns.

    A null text has no words and no lines.
    """
    text = F.coalesce(F.col(f"`{text_col}`"), F.lit(""))
    read = docs.select(F.col(f"`{id_col}`").alias("id"), text.alias("text"), *[c.alias(n) for n, c in (extra or {}).items()])
    kept = list(extra or {})
    # each select is one step of the same task; arrays are passed on, not copied
    split = read.select("id", *kept, "text", words(F.col("text")).alias("words"))
    lines = F.filter(F.split("text", "\n"), lambda line: F.length(F.regexp_replace(line, GAP, "")) > 0)
    listed = split.select(
        "id", *kept, "words", lines.alias("lines"),
        F.length(F.regexp_replace("text", GAP, "")).cast("long").alias("word_chars"),
        F.length(F.regexp_replace("text", SYMBOLS, "")).cast("long").alias("n_symbols"),
    )
    size = F.size("words")
    starts = F.when(size >= WINDOW, F.sequence(F.lit(1), size - WINDOW + 1)).otherwise(F.array().cast("array<int>"))
    hashed = listed.select(
        "id", *kept, "word_chars", "n_symbols", size.cast("long").alias("n_words"), F.size("lines").cast("long").alias("n_lines"),
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"),
        F.transform(starts, lambda i: F.xxhash64(F.slice("words", i, WINDOW))).alias("windows"),
    )
    repeats = F.size(F.array_distinct("windows")) < F.size("windows")
    return hashed.select(
        "id", *kept, "n_words", "word_chars", "n_symbols", "n_lines", "n_dup_lines",
        F.when(repeats, _covered(F.col("windows"))).otherwise(F.lit(0)).cast("long").alias("n_repeat_words"),
    )


def _covered(windows: Column) -> Column:
    """Words in windows whose 64-bit hash occurs twice or more: sort hashes with places, compare neighbours, merge."""
    placed = F.transform(windows, lambda h, i: F.struct(h.alias("h"), i.alias("i")))
    ordered = F.transform(F.array(F.sort_array(placed)), lambda s: F.zip_with(
        s, F.concat(F.slice(s, 2, F.greatest(F.size(s) - 1, F.lit(0))), F.array(F.element_at(s, 1))),
        lambda a, b: F.when((a["h"] == b["h"]) & (a["i"] < b["i"]), F.array(a["i"], b["i"])),
    ))
    places = F.sort_array(F.array_distinct(F.flatten(F.array_compact(F.flatten(ordered)))))
    start = F.struct(F.lit(0).alias("end"), F.lit(0).alias("total"))
    merge = lambda s, i: F.struct((i + WINDOW).alias("end"), (s["total"] + WINDOW - F.greatest(s["end"] - i, F.lit(0))).alias("total"))
    return F.aggregate(places, start, merge, lambda s: s["total"])


def base_failed() -> Column:
    return (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MOST_REPEATED * F.col("n_words"))


def vectors(counts: DataFrame) -> DataFrame:
    """``x0`` to ``x4``, whole thousandths: logarithms of length and word length, and the arcsines of the square roots of
    the shares of symbols, repeated lines and repeated words."""
    share = lambda part, whole: F.asin(F.sqrt(part / F.greatest(whole, F.lit(1))))
    values = (
        F.log1p("n_words"), F.log1p(F.col("word_chars") / F.greatest("n_words", F.lit(1))), share(F.col("n_symbols"), F.col("word_chars")),
        share(F.col("n_dup_lines"), F.col("n_lines")), share(F.col("n_repeat_words"), F.col("n_words")),
    )
    return counts.withColumns({f"x{k}": F.round(1000 * v) for k, v in enumerate(values)})


def _tagged(c: Column) -> Column:
    return F.when(c.isNull(), "-").otherwise(F.concat(F.lit("+"), c.cast("string")))


def grouped(rows: DataFrame, min_rows: int = MIN_ROWS) -> DataFrame:
    """Adds ``cell``: language and source, or the language alone for sources with few rows; null values are values."""
    sizes = rows.filter("fit").groupBy("lang", "source").agg(F.count("*").alias("cell_rows"))
    sizes = sizes.select(F.col("lang").alias("_lang"), F.col("source").alias("_source"), "cell_rows")
    same = F.col("lang").eqNullSafe(F.col("_lang")) & F.col("source").eqNullSafe(F.col("_source"))
    joined = rows.join(stage(sizes, "cell-sizes"), same, "left")
    part = F.when(F.col("cell_rows") >= min_rows, _tagged(F.col("source"))).otherwise("*")
    return joined.withColumn("cell", F.to_json(F.array(_tagged(F.col("lang")), part))).drop("_lang", "_source", "cell_rows")


def _medians(values: DataFrame) -> DataFrame:
    """Lower median of ``x`` per cell and ``dim``, from counts of the (rounded) values."""
    counts = values.groupBy("cell", "dim", "x").agg(F.count("*").alias("n"))
    by = Window.partitionBy("cell", "dim")
    upto = F.sum("n").over(by.orderBy("x").rowsBetween(Window.unboundedPreceding, 0))
    ranked = counts.withColumns({"upto": upto, "all": F.sum("n").over(by)})
    return ranked.filter(2 * F.col("upto") >= F.col("all")).groupBy("cell", "dim").agg(F.min("x").alias("median"))


def _wide(table: DataFrame, value: str, name: str) -> DataFrame:
    picks = [F.max(F.when(F.col("dim") == k, F.col(value))).alias(f"{name}{k}") for k in range(DIMS)]
    return table.groupBy("cell").agg(*picks)


def _total(terms: list[str]) -> str:
    return " + ".join(terms) or "0.0D"


def _add(params: DataFrame, **columns: str) -> DataFrame:
    """Columns written as SQL, all at once: quicker to build than long column objects."""
    return params.selectExpr("*", *[f"{text} AS {name}" for name, text in columns.items()])


def _with_precision(params: DataFrame) -> DataFrame:
    """Adds the inverse (``p{i}{j}``) and the log determinant of the covariance ``c{i}{j}``, by Cholesky."""
    for j in range(DIMS):
        rest = lambda i, j=j: f"(c{j}{i} - ({_total([f'l{i}{k} * l{j}{k}' for k in range(j)])}))"
        params = _add(params, **{f"l{j}{j}": f"sqrt({rest(j)})"})
        params = _add(params, **{f"l{i}{j}": f"{rest(i)} / l{j}{j}" for i in range(j + 1, DIMS)}) if j + 1 < DIMS else params
    for i in range(DIMS):  # inverse of the lower triangle, row by row
        row = {f"v{i}{j}": f"-({_total([f'l{i}{k} * v{k}{j}' for k in range(j, i)])}) / l{i}{i}" for j in range(i)}
        params = _add(params, **row, **{f"v{i}{i}": f"1.0D / l{i}{i}"})
    inverse = {f"p{i}{j}": _total([f"v{k}{i} * v{k}{j}" for k in range(j, DIMS)]) for i, j in PAIRS}
    logdet = f"2 * ({_total([f'ln(l{k}{k})' for k in range(DIMS)])})"
    return _add(params, **inverse, logdet=logdet).select(
        "cell", "start", "n", "logdet", *[f"m{k}" for k in range(DIMS)], *[f"p{i}{j}" for i, j in PAIRS]
    )


def _squared_distance() -> Column:
    off = lambda k: f"(x{k} - m{k})"
    return F.expr(_total([f"{1 if i == j else 2} * p{i}{j} * {off(i)} * {off(j)}" for i, j in PAIRS]))


def _moments() -> list[Column]:
    sums = [F.expr(f"sum(x{k}) AS s{k}") for k in range(DIMS)]
    return [F.count("*").alias("n"), *sums, *[F.expr(f"sum(x{i} * x{j}) AS q{i}{j}") for i, j in PAIRS]]


def _estimate(sums: DataFrame) -> DataFrame:
    """Mean and floored covariance from count, sums and products."""
    means = _add(sums, **{f"m{k}": f"s{k} / n" for k in range(DIMS)})
    floor = lambda i, j: f"{FLOORS[i] ** 2}D" if i == j else "0.0D"
    return _with_precision(_add(means, **{f"c{i}{j}": f"q{i}{j} / n - m{i} * m{j} + {floor(i, j)}" for i, j in PAIRS}))


def _bin(distance: Column) -> Column:
    return F.floor(BINS_PER_OCTAVE * F.log2(1 + 8 * distance)).cast("int")


def starts(rows: DataFrame) -> DataFrame:
    """Two first estimates per cell: medians with median deviations, and mean with covariance."""
    dims = F.explode(F.array(*[F.struct(F.lit(k).alias("dim"), F.col(f"x{k}").alias("x")) for k in range(DIMS)]))
    long = rows.select("cell", dims.alias("v")).select("cell", "v.dim", "v.x")
    medians = stage(_medians(long), "medians")
    away = long.join(medians, ["cell", "dim"]).select("cell", "dim", F.abs(F.col("x") - F.col("median")).alias("x"))
    wide = _wide(medians, "median", "m").join(_wide(_medians(away), "median", "d"), "cell")
    spread = {f"c{i}{j}": f"pow(1.4826D * d{i}, 2) + {FLOORS[i] ** 2}D" if i == j else "0.0D" for i, j in PAIRS}
    by_median = _with_precision(_add(wide, start="0", n="0L", **spread))
    by_mean = _estimate(rows.groupBy("cell").agg(*_moments()).withColumn("start", F.lit(1)))
    return by_median.unionByName(by_mean)


def concentrate(rows: DataFrame, params: DataFrame, support: float = SUPPORT) -> DataFrame:
    """One concentration step: moments of the nearest ``support`` of each cell, whole bins at a time."""
    binned = rows.join(params.drop("n"), "cell").withColumn("bin", _bin(_squared_distance()))
    bins = binned.groupBy("cell", "start", "bin").agg(*_moments())
    by = Window.partitionBy("cell", "start")
    upto = by.orderBy("bin").rowsBetween(Window.unboundedPreceding, 0)
    names = ["n", *[f"s{k}" for k in range(DIMS)], *[f"q{i}{j}" for i, j in PAIRS]]
    run = bins.withColumn("all", F.sum("n").over(by)).select("cell", "start", "bin", "all", *[F.sum(c).over(upto).alias(c) for c in names])
    near = run.filter(F.col("n") >= support * F.col("all"))
    first = near.groupBy("cell", "start").agg(F.min_by(F.struct(*names), F.col("bin")).alias("at"))
    return _estimate(first.select("cell", "start", "at.*"))


def estimates(rows: DataFrame, min_rows: int = MIN_ROWS, support: float = SUPPORT, steps: int = STEPS) -> DataFrame:
    """The estimate of least determinant per cell, with ``scale``: the median squared distance over that of chi-square.

    ``rows`` has ``cell`` and ``x0`` to ``x4``.  Cells with fewer than ``min_rows`` rows get none.
    """
    many = rows.groupBy("cell").agg(F.count("*").alias("rows")).filter(F.col("rows") >= min_rows).select("cell")
    used = stage(rows.join(stage(many, "cells"), "cell").select("cell", *[f"x{k}" for k in range(DIMS)]), "vectors")
    params = stage(starts(used), "mcd-start")
    for _ in range(steps):
        params = stage(concentrate(used, params, support), "mcd-step")
    best = params.groupBy("cell").agg(F.min_by(F.struct(*[c for c in params.columns if c != "cell"]), F.struct("logdet", "start")).alias("b"))
    best = stage(best.select("cell", "b.*"), "mcd-best")
    distances = used.join(best, "cell").select("cell", F.lit(0).alias("dim"), _bin(_squared_distance()).alias("x"))
    middle = (F.pow(F.lit(2.0), (F.col("median") + 1) / BINS_PER_OCTAVE) - 1) / 8
    scales = _medians(distances).select("cell", F.greatest(middle / CHI_MEDIAN, F.lit(1.0)).alias("scale"))
    return best.join(scales, "cell")


def judge(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", source_col: str = "source",
    min_rows: int = MIN_ROWS, far: float = CHI_FAR, steps: int = STEPS,
) -> DataFrame:
    """One row per input row: ``id, text_sha``, the counts, ``base_failed, cell, distance, kept``.

    A text is rejected by the fixed rules, or when its squared distance from its cell's estimate, scaled, exceeds
    ``far``.  Sources with few rows share a cell of their language; a cell with fewer than ``min_rows`` texts that pass
    the fixed rules rejects nothing more.  A null text fails the fixed rules; null language and source are values of
    their own; repeated rows are judged alike; an empty table gives no rows.
    """
    extra = {"lang": F.col(f"`{lang_col}`"), "source": F.col(f"`{source_col}`"), "text_sha": sha(F.col(f"`{text_col}`"))}
    counts = text_counts(docs, id_col, text_col, extra).withColumn("base_failed", base_failed())
    rows = stage(vectors(counts).withColumn("fit", ~F.col("base_failed")), "counts")
    celled = stage(grouped(rows, min_rows), "counts-by-cell")
    found = stage(estimates(celled.filter("fit"), min_rows, steps=steps), "mcd").drop("start", "n")
    measured = celled.join(found, "cell", "left").withColumn("distance", _squared_distance() / F.col("scale"))
    kept = ~F.col("base_failed") & F.coalesce(F.col("distance") <= far, F.lit(True))
    return measured.withColumn("kept", kept).select(
        "id", "text_sha", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "cell", F.sqrt("distance").alias("distance"), "kept"
    )


def keep_good(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **settings) -> DataFrame:
    """The rows of ``docs`` that are kept, with all their columns."""
    good = judge(docs, id_col, text_col, **settings).filter("kept").select(row_key(F.col("id"), F.hex("text_sha")).alias("_key")).distinct()
    keyed = docs.withColumn("_key", row_key(F.col(f"`{id_col}`"), F.hex(sha(F.col(f"`{text_col}`")))))
    return keyed.join(good, "_key", "left_semi").drop("_key")
