"""Quality rules: base rules on a text's statistics, then robust multivariate outliers, in DataFrame functions alone.

For each language and source the minimum-covariance-determinant estimate of the transformed statistics is found: the mean and
covariance of the 75 % of the rows whose covariance has the least determinant. Concentration steps lead there: from a start,
rows are ordered by their Mahalanobis distance, the nearest 75 % give the next mean and covariance, and so on. Several
starts are stepped side by side, and the one with the least determinant is kept. Rows beyond a chi-square quantile of
the distance are rejected.

Everything about a group is a sum or a histogram count, so a source with a third of all rows is pre-aggregated in every
task, and no group is ever gathered. The 75 % point of the distances is read from a histogram of their logarithm.
Estimates are joined to rows on language and source; their number follows the number of sources, and Spark may broadcast
them only below its size threshold.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallymark.llm._shared import row_hash, stash

#: Base rules: least words, and the share of words in repeated windows, in hundredths, that fails.
MIN_WORDS, MAX_REPEATED = 50, 50
#: Smallest groups with an estimate of their own; smaller sources of a language are pooled, and so are then all languages.
MIN_ROWS = 60
#: Share of rows that an estimate is made of, concentration steps, and the chi-square quantile (4 degrees, 0.99999).
SHARE, STEPS, CUTOFF = 0.75, 4, 28.47
#: Bins for each doubling of a distance.
BINS = 32
#: Standard deviations of the transformed statistics that are no sign of bad quality: they are added to each estimate, which
#: also keeps it regular where most rows have no symbol or no repeated line at all. Where a source has none, a text goes for ten
#: symbols, or four repeated lines, or 31 repeated words in a hundred words alone.
NOISE = (0.12, 0.45, 0.3, 0.65)
#: Ratio of the variance of normal values to that of their nearest 75 %, four dimensions.
CONSISTENCY = 1.62
P = 4
#: The columns that a verdict depends on.
ROW = ("text", "lang", "source")
_WS = " \t\n\x0b\f\r"
_WS_CLASS = "[ \\t\\n\\x0B\\f\\r]+"


def statistics(docs: DataFrame, text: str = "text") -> DataFrame:
    """docs with n_words, word_chars, n_symbols, n_dup_lines and n_repeat_words under `s` (a struct). A null text counts as empty.

    Repeated windows: a word position counts when a three-word window over it starts at one of the positions whose windows
    (by a 64-bit hash) come twice. Positions are sorted by hash, so the work is n log n in a text's words.
    """
    t0 = docs.withColumn("__t", F.coalesce(F.col(text).cast("string"), F.lit("")))
    t1 = t0.withColumn("__trim", F.btrim("__t", F.lit(_WS)))
    t2 = t1.withColumn("__w", F.when(F.col("__trim") == "", F.array().cast("array<string>")).otherwise(F.split("__trim", _WS_CLASS)))
    windows = F.when(
        F.size("__w") >= 3,
        F.transform(F.sequence(F.lit(0), F.size("__w") - 3), lambda i: F.xxhash64(F.get("__w", i), F.get("__w", i + 1), F.get("__w", i + 2))),
    ).otherwise(F.array().cast("array<bigint>"))
    lines = F.filter(F.split("__t", "\n"), lambda x: F.btrim(x, F.lit(_WS)) != "")
    t3 = t2.withColumns({"__g": windows, "__l": lines})
    sorted_windows = F.when(
        F.size(F.array_distinct("__g")) < F.size("__g"),
        F.sort_array(F.transform("__g", lambda h, i: F.struct(h.alias("h"), i.alias("i")))),
    ).otherwise(F.array().cast("array<struct<h:bigint,i:int>>"))
    t4 = t3.withColumn("__s", sorted_windows)

    def twice(i: Column) -> Column:
        here = F.get("__s", i)["h"]
        return F.coalesce(here == F.get("__s", i - 1)["h"], F.lit(False)) | F.coalesce(here == F.get("__s", i + 1)["h"], F.lit(False))

    starts = F.when(
        F.size("__s") > 0,
        F.sort_array(F.transform(F.filter(F.sequence(F.lit(0), F.size("__s") - 1), twice), lambda i: F.get("__s", i)["i"])),
    ).otherwise(F.array().cast("array<int>"))
    t5 = t4.withColumn("__p", starts)
    covered = F.when(
        F.size("__p") > 0,
        F.aggregate(
            F.sequence(F.lit(0), F.size("__p") - 1),
            F.lit(0),
            lambda acc, k: acc + F.coalesce(F.least(F.lit(3), F.get("__p", k + 1) - F.get("__p", k)), F.lit(3)),
        ),
    ).otherwise(0)
    return t5.select(
        *docs.columns,
        F.struct(
            F.size("__w").cast("long").alias("n_words"),
            F.char_length(F.array_join("__w", "")).cast("long").alias("word_chars"),
            F.regexp_count("__t", F.lit("[#*$%&|<>]")).cast("long").alias("n_symbols"),
            (F.size("__l") - F.size(F.array_distinct("__l"))).cast("long").alias("n_dup_lines"),
            covered.cast("long").alias("n_repeat_words"),
        ).alias("s"),
    )


def _vector() -> list[Column]:
    """The transformed statistics: log mean word length, and logs of symbols, repeated lines and repeated words per 100 words."""
    words = F.greatest(F.col("n_words"), F.lit(1)).cast("double")
    return [F.log(F.greatest(F.col("word_chars"), F.lit(1)) / words), *(F.log1p(100.0 * F.col(c) / words) for c in ("n_symbols", "n_dup_lines", "n_repeat_words"))]


def _estimates(rows: DataFrame, keys: list[str]) -> DataFrame:
    """Mean (m0..) and Cholesky factor (l00, l10, ..) of the covariance plus noise of x0.., with the log determinant."""
    x = [F.col(f"x{i}") for i in range(P)]
    sums = {f"m{i}": F.avg(x[i]) for i in range(P)} | {f"c{i}{j}": F.avg(x[i] * x[j]) for i in range(P) for j in range(i + 1)}
    out = rows.groupBy(*keys).agg(*(c.alias(k) for k, c in sums.items()))
    factor = F.when(F.col("scaled"), F.lit(CONSISTENCY)).otherwise(1.0) if "scaled" in keys else F.lit(1.0)
    covariance = {f"c{i}{j}": factor * (F.col(f"c{i}{j}") - F.col(f"m{i}") * F.col(f"m{j}")) + (F.lit(NOISE[i] ** 2) if i == j else 0.0) for i in range(P) for j in range(i + 1)}
    out = out.withColumns(covariance)
    for i in range(P):
        for j in range(i + 1):
            left = F.col(f"c{i}{j}") - sum((F.col(f"l{i}{k}") * F.col(f"l{j}{k}") for k in range(j)), F.lit(0.0))
            out = out.withColumn(f"l{i}{j}", F.sqrt(F.greatest(left, F.lit(NOISE[i] ** 2 / 4))) if i == j else left / F.col(f"l{j}{j}"))
    return out.withColumn("logdet", sum((F.log(f"l{i}{i}") for i in range(P)), F.lit(0.0))).drop(*covariance)


_FIT = [*(f"m{i}" for i in range(P)), *(f"l{i}{j}" for i in range(P) for j in range(i + 1)), "logdet"]


def _distance(rows: DataFrame) -> DataFrame:
    """rows with d2, the squared Mahalanobis distance, by forward substitution."""
    for i in range(P):
        rest = F.col(f"x{i}") - F.col(f"m{i}") - sum((F.col(f"l{i}{k}") * F.col(f"z{k}") for k in range(i)), F.lit(0.0))
        rows = rows.withColumn(f"z{i}", rest / F.col(f"l{i}{i}"))
    return rows.withColumn("d2", sum((F.col(f"z{i}") * F.col(f"z{i}") for i in range(P)), F.lit(0.0))).drop(*(f"z{i}" for i in range(P)))


def _nearest(rows: DataFrame, keys: list[str]) -> DataFrame:
    """The rows of each group in the histogram bins up to that which completes SHARE of them. rows: d2 and keys."""
    binned = rows.withColumn("bin", F.floor(BINS * F.log2(F.col("d2") + 1e-3)).cast("int"))
    counts = binned.groupBy(*keys, "bin").agg(F.count("*").alias("n"))
    from pyspark.sql import Window

    up_to = Window.partitionBy(*keys).orderBy("bin")
    before = counts.withColumns({"upto": F.sum("n").over(up_to), "all": F.sum("n").over(Window.partitionBy(*keys))})
    limit = before.where(F.col("upto") >= SHARE * F.col("all")).groupBy(*keys).agg(F.min("bin").alias("last"))
    return binned.join(limit, keys).where(F.col("bin") <= F.col("last")).drop("bin", "last")


def robust_fit(rows: DataFrame) -> DataFrame:
    """One row per group `g`: the minimum-covariance-determinant estimate of x0..x3. rows: doc_id, g, x0..x3.

    Starts: all rows, the half of lower words' symbols (x1 at or below its mean), and a hashed half. The last
    estimate of each is corrected for consistency; that of the least determinant, ties by number, is kept.
    """
    g = ["g", "start"]
    mean = rows.groupBy("g").agg(F.avg("x1").alias("mid"))
    first = rows.join(mean, "g").select(
        "*",
        F.explode(
            F.filter(
                F.array(F.lit(0), F.when(F.col("x1") <= F.col("mid"), 1), F.when(F.pmod(F.xxhash64("doc_id"), F.lit(2)) == 0, 2)),
                lambda s: s.isNotNull(),
            )
        ).alias("start"),
    )
    fit = stash(_estimates(first, g), "mcd")
    for step in range(STEPS):
        chosen = _nearest(_distance(rows.join(fit, "g")).drop(*_FIT), g)
        keys = g
        if step == STEPS - 1:
            chosen, keys = chosen.withColumn("scaled", F.lit(True)), [*g, "scaled"]
        fit = stash(_estimates(chosen, keys).drop("scaled"), "mcd")
    best = fit.groupBy("g").agg(F.min_by(F.struct(*(c for c in _FIT)), F.struct(F.col("logdet"), F.col("start"))).alias("f"))
    return best.select("g", "f.*")


def quality_rules(docs: DataFrame, cutoff: float = CUTOFF) -> DataFrame:
    """The statistics and verdict of each row, see `judged`."""
    return judged(docs, cutoff).drop("raw")


def judged(docs: DataFrame, cutoff: float = CUTOFF) -> DataFrame:
    """One row per row of docs: doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept, d2, raw (a hash of
    text, lang and source).

    Reads doc_id, text, and lang and source where there (null or missing ones are a group of their own); other columns are
    ignored. A null text has no words and fails the base rules; so does an empty one. Rows that repeat an id are judged each
    for itself. The estimates are made of the rows that pass the base rules. Rows of groups too small even when pooled are
    judged by the estimate over all; d2 is null, and the base rules decide, where there are no more than four of those. An
    empty table gives no rows.
    """
    part = lambda c: F.coalesce(F.col(c).cast("string"), F.lit("\x00")) if c in docs.columns else F.lit("\x00")
    rows = statistics(docs.select(F.col("doc_id").cast("long").alias("doc_id"), part("lang").alias("lang"), part("source").alias("source"), F.col("text").cast("string").alias("text"), row_hash(docs, *ROW).alias("raw")))
    failed = (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEATED * F.col("n_words"))
    known = stash(rows.select("doc_id", "raw", "lang", "source", "s.*").withColumn("base_failed", failed), "statistics")
    passed = known.where("not base_failed")
    by_source = passed.groupBy("lang", "source").agg(F.count("*").alias("n"))
    own = by_source.select("lang", "source", "n", (F.col("n") >= MIN_ROWS).alias("own"))
    by_lang = own.where("not own").groupBy("lang").agg((F.sum("n") >= MIN_ROWS).alias("pooled"))
    groups = own.join(by_lang, "lang", "left").select(
        "lang", "source", F.when(F.col("own"), F.to_json(F.array("lang", "source"))).when(F.col("pooled"), F.to_json(F.array("lang"))).otherwise("[]").alias("g")
    )
    vectors = passed.withColumns({f"x{i}": c for i, c in enumerate(_vector())}).join(stash(groups, "groups"), ["lang", "source"]).select("doc_id", "g", *(f"x{i}" for i in range(P)))
    rows_ = stash(vectors, "vectors")
    fit = stash(robust_fit(rows_).join(rows_.groupBy("g").agg(F.count("*").alias("n")), "g").where(F.col("n") > P).drop("n"), "fit")
    judged = known.join(groups, ["lang", "source"], "left").withColumns({f"x{i}": c for i, c in enumerate(_vector())})
    found = _distance(judged.join(fit, "g", "left"))
    verdict = ~F.col("base_failed") & (F.col("d2").isNull() | (F.col("d2") <= cutoff))
    return found.select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", verdict.alias("kept"),
        F.when(~F.col("base_failed"), F.col("d2")).alias("d2"), "raw",
    )


def kept_rows(docs: DataFrame) -> DataFrame:
    """The rows that are kept. Rows that share an id are judged each for itself; those that share text, language and source too are alike."""
    gone = judged(docs).where("not kept").select(F.col("doc_id").alias("__id"), F.col("raw").alias("__raw")).distinct()
    met = F.col("doc_id").cast("long").eqNullSafe(F.col("__id")) & (row_hash(docs, *ROW) == F.col("__raw"))
    return docs.join(gone.hint("shuffle_hash"), met, "left_anti")
