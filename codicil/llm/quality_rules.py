"""Quality rules: fixed rules, then robust multivariate outliers. DataFrame functions only.

Statistics of each whole text are transformed into a vector. For every language and source the minimum
covariance determinant estimate is found: from several starts, concentration steps (centre and covariance
of the share of rows nearest to the last estimate, each of them two distributed aggregates) go on until no
determinant falls any more, and the start of the smallest determinant is taken. The same is done for every
language and for the whole table, and each estimate is drawn towards the wider one by its number of rows, so
that a small group is judged by what is known of its language, without a size at which the rule changes. A
document is rejected if its Mahalanobis distance is beyond a chi-square quantile.

Groups are never brought together: aggregates are formed in two steps, and the estimates, a row for each
language and source, are sent to the tasks if their number is bounded (and joined by shuffles if not).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import WHITE_CHARS, Carried, bounded, materialise, words_of

# Fixed values of the contract.
SYMBOLS = "#*$%&|<>"
#: Least standard deviations: log words, log mean word length, log symbol rate, log rate of repeated lines, share of repeated words.
FLOORS = (0.25, 0.04, 0.175, 0.4, 0.06)
D = len(FLOORS)
#: Median and 0.999 quantile of the chi-square distribution with D degrees of freedom.
CHI_MEDIAN, CHI_999 = 4.3515, 20.5150
#: Starts of the concentration steps.
STARTS = 3
#: Estimates that are sent to all tasks.
SENT_ROWS = 20_000
#: Bytes of the largest method that the JVM compiles to machine code; generated methods beyond it would be interpreted.
METHOD_LIMIT = ("spark.sql.codegen.hugeMethodLimit", "8000")


def with_statistics(df: DataFrame, text: Column) -> DataFrame:
    """Adds _n_words, _word_chars, _n_symbols, _n_dup_lines, _n_repeat_words, _n_lines.

    Repeated words: windows of three words are hashed; where any window comes twice, windows are sorted by
    hash with their position, and the words under those that have an equal neighbour are counted.
    """
    text = F.coalesce(text, F.lit(""))
    full_lines = F.filter(F.split(text, "\n", -1), lambda x: F.btrim(x, F.lit(WHITE_CHARS)) != "")
    one = df.withColumns({"_w": words_of(text), "_lines": full_lines})
    two = one.withColumns(
        {
            "_h": F.transform("_w", lambda x: F.xxhash64(x)),
            "_n_words": F.size("_w").cast("long"),
            "_n_lines": F.size("_lines").cast("long"),
            "_n_dup_lines": (F.size("_lines") - F.size(F.array_distinct("_lines"))).cast("long"),
            "_word_chars": F.char_length(F.array_join("_w", "")).cast("long"),
            "_n_symbols": F.regexp_count(text, F.lit(f"[{SYMBOLS}]")).cast("long"),
        }
    ).drop("_w", "_lines")
    part = lambda i: F.slice("_h", F.lit(i), F.greatest(F.size("_h") - 2, F.lit(0)))
    three = two.withColumn("_g", F.zip_with(F.zip_with(part(1), part(2), lambda a, b: F.xxhash64(a, b)), part(3), lambda a, b: F.xxhash64(a, b))).drop("_h")
    four = three.withColumn(
        "_s",
        F.when(F.size(F.array_distinct("_g")) < F.size("_g"), F.sort_array(F.transform("_g", lambda h, i: F.struct(h.alias("h"), i.alias("i"))))),
    ).drop("_g")
    five = four.withColumn(
        "_p",
        F.sort_array(
            F.transform(
                F.filter("_s", lambda x, i: x["h"].eqNullSafe(F.get(F.col("_s"), i - 1)["h"]) | x["h"].eqNullSafe(F.get(F.col("_s"), i + 1)["h"])),
                lambda x: x["i"],
            )
        ),
    ).drop("_s")
    # Each window covers three words, less what the one before it has covered.
    gaps = F.zip_with("_p", F.concat(F.array(F.lit(-3)), F.slice("_p", F.lit(1), F.greatest(F.size("_p") - 1, F.lit(0)))), lambda a, b: F.least(F.lit(3), a - b))
    covered = F.aggregate(gaps, F.lit(0), lambda s, x: s + x)
    return five.withColumn("_n_repeat_words", F.coalesce(F.when(F.size("_p") > 0, covered), F.lit(0)).cast("long")).drop("_p")


def vector() -> list[Column]:
    words, chars = F.greatest(F.col("_n_words"), F.lit(1)), F.greatest(F.col("_word_chars"), F.lit(1))
    return [
        F.log1p(F.col("_n_words").cast("double")),
        F.log(F.col("_word_chars") / words + 0.5),
        F.log1p(100.0 * F.col("_n_symbols") / chars),
        F.log1p(10.0 * F.col("_n_dup_lines") / F.greatest(F.col("_n_lines"), F.lit(1))),
        F.col("_n_repeat_words") / words,
    ]


X = [f"_x{i}" for i in range(D)]


PAIRS = [(i, j) for i in range(D) for j in range(i + 1)]
OF = ["_group", "_start"]


def _met(rows: DataFrame, small: DataFrame) -> DataFrame:
    """Rows with what is known of their group and start."""
    return rows.join(bounded(small, SENT_ROWS), [x for x in OF if x in small.columns])


def _estimate(rows: DataFrame) -> DataFrame:
    """Number of rows, centre, covariance (variances not under the floors) and its determinant, by group and start.

    Sums and sums of products are less work than covar_pop; entries are logarithms and shares, a few units large,
    so that their differences stay far more exact than the floors.
    """
    sums = rows.groupBy(*OF).agg(
        F.count(F.lit(1)).alias("_n"), *[F.sum(x).alias(f"_m{i}") for i, x in enumerate(X)], *[F.sum(F.col(X[i]) * F.col(X[j])).alias(f"_c{i}{j}") for i, j in PAIRS]
    )
    sums = sums.withColumns({f"_m{i}": F.col(f"_m{i}") / F.col("_n") for i in range(D)})
    floored = [(F.col(f"_c{i}{j}") / F.col("_n") - F.col(f"_m{i}") * F.col(f"_m{j}") + (FLOORS[i] ** 2 if i == j else 0.0)).alias(f"_v{i}{j}") for i, j in PAIRS]
    return _factored(sums.select(*OF, "_n", *[f"_m{i}" for i in range(D)], *floored))


def _factored(sums: DataFrame) -> DataFrame:
    """Adds _l, the lower Cholesky factor of _v, and _det, the logarithm of its determinant."""
    for i, j in PAIRS:
        left = F.col(f"_v{i}{j}")
        for k in range(j):
            left = left - F.col(f"_l{i}{k}") * F.col(f"_l{j}{k}")
        sums = sums.withColumn(f"_l{i}{j}", F.sqrt(F.greatest(left, F.lit(1e-12))) if i == j else left / F.col(f"_l{j}{j}"))
    return sums.withColumn("_det", sum(2.0 * F.log(F.col(f"_l{i}{i}")) for i in range(D)))


def _distance(joined: DataFrame) -> DataFrame:
    """Adds _d2, the squared Mahalanobis distance of a row from the estimate beside it."""
    for i in range(D):
        left = F.col(X[i]) - F.col(f"_m{i}")
        for k in range(i):
            left = left - F.col(f"_l{i}{k}") * F.col(f"_y{k}")
        joined = joined.withColumn(f"_y{i}", left / F.col(f"_l{i}{i}"))
    squares = [F.col(f"_y{i}") * F.col(f"_y{i}") for i in range(D)]
    return joined.withColumn("_d2", sum(squares[1:], squares[0]))


def _nearest(rows: DataFrame, share: float) -> DataFrame:
    """The share of each group's rows with the least _d2, for each start."""
    cut = rows.groupBy(*OF).agg(F.percentile_approx("_d2", share, 2000).alias("_cut"))
    return _met(rows, materialise(cut, "rule-cut")).filter(F.col("_d2") <= F.col("_cut")).select(*OF, *X)


def least_determinants(fit: DataFrame, *, share: float = 0.75, steps: int = 20, settled: float = 1e-3) -> DataFrame:
    """(_group, _x0, ...) -> the estimate of each group, with _n, its number of rows: _m, _v, _l and _det.

    The starts are the half of the rows nearest to the medians in units of the mean absolute deviations, the
    same with the entries' own deviations in the squares' place (which ignores far rows more), and all rows.
    Steps end when no logarithm of a determinant falls by more than settled. The covariance is scaled so that
    the median distance is that of a normal sample; a scale under 1 comes of wide floors and is taken as 1.
    """
    conf = fit.sparkSession.conf
    before = conf.get(METHOD_LIMIT[0])
    conf.set(*METHOD_LIMIT)
    try:
        return _least_determinants(fit, share, steps, settled)
    finally:
        conf.set(METHOD_LIMIT[0], before)


def _least_determinants(fit: DataFrame, share: float, steps: int, settled: float) -> DataFrame:
    middle = materialise(fit.groupBy("_group").agg(F.count(F.lit(1)).alias("_all"), *[F.percentile_approx(x, 0.5, 2000).alias(f"_q{i}") for i, x in enumerate(X)]), "rule-middle")
    off = fit.join(bounded(middle, SENT_ROWS), "_group")
    wide = off.groupBy("_group").agg(*[F.percentile_approx(F.abs(F.col(x) - F.col(f"_q{i}")), 0.5, 2000).alias(f"_w{i}") for i, x in enumerate(X)])
    off = off.join(bounded(materialise(wide, "rule-wide"), SENT_ROWS), "_group")
    part = [F.abs(F.col(x) - F.col(f"_q{i}")) / (1.4826 * F.col(f"_w{i}") + FLOORS[i]) for i, x in enumerate(X)]
    first = [sum((y * y for y in part[1:]), part[0] * part[0]), F.greatest(*part), F.lit(0.0)]
    begun = off.select("_group", *X, F.posexplode(F.array(*first)).alias("_start", "_d2"))
    estimate = materialise(_estimate(_nearest(begun, 0.5)), "rule-estimate")
    started = fit.withColumn("_start", F.explode(F.sequence(F.lit(0), F.lit(STARTS - 1))))
    for _ in range(steps):
        now = materialise(_estimate(_nearest(_distance(_met(started, estimate)).select(*OF, *X, "_d2"), share)), "rule-estimate")
        fell = now.join(estimate.select(*OF, F.col("_det").alias("_last")), OF).agg(F.max(F.col("_last") - F.col("_det"))).first()[0]
        estimate = now
        if fell is None or fell <= settled:
            break
    best = estimate.groupBy("_group").agg(F.min(F.struct("_det", "_start"))["_start"].alias("_start"))
    best = materialise(estimate.join(best, OF).drop("_start"), "rule-best")
    scale = _distance(fit.join(bounded(best, SENT_ROWS), "_group")).groupBy("_group").agg((F.percentile_approx("_d2", 0.5, 2000) / CHI_MEDIAN).alias("_scale"))
    wider = [(F.col(f"_v{i}{j}") * F.greatest("_scale", F.lit(1.0))).alias(f"_v{i}{j}") for i, j in PAIRS]
    told = best.join(materialise(scale, "rule-scale"), "_group").join(middle.select("_group", "_all"), "_group")
    return materialise(told.select("_group", F.col("_all").alias("_n"), *[f"_m{i}" for i in range(D)], *wider), "rule-told")


def _drawn(names: DataFrame, estimates: DataFrame, weight: float) -> DataFrame:
    """For each language and source its estimate, drawn towards that of the language, and that towards the whole table's.

    An estimate of n rows counts n / (n + weight); what it leaves is the wider one's.
    """
    cols = [*[f"_m{i}" for i in range(D)], *[f"_v{i}{j}" for i, j in PAIRS]]
    out = names
    for at in (2, 1, 0):
        of = estimates.select(F.col("_group").alias("_g"), F.col("_n").alias("_k"), *[F.col(x).alias(f"{x}_") for x in cols])
        out = out.join(of, F.col("_may")[at] == F.col("_g"), "left")
        own = F.coalesce(F.col("_k") / (F.col("_k") + weight), F.lit(0.0)) if at < 2 else F.lit(1.0)
        mixed = {x: F.coalesce(F.col(f"{x}_"), F.lit(0.0)) * own + F.col(x) * (1.0 - own) if at < 2 else F.col(f"{x}_") for x in cols}
        out = out.withColumns(mixed).drop("_g", "_k", *[f"{x}_" for x in cols])
    return _factored(out).drop("_may", "_det")


def judge_documents(
    docs: DataFrame,
    *,
    share: float = 0.75,
    steps: int = 20,
    cutoff: float = CHI_999,
    weight: float = 200.0,
    carry_text: bool = False,
    id_col: str = "doc_id",
    text_col: str = "text",
    lang_col: str = "lang",
    source_col: str = "source",
) -> DataFrame:
    """Returns the rows of docs (without the text, unless carry_text) with n_words, word_chars, n_symbols,
    n_dup_lines, n_repeat_words, base_failed, distance (null only if no row passes the fixed rules) and kept.

    Null text has no words and fails. Null languages and sources are values of their own. Estimates are made
    of the rows that pass the fixed rules; that of a language and source with n of them counts
    n / (n + weight), the language's the rest. Repeated rows are judged one by one; rows equal in statistics,
    language and source get one verdict. Columns with the names of the new ones are replaced. All words of a
    text are in one row's memory at once, with about 60 bytes for each.
    """
    c = Carried(docs, doc=id_col, text=text_col, lang=lang_col, source=source_col)
    named = c.df.withColumns({"_lang": c.col("lang").cast("string"), "_source": c.col("source").cast("string")})
    stats = with_statistics(named, c.col("text"))
    stats = stats.withColumn("_base", (F.col("_n_words") < 50) | (100 * F.col("_n_repeat_words") > 50 * F.col("_n_words")))
    stats = stats.withColumns(dict(zip(X, vector())))
    if not carry_text:
        stats = stats.drop(c.at["text"])
    rows = materialise(stats, "rule-stats")
    name = lambda x: F.when(x.isNull(), F.lit("-")).otherwise(F.concat(F.lit("="), x))
    may = F.array(F.concat_ws(" ", name(F.col("_lang")), name(F.col("_source"))), name(F.col("_lang")), F.lit(""))
    fit = materialise(rows.filter(~F.col("_base")).select(may.alias("_may"), *X), "rule-fit").select(F.explode("_may").alias("_group"), *X)
    names = materialise(rows.groupBy("_lang", "_source").agg(F.first(may).alias("_may")), "rule-groups")
    drawn = _drawn(names.withColumnsRenamed({"_lang": "_gl", "_source": "_gs"}), least_determinants(fit, share=share, steps=steps), weight)
    drawn = bounded(materialise(drawn, "rule-drawn"), SENT_ROWS)
    told = _distance(rows.join(drawn, F.col("_lang").eqNullSafe(F.col("_gl")) & F.col("_source").eqNullSafe(F.col("_gs")), "left"))
    names = [n for i, n in enumerate(c.names) if carry_text or f"_c{i}" != c.at["text"]]
    c.names, keep = names, [f"_c{i}" for i in range(len(c.names)) if carry_text or f"_c{i}" != c.at["text"]]
    told = told.withColumnsRenamed({old: f"_k{i}" for i, old in enumerate(keep)})
    told = told.withColumnsRenamed({f"_k{i}": f"_c{i}" for i in range(len(keep))})
    return c.restore(
        told,
        {
            "n_words": F.col("_n_words"),
            "word_chars": F.col("_word_chars"),
            "n_symbols": F.col("_n_symbols"),
            "n_dup_lines": F.col("_n_dup_lines"),
            "n_repeat_words": F.col("_n_repeat_words"),
            "base_failed": F.col("_base"),
            "distance": F.col("_d2"),
            "kept": ~F.col("_base") & (F.coalesce("_d2", F.lit(0.0)) <= cutoff),
        },
    )
