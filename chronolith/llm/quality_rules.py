"""Quality rules by robust multivariate outliers.

Each document has a vector of transformed statistics: log mean word length, log (0.05 + punctuation and symbols per word),
log distinct words over log words, log (0.05 + capitals per word). Per group (language and source) the minimum-covariance-determinant
estimate of place and scatter is found over all its documents that pass the base rules. There are three deterministic
starts: medians with quartile spreads, the correlation of the vectors' hyperbolic tangents, and that of their signs in
space. From each, concentration steps - the three quarters of the group nearest by Mahalanobis distance give the next
mean and covariance - go on until the determinant stands still; the start of least determinant is taken. The estimate is
rescaled so that the group's median squared distance is that of the chi-square distribution, and a document is rejected
if its squared distance is beyond that distribution's quantile of ``1 - 1e-9``.

Estimates shrink, so that every document is judged however small its group: to the core of a group that of its language
is added with the weight of ``PRIOR`` documents, and to that of a language the table's. No size switches from one
estimate to another. The one constant added to a variance is ``RIDGE``, the square of 0.03 in coordinates whose usual
scatter is a tenth and more; it keeps the covariance of equal vectors positive definite.

Scale: texts are read once; what the steps read is a table of a few numbers a row. The coordinates are fixed-point
integers, so sums are exact and the same however rows are dealt. A step is one aggregation of counts, sums and products by
group, start and distance bin (a set number of bins, partial results before the shuffle), from which the core is the
nearest bins; no group is ever in one task. DataFrame functions alone touch documents.

Defined results: a null text counts as empty and fails the base rules. Equal rows get equal results. Null languages and
sources are values of their own. An empty table gives no rows. Extra columns are not read by judge().
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from chronolith.llm._common import cut, small, text_of

WORD = r"[^\x20\x09-\x0D]+"
#: What is neither punctuation nor a symbol.
PLAIN = r"[\p{L}\p{M}\p{N}\x20\x09-\x0D]+"
#: Share of a group in its core; documents that the estimate of the language, or of the table, counts for.
CORE, PRIOR = 0.75, 60
#: Quantile of 1 - 1e-9, and median, of the chi-square distribution with as many degrees of freedom as coordinates.
CUT, MEDIAN_CHI = 47.9, 3.357
#: Fixed-point units of a coordinate; distance bins per doubling; their largest number.
UNITS, BINS_PER_DOUBLING, LAST_BIN = 4096, 32, 1280
#: What is added to each variance; scales of the coordinates, which bring their usual scatter to the order of a tenth or more, far above the ridge.
RIDGE = 9e-4
SCALES = (4, 1, 10, 1)
DIMS = len(SCALES)
#: What is added to rates a word before their logarithm: it does not hang on the length of a text that has none.
RATE = 0.05
#: A determinant stands still if its logarithm falls by less.
STILL = 1e-6
#: Longest list of repeated windows that is searched window by window; longer ones are matched by sorting.
FEW = 48


def statistics(docs: DataFrame, keep: tuple[str, ...] = ()) -> DataFrame:
    """keep, n_words, word_chars, n_symbols, n_punct, n_distinct (words), n_upper (capitals), n_dup_lines and n_repeat_words of every whole text."""
    kept = [F.col(c).alias(f"__k{i}") for i, c in enumerate(keep)]
    names = [f"__k{i}" for i in range(len(keep))]
    text = docs.select(*kept, text_of().alias("t"))
    real = F.filter(F.split("t", "\n", -1), lambda x: x.rlike(WORD))
    one = text.select(
        *names, F.regexp_extract_all("t", F.lit(WORD), F.lit(0)).alias("w"), F.octet_length(F.regexp_replace("t", r"[^#*$%&|<>]+", "")).cast("long").alias("n_symbols"),
        F.length(F.regexp_replace("t", PLAIN, "")).cast("long").alias("n_punct"),
        F.length(F.regexp_replace("t", r"\P{Lu}+", "")).cast("long").alias("n_upper"), real.alias("lines"),
    )
    n = F.size("w")
    hashes = F.when(n >= 3, F.transform(F.sequence(F.lit(0), n - 3), lambda i: F.xxhash64(F.get("w", i), F.get("w", i + 1), F.get("w", i + 2)))).otherwise(F.array().cast("array<bigint>"))
    two = one.select(
        *names, n.cast("long").alias("n_words"), F.length(F.array_join("w", "")).cast("long").alias("word_chars"), "n_symbols", "n_punct",
        F.size(F.array_distinct("w")).cast("long").alias("n_distinct"), "n_upper", (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"), hashes.alias("h"),
    )
    done = [*names, "n_words", "word_chars", "n_symbols", "n_punct", "n_distinct", "n_upper", "n_dup_lines"]
    three = two.select(*done, "h", F.when(F.size(F.array_distinct("h")) < F.size("h"), F.sort_array("h")).alias("sorted"))
    again = F.array_distinct(F.filter("sorted", lambda x, i: (i > 0) & (F.get("sorted", i - 1) == x)))
    four = three.select(*done, "h", again.alias("again"))
    few = F.filter(F.transform("h", lambda x, i: F.when(F.array_contains("again", x), i)), lambda i: i.isNotNull())
    pairs = four.withColumn("pairs", F.when(F.size("again") > FEW, F.sort_array(F.transform("h", lambda x, i: F.struct(x.alias("x"), i.alias("i"))))))
    near = lambda e, at: F.coalesce(F.get("pairs", at)["x"] == e["x"], F.lit(False))
    many = F.sort_array(F.transform(F.filter("pairs", lambda e, i: ((i > 0) & near(e, i - 1)) | near(e, i + 1)), lambda e: e["i"]))
    five = pairs.select(*done, F.when(F.size("again") > FEW, many).when(F.col("again").isNotNull(), few).alias("p"))
    # Windows at sorted places cover three words each, less what the next one covers as well.
    cover = F.aggregate(F.transform("p", lambda x, i: F.least(F.lit(3), F.coalesce(F.get("p", i + 1) - x, F.lit(3)))), F.lit(0), lambda a, x: a + x)
    back = [F.col(f"__k{i}").alias(c) for i, c in enumerate(keep)]
    return five.select(*back, *done[len(names) :], F.coalesce(cover, F.lit(0)).cast("long").alias("n_repeat_words"))


def base_failed() -> Column:
    return (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))


def vector() -> list[Column]:
    """The transformed statistics, as fixed-point integers."""
    words = F.greatest(F.col("n_words"), F.lit(2))
    logs = (F.log(F.greatest(F.col("word_chars"), F.lit(1)) / words), F.log(F.col("n_punct") / words + RATE), F.log(F.greatest(F.col("n_distinct"), F.lit(1))) / F.log(words), F.log(F.col("n_upper") / words + RATE))
    raw = [x * scale for x, scale in zip(logs, SCALES, strict=True)]
    return [F.round(x * UNITS).cast("long").alias(f"x{i}") for i, x in enumerate(raw)]


_PAIRS = [(i, j) for i in range(DIMS) for j in range(i + 1)]
_MEANS = [f"m{i}" for i in range(DIMS)]
_FACTOR = [f"l{i}{j}" for i, j in _PAIRS]
_SUMS = ["n", *(f"s{i}" for i in range(DIMS)), *(f"p{i}{j}" for i, j in _PAIRS)]


# Expressions are SQL text, which is parsed at once; columns refer to earlier ones of their select.


def _factored(frame: DataFrame, names: list[str]) -> DataFrame:
    """names, m (mean), l (rows of the lower Cholesky factor of the covariance c) and logdet, per row of frame."""
    factor = []
    for i, j in _PAIRS:
        rest = " - ".join([f"c{i}{j}", *(f"l{i}{k} * l{j}{k}" for k in range(j))])
        # The ridge keeps the matrix positive definite, so what is left on the diagonal is at least its order.
        factor.append(f"sqrt(greatest({rest} + {RIDGE:.9f}D, {RIDGE / 4:.9f}D)) AS l{i}{j}" if i == j else f"({rest}) / l{j}{j} AS l{i}{j}")
    return frame.selectExpr(*names, *_MEANS, *factor, " + ".join(f"2 * ln(l{i}{i})" for i in range(DIMS)) + " AS logdet")


def _estimate(sums: DataFrame, names: list[str], scale: str = "1D") -> DataFrame:
    """The mean and factored covariance (times scale) of each row's sums, in coordinates of unit size."""
    covariance = [f"(p{i}{j} / n / {UNITS * UNITS}D - m{i} * m{j}) * {scale} AS c{i}{j}" for i, j in _PAIRS]
    return _factored(sums.selectExpr(*names, *[f"s{i} / n / {UNITS}D AS m{i}" for i in range(DIMS)], *covariance), names)


def _distance(rows: DataFrame, estimate: DataFrame, kept: tuple[str, ...] = ()) -> DataFrame:
    """rows, with the columns kept of the estimates, and d2, the squared Mahalanobis distance from their group's estimate (null without one)."""
    frame = rows.join(small(estimate.select("grp", *kept, *_MEANS, *_FACTOR)), "grp", "left" if not kept else "inner")
    turned = []
    for i in range(DIMS):
        left = " - ".join([f"x{i} / {UNITS}D - m{i}", *(f"l{i}{k} * y{k}" for k in range(i))])
        turned.append(f"({left}) / l{i}{i} AS y{i}")
    return frame.selectExpr(*rows.columns, *kept, *turned, " + ".join(f"y{i} * y{i}" for i in range(DIMS)) + " AS d2").drop(*[f"y{i}" for i in range(DIMS)])


def _bin(value: str) -> Column:
    """Bin of a number from 0 on: BINS_PER_DOUBLING to a doubling, from 2^-20 to 2^20."""
    return F.least(F.greatest(F.floor((F.log2(F.greatest(F.col(value), F.lit(1e-6))) + 20) * BINS_PER_DOUBLING), F.lit(0)), F.lit(LAST_BIN)).cast("int")


def _middle_of_bin(name: str) -> Column:
    return F.pow(F.lit(2.0), (F.col(name) + 0.5) / BINS_PER_DOUBLING - 20)


def _nearest(counts: DataFrame, keys: list[str], share: float) -> DataFrame:
    """Of counts (keys, bin, n, others), the bins that hold the nearest share of each key's rows."""
    of = Window.partitionBy(*keys)
    return counts.withColumns({"__all": F.sum("n").over(of), "__upto": F.sum("n").over(of.orderBy("bin"))}).where(F.col("__upto") - F.col("n") < share * F.col("__all")).drop("__all", "__upto")


def _starts(rows: DataFrame) -> DataFrame:
    """The first estimates of each group, by start."""
    # Coordinates in sixteenths have a set number of values, so what an exact percentile counts is bounded.
    spread = rows.groupBy("grp").agg(*[F.expr(f"percentile(round(x{i} / 16), array(0.25, 0.5, 0.75)) AS q{i}") for i in range(DIMS)])
    spread = cut(spread.selectExpr("grp", *[f"q{i}[1] * 16 / {UNITS} AS m{i}" for i in range(DIMS)], *[f"greatest((q{i}[2] - q{i}[0]) * 16 / {UNITS} / 1.349D, {RIDGE**0.5}D) AS d{i}" for i in range(DIMS)]))
    z = rows.join(small(spread), "grp").selectExpr("grp", *[f"(x{i} / {UNITS}D - m{i}) / d{i} AS z{i}" for i in range(DIMS)], "greatest(sqrt(" + " + ".join(f"z{i} * z{i}" for i in range(DIMS)) + "), 1e-6D) AS norm")
    # Fixed-point as well, so that their sums are exact.
    bent = z.selectExpr("grp", *[f"cast(round(tanh(z{i}) * 4096) AS bigint) AS t{i}" for i in range(DIMS)], *[f"cast(round(z{i} / norm * 4096) AS bigint) AS u{i}" for i in range(DIMS)])
    sums = bent.groupBy("grp").agg(*[F.expr(x) for x in ("count(*) AS n", *(f"sum(t{i}) AS t{i}" for i in range(DIMS)), *(f"sum({c}{i} * {c}{j}) AS {c}{i}{j}" for c in "tu" for i, j in _PAIRS))])
    sums = sums.selectExpr("grp", *[f"t{i}{j} / n - t{i} / n * t{j} / n AS t{i}{j}" for i, j in _PAIRS], *[f"u{i}{j} / n AS u{i}{j}" for i, j in _PAIRS])
    starts = []
    for start, of in enumerate(" tu"):
        # Correlations; the first start has none.
        c = {(i, j): "1D" if i == j else "0D" if start == 0 else f"{of}{i}{j} / sqrt(greatest({of}{i}{i}, 1D) * greatest({of}{j}{j}, 1D))" for i, j in _PAIRS}
        starts.append(f"struct({start} AS start, " + ", ".join(f"{c[i, j]} * d{i} * d{j} AS c{i}{j}" for i, j in _PAIRS) + ")")
    each = sums.join(small(spread), "grp").selectExpr("grp", *_MEANS, f"explode(array({', '.join(starts)})) AS c").select("grp", *_MEANS, "c.*")
    return _factored(each, ["grp", "start"])


def cores(rows: DataFrame) -> DataFrame:
    """grp and the sums over its core (n, s, p), of the start with the least determinant, from rows of grp and coordinates."""
    keys = ["grp", "start"]
    moments = [F.expr(x) for x in ("count(*) AS n", *(f"sum(x{i}) AS s{i}" for i in range(DIMS)), *(f"sum(x{i} * x{j}) AS p{i}{j}" for i, j in _PAIRS))]
    total = [F.expr(f"sum({c}) AS {c}") for c in _SUMS]
    now = cut(_starts(rows).withColumn("last", F.lit(float("inf"))).drop("logdet"))
    settled = None
    while not now.isEmpty():
        binned = _distance(rows, now, ("start", "last")).groupBy(*keys, "last", _bin("d2").alias("bin")).agg(*moments)
        sums = _nearest(binned, keys, CORE).groupBy(*keys, "last").agg(*total)
        after = cut(_estimate(sums, [*keys, "last", *_SUMS]))
        # A determinant that no longer falls ends the steps: it falls by STILL each time, and the ridge bounds it.
        still = F.col("logdet") > F.col("last") - STILL
        done = after.where(still).select(*keys, "logdet", *_SUMS)
        settled = done if settled is None else settled.union(done)
        now = after.where(~still).select(*keys, F.col("logdet").alias("last"), *_MEANS, *_FACTOR)
    if settled is None:
        return rows.groupBy("grp").agg(*moments)
    return cut(settled.groupBy("grp").agg(F.min_by(F.struct(*_SUMS), F.struct("logdet", "start")).alias("v")).select("grp", "v.*"))


def estimates(rows: DataFrame, above: list[DataFrame] = ()) -> DataFrame:
    """The rescaled minimum-covariance-determinant estimate per group from rows of grp and coordinates. above: frames of grp
    and up, the group that grp shrinks to, from the top down."""
    sums = cores(rows)
    for levels in above:
        sums = cut(_shrunk(sums, levels, _SUMS))
    # Consistency: the median of the group's squared distances is that of the chi-square distribution.
    counts = _distance(rows, _estimate(sums, ["grp"])).groupBy("grp", _bin("d2").alias("bin")).agg(F.count("*").alias("n"))
    middle = _nearest(counts, ["grp"], 0.5).groupBy("grp").agg(F.max("bin").alias("middle"))
    # A core's scatter is at most that of its group: a factor below 1 comes from the ridge, where coordinates are constant.
    factors = cut(middle.select("grp", F.greatest(_middle_of_bin("middle") / MEDIAN_CHI, F.lit(1.0)).alias("factor")))
    scaled = sums.join(small(factors), "grp")
    for levels in above:
        # The factor of a few documents says little: it is averaged with that of the group above.
        of = scaled.select("grp", (rows_of := F.col("n").cast("double")).alias("n"), (F.col("factor") * rows_of).alias("f"))
        of = cut(_shrunk(of, levels, ["n", "f"])).select("grp", (F.col("f") / F.col("n")).alias("factor"))
        scaled = scaled.drop("factor").join(small(of), "grp")
    return cut(_estimate(scaled, ["grp"], "factor"))


def _shrunk(sums: DataFrame, levels: DataFrame, names: list[str]) -> DataFrame:
    """sums of grp, n and others, where those of the groups of levels have their upper group's added as that of PRIOR documents."""
    sums = sums.select("grp", *[F.col(c).cast("double").alias(c) for c in names])  # products of exact sums pass 64 bits
    top = sums.select(F.col("grp").alias("up"), *[(F.col(c) * PRIOR / F.col("n")).alias(f"u_{c}") for c in names])
    both = sums.join(small(levels), "grp", "left").join(small(top), "up", "left")
    added = {c: F.col(c) + F.coalesce(F.col(f"u_{c}"), F.lit(0.0)) for c in names}
    for i, j in _PAIRS if "s0" in names else ():
        # Scatter is about each one's own mean, so that a distant group of a few documents does not widen its own estimate.
        own, upper = F.col(f"s{i}") * F.col(f"s{j}") / F.col("n"), F.col(f"u_s{i}") * F.col(f"u_s{j}") / PRIOR
        added[f"p{i}{j}"] = added[f"p{i}{j}"] + F.coalesce(added[f"s{i}"] * added[f"s{j}"] / added["n"] - own - upper, F.lit(0.0))
    return both.select("grp", *[x.alias(c) for c, x in added.items()])


def judge(docs: DataFrame, keep: tuple[str, ...] = ()) -> DataFrame:
    """keep, doc_id, the statistics, base_failed, kept and d2 (squared distance; null where the base rules failed)."""
    columns = tuple(dict.fromkeys((*keep, "doc_id", "lang", "source")))
    stats = statistics(docs, columns).withColumn("base_failed", base_failed())
    group, language = F.to_json(F.struct("lang", "source")), F.concat(F.lit("lang"), F.to_json(F.struct("lang")))
    stats = cut(stats.select("*", group.alias("grp"), language.alias("language"), *vector()))
    good = stats.where(~F.col("base_failed"))
    groups = cut(good.select("grp", "language").distinct())
    levels = [groups.select(F.col("language").alias("grp"), F.lit("all").alias("up")).distinct(), groups.select("grp", F.col("language").alias("up"))]
    every = good.select(F.explode(F.array("grp", "language", F.lit("all"))).alias("grp"), *[f"x{i}" for i in range(DIMS)])
    judged = _distance(stats, estimates(every, above=levels)).withColumn("d2", F.when(~F.col("base_failed"), F.col("d2")))
    kept = ~F.col("base_failed") & F.coalesce(F.col("d2") <= CUT, F.lit(True))
    numbers = ("n_words", "word_chars", "n_symbols", "n_punct", "n_distinct", "n_upper", "n_dup_lines", "n_repeat_words", "base_failed")
    return judged.select(*columns, *numbers, kept.alias("kept"), "d2")
