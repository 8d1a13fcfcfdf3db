"""Quality rules: text statistics and robust multivariate outliers, in DataFrame functions only.

Every document gets counts over its whole text. Documents that fail the base rules are out; the
rest become points of four transformed statistics, and per language and source a minimum covariance
determinant (MCD) estimate says how far each lies from the bulk. Points beyond `cutoff` (a squared
Mahalanobis distance) are rejected.

MCD: two starts per group (moments of all points; medians with fixed scales), each followed by
concentration steps: keep the `share` of the points nearest to the current estimate, take mean and
covariance of those, repeat. The start with the smaller determinant wins. The share is found from a
histogram of distances, so a group of any size is aggregated before it is shuffled and no task holds
a group: a step is one scan, which sums counts, deviations and products per bin of distance. Groups and
points are stored once, so every step is a small plan over four numbers per document. Groups under
`min_rows` points share their language's estimate, then a common one; if these leftovers are under
`min_rows` too, they are held against the estimate over all points, and only if the whole table has
fewer points there is no verdict and the base rules decide. `estimate` names the group that was used.

Cases: a NULL text has no words and fails; NULL languages and sources form groups of their own;
repeated rows are judged each and count each; an empty table gives an empty result; ties get the
same verdict, as only the statistics decide. Other columns are ignored, whatever their names.
"""

import math

from pyspark.sql import Window as W, functions as F

from spectraloom.session import handed_over

SPACE = r"[\x20\x09-\x0D]+"
SYMBOLS = r"[#*$%&|<>]"
WINDOW = 8
MIN_WORDS = 20
MAX_REPEAT_PERCENT = 30

DIMS = ("word_length", "symbol_share", "dup_line_share", "repeat_share")
#: smallest standard deviation of each dimension: most documents have no symbol and no repeat at all
FLOORS = (0.05, 0.05, 0.12, 0.12)
SHARE = 0.75
STEPS = 4
MIN_ROWS = 100
#: group of what is left when small groups were joined by language
REST = "[]"
#: the chi-squared quantile of four dimensions at 1 - 1e-5
CUTOFF = 28.47


def _shifted(array, n, by):
    """Neighbours `by` apart of an array with `n` entries, as two arrays of equal length."""
    rest = F.greatest(n - by, F.lit(0))
    return F.slice(array, F.lit(1), rest), F.slice(array, F.lit(1 + by), rest)


def text_statistics(docs, text="text"):
    """`docs` with n_words, word_chars, n_symbols, n_lines, n_dup_lines, n_repeat_words (all long).

    Repeated words are those in any window of eight words found twice or more in the text. Windows
    are compared by 64-bit hashes built by doubling: pairs, fours, eights. Positions are sorted only
    for documents in which some window repeats.
    """
    out = docs.withColumn("_t", F.coalesce(F.col(text), F.lit("")))
    out = out.withColumn("_w", F.array_remove(F.split("_t", SPACE), "")).withColumn(
        "_l", F.filter(F.split("_t", "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    )
    out = out.withColumn("_n", F.size("_w"))
    hashed = F.zip_with(*_shifted(F.col("_w"), F.col("_n"), 1), lambda a, b: F.xxhash64(a, b))
    out = out.withColumn("_h", hashed)
    for by in (2, 4):
        n = F.col("_n") - (by - 1)
        out = out.withColumn("_h", F.zip_with(*_shifted(F.col("_h"), n, by), lambda a, b: F.xxhash64(a, b)))
    repeats = F.size(F.array_distinct("_h")) < F.size("_h")
    keyed = F.sort_array(F.transform("_h", lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
    out = out.withColumn("_s", F.when(repeats, keyed)).withColumn(
        "_p",
        F.when(
            F.col("_s").isNotNull(),
            F.sort_array(
                F.transform(
                    F.filter(
                        "_s",
                        lambda x, k: F.coalesce(x.h == F.get("_s", k - 1).h, F.lit(False))
                        | F.coalesce(x.h == F.get("_s", k + 1).h, F.lit(False)),
                    ),
                    lambda x: x.i,
                )
            ),
        ),
    )
    gaps = F.zip_with(*_shifted(F.col("_p"), F.size("_p"), 1), lambda a, b: F.least(b - a, F.lit(WINDOW)))
    covered = F.when(
        F.col("_p").isNotNull(), F.aggregate(gaps, F.lit(0), lambda acc, x: acc + x) + F.lit(WINDOW)
    ).otherwise(0)
    counts = {
        "n_words": F.col("_n"),
        "word_chars": F.length(F.array_join("_w", "")),
        "n_symbols": F.regexp_count("_t", F.lit(SYMBOLS)),
        "n_lines": F.size("_l"),
        "n_dup_lines": F.size("_l") - F.size(F.array_distinct("_l")),
        "n_repeat_words": covered,
    }
    return out.select(*docs.columns, *[c.cast("bigint").alias(name) for name, c in counts.items()])


def base_failed():
    return (F.col("n_words") < MIN_WORDS) | (
        F.col("n_repeat_words") * 100 > F.col("n_words") * MAX_REPEAT_PERCENT
    )


def transformed():
    """The point of a document. Short texts are drawn towards fixed values, as their shares are noisy."""
    chars = F.col("word_chars").cast("double")
    words = F.col("n_words").cast("double")
    return [
        F.log((chars + 500) / (words + 100)),
        F.sqrt(F.col("n_symbols") / (chars + 200)),
        F.sqrt(F.col("n_dup_lines") / (F.col("n_lines") + 5.0)),
        F.sqrt(F.col("n_repeat_words") / (words + 100)),
    ]


def _key(*cols):
    """NULLs of lang and source kept apart from every text."""
    return F.to_json(F.array(*[F.col(c).cast("string") if isinstance(c, str) else c for c in cols]))


def assigned_groups(stats, lang="lang", source="source", min_rows=MIN_ROWS):
    """(g_lang, g_source, _g) per language and source: own group, the language's rest, or the common rest.

    Sizes are counts of points. The table has a row per language and source of `stats`.
    """
    points = F.sum((~F.col("_failed")).cast("bigint")).alias("n")
    out = stats.groupBy(F.col(lang).alias("g_lang"), F.col(source).alias("g_source")).agg(points)
    out = out.withColumn("_g", _key("g_lang", "g_source"))
    for wider in (_key("g_lang"), F.lit(REST)):
        large = out.groupBy(F.col("_g").alias("_large")).agg(F.sum("n").alias("_all")).filter(F.col("_all") >= min_rows)
        out = out.join(large, F.col("_g") == F.col("_large"), "left")
        out = out.withColumn("_g", F.when(F.col("_large").isNull(), wider).otherwise(F.col("_g"))).drop("_large", "_all")
    return out.select("g_lang", "g_source", "_g")


def consistency(share):
    """Factor that makes the covariance of the nearest `share` unbiased for four normal dimensions."""
    below4 = lambda x: 1 - math.exp(-x / 2) * (1 + x / 2)
    low, high = 0.0, 100.0
    for _ in range(100):
        mid = (low + high) / 2
        low, high = (mid, high) if below4(mid) < share else (low, mid)
    below6 = 1 - math.exp(-low / 2) * (1 + low / 2 + low * low / 8)
    return share / below6


def _cholesky(out, factor):
    """Lower Cholesky factor of factor * covariance (c00, c10, ...) + floors, and log det."""
    p = range(len(DIMS))
    for i in p:
        for j in range(i + 1):
            rest = F.col(f"c{i}{j}") * factor
            for k in range(j):
                rest = rest - F.col(f"l{i}{k}") * F.col(f"l{j}{k}")
            if i == j:
                # rounding can leave a tiny negative rest; the floor keeps it positive
                value = F.sqrt(F.greatest(rest, F.lit(0.0)) + F.lit(FLOORS[i] ** 2))
            else:
                value = rest / F.col(f"l{j}{j}")
            out = out.withColumn(f"l{i}{j}", value)
    logdet = sum((F.log(f"l{i}{i}") for i in p), F.lit(0.0))
    return out.withColumn("logdet", logdet).drop(*[f"c{i}{j}" for i in p for j in p if j <= i])


def _moments(points):
    """Start with mean and covariance of all points."""
    p = range(len(DIMS))
    aggs = [F.avg(f"x{i}").alias(f"m{i}") for i in p]
    aggs += [F.covar_pop(f"x{i}", f"x{j}").alias(f"c{i}{j}") for i in p for j in p if j <= i]
    return _cholesky(points.groupBy("_g").agg(*aggs), F.lit(1.0)).drop("logdet")


def _medians(points):
    """Start with medians and the smallest scales."""
    long = points.select("_g", F.posexplode(F.array(*[f"x{i}" for i in range(len(DIMS))])).alias("d", "x"))
    centre = _quantile(long, ["_g", "d"], F.floor(F.col("x") * 1000).cast("bigint"), 0.5)
    centre = centre.groupBy("_g").agg(
        *[F.max(F.when(F.col("d") == i, (F.col("edge") + 0.5) / 1000)).alias(f"m{i}") for i in range(len(DIMS))]
    )
    for i, floor in enumerate(FLOORS):
        for j in range(i + 1):
            centre = centre.withColumn(f"l{i}{j}", F.lit(floor if i == j else 0.0))
    return centre


def _quantile(points, by, bin_of, share):
    """Smallest bin of each group at which `share` of its points is reached: counts, then sums over bins."""
    bins = points.select(*by, bin_of.alias("bin")).groupBy(*by, "bin").count()
    order = W.partitionBy(*by).orderBy("bin")
    bins = bins.withColumn("upto", F.sum("count").over(order)).withColumn(
        "all", F.sum("count").over(W.partitionBy(*by))
    )
    return bins.filter(F.col("upto") >= F.ceil(F.col("all") * share)).groupBy(*by).agg(F.min("bin").alias("edge"))


def _distance():
    """Squared Mahalanobis distance by forward substitution."""
    z = []
    for i in range(len(DIMS)):
        rest = F.col(f"x{i}") - F.col(f"m{i}")
        for k in range(i):
            rest = rest - F.col(f"l{i}{k}") * z[k]
        z.append(rest / F.col(f"l{i}{i}"))
    return sum((v * v for v in z), F.lit(0.0))


def _bin(distance):
    return F.floor(F.log1p(F.least(distance, F.lit(1e12))) * 50).cast("bigint")


ESTIMATE = [f"m{i}" for i in range(len(DIMS))] + [f"l{i}{j}" for i in range(len(DIMS)) for j in range(i + 1)]


def _step(points, current, share, factor):
    """Mean and covariance of the nearest `share` of each group's points, per start: one scan of `points`."""
    p = range(len(DIMS))
    off = points.join(current, "_g").select(
        "start", "_g", *[f"m{i}" for i in p], _bin(_distance()).alias("bin"), *[(F.col(f"x{i}") - F.col(f"m{i}")).alias(f"d{i}") for i in p]
    )
    sums = [F.count("*").alias("n")] + [F.sum(f"d{i}").alias(f"s{i}") for i in p]
    sums += [F.sum(F.col(f"d{i}") * F.col(f"d{j}")).alias(f"q{i}{j}") for i in p for j in range(i + 1)]
    by = ["start", "_g", *[f"m{i}" for i in p]]
    bins = off.groupBy(*by, "bin").agg(*sums)
    # all bins before the share is reached, and the one it is reached in
    group = W.partitionBy("start", "_g")
    before = F.sum("n").over(group.orderBy("bin")) - F.col("n")
    near = bins.withColumn("before", before).withColumn("all", F.sum("n").over(group))
    near = near.filter(F.col("before") < F.ceil(F.col("all") * share)).groupBy(*by).agg(
        F.sum("n").alias("n"), *[F.sum(f"s{i}").alias(f"s{i}") for i in p], *[F.sum(f"q{i}{j}").alias(f"q{i}{j}") for i in p for j in range(i + 1)]
    )
    mean = [F.col(f"s{i}") / F.col("n") for i in p]
    out = near.select(
        "start", "_g", *[(F.col(f"m{i}") + mean[i]).alias(f"m{i}") for i in p],
        *[(F.col(f"q{i}{j}") / F.col("n") - mean[i] * mean[j]).alias(f"c{i}{j}") for i in p for j in range(i + 1)],
    )
    return _cholesky(out, factor)


def mcd_estimates(points, share=SHARE, steps=STEPS):
    """One row per `_g`: mean, Cholesky factor of the covariance. `points` has _g, x0.. and is cheap to read again.

    The estimates of every step are a table of two rows per group.
    """
    factor = F.lit(consistency(share))
    first = _moments(points).select(F.lit("moments").alias("start"), "_g", *ESTIMATE)
    second = _medians(points).select(F.lit("medians").alias("start"), "_g", *ESTIMATE)
    current = handed_over(first.unionByName(second), "estimates")
    for _ in range(steps):
        current = handed_over(_step(points, current, share, factor).select("start", "_g", *ESTIMATE, "logdet"), "estimates")
    best = F.min(F.struct("logdet", "start", *ESTIMATE)).alias("b")
    return current.groupBy("_g").agg(best).select("_g", *[f"b.{c}" for c in ESTIMATE])


def judge(docs, doc_id="doc_id", text="text", lang="lang", source="source", cutoff=CUTOFF, min_rows=MIN_ROWS):
    """One row per row of `docs`: `doc_id`, the six statistics, `base_failed`, `distance`, `estimate`, `kept`, `text_hash`.

    `distance` is NULL where the base rules reject or no estimate exists. The statistics are written
    to the shared folder once, then the points with their groups; the steps read those.
    """
    rows = docs.select(
        F.col(doc_id).alias("doc_id"), F.col(lang).cast("string").alias("lang"),
        F.col(source).cast("string").alias("source"), F.col(text).alias("text"),
    )
    stats = text_statistics(rows).withColumn("text_hash", F.xxhash64("text")).drop("text")
    x = [f"x{i}" for i in range(len(DIMS))]
    stats = handed_over(stats.withColumn("_failed", base_failed()), "statistics")
    groups = handed_over(assigned_groups(stats, min_rows=min_rows), "groups")
    mine = F.col("lang").eqNullSafe(F.col("g_lang")) & F.col("source").eqNullSafe(F.col("g_source"))
    grouped = stats.join(groups, mine).drop("g_lang", "g_source")
    points = handed_over(grouped.filter("not _failed").select("_g", *[c.alias(n) for n, c in zip(x, transformed())]), "points")
    rest = F.col("_g") == REST
    size = points.agg(F.count("*").alias("all"), F.count_if(rest).alias("rest")).first()
    if 0 < size["rest"] < min_rows:
        # leftovers too few for an estimate: held against all points, counted once more under their group's name
        others = points.filter(~rest)
        points = others.unionByName(points.withColumn("_g", F.lit(REST))) if size["all"] >= min_rows else others
    estimates = mcd_estimates(points).withColumnRenamed("_g", "estimate")
    out = grouped.select("*", *[c.alias(n) for n, c in zip(x, transformed())])
    out = out.join(estimates, F.col("_g") == F.col("estimate"), "left").withColumn("distance", F.when(~F.col("_failed"), _distance()))
    return out.select(
        "doc_id", "lang", "source", "text_hash", "n_words", "word_chars", "n_symbols", "n_lines", "n_dup_lines",
        "n_repeat_words", F.col("_failed").alias("base_failed"), "distance", F.when(~F.col("_failed"), F.col("estimate")).alias("estimate"),
        (~F.col("_failed") & F.coalesce(F.col("distance") <= cutoff, F.lit(True))).alias("kept"),
    )


def keep_good(docs, doc_id="doc_id", text="text", **options):
    """The rows of `docs` that the rules keep, with all their columns.

    Rejected rows are found again by id and hash of the text, NULLs included: rows that repeat in
    both have the same verdict unless they differ in language or source, then each its own.
    """
    lang, source = options.get("lang", "lang"), options.get("source", "source")
    bad = judge(docs, doc_id, text, **options).filter(~F.col("kept"))
    bad = bad.select(
        F.col("doc_id").alias("_id"), F.col("text_hash").alias("_h"), F.col("lang").alias("_lang"),
        F.col("source").alias("_source"),
    ).distinct()
    same = (
        docs[doc_id].eqNullSafe(bad["_id"]) & (F.xxhash64(docs[text]) == bad["_h"])
        & docs[lang].cast("string").eqNullSafe(bad["_lang"]) & docs[source].cast("string").eqNullSafe(bad["_source"])
    )
    return docs.join(bad, same, "left_anti")
