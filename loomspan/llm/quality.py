"""Document statistics and robust multivariate outliers, in DataFrame expressions only."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .workspace import Workspace, small_side

STATS = ("x0", "x1", "x2", "x3")
#: Least standard deviation of each statistic, added to every covariance.  On its logarithmic scale a
#: statistic moves by as much between texts that do not differ in kind: a quarter in length, a twelfth
#: in the length of words, a symbol in about 400 words, a word in about 120 repeated.
FLOORS = (0.25, 0.08, 0.25, 0.15)
#: Share of rows that an estimate rests on, concentration steps, and the starts among which the least
#: determinant chooses.
SHARE, STEPS, STARTS = 0.75, 3, ("medians", "means", "deviations")
#: Whatever the distribution, at most p / k of its rows lie beyond a squared Mahalanobis distance of k
#: (Chebyshev's inequality in p dimensions).  Statistics of texts have heavy tails, so this and not the
#: chi-square quantile gives the cutoff: one row in 30 at the most.
CUTOFF = 30.0 * len(STATS)


def _chi_square(x: float, p: int) -> float:
    """P(chi-square of p, an even number of degrees, <= x)."""
    return 1 - math.exp(-x / 2) * sum((x / 2) ** i / math.factorial(i) for i in range(p // 2))


def consistency(p: int, share: float) -> float:
    """What turns distances by the covariance of the nearest ``share`` of normal rows into those by that of all."""
    low, high = 0.0, 1000.0
    for _ in range(100):
        mid = (low + high) / 2
        low, high = (mid, high) if _chi_square(mid, p) < share else (low, mid)
    return _chi_square(low, p + 2) / share


def transformed(n_words: int, word_chars: int, n_symbols: int, n_dup_lines: int, n_repeat_words: int) -> list[float]:
    """The statistics of one row, as ``_statistics`` gives them for columns."""
    w = max(1, n_words)
    return [math.log1p(n_words), math.log1p(word_chars / w), math.log1p(100 * n_symbols / w), math.log1p(20 * n_repeat_words / w + n_dup_lines / 4)]


def _statistics() -> list[Column]:
    words = F.greatest("n_words", F.lit(1))
    return [
        F.log1p("n_words").alias("x0"),
        F.log1p(F.col("word_chars") / words).alias("x1"),
        F.log1p(100 * F.col("n_symbols") / words).alias("x2"),
        F.log1p(20 * F.col("n_repeat_words") / words + F.col("n_dup_lines") / F.lit(4.0)).alias("x3"),
    ]


def _base(docs: DataFrame, keep: list[str]) -> DataFrame:
    """keep, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words.

    A window's hash follows from its five words' hashes.  Only texts in which some window comes back
    are searched for the words that those windows cover.
    """
    df = docs.select(*keep, F.coalesce("text", F.lit("")).alias("t"))
    df = df.select(*keep, "t", F.expr(r"filter(split(t, '[\\x20\\x09-\\x0D]+'), x -> x <> '')").alias("w"))
    df = df.select(*keep, "t", F.size("w").alias("n"), F.length(F.array_join("w", "")).alias("c"), F.expr("transform(w, x -> xxhash64(x))").alias("h"))
    window = "xxhash64(h[i], h[i + 1], h[i + 2], h[i + 3], h[i + 4])"
    df = df.select(*keep, "t", "n", "c", F.expr(f"if(n < 6, cast(array() as array<bigint>), transform(sequence(0, n - 5), i -> {window}))").alias("k"))
    # positions of windows that come back, in order; neighbours in sorted (hash, position) share the hash
    twin = "(j > 0 and s[j].k = s[j - 1].k) or (j < size(s) - 1 and s[j].k = s[j + 1].k)"
    again = f"""transform(array(array_sort(transform(k, (x, i) -> named_struct('k', x, 'i', i)))),
        s -> array_sort(transform(filter(sequence(0, size(s) - 1), j -> {twin}), j -> s[j].i)))[0]"""
    covered = f"""transform(array({again}),
        p -> aggregate(sequence(1, size(p)), 0, (a, j) -> a + if(j = size(p), 5, least(5, p[j] - p[j - 1]))))[0]"""
    return df.select(
        *keep,
        F.col("n").cast("long").alias("n_words"),
        F.col("c").cast("long").alias("word_chars"),
        F.expr("cast(regexp_count(t, '[#*$%&|<>]') as bigint)").alias("n_symbols"),
        F.expr(r"""cast(transform(array(filter(split(t, '\n'), x -> x rlike '[^\\x20\\x09-\\x0D]')),
            l -> size(l) - size(array_distinct(l)))[0] as bigint)""").alias("n_dup_lines"),
        F.expr(f"cast(if(size(k) = size(array_distinct(k)), 0, {covered}) as bigint)").alias("n_repeat_words"),
    )


def _factors(moments: DataFrame) -> DataFrame:
    """(g, start, det, means m, factor l) from means and covariances: the Cholesky factor of the floored covariance, and its determinant."""
    p, out = len(STATS), moments
    for i in range(p):
        for j in range(i + 1):
            rest = F.col(f"s{i}{j}") + (FLOORS[i] ** 2 if i == j else 0.0)
            for k in range(j):
                rest = rest - F.col(f"l{i}{k}") * F.col(f"l{j}{k}")
            # with the floor's square added the matrix is positive definite, but for rounding
            out = out.withColumn(f"l{i}{j}", F.sqrt(F.greatest(rest, F.lit(1e-12))) if i == j else rest / F.col(f"l{j}{j}"))
    det = F.col("l00")
    for i in range(1, p):
        det = det * F.col(f"l{i}{i}")
    return out.select("g", "start", det.alias("det"), *_HELD)


#: Names of an estimate's means and factor.
_HELD = [*(f"m{i}" for i in range(len(STATS))), *(f"l{i}{j}" for i in range(len(STATS)) for j in range(i + 1))]


def _moments(rows: DataFrame) -> DataFrame:
    """The estimates of each group and start from its rows within their edges: all starts in one pass."""
    p, each, starts = len(STATS), [], []
    for s in range(len(STARTS)):
        x = [F.when(F.col(f"d{s}") <= F.col(f"edge{s}"), F.col(name)) for name in STATS]
        each += [F.avg(x[i]).alias(f"m{i}_{s}") for i in range(p)]
        each += [F.covar_pop(x[i], x[j]).alias(f"s{i}{j}_{s}") for i in range(p) for j in range(i + 1)]
        names = [*(f"m{i}" for i in range(p)), *(f"s{i}{j}" for i in range(p) for j in range(i + 1))]
        starts.append(F.struct(F.lit(s).alias("start"), *(F.col(f"{n}_{s}").alias(n) for n in names)))
    return _factors(rows.groupBy("g").agg(*each).select("g", F.inline(F.array(*starts))))


def _distances(rows: DataFrame, moments: DataFrame, suffixes: dict[str, str]) -> DataFrame:
    """Adds squared Mahalanobis distances, named by ``suffixes``, by forward substitution; 0 where a group has no estimate."""
    out, d = rows.join(moments, "g", "left"), {}
    for suffix in suffixes:
        d[suffix] = F.lit(0.0)
        for i, x in enumerate(STATS):
            z = F.col(x) - F.col(f"m{i}{suffix}")
            for j in range(i):
                z = z - F.col(f"l{i}{j}{suffix}") * F.col(f"z{j}{suffix}")
            out = out.withColumn(f"z{i}{suffix}", z / F.col(f"l{i}{i}{suffix}"))
            d[suffix] = d[suffix] + F.col(f"z{i}{suffix}") * F.col(f"z{i}{suffix}")
    return out.select(*rows.columns, *(F.coalesce(d[suffix], F.lit(0.0)).alias(name) for suffix, name in suffixes.items()))


def _started(rows: DataFrame, ws: Workspace) -> DataFrame:
    """``rows`` with d0, d1 ..., what each start takes for their distance.

    medians: from the medians, in floors.  means: from the means, in standard deviations.  deviations:
    the largest from the medians, in median deviations.
    """
    apart = lambda i, x: F.col(x) - F.col(f"c{i}")
    each = [(F.percentile_approx(x, 0.5, 10_000).alias(f"c{i}"), F.avg(x).alias(f"a{i}"), F.var_pop(x).alias(f"v{i}")) for i, x in enumerate(STATS)]
    middle = small_side(ws.save(rows.groupBy("g").agg(*(x for three in each for x in three)), "middle"))
    placed = rows.join(middle, "g")
    spread = placed.groupBy("g").agg(*(F.percentile_approx(F.abs(apart(i, x)), 0.5, 10_000).alias(f"e{i}") for i, x in enumerate(STATS)))
    placed = placed.join(small_side(ws.save(spread, "spread")), "g")
    medians = sum(((apart(i, x) / FLOORS[i]) ** 2 for i, x in enumerate(STATS)), F.lit(0.0))
    means = sum(((F.col(x) - F.col(f"a{i}")) ** 2 / (F.col(f"v{i}") + FLOORS[i] ** 2) for i, x in enumerate(STATS)), F.lit(0.0))
    deviations = F.greatest(*(F.abs(apart(i, x)) / (1.4826 * F.col(f"e{i}") + FLOORS[i]) for i, x in enumerate(STATS)))
    return placed.select("g", *STATS, *(d.alias(f"d{k}") for k, d in enumerate((medians, means, deviations))))


def _estimates(rows: DataFrame, ws: Workspace, share: float, steps: int) -> DataFrame:
    """For each group the minimum-covariance-determinant estimate that concentration steps reach from several starts.

    A row stays one row: it has a distance from each start's estimate.
    """
    near, every = _started(rows, ws), range(len(STARTS))
    for k in range(steps + 1):
        edge = near.groupBy("g").agg(*(F.percentile_approx(f"d{s}", share, 10_000).alias(f"edge{s}") for s in every))
        moments = ws.save(_moments(near.join(small_side(ws.save(edge, f"edge{k}")), "g")), f"moments{k}")  # a row a group and start
        wide = moments.groupBy("g").agg(*(F.max(F.when(F.col("start") == s, F.col(c))).alias(f"{c}_{s}") for s in every for c in _HELD))
        near = _distances(rows, small_side(ws.save(wide, f"wide{k}")), {f"_{s}": f"d{s}" for s in every})
    best = moments.groupBy("g").agg(F.min_by(F.struct(*_HELD), F.struct(F.round("det", 12), "start")).alias("best"))
    return best.select("g", "best.*")


def quality_verdicts(docs: DataFrame, keep: list[str] | None = None, cutoff: float = CUTOFF, share: float = SHARE, steps: int = STEPS, least: int = 100) -> DataFrame:
    """``keep`` columns, the base statistics, base_failed, distance and kept, one row for each input row.

    Groups are (lang, source).  Groups of fewer than ``least`` rows are held against the estimate of all
    rows of their language, and those of languages of fewer rows against that of all rows, however few
    these are.  For each estimate, ``steps`` concentration steps, each of which keeps the ``share`` of rows
    at the smallest distance, lead from each of STARTS to a covariance, and the least determinant
    wins.  Distances are corrected for the share.  Rows of more than ``cutoff`` squared distance are
    rejected, as are those that fail the base rules.  Rows that fail them are no part of any estimate.

    Null or empty texts have no words and fail.  A null lang or source is a value like any other.
    Ties at the share's edge are all inside, equal determinants go to the first start.  Repeated rows
    are judged alike.  No rows give no rows.  Extra columns are ignored.
    """
    ws = Workspace(docs.sparkSession, "quality")
    keep = keep or ["doc_id"]
    inner = [f"k{i}" for i in range(len(keep))]
    base = _base(docs.select(*(F.col(c).alias(k) for c, k in zip(keep, inner, strict=True)), F.struct("lang", "source").alias("ls"), "text"), [*inner, "ls"])
    base = base.withColumn("base_failed", F.expr("n_words < 10 or 100 * n_repeat_words > 20 * n_words")).select("*", *_statistics())
    base = ws.save(base, "base")
    sizes = base.groupBy("ls").agg(F.count_if(~F.col("base_failed")).alias("rows"))
    langs = sizes.groupBy(F.col("ls.lang").alias("pool_lang")).agg(F.sum("rows").alias("pool"), F.min("rows").alias("fewest"))
    every = langs.agg(F.coalesce(F.min("pool") < least, F.lit(False)).alias("mixed"))
    own, lang = F.concat_ws("\x01", F.lit("g"), F.col("lang"), F.lit("\x02"), F.col("source")), F.concat_ws("\x01", F.lit("l"), F.col("lang"))
    large, whole = F.col("rows") >= least, F.col("pool") >= least
    # the estimates that a group's rows are part of: only those against which some group is held
    teaches = F.array_compact(F.array(F.when(large, own), F.when(whole & (F.col("fewest") < least), lang), F.when(F.col("mixed"), "all")))
    sizes = sizes.select("ls.lang", "ls.source", "rows").join(langs, F.expr("lang <=> pool_lang"), "left").crossJoin(F.broadcast(every))  # one row
    sizes = sizes.select(F.struct("lang", "source").alias("ls"), F.when(large, own).when(whole, lang).otherwise("all").alias("g"), teaches.alias("teaches"))
    sizes = ws.save(sizes, "sizes")
    grouped = base.alias("a").join(small_side(sizes).alias("b"), F.expr("a.ls <=> b.ls"), "left").select("a.*", "b.g", "b.teaches")
    grouped = ws.save(grouped, "grouped")
    ws.drop("base")
    rows = grouped.where("not base_failed").select(F.explode("teaches").alias("g"), *STATS)
    out = _distances(grouped, small_side(ws.save(_estimates(rows, ws, share, steps), "estimates")), {"": "d"})
    out = out.withColumn("d", F.col("d") * consistency(len(STATS), share))
    return out.select(
        *(F.col(k).alias(c) for c, k in zip(keep, inner, strict=True)),
        "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed",
        F.col("d").alias("distance"), (~F.col("base_failed") & (F.col("d") <= cutoff)).alias("kept"),
    )
