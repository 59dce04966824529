"""Quality rules: base statistics, then robust multivariate outliers.

Every document's statistics become a short vector. For each language and source
the centre and spread with the least determinant over the core of the group are
sought by concentration steps from several starts, and documents far from it by
Mahalanobis distance go. Several statistics are constant in most texts, so
covariances are regularised: by floors, and those of a source towards those of
its language. All of it is aggregates and joins; vectors are
whole numbers on a fixed grid, so sums do not depend on the order of rows.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import materialize, materialize_counted, space_words, with_run_hashes

REPEAT_WINDOW_STEPS = 3  # windows of 2 ** 3 = 8 words
#: Steps of the grid on which vectors lie, per unit; steps of the grid of
#: distances per doubling.
GRID, BINS = 1000, 64
#: Dimensions, and the standard deviation that is added to each.
DIMS = ("x1", "x2", "x3", "x4")
FLOORS = (0.08, 0.06, 0.10, 0.10)
TRIANGLE = [(i, j) for i in range(4) for j in range(i + 1)]
#: From the whole to the part: what a level's groups are made of.
LEVELS = (("lang",), ("lang", "source"))


@dataclass(frozen=True)
class Robust:
    """Settings of the estimate.

    core: share of a group that a concentration step keeps; core_factor makes
    the spread of that share consistent for normal data in four dimensions.
    prior: rows for which the language's estimate counts in that of a source,
    whatever the source's size.
    weight_cut and reject_cut are squared distances (chi-square with four
    degrees of freedom at 0.975 and 0.999). A start ends when its log
    determinant falls by less than ``gain``; as each step has to gain that much,
    all of them end.
    """

    core: float = 0.75
    core_factor: float = 1.485
    prior: float = 20.0
    weight_cut: float = 11.143
    reject_cut: float = 18.467
    gain: float = 1e-3


def statistics(docs: DataFrame, keep: str = "") -> DataFrame:
    """doc_id, lang, source and the counts of every text, in one scan; with
    ``keep`` the columns of ``docs`` too, as a struct of that name."""
    text = F.coalesce("text", F.lit(""))
    rest = [F.struct(*[docs[c] for c in docs.columns]).alias(keep)] if keep else []
    carried = [keep] if keep else []
    base = docs.select("doc_id", "lang", "source", text.alias("text"), *rest).withColumn("w", space_words(F.col("text")))
    counted = base.select(
        "doc_id", "lang", "source", *carried,
        F.length("text").alias("n_chars"),
        F.size("w").cast("long").alias("n_words"),
        F.length(F.array_join("w", "")).cast("long").alias("word_chars"),
        (F.length("text") - F.length(F.regexp_replace("text", r"[#*$%&|<>]", ""))).cast("long").alias("n_symbols"),
        F.filter(F.split("text", "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]")).alias("lines"),
        F.transform("w", lambda x: F.xxhash64(x)).alias("h"),
    )
    hashed = with_run_hashes(counted, "h", REPEAT_WINDOW_STEPS)
    marked = hashed.withColumn("repeats", F.size("h") > F.size(F.array_distinct("h")))
    # Only texts with a repeated window sort theirs: equal neighbours are repeats.
    sorted_ = marked.withColumn("s", F.when(F.col("repeats"), F.array_sort(F.transform("h", lambda h, i: F.struct(h.alias("h"), i.alias("i"))))))
    n = F.size("s") - 1
    pairs = F.zip_with(F.slice("s", 1, n), F.slice("s", 2, n), lambda a, b: F.when(a["h"] == b["h"], F.array(a["i"], b["i"])).otherwise(F.array().cast("array<int>")))
    placed = sorted_.withColumn("p", F.when(F.col("repeats"), F.array_sort(F.array_distinct(F.flatten(pairs)))))
    m, size = F.size("p") - 1, 2**REPEAT_WINDOW_STEPS
    steps = F.zip_with(F.slice("p", 1, m), F.slice("p", 2, m), lambda a, b: F.least(b - a, F.lit(size)))
    covered = F.aggregate(steps, F.lit(size), lambda acc, x: acc + x)
    return placed.select(
        "doc_id", "lang", "source", *carried, "n_chars", "n_words", "word_chars", "n_symbols",
        F.size("lines").alias("n_lines"),
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"),
        F.when(F.col("repeats"), covered).otherwise(0).cast("long").alias("n_repeat_words"),
    )


def vectors(stats: DataFrame) -> DataFrame:
    """The transformed statistics on the grid; short texts lean to the usual."""
    raw = {
        "x1": F.log((F.col("word_chars") + 250) / (F.col("n_words") + 50)),
        "x2": F.sqrt(F.col("n_symbols") / (F.col("n_chars") + 50)),
        "x3": F.col("n_dup_lines") / (F.col("n_lines") + 2),
        "x4": F.col("n_repeat_words") / (F.col("n_words") + 20),
    }
    return stats.withColumns({k: F.round(v * GRID).cast("long") for k, v in raw.items()})


def _group(level: int) -> Column:
    """The group of a row at a level, as a string in which nulls have a place."""
    return F.to_json(F.struct(*LEVELS[level]))


#: Names of a group's sums, of an estimate, and of its parent's one beside it.
SUMS = ("n", *[f"s{i}" for i in range(4)], *[f"p{i}{j}" for i, j in TRIANGLE])
MOMENTS = (*[f"m{i}" for i in range(4)], *[f"c{i}{j}" for i, j in TRIANGLE])
ESTIMATE = (*MOMENTS, *[f"l{i}{j}" for i, j in TRIANGLE], "logdet")
PRIOR = tuple(f"prior_{c}" for c in MOMENTS)


def _sum_columns() -> list[Column]:
    """n, and the sums s of the vectors and p of their products."""
    sums = [F.sum(x).alias(f"s{i}") for i, x in enumerate(DIMS)]
    products = [F.sum(F.col(DIMS[i]) * F.col(DIMS[j])).alias(f"p{i}{j}") for i, j in TRIANGLE]
    return [F.count(F.lit(1)).alias("n"), *sums, *products]


def _with_prior(groups: DataFrame, prior: DataFrame | None) -> DataFrame:
    """``groups`` with the moments of their parents' estimates, if there are any."""
    if prior is None:
        return groups
    return groups.join(prior.select(F.col("group").alias("parent"), *[F.col(c).alias(p) for c, p in zip(MOMENTS, PRIOR, strict=True)]), "parent")


def _estimate(sums: DataFrame, settings: Robust, factor: float) -> DataFrame:
    """The sums replaced by centre m, spread c, its root l (Cholesky) and logdet.
    Where parents' moments stand beside them, those count too."""
    n = F.col("n").cast("double")
    mean = [F.col(f"s{i}") / n for i in range(4)]
    floors = {(i, j): F.lit((FLOORS[i] * GRID) ** 2 if i == j else 0.0) for i, j in TRIANGLE}
    spread = {(i, j): (F.col(f"p{i}{j}") / n - mean[i] * mean[j]) * factor + floors[i, j] for i, j in TRIANGLE}
    rest = [c for c in sums.columns if c not in SUMS]
    if PRIOR[0] not in rest:
        return _rooted(sums.select(*rest, *[mean[i].alias(f"m{i}") for i in range(4)], *[spread[i, j].alias(f"c{i}{j}") for i, j in TRIANGLE]))
    # The moments of the group's rows mixed with ``prior`` rows of the parent.
    w = n / (n + settings.prior)
    off = [mean[i] - F.col(f"prior_m{i}") for i in range(4)]
    return _rooted(sums.select(
        *rest, *[(w * mean[i] + (1 - w) * F.col(f"prior_m{i}")).alias(f"m{i}") for i in range(4)],
        *[(w * spread[i, j] + (1 - w) * F.col(f"prior_c{i}{j}") + w * (1 - w) * off[i] * off[j]).alias(f"c{i}{j}") for i, j in TRIANGLE],
    ))


def _rooted(found: DataFrame) -> DataFrame:
    """Adds the root l of the spread c, and logdet. Each column names earlier ones
    of the same select, so the plan is analysed once and not once a column."""
    root = []
    for i, j in TRIANGLE:
        rest = F.col(f"c{i}{j}")
        for k in range(j):
            rest = rest - F.col(f"l{i}{k}") * F.col(f"l{j}{k}")
        root.append((F.sqrt(rest) if i == j else rest / F.col(f"l{j}{j}")).alias(f"l{i}{j}"))
    return found.select("*", *root, (2 * F.log(F.col("l00") * F.col("l11") * F.col("l22") * F.col("l33"))).alias("logdet"))


def _with_distance(rows: DataFrame, estimate: DataFrame, *more: str) -> DataFrame:
    """``rows`` with d2, their squared distance, and ``more`` of the estimate."""
    joined = rows.join(estimate.select("group", *more, *[f"m{i}" for i in range(4)], *[f"l{i}{j}" for i, j in TRIANGLE]), "group")
    total: Column = F.lit(0.0)
    solved = []
    for i, x in enumerate(DIMS):
        rest = F.col(x) - F.col(f"m{i}")
        for k in range(i):
            rest = rest - F.col(f"l{i}{k}") * F.col(f"y{k}")
        solved.append((rest / F.col(f"l{i}{i}")).alias(f"y{i}"))
        total = total + F.col(f"y{i}") * F.col(f"y{i}")
    return joined.select("*", *solved).select(*rows.columns, total.alias("d2"), *more)


def _starts(rows: DataFrame, prior: DataFrame | None, settings: Robust) -> DataFrame:
    """Starts without a draw: medians with the floors, the moments of all of a
    group's rows, and its parent's estimate."""
    medians = [F.percentile(x, F.lit(0.5)).alias(f"median{i}") for i, x in enumerate(DIMS)]
    groups = materialize(_with_prior(rows.groupBy("group", "parent").agg(*medians, *_sum_columns()), prior), "groups")
    keys = ["group", "parent", *[c for c in groups.columns if c in PRIOR]]
    spread = {f"c{i}{j}": F.lit((FLOORS[i] * GRID) ** 2 if i == j else 0.0) for i, j in TRIANGLE}
    middle = groups.select(*keys, *[F.col(f"median{i}").alias(f"m{i}") for i in range(4)]).withColumns(spread)
    starts = _rooted(middle).withColumn("start", F.lit("medians"))
    starts = starts.unionByName(_estimate(groups.select(*keys, *SUMS), settings, 1.0).withColumn("start", F.lit("moments")))
    if prior is not None:
        theirs = groups.select(*keys, *[F.col(p).alias(c) for c, p in zip(MOMENTS, PRIOR, strict=True)])
        starts = starts.unionByName(_rooted(theirs).withColumn("start", F.lit("parent")))
    return starts


def _core(far: DataFrame, settings: Robust) -> DataFrame:
    """Sums of the nearest rows of every group and start. Distances are binned
    by their logarithm, so that all rows pass once and a group leaves a few
    hundred sums; the bin in which the core is reached belongs to it."""
    binned = far.withColumn("bin", F.floor(BINS * F.log2(1 + F.col("d2")))).groupBy("group", "start", "bin").agg(*_sum_columns())
    by = Window.partitionBy("group", "start")
    nearer = F.coalesce(F.sum("n").over(by.orderBy("bin").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    core = binned.withColumn("nearer", nearer).withColumn("all", F.sum("n").over(by)).where(F.col("nearer") < settings.core * F.col("all"))
    return core.groupBy("group", "start").agg(*[F.sum(F.col(c).cast("decimal(38,0)")).cast("double").alias(c) for c in SUMS])


def least_determinants(rows: DataFrame, prior: DataFrame | None, settings: Robust = Robust()) -> DataFrame:
    """Per group of ``rows`` (group, parent and the vectors) the estimate whose
    core has the least determinant, over all starts, then weighted once more.

    A round is one query with one scan of the rows. What it compares with goes
    along by a merge join on the keys its sums are dealt by already, and whether
    any start is still open is counted as it is written: the driver plans and
    broadcasts for every round, and that is what its memory goes into.
    """
    open_ = materialize(_starts(rows, prior, settings).withColumn("logdet", F.lit(float("inf"))), "starts")
    carried = [c for c in open_.columns if c not in ESTIMATE]
    ended = []
    while True:
        before = open_.select(*carried, *[F.col(c).alias(f"o_{c}") for c in ESTIMATE])
        core = _core(_with_distance(rows.select("group", *DIMS), open_, "start"), settings)
        new = _estimate(core.join(before.hint("merge"), ["group", "start"]), settings, settings.core_factor)
        new = new.withColumn("better", F.col("logdet") < F.col("o_logdet") - settings.gain)
        new, better = materialize_counted(new, "steps", F.col("better"))
        ended.append(new.where("not better").select("group", *[c for c in carried if c in ("parent", *PRIOR)], *[F.col(f"o_{c}").alias(c) for c in ESTIMATE]))
        if not better:
            break
        open_ = new.where("better").select(*open_.columns)
    all_ = ended[0]
    for more in ended[1:]:
        all_ = all_.unionByName(more)
    least = F.min_by(F.struct(*[c for c in all_.columns if c != "group"]), "logdet")
    best = materialize(all_.groupBy("group").agg(least.alias("b")).select("group", "b.*"), "best")
    near = _with_distance(rows.select("group", *DIMS), best).where(F.col("d2") <= settings.weight_cut)
    core = best.select("group", *[c for c in best.columns if c in PRIOR], *[F.col(c).alias(f"o_{c}") for c in ESTIMATE])
    found = _estimate(core.hint("merge").join(near.groupBy("group").agg(*_sum_columns()), "group", "left"), settings, 1.0)
    # A group none of whose rows is near keeps the estimate of its core.
    none = F.col("m0").isNull()
    return materialize(found.select("group", *[F.when(none, F.col(f"o_{c}")).otherwise(F.col(c)).alias(c) for c in ESTIMATE]), "estimate")


def outliers(stats: DataFrame, settings: Robust = Robust()) -> DataFrame:
    """``stats`` with d2, the squared robust distance of every row."""
    groups = {f"group{level}": _group(level) for level in range(len(LEVELS))}
    rows = materialize(vectors(stats).withColumns(groups), "vectors")
    prior = None
    for level in range(len(LEVELS)):
        grouped = rows.select(F.col(f"group{level}").alias("group"), F.col(f"group{max(level - 1, 0)}").alias("parent"), *DIMS)
        prior = least_determinants(grouped, prior, settings)
    return _with_distance(rows.withColumnRenamed(f"group{len(LEVELS) - 1}", "group"), prior)


#: SQL text of the base rules.
FAILED = "n_words < 20 OR 100 * n_repeat_words > 30 * n_words"


def quality(docs: DataFrame, settings: Robust = Robust()) -> DataFrame:
    """Statistics and verdict of every document.

    Returns one row per row of ``docs``: doc_id, n_words, word_chars, n_symbols,
    n_dup_lines, n_repeat_words, base_failed, kept, distance2. A null text has
    no words; a null lang or source is a group of its own; a group of any size
    has an estimate (that of its language, the more the smaller it is); repeated
    rows each get a row; texts of any length are read whole; an empty table
    gives an empty result. Repeated windows are found by 64-bit hashes within a
    text. Extra columns are not read.
    """
    found = outliers(statistics(docs), settings)
    return found.withColumn("base_failed", F.expr(FAILED)).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed",
        (~F.col("base_failed") & (F.col("d2") <= settings.reject_cut)).alias("kept"),
        F.col("d2").alias("distance2"),
    )


def keep_good(docs: DataFrame, settings: Robust = Robust()) -> DataFrame:
    """The rows of ``docs`` that the rules and the estimate keep.

    Columns stay as they are, whatever their names. Texts are carried beside
    their vectors, so none is shuffled; nulls, repeats, texts of any length and
    empty tables are as in ``quality``.
    """
    found = outliers(statistics(docs, keep="whole"), settings)
    return found.where(~F.expr(FAILED) & (F.col("d2") <= settings.reject_cut)).select("whole.*")
