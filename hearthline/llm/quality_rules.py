"""Quality rules with SQL functions only: fixed base limits, then robust multivariate outliers.

Each text becomes a vector of four transformed statistics. Repeated lines are no part of it: most
documents have none, so a core's spread of them is none either; repeated words hold them already.

Per language and source, a minimum-covariance-determinant estimate is reached by concentration steps
from several starts (the closest half, the closest three quarters and the whole of a group around its
median): distances from the last estimate are binned, the bins holding the closest three quarters are
summed into new moments, and a Cholesky factor of those gives the next distances. The start with the
smallest determinant wins. One step is one map-side-combined aggregation to at most ``BINS`` rows per
group and start, and the models, one row each, are broadcast after a check of their number, so a group
with a third of all documents costs no more to shuffle than any other. Vectors are integers (1/1024
steps), so sums do not depend on order.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from hearthline.llm.common import SPACE, SPACE_CLASS, materialise

SCALE = 1024
BINS = 400
DIMS = 4
#: Least standard deviation of each statistic that counts as spread (in its transformed unit).
FLOORS = (0.15, 0.06, 0.12, 0.08)
#: Share of a group taken as its core, and the factor that makes a core's covariance consistent for it.
CORE, CONSISTENCY = 0.75, 1.486
#: Share taken in the first step, by start.
STARTS = (0.5, 0.75, 1.0)
#: Squared robust distance beyond which a vector is rejected: 4 F(0.999; 4, 6), the 99.9 % quantile of a t law of
#: four dimensions with six degrees of freedom, as statistics of clean prose have longer tails than the normal law.
CUTOFF = 87.7
#: Up to so many rows of models or group keys (some 200 bytes each) are broadcast; more are joined by shuffle.
BROADCAST_ROWS = 50_000
#: Groups with fewer rows use their language's pooled estimate, or the table's.
LEAST_GROUP = 64
STEPS = 4

PAIRS = [(i, j) for i in range(DIMS) for j in range(i + 1)]


def _let(name: str, value: str, body: str) -> str:
    return f"element_at(transform(array({value}), {name} -> {body}), 1)"


def _repeat_words(words: str) -> str:
    """Words inside any 3-word window that occurs twice or more, by sorting hashed windows with their places."""
    places = _let(
        "s",
        "sort_array(transform(h, (x, i) -> struct(x AS x, i AS i)))",
        "sort_array(transform(filter(s, (e, k) -> (k > 0 AND s[k - 1].x = e.x) OR (k < size(s) - 1 AND s[k + 1].x = e.x)), e -> e.i))",
    )
    covered = _let(
        "p", places, "aggregate(sequence(0, size(p) - 1), 0L, (a, k) -> a + if(k = size(p) - 1, 3, least(3, p[k + 1] - p[k])))"
    )
    hashes = f"transform(sequence(0, size({words}) - 3), i -> xxhash64({words}[i], {words}[i + 1], {words}[i + 2]))"
    found = _let("h", hashes, f"if(size(array_distinct(h)) = size(h), 0L, {covered})")
    return f"if(size({words}) < 6, {_short_repeats(words)}, {found})"


def _short_repeats(words: str) -> str:
    """Texts of four or five words: equal windows overlap or touch, and cover every word between their ends."""
    return _let(
        "t",
        f"transform(if(size({words}) < 4, array(), sequence(0, size({words}) - 3)), i -> struct({words}[i] AS a, {words}[i + 1] AS b, {words}[i + 2] AS c))",
        f"size(array_distinct(flatten(transform(t, (e, i) -> if(size(filter(t, f -> f = e)) > 1, array(i, i + 1, i + 2), array())))))",
    )


def text_statistics(docs: DataFrame, id_col: str, text_col: str, group_cols: list[str]) -> DataFrame:
    """(doc, version, g1.., n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words) of every row; null texts have no words."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    trimmed = F.btrim(text, F.lit(SPACE))
    base = docs.select(
        F.col(id_col).alias("doc"),
        F.xxhash64(text_col).alias("version"),
        *[F.coalesce(F.col(c).cast("string"), F.lit("")).alias(f"g{k}") for k, c in enumerate(group_cols)],
        text.alias("text"),
        F.when(trimmed == "", F.array().cast("array<string>")).otherwise(F.split(trimmed, SPACE_CLASS + "+")).alias("words"),
        F.filter(F.split(text, "\n", -1), lambda x: F.btrim(x, F.lit(SPACE)) != "").alias("lines"),
    )
    return base.select(
        "doc",
        "version",
        *[f"g{k}" for k in range(len(group_cols))],
        F.size("words").cast("long").alias("n_words"),
        F.char_length(F.array_join("words", "")).cast("long").alias("word_chars"),
        (F.char_length("text") - F.char_length(F.regexp_replace("text", r"[#*$%&|<>]+", ""))).cast("long").alias("n_symbols"),
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"),
        F.expr(_repeat_words("words")).cast("long").alias("n_repeat_words"),
    )


def _vector() -> list[Column]:
    words = F.greatest(F.col("n_words"), F.lit(1)).cast("double")
    parts = [
        F.log(words),
        F.log(F.greatest(F.col("word_chars"), F.lit(1)) / words),
        F.sqrt(F.col("n_symbols") / words),
        F.sqrt(F.col("n_repeat_words") / words),
    ]
    return [F.rint(p * SCALE).cast("long").alias(f"x{i}") for i, p in enumerate(parts)]


def _cholesky(model: DataFrame) -> DataFrame:
    """The factor l_ij of the model's covariance c_ij in its place."""
    for i, j in PAIRS:
        rest = sum((F.col(f"l{i}{k}") * F.col(f"l{j}{k}") for k in range(j)), F.lit(0.0))
        value = F.col(f"c{i}{j}") - rest
        model = model.withColumn(f"l{i}{j}", F.sqrt(F.greatest(value, F.lit(1e-6))) if i == j else value / F.col(f"l{j}{j}"))
    return model.select("g", "start", *[f"m{i}" for i in range(DIMS)], *[f"l{i}{j}" for i, j in PAIRS])


def _joined(rows: DataFrame, table: DataFrame, keys: str | list[str]) -> DataFrame:
    """``rows`` with those of a written table that has few rows per group; rows are only shuffled where it is too large to broadcast."""
    return rows.join(F.broadcast(table) if table.count() <= BROADCAST_ROWS else table, keys)


def _distance(rows: DataFrame) -> DataFrame:
    """Adds d2, the squared distance from the model's centre in its metric, by forward substitution."""
    for i in range(DIMS):
        rest = sum((F.col(f"l{i}{k}") * F.col(f"y{k}") for k in range(i)), F.lit(0.0))
        rows = rows.withColumn(f"y{i}", (F.col(f"x{i}") / F.lit(float(SCALE)) - F.col(f"m{i}") - rest) / F.col(f"l{i}{i}"))
    return rows.withColumn("d2", sum((F.col(f"y{i}") * F.col(f"y{i}") for i in range(DIMS)), F.lit(0.0)))


def _medians(rows: DataFrame, shift: list[Column], take) -> DataFrame:
    """Median of each (transformed) statistic by group, from counts of 1/32-wide bins: no group is gathered."""
    cells = rows.select("g", F.posexplode(F.array(*[take(c) for c in shift])).alias("dim", "v"))
    cells = cells.select("g", "dim", F.floor(F.least(F.greatest(F.col("v"), F.lit(-32.0)), F.lit(64.0)) * 32).alias("bin"))
    counts = cells.groupBy("g", "dim", "bin").agg(F.count("*").alias("n"))
    order = Window.partitionBy("g", "dim").orderBy("bin")
    total = Window.partitionBy("g", "dim")
    ranked = counts.select("g", "dim", "bin", F.sum("n").over(order).alias("upto"), F.sum("n").over(total).alias("of"))
    found = ranked.where(F.col("upto") * 2 >= F.col("of")).groupBy("g", "dim").agg(((F.min("bin") + F.lit(0.5)) / 32).alias("med"))
    return found.groupBy("g").pivot("dim", list(range(DIMS))).agg(F.first("med"))


def _concentrated(vectors: DataFrame, model: DataFrame, shares: dict[int, float]) -> DataFrame:
    """Models of the closest share of each group by the distances of ``model``; a start of its own for each of ``shares``."""
    placed = _distance(_joined(vectors, model, "g")).withColumn("bin", F.least(F.floor(F.log2(F.col("d2") + 1.0) * 16), F.lit(BINS - 1)))
    sums = [F.count("*").alias("n"), *[F.sum(f"x{i}").alias(f"s{i}") for i in range(DIMS)]]
    sums += [F.sum(F.col(f"x{i}") * F.col(f"x{j}")).alias(f"q{i}{j}") for i, j in PAIRS]
    binned = placed.groupBy("g", "start", "bin").agg(*sums)
    order, total = Window.partitionBy("g", "start").orderBy("bin"), Window.partitionBy("g", "start")
    binned = binned.withColumn("before", F.sum("n").over(order) - F.col("n")).withColumn("of", F.sum("n").over(total))
    if len(shares) > 1:
        cores = F.explode(F.array(*[F.struct(F.lit(k).alias("start"), F.lit(share).alias("core")) for k, share in shares.items()])).alias("c")
        binned = binned.drop("start").select("*", cores).select("*", "c.start", "c.core").drop("c")
    else:
        binned = binned.withColumn("core", F.lit(next(iter(shares.values()))))
    core = binned.where(F.col("before") < F.col("of") * F.col("core")).groupBy("g", "start")
    core = core.agg(*[F.sum(c).cast("double").alias(c) for c in ["n", *[f"s{i}" for i in range(DIMS)], *[f"q{i}{j}" for i, j in PAIRS]]])
    moments = core.select(
        "g",
        "start",
        *[(F.col(f"s{i}") / F.col("n") / SCALE).alias(f"m{i}") for i in range(DIMS)],
        *[
            (
                (F.col(f"q{i}{j}") / F.col("n") - F.col(f"s{i}") / F.col("n") * F.col(f"s{j}") / F.col("n")) / SCALE**2 * CONSISTENCY
                + F.lit(FLOORS[i] ** 2 if i == j else 0.0)
            ).alias(f"c{i}{j}")
            for i, j in PAIRS
        ],
    )
    return materialise(_cholesky(moments), "mcd")


def fit_outlier_model(vectors: DataFrame) -> DataFrame:
    """One row (g, centre, Cholesky factor, log_det) per group of ``vectors`` (g, x0..x3); it is written out between steps."""
    plain = [F.col(f"x{i}") / F.lit(float(SCALE)) for i in range(DIMS)]
    centre = materialise(_medians(vectors, plain, lambda c: c).toDF("g", *[f"m{i}" for i in range(DIMS)]), "mcd")
    around = _joined(vectors, centre, "g")
    spread = _medians(around, list(range(DIMS)), lambda i: F.abs(plain[i] - F.col(f"m{i}"))).toDF("g", *[f"s{i}" for i in range(DIMS)])
    model = centre.join(spread, "g").withColumn("start", F.lit(0))
    for i, j in PAIRS:
        wide = F.pow(F.greatest(F.col(f"s{i}") * 1.4826, F.lit(FLOORS[i])), F.lit(2.0))
        model = model.withColumn(f"c{i}{j}", wide if i == j else F.lit(0.0))
    model = _concentrated(vectors, materialise(_cholesky(model), "mcd"), dict(enumerate(STARTS)))
    for _ in range(STEPS - 1):
        model = _concentrated(vectors, model, {0: CORE})
    names = [*[f"m{i}" for i in range(DIMS)], *[f"l{i}{j}" for i, j in PAIRS], "log_det"]
    model = model.withColumn("log_det", 2 * sum((F.log(f"l{i}{i}") for i in range(DIMS)), F.lit(0.0)))
    best = model.groupBy("g").agg(F.min_by(F.struct(*names), F.struct("log_det", "start")).alias("best"))
    return materialise(best.select("g", "best.*"), "mcd")


def _grouped(stats: DataFrame, n_groups: int) -> DataFrame:
    """Adds g: the row's own group where it is large enough, else its first key pooled, else all such rows."""
    keys = [f"g{k}" for k in range(n_groups)]
    sizes = stats.groupBy(*keys).agg(F.count("*").alias("own"))
    small = sizes.where(F.col("own") < LEAST_GROUP).groupBy(keys[0]).agg(F.sum("own").alias("pool"))
    place = sizes.join(small, keys[0], "left").select(
        *keys,
        F.when(F.col("own") >= LEAST_GROUP, F.concat_ws("\x1f", F.lit("own"), *keys))
        .when(F.col("pool") >= LEAST_GROUP, F.concat_ws("\x1f", F.lit("pool"), keys[0]))
        .otherwise(F.lit("all"))
        .alias("g"),
    )
    return _joined(stats, materialise(place, "quality-place"), keys)


def judge(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", group_cols=("lang", "source")) -> DataFrame:
    """(doc, version, statistics, base_failed, d2, kept) for every row of ``docs``.

    Base: fewer than 50 words, or more than half of the words inside repeated 3-word windows. Rows
    that pass are rejected where their squared robust distance exceeds ``CUTOFF``. Groups are fitted
    on the rows that pass the base. Null texts are empty and fail; null group keys count as one key;
    an empty table gives an empty result; repeated rows are judged alike.
    """
    group_cols = list(group_cols)
    failed = (F.col("n_words") < 50) | (F.col("n_repeat_words") * 100 > F.col("n_words") * 50)
    stats = text_statistics(docs, id_col, text_col, group_cols).withColumn("base_failed", failed)
    stats = materialise(stats.select("*", *_vector()), "quality")
    passed = materialise(_grouped(stats.where(~F.col("base_failed")), len(group_cols)), "quality-groups")
    model = fit_outlier_model(passed.select("g", *[f"x{i}" for i in range(DIMS)]))
    seen = ["doc", "version", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed"]
    good = _distance(_joined(passed, model, "g")).select(*seen, "d2", (F.col("d2") <= CUTOFF).alias("kept"))
    return good.unionByName(stats.where("base_failed").select(*seen, F.lit(None).cast("double").alias("d2"), F.lit(False).alias("kept")))


def filter_quality(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """The rows of ``docs`` that are kept, with all their columns. Rows without an id are judged by their text alone."""
    out = judge(docs, id_col, text_col, **options).where(~F.col("kept"))
    out = out.select(F.col("doc").alias("__doc"), F.col("version").alias("__version")).distinct()
    return docs.join(out, F.col(id_col).eqNullSafe(F.col("__doc")) & (F.xxhash64(text_col) == F.col("__version")), "left_anti")


def op8_quality_rules(spark, sf_dir: str) -> DataFrame:
    """doc_id, base statistics, base_failed and the verdict for all documents."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", "lang", "source")
    return judge(docs).drop("version").withColumnRenamed("doc", "doc_id")
