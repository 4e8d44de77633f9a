"""Scores of predictions as aggregates: accuracy, balanced accuracy, log loss, ROC AUC, F1, paired tests."""

from __future__ import annotations

from math import erf, exp, lgamma, log, sqrt

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from dyadix.operators.prefix import running_before
from dyadix.operators.quantiles import aggregated

EPS = 2.220446049250313e-16


def argmax(p: Column) -> Column:
    """First position of the largest probability, from 0."""
    return (F.array_position(p, F.array_max(p)) - 1).cast("int")


def one_hot(y: Column, n: int) -> Column:
    return F.transform(F.sequence(F.lit(0), F.lit(n - 1)), lambda k: (k == y).cast("double"))


def accuracy(df: DataFrame, keys: list[str], y: str = "y", pred: str = "pred") -> DataFrame:
    return df.groupBy(*keys).agg(F.avg((F.col(y) == F.col(pred)).cast("double")).alias("accuracy"))


def balanced_accuracy(df: DataFrame, keys: list[str], y: str = "y", pred: str = "pred") -> DataFrame:
    recall = df.groupBy(*keys, y).agg(F.avg((F.col(y) == F.col(pred)).cast("double")).alias("recall"))
    return recall.groupBy(*keys).agg(F.avg("recall").alias("balanced_accuracy"))


def log_loss(df: DataFrame, keys: list[str], y: str = "y", proba: str = "proba") -> DataFrame:
    p = F.get(F.col(proba), F.col(y).cast("int"))
    return df.groupBy(*keys).agg((-F.avg(F.ln(F.least(F.greatest(p, F.lit(EPS)), F.lit(1 - EPS))))).alias("log_loss"))


def roc_auc(df: DataFrame, keys: list[str], y: str, score: str) -> DataFrame:
    """Mann-Whitney with average ranks, from one row per distinct score: ties are added up before they are ranked."""
    per = df.groupBy(*keys, score).agg(F.sum(F.col(y).cast("long")).alias("pos"), F.count("*").alias("n"))
    ranked = running_before(per.withColumn("neg", F.col("n") - F.col("pos")), keys, score, "neg", "before")
    wins = ranked.withColumn("u", F.col("pos") * (F.col("before") + F.col("neg") / 2))
    return wins.groupBy(*keys).agg((F.sum("u") / F.nullif(F.sum("pos") * F.sum(F.col("n") - F.col("pos")), F.lit(0))).alias("roc_auc"))


def roc_auc_ovr(df: DataFrame, keys: list[str], n_classes: int, y: str = "y", proba: str = "proba") -> DataFrame:
    """One class against the rest, weighted by prevalence."""
    each = df.select(*keys, y, F.posexplode(proba).alias("klass", "p")).select(*keys, "klass", (F.col(y) == F.col("klass")).cast("int").alias("hit"), "p")
    auc = roc_auc(each, [*keys, "klass"], "hit", "p")
    count = df.groupBy(*keys, F.col(y).cast("int").alias("klass")).agg(F.count("*").alias("w"))
    return auc.join(count, [*keys, "klass"]).groupBy(*keys).agg((F.sum(F.col("roc_auc") * F.col("w")) / F.sum("w")).alias("roc_auc"))


def minority_class(df: DataFrame, keys: list[str], y: str = "y") -> DataFrame:
    per = df.groupBy(*keys, y).agg(F.count("*").alias("n"))
    return per.groupBy(*keys).agg(F.min_by(y, F.struct("n", y)).alias("minority"))


def f1_per_class(df: DataFrame, keys: list[str], y: str = "y", pred: str = "pred") -> DataFrame:
    """(keys, klass, support, f1): confusion counts first, so the rest works on classes."""
    counts = df.groupBy(*keys, y, pred).agg(F.count("*").alias("n"))
    sides = counts.select(*keys, F.explode(F.array(
        F.struct(F.col(y).alias("klass"), F.when(F.col(y) == F.col(pred), F.col("n")).otherwise(0).alias("tp"), F.col("n").alias("is"), F.lit(0).cast("long").alias("said")),
        F.struct(F.col(pred).alias("klass"), F.lit(0).cast("long").alias("tp"), F.lit(0).cast("long").alias("is"), F.col("n").alias("said")))).alias("s")).select(*keys, "s.*")
    return sides.groupBy(*keys, "klass").agg(F.sum("is").alias("support"), F.coalesce(
        2 * F.sum("tp") / F.nullif(F.sum("is") + F.sum("said"), F.lit(0)), F.lit(0.0)).alias("f1"))


def f1(df: DataFrame, keys: list[str], n_classes: int, y: str = "y", pred: str = "pred") -> DataFrame:
    """Two classes: of the rarer one; more: weighted by support."""
    per = f1_per_class(df, keys, y, pred)
    if n_classes == 2:
        return per.where("support > 0").groupBy(*keys).agg(F.min_by("f1", F.struct("support", "klass")).alias("f1"))
    return per.groupBy(*keys).agg((F.sum(F.col("f1") * F.col("support")) / F.sum("support")).alias("f1"))


def all_metrics(df: DataFrame, keys: list[str], n_classes: int) -> DataFrame:
    """``df(keys, y, pred, proba)`` -> the five scores, one row per key."""
    auc = roc_auc(df.withColumn("__p", F.get("proba", F.lit(1))), keys, "y", "__p") if n_classes == 2 else roc_auc_ovr(df, keys, n_classes)
    out = accuracy(df, keys)
    for part in (balanced_accuracy(df, keys), log_loss(df, keys), auc, f1(df, keys, n_classes)):
        out = out.join(part, keys)
    return out


def all_metrics_by_classes(df: DataFrame, keys: list[str]) -> DataFrame:
    """The five scores of ``df(keys, classes, y, pred, proba)``, where each key has its own number of classes."""
    return all_metrics(df.where("classes = 2"), keys, 2).unionByName(all_metrics(df.where("classes <> 2"), keys, 3))


def difference_summary(df: DataFrame, keys: list[str], a: str, b: str) -> DataFrame:
    d = F.abs(F.col(a) - F.col(b))
    return df.groupBy(*keys).agg(
        F.max(d).alias("max_abs_diff"), F.avg(d).alias("mean_abs_diff"), F.max(d / F.nullif(F.abs(F.col(b)), F.lit(0.0))).alias("max_rel_diff"),
        F.sum((F.col(a).cast("float") != F.col(b).cast("float")).cast("long")).alias("float32_disagreements"), F.count("*").alias("n"))


def correlation(df: DataFrame, keys: list[str], a: str, b: str) -> DataFrame:
    return df.groupBy(*keys).agg(F.corr(a, b).alias("correlation"))


def paired_counts(df: DataFrame, a: str, b: str) -> DataFrame:
    counts = [F.count_if(F.col(a) > F.col(b)).alias("wins"), F.count_if(F.col(a) == F.col(b)).alias("ties"), F.count_if(F.col(a) < F.col(b)).alias("losses")]
    return aggregated(df, [], [*counts, F.avg(a).alias("mean_a"), F.avg(b).alias("mean_b")], {"median_a": (F.col(a), 0.5), "median_b": (F.col(b), 0.5)})


def wilcoxon_sums(df: DataFrame, a: str, b: str) -> DataFrame:
    """Signed-rank sums with average ranks, zero differences left out: ties are counted before they are ranked."""
    d = df.select((F.col(a) - F.col(b)).alias("d")).where("d <> 0")
    per = d.groupBy(F.abs("d").alias("size")).agg(F.count_if(F.col("d") > 0).alias("up"), F.count("*").alias("n"))
    rank = F.col("before") + (F.col("n") + 1) / 2
    ranked = running_before(per, [], "size", "n", "before").select((F.col("up") * rank).alias("up"), ((F.col("n") - F.col("up")) * rank).alias("down"), "n")
    return ranked.agg(F.sum("up").alias("w_plus"), F.sum("down").alias("w_minus"), F.sum("n").alias("n"), F.sum(F.col("n") * F.col("n") * F.col("n") - F.col("n")).alias("tie_term"))


def wilcoxon_greater(w_plus: float, n: int, tie_term: float = 0.0) -> float:
    """One-sided p value: exact for up to 50 untied pairs, else by the normal limit."""
    if n <= 50 and not tie_term:
        ways = [1] + [0] * (n * (n + 1) // 2)
        for k in range(1, n + 1):
            for s in range(len(ways) - 1, k - 1, -1):
                ways[s] += ways[s - k]
        return sum(ways[int(w_plus):]) / 2 ** n
    spread = sqrt(n * (n + 1) * (2 * n + 1) / 24 - tie_term / 48)
    return 0.5 * (1 - erf((w_plus - n * (n + 1) / 4) / spread / sqrt(2)))


def t_statistics(df: DataFrame, a: str, b: str) -> DataFrame:
    d = F.col(a) - F.col(b)
    return df.agg(F.count(d).alias("n"), F.avg(d).alias("mean_diff"), F.stddev_samp(d).alias("sd_diff"), (F.avg(d) / (F.stddev_samp(d) / F.sqrt(F.count(d)))).alias("t"))


def t_greater(t: float, df: int, steps: int = 4000) -> float:
    """P(T > t) by Simpson's rule on the tail after x = t + u / (1 - u)."""
    lead = exp(lgamma((df + 1) / 2) - lgamma(df / 2)) / sqrt(df * 3.141592653589793)

    def f(u: float) -> float:
        if u >= 1:
            return 0.0
        x = abs(t) + u / (1 - u)
        return lead * exp(-(df + 1) / 2 * log(1 + x * x / df)) / (1 - u) ** 2

    h = 1 / steps
    total = f(0) + f(1 - 1e-9) + sum((4 if k % 2 else 2) * f(k * h) for k in range(1, steps))
    tail = total * h / 3
    return tail if t >= 0 else 1 - tail
