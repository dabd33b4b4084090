"""Classification and calibration metrics over long probabilities (id, y, cls, p)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tarnlake.operators.ranks import running


def predictions(probs: DataFrame) -> DataFrame:
    """(id, y, pred, conf); ties go to the lowest class."""
    return probs.groupBy("id", "y").agg(F.max_by("cls", F.struct("p", -F.col("cls"))).alias("pred"), F.max("p").alias("conf"))


def confusion(pred: DataFrame) -> DataFrame:
    return pred.groupBy("y", "pred").agg(F.count("*").alias("n"))


def accuracy_metrics(pred: DataFrame) -> DataFrame:
    """One row: accuracy, balanced accuracy (mean recall of the true classes), macro F1 (union of classes)."""
    c = confusion(pred)
    side = lambda name: c.groupBy(F.col(name).alias("cls")).agg(F.sum("n").alias(f"n_{name}"))
    hit = c.where("y = pred").select(F.col("y").alias("cls"), F.col("n").alias("hit"))
    per = side("y").join(side("pred"), "cls", "full").join(hit, "cls", "left").fillna(0, ["n_y", "n_pred", "hit"])
    recall = F.when(F.col("n_y") > 0, F.col("hit") / F.col("n_y"))
    f1 = F.when(F.col("n_y") + F.col("n_pred") > 0, 2 * F.col("hit") / (F.col("n_y") + F.col("n_pred"))).otherwise(0.0)
    return per.agg((F.sum("hit") / F.sum("n_y")).alias("accuracy"), F.avg(recall).alias("balanced_acc"), F.avg(f1).alias("macro_f1"))


def mid_rank_auroc(scored: DataFrame, by: list[str]) -> DataFrame:
    """AUROC of (score, positive) within ``by``, by mid-ranks; null where only one class is there.

    Rows are counted by score first, and only distinct scores are put in order, over as many tasks as they need.
    """
    counts = scored.groupBy(*by, "score").agg(F.count("*").alias("n"), F.count_if("positive").alias("n1"))
    placed = running(counts, by, ["score"], "n", "upto", "total")
    middle = F.col("upto") - (F.col("n") - 1) / 2.0  # the mean rank of rows of this score
    sums = placed.groupBy(*by).agg(F.sum(F.col("n1") * middle).alias("ranks"), F.sum("n1").alias("n1"), F.max("total").alias("n"))
    u = F.col("ranks") - F.col("n1") * (F.col("n1") + 1) / 2.0
    both = (F.col("n1") > 0) & (F.col("n1") < F.col("n"))
    return sums.select(*by, F.when(both, u / (F.col("n1") * (F.col("n") - F.col("n1")))).alias("auroc"))


def auroc_ovr(probs: DataFrame) -> DataFrame:
    return mid_rank_auroc(probs.select("cls", F.col("p").alias("score"), (F.col("y") == F.col("cls")).alias("positive")), ["cls"])


def macro_auroc(probs: DataFrame) -> DataFrame:
    """Mean over classes; null if any class is missing from the truth."""
    per = auroc_ovr(probs)
    return per.agg(F.when(F.count("*") == F.count("auroc"), F.avg("auroc")).alias("auroc"))


def as_calibrated(probs: DataFrame) -> DataFrame:
    """Softmax of the log of clipped probabilities: they are clipped and made to sum to 1 again."""
    c = F.greatest(F.least("p", F.lit(1.0)), F.lit(1e-6))
    return probs.withColumn("p", c / F.sum(c).over(Window.partitionBy("id")))


def nll(probs: DataFrame) -> Column:
    return F.avg(F.when(F.col("y") == F.col("cls"), -F.log(F.greatest(F.least("p", F.lit(1.0)), F.lit(1e-7))))).alias("nll")


def brier(probs: DataFrame) -> DataFrame:
    d = F.col("p") - (F.col("y") == F.col("cls")).cast("double")
    return probs.groupBy("id").agg(F.sum(d * d).alias("b")).agg(F.avg("b").alias("brier"))


def equal_width_bin(conf: Column, bins: int) -> Column:
    """Bins are open at their lower edge but for the first."""
    return F.greatest(F.lit(0), F.least(F.lit(bins - 1), F.ceil(conf * bins).cast("int") - 1))


def reliability(pred: DataFrame, bins: int = 15) -> DataFrame:
    """(bin, n, acc, conf) for every bin, zeros where it is empty."""
    hit = (F.col("y") == F.col("pred")).cast("double")
    got = pred.groupBy(equal_width_bin(F.col("conf"), bins).alias("bin")).agg(F.count("*").alias("n"), F.avg(hit).alias("acc"), F.avg("conf").alias("conf"))
    spine = pred.sparkSession.range(bins).select(F.col("id").cast("int").alias("bin"))
    return spine.join(got, "bin", "left").fillna(0, ["n"]).fillna(0.0, ["acc", "conf"])


def ece(binned: DataFrame) -> DataFrame:
    return binned.agg((F.sum(F.col("n") * F.abs(F.col("acc") - F.col("conf"))) / F.sum("n")).alias("ece"))


def adaptive_bins(pred: DataFrame, bins: int = 15) -> DataFrame:
    """Equal-mass bins: exact quantile edges, made distinct, the ends at 0 and 1."""
    edges = pred.agg(F.array_distinct(F.percentile("conf", [i / bins for i in range(bins + 1)])).alias("e"))
    edges = edges.select(F.when(F.size("e") < 2, F.array(F.lit(0.0), F.lit(1.0))).otherwise(F.concat(F.array(F.lit(0.0)), F.slice("e", 2, F.size("e") - 2), F.array(F.lit(1.0)))).alias("e"))
    at = F.greatest(F.lit(0), F.size(F.filter("e", lambda x: x < F.col("conf"))) - 1)
    binned = pred.join(F.broadcast(edges), F.lit(True)).withColumn("bin", at)  # one row of at most bins + 1 edges
    return binned.groupBy("bin").agg(F.count("*").alias("n"), F.avg((F.col("y") == F.col("pred")).cast("double")).alias("acc"), F.avg("conf").alias("conf"))


def tempered(probs: DataFrame, t: Column | float) -> DataFrame:
    """Probabilities of the log of clipped ones over a temperature."""
    z = F.log(F.greatest(F.least("p", F.lit(1.0)), F.lit(1e-6))) / t
    e = F.exp(z)
    return probs.withColumn("p", e / F.sum(e).over(Window.partitionBy("id")))


def calibration_row(probs: DataFrame, bins: int = 15) -> DataFrame:
    """One row: ece_ew, ece_adaptive, nll, brier, accuracy of calibrated probabilities."""
    pred = predictions(probs)
    one = lambda d, name: d.toDF(name).withColumn("one", F.lit(1))
    out = one(ece(reliability(pred, bins)), "ece_ew").join(one(ece(adaptive_bins(pred, bins)), "ece_adaptive"), "one")
    out = out.join(one(probs.agg(nll(probs)), "nll"), "one").join(one(brier(probs), "brier"), "one")
    return out.join(one(pred.agg(F.avg((F.col("y") == F.col("pred")).cast("double"))), "accuracy"), "one").drop("one")


def dirichlet(votes_dense: DataFrame, scale: float = 1.0) -> DataFrame:
    """(id, y, cls, alpha, mean, vacuity, logit) of evidence scale * vote + 1."""
    w = Window.partitionBy("id")
    a = votes_dense.withColumn("alpha", F.lit(scale) * F.col("p") + 1)
    return a.select("id", "y", "cls", "alpha", (F.col("alpha") / F.sum("alpha").over(w)).alias("mean"), (F.count("*").over(w) / F.sum("alpha").over(w)).alias("vacuity"), F.log("alpha").alias("logit"))
