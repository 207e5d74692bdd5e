"""Multinomial naive Bayes over token counts, plain or weighted by IDF, and its explanations."""

from __future__ import annotations

import math
import warnings
from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomtext.errors import EmptyTrainingSet
from loomtext.functions.scores import softmax
from loomtext.functions.text import tokens
from loomtext.operators.features import BROADCAST_TOKENS, TfIdf, fit_tfidf

ALPHA = 1.0


@dataclass
class BayesModel:
    """labels: (label, docs, prior, total), one row a label; counts: (label, token, c); n_tokens: the vocabulary's size.

    idf is there for the TF-IDF variant. Tables are kept as DataFrames: counts grow with the vocabulary.
    """

    labels: DataFrame
    counts: DataFrame
    n_tokens: int
    idf: TfIdf | None = None
    alpha: float = ALPHA
    _kept: list[DataFrame] = field(default_factory=list, repr=False)

    def release(self) -> None:
        """Forget the tables that are kept in memory or on disk; the model can still be used, and reads its samples again."""
        for df in (self.counts, *self._kept, *([self.idf.vocab] if self.idf else [])):
            df.unpersist()
        self._kept.clear()

    def _words(self) -> tuple[DataFrame, list[tuple[str, float, float]]]:
        """(token, c, m, h0, h1, ...) and for each label its name, log prior and the log probability of a token it never had.

        Every occurrence of a token adds 1 + m to a document's weight and its h to the label's score beyond
        what the weight gives at the smoothed probability: idf - 1 and idf * (log p - log smoothed p).
        """
        rows = self.labels.collect()
        floor = 1e-9
        denom = [max(r.total + self.alpha * self.n_tokens, self.alpha * self.n_tokens) for r in rows]
        labels = [(r.label, math.log(r.prior), math.log(max(self.alpha / d, floor))) for r, d in zip(rows, denom)]
        p = lambda d, l: F.log(F.greatest((F.col("c") + self.alpha) / F.lit(float(d)), F.lit(floor))) - F.lit(l)
        gains = [F.sum(F.when(F.col("label") == r.label, p(d, l))).alias(f"h{i}") for i, (r, d, (_, _, l)) in enumerate(zip(rows, denom, labels))]
        words = self.counts.groupBy("token").agg(F.sum("c").alias("c"), *gains).na.fill(0.0).withColumn("m", F.lit(0.0))
        if self.idf is not None:
            words = words.join(self.idf.vocab.select("token", "idf"), "token", "left").withColumn("idf", F.coalesce("idf", F.lit(1.0)))
            words = words.withColumns({"m": F.col("idf") - 1, **{f"h{i}": F.col(f"h{i}") * F.col("idf") for i in range(len(rows))}}).drop("idf")
        return words, labels

    def _frequent(self, words: DataFrame) -> DataFrame:
        if not self._kept:
            self._kept.append(words.orderBy(F.desc("c"), "token").limit(BROADCAST_TOKENS).persist())
        return self._kept[0]

    def log_scores(self, docs: DataFrame) -> DataFrame:
        """(doc_id, label, score): ln prior plus the sum of log probabilities of every token occurrence.

        Tokens that a label never had count with the smoothed probability. The most frequent BROADCAST_TOKENS
        tokens are broadcast, so a document's tokens are summed where its text is read; only tokens
        beyond these, none of which is frequent, are counted and joined by shuffle. Documents without a
        token have the priors alone; rows that repeat a doc_id are one document.
        """
        words, labels = self._words()
        names = ["m", *(f"h{i}" for i in range(len(labels)))]
        n = F.size("__t")
        split = docs.select("doc_id", tokens(F.coalesce("text", F.lit(""))).alias("__t"))
        each = split.select("doc_id", n.cast("double").alias("n"), F.explode(F.concat("__t", F.array(F.lit(None).cast("string")))).alias("token"))
        head = words if self.n_tokens <= BROADCAST_TOKENS else self._frequent(words)
        near = each.join(F.broadcast(head.drop("c")), "token", "left").select("doc_id", F.when(F.col("token").isNull(), F.col("n")).alias("n"), *names)
        sums = near.groupBy("doc_id").agg(F.sum("n").alias("n"), *[F.sum(c).alias(c) for c in names])
        if head is not words:
            tail = words.join(F.broadcast(head.select("token")), "token", "left_anti")
            rare = each.where("token IS NOT NULL").join(F.broadcast(head.select("token")), "token", "left_anti").groupBy("doc_id", "token").agg(F.count("*").alias("k"))
            far = rare.join(tail, "token").groupBy("doc_id").agg(*[F.sum(F.col(c) * F.col("k")).alias(c) for c in names])
            sums = sums.unionByName(far.withColumn("n", F.lit(0.0))).groupBy("doc_id").agg(F.sum("n").alias("n"), *[F.sum(c).alias(c) for c in names])
        mass = F.col("n") + F.coalesce("m", F.lit(0.0))
        rows = [F.struct(F.lit(name).alias("label"), (F.lit(prior) + mass * F.lit(rest) + F.coalesce(f"h{i}", F.lit(0.0))).alias("score")) for i, (name, prior, rest) in enumerate(labels)]
        return sums.select("doc_id", F.explode(F.array(*rows)).alias("s")).select("doc_id", "s.label", "s.score")

    def scores(self, docs: DataFrame) -> DataFrame:
        return softmax(self.log_scores(docs), "doc_id")

    def explain(self, docs: DataFrame) -> DataFrame:
        """(doc_id, pos, token, contribution) of each token occurrence for the document's best label.

        Contributions are log probabilities without prior and IDF, whichever variant the model is.
        """
        best = self.log_scores(docs).groupBy("doc_id").agg(F.max_by("label", F.struct("score", F.expr("transform(split(label, ''), c -> -ascii(c))"))).alias("label"))
        each = docs.select("doc_id", F.posexplode(tokens(F.col("text"))).alias("pos", "token")).join(best, "doc_id")
        hit = each.join(self.counts, ["label", "token"], "left").join(F.broadcast(self.labels.select("label", "total")), "label")
        denom = F.greatest(F.col("total") + F.lit(self.alpha * self.n_tokens), F.lit(1e-6))
        return hit.select("doc_id", "label", "pos", "token", F.log((F.coalesce("c", F.lit(0)) + self.alpha) / denom).alias("contribution"))


def train_bayes(samples: DataFrame, nlp: str = "Count") -> BayesModel:
    """From (doc_id, text, label). Every token counts, stop words too; there is no frequency filter."""
    if nlp not in ("Count", "TfIdf"):
        warnings.warn(f"naive Bayes reads {nlp} as Count", stacklevel=2)
    each = samples.select("label", F.explode(tokens(F.col("text"))).alias("token"))
    counts = each.groupBy("label", "token").agg(F.count("*").alias("c")).persist()
    docs = samples.groupBy("label").agg(F.count("*").alias("docs")).collect()
    n = sum(r.docs for r in docs)
    if not n:
        raise EmptyTrainingSet("naive Bayes", "no sample")
    totals = {r.label: r.t for r in counts.groupBy("label").agg(F.sum("c").alias("t")).collect()}
    size = counts.agg(F.count_distinct("token")).first()[0]
    labels = samples.sparkSession.createDataFrame([(r.label, r.docs, r.docs / n, int(totals.get(r.label, 0))) for r in docs], "label string, docs bigint, prior double, total bigint")
    idf = fit_tfidf(samples) if nlp == "TfIdf" else None
    return BayesModel(labels, counts, max(1, size), idf)
