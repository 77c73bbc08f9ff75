"""Mixing documents to target token weights of domains that a classifier assigns softly.

1. A multinomial logistic regression on the presence of words, the most frequent of a bounded sample of the labelled rows, is fitted on that
   sample and gives every document posteriors over the domains.
2. Nonnegative document rates r_i are sought whose expected totals sum(r_i * tokens_i * posterior_i) match the targets. Projected
   gradient steps on the least squares of the totals start from rate 1 for all. Rates are measured per token, and the totals' errors by the
   inverse of sum(tokens_i * posterior_i * posterior_i'), so a step moves a rate by posterior_i * step: documents of one domain move alike
   whatever their length, and no more than needed. A domain that no document is most likely of is not served and left out: other
   domains' documents would be copied without end for their small posteriors of it. A step is one aggregation over documents to as many
   sums as there are domains; a task works its rows' rates out from the steps so far. Steps end when every served domain has its
   target or no longer comes nearer; ``totals`` gives what is reached beside the targets, ``rates`` logs what is missed.
3. ``resample`` gives each document floor(rate) copies and one more with the probability of the rest, drawn from a hash of its identifier.
   A document that most likely is of a domain whose target is no lower than its present total is never dropped by that draw.

Defined results: a null text counts as empty, has no tokens and keeps rate 1; a null identifier stays null; every row gives one row
(repeated rows have equal rates and draws); labels without a document, of null domain or of unknown documents are not used; without any
usable label, or with an empty table, posteriors are equal for all domains; a target that no rates reach is approached as far as nonnegative
rates do; a rate has no upper bound; extra columns are kept by ``resample`` and not read elsewhere.
"""

from __future__ import annotations

import logging
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.ml import Pipeline
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import CountVectorizer
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cohortspan.llm.common import NO_ID, given_id, materialize, numbered

#: Labelled rows that the classifier is fitted on at most, words that it knows at most, labelled rows that a word is in at least, and penalty.
TRAIN_ROWS, FEATURES, LEAST_ROWS, PENALTY = 20_000, 20_000, 5, 0.0005
#: Steps at most; the relative error of every domain's total at which they end.
STEPS, PRECISION = 60, 1e-4

_log = logging.getLogger(__name__)


def _words(table: DataFrame) -> DataFrame:
    words = F.filter(F.split(F.lower("_text"), r"[\x09-\x0D ]+"), lambda w: w != "")
    return table.withColumn("_words", words)


def fit(docs: DataFrame, labelled: DataFrame, domains: list[str], id_col: str = "doc_id", text_col: str = "text",
        train_rows: int = TRAIN_ROWS):
    """A classifier of the domains, or None without labels. ``labelled``: ``id_col`` and ``domain``.

    Rows beyond ``train_rows`` are left out by a hash of the identifier, whatever their order.
    """
    known = labelled.filter(F.col("domain").isin(domains)).select(F.col(f"`{id_col}`").cast("long").alias("_id"), "domain").distinct()
    count = known.count()
    if not count:
        return None
    if count > train_rows:
        known = known.filter(F.pmod(F.xxhash64("_id", F.lit(6)), F.lit(1 << 20)) < int(train_rows / count * (1 << 20)))
    at = F.array_position(F.array(*map(F.lit, domains)), F.col("domain")) - 1
    train = materialize(numbered(docs, id_col, text_col).join(known, "_id").select("_text", at.cast("double").alias("label")), "mixing-train")
    steps = [
        CountVectorizer(inputCol="_words", outputCol="_counts", vocabSize=FEATURES, minDF=LEAST_ROWS, binary=True),
        LogisticRegression(featuresCol="_counts", regParam=PENALTY, maxIter=40, family="multinomial", standardization=False),
    ]
    rows = _words(train)
    words = rows.select(F.explode(F.array_distinct("_words")).alias("w")).groupBy("w").count().filter(F.col("count") >= LEAST_ROWS)
    return Pipeline(stages=steps).fit(rows) if words.head(1) else None


def posteriors(docs: DataFrame, model, domains: list[str], id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: ``_id``, ``tokens`` (words) and ``p`` (posterior of each domain)."""
    rows = numbered(docs, id_col, text_col)
    if model is None:
        even = F.array(*[F.lit(1.0 / len(domains))] * len(domains))
        return _words(rows).select("_id", F.size("_words").cast("long").alias("tokens"), even.alias("p"))
    found = model.transform(_words(rows)).select("_id", F.size("_words").cast("long").alias("tokens"), vector_to_array("probability").alias("p"))
    short = len(domains) - model.stages[-1].numClasses  # domains after the last one that has labels
    return found.withColumn("p", F.concat("p", F.array(*[F.lit(0.0)] * short))) if short > 0 else found


def _rates(p: np.ndarray, steps: list[np.ndarray]) -> np.ndarray:
    """Rates of rows with these posteriors after the steps."""
    rate = np.ones(len(p))
    for step in steps:
        rate = np.maximum(rate + p @ step, 0.0)
    return rate


def _posteriors(batch: pa.RecordBatch, k: int) -> np.ndarray:
    return batch.column("p").flatten().to_numpy().reshape(-1, k)


def _missed(total: np.ndarray, target: np.ndarray, corpus: float, precision: float) -> np.ndarray:
    return np.abs(total - target) > precision * np.maximum(target, 1e-3 * corpus)


def fit_rates(weighted: DataFrame, targets: dict[str, float], steps: int = STEPS, precision: float = PRECISION) -> tuple[list[list[float]], dict[str, float], list[str]]:
    """The steps, the totals that they reach, and the domains whose targets are no lower than their totals at rate 1. ``weighted``: ``tokens`` and ``p`` in the order of ``targets``.

    Targets are shares of the corpus' tokens (they need not sum to 1).
    """
    k, names = len(targets), list(targets)
    schema = ", ".join(f"s{i} double" for i in range(2 * k + k * k))

    def sums(done: list[np.ndarray], first: bool) -> np.ndarray:
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            total, likeliest, square = np.zeros(k), np.zeros(k), np.zeros((k, k))
            for batch in batches:
                p, tokens = _posteriors(batch, k), batch.column("tokens").to_numpy()
                total += (_rates(p, done) * tokens) @ p
                if first:
                    likeliest += tokens @ (p >= p.max(axis=1, keepdims=True) - 1e-9)
                    square += (p * tokens[:, None]).T @ p
            yield pa.RecordBatch.from_arrays([pa.array([x]) for x in [*total, *likeliest, *square.ravel()]], names=[f"s{i}" for i in range(2 * k + k * k)])

        row = weighted.select("tokens", "p").mapInArrow(run, schema).agg(*[F.sum(f"s{i}") for i in range(2 * k + k * k)]).first()
        return np.array([x or 0.0 for x in row])

    start = sums([], True)
    total, served, gram = start[:k], np.flatnonzero(start[k : 2 * k] > 0), start[2 * k :].reshape(k, k)
    corpus = total.sum()
    target = np.array([targets[n] for n in names]) * corpus
    raised = [n for n, now, then in zip(names, total, target) if then >= now]
    if not corpus:
        return [], dict(zip(names, total.tolist())), raised
    weight = np.zeros((k, k))
    weight[np.ix_(served, served)] = np.linalg.pinv(gram[np.ix_(served, served)], rcond=1e-9, hermitian=True)
    done: list[np.ndarray] = []
    open_ = _missed(total, target, corpus, precision)[served]
    while len(done) < steps and open_.any():
        last = total
        done.append(weight @ (target - total))
        total = sums(done, False)[:k]
        # a domain's steps end when it has its target or no longer comes nearer, as with one that no rates can reach
        moves = np.abs(total - last) > 0.01 * np.abs(target - last)
        open_ = (_missed(total, target, corpus, precision) & moves)[served]
    return [s.tolist() for s in done], dict(zip(names, total.tolist())), raised


def totals(docs: DataFrame, labelled: DataFrame, targets: dict[str, float], id_col: str = "doc_id", text_col: str = "text") -> dict[str, tuple[float, float]]:
    """Per domain the target and the expected total that ``rates`` reaches, both as shares of the corpus' tokens."""
    domains = list(targets)
    weighted = materialize(posteriors(docs, fit(docs, labelled, domains, id_col, text_col), domains, id_col, text_col), "posteriors")
    corpus = weighted.agg(F.sum("tokens")).first()[0] or 1
    return {n: (targets[n], t / corpus) for n, t in fit_rates(weighted, targets)[1].items()}


def rates(docs: DataFrame, labelled: DataFrame, targets: dict[str, float], id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: identifier, ``tokens``, ``p`` (posteriors in the order of ``targets``), ``rate``, ``domain`` (the likeliest) and ``copies``."""
    domains = list(targets)
    weighted = materialize(posteriors(docs, fit(docs, labelled, domains, id_col, text_col), domains, id_col, text_col), "posteriors")
    steps, reached, raised = fit_rates(weighted, targets)
    corpus = weighted.agg(F.sum("tokens")).first()[0] or 0
    want = np.array(list(targets.values())) * corpus
    for n in np.flatnonzero(_missed(np.array(list(reached.values())), want, corpus, PRECISION)) if corpus else ():
        _log.warning("mixing: %s has %.5f of the tokens after %d steps, its target is %.5f", domains[n], reached[domains[n]] / corpus, len(steps), targets[domains[n]])
    k = len(domains)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(_rates(_posteriors(batch, k), list(map(np.array, steps))))], names=["_id", "tokens", "p", "rate"])

    found = weighted.mapInArrow(run, "_id long, tokens long, p array<double>, rate double")
    domain = F.element_at(F.array(*map(F.lit, domains)), F.array_position("p", F.array_max("p")).cast("int"))
    draw = F.pmod(F.xxhash64("_id", F.lit(17)), F.lit(1 << 30)) / F.lit(float(1 << 30))
    drawn = (F.floor("rate") + F.when(draw < F.col("rate") - F.floor("rate"), 1).otherwise(0)).cast("int")
    least = F.when(F.col("domain").isin(raised), 1).otherwise(0)
    return found.withColumn("domain", domain).select(given_id("_id").alias(id_col), "tokens", "p", "rate", "domain", F.greatest(drawn, least).alias("copies"))


def resample(docs: DataFrame, labelled: DataFrame, targets: dict[str, float], id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The input's rows and columns, each as often as its ``copies`` say. Rows that share an identifier are dropped or kept together."""
    found = rates(docs, labelled, targets, id_col, text_col)
    per_id = found.groupBy(F.coalesce(F.col(id_col), F.lit(NO_ID)).alias("_mix_id")).agg(F.max("copies").alias("_n"))
    mine = F.coalesce(F.col(f"`{id_col}`").cast("long"), F.lit(NO_ID))
    inner = docs.select(*[F.col(f"`{c}`").alias(f"_c{i}") for i, c in enumerate(docs.columns)], mine.alias("_mix_id"))
    repeated = inner.join(per_id.filter("_n > 0"), "_mix_id").withColumn("_k", F.explode(F.sequence(F.lit(1), F.col("_n"))))
    return repeated.select(*[F.col(f"_c{i}").alias(c) for i, c in enumerate(docs.columns)])


#: Domains of the ``labels`` table, and their shares of the tokens before mixing: what is clean gains what the others lose.
TARGETS = {"clean": 1.0, "low": 0.03, "toxic": 0.02}


def label_domains(labels: DataFrame) -> DataFrame:
    """``doc_id`` and ``domain`` from quality and toxic; rows without either have none."""
    domain = F.when(F.col("toxic") == 1, "toxic").when(F.col("quality") == 0, "low").when((F.col("quality") == 1) & (F.col("toxic") == 0), "clean")
    return labels.select("doc_id", domain.alias("domain")).filter("domain IS NOT NULL")
