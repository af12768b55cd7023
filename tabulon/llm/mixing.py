"""Soft-membership mixing of a corpus to target weights, in DataFrame operations only.

A naive Bayes classifier learned from a labelled table gives each document a probability
per domain, from a few statistics of its whole text. Projected gradient descent then fits
a rate >= 0 per document so that the expected tokens per domain, sum of tokens * p * rate,
match the targets; each step is one aggregation that returns one number per domain. If no
document may repeat, every rate is kept at 1 or less, in the fit and in the mix.
"""

from __future__ import annotations

import math
import warnings
from dataclasses import dataclass, replace

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tabulon.session import materialise

BINS = 16
#: Steps of the fit at most, and the largest relative miss of a domain's total to stop at.
STEPS = 60
TOLERANCE = 1e-4
#: Without repeats: if no domain's total moves more in a step, the targets are out of reach.
STALLED = TOLERANCE / 10
FEATURES = ("words", "word_length", "capitals", "marks", "distinct", "lines", "beyond_ascii", "doubled")


def token_count(text: Column) -> Column:
    """Runs without white space; null texts have none."""
    return F.regexp_count(F.coalesce(text, F.lit("")), F.lit("\\S+")).cast("long")


def _share(part: Column, whole: Column) -> Column:
    """Bin of a share, finer near 0."""
    return F.least(F.floor(F.sqrt(F.least(part / F.greatest(whole, F.lit(1)), F.lit(1.0))) * BINS), F.lit(BINS - 1)).cast("int")


def _log(size: Column) -> Column:
    return F.least(F.floor(F.log2(size + F.lit(1))), F.lit(BINS - 1)).cast("int")


def with_features(docs: DataFrame, text_col: str) -> DataFrame:
    """``docs`` with __tokens and one bin per feature, from the whole text."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    docs = docs.withColumn("__split", F.split(text, " "))
    words = F.size("__split")
    doubled = F.regexp_count(text, F.lit("(\\S+)\\x20\\1(?=\\s)"))
    lines = F.char_length(text) - F.char_length(F.replace(text, F.lit("\n"), F.lit("")))
    bins = {
        "words": _log(words), "word_length": F.least(F.floor(F.char_length(text) / words), F.lit(BINS - 1)).cast("int"),
        "capitals": _share(F.regexp_count(text, F.lit("[A-Z]")), F.char_length(text)),
        "marks": _share(F.regexp_count(text, F.lit("[!-/:-@\\[-`{-~]")), F.char_length(text)),
        "distinct": _share(F.size(F.array_distinct("__split")), words), "lines": _share(lines, words),
        "beyond_ascii": _share(F.octet_length(text) - F.char_length(text), F.char_length(text)), "doubled": _share(doubled, words),
    }
    docs = docs.withColumns({"__tokens": token_count(text), **{f"__{name}": bins[name] for name in FEATURES}})
    return docs.drop("__split")


@dataclass(frozen=True)
class MixingModel:
    """Log probabilities (domain, feature, bin), priors, and the steps of the fitted rates."""

    domains: list[str]
    priors: list[float]
    tables: dict[str, list[list[float]]]  # feature: per domain, per bin
    steps: tuple[tuple[float, ...], ...] = ()
    most: float | None = None  # the largest rate; None: any
    miss: float = 0.0  # largest miss of a domain's target, as a share of the domain's tokens

    def posteriors(self, docs: DataFrame) -> DataFrame:
        """Adds __p0, __p1, ... to rows with features."""
        scores = {}
        for k in range(len(self.domains)):
            score = F.lit(self.priors[k])
            for name in FEATURES:
                table = F.array(*[F.lit(x) for x in self.tables[name][k]])
                score = score + F.element_at(table, F.col(f"__{name}") + 1)
            scores[f"__s{k}"] = score
        docs = docs.withColumns(scores).withColumn("__top", F.greatest(*scores) if len(scores) > 1 else F.col("__s0"))
        docs = docs.withColumns({f"__e{k}": F.exp(F.col(f"__s{k}") - F.col("__top")) for k in range(len(scores))})
        whole = sum((F.col(f"__e{k}") for k in range(1, len(scores))), F.col("__e0"))
        docs = docs.withColumns({f"__p{k}": F.col(f"__e{k}") / whole for k in range(len(scores))})
        return docs.drop("__top", *scores, *[f"__e{k}" for k in range(len(scores))])

    def rate(self, start: Column | None = None, steps=None) -> Column:
        """The rate after the fitted steps, from 1; each step is followed by the projection to [0, ``most``]."""
        start = F.lit(1.0) if start is None else start
        steps = self.steps if steps is None else steps
        if not steps:
            return start
        table = F.array(*[F.array(*[F.lit(e) for e in step]) for step in steps])

        def move(rate, step):
            along = sum((F.col(f"__p{k}") * step[k] for k in range(1, len(self.domains))), F.col("__p0") * step[0])
            moved = F.greatest(rate - along, F.lit(0.0))
            return moved if self.most is None else F.least(moved, F.lit(self.most))

        return F.aggregate(table, start, move)


def learn_domains(features: DataFrame, labelled: DataFrame, domains: list[str], id_col: str = "doc_id") -> MixingModel:
    """Naive Bayes with add-one counts from ``labelled`` (id, domain); other domains are ignored.

    ``features`` is the narrow table of all documents. Domains should be few: the driver
    gets one count per domain, feature and bin.
    """
    labels = labelled.where(F.col("domain").isin(domains)).select(F.col(id_col).alias("__id"), "domain").distinct()
    rows = features.join(labels, features[id_col] == labels["__id"])
    pairs = F.explode(F.array(*[F.struct(F.lit(n).alias("feature"), F.col(f"__{n}").alias("bin")) for n in FEATURES]))
    counts = rows.select("domain", pairs.alias("x")).groupBy("domain", "x.feature", "x.bin").count().collect()
    tables = {n: [[1.0] * BINS for _ in domains] for n in FEATURES}
    total = [0] * len(domains)
    for domain, feature, place, n in counts:
        tables[feature][domains.index(domain)][place] += n
        total[domains.index(domain)] += n if feature == FEATURES[0] else 0
    logs = {n: [[math.log(x / sum(row)) for x in row] for row in table] for n, table in tables.items()}
    priors = [math.log((t + 1) / (sum(total) + len(domains))) for t in total]
    return MixingModel(domains, priors, logs)


def fit_rates(members: DataFrame, model: MixingModel, weights: list[float], repeat: bool, relative: bool) -> MixingModel:
    """Steps of projected gradient descent on the weighted least squares of the domain totals.

    ``members`` holds __tokens and __p0, ...; the targets are ``weights`` of a budget: all
    tokens if documents may repeat. Else no rate exceeds 1, and the budget begins at the most
    for which no domain needs repeats; documents with a share in several domains may keep
    that out of reach, so it is lowered to what the shortest domain gets until all fit. The
    step is measured per token, so its largest curvature is 1 and a step of 1 is safe. A fit
    that has not met its targets after STEPS steps is returned with its ``miss`` and a warning.
    """
    count = range(len(weights))
    if not repeat:
        model = replace(model, most=1.0)
    sums = lambda df, rate: [x or 0.0 for x in df.agg(*[F.sum(F.col("__tokens") * F.col(f"__p{k}") * rate) for k in count]).first()]
    natural = sums(members, F.lit(1.0))
    held = [k for k in count if natural[k] > 0]
    if not held:
        return model
    if relative:
        weights = [w * n for w, n in zip(weights, natural)]
    weights = [w / sum(weights) for w in weights]
    budget = sum(natural) if repeat else min(natural[k] / weights[k] for k in held if weights[k] > 0)
    targets = [w * budget for w in weights]
    steps: list[tuple[float, ...]] = []
    table, done = members.withColumn("__rate", F.lit(1.0)), 0
    before: list[float] = []
    largest = 0.0
    # The last round takes no step; it measures what the one before has reached.
    for tried in range(STEPS + 1):
        totals = sums(table, model.rate(F.col("__rate"), steps[done:]))
        if not repeat and before and max(abs(totals[k] - before[k]) / natural[k] for k in held) < STALLED:
            reached = min(totals[k] / targets[k] for k in held if targets[k] > 0)
            targets = [t * reached if 0 < reached < 1 else t for t in targets]
        before = totals
        miss = [(totals[k] - targets[k]) / natural[k] if k in held else 0.0 for k in count]
        largest = max(abs(m) for m in miss)
        if largest < TOLERANCE:
            break
        if tried == STEPS:
            warnings.warn(f"mixing: a domain misses its target by {largest:.2%} of its tokens after {STEPS} steps", stacklevel=2)
            break
        steps.append(tuple(miss))
        if len(steps) - done == 12:
            table, done = materialise(table.withColumn("__rate", model.rate(F.col("__rate"), steps[done:]))), len(steps)
    return replace(model, steps=tuple(steps), miss=largest)


def fit_mixing(
    docs: DataFrame, labelled: DataFrame, weights: dict[str, float], id_col: str = "doc_id", text_col: str = "text",
    repeat: bool = True, relative: bool = False,
) -> tuple[MixingModel, DataFrame]:
    """(model, members): the classifier with its rates, and one checkpointed row per document.

    ``weights`` are the domains and their shares of the expected tokens, all above 0; with
    ``relative`` they multiply the shares that the domains have. Null
    and empty texts have no tokens; they get a rate but move nothing. Without labelled rows
    every domain is equally likely; without documents all rates are 1.
    """
    domains = sorted(weights)
    features = materialise(with_features(docs.select(id_col, text_col), text_col).drop(text_col))
    model = learn_domains(features, labelled, domains, id_col)
    members = materialise(model.posteriors(features).select(id_col, "__tokens", *[f"__p{k}" for k in range(len(domains))]))
    return fit_rates(members, model, [weights[d] for d in domains], repeat, relative), members


def mixing_rates(
    docs: DataFrame, labelled: DataFrame, weights: dict[str, float], id_col: str = "doc_id", text_col: str = "text", repeat: bool = True
) -> DataFrame:
    """(doc_id, tokens, domain, membership, rate) of every row; ``domain`` is the likeliest one."""
    model, members = fit_mixing(docs, labelled, weights, id_col, text_col, repeat)
    best = F.greatest(*[F.struct(F.col(f"__p{k}").alias("p"), F.lit(-k).alias("k"), F.lit(d).alias("domain")) for k, d in enumerate(model.domains)]) if len(model.domains) > 1 else F.struct(F.col("__p0").alias("p"), F.lit(model.domains[0]).alias("domain"))
    return members.select(
        F.col(id_col).alias("doc_id"), F.col("__tokens").alias("tokens"), best["domain"].alias("domain"),
        best["p"].alias("membership"), *[F.col(f"__p{k}").alias(f"p_{d}") for k, d in enumerate(model.domains)],
        model.rate().alias("rate"),
    )


def mix(docs: DataFrame, model: MixingModel, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The mixed corpus: each row as often as its rate says; the fraction is drawn by a hash of the id.

    One pass over the texts; nothing is shuffled.
    """
    rows = model.posteriors(with_features(docs, text_col)).withColumn("__rate", model.rate())
    draw = F.pmod(F.xxhash64(id_col, F.lit("mixing")), F.lit(1 << 30)) / float(1 << 30)
    # The row number adds nothing; it keeps the filter below from being computed out of the texts anew.
    draw = draw + F.monotonically_increasing_id() * 0.0
    rows = rows.withColumn("__copies", F.floor(F.col("__rate") + draw).cast("int")).where("__copies > 0")
    rows = rows.withColumn("__copy", F.explode(F.sequence(F.lit(1), F.col("__copies"))))
    return rows.select(*[F.col(f"`{c}`") for c in docs.columns])
