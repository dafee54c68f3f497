"""Mixing sources to target weights with soft membership.

1. A naive Bayes classifier is learned from a labelled table: counts of ``MARKS`` (letters, letter pairs and
   signs that tell languages and junk apart) for each domain.
2. Every document gets a posterior over the domains. The evidence of a text is scaled to at most
   ``EVIDENCE`` marks, so that long texts keep soft memberships instead of certainty.
3. Nonnegative rates r are fitted to the documents so that the expected tokens of each domain,
   S = sum(r * tokens * posterior), meet the targets T: projected gradient steps on the least squares
   (S - T)' M^-1 (S - T) with M = sum(tokens * posterior posterior'). In the metric of the tokens this problem
   has gradient ``posterior . M^-1 (S - T)`` and Lipschitz constant 1, so full steps converge for any size.

Every step is one aggregate over all documents; only sums by domain come to the driver. The rate of a document
follows from its own posterior and the steps taken, so nothing is joined and no key is shuffled: a hot source
does not matter. DataFrame functions only.

Cases: a null or blank text has no tokens, prior posteriors and no say in the totals; a null doc_id is kept; rows
of the labelled table with a null id or domain are left out, and so are domains without a target; repeated rows
each get the same rate; columns other than those in ``keep`` are ignored; an empty table gives an empty result. A
domain without any labelled row has flat counts. Targets that the documents cannot meet are met as nearly as
the least squares allow.
"""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fairload.llm.common import written

# What is counted in a text.
MARKS = (
    "a", "e", "i", "o", "u", "h", "w", "q", "é", "è", "ê", "ç", "ü", "ö", "ä", "ß", "ñ", "ó", "í",
    "th", "ch", "ge", "qu", "ci", "TH", "EN", "#", "%", "&", "$", "*", "|", "!", ".", " ",
)

MAX_ROWS = 20_000  # labelled rows used for fitting
EVIDENCE = 8.0
TOLERANCE = 1e-7
MAX_STEPS = 60
STEPS_IN_A_ROW = 10  # steps kept in one expression before the rates are written


def _counts(text: Column) -> list[Column]:
    size = F.octet_length(text)
    return [(size - F.octet_length(F.replace(text, F.lit(m)))) / len(m.encode("utf-8")) for m in MARKS]


def _tokens(text: Column) -> Column:
    """Number of words; plain replacing and splitting, as translate and patterns look at every character by itself."""
    for blank in "\t\n\r\x0b\x0c":
        text = F.replace(text, F.lit(blank), F.lit(" "))
    return F.size(F.array_remove(F.split(text, " "), "")).cast("double")


def learn(docs: DataFrame, labelled: DataFrame, domains: list[str]) -> tuple[list[float], list[list[float]]]:
    """Log priors and, by domain, log shares of the marks; ``labelled`` has doc_id and domain."""
    usable = (
        labelled.where(F.col("doc_id").isNotNull() & F.col("domain").isin(domains))
        .groupBy("doc_id")
        .agg(F.min("domain").alias("domain"))
        .orderBy(F.xxhash64("doc_id"), "doc_id")
        .limit(MAX_ROWS)
    )
    texts = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    seen = texts.join(F.broadcast(usable), "doc_id")  # MAX_ROWS bounds it
    counted = seen.select("domain", *(c.alias(f"m{k}") for k, c in enumerate(_counts(F.col("text")))))
    sums = counted.groupBy("domain").agg(F.count("*").alias("n"), *(F.sum(f"m{k}").alias(f"m{k}") for k in range(len(MARKS))))
    by_domain = {r["domain"]: r for r in sums.collect()}  # a row a domain
    priors, shares = [], []
    total = sum(r["n"] for r in by_domain.values()) + len(domains)
    for d in domains:
        row = by_domain.get(d)
        priors.append(math.log(((row["n"] if row else 0) + 1) / total))
        marks = [(row[f"m{k}"] if row else 0.0) + 1.0 for k in range(len(MARKS))]
        shares.append([math.log(m / sum(marks)) for m in marks])
    return priors, shares


def posteriors(docs: DataFrame, priors: list[float], shares: list[list[float]], keep: list[str]) -> DataFrame:
    """``keep`` columns as struct ``d``, with tokens and the posterior ``p0 .. pK`` of each document."""
    text = F.coalesce(F.col("text"), F.lit(""))
    tokens = _tokens(text)
    counted = docs.select(
        F.struct(*keep).alias("d"), tokens.alias("tokens"), *(c.alias(f"m{k}") for k, c in enumerate(_counts(text)))
    )
    sums = lambda cs: sum(cs[1:], cs[0])
    marks = [F.col(f"m{k}") for k in range(len(MARKS))]
    scale = F.lit(EVIDENCE) / F.greatest(F.lit(EVIDENCE), sums(marks))
    scored = counted.select(
        "d",
        "tokens",
        *(
            (F.lit(prior) + scale * sums([m * s for m, s in zip(marks, share)])).alias(f"l{k}")
            for k, (prior, share) in enumerate(zip(priors, shares))
        ),
    )
    logs = [F.col(f"l{k}") for k in range(len(priors))]
    top = F.greatest(*logs) if len(logs) > 1 else logs[0]
    odds = scored.select("d", "tokens", *(F.exp(x - top).alias(f"e{k}") for k, x in enumerate(logs)))
    total = sums([F.col(f"e{k}") for k in range(len(priors))])
    return odds.select("d", "tokens", *((F.col(f"e{k}") / total).alias(f"p{k}") for k in range(len(priors))))


def _stepped(rate: Column, steps: list[np.ndarray], width: int) -> Column:
    """The rate after steps of ``max(0, rate + posterior . step)``."""
    for step in steps:
        move = sum((F.col(f"p{k}") * float(step[k]) for k in range(1, width)), F.col("p0") * float(step[0]))
        rate = F.greatest(F.lit(0.0), rate + move)
    return rate


def fit_rates(members: DataFrame, weights: list[float]) -> DataFrame:
    """``members`` (tokens, p0 .. pK, rate) with the fitted ``rate``."""
    width = len(weights)
    p = [F.col(f"p{k}") for k in range(width)]
    square = [
        F.sum(F.col("tokens") * p[a] * p[b]).alias(f"s{a}_{b}") for a in range(width) for b in range(width)
    ]
    first = members.agg(F.sum("tokens").alias("total"), *square).first()
    total = float(first["total"] or 0.0)
    if total == 0:
        return members
    m = np.array([[first[f"s{a}_{b}"] for b in range(width)] for a in range(width)]) / total
    inverse = np.linalg.inv(m + np.eye(width) * 1e-9)
    target = np.array(weights) / sum(weights)
    steps: list[np.ndarray] = []
    for _ in range(MAX_STEPS):
        rate = _stepped(F.col("rate"), steps, width)
        sums = members.select("tokens", *p, rate.alias("rate")).agg(
            *(F.sum(F.col("rate") * F.col("tokens") * x).alias(f"s{k}") for k, x in enumerate(p))
        )
        found = np.array(sums.first()) / total
        if np.abs(found - target).sum() < TOLERANCE:
            break
        steps.append(inverse @ (target - found))
        if len(steps) == STEPS_IN_A_ROW:
            members = written(members.withColumn("rate", _stepped(F.col("rate"), steps, width)), "mix-rates")
            steps = []
    return members.withColumn("rate", _stepped(F.col("rate"), steps, width))


def mix(docs: DataFrame, labelled: DataFrame, targets: dict[str, float], keep: list[str]) -> DataFrame:
    """``keep`` columns, tokens, likeliest domain, posteriors, rate, and whole copies drawn by a hash.

    ``copies`` is the rate rounded up or down, up with the chance of its fraction, so totals keep their mean.
    """
    domains = sorted(targets)
    priors, shares = learn(docs, labelled, domains)
    members = posteriors(docs, priors, shares, keep).withColumn("rate", F.lit(1.0))
    fitted = fit_rates(written(members, "mix"), [targets[d] for d in domains])
    p = [F.col(f"p{k}") for k in range(len(domains))]
    likeliest = F.array_max(F.array(*(F.struct(x.alias("p"), F.lit(d).alias("d")) for x, d in zip(p, domains))))["d"]
    chance = F.pmod(F.xxhash64("d"), F.lit(1 << 20)) / float(1 << 20)
    up = (chance < F.col("rate") - F.floor("rate")).cast("long")
    return fitted.select(
        *(F.col(f"d.`{c}`") for c in keep),
        F.col("tokens").cast("long").alias("tokens"),
        likeliest.alias("domain"),
        *(x.alias(f"p_{d}") for x, d in zip(p, domains)),
        "rate",
        (F.floor("rate") + up).cast("long").alias("copies"),
    )


def text_domains(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """Labelled table of text domains: the language of a good text, ``junk`` for any other."""
    judged = labels.where(F.col("doc_id").isNotNull() & F.col("quality").isNotNull())
    judged = judged.groupBy("doc_id").agg(F.avg("quality").alias("quality"))
    domain = F.when(F.col("quality") < 0.5, F.lit("junk")).otherwise(F.col("lang"))
    return docs.select("doc_id", "lang").join(judged, "doc_id").select("doc_id", domain.alias("domain"))
