"""URL filter: rules first, then two character Markov models.

Pages that a rule accepts or rejects teach two models of variable order, one per class.
The probability of a character is that of its longest known context, smoothed step by step
with shorter ones.  A URL that no rule covers is accepted if its log-likelihood under the
accepted model minus that under the rejected model, per character, reaches a threshold that
is calibrated on labelled URLs kept out of the models.  Both halves are all such URLs of the
input, copies counted once, so what the models gather grows with it.

Contexts are hashed into a fixed number of buckets, so a model is two arrays of constant
length, whatever the input: it fits in an expression and scoring is a projection without
join or shuffle.  Only DataFrame functions are used.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from ledgerloom.llm.common import ascii_lower, staged

# Fixed values: (host, start of the path, verdict)
RULES = (
    ("com", "/", "allow"),
    ("example.com", "/en/", "block"),
    ("www.example.com", "/en/", "allow"),
    ("net", "/es/", "block"),
    ("net", "/fr/", "block"),
)
ORDER = 4
BUCKETS = 2**15
SMOOTHING = 2.0
ALPHABET = 256.0
BIN = 0.005
SPAN = 1000  # score bins on each side of 0


def host_of(url: Column) -> Column:
    """What follows the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z lower-cased."""
    return ascii_lower(F.regexp_extract(_after_scheme(url), r"^([^/?#]*)", 1))


def path_of(url: Column) -> Column:
    """What follows the host up to ``?``, ``#`` or the end."""
    return F.regexp_extract(_after_scheme(url), r"^[^/?#]*([^?#]*)", 1)


def _after_scheme(url: Column) -> Column:
    at = F.locate("://", url)
    return F.coalesce(F.when(at > 0, F.substr(url, at + 3)), F.lit(""))


def matched_rule(host: Column, path: Column, rules: Sequence[tuple[str, str, str]], value: Column | None = None):
    """(rule text, verdict) of the longest fitting rule; null where none fits.  A rule fits
    its host and all its subdomains if the path starts with the rule's path.  The list
    is part of the expression, so it is meant for hundreds of rules, not millions."""
    text = verdict = F.lit(None).cast("string")
    for rule_host, rule_path, says in sorted(rules, key=lambda r: len(r[0] + r[1])):
        fits = ((host == rule_host) | host.endswith("." + rule_host)) & path.startswith(rule_path)
        text = F.when(fits, F.lit(rule_host + rule_path)).otherwise(text)
        verdict = F.when(fits, F.lit(says)).otherwise(verdict)
    return text, verdict


def judged(
    pages: DataFrame,
    page_id: str = "page_id",
    url: str = "url",
    rules: Sequence[tuple[str, str, str]] = RULES,
) -> DataFrame:
    """Verdict on every page's URL: page_id, host, path, rule, verdict, score.

    The models count all different URLs that a rule accepts or rejects and whose hash is even;
    those with an odd hash calibrate the threshold.  ``score`` is the difference per character
    minus the threshold.  A null or empty URL, or one without ``://``, has empty host and path
    and no rule; null and empty ones have no score and are blocked, since nothing can be
    fetched there.  If a class has no labelled URL, the models say nothing and URLs without
    rule are allowed.  Repeated rows are judged alike; no rows give no rows.
    """
    host, path = host_of(F.col("url")), path_of(F.col("url"))
    base = pages.select(F.col(f"`{page_id}`").alias("page_id"), F.col(f"`{url}`").alias("url"))
    base = base.withColumn("host", host).withColumn("path", path)
    rule, verdict = matched_rule(F.col("host"), F.col("path"), rules)
    base = base.withColumn("rule", rule).withColumn("by_rule", verdict)

    marked = base.where(F.col("by_rule").isNotNull()).select(
        "url", (F.col("by_rule") == "allow").alias("good"), F.xxhash64("url", F.lit(8)).alias("draw")
    )
    # different URLs, so that copies of one can't outweigh the others
    labelled = staged(marked.distinct(), "url-labelled")
    learn, check = labelled.where(F.col("draw") % 2 == 0), labelled.where(F.col("draw") % 2 != 0)
    model = _counts(learn)
    threshold = _threshold(check.select("good", _difference(F.col("url"), model).alias("raw")))
    empty = F.coalesce(F.col("url"), F.lit("")) == ""
    score = F.lit(None).cast("double") if threshold is None else _difference(F.col("url"), model) - F.lit(threshold)
    by_model = F.when(empty, "block").when(F.coalesce(F.col("score"), F.lit(0.0)) >= 0, "allow").otherwise("block")
    return (
        base.withColumn("score", F.when(empty | F.col("rule").isNotNull(), None).otherwise(score))
        .withColumn("verdict", F.coalesce("by_rule", by_model))
        .select("page_id", "host", "path", "rule", "verdict", "score")
    )


def _grams(url: Column) -> Column:
    """For each character of the padded URL the buckets of the strings of length 1 to ORDER
    that end there (null where the string would start before the padding)."""
    pad = F.array_repeat(F.lit("^"), ORDER - 1)
    # The padded characters are bound once through a one-element array.
    chars = F.array(F.concat(pad, F.split(F.coalesce(url, F.lit("")), "")))
    bucket = lambda c, at, n: F.pmod(
        F.xxhash64(*[F.get(c, at - k) for k in reversed(range(n))]), F.lit(BUCKETS)
    ).cast("int")
    each = lambda c: F.transform(
        c, lambda _, at: F.array(*[F.when(at >= n - 1, bucket(c, at, n)) for n in range(1, ORDER + 1)])
    )
    return F.get(F.transform(chars, each), 0)


def _counts(learn: DataFrame) -> list[list[int]]:
    """The two models, accepted and rejected: BUCKETS counts each."""
    rows = (
        learn.select("good", F.explode(F.flatten(_grams(F.col("url")))).alias("bucket"))
        .where(F.col("bucket").isNotNull())
        .groupBy("bucket")
        .agg(F.count_if("good").alias("good"), F.count_if(~F.col("good")).alias("bad"))
        .collect()  # at most BUCKETS rows
    )
    good, bad = [0] * BUCKETS, [0] * BUCKETS
    for row in rows:
        good[row["bucket"]], bad[row["bucket"]] = row["good"], row["bad"]
    return [good, bad]


def _difference(url: Column, model: list[list[int]]) -> Column:
    """Log-likelihood per character, accepted minus rejected."""
    total = [F.lit(sum(counts) / ORDER) for counts in model]
    # The models are constants, folded into arrays once per plan and bound once per row.
    known = [F.split(F.lit(",".join(map(str, counts))), ",").cast("array<double>") for counts in model]
    models = F.array(F.struct(known[0].alias("m0"), known[1].alias("m1")))

    def log_p(grams, at, counts, total):
        here, before = F.get(grams, at), F.get(grams, at - 1)
        p = F.lit(1 / ALPHABET)
        for n in range(1, ORDER + 1):
            seen = total if n == 1 else F.get(counts, F.get(before, n - 2))
            p = (F.get(counts, F.get(here, n - 1)) + SMOOTHING * p) / (seen + SMOOTHING)
        return F.log(p)

    def per_char(grams, m):
        parts = F.transform(
            F.sequence(F.lit(ORDER - 1), F.size(grams) - 1),
            lambda at: log_p(grams, at, m["m0"], total[0]) - log_p(grams, at, m["m1"], total[1]),
        )
        return F.aggregate(parts, F.lit(0.0), lambda a, x: a + x) / F.size(parts)

    def with_model(m):
        bound = F.array(_grams(url))
        return F.get(F.transform(bound, lambda g: F.when(F.size(g) >= ORDER, per_char(g, m))), 0)

    return F.get(F.transform(models, with_model), 0)


def _threshold(scored: DataFrame) -> float | None:
    """The cut with the best sum of both classes' hit rates, from at most 2 * SPAN + 1 bins;
    null if a class is missing."""
    bin_ = F.greatest(F.lit(-SPAN), F.least(F.lit(SPAN), F.floor(F.col("raw") / BIN)))
    rows = (
        scored.groupBy(bin_.cast("int").alias("bin"))
        .agg(F.count_if("good").alias("good"), F.count_if(~F.col("good")).alias("bad"))
        .orderBy("bin")
        .collect()
    )
    good, bad = sum(r["good"] for r in rows), sum(r["bad"] for r in rows)
    if not good or not bad:
        return None
    best, cut, below_good, below_bad = -1.0, 0.0, 0, 0
    for row in rows:
        gain = (good - below_good) / good + below_bad / bad
        if gain > best:
            best, cut = gain, row["bin"] * BIN
        below_good, below_bad = below_good + row["good"], below_bad + row["bad"]
    return cut
