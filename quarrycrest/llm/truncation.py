"""Values that lost their end: field limits and broken transfers.

Two kinds of evidence are added up as log odds.

Length: of each (source, field) the histogram of lengths is taken over all values.
Lengths that stand out of their neighbourhood are candidate limits.  A log-normal
length distribution is fitted by maximum likelihood with the values at candidate
limits as right-censored (EM: expected logarithms of the censored lengths, then the
closed form), and the posterior of censoring at a limit is the share of the values
there that the distribution doesn't explain.

Ending: traces (dots, half an entity or tag), a closing mark, or neither.  In the last
case the sentence is compared with the corpus: how many words sentences with the same
opening have, and whether the last word occurs as a whole word elsewhere.  What each
ending is worth is fitted: what stands at limits beyond what stands beside them shows how
cut values end, the other values how whole ones do.  So where a source cuts behind full
stops, a closed value right at its limit counts as cut, and elsewhere it does not.

Null, blank and stand-in values are not looked at.  Null sources are one source.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarrycrest.llm.common import BLANK, checkpoint

#: What stands in for a missing value, lower case, without blanks at the ends.
STAND_INS = ["-", "--", "---", "?", "??", ".", "..", "n/a", "na", "n.a.", "nil", "nan", "none", "null", "tba", "tbd", "tbc", "unknown", "to be announced", "to be determined", "to be confirmed", "not available", "not applicable"]
FIELDS = ("description", "notes", "restrictions")
#: A length stands out if it has this many values and this many times its neighbours' mean.
LEAST, TIMES, NEAR = 4, 4.0, 25
#: and it is a limit if at least this share of its values has a broken end.
LIMIT_BREAKS = 0.3
SAME_IN_FEEDS = 3
#: What the fit of the endings starts from: the share of cut values away from limits, the
#: log odds that each ending adds and how whole values end; and what that counts for, in values.
SHARE = 0.02
ENDINGS = {"trace": 9.0, "closed": -7.0, "broken": 6.0, "entire": -3.0}
WHOLE = (1e-4, 0.9, 1e-3, 0.1)
PRIOR_VALUES, ROUNDS, DEVIATIONS = 10.0, 50, 3.0
TRACES = r"(?:\.\.\.|…|�|&#?\w{0,7}|<[a-zA-Z/]?\w{0,7})\s*\z"
CLOSERS = r"[.!?。！？)\]\"'”’]\s*\z"


def bare(value: Column) -> Column:
    return F.regexp_replace(value, rf"^{BLANK}+|{BLANK}+\z", "")


def is_real(value: Column) -> Column:
    """Neither null nor blank nor a stand-in."""
    plain = F.lower(bare(F.coalesce(value, F.lit(""))))
    return (plain != "") & ~plain.isin(*STAND_INS)


def endings_fitted(at: np.ndarray, beside: np.ndarray, away: np.ndarray) -> tuple[float, np.ndarray]:
    """(prior log odds away from limits, log odds of each ending).

    at: values at limits by ending; beside: what the lengths around them have on average,
    and DEVIATIONS standard deviations more; away: all others.  What stands at limits beyond what stands beside them shows how cut
    values end; the share of cut values away from limits and how whole values end follow
    by EM from the others."""
    start = np.array(list(ENDINGS.values()))
    whole = np.array(WHOLE) / sum(WHOLE)
    cut = whole * np.exp(start)
    cut = PRIOR_VALUES * cut / cut.sum() + np.maximum(at - beside, 0)
    cut /= cut.sum()
    pseudo, share = PRIOR_VALUES * whole, SHARE
    for _ in range(ROUNDS):
        r = share * cut / (share * cut + (1 - share) * whole) * away
        whole = pseudo + away - r
        whole /= whole.sum()
        share = (r.sum() + PRIOR_VALUES * SHARE) / (away.sum() + PRIOR_VALUES)
    return math.log(share / (1 - share)), np.log(cut) - np.log(whole)


def _endings(out: DataFrame) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(at, beside, away) of rows (feed, field, n, ending, posterior): four numbers each.

    The lengths of a source that lie around its limits are met by a join on (feed,
    field) of histograms, which have one row a length and ending."""
    histogram = out.groupBy("feed", "field", "n", "ending").agg(F.count("*").alias("c"), F.max("posterior").alias("posterior"))
    spots = histogram.where("posterior > 0").select("feed", "field", F.col("n").alias("spot")).distinct()
    near = histogram.where("posterior = 0").join(spots, ["feed", "field"]).where(F.abs(F.col("n") - F.col("spot")) <= NEAR)
    lengths = 2 * NEAR - 4  # around a limit, which takes about three itself
    each = near.groupBy("feed", "field", "spot", "ending").agg((F.sum("c") / lengths).alias("mean"), (F.sum(F.col("c") * F.col("c")) / lengths).alias("square"))
    beside = each.groupBy("ending").agg(F.sum("mean").alias("beside"), F.sum(F.col("square") - F.col("mean") * F.col("mean")).alias("spread"))
    counts = histogram.groupBy("ending").agg(F.sum(F.when(F.col("posterior") > 0, F.col("c")).otherwise(0)).alias("at"), F.sum(F.when(F.col("posterior") > 0, 0).otherwise(F.col("c"))).alias("away"))
    rows = {r.ending: r for r in counts.join(beside, "ending", "left").collect()}
    at, beside, spread, away = (np.array([float(getattr(rows[e], c) or 0) if e in rows else 0.0 for e in ENDINGS]) for c in ("at", "beside", "spread", "away"))
    # a handful of values proves nothing where there are none beside
    return at, beside + DEVIATIONS * np.sqrt(spread + PRIOR_VALUES), away


def long_form(df: DataFrame, fields=FIELDS, key: str = "rec_id", source: str = "feed") -> DataFrame:
    """(rec_id, feed, field, value, n) of real values; n is the length as it stands."""
    entries = F.explode(F.array(*(F.struct(F.lit(f).alias("field"), F.col(f).alias("value")) for f in fields))).alias("e")
    rows = df.select(F.col(key).cast("bigint").alias("rec_id"), F.coalesce(F.col(source).cast("string"), F.lit("")).alias("feed"), entries)
    rows = rows.select("rec_id", "feed", "e.field", "e.value").where(is_real(F.col("value")))
    return rows.withColumn("n", F.length("value"))


def _cdf(x: np.ndarray) -> np.ndarray:
    return np.array([0.5 * math.erfc(-v / math.sqrt(2)) for v in np.ravel(x)]).reshape(np.shape(x))


def censoring(lengths: np.ndarray, counts: np.ndarray, rounds: int = 25) -> np.ndarray:
    """Posterior of each length's values being cut at that length."""
    order = np.argsort(lengths)
    n, c = lengths[order].astype(float), counts[order].astype(float)
    local = np.empty(len(n))
    for i in range(len(n)):
        near = (np.abs(n - n[i]) <= NEAR) & (np.abs(n - n[i]) > 1)
        # a spike beside this one says nothing about the neighbourhood
        local[i] = min(c[near].sum() / (2 * NEAR - 1), np.median(c[near]) * near.sum() / (2 * NEAR - 1) * 2) if near.any() else 0.0
    spike = (c >= LEAST) & (c >= TIMES * np.maximum(local, 0.5))
    q = np.where(spike, 0.5, 0.0)
    y = np.log(np.maximum(n, 1))
    mu, sigma = np.average(y, weights=c), max(0.05, math.sqrt(np.average((y - np.average(y, weights=c)) ** 2, weights=c)))
    for _ in range(rounds):
        z = (y - mu) / sigma
        tail = np.maximum(1 - _cdf(z), 1e-12)
        hazard = np.exp(-z * z / 2) / math.sqrt(2 * math.pi) / tail
        first = mu + sigma * hazard  # E[log T | T > n]
        second = mu * mu + 2 * mu * sigma * hazard + sigma * sigma * (1 + z * hazard)
        total = c.sum()
        mu = float((c * (1 - q) * y + c * q * first).sum() / total)
        sigma = max(0.05, math.sqrt(max(1e-6, float((c * (1 - q) * y * y + c * q * second).sum() / total) - mu * mu)))
        usual = total * (_cdf((np.log(n + 0.5) - mu) / sigma) - _cdf((np.log(np.maximum(n - 0.5, 0.5)) - mu) / sigma))
        q = np.where(spike, np.clip(1 - np.maximum(np.minimum(usual, 2 * local + 1), local) / c, 0, 0.999), 0.0)
    out = np.empty(len(n))
    out[order] = q
    return out


def limits(values: DataFrame) -> DataFrame:
    """(feed, field, n, posterior) of candidate limits.  A group of the pandas step is a
    histogram: one row a distinct length, however many values there are."""
    # copies of a value say no more about lengths than one
    distinct = values.groupBy("feed", "field", F.xxhash64("value").alias("v")).agg(F.first("n").alias("n"))
    histogram = distinct.groupBy("feed", "field", "n").agg(F.count("*").alias("c"))

    def fit(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.assign(posterior=censoring(pdf["n"].to_numpy(), pdf["c"].to_numpy()))
        return pdf.loc[pdf.posterior > 0, ["feed", "field", "n", "posterior"]]

    return histogram.groupBy("feed", "field").applyInPandas(fit, "feed string, field string, n int, posterior double")


def _parsed(values: DataFrame) -> DataFrame:
    """Adds ``sents``: (opening, words, last, closed) of each sentence in order."""
    plain = F.regexp_replace(F.lower(bare(F.col("value"))), r"\d+", "0")
    # course codes are one kind of word, whatever their letters
    coded = F.regexp_replace(F.regexp_replace(bare(F.col("value")), r"\b[A-Z]{4} \d{3}\b", "xxxx 0"), r"\d+", "0")
    parts = F.split(F.lower(coded), r"(?<=[.!?。])\s+")

    def sentence(s: Column) -> Column:
        words = F.regexp_extract_all(s, F.lit(r"[\p{L}\p{N}'-]+"), F.lit(0))
        return F.struct(
            F.array_join(F.slice(words, 1, 2), " ").alias("opening"),
            F.size(words).alias("words"),
            F.coalesce(F.try_element_at(words, F.lit(-1)), F.lit("")).alias("last"),
            s.rlike(CLOSERS).alias("closed"),
            words.alias("all"),
        )

    return values.withColumn("sents", F.transform(parts, sentence)).withColumn("plain", plain)


def find(df: DataFrame, fields=FIELDS, key: str = "rec_id", source: str = "feed") -> DataFrame:
    """(rec_id, feed, field, n, limit_posterior, ending, probability, cut), one row a real value.

    ending is trace, closed, broken or entire.  Rows with a null key are kept."""
    values = _parsed(long_form(df, fields, key, source))
    values = checkpoint(values.drop("plain"))
    one = values.select((F.size("sents") == 1).alias("single"), F.inline("sents"))
    # sentences of each opening by their number of words; those that close and those that don't
    lengths = one.groupBy("opening", "words").agg(F.count_if("closed").alias("c"), F.count_if(~F.col("closed") & F.col("single")).alias("o"))
    openings = lengths.groupBy("opening").agg(F.sum("c").alias("all_closed"), F.sum("o").alias("all_open"))
    lengths = lengths.join(openings, "opening")
    whole_words = one.select(F.explode(F.when(F.col("closed"), F.col("all")).otherwise(F.slice("all", F.lit(1), F.greatest(F.size("all") - 1, F.lit(0))))).alias("last")).groupBy("last").agg(F.count("*").alias("seen"))

    final = F.element_at("sents", -1)
    rows = values.select("rec_id", "feed", "field", "n", F.xxhash64(F.lower(bare(F.col("value")))).alias("v"), F.col("value").rlike(TRACES).alias("trace"), F.col("value").rlike(CLOSERS).alias("closed"), final["opening"].alias("opening"), final["words"].alias("words"), final["last"].alias("last"), (F.size("sents") == 1).alias("single"))
    settled = rows.where(F.col("trace") | F.col("closed"))
    feeds = rows.where(~(F.col("trace") | F.col("closed"))).groupBy("field", "v").agg(F.count_distinct("feed").alias("feeds"))
    loose = rows.where(~(F.col("trace") | F.col("closed"))).join(feeds, ["field", "v"]).join(lengths, ["opening", "words"], "left").join(whole_words, "last", "left")
    n = lambda c: F.coalesce(F.col(c), F.lit(0))
    # as long as sentences that close; a value of one sentence whose opening never closes
    # is a note, if most with that opening are as long, or none other has it
    usual = F.when(n("all_closed") >= 3, n("c") >= F.greatest(F.lit(2), n("all_closed") * 0.02)).otherwise(F.col("single") & (F.col("words") >= 2) & (n("o") >= 2) & (n("o") >= 0.3 * n("all_open")))
    alone = F.col("single") & (n("all_closed") + n("all_open") <= 2) & F.col("words").between(2, 6)
    # a last word seen nowhere else is half a word, unless notes end so
    known = (n("seen") >= 2) | ((n("all_closed") == 0) & usual) | F.col("last").rlike(r"^0")
    # sources have different limits: what several of them end alike was written so
    common = F.col("feeds") >= SAME_IN_FEEDS
    loose = loose.withColumn("entire", (usual & known) | alone | common)
    ending = lambda d, e: d.select("rec_id", "feed", "field", "n", e.alias("ending"))
    out = checkpoint(ending(settled, F.when(F.col("trace"), "trace").otherwise("closed")).unionByName(ending(loose, F.when(F.col("entire"), "entire").otherwise("broken"))))
    # a limit breaks most of the values it meets; a length that many whole notes share does not
    breaks = out.groupBy("feed", "field", "n").agg(F.avg(F.col("ending").isin("broken", "trace").cast("double")).alias("share"))
    real = limits(values).join(breaks, ["feed", "field", "n"]).where(F.col("share") >= LIMIT_BREAKS).drop("share")
    # where the cut fell behind a space that was stripped, a value is that much shorter
    real = real.select("feed", "field", F.explode(F.array(*(F.col("n") - i for i in range(3)))).alias("n"), "posterior").groupBy("feed", "field", "n").agg(F.max("posterior").alias("posterior"))
    out = out.join(real, ["feed", "field", "n"], "left").withColumn("posterior", F.coalesce("posterior", F.lit(0.0)))
    out = checkpoint(out)
    away, weights = endings_fitted(*_endings(out))
    weight = F.create_map(*(F.lit(x) for pair in zip(ENDINGS, map(float, weights)) for x in pair))
    prior = F.when(F.col("posterior") > 0, F.log(F.col("posterior") / (1 - F.col("posterior")))).otherwise(F.lit(away))
    odds = F.greatest(prior, F.lit(away)) + F.element_at(weight, F.col("ending"))
    out = out.withColumn("probability", 1 / (1 + F.exp(-odds)))
    return out.select("rec_id", "feed", "field", "n", F.col("posterior").alias("limit_posterior"), "ending", "probability", (F.col("probability") > 0.5).alias("cut"))


def rates(found: DataFrame) -> DataFrame:
    """(feed, field, n_values, n_cut, share_cut): how often each source cuts each field."""
    return found.groupBy("feed", "field").agg(F.count("*").alias("n_values"), F.count_if("cut").alias("n_cut")).withColumn("share_cut", F.col("n_cut") / F.col("n_values"))
