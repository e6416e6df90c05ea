"""Quality rules with risk-controlled cutoffs.

Every text is measured (`measure`); a rule rejects a text whose value lies above
the rule's cutoff. Cutoffs come from labelled rows, by exact binomial tests of "more than
`alpha` of the stratum's good texts would be lost to this rule": in each stratum a rule's
candidate cutoffs are tested from lax to strict, and one is certified as long as its test and all
before it reject. Each stratum has an equal part of `delta`, and its rules share that part, step
down: rules that catch no bad text at any candidate are left out beforehand (this looks at the bad texts
only, the tests at the good ones only), and a rule whose candidates are all certified
hands its part on to the others. This graphical procedure bounds by `delta` the
chance that any certified cutoff, in any stratum, loses more than `alpha`.

Strata with fewer good labels than one test without a single loss needs (`needed`; known from the
labels' number, before any value is looked at) are pooled: together they are one stratum more,
tested on its own part of delta, and its guarantee holds for the good texts of the pool, not of each. `report` tells for
every stratum and rule what was certified and, where nothing was, why.

Among certified cutoffs the one of greatest gain (share of bad texts caught, less
`loss` times the share of good texts lost) is used, the laxest at ties; with none
certified, or no gain, the rule is off in that stratum.

Defined results: a null or empty text has no words and fails the base rule; a
null stratum is one of its own, apart from ''; strata without any label get no cutoffs; several
labels of one id count once, bad if any is bad; null ids and labels with null quality
are no labels; repeated rows each count; very long texts are measured whole; no
documents give no rows; columns of any name keep their values (`keep`), else are not read. Texts are measured with
64-bit fingerprints of words inside one text.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import words as w
from .shared import carried, cut, small

_LONG = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_bangs", "n_upper", "n_letters", "n_digits")
STATS = T.StructType([T.StructField(c, T.LongType()) for c in _LONG])
_ARROW = pa.struct([(c, pa.int64()) for c in _LONG])
SYMBOLS = b"#*$%&|<>"


def _table(chars: bytes) -> np.ndarray:
    out = np.zeros(256, bool)
    out[list(chars)] = True
    return out


_UPPER = bytes(range(65, 91))
_TABLES = {"n_symbols": _table(SYMBOLS), "n_bangs": _table(b"!"), "n_upper": _table(_UPPER), "n_letters": _table(_UPPER + _UPPER.lower()), "n_digits": _table(b"0123456789")}


def _lines(text: str | None) -> tuple[int, int]:
    """Lines with a word, and those equal to an earlier line."""
    if not text:
        return 0, 0
    seen, n = set(), 0
    for line in text.split("\n"):
        if line.strip(" \t\n\x0b\x0c\r"):
            seen.add(line)
            n += 1
    return n, n - len(seen)


def _stats(data: np.ndarray, off: np.ndarray, texts: list[str | None]) -> pa.StructArray:
    words = w.Words(data, off, w.spaced())
    n, first = len(words.start), words.first
    out = {"n_words": words.counts(), "word_chars": w.per_row(words.mask & ((data & 0xC0) != 0x80), off)}
    out |= {k: w.per_row(t[data], off) for k, t in _TABLES.items()}
    repeated = np.zeros(0, bool)
    if n:
        ok = np.flatnonzero(w.inside(first, 8, n))
        g = w.grams(words.hashes(), 8)[ok] ^ w.mix(words.owner()[ok].astype(w.U) + w.U(1)) if len(ok) else np.zeros(0, w.U)
        _, place, count = np.unique(g, return_inverse=True, return_counts=True)
        repeated = w.covered(ok[count[place] > 1], 8, n)
    out["n_repeat_words"] = w.per_row(repeated, first)
    pairs = [_lines(t) for t in texts]
    out["n_lines"], out["n_dup_lines"] = [p[0] for p in pairs], [p[1] for p in pairs]
    return pa.StructArray.from_arrays([pa.array(out[c], pa.int64()) for c in _LONG], names=list(_LONG))


def measure(docs: DataFrame, text: str = "text", into: str = "quality_stats") -> DataFrame:
    """docs with a struct of statistics of each whole text."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, data, off in w.pieces(batches, text):
            stats = _stats(data, off, part.column(part.schema.get_field_index(text)).to_pylist())
            yield pa.RecordBatch.from_arrays([*part.columns, stats], schema=part.schema.append(pa.field(into, _ARROW)))

    return docs.mapInArrow(run, T.StructType([*docs.schema.fields, T.StructField(into, STATS)]))


@dataclass(frozen=True)
class Rule:
    """Rejects where numerator / denominator > cutoff; a zero denominator counts as 1."""

    name: str
    over: str
    under: str
    grid: tuple[float, ...]

    def value(self, s: str) -> Column:
        return F.col(f"{s}.{self.over}") / F.greatest(F.col(f"{s}.{self.under}"), F.lit(1))

    def exceeded(self, s: str) -> Column:
        """How many cutoffs of the grid the value exceeds."""
        value = self.value(s)
        return F.size(F.filter(F.array(*[F.lit(c) for c in self.grid]), lambda c: value > c))


def _shares(step: float, n: int) -> tuple[float, ...]:
    return tuple(round(step * i, 6) for i in range(n, 0, -1))


#: Candidate cutoffs from lax to strict.
RULES = (
    Rule("symbol_share", "n_symbols", "word_chars", _shares(0.01, 60)),
    Rule("bang_share", "n_bangs", "n_words", _shares(0.05, 60)),
    Rule("upper_share", "n_upper", "n_letters", _shares(0.02, 48)),
    Rule("dup_line_share", "n_dup_lines", "n_lines", _shares(0.02, 45)),
    Rule("repeat_share", "n_repeat_words", "n_words", _shares(0.01, 30)),
    Rule("digit_share", "n_digits", "word_chars", _shares(0.02, 45)),
    Rule("word_length", "word_chars", "n_words", _shares(0.5, 60)),
)


@dataclass(frozen=True)
class Policy:
    """alpha: share of a stratum's good texts that a rule may lose; delta: chance that any certified cutoff loses more."""

    alpha: float = 0.02
    delta: float = 0.05
    loss: float = 5.0
    min_words: int = 20
    repeat_percent: int = 30
    rules: tuple[Rule, ...] = field(default=RULES)


def binomial_cdf(k: np.ndarray, n: int, p: float) -> np.ndarray:
    """P(Bin(n, p) <= k), exactly summed in logarithms."""
    k = np.asarray(k, np.int64)
    i = np.arange(int(k.max(initial=0)) + 1)
    logs = np.array([math.lgamma(n + 1) - math.lgamma(x + 1) - math.lgamma(n - x + 1) + x * math.log(p) + (n - x) * math.log1p(-p) for x in i])
    return np.minimum(np.cumsum(np.exp(logs)), 1.0)[k]


def needed(alpha: float, level: float) -> int:
    """Good texts without a loss that reject "more than alpha are lost" at a level."""
    return math.ceil(math.log(level) / math.log1p(-alpha))


def certified(p: list[np.ndarray], useful: list[bool], level: float) -> list[int]:
    """How many cutoffs of each rule are certified. p: the tests' p-values, from lax to strict, of each rule; useful: whether it takes part.

    Each chain starts with an equal part of the level; one certified to its end hands its part on."""
    out, active = [0] * len(p), [j for j, u in enumerate(useful) if u]
    share = level / max(1, len(active))
    while active:
        for j in active:
            passed = p[j] <= share
            out[j] = len(passed) if passed.all() else int(np.argmin(passed))
        ended = [j for j in active if out[j] == len(p[j])]
        if not ended or len(ended) == len(active):
            break
        whole = share * len(active)
        active = [j for j in active if j not in ended]
        share = whole / len(active)
    return out


_REPORT = "struct<rule:string,n_good:long,n_bad:long,needed:long,certified:int,cutoff:double,lost:long,caught:long,reason:string>"
_ALL = "(pool)"


def _key(stratum: str) -> Column:
    """A name for a stratum; null has its own."""
    return F.coalesce(F.concat(F.lit("="), F.col(f"`{stratum}`").cast("string")), F.lit("null"))


def _decide(rules: tuple[Rule, ...], policy: Policy, side: list[tuple[np.ndarray, np.ndarray]], level: float) -> list[dict]:
    """What is certified and used of each rule, from the counts (good, bad) by bin."""
    above, p = [], []
    for r, (good, bad) in zip(rules, side, strict=True):
        n = len(r.grid)
        # a value in bin b exceeds the b strictest cutoffs, those at n - b and after
        lost, caught = (np.cumsum(x[::-1])[:n].astype(np.int64) for x in (good, bad))
        above.append((lost, caught))
        p.append(binomial_cdf(lost, int(good.sum()), policy.alpha) if good.sum() else np.ones(n))
    m = certified(p, [bool(len(c) and c[-1]) for _, c in above], level)
    share = level / max(1, sum(bool(len(c) and c[-1]) for _, c in above))
    out = []
    for r, (good, bad), (lost, caught), k in zip(rules, side, above, m, strict=True):
        n_good, n_bad = int(good.sum()), int(bad.sum())
        row = {"rule": r.name, "n_good": n_good, "n_bad": n_bad, "needed": needed(policy.alpha, share), "certified": k, "cutoff": None, "lost": None, "caught": None}
        gain = caught[:k] / max(1, n_bad) - policy.loss * lost[:k] / max(1, n_good)
        best = int(np.argmax(gain)) if k else 0
        if k and gain[best] > 0:
            row |= {"cutoff": float(r.grid[best]), "lost": int(lost[best]), "caught": int(caught[best]), "reason": "used"}
        else:
            row["reason"] = "no bad text above any candidate" if not len(caught) or not caught[-1] else "too few good labels" if n_good < row["needed"] else "the laxest candidate loses too many" if not k else "no gain among the certified"
        out.append(row)
    return out


def cutoffs(measured: DataFrame, labels: DataFrame, policy: Policy, stratum: str = "lang", stats: str = "quality_stats", doc_id: str = "doc_id") -> DataFrame:
    """(stratum, pooled, cutoffs array in the order of the rules, null where a rule is off, report), from every labelled row. stratum: as `_key` names it.

    Only counts per stratum, rule and candidate leave the executors' partial
    aggregates: the groups that are tested are as large as the grids."""
    rules = policy.rules
    bins = F.array(*[F.struct(F.lit(j).alias("rule"), r.exceeded(stats).alias("bin")) for j, r in enumerate(rules)])
    bad = labels.where(F.col(doc_id).isNotNull() & F.col("quality").isNotNull()).groupBy(F.col(doc_id).alias("_id")).agg(F.max((F.col("quality") != 1).cast("int")).alias("_bad"))
    held = measured.join(bad, measured[doc_id] == bad["_id"]).select(_key(stratum).alias("stratum"), "_bad", F.explode(bins).alias("b"))
    counts = cut(held.groupBy("stratum", F.col("b.rule").alias("rule"), F.col("b.bin").alias("bin"), "_bad").count())
    sizes = counts.where("rule = 0").groupBy("stratum").agg(F.coalesce(F.sum(F.when(F.col("_bad") == 0, F.col("count"))), F.lit(0)).alias("good"))
    strata = max(1, sizes.count())
    enough = needed(policy.alpha, policy.delta / (strata * len(rules)))
    sizes = cut(sizes.select(F.col("stratum").alias("of"), (F.col("good") < enough).alias("pooled")))
    large = sizes.where("not pooled").count()
    level = policy.delta / max(1, large + (large < strata))
    grouped = counts.join(small(sizes), F.col("stratum") == F.col("of")).withColumn("stratum", F.when(F.col("pooled"), _ALL).otherwise(F.col("stratum")))
    grouped = grouped.groupBy("stratum", "rule", "bin", "_bad").agg(F.sum("count").alias("count"))

    def per_stratum(pdf: pd.DataFrame) -> pd.DataFrame:
        side = []
        for j, r in enumerate(rules):
            of = pdf[pdf["rule"] == j]
            side.append(tuple(np.bincount(x["bin"], weights=x["count"], minlength=len(r.grid) + 1) for x in (of[of["_bad"] == 0], of[of["_bad"] == 1])))
        found = _decide(rules, policy, side, level)
        return pd.DataFrame({"tested": [pdf["stratum"].iloc[0]], "cutoffs": [[f["cutoff"] for f in found]], "report": [found]})

    tested = grouped.groupBy("stratum").applyInPandas(per_stratum, f"tested string, cutoffs array<double>, report array<{_REPORT}>")
    by = F.when(F.col("pooled"), _ALL).otherwise(F.col("of"))
    return sizes.join(tested, by == F.col("tested")).select(F.col("of").alias("stratum"), "pooled", "cutoffs", "report")


def report(docs: DataFrame, labels: DataFrame, policy: Policy | None = None, stratum: str = "lang") -> DataFrame:
    """A row for every labelled stratum (named =value or null) and rule: labels, labels that a lossless test needs, number of certified cutoffs, the cutoff used and its counts, or the reason why there is none. Pooled strata show the pool's rows."""
    policy = policy or Policy()
    measured = cut(measure(docs.select("doc_id", stratum, "text")).drop("text"))
    return cutoffs(measured, labels, policy, stratum).select("stratum", "pooled", F.explode("report").alias("r")).select("stratum", "pooled", "r.*")


def judge(measured: DataFrame, limits: DataFrame, policy: Policy, stratum: str = "lang", stats: str = "quality_stats") -> DataFrame:
    """measured with booleans base_failed, kept and pooled (null in strata without a label)."""
    s = F.col(f"{stats}.n_words")
    failed = (s < policy.min_words) | (100 * F.col(f"{stats}.n_repeat_words") > policy.repeat_percent * s)
    limits = cut(limits.select(F.col("stratum").alias("_stratum"), F.col("cutoffs").alias("_cutoffs"), "pooled"))
    broken = F.lit(False)
    for j, r in enumerate(policy.rules):
        broken = broken | F.coalesce(r.value(stats) > F.col("_cutoffs")[j], F.lit(False))
    joined = measured.withColumn("_key", _key(stratum)).join(small(limits), F.col("_key") == F.col("_stratum"), "left")
    return joined.withColumns({"base_failed": failed, "kept": ~failed & ~F.coalesce(broken, F.lit(False))}).drop("_key", "_stratum", "_cutoffs")


def assess(docs: DataFrame, labels: DataFrame, policy: Policy | None = None, stratum: str = "lang") -> DataFrame:
    """doc_id, stratum, statistics and verdict of every document, from one pass over the texts."""
    policy = policy or Policy()
    measured = cut(measure(docs.select("doc_id", stratum, "text")).drop("text"))
    return judge(measured, cutoffs(measured, labels, policy, stratum), policy, stratum)


def keep(docs: DataFrame, labels: DataFrame, policy: Policy | None = None, stratum: str = "lang") -> DataFrame:
    """The rows of docs that pass, with the columns of docs. Texts are measured twice, never shuffled."""
    policy = policy or Policy()
    docs, back = carried(docs, ("doc_id", "text", stratum))
    measured = cut(measure(docs.select("doc_id", stratum, "text")).drop("text"))
    judged = judge(measure(docs), cutoffs(measured, labels, policy, stratum), policy, stratum)
    return back(judged.where("kept"))
