"""Mixing sources to target weights by hierarchical budgeting.

The leaves of the tree are (domain, language, source). A node's capacity is the
tokens its leaves can give in `max_epochs` epochs. The root's budget is a share of
all tokens, and at each level a parent's budget is dealt to its children by
weight; a child never gets more than its capacity, and what it cannot take goes
to its siblings, by weight, until all is dealt (water filling in whole numbers).
As a parent's own share is bounded by its capacity, a shortage reaches the
parent's siblings only where all of its children are full.

Each leaf then takes whole epochs and, of the last one, a prefix: documents in
the order of a hash of seed, epoch and id as long as their tokens fit. The prefix
is found through sums of hash buckets, as many as the largest leaf needs for buckets of
`BUCKET_ROWS`; only documents of the one bucket in which it
ends are sorted, so a leaf with a third of all rows is no single task's. Budgets are dealt in whole tokens: what a
division leaves over, less than one token a child at each level, is not dealt.

Where the texts are not wanted back, `counted` reads them once, and the mix is made of its rows.

Defined results: a token is a run of `[^\\x20\\x09-\\x0D]+`; null texts have none and are
taken where they fall inside the prefix; null language or source reads as '';
weights are whole numbers above 0, 1 where not given; of equal hashes the smaller id and text
digest comes first; repeated rows each count; very long texts are counted whole; no documents give no rows; other
columns, whatever their names, are carried, and new ones that clash take a leading underscore.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .shared import carried, cut, own, small

#: Rows that a leaf's last bucket should hold; the number of buckets, 16^5 at most, follows from the largest leaf.
BUCKET_ROWS = 2_000


@dataclass(frozen=True)
class Mix:
    """percent: the budget, of all tokens of one epoch."""

    percent: int = 60
    max_epochs: int = 2
    seed: int = 17
    domains: dict[str, int] = field(default_factory=lambda: {"d0": 4, "d1": 3, "d2": 2, "d3": 1})
    languages: dict[str, int] = field(default_factory=lambda: {"en": 5, "de": 2, "fr": 2, "es": 1})
    sources: dict[str, int] = field(default_factory=dict)


def domain_of(source: Column) -> Column:
    """The domain of a source where the table has none: one of four, by digest."""
    return F.concat(F.lit("d"), (F.conv(F.substring(F.md5(F.coalesce(source, F.lit("")).cast("binary")), 1, 4), 16, 10).cast("int") % 4).cast("string"))


def _tokens(text: Column) -> Column:
    """Runs of `[^\\x20\\x09-\\x0D]+`: what the runs between them part, without the empty strings at the ends. One reference to the split: Spark then computes it after the filters, not for every row."""
    return F.size(F.array_remove(F.split(F.coalesce(text, F.lit("")), r"[\x20\x09-\x0D]+", -1), "")).cast("long")


def _weight(name: str, of: dict[str, int]) -> Column:
    out = F.lit(1)
    for k, v in sorted(of.items()):
        out = F.when(F.col(name) == k, v).otherwise(out)
    return out.cast("long")


def deal(nodes: DataFrame, parents: list[str], name: str) -> DataFrame:
    """nodes (parents, name, weight, capacity, budget of the parent) with `given`, each child's part of the budget."""
    group = Window.partitionBy(*parents)
    order = group.orderBy((F.col("capacity") / F.col("weight")).asc(), F.col(name).asc())
    d = lambda c: F.col(c).cast("decimal(19,0)")
    out = nodes.withColumns({
        "_full": F.coalesce(F.sum("capacity").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)),
        "_left": F.sum("weight").over(order.rowsBetween(0, Window.unboundedFollowing)),
    })
    out = out.withColumn("_sat", d("capacity") * d("_left") <= (F.col("budget") - F.col("_full")).cast("decimal(19,0)") * d("weight"))
    out = out.withColumns({"_taken": F.sum(F.when(F.col("_sat"), F.col("capacity")).otherwise(0)).over(group), "_rest": F.sum(F.when(~F.col("_sat"), F.col("weight")).otherwise(0)).over(group)})
    share = F.expr("cast(cast(budget - _taken as decimal(19,0)) * cast(weight as decimal(19,0)) as decimal(38,0)) div cast(greatest(_rest, 1) as decimal(19,0))").cast("long")
    return out.withColumn("given", F.when(F.col("_sat"), F.col("capacity")).otherwise(share)).drop("_full", "_left", "_sat", "_taken", "_rest")


def budgets(leaves: DataFrame, mix: Mix) -> DataFrame:
    """leaves (domain, lang, source, tokens) with `given`: the tokens each is to supply."""
    leaves = leaves.withColumn("capacity", F.col("tokens") * mix.max_epochs)
    mids = leaves.groupBy("domain", "lang").agg(F.sum("capacity").alias("capacity"))
    tops = mids.groupBy("domain").agg(F.sum("capacity").alias("capacity"))
    root = leaves.agg(F.least(F.expr(f"(coalesce(sum(tokens), 0) * {mix.percent}L) div 100"), F.coalesce(F.sum("capacity"), F.lit(0))).cast("long").alias("budget"))
    budget = root.head()[0]
    tops = deal(tops.withColumns({"weight": _weight("domain", mix.domains), "budget": F.lit(budget).cast("long")}), [], "domain")
    mids = mids.withColumn("weight", _weight("lang", mix.languages)).join(tops.select("domain", F.col("given").alias("budget")), "domain")
    mids = deal(mids, ["domain"], "lang")
    leaves = leaves.withColumn("weight", _weight("source", mix.sources)).join(mids.select("domain", "lang", F.col("given").alias("budget")), ["domain", "lang"])
    return deal(leaves, ["domain", "lang"], "source").select("domain", "lang", "source", "tokens", "given")


def _digest(text: Column) -> Column:
    return F.md5(F.coalesce(text, F.lit("")).cast("binary"))


def counted(docs: DataFrame) -> DataFrame:
    """doc_id, lang and source of every row of docs with the text's tokens and digest, which `mix_sources` takes in place of it: dealt, as a checkpoint of few files, so what follows is neither a pass over the texts nor a task for each piece of them."""
    return cut(docs.select("doc_id", "lang", "source", _tokens(F.col("text")).alias("tokens"), _digest(F.col("text")).alias("digest")), docs.count(), deal=True)


def mix_sources(docs: DataFrame, mix: Mix | None = None, domain: Column | None = None) -> DataFrame:
    """The chosen rows of docs with domain, n_tokens and copies (names as `own` gives them): how often each stands in the mix. docs: with their texts, or as `counted` gives them."""
    mix = mix or Mix()
    added = {c: own(docs, c) for c in ("domain", "n_tokens", "copies")}
    own_domain = own(docs, "_domain")
    if domain is not None:
        docs = docs.withColumn(own_domain, domain)
    texts = "text" in docs.columns
    docs, back = carried(docs, ("doc_id", *(("text",) if texts else ("tokens", "digest")), "lang", "source"))
    names, p = {c: c for c in added}, "_mix"
    given = F.col(docs.columns[-1]) if domain is not None else None
    keyed = docs.withColumns({
        names["n_tokens"]: _tokens(F.col("text")) if texts else F.col("tokens"),
        f"{p}d": given if given is not None else domain_of(F.col("source")), f"{p}l": F.coalesce("lang", F.lit("")), f"{p}s": F.coalesce("source", F.lit("")),
    })
    tie = _digest(F.col("text")) if texts else F.col("digest")
    leaf = [f"{p}d", f"{p}l", f"{p}s"]
    narrow = keyed.select(F.col("doc_id").alias(f"{p}i"), *leaf, F.col(names["n_tokens"]).alias("n"))
    narrow = cut(narrow) if texts else narrow
    leaves = cut(narrow.groupBy(*[F.col(c).alias(a) for c, a in zip(leaf, ("domain", "lang", "source"), strict=True)]).agg(F.sum("n").alias("tokens"), F.count("*").alias("rows")))
    most, digits = leaves.agg(F.max("rows")).head()[0] or 0, 1  # hex digits of the hash that name a bucket
    while most > BUCKET_ROWS * 16**digits and digits < 5:
        digits += 1
    plan = budgets(leaves.drop("rows"), mix)
    plan = cut(plan.select(*[F.col(a).alias(f"{p}{a}") for a in ("domain", "lang", "source")], F.when(F.col("tokens") > 0, F.expr("given div greatest(tokens, 1)")).otherwise(0).alias(f"{p}epoch"), F.when(F.col("tokens") > 0, F.expr("given % greatest(tokens, 1)")).otherwise(0).alias(f"{p}rest")))
    n = plan.count()

    def planned(rows: DataFrame, by: DataFrame) -> DataFrame:
        on = [rows[c] == by[f"{p}{a}"] for c, a in zip(leaf, ("domain", "lang", "source"), strict=True)]
        return rows.join(small(by, n), on).drop(*[f"{p}{a}" for a in ("domain", "lang", "source")])

    def hashed(ident: str) -> Column:
        return F.md5(F.concat(F.lit(f"{mix.seed}|"), F.col(f"{p}epoch").cast("string"), F.lit("|"), F.coalesce(F.col(ident).cast("string"), F.lit(""))).cast("binary"))

    sums = planned(narrow, plan).groupBy(*leaf, f"{p}rest", F.substring(hashed(f"{p}i"), 1, digits).alias("b")).agg(F.sum("n").alias("n"))
    run = sums.withColumn("to", F.sum("n").over(Window.partitionBy(*leaf).orderBy("b").rowsBetween(Window.unboundedPreceding, 0)))
    ends = run.where(F.col("to") > F.col(f"{p}rest")).groupBy(*leaf).agg(F.min("b").alias(f"{p}end"), F.min_by(F.col(f"{p}rest") - F.col("to") + F.col("n"), "b").alias(f"{p}room"))
    plan = plan.join(ends, [plan[f"{p}{a}"] == ends[c] for c, a in zip(leaf, ("domain", "lang", "source"), strict=True)], "left").drop(*leaf)
    rows = planned(keyed, cut(plan)).withColumn(f"{p}h", hashed("doc_id"))
    bucket, end = F.substring(f"{p}h", 1, digits), F.coalesce(F.col(f"{p}end"), F.lit("g"))  # g: after all buckets
    whole = rows.where(bucket != end).withColumn(names["copies"], F.col(f"{p}epoch") + (bucket < end).cast("int"))
    order = Window.partitionBy(*leaf).orderBy(f"{p}h", "doc_id", tie).rowsBetween(Window.unboundedPreceding, 0)
    last = rows.where(bucket == end).withColumn(names["copies"], F.col(f"{p}epoch") + (F.sum(names["n_tokens"]).over(order) <= F.col(f"{p}room")).cast("int"))
    out = whole.unionByName(last).where(F.col(names["copies"]) > 0)
    new = (F.col(f"{p}d").alias(added["domain"]), F.col(names["n_tokens"]).alias(added["n_tokens"]), F.col(names["copies"]).cast("long").alias(added["copies"]))
    out = back(out, *new)
    return out if domain is None else out.drop(own_domain)


def take(docs: DataFrame, mix: Mix | None = None) -> DataFrame:
    """The mix with the columns of docs: each chosen row as often as it is to be seen."""
    docs, back = carried(docs, ("doc_id", "text", "lang", "source"))
    return back(mix_sources(docs, mix).withColumn("_copy", F.explode(F.sequence(F.lit(1).cast("long"), F.col("copies")))))


ORACLE_SQL = r"""
WITH d AS (
  SELECT doc_id, coalesce(lang, '') AS lang, coalesce(source, '') AS source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS n_tokens,
         'd' || (('0x' || substr(md5(coalesce(source, '')), 1, 4))::BIGINT % 4)::VARCHAR AS domain, md5(coalesce(text, '')) AS tie, lang AS lang0, source AS source0
  FROM documents),
leaf AS (SELECT domain, lang, source, sum(n_tokens)::HUGEINT AS tokens, 2 * sum(n_tokens)::HUGEINT AS cap FROM d GROUP BY ALL),
mid AS (SELECT domain, lang, sum(cap)::HUGEINT AS cap, CASE lang WHEN 'en' THEN 5 WHEN 'de' THEN 2 WHEN 'fr' THEN 2 ELSE 1 END AS w FROM leaf GROUP BY ALL),
top AS (SELECT domain, sum(cap)::HUGEINT AS cap, CASE domain WHEN 'd0' THEN 4 WHEN 'd1' THEN 3 WHEN 'd2' THEN 2 ELSE 1 END AS w FROM mid GROUP BY ALL),
t0 AS (SELECT *, (SELECT least(sum(tokens)::HUGEINT * 60 // 100, sum(cap)::HUGEINT) FROM leaf) AS budget FROM top),
t1 AS (SELECT *, coalesce(sum(cap) OVER (ORDER BY cap::DOUBLE / w, domain ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::HUGEINT AS fullb, sum(w) OVER (ORDER BY cap::DOUBLE / w, domain ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)::HUGEINT AS lef FROM t0),
t2 AS (SELECT *, cap * lef <= (budget - fullb) * w AS sat FROM t1),
t3 AS (SELECT domain, CASE WHEN sat THEN cap ELSE (budget - coalesce(sum(CASE WHEN sat THEN cap END) OVER (), 0)::HUGEINT) * w // greatest(sum(CASE WHEN sat THEN 0 ELSE w END) OVER ()::HUGEINT, 1) END AS given FROM t2),
m0 AS (SELECT mid.*, t3.given AS budget FROM mid JOIN t3 USING (domain)),
m1 AS (SELECT *, coalesce(sum(cap) OVER (PARTITION BY domain ORDER BY cap::DOUBLE / w, lang ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::HUGEINT AS fullb, sum(w) OVER (PARTITION BY domain ORDER BY cap::DOUBLE / w, lang ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)::HUGEINT AS lef FROM m0),
m2 AS (SELECT *, cap * lef <= (budget - fullb) * w AS sat FROM m1),
m3 AS (SELECT domain, lang, CASE WHEN sat THEN cap ELSE (budget - coalesce(sum(CASE WHEN sat THEN cap END) OVER (PARTITION BY domain), 0)::HUGEINT) * w // greatest(sum(CASE WHEN sat THEN 0 ELSE w END) OVER (PARTITION BY domain)::HUGEINT, 1) END AS given FROM m2),
l0 AS (SELECT leaf.*, 1 AS w, m3.given AS budget FROM leaf JOIN m3 USING (domain, lang)),
l1 AS (SELECT *, coalesce(sum(cap) OVER (PARTITION BY domain, lang ORDER BY cap::DOUBLE / w, source ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::HUGEINT AS fullb, sum(w) OVER (PARTITION BY domain, lang ORDER BY cap::DOUBLE / w, source ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)::HUGEINT AS lef FROM l0),
l2 AS (SELECT *, cap * lef <= (budget - fullb) * w AS sat FROM l1),
l3 AS (SELECT domain, lang, source, tokens, CASE WHEN sat THEN cap ELSE (budget - coalesce(sum(CASE WHEN sat THEN cap END) OVER (PARTITION BY domain, lang), 0)::HUGEINT) * w // greatest(sum(CASE WHEN sat THEN 0 ELSE w END) OVER (PARTITION BY domain, lang)::HUGEINT, 1) END AS given FROM l2),
p AS (SELECT domain, lang, source, CASE WHEN tokens > 0 THEN given // greatest(tokens, 1) ELSE 0 END AS epoch, CASE WHEN tokens > 0 THEN given % greatest(tokens, 1) ELSE 0 END AS rest FROM l3),
h AS (SELECT d.*, p.epoch, p.rest, md5('17|' || p.epoch::VARCHAR || '|' || coalesce(d.doc_id::VARCHAR, '')) AS hash FROM d JOIN p USING (domain, lang, source)),
c AS (SELECT *, sum(n_tokens) OVER (PARTITION BY domain, lang, source ORDER BY hash, doc_id NULLS FIRST, tie ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS upto FROM h)
SELECT doc_id, domain, lang0 AS lang, source0 AS source, n_tokens, (epoch + CASE WHEN upto <= rest THEN 1 ELSE 0 END)::BIGINT AS copies
FROM c WHERE epoch + CASE WHEN upto <= rest THEN 1 ELSE 0 END > 0
"""
