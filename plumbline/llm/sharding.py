"""Sharding by sampled splitters, in DataFrame functions only.

Records are ordered by a key: the MD5 of their text, then their id, then a hash of
the whole row, so equal texts stand together and a large group of copies spreads
over its ids. A size-weighted sample of keys (each row with probability
`sample * size / total`, by a hash of its key) gives quantile boundaries; rows are
dealt to the ranges between them. A range that is still overfull is subdivided by
a sample of its own. Exact sums of the ranges and a running sum inside each give
every row its place in the whole order, hence its shard and its slot: shards are
runs of the order.

`bytes`: shard i takes the rows whose middle byte lies in the i-th part of all bytes.
`rows`: shard i takes the rows whose number lies in the i-th part of all rows.
`key`: not by order but by jump hashing of the id, so that one more shard takes
rows only into itself.

Defined results: null text has size 1 and the MD5 and CRC of no bytes; null ids come
first among equal texts; repeated rows take consecutive slots; empty tables give
no rows; very long texts are placed whole; all columns, whatever their names and kinds, are carried, and new ones that clash take a leading
underscore. Nothing is gathered but the boundaries and the sums of ranges, whose
number is bounded by `MAX_RANGES`.
"""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .shared import carried, cut, own, row_hash, utf8_size

SHARDS = 16
#: Rows that a range should hold, and ranges at most: their boundaries are literals of the plan. Beyond MAX_RANGES x RANGE_ROWS rows, ranges grow in proportion.
RANGE_ROWS, MAX_RANGES = 20_000, 16_384
#: Sampled keys per range.
OVERSAMPLE = 16
#: A range of more than so many times the mean bytes is subdivided, so often at most.
OVERFULL, ROUNDS = 4, 3
NEW = ("size", "text_crc32", "law", "shard", "slot", "grown_shard")


def _order(docs: DataFrame) -> Column:
    """The sort key as one string: digest of the text, id, hash of the row."""
    number = F.lpad(F.hex(F.coalesce(F.col("doc_id").cast("long"), F.lit(0)) + F.lit(-(1 << 63))), 16, "0")
    ident = F.when(F.col("doc_id").isNull(), F.lit("-" * 16)).otherwise(number)
    rest = F.lpad(F.hex(row_hash(docs)), 16, "0")
    return F.concat(F.md5(F.coalesce(F.col("text"), F.lit("")).cast("binary")), ident, rest)


def _uniform(key: Column, salt: int) -> Column:
    return F.crc32(F.concat(key, F.lit(str(salt)))) / F.lit(float(1 << 32))


def _boundaries(rows: DataFrame, key: str, size: str, total: int, ranges: int, salt: int) -> list[str]:
    """Quantile boundaries of a size-weighted sample."""
    if ranges < 2 or not total:
        return []
    rate = OVERSAMPLE * ranges / total
    weight = F.greatest(F.col(size).cast("double"), F.lit(1 / rate))  # what a sampled row stands for
    sample = rows.where(_uniform(F.col(key), salt) < F.col(size) * rate).select(key, weight.alias("w"))
    run = sample.select(key, F.sum("w").over(Window.orderBy(key).rowsBetween(Window.unboundedPreceding, 0)).alias("to"), F.sum("w").over(Window.partitionBy()).alias("all"))
    part = run.select(key, F.floor(F.col("to") * ranges / F.col("all")).alias("q")).where(F.col("q") < ranges)
    return sorted({r[0] for r in part.groupBy("q").agg(F.min(key)).where("q > 0").select(f"min({key})").collect()})


def _range_of(key: Column, boundaries: list[str]) -> Column:
    """Number of boundaries not above the key: those that share its first two digits are looked through, the rest counted beforehand."""
    digits = [f"{i:02x}" for i in range(256)]
    table, below = {}, {}
    for d in digits:
        table[d] = [b for b in boundaries if b[:2] == d]
    n = 0
    for d in digits:
        below[d] = n
        n += len(table[d])
    if not boundaries:
        return F.lit(0)
    before = F.array(*[F.lit(below[d]) for d in digits])
    near = F.from_json(F.lit(json.dumps([table[d] for d in digits])), "array<array<string>>")
    at = F.conv(F.substring(key, 1, 2), 16, 10).cast("int")
    return (F.get(before, at) + F.size(F.filter(F.get(near, at), lambda b: b <= key))).cast("int")


def splitters(rows: DataFrame, key: str, size: str) -> tuple[list[str], dict[int, tuple[int, int]]]:
    """Boundaries, and rows and bytes of each range. rows: key and size only."""
    count, total = rows.agg(F.count("*"), F.coalesce(F.sum(size), F.lit(0))).head()
    ranges = min(MAX_RANGES, max(16, -(-count // RANGE_ROWS)))
    boundaries = _boundaries(rows, key, size, total, ranges, 0)
    for round_ in range(ROUNDS + 1):
        placed = rows.select(_range_of(F.col(key), boundaries).alias("r"), size)
        sums = {r[0]: (r[1], r[2]) for r in placed.groupBy("r").agg(F.count("*"), F.sum(size)).collect()}
        over = {r: s for r, s in sums.items() if s[1] > OVERFULL * total / ranges and s[0] > 1}
        if not over or round_ == ROUNDS or len(boundaries) >= 2 * MAX_RANGES:
            return boundaries, sums
        inside = rows.where(_range_of(F.col(key), boundaries).isin([*over]))
        more = sum(s[1] for s in over.values())
        new = _boundaries(inside, key, size, more, min(MAX_RANGES, -(-2 * more * ranges // total)), round_ + 1)
        boundaries = sorted({*boundaries, *new})
    raise AssertionError


def jump_hash(key: Column, shards: int) -> Column:
    """Shard of a key, such that one more shard takes keys only into itself: the last step s < shards at which a hash of (key, s) is below 1 / (s + 1)."""
    steps = F.sequence(F.lit(0), F.lit(shards - 1))
    u = lambda s: F.pmod(F.xxhash64(key, s), F.lit(1 << 30)) * (s + 1) < F.lit(1 << 30)
    return F.array_max(F.filter(steps, u))


def shard(docs: DataFrame, law: str = "bytes", shards: int = SHARDS) -> DataFrame:
    """docs with size, text_crc32, law, shard, slot and grown_shard (names as `own` gives them)."""
    if law not in ("bytes", "rows", "key"):
        raise ValueError(f"no such law: {law}")
    added = [own(docs, c) for c in NEW]
    docs, back = carried(docs, ("doc_id", "text"))
    names, (key, place, before, start) = {c: c for c in NEW}, ("_key", "_range", "_before", "_start")
    new = [F.col(c).alias(a) for c, a in zip(NEW, added, strict=True)]
    size = utf8_size(F.col("text")) + 1
    keyed = docs.withColumns({key: _order(docs), names["size"]: size, names["text_crc32"]: F.crc32(F.coalesce(F.col("text"), F.lit("")).cast("binary"))})
    law_of = F.lit(law)
    if law == "key":
        ident = F.coalesce(F.col("doc_id").cast("string"), F.lit(""))
        keyed = keyed.withColumns({names["shard"]: jump_hash(ident, shards), names["grown_shard"]: jump_hash(ident, shards + 1)})
    narrow = cut(keyed.select(key, names["size"], *([names["shard"]] if law == "key" else [])))
    boundaries, sums = splitters(narrow, key, names["size"])
    ranges = sorted(sums)
    rows_before, bytes_before, n, total = {}, {}, 0, 0
    for r in ranges:
        rows_before[r], bytes_before[r] = n, total
        n, total = n + sums[r][0], total + sums[r][1]
    dealt = keyed.withColumn(place, _range_of(F.col(key), boundaries))
    within = Window.partitionBy(place).orderBy(key)
    up_to = within.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    if law == "key":
        per = narrow.select(_range_of(F.col(key), boundaries).alias("r"), names["shard"]).groupBy("r", names["shard"]).count().collect()
        counts = {(r, s): c for r, s, c in per}
        offsets = []
        for s in range(shards):
            at, row = 0, []
            for r in range(len(boundaries) + 1):
                row.append(at)
                at += counts.get((r, s), 0)
            offsets.append(row)
        base = F.get(F.get(_literal(offsets), F.col(names["shard"])), F.col(place))
        out = dealt.withColumn(names["slot"], (base + F.row_number().over(Window.partitionBy(place, names["shard"]).orderBy(key)) - 1).cast("long"))
        return back(out.withColumn(names["law"], law_of), *new)

    def offset(of: dict[int, int], at: str = place) -> Column:
        return F.get(_literal([of.get(r, 0) for r in range(len(boundaries) + 1)]), F.col(at))

    order = (offset(rows_before) + F.row_number().over(within) - 1).cast("long")
    # twice the middle byte
    begin = (2 * (offset(bytes_before) + F.sum(names["size"]).over(up_to)) - F.col(names["size"])).cast("long")
    dealt = dealt.withColumns({before: order, start: begin})
    whole = 2 * total if law == "bytes" else n
    dealt = dealt.withColumn(names["shard"], _part(start if law == "bytes" else before, shards, whole))
    firsts = _firsts(narrow, key, names["size"], boundaries, offset, rows_before, bytes_before, whole, shards, law)
    first = F.get(_literal([firsts.get(s, 0) for s in range(shards)]), F.col(names["shard"]))
    out = dealt.withColumns({names["slot"]: (F.col(before) - first).cast("long"), names["law"]: law_of, names["grown_shard"]: F.lit(None).cast("int")})
    return back(out, *new)


def _literal(values: list) -> Column:
    kind = "array<array<long>>" if values and isinstance(values[0], list) else "array<long>"
    return F.from_json(F.lit(json.dumps(values)), kind)


def _part(column: str, shards: int, whole: int) -> Column:
    """In which of so many equal parts of the whole a place lies, in whole numbers."""
    return F.expr(f"cast((`{column}` * {shards}L) div {max(whole, 1)}L as int)")


def _firsts(narrow: DataFrame, key: str, size: str, boundaries: list[str], offset, rows_before: dict[int, int], bytes_before: dict[int, int], whole: int, shards: int, law: str) -> dict[int, int]:
    """The number of the first row of each shard."""
    place = own(narrow, "_range")
    within = Window.partitionBy(place).orderBy(key)
    base = narrow.withColumn(place, _range_of(F.col(key), boundaries))
    rows = offset(rows_before, place) + F.row_number().over(within) - 1
    begin = 2 * (offset(bytes_before, place) + F.sum(size).over(within.rowsBetween(Window.unboundedPreceding, Window.currentRow))) - F.col(size)
    base = base.select(rows.alias("n"), begin.alias("b"))
    return {r[0]: r[1] for r in base.groupBy(_part("b" if law == "bytes" else "n", shards, whole).alias("s")).agg(F.min("n")).collect()}
