"""Benchmark decontamination with an FM-index per training shard.

A shard is a run of records of about 2 MB of text. Its words become symbols of
the benchmark's vocabulary; all other words are one separator, which no phrase
holds, so runs of fewer symbols than the shortest phrase are left out of the index.
The index is the Burrows-Wheeler transform of the shard's symbols in a wavelet
tree whose level-wise ranks drive backward search of all benchmark windows at
once; occurrences are located by walking to sampled suffix positions and merged
into removal spans.

The benchmark is searched in blocks of about `BLOCK_BYTES` of text (single
longer items stand alone), one after the other: a block is read, sent to the executors,
searched by a job of its own that leaves only the spans and items of texts with hits in a
checkpoint, and taken back before the next one is read. What is on the driver or in a
broadcast at once is one block. A benchmark of one block needs no checkpoint. A
shard's index holds the runs of the block's words only, so it is small and is built for
each block.

Defined results: words are `[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+` after lower-casing
A-Z; a window is 10 consecutive words of an item, or all words of a shorter one; null and
empty texts have no words; texts are searched whole, however long; items without words or with null id are never found;
rows of one item_id are one item; repeated documents each get a row; empty tables
give no hits or no rows; columns of any name are carried by `clean`, else not read. Words are compared by 64-bit fingerprints, texts of rows that
wait for further blocks by SHA-256.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import words as w
from .shared import carried, cut, small, utf8_size

WINDOW = 10
#: Benchmark text sent to the executors at once.
BLOCK_BYTES = 4 << 20
#: One suffix position in so many is kept.
SAMPLED = 16


@dataclass
class Phrases:
    """The windows of a block of items: rows of vocabulary symbols (from 1), by length."""

    vocabulary: np.ndarray  # sorted word fingerprints; symbol = place + 1
    windows: dict[int, np.ndarray] = field(default_factory=dict)
    items: dict[int, list[tuple[str, ...]]] = field(default_factory=dict)  # of each window

    @property
    def shortest(self) -> int:
        return min(self.windows, default=0)

    @classmethod
    def of(cls, rows: list[tuple[object, str | None]], window: int = WINDOW) -> Phrases:
        rows = [(str(i), t) for i, t in rows if i is not None and t]
        found = w.Words(*w.flat(pa.array([t for _, t in rows], pa.string())), w.alnum(), fold=True)
        h = found.hashes()
        vocabulary, symbols = np.unique(h, return_inverse=True)
        out: dict[int, dict[tuple[int, ...], set[str]]] = {}
        for j, (item, _) in enumerate(rows):
            s = tuple((symbols[found.first[j] : found.first[j + 1]] + 1).tolist())
            k = min(window, len(s))
            for i in range(len(s) - k + 1 if k else 0):
                out.setdefault(k, {}).setdefault(s[i : i + k], set()).add(item)
        return cls(vocabulary, {k: np.array(list(x), np.int64) for k, x in out.items()}, {k: [tuple(sorted(v)) for v in x.values()] for k, x in out.items()})


def suffixes(s: np.ndarray) -> np.ndarray:
    """The suffix array of s by prefix doubling; zeros count as distinct, smaller than all else, in order of place."""
    n = len(s)
    zeros = np.flatnonzero(s == 0)
    rank = s.astype(np.int64) + n
    rank[zeros] = np.arange(len(zeros))
    order = np.argsort(rank, kind="stable")
    k = 1
    while True:
        sorted_ = rank[order]
        new = np.empty(n, np.int64)
        new[order] = np.concatenate([[0], np.cumsum(sorted_[1:] != sorted_[:-1])]) if n else sorted_
        rank = new
        if not n or rank[order[-1]] == n - 1:
            return order
        after = np.zeros(n, np.int64)
        after[: n - k] = rank[k:] + 1
        rank = rank * (n + 1) + after
        # ranks only split ties, so ties alone are sorted again
        tie = np.zeros(n, bool)
        same = new[order][1:] == new[order][:-1]
        tie[1:] |= same
        tie[:-1] |= same
        at = np.flatnonzero(tie)
        part = order[at]
        order[at] = part[np.argsort(rank[part], kind="stable")]
        k *= 2


class WaveletTree:
    """Ranks of symbols in a sequence: one bit row a level, each level stably parted by the bit above."""

    def __init__(self, s: np.ndarray, top: int) -> None:
        self.levels = max(1, int(top).bit_length())
        self.ones, self.zeros = [], []
        s = s.astype(np.int64)
        for level in range(self.levels - 1, -1, -1):
            bit = (s >> level) & 1
            self.ones.append(np.concatenate([[0], np.cumsum(bit, dtype=np.int32)]).astype(np.int32))
            self.zeros.append(len(s) - int(self.ones[-1][-1]))
            s = np.concatenate([s[bit == 0], s[bit == 1]])

    def rank(self, symbol: np.ndarray, *places: np.ndarray) -> list[np.ndarray]:
        """How often each symbol stands before each place."""
        lo, at = np.zeros(len(symbol), np.int64), [p.astype(np.int64) for p in places]
        for i in range(self.levels):
            one = ((symbol >> (self.levels - 1 - i)) & 1).astype(bool)
            ones, zeros = self.ones[i], self.zeros[i]
            lo, *at = [np.where(one, zeros + ones[p], p - ones[p]) for p in (lo, *at)]
        return [p - lo for p in at]


class FMIndex:
    """Backward search and location over symbols 1..top with 0 as separator; the sequence ends with 0."""

    def __init__(self, s: np.ndarray, top: int) -> None:
        order = suffixes(s)
        self.bwt = s[order - 1].astype(np.int64)
        self.tree = WaveletTree(self.bwt, top)
        self.before = np.concatenate([[0], np.cumsum(np.bincount(s, minlength=top + 1))])
        begins = np.ones(len(s), bool)
        begins[1:] = s[:-1] == 0
        kept = (order % SAMPLED == 0) | begins[order] | (s[order] == 0)
        self.kept_before = np.concatenate([[0], np.cumsum(kept)])
        self.kept, self.sample = kept, order[kept]

    def search(self, windows: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Of the windows that occur: their places in windows, and the first and last + 1 of their suffixes."""
        alive = np.arange(len(windows))
        c = windows[:, -1]
        lo, hi = self.before[c], self.before[c + 1]
        for step in range(2, windows.shape[1] + 2):
            ok = lo < hi
            alive, lo, hi = alive[ok], lo[ok], hi[ok]
            if step > windows.shape[1] or not len(alive):
                break
            c = windows[alive, -step]
            lo, hi = self.tree.rank(c, lo, hi)
            lo, hi = lo + self.before[c], hi + self.before[c]
        return alive, lo, hi

    def locate(self, rows: np.ndarray) -> np.ndarray:
        """Places in the sequence of some suffixes."""
        rows, steps, out = rows.copy(), 0, np.empty(len(rows), np.int64)
        todo = np.arange(len(rows))
        while len(todo):
            got = self.kept[rows[todo]]
            hit = todo[got]
            out[hit] = self.sample[self.kept_before[rows[hit]]] + steps
            todo = todo[~got]
            c = self.bwt[rows[todo]]
            rows[todo] = self.before[c] + self.tree.rank(c, rows[todo])[0]
            steps += 1
        return out


def find(words: w.Words, hashes: np.ndarray, phrases: Phrases) -> tuple[np.ndarray, list[set[str]]]:
    """Which words are hit, and the items found in each text."""
    n, rows = len(hashes), len(words.first) - 1
    hit, items = np.zeros(n, bool), [set() for _ in range(rows)]
    if not n or not len(phrases.vocabulary):
        return hit, items
    place = np.minimum(np.searchsorted(phrases.vocabulary, hashes), len(phrases.vocabulary) - 1)
    known = phrases.vocabulary[place] == hashes
    owner = words.owner()
    # runs of known words inside one text
    begins, ends = known.copy(), known.copy()
    begins[1:] &= ~known[:-1] | (owner[1:] != owner[:-1])
    ends[:-1] &= ~known[1:] | (owner[1:] != owner[:-1])
    b, e = np.flatnonzero(begins), np.flatnonzero(ends) + 1
    long = e - b >= phrases.shortest
    b, e = b[long], e[long]
    if not len(b):
        return hit, items
    size = e - b
    at = np.cumsum(size + 1) - (size + 1)  # each run is followed by a separator
    total = int(at[-1] + size[-1] + 1)
    word = np.full(total, -1, np.int64)
    word[np.repeat(at, size) + np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size)] = np.repeat(b, size) + np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size)
    s = np.where(word >= 0, place[word] + 1, 0)
    index = FMIndex(s, len(phrases.vocabulary))
    for k, windows in phrases.windows.items():
        which, lo, hi = index.search(windows)
        if not len(which):
            continue
        count = hi - lo
        suffix = np.repeat(lo, count) + np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count)
        start = word[index.locate(suffix)]
        hit |= w.covered(start, k, n)
        text, window = owner[start], np.repeat(which, count)
        names = phrases.items[k]
        for pair in np.unique(text * len(windows) + window).tolist():
            items[pair // len(windows)].update(names[pair % len(windows)])
    return hit, items


def blocks(benchmark: DataFrame, window: int = WINDOW, block_bytes: int = BLOCK_BYTES) -> Iterator[Phrases]:
    """The benchmark's phrases, one bounded block of items at a time."""
    rows = benchmark.where(F.col("item_id").isNotNull() & F.col("text").isNotNull()).select("item_id", "text")
    n = n_blocks(benchmark, block_bytes)
    for i in range(n):
        part = rows if n == 1 else rows.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(n)) == i)
        yield Phrases.of(sorted((str(r[0]), r[1]) for r in part.collect()), window)


def n_blocks(benchmark: DataFrame, block_bytes: int = BLOCK_BYTES) -> int:
    total = benchmark.agg(F.sum(F.when(F.col("item_id").isNotNull(), utf8_size(F.col("text"))))).head()[0] or 0
    return max(1, -(-total * 5 // (4 * block_bytes))) if total > block_bytes else 1


def _scan(data: np.ndarray, off: np.ndarray, phrases: Phrases) -> tuple[w.Words, np.ndarray, list[set[str]]]:
    words = w.Words(data, off, w.alnum(), fold=True)
    return words, *find(words, words.hashes(), phrases)


_SPAN = pa.struct([("a", pa.int64()), ("b", pa.int64())])


def _found(docs: DataFrame, benchmark: DataFrame, window: int, block_bytes: int) -> DataFrame:
    """(id, digest, spans, items) of the texts with hits, block by block: runs of hit words (first, end), which may overlap, and the items."""
    spark, picked, out = docs.sparkSession, docs.select("doc_id", "text"), None
    for phrases in blocks(benchmark, window, block_bytes):
        held = spark.sparkContext.broadcast(phrases)

        def run(batches: Iterator[pa.RecordBatch], held=held) -> Iterator[pa.RecordBatch]:
            for part, data, off in w.pieces(batches, "text"):
                words, hit, items = _scan(data, off, held.value)
                dirty = np.flatnonzero(w.per_row(hit, words.first)).tolist()
                digest = [hashlib.sha256(data[off[i] : off[i + 1]].tobytes()).digest() for i in dirty]
                runs = [[{"a": a, "b": b} for a, b in spans(hit[words.first[i] : words.first[i + 1]])] for i in dirty]
                yield pa.RecordBatch.from_arrays([part.column(0).take(pa.array(dirty, pa.int64())), pa.array(digest, pa.binary()), pa.array(runs, pa.list_(_SPAN)), pa.array([sorted(items[i]) for i in dirty], pa.list_(pa.string()))], names=["id", "digest", "spans", "items"])

        one = cut(picked.mapInArrow(run, f"id {dict(picked.dtypes)['doc_id']}, digest binary, spans array<struct<a:long,b:long>>, items array<string>"))
        held.destroy()
        out = one if out is None else out.unionByName(one)
    return out.groupBy("id", "digest").agg(F.array_sort(F.array_distinct(F.flatten(F.collect_list("spans")))).alias("spans"), F.array_sort(F.array_distinct(F.flatten(F.collect_list("items")))).alias("items"))


def _digest(text: str = "text"):
    return F.unhex(F.sha2(F.coalesce(F.col(text), F.lit("")).cast("binary"), 256))


def report(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """doc_id, n_words, n_hit, n_items, items_sha256, contaminated of every document."""
    picked = docs.select("doc_id", "text")
    if n_blocks(benchmark, block_bytes) > 1:
        return _report_of(picked, _found(docs, benchmark, window, block_bytes))
    held = docs.sparkSession.sparkContext.broadcast(next(blocks(benchmark, window, block_bytes)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, data, off in w.pieces(batches, "text"):
            words, hit, items = _scan(data, off, held.value)
            n_hit = w.per_row(hit, words.first)
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array(words.counts(), pa.int64()), pa.array(n_hit, pa.int64()), pa.array([len(x) for x in items], pa.int64()), pa.array([hashlib.sha256(",".join(sorted(x)).encode()).hexdigest() for x in items], pa.string()), pa.array(n_hit > 0)], names=["doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated"])

    return picked.mapInArrow(run, f"doc_id {dict(picked.dtypes)['doc_id']}, n_words long, n_hit long, n_items long, items_sha256 string, contaminated boolean")


def _report_of(picked: DataFrame, found: DataFrame) -> DataFrame:
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, data, off in w.pieces(batches, "text"):
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array(w.Words(data, off, w.alnum()).counts(), pa.int64()), part.column(2)], names=["doc_id", "n_words", "own"])

    whole = picked.withColumn("own", _digest()).mapInArrow(count, f"doc_id {dict(picked.dtypes)['doc_id']}, n_words long, own binary")
    zero = F.struct(F.lit(0).cast("long").alias("n"), F.lit(0).cast("long").alias("end"))
    merged = F.aggregate("spans", zero, lambda acc, s: F.struct((acc["n"] + F.greatest(s["b"] - F.greatest(s["a"], acc["end"]), F.lit(0))).alias("n"), F.greatest(acc["end"], s["b"]).alias("end")), lambda acc: acc["n"])
    out = whole.join(found.withColumn("n", merged), F.col("doc_id").eqNullSafe(F.col("id")) & (F.col("own") == F.col("digest")), "left")
    n_hit, items = F.coalesce("n", F.lit(0)).cast("long"), F.coalesce("items", F.array().cast("array<string>"))
    return out.select("doc_id", "n_words", n_hit.alias("n_hit"), F.size(items).cast("long").alias("n_items"), F.sha2(F.array_join(items, ",").cast("binary"), 256).alias("items_sha256"), (n_hit > 0).alias("contaminated"))


def spans(hit: np.ndarray) -> list[tuple[int, int]]:
    """Runs of hit words, merged."""
    edge = np.flatnonzero(np.diff(np.concatenate([[0], hit.astype(np.int8), [0]])))
    return list(zip(edge[::2].tolist(), edge[1::2].tolist(), strict=True))


def _cut(text: bytes, words: w.Words, hit: np.ndarray) -> bytes:
    out, at = [], 0
    for a, b in spans(hit):
        out.append(text[at : words.start[a]].rstrip(b" "))
        at = int(words.end[b - 1])
    return b" ".join(x for x in [*out, text[at:].lstrip(b" ")] if x)


def clean(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """docs with every removal span cut out of the text, again until none is left; texts without a word left over are dropped, others keep all else. n_chars, where present, follows the new text."""
    chars = dict(docs.dtypes).get("n_chars")
    docs, back = carried(docs, ("doc_id", "text", *(["n_chars"] if chars else [])))
    if n_blocks(benchmark, block_bytes) > 1:
        out = _clean_of(docs, benchmark, window, block_bytes)
    else:
        held = docs.sparkSession.sparkContext.broadcast(next(blocks(benchmark, window, block_bytes)))
        schema = T.StructType([*docs.schema.fields, T.StructField("emptied", T.BooleanType())])

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for part, data, off in w.pieces(batches, "text"):
                words, hit, _ = _scan(data, off, held.value)
                texts = {}
                for i in np.flatnonzero(w.per_row(hit, words.first)).tolist():
                    raw, own_hit = data[off[i] : off[i + 1]].tobytes(), np.ones(1, bool)
                    while own_hit.any():
                        own_words, own_hit, _ = _scan(np.frombuffer(raw, np.uint8), np.array([0, len(raw)]), held.value)
                        raw = _cut(raw, own_words, own_hit) if own_hit.any() else raw
                    texts[i] = raw.decode(), not len(own_words.start)
                yield _with_texts(part, texts)

        out = docs.mapInArrow(run, schema).where("not emptied")
    return back(out.withColumn("n_chars", F.length("text").cast(chars)) if chars else out)


def _with_texts(part: pa.RecordBatch, texts: dict[int, tuple[str, bool]]) -> pa.RecordBatch:
    """part with some texts replaced, and a column `emptied`."""
    place = part.schema.get_field_index("text")
    column, emptied = part.column(place), np.zeros(len(part), bool)
    if texts:
        of = column.to_pylist()
        for i, (text, empty) in texts.items():
            of[i], emptied[i] = text, empty
        column = pa.array(of, column.type)
    columns = [column if i == place else c for i, c in enumerate(part.columns)]
    return pa.RecordBatch.from_arrays([*columns, pa.array(emptied)], schema=part.schema.append(pa.field("emptied", pa.bool_())))


def _clean_of(docs: DataFrame, benchmark: DataFrame, window: int, block_bytes: int) -> DataFrame:
    """As clean, for a benchmark of several blocks: rounds of finding in all blocks and cutting, until nothing is found."""
    schema = T.StructType([*docs.schema.fields, T.StructField("spans", T.ArrayType(T.StructType([T.StructField("a", T.LongType()), T.StructField("b", T.LongType())]))), T.StructField("emptied", T.BooleanType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, data, off in w.pieces(batches, "text"):
            texts, runs = {}, part.column(part.schema.get_field_index("spans"))
            for i, found in enumerate(runs.to_pylist()):
                if found:
                    raw = data[off[i] : off[i + 1]].tobytes()
                    words = w.Words(np.frombuffer(raw, np.uint8), np.array([0, len(raw)]), w.alnum(), fold=True)
                    hit = np.zeros(len(words.start), bool)
                    for x in found:
                        hit[x["a"] : x["b"]] = True
                    texts[i] = _cut(raw, words, hit).decode(), bool(hit.all())
            yield _with_texts(part, texts)

    while True:
        found = cut(_found(docs, benchmark, window, block_bytes))
        if not found.head(1):
            return docs
        met = F.col("doc_id").eqNullSafe(F.col("id")) & (F.col("own") == F.col("digest"))
        joined = docs.withColumn("own", _digest()).join(small(found.drop("items")), met, "left").select(*docs.columns, "spans")
        docs = cut(joined.mapInArrow(run, schema).where("not emptied").drop("spans", "emptied"))
