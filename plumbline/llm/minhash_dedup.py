"""Near-duplicate groups by SuperMinHash.

Each distinct shingle draws, step by step, a rank and the next place of a random
permutation of the slots; a slot keeps the least `step + rank`. The ranks of one
element are so spread over different slots, which lowers the estimate's variance,
and no element draws again once every slot is filled (early stopping). Rows of
slots are banded; what meets in a band is verified on the full shingle sets; the
links go to union-find (`components`).

Copies with equal shingle sets are one class, known by its smallest id. In each
band's bucket all classes are first held against the smallest one. Then, in
buckets where several components are left, the pairs across components whose
signatures agree far enough (`agree`: at a similarity of 0.8 missed with
probability below 1e-8) are verified as well, inside blocks of bounded size: signatures alone
tell which classes have a partner, and only those are sent their shingle sets. So no
link between different texts is lost but by the bands: a pair at the threshold
shares none of 28 bands of 4 with probability (1 - 0.8^4)^28 = 4e-7.

Defined results: null or wordless texts have the empty set and link with nothing;
texts of fewer words than a shingle are one shingle; rows of one id are one node;
rows with null id link with nothing and are kept; no documents give no rows;
texts are read whole, however long; columns
besides doc_id and text, whatever their names, are carried by `keep`, else not read. Shingles are
compared by 64-bit fingerprints (48 bits inside blocks), classes by 128 bits and their size.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import words as w
from .components import components
from .shared import carried, cut, row_hash

U = w.U


@dataclass(frozen=True)
class Settings:
    shingle: int = 4
    percent: int = 80
    bands: int = 28
    rows: int = 4
    agree: int = 64  # of the slots
    block: int = 256  # classes compared at once

    @property
    def slots(self) -> int:
        return self.bands * self.rows


def shingles(words: w.Words, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Row and fingerprint of every distinct shingle of each text, by row and fingerprint."""
    h, first, n = words.hashes(), words.first, len(words.start)
    owner, ok = words.owner(), np.flatnonzero(w.inside(first, k, n))
    rows, values = [owner[ok]], [w.grams(h, k)[ok]]
    count = np.diff(first)
    for short in range(1, k):
        at = np.flatnonzero(count == short)
        rows.append(at)
        values.append(w.grams(h, short)[first[:-1][at]])
    row, value = np.concatenate(rows), np.concatenate(values)
    order = np.argsort(value)
    order = order[np.argsort(row[order].astype(np.uint16), kind="stable")]
    row, value = row[order], value[order]
    new = np.ones(len(row), bool)
    new[1:] = (row[1:] != row[:-1]) | (value[1:] != value[:-1])
    return row[new], value[new]


def superminhash(row: np.ndarray, value: np.ndarray, n_rows: int, m: int) -> np.ndarray:
    """The signatures of some sets: an n_rows x m table of `step * 2^48 + rank`. row: ascending; rows without an element keep the largest value."""
    empty = np.iinfo(U).max
    out = np.full(n_rows * m, empty, U)

    def draw(value: np.ndarray, step: int) -> tuple[np.ndarray, np.ndarray]:
        a = w.mix(value + U(0x9E3779B97F4A7C15 * (2 * step + 1) & (2**64 - 1)))
        swap = step + (((a >> U(32)) * U(m - step)) >> U(32)).astype(np.int64)
        return swap, (U(step) << U(48)) | (w.mix(a) >> U(16))

    swap0, rank = draw(value, 0)
    np.minimum.at(out, row * m + swap0, rank)
    open_ = (out.reshape(n_rows, m) == empty).any(axis=1)
    first = np.searchsorted(row, np.arange(n_rows + 1))
    open_ &= np.diff(first) > 0
    todo = np.flatnonzero(open_)
    # the permutations of the elements of still open rows, in groups of bounded size
    size, at = np.diff(first)[todo], 0
    while at < len(todo):
        total, end = 0, at
        while end < len(todo) and (end == at or total + size[end] <= 1 << 16):
            total += size[end]
            end += 1
        rows = todo[at:end]
        e = np.repeat(first[rows], size[at:end]) + np.arange(total) - np.repeat(np.cumsum(size[at:end]) - size[at:end], size[at:end])
        r, v = row[e], value[e]
        p = np.tile(np.arange(m, dtype=np.uint16), (len(e), 1))
        i = np.arange(len(e))
        p[i, swap0[e]] = 0
        p[i, 0] = swap0[e]
        for step in range(1, m):
            live = np.zeros(n_rows, bool)
            live[rows] = (out.reshape(n_rows, m)[rows] == empty).any(axis=1)
            k = np.flatnonzero(live[r])
            if not len(k):
                break
            swap, rank = draw(v[k], step)
            slot = p[k, swap].copy()
            p[k, swap] = p[k, step]
            p[k, step] = slot
            np.minimum.at(out, r[k] * m + slot, rank)
        at = end
    return out.reshape(n_rows, m)


def band_keys(signature: np.ndarray, settings: Settings) -> np.ndarray:
    out = np.zeros((len(signature), settings.bands), U)
    parts = signature.reshape(len(signature), settings.bands, settings.rows)
    for j in range(settings.rows):
        out = w.mix(out + parts[:, :, j])
    return w.mix(out + np.arange(settings.bands, dtype=U)).astype(np.int64)


def set_hashes(row: np.ndarray, value: np.ndarray, n_rows: int) -> list[bytes | None]:
    """What a class is known by: two sums over its shingles and their number; None for the empty set."""
    n = np.bincount(row, minlength=n_rows)
    first = np.searchsorted(row, np.arange(n_rows + 1))
    sums = []
    for salt in (1, 2):
        total = np.concatenate([np.zeros(1, U), np.cumsum(w.mix(value ^ w.mix(np.full(1, salt, U))))])
        sums.append(total[first[1:]] - total[first[:-1]])
    digest = np.stack([*sums, n.astype(U)], axis=1)
    return [d.tobytes() if c else None for d, c in zip(digest, n, strict=True)]


def sketch(docs: DataFrame, settings: Settings) -> DataFrame:
    """doc_id, n_shingles, set_hash (null for the empty set), bands, low (a byte of each slot)."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, data, off in w.pieces(batches, "text"):
            row, value = shingles(w.Words(data, off, w.spaced(), fold=True), settings.shingle)
            n = np.bincount(row, minlength=len(part))
            signature = superminhash(row, value, len(part), settings.slots)
            keys, low = band_keys(signature, settings), w.mix(signature).astype(np.uint8)
            yield pa.RecordBatch.from_arrays([
                part.column(0), pa.array(n, pa.int64()),
                pa.array(set_hashes(row, value, len(part)), pa.binary()),
                pa.ListArray.from_arrays(pa.array(np.arange(len(part) + 1, dtype=np.int32) * settings.bands), pa.array(keys.ravel())),
                pa.array([x.tobytes() for x in low], pa.binary()),
            ], names=["doc_id", "n_shingles", "set_hash", "bands", "low"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "doc_id long, n_shingles long, set_hash binary, bands array<long>, low binary")


def _verify(pairs: DataFrame, texts: DataFrame, settings: Settings) -> DataFrame:
    """The pairs (a, b) whose full shingle sets are similar enough. texts: (id, text), one row an id."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, data, off in w.pieces(batches, "text_a", 1 << 20):
            sides = [shingles(w.Words(data, off, w.spaced(), fold=True), settings.shingle), shingles(w.Words(*w.flat(part.column(3)), w.spaced(), fold=True), settings.shingle)]
            row, value = np.concatenate([s[0] for s in sides]), np.concatenate([s[1] for s in sides])
            order = np.argsort(value)
            order = order[np.argsort(row[order].astype(np.uint16), kind="stable")]
            row, value = row[order], value[order]
            both = np.bincount(row[1:][(row[1:] == row[:-1]) & (value[1:] == value[:-1])], minlength=len(part))
            union = np.bincount(row, minlength=len(part)) - both
            ok = pa.array((100 * both >= settings.percent * union) & (union > 0))
            yield pa.RecordBatch.from_arrays([part.column(0).filter(ok), part.column(1).filter(ok)], names=["a", "b"])

    t = texts.select(F.col("id").alias("ia"), F.col("text").alias("text_a"))
    joined = pairs.join(t, F.col("a") == F.col("ia")).drop("ia")
    t = texts.select(F.col("id").alias("ib"), F.col("text").alias("text_b"))
    return joined.join(t, F.col("b") == F.col("ib")).select("a", "b", "text_a", "text_b").mapInArrow(run, "a long, b long")


def _texts(docs: DataFrame, pairs: DataFrame, n: int) -> DataFrame:
    """The text of each class in the pairs, n at most."""
    wanted = pairs.select(F.explode(F.array("a", "b")).alias("id")).distinct()
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return cut(rows.join(wanted.hint("shuffle_hash"), rows["doc_id"] == wanted["id"]).select("id", "text"), n, 20_000)


def _prints(texts: DataFrame, settings: Settings) -> DataFrame:
    """(set_hash, prints): each shingle set of the texts, 6 bytes of each fingerprint in order. By set, not id: an id may have several texts."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, data, off in w.pieces(batches, "text"):
            row, value = shingles(w.Words(data, off, w.spaced(), fold=True), settings.shingle)
            raw = (value >> U(16)).view(np.uint8).reshape(-1, 8)[:, :6]
            first = np.searchsorted(row, np.arange(len(part) + 1))
            yield pa.RecordBatch.from_arrays([pa.array(set_hashes(row, value, len(part)), pa.binary()), pa.array([raw[first[i] : first[i + 1]].tobytes() for i in range(len(part))], pa.binary())], names=["set_hash", "prints"])

    return texts.select("id", "text").mapInArrow(run, "set_hash binary, prints binary").where("set_hash is not null").dropDuplicates(["set_hash"])


def _unpack(raw: bytes) -> np.ndarray:
    out = np.zeros((len(raw) // 6, 8), np.uint8)
    out[:, :6] = np.frombuffer(raw, np.uint8).reshape(-1, 6)
    return out.view(U).ravel()


_CLASS = "key long, i int, j int, own int, id long, set_hash binary, part long, low binary, bands array<long>"


def _groups(batches: Iterator[pa.RecordBatch], keys: int) -> Iterator[pa.RecordBatch]:
    """The runs of rows with equal first columns, whole, from batches that are sorted by them."""
    held: list[pa.RecordBatch] = []
    last = None
    for batch in batches:
        if not len(batch):
            continue
        k = np.stack([batch.column(c).to_numpy() for c in range(keys)], axis=1)
        starts = [0, *(np.flatnonzero((k[1:] != k[:-1]).any(axis=1)) + 1).tolist(), len(batch)]
        for lo, hi in zip(starts, starts[1:], strict=False):
            name = tuple(k[lo].tolist())
            if name != last and held:
                yield pa.concat_batches(held)
                held = []
            last = name
            held.append(batch.slice(lo, hi - lo))
    if held:
        yield pa.concat_batches(held)


class _Block:
    """The classes of a pair of blocks of one bucket, in the order of id and set_hash."""

    def __init__(self, rows: pa.RecordBatch, settings: Settings) -> None:
        self.settings, self.n = settings, len(rows)
        key, i, j, self.own, self.ids = (rows.column(c).to_numpy() for c in range(5))
        self.low = w.flat(rows.column(7))[0].reshape(self.n, settings.slots)
        bands = rows.column(8).flatten().to_numpy().reshape(self.n, settings.bands)
        here = int(np.flatnonzero(bands[0] == key[0])[0])
        self.before, self.one = bands[:, :here], i[0] == j[0]
        _, self.part = np.unique(rows.column(6).to_numpy(), return_inverse=True)

    def partners(self) -> Iterator[tuple[int, np.ndarray]]:
        """Each class with the later classes of other components whose slots agree far enough and that share no earlier band, so that a pair is looked at once."""
        for lo in range(0, self.n, 32):
            at = np.arange(lo, min(self.n, lo + 32))
            ok = (self.part[at, None] != self.part[None]) & (np.arange(self.n)[None] > at[:, None])
            if not self.one:
                ok &= self.own[at, None] != self.own[None]
            if ok.any():
                ok &= (self.low[at, None] == self.low[None]).sum(axis=2, dtype=np.int16) >= self.settings.agree
            if ok.any():
                x, y = np.nonzero(ok)
                ok[x, y] = ~(self.before[at[x]] == self.before[y]).any(axis=1)
                for k in np.flatnonzero(ok.any(axis=1)).tolist():
                    yield int(at[k]), np.flatnonzero(ok[k])


def _dealt(rows: DataFrame) -> DataFrame:
    """rows by pairs of blocks, each pair's together and in order. Not fewer partitions for few bytes: comparing takes time, not space."""
    n = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return rows.repartition(n, "key", "i", "j").sortWithinPartitions("key", "i", "j", "id", "set_hash")


def _candidates(members: DataFrame, settings: Settings) -> DataFrame:
    """The classes of each pair of blocks that have a partner in it, told by signatures alone.

    members: key, id, set_hash, part (its component), low, bands, n (classes
    in the bucket); classes of one id are one component. A bucket is dealt as pairs of blocks of about `block` classes."""
    blocks = F.ceil(F.col("n") / settings.block).cast("int")
    own_block = F.pmod(F.xxhash64("set_hash"), blocks).cast("int")
    rest = ("id", "set_hash", "part", "low", "bands")
    dealt = members.withColumn("own", own_block).select("key", *rest, "own", F.explode(F.sequence(F.lit(0), blocks - 1)).alias("other"))
    dealt = dealt.select("key", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), "own", *rest)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in _groups(batches, 3):
            found = np.zeros(len(rows), bool)
            for x, y in _Block(rows, settings).partners():
                found[x] = True
                found[y] = True
            if found.any():
                yield rows.filter(pa.array(found))

    return _dealt(dealt).mapInArrow(run, _CLASS)


def _across(members: DataFrame, texts: DataFrame, settings: Settings, most: int) -> DataFrame:
    """Links between classes of one bucket and different components.

    Only classes with a partner (`_candidates`) are sent their shingle sets, from the texts (id, text). Inside a pair of blocks the
    partners are held on their full sets; links that tie what earlier ones have tied are not returned, so rows are no more than
    the block's classes. most: about as many members."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in _groups(batches, 3):
            of, sets, out = _Block(rows, settings), {}, []
            prints, part = rows.column(9), of.part

            def full(x: int) -> np.ndarray:
                if x not in sets:
                    sets[x] = _unpack(prints[x].as_py())  # noqa: B023
                return sets[x]  # noqa: B023

            for x, near in of.partners():
                for z in near.tolist():
                    if part[z] == part[x]:
                        continue
                    a, b = full(x), full(z)
                    if 100 * min(len(a), len(b)) < settings.percent * max(len(a), len(b)):
                        continue
                    both = len(a) + len(b) - len(np.unique(np.concatenate([a, b])))
                    if 100 * both >= settings.percent * (len(a) + len(b) - both):
                        out.append((of.ids[x], of.ids[z]))
                        part[part == part[z]] = part[x]
            if out:
                yield pa.RecordBatch.from_arrays([pa.array([o[k] for o in out], pa.int64()) for k in range(2)], names=["a", "b"])

    found = cut(_candidates(members, settings), most, 100_000, deal=True)
    prints = _prints(texts.join(found.select("id").distinct(), "id", "left_semi"), settings)
    with_sets = found.join(prints, "set_hash").select("key", "i", "j", "own", "id", "set_hash", "part", "low", "bands", "prints")
    return _dealt(with_sets).mapInArrow(run, "a long, b long").distinct()


def group(docs: DataFrame, settings: Settings | None = None) -> DataFrame:
    """doc_id, n_shingles, component_id, kept of every document."""
    settings = settings or Settings()
    sketches = cut(sketch(docs, settings))
    n = sketches.count()
    classes = cut(sketches.where("set_hash is not null and doc_id is not null").groupBy("set_hash").agg(F.min("doc_id").alias("id"), F.first("bands").alias("bands"), F.first("low").alias("low")), n, 100_000)
    banded = classes.select(F.explode("bands").alias("key"), "id")
    buckets = banded.groupBy("key").agg(F.min("id").alias("a"), F.max("id").alias("last"), F.count("*").alias("n")).where("a < last")
    met = cut(banded.join(buckets, "key").select("key", "a", F.col("id").alias("b"), "n"), settings.bands * n)
    pairs = met.where("a <> b").select("a", "b").distinct()
    texts = _texts(docs, pairs, n)
    links = cut(_verify(pairs, texts, settings), settings.bands * n, deal=True)
    # several rows of one id may differ in text; they are one node all the same
    same = sketches.where("set_hash is not null and doc_id is not null").join(classes.select("set_hash", F.col("id").alias("b")), "set_hash").select(F.col("doc_id").alias("a"), "b").where("a <> b")
    parts = components(links)

    in_bucket = met.select("key", F.col("b").alias("id"), "n")
    labelled = in_bucket.join(parts, in_bucket["id"] == parts["node"], "left").select("key", "id", "n", F.coalesce("component", "id").alias("part"))
    mixed = labelled.groupBy("key").agg(F.min("part").alias("p"), F.max("part").alias("q")).where("p < q").select("key")
    members = labelled.join(mixed, "key", "left_semi").dropDuplicates(["key", "id"])
    # several classes may have one id; those of a bucket have its key among their bands
    of_bucket = members.join(classes.select("id", "set_hash", "low", "bands"), "id").where("array_contains(bands, key)")
    more = cut(_across(of_bucket, texts, settings, settings.bands * n), settings.bands * n)
    if more.head(1):
        links = links.union(more)
        parts = components(links)
    # of class representatives to all ids; ids that stand in several classes tie them
    ids = sketches.where("set_hash is not null and doc_id is not null").groupBy("doc_id").agg(F.min("set_hash").alias("x"), F.max("set_hash").alias("y"))
    if ids.where("x <> y").head(1):
        parts = components(links.union(same))
    of_class = classes.join(parts, classes["id"] == parts["node"], "left").select("set_hash", F.coalesce("component", "id").alias("component"))
    out = sketches.select("doc_id", "n_shingles", "set_hash").join(of_class, "set_hash", "left")
    component = F.when(F.col("doc_id").isNotNull(), F.coalesce("component", "doc_id"))
    return out.select("doc_id", "n_shingles", component.alias("component_id"), F.coalesce(F.col("doc_id") == component, F.lit(True)).alias("kept"))


def keep(docs: DataFrame, settings: Settings | None = None) -> DataFrame:
    """One document of each group, that of the smallest id, with the columns of docs; of several rows of an id the one whose text has the least MD5, then the least hash of the row."""
    docs, back = carried(docs, ("doc_id", "text"))
    judged = cut(group(docs, settings))
    gone = judged.where(~F.col("kept")).select(F.col("doc_id").alias("gone")).distinct()
    left = docs.join(gone, docs["doc_id"].cast("long") == gone["gone"], "left_anti")
    again = judged.where("doc_id is not null and kept").groupBy("doc_id").count().where("count > 1").select(F.col("doc_id").alias("again"))
    if again.head(1):
        order = Window.partitionBy("doc_id").orderBy(F.md5(F.coalesce(F.col("text"), F.lit("")).cast("binary")), row_hash(docs))
        is_again = docs["doc_id"].cast("long") == again["again"]
        first = left.join(again, is_again, "left_semi").withColumn("nth", F.row_number().over(order)).where("nth = 1").drop("nth")
        left = left.join(again, is_again, "left_anti").unionByName(first)
    return back(left)
