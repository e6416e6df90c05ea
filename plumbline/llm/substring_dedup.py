"""Substring deduplication by relative Lempel-Ziv parsing.

Reference: every document of a smaller id. Its indexed reference blocks are word sequences
at content-chosen places: the least fingerprint among the half-window sequences
inside a window is that window's anchor, so equal windows have equal anchors wherever
they stand, and about one place in thirteen is an anchor. The block of an anchor
(its stretch) is all the words of the windows that it answers for, 50 to 75 of them, and
is indexed under its fingerprint with the smallest document that holds it and its place there.

A document is factored against that index. Its blocks that stand in a smaller
document are copies; where only the anchor is shared, a copy begins or ends inside the
block, and its single windows are looked up instead (boundary check). Copies from one
document at one distance are extended into each other (`matches`): each is a
maximal run of words that the index knows from one source. The parse (`factors`) then goes
through the document from its first word and always takes, of the matches
that cover the next word, the one that reaches farthest, as a factor (source, place there,
length); words that none covers are literals. A factor cut short by the one before it is
checked at that boundary: with the words before it, it is still a copy of a window or more.
The words of the factors are the duplicate spans.

The index names one source for a block, the smallest document; a long copy of a later
document is thus several factors where an earlier one shares parts of it. This changes
sources and factor lengths, never which words are covered.

All of it is minima per fingerprint, combined before they are dealt, and joins
that spread hot keys (`spread_join`); documents without a shared block are only scanned.

Defined results: words are `[^\\x20\\x09-\\x0D]+`, unchanged; null and wordless texts
have none; texts are parsed whole, however long; a word goes if a window over it also starts in a document with a
smaller id; windows are judged on the input; rows of one id never count against
each other (rows of one id and different texts are told apart by 31 bits); rows with null id neither
lose words nor count; repeated rows each get a row; no documents give no rows; extra columns, whatever their
names, are carried by `remove`, else not read. Blocks and windows are compared by 128 bits (anchor and stretch, or two
window fingerprints).
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import words as w
from .shared import carried, cut, spread_join

U = w.U
WINDOW = 50
#: Windows whose anchors are chosen at once; places in such a part fit in 24 bits.
_PART = 1 << 22
#: Bits of a place; above them stand those that tell the rows of one id apart.
_BITS = 32
_MATCH = "array<struct<at:long,source:long,place:long>>"


class Anchors:
    """The anchors of some texts: their places, and the first and last window that each answers for."""

    def __init__(self, words: w.Words, h: np.ndarray, window: int) -> None:
        block = window // 2
        self.block, self.window = block, window
        n = len(h)
        self.grams = w.grams(h, block)
        ok = np.flatnonzero(w.inside(words.first, window, n))
        inside = window - block + 1
        place = np.empty(len(ok), np.int64)
        if len(ok):
            low = self.grams & ~U((1 << 24) - 1)
            chosen = np.empty(n - window + 1, np.int64)
            for a in range(0, n - window + 1, _PART):
                b = min(n - window + 1, a + _PART)
                x = low[a : b + inside - 1] | np.arange(b + inside - 1 - a, dtype=U)
                size = 1
                while size * 2 <= inside:
                    x = np.minimum(x[:-size], x[size:])
                    size *= 2
                if inside > size:
                    x = np.minimum(x[: len(x) - (inside - size)], x[inside - size :])
                chosen[a:b] = (x & U((1 << 24) - 1)).astype(np.int64) + a
            place = chosen[ok]
        new = np.ones(len(ok), bool)
        new[1:] = place[1:] != place[:-1]  # windows of one anchor follow one another
        begin = np.flatnonzero(new)
        self.place, self.first = place[begin], ok[begin]
        self.last = ok[np.append(begin[1:], len(ok)) - 1] if len(ok) else ok
        self.row = words.owner()[self.first] if len(ok) else self.first

    def stretches(self, h: np.ndarray) -> np.ndarray:
        """A fingerprint of the words of each anchor's windows, of their number, and of the anchor's place in them."""
        out = np.zeros(len(self.place), U)
        x = w.mix(h ^ U(0x5851F42D4C957F2D))
        step = 1 << 14
        for a in range(0, len(out), step):
            lo, hi = self.first[a : a + step], self.last[a : a + step] + self.window
            base, top = int(lo[0]), int(hi.max())
            total = np.zeros(top - base + 1, U)
            np.cumsum(x[base:top] * w._SPOW.upto(top - base), out=total[1:])
            out[a : a + step] = (total[hi - base] - total[lo - base]) * w._SINV.upto(top - base)[lo - base]
        return w.mix(out + w.mix(((self.last - self.first) << 20 | (self.place - self.first)).astype(U)))


def _tag(raw: bytes) -> int:
    """31 bits that tell rows of one id apart."""
    return int.from_bytes(hashlib.blake2b(raw, digest_size=4).digest(), "big") >> 1


def _tags(data: np.ndarray, off: np.ndarray) -> np.ndarray:
    return np.array([_tag(data[off[i] : off[i + 1]].tobytes()) for i in range(len(off) - 1)], np.int64)


def anchors(docs: DataFrame, window: int) -> DataFrame:
    """(a, s, doc_id, place) of every anchor: anchor and stretch fingerprints; place: the row's tag, then the number of the anchor's first word."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, data, off in w.pieces(batches, "text"):
            words = w.Words(data, off, w.spaced())
            h = words.hashes()
            of = Anchors(words, h, window)
            ids = part.column(0).to_numpy(zero_copy_only=False)
            place = (_tags(data, off)[of.row] << _BITS) | (of.place - words.first[of.row])
            yield pa.RecordBatch.from_arrays([pa.array(of.grams[of.place].astype(np.int64)), pa.array(of.stretches(h).astype(np.int64)), pa.array(ids[of.row].astype(np.int64)), pa.array(place)], names=["a", "s", "doc_id", "place"])

    picked = docs.where("doc_id is not null and text is not null").select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return picked.mapInArrow(run, "a long, s long, doc_id long, place long")


def _boundary_windows(listed: DataFrame, window: int) -> DataFrame:
    """(x, y, doc_id, place) of each window whose anchor is in the list `check`: two fingerprints of its words."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, data, off in w.pieces(batches, "text"):
            words = w.Words(data, off, w.spaced())
            h = words.hashes()
            of = Anchors(words, h, window)
            first, tags = words.first, part.column(1).to_numpy()
            column = part.column(part.schema.get_field_index("check"))
            wanted = column.flatten().to_numpy(zero_copy_only=False).astype(np.int64) + first[_rows(column)]
            pick = np.flatnonzero(np.isin(of.place, wanted))
            size = (of.last - of.first + 1)[pick]
            start = np.repeat(of.first[pick], size) + np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size)
            row = np.repeat(of.row[pick], size)
            x, y = (w.grams(h, window, salt)[start].astype(np.int64) if len(start) else np.zeros(0, np.int64) for salt in (11, 23))
            yield pa.RecordBatch.from_arrays([pa.array(x), pa.array(y), pa.array(part.column(0).to_numpy()[row]), pa.array((tags[row] << _BITS) | (start - first[row]))], names=["x", "y", "doc_id", "place"])

    return listed.where(F.size("check") > 0).select("doc_id", "tag", "text", "check").mapInArrow(run, "x long, y long, doc_id long, place long")


def _rows(column: pa.ListArray) -> np.ndarray:
    """The row of each value of a list column."""
    return np.repeat(np.arange(len(column)), np.diff(column.offsets.to_numpy()))


def matches(start: np.ndarray, size: np.ndarray, source: np.ndarray, place: np.ndarray) -> list[tuple[int, int, int, int]]:
    """(first word, end, source, place there) of the maximal copies: pieces of one source at one distance that touch are one."""
    out: list[tuple[int, int, int, int]] = []
    distance = place - start
    for i in np.lexsort((start, distance, source)).tolist():
        a, b = int(start[i]), int(start[i] + size[i])
        if out and out[-1][2] == source[i] and out[-1][3] - out[-1][0] == distance[i] and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(b, out[-1][1]), *out[-1][2:])
        else:
            out.append((a, b, int(source[i]), int(place[i])))
    return sorted(out)


def factors(found: list[tuple[int, int, int, int]]) -> list[tuple[int, int, int, int]]:
    """The greedy parse, without its literals: (first word, length, source, place there). found: as `matches` gives them."""
    out, at, best, i = [], 0, (0, 0, 0, 0), 0
    while True:
        while i < len(found) and found[i][0] <= at:
            best = max(best, found[i], key=lambda m: m[1])
            i += 1
        if best[1] > at:
            out.append((at, best[1] - at, best[2], best[3] + at - best[0]))
            at = best[1]
        elif i < len(found):
            at = found[i][0]
        else:
            return out


def _parse(listed: DataFrame, window: int, into: str = "sha") -> DataFrame:
    """The greedy parse of listed texts from their copied blocks (`copied`) and windows (`windows`). into: sha or text of what is left, or the factors."""
    kind = "array<struct<start:long,length:long,source:long,place:long>>" if into == "factors" else "string"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, data, off in w.pieces(batches, "text"):
            words = w.Words(data, off, w.spaced())
            n, first = len(words.start), words.first
            of = Anchors(words, words.hashes(), window)
            pieces = []
            for name in ("copied", "windows"):
                column = part.column(part.schema.get_field_index(name))
                flat, row = column.flatten(), _rows(column)
                at, source, place = (flat.field(k).to_numpy(zero_copy_only=False).astype(np.int64) for k in range(3))
                at, size = at + first[row], np.full(len(at), window)
                if name == "copied":  # from the anchor to its whole block
                    block = np.searchsorted(of.place, at)
                    shift = at - of.first[block]
                    at, place, size = at - shift, place - shift, of.last[block] - of.first[block] + window
                pieces.append((row, at, size, source, place))
            row, at, size, source, place = (np.concatenate(x) for x in zip(*pieces, strict=True))
            order = np.argsort(row, kind="stable")
            bounds = np.searchsorted(row[order], np.arange(len(part) + 1))
            gone, kept = np.zeros(n, bool), []
            for i in range(len(part)):
                of_row = order[bounds[i] : bounds[i + 1]]
                parsed = factors(matches(at[of_row], size[of_row], source[of_row], place[of_row]))
                for a, length, *_ in parsed:
                    gone[a : a + length] = True
                if into == "factors":
                    kept.append([{"start": a - int(first[i]), "length": k, "source": s, "place": p} for a, k, s, p in parsed])
                    continue
                left = np.flatnonzero(~gone[first[i] : first[i + 1]]) + first[i]
                kept.append(_rest(words, data, off, i, left) if into == "text" else hashlib.sha256(b" ".join(words.text(j) for j in left.tolist())).hexdigest())
            type_ = pa.list_(pa.struct([(k, pa.int64()) for k in ("start", "length", "source", "place")])) if into == "factors" else pa.string()
            yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(w.per_row(gone, first), pa.int64()), pa.array(kept, type_)], names=["doc_id", "tag", "n_removed", "kept"])

    return listed.select("doc_id", "tag", "text", "copied", "windows").mapInArrow(run, f"doc_id long, tag long, n_removed long, kept {kind}")


def _rest(words: w.Words, data: np.ndarray, off: np.ndarray, i: int, left: np.ndarray) -> str:
    """What is left of a text: the kept words, and the white space before each of them that follows a kept one; one space at the seams."""
    out, previous = [], None
    for j in left.tolist():
        a = int(words.start[j])
        if previous == j - 1:
            a = int(words.end[j - 1])
        elif previous is not None:
            out.append(b" ")
        out.append(data[a : words.end[j]].tobytes())
        previous = j
    return b"".join(out).decode()


def _resolved(docs: DataFrame, window: int, into: str = "sha") -> DataFrame:
    """(doc_id, tag, n_removed, kept) of the documents that may lose words, as `_parse` gives them."""
    mask = F.lit((1 << _BITS) - 1)
    at, tag = F.col("place").bitwiseAND(mask), F.shiftright("place", _BITS)
    there = F.col("source_place").bitwiseAND(mask)
    all_ = anchors(docs, window)
    least = [F.min("doc_id").alias("source"), F.min_by("place", "doc_id").alias("source_place")]
    shared = all_.groupBy("a").agg(*least, F.max("doc_id").alias("high"), F.min("s").alias("s0"), F.max("s").alias("s1"), F.count("*").alias("n"))
    shared = cut(shared.where("source < high").select("a", "source", "source_place", (F.col("s0") != F.col("s1")).alias("mixed"), "n"))
    total = shared.agg(F.sum("n")).head()[0] or 0
    met = cut(spread_join(all_, shared, ["a"], "n"), total)
    # of an anchor with several blocks, the least document of each block
    blocks = cut(met.where("mixed").groupBy("a", "s").agg(*least, F.count("*").alias("n")), total)
    mixed = spread_join(met.where("mixed").drop("source", "source_place"), blocks, ["a", "s"], "n")
    known = met.where("not mixed and doc_id > source")
    copy = F.struct(at.alias("at"), "source", there.alias("place"))
    found = mixed.select("doc_id", "place", "source", "source_place").unionByName(known.select("doc_id", "place", "source", "source_place"))
    copied = F.col("doc_id") > F.col("source")
    lists = found.groupBy(F.col("doc_id").alias("list_id"), tag.alias("tag")).agg(F.collect_list(F.when(copied, copy)).cast(_MATCH).alias("copied"), F.collect_list(F.when(~copied, at)).alias("check"))

    def tagged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, data, off in w.pieces(batches, "text"):
            yield pa.RecordBatch.from_arrays([*part.columns, pa.array(_tags(data, off))], names=["doc_id", "text", "own_tag"])

    picked = docs.where("doc_id is not null and text is not null").select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(tagged, "doc_id long, text string, own_tag long")
    lists = lists.hint("shuffle_hash")
    listed = cut(picked.join(lists, (F.col("doc_id") == F.col("list_id")) & (F.col("own_tag") == F.col("tag"))).select("doc_id", "tag", "text", "copied", "check"))
    windows = cut(_boundary_windows(listed, window))
    first = cut(windows.groupBy("x", "y").agg(*least, F.max("doc_id").alias("high"), F.count("*").alias("n")).where("source < high").drop("high"))
    double = spread_join(windows, first, ["x", "y"], "n").where("doc_id > source").groupBy(F.col("doc_id").alias("wid"), tag.alias("wtag")).agg(F.collect_list(copy).cast(_MATCH).alias("windows"))
    none = F.array().cast(_MATCH)
    # texts without a list to check are not moved again
    plain = listed.where((F.size("check") == 0) & (F.size("copied") > 0)).withColumn("windows", none)
    both = listed.where(F.size("check") > 0).join(double, (F.col("doc_id") == F.col("wid")) & (F.col("tag") == F.col("wtag")), "left").where((F.size("copied") > 0) | F.col("windows").isNotNull())
    columns = ["doc_id", "tag", "text", "copied"]
    both = both.select(*columns, F.coalesce("windows", none).alias("windows"))
    return _parse(plain.select(*columns, "windows").unionByName(both), window, into)


def parse(docs: DataFrame, window: int = WINDOW) -> DataFrame:
    """(doc_id, start, length, source, place) of every factor: so many words of the document, from word `start` on, stand in document `source` from word `place` on."""
    out = _resolved(docs, window, "factors").dropDuplicates(["doc_id", "tag"])
    return out.select("doc_id", F.explode("kept").alias("f")).select("doc_id", "f.*")


def dedup_spans(docs: DataFrame, window: int = WINDOW) -> DataFrame:
    """doc_id, n_words, n_removed, kept_sha256 of every document."""
    resolved = cut(_resolved(docs, window)).dropDuplicates(["doc_id", "tag"]).withColumnsRenamed({"doc_id": "rid", "tag": "rtag"})

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n, sha, tags = [], [], []
            for t in batch.column(1):
                raw = (t.as_py() or "").encode()
                own_words = raw.split()  # at the six bytes of white space
                n.append(len(own_words))
                sha.append(hashlib.sha256(b" ".join(own_words)).hexdigest())
                tags.append(_tag(raw))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n, pa.int64()), pa.array(sha, pa.string()), pa.array(tags, pa.int64())], names=["doc_id", "n_words", "sha", "own_tag"])

    whole = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "doc_id long, n_words long, sha string, own_tag long")
    out = whole.join(resolved, (F.col("doc_id") == F.col("rid")) & (F.col("own_tag") == F.col("rtag")), "left")
    return out.select("doc_id", "n_words", F.coalesce("n_removed", F.lit(0)).cast("long").alias("n_removed"), F.coalesce("kept", "sha").alias("kept_sha256"))


def remove(docs: DataFrame, window: int = WINDOW) -> DataFrame:
    """docs with duplicate spans cut out of the texts; other texts and all other columns stay as they are."""
    docs, back = carried(docs, ("doc_id", "text"))
    resolved = cut(_resolved(docs, window, "text")).dropDuplicates(["doc_id", "tag"]).select(F.col("doc_id").alias("rid"), "tag", "kept")
    schema = T.StructType([*docs.schema.fields, T.StructField("own_tag", T.LongType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, data, off in w.pieces(batches, "text"):
            yield pa.RecordBatch.from_arrays([*part.columns, pa.array(_tags(data, off))], schema=part.schema.append(pa.field("own_tag", pa.int64())))

    out = docs.mapInArrow(run, schema).join(resolved, (F.col("doc_id").cast("long") == F.col("rid")) & (F.col("own_tag") == F.col("tag")), "left")
    return back(out.withColumn("text", F.coalesce("kept", "text")))
