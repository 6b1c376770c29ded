"""Suffix-array dedup of byte strings by bucket-pointer refinement.

Every start of an ``n``-byte string gets a bucket identifier that is refined by
doubling: the 8-byte prefix is its own bucket, and the identifier for 2m bytes
combines the identifiers for m bytes at the start and m bytes later, each
level reusing the one before (8, 16, 32, 64 bytes; longer ones from overlapping
buckets).  Identifiers are numbers computed from those below, so equal strings get
equal identifiers in every task without a rank exchange.

Starts are refined only as far as needed, always by the same step on ranges of starts:

1.  Initial buckets.  A start belongs to the bucket of the q-gram with the
    smallest identifier among the q-grams of its string (a property of the string
    alone).  Neighbouring starts with the same q-gram form a range, so the corpus
    shuffles one short row per range, about one for 70 bytes.
2.  Ranges left over are cut where their starts' distance to the q-gram passes a multiple of
    ``CUT``; all starts of a piece share the bytes between its ends, whose identifier
    refines the bucket.
3.  Pieces left over fall into single starts, with their ``n``-byte identifiers.

At each step a bucket with one range is done: none of its starts occurs anywhere
else.  Ranges of a bucket that are equal as a whole (identifiers of the first and last
start, and the length) are done too: all their starts repeat.  What is left goes on,
with one copy of each repeated range beside it.  Bytes travel only with ranges left after step 1.

Bucket sizes are counts (combined map-side); hot buckets are joins whose
rows adaptive execution splits.  Nothing is gathered by bucket.
Identifiers have 64 bits and are compared only inside one 64-bit bucket.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from noteflare.llm.common import arrow_stage, drop_scratch, scratch_table, with_fields
from noteflare.operators.joins import dimension

LENGTH = 200
CUT = 17
CHUNK = 1 << 20  # starts refined at once; bounds memory on very long texts
_A, _B, _C = (np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0xD6E8FEB86659FD93))
_S = np.uint64(32)


def _pair(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Identifier of the bucket named by two identifiers."""
    x = a * _A + (b ^ (b >> _S)) * _B
    x ^= x >> _S
    x *= _C
    x ^= x >> _S
    return x


def _octets(data: np.ndarray) -> np.ndarray:
    """Bucket of every 8-byte string: the string itself as a number, stirred."""
    n = len(data) - 7
    raw = np.ndarray((n,), "<u8", data.tobytes(), strides=(1,)).copy()
    return _pair(raw, raw)


def q_of(length: int) -> int:
    """Bytes of the initial q-grams: the largest power of two up to a third of the length."""
    return 1 << (length // 3).bit_length() - 1


class Buckets:
    """Identifiers of one stretch of bytes, by refinement."""

    def __init__(self, data: np.ndarray, length: int):
        self.ids, m = {8: _octets(data)}, 8
        while 2 * m <= length // 2:
            x = self.ids[m]
            m *= 2
            self.ids[m] = _pair(x[:-(m // 2)], x[m // 2:])

    def of(self, at: np.ndarray, length: int) -> np.ndarray:
        """Identifiers of the ``length``-byte strings that start ``at``."""
        m = max(m for m in self.ids if m <= length)
        x = self.ids[m]
        if 2 * m >= length:
            return _pair(x[at], x[at + length - m])
        wide = lambda p: _pair(x[p], x[p + m])
        return _pair(wide(at), wide(at + length - 2 * m))


def _ranges(data: np.ndarray, length: int):
    """Ranges of one stretch: (first, last, q-gram's place, bucket, whole) arrays."""
    n, q = len(data) - length + 1, q_of(length)
    b = Buckets(data, length)
    grams, span = b.ids[q], length - q + 1
    low = (grams & ~np.uint64(0xFFFFFF)) | np.arange(len(grams), dtype=np.uint64)  # smallest, leftmost place
    width = 1
    while width * 2 <= span:
        low = np.minimum(low[:-width], low[width:])
        width *= 2
    low = np.minimum(low[:n], low[span - width:span - width + n])
    at = (low & np.uint64(0xFFFFFF)).astype(np.int64)
    first = np.flatnonzero(np.concatenate(([True], at[1:] != at[:-1])))
    last = np.append(first[1:], n) - 1
    return first, last, at[first], grams[at[first]], _whole(b, first, last, length)


def _whole(b: Buckets, first, last, length):
    """Identifier of a whole range, from those of its ends."""
    return _pair(_pair(b.of(first, length), b.of(last, length)), (last - first).astype(np.uint64))


def _pieces(data: np.ndarray, first: int, last: int, at: int, bucket: int, length: int):
    """A range cut by distance to its q-gram: (first, last, refined bucket, whole) arrays.

    ``data`` begins at ``first``; positions are in the text.
    """
    b = Buckets(data, length)
    lane = (at - np.arange(first, last + 1)) // CUT
    head = np.flatnonzero(np.concatenate(([True], lane[1:] != lane[:-1])))
    tail = np.append(head[1:], len(lane)) - 1
    # All starts of lane g hold the bytes from at - g * CUT on, as far as the farthest start reaches.
    shared = length - CUT + 1
    core = b.of(at - lane[head] * CUT - first, shared)
    refined = _pair(core, lane[head].astype(np.uint64) ^ np.int64(bucket).view(np.uint64))
    return head + first, tail + first, refined, _whole(b, head, tail, length)


def _stretches(n: int, length: int):
    """(offset, size) of stretches that hold every start of n bytes once."""
    for a in range(0, max(0, n - length + 1), CHUNK):
        yield a, min(CHUNK, n - length + 1 - a) + length - 1


def _octet_view(text) -> np.ndarray:
    return np.frombuffer((text or "").encode("utf-8", "replace"), np.uint8)


def _long(x: np.ndarray) -> pa.Array:
    return pa.array(x.astype(np.int64) if x.dtype != np.uint64 else x.view(np.int64))


def _settle(ranges: DataFrame) -> tuple[DataFrame, DataFrame]:
    """One refinement step on (row, first, last, at, bucket, whole) ranges of starts.

    ``ranges`` is a scratch table, deleted here.  Gives (row, first, last) of ranges that repeat as
    a whole, and the rows to refine on: unequal ranges that share a bucket, and one
    of each kind of repeated range beside them.
    """
    # Counts are written before they are joined: only then can a hot bucket's rows be split in the join.
    shared = scratch_table(ranges.groupBy("bucket").agg(F.count("*").alias("n")).where("n > 1").select("bucket"),
                           "suffix-shared")
    alive = scratch_table(ranges.join(shared, "bucket", "left_semi"), "suffix-alive")
    drop_scratch(ranges)
    kinds = scratch_table(alive.groupBy("bucket", "whole").agg(
        F.count("*").alias("n"), F.min(F.struct("row", "first", "last", "at")).alias("one")), "suffix-kinds")
    unsure = scratch_table(kinds.where("n = 1").select("bucket").distinct(), "suffix-unsure")
    onward = kinds.join(unsure, "bucket", "left_semi").select("bucket", "one.*")
    twice = alive.join(kinds.where("n > 1").select("bucket", "whole"), ["bucket", "whole"], "left_semi")
    return twice.select("row", "first", "last"), onward


class _Emit:
    """Collects columns of longs and gives them out as batches of bounded size."""

    def __init__(self, names):
        self.names, self.parts, self.size = names, [], 0

    def add(self, *columns):
        self.parts.append(columns)
        self.size += len(columns[-1])

    def ready(self, at_least: int = 200_000):
        if self.parts and self.size >= at_least:
            cols = [np.concatenate([p[i] for p in self.parts]) for i in range(len(self.names))]
            self.parts, self.size = [], 0
            yield pa.RecordBatch.from_arrays([_long(c) for c in cols], names=self.names)


RANGE = "row long, first long, last long, at long, bucket long, whole long"


def repeated_starts(rows: DataFrame, length: int) -> DataFrame:
    """(row, first, last): inclusive ranges of starts whose strings also start elsewhere, from (row, text)."""

    def cut(batches):
        out = _Emit(["row", "first", "last", "at", "bucket", "whole"])
        for b in batches:
            for key, text in zip(b.column(0).to_numpy(), b.column(1)):
                data = _octet_view(text.as_py())
                for offset, n in _stretches(len(data), length):
                    first, last, at, bucket, whole = _ranges(data[offset:offset + n], length)
                    out.add(np.full(len(first), key), first + offset, last + offset, at + offset, bucket, whole)
                    yield from out.ready()
        yield from out.ready(0)

    twice, onward = _settle(scratch_table(arrow_stage(rows, cut, RANGE), "suffix-ranges"))

    def with_bytes(batches):
        for b in batches:
            keys, cols, pieces = [], [], []
            for key, text, ranges in zip(b.column(0), b.column(1), b.column(2)):
                raw = (text.as_py() or "").encode("utf-8", "replace")
                for r in ranges.values.to_pylist():
                    keys.append(key.as_py())
                    cols.append((r["first"], r["last"], r["at"], r["bucket"]))
                    pieces.append(raw[r["first"]:r["last"] + length])
            longs = np.array(cols, np.int64).reshape(-1, 4)
            yield pa.RecordBatch.from_arrays(
                [pa.array(keys, pa.int64()), *[pa.array(longs[:, i]) for i in range(4)], pa.array(pieces, pa.binary())],
                names=["row", "first", "last", "at", "bucket", "data"])

    per_text = onward.groupBy("row").agg(F.collect_list(F.struct("first", "last", "at", "bucket")).alias("ranges"))
    left = scratch_table(arrow_stage(rows.join(per_text, "row"), with_bytes,
                                     "row long, first long, last long, at long, bucket long, data binary"), "suffix-left")

    def divide(batches):
        out = _Emit(["row", "first", "last", "at", "bucket", "whole"])
        for b in batches:
            longs = [c.to_numpy() for c in b.columns[:5]]
            for row, first, last, at, bucket, data in zip(*longs, b.column(5)):
                got = _pieces(np.frombuffer(data.as_py(), np.uint8), first, last, at, bucket, length)
                out.add(np.full(len(got[0]), row), got[0], got[1], np.full(len(got[0]), first), *got[2:])
            yield from out.ready()
        yield from out.ready(0)

    # From here on ``at`` is the first start of the range a piece was cut from, which has its bytes.
    again, pieces = _settle(scratch_table(arrow_stage(left, divide, RANGE), "suffix-pieces"))
    open_pieces = pieces.groupBy("row", "at").agg(F.collect_list(F.struct("first", "last", "bucket")).alias("pieces"))
    source = left.select("row", F.col("first").alias("at"), "data").dropDuplicates(["row", "at"])

    def single(batches):
        out = _Emit(["row", "start", "bucket", "id"])
        for b in batches:
            for row, at, data, todo in zip(b.column(0).to_numpy(), b.column(1).to_numpy(), b.column(2), b.column(3)):
                raw = np.frombuffer(data.as_py(), np.uint8)
                for r in todo.values.to_pylist():
                    a, z = r["first"] - at, r["last"] - at
                    ids = Buckets(raw[a:z + length], length).of(np.arange(z - a + 1), length)
                    out.add(np.full(len(ids), row), np.arange(r["first"], r["last"] + 1), np.full(len(ids), r["bucket"]), ids)
            yield from out.ready()
        yield from out.ready(0)

    starts = scratch_table(arrow_stage(source.join(open_pieces, ["row", "at"]), single,
                                       "row long, start long, bucket long, id long"), "suffix-starts")
    drop_scratch(left)
    shared = scratch_table(starts.groupBy("bucket", "id").agg(F.count("*").alias("n")).where("n > 1")
                           .select("bucket", "id"), "suffix-same")
    alone = starts.join(shared, ["bucket", "id"], "left_semi").select(
        "row", F.col("start").alias("first"), F.col("start").alias("last"))
    return twice.unionByName(again).unionByName(alone)


def _spans(first: np.ndarray, last: np.ndarray, length: int, n: int) -> np.ndarray:
    """Maximal removed [begin, end) byte ranges from inclusive ranges of repeated starts."""
    if not len(first):
        return np.empty((0, 2), np.int64)
    order = np.argsort(first, kind="stable")
    begin, end = first[order], np.maximum.accumulate(last[order] + length)
    new = np.concatenate(([True], begin[1:] > end[:-1]))
    heads = np.flatnonzero(new)
    return np.stack([begin[heads], end[np.append(heads[1:], len(end)) - 1]], axis=1)


def dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", length: int = LENGTH) -> DataFrame:
    """Every input row with (n_bytes, n_removed, n_spans, spans, kept_sha256, kept_text) appended.

    A byte is removed when a ``length``-byte string covers it that also starts
    anywhere else in the corpus, the same text included.  ``spans`` are the
    maximal removed byte ranges [begin, end).  ``kept_text`` is the rest as
    text; bytes of a character that a span cuts through are left out of it (not
    of the hash).  Null texts are empty.  Rows repeating an id are texts of
    their own; two equal texts count as each other's elsewhere.  Input columns
    pass through, but for ones named like a result column; an empty table gives an empty result.
    """
    assert length >= 4 * CUT
    added = ["n_bytes", "n_removed", "n_spans", "spans", "kept_sha256", "kept_text"]
    src = docs.select(*[F.col(f"`{c}`") for c in docs.columns if c.lower() not in added])
    # A row is known by its id and text, so that reruns of a lost task agree; equal rows share one key.
    key = F.xxhash64(F.col(id_col), F.col(text_col))
    # All strings of a row that comes again start elsewhere too.  One of its copies stands for all in the search, and
    # none carries a list of ranges: the copies cost their number, not its square.
    again = scratch_table(src.groupBy(key.alias("_sa_again")).count().where("count > 1").select("_sa_again"), "suffix-equal-rows")
    again = dimension(again)
    texts = src.select(key.alias("row"), F.col(text_col).alias("text"))
    same = F.col("row") == F.col("_sa_again")
    once = texts.join(again, same, "left_anti").unionByName(texts.join(again, same, "left_semi").dropDuplicates(["row"]))
    found = (repeated_starts(once, length).join(again, same, "left_anti").groupBy("row")
             .agg(F.collect_list("first").alias("_sa_firsts"), F.collect_list("last").alias("_sa_lasts")))
    whole = src.withColumn("_sa_row", key).join(found.withColumnRenamed("row", "_sa_row"), "_sa_row", "left")
    whole = whole.join(again, F.col("_sa_row") == F.col("_sa_again"), "left")
    at = [whole.columns.index(c) for c in (text_col, "_sa_firsts", "_sa_lasts", "_sa_again")]
    out_cols = list(src.columns)
    keep_at = [whole.columns.index(c) for c in out_cols]

    def finish(batches):
        for b in batches:
            res = {c: [] for c in added}
            for text, firsts, lasts, twin in zip(*[b.column(i) for i in at]):
                raw = (text.as_py() or "").encode("utf-8", "replace")
                spans = np.empty((0, 2), np.int64)
                if twin.is_valid and len(raw) >= length:
                    spans = np.array([[0, len(raw)]], np.int64)
                elif firsts.is_valid:
                    spans = _spans(firsts.values.to_numpy(), lasts.values.to_numpy(), length, len(raw))
                edges = [0, *spans.reshape(-1).tolist(), len(raw)]
                kept = b"".join(raw[a:z] for a, z in zip(edges[::2], edges[1::2]))
                res["n_bytes"].append(len(raw))
                res["n_removed"].append(len(raw) - len(kept))
                res["n_spans"].append(len(spans))
                res["spans"].append(spans.tolist())
                res["kept_sha256"].append(hashlib.sha256(kept).hexdigest())
                res["kept_text"].append(kept.decode("utf-8", "ignore"))
            kinds = [pa.int64(), pa.int64(), pa.int64(), pa.list_(pa.list_(pa.int64())), pa.string(), pa.string()]
            yield pa.RecordBatch.from_arrays(
                [b.column(i) for i in keep_at] + [pa.array(res[c], k) for c, k in zip(added, kinds)],
                names=out_cols + added)

    return arrow_stage(whole, finish, with_fields(src.schema, (
        "n_bytes long, n_removed long, n_spans long, spans array<array<long>>, kept_sha256 string, kept_text string")))
