"""Toxicity scores from class-conditional Kneser-Ney word models.

Two bigram models, one of toxic and one of ordinary texts, use absolute discounting, with discounts
estimated from the numbers of expressions seen once, twice, three and four times.  Class bigrams back off to class words,
and class words to one distribution shared by both classes: continuation counts (how many different words
precede a word), smoothed by the word counts of the whole corpus.  Backoff weights are shared counts, the same for both classes, and
never under ``TIE`` of them: an expression that neither class has seen weighs nothing, and one occurrence little.  Class counts
are numbers of texts, so one long or repeated passage can't make a word toxic.  The two log-likelihoods are compared per word,
over all expressions and over the strongly toxic ones; a logistic curve over both gives the score.

Every labelled row outside the held-out ones is learnt from: three in four are counted, the fourth tunes
the curve, whose Newton steps are aggregates over a table of two numbers a row.  Every word and every bigram of the counted
texts is kept and weighed.  Words and bigrams of at least ``MIN_WORD`` and ``MIN_BIGRAM`` texts, the most frequent ``MAX_WORDS``
and ``MAX_BIGRAMS`` at most, are broadcast as the model's head; all others stay in a distributed table, in buckets that
the expressions of blocks of texts are sent to, packed.  Head and table use the same formulas, so these
limits move work and not results.  (id, label) rows are broadcast while they are at most ``MAX_SENT``; more labels than that are
shuffled to their texts.

A bigram is known by the number of its second word and a 44-bit hash if that word is in the head, else by a 44-bit hash of the
second and an 18-bit hash of the first word.  Weights are summed in units of 2**-24, so sums do not depend on their order.
"""

from __future__ import annotations

import re
from collections import Counter
from dataclasses import dataclass
from hashlib import blake2b

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from noteflare.llm.common import arrow_stage, drop_scratch, free_shuffles, scratch_table, unused
from noteflare.operators.joins import dimension

MAX_SENT = 1_000_000  # (id, label) rows that are broadcast; more are joined by a shuffle
MAX_WORDS = 1 << 17  # of the head, as are the next three: the rest is in the table
MAX_BIGRAMS = 1 << 18
MIN_WORD = 5
MIN_BIGRAM = 5
DISCOUNT = 0.75  # of continuation counts, and of classes too small to estimate it
TIE = 2.0  # least shared counts behind a class count
STRONG = 2.0  # log-likelihood ratio from which an expression counts as strongly toxic
THRESHOLD = 0.3
HELD_OUT = 2  # remainder of crc32(id) mod 4 that is never learnt from
BUCKET_WORDS = 8_000_000  # words of the corpus a bucket of the table
BLOCK_WORDS = 1 << 19  # words that a task packs at a time, at least
SLICES = 4  # of the scored texts, one after another: bounds the packed expressions on disk
UNIT = 1 << 24

_KEY, _FIRST = 44, 18  # bits: of a bigram's hash by a head word, of the first word's by another
_TAIL = 1 << 62

_WORD = re.compile(rb"[a-z0-9\x80-\xff]+")


def words_of(text: str | None) -> list[bytes]:
    """Lower-cased (A-Z) runs of letters, digits and non-ASCII characters."""
    return _WORD.findall((text or "").encode("utf-8", "replace").lower())


@dataclass
class Weights:
    """What both levels of the class models share: totals, discounts and the backoff of words."""

    words: tuple[float, float]  # texts' words by class, ordinary and toxic
    pairs: tuple[float, float]
    word_discount: tuple[float, ...]  # of 0, 1, 2, 3 and more
    pair_discount: tuple[float, ...]
    shared: float  # shared counts of all words
    kinds: float  # continuation counts of all words
    spread: float  # their discounted share, dealt by corpus counts
    corpus: tuple[float, float]  # words of the corpus, different words

    @staticmethod
    def _ratio(counts, totals, discount, back) -> np.ndarray:
        """log p(e | toxic) - log p(e | ordinary); ``back``: shared counts behind the ordinary and the toxic count."""
        every = max(sum(totals), 1.0)
        ones = []
        for n, total, b in zip(counts, totals, back):
            left = np.maximum(n - np.asarray(discount)[np.minimum(n, 3).astype(np.int64)], 0)
            ones.append(np.log(left * (every / max(total, 1.0)) + b))
        return ones[1] - ones[0]

    def word(self, n0, n1, n_all, before) -> np.ndarray:
        """Of seen words, by texts of each class, corpus count and number of different words before."""
        floor = (n_all + 0.5) / (self.corpus[0] + 0.5 * (self.corpus[1] + 1))
        shared = np.maximum(before - DISCOUNT, 0) / max(self.kinds, 1.0) + self.spread * floor
        back = TIE + self.shared * shared
        return self._ratio((n0, n1), self.words, self.word_discount, (back, back))

    def pair(self, n0, n1, word) -> np.ndarray:
        """Of seen bigrams, by texts of each class and the ratio of their second words."""
        return self._ratio((n0, n1), self.pairs, self.pair_discount, (TIE * np.exp(-word / 2), TIE * np.exp(word / 2)))


def discounts(seen_1: float, seen_2: float, seen_3: float, seen_4: float) -> tuple[float, ...]:
    """Discounts of 0, 1, 2, 3 and more from how many expressions were seen once, twice, three and four times."""
    if not (seen_1 and seen_2):
        return 0.0, DISCOUNT, DISCOUNT, DISCOUNT
    y = seen_1 / (seen_1 + 2 * seen_2)
    found = [i - (i + 1) * y * more / n if n else DISCOUNT
             for i, (n, more) in enumerate(((seen_1, seen_2), (seen_2, seen_3), (seen_3, seen_4)), 1)]
    return 0.0, *[float(min(max(d, 0.1), i)) for i, d in enumerate(found, 1)]


def _units(x) -> np.ndarray:
    return np.rint(np.asarray(x) * UNIT).astype(np.int64)


def _strong(gain) -> np.ndarray:
    return np.maximum(gain - STRONG, 0)


def word_hash(word: bytes) -> int:
    return int.from_bytes(blake2b(word, digest_size=8).digest(), "little")


@dataclass
class Head:
    """The broadcast part; word number 0 is unused.  Weights are units, of bigrams what they add to their second word's."""

    index: dict[bytes, int]
    hashes: np.ndarray
    buckets: int
    block: int                        # words that a task packs at a time
    gain: np.ndarray | None = None    # ratios of the words
    pair: np.ndarray | None = None    # sorted keys
    weight: np.ndarray | None = None  # (2, B): whole and strong part


@dataclass
class Model:
    """Broadcast head and distributed table of all expressions; a curve over both features."""

    head: Head
    weights: Weights
    table: DataFrame  # (bucket, blob): sorted keys, ordinary and toxic texts, corpus count of words
    pair_count: np.ndarray  # (2, B): of the head's bigrams
    slope: tuple[float, ...] = (0.0, 1.0, 0.0)
    mean: tuple[float, ...] = (0.0, 0.0)
    scale: tuple[float, ...] = (1.0, 1.0)

    @property
    def index(self) -> dict[bytes, int]:
        return self.head.index


# ---------------------------------------------------------------------------
# packed expressions
# ---------------------------------------------------------------------------

def pack(*arrays: np.ndarray) -> bytes:
    """Arrays of numbers from 0 to 2**63 - 1 as compressed byte planes; the first is sorted and kept as differences."""
    arrays = [np.diff(arrays[0], prepend=0), *arrays[1:]]
    sizes, planes = [], []
    for a in arrays:
        width = (int(a.max()).bit_length() + 7) // 8 if len(a) else 0
        sizes += [len(a), width]
        planes.append(np.ascontiguousarray(a.astype("<i8").view(np.uint8).reshape(-1, 8)[:, :width].T).tobytes())
    return np.array([len(arrays), *sizes], "<i8").tobytes() + pa.compress(b"".join(planes), codec="zstd", asbytes=True)


def unpack(blob: bytes) -> list[np.ndarray]:
    k = int(np.frombuffer(blob, "<i8", 1)[0])
    sizes = np.frombuffer(blob, "<i8", 2 * k, 8).reshape(k, 2)
    raw = pa.decompress(blob[8 + 16 * k:], int((sizes[:, 0] * sizes[:, 1]).sum()), codec="zstd", asbytes=True)
    out, at = [], 0
    for n, width in sizes.tolist():
        wide = np.zeros((n, 8), np.uint8)
        wide[:, :width] = np.frombuffer(raw, np.uint8, n * width, at).reshape(width, n).T
        out.append(wide.reshape(-1).view("<i8").astype(np.int64))
        at += n * width
    return [np.cumsum(out[0]), *out[1:]]


def _tail_word(hashes: np.ndarray) -> np.ndarray:
    """Keys of words outside the head; those of their bigrams follow them."""
    return _TAIL | (hashes >> np.uint64(64 - _KEY)).astype(np.int64) << _FIRST


def _bucket(keys: np.ndarray, buckets: int) -> np.ndarray:
    """By the hash of a bigram, or of a word outside the head: such a word and its bigrams are in one bucket."""
    return np.where(keys & _TAIL, keys >> _FIRST & (1 << _KEY) - 1, keys & (1 << _KEY) - 1) % buckets


class _Numbers(dict):
    """Numbers of words: of the head, and beyond its last number for others as they are met."""

    def __init__(self, head: Head):
        super().__init__(head.index)
        self.hashes = head.hashes.tolist()

    def __missing__(self, word: bytes) -> int:
        self[word] = number = len(self.hashes)
        self.hashes.append(word_hash(word))
        return number


@dataclass
class _Block:
    """Some texts' words, number by number."""

    doc: np.ndarray      # of each word
    id: np.ndarray
    word_key: np.ndarray  # 0 for words of the head
    pair_key: np.ndarray  # of each word with the one before in its text; 0 for first words


def _blocks(texts, head: Head):
    """(first text, end, block) for runs of texts that have ``head.block`` words together."""
    size, first, numbers, ids, n = len(head.hashes), 0, _Numbers(head), [], 0

    def block() -> _Block:
        every, hashes = np.concatenate(ids), np.array(numbers.hashes, np.uint64)
        doc = np.repeat(np.arange(len(ids)), [len(i) for i in ids])
        own = hashes[every]
        tail = every >= size
        word_key = np.where(tail, _tail_word(own), 0)
        h = np.roll(own, 1)
        mixed = h * np.uint64(0x9E3779B97F4A7C15) + own
        mixed = (mixed ^ mixed >> np.uint64(32)) * np.uint64(0xD6E8FEB86659FD93)
        mixed ^= mixed >> np.uint64(29)
        low = (mixed & np.uint64((1 << _KEY) - 1)).astype(np.int64)
        before = 1 + (h % np.uint64((1 << _FIRST) - 1)).astype(np.int64)
        pair_key = np.where(tail, word_key | before, every << _KEY | low)
        pair_key[np.flatnonzero(np.diff(doc, prepend=-1))] = 0
        return _Block(doc, every, word_key, pair_key)

    for at, text in enumerate(texts):
        words = words_of(text.as_py())
        ids.append(np.fromiter(map(numbers.__getitem__, words), np.int64, len(words)))
        n += len(words)
        if n >= head.block:
            yield first, at + 1, block()
            first, ids, n = at + 1, [], 0
            if len(numbers.hashes) > size + head.block:
                numbers = _Numbers(head)
    if ids:
        yield first, first + len(ids), block()


def _once(keys: np.ndarray, docs: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(key, doc, times), each pair once, by key and doc; ``docs`` ascends."""
    order = np.argsort(keys, kind="stable")
    keys, docs = keys[order], docs[order]
    first = np.flatnonzero(np.r_[True, (np.diff(keys) != 0) | (np.diff(docs) != 0)][:len(keys)])
    return keys[first], docs[first], np.diff(np.r_[first, len(keys)])


def _parts(keys: np.ndarray, buckets: int):
    """(bucket, positions) of the entries of every bucket, in the order of the keys."""
    of = _bucket(keys, buckets)
    order = np.argsort(of, kind="stable")
    ends = np.searchsorted(of[order], np.arange(buckets + 1))
    for b in range(buckets):
        if ends[b] < ends[b + 1]:
            yield b, order[ends[b]:ends[b + 1]]


def _dealt(rows: DataFrame, buckets: int) -> DataFrame:
    """A partition a bucket, its kinds in order."""
    return rows.repartitionById(buckets, F.col("bucket")).sortWithinPartitions("bucket", "kind")


_PACKED = "bucket int, kind int, blob binary"


def _packed(rows: list[tuple[int, int, bytes]]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int32()), pa.array([r[1] for r in rows], pa.int32()),
                                       pa.array([r[2] for r in rows], pa.binary())], names=["bucket", "kind", "blob"])


def held_out(id_col) -> F.Column:
    """Whether a row is held out: crc32 of the id as text leaves remainder 2 by 4."""
    return F.coalesce(F.crc32(id_col.cast("string").cast("binary")) % 4 == HELD_OUT, F.lit(False))


def labelled_rows(labels: DataFrame, id_col: str, label_col: str) -> DataFrame:
    """(id, toxic, role) of every row to learn from: 'count' rows and 'tune' rows (one in four, by a hash of the id).

    Rows repeating an id count once, as toxic if any of them is; rows without id or label are left out.
    """
    known = (labels.select(F.col(id_col).alias("id"), F.col(label_col).cast("int").alias("toxic"))
             .where(F.col("id").isNotNull() & F.col("toxic").isNotNull() & ~held_out(F.col("id")))
             .groupBy("id").agg(F.max("toxic").alias("toxic")))
    tune = F.pmod(F.xxhash64("id", F.lit("tune")), F.lit(4)) == 0
    return known.select("id", F.col("toxic").cast("int").alias("toxic"), F.when(tune, "tune").otherwise("count").alias("role"))


def _with_label(docs: DataFrame, learnt: DataFrame, role: str, id_col: str, text_col: str, how: str) -> DataFrame:
    """(text, toxic) by the ``learnt`` rows of one role."""
    rows = dimension(learnt.where(F.col("role") == role).select("id", "toxic"), MAX_SENT)
    return docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).join(rows, "id", how).select("text", "toxic")


def _word_counts(docs: DataFrame, learnt: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(word, n_all, n_0, n_1): corpus counts of every word, and texts of each class's 'count' rows with it."""
    src = _with_label(docs, learnt, "count", id_col, text_col, "left")

    def count(batches):
        for b in batches:
            everything, by_class = Counter(), (Counter(), Counter())
            for text, toxic in zip(b.column(0), b.column(1)):
                words = words_of(text.as_py())
                everything.update(words)
                if toxic.is_valid:
                    by_class[int(toxic.as_py() > 0)].update(set(words))
            keys = list(everything)
            yield pa.RecordBatch.from_arrays(
                [pa.array([k.decode("utf-8", "replace") for k in keys], pa.string())]
                + [pa.array([c[k] for k in keys], pa.int64()) for c in (everything, *by_class)],
                names=["word", "n_all", "n_0", "n_1"])

    raw = arrow_stage(src, count, "word string, n_all long, n_0 long, n_1 long")
    return raw.groupBy("word").agg(*[F.sum(c).alias(c) for c in ("n_all", "n_0", "n_1")])


def _expressions(docs: DataFrame, learnt: DataFrame, words: DataFrame, head, id_col: str, text_col: str) -> DataFrame:
    """(bucket, blob): every bigram of the 'count' rows and every seen word outside the head with its counts, merged by bucket."""
    src = _with_label(docs, learnt, "count", id_col, text_col, "inner")
    buckets, block_words = head.value.buckets, head.value.block

    def pairs(batches):
        for b in batches:
            toxic = np.asarray(b.column(1)) > 0
            for lo, hi, block in _blocks(b.column(0), head.value):
                at = np.flatnonzero(block.pair_key)
                keys, docs, _ = _once(block.pair_key[at], block.doc[at])
                if not len(keys):
                    continue
                first = np.flatnonzero(np.diff(keys, prepend=-1))
                ones = np.add.reduceat(toxic[lo:hi][docs].astype(np.int64), first)
                keys, n = keys[first], np.diff(np.r_[first, len(keys)])
                yield _packed([(b, 0, pack(keys[i], (n - ones)[i], ones[i], np.zeros(len(i), np.int64)))
                               for b, i in _parts(keys, buckets)])

    def rare(batches):
        for b in batches:
            hashes = np.array([word_hash(w.as_py().encode()) for w in b.column("word")], np.uint64)
            keys = _tail_word(hashes)
            order = np.argsort(keys, kind="stable")
            counts = [np.asarray(b.column(c))[order] for c in ("n_0", "n_1", "n_all")]
            if len(keys):
                yield _packed([(at, 0, pack(keys[order][i], *[c[i] for c in counts])) for at, i in _parts(keys[order], buckets)])

    known = docs.sparkSession.createDataFrame([(w.decode(),) for w in head.value.index], "word string")
    rest = words.where(F.col("n_0") + F.col("n_1") > 0).join(F.broadcast(known), "word", "left_anti")  # at most MAX_WORDS rows
    sent = arrow_stage(src, pairs, _PACKED).unionByName(arrow_stage(rest, rare, _PACKED))

    def merge(batches):
        kept, waiting, at, n = None, [], None, 0

        def merged():
            if not waiting:
                return kept
            every = [np.concatenate(a) for a in zip(*([kept] if kept else []), *waiting)]
            order = np.argsort(every[0], kind="stable")
            keys = every[0][order]
            first = np.flatnonzero(np.diff(keys, prepend=-1))
            return [keys[first], *[np.add.reduceat(a[order], first) for a in every[1:]]]

        def chunks():
            for lo in range(0, len(kept[0]) if kept else 0, 1 << 20):
                yield _packed([(at, 0, pack(*[a[lo:lo + (1 << 20)] for a in kept]))])

        for b in batches:
            for bucket, blob in zip(b.column(0), b.column(2)):
                if bucket.as_py() != at:
                    kept = merged()
                    yield from chunks()
                    kept, waiting, at, n = None, [], bucket.as_py(), 0
                waiting.append(unpack(blob.as_py()))
                n += len(waiting[-1][0])
                if n > block_words:
                    kept, waiting, n = merged(), [], 0
        kept = merged()
        yield from chunks()

    return arrow_stage(_dealt(sent, buckets), merge, _PACKED)


def _pair_facts(table: DataFrame) -> dict[int, int]:
    """Different words before each word of the head; below 0: texts' bigrams by class (-1, -2), bigrams seen 1 to 4 times (-3 to -6) and all (-7)."""

    def count(batches):
        before, facts = np.zeros(MAX_WORDS, np.int64), np.zeros(7, np.int64)
        for b in batches:
            for blob in b.column("blob"):
                keys, n0, n1, _ = unpack(blob.as_py())
                pair = (keys < _TAIL) | (keys & (1 << _FIRST) - 1 > 0)
                before += np.bincount(keys[keys < _TAIL] >> _KEY, minlength=MAX_WORDS)
                n = (n0 + n1)[pair]
                facts += [n0[pair].sum(), n1[pair].sum(), *[(n == i).sum() for i in (1, 2, 3, 4)], len(n)]
        used = np.flatnonzero(before)
        yield pa.RecordBatch.from_arrays([pa.array(np.r_[used, -1 - np.arange(7)]), pa.array(np.r_[before[used], facts])],
                                         names=["id", "n"])

    return {r["id"]: r["n"] for r in arrow_stage(table.select("blob"), count, "id long, n long").groupBy("id").agg(F.sum("n").alias("n")).collect()}


def _frequent_pairs(table: DataFrame) -> DataFrame:
    """(pair, n_0, n_1) of bigrams by a head word in ``MIN_BIGRAM`` texts at least."""

    def often(batches):
        for b in batches:
            for blob in b.column("blob"):
                keys, n0, n1, _ = unpack(blob.as_py())
                i = np.flatnonzero((keys < _TAIL) & (n0 + n1 >= MIN_BIGRAM))
                yield pa.RecordBatch.from_arrays([pa.array(a[i]) for a in (keys, n0, n1)], names=["pair", "n_0", "n_1"])

    return arrow_stage(table.select("blob"), often, "pair long, n_0 long, n_1 long")


def _most_frequent(counts: DataFrame, seen, least: int, limit: int) -> DataFrame:
    """The head's rows: those seen at least ``least`` times, or as often more as leaves at most ``limit`` rows."""
    levels = counts.where(seen >= least).groupBy(F.least(seen, F.lit(10_000)).alias("seen")).count().collect()
    rows, cut = 0, 10_001
    for r in sorted(levels, key=lambda r: -r["seen"]):
        rows += r["count"]
        if rows > limit:
            break
        cut = r["seen"]
    return counts.where(seen >= cut)


def _logistic(rows: DataFrame) -> tuple[list, list, list] | None:
    """Newton steps of a lightly penalised logistic fit over (a, b, toxic) rows; (weights, means, scales).

    A step is one aggregate of nine sums, so memory does not grow with the rows.  The weights are kept to nine digits, which
    the order of summing does not reach.  None if a class is missing.
    """
    y = (F.col("toxic") > 0).cast("double")
    n, n1, *found = rows.agg(F.count("*"), F.sum(y), F.avg("a"), F.avg("b"), F.stddev_pop("a"), F.stddev_pop("b")).first()
    if not n or not 0 < n1 < n:
        return None
    shorter = lambda v: float(f"{v:.9g}")
    mean, scale = [shorter(v) for v in found[:2]], [shorter(v + 1e-12) for v in found[2:]]
    z = [F.lit(1.0)] + [(F.col(c) - m) / s for c, m, s in zip("ab", mean, scale)]
    w, ridge = np.zeros(3), np.diag([1e-6, 1e-2, 1e-2])
    cells = [(i, j) for i in range(3) for j in range(i, 3)]
    for _ in range(50):
        margin = sum((x * float(v) for x, v in zip(z[1:], w[1:])), F.lit(float(w[0])))
        p = 1 / (1 + F.exp(-F.greatest(F.lit(-30.0), F.least(F.lit(30.0), margin))))
        sums = rows.select(*[x.alias(f"z{i}") for i, x in enumerate(z)], y.alias("y"), p.alias("p")).agg(
            *[F.sum(F.col(f"z{i}") * (F.col("y") - F.col("p"))) for i in range(3)],
            *[F.sum(F.col(f"z{i}") * F.col(f"z{j}") * F.col("p") * (1 - F.col("p"))) for i, j in cells]).first()
        curve = np.zeros((3, 3))
        for (i, j), v in zip(cells, sums[3:]):
            curve[i, j] = curve[j, i] = v
        step = np.linalg.solve(curve + ridge, np.array(sums[:3]) - ridge @ w)
        w += step
        if np.abs(step).max() < 1e-8:
            break
    return [shorter(v) for v in w], mean, scale


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text",
        label_col: str = "toxic") -> Model:
    """Fit both class models and the calibration; without labels every text scores alike."""
    spark = docs.sparkSession
    learnt = scratch_table(labelled_rows(labels, id_col, label_col), "toxicity-labels")
    counts = scratch_table(_word_counts(docs, learnt, id_col, text_col), "toxicity-words")
    seen = F.col("n_0") + F.col("n_1")
    total_all, kinds_all, total_0, total_1, kinds_seen, *words_seen = [float(v or 0) for v in counts.agg(
        F.sum("n_all"), F.count("*"), F.sum("n_0"), F.sum("n_1"), F.sum((seen > 0).cast("int")),
        *[F.sum((seen == i).cast("int")) for i in (1, 2, 3, 4)]).first()]
    vocab = _most_frequent(counts, seen, MIN_WORD, MAX_WORDS - 1).toPandas().sort_values("word", ignore_index=True)
    words = [w.encode() for w in vocab["word"]]
    buckets = max(spark.sparkContext.defaultParallelism, -(-int(total_all) // BUCKET_WORDS))
    head = Head({w: i + 1 for i, w in enumerate(words)}, np.array([0, *map(word_hash, words)], np.uint64), buckets, BLOCK_WORDS)
    table = scratch_table(_expressions(docs, learnt, counts, spark.sparkContext.broadcast(head), id_col, text_col), "toxicity-pairs")
    drop_scratch(counts)
    free_shuffles(spark)

    facts = _pair_facts(table)
    pairs = tuple(float(facts.get(-i, 0)) for i in (1, 2))
    before = np.array([float(facts.get(i + 1, 0)) for i in range(len(words))])
    word_discount, kinds = discounts(*words_seen), float(facts.get(-7, 0))
    lost = [words_seen[0], words_seen[1], kinds_seen - words_seen[0] - words_seen[1]]
    # The discounted part of the continuation counts, of which every seen word but texts' first ones has at least one.
    weights = Weights((total_0, total_1), pairs, word_discount, discounts(*[float(facts.get(-i, 0)) for i in (3, 4, 5, 6)]),
                      sum(n * d for n, d in zip(lost, word_discount[1:])), kinds,
                      DISCOUNT * kinds_seen / kinds if kinds else 1.0, (total_all, kinds_all))
    counted = [vocab[c].to_numpy(float) for c in ("n_0", "n_1", "n_all")]
    head.gain = np.r_[0.0, weights.word(*counted, before)]
    often = scratch_table(_frequent_pairs(table), "toxicity-frequent")
    kept = _most_frequent(often, seen, MIN_BIGRAM, MAX_BIGRAMS).toPandas().sort_values("pair")
    head.pair = kept["pair"].to_numpy(np.int64)
    pair_count = np.stack([kept["n_0"].to_numpy(float), kept["n_1"].to_numpy(float)])
    head.weight = _added(weights.pair(*pair_count, own := head.gain[head.pair >> _KEY]), own)
    model = Model(head, weights, table, pair_count)

    rows = _with_label(docs, learnt, "tune", id_col, text_col, "inner").select(_text_key("text").alias("key"), "text", "toxic")
    margins = rows.select("key", "toxic").join(_features(rows.select("key", "text"), model), "key").select("a", "b", "toxic")
    curve = _logistic(scratch_table(margins, "toxicity-margins"))
    if curve:
        model.slope, model.mean, model.scale = curve
    else:
        model.slope = (-2.0, 1.0, 1.0) if total_1 and total_0 else (-2.0, 0.0, 0.0)
    return model


def _added(ratio: np.ndarray, word: np.ndarray) -> np.ndarray:
    """(2, n): what bigrams of a ratio add to their second word's, in units: whole and strong part."""
    return np.stack([_units(ratio) - _units(word), _units(_strong(ratio)) - _units(_strong(word))])


def _text_key(text) -> F.Column:
    return F.xxhash64(F.coalesce(text if isinstance(text, F.Column) else F.col(f"`{text}`"), F.lit("")))


def _features(texts: DataFrame, model: Model, slices: int = 1) -> DataFrame:
    """(key, a, b) of every different text of (key, text): per word, the log-likelihood ratio and its part from strongly toxic expressions.

    Blocks of texts weigh expressions of the head themselves and send all others, packed, to the table's buckets, where the block
    is weighed and its sums are returned by text.  A text that comes twice may count twice in both the sums and the words.
    """
    held = texts.sparkSession.sparkContext.broadcast(model.head)
    weights, buckets = model.weights, model.head.buckets

    def send(batches):
        head = held.value
        size = len(head.hashes)
        word_weight = np.stack([_units(head.gain), _units(_strong(head.gain))])
        for b in batches:
            own, at = np.unique(np.asarray(b.column(0)), return_index=True)
            own, at = own[np.argsort(at)], np.sort(at)
            for lo, hi, block in _blocks(b.column(1).take(pa.array(at)), head):
                key, n = own[lo:hi], hi - lo
                known = block.id < size
                sums = [_sums(block.doc[known], w[block.id[known]], n) for w in word_weight]
                some = np.flatnonzero(block.pair_key), np.flatnonzero(block.word_key)
                keys, docs, times = _once(np.concatenate([block.pair_key[some[0]], block.word_key[some[1]]]),
                                          np.concatenate([block.doc[i] for i in some]))
                first = np.flatnonzero(np.diff(keys, prepend=-1))
                runs = np.diff(np.r_[first, len(keys)])
                place, hit = _find(head.pair, keys[first])
                each = np.repeat(hit, runs)
                for s, w in zip(sums, head.weight):
                    s += _sums(docs[each], np.repeat(w[place[hit]], runs[hit]) * times[each], n)
                yield _packed([(int(key[0] % buckets), 2, _rows(key, *sums, np.bincount(block.doc, minlength=n)))])
                keys, docs, times = keys[~each], docs[~each], times[~each]
                for bucket, i in _parts(keys, buckets):
                    used, doc = np.unique(docs[i], return_inverse=True)
                    first = np.flatnonzero(np.diff(keys[i], prepend=-1))
                    blob = pack(keys[i][first], np.diff(np.r_[first, len(i)]), doc, times[i] - 1)
                    yield _packed([(bucket, 1, np.array([len(used)], "<i8").tobytes() + key[used].astype("<i8").tobytes() + blob)])

    def weigh(batches):
        at, table, chunks = None, None, []
        for b in batches:
            for bucket, kind, blob in zip(*b.columns):
                bucket, kind, blob = bucket.as_py(), kind.as_py(), blob.as_py()
                if bucket != at:
                    at, table, chunks = bucket, None, []
                if kind == 0:
                    chunks.append(unpack(blob))
                    continue
                if kind == 2:
                    key, a, s, n = np.frombuffer(blob, "<i8").reshape(4, -1)
                    yield _sum_rows(key, a, s, n)
                    continue
                if table is None:
                    table, chunks = _weighed(chunks, weights, held.value), []
                n = int(np.frombuffer(blob, "<i8", 1)[0])
                key = np.frombuffer(blob, "<i8", n, 8)
                keys, runs, doc, more = unpack(blob[8 + 8 * n:])
                place, hit = _find(table[0], keys)
                each = np.repeat(hit, runs)
                a, s = [_sums(doc[each], np.repeat(w[place[hit]], runs[hit]) * (more[each] + 1), n) for w in table[1]]
                some = np.flatnonzero((a != 0) | (s != 0))
                yield _sum_rows(key[some], a[some], s[some], np.zeros(len(some), np.int64))

    per_word = lambda c: F.when(F.col("n") > 0, F.col(c) / F.lit(float(UNIT)) / F.col("n")).otherwise(F.lit(0.0)).alias(c)

    def measured(part: DataFrame) -> DataFrame:
        sent = arrow_stage(part.select("key", "text"), send, _PACKED)
        sums = arrow_stage(_dealt(model.table.unionByName(sent), buckets), weigh, "key long, a long, b long, n long").groupBy("key").agg(
            *[F.sum(c).alias(c) for c in "abn"])
        return scratch_table(sums.select("key", per_word("a"), per_word("b")), "toxicity-features")

    found = None
    for i in range(slices):
        one = measured(texts.where(F.pmod("key", F.lit(slices)) == i) if slices > 1 else texts)
        found = one if found is None else found.unionByName(one)
        free_shuffles(texts.sparkSession)
    return found


def _sums(docs: np.ndarray, units: np.ndarray, n: int) -> np.ndarray:
    return np.bincount(docs, weights=units, minlength=n).astype(np.int64)  # whole numbers under 2**53: exact


def _find(keys: np.ndarray, wanted: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places of ``wanted`` in sorted keys, and whether they are there."""
    if not len(keys):
        return np.zeros(len(wanted), np.int64), np.zeros(len(wanted), bool)
    at = np.minimum(np.searchsorted(keys, wanted), len(keys) - 1)
    return at, keys[at] == wanted


def _rows(*columns: np.ndarray) -> bytes:
    return np.stack(columns).astype("<i8").tobytes()


def _sum_rows(*columns: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names=["key", "a", "b", "n"])


def _weighed(chunks: list, weights: Weights, head: Head) -> tuple[np.ndarray, np.ndarray]:
    """(keys, weights) of a bucket's table: a word's own, and what a bigram adds to its second word's."""
    if not chunks:
        return np.zeros(0, np.int64), np.zeros((2, 0), np.int64)
    keys, n0, n1, n_all = [np.concatenate(a) for a in zip(*sorted(chunks, key=lambda c: c[0][0]))]
    out = np.zeros((2, len(keys)), np.int64)
    split = int(np.searchsorted(keys, _TAIL))
    own = head.gain[keys[:split] >> _KEY]
    out[:, :split] = _added(weights.pair(n0[:split], n1[:split], own), own)
    low = keys[split:] & (1 << _FIRST) - 1
    word = np.flatnonzero(low == 0) + split  # each followed by its bigrams
    if len(word):
        runs = np.diff(np.r_[word, len(keys)])
        gain = weights.word(n0[word], n1[word], n_all[word], runs - 1.0)
        own = np.repeat(gain, runs)
        out[:, split:] = _added(weights.pair(n0[split:], n1[split:], own), own)
        out[:, word] = np.stack([_units(gain), _units(_strong(gain))])
    return keys, out


def score(docs: DataFrame, model: Model, text_col: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """Every input row with (score, predicted) appended; equal texts score alike.

    Whole texts are scored, null as empty; a text without words gets the score
    of a log-likelihood ratio of 0.  Input columns named score or predicted are
    replaced; an empty table gives an empty result.
    """
    src = docs.select(*[c for c in docs.columns if c not in ("score", "predicted")])
    key = unused(src, "text_key")
    found = _features(src.select(_text_key(text_col).alias("key"), F.col(f"`{text_col}`").alias("text")), model,
                      max(1, min(SLICES, int(model.weights.corpus[0] // BUCKET_WORDS))))
    z = F.lit(model.slope[0])
    for c, w, m, s in zip("ab", model.slope[1:], model.mean, model.scale):
        z = z + F.lit(w) * ((F.col(c) - F.lit(m)) / F.lit(s))
    p = 1.0 / (1.0 + F.exp(-F.greatest(F.lit(-700.0), F.least(F.lit(700.0), z))))
    scores = found.select(F.col("key").alias(key), p.alias("score"), (p >= F.lit(threshold)).cast("int").alias("predicted"))
    return src.withColumn(key, _text_key(text_col)).join(scores, key).drop(key)
