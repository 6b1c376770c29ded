"""Text and numeric vectors (V2-V4, V6): the vocabulary by term, the weights row by row.

* The vocabulary fit shuffles terms only, never text.  A count-min sketch of document frequencies (a fixed number of
  cells, counted map-side and merged by cell) rules out terms that can't reach ``min_df``: a cell's count is never below that of a
  term in it, so no term of the vocabulary is lost.  The survivors are then counted exactly, keyed by term.
  The sketch costs a second tokenising pass over the training text and saves the shuffle of the rare terms,
  by far the most of all word pairs.
* The vocabulary has at most ``max_features`` terms by construction, so the transform holds it in each task: raw
  counts, times idf, L2 norm are three row-wise stages (:func:`tfidf_vectors`), and the long form
  ``(doc, term, weight)`` unpacks their vectors (:func:`tfidf`).  No exchange in either.
"""

from __future__ import annotations

from collections.abc import Iterable, Sequence
from dataclasses import dataclass

from pyspark.ml.feature import NGram, StopWordsRemover
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from noteflare.constants import TFIDF_MAX_FEATURES, TFIDF_MIN_DF, ENGLISH_STOP_WORDS
from noteflare.operators.joins import bounded

# A token is a run of 2+ letters, digits or underscores (lower-cased first).
TOKEN_PATTERN = r"[\p{L}\p{N}_]{2,}"
SKETCH_WIDTH, SKETCH_DEPTH = 1 << 19, 2  # cells: one bit each once counted, 128 KB in all


def tokens(df: DataFrame, text_col: str, out_col: str = "terms", ngram_max: int = 2,
           stop_words: Sequence[str] | None = None) -> DataFrame:
    """V2: ``out_col`` = unigrams (stop words removed) followed by their n-grams.

    N-grams are formed from the tokens left after stop-word removal.
    """
    stop = list(stop_words if stop_words is not None else ENGLISH_STOP_WORDS)
    tmp = "_tok"
    raw = df.withColumn(tmp + "_raw", F.regexp_extract_all(
        F.lower(F.coalesce(F.col(text_col), F.lit(""))), F.lit(TOKEN_PATTERN), 0))
    clean = StopWordsRemover(inputCol=tmp + "_raw", outputCol=tmp, stopWords=stop,
                             caseSensitive=True).transform(raw)
    grams = [F.col(tmp)]
    for n in range(2, ngram_max + 1):
        clean = NGram(n=n, inputCol=tmp, outputCol=f"{tmp}_{n}").transform(clean)
        grams.append(F.col(f"{tmp}_{n}"))
    out = clean.withColumn(out_col, F.concat(*grams))
    return out.drop(tmp + "_raw", tmp, *[f"{tmp}_{n}" for n in range(2, ngram_max + 1)])


@dataclass(frozen=True)
class Sketch:
    """Count-min sketch of document frequencies, reduced to one bit a cell: did ``min_df`` documents meet in it?"""

    words: DataFrame  # one row: array<long>, 64 cells a word
    width: int
    depth: int

    def may_hold(self, term) -> F.Column:
        """False only for terms that fewer than ``min_df`` documents hold."""
        words = self.words.scalar()  # uncorrelated scalar subquery, evaluated once
        keep = F.lit(True)
        for cell in _cells(term, self.width, self.depth):
            keep = keep & (F.getbit(F.get(words, F.shiftright(cell, 6).cast("int")), (cell % 64).cast("int")) == 1)
        return keep


def _cells(term, width: int, depth: int) -> list[F.Column]:
    return [F.pmod(F.xxhash64(F.lit(r), term), F.lit(width)) + r * width for r in range(depth)]


def frequency_sketch(tokenised: DataFrame, min_df: int, terms_col: str = "terms", width: int = SKETCH_WIDTH,
                     depth: int = SKETCH_DEPTH) -> Sketch:
    """Sketch the document frequencies of ``terms_col`` (array of terms, one row a document).

    ``width * depth`` cells, whatever the data: counted map-side, one row a cell and task is shuffled.
    """
    held = tokenised.select(F.explode_outer(F.array_distinct(terms_col)).alias("term")).where(F.col("term").isNotNull())
    cells = held.select(F.explode(F.array(*_cells(F.col("term"), width, depth))).alias("cell"))
    heavy = cells.groupBy("cell").count().where(F.col("count") >= min_df)
    bits = heavy.groupBy(F.shiftright("cell", 6).alias("id")).agg(
        F.bit_or(F.call_function("shiftleft", F.lit(1).cast("long"), (F.col("cell") % 64).cast("int"))).alias("bits"))
    every = held.sparkSession.range(0, -(-width * depth // 64), numPartitions=1)
    words = every.join(bounded(bits), "id", "left").agg(F.transform(
        F.array_sort(F.collect_list(F.struct("id", F.coalesce("bits", F.lit(0)).alias("bits")))), lambda w: w["bits"]).alias("words"))
    return Sketch(words, width, depth)


@dataclass(frozen=True)
class Vocabulary:
    """Fitted vocabulary: ``terms`` holds (term, df, tf_total, idf, term_index)."""

    terms: DataFrame
    n_docs: DataFrame  # one row: n_docs


def fit_vocabulary(train: DataFrame, text_col: str, max_features: int = TFIDF_MAX_FEATURES, min_df: int = TFIDF_MIN_DF,
                   ngram_max: int = 2, width: int = SKETCH_WIDTH, depth: int = SKETCH_DEPTH) -> Vocabulary:
    """V3 + idf: terms in at least ``min_df`` of the ``train`` documents, top ``max_features`` by
    total count (ties by term), idf = ln((1 + n) / (1 + df)) + 1; n counts all documents, empty ones too.

    ``depth=0`` counts all terms without the sketch.  The top-k keeps at most
    ``max_features`` rows per partition before the single merge task.
    """
    n = train.agg(F.count(F.lit(1)).alias("n_docs"))
    tok = tokens(train.select(text_col), text_col, "terms", ngram_max)
    # One row a term and document for df, then one row an occurrence for tf: both meet in one aggregate by term.
    # explode_outer + null filter: a plain explode makes Catalyst infer a
    # ``size(terms) > 0`` filter and push it below the projection, which
    # would evaluate the regex / stop-word / n-gram work twice per row.
    once = tok.select("terms", F.array_distinct("terms").alias("own"))
    rows = once.select(F.size("own").alias("n_own"), F.posexplode_outer(F.concat("own", "terms")).alias("at", "term")).where(
        F.col("term").isNotNull()).select("term", (F.col("at") < F.col("n_own")).cast("int").alias("d"))
    if depth:
        rows = rows.where(frequency_sketch(tok, min_df, "terms", width, depth).may_hold(F.col("term")))
    stats = (rows.groupBy("term").agg(F.sum("d").alias("df"), (F.count(F.lit(1)) - F.sum("d")).alias("tf_total"))
             .where(F.col("df") >= min_df))
    top = stats.orderBy(F.col("tf_total").desc(), F.col("term").asc()).limit(max_features)
    idf = F.log((F.lit(1.0) + n.scalar()) / (F.lit(1.0) + F.col("df"))) + F.lit(1.0)
    # Column order of the vector: alphabetical, as the reference's vectoriser.
    # The window is global but sees at most ``max_features`` rows.
    index = F.row_number().over(Window.orderBy("term")) - 1
    return Vocabulary(top.select("term", "df", "tf_total", idf.alias("idf"), index.alias("term_index")), n)


def tfidf(df: DataFrame, vocab: Vocabulary, doc_col: str, text_col: str, keep: Iterable[str] = (),
          ngram_max: int = 2) -> DataFrame:
    """V4: (doc, term, term_index, tfidf) with each document's weights L2-normalised.

    Terms outside the vocabulary are dropped; a document with none left has
    no rows (a zero vector).  ``vocab`` is read twice: pass a materialised one.
    """
    vectors = tfidf_vectors(tokens(df.select(doc_col, *keep, text_col), text_col, "terms", ngram_max), vocab)
    sparse = F.unwrap_udt("text_vec")
    pairs = vectors.select(doc_col, *keep, F.inline(F.arrays_zip(
        sparse["indices"].alias("term_index"), sparse["values"].alias("tfidf"))))
    names = bounded(vocab.terms.select("term", "term_index"))
    return pairs.join(names, "term_index").select(doc_col, *keep, "term", "term_index", "tfidf")


def tfidf_vectors(df: DataFrame, vocab: Vocabulary, terms_col: str = "terms",
                  out_col: str = "text_vec") -> DataFrame:
    """V4 as Spark ML vectors: the same weights as :func:`tfidf`, row by row.

    The vocabulary (at most ``max_features`` terms, alphabetical) and its idf
    values are read back to the driver, as any fitted model holds them; the
    transform is then three JVM stages over each row's own tokens, with no
    shuffle: raw counts -> times idf -> L2 normalise.
    """
    from pyspark.ml.feature import CountVectorizerModel, ElementwiseProduct, Normalizer
    from pyspark.ml.linalg import Vectors

    rows = vocab.terms.orderBy("term_index").select("term", "idf").collect()
    words = [r["term"] for r in rows]
    idf = Vectors.dense([float(r["idf"]) for r in rows])
    counts = CountVectorizerModel.from_vocabulary(words, inputCol=terms_col, outputCol="_tf")
    scaled = ElementwiseProduct(scalingVec=idf, inputCol="_tf", outputCol="_tfidf")
    norm = Normalizer(p=2.0, inputCol="_tfidf", outputCol=out_col)
    return norm.transform(scaled.transform(counts.transform(df))).drop("_tf", "_tfidf")


# ---------------------------------------------------------------------------
# numeric scaling (V6)
# ---------------------------------------------------------------------------

@dataclass(frozen=True)
class Scaler:
    """Fitted per-column mean and population std (zero std -> scale 1)."""

    mean: dict[str, float]
    scale: dict[str, float]

    def transform(self, df: DataFrame, cols: Sequence[str] | None = None, suffix: str = "") -> DataFrame:
        cols = list(cols or self.mean)
        return df.withColumns({
            c + suffix: (F.coalesce(F.col(c).cast("double"), F.lit(0.0)) - F.lit(self.mean[c]))
            / F.lit(self.scale[c]) for c in cols})


def fit_scaler(train: DataFrame, cols: Sequence[str]) -> Scaler:
    """V6 fit: one aggregate over the training rows (missing values count as 0).

    The two fitted numbers per column are read back to the driver, the way
    a Spark ML model holds its parameters.
    """
    x = {c: F.coalesce(F.col(c).cast("double"), F.lit(0.0)) for c in cols}
    row = train.agg(*[F.avg(x[c]).alias(f"m_{c}") for c in cols],
                    *[F.stddev_pop(x[c]).alias(f"s_{c}") for c in cols]).first()
    mean = {c: float(row[f"m_{c}"] or 0.0) for c in cols}
    scale = {c: (float(row[f"s_{c}"]) if row[f"s_{c}"] else 1.0) for c in cols}
    return Scaler(mean, scale)
