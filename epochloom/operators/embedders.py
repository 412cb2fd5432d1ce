"""Text embedders: hash, character n-gram and TF-IDF, all as column or table jobs."""
from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.window import Window

from epochloom.functions import arrays, text
from epochloom.functions.scale import attach_row, join_keys, ranked, small_side
from epochloom.session import written


def _dense(entries: DataFrame, key: str, index: str, weight: str, dim: int) -> DataFrame:
    """Unit vectors from ``(key, index, weight)`` rows; a key holds at most ``dim`` of them."""
    packed = entries.groupBy(key).agg(F.map_from_entries(F.collect_list(F.struct(index, weight))).alias("_m"))
    raw = F.transform(
        F.sequence(F.lit(0), F.lit(dim - 1)),
        lambda i: F.coalesce(F.try_element_at(F.col("_m"), i), F.lit(0.0).cast("double")),
    )
    length = arrays.norm("_raw")
    return packed.withColumn("_raw", raw).select(
        key, F.when(length >= 1e-8, F.transform("_raw", lambda v: v / length)).alias("vec")
    )


def _or_hash(df: DataFrame, vectors: DataFrame, key: str, surface: str, dim: int, out: str) -> DataFrame:
    """Keep the vector, or the hash embedding where the text gave none."""
    return df.join(vectors.withColumnRenamed("vec", "_vec"), key, "left").withColumn(
        out, F.coalesce("_vec", text.hash_embedding(surface, dim))
    ).drop("_vec")


@dataclass
class HashEmbedder:
    """Stateless embedding from the SHA-256 of the surface."""

    dim: int = 64

    def fit(self, corpus: DataFrame, key: str = "key", surface: str = "surface") -> "HashEmbedder":
        return self

    def transform(self, df: DataFrame, key: str, surface: str, out: str = "vec") -> DataFrame:
        return df.withColumn(out, text.hash_embedding(surface, self.dim))


@dataclass
class CharGramEmbedder:
    """Hashed character 3- to 5-grams inside word edges, unit length."""

    dim: int = 64

    def fit(self, corpus: DataFrame, key: str = "key", surface: str = "surface") -> "CharGramEmbedder":
        return self

    def counts(self, df: DataFrame, key: str, surface: str) -> DataFrame:
        """Bucket counts per key; counted before the shuffle, at most ``dim`` rows per key."""
        grams = df.select(key, F.explode(text.char_grams(surface)).alias("gram"))
        return grams.groupBy(key, text.hash_bucket("gram", self.dim).alias("bucket")).agg(
            F.count(F.lit(1)).cast("double").alias("n")
        )

    def transform(self, df: DataFrame, key: str, surface: str, out: str = "vec") -> DataFrame:
        vectors = _dense(self.counts(df, key, surface), key, "bucket", "n", self.dim)
        return _or_hash(df, vectors, key, surface, self.dim, out)


def term_rows(df: DataFrame, key: str, surface: str, *extra: str) -> DataFrame:
    """Term counts per text: words and neighbouring word pairs."""
    return (
        df.select(key, *extra, F.explode(text.word_terms(surface)).alias("term"))
        .groupBy(key, *extra, "term").agg(F.count(F.lit(1)).alias("tf"))
    )


def term_totals(df: DataFrame, surface: str, *by: str) -> DataFrame:
    """``by, term, tf_total, df``: terms counted where the text is, so that only partial counts are shuffled.

    Each row is one document; the first of equal terms in it counts as the document.
    """
    return _sums(_marks(df, surface, *by), *by)


def _marks(df: DataFrame, surface: str, *by: str) -> DataFrame:
    """``by, term, tf, df`` rows of texts that are a document each."""
    listed = df.select(*by, text.word_terms(surface).alias("_w"))
    one = lambda w, n, d: F.transform(w, lambda t: F.struct(t.alias("term"), F.lit(n).alias("tf"), F.lit(d).alias("df")))
    return listed.select(*by, F.inline(F.concat(one(F.col("_w"), 1, 0), one(F.array_distinct("_w"), 0, 1))))


def _sums(marks: DataFrame, *by: str) -> DataFrame:
    return marks.groupBy(*by, "term").agg(F.sum("tf").alias("tf_total"), F.sum("df").alias("df"))


def fold_totals(df: DataFrame, key: str, surface: str, fold: str) -> DataFrame:
    """``term_totals`` by fold, where the rows of one key and fold are one document.

    Only the terms of such repeated keys are shuffled by key.
    """
    repeated = df.groupBy(key, fold).agg(F.count(F.lit(1)).alias("_n")).where("_n > 1").select(key, fold, F.lit(True).alias("_again"))
    repeated = written(repeated, "repeated")
    if repeated.isEmpty():
        return term_totals(df, surface, fold)
    rows = join_keys(df, small_side(repeated), [key, fold], "left")
    again = term_rows(rows.where("_again"), key, surface, fold).select(fold, "term", "tf", F.lit(1).alias("df"))
    return _sums(_marks(rows.where("_again IS NULL"), surface, fold).unionByName(again), fold)


def document_frequency(df: DataFrame, key: str, surface: str) -> DataFrame:
    """Corpus count, document frequency and smoothed IDF of every term; ``key`` is unique."""
    totals = df.agg(F.count(F.lit(1)).alias("n_docs"))
    counts = term_totals(df, surface)
    return attach_row(counts, totals).withColumn("idf", F.log((F.col("n_docs") + 1) / (F.col("df") + 1)) + 1)


def top_terms(frequencies: DataFrame, dim: int) -> DataFrame:
    """The ``dim`` most counted terms, numbered by name (ties go to the smaller name)."""
    best = frequencies.orderBy(F.desc("tf_total"), "term").limit(dim)
    # at most ``dim`` rows from here on
    return best.withColumn("idx", F.row_number().over(Window.orderBy("term")) - 1)


@dataclass
class TfidfEmbedder:
    """Word TF-IDF fitted on training text only, unit length."""

    dim: int = 64
    terms: DataFrame | None = field(default=None, repr=False)

    def fit(self, corpus: DataFrame, key: str = "key", surface: str = "surface") -> "TfidfEmbedder":
        self.terms = top_terms(document_frequency(corpus, key, surface), self.dim).select("term", "idf", "idx")
        return self

    def transform(self, df: DataFrame, key: str, surface: str, out: str = "vec") -> DataFrame:
        if self.terms is None:
            raise ValueError("fit the embedder on training text first")
        # the fitted table has at most ``dim`` rows
        # and meets the terms before they are shuffled
        met = df.select(key, F.explode(text.word_terms(surface)).alias("term")).join(F.broadcast(self.terms), "term", "inner")
        weights = met.groupBy(key, "term", "idx", "idf").agg(F.count(F.lit(1)).alias("tf")).select(
            key, "idx", (F.col("tf") * F.col("idf")).alias("w")
        )
        return _or_hash(df, _dense(weights, key, "idx", "w", self.dim), key, surface, self.dim, out)


@dataclass
class FunctionEmbedder:
    """A user function ``(surface, dim) -> vector``, run over Arrow batches."""

    fn: Callable[[str, int], np.ndarray]
    dim: int = 64

    def fit(self, corpus: DataFrame, key: str = "key", surface: str = "surface") -> "FunctionEmbedder":
        return self

    def transform(self, df: DataFrame, key: str, surface: str, out: str = "vec") -> DataFrame:
        fn, dim = self.fn, self.dim

        @F.pandas_udf("array<double>")
        def embed(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
            for batch in batches:
                # each distinct surface of a batch is embedded once
                codes, values = pd.factorize(batch)
                vectors = [list(np.asarray(fn(v, dim), dtype=np.float64)) for v in values]
                yield pd.Series([vectors[c] for c in codes])

        return df.withColumn(out, embed(F.col(surface)))


def fold_terms(df: DataFrame, key: str, surface: str, fold: str, dim: int) -> DataFrame:
    """Fold-local TF-IDF terms without refitting: totals less the counts of the held-out group.

    Texts are tokenised once; rows of one key and fold are one document. A fold's best terms lie among its own terms and the first ``dim`` terms of the whole
    corpus that it doesn't hold; only those are formed, so besides the fold's own terms there are ``dim`` rows a fold.
    """
    counts = fold_totals(df, key, surface, fold)
    by_term = written(counts.groupBy("term").agg(
        F.sum("tf_total").alias("tf_total"), F.sum("df").alias("df"), (-F.sum("tf_total")).alias("_neg"),
        F.collect_list(F.struct(F.col(fold).alias("fold"), F.col("tf_total").alias("tf"), F.col("df").alias("df"))).alias("held"),
    ), "terms")
    corpus = written(ranked(by_term, [], ["_neg", "term"], "rank").drop("_neg"), "ranked")
    sizes = df.groupBy(fold).agg(F.count(F.lit(1)).alias("docs_held"))
    docs = attach_row(sizes, sizes.agg(F.sum("docs_held").alias("n_docs"))).where(F.col(fold).isNotNull())
    own = corpus.select("term", "rank", "tf_total", F.col("df").alias("_df"), F.explode("held").alias("h")).select(
        F.col("h.fold").alias(fold), "term", "rank", (F.col("tf_total") - F.col("h.tf")).alias("tf_train"), (F.col("_df") - F.col("h.df")).alias("df_train"),
    ).where(F.col(fold).isNotNull())
    others = _ranks_not_held(own.select(fold, "rank"), docs.select(fold), fold, dim).join(corpus, "rank", "inner").select(
        fold, "term", F.col("tf_total").alias("tf_train"), F.col("df").alias("df_train")
    )
    best = Window.partitionBy(fold).orderBy(F.desc("tf_train"), "term")
    scored = own.drop("rank").unionByName(others).where("df_train > 0")
    chosen = scored.withColumn("_r", F.row_number().over(best)).where(F.col("_r") <= dim).drop("_r")
    # each fold keeps at most ``dim`` rows here
    numbered = chosen.join(docs, fold, "inner").select(fold, "term", "tf_train", "df_train", (F.col("n_docs") - F.col("docs_held")).alias("n_train"))
    return numbered.withColumn("idf", F.log((F.col("n_train") + 1) / (F.col("df_train") + 1)) + 1).withColumn(
        "idx", F.row_number().over(Window.partitionBy(fold).orderBy("term")) - 1
    )


def _ranks_not_held(held: DataFrame, folds: DataFrame, fold: str, dim: int) -> DataFrame:
    """``fold, rank``: the first ``dim`` ranks that each fold doesn't hold.

    The i-th held rank ``r`` has ``r - i`` others before it; so the k-th other one is ``k`` plus the number of held
    ranks with fewer than ``k`` before them. No rank beyond those is listed.
    """
    before = ranked(held, [fold], ["rank"], "_i").select(fold, (F.col("rank") - F.col("_i")).alias("_c")).where(F.col("_c") < dim)
    counted = before.groupBy(fold, "_c").agg(F.count(F.lit(1)).alias("_n"))
    places = folds.withColumn("_c", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(dim - 1).cast("long"))))
    w = Window.partitionBy(fold).orderBy("_c")
    rank = F.col("_c") + 1 + F.sum(F.coalesce("_n", F.lit(0))).over(w)
    # written, so that the join knows its size
    return small_side(written(places.join(counted, [fold, "_c"], "left").select(fold, rank.alias("rank")), "others"))


def fold_embeddings(
    surfaces: DataFrame, key: str, surface: str, terms: DataFrame, fold: str, dim: int, out: str = "vec"
) -> DataFrame:
    """Embeddings of the surfaces under every fold that ``surfaces`` names in its fold column."""
    weights = (
        surfaces.select(fold, key, F.explode(text.word_terms(surface)).alias("term"))
        .groupBy(fold, key, "term").agg(F.count(F.lit(1)).alias("tf"))
        .join(terms.select(fold, "term", "idf", "idx"), [fold, "term"], "inner")
        .select(F.struct(fold, key).alias("_k"), "idx", (F.col("tf") * F.col("idf")).alias("w"))
    )
    vectors = _dense(weights, "_k", "idx", "w", dim).select("_k.*", "vec")
    return surfaces.join(vectors, [fold, key], "left").withColumn(
        out, F.coalesce("vec", text.hash_embedding(surface, dim))
    )
