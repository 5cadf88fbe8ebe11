"""Hashed term vectors (lexical embeddings), built without a shuffle.

A document's sparse vector is computed inside its own row with JVM
higher-order functions: tokens -> md5 buckets -> sort -> run lengths, so
the vectoriser is a narrow projection over the scan.  The only global step
is document frequency (one partial-aggregated ``groupBy(bucket)``, at most
``num_buckets`` rows after the map side), whose idf table is bounded by
``num_buckets`` and enters the projection as a scalar subquery array.

Vectors are kept packed: ``terms ARRAY<INT>`` (ascending buckets) and
``weights ARRAY<DOUBLE>`` L2-normalised, one row per document.  This is a
lexical stand-in for a neural embedder, not a reproduction of one; see
``udf_embedder`` for plugging a model in.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry import config
from quarry.functions.text import term_bucket, tokens


def _run_lengths(df: DataFrame, arr: str, keep) -> DataFrame:
    """Replace the sorted array column ``arr`` by (terms, weights=counts),
    O(n) per row with HOFs.  Run starts are materialised in their own
    projection: referenced twice, Catalyst keeps them computed once.
    ``get`` is 0-based and NULL out of range, so no bounds errors."""
    s = F.col(arr)
    n = F.size(s)
    starts = F.filter(
        F.sequence(F.lit(0), F.greatest(n - 1, F.lit(0))),
        lambda i: (n > 0) & ((i == 0) | (F.get(s, i) != F.get(s, i - 1))),
    )
    staged = df.select(*keep, s, starts.alias("__s"))
    st = F.col("__s")
    return staged.select(
        *keep,
        F.transform(st, lambda i: F.get(s, i)).alias("terms"),
        F.transform(st, lambda i, j: (F.coalesce(F.get(st, j + 1), F.size(s)) - i).cast("double")).alias("weights"),
    )


def _l2_normalise(df: DataFrame, w: str = "weights") -> DataFrame:
    """Divide by the row's L2 norm.  The norm is spread with array_repeat
    (evaluated once per row) and zipped in: a lambda that referenced it
    directly would recompute it per element once Catalyst inlines it."""
    nrm = F.sqrt(F.aggregate(F.col(w), F.lit(0.0), lambda acc, x: acc + x * x))
    norms = F.array_repeat(nrm, F.size(F.col(w)))
    return df.withColumn(w, F.zip_with(F.col(w), norms, lambda x, n: F.try_divide(x, n)))


def term_frequencies(docs: DataFrame, text_col: str = "text", id_col: str = "doc_id",
                     num_buckets: int = config.DEFAULT_NUM_BUCKETS, keep=(), partitions: int | None = None) -> DataFrame:
    """Raw counts per bucket: (id, terms, weights=count), unnormalised.

    ``partitions``: deal the rows to that many tasks first; for inputs that
    arrive in one split (a Parquet file of one row group)."""
    docs = docs.select(id_col, *keep, text_col)
    if partitions:
        docs = docs.repartition(partitions)
    buckets = F.array_sort(F.transform(tokens(text_col), lambda t: term_bucket(t, num_buckets)))
    return _run_lengths(docs.select(id_col, *keep, buckets.alias("__b")), "__b", [id_col, *keep])


def embed_tf(docs: DataFrame, text_col: str = "text", id_col: str = "doc_id",
             num_buckets: int = config.DEFAULT_NUM_BUCKETS, keep=(), partitions: int | None = None) -> DataFrame:
    """L2-normalised term-frequency vectors (per-document: incremental-safe)."""
    return _l2_normalise(term_frequencies(docs, text_col, id_col, num_buckets, keep, partitions))


def _with_idf(df: DataFrame, n_docs: Column) -> DataFrame:
    return df.withColumn("idf", F.log((n_docs + 1) / (F.col("df") + 1)) + 1)


def idf_table(tf: DataFrame) -> DataFrame:
    """(bucket, df, idf) with idf = ln((N+1)/(df+1)) + 1 over the corpus.
    At most ``num_buckets`` rows whatever the corpus size."""
    # explode_outer + IS NOT NULL, not explode: for a plain explode Spark
    # infers size(terms) > 0 and pushes it under the projection, which
    # would re-evaluate the whole vectoriser inside that predicate.
    buckets = tf.select(F.explode_outer("terms").alias("bucket")).where(F.col("bucket").isNotNull())
    df = buckets.groupBy("bucket").agg(F.count(F.lit(1)).alias("df"))
    return _with_idf(df, tf.select(F.count(F.lit(1))).scalar())


def _dense_idf(table: DataFrame, n_docs: Column, num_buckets: int) -> Column:
    from quarry.session import scratch_path

    spark = table.sparkSession
    every = spark.range(num_buckets).select(F.col("id").cast("int").alias("bucket"))
    full = every.join(table.select("bucket", "idf"), "bucket", "left").select(
        "bucket", F.coalesce(F.col("idf"), F.log(n_docs + 1) + 1).alias("idf"))
    dense = full.agg(F.sort_array(F.collect_list(F.struct("bucket", "idf"))).alias("e")).select(
        F.transform("e", lambda x: x["idf"]).alias("idf"))
    path = scratch_path(spark, "idf")
    dense.write.parquet(path)
    return spark.read.schema(dense.schema).parquet(path).scalar()


def idf_vector(tf: DataFrame, num_buckets: int = config.DEFAULT_NUM_BUCKETS) -> Column:
    """Dense idf array indexed by bucket (0-based ``get``); buckets no
    document uses get ln(N+1) + 1.  Document frequencies are computed once,
    here, and written to the shared folder; the returned scalar subquery
    reads that one row (``num_buckets`` doubles, fixed by the parameter)
    wherever it is used."""
    return _dense_idf(idf_table(tf), tf.select(F.count(F.lit(1))).scalar(), num_buckets)


def apply_idf(tf: DataFrame, idf: Column) -> DataFrame:
    """Weight raw counts by idf and L2-normalise."""
    staged = tf.withColumn("__idf", idf)
    out = staged.withColumn(
        "weights", F.zip_with("terms", "weights", lambda t, c: c * F.get(F.col("__idf"), t)))
    return _l2_normalise(out.drop("__idf"))


def embed_tfidf(docs: DataFrame, text_col: str = "text", id_col: str = "doc_id",
                num_buckets: int = config.DEFAULT_NUM_BUCKETS, keep=(), partitions: int | None = None):
    """(vectors, idf column) for a corpus; reuse the idf for queries.

    Term counts feed two passes (document frequency, then weighting), so
    they are written once to the shared checkpoint folder: the tokeniser -
    the CPU hot spot - runs once, and a lost executor re-reads instead of
    re-tokenising.
    """
    from quarry.session import scratch_path

    spark = docs.sparkSession
    tf = term_frequencies(docs, text_col, id_col, num_buckets, keep, partitions)
    path = scratch_path(spark, "term-counts")
    tf.write.parquet(path)
    tf = spark.read.schema(tf.schema).parquet(path)
    idf = idf_vector(tf, num_buckets)
    return apply_idf(tf, idf), idf


def embed_queries(queries: DataFrame, idf: Column, text_col: str = "query", id_col: str = "qid",
                  num_buckets: int = config.DEFAULT_NUM_BUCKETS) -> DataFrame:
    """Vectorise query texts with the corpus' idf (queries embedded bare)."""
    return apply_idf(term_frequencies(queries, text_col, id_col, num_buckets), idf)


def explode_vectors(vecs: DataFrame, id_col: str = "doc_id", digits: int | None = None) -> DataFrame:
    """Packed vectors -> long form (id, bucket, weight)."""
    z = vecs.select(id_col, F.explode_outer(F.arrays_zip("terms", "weights")).alias("z")) \
        .where(F.col("z").isNotNull())
    w = F.col("z.weights")
    return z.select(id_col, F.col("z.terms").alias("bucket"),
                    (F.round(w, digits) if digits is not None else w).alias("weight"))


def udf_embedder(factory, width: int | None = None):
    """Iterator pandas UDF (ARRAY<DOUBLE>) around a model.  ``factory()``
    runs once per task and returns ``fn(pandas.Series[str]) -> 2-d array or
    sequence of vectors``; ``width``, if given, is checked per batch."""
    from pyspark.sql.functions import pandas_udf

    from quarry.session import ship_package

    ship_package(SparkSession.getActiveSession())

    @pandas_udf("array<double>")
    def embed(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        fn = factory()
        for s in batches:
            vecs = [np.asarray(v, dtype=np.float64) for v in fn(s)]
            if width is not None:
                bad = [len(v) for v in vecs if len(v) != width]
                if bad:
                    raise ValueError(f"embedder returned width {bad[0]}, expected {width}")
            yield pd.Series(vecs)

    return embed


class DocumentFrequencies:
    """Stored document frequencies that follow an index.

    Each operation adds one folder ``delta=<id>`` with signed counts per
    bucket (documents added minus removed; bucket -1: the documents
    themselves), so the cost is that of the documents that differ.  Applying
    an operation again under its id replaces its folder.  :meth:`compact`
    sums the folders up."""

    def __init__(self, spark: SparkSession, path: str, num_buckets: int = config.DEFAULT_NUM_BUCKETS):
        self.spark, self.path, self.num_buckets = spark, path.rstrip("/"), num_buckets

    def apply(self, operation: int, added: DataFrame | None = None, removed: DataFrame | None = None) -> None:
        """Count packed vectors (``terms``) in and out."""
        parts = []
        for docs, sign in ((added, 1), (removed, -1)):
            if docs is not None:
                buckets = docs.select(F.explode(F.concat(F.array(F.lit(-1)), "terms")).alias("bucket"))
                parts.append(buckets.groupBy("bucket").agg((F.count(F.lit(1)) * sign).alias("n")))
        if parts:
            both = parts[0] if len(parts) == 1 else parts[0].unionByName(parts[1])
            both.groupBy("bucket").agg(F.sum("n").alias("n")).write.mode("overwrite").parquet(f"{self.path}/delta={operation}")

    def counts(self) -> DataFrame:
        """(bucket, df) of buckets that some document has; bucket -1: all documents."""
        deltas = self.spark.read.schema("bucket int, n bigint, delta bigint").parquet(self.path)
        return deltas.groupBy("bucket").agg(F.sum("n").alias("df")).where(F.col("df") != 0)

    def idf(self) -> DataFrame:
        """(bucket, df, idf) as :func:`idf_table` gives it for the documents counted."""
        counts = self.counts()
        n = counts.agg(F.coalesce(F.max(F.when(F.col("bucket") == -1, F.col("df"))), F.lit(0)).alias("n"))
        return _with_idf(counts.where(F.col("bucket") >= 0), n.scalar())

    def vector(self) -> Column:
        """The dense idf array (see :func:`idf_vector`)."""
        n = self.counts().where(F.col("bucket") == -1).agg(F.coalesce(F.max("df"), F.lit(0)).alias("n")).scalar()
        return _dense_idf(self.idf(), n, self.num_buckets)

    def compact(self, operation: int) -> None:
        """Sum all folders up into one, of the given (newest) id."""
        sc = self.spark.sparkContext
        root = sc._jvm.org.apache.hadoop.fs.Path(self.path)
        fs = root.getFileSystem(sc._jsc.hadoopConfiguration())
        old = [s.getPath() for s in fs.listStatus(root)]
        whole = sc._jvm.org.apache.hadoop.fs.Path(f"{self.path}/_whole")             # readers skip it
        self.counts().select("bucket", F.col("df").alias("n")).write.mode("overwrite").parquet(whole.toString())
        for p in old:
            fs.delete(p, True)
        fs.rename(whole, sc._jvm.org.apache.hadoop.fs.Path(f"{self.path}/delta={operation}"))


def probe_width(spark: SparkSession, embedder) -> int:
    """Width of an embedder's vectors, found by embedding one word."""
    return spark.range(1).select(F.size(embedder(F.lit("test")))).first()[0]


__all__ = ["embed_tf", "embed_tfidf", "embed_queries", "term_frequencies", "idf_table",
           "idf_vector", "apply_idf", "explode_vectors", "udf_embedder",
           "probe_width", "DocumentFrequencies"]
