"""Result shaping for searches: regroup hits by repository, summaries,
hit projection and late payload fetch.

Hits are already a top-k (bounded) set, so the regrouping shuffles at most
k rows; everything stays a DataFrame so a batch of queries (a ``qid``
column) regroups in the same job.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quarry import config
from quarry.functions.text import preview


def group_hits_by_repo(hits: DataFrame, limit: int = config.GROUPED_SEARCH_LIMIT,
                       repo_col: str = "repo_name", id_col: str = "doc_id",
                       by: Sequence[str] = (), digits: int | None = None) -> DataFrame:
    """One row per (repository, matching file) for the best ``limit``
    repositories, ranked by mean hit score (ties by name); files ranked by
    score inside each.  ``by`` adds grouping keys such as a query id."""
    by = list(by)
    repo_w = Window.partitionBy(*by, repo_col)
    rel = F.avg("score").over(repo_w)
    if digits is not None:
        rel = F.round(rel, digits)
    g = (hits.withColumn("relevance_score", rel)
         .withColumn("files_in_repo", F.count(F.lit(1)).over(repo_w))
         .withColumn("file_rank", F.row_number().over(
             repo_w.orderBy(F.desc_nulls_last("score"), F.asc(id_col))).cast("bigint")))
    repo_rank = F.dense_rank().over(
        Window.partitionBy(*by).orderBy(F.desc_nulls_last("relevance_score"), F.asc(repo_col))).cast("bigint")
    return g.withColumn("repo_rank", repo_rank).where(F.col("repo_rank") <= limit)


def hits_summary(hits: DataFrame, repo_col: str = "repo_name", by: Sequence[str] = ()) -> DataFrame:
    """total_results and repositories_found over a hit set."""
    agg = [F.count(F.lit(1)).alias("total_results"),
           F.count_distinct(repo_col).alias("repositories_found")]
    return hits.groupBy(*by).agg(*agg) if by else hits.agg(*agg)


HIT_FIELDS = ("path", "content", "repo_name", "score", "extension", "size", "modified")


def project_hits(hits: DataFrame, with_preview: bool = False, extra: Sequence[str] = ()) -> DataFrame:
    """Public hit fields (hash and added_at dropped), after the ``extra``
    ones the caller wants; optional preview."""
    cols = [c for c in HIT_FIELDS if c in hits.columns]
    out = hits.select(*extra, *cols)
    return out.withColumn("preview", preview("content")) if with_preview else out


def fetch_payload(hits: DataFrame, docs: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """Late fetch: join a hit list to the payload table by id.  Spark
    broadcasts the hits when their measured size allows and shuffles both
    by id otherwise."""
    return docs.join(hits, id_col, "inner")
