"""Query catalog: name -> builder(spark, sf_dir) -> DataFrame, and the
equivalent SQL (DuckDB dialect) over the same tables.

Scores are rounded to 6 places before ranking on both sides, and every
ordering ends in an id, so results are deterministic and comparable.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.operators import knn as K
from quarry.sources.tables import load

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}

DIGITS = 6
K_HITS = 10
PROBE_REPO = 0          # repository filter used by the filtered searches
MIN_SCORE = 0.3


def register(name: str, sql: str | None = None):
    def deco(fn):
        QUERIES[name] = fn
        if sql is not None:
            ORACLE_SQL[name] = sql.strip()
        return fn
    return deco


# ------------------------------------------------------------------ vectors
# The probe query is the corpus' first vector (smallest id): a data-derived
# query, delivered to the scan as a one-row scalar subquery.

def _emb(spark, d):
    return load(spark, d, "embeddings")


def _probe(emb: DataFrame) -> DataFrame:
    first = emb.select(F.min("vec_id")).scalar()
    return emb.where(F.col("vec_id") == first).select("embedding", "label")


_Q = """WITH q AS (SELECT embedding::DOUBLE[] AS qv, label AS ql FROM embeddings
                   WHERE vec_id = (SELECT min(vec_id) FROM embeddings))"""
_COS = "round(list_cosine_similarity(e.embedding::DOUBLE[], q.qv), 6)"


def _knn(spark, d, **kw):
    emb = _emb(spark, d)
    hits = K.knn(emb, _probe(emb), k=kw.pop("k", K_HITS), id_col="vec_id", repo_col="label",
                 digits=DIGITS, **kw)
    return hits.select("vec_id", "label", "score")


register("knn_cosine", f"""{_Q}
SELECT e.vec_id, e.label, {_COS} AS score FROM embeddings e, q
ORDER BY score DESC NULLS LAST, e.vec_id LIMIT {K_HITS}""")(
    lambda spark, d: _knn(spark, d, metric="cosine"))

register("knn_cosine_distance", f"""{_Q}
SELECT e.vec_id, e.label, round(1 - list_cosine_distance(e.embedding::DOUBLE[], q.qv), 6) AS score
FROM embeddings e, q ORDER BY score DESC NULLS LAST, e.vec_id LIMIT {K_HITS}""")(
    lambda spark, d: _knn(spark, d, metric="cosine_distance"))

register("knn_l2", f"""{_Q}
SELECT e.vec_id, e.label, round(1.0 / (1.0 + pow(list_distance(e.embedding::DOUBLE[], q.qv), 2)), 6) AS score
FROM embeddings e, q ORDER BY score DESC NULLS LAST, e.vec_id LIMIT {K_HITS}""")(
    lambda spark, d: _knn(spark, d, metric="l2"))

register("knn_dot", f"""{_Q}
SELECT e.vec_id, e.label, round(list_dot_product(e.embedding::DOUBLE[], q.qv), 6) AS score
FROM embeddings e, q ORDER BY score DESC NULLS LAST, e.vec_id LIMIT {K_HITS}""")(
    lambda spark, d: _knn(spark, d, metric="dot"))

register("knn_filtered", f"""{_Q}
SELECT e.vec_id, e.label, {_COS} AS score FROM embeddings e, q WHERE e.label = {PROBE_REPO}
ORDER BY score DESC NULLS LAST, e.vec_id LIMIT {K_HITS}""")(
    lambda spark, d: _knn(spark, d, repo=PROBE_REPO))

register("knn_postfilter", f"""{_Q}
SELECT * FROM (SELECT e.vec_id, e.label, {_COS} AS score FROM embeddings e, q
               ORDER BY score DESC NULLS LAST, e.vec_id LIMIT {K_HITS}) t WHERE label = {PROBE_REPO}""")(
    lambda spark, d: _knn(spark, d, repo=PROBE_REPO, prefilter=False))

register("knn_min_score", f"""{_Q}
SELECT * FROM (SELECT e.vec_id, e.label, {_COS} AS score FROM embeddings e, q) t
WHERE score >= {MIN_SCORE} ORDER BY score DESC NULLS LAST, vec_id LIMIT {K_HITS}""")(
    lambda spark, d: _knn(spark, d, min_score=MIN_SCORE))


@register("knn_per_repo", f"""{_Q}
SELECT * FROM (SELECT e.vec_id, e.label, {_COS} AS score,
  row_number() OVER (PARTITION BY e.label ORDER BY {_COS} DESC NULLS LAST, e.vec_id) AS rank
  FROM embeddings e, q) t WHERE rank <= 3""")
def _knn_per_repo(spark, d):
    emb = _emb(spark, d)
    return K.knn_per_group(emb, _probe(emb), 3, group_col="label", id_col="vec_id",
                           digits=DIGITS).select("vec_id", "label", "score", "rank")


@register("vector_dims", "SELECT len(embedding) AS dim, count(*) AS n FROM embeddings GROUP BY 1")
def _vector_dims(spark, d):
    return K.vector_dims(_emb(spark, d))


@register("index_stats", """
SELECT 'spark-parquet' AS db_type, count(*) AS total_documents, max(len(embedding))::BIGINT AS vector_size,
       'cosine' AS distance_metric FROM embeddings""")
def _index_stats(spark, d):
    return K.index_stats(_emb(spark, d))


@register("knn_batch", f"""
SELECT * FROM (SELECT q.vec_id AS qid, e.vec_id AS doc_id,
  round(list_cosine_similarity(q.embedding::DOUBLE[], e.embedding::DOUBLE[]), 6) AS score,
  row_number() OVER (PARTITION BY q.vec_id ORDER BY
     round(list_cosine_similarity(q.embedding::DOUBLE[], e.embedding::DOUBLE[]), 6) DESC NULLS LAST, e.vec_id) AS rank
  FROM embeddings q, embeddings e) t WHERE rank <= {K_HITS}""")
def _knn_batch(spark, d):
    emb = _emb(spark, d)
    return K.knn_join(emb, emb, k=K_HITS, q_id="vec_id", c_id="vec_id", digits=DIGITS)


def _grouped_hits(spark, d, limit: int = 5):
    """Over-fetch 2 x limit hits, then regroup by repository."""
    emb = _emb(spark, d)
    return K.knn(emb, _probe(emb), k=2 * limit, id_col="vec_id", repo_col="label", digits=DIGITS)


_HITS2 = f"""{_Q}, hits AS (SELECT e.vec_id, e.label, {_COS} AS score FROM embeddings e, q
          ORDER BY score DESC NULLS LAST, e.vec_id LIMIT 10)"""


@register("search_by_repo", f"""{_HITS2},
g AS (SELECT *, round(avg(score) OVER (PARTITION BY label), 6) AS relevance_score,
             count(*) OVER (PARTITION BY label) AS files_in_repo,
             row_number() OVER (PARTITION BY label ORDER BY score DESC NULLS LAST, vec_id) AS file_rank
      FROM hits),
r AS (SELECT *, dense_rank() OVER (ORDER BY relevance_score DESC NULLS LAST, label) AS repo_rank FROM g)
SELECT label, relevance_score, files_in_repo, repo_rank, vec_id, score, file_rank FROM r WHERE repo_rank <= 5""")
def _search_by_repo(spark, d):
    from quarry.operators.retrieve import group_hits_by_repo
    g = group_hits_by_repo(_grouped_hits(spark, d), 5, repo_col="label", id_col="vec_id", digits=DIGITS)
    return g.select("label", "relevance_score", "files_in_repo", "repo_rank", "vec_id", "score", "file_rank")


@register("search_summary", f"""{_HITS2}
SELECT count(*) AS total_results, count(DISTINCT label) AS repositories_found FROM hits""")
def _search_summary(spark, d):
    from quarry.operators.retrieve import hits_summary
    return hits_summary(_grouped_hits(spark, d), repo_col="label")


# ------------------------------------------------------------------ files
# documents stand in for a file tree: source = repository, a derived path
# per document (ignored directories, look-alikes, odd suffixes), n_chars =
# size (bytes).  SMALL_CAP makes the size rule bite at this data's scale and
# is used only where the size rule is what the query shows; everything else
# uses the default limit.

SMALL_CAP = 2000
SIZE_CAP = 2 * 1024 * 1024
_DOC_PATH = """concat(source, '/',
  CASE doc_id % 5 WHEN 0 THEN 'src' WHEN 1 THEN 'node_modules/lib' WHEN 2 THEN 'docs/build'
                  WHEN 3 THEN '.github' ELSE 'rebuild' END,
  '/f', doc_id::VARCHAR,
  CASE doc_id % 7 WHEN 0 THEN '.py' WHEN 1 THEN '.tar.gz' WHEN 2 THEN '.PY' WHEN 3 THEN '.md'
                  WHEN 4 THEN '.' WHEN 5 THEN '' ELSE '.js' END)"""
_EXT = r"regexp_extract(path, '(?s)^(?:.*/)?[^/]+(\.[^./]+)$', 1)"
_IGN = "list_has_any(string_split(path, '/'), {ign})"
_FILES = f"""WITH f0 AS (SELECT doc_id, source AS repo_name, {_DOC_PATH} AS path, text AS content,
                          strlen(text)::BIGINT AS size, lang FROM documents),
     files AS (SELECT *, {_EXT} AS extension FROM f0)"""


def _sql_list(xs) -> str:
    return "[" + ", ".join("'" + x + "'" for x in sorted(xs)) + "]"


def _files(spark, d):
    from quarry.sources.tables import documents_as_files
    return documents_as_files(load(spark, d, "documents"))


def _eligible(spark, d, limit_bytes=SIZE_CAP):
    from quarry.operators.filters import eligible_files
    return eligible_files(_files(spark, d), limit_bytes=limit_bytes)


def _sqlf():
    from quarry import config
    ign = _IGN.format(ign=_sql_list(config.IGNORE_DIRS))
    ext = f"extension IN ({', '.join(repr(e) for e in sorted(config.SUPPORTED_EXTENSIONS))})"
    return ign, ext


_IGN_SQL, _EXT_SQL = _sqlf()
_ELIG_SMALL = f"""{_FILES}, elig AS (SELECT * FROM files WHERE size <= {SMALL_CAP} AND {_EXT_SQL} AND NOT {_IGN_SQL})"""
_ELIG = f"""{_FILES}, elig AS (SELECT * FROM files WHERE size <= {SIZE_CAP} AND {_EXT_SQL} AND NOT {_IGN_SQL})"""


@register("path_extension", f"{_FILES} SELECT doc_id, path, extension FROM files")
def _path_extension(spark, d):
    return _files(spark, d).select("doc_id", "path", "extension")


@register("filter_ignored_dirs", f"{_FILES} SELECT doc_id, path FROM files WHERE NOT {_IGN_SQL}")
def _filter_ignored_dirs(spark, d):
    from quarry.operators.filters import filter_ignored_dirs
    return filter_ignored_dirs(_files(spark, d)).select("doc_id", "path")


@register("filter_extension", f"{_FILES} SELECT doc_id, path, extension FROM files WHERE {_EXT_SQL}")
def _filter_extension(spark, d):
    from quarry.operators.filters import filter_extension
    return filter_extension(_files(spark, d)).select("doc_id", "path", "extension")


@register("filter_size", f"{_FILES} SELECT doc_id, size FROM files WHERE size <= {SMALL_CAP}")
def _filter_size(spark, d):
    from quarry.operators.filters import filter_size
    return filter_size(_files(spark, d), SMALL_CAP).select("doc_id", "size")


@register("eligible_files", f"{_ELIG_SMALL} SELECT doc_id, repo_name, path, extension, size FROM elig")
def _eligible_files(spark, d):
    return _eligible(spark, d, SMALL_CAP).select("doc_id", "repo_name", "path", "extension", "size")


@register("content_hash", "SELECT doc_id, md5(regexp_replace(text, '\\r\\n?', '\n', 'g')) AS hash FROM documents")
def _content_hash(spark, d):
    from quarry.functions.text import content_hash, normalize_newlines
    return load(spark, d, "documents").select("doc_id", content_hash(normalize_newlines("text")).alias("hash"))


_PAGES = r"""WITH p0 AS (SELECT page_id, url, regexp_replace(url, '[?#].*$', '') AS clean, html FROM pages),
pg AS (SELECT page_id, url, regexp_extract(clean, '^[A-Za-z][A-Za-z0-9+.-]*://([^/]+)', 1) AS repo_name,
              regexp_extract(clean, '^[A-Za-z][A-Za-z0-9+.-]*://[^/]+/?(.*)$', 1) AS path,
              html AS content, strlen(html)::BIGINT AS size FROM p0)"""


@register("file_records", _PAGES + r"""
SELECT page_id, repo_name, path, path AS full_path, regexp_extract(path, '(?s)^(?:.*/)?[^/]+(\.[^./]+)$', 1) AS extension,
       size, md5(regexp_replace(content, '\r\n?', chr(10), 'g')) AS hash,
       length(regexp_replace(content, '\r\n?', chr(10), 'g'))::BIGINT AS n_chars
FROM pg WHERE length(content) > 0""")
def _file_records(spark, d):
    from quarry.operators.records import file_records
    from quarry.sources.tables import pages_as_files
    rec = file_records(pages_as_files(load(spark, d, "pages")), keep=("page_id", "repo_name"))
    return rec.select("page_id", "repo_name", "path", "full_path", "extension", "size", "hash",
                      F.length("content").cast("bigint").alias("n_chars"))


@register("repo_name_from_url", r"""
SELECT page_id, url, replace(string_split(url, '/')[-1], '.git', '') AS repo_name,
       regexp_replace(string_split(regexp_replace(url, '/+$', ''), '/')[-1], '\.git$', '') AS repo_name_clean
FROM pages""")
def _repo_name_from_url(spark, d):
    from quarry.functions.text import repo_name_from_url
    return load(spark, d, "pages").select(
        "page_id", "url", repo_name_from_url("url", strict_compat=True).alias("repo_name"),
        repo_name_from_url("url").alias("repo_name_clean"))


@register("embedding_text", f"""{_FILES}
SELECT doc_id, 'File: ' || path || chr(10) || chr(10) || 'Content:' || chr(10) || content AS embedding_text FROM files""")
def _embedding_text(spark, d):
    from quarry.functions.text import embedding_text
    return _files(spark, d).select("doc_id", embedding_text("path", "content").alias("embedding_text"))


def _preview_sql():
    from quarry.functions.text import PY_WHITESPACE
    ws = PY_WHITESPACE
    return (f"SELECT doc_id, substring(replace(regexp_replace(text, '^{ws}+|{ws}+$', '', 'g'), chr(10), ' '), 1, 150)"
            f" || '...' AS preview FROM documents")


@register("hit_preview", _preview_sql())
def _hit_preview(spark, d):
    from quarry.functions.text import preview
    return load(spark, d, "documents").select("doc_id", preview("text").alias("preview"))


# ------------------------------------------------------------------ aggregates

@register("language_histogram", f"""{_ELIG}
SELECT repo_name, extension, count(*) AS n_files FROM elig GROUP BY ALL""")
def _language_histogram(spark, d):
    from quarry.operators.aggregates import language_histogram
    return language_histogram(_eligible(spark, d))


@register("repo_metadata", f"""{_ELIG},
h AS (SELECT repo_name, extension, count(*) AS n FROM elig GROUP BY ALL),
m AS (SELECT repo_name, '{{' || string_agg('"' || extension || '":' || n::VARCHAR, ',' ORDER BY extension) || '}}' AS languages
      FROM h GROUP BY repo_name)
SELECT e.repo_name AS name, e.repo_name AS path, 'local:' || e.repo_name AS url, count(*) AS file_count,
       sum(size)::BIGINT AS total_bytes, round(sum(size) / 1048576.0, 3) AS size_mb, any_value(m.languages) AS languages
FROM elig e JOIN m USING (repo_name) GROUP BY e.repo_name""")
def _repo_metadata(spark, d):
    from quarry.operators.aggregates import repo_metadata
    md = repo_metadata(_eligible(spark, d)).drop("last_updated")
    return md.withColumn("languages", F.to_json("languages"))


@register("language_totals", f"""{_ELIG} SELECT extension, count(*) AS n_files FROM elig GROUP BY ALL""")
def _language_totals(spark, d):
    from quarry.operators.aggregates import language_totals
    return language_totals(_eligible(spark, d))


@register("top_languages", f"""{_FILES}
SELECT extension, count(*) AS n_files FROM files GROUP BY ALL ORDER BY n_files DESC, extension LIMIT 10""")
def _top_languages(spark, d):
    from quarry.operators.aggregates import top_languages
    return top_languages(_files(spark, d))


@register("repo_names", "SELECT DISTINCT source AS repo_name FROM documents")
def _repo_names(spark, d):
    from quarry.operators.aggregates import repo_names
    return repo_names(_files(spark, d))




# ------------------------------------------------------------------ text search
# Hashed term vectors over the embedding text (path + content) of every
# document; the batch of queries is every user turn of the conversations
# table, embedded bare with the corpus idf.

NB = 65536
_TOK = r"regexp_extract_all(lower({c}), '[\p{{L}}\p{{N}}_]+')"
_BK = f"((('0x' || substr(md5(t), 1, 8))::BIGINT) % {NB})::INTEGER"
_ETEXT = "'File: ' || path || chr(10) || chr(10) || 'Content:' || chr(10) || content"
_TF_SQL = f"""{_FILES},
tok AS (SELECT doc_id, unnest({_TOK.format(c=_ETEXT)}) AS t FROM files),
tf AS (SELECT doc_id, {_BK} AS bucket, count(*)::DOUBLE AS c FROM tok GROUP BY ALL)"""
_IDF_SQL = """
nd AS (SELECT count(*) AS n FROM documents),
idf AS (SELECT bucket, ln((nd.n + 1.0) / (count(*) + 1.0)) + 1 AS idf FROM tf, nd GROUP BY bucket, nd.n),
tw AS (SELECT doc_id, bucket, c * idf AS w FROM tf JOIN idf USING (bucket)),
dv AS (SELECT doc_id, bucket, w / sqrt(sum(w * w) OVER (PARTITION BY doc_id)) AS w FROM tw)"""
_QV_SQL = f"""
qs AS (SELECT conv_id || '/' || turn AS qid, text FROM conversations WHERE role = 'user'),
qtok AS (SELECT qid, unnest({_TOK.format(c='text')}) AS t FROM qs),
qtf AS (SELECT qid, {_BK} AS bucket, count(*)::DOUBLE AS c FROM qtok GROUP BY ALL),
qw AS (SELECT qid, bucket, c * coalesce(idf.idf, ln(nd.n + 1.0) + 1) AS w
       FROM qtf LEFT JOIN idf USING (bucket), nd),
qv AS (SELECT qid, bucket, w / sqrt(sum(w * w) OVER (PARTITION BY qid)) AS w FROM qw)"""


def _embeddable(spark, d) -> DataFrame:
    from quarry.functions.text import embedding_text
    return _files(spark, d).withColumn("embedding_text", embedding_text("path", "content"))


def _tasks(spark, d, table: str = "documents") -> int | None:
    """How many tasks to deal a table to before tokenising: one per core if
    its scan has fewer splits than cores (here: one row group), else none,
    as then the shuffle of all texts would gain nothing."""
    cores = spark.sparkContext.defaultParallelism
    return cores if load(spark, d, table).rdd.getNumPartitions() < cores else None


def _doc_tfidf(spark, d, id_col="doc_id"):
    from quarry.operators.embed import embed_tfidf
    return embed_tfidf(_embeddable(spark, d), "embedding_text", id_col, NB, partitions=_tasks(spark, d))


def _query_vectors(spark, d, idf):
    from quarry.operators.embed import embed_queries
    from quarry.sources.tables import query_turns
    return embed_queries(query_turns(load(spark, d, "conversations")), idf, "query", "qid", NB)


@register("embed_tf", f"""{_TF_SQL}
SELECT doc_id, bucket, round(c / sqrt(sum(c * c) OVER (PARTITION BY doc_id)), 6) AS weight FROM tf""")
def _embed_tf(spark, d):
    from quarry.operators.embed import embed_tf, explode_vectors
    vecs = embed_tf(_embeddable(spark, d), "embedding_text", "doc_id", NB, partitions=_tasks(spark, d))
    return explode_vectors(vecs, "doc_id", DIGITS)


@register("embed_tfidf", f"""{_TF_SQL}, {_IDF_SQL}
SELECT doc_id, bucket, round(w, 6) AS weight FROM dv""")
def _embed_tfidf(spark, d):
    from quarry.operators.embed import explode_vectors
    vecs, _ = _doc_tfidf(spark, d)
    return explode_vectors(vecs, "doc_id", DIGITS)


@register("embed_queries", f"""{_TF_SQL}, {_IDF_SQL}, {_QV_SQL}
SELECT qid, bucket, round(w, 6) AS weight FROM qv""")
def _embed_queries(spark, d):
    from quarry.operators.embed import explode_vectors
    _, idf = _doc_tfidf(spark, d)
    return explode_vectors(_query_vectors(spark, d, idf), "qid", DIGITS)


# Every document is ranked for every query; those without a shared term
# score 0.
_HITS_SQL = f"""{_TF_SQL}, {_IDF_SQL}, {_QV_SQL},
m AS (SELECT qid, doc_id, sum(qv.w * dv.w) AS score FROM qv JOIN dv USING (bucket) GROUP BY ALL),
s AS (SELECT qs.qid, f.doc_id, f.repo_name, round(coalesce(m.score, 0), 6) AS score
      FROM qs CROSS JOIN files f LEFT JOIN m ON m.qid = qs.qid AND m.doc_id = f.doc_id)"""


@register("search_text", f"""{_HITS_SQL},
r AS (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY score DESC, doc_id) AS rank FROM s)
SELECT qid, doc_id, score, rank FROM r WHERE rank <= {K_HITS}""")
def _search_text(spark, d):
    from quarry.operators.search import search_vectors
    docs, idf = _doc_tfidf(spark, d)
    return search_vectors(_query_vectors(spark, d, idf), docs, k=K_HITS, digits=DIGITS)


SEARCHED_REPO = "src3"


@register("search_index", f"""{_HITS_SQL},
sh AS (SELECT s.qid, sha256(f.repo_name || chr(31) || f.path) AS id, s.score, f.* EXCLUDE (repo_name), f.repo_name
       FROM s JOIN files f USING (doc_id) WHERE s.repo_name = '{SEARCHED_REPO}'),
r AS (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY score DESC, id) AS rank FROM sh)
SELECT qid, id AS doc_id, path, md5(content) AS content_md5, repo_name, score, extension, size, rank FROM r WHERE rank <= 3""")
def _search_index(spark, d):
    """Add every repository to an index, search one of them with every
    user turn, and fetch the hits' payload."""
    from quarry.operators.lifecycle import with_doc_id
    from quarry.operators.retrieve import fetch_payload, project_hits
    from quarry.operators.search import search_vectors
    store, idf = _index(spark, d)
    vectors = store.read("vectors", SEARCHED_REPO)
    hits = search_vectors(_query_vectors(spark, d, idf), vectors, k=3, digits=DIGITS)
    full = fetch_payload(hits, store.read("docs", SEARCHED_REPO))
    shown = project_hits(full, extra=("qid", "doc_id", "rank"))
    return shown.select("qid", "doc_id", "path", F.md5(F.col("content").cast("binary")).alias("content_md5"), "repo_name", "score",
                        "extension", "size", "rank")


def _index(spark, d):
    """A store with every document of the table: payload and tf-idf vectors."""
    from quarry.operators.lifecycle import registry_from_files, with_doc_id
    from quarry.operators.records import index_payload
    from quarry.session import scratch_path
    from quarry.sources.store import IndexStore
    files = _files(spark, d)
    docs = index_payload(with_doc_id(files.drop("doc_id", "lang")))
    ids = with_doc_id(_embeddable(spark, d).drop("doc_id"))
    from quarry.operators.embed import embed_tfidf
    vecs, idf = embed_tfidf(ids, "embedding_text", "doc_id", NB, keep=("repo_name",), partitions=_tasks(spark, d))
    store = IndexStore(spark, scratch_path(spark, "store"), num_parts=16)
    store.add(docs, vecs, registry_from_files(files))
    return store, idf


# ------------------------------------------------------------------ lifecycle
# Two snapshots of the doc* file tree, derived so both engines can build
# them: the old one lacks every 10th document, the new one lacks another
# 10th and has every 10th text edited.  Both cover the whole table.

_SNAP = f"""{_FILES},
old AS (SELECT *, md5(content) AS hash FROM files WHERE doc_id % 10 <> 0),
new0 AS (SELECT * REPLACE (CASE WHEN doc_id % 10 = 2 THEN content || ' x' ELSE content END AS content)
         FROM files WHERE doc_id % 10 <> 1),
new AS (SELECT *, md5(content) AS hash FROM new0),
d AS (SELECT coalesce(o.repo_name, n.repo_name) AS repo_name, coalesce(o.path, n.path) AS path,
             o.hash AS old_hash, n.hash AS new_hash,
             CASE WHEN o.doc_id IS NULL THEN 'added' WHEN n.doc_id IS NULL THEN 'removed'
                  WHEN o.hash = n.hash THEN 'unchanged' ELSE 'changed' END AS change
      FROM old o FULL OUTER JOIN new n ON o.repo_name = n.repo_name AND o.path = n.path)"""
UPDATED_REPO = "src2"
EMPTIED_REPO = "src4"
OTHER_REPO = "src5"
REMOVED_REPOS = ("src0", "src1")
REGISTRY_PROBE = "src3"


def _snapshots(spark, d):
    from quarry.functions.text import content_hash
    f = _files(spark, d)
    i = F.col("doc_id") % 10
    old = f.where(i != 0).withColumn("hash", content_hash("content"))
    new = (f.where(i != 1)
           .withColumn("content", F.when(i == 2, F.concat("content", F.lit(" x"))).otherwise(F.col("content")))
           .withColumn("hash", content_hash("content")))
    return old, new


@register("diff_snapshots", f"{_SNAP} SELECT repo_name, path, old_hash, new_hash, change FROM d")
def _diff_snapshots(spark, d):
    from quarry.operators.lifecycle import diff_snapshots
    old, new = _snapshots(spark, d)
    return diff_snapshots(old, new).select("repo_name", "path", "old_hash", "new_hash", "change")


def _stored(spark, files):
    """A store that holds these files (payload and term vectors)."""
    from quarry.operators.lifecycle import registry_from_files
    from quarry.session import scratch_path
    from quarry.sources.store import IndexStore
    store = IndexStore(spark, scratch_path(spark, "store"), num_parts=16)
    store.add(*_rows_of(files), registry_from_files(files))
    return store


def _rows_of(files):
    """Payload and term vectors (of path and content) of files."""
    from quarry.operators.embed import embed_tf
    from quarry.operators.lifecycle import with_doc_id
    from quarry.operators.records import index_payload, with_embedding_text
    docs = index_payload(with_doc_id(files.drop("doc_id", "lang")))
    return docs, embed_tf(with_embedding_text(docs), "embedding_text", "doc_id", NB, keep=("repo_name",))


def _with_vectors(store, *columns) -> DataFrame:
    """Stored documents with figures that tell their stored vectors apart."""
    vectors = store.read("vectors").select(
        "doc_id", F.size("terms").cast("bigint").alias("n_terms"),
        F.aggregate("terms", F.lit(0).cast("bigint"), lambda a, t: a + t).alias("bucket_sum"),
        F.round(F.aggregate("weights", F.lit(0.0), lambda a, w: a + w), DIGITS).alias("weight_sum"))
    return store.read("docs").join(vectors, "doc_id").select(*columns, "n_terms", "bucket_sum", "weight_sum")


def _vector_sql(cte: str) -> str:
    return f"""
vt AS (SELECT repo_name, path, unnest({_TOK.format(c=_ETEXT)}) AS t FROM {cte}),
vb AS (SELECT repo_name, path, {_BK} AS bucket, count(*)::DOUBLE AS c FROM vt GROUP BY ALL),
vd AS (SELECT repo_name, path, count(*) AS n_terms, sum(bucket)::BIGINT AS bucket_sum, round(sum(c) / sqrt(sum(c * c)), 6) AS weight_sum FROM vb GROUP BY ALL)"""


@register("update_repo", f"""{_SNAP},
now AS (SELECT repo_name, path, content, hash FROM old WHERE repo_name NOT IN ('{UPDATED_REPO}', '{EMPTIED_REPO}')
        UNION ALL SELECT repo_name, path, content, hash FROM new WHERE repo_name = '{UPDATED_REPO}'),{_vector_sql("now")}
SELECT now.repo_name, now.path, hash, n_terms, bucket_sum, weight_sum FROM now JOIN vd USING (repo_name, path)""")
def _update_repo(spark, d):
    """Store the old snapshot, replace one repository, update another whose
    scan finds nothing and a third with foreign rows (refused), read the index."""
    from quarry.operators.lifecycle import registry_from_files
    old, new = _snapshots(spark, d)
    store = _stored(spark, old)
    scan = new.where(F.col("repo_name") == UPDATED_REPO)
    store.update(UPDATED_REPO, *_rows_of(scan), registry_from_files(scan))
    store.update(EMPTIED_REPO, *_rows_of(scan.limit(0)))
    try:
        store.update(OTHER_REPO, *_rows_of(scan))
    except ValueError:
        pass
    return _with_vectors(store, "repo_name", "path", "hash")


@register("remove_repos", f"""{_SNAP},
now AS (SELECT * FROM old WHERE repo_name NOT IN ({', '.join(repr(r) for r in REMOVED_REPOS)})),{_vector_sql("now")}
SELECT now.repo_name, now.path, hash, n_terms, bucket_sum, weight_sum FROM now JOIN vd USING (repo_name, path)""")
def _remove_repos(spark, d):
    """Store the old snapshot, remove repositories, read what is left."""
    old, _ = _snapshots(spark, d)
    store = _stored(spark, old)
    store.remove(REMOVED_REPOS)
    return _with_vectors(store, "repo_name", "path", "hash")


@register("add_summary", f"""{_ELIG}
SELECT repo_name, count(*) AS files_processed, count(*) AS documents_added FROM elig GROUP BY repo_name""")
def _add_summary(spark, d):
    """What adding every repository reports."""
    from quarry.operators.lifecycle import registry_from_files
    from quarry.session import scratch_path
    from quarry.sources.store import IndexStore
    files = _eligible(spark, d)
    store = IndexStore(spark, scratch_path(spark, "store"), num_parts=16)
    return store.add(*_rows_of(files), registry_from_files(files))


@register("incremental_upsert", f"""{_SNAP},
ntok AS (SELECT repo_name, path, unnest({_TOK.format(c='content')}) AS t FROM new),
nt AS (SELECT repo_name, path, count(DISTINCT {_BK}) AS n_terms FROM ntok GROUP BY ALL)
SELECT d.repo_name, d.path, d.new_hash AS hash, d.change, coalesce(nt.n_terms, 0) AS n_terms
FROM d LEFT JOIN nt ON d.repo_name = nt.repo_name AND d.path = nt.path WHERE d.change <> 'removed'""")
def _incremental_upsert(spark, d):
    from quarry.operators.embed import embed_tf
    from quarry.operators.lifecycle import incremental_upsert

    def embed(files):
        keep = [c for c in ("repo_name", "path", "hash", "change") if c in files.columns]
        return embed_tf(files, "content", "doc_id", NB, keep=keep, partitions=_tasks(spark, d))

    old, new = _snapshots(spark, d)
    idx = incremental_upsert(embed(old), new, embed)
    return idx.select("repo_name", "path", "hash", "change", F.size("terms").cast("bigint").alias("n_terms"))


@register("maintained_idf", f"""{_SNAP},
ntok AS (SELECT repo_name, path, unnest({_TOK.format(c='content')}) AS t FROM new),
ntf AS (SELECT DISTINCT repo_name, path, {_BK} AS bucket FROM ntok),
nn AS (SELECT count(*) AS n FROM new)
SELECT bucket, count(*) AS df, round(ln((nn.n + 1.0) / (count(*) + 1.0)) + 1, 6) AS idf FROM ntf, nn GROUP BY bucket, nn.n""")
def _maintained_idf(spark, d):
    """Document frequencies of the old snapshot, brought to the new one by
    the counts of the files that differ; one operation is applied twice."""
    from quarry.operators.embed import DocumentFrequencies, embed_tf
    from quarry.operators.lifecycle import KEY, diff_snapshots
    from quarry.session import scratch_path
    old, new = _snapshots(spark, d)
    path = scratch_path(spark, "differing")
    diff_snapshots(old, new).select(*KEY, "change").where(F.col("change") != "unchanged").write.parquet(path)
    differs = spark.read.parquet(path)

    def vectors(files):
        return embed_tf(files, "content", "doc_id", NB, partitions=_tasks(spark, d))

    counts = DocumentFrequencies(spark, scratch_path(spark, "df"), NB)
    counts.apply(1, vectors(old))
    gone = old.join(differs.where(F.col("change") != "added"), list(KEY), "left_semi")
    come = new.join(differs.where(F.col("change") != "removed"), list(KEY), "left_semi")
    for _ in range(2):
        counts.apply(2, vectors(come), vectors(gone))
    return counts.idf().select("bucket", "df", F.round("idf", DIGITS).alias("idf"))


@register("index_append", f"""{_ELIG},{_vector_sql("elig")}
SELECT sha256(repo_name || chr(31) || path) AS doc_id, repo_name, path, extension, size, md5(content) AS hash, true AS stamped,
       n_terms, bucket_sum, weight_sum FROM elig JOIN vd USING (repo_name, path)""")
def _index_append(spark, d):
    """Add every repository to a new store, read payload and vectors back."""
    from quarry.functions.text import content_hash
    store = _stored(spark, _eligible(spark, d).withColumn("hash", content_hash("content")))
    return _with_vectors(store, "doc_id", "repo_name", "path", "extension", "size", "hash", F.col("added_at").isNotNull().alias("stamped"))


TOY_LETTERS = "etaoinsr"


def _toy_model():
    """Stands in for a model that is loaded once per worker: letter counts."""
    return lambda texts: [[float(t.count(c)) for c in TOY_LETTERS] for t in texts]


_TOY_SQL = "[" + ", ".join(f"(length({{c}}) - length(replace({{c}}, '{c}', '')))::DOUBLE" for c in TOY_LETTERS) + "]"


@register("embed_search", f"""{_ELIG},
q AS (SELECT {_TOY_SQL.format(c="text")} AS qv FROM conversations WHERE role = 'user' ORDER BY conv_id || '/' || turn LIMIT 1),
e AS (SELECT *, 'File: ' || path || chr(10) || chr(10) || 'Content:' || chr(10) || content AS etext FROM elig),
v AS (SELECT sha256(repo_name || chr(31) || path) AS doc_id, repo_name, path, {_TOY_SQL.format(c="etext")} AS embedding FROM e)
SELECT doc_id, repo_name, path, round(list_cosine_similarity(embedding, qv), 6) AS score, {len(TOY_LETTERS)} AS width
FROM v, q ORDER BY score DESC NULLS LAST, doc_id LIMIT {K_HITS}""")
def _embed_search(spark, d):
    """A model of the user's: probe its width, embed and store every file,
    search with the first user turn, fetch the hits' payload."""
    from quarry.operators.embed import probe_width, udf_embedder
    from quarry.operators.lifecycle import registry_from_files, with_doc_id
    from quarry.operators.records import index_payload, with_embedding_text
    from quarry.operators.retrieve import fetch_payload
    from quarry.session import scratch_path
    from quarry.sources.store import IndexStore
    from quarry.sources.tables import query_turns
    width = probe_width(spark, udf_embedder(_toy_model))
    model = udf_embedder(_toy_model, width)
    files = _eligible(spark, d)
    docs = index_payload(with_doc_id(files.drop("doc_id", "lang")))
    vectors = with_embedding_text(docs).select("doc_id", "repo_name", model("embedding_text").alias("embedding"))
    store = IndexStore(spark, scratch_path(spark, "store"), num_parts=16)
    store.add(docs, vectors, registry_from_files(files), vec_col="embedding")
    asked = query_turns(load(spark, d, "conversations")).orderBy("qid").limit(1).select(model("query").alias("embedding"))
    hits = K.knn(store.read("vectors"), asked, k=K_HITS, digits=DIGITS).select("doc_id", "score", F.size("embedding").alias("width"))
    return fetch_payload(hits, store.read("docs")).select("doc_id", "repo_name", "path", "score", "width")


@register("union_indexes", f"""{_FILES}
SELECT repo_name, path, lang FROM files""")
def _union_indexes(spark, d):
    """Scans of several roots (here: languages) into one stored index."""
    from quarry.operators.lifecycle import registry_from_files
    files = _files(spark, d).withColumn("repo_name", F.concat("lang", F.lit(":"), "repo_name"))
    english = F.col("lang") == "en"
    store = _stored(spark, files.where(english))
    rest = files.where(~english)
    store.add(*_rows_of(rest), registry_from_files(rest))
    lang, repo = F.element_at(F.split("repo_name", ":"), 1), F.element_at(F.split("repo_name", ":"), 2)
    return store.visible("docs").select(repo.alias("repo_name"), "path", lang.alias("lang"))


@register("join_vectors", """
SELECT d.doc_id, d.source AS repo_name, e.label, len(e.embedding)::INTEGER AS dim
FROM documents d JOIN embeddings e ON d.doc_id = e.vec_id""")
def _join_vectors(spark, d):
    docs = load(spark, d, "documents").select("doc_id", F.col("source").alias("repo_name"))
    vecs = _emb(spark, d).select(F.col("vec_id").alias("doc_id"), "label", F.size("embedding").alias("dim"))
    return docs.join(vecs, "doc_id", "inner")


_REG = f"""{_ELIG}, reg AS (SELECT repo_name AS name, 'local:' || repo_name AS source, false AS is_url,
                           count(*) AS files_processed FROM elig GROUP BY repo_name)"""


def _registry(spark, d):
    from quarry.operators.lifecycle import registry_from_files
    return registry_from_files(_eligible(spark, d))


LATE_REPO = "src8"


def _registered(spark, d):
    """A store to which the repositories were added in two steps and whose
    registry has since been damaged: one entry holds no Parquet."""
    import warnings

    from quarry.operators.lifecycle import registry_from_files
    files = _eligible(spark, d)
    late = F.col("repo_name") == LATE_REPO
    store = _stored(spark, files.where(~late))
    spark.range(1).selectExpr("'damaged' AS value").write.text(f"{store.path('registry')}/entry=1")
    with warnings.catch_warnings():
        warnings.simplefilter("ignore")                     # the store reports what it sets aside
        store.add(*_rows_of(files.where(late)), registry_from_files(files.where(late)))
    assert store.damaged == ["entry=1"]
    return store


@register("known_repos", f"""{_REG}
SELECT DISTINCT source AS repo_name FROM documents WHERE source IN (SELECT name FROM reg)""")
def _known_repos(spark, d):
    from quarry.operators.lifecycle import known_repos
    names = load(spark, d, "documents").select(F.col("source").alias("repo_name")).distinct()
    return known_repos(names, _registered(spark, d).registry())


@register("registry_list", f"{_REG} SELECT name, source, is_url, files_processed FROM reg ORDER BY name")
def _registry_list(spark, d):
    return _registered(spark, d).repos().select("name", "source", "is_url", "files_processed")


@register("registry_get", f"{_REG} SELECT name, source, is_url, files_processed FROM reg WHERE name = '{REGISTRY_PROBE}'")
def _registry_get(spark, d):
    row = _registered(spark, d).get(REGISTRY_PROBE)
    return spark.createDataFrame([(row["name"], row["source"], row["is_url"], row["files_processed"])] if row else [],
                                 "name string, source string, is_url boolean, files_processed bigint")


_STATS = f"""{_REG},
l AS (SELECT extension, count(*) AS n FROM elig GROUP BY ALL)
SELECT (SELECT count(*) FROM reg) AS total_repositories, (SELECT sum(files_processed) FROM reg)::BIGINT AS total_files,
       (SELECT count(*) FROM l) AS n_languages,
       (SELECT '{{' || string_agg('"' || extension || '":' || n::VARCHAR, ',' ORDER BY extension) || '}}' FROM l) AS languages,
       'spark-parquet' AS db_type, (SELECT count(*) FROM embeddings) AS total_documents,
       (SELECT max(len(embedding)) FROM embeddings)::BIGINT AS vector_size,
       (SELECT string_agg(name, ',' ORDER BY name) FROM reg) AS repositories"""


def _stats(spark, d):
    from quarry.operators.aggregates import corpus_stats
    return corpus_stats(_registry(spark, d), _eligible(spark, d), _emb(spark, d))


def _flat_stats(stats):
    return stats.select("total_repositories", "total_files", "n_languages", F.to_json("languages").alias("languages"), "vector_db.*",
                        F.array_join("repositories", ",").alias("repositories"))


@register("corpus_stats", _STATS)
def _corpus_stats(spark, d):
    return _flat_stats(_stats(spark, d))


@register("export_stats", _STATS)
def _export_stats(spark, d):
    """Write the statistics as a JSON document and read it back."""
    from quarry.operators.lifecycle import export_stats, read_export
    from quarry.session import scratch_path
    stats, path = _stats(spark, d), scratch_path(spark, "export")
    export_stats(stats, path)
    return _flat_stats(read_export(spark, path, stats.schema))


# ------------------------------------------------------------------ file trees
# The doc* files written out as a real directory tree (by the executors,
# into a new folder of the shared checkpoint folder, every time), then
# scanned.

def _tree(spark, d, encoding="utf-8") -> str:
    from quarry.plans.trees import fresh_tree, write_tree
    root = f"{fresh_tree(spark)}/data"
    write_tree(_files(spark, d), root, encoding)
    return root


_TREE_ELIG = f"""{_FILES}, elig AS (SELECT * FROM files WHERE strlen(content) <= {SIZE_CAP} AND {_EXT_SQL}
                                  AND NOT {_IGN_SQL} AND length(content) > 0)"""


@register("scan_files", f"""{_TREE_ELIG}
SELECT 'data' AS repo_name, path, extension, strlen(content)::BIGINT AS size, md5(content) AS hash, true AS dated FROM elig""")
def _scan_files(spark, d):
    from quarry.sources.filetree import scan_files
    rec = scan_files(spark, _tree(spark, d), limit_bytes=SIZE_CAP)
    return rec.select("repo_name", "path", "extension", "size", "hash", F.col("modified").isNotNull().alias("dated"))


@register("scan_source", f"""{_TREE_ELIG}
SELECT 'data' AS repo_name, path, extension, strlen(content)::BIGINT AS size, md5(content) AS hash FROM elig""")
def _scan_source(spark, d):
    """The tree as a data source, with size and extension pushed into it."""
    from quarry import config
    from quarry.operators.records import file_records
    from quarry.session import scratch_path
    from quarry.sources.datasource import open_files, write_listing
    files = open_files(spark, write_listing(spark, _tree(spark, d), scratch_path(spark, "listed")))
    wanted = files.where(F.col("size") <= SIZE_CAP).where(F.col("extension").isin(*config.SUPPORTED_EXTENSIONS)).where(F.col("error").isNull())
    return file_records(wanted, raw_col="raw", keep=("repo_name",)).select("repo_name", "path", "extension", "size", "hash")


@register("scan_files_multi", f"""{_TREE_ELIG}
SELECT repo_name, substr(path, length(repo_name) + 2) AS path, extension, strlen(content)::BIGINT AS size,
       md5(content) AS hash FROM elig""")
def _scan_files_multi(spark, d):
    from quarry.operators.aggregates import repo_names
    from quarry.sources.filetree import scan_files
    root = _tree(spark, d)
    roots = repo_names(_files(spark, d)).select(F.concat(F.lit(root + "/"), "repo_name").alias("root"), "repo_name")
    rec = scan_files(spark, roots, limit_bytes=SIZE_CAP)
    return rec.select("repo_name", "path", "extension", "size", "hash")


@register("scan_rejects", f"""{_TREE_ELIG}
SELECT path, 'FileNotFoundError' AS reason FROM elig WHERE doc_id % 10 = 4""")
def _scan_rejects(spark, d):
    """Files that vanish between listing and reading are reported."""
    from quarry.plans.trees import remove_files
    from quarry.sources.filetree import list_files, roots_frame, scan_rejects
    root = _tree(spark, d)
    listing = list_files(roots_frame(spark, [root]))
    remove_files(_files(spark, d).where(F.col("doc_id") % 10 == 4), root)
    return scan_rejects(listing).select("path", "reason")


@register("decode_text", f"""{_TREE_ELIG}
SELECT path, length(content)::BIGINT AS n_chars, md5(content) AS hash FROM elig""")
def _decode_text(spark, d):
    """The tree in Latin-1 where a text allows it: those files are not
    valid UTF-8 once they hold an accented letter."""
    from quarry.sources.filetree import scan_files
    rec = scan_files(spark, _tree(spark, d, "latin-1"), limit_bytes=SIZE_CAP)
    return rec.select("path", F.length("content").cast("bigint").alias("n_chars"), "hash")


@register("read_snapshot", f"""{_ELIG}
SELECT repo_name, path, extension, size, md5(content) AS hash FROM elig""")
def _read_snapshot(spark, d):
    from quarry.functions.text import content_hash
    from quarry.session import scratch_path
    from quarry.sources.snapshot import read_snapshot, write_snapshot
    path = scratch_path(spark, "snapshot")
    write_snapshot(_eligible(spark, d).withColumn("hash", content_hash("content")), path)
    return read_snapshot(spark, path).select("repo_name", "path", "extension", "size", "hash")


@register("snapshot_history", f"""{_SNAP}
SELECT d.repo_name, d.path, d.old_hash, d.new_hash, d.change, o.n_files AS files_then
FROM d LEFT JOIN (SELECT repo_name, count(*) AS n_files FROM old GROUP BY 1) o ON o.repo_name = d.repo_name""")
def _snapshot_history(spark, d):
    """Two stored snapshots of every repository, compared from disk, with
    the files each repository had at the earlier time."""
    import datetime as dt

    from quarry.operators.aggregates import repo_names
    from quarry.session import scratch_path
    from quarry.sources.snapshot import diff_stored, snapshot_log, write_snapshot
    path, (old, new) = scratch_path(spark, "history"), _snapshots(spark, d)
    then = write_snapshot(old, path, dt.datetime(2024, 1, 1))
    write_snapshot(new, path, dt.datetime(2024, 6, 1, 12), repos=repo_names(_files(spark, d)))
    sizes = snapshot_log(spark, path).where(F.col("at") == then).select("repo_name", F.col("n_files").alias("files_then"))
    return diff_stored(spark, path, dt.datetime(2024, 3, 1)).join(sizes, "repo_name", "left")


# ------------------------------------------------------------------ streaming
# Each runs a real Structured Streaming query (availableNow) over the table
# files, checkpointed under the shared folder, and returns what it wrote.

def _stream_of(spark, d, name):
    """A stream of one table's rows; the table is a file or a folder of files."""
    schema = load(spark, d, name).schema
    path = spark._jvm.org.apache.hadoop.fs.Path(f"{d.rstrip('/')}/{name}.parquet")
    files = path.getFileSystem(spark._jsc.hadoopConfiguration())
    if files.getFileStatus(path).isDirectory():
        return spark.readStream.schema(schema).parquet(path.toString())
    # the stream source lists a folder; the glob filter picks the table
    return (spark.readStream.schema(schema).option("pathGlobFilter", f"{name}.parquet")
            .parquet(d.rstrip("/")))


@register("stream_ingest", f"""WITH tok AS (SELECT doc_id, unnest({_TOK.format(c='text')}) AS t FROM documents),
tf AS (SELECT DISTINCT doc_id, {_BK} AS bucket FROM tok)
SELECT doc_id, count(*) AS n_terms FROM tf GROUP BY doc_id""")
def _stream_ingest(spark, d):
    from quarry.session import scratch_path
    from quarry.streaming.ingest import latest_arrivals, run_available_now, stream_ingest
    sink, ckpt = scratch_path(spark, "ingest-sink"), scratch_path(spark, "ingest-ckpt")
    run_available_now(stream_ingest(_stream_of(spark, d, "documents"), sink, ckpt, num_buckets=NB))
    return latest_arrivals(spark.read.parquet(sink)).select("doc_id", F.size("terms").cast("bigint").alias("n_terms"))


UPSERT_BATCHES = 4


@register("stream_upsert", f"""{_SNAP},
now AS (SELECT o.repo_name, o.path, o.content, o.hash FROM old o WHERE NOT EXISTS (SELECT 1 FROM new n WHERE n.repo_name = o.repo_name AND n.path = o.path)
        UNION ALL SELECT repo_name, path, content, hash FROM new),{_vector_sql("now")}
SELECT now.repo_name, now.path, hash, n_terms, bucket_sum, weight_sum FROM now JOIN vd USING (repo_name, path)""")
def _stream_upsert(spark, d):
    """Both snapshots arrive as a stream of files, the later one after the
    earlier one, when the stream goes on from its checkpoint; each in up to
    UPSERT_BATCHES micro-batches, however many files it has.  The store ends
    as a batch build of what arrived last."""
    from quarry.operators.embed import embed_tf
    from quarry.operators.records import with_embedding_text
    from quarry.session import scratch_path
    from quarry.sources.store import IndexStore
    from quarry.streaming.ingest import run_available_now, stream_upsert
    source = scratch_path(spark, "arrivals")
    store, ckpt = IndexStore(spark, scratch_path(spark, "store"), num_parts=16), scratch_path(spark, "upsert-ckpt")

    def embed(rows):
        return embed_tf(with_embedding_text(rows), "embedding_text", "doc_id", NB, keep=("repo_name",))

    came = 0
    for files in _snapshots(spark, d):
        files.write.mode("append").parquet(source)
        there = len(spark.read.schema(files.schema).parquet(source).inputFiles())
        arrivals = (spark.readStream.schema(files.schema).option("maxFilesPerTrigger", max(1, -(-(there - came) // UPSERT_BATCHES)))
                    .parquet(source).drop("doc_id", "lang"))
        run_available_now(stream_upsert(arrivals, store, embed, ckpt))
        came = there
    return _with_vectors(store, "repo_name", "path", "hash")


_FIRST_ARRIVALS = """
SELECT event_id, user_id, event_type FROM (
  SELECT *, lag(ts) OVER (PARTITION BY user_id, event_type ORDER BY ts) AS before FROM events) t
WHERE before IS NULL OR ts >= before + INTERVAL 1 DAY"""
DEDUPE_KEYS = ["user_id", "event_type"]
DEDUPE_BATCHES = 4


@register("dedupe_arrivals", _FIRST_ARRIVALS)
def _dedupe_arrivals(spark, d):
    from quarry.streaming.ingest import dedupe_arrivals
    return dedupe_arrivals(load(spark, d, "events"), DEDUPE_KEYS).select("event_id", "user_id", "event_type")


@register("stream_dedupe", _FIRST_ARRIVALS)
def _stream_dedupe(spark, d):
    """The events in time order, as several micro-batches: the stream goes on
    from its checkpoint with each slice, however many files that has."""
    from quarry.session import scratch_path
    from quarry.streaming.ingest import dedupe_arrivals, run_available_now
    events, source = load(spark, d, "events"), scratch_path(spark, "dedupe-source")
    cuts = events.agg(F.percentile_approx(F.unix_micros(F.col("ts").cast("timestamp")), [i / DEDUPE_BATCHES for i in range(1, DEDUPE_BATCHES)]).alias("c")).first()["c"]
    at = F.unix_micros(F.col("ts").cast("timestamp"))
    slice_ = sum(((at >= F.lit(c)).cast("int") for c in sorted(set(cuts))), F.lit(0))
    sink, ckpt = scratch_path(spark, "dedupe-sink"), scratch_path(spark, "dedupe-ckpt")
    for i in range(DEDUPE_BATCHES):
        events.where(slice_ == i).write.mode("append").parquet(source)
        arrivals = spark.readStream.schema(events.schema).parquet(source)
        run_available_now(dedupe_arrivals(arrivals, DEDUPE_KEYS).writeStream.format("parquet").option("path", sink)
                          .option("checkpointLocation", ckpt).outputMode("append"))
    return spark.read.parquet(sink).select("event_id", "user_id", "event_type")


RESENT_EVERY, LATE_EVERY, SLICES, SLICE_FILES = 10, 50, 4, 4


@register("stream_drop_repeats", f"""
SELECT event_id, user_id, event_type FROM events
WHERE NOT (event_id % {LATE_EVERY} = 7 AND ts < (SELECT max(ts) FROM events) - INTERVAL 15 DAY)""")
def _stream_drop_repeats(spark, d):
    """The events in time order, each tenth sent again an hour later (and some
    of them before the first one), a few of the old ones only at the end,
    when the watermark has passed them."""
    from quarry.session import scratch_path
    from quarry.streaming.ingest import drop_repeats, run_available_now
    events, source = load(spark, d, "events"), scratch_path(spark, "repeats-source")
    newest = events.select(F.max("ts")).scalar()
    late = (F.col("event_id") % LATE_EVERY == 7) & (F.col("ts") < newest - F.expr("INTERVAL 15 DAYS"))
    again = events.where(~late & (F.col("event_id") % RESENT_EVERY == 3)).withColumn("ts", F.col("ts") + F.expr("INTERVAL 1 HOUR"))
    sent = events.where(~late).unionByName(again)
    at = F.unix_micros(F.col("ts").cast("timestamp"))
    first, last = events.agg(F.min(at), F.max(at)).first()
    slice_ = F.least(F.floor((at - first) * SLICES / (last - first + 1)), F.lit(SLICES - 1))
    for i in range(SLICES):                                 # a slice of bounded files is a micro-batch
        sent.where(slice_ == i).repartition(SLICE_FILES).write.mode("append").parquet(source)
    events.where(late).repartition(SLICE_FILES).write.mode("append").parquet(source)
    sink, ckpt = scratch_path(spark, "repeats-sink"), scratch_path(spark, "repeats-ckpt")
    arrivals = spark.readStream.schema(events.schema).option("maxFilesPerTrigger", SLICE_FILES).parquet(source)
    run_available_now(drop_repeats(arrivals, ["event_id"]).writeStream.format("parquet").option("path", sink)
                      .option("checkpointLocation", ckpt).outputMode("append"))
    return spark.read.parquet(sink).select("event_id", "user_id", "event_type")


@register("stream_search", ORACLE_SQL["search_text"])
def _stream_search(spark, d):
    from quarry.session import scratch_path
    from quarry.sources.tables import query_turns
    from quarry.streaming.ingest import run_available_now, stream_search
    from quarry.operators.postings import write_postings
    docs, idf = _doc_tfidf(spark, d)
    index = write_postings(docs, scratch_path(spark, "text-index"))          # static index, built once
    sink, ckpt = scratch_path(spark, "search-sink"), scratch_path(spark, "search-ckpt")
    queries = query_turns(_stream_of(spark, d, "conversations"))
    run_available_now(stream_search(queries, index, idf, sink, ckpt, k=K_HITS, num_buckets=NB, digits=DIGITS))
    return spark.read.parquet(sink).select("qid", "doc_id", "score", "rank")




# ------------------------------------------------------------------ approximate
# Signed random projections: buckets are stored once and joined.  The bucket
# rule is plain arithmetic, so the SQL twin has the same candidates; recall
# against exact search is tested.  Queries: every row whose id divides by 20.

LSH_EVERY = 20


LSH_SQL_BITS = 16        # planes per table that the SQL lists: enough for 65,536 distinct vectors


def _lsh_sql() -> str:
    signs = ", ".join(f"({t}, '{''.join('1' if x > 0 else '0' for x in p[:LSH_SQL_BITS].ravel())}')" for t, p in enumerate(K.planes(64)))
    least = K.LSH_OPEN + 1
    return f"""
WITH e AS (SELECT vec_id, embedding::DOUBLE[] AS v FROM embeddings WHERE list_dot_product(embedding, embedding) > 0),
u AS (SELECT min(vec_id) AS vec_id, v FROM e GROUP BY v),
n AS (SELECT greatest({least}, CASE WHEN count(*) > 1 THEN length(to_base(count(*) - 1, 2)) ELSE 0 END) AS most FROM u),
s AS (SELECT * FROM (VALUES {signs}) AS s(tab, signs)),
p AS (SELECT tab, b, [2.0 * substr(signs, (b * 64 + i + 1)::INT, 1)::INT - 1.0 for i in range(64)]::DOUBLE[] AS plane
      FROM s, range({LSH_SQL_BITS}) AS r(b)),
d AS MATERIALIZED (SELECT vec_id, tab, b::INT AS b, list_dot_product(v, plane) AS x FROM e, p),
c AS MATERIALIZED (SELECT vec_id, tab, sum(CASE WHEN x >= 0 THEN 1 << b ELSE 0 END)::BIGINT AS code FROM d GROUP BY vec_id, tab),
sample AS (SELECT vec_id, v FROM u ORDER BY md5(vec_id::VARCHAR), vec_id LIMIT {K.LSH_SAMPLE}),
near AS (SELECT * FROM (
    SELECT *, row_number() OVER (PARTITION BY qid ORDER BY score DESC, doc_id) AS r
    FROM (SELECT a.vec_id AS qid, b.vec_id AS doc_id, round(list_cosine_similarity(a.v, b.v), 6) AS score FROM sample a, u b))
    WHERE r <= {K.LSH_NEAR + 1} AND qid <> doc_id),
so AS (SELECT vec_id, tab, bits, sum(1 << b)::BIGINT AS free
       FROM (SELECT d.*, bits, row_number() OVER (PARTITION BY vec_id, tab, bits ORDER BY abs(x), b) AS r
             FROM d, range({least}, {LSH_SQL_BITS + 1}) AS w(bits) WHERE b < bits AND vec_id IN (SELECT vec_id FROM sample))
       WHERE r <= {K.LSH_OPEN} GROUP BY vec_id, tab, bits),
met AS (SELECT qid, doc_id, bits, bool_or(xor(a.code, b.code) & ((1 << bits::INT) - 1) & ~free = 0) AS hit
        FROM near JOIN c a ON a.vec_id = qid JOIN c b ON b.vec_id = doc_id AND a.tab = b.tab
        JOIN so ON so.vec_id = qid AND so.tab = a.tab GROUP BY qid, doc_id, bits),
fit AS (SELECT coalesce(max(bits), {least}) AS bits
        FROM (SELECT bits FROM met, n WHERE bits <= most GROUP BY bits HAVING avg(hit::INT) >= {K.LSH_RECALL})),
o AS (SELECT vec_id, tab, sum(1 << b)::BIGINT AS free
      FROM (SELECT d.*, row_number() OVER (PARTITION BY vec_id, tab ORDER BY abs(x), b) AS r
            FROM d, fit WHERE b < bits AND vec_id % {LSH_EVERY} = 0)
      WHERE r <= {K.LSH_OPEN} GROUP BY vec_id, tab),
pairs AS (SELECT DISTINCT q.vec_id AS qid, c.vec_id AS doc_id
          FROM c q JOIN o ON q.vec_id = o.vec_id AND q.tab = o.tab JOIN c ON q.tab = c.tab, fit
          WHERE xor(q.code, c.code) & ((1 << bits::INT) - 1) & ~free = 0),
m AS (SELECT qid, doc_id, round(list_cosine_similarity(a.v, b.v), 6) AS score
      FROM pairs JOIN e a ON a.vec_id = qid JOIN e b ON b.vec_id = doc_id),
r AS (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY score DESC, doc_id) AS rank FROM m)
SELECT qid, doc_id, score, rank FROM r WHERE rank <= {K_HITS}"""


@register("knn_lsh", _lsh_sql())
def _knn_lsh(spark, d):
    from quarry.session import scratch_path
    emb = _emb(spark, d)
    index = K.write_lsh(emb, scratch_path(spark, "lsh-index"), "vec_id")
    return K.knn_lsh(emb.where(F.col("vec_id") % LSH_EVERY == 0), index, K_HITS, q_id="vec_id", digits=DIGITS)


FLAGSHIP = "search_text"
