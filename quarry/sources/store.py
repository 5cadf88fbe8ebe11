"""Index store on plain partitioned Parquet: add, update, remove, wipe.

Layout under ``root``: ``docs`` (payload) and ``vectors`` (id, repo_name and
vector columns, no content, so searches never scan text) are partitioned by
``part`` (a hash of the repository, which bounds the entries of a folder),
``repo_key`` (one folder per repository) and ``gen`` (a generation).
``registry`` is a log: each operation adds one folder ``entry=<number>`` with
a row per repository it touched: its generation, or that it was removed.

A repository's rows may lie in several generations: its ``gen`` and ``layers``
that were put on top of it (``add`` with ``on_top``), so that few changes to a
large repository write few rows.  ``replaced``, stored like the other two, has
the doc_ids that a layer replaces in the generations before it.

An operation is all or nothing.  It writes new generations beside the old
ones, then a registry entry under a temporary name, and renames that folder:
from then on readers, which take the newest entry of a repository and join on
(repo_name, gen), see all of it.  Old generations are deleted afterwards; what
a crash leaves behind is invisible until :meth:`IndexStore.vacuum` deletes it.
An entry that cannot be read is moved to ``registry/_damaged`` and reported;
the repositories it named show their state before it.

Only the folders of the repositories in question are written, and a read of
one repository lists and reads its folder alone.  Rows are rebalanced by
repository before they are written, so a large one has several files and a
small one a single file.  Counts come from observing the writes.
"""

from __future__ import annotations

import time
import warnings
from collections.abc import Iterable

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

PAYLOAD = ("docs", "vectors", "replaced")
TABLES = (*PAYLOAD, "registry")
REGISTRY = ("name string, source string, is_url boolean, processed_at timestamp, files_processed bigint, data_file string, "
            "repo_path string, gen bigint, width int, layers array<bigint>, stacked bigint, removed boolean")
SHOWN = ("name", "source", "is_url", "processed_at", "files_processed", "data_file", "repo_path")
OBSERVED = 500            # repositories whose rows one observation counts


def repo_key(repo) -> Column:
    """Folder name of a repository: always text, safe in any path."""
    return F.concat(F.lit("r"), F.md5(repo.cast("binary")))


def _generations() -> Column:
    """All generations of a registry row."""
    return F.concat(F.array("gen"), F.coalesce("layers", F.expr("cast(array() as array<bigint>)")))


class IndexStore:
    def __init__(self, spark: SparkSession, root: str, num_parts: int = 256):
        self.spark, self.root, self.num_parts = spark, root.rstrip("/"), num_parts
        self.damaged: list[str] = []          # registry entries that were set aside
        self._places: dict[str, str] = {}

    # ---------------------------------------------------------------- paths
    def path(self, table: str) -> str:
        return f"{self.root}/{table}"

    def _fs(self, path: str):
        p = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        return p.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()), p

    def _drop(self, path: str) -> bool:
        fs, p = self._fs(path)
        return bool(fs.delete(p, True))

    def _children(self, path: str) -> list[str]:
        fs, p = self._fs(path)
        return sorted(s.getPath().getName() for s in fs.listStatus(p)) if fs.exists(p) else []

    def _folders(self, names: Iterable[str]) -> dict[str, str]:
        """Folder of each repository below a table's."""
        if new := [n for n in names if n not in self._places]:
            rows = self.spark.createDataFrame([(n,) for n in new], "n string").select("n", self._part(F.col("n")).alias("part"), repo_key(F.col("n")).alias("k"))
            self._places.update({r["n"]: f"part={r['part']}/repo_key={r['k']}" for r in rows.collect()})
        return {n: self._places[n] for n in names}

    def _part(self, repo: Column) -> Column:
        return F.pmod(F.xxhash64(repo), F.lit(self.num_parts)).cast("int")

    # ---------------------------------------------------------------- registry
    def _entries(self) -> list[str]:
        return [f"{self.path('registry')}/{e}" for e in self._children(self.path("registry")) if e.startswith("entry=")]

    def _log(self) -> DataFrame | None:
        """All registry rows with their entry, after setting damaged entries aside."""
        def rows(paths):
            return self.spark.read.option("basePath", self.path("registry")).schema(f"{REGISTRY}, entry bigint").parquet(*paths)

        if not (paths := self._entries()):
            return None
        try:
            rows(paths).write.format("noop").mode("overwrite").save()
        except Exception:
            good = []
            for p in paths:
                try:
                    rows([p]).write.format("noop").mode("overwrite").save()
                    good.append(p)
                except Exception:
                    self._set_aside(p)
            paths = good
        return rows(paths) if paths else None

    def _set_aside(self, entry: str) -> None:
        name = entry.rsplit("/", 1)[-1]
        fs, to = self._fs(f"{self.path('registry')}/_damaged/{name}")
        fs.mkdirs(to.getParent())
        fs.rename(self._fs(entry)[1], to)
        self.damaged.append(name)
        warnings.warn(f"registry {name} cannot be read and was set aside in {self.path('registry')}/_damaged", stacklevel=3)

    def registry(self) -> DataFrame | None:
        """The current row of every registered repository, with ``gen`` and ``width``."""
        if (log := self._log()) is None:
            return None
        columns = [c for c in log.columns if c not in ("entry", "name")]
        last = log.groupBy("name").agg(F.max_by(F.struct(*columns), "entry").alias("r"))
        return last.select("name", "r.*").where(~F.col("removed")).drop("removed")

    def repos(self) -> DataFrame | None:
        """Registered repositories, by name."""
        reg = self.registry()
        return None if reg is None else reg.select(*SHOWN).orderBy("name")

    def get(self, repo: str) -> dict | None:
        """One repository's registry row."""
        return self.get_all([repo])[repo]

    def get_all(self, names: Iterable[str]) -> dict[str, dict | None]:
        """Registry rows of several repositories."""
        names, reg = list(names), self.registry()
        found = reg.where(F.col("name").isin(names)).collect() if reg is not None and names else []
        return dict.fromkeys(names) | {r["name"]: r.asDict() for r in found}

    def has(self, repo: str) -> bool:
        return self.get(repo) is not None

    def _commit(self, rows: DataFrame, number: int) -> None:
        """Make a registry entry visible: written under a temporary name,
        then renamed, which happens as a whole or not at all."""
        staging = f"{self.path('registry')}/_staging-{number}"
        have = {f.name for f in rows.schema}
        full = self.spark.createDataFrame([], REGISTRY).schema
        rows.select(*[(F.col(f.name) if f.name in have else F.lit(None)).cast(f.dataType).alias(f.name) for f in full]).write.mode("overwrite").parquet(staging)
        self._step("commit")
        fs, p = self._fs(staging)
        if not fs.rename(p, self._fs(f"{self.path('registry')}/entry={number}")[1]):
            raise OSError(f"registry entry {number} could not be renamed")

    def _step(self, name: str) -> None:
        """Called before each step of an operation; tests let it fail."""

    # ---------------------------------------------------------------- reads
    def read(self, table: str, repo: str | None = None) -> DataFrame | None:
        """The table's visible rows (of one repository: only its folder), or
        None when there are none."""
        base = self.path(table)
        if repo is not None:
            row = self.get(repo)
            if row is None:
                return None
            rows = self._generations(table, repo, [row["gen"], *(row["layers"] or [])])
            return rows if rows is None else self._current(rows, self._generations("replaced", repo, row["layers"] or [])).drop("gen")
        reg = self.registry()
        rows = None if reg is None else self._parquet(base, [base], "gen")
        if rows is None or reg.isEmpty():
            return None
        seen = reg.select(F.col("name").alias("repo_name"), F.explode(_generations()).alias("gen"))
        rows = rows.join(seen, ["repo_name", "gen"], "left_semi")
        layered = bool(self._children(self.path("replaced"))) and not reg.where(F.size("layers") > 0).isEmpty()
        replaced = self._parquet(self.path("replaced"), [self.path("replaced")], "gen") if layered else None
        return self._current(rows, None if replaced is None else replaced.join(seen, ["repo_name", "gen"], "left_semi")).drop("gen")

    def _generations(self, table: str, repo: str, gens: list[int]) -> DataFrame | None:
        folder = f"{self.path(table)}/{self._folders([repo])[repo]}"
        there = set(self._children(folder)) if gens else set()
        paths = [f"{folder}/gen={g}" for g in gens if f"gen={g}" in there]
        return self._parquet(self.path(table), paths, "gen") if paths else None

    def _current(self, rows: DataFrame, replaced: DataFrame | None) -> DataFrame:
        """Rows of which no later layer has another version."""
        if replaced is None:
            return rows
        later = replaced.groupBy(F.col("doc_id").alias("__id")).agg(F.max("gen").alias("__gen"))
        return rows.join(later, (F.col("doc_id") == F.col("__id")) & (F.col("gen") < F.col("__gen")), "left_anti")

    def _parquet(self, base: str, paths: list[str], *keep: str) -> DataFrame | None:
        try:
            rows = self.spark.read.option("basePath", base).parquet(*paths)
        except AnalysisException as e:
            if e.getCondition() in ("PATH_NOT_FOUND", "UNABLE_TO_INFER_SCHEMA"):
                return None
            raise
        return rows.drop(*[c for c in ("part", "repo_key", "gen") if c not in keep])

    def visible(self, table: str) -> DataFrame | None:
        return self.read(table)

    # ---------------------------------------------------------------- writes
    def _write(self, table: str, rows: DataFrame, gen: int, names: list[str], vec_col: str | None = None):
        """Write a generation; (rows per repository, widths) as observed."""
        placed = rows.withColumns({"part": self._part(F.col("repo_name")), "repo_key": repo_key(F.col("repo_name")), "gen": F.lit(gen)})
        placed = placed.hint("rebalance", "part", "repo_key")
        counts = []
        for i in range(0, len(names), OBSERVED):
            counts.append(Observation())
            some = [F.count_if(F.col("repo_name").eqNullSafe(F.lit(n))).alias(f"n{i + j}") for j, n in enumerate(names[i:i + OBSERVED])]
            placed = placed.observe(counts[-1], *some)
        widths, size = Observation(), F.size(vec_col) if vec_col else F.lit(None).cast("int")
        placed = placed.observe(widths, F.min(size).alias("least"), F.max(size).alias("most"), F.count(F.lit(1)).alias("n"))
        placed.write.mode("append").partitionBy("part", "repo_key", "gen").parquet(self.path(table))
        each = {k: v for o in counts for k, v in o.get.items()}
        return {n: each[f"n{i}"] for i, n in enumerate(names)}, widths.get

    def _replace(self, names: list[str], docs: DataFrame, vectors: DataFrame, registry: DataFrame, vec_col: str | None, may_be_empty: bool,
                 on_top: Iterable[str] = (), replaced: DataFrame | None = None) -> dict[str, int]:
        """Write new generations of the named repositories and switch to them;
        those ``on_top`` keep the ones they have."""
        gen = time.time_ns() // 1000
        below = {n: r for n, r in self.get_all(on_top).items() if r is not None}
        old = self.registry()
        width = None if old is None or not vec_col else old.where(~F.col("name").isin(names)).agg(F.max("width")).first()[0]
        try:
            self._step("docs")
            added, seen = self._write("docs", docs, gen, names)
            if not may_be_empty and (empty := [n for n, c in added.items() if not c]):
                raise ValueError(f"no files to index in {empty[:5]}")
            if seen["n"] != sum(added.values()):
                raise ValueError(f"documents of other repositories than {names[:5]}")
            self._step("vectors")
            of_vectors, seen = self._write("vectors", vectors, gen, names, vec_col)
            if seen["n"] != sum(of_vectors.values()):
                raise ValueError(f"vectors of other repositories than {names[:5]}")
            found = {w for w in (seen["least"], seen["most"], width) if w is not None}
            if len(found) > 1:
                raise ValueError(f"vector widths differ: {sorted(found)}")
            self._step("registry")
            if below and replaced is not None:
                self._write("replaced", replaced.select("repo_name", "doc_id"), gen, [])
            layers = [(n, r["gen"], [*(r["layers"] or []), gen], (r["stacked"] or 0) + added[n]) for n, r in below.items()]
            layers = self.spark.createDataFrame(layers, "name string, base bigint, layers array<bigint>, stacked bigint")
            registry = registry.join(F.broadcast(layers), "name", "left")
            self._commit(registry.withColumns({"gen": F.coalesce("base", F.lit(gen)), "width": F.lit(max(found, default=None)).cast("int"), "removed": F.lit(False)}), gen)
        except BaseException:
            self._clean(names, only=gen)
            raise
        self._step("clean")
        self._clean([n for n in names if n not in below], keep=gen)
        return added

    def _clean(self, names: Iterable[str], keep: int | None = None, only: int | None = None) -> None:
        """Delete generations of repositories: all but ``keep``, or ``only`` one."""
        for place in self._folders(list(names)).values():
            for table in PAYLOAD:
                folder = f"{self.path(table)}/{place}"
                for g in self._children(folder):
                    if g.startswith("gen=") and g != f"gen={keep}" and only in (None, int(g[4:])):
                        self._drop(f"{folder}/{g}")

    def add(self, docs: DataFrame, vectors: DataFrame, registry: DataFrame, vec_col: str | None = None,
            on_top: Iterable[str] = (), replaced: DataFrame | None = None) -> DataFrame:
        """Add or replace repositories; one summary row each (repo_name,
        files_processed, documents_added).  ``registry`` has a row for each
        repository; one without documents is refused, and so are rows of
        others and vectors of another width than each other or than the index
        has.  Nothing changes then.  Those of the repositories that are named
        ``on_top`` and are there keep their rows, but for the ones ``replaced``
        (repo_name, doc_id)."""
        registry = registry.withColumnRenamed("repo_name", "name")
        rows = registry.select("name", "files_processed").collect()             # a row per repository that is added
        added = self._replace([r["name"] for r in rows], docs, vectors, registry, vec_col, False, on_top, replaced) if rows else {}
        return self.spark.createDataFrame([(r["name"], r["files_processed"], added[r["name"]]) for r in rows],
                                          "repo_name string, files_processed bigint, documents_added bigint")

    def update(self, repo: str, docs: DataFrame, vectors: DataFrame, registry: DataFrame | None = None, vec_col: str | None = None) -> DataFrame:
        """Replace one registered repository by a new scan of it.  After a
        scan that found nothing its rows are gone and its registry row stays,
        with no files.  Rows of another repository are refused."""
        now = self.get(repo)
        if now is None:
            raise KeyError(f"repository {repo!r} is not in the index")
        fresh = None
        if registry is not None:
            fresh = registry.withColumnRenamed("repo_name", "name").where(F.col("name") == F.lit(repo))
        if fresh is None or fresh.isEmpty():
            kept = self.spark.createDataFrame([tuple(now.get(c) for c in SHOWN)], REGISTRY.split(", gen")[0])
            fresh = kept.withColumns({"processed_at": F.current_timestamp(), "files_processed": F.lit(0).cast("bigint")})
        added = self._replace([repo], docs, vectors, fresh, vec_col, may_be_empty=True)
        return fresh.select(F.col("name").alias("repo_name"), "files_processed", F.lit(added[repo]).cast("bigint").alias("documents_added"))

    def remove(self, repos: Iterable[str]) -> dict[str, bool]:
        """Drop repositories, with the snapshots their registry rows name;
        False for those that were not there."""
        rows = self.get_all(repos)
        gone = [(r["name"], True) for r in rows.values() if r is not None]
        if gone:
            self._commit(self.spark.createDataFrame(gone, "name string, removed boolean"), time.time_ns() // 1000)
            self._step("clean")
            self._clean([name for name, _ in gone])
            for r in rows.values():
                if r is not None and r["data_file"]:
                    self._drop(r["data_file"])
        return {repo: r is not None for repo, r in rows.items()}

    def vacuum(self) -> None:
        """Delete what no reader sees: generations that were never switched
        to or have been replaced, and all registry entries but one."""
        if (reg := self.registry()) is None:
            return
        seen = self._entries()
        number = time.time_ns() // 1000
        self._commit(reg.withColumn("removed", F.lit(False)), number)
        for entry in seen:
            self._drop(entry)
        reg = self.registry()
        now = {(r["part"], r["k"], r["gen"]) for r in reg.select(self._part(F.col("name")).alias("part"), repo_key(F.col("name")).alias("k"), F.explode(_generations()).alias("gen")).toLocalIterator()}
        for table in PAYLOAD:
            for part in self._children(self.path(table)):
                for key in self._children(f"{self.path(table)}/{part}") if part.startswith("part=") else []:
                    for g in self._children(f"{self.path(table)}/{part}/{key}"):
                        if g.startswith("gen=") and (int(part[5:]), key[9:], int(g[4:])) not in now:
                            self._drop(f"{self.path(table)}/{part}/{key}/{g}")

    def wipe(self) -> None:
        """Drop everything and leave an empty store."""
        for t in TABLES:
            self._drop(self.path(t))
            fs, p = self._fs(self.path(t))
            fs.mkdirs(p)
