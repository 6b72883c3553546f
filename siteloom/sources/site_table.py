"""A stored table whose sites are replaced by commits: staged files, one manifest row a site, one log entry a commit.

Layout below ``root``: ``data/<run>`` has the rows of a run, ``manifest/<run>`` the sites that it replaces (also those it
leaves empty), ``log/<number>-<run>`` an empty file a commit. Creating that file is the commit: a run that dies before it has
changed nothing that a reader sees, and a run whose name the log holds is not done again. Of two writers that take one number at
once, the run later by name counts as the later. Readers take each site from the last commit that has it; sites that a
commit does not name keep their files.
"""

from __future__ import annotations

import re
import uuid
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from siteloom.operators.spread import join_per_site
from siteloom.session import cut_lineage

RUN = "_run"


class SiteTable:
    """``root`` is a folder that driver and executors share; ``keys`` name what is replaced as a whole."""

    def __init__(self, spark: SparkSession, root: str, keys: tuple[str, ...] = ("site",)) -> None:
        self.spark, self.root, self.keys = spark, root.rstrip("/"), keys

    def _fs(self, path: str):
        where = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        return where.getFileSystem(self.spark._jsc.hadoopConfiguration()), where

    def commits(self) -> list[str]:
        """Runs in the order of their commits."""
        fs, folder = self._fs(f"{self.root}/log")
        names = sorted(s.getPath().getName() for s in fs.listStatus(folder)) if fs.exists(folder) else []
        return [n.split("-", 1)[1] for n in names]

    def _stage(self, rows: DataFrame, replaced: DataFrame, run: str) -> None:
        """Write files that no reader looks at yet. Spark sizes them by bytes: small sites share one, large ones have many."""
        rows.hint("rebalance", *self.keys).sortWithinPartitions(*self.keys).write.mode("overwrite").parquet(f"{self.root}/data/{run}")
        replaced.hint("rebalance").write.mode("overwrite").parquet(f"{self.root}/manifest/{run}")

    def _commit(self, run: str) -> None:
        fs, entry = self._fs(f"{self.root}/log/{len(self.commits()):012d}-{run}")
        fs.mkdirs(entry.getParent())
        fs.create(entry, False).close()

    def replace(self, rows: DataFrame, replaced: DataFrame | None = None, run: str | None = None) -> bool:
        """Replace the sites of ``rows`` and of ``replaced``: False if ``run`` was committed before."""
        run = run or uuid.uuid4().hex
        if not re.fullmatch(r"[A-Za-z0-9_.-]+", run):
            raise ValueError(f"{run!r} does not do as a file name")
        if run in self.commits():
            return False
        sites = rows.select(*self.keys).distinct()
        if replaced is not None:
            sites = sites.unionByName(replaced.select(*self.keys)).distinct()
        self._stage(rows, sites, run)
        self._commit(run)
        return True

    def owners(self) -> DataFrame:
        """(keys, _run): the run that each site's rows are read from."""
        listed = [
            self.spark.read.parquet(f"{self.root}/manifest/{run}").select(*self.keys, F.struct(F.lit(number).alias("n"), F.lit(run).alias("run")).alias("_at"))
            for number, run in enumerate(self.commits())
        ]
        if not listed:
            raise ValueError(f"nothing was committed to {self.root}")
        return reduce(DataFrame.unionByName, listed).groupBy(*self.keys).agg(F.max("_at")["run"].alias(RUN))

    def read(self) -> DataFrame:
        """Rows of the last commit of each site. Runs that no site is read from are not opened."""
        owners = cut_lineage(self.owners())
        runs = [r[0] for r in owners.select(RUN).distinct().collect()]  # one name a commit at most
        parts = [self.spark.read.parquet(f"{self.root}/data/{run}").withColumn(RUN, F.lit(run)) for run in sorted(runs)]
        rows = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)
        by = next((c for c in rows.columns if c not in (*self.keys, RUN)), self.keys[0])
        return join_per_site(rows, owners, by, on=(*self.keys, RUN)).drop(RUN)

    def apply(self, changes: DataFrame, ids: list[str], run: str | None = None) -> bool:
        """Apply ``changes`` (rows with ``change``: upsert, delete or keep); sites without a change keep their files.

        ``ids`` name a row and include the keys. Deleted and upserted rows leave, upserted ones enter.
        """
        changed = changes.where("change <> 'keep'")
        touched = changed.select(*self.keys).distinct()
        stored = self.read()
        here = stored.join(touched, [*self.keys], "left_semi").join(changed.select(*ids), ids, "left_anti")
        fresh = changed.where("change = 'upsert'").select(*stored.columns)
        return self.replace(here.select(*stored.columns).unionByName(fresh), touched, run)

    def vacuum(self) -> list[str]:
        """Delete the files of committed runs that no site is read from any more; their names."""
        needed = {r[0] for r in self.owners().select(RUN).distinct().collect()}
        gone = [run for run in self.commits() if run not in needed]
        for run in gone:
            fs, folder = self._fs(f"{self.root}/data/{run}")
            fs.delete(folder, True)
        return gone
