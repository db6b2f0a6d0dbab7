"""Versioned tables as lists of immutable files, and set operations between snapshots."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


class Conflict(RuntimeError):
    pass


class Store:
    """Snapshots, branches and tags below a folder that driver and executors share.

    Version n of a branch is the file refs/<branch>/<n>, made by an atomic create that fails if it exists; it lists the
    data folders that the version consists of.  So readers never see half a version, branches and restores share files,
    and of two writers of one version one loses.
    """

    def __init__(self, spark: SparkSession, root: str) -> None:
        self.spark, self.root = spark, root
        self.jvm = spark._jvm
        self.fs = self._path("").getFileSystem(spark._jsc.hadoopConfiguration())

    def _path(self, name: str):
        return self.jvm.org.apache.hadoop.fs.Path(f"{self.root}/{name}" if name else self.root)

    def _create(self, name: str, text: str) -> None:
        """Written aside and renamed without overwriting, so that it is there whole or not at all; Conflict if it is there already."""
        aside, place = self._path(f"aside/{uuid.uuid4().hex}"), self._path(name)
        out = self.fs.create(aside, False)
        out.write(text.encode())
        out.close()
        self.fs.mkdirs(place.getParent())
        fs = self.jvm.org.apache.hadoop.fs
        kind = self.jvm.java.lang.Class.forName("org.apache.hadoop.fs.Options$Rename")
        how = self.jvm.java.lang.reflect.Array.newInstance(kind, 1)
        self.jvm.java.lang.reflect.Array.set(how, 0, self.jvm.java.lang.Enum.valueOf(kind, "NONE"))
        try:
            fs.FileContext.getFileContext(place.toUri(), self.spark._jsc.hadoopConfiguration()).rename(aside, place, how)
        except Exception as e:
            self.fs.delete(aside, False)
            if self.fs.exists(place):
                raise Conflict(name) from e
            raise

    def _read(self, name: str) -> str | None:
        path = self._path(name)
        if not self.fs.exists(path):
            return None
        stream = self.fs.open(path)
        try:
            return self.jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
        finally:
            stream.close()

    def head(self, branch: str = "main") -> int:
        path = self._path(f"refs/{branch}")
        return max((int(x.getPath().getName()) for x in self.fs.listStatus(path)), default=0) if self.fs.exists(path) else 0

    def files(self, branch: str = "main", version: int | None = None) -> list[str]:
        text = self._read(f"refs/{branch}/{self.head(branch) if version is None else version}")
        if text is None:
            raise KeyError(f"{branch} has no version {version}")
        return text.split()

    def read(self, branch: str = "main", version: int | None = None) -> DataFrame:
        return self.spark.read.option("mergeSchema", "true").parquet(*[f"{self.root}/{f}" for f in self.files(branch, version)])

    def commit(self, df: DataFrame, base: int, branch: str = "main", keep: list[str] = (), txn: str | None = None) -> int:
        """Publishes df, beside the kept folders, as version base + 1; Conflict if another was faster. A transaction id can be resolved later."""
        name = f"data/{txn or uuid.uuid4().hex}"
        if txn:
            self._create(f"txn/{txn}", f"{branch} {base + 1}")
        df.write.parquet(f"{self.root}/{name}")
        if self.head(branch) != base:
            raise Conflict(f"{branch} is not at {base}")
        self._create(f"refs/{branch}/{base + 1}", "\n".join([*keep, name]))
        return base + 1

    def resolve(self, txn: str) -> str:
        """What became of a transaction: Applied, Conflicted (another took its version) or Unresolved (its version is still free, or it never began)."""
        noted = self._read(f"txn/{txn}")
        if noted is None:
            return "Unresolved"
        branch, version = noted.rsplit(" ", 1)
        files = self._read(f"refs/{branch}/{version}")
        return "Unresolved" if files is None else "Applied" if f"data/{txn}" in files.split() else "Conflicted"

    def clean(self) -> int:
        """Deletes data folders that no version and no tag names; how many. Not beside writers that are still at work."""
        named = set()
        for top in ("refs", "tags"):
            if self.fs.exists(self._path(top)):
                found = self.fs.listFiles(self._path(top), True)
                while found.hasNext():
                    path = found.next().getPath()
                    stream = self.fs.open(path)
                    named |= set(self.jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8").split())
                    stream.close()
        gone = [x.getPath() for x in self.fs.listStatus(self._path("data")) if f"data/{x.getPath().getName()}" not in named]
        for path in gone:
            self.fs.delete(path, True)
        return len(gone)

    def append(self, df: DataFrame, base: int, branch: str = "main") -> int:
        return self.commit(df, base, branch, self.files(branch, base) if base else [])

    def restore(self, version: int, branch: str = "main") -> int:
        base = self.head(branch)
        self._create(f"refs/{branch}/{base + 1}", "\n".join(self.files(branch, version)))
        return base + 1

    def branch(self, name: str, of: str = "main", version: int | None = None) -> None:
        self._create(f"refs/{name}/1", "\n".join(self.files(of, version)))

    def tag(self, name: str, branch: str = "main", version: int | None = None) -> None:
        """Tags are immutable: the same target again is fine, another one is a Conflict."""
        text = "\n".join(self.files(branch, version))
        if (have := self._read(f"tags/{name}")) is None:
            self._create(f"tags/{name}", text)
        elif have != text:
            raise Conflict(f"the tag {name} stands for something else")

    def at_tag(self, name: str) -> DataFrame | None:
        text = self._read(f"tags/{name}")
        return None if text is None else self.spark.read.parquet(*[f"{self.root}/{f}" for f in text.split()])

    def compact(self, branch: str = "main", rows: int = 65_536) -> int:
        """Rewrites a branch into files of at most so many rows."""
        base = self.head(branch)
        return self.commit(self.read(branch).repartition(), base, branch) if rows <= 0 else self._compact(base, branch, rows)

    def _compact(self, base: int, branch: str, rows: int) -> int:
        df = self.read(branch)
        return self.commit(df.repartition(max(1, -(-df.count() // rows))), base, branch)


def diff(before: DataFrame, after: DataFrame, key: str, mark: Column) -> DataFrame:
    """(key, change): added, updated, removed. Two narrow sides, one shuffle each."""
    a, b = before.select(key, mark.alias("_a")), after.select(key, mark.alias("_b"))
    j = a.join(b, key, "full_outer")
    return j.select(key, F.when(F.col("_a").isNull(), "added").when(F.col("_b").isNull(), "removed").when(F.col("_a") != F.col("_b"), "updated").alias("change")).where("change is not null")


def upsert(old: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    return old.join(new, keys, "left_anti").unionByName(new)


def replace_paths(old: DataFrame, batch: DataFrame, paths: DataFrame, path: str) -> DataFrame:
    """All rows of the paths go, the batch comes."""
    return old.join(paths, path, "left_anti").unionByName(batch)


def three_way(base: DataFrame, ours: DataFrame, theirs: DataFrame, key: str, mark: str) -> DataFrame:
    """(key, mark, state): a side that did not change yields; equal changes agree; other changes are a conflict with a null mark."""
    j = base.select(key, F.col(mark).alias("b")).join(ours.select(key, F.col(mark).alias("o")), key, "full_outer").join(theirs.select(key, F.col(mark).alias("t")), key, "full_outer")
    b, o, t = F.col("b"), F.col("o"), F.col("t")
    state = F.when(o.eqNullSafe(t), "same").when(o.eqNullSafe(b), "theirs").when(t.eqNullSafe(b), "ours").otherwise("conflict")
    return j.select(key, F.when(state == "conflict", None).when(state == "theirs", t).otherwise(o).alias(mark), state.alias("state"))
