"""Tables in parts that are replaced without a gap.

A table is a folder with `data`, one folder per written part, and `manifests`, one small file per version that names the folder of each part. A version is
published by creating the next manifest, which only one writer can do; until then its folders are seen by nobody. Readers take the newest manifest, so they have the
old table or the new one, and what they have begun to read stays until `tidy` removes it. A writer that dies leaves folders without a manifest, for `tidy`.
"""

from __future__ import annotations

import json
import time
import uuid

from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

WHOLE = "{}"  # the part of a table without keys


class Taken(RuntimeError):
    """Another run has the claim or has published first."""


class _Folder:
    """Small files of a folder on any file system that Spark knows."""

    def __init__(self, spark: SparkSession, path: str):
        self.jvm, self.path = spark.sparkContext._jvm, path.rstrip("/")
        self.fs = self.at("").getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

    def at(self, name: str):
        return self.jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}" if name else self.path)

    def names(self, name: str = "") -> list[str]:
        return sorted(s.getPath().getName() for s in self.fs.listStatus(self.at(name))) if self.fs.exists(self.at(name)) else []

    def read(self, name: str) -> str:
        stream = self.fs.open(self.at(name))
        try:
            return self.jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
        finally:
            stream.close()

    def create(self, name: str, text: str) -> bool:
        """Create a file with its whole text; False if there is one. The text is written beside and renamed, so nobody sees a part of it."""
        beside = self.at(f".{name.replace('/', '-')}-{uuid.uuid4().hex}")
        stream = self.fs.create(beside, True)
        stream.write(text.encode())
        stream.close()
        self.fs.mkdirs(self.at(name).getParent())
        context = self.jvm.org.apache.hadoop.fs.FileContext.getFileContext(self.at("").toUri())
        options = self.jvm.java.lang.reflect.Array.newInstance(self.jvm.java.lang.Class.forName("org.apache.hadoop.fs.Options$Rename"), 0)
        try:
            context.rename(beside, self.at(name), options)  # fails if there is one
            return True
        except Py4JJavaError as e:
            self.fs.delete(beside, False)
            if "FileAlreadyExists" in str(e.java_exception):
                return False
            raise

    def age(self, name: str) -> float:
        return time.time() - self.fs.getFileStatus(self.at(name)).getModificationTime() / 1000

    def delete(self, name: str) -> None:
        self.fs.delete(self.at(name), True)


def _key(values: dict) -> str:
    return json.dumps(values, sort_keys=True, default=str)


def _newest(folder: _Folder) -> tuple[int, dict[str, str]]:
    """The number of the newest version, 0 if there is none, and its parts' folders."""
    names = [n for n in folder.names("manifests") if n.endswith(".json")]
    return (int(names[-1][:-5]), json.loads(folder.read(f"manifests/{names[-1]}"))) if names else (0, {})


def parts(spark: SparkSession, path: str) -> list[dict]:
    """The keys of the table's parts."""
    return [json.loads(k) for k in sorted(_newest(_Folder(spark, path))[1])]


def current(spark: SparkSession, path: str, **keys) -> DataFrame:
    """The newest version; of the parts with these keys only, if some are given: other parts are not opened. A table without such parts is an error."""
    number, folders = _newest(_Folder(spark, path))
    chosen = [f for k, f in sorted(folders.items()) if all(str(json.loads(k).get(name)) == str(v) for name, v in keys.items())]
    if not chosen:
        raise FileNotFoundError(f"{path}: no part {keys} in version {number}")
    return spark.read.option("mergeSchema", "true").parquet(*(f"{path.rstrip('/')}/data/{f}" for f in chosen))


def publish(df: DataFrame, path: str, keys=(), replace_all: bool | None = None, attempts: int = 20) -> int:
    """Write df and publish it as the next version; its number. With `keys`, the parts whose keys stand in df are replaced and others stay (unless
    replace_all); without, the whole table is replaced. df may be read from the table itself.

    The number of distinct keys must be a small one: each is a folder. Of two writers, the second merges its parts with those of the first; if both replace the same part,
    the second one is an error (Taken) and leaves the first one's.
    """
    spark, keys = df.sparkSession, list(keys)
    folder = _Folder(spark, path)
    number, before = _newest(folder)
    name = uuid.uuid4().hex
    written: dict[str, str] = {}
    if keys:
        # Copies of the keys name the folders; the columns themselves stay in the files.
        copies = {k: f"part_{k}" for k in keys}
        df.withColumns({c: F.col(k).cast("string") for k, c in copies.items()}).write.option("compression", "zstd").partitionBy(*copies.values()).parquet(f"{folder.path}/data/{name}")
        for row in df.select(*keys).distinct().collect():
            at = "/".join(f"{copies[k]}={_escaped(spark, row[k])}" for k in keys)
            written[_key(row.asDict())] = f"{name}/{at}"
    else:
        df.write.option("compression", "zstd").parquet(f"{folder.path}/data/{name}")
        written[WHOLE] = name
    whole = not keys if replace_all is None else replace_all
    start = before
    for _ in range(attempts):
        merged = written if whole else before | written
        if folder.create(f"manifests/{number + 1:012d}.json", json.dumps(merged)):
            return number + 1
        number, before = _newest(folder)
        clash = [k for k in (written if not whole else set(start) | set(before)) if before.get(k) != start.get(k)]
        if clash:
            folder.delete(f"data/{name}")
            raise Taken(f"{path}: another run has published {clash[0]}")
    raise Taken(f"{path}: {attempts} versions came in between")


def _escaped(spark: SparkSession, value) -> str:
    text = None if value is None else str(value).lower() if isinstance(value, bool) else str(value)
    return "__HIVE_DEFAULT_PARTITION__" if not text else spark.sparkContext._jvm.org.apache.spark.sql.catalyst.catalog.ExternalCatalogUtils.escapePathName(text)


def tidy(spark: SparkSession, path: str, keep: int = 3, older_than: float = 86_400.0) -> int:
    """Remove manifests but the newest `keep` and folders that none of these names and that are older than so many seconds; how many folders went."""
    folder = _Folder(spark, path)
    names = [n for n in folder.names("manifests") if n.endswith(".json")]
    for n in names[:-keep]:
        folder.delete(f"manifests/{n}")
    used = {f.split("/")[0] for n in names[-keep:] for f in json.loads(folder.read(f"manifests/{n}")).values()}
    gone = [n for n in folder.names("data") if n not in used and folder.age(f"data/{n}") >= older_than]
    for n in gone:
        folder.delete(f"data/{n}")
    return len(gone)


class claim:
    """`with claim(spark, folder, name):` one run at a time has a name; others get Taken. A claim older than `expires` seconds, of a run that died, is taken over."""

    def __init__(self, spark: SparkSession, path: str, name: str, expires: float = 6 * 3600.0):
        self.folder, self.name, self.expires = _Folder(spark, path), f"claims/{name}", expires

    def __enter__(self):
        if not self.folder.create(self.name, "claimed"):
            if self.folder.age(self.name) < self.expires:
                raise Taken(f"{self.name} is claimed")
            self.folder.delete(self.name)
            if not self.folder.create(self.name, "claimed"):
                raise Taken(f"{self.name} is claimed")
        return self

    def __exit__(self, *_):
        self.folder.delete(self.name)
