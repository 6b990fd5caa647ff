"""Writing facts and results with a manifest, and reading back what the manifest vouches for.

The manifest is written last: rows in all and per folder, every data file with its size and time, and a mark of the input. A table without
one was never finished. A table whose files are not those in the manifest has lost something or was changed by
someone else. Both are errors when it is opened, in whatever session that is.
"""

import json
from hashlib import sha256
from urllib.parse import urlparse

from pyspark.sql import DataFrame, SparkSession, functions as F

from bundlelens.operators.preparation import dataset_profile

MANIFEST = "_manifest.json"


class SnapshotError(RuntimeError):
    """A table that isn't what its manifest says."""


def _folder(spark: SparkSession, path: str):
    jvm = spark.sparkContext._jvm
    place = jvm.org.apache.hadoop.fs.Path(path)
    return place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), place


def _hidden(name: str) -> bool:
    return any(part.startswith(("_", ".")) and "=" not in part for part in name.split("/"))


def data_files(spark: SparkSession, path: str) -> dict[str, list[int]]:
    """Size and time of each data file below a folder, or of the file itself, by its name from there on."""
    fs, place = _folder(spark, path)
    if not fs.exists(place):
        return {}
    root, found = fs.makeQualified(place).toString().rstrip("/"), {}
    each = fs.listFiles(place, True)
    while each.hasNext():
        one = each.next()
        name = one.getPath().toString()[len(root):].lstrip("/")
        if not _hidden(name):
            found[name] = [one.getLen(), one.getModificationTime()]
    return found


def source_mark(spark: SparkSession, paths: list[str], more: str = "") -> str:
    """A mark that changes when a file of the inputs does; ``more`` tells versions of what is made from them."""
    seen = {p: sorted(data_files(spark, p).items()) for p in paths}
    return sha256(json.dumps([seen, more], sort_keys=True).encode()).hexdigest()[:32]


def read_manifest(spark: SparkSession, path: str) -> dict | None:
    fs, place = _folder(spark, f"{path}/{MANIFEST}")
    if not fs.exists(place):
        return None
    stream = fs.open(place)
    try:
        return json.loads(spark.sparkContext._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8"))
    finally:
        stream.close()


def _write_text(spark: SparkSession, path: str, text: str) -> None:
    fs, place = _folder(spark, path)
    stream = fs.create(place, True)
    try:
        stream.write(bytearray(text.encode()))
    finally:
        stream.close()


def write_snapshot(df: DataFrame, path: str, by: str | None = None, fmt: str = "parquet", replace: str = "table", source: str | None = None) -> str:
    """Write a fact or result, in folders of ``by`` where given, then its manifest; ``source`` is the mark of what it was made from.

    ``replace="table"`` replaces all that was there, ``"folders"`` only the folders that ``df`` has rows for, as a refresh of one
    quarter does. A path that ``df`` itself reads from is refused. The old manifest goes first, so nobody trusts a table that is being replaced.

    Rows are rebalanced on the folder column first: small folders get one file instead of one per task,
    and a folder that holds much of the table is split over several tasks.
    """
    if replace not in ("table", "folders") or (replace == "folders" and not by):
        raise ValueError("replace is 'table', or 'folders' where there are folders")
    spark = df.sparkSession
    inside = urlparse(path).path.rstrip("/") + "/"
    if any(urlparse(f).path.startswith(inside) for f in df.inputFiles()):
        raise ValueError(f"{path} is read by the frame that would replace it")
    fs, place = _folder(spark, f"{path}/{MANIFEST}")
    fs.delete(place, False)
    if by:
        df = df.hint("rebalance", F.col(by))
    writer = df.write.mode("overwrite").format(fmt).option("partitionOverwriteMode", "dynamic" if replace == "folders" else "static")
    if fmt == "csv":
        writer = writer.option("header", True)
    (writer.partitionBy(by) if by else writer).save(path)
    # Parquet counts come from the files' footers.
    back = _reader(spark, df.schema, fmt).load(path)
    rows = back.groupBy(F.col(by).cast("string").alias("folder") if by else F.lit("").alias("folder")).agg(F.count(F.lit(1)).alias("n")).collect()
    folders = {r.folder or "": r.n for r in rows}
    _write_text(spark, f"{path}/{MANIFEST}", json.dumps({"rows": sum(folders.values()), "folders": folders if by else {}, "files": data_files(spark, path),
                                                         "format": fmt, "by": by, "source": source}, sort_keys=True))
    return path


def _reader(spark: SparkSession, schema, fmt: str):
    reader = spark.read.schema(schema).format(fmt)
    return reader.option("header", True) if fmt == "csv" else reader


def check_snapshot(spark: SparkSession, path: str, source: str | None = None) -> dict:
    """The manifest, or an error that says what is amiss: never finished, files lost, changed or added, or made from another input."""
    manifest = read_manifest(spark, path)
    if manifest is None:
        raise SnapshotError(f"{path} has no manifest: it was never finished, or is being replaced")
    there, told = data_files(spark, path), manifest["files"]
    wrong = sorted(f for f in {*there, *told} if there.get(f) != told.get(f))
    if wrong:
        kinds = ["lost" if f not in there else "added" if f not in told else "changed" for f in wrong]
        raise SnapshotError(f"{path}: {len(wrong)} files differ from the manifest, first {wrong[0]} ({kinds[0]})")
    if source is not None and manifest["source"] != source:
        raise SnapshotError(f"{path} was made from another input")
    return manifest


def read_snapshot(spark: SparkSession, path: str, schema, fmt: str = "parquet", source: str | None = None) -> DataFrame:
    """Open a table after ``check_snapshot``. Files that are lost later fail the job that reads them."""
    check_snapshot(spark, path, source)
    return _reader(spark, schema, fmt).load(path)


def folders_in(spark: SparkSession, folder: str) -> list[str]:
    fs, place = _folder(spark, folder)
    return sorted(x.getPath().toString() for x in fs.listStatus(place)) if fs.exists(place) else []


def latest_snapshot(spark: SparkSession, folder: str, source: str) -> str | None:
    """The first table in ``folder`` that is whole and made from ``source``: what another session has left, if anything."""
    for one in folders_in(spark, folder):
        try:
            check_snapshot(spark, one, source)
            return one
        except SnapshotError:
            continue
    return None


def write_profile(df: DataFrame, path: str) -> str:
    """Write the metadata row of a fact as JSON."""
    dataset_profile(df).write.mode("overwrite").json(path)
    return path
