"""Media files: manifests and PCM block tables from binary files.

Folders are listed, and files hashed, by tasks: a path or a file's bytes never come to the driver, and a file of any size is
digested in chunks.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from urllib.parse import unquote

import pandas as pd
import pyarrow as pa
from pyarrow.fs import FileSelector, FileSystem, FileType
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tracklake.functions.text import safe_filename
from tracklake.storage import cut

EXTENSIONS = ("mp4", "mkv", "mov", "wav", "mp3", "m4a")
LIMIT = 10 * 1024**3
READ_LIMIT = 2**31 - 1024  # bytes of content that a column holds
CHUNK = 8 << 20  # bytes of a file that a task holds while it digests it
LISTED = "path string, length long, is_folder boolean"


def binary(spark: SparkSession, path: str, glob: str | None = None) -> DataFrame:
    reader = spark.read.format("binaryFile").option("recursiveFileLookup", "true")
    return (reader.option("pathGlobFilter", glob) if glob else reader).load(path)


def described(limit: int) -> tuple[dict[str, Column], Column]:
    """Columns of a manifest that path and length give, and the error code: empty, too_large or unsupported, in this order."""
    name = F.element_at(F.split("path", "/"), -1)
    ext = F.lower(F.regexp_extract(name, r"\.([^.]*)$", 1))
    error = F.when(F.col("length") == 0, "empty").when(F.col("length") > limit, "too_large").when(~ext.isin(*EXTENSIONS), "unsupported")
    columns = {"media_id": F.sha2("path", 256), "path": F.col("path"), "safe_name": F.substring(safe_filename(name), 1, 220), "ext": ext, "size_bytes": F.col("length")}
    return columns, error


def manifest(files: DataFrame, limit: int = LIMIT, read_limit: int = READ_LIMIT) -> DataFrame:
    """One row a file (path, length, content): media_id (sha256 of the path), path, safe_name, ext, size_bytes, sha256, error_code.

    Errors in order: empty, too_large, unsupported. Only files without an error are read for their hash: the reader
    prunes content where it is not asked for, and filters on length before it. A file of over read_limit bytes, more than a
    column can hold, is no error but has no hash.
    """
    columns, error = described(limit)
    named = lambda sha: [*(c.alias(k) for k, c in columns.items()), sha.alias("sha256"), error.alias("error_code")]
    readable = error.isNull() & (F.col("length") <= read_limit)
    return files.where(readable).select(*named(F.sha2("content", 256))).unionByName(files.where(~readable).select(*named(F.lit(None).cast("string"))))


def walk(spark: SparkSession, root: str) -> DataFrame:
    """(path, length) of all files below a folder, listed by tasks: a job for each level of folders, whatever their number.

    root names any store that pyarrow opens. Paths are as the store has them, after the root's scheme and host. A folder's
    own listing is one task's; names that begin with a dot or an underscore count like all others.
    """
    def listed(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        store, _ = FileSystem.from_uri(root)
        for pdf in batches:
            for folder in pdf["path"]:
                found = store.get_file_info(FileSelector(folder))
                for at in range(0, len(found), 10_000):
                    part = found[at : at + 10_000]
                    yield pd.DataFrame({"path": [f.path for f in part], "length": [f.size or 0 for f in part], "is_folder": [f.type == FileType.Directory for f in part]})

    level = spark.createDataFrame([(FileSystem.from_uri(root)[1],)], "path string")
    files = None
    while not level.isEmpty():
        found = cut(level.repartition("path").mapInPandas(listed, LISTED))
        here = found.where(~F.col("is_folder")).select("path", "length")
        files = here if files is None else files.unionByName(here)
        level = found.where("is_folder").select("path")
    return files


def digested(files: DataFrame, root: str, chunk: int = CHUNK) -> DataFrame:
    """files (path, as walk gives them) with sha256 of their bytes, read in chunks by tasks; null if a file cannot be read."""
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        store, _ = FileSystem.from_uri(root)
        for pdf in batches:
            for path in pdf["path"]:
                digest = hashlib.sha256()
                try:
                    with store.open_input_stream(path) as f:
                        while part := f.read(chunk):
                            digest.update(part)
                    yield pd.DataFrame({"path": [path], "sha256": [digest.hexdigest()]})
                except OSError:
                    yield pd.DataFrame({"path": [path], "sha256": [None]})

    # dealt by size: many small files to a task, a large one to a task of its own
    return files.repartitionByRange("length", "path").select("path").mapInPandas(run, "path string, sha256 string")


def media_manifest(spark: SparkSession, path: str, limit: int = LIMIT) -> DataFrame:
    """The manifest of the files under a path, listed and hashed by tasks; a file that cannot be read has error unreadable.

    A store that only Spark's reader opens is read by it: its paths are then listed on the driver, and files of over 2 GB
    have no hash.
    """
    try:
        FileSystem.from_uri(path)
    except (pa.ArrowInvalid, OSError):
        return read_manifest(spark, path, limit)
    columns, error = described(limit)
    scheme = re.match(r"[a-z0-9+]+:(?=//)|", path)[0]
    files = walk(spark, path)
    hashes = digested(files.where(error.isNull()), path)
    rows = files.join(hashes, "path", "left").withColumn("_error", F.when(error.isNull() & F.col("sha256").isNull(), "unreadable").otherwise(error))
    slashes = "" if scheme == "file:" else "//"  # as Spark's reader names files
    return rows.withColumn("path", F.concat(F.lit(scheme + slashes), "path")).select(*[c.alias(k) for k, c in columns.items()], "sha256", F.col("_error").alias("error_code"))


def read_manifest(spark: SparkSession, path: str, limit: int = LIMIT) -> DataFrame:
    """The manifest by Spark's binary reader, which passes over empty files; they are taken from its listing."""
    files = binary(spark, path)
    listed = [(re.sub(r"^file:/+", "file:/", unquote(p)),) for p in files.inputFiles()]
    empty = spark.createDataFrame(listed, "path string").join(files.select("path"), "path", "left_anti")
    return manifest(files, limit).unionByName(manifest(empty.select("path", F.lit(0).cast("long").alias("length"), F.lit(b"").alias("content")), limit))


def wav_blocks(spark: SparkSession, path: str, block: int = 1600, rate: int = 16000, channel_mode: str = "mean") -> DataFrame:
    """Blocks of the WAV files under a path, as decoded gives them."""
    return decoded(binary(spark, path, "*.wav"), block, rate, channel_mode)


def decoded(files: DataFrame, block: int = 1600, rate: int = 16000, channel_mode: str = "mean") -> DataFrame:
    """(path, block_index, rms, n, error_code) of 16-bit PCM WAV files (path, content); stereo is averaged, or its first channel taken.

    A file that is no 16-bit PCM WAV at the rate has one row with an error code.
    """
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import io
        import wave

        import numpy as np

        for pdf in batches:
            for p, content in zip(pdf["path"], pdf["content"], strict=True):
                try:
                    with wave.open(io.BytesIO(content)) as w:
                        if w.getframerate() != rate or w.getsampwidth() != 2:
                            raise ValueError("format")
                        x = np.frombuffer(w.readframes(w.getnframes()), "<i2").reshape(-1, w.getnchannels()) / 32768.0
                except (wave.Error, EOFError, ValueError) as e:
                    yield pd.DataFrame({"path": [p], "block_index": [None], "rms": [None], "n": [None], "error_code": ["format" if str(e) == "format" else "unreadable"]})
                    continue
                x = x.mean(axis=1) if channel_mode == "mean" else x[:, 0]
                starts = range(0, len(x), block)
                rms = [float(np.sqrt(np.mean(x[i : i + block] ** 2))) for i in starts]
                yield pd.DataFrame({"path": p, "block_index": range(len(rms)), "rms": rms, "n": [len(x[i : i + block]) for i in starts], "error_code": None})

    return files.select("path", "content").mapInPandas(run, "path string, block_index long, rms double, n long, error_code string")
