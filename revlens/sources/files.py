"""Whole files: their digests, and copies that are there whole or not at all."""

from __future__ import annotations

import hashlib
import os
import shutil
import uuid
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

BLOCK = 1 << 17


def digests(spark: SparkSession, path: str) -> DataFrame:
    """(path, size, md5, sha1, sha512) of files, computed where they are read."""
    files = spark.read.format("binaryFile").load(path)
    return files.select("path", F.col("length").alias("size"), F.md5("content").alias("md5"), F.sha1("content").alias("sha1"), F.sha2("content", 512).alias("sha512"))


def differing(found: DataFrame, expected: DataFrame) -> DataFrame:
    """Expected files (path, sha1) that are absent or differ."""
    return expected.join(found.select("path", F.col("sha1").alias("_sha1")), "path", "left").where("_sha1 IS NULL OR _sha1 <> sha1").drop("_sha1")


def digest(path: Path, kind: str = "sha1") -> str:
    h = hashlib.new(kind)
    with open(path, "rb") as f:
        while block := f.read(BLOCK):
            h.update(block)
    return h.hexdigest()


def verified(path: Path, expected: str, kind: str = "sha1") -> Path:
    if digest(path, kind) != expected:
        raise FileExistsError(f"{path} is not what was expected")
    return path


def fetched(source: Path, target: Path, sha1: str) -> Path:
    """target, copied from source unless it is there; verified in either case."""
    if not target.exists():
        target.parent.mkdir(parents=True, exist_ok=True)
        part = target.with_name(f"tmp.{uuid.uuid4().hex}.{target.name}")
        shutil.copyfile(source, part)
        try:
            verified(part, sha1)
        except FileExistsError:
            part.unlink()
            raise
        os.replace(part, target)
    return verified(target, sha1)
