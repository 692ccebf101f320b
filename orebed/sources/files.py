"""Files as assets, and publishing results as files."""

from __future__ import annotations

import os
import stat
import tempfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..errors import EngineError


def locator(path: Path) -> str:
    return path.as_posix()


def expand(paths: list[Path], recursive: bool = False) -> list[Path]:
    """Files in argument order; folders, if allowed, depth first by name. Links and special files are errors."""
    out = []
    for p in paths:
        if p.is_dir() and not (recursive and p.is_symlink()):
            if not recursive:
                raise EngineError(f"{p} is a folder; import it recursively")
            out += expand(sorted(p.iterdir(), key=lambda x: x.name.encode()), True)
        elif recursive and p.is_symlink():
            raise EngineError(f"{p} is a link")
        elif not p.exists():
            raise EngineError(f"{p} does not exist")
        elif not stat.S_ISREG(p.stat().st_mode):
            raise EngineError(f"{p} is no regular file")
        else:
            out.append(p)
    return out


def read_files(spark: SparkSession, paths: list[Path], order: list[int]) -> DataFrame:
    """(locator, data, seq), read by the executors."""
    if not paths:
        return spark.createDataFrame([], "locator string, data binary, seq bigint")
    names = spark.createDataFrame([(p.resolve().as_uri().replace("file:///", "file:/"), locator(p), n) for p, n in zip(paths, order, strict=True)], "path string, locator string, seq bigint")
    data = spark.read.format("binaryFile").load([str(p.resolve()) for p in dict.fromkeys(paths)]).select(F.col("path"), F.col("content").alias("data"))
    return data.join(F.broadcast(names), "path").select("locator", "data", "seq")  # the listing is the caller's own


def publish(target: Path, data: bytes) -> None:
    """Writes a new file whole, or not at all; an existing file is never replaced."""
    target.parent.mkdir(parents=True, exist_ok=True)
    fd, temp = tempfile.mkstemp(dir=target.parent)
    try:
        with os.fdopen(fd, "wb") as f:
            f.write(data)
            f.flush()
            os.fsync(f.fileno())
        try:
            os.link(temp, target)
        except FileExistsError:
            raise EngineError(f"{target} exists") from None
    finally:
        os.unlink(temp)


def inside(root: Path, path: Path, limit: int) -> Path:
    """The canonical path of a file that must lie inside root."""
    real = path.resolve(strict=True)
    if not real.is_relative_to(root.resolve()) or not real.is_file():
        raise EngineError(f"{path} is not a file of the workspace")
    if real.stat().st_size > limit:
        raise EngineError(f"{path} exceeds its size limit")
    return real


def save_each(assets: DataFrame, folder: str) -> int:
    """Publishes every (locator, data) row below a shared folder, from the executors; existing files are errors."""

    def write(rows):
        for r in rows:
            publish(Path(folder) / r.locator, bytes(r.data))

    assets.select("locator", "data").foreachPartition(write)
    return assets.count()
