"""Readers, writers, hashes and seeded samples."""

from __future__ import annotations

import hashlib
import json
from dataclasses import dataclass
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quern.functions.stats import hash_share, plain_missing

#: File endings by format.
FORMATS = {
    "csv": (".csv", ".tsv", ".txt"),
    "parquet": (".parquet", ".pq"),
    "excel": (".xlsx", ".xlsm", ".xls"),
}


class InputError(ValueError):
    """The input can't be used; the message says why."""


@dataclass(frozen=True)
class Source:
    """Where a table came from."""

    path: str
    format: str
    total_rows: int | None = None
    sampled: bool = False
    sample_rows: int | None = None
    seed: int | None = None


@dataclass(frozen=True)
class Table:
    frame: DataFrame
    source: Source


def supported_formats() -> list[str]:
    return sorted(x for endings in FORMATS.values() for x in endings)


def detect_format(path: str) -> str:
    ending = Path(path.rstrip("/")).suffix.lower()
    for name, endings in FORMATS.items():
        if ending in endings:
            return name
    raise InputError(f"{path}: unknown format {ending or '(none)'}; known are {', '.join(supported_formats())}")


def normalise_missing(df: DataFrame) -> DataFrame:
    """NaN becomes null in every floating-point column."""
    return df.select(*[plain_missing(n, t).alias(n) for n, t in df.dtypes])


def _read_csv(spark: SparkSession, path: str) -> DataFrame:
    options = {"header": True, "inferSchema": True, "sep": "\t" if path.lower().endswith(".tsv") else ","}
    df = spark.read.options(**options, encoding="UTF-8", mode="PERMISSIVE").csv(path)
    strings = [n for n, t in df.dtypes if t == "string"]
    broken = F.lit(False)
    for n in strings:
        broken |= F.coalesce(F.col(f"`{n}`").contains("�"), F.lit(False))
    if strings and not df.where(broken).isEmpty():
        df = spark.read.options(**options, encoding="ISO-8859-1").csv(path)
    return df


def read_table(
    spark: SparkSession, path: str, sample_rows: int | None = None, seed: int = 0, key: list[str] | None = None
) -> Table:
    """Read a file or folder of part files; all of it unless ``sample_rows`` is given."""
    kind = detect_format(path)
    try:
        if kind == "parquet":
            df = spark.read.parquet(path)
        elif kind == "csv":
            df = _read_csv(spark, path)
        else:
            try:
                import openpyxl  # noqa: F401
            except ImportError:
                raise InputError("reading Excel files needs the package openpyxl") from None
            import pandas as pd

            df = spark.createDataFrame(pd.read_excel(path))
    except InputError:
        raise
    except Exception as error:
        raise InputError(f"{path}: {str(error).splitlines()[0]}") from error
    if not df.columns:
        raise InputError(f"{path}: no columns")
    df = normalise_missing(df)
    if sample_rows is None:
        return Table(df, Source(path, kind))
    total = df.count()
    if total == 0:
        raise InputError(f"{path}: no rows")
    if total <= sample_rows:
        return Table(df, Source(path, kind, total, False, None, seed))
    return Table(hash_sample(df, sample_rows, total, seed, key), Source(path, kind, total, True, sample_rows, seed))


def hash_sample(df: DataFrame, rows: int, total: int, seed: int = 0, key: list[str] | None = None) -> DataFrame:
    """About ``rows`` rows, kept if a hash of seed and key is small: repeatable in any partitioning."""
    keys = [F.col(f"`{c}`") for c in key] if key else [F.to_json(F.struct("*"))]
    return df.where(hash_share(*keys, seed=seed) < min(1.0, rows / max(total, 1)))


def write_table(df: DataFrame, path: str) -> None:
    ending = Path(path.rstrip("/")).suffix.lower()
    if ending in FORMATS["parquet"]:
        df.write.mode("overwrite").parquet(path)
    elif ending in FORMATS["csv"]:
        df.write.mode("overwrite").csv(path, header=True, sep="\t" if ending == ".tsv" else ",")
    else:
        raise InputError(f"{path}: can be written as {', '.join(FORMATS['parquet'] + FORMATS['csv'])}")


def hash_file(path: str) -> str:
    """SHA-256 of a file's bytes; of a folder, of its files' sorted names and digests."""
    at = Path(path)
    if at.is_dir():
        lines = [f"{p.relative_to(at)} {hash_file(str(p))}" for p in sorted(at.rglob("*")) if p.is_file() and p.name[0] not in "._"]
        return hashlib.sha256("\n".join(lines).encode()).hexdigest()
    with at.open("rb") as f:
        return hashlib.file_digest(f, "sha256").hexdigest()


def hash_table(df: DataFrame) -> str:
    """Digest of a table's columns, types and rows, whatever their order or partitioning: one aggregate."""
    row = F.to_json(F.struct(*[F.col(f"`{n}`") for n in sorted(df.columns)]))
    sums = df.agg(F.count(F.lit(1)), *[F.sum(F.xxhash64(F.lit(k), row).cast("decimal(38,0)")) for k in range(2)]).first()
    return hash_payload([sorted(df.dtypes), *map(str, sums)])


def hash_payload(payload: object) -> str:
    return hashlib.sha256(json.dumps(payload, sort_keys=True, separators=(",", ":")).encode()).hexdigest()


def read_manifests(spark: SparkSession, folder: str) -> DataFrame:
    """Run manifests as rows; unreadable files come back in ``_corrupt_record``."""
    return spark.read.option("multiLine", True).option("pathGlobFilter", "*.json").json(folder)
