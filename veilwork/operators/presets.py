"""Presets: named lists of categories, built in or saved as JSON files in a folder."""

from __future__ import annotations

import json
import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from veilwork.functions.patterns import CATEGORIES, PRESETS


def builtin_presets() -> dict[str, list[str]]:
    return {name: list(keys) for name, keys in PRESETS.items()}


def category_labels() -> dict[str, str]:
    return {c.key: c.label for c in CATEGORIES.values()}


def preset_path(folder: str, name: str) -> str:
    """Letters, digits, spaces, ``_`` and ``-`` of the name make the file's; so different names may share a file."""
    return f"{folder.rstrip('/')}/" + "".join(filter(lambda c: c.isalnum() or c in " _-", name)).rstrip() + ".json"


def _store(path: str):
    """The file system of a path or URI, and the path in it."""
    from pyarrow import fs

    return fs.FileSystem.from_uri(path) if "://" in path else (fs.LocalFileSystem(), os.path.abspath(path))


def save_preset(folder: str, name: str, categories: list[str]) -> str:
    path = preset_path(folder, name)
    store, at = _store(path)
    store.create_dir(at.rpartition("/")[0], recursive=True)
    with store.open_output_stream(at) as f:
        f.write(json.dumps({"name": name, "categories": categories}, indent=2).encode())
    return path


def delete_preset(folder: str, name: str) -> bool:
    """Whether there was one."""
    store, at = _store(preset_path(folder, name))
    found = store.get_file_info(at).is_file
    if found:
        store.delete_file(at)
    return found


def saved_presets(spark: SparkSession, folder: str) -> DataFrame:
    """``(name, categories)`` from the folder's JSON files; malformed ones are left out, of a name the last file's counts."""
    jvm = spark.sparkContext._jvm
    pattern = jvm.org.apache.hadoop.fs.Path(f"{folder}/*.json")
    if not pattern.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).globStatus(pattern):
        return spark.createDataFrame([], "name string, categories array<string>")
    read = spark.read.text(f"{folder}/*.json", wholetext=True).select(
        F.input_file_name().alias("file"), F.from_json("value", "name string, categories array<string>").alias("p")
    )
    ok = read.where(F.col("p.name").isNotNull() & F.col("p.categories").isNotNull())
    return ok.groupBy(F.col("p.name").alias("name")).agg(F.max_by("p.categories", "file").alias("categories"))


def all_presets(builtin: DataFrame, saved: DataFrame) -> DataFrame:
    """Saved presets override built-in ones of the same name."""
    s = saved.select("name", F.col("categories").alias("_own"))
    return builtin.join(s, "name", "full_outer").select("name", F.coalesce("_own", "categories").alias("categories"))


def builtin_frame(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(list(builtin_presets().items()), "name string, categories array<string>")


def categories_of(name: str, presets: dict[str, list[str]] | None = None) -> list[str]:
    """A preset's categories; an unknown name means all."""
    return (presets or builtin_presets()).get(name, list(CATEGORIES))
