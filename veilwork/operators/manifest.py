"""Names of files: what is supported, where the masked copy goes, what must not be overwritten."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# fixed values
EXTENSIONS = (".pdf", ".docx", ".xlsx")
SUFFIX = "_REDACTED"
#: So many output paths may be broadcast.
FEW = 100_000


def extension(path: Column) -> Column:
    return F.lower(F.regexp_extract(path, r"(\.[^./\\]+)$", 1))


def supported(files: DataFrame) -> DataFrame:
    """Files that can be read, each path once."""
    return files.where(extension(F.col("path")).isin(*EXTENSIONS)).dropDuplicates(["path"])


def output_path(path: Column, out_dir: str | None = None, suffix: str = SUFFIX) -> Column:
    """``<folder>/<stem><suffix><ext>``, beside the source or in ``out_dir``."""
    name = F.regexp_extract(path, r"([^/]*)$", 1)
    stem, ext = F.regexp_replace(name, r"(?<=.)\.[^.]*$", ""), F.regexp_extract(name, r"(?<=.)(\.[^.]*)$", 1)
    folder = F.regexp_extract(path, r"^(.*/)?[^/]*$", 1) if out_dir is None else F.lit(out_dir.rstrip("/") + "/")
    return F.concat(folder, stem, F.lit(suffix), ext)


def image_path(path: Column, page: Column, fmt: str = "PNG") -> Column:
    """Where page ``page`` (from 1) of a masked file is rendered to."""
    ext = ".jpg" if fmt.upper() in ("JPG", "JPEG") else ".png"
    stem = F.regexp_replace(path, r"(?<=[^/])\.[^./]*$", "")
    name = F.regexp_extract(stem, r"([^/]*)$", 1)
    return F.concat(stem, F.lit("_images/"), name, F.lit("_p"), F.lpad(page.cast("string"), 3, "0"), F.lit(ext))


def image_name(path: str, page: int, fmt: str = "PNG") -> str:
    """As ``image_path``, for one path."""
    folder, _, name = path.rpartition("/")
    stem = name[: name.rfind(".")] if name.rfind(".") > 0 else name
    at = f"{stem}_images/{stem}_p{page:03d}" + (".jpg" if fmt.upper() in ("JPG", "JPEG") else ".png")
    return f"{folder}/{at}" if folder else at


def dropped_paths(text: str) -> list[str]:
    """Paths in a string of dropped files: apart by white space, those with spaces in braces. One without its end takes the rest."""
    import re

    return [braced or plain for braced, plain in re.findall(r"\{([^}]*)\}?|(\S+)", text) if braced or plain]


def queued(files: DataFrame, more: DataFrame) -> DataFrame:
    """The queue with the supported ones of ``more`` that it doesn't hold yet."""
    return supported(files.select("path").unionByName(more.select("path")))


def manifest(files: DataFrame, out_dir: str | None = None, suffix: str = SUFFIX, out_path: str | dict[str, str] | None = None) -> DataFrame:
    """``(path, out, error)``: an error where the output is the source, or where two sources share an output.

    ``out_path``: the output of a single file, or outputs by the ends of their sources' paths (a short list, part of the plan).
    """
    out = files.select("path", target_path(F.col("path"), out_dir, suffix, out_path).alias("out"))
    shared = out.groupBy("out").agg(F.count("*").alias("_n"))
    return out.join(shared, "out").select("path", "out", _error(F.col("path"), F.col("out"), F.col("_n") > 1).alias("error"))


def target_path(path: Column, out_dir: str | None = None, suffix: str = SUFFIX, out_path: str | dict[str, str] | None = None) -> Column:
    """Where the masked copy goes, explicit outputs first."""
    if isinstance(out_path, str):
        return F.lit(out_path)
    to = output_path(path, out_dir, suffix)
    for end, own in (out_path or {}).items():
        to = F.when(path.endswith(end), F.lit(own)).otherwise(to)
    return to


def _error(path: Column, out: Column, shared: Column) -> Column:
    return (
        F.when(~extension(path).isin(*EXTENSIONS), F.concat(F.lit("Unsupported file type: "), extension(path)))
        .when(path == out, F.lit("Output path equals the source"))
        .when(shared, F.lit("Output path is shared by several sources"))
    )


def refused(files: DataFrame, paths: DataFrame, out_dir: str | None = None, suffix: str = SUFFIX, out_path: str | dict[str, str] | None = None) -> DataFrame:
    """``files`` with the ``error`` of ``manifest`` as ``refused``; ``paths`` are those of all files.

    Files don't move for it unless more than ``FEW`` outputs are shared, which a job over the paths finds out first.
    """
    out = target_path(F.col("path"), out_dir, suffix, out_path)
    shared = paths.select(out.alias("_out")).groupBy("_out").agg(F.count("*").alias("_n")).where("_n > 1").select("_out", F.lit(True).alias("_shared"))
    n = shared.limit(FEW + 1).count()
    if n:
        marked = files.withColumn("_out", out).join(F.broadcast(shared) if n <= FEW else shared, "_out", "left").drop("_out")
    else:
        marked = files.withColumn("_shared", F.lit(False))
    return marked.withColumn("refused", _error(F.col("path"), out, F.coalesce("_shared", F.lit(False)))).drop("_shared")
