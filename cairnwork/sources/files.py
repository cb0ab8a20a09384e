"""Scans of labelled files and keys derived from their names."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# The file name extensions of clips, and the mark of derived rows.
EXTENSIONS = ("flac", "m4a", "mp3", "ogg", "wav")
DERIVED_MARK = "_aug_"
GROUP_CHARACTERS = 36


def scan_labelled_files(spark: SparkSession, root: str, classes: list[str] | None = None, extensions: tuple[str, ...] = EXTENSIONS) -> DataFrame:
    """path, label, stem, extension, length of the clips in <root>/<class>/; contents stay unread.

    Only names that end in an extension (in either case) are listed. classes limits the labels; a class without
    folder or files has no rows.
    """
    letters = ",".join("".join(f"[{c}{c.upper()}]" if c.isalpha() else c for c in e) for e in extensions)
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", f"*.{{{letters}}}").load(root).select("path", "length")
    return labelled_paths(files, classes, extensions)


def labelled_paths(files: DataFrame, classes: list[str] | None = None, extensions: tuple[str, ...] = EXTENSIONS) -> DataFrame:
    """label (the folder's name), stem and extension (in lower case) beside path and the other columns, of the paths with one of the extensions."""
    parts = F.split("path", "/")
    name = F.element_at(parts, -1)
    others = [c for c in files.columns if c != "path"]
    found = files.select("path", F.element_at(parts, -2).alias("label"), F.regexp_replace(name, r"\.[^.]*$", "").alias("stem"), F.lower(F.regexp_extract(name, r"\.([^.]*)$", 1)).alias("extension"), *others)
    found = found.where(F.col("extension").isin(*extensions))
    return found if classes is None else found.where(F.col("label").isin(classes))


def is_derived(stem: Column) -> Column:
    return F.coalesce(stem.contains(DERIVED_MARK), F.lit(False))


def filter_originals(df: DataFrame, stem: str = "stem", extension: str | None = None) -> DataFrame:
    """Rows that aren't derived from others, and of one extension only where one is given."""
    df = df.where(~is_derived(F.col(stem)))
    return df if extension is None else df.where(F.col("extension") == extension)


def group_key(stem: Column) -> Column:
    """The first 36 characters of the name before any mark of derivation, in lower case."""
    return F.lower(F.substring(F.split(stem, DERIVED_MARK)[0], 1, GROUP_CHARACTERS))


def encode_label(df: DataFrame, label: str, domain: list[str], out: str = "label_idx") -> DataFrame:
    """df with the label's place (from 0) in the domain; null for others. The domain is a literal, so that no join is needed."""
    return df.withColumn(out, (F.nullif(F.array_position(F.array(*map(F.lit, domain)), F.col(label)), F.lit(0)) - 1).cast("int"))


def decode_label(df: DataFrame, index: str, domain: list[str], out: str = "label") -> DataFrame:
    return df.withColumn(out, F.get(F.array(*map(F.lit, domain)), F.col(index)))
