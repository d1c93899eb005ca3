"""Files as a source: what to index, their attributes, plain text, and the slot for other extractors."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: The longest text that is kept, and the largest file that is read as text.
MOST_CHARS, MOST_BYTES = 2_490_999, 5 * 1024 * 1024
#: Types by the end of a file's name, and the class of each kind of file.
MIME = {"txt": "text/plain", "md": "text/plain", "html": "text/html", "pdf": "application/pdf", "png": "image/png", "jpg": "image/jpeg", "mp3": "audio/mpeg", "ogg": "audio/ogg", "mp4": "video/mp4", "zip": "application/zip"}
KINDS = {"text/": "nfo:TextDocument", "image/": "nfo:Image", "audio/": "nfo:Audio", "video/": "nfo:Video", "application/zip": "nfo:Archive", "application/pdf": "nfo:PaginatedTextDocument"}


def glob_pattern(glob: str) -> str:
    return "^" + "".join({"*": ".*", "?": "."}.get(c, re.escape(c)) for c in glob) + "$"


def should_index(path: Column, include: list[str], exclude: list[str], names: list[str] = (), hidden: bool = False) -> Column:
    """The longest included or excluded folder that holds a file decides; hidden files and the excluded names are out."""
    length = lambda folders: F.greatest(F.lit(-1), F.lit(-1), *[F.when(path.startswith(f.rstrip("/") + "/"), len(f.rstrip("/"))).otherwise(-1) for f in folders])
    ok = length(include) > length(exclude)
    name = F.substring_index(path, "/", -1)
    for glob in names:
        ok &= ~name.rlike(glob_pattern(glob))
    return ok if hidden else ok & ~path.rlike(r"/\.[^/]")


def walk(spark: SparkSession, root: str) -> DataFrame:
    """path, modificationTime, length of the files below root; contents are not read."""
    return spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root).select("path", "modificationTime", "length")


def fresh(files: DataFrame, known: DataFrame) -> DataFrame:
    """Files that are not known (path, modificationTime), or changed since."""
    return files.join(known.select("path", "modificationTime"), ["path", "modificationTime"], "left_anti")


def mime_type(path: str) -> Column:
    """The type that the end of a path says."""
    ending = F.lower(F.substring_index(path, ".", -1))
    return F.coalesce(F.try_element_at(F.create_map(*[F.lit(x) for kv in MIME.items() for x in kv]), ending), F.lit("application/octet-stream"))


def attributes(files: DataFrame) -> DataFrame:
    """url, name, size, mime, type, modified of files."""
    kind = F.lit("nfo:FileDataObject")
    for start, cls in KINDS.items():
        kind = F.when(F.col("mime").startswith(start), cls).otherwise(kind)
    rows = files.select(F.col("path").alias("url"), F.substring_index("path", "/", -1).alias("name"), F.col("length").alias("size"), mime_type("path").alias("mime"), F.col("modificationTime").alias("modified"))
    return rows.withColumn("type", kind)


def plain_text(spark: SparkSession, path: str) -> DataFrame:
    """path, text, words, lines, chars of text files up to MOST_BYTES."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).filter(F.col("length") <= MOST_BYTES)
    return text_counts(files.select("path", F.decode("content", "UTF-8").alias("text")))


def text_counts(rows: DataFrame) -> DataFrame:
    """Adds words, lines and chars of text, and keeps MOST_CHARS of it."""
    words, lines = F.regexp_count("text", F.lit(r"[^\x20\x09-\x0D]+")), F.regexp_count("text", F.lit("\n")) + F.when((F.length("text") > 0) & ~F.col("text").endswith("\n"), 1).otherwise(0)
    return rows.withColumn("words", words).withColumn("lines", lines).withColumn("chars", F.length("text")).withColumn("text", F.substring("text", 1, MOST_CHARS))


#: Extractors by type: bytes to (property, value) pairs. Formats that need libraries are registered by their users.
EXTRACTORS: dict[str, Callable[[bytes], list[tuple[str, str]]]] = {}


def extracted(spark: SparkSession, path: str) -> DataFrame:
    """url, p, o by the registered extractors; a file that one fails on gives an error row, and does not stop the others."""
    table = dict(EXTRACTORS)

    def rows(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for url, mime, content in zip(batch["url"], batch["mime"], batch["content"], strict=True):
                for start, extract in table.items():
                    if mime.startswith(start):
                        try:
                            out += [(url, p, str(o)[:MOST_CHARS]) for p, o in extract(bytes(content))]
                        except Exception as error:  # noqa: BLE001
                            out.append((url, "error", repr(error)))
            yield pd.DataFrame(out, columns=["url", "p", "o"])

    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    typed = files.select(F.col("path").alias("url"), mime_type("path").alias("mime"), "content")  # contents are not shuffled
    return typed.mapInPandas(rows, "url string, p string, o string").distinct()
