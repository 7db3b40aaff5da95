"""Files as rows: kind by content, folder listing, text readers."""

from __future__ import annotations

import io
import zipfile

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from docloom.functions.html import html_text_udf, title_column, unescape_udf
from docloom.functions.columns import title_guess

#: Extensions of the kinds (fixed values).
EXTENSIONS = {
    "pdf": "pdf", "image": "jpg jpeg png tif tiff bmp webp heic heif gif", "audio": "wav mp3 m4a aac ogg flac aiff aif caf opus", "video": "mp4 mov mkv webm avi m4v",
    "office": "docx dotx docm pptx potx ppsx xlsx xlsm odt ods odp", "html": "html htm xhtml", "text": "md markdown txt text csv adoc asciidoc tex vtt", "epub": "epub", "archive": "zip tar tgz gz bz2 tbz2 xz txz",
}
ACCEPTED = ("pdf", "image", "audio", "video", "office", "html", "text", "epub")
SKIP_DIRS = ("__MACOSX", ".git", "node_modules", ".Trash", ".Spotlight-V100", ".fseventsd")
SKIP_FILES = (".DS_Store", "Thumbs.db", "desktop.ini", "Icon\r")
BUNDLES = (".app", ".photoslibrary", ".framework", ".bundle", ".xcodeproj", ".numbers", ".pages", ".key")
#: First bytes in hex, from the given place on, and the kind they mean (fixed values, tried in order).
MAGIC = (
    (1, "255044462D", "pdf"), (1, "89504E470D0A1A0A", "image"), (1, "FFD8FF", "image"), (1, "49492A00", "image"), (1, "4D4D002A", "image"), (1, "424D", "image"), (1, "474946383761", "image"), (1, "474946383961", "image"),
    (1, "664C6143", "audio"), (1, "494433", "audio"), (1, "FFFB", "audio"), (1, "FFF3", "audio"), (1, "4F676753", "audio"), (1, "1F8B", "archive"), (1, "425A68", "archive"), (1, "FD377A585A00", "archive"), (1, "1A45DFA3", "video"), (258, "7573746172", "archive"),
)
RIFF = {"57454250": "image", "57415645": "audio"}
BRANDS = {**dict.fromkeys((b.encode().hex().upper() for b in ("heic", "heix", "hevc", "mif1", "msf1", "heif")), "image"), **dict.fromkeys((b.encode().hex().upper() for b in ("M4A ", "M4B ", "M4P ")), "audio")}


def extension(path: Column) -> Column:
    name = F.lower(F.regexp_replace(path, r"^.*/", ""))
    return F.when(name.endswith(".tar.gz"), "tgz").otherwise(F.regexp_extract(name, r"[^.]\.([^.]+)$", 1))


def kind_of_extension(ext: Column) -> Column:
    out: Column = F.lit("unknown")
    for kind, exts in EXTENSIONS.items():
        out = F.when(ext.isin(*exts.split()), kind).otherwise(out)
    return out


@F.pandas_udf(T.StringType())
def _zip_kind(content: pd.Series) -> pd.Series:
    """Office files and books are zips; their own manifest tells, not the name."""

    def look(b: bytes | None) -> str:
        try:
            with zipfile.ZipFile(io.BytesIO(b or b"")) as z:
                names = z.namelist()[:64]
                if "[Content_Types].xml" in names:
                    return "office"
                mark = z.read("mimetype")[:64] if "mimetype" in names else b""
        except (zipfile.BadZipFile, KeyError, OSError):
            return "archive"
        return "epub" if mark.startswith(b"application/epub") else "office" if mark.startswith(b"application/vnd.oasis.opendocument") else "archive"

    return content.map(look)


def sniff(files: DataFrame) -> DataFrame:
    """Adds ext, kind and mismatch to rows of (path, content).

    The first bytes decide; text formats have none, so an extension of theirs is believed if the bytes
    look like text. Only zips reach Python. Null content counts as empty.
    """
    c = F.coalesce("content", F.lit(b""))

    def at(place: int, size: int) -> Column:
        return F.hex(F.substring(c, place, size))

    ext = extension(F.col("path"))
    by_ext = kind_of_extension(ext)
    head = F.lower(F.ltrim(F.decode(F.substring(c, 1, 512), "ISO-8859-1"), F.lit(" \t\r\n\f")))
    html = head.startswith("<!doctype html") | head.startswith("<html") | head.startswith("<?xml") | head.contains("<html")
    magic: Column = F.when(html, "html")
    for place, sign, kind in reversed(MAGIC):
        magic = F.when(at(place, len(sign) // 2) == sign, kind).otherwise(magic)
    riff, ftyp = F.lit(None).cast("string"), F.when(ext.isin(*EXTENSIONS["audio"].split()), "audio").otherwise(F.lit("video"))
    for sign, kind in RIFF.items():
        riff = F.when(at(9, 4) == sign, kind).otherwise(riff)
    for sign, kind in BRANDS.items():
        ftyp = F.when(at(9, 4) == sign, kind).otherwise(ftyp)
    aiff = F.when(at(9, 4).isin("41494646", "41494643"), "audio")
    zips = F.when(ext.isin("docx", "dotx", "docm", "pptx", "potx", "ppsx", "xlsx", "xlsm"), "office").when(ext == "epub", "epub").otherwise(_zip_kind(F.when(at(1, 4) == "504B0304", c)))
    magic = F.when(at(1, 4) == "52494646", riff).when(at(1, 4) == "464F524D", aiff).when(at(5, 4) == "66747970", ftyp).when(at(1, 4) == "504B0304", zips).otherwise(magic)
    # Text if nothing but a few of the first bytes are control characters.
    first = F.decode(F.substring(c, 1, 1024), "ISO-8859-1")
    bad = F.length(first) - F.length(F.regexp_replace(first, r"[\x00-\x08\x0b\x0e-\x1f]", ""))
    textual = (bad * 50 <= F.length(first)) & ~first.contains("\u0000")
    rows = files.withColumns({"ext": ext, "_magic": magic, "_ext_kind": by_ext, "_textual": textual})
    kind = F.coalesce("_magic", F.when((F.col("_ext_kind") != "unknown") & F.col("_textual"), F.col("_ext_kind")), F.lit("unknown"))
    wrong = F.col("_magic").isNotNull() & (F.col("_ext_kind") != "unknown") & (F.col("_ext_kind") != F.col("_magic"))
    return rows.withColumns({"kind": kind, "mismatch": wrong}).drop("_magic", "_ext_kind", "_textual")


def list_files(spark: SparkSession, root: str, recursive: bool = True) -> DataFrame:
    """Non-empty files under root (path, length, modificationTime, content), without hidden ones, junk and bundles."""
    rows = spark.read.format("binaryFile").option("recursiveFileLookup", str(recursive).lower()).load(root)
    inner = F.regexp_replace(F.col("path"), r"^[a-z]+:/*", "/")
    base = root.removeprefix("file:").rstrip("/")
    parts = F.split(F.substr(inner, F.lit(len(base) + 2)), "/")
    name, dirs = F.element_at(parts, -1), F.slice(parts, 1, F.greatest(F.size(parts) - 1, F.lit(0)))
    hidden = F.exists(dirs, lambda d: d.startswith(".") | d.isin(*SKIP_DIRS) | d.rlike("(" + "|".join(b.replace(".", r"\.") for b in BUNDLES) + ")$"))
    return rows.where((F.col("length") > 0) & ~hidden & ~name.startswith(".") & ~name.startswith("~$") & ~name.isin(*SKIP_FILES))


def compatible(spark: SparkSession, root: str, archives: bool = True) -> DataFrame:
    """Listed files of an accepted kind, and archives if asked for."""
    kinds = (*ACCEPTED, "archive") if archives else ACCEPTED
    return sniff(list_files(spark, root)).where(F.col("kind").isin(*kinds))


def count_compatible(files: DataFrame, limit: int = 50_000) -> DataFrame:
    """Numbers by kind, and whether the limit was reached."""
    total = files.limit(limit).groupBy("kind").agg(F.count("*").alias("n"))
    return total.withColumn("capped", F.sum("n").over(Window.partitionBy()) >= limit)


def read_texts(files: DataFrame) -> DataFrame:
    """(path, kind, title, text, sha256, n_chars) of text, Markdown and HTML files; other kinds need a decoder (adapters)."""
    body = F.make_valid_utf8(F.decode(F.col("content"), "UTF-8"))
    rows = files.where(F.col("kind").isin("text", "html")).select("path", "kind", F.sha2("content", 256).alias("sha256"), body.alias("raw"))
    text = F.when(F.col("kind") == "html", html_text_udf("raw")).otherwise(F.col("raw"))
    rows = rows.withColumn("text", text)
    title = F.coalesce(F.when(F.col("kind") == "html", unescape_udf(title_column(F.col("raw")))), title_guess(F.col("text")))
    return rows.select("path", "kind", title.alias("title"), "text", "sha256", F.length("text").alias("n_chars"))
