"""Content that users bring along: JSON lines, CSV and plain lines of URLs or texts, as batches or streams.

Spark's own file readers do the reading, so files may lie in any store that Spark reaches, are
split by the scan, and a stream takes up new files as they come.  Every format gives the same
rows: input_type, url, text, title, source, published, error.

Defined cases: a URL wins over a text beside it; a line of a plain file is a URL if it begins with
http:// or https://, else a text; blank lines and lines that begin with # are dropped; a JSON
line that is no object, or a row with neither URL nor text, keeps its place with an error and
no content; surrounding white space does not count; further fields are ignored, missing ones null.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

FIELDS = "url string, text string, title string, source string, published timestamp"
#: Endings of files and what they hold.
KINDS = {".jsonl": "json", ".ndjson": "json", ".json": "json", ".csv": "csv", ".txt": "lines", ".urls": "lines"}
#: How late a link may come again and still be the same item.
LATE = "1 day"


def kind_of(path: str) -> str:
    found = next((k for end, k in KINDS.items() if path.lower().rstrip("/*").endswith(end)), None)
    if found is None:
        raise ValueError(f"a file of content ends in one of {', '.join(KINDS)}: {path}")
    return found


def _bare(name: str):
    return F.nullif(F.regexp_replace(F.col(name), r"^\s+|\s+$", ""), F.lit(""))


def _content(rows: DataFrame, broken=None) -> DataFrame:
    """The common columns of rows with FIELDS; `broken` marks rows that could not be read."""
    url, text = _bare("url"), _bare("text")
    error = F.when(url.isNull() & text.isNull(), "neither url nor text")
    if broken is not None:
        error = F.when(broken, "no JSON object").otherwise(error)
    return rows.select(
        F.when(url.isNotNull(), "url").when(text.isNotNull(), "text").alias("input_type"),
        url.alias("url"),
        F.when(url.isNull(), text).alias("text"),
        _bare("title").alias("title"),
        _bare("source").alias("source"),
        "published",
        error.alias("error"),
    )


def read(spark: SparkSession, path: str, kind: str | None = None, stream: bool = False) -> DataFrame:
    """Rows of the files at a path; with `stream`, of a folder that files arrive in."""
    kind = kind or kind_of(path)
    reader = spark.readStream if stream else spark.read
    if kind == "csv":
        names = [f.split()[0] for f in FIELDS.split(", ")]
        if stream:  # a stream of CSV files has its columns in the order of FIELDS
            rows = reader.schema(FIELDS).option("header", True).option("multiLine", True).option("escape", '"').csv(path)
        else:
            raw = reader.option("header", True).option("multiLine", True).option("escape", '"').csv(path)
            have = {c.lower(): c for c in raw.columns}
            rows = raw.select(*((F.col(f"`{have[n]}`") if n in have else F.lit(None)).cast("timestamp" if n == "published" else "string").alias(n) for n in names))
        return _content(rows)
    lines = reader.text(path).withColumn("line", _bare("value")).where("line IS NOT NULL")
    if kind == "json":
        parsed = lines.select(F.from_json("line", FIELDS, {"mode": "PERMISSIVE"}).alias("j"), F.coalesce(F.expr("typeof(try_parse_json(line)) IS NOT NULL AND schema_of_variant(try_parse_json(line)) LIKE 'OBJECT%'"), F.lit(False)).alias("fine"))
        return _content(parsed.select("j.*", "fine"), ~F.col("fine"))
    own = lines.where("NOT startswith(line, '#')")
    is_url = F.col("line").startswith("http://") | F.col("line").startswith("https://")
    none = F.lit(None).cast("string")
    return _content(own.select(F.when(is_url, F.col("line")).alias("url"), F.when(~is_url, F.col("line")).alias("text"), none.alias("title"), none.alias("source"), F.lit(None).cast("timestamp").alias("published")))


def feed(spark: SparkSession, path: str, kind: str = "json") -> DataFrame:
    """A stream of feed items: link, title, source, published, snippet; a link counts once while it is within LATE of the newest.

    Items without a link or a time are dropped: nothing tells them from others.
    """
    rows = read(spark, path, kind, stream=True).where("url IS NOT NULL AND published IS NOT NULL")
    items = rows.select(F.col("url").alias("link"), "title", "source", "published", F.col("text").alias("snippet"))
    return items.withWatermark("published", LATE).dropDuplicatesWithinWatermark(["link"])


def write(scored: DataFrame, path: str, kind: str) -> None:
    """Verdicts as JSON lines, as CSV with a header, or as `id TAB verdict` lines; one file a task."""
    out = scored.write.mode("overwrite")
    if kind == "json":
        out.option("ignoreNullFields", False).json(path)
    elif kind == "csv":
        out.option("header", True).option("escape", '"').csv(path)
    elif kind == "tsv":
        scored.select(F.concat_ws("\t", *(F.coalesce(F.col(c).cast("string"), F.lit("")) for c in scored.columns))).write.mode("overwrite").text(path)
    else:
        raise ValueError(f"json, csv or tsv, not {kind}")
