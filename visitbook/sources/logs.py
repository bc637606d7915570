"""The audit log: daily text files in, a day-partitioned table out."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from visitbook.columns import compute_once
from visitbook.functions.fields import to_day
from visitbook.session import finished_folders, remove_folder, settle

# The text log's line format and character set.
LOG_CHARSET = "ISO-8859-1"
HEADER_PATTERN = r"^\d{4}-\d{2}-\d{2}\s*$"
EVENT_START = "Nouvelle evenement: "
EVENT_PATTERN = r"^Nouvelle evenement: (\d\d:\d\d:\d\d) ([^,]*), ([^,]*), (.*)$"

# Folders of a streamed log that are merged into one.
TIER = 10


def read_log_files(spark: SparkSession, path: str) -> DataFrame:
    """Parse daily log files; see `parse_log_lines`.

    The text reader hands over the bytes of each line untouched, so files stay
    splittable and the character set is applied per line.
    """
    lines = spark.read.text(path).select(
        F.col("_metadata.file_path").alias("file"),
        # Rows of one split are read in order, so within the first split of a file
        # the smallest number belongs to the file's first line.
        F.when(F.col("_metadata.file_block_start") == 0, F.monotonically_increasing_id()).alias("line_no"),
        F.decode(F.col("value").cast("binary"), LOG_CHARSET).alias("line"),
    )
    return parse_log_lines(lines)


def parse_log_lines(lines: DataFrame) -> DataFrame:
    """Events from raw lines (file, line_no, line): file, ts, user_type, action, details, line.

    `line_no` numbers the lines of a file's first block and is null beyond it. The first
    line of a file carries its day; every event line carries only a time. A line that is
    neither keeps its text and has no timestamp, so nothing is lost: only the header goes, and
    a later line that repeats its text stays, whatever the blocks. The headers, one row per
    file, are written to the shared folder, so the lines come from an exchange of their own and
    a very large file may be split.
    """
    # Dates and numbers aggregate by hashing, where the lines' text would be sorted.
    own_day = F.when(F.col("line").rlike(HEADER_PATTERN), F.rtrim("line").try_cast("date"))
    headers = settle(
        lines.where(F.col("line_no").isNotNull())
        .select("file", "line_no", own_day.alias("day"))
        .groupBy("file")
        .agg(F.min_by("day", "line_no").alias("day"), F.min("line_no").alias("header_no")),
        lines.sparkSession, "headers",
    )
    dated = lines.where(F.col("line") != "").join(headers, "file", "left")
    is_header = F.col("day").isNotNull() & (F.col("line_no") == F.col("header_no"))
    # Only the last of an event's parts may hold a comma, so one replacement cuts a line.
    cut = F.regexp_replace("line", EVENT_PATTERN + "(?s:.*)", "$1,$2,$3,$4")
    event = F.when(F.col("line").startswith(EVENT_START) & (cut != F.col("line")), F.split(cut, ",", 4))
    parts = compute_once(dated.where(~F.coalesce(is_header, F.lit(False))), {"_part": event})
    part = lambda i: F.col("_part")[i]
    return parts.select(
        "file",
        F.concat(F.col("day").cast("string"), F.lit(" "), part(0)).try_cast("timestamp").alias("ts"),
        part(1).alias("user_type"),
        part(2).alias("action"),
        part(3).alias("details"),
        "line",
    )


def write_log(events: DataFrame, path: str, ts: str = "timestamp", mode: str = "append") -> None:
    """Write events to the log table, one partition per day.

    The rebalance lets adaptive execution merge small days into few files and
    split a day that holds far more events than the others.
    """
    (
        events.withColumn("log_date", to_day(F.col(ts)))
        .hint("rebalance", "log_date")
        .write.mode(mode)
        .partitionBy("log_date")
        .parquet(path)
    )


def _spans(spark: SparkSession, path: str) -> list[tuple[int, int]]:
    """First and last trigger of every complete folder of a streamed log, covered ones too."""
    names = finished_folders(spark, path, "batch_id=")
    bounds = [tuple(int(n) for n in name.split("-")) for name in names]
    return sorted((b[0], b[-1]) for b in bounds)


def _folder(path: str, span: tuple[int, int]) -> str:
    return f"{path}/batch_id={span[0]}" + (f"-{span[1]}" if span[1] > span[0] else "")


def _uncovered(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """The folders that are read: those no other folder holds the triggers of."""
    return [s for s in spans if not any(t != s and t[0] <= s[0] and s[1] <= t[1] for t in spans)]


def read_log(spark: SparkSession, path: str) -> DataFrame:
    """The stored log, written in batch or by a stream, which keeps a folder per trigger or,
    once compacted, per run of triggers.
    """
    spans = _uncovered(_spans(spark, path))
    if not spans:
        return spark.read.parquet(path).drop("batch_id")
    return spark.read.option("basePath", path).parquet(*[_folder(path, s) for s in spans]).drop("batch_id")


def compact_log(spark: SparkSession, path: str, ts: str = "timestamp", tier: int = TIER) -> None:
    """Merge the folders of a streamed log, `tier` of about equal age at a time.

    An event is rewritten once per tier, and a day has at most tier - 1 folders of each, however
    many triggers there were. A merged folder counts once it is complete. What it covers stays
    for readers that have begun, and goes with the next compaction. The stream may go on meanwhile.
    """
    spans = _spans(spark, path)
    kept = _uncovered(spans)
    for span in set(spans) - set(kept):
        remove_folder(spark, _folder(path, span))

    def level(span: tuple[int, int]) -> int:
        size, n = span[1] - span[0] + 1, 0
        while size >= tier:
            size, n = size // tier, n + 1
        return n

    at = 0
    while at + tier <= len(kept):
        run = kept[at : at + tier]
        if len({level(s) for s in run}) > 1:
            at += 1
            continue
        merged = (run[0][0], run[-1][1])
        events = spark.read.option("basePath", path).parquet(*[_folder(path, s) for s in run])
        write_log(events.drop("batch_id", "log_date"), _folder(path, merged), ts, mode="overwrite")
        kept[at : at + tier] = [merged]
        at = max(0, at - tier + 1)


def on_day(log: DataFrame, day: str) -> DataFrame:
    """Events of one day: a partition filter, in place of truncating the log daily."""
    return log.where(F.col("log_date") == F.lit(day).cast("date"))
