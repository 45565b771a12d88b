"""Season CSV files: scan, checks, goals, manifest.

Files are grouped by their header and each group is read once. Columns are read by position
under an explicit all-string schema (one spare column catches over-long rows) and picked by
header name afterwards, so files with different column orders never mix.

Headers come from the first bytes of each file, not from a scan. The scan is written once, with every column that
counts, goals and the manifest need; rows are numbered by two-level sums (rows of each split, place in the split), so
a row's number and ``match_id`` are the same however Spark splits the files.
"""

from __future__ import annotations

import csv
import hashlib
import os
from collections import defaultdict
from collections.abc import Iterable, Iterator, Sequence
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass
from urllib.parse import quote, unquote

import pyarrow as pa
import pyarrow.fs
from pyspark.sql import Column, DataFrame, Observation, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from foretally.contracts import COMPETITION_CODE, COUNT_COLUMNS, FIXTURE_KEY, GOAL_COLUMNS
from foretally.functions.parsing import parse_count, parse_match_date, stripped
from foretally.operators import quality
from foretally.workspace import attach, settle, ship_package

_NO_NULL = "\u0001"  # cells stay strings: blank is '', only an absent cell is NULL
#: Bad rows that an error names; it gives the number of all.
_SHOWN = 20
#: Bytes of a file that are read for its header, more only if its first line is longer.
HEADER_BYTES = 1 << 16
_HEADER_THREADS = 16
#: Larger files are hashed in pieces of ``_HASH_BYTES`` instead of whole.
WHOLE_BYTES = 1 << 30
_HASH_BYTES = 8 << 20
_ROW_BITS = 40


@dataclass(frozen=True)
class LoadedLog:
    """Completed contests, bad rows with reasons, row-quality counts, and the written rows they all come from."""

    contests: DataFrame
    quarantine: DataFrame
    quality: DataFrame
    rows: DataFrame
    goal_quarantine: DataFrame | None = None


def _plain(path: Column | str) -> Column:
    """A path or name without percent escapes; a plus sign stays one."""
    return F.url_decode(F.replace(path, F.lit("+"), F.lit("%2B")))


def first_line(spark: SparkSession, path: str) -> str | None:
    """The first line of a file that any of Spark's stores holds, None if the file is empty."""
    jvm, conf = spark._jvm, spark._jsc.hadoopConfiguration()
    target = jvm.org.apache.hadoop.fs.Path(path)
    stream = target.getFileSystem(conf).open(target)
    codec = jvm.org.apache.hadoop.io.compress.CompressionCodecFactory(conf).getCodec(target)
    if codec is not None:
        stream = codec.createInputStream(stream)
    try:
        held = b""
        while not held or (b"\n" not in held and b"\r" not in held):
            piece = bytes(stream.readNBytes(HEADER_BYTES))
            if not piece:
                break
            held += piece
    finally:
        stream.close()
    return held.decode("utf-8-sig", "replace").splitlines()[0] if held else None


def headers_of(spark: SparkSession, paths: Sequence[str]) -> dict[str, tuple[str, ...]]:
    """Column names of every file that isn't empty, by its path: one ranged read for each file."""
    files = [unquote(file) for file in spark.read.text(list(paths)).inputFiles()]  # as the paths of rows are
    with ThreadPoolExecutor(_HEADER_THREADS) as pool:
        lines = pool.map(lambda path: first_line(spark, path), files)
    return {path: tuple(next(csv.reader([line]), [])) for path, line in zip(files, lines) if line is not None}


def _bare(path: str) -> str:
    """A path without the scheme of local files, to match given paths with Spark's."""
    return "/" + path.removeprefix("file:").lstrip("/")


def scan(spark: SparkSession, paths: Iterable[str], wanted: Sequence[str], multi_line: bool = False) -> DataFrame:
    """Rows of all files with the wanted columns as strings, plus the file, the split and the place they came from.

    ``at`` rises by one from row to row of a split; it holds for a written result only.
    """
    paths = [str(p) if "://" in str(p) or str(p).startswith("file:") else os.path.abspath(p) for p in paths]
    if not paths:
        raise ValueError("no season files given")
    headers = headers_of(spark, paths)
    found = {_bare(path) for path in headers}
    for path in paths:
        if _bare(path) not in found and not any(f.startswith(_bare(path).rstrip("/") + "/") for f in found):
            raise ValueError(f"{path} is missing required columns: {', '.join(sorted(set(wanted)))}")
    groups: dict[tuple[str, ...], list[str]] = defaultdict(list)
    for path, header in sorted(headers.items()):
        missing = sorted(set(wanted) - set(header))
        if missing:
            raise ValueError(f"{path} is missing required columns: {', '.join(missing)}")
        groups[header].append(path)
    parts = [_scan_group(spark, header, files, wanted, multi_line) for header, files in groups.items()]
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out.withColumn("at", F.monotonically_increasing_id())


def _scan_group(spark, header, files, wanted, multi_line) -> DataFrame:
    schema = T.StructType([T.StructField(f"c{i}", T.StringType()) for i in range(len(header) + 1)])
    rows = (
        spark.read.schema(schema)
        .option("header", True)
        .option("enforceSchema", True)
        .option("nullValue", _NO_NULL)
        .option("emptyValue", "")
        .option("multiLine", multi_line)
        .csv(files)
    )
    last = {name: i for i, name in enumerate(header)}  # a repeated name means its last column
    return rows.select(
        *[F.col(f"c{last[name]}").alias(name) for name in wanted],
        F.col(f"c{len(header)}").isNotNull().alias("over_long"),
        _plain("_metadata.file_path").alias("file_path"),
        _plain("_metadata.file_name").alias("file_name"),
        F.col("_metadata.file_block_start").alias("block_start"),
    )


def located(rows: DataFrame) -> DataFrame:
    """Written rows of a scan with their number in the file (the header is row 1) and a stable ``match_id``.

    Files are numbered in order of their paths; what is shuffled is a row for each split.
    """
    splits = rows.groupBy("file_path", "block_start").agg(F.min("at").alias("first_at"), F.count(F.lit(1)).alias("n"))
    before = Window.partitionBy("file_path").orderBy("block_start").rowsBetween(Window.unboundedPreceding, -1)
    placed = splits.select(
        "file_path", "block_start", "first_at", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("earlier"),
        F.dense_rank().over(Window.orderBy("file_path")).alias("file_no"),  # one row a split
    )
    placed = settle(placed, "splits")
    joined = attach(rows, placed, ["file_path", "block_start"], placed.count())
    numbered = joined.withColumn("row", (F.col("earlier") + F.col("at") - F.col("first_at") + 2).cast("long"))
    match_id = F.shiftleft(F.col("file_no").cast("long"), _ROW_BITS) + F.col("row")
    return numbered.withColumn("match_id", match_id).drop("at", "block_start", "first_at", "earlier", "file_no")


def _named(bad: DataFrame, n: int, faults: str = "faults") -> str:
    """'file row N: reason' for the first bad rows and how many more there are."""
    shown = bad.orderBy("file_name", "row").limit(_SHOWN).collect()
    lines = [f"{row.file_name} row {row.row}: {'; '.join(row[faults])}" for row in shown]
    return "\n".join([*lines, *([f"and {n - len(lines)} more rows"] if n > len(lines) else [])])


def _goal_faults(competition: str) -> Column:
    return F.array_compact(
        F.array(
            F.when(F.col("over_long") | ~F.col("Div").eqNullSafe(competition), F.lit("malformed or foreign fixture")),
            F.when(F.col("match_date").isNull(), F.lit("unsupported match date")),
            F.when(F.col("home_goals").isNull() | F.col("away_goals").isNull(), F.lit("invalid goal result")),
        )
    )


def season_rows(
    spark: SparkSession, paths: Iterable[str], multi_line: bool = False, competition: str | None = None
) -> tuple[DataFrame, dict[str, int]]:
    """All rows of the files, judged, numbered and written once; and how many are bad, counted by that write.

    With a ``competition`` goals are read and judged too, in ``goal_faults``.
    """
    wanted = COUNT_COLUMNS if competition is None else list(dict.fromkeys([*COUNT_COLUMNS, *GOAL_COLUMNS]))
    rows = quality.judged(scan(spark, paths, wanted, multi_line))
    if competition is not None:
        rows = rows.withColumns({"home_goals": parse_count("FTHG"), "away_goals": parse_count("FTAG"), "season": season_label()})
        rows = rows.withColumn("goal_faults", _goal_faults(competition))
    tests = {"bad": F.col("status") == "quarantined"} | ({} if competition is None else {"bad_goals": F.size("goal_faults") > 0})
    seen = Observation()
    counted = rows.observe(seen, *[F.count_if(test).alias(name) for name, test in tests.items()])
    written = settle(counted, "season-rows", even=True)
    return located(written), {name: value or 0 for name, value in seen.get.items()}


def _loaded(rows: DataFrame, goal_quarantine: DataFrame | None = None) -> LoadedLog:
    # goals reach the contests through their own join
    own = rows.drop("home_goals", "away_goals", "season")
    return LoadedLog(quality.contests_from(own), quality.quarantine(rows), quality.row_quality(rows, ("file_path",)), rows, goal_quarantine)


def load_contests(
    spark: SparkSession, paths: Iterable[str], strict: bool = True, multi_line: bool = False
) -> LoadedLog:
    """Completed contests of the season files.

    ``multi_line`` allows line breaks inside quoted cells; such files are not split. With ``strict`` a malformed completed row raises and names its file and row; without it
    such rows are set aside in ``quarantine``. Rows without a result are counted and dropped.
    """
    rows, bad = season_rows(spark, paths, multi_line)
    loaded = _loaded(rows)
    if strict and bad["bad"]:
        raise ValueError(_named(loaded.quarantine, bad["bad"]))
    return loaded


def season_label(file_name_col: str = "file_name"):
    """File stem without the competition prefix; never derived from the date."""
    stem = F.regexp_replace(file_name_col, r"\.[^.]*$", "")
    return F.regexp_replace(stem, r"^E1_", "")


def load_goals(
    spark: SparkSession,
    paths: Iterable[str],
    competition: str = COMPETITION_CODE,
    multi_line: bool = False,
    strict: bool = True,
) -> tuple[DataFrame, LoadedLog, DataFrame]:
    """Goals joined onto the completed contests.

    Returns (goal contests, the contest load, source rows without a completed contest). With ``strict`` a row
    of another competition, an over-long row, an invalid goal cell or a repeated fixture raises. Without it bad rows
    are set aside in ``quarantine`` and ``goal_quarantine``, and of a repeated fixture the first row stays.
    """
    rows, bad = season_rows(spark, [str(p) for p in paths], multi_line, competition)
    bad_goals = rows.filter(F.size("goal_faults") > 0)
    loaded = _loaded(rows, bad_goals)
    if strict and bad["bad"]:
        raise ValueError(_named(loaded.quarantine, bad["bad"]))
    if strict and bad["bad_goals"]:
        raise ValueError(_named(bad_goals, bad["bad_goals"], "goal_faults"))
    goals = rows.filter(F.size("goal_faults") == 0).select("match_id", *FIXTURE_KEY, "home_goals", "away_goals", "season")
    if strict:
        quality.require_unique_fixtures(goals)
    else:
        goals = quality.unique_fixtures(goals)
        loaded = LoadedLog(quality.unique_fixtures(loaded.contests), loaded.quarantine, loaded.quality, rows, bad_goals)
    joined = settle(quality.joined_goals(goals, loaded.contests), "joined-goals")
    return quality.matched(joined), loaded, quality.unmatched(joined)


def _streamed_sha256(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Hashes of files read piece by piece, from any store that pyarrow opens."""
    for batch in batches:
        digests = []
        for path in batch.column("file_path").to_pylist():
            if path.startswith(("file:", "/")):
                store, inner = pyarrow.fs.LocalFileSystem(), _bare(path)
            else:
                store, inner = pyarrow.fs.FileSystem.from_uri(quote(path, safe=":/"))
            digest = hashlib.sha256()
            with store.open_input_stream(inner, compression=None) as stream:
                while piece := stream.read(_HASH_BYTES):
                    digest.update(piece)
            digests.append(digest.hexdigest())
        yield pa.RecordBatch.from_arrays([batch.column("file_path"), pa.array(digests, pa.string())], ["file_path", "sha256"])


def file_hashes(spark: SparkSession, paths: Sequence[str], whole_bytes: int = WHOLE_BYTES) -> DataFrame:
    """(file_path, file_name, bytes, sha256) of every file, of any size.

    Files up to ``whole_bytes`` are hashed by an expression over their content; a larger one is read in pieces by a
    task of its own, so its size costs no memory.
    """
    path = _plain(F.col("_metadata.file_path"))
    files = spark.read.format("binaryFile").load([str(p) for p in paths])
    named = files.select(path.alias("file_path"), F.element_at(F.split(path, "/"), -1).alias("file_name"), F.col("length").alias("bytes"), "content")
    small = named.where(F.col("bytes") <= whole_bytes).select("file_path", "file_name", "bytes", F.sha2("content", 256).alias("sha256"))
    large = settle(named.where(F.col("bytes") > whole_bytes).select("file_path", "file_name", "bytes"), "large-files")
    n_large = large.count()
    if not n_large:
        return small
    ship_package(spark)
    digests = large.select("file_path").repartition(n_large).mapInArrow(_streamed_sha256, "file_path string, sha256 string")
    return small.unionByName(large.join(digests, "file_path"))


def file_manifest(
    spark: SparkSession, paths: Iterable[str], multi_line: bool = False, rows: DataFrame | None = None, whole_bytes: int = WHOLE_BYTES
) -> DataFrame:
    """Per file, by its full path: name, bytes, SHA-256, rows, first and last date, number of teams.

    ``rows`` may give the files' written rows (``LoadedLog.rows``), which spares the scan.
    """
    paths = [str(p) for p in paths]
    if rows is None:
        sides = [stripped(name).alias(kept) for name, kept in (("HomeTeam", "home_team"), ("AwayTeam", "away_team"))]
        rows = scan(spark, paths, GOAL_COLUMNS, multi_line).select("file_path", parse_match_date("Date").alias("match_date"), *sides)
        rows = settle(rows, "manifest-rows")
    counts = rows.groupBy("file_path").agg(
        F.count(F.lit(1)).alias("rows"), F.min("match_date").alias("first_date"), F.max("match_date").alias("last_date")
    )
    teams = rows.select("file_path", F.explode(F.array("home_team", "away_team")).alias("team")).distinct()
    teams = teams.groupBy("file_path").agg(F.count("team").alias("teams"))
    return file_hashes(spark, paths, whole_bytes).join(counts, "file_path", "left").join(teams, "file_path", "left")
