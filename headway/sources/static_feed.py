"""Schedule archives: ZIP files to typed tables.

A task only unpacks: it opens an archive once and hands on the lines of its members, put together where
a quoted value holds a line end. They are landed as a table; from there Spark's CSV parser reads
them, each by the header of its own file, and types, checks and everything later are Spark expressions.
"""

from __future__ import annotations

import csv
import io
import zipfile
from collections.abc import Iterator, Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from headway import schemas
from headway.operators import schedule
from headway.session import materialise

RECORDS_PER_BATCH = 20_000
RECORD_SCHEMA = "feed_name string, table_name string, layout string, record string"
NO_OTHERS = "map_from_arrays(cast(array() AS array<string>), cast(array() AS array<string>))"


def archives(spark: SparkSession, path: str, feed_name: Column | None = None) -> DataFrame:
    """(feed_name, content) of ZIP files; by default a feed is named after its file."""
    files = spark.read.format("binaryFile").load(path)
    by_file = F.regexp_extract("path", r"([^/]+)\.zip$", 1)
    return files.select((by_file if feed_name is None else feed_name).alias("feed_name"),
                        "path", "content")


def _records(lines: Iterator[str]) -> Iterator[str]:
    """Lines without their ends; a line that leaves a quote open continues with the next one. Empty lines go."""
    held = ""
    for line in lines:
        held += line
        if held.count('"') % 2 == 0:
            record, held = held.rstrip("\r\n"), ""
            if record:
                yield record
    if held.rstrip("\r\n"):
        yield held.rstrip("\r\n")


def _unpacker(wanted: frozenset[str]):
    names = ["feed_name", "table_name", "layout", "record"]

    def rows(feed: str, content: bytes) -> Iterator[tuple]:
        with zipfile.ZipFile(io.BytesIO(content)) as archive:
            for name in archive.namelist():
                if not name.endswith(".txt"):
                    continue
                table, header = name[:-4], None
                if table in wanted:
                    with archive.open(name) as member:
                        for record in _records(io.TextIOWrapper(member, "utf-8-sig", newline="")):
                            if header is None:
                                header = record
                            else:
                                yield feed, table, header, record
                yield feed, table, header, None  # Tells that the archive brings the table.

    def unpack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for feed, content in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                held = []
                for row in rows(feed, content):
                    held.append(row)
                    if len(held) == RECORDS_PER_BATCH:
                        yield pa.RecordBatch.from_arrays([pa.array(c, pa.string()) for c in zip(*held)], names=names)
                        held = []
                if held:
                    yield pa.RecordBatch.from_arrays([pa.array(c, pa.string()) for c in zip(*held)], names=names)

    return unpack


def unpacked(archive_rows: DataFrame, tables: Sequence[str] | None = None) -> DataFrame:
    """All members of the archives, landed once: a row per record of the wanted tables with the header of
    its file, and for every member one row without a record."""
    wanted = frozenset(tables or schemas.STATIC_TABLES)
    rows = archive_rows.select("feed_name", "content").mapInArrow(_unpacker(wanted), RECORD_SCHEMA)
    return materialise(rows, "unpacked", ("table_name",))


def members(archive_rows: DataFrame) -> DataFrame:
    """(feed_name, table_name) of every text member."""
    return brought(archive_rows.select("feed_name", "content").mapInArrow(_unpacker(frozenset()), RECORD_SCHEMA))


def brought(opened: DataFrame) -> DataFrame:
    return opened.where("record IS NULL").select("feed_name", "table_name")


def records(archive_rows: DataFrame, tables: Sequence[str] | None = None) -> DataFrame:
    """(feed_name, table_name, layout, record): each CSV record as it came, with the header of its file.

    A wanted table that an archive lacks simply has no rows (see ``missing``).
    """
    return unpacked(archive_rows, tables).where("record IS NOT NULL")


def _parsed(layout: str, known: Sequence[str]) -> Column:
    """A record of one layout: the known columns by name, null where the file lacks them, and a map of the others."""
    header = [name.strip() for name in next(csv.reader(io.StringIO(layout, newline="")))]
    at = {name: k for k, name in reversed(list(enumerate(header)))}
    raw = F.from_csv("record", ", ".join(f"c{k} string" for k in range(len(header))), {"escape": '"'})
    others = [name for name in at if name not in known]

    def row(values: Column) -> Column:
        columns = [values[f"c{at[n]}"] if n in at else F.lit(None).cast("string") for n in known]
        rest = F.map_from_arrays(F.array(*[F.lit(n) for n in others]), F.array(*[values[f"c{at[n]}"] for n in others])) \
            if others else F.expr(NO_OTHERS)
        return F.struct(*[c.alias(n) for c, n in zip(columns, known)], rest.alias("_other"))

    return F.transform(F.array(raw), row)[0]  # Bound once, so that a record is parsed once.


def typed(record_rows: DataFrame, table: str) -> DataFrame:
    """One schedule table of all feeds, typed, with ``_feed_name`` and ``_cast_errors``.

    Header names are trimmed, a byte-order mark is skipped, empty values are null. Members outside the
    canonical columns stay available as a map; a table without canonical columns has only that.
    """
    known = schemas.STATIC_TABLES.get(table, schemas.struct()).fieldNames()
    own = record_rows.where((F.col("table_name") == table) & F.col("record").isNotNull())
    layouts = [r.layout for r in own.select("layout").distinct().collect()]  # One row per distinct header.
    row = F.expr(f"cast(null AS struct<{', '.join(f'{n}: string' for n in known) + ', ' * bool(known)}"
                 "_other: map<string, string>>)")
    for layout in sorted(layouts):
        row = F.when(F.col("layout") == layout, _parsed(layout, known)).otherwise(row)
    text = own.select(F.col("feed_name").alias("_feed_name"), row.alias("_r")).select(
        "_feed_name", *[F.col("_r")[n].alias(n) for n in known], F.col("_r")["_other"].alias("_other"))
    return schedule.canonical_types(text, table)


def landed_records(spark: SparkSession, folder: str, ingestion_date: str) -> DataFrame:
    """Records landed for one date; only that date's folders are read."""
    landed = spark.read.schema(RECORD_SCHEMA + ", ds string").parquet(folder)
    return landed.where(F.col("ds") == ingestion_date).drop("ds")


def missing(archive_rows: DataFrame, tables: Sequence[str]) -> DataFrame:
    """(feed_name, table_name) of wanted tables that an archive does not bring."""
    wanted = archive_rows.select("feed_name", F.explode(F.array(*[F.lit(t) for t in tables]))
                                 .alias("table_name"))
    return schedule.missing_tables(wanted, members(archive_rows))


def from_disk(spark: SparkSession, path: str, tables: Sequence[str] | None = None
              ) -> dict[str, DataFrame]:
    """Typed tables of the archives below a path."""
    wanted = tuple(tables) if tables else tuple(schemas.STATIC_TABLES)
    rows = records(archives(spark, path), wanted)
    return {table: typed(rows, table) for table in wanted}


def landed_csv(spark: SparkSession, path: str, table: str) -> DataFrame:
    """A landed CSV table, read by header name as text and then typed (no inference)."""
    raw = spark.read.option("header", True).csv(path)
    raw = raw.toDF(*[c.strip() for c in raw.columns])
    return schedule.canonical_types(raw, table)
