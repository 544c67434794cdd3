"""Daily option bulletins: CP950 text in three layouts, plain or zipped, to raw rows and to the strategy view."""

from __future__ import annotations

import csv
import io
import struct
import time
import zipfile
import zlib
from collections.abc import Callable, Iterator
from functools import partial
from pathlib import Path

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strikeflow.functions import dates
from strikeflow.sources.shards import VIEW, check_columns

# The columns of the published files and their names here.
COLUMNS = {
    "交易日期": "date",
    "契約": "contract",
    "到期月份(週別)": "contract_month_week",
    "履約價": "strike",
    "買賣權": "option_type",
    "開盤價": "open",
    "最高價": "high",
    "最低價": "low",
    "收盤價": "close",
    "成交量": "volume",
    "結算價": "settle",
    "未沖銷契約數": "open_interest",
    "最後最佳買價": "bid",
    "最後最佳賣價": "ask",
    "歷史最高價": "historical_high",
    "歷史最低價": "historical_low",
    "是否因訊息面暫停交易": "halt_flag",
    "交易時段": "trading_session",
    "漲跌價": "change",
    "漲跌%": "change_pct",
    "契約到期日": "contract_date",
}
OPTION_TYPES = {"買權": "call", "賣權": "put"}
SESSIONS = {"一般": "regular", "盤後": "after_hours"}
_NAMES = list(COLUMNS.values())
VERSIONS = {"oldest": set(_NAMES[:18]), "change": set(_NAMES[:20]), "contract_date": set(_NAMES)}
WHOLE, TEXT = ("volume", "open_interest"), ("contract", "contract_month_week", "option_type", "trading_session", "halt_flag")
WIDTH = 23


def as_read(text: str) -> str:
    """CP950 text as it looks when its bytes are read as Latin-1. Spark's reader knows no CP950; only titles and two closed sets of values aren't ASCII."""
    return text.encode("cp950").decode("latin-1")


def decoded(header: list[str | None]) -> list[str]:
    return [h.encode("latin-1").decode("cp950") for h in header if h]


def version_of(header: list[str]) -> tuple[str, list[str]]:
    """The layout of a header line and its column names here; empty trailing fields don't count."""
    titles = [h.strip() for h in header if h and h.strip()]
    names = {COLUMNS.get(h, h) for h in titles}
    version = "contract_date" if "contract_date" in names else "change" if "change" in names else "oldest"
    missing, extra = VERSIONS[version] - names, names - VERSIONS[version]
    if missing or extra:
        raise ValueError(f"layout {version}: missing {sorted(missing)}, unknown {sorted(extra)}")
    return version, [COLUMNS[h] for h in titles]


def typed(fields: DataFrame, names: list[str]) -> DataFrame:
    """Columns f0, f1, ... of text to typed columns; - and blanks are null."""
    value = {n: F.nullif(F.nullif(F.trim(F.col(f"f{i}")), F.lit("-")), F.lit("")) for i, n in enumerate(names)}
    mapped = lambda c, m: F.try_element_at(F.create_map(*(F.lit(x) for k, v in m.items() for x in (as_read(k), v))), c)
    out = []
    for n in names:
        c = value[n]
        if n == "date":
            c = F.try_to_timestamp(c, F.lit("yyyy/MM/dd")).cast("date")
        elif n == "contract_date":
            c = dates.compact_date(c.try_cast("double"))
        elif n == "option_type":
            c = mapped(c, OPTION_TYPES)
        elif n == "trading_session":
            c = mapped(c, SESSIONS)
        elif n in WHOLE:
            c = c.try_cast("double").cast("bigint")
        elif n == "change_pct":
            c = F.replace(c, F.lit("%"), F.lit("")).try_cast("double")
        elif n not in TEXT:
            c = c.try_cast("double")
        out.append(c.alias(n))
    return fields.select(*out)


def parse(spark: SparkSession, path: str) -> DataFrame:
    """Raw rows of plain files of one layout."""
    schema = ", ".join(f"f{i} string" for i in range(WIDTH))
    fields = spark.read.schema(schema).option("encoding", "iso-8859-1").option("escape", "\u0000").option("mode", "PERMISSIVE").csv(path)
    title = as_read(next(iter(COLUMNS)))
    headers = fields.where(F.trim("f0") == title).distinct().limit(2).collect()
    if len(headers) != 1:
        first = fields.limit(1).collect()
        if not headers and first:
            version_of(decoded(list(first[0])))  # says what is wrong with it
        raise ValueError(f"{len(headers) or 'no'} layouts in one set of files")
    names = version_of(decoded(list(headers[0])))[1]
    return typed(fields.where(F.coalesce(F.trim("f0") != title, F.lit(True))), names)


MEMBERS = "archive string, member string, method int, crc long, size long, packed binary"
#: Bytes of a member that are inflated at once, and the rows that leave together.
CHUNK, ROWS = 1 << 20, 10_000


def members_of(content: bytes) -> Iterator[tuple[str, int, int, int, int, int]]:
    """(name, method, checksum, size, start, packed size) of an archive's CSV files, from its central directory and their local headers; nothing is inflated."""
    with zipfile.ZipFile(io.BytesIO(content)) as z:
        for info in sorted(z.infolist(), key=lambda i: i.filename):
            if info.filename.lower().endswith(".csv"):
                if info.flag_bits & 1 or info.compress_type not in (zipfile.ZIP_STORED, zipfile.ZIP_DEFLATED):
                    raise ValueError(f"{info.filename}: encrypted, or packed in another way")
                name, extra = struct.unpack("<HH", content[info.header_offset + 26 : info.header_offset + 30])
                yield info.filename, info.compress_type, info.CRC, info.file_size, info.header_offset + 30 + name + extra, info.compress_size


class Inflated(io.RawIOBase):
    """A member's bytes, inflated as they are read; its size and checksum are held against the directory at the end."""

    def __init__(self, member: str, method: int, crc: int, size: int, packed: bytes):
        self.member, self.crc, self.size, self.packed = member, crc, size, packed
        self.inflate = zlib.decompressobj(-15) if method == zipfile.ZIP_DEFLATED else None
        self.at = self.told = self.sum = 0

    def readable(self) -> bool:
        return True

    def readinto(self, to) -> int:
        out = b""
        while not out:
            if self.inflate is None:
                out = self.packed[self.at : self.at + min(len(to), CHUNK)]
                self.at += len(out)
            else:
                part = self.inflate.unconsumed_tail or self.packed[self.at : self.at + CHUNK]
                self.at += 0 if self.inflate.unconsumed_tail else len(part)
                out = self.inflate.decompress(part, len(to)) if not self.inflate.eof else b""
                if not part and not out:
                    break
            if not out and (self.inflate is None or self.inflate.eof):
                break
        self.told, self.sum = self.told + len(out), zlib.crc32(out, self.sum)
        if not out and (self.told != self.size or self.sum != self.crc):
            raise ValueError(f"{self.member}: damaged")
        to[: len(out)] = out
        return len(out)


def zip_members(spark: SparkSession, path: str) -> DataFrame:
    """A row for each CSV file of archives, still packed, each in a partition of its own.

    A first pass reads the directories only. The second slices the archives by the members' byte ranges and deals these out, so
    what inflating and parsing cost is spread over as many tasks as there are members, whatever archive they are in.
    """
    archives = spark.read.format("binaryFile").load(path).select("path", "content")

    def slices(batches: Iterator[pd.DataFrame], packed: bool) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for archive, content in zip(batch["path"], batch["content"], strict=True):
                for name, method, crc, size, start, length in members_of(content):
                    yield pd.DataFrame({"archive": [archive], "member": [name], "method": [method], "crc": [crc], "size": [size], "packed": [content[start : start + length] if packed else None]})

    n = archives.mapInPandas(partial(slices, packed=False), MEMBERS).count()
    return archives.mapInPandas(partial(slices, packed=True), MEMBERS).repartition(max(1, n))


def parse_zip(spark: SparkSession, path: str) -> DataFrame:
    """Raw rows of zipped files of one layout. Each member is a task; its lines leave in batches."""

    def lines(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        names = [f"f{i}" for i in range(WIDTH)]
        for batch in batches:
            for r in batch.itertuples(index=False):
                rows: list[list] = []
                for row in csv.reader(io.TextIOWrapper(io.BufferedReader(Inflated(r.member, r.method, r.crc, r.size, r.packed)), "latin-1", newline="")):
                    rows.append((row + [None] * WIDTH)[:WIDTH])
                    if len(rows) >= ROWS:
                        yield pd.DataFrame(rows, columns=names)
                        rows = []
                if rows:
                    yield pd.DataFrame(rows, columns=names)

    fields = zip_members(spark, path).mapInPandas(lines, ", ".join(f"f{i} string" for i in range(WIDTH)))
    title = as_read(next(iter(COLUMNS)))
    headers = fields.where(F.trim("f0") == title).distinct().limit(2).collect()
    if len(headers) != 1:
        raise ValueError(f"{len(headers)} layouts in one set of archives")
    return typed(fields.where(F.coalesce(F.trim("f0") != title, F.lit(True))), version_of(decoded(list(headers[0])))[1])


def strategy_view(raw: DataFrame, holidays: DataFrame | None = None, contract: str = "TXO", *, strict: bool = False) -> DataFrame:
    """Monthly options of the regular session, ten columns. Expiry is the contract date, or the third Wednesday moved past holidays.

    strict: raw rows without any of the contract, or without any of its monthly regular options, are refused; this runs a job.
    """
    month = F.trim("contract_month_week")
    is_own = F.col("contract") == contract
    monthly = (F.col("trading_session") == "regular") & month.rlike(r"^\d{6}$") & F.col("strike").isNotNull()
    own = raw.where(is_own & monthly)
    if strict:
        counted = raw.agg(F.count("*").alias("n"), F.count_if(is_own).alias("n_own"), F.count_if(is_own & monthly).alias("n_monthly")).first()
        for n, what in zip(counted, ("no rows", f"no rows of {contract}", f"no monthly regular rows of {contract}"), strict=True):
            if not n:
                raise ValueError(what)
    if "contract_date" in raw.columns:
        own = own.withColumn("expiry", F.col("contract_date"))
    else:
        own = own.withColumn("wed", dates.third_wednesday(F.to_date(F.concat(month, F.lit("01")), "yyyyMMdd")))
        own = dates.rolled(own, "wed", holidays) if holidays is not None else own.withColumn("expiry", F.col("wed"))
    out = own.select(*VIEW)
    check_columns(out, VIEW)
    return out


def fetch(get: Callable[[str, dict], bytes], target: str, url: str, form: dict, *, annual: bool = False, tries: int = 4, wait: float = 1.0) -> str:
    """A landing job's download: kept if it is there already, tried again after connection errors, refused if it can't be the file; appears whole or not at all."""
    to = Path(target)
    if to.exists():
        return "cached"
    for k in range(tries):
        try:
            body = get(url, form)
            break
        except (ConnectionError, TimeoutError):
            if k == tries - 1:
                raise
            time.sleep(wait * 2**k)
    if len(body) < 100 or annual and not body.startswith(b"PK"):
        raise ValueError("not a bulletin")
    part = to.with_suffix(".part")
    part.write_bytes(body)
    part.rename(to)
    return "fetched"


def backfill(spark: SparkSession, paths: list[str], raw_folder: str, view_folder: str, holidays: DataFrame | None = None) -> DataFrame:
    """Parses files and saves the dates that aren't saved yet, in both layers; (date, n) of what was added."""
    from strikeflow.sources import shards

    added = None
    for path in paths:
        raw = parse_zip(spark, path) if path.endswith(".zip") else parse(spark, path)
        try:
            # read in full before the folder is written to
            raw = shards.new_dates(raw, spark.createDataFrame(shards.dates(spark, raw_folder).collect(), "date date"))
        except Exception as e:  # the folder doesn't exist before the first file
            if "PATH_NOT_FOUND" not in str(e):
                raise
        if raw.isEmpty():
            continue
        rows = raw.groupBy("date").agg(F.count("*").alias("n")).collect()  # a row for each date of a file
        shards.save(raw, raw_folder)
        view = strategy_view(raw, holidays)
        if not view.isEmpty():
            shards.save(view, view_folder)
        part = spark.createDataFrame([(r["date"], r["n"]) for r in rows], "date date, n long")
        added = part if added is None else added.unionByName(part)
    return added if added is not None else spark.createDataFrame([], "date date, n long")


def write_report(df: DataFrame, path: str) -> None:
    """A small result table as one CSV file, with a header even if it has no rows."""
    df.toPandas().to_csv(path, index=False)


def spot(spark: SparkSession, path: str, start=None, end=None) -> DataFrame:
    """(date, underlying) of a CSV file with a header, its first column the date and close the value."""
    df = spark.read.option("header", True).csv(path)
    out = df.select(F.to_date(df.columns[0]).alias("date"), F.col("close").cast("double").alias("underlying"))
    return out.where(F.col("date").between(F.lit(str(start)).cast("date"), F.lit(str(end)).cast("date"))) if start else out
