"""Sources and sinks: raw logs as canonical activity, CSV, archives, results."""

from __future__ import annotations

import csv
import io
import os
import tarfile
import zipfile
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def read_csv(spark: SparkSession, path: str, schema: StructType | str, missing: tuple[str, ...] = ()) -> DataFrame:
    """CSV with a header and a given schema; string columns are trimmed and ``missing`` values become null."""
    df = spark.read.schema(schema).option("header", True).csv(path)
    for name, kind in df.dtypes:
        if kind == "string":
            value = F.trim(name)
            df = df.withColumn(name, F.when(~F.lower(value).isin(*missing), value) if missing else value)
    return df


def _tar_lines(lines: Iterator[bytes]) -> Iterator[tuple[str, bytes]]:
    """(member, line) of an unpacked tar stream that was split after each newline, without holding a member."""
    name, left, pad, rest, last = None, 0, 0, b"", b""

    def part(data: bytes) -> Iterator[tuple[str, bytes]]:
        nonlocal left, rest, last
        own, rest = data[:left], data[left:]
        left -= len(own)
        last += own
        if last.endswith(b"\n") or not left:
            if last:
                yield name, last.rstrip(b"\r\n")
            last = b""

    for line in lines:
        if left:
            yield from part(line)
            if left or not rest:
                continue
        else:
            rest += line
        while not left and len(rest) >= pad + tarfile.BLOCKSIZE:
            block, rest, pad = rest[pad : pad + tarfile.BLOCKSIZE], rest[pad + tarfile.BLOCKSIZE :], 0
            if not block.strip(b"\0"):
                continue
            head = tarfile.TarInfo.frombuf(block, "utf-8", "strict")
            name, left = (os.path.basename(head.name) if head.isfile() else ""), head.size
            pad = -head.size % tarfile.BLOCKSIZE
            if left:
                yield from part(rest)
    if left:
        raise ValueError(f"{name} ends early")


def read_archive(spark: SparkSession, path: str, members: tuple[str, ...], needed: tuple[str, ...] = ()) -> DataFrame:
    """archive_no, member, line_no and line of the chosen members of one tar.gz or zip archive, in archive order.

    A gzipped tar is read as a stream of lines by one task, which holds a line at a time and stops after the last of the
    members; it cannot be split. Of a zip the task holds the packed bytes (2 GB at most), and reads the members' lines
    one after the other. All members, and those ``needed``, must be there."""
    wanted = set(members)
    schema = "archive_no int, member string, line_no bigint, line string"

    def numbered(found: Iterator[tuple[int, str, bytes]], size: int = 20_000) -> Iterator[pd.DataFrame]:
        count: dict[str, int] = {}
        rows: list[tuple] = []
        for no, member, line in found:
            count[member] = count.get(member, -1) + 1
            rows.append((no, member, count[member], line.decode("utf-8")))
            if len(rows) == size:
                yield pd.DataFrame(rows, columns=["archive_no", "member", "line_no", "line"])
                rows = []
        yield pd.DataFrame(rows, columns=["archive_no", "member", "line_no", "line"])

    def absent(seen: set[str]) -> None:
        if lost := sorted(wanted.union(needed) - seen):
            raise ValueError(f"{path} lacks {', '.join(lost)}")

    def tar(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        def found() -> Iterator[tuple[int, str, bytes]]:
            seen: list[str] = []
            for member, line in _tar_lines(v.encode("utf-8") + b"\n" for b in batches for v in b["value"]):
                if not seen or member != seen[-1]:
                    if seen and wanted.union(needed) <= set(seen):
                        return
                    seen.append(member)
                if member in wanted:
                    yield len(seen) - 1, member, line
            if seen:
                absent(set(seen))

        yield from numbered(found())

    def packed(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for content in batch["content"]:
                with zipfile.ZipFile(io.BytesIO(content)) as z:
                    names = [os.path.basename(m) for m in z.namelist()]
                    absent(set(names))
                    chosen = [(i, n, m) for i, (n, m) in enumerate(zip(names, z.namelist())) if n in wanted]
                    yield from numbered((i, n, line.rstrip(b"\r\n")) for i, n, m in chosen for line in z.open(m))

    if path.endswith(".zip"):
        return spark.read.format("binaryFile").load(path).select("content").mapInPandas(packed, schema)
    return spark.read.option("lineSep", "\n").text(path).select("value").mapInPandas(tar, schema)


def read_archive_csv(spark: SparkSession, path: str, members: tuple[str, ...], columns: tuple[str, ...], needed: tuple[str, ...] = ()) -> DataFrame:
    """archive_no, member, line_no and the named columns, as trimmed text, of members that are CSV with a header.

    Values do not hold line breaks; quoted values may hold commas and doubled quotes."""
    lines = read_archive(spark, path, members, needed)
    # the header is found in any row's batch, since a member's lines come in order from one task
    names = ["archive_no", "member", "line_no", *columns]

    def parse(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        at: dict[str, list[int]] = {}
        for batch in batches:
            rows = []
            for no, member, line_no, values in zip(batch["archive_no"], batch["member"], batch["line_no"], csv.reader(batch["line"])):
                if line_no == 0:
                    header = [v.strip().lstrip("\ufeff") for v in values]
                    at[member] = [header.index(c) for c in columns]
                elif values:
                    rows.append((no, member, line_no, *(values[i].strip() for i in at[member])))
            yield pd.DataFrame(rows, columns=names)

    return lines.mapInPandas(parse, "archive_no int, member string, line_no bigint, " + ", ".join(f"`{c}` string" for c in columns))


def write_csv(df: DataFrame, path: str, mark: bool = False) -> None:
    """CSV with a header in one folder. mark: each file begins with a byte order mark, for spreadsheets."""
    if not mark:
        df.write.mode("overwrite").option("header", True).csv(path)
        return
    first, *rest = (F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in df.columns)
    named = df.select(first.alias("\ufeff" + df.columns[0]), *rest)
    named.write.mode("overwrite").option("header", True).option("emptyValue", "").csv(path)


def materialised(spark: SparkSession, path: str, make) -> DataFrame:
    """The table at the path; made, written and marked as whole first, if it is not there yet."""
    file = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/_SUCCESS")
    if not file.getFileSystem(spark._jsc.hadoopConfiguration()).exists(file):
        make().write.mode("overwrite").parquet(path)
    return spark.read.parquet(path)


def split_path(folder: str, seed: int) -> str:
    """Where the splits of a seed are kept: the partition of the table of all seeds."""
    return f"{folder}/splits/seed={seed}"


def feature_path(folder: str, name: str, seed: int) -> str:
    """Where the features (x59, x55) of a seed are kept."""
    return f"{folder}/{name}/seed={seed}"


def append_results(df: DataFrame, path: str) -> None:
    """Adds result rows, with doubles rounded to 6 decimals; run_seq orders repeated runs."""
    df.select(*(F.round(c, 6).alias(c) if k == "double" else F.col(c) for c, k in df.dtypes)).write.mode("append").parquet(path)


def write_predictions(df: DataFrame, path: str) -> None:
    """Predictions (model, seed, split, enroll_id, label, prob) with 8 decimals, one folder per model and seed."""
    df.withColumn("prob", F.round("prob", 8)).write.mode("overwrite").partitionBy("model", "seed").parquet(path)


def events_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Activity of the unweighted log: event_id, enroll_id, user_id, course_id, action, object_id, event_date, clicks."""
    k = F.get_json_object("props", "$.k").cast("bigint")
    return read_table(spark, sf_dir, "events").select(
        "event_id", (F.col("user_id") * 10 + k % 10).alias("enroll_id"), "user_id", (k % 10).alias("course_id"),
        F.col("event_type").alias("action"), k.cast("string").alias("object_id"), F.to_date("ts").alias("event_date"), F.lit(1).cast("bigint").alias("clicks"),
    )


def orders_log(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """(clicks, enrollments) of the weighted log."""
    o = read_table(spark, sf_dir, "orders").select(
        F.col("o_orderkey").alias("enroll_id"), F.col("o_custkey").alias("user_id"), F.col("o_orderpriority").alias("course_id"),
        (F.col("o_orderstatus") == "F").cast("int").alias("label"),
    )
    li = read_table(spark, sf_dir, "lineitem").select(
        F.col("l_orderkey").alias("enroll_id"), F.concat("l_returnflag", "l_linestatus").alias("action"), F.col("l_partkey").cast("string").alias("object_id"),
        (F.datediff(F.to_date("l_shipdate"), F.lit("1995-01-01").cast("date")) % 70).alias("d"), F.col("l_quantity").cast("bigint").alias("clicks"),
    )
    return li, o
