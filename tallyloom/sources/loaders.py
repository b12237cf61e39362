"""Loaders of the two public activity logs in their own formats, as one table of events.

Both return (events, labels). events: node_id, enroll_id, user_id, course_id, label, action, object_id, d and, in the
weighted log, clicks; an enrollment without any kept event has one row without action. A row that should have a partner
in another table and has none makes the job fail, whichever columns are read: the check is a filter over the joined rows,
which costs no pass and is never pruned. Of rows with one key the last counts, in the order of their file."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.ranking import position
from ..operators import activity as A
from ..spec import MOOC, VLE
from .tables import read_archive_csv

#: Member files, in the order in which their rows count, and columns.
MOOC_LOGS, MOOC_TRUTHS = ("train_log.csv", "test_log.csv"), ("train_truth.csv", "test_truth.csv")
LOG_COLUMNS = ("enroll_id", "username", "course_id", "action", "object", "time")
VLE_MEMBERS = (
    "courses.csv", "assessments.csv", "vle.csv", "studentInfo.csv", "studentRegistration.csv", "studentAssessment.csv", "studentVle.csv",
)
WITHDRAWN = "Withdrawn"
#: Enrollments that meet in one task with their log rows: joins and sums by enrollment there hold some 10 KB each.
TASK_ENROLLMENTS = 20_000


def mooc(logs: DataFrame, truths: DataFrame, courses: DataFrame) -> tuple[DataFrame, DataFrame]:
    """logs: LOG_COLUMNS as text and seq, the order of the rows; truths: enroll_id, truth, seq; courses: course_id, start, seq.

    The last truth and the last course row count; an enrollment's user and course are those of its first log row."""
    truth = truths.groupBy(F.col("enroll_id").cast("bigint").alias("enroll_id")).agg(F.max_by(F.col("truth").cast("int"), "seq").alias("label"))
    raw = logs.select(F.col("enroll_id").cast("bigint").alias("enroll_id"), F.col("username").cast("bigint").alias("user_id"), "course_id", "action", "object", "time", "seq")
    first = raw.groupBy("enroll_id").agg(F.min_by(F.struct("user_id", "course_id"), "seq").alias("f"))
    labels = A.demanded(truth.join(first, "enroll_id", "left"), "f", "enrollment ", F.col("enroll_id"), " has a label but no log row")
    labels = labels.select("enroll_id", F.col("f.user_id").alias("user_id"), F.col("f.course_id").alias("course_id"), "label")
    nodes = A.nodes(labels)
    # by their number and not by bytes, of which a task gets the more the larger the log is
    tasks = -(-nodes.count() // TASK_ENROLLMENTS) or 1
    nodes = nodes.repartition(tasks, "enroll_id")
    start = courses.groupBy("course_id").agg(F.max_by("start", "seq").alias("start"))
    own = raw.where(F.col("action").isin(*MOOC.actions)).repartition(tasks, "enroll_id").join(nodes.select("enroll_id", "node_id", "label"), "enroll_id")
    day = F.datediff(F.to_date(F.substring("time", 1, 10)), F.to_date(F.substring("start", 1, 10)))
    events = A.demanded(own.join(start, "course_id", "left"), "start", "no start of course ", F.col("course_id"))
    events = events.withColumn("d", day).where(A.in_window(MOOC))
    events = events.select("node_id", "enroll_id", "user_id", "course_id", "label", "action", F.trim("object").alias("object_id"), "d")
    return A.padded(events, nodes), nodes


def read_mooc(spark: SparkSession, folder: str) -> tuple[DataFrame, DataFrame]:
    """From prediction_data.tar.gz and course_info.csv in the folder."""
    rows = lambda members, columns: read_archive_csv(spark, f"{folder}/prediction_data.tar.gz", members, columns).withColumn("seq", F.struct("archive_no", "line_no"))
    # numbers grow along a part of a file, parts along the file
    seq = F.struct(F.col("_metadata.file_path"), F.col("_metadata.file_block_start"), F.monotonically_increasing_id())
    courses = spark.read.option("header", True).csv(f"{folder}/course_info.csv").select("course_id", "start", seq.alias("seq"))
    return mooc(rows(MOOC_LOGS, LOG_COLUMNS), rows(MOOC_TRUTHS, ("enroll_id", "truth")), courses)


def vle(info: DataFrame, sites: DataFrame, clicks: DataFrame) -> tuple[DataFrame, DataFrame]:
    """info: code_module, code_presentation, id_student, final_result; sites: id_site, activity_type and seq, the order of
    the rows; clicks: the three keys, id_site, date, sum_click. All others as text, "?" and "" as null.

    Enrollments are numbered by their key, since a table has no order of rows; a repeated key fails."""
    key = ["code_module", "code_presentation", "id_student"]
    one = info.groupBy(*key).agg(F.count(F.lit(1)).alias("n"), F.first("final_result").alias("final_result"))
    one = A.demanded(one.withColumn("n", F.when(F.col("n") == 1, F.col("n"))), "n", "two rows of ", F.concat_ws(" ", *key))
    numbered = position(one.withColumn("student", F.col("id_student").cast("bigint")), [], ["code_module", "code_presentation", "student"])
    labels = numbered.select(
        (F.col("pos") - 1).alias("enroll_id"), (F.col("pos") - 1).alias("node_id"), F.col("student").alias("user_id"),
        F.concat_ws("_", "code_module", "code_presentation").alias("course_id"),
        F.coalesce(F.col("final_result") == WITHDRAWN, F.lit(False)).cast("int").alias("label"), *key,
    )
    early = clicks.withColumn("d", F.col("date").cast("int")).where(A.in_window(VLE))
    known = A.demanded(early.join(labels, key, "left"), "enroll_id", "clicks of an unknown enrollment ", F.concat_ws(" ", *key))
    kind = sites.groupBy("id_site").agg(F.max_by("activity_type", "seq").alias("activity_type"))
    events = A.demanded(known.join(kind, "id_site", "left"), "activity_type", "unknown site ", F.col("id_site")).select(
        "node_id", "enroll_id", "user_id", "course_id", "label", F.col("activity_type").alias("action"), F.col("id_site").alias("object_id"), "d",
        F.col("sum_click").cast("bigint").alias("clicks"),
    )
    nodes = labels.drop(*key)
    return A.padded(events, nodes), nodes


def read_vle(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """From the zip archive, in which all seven members must be."""

    def rows(member: str, *columns: str) -> DataFrame:
        found = read_archive_csv(spark, path, (member,), columns, VLE_MEMBERS)
        return found.select(*(F.when(~F.col(c).isin("", "?"), F.col(c)).alias(c) for c in columns), F.struct("archive_no", "line_no").alias("seq"))

    key = ("code_module", "code_presentation", "id_student")
    info = rows("studentInfo.csv", *key, "final_result")
    return vle(info, rows("vle.csv", "id_site", "activity_type"), rows("studentVle.csv", *key, "id_site", "date", "sum_click"))
