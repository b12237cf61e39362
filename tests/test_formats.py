"""The public logs' own formats: the hand fixture as archives, and rows that must fail."""

import io
import tarfile
import zipfile

import pytest
from pyspark.sql import functions as F

from tallyloom.operators import activity as A
from tallyloom.operators import hypergraph as H
from tallyloom.plans import formats
from tallyloom.sources import loaders, tables
from tallyloom.spec import MOOC, VLE

START = {"A": "2024-01-01", "B": "2024-01-11", "C": "2024-01-01"}
LOG = [
    (10, 1, "A", "play_video", "v1", "2024-01-01"), (10, 1, "A", "play_video", " v1 ", "2024-01-02"), (10, 1, "A", "problem_check", "p1", "2024-01-02"),
    (10, 1, "A", "click_info", "", "2024-01-03"), (11, 1, "B", "play_video", "v1", "2024-01-11"), (12, 2, "A", "problem_get", "p1", "2024-01-04"),
    (12, 2, "A", "create_thread", "None", "2024-01-06"), (12, 2, "A", "play_video", "v9", "2023-12-31"), (12, 2, "A", "play_video", "v9", "2024-02-05"),
    (12, 2, "A", "unknown_action", "v9", "2024-01-05"),
]
MORE = [
    (13, 3, "B", "play_video", "v1", "2024-02-14"), (13, 3, "B", "click_courseware", '"pg9, ""x"""', "2024-02-14"), (14, 4, "C", "play_video", "v1", "2024-02-10"),
    (14, 5, "B", "play_video", "v1", "2023-12-01"), (99, 9, "Z", "play_video", "v1", "2024-01-01"), (12, 2, "Z", "unknown_action", "v1", "2024-01-01"),
]


def lines(rows, header):
    return header + "\n" + "\n".join(",".join(map(str, r)) for r in rows)


def tar_of(path, members):
    with tarfile.open(path, "w:gz") as t:
        for name, text in members:
            data = text.encode()
            info = tarfile.TarInfo(f"prediction_log/{name}")
            info.size = len(data)
            t.addfile(info, io.BytesIO(data))


def mooc_folder(tmp_path, log=LOG, more=MORE, truth=((10, 1), (11, 0), (12, 1), (13, 0), (14, 1)), start=START):
    header = "enroll_id,username,course_id,session_id,action,object,time"
    raw = lambda rows: lines([(e, u, c, "s", a, o, f"{t}T10:00:00") for e, u, c, a, o, t in rows], header)
    members = [("readme.txt", "x" * 511), ("train_log.csv", raw(log) + "\n"), ("empty.csv", ""), ("test_log.csv", raw(more)), ("train_truth.csv", lines(truth, "enroll_id,truth") + "\r\n"), ("test_truth.csv", "enroll_id,truth\n14,0"), ("rest.bin", "y\n" * 3000)]
    tar_of(tmp_path / "prediction_data.tar.gz", members)
    (tmp_path / "course_info.csv").write_text(lines([(i, c, f"{s} 08:00:00") for i, (c, s) in enumerate(start.items())], "id,course_id,start") + "\n")
    return str(tmp_path)


def test_mooc_archive_gives_the_hand_fixture(spark, tmp_path):
    events, nodes = loaders.read_mooc(spark, mooc_folder(tmp_path))
    x = {r.node_id: r for r in A.counts(events, MOOC).join(nodes.select("enroll_id", "node_id"), "enroll_id").collect()}
    assert [x[i].total_events for i in range(5)] == [4, 1, 2, 2, 0] and [x[i].distinct_objects for i in range(5)] == [2, 1, 1, 2, 0]
    assert (x[0].activity_day_0, x[0].activity_day_1, x[0].activity_day_2, x[3].activity_day_34) == (1, 2, 1, 2)
    assert x[0].action_video_2 == 2 and len(MOOC.feature_names) == 59
    assert [(r.enroll_id, r.user_id, r.course_id, r.label) for r in nodes.orderBy("node_id").collect()] == [(10, 1, "A", 1), (11, 1, "B", 0), (12, 2, "A", 1), (13, 3, "B", 0), (14, 4, "C", 0)]
    edges = H.edges(H.memberships(nodes, events.where("action IS NOT NULL"), MOOC)).orderBy("edge_id").collect()
    assert [(r.family, r.key, r.size) for r in edges] == [("course", "A", 2), ("course", "B", 2), ("object", "A|assignment|p1", 2), ("object", "B|video|v1", 2), ("user", "1", 2)]
    assert {r.object_id for r in events.where("action = 'click_courseware'").collect()} == {'pg9, "x"'}


def test_mooc_rows_without_a_partner_fail(spark, tmp_path):
    with pytest.raises(Exception, match="no start of course Q"):
        (tmp_path / "a").mkdir()
        loaders.read_mooc(spark, mooc_folder(tmp_path / "a", [*LOG, (10, 1, "Q", "play_video", "v", "2024-01-01")]))[0].collect()
    with pytest.raises(Exception, match="enrollment 77 has a label but no log row"):
        (tmp_path / "b").mkdir()
        loaders.read_mooc(spark, mooc_folder(tmp_path / "b", truth=((10, 1), (77, 0))))[0].collect()


def vle_zip(path, clicks, info=None, sites=((1, "quiz"), (2, "url"), (3, "page"))):
    info = info or [("AAA", "2013J", 7, "Pass"), ("AAA", "2013J", 20, "Withdrawn"), ("AAA", "2014B", 7, "?"), ("BBB", "2013J", 100, "Fail")]
    text = {m: "x\n" for m in loaders.VLE_MEMBERS}
    text["studentInfo.csv"] = lines([(a, b, s, "M", r) for a, b, s, r in info], "code_module,code_presentation,id_student,gender,final_result")
    text["vle.csv"] = lines([(i, "AAA", "2013J", k) for i, k in sites], '"id_site","code_module","code_presentation","activity_type"')
    text["studentVle.csv"] = lines(clicks, "code_module,code_presentation,id_student,id_site,date,sum_click")
    with zipfile.ZipFile(path, "w", zipfile.ZIP_DEFLATED) as z:
        for m, t in text.items():
            z.writestr(m, t)
    return str(path)


CLICKS = [("AAA", "2013J", 7, 1, 0, 4), ("AAA", "2013J", 7, 1, 0, 2), ("AAA", "2013J", 7, 2, 34, 1), ("AAA", "2013J", 7, 3, 35, 9), ("AAA", "2013J", 7, 3, -1, 9), ("AAA", "2014B", 7, 2, 3, 5)]


def test_vle_archive(spark, tmp_path):
    events, nodes = loaders.read_vle(spark, vle_zip(tmp_path / "v.zip", [*CLICKS, ("ZZZ", "x", 1, 1, 40, 1)]))
    assert [(r.enroll_id, r.user_id, r.course_id, r.label) for r in nodes.orderBy("node_id").collect()] == [(0, 7, "AAA_2013J", 0), (1, 20, "AAA_2013J", 1), (2, 7, "AAA_2014B", 0), (3, 100, "BBB_2013J", 0)]
    x = {r.enroll_id: r for r in A.counts(events, VLE).collect()}
    assert [x[i].total_clicks for i in range(4)] == [7, 0, 5, 0] and [x[i].distinct_sites for i in range(4)] == [2, 0, 1, 0]
    assert (x[0].clicks_day_0, x[0].clicks_day_34, x[0].clicks_quiz, x[0].clicks_url, x[2].clicks_day_3) == (6, 1, 6, 1, 5) and len(VLE.feature_names) == 55


def test_vle_rows_without_a_partner_fail(spark, tmp_path):
    for name, match, clicks, how in (
        ("a", "clicks of an unknown enrollment AAA 2013J 8", [("AAA", "2013J", 8, 1, 1, 1)], {}), ("b", "unknown site 9", [("AAA", "2013J", 7, 9, 1, 1)], {}),
        ("c", "two rows of AAA 2013J 7", CLICKS, {"info": [("AAA", "2013J", 7, "Pass"), ("AAA", "2013J", 7, "Fail")]}),
    ):
        with pytest.raises(Exception, match=match):
            loaders.read_vle(spark, vle_zip(tmp_path / f"{name}.zip", clicks, **how))[0].collect()
    with zipfile.ZipFile(tmp_path / "short.zip", "w") as z:
        z.writestr("vle.csv", "id_site,activity_type\n")
    with pytest.raises(Exception, match="lacks"):
        loaders.read_vle(spark, str(tmp_path / "short.zip"))


def test_tar_stream_with_long_members_and_names(spark, tmp_path):
    long = "\n".join(f"line {i} " + "ü" * (i % 700) for i in range(900))
    tar_of(tmp_path / "t.tar.gz", [("n" * 150 + ".csv", "skip\nthis"), ("a.csv", long), ("b.csv", "1\n\n3\n"), ("c.csv", "end")])
    rows = tables.read_archive(spark, str(tmp_path / "t.tar.gz"), ("a.csv", "b.csv", "c.csv")).collect()
    of = lambda m: [r.line for r in sorted((r for r in rows if r.member == m), key=lambda r: r.line_no)]
    assert of("a.csv") == long.split("\n") and of("b.csv") == ["1", "", "3"] and of("c.csv") == ["end"]
    with pytest.raises(Exception, match="lacks d.csv"):
        tables.read_archive(spark, str(tmp_path / "t.tar.gz"), ("d.csv",)).collect()


def test_materialised_and_marked_sinks(spark, tmp_path):
    path = str(tmp_path / "m")
    assert tables.materialised(spark, path, lambda: spark.range(3)).count() == 3
    assert tables.materialised(spark, path, lambda: spark.range(9)).count() == 3
    tables.write_csv(spark.createDataFrame([("a", None), ("ü ± ✓", 2.5)], "s string, v double").coalesce(1), str(tmp_path / "c"), mark=True)
    (part,) = (tmp_path / "c").glob("part-*.csv")
    assert part.read_bytes().startswith("\ufeffs,v".encode()) and sorted(part.read_text("utf-8-sig").split("\n")[1:]) == ["", "a,", "ü ± ✓,2.5"]
    assert tables.split_path("f", 11) == "f/splits/seed=11" and tables.feature_path("f", "x59", 1) == "f/x59/seed=1"


def test_the_last_of_repeated_rows_counts_however_rows_are_dealt(spark):
    """Twenty-eight rows of one course and of one site, over several partitions and in any order."""
    logs = spark.createDataFrame([("1", "5", "A", "play_video", "v", "2024-02-01", 0)], "enroll_id string, username string, course_id string, action string, object string, time string, seq int")
    truths = spark.createDataFrame([("1", "0", 0), ("1", "1", 1)], "enroll_id string, truth string, seq int")
    courses = spark.createDataFrame([("A", f"2024-01-{i + 1:02}", i) for i in range(28)], "course_id string, start string, seq int")
    info = spark.createDataFrame([("m", "p", "1", "Pass")], "code_module string, code_presentation string, id_student string, final_result string")
    clicks = spark.createDataFrame([("m", "p", "1", "3", "0", "2")], "code_module string, code_presentation string, id_student string, id_site string, date string, sum_click string")
    sites = spark.createDataFrame([("3", VLE.actions[i % 18], i) for i in range(28)], "id_site string, activity_type string, seq int")
    for n in (1, 3, 7, 11):
        assert [r.d for r in loaders.mooc(logs, truths, courses.repartition(n))[0].collect()] == [4]
        assert [r.action for r in loaders.vle(info, sites.repartition(n), clicks)[0].collect()] == [VLE.actions[27 % 18]]


def test_the_last_line_of_a_course_file_counts(spark, tmp_path):
    folder = mooc_folder(tmp_path)
    (tmp_path / "course_info.csv").write_text("id,course_id,start\n" + "".join(f"{i},{c},2024-{i % 12 + 1:02}-01\n" for i in range(500) for c in "ABC") + "".join(f"0,{c},{s}\n" for c, s in START.items()))
    size = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "2048")
    try:
        events, _ = loaders.read_mooc(spark, folder)
        assert {(r.enroll_id, r.d) for r in events.where("action = 'play_video'").collect()} == {(10, 0), (10, 1), (11, 0), (13, 34)}
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", size)


@pytest.mark.parametrize("columns", [["event_id"], ["start"], ["d"], ["enroll_id", "action"], []])
def test_an_unknown_course_fails_whatever_is_read(spark, columns):
    events = spark.createDataFrame([(1, 7, "A", "view", "2024-01-05"), (2, 8, "Q", "view", "2024-01-05")], "event_id int, enroll_id int, course_id string, action string, event_date string")
    courses = spark.createDataFrame([("A", "2024-01-01")], "course_id string, start string")
    out = A.course_day(events, courses)
    with pytest.raises(Exception, match="no start of course Q"):
        out.select(*columns).collect() if columns else out.count()
    assert A.course_day(events.where("event_id = 1"), courses).count() == 1


@pytest.mark.parametrize("column", ["node_id", "object_id", "clicks"])
def test_clicks_without_a_partner_fail_whatever_is_read(spark, tmp_path, column):
    for name, clicks in (("enrollment", ("AAA", "2013J", 8, 1, 1, 1)), ("site 9", ("AAA", "2013J", 7, 9, 1, 1))):
        with pytest.raises(Exception, match=f"unknown {name}"):
            loaders.read_vle(spark, vle_zip(tmp_path / f"{column}{name[:4]}.zip", [clicks]))[0].select(column).collect()


def test_an_unknown_activity_of_a_weighted_log_fails_in_features(spark):
    rows = spark.createDataFrame([(1, VLE.actions[0], "3", 2, 5), (1, "other", "3", 40, 5)], "enroll_id int, action string, object_id string, d int, clicks bigint")
    labels = spark.createDataFrame([(1,), (2,)], "enroll_id int")
    assert [r.total_clicks for r in A.features(rows, labels, VLE).orderBy("enroll_id").collect()] == [5, 0]
    with pytest.raises(Exception, match="unknown activity other"):
        A.features(rows.withColumn("d", rows.d % 35), labels, VLE).collect()


def test_log_rows_meet_in_tasks_of_few_enrollments(spark, sf_dir, monkeypatch):
    """More enrollments take more tasks and not larger ones; the rows stay the same."""
    logs, truths, courses = formats.mooc_raw(spark, sf_dir)
    of = lambda: {tuple(r) for r in loaders.mooc(logs, truths, courses)[0].drop("node_id").collect()}
    whole = of()
    monkeypatch.setattr(loaders, "TASK_ENROLLMENTS", 20)
    few = loaders.mooc(logs, truths, courses)[0]
    at = few.groupBy(F.spark_partition_id()).agg(F.countDistinct("enroll_id").alias("n")).collect()
    assert sum(r.n for r in at) == few.select("enroll_id").distinct().count() and max(r.n for r in at) < 60
    assert of() == whole
