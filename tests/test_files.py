from pathlib import Path

from .conftest import SMALL

from meridian.plans import catalog
from meridian.sources import trajectories


def _files(path):
    return [f for f in Path(path.removeprefix("file://")).rglob("*") if f.is_file() and f.name.startswith("part-")]


def test_a_user_has_one_file_with_its_header_first(spark):
    points = _files(catalog._write_points(spark, SMALL))
    assert len({f.parent.name for f in points}) == len(points) == 15
    for f in points:
        lines = f.read_text().splitlines()
        times = [x.rsplit(",", 1)[1] for x in lines[6:]]
        assert lines[:2] == ["Trajectory", "WGS 84"] and times == sorted(times) and all(x.count(",") == 6 for x in lines[6:])


def test_labels_are_in_one_file_a_user_and_points_are_not_written_for_them(spark):
    made = []
    catalog.fresh_path, old = lambda s, label: made.append(label) or old(s, label), catalog.fresh_path
    try:
        assert catalog.label_files(spark, SMALL).count() > 15
        path = catalog._write_labels(spark, SMALL)
    finally:
        catalog.fresh_path = old
    assert made == ["labels", "labels"]
    files = _files(path)
    assert len({f.parent.name for f in files}) == len(files)


def test_files_are_written_by_tasks_and_folders_listed_by_few(spark, tmp_path):
    """Files of many lines and of odd names, without a process for each; 150 folders are not 150 tasks."""
    lines = [(f"u{i}", day, f"{k},127.0,0,492,39744.1,2008-10-0{day},0{k}:00:00") for i in range(150) for day in ("1", "2") for k in range(3)]
    lines += [("a/b", "1", f"{k},127.0,0,492,39744.1,2008-10-01,00:00:00") for k in range(30)]
    rows = spark.createDataFrame(lines, "user_id string, file string, value string").repartition(3, "user_id").sortWithinPartitions("user_id", "file", "value")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
    try:
        trajectories.write_files(rows, f"file://{tmp_path}/out")
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    files = [f for f in (tmp_path / "out").rglob("*") if f.is_file()]
    assert len(files) == 301 and {f.name for f in files} == {"part-1.txt", "part-2.txt"}
    assert (tmp_path / "out/user_id=a%2Fb/part-1.txt").read_text().splitlines() == sorted(v for u, _, v in lines if u == "a/b")
    spark.sparkContext.setJobGroup("listing", "")
    try:
        read = trajectories.trajectories(spark, f"file://{tmp_path}/out", "user_id=*/part-*", "user_id=([^/]+)/")
        tracker = spark.sparkContext.statusTracker()
        jobs = [tracker.getJobInfo(j) for j in tracker.getJobIdsForGroup("listing")]
        assert 0 < sum(tracker.getStageInfo(s).numTasks for j in jobs for s in j.stageIds) <= 4 * spark.sparkContext.defaultParallelism
    finally:
        spark.sparkContext.setJobGroup("", "")
    assert sorted(r.user_id for r in read.filter("lat = 2 and user_id like 'u%'").collect()) == sorted(u for u, _, v in lines if u != "a/b" and v.startswith("2,"))
