"""New files as a stream, and objects read from them."""

from marlstone.sources.scan import file_rows, scan_objects, skipped_label
from marlstone.streaming.watch import files_stream


def test_new_files_arrive_whole(spark, tmp_path):
    code = tmp_path / "sql"
    code.mkdir()
    (code / "a.sql").write_text("CREATE VIEW a AS\nSELECT 1;")
    (code / "note.txt").write_text("no")
    q = files_stream(spark, str(code)).writeStream.format("memory").queryName("arrived").option("checkpointLocation", f"file://{tmp_path}/check").trigger(availableNow=True).start()
    q.awaitTermination(60)
    rows = spark.table("arrived").collect()
    assert [(r.file.rsplit("/", 1)[-1], r.text) for r in rows] == [("a.sql", "CREATE VIEW a AS\nSELECT 1;")]


def test_scan_keeps_problems_as_rows(spark, tmp_path):
    (tmp_path / "sub").mkdir()
    (tmp_path / "b.sql").write_text("CREATE VIEW b AS SELECT * FROM a;\nUPDATE a SET x = 1;\nCREATE INDEX ON t (a);\nCREATE VIEW lost AS SELECT 1;")
    (tmp_path / "sub" / "a.sql").write_text("CREATE TABLE a (x int);")
    (tmp_path / "c.sql").write_text("SELECT 'open")
    (tmp_path / "x.test.sql").write_text("CREATE VIEW t AS SELECT 1;")
    rows = scan_objects(spark, str(tmp_path)).orderBy("seq").collect()
    assert [(r.object_type, r.state_name, r.start_line) for r in rows if r.object_type] == [("view", "b", 1), ("table", "a", 1)]
    assert [r.problem.split(":")[0] for r in rows if r.problem] == ["skipped update", "rest of the file left out", "syntax error"]
    assert file_rows("f", "") == [] and skipped_label("GRANT ALL ON t TO u") == "permission" and skipped_label("VACUUM t") == "maintenance"
