"""Archives by their members, and folders for files."""

import zipfile

import pytest

from tidewind.sources import archives, panels, paths


def test_members_are_tasks_and_dates_are_pushed_down(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(archives, "MEMBERS", 2)
    name = tmp_path / "ABC__minutes of a year.zip"
    with zipfile.ZipFile(name, "w") as z:
        for day in range(1, 10):
            z.writestr(f"ABC/2020-01-{day:02d}.csv", f"timestamp,close\n1,5\n2,{day}\n")
        z.writestr("ABC/notes.txt", "x")
        z.writestr("ABC/undated.csv", "timestamp,close\n2020-01-20,7\n")
    raw = bytearray(name.read_bytes())
    at = raw.index(b"2,9\n")
    raw[at : at + 3] = b"2,8"  # the check sum of the last day's member is wrong
    name.write_bytes(bytes(raw))
    path = str(tmp_path / "*.zip")
    assert {(r.member, r.bytes) for r in archives.zip_members(spark, path).where("member LIKE '%-01.csv'").collect()} == {("ABC/2020-01-01.csv", 24)}
    assert archives.zip_last_rows(spark, path, "2020-01-02", "2020-01-05").count() == 5
    got = {str(r.date): r.close for r in archives.daily_closes(spark, path, "2020-01-03", "2020-01-08").collect()}
    assert got == {f"2020-01-0{d}": float(d) for d in range(3, 9)}
    assert {str(r.date) for r in archives.daily_closes(spark, path, first="2020-01-10").collect()} == {"2020-01-20"}
    with pytest.raises(Exception, match="CRC"):
        archives.daily_closes(spark, path).collect()


def test_other_archives_are_read_whole(spark, tmp_path):
    import io
    import tarfile

    with tarfile.open(tmp_path / "XY__m.tar", "w") as t:
        info = tarfile.TarInfo("XY/2020-01-02.csv")
        body = b"timestamp,close\n1,3\n"
        info.size = len(body)
        t.addfile(info, io.BytesIO(body))
    with zipfile.ZipFile(tmp_path / "ZZ__m.ZIP", "w") as z:
        z.writestr("a/2020-01-02.CSV", "timestamp,close\n1,4\n")
    assert {(r.asset, r.close) for r in archives.daily_closes(spark, str(tmp_path / "*")).collect()} == {("XY", 3.0), ("ZZ", 4.0)}


def test_files_are_written_by_tasks(spark, tmp_path):
    folder = panels.write_files(spark.createDataFrame([("a b/x.csv", bytearray(b"1")), ("y.csv", bytearray(b"2"))], "name string, content binary"), str(tmp_path / "out"))
    assert (tmp_path / "out" / "a b" / "x.csv").read_bytes() == b"1" and (tmp_path / "out" / "y.csv").read_bytes() == b"2" and folder == str(tmp_path / "out")
    with archives.opened(f"file:{folder}/a%20b/x.csv") as f:
        assert f.read() == b"1"
    assert paths.scratch(spark) != paths.scratch(spark)
