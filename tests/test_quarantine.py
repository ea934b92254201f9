"""Rejected lines of a CSV survey: every line is accepted, set aside with its place, or a header."""
import pytest

from surveykit.sources.quarantine import REASONS, read_survey_checked
from surveykit.sources.survey import read_survey

HEADER = "Segment,Q5_Rattle_Severity_Scale,Q9_Price_Bargain"
FILES = {
    "a.csv": [HEADER, "Elite_Enthusiast,3.0,10.5", "Tech_Purist,2", '"A, quoted",4,1', "x,1,2,3", "", HEADER, '"open,1,2', ",,", "NA,5,7", ",,,x"],
    "b.csv": ["﻿" + HEADER, "Tech_Purist,1,2", " ", 'say \\"hi\\",1,2'],
    "c.csv": ["Segment,Other", "x,1", "y,2"],
    "d.csv": [HEADER],
}


def write(folder, files):
    folder.mkdir()
    for name, lines in files.items():
        (folder / name).write_text("\n".join(lines) + "\n", encoding="utf-8")
    return str(folder)


@pytest.mark.parametrize("split", ["134217728", "16"])
def test_every_line_has_one_place(spark, tmp_path, split):
    path = write(tmp_path / "in", FILES)
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", split)
    try:
        accepted, rejected = read_survey_checked(spark, path)
        got = sorted((r.file.rsplit("/", 1)[1], r.line, REASONS.index(r.reason), r.text) for r in rejected.collect())
        rows = accepted.collect()
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)
    a, b, c = FILES["a.csv"], FILES["b.csv"], FILES["c.csv"]
    assert got == [("a.csv", 3, 4, a[2]), ("a.csv", 5, 5, a[4]), ("a.csv", 6, 2, ""), ("a.csv", 7, 1, HEADER), ("a.csv", 8, 3, a[7]), ("a.csv", 11, 5, a[10]),
                   ("b.csv", 3, 2, b[2]), *[("c.csv", i + 1, 0, s) for i, s in enumerate(c)]]
    assert sorted((r.Segment or "", r.Q5_Rattle_Severity_Scale, r.Q9_Price_Bargain) for r in rows if r.Q5_Rattle_Severity_Scale) == [
        ("", 5, 7.0), ("A, quoted", 4, 1.0), ("Elite_Enthusiast", 3, 10.5), ("Tech_Purist", 1, 2.0), ('say \\"hi\\"', 1, 2.0)]
    assert len(rows) + len(got) + 3 == sum(map(len, FILES.values())) and len({r.respondent_id for r in rows}) == len(rows)


def test_sound_file_reads_as_by_the_plain_reader(spark, tmp_path):
    path = write(tmp_path / "in", {"a.csv": FILES["a.csv"][:2] + ['"A, quoted",4,1', ",,", "NA,5,7"]})
    accepted, rejected = read_survey_checked(spark, path)
    assert rejected.count() == 0 and sorted(map(str, accepted.collect())) == sorted(map(str, read_survey(spark, path).collect()))


def test_headers_that_cannot_be_read(spark, tmp_path):
    for i, head in enumerate(["a,A", "a,,b"]):
        with pytest.raises(ValueError):
            read_survey_checked(spark, write(tmp_path / str(i), {"a.csv": [head, "1,2"]}))
