"""Loading that never raises: reasons, places, and failures of data sets and resamples."""

from dyadix.operators import quantiles
from dyadix.sources import audit


def put(folder, name, lines):
    (folder / f"dataset={name}").mkdir(parents=True, exist_ok=True)
    (folder / f"dataset={name}" / "TRAIN.ts").write_text("\n".join(lines) + "\n")


def test_reasons_and_places(spark, tmp_path, monkeypatch):
    put(tmp_path, "a", ["# head", "@data", "1,2,3:x", "", "1, 2 ,3:", "1,2,3", "1,?,3:y", "1,b,3:y", ":y", "1,,3:y", "1,nan,3:y", " 4,5,6 : z ", "1,1e999,2:y"])
    put(tmp_path, "b", ["1,2,3:4,5,6:x", "1,2:3:x", "1,2,3:x"])
    good, bad = audit.audited(spark, str(tmp_path))
    assert sorted((r.dataset, r.line_no, r.reason) for r in bad.collect()) == [
        ("a", 5, audit.NO_LABEL), ("a", 6, audit.NO_LABEL), ("a", 7, audit.MISSING), ("a", 8, audit.NOT_A_NUMBER), ("a", 9, audit.NO_POINTS),
        ("a", 10, audit.MISSING), ("a", 11, audit.MISSING), ("a", 13, audit.NOT_A_NUMBER), ("b", 2, audit.RAGGED)]
    assert sorted((r.dataset, r.line_no, r.label, r.channels) for r in good.collect()) == [
        ("a", 3, "x", [[1, 2, 3]]), ("a", 12, "z", [[4, 5, 6]]), ("b", 1, "x", [[1, 2, 3], [4, 5, 6]]), ("b", 3, "x", [[1, 2, 3]])]
    assert sorted((r.dataset, r.reason) for r in audit.dataset_faults(good, bad).collect()) == [("a", audit.BAD_LINES), ("b", audit.BAD_LINES), ("b", audit.CHANNELS)]


def test_lines_of_a_file_that_is_read_in_blocks(spark, tmp_path):
    put(tmp_path, "a", [f"{i},{i},{'oops' if i % 100 == 50 else i}:x" for i in range(3000)])
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "4k")
    try:
        good, bad = audit.audited(spark, str(tmp_path))
        assert good.rdd.getNumPartitions() > 4
        got = sorted((r.line_no, r.start) for r in bad.collect())
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)
    assert got == [(i + 1, f"{i},{i},oops:x") for i in range(50, 3000, 100)]


def test_tab_separated(spark, tmp_path):
    put(tmp_path, "t", ["x\t1\t2\t3", "\t1\t2", "y", "z\t1\tq", "x\t1\t2\t3\t4"])
    good, bad = audit.audited(spark, str(tmp_path), "tsv")
    assert sorted((r.line_no, r.reason) for r in bad.collect()) == [(2, audit.NO_LABEL), (3, audit.NO_POINTS), (4, audit.NOT_A_NUMBER)]
    assert good.count() == 2


def test_failures(spark, tmp_path, monkeypatch):
    put(tmp_path, "fine", ["1,2,3:x", "4,5,6:y"])
    put(tmp_path, "uneven", ["1,2,3:x", "4,5:y"])
    put(tmp_path, "ruined", ["?:x"])
    good, bad = audit.audited(spark, str(tmp_path))
    wanted = spark.createDataFrame([(d, r) for d in ("fine", "uneven", "ruined", "absent") for r in (0, 1)], "dataset string, resample int")
    indices = spark.createDataFrame([("fine", 0, 1), ("fine", 0, 0), ("fine", 1, 2), ("uneven", 0, 0), ("uneven", 0, 0)], "dataset string, resample int, idx long")
    for few in (quantiles.FEW, 0):
        monkeypatch.setattr(audit, "FEW", few)
        assert sorted(map(tuple, audit.failures(wanted, good, bad, indices).collect())) == sorted([
            ("absent", 0, audit.NOTHING), ("absent", 1, audit.NOTHING), ("absent", 0, audit.NO_INDICES), ("absent", 1, audit.NO_INDICES), ("fine", 1, audit.OUTSIDE),
            ("uneven", 0, audit.LENGTHS), ("uneven", 0, audit.SHORT), ("uneven", 0, audit.TWICE), ("uneven", 1, audit.LENGTHS), ("uneven", 1, audit.SHORT), ("uneven", 1, audit.NO_INDICES),
            ("ruined", 0, audit.BAD_LINES), ("ruined", 1, audit.BAD_LINES), ("ruined", 0, audit.NO_INDICES), ("ruined", 1, audit.NO_INDICES)])
