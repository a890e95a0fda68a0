"""Readers, writers and the streaming rollup."""

import gzip
import hashlib
import io
import tarfile

import pytest

from gaugelake.sources import archives, readers, streams, writers
from gaugelake.streaming.rollup import source_rollup

SCHEMA = "ID string, Name string, SMILES string, Solubility double"


def test_csv_encodings(spark, tmp_path):
    from pyspark.sql.types import _parse_datatype_string

    kind = _parse_datatype_string("a string, b double")
    (tmp_path / "u.csv").write_bytes("a,b\nnaïve,1\n".encode())
    (tmp_path / "l.csv").write_bytes("a,b\nnaïve,x\n".encode("latin-1"))
    assert [tuple(r) for r in readers.read_csv(spark, str(tmp_path / "u.csv"), kind).collect()] == [("naïve", 1.0)]
    assert [tuple(r) for r in readers.read_csv(spark, str(tmp_path / "l.csv"), kind).collect()] == [("naïve", None)]
    assert readers.read_sources([("u", str(tmp_path / "u.csv"), kind, 1)], spark)["u"].count() == 1
    with pytest.raises(ValueError, match="rows"):
        readers.read_sources([("u", str(tmp_path / "u.csv"), kind, 5)], spark)


def _tar(path, members, mode="w:gz"):
    with tarfile.open(path, mode) as tar:
        for name, body in members.items():
            info = tarfile.TarInfo(name)
            info.size = len(body)
            tar.addfile(info, io.BytesIO(body))


@pytest.mark.parametrize("mode", ["w:gz", "w"])
def test_archive_is_checked(spark, tmp_path, mode):
    from pyspark.sql.types import _parse_datatype_string

    archive, kind = tmp_path / "a.tar.gz", _parse_datatype_string(SCHEMA)
    head = b"junk line\nSolubility,more,ID,Name,SMILES\n"
    many = "".join(f"-{k}.5,,{k + 10},\"n, {k}\",C\r\n" for k in range(9000)).encode()
    _tar(archive, {"d/t1.csv": head + b'-1.5,a,1,"x\ny",C\n\n,,2\n', "d/t2.csv": b"\xef\xbb\xbf" + head + many, "d/none.csv": head, "d/bad.csv": head + b"high,a,1,x,C\n"}, mode)
    digest = hashlib.md5(archive.read_bytes()).hexdigest()
    read = lambda members, md5=None, **more: archives.read_archive(spark, str(archive), members, kind, md5=md5, **more)
    df = read({"one": ("d/t1.csv", 2), "two": ("d/t2.csv", 9000), "zero": ("d/none.csv", 0)}, digest, id_col="ID")
    got = {r.ID: r for r in df.collect()}
    assert len(got) == 9002 and tuple(got["1"]) == ("1", "x\ny", "C", -1.5, "one") and tuple(got["2"]) == ("2", None, None, None, "one")
    assert tuple(got["9009"]) == ("9009", "n, 8999", "C", -8999.5, "two")
    assert {r.member for r in archives.archive_members(spark, str(archive)).collect()} == {"d/t1.csv", "d/t2.csv", "d/none.csv", "d/bad.csv"}
    for members, md5, what in (({"t1": ("d/t1.csv", 3)}, None, "rows"), ({"t1": ("no.csv", 1)}, None, "not in"), ({"t1": ("d/t1.csv", 2)}, "0" * 32, "MD5")):
        with pytest.raises(ValueError, match=what):
            read(members, md5)
    with pytest.raises(ValueError, match="repeated ids"):
        read({"a": ("d/t1.csv", 2), "b": ("d/t1.csv", 2)}, id_col="ID")
    with pytest.raises(Exception, match="CAST_INVALID_INPUT"):
        read({"a": ("d/bad.csv", 1)})


def test_csv_behind_a_preamble(spark, tmp_path):
    from pyspark.sql.types import _parse_datatype_string

    kind = _parse_datatype_string("b double, a string")
    folder = tmp_path / "c"
    folder.mkdir()
    (folder / "1.csv").write_bytes("made by hand\n\na,c,b\nnaïve,,1.5\r\n\n\"x, y\",2,\n".encode("latin-1"))
    (folder / "2.csv").write_bytes(b"made by hand\n\na,c,b\n" + b"".join(b"r%d,,%d\n" % (k, k) for k in range(5000)))
    (folder / "3.csv").write_bytes(b"")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "8192")  # files in several pieces
    try:
        got = sorted((r.a, r.b) for r in readers.read_csv(spark, str(folder), kind, skip_lines=2).collect())
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    assert len(got) == 5002 and set(got) == {("naïve", 1.5), ("x, y", None), *[(f"r{k}", float(k)) for k in range(5000)]}
    assert readers.read_csv(spark, str(folder / "1.csv"), skip_lines=2).columns == ["a", "c", "b"] and readers.read_csv(spark, str(folder / "3.csv"), kind, skip_lines=2).count() == 0
    with pytest.raises(ValueError, match="missing columns"):
        readers.read_csv(spark, str(folder), _parse_datatype_string("z string"), skip_lines=2)


def test_files_of_any_size(spark, tmp_path):
    root = tmp_path / "big"
    root.mkdir()
    size = (3 << 30) + 5  # beyond what one value holds; a hole of zeros
    with open(root / "hole.bin", "wb") as f:
        f.write(b"start")
        f.truncate(size)
    (root / "empty").write_bytes(b"")
    (root / "a b%.txt").write_bytes(b"x" * 9)
    want = hashlib.sha256(b"start")
    for _ in range(3 << 10):
        want.update(bytes(1 << 20))
    got = {r.path: (r.length, r.sha256) for r in readers.file_inventory(spark, str(root)).collect()}
    assert got == {"hole.bin": (size, want.hexdigest()), "empty": (0, hashlib.sha256().hexdigest()), "a b%.txt": (9, hashlib.sha256(b"x" * 9).hexdigest())}
    changed = streams.listing(spark, str(root / "a b%.txt")).selectExpr("path", "length + 1 AS length")
    with pytest.raises(Exception, match="changed while it was read"):
        streams.digests(changed).collect()


def test_footers(spark, tmp_path):
    spark.range(100).selectExpr("id", "id % 3 AS k", "array(id) AS l").repartition(3).write.partitionBy("k").parquet(str(tmp_path / "t"))
    found = streams.footers(spark, str(tmp_path / "t")).collect()
    assert sum(r.rows for r in found) == 100 and {r.columns for r in found} == {2} and all(r.length > 0 and r.row_groups == 1 for r in found)


def test_lock_and_inventory(spark, tmp_path):
    (tmp_path / "x").mkdir()
    (tmp_path / "x/lock.txt").write_text("# c==1\nb==2\nA==1.0\n\nnot pinned\n")
    (tmp_path / "x/.git").mkdir()
    (tmp_path / "x/.git/h").write_text("h")
    assert [tuple(r) for r in readers.read_lock(spark, str(tmp_path / "x/lock.txt")).collect()] == [("A", "1.0"), ("b", "2")]
    got = readers.file_inventory(spark, str(tmp_path / "x")).collect()
    assert [(r.path, r.length, r.sha256) for r in got] == [("lock.txt", (tmp_path / "x/lock.txt").stat().st_size, hashlib.sha256((tmp_path / "x/lock.txt").read_bytes()).hexdigest())]
    with pytest.raises(ValueError, match="too large"):
        readers.file_inventory(spark, str(tmp_path / "x"), max_bytes=3)


def test_tables_and_swaps(spark, tmp_path):
    df = spark.createDataFrame([("r1", "A", 1.0), ("r2", "B", 2.0)], "run_id string, heldout string, v double")
    assert writers.write_table(df, str(tmp_path / "t"), str(tmp_path / "c"), gzip=True) == 2
    assert any(gzip.open(p).read() for p in (tmp_path / "c").glob("*.gz"))
    assert writers.ids_read_back(df, [str(tmp_path / "t")], "run_id") == []
    more = spark.createDataFrame([("r3", "A", 1.0, 0.5)], "run_id string, heldout string, v double, sd double")
    writers.write_partitioned([df, more], str(tmp_path / "p"), "heldout")
    back = readers.read_parquet(spark, str(tmp_path / "p"), columns=["run_id", "heldout", "sd"])
    assert {(r.run_id, r.heldout, r.sd) for r in back.collect()} == {("r1", "A", None), ("r2", "B", None), ("r3", "A", 0.5)}
    target = str(tmp_path / "runs")
    assert writers.append_runs(spark, df, target) == "created" and writers.append_runs(spark, more, target) == "appended"
    assert writers.append_runs(spark, more, target, idempotent=True) == "unchanged" and spark.read.parquet(target).count() == 3
    for new, same in ((more, False), (df.unionByName(df.selectExpr("'r9' AS run_id", "heldout", "v")), True)):
        with pytest.raises(ValueError, match="already"):
            writers.append_runs(spark, new, target, idempotent=same)
    assert readers.read_shards(spark, [target, str(tmp_path / "t")]).count() == 5
    with pytest.raises(ValueError, match="unfinished"):
        readers.read_shards(spark, [str(tmp_path)])
    assert writers.typed(df.selectExpr("'x' AS v"), {"v": "double"}).first().v is None


def test_reports_and_markers(tmp_path):
    writers.write_report({"b": float("nan"), "a": [1, {"c": 2.5}]}, str(tmp_path / "r.json"))
    assert readers.read_report(tmp_path / "r.json") == {"a": [1, {"c": 2.5}], "b": None}
    marker = writers.StaleMarker(str(tmp_path / "stale"))
    marker.refuse()
    marker.set("runs were added")
    with pytest.raises(RuntimeError, match="runs were added"):
        marker.refuse()
    marker.clear()
    marker.refuse()


def test_stream_equals_table(spark, tmp_path):
    df = spark.createDataFrame([("2024-01-01 05:00:00", "a", 1.0), ("2024-01-01 23:00:00", "a", float("nan")), ("2024-01-02 01:00:00", "b", 3.0)], "ts string, source string, value double").selectExpr("cast(ts AS timestamp) AS ts", "source", "value")
    df.write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(df.schema).parquet(str(tmp_path / "in"))
    q = source_rollup(stream).writeStream.outputMode("complete").format("memory").queryName("rollup_test").option("checkpointLocation", str(tmp_path / "cp")).start()
    try:
        q.processAllAvailable()
    finally:
        q.stop()
    assert {tuple(r) for r in spark.table("rollup_test").collect()} == {tuple(r) for r in source_rollup(df).collect()} and spark.table("rollup_test").count() == 2


def test_appends_touch_what_changed(spark, tmp_path):
    from gaugelake.operators.tasks import ranked_outcomes

    target = str(tmp_path / "meta")
    runs = lambda ids: spark.createDataFrame([(f"r{k}", f"t{k % 3}", k != 4, float(k * 7 % 5)) for k in ids], "run_id string, task_id string, selectable boolean, y_rmse double")
    files = lambda: {p: p.stat().st_mtime_ns for p in (tmp_path / "meta").rglob("*.parquet")}
    assert writers.append_runs(spark, ranked_outcomes(runs(range(9))), target, by="task_id") == "created"
    before, new = files(), runs([12, 15, 10])  # of t0 and t1
    assert writers.append_runs(spark, ranked_outcomes(new), target, by="task_id") == "appended"
    after = files()
    assert before.items() <= after.items() and len(after) > len(before)
    plain = ["run_id", "task_id", "selectable", "y_rmse"]
    assert writers.rebuild(spark, target, new, "task_id", lambda df: ranked_outcomes(df.select(*plain))) == 9
    last = files()
    kept = {p for p in last if "task_id=t2" in str(p)}
    assert kept and all(last[p] == before[p] for p in kept) and not (set(last) - kept) & set(after)
    whole = ranked_outcomes(runs([*range(9), 12, 15, 10]))
    assert writers.same_rows(spark.read.parquet(target).select(*whole.columns), whole)
    assert writers.append_runs(spark, ranked_outcomes(new), target, by="task_id", idempotent=True) == "unchanged"
    wider = ranked_outcomes(runs([20])).selectExpr("*", "1 AS more")
    assert writers.append_runs(spark, wider, target, by="task_id") == "appended" and spark.read.parquet(target).where("more = 1").count() == 1


def test_fingerprints(spark, tmp_path):
    rows = lambda x: spark.createDataFrame(x, "a int, b string")
    one = rows([(1, "x"), (1, "x"), (2, None)])
    assert writers.same_rows(one, rows([(2, None), (1, "x"), (1, "x")])) and writers.same_rows(one.limit(0), rows([]))
    for other in ([(1, "x"), (2, None)], [(1, "x"), (2, None), (2, None)], [(1, "x"), (1, "x"), (None, "2")], []):
        assert not writers.same_rows(one, rows(other))
    assert writers.same_rows(one, one.selectExpr("CAST(a AS long) AS a", "b")) and not writers.same_rows(one, one.select("b", "a").selectExpr("b AS x", "CAST(a AS string) AS y"))
    loose = one.selectExpr("a", "map(a, b) AS m", "uuid() AS u", "'two\nlines' AS t")  # other rows each time they are made
    assert writers.write_table(loose, str(tmp_path / "t")) == 3 and writers.write_table(loose.drop("m"), str(tmp_path / "t"), str(tmp_path / "c")) == 3
    assert writers.write_table(one.limit(0), str(tmp_path / "e")) == 0


def test_nested_reports_are_flat(spark):
    import json

    from gaugelake.operators.reports import flatten_report, flattened

    made = [
        {"a": {"b": [1, 2, {"c": "x", "d": [{"e": None}, [3, [4, {"f": True}]], []]}], "g": {}, "h": []}, "i": "text", "j": 2.5},
        [], {}, 7, "s", [[], [{"k": [1]}]], {"x.y": {"z": [{"w": 1}, {"w": [2, 3]}]}}, [{"p": 0}], None,
    ]
    text = lambda v: v if v is None or isinstance(v, str) else json.dumps(v)
    want = sorted(((k, m, text(v)) for k, r in enumerate(made) for m, v in flatten_report(r)), key=repr)
    table = spark.createDataFrame([*[(k, json.dumps(r)) for k, r in enumerate(made)], (99, None)], "id int, report string")
    assert sorted((tuple(r) for r in flattened(table, "id", "report").collect()), key=repr) == want and len(want) > 20
    assert flattened(table.limit(0), "id", "report").collect() == []
