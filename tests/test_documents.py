"""The line document source: ranges, pushed filters, commit and abort."""

import pytest
from pyspark import TaskContext
from pyspark.sql import functions as F

from variscope.sources import documents as D, text as S


def put(folder, name, data):
    folder.mkdir(parents=True, exist_ok=True)
    (folder / name).write_bytes(data)


def test_ranges_cover_each_line_once(spark, tmp_path):
    text = "\n".join("x" * (i % 37) + str(i) for i in range(500)) + "\nlast without end"
    put(tmp_path, "a.model", text.encode())
    put(tmp_path, "b.model", b"one\r\ntwo\n")
    put(tmp_path, "empty.model", b"")
    put(tmp_path, "other.cnf", b"no\n")
    for size in (1, 7, 100, 1 << 20):
        if size == 1 and len(text) > 20_000:
            continue
        rows = D.read_documents(spark, str(tmp_path), ".model", size=max(size, 64)).collect()
        mine = sorted((r["part"], r["at"], r["line"]) for r in rows if r["name"] == "a")
        assert [x[2] for x in mine] == text.split("\n")
        assert [r["line"] for r in sorted(rows, key=lambda r: r["at"]) if r["name"] == "b"] == ["one", "two"]
    for size in (1, 2, 3, 11):  # every cut, also within and after line ends
        class File:
            def read_at(self, n, at):
                return data[at : at + n]

        data = b"ab\n\ncd\r\nefg\n"
        got = [x for a in range(0, len(data), size) for x in D.lines_of(File(), len(data), a, min(a + size, len(data)))]
        assert got == [(0, b"ab"), (3, b""), (4, b"cd\r"), (8, b"efg")], size


def test_files_of_other_names_are_not_opened(spark, tmp_path):
    """Their bytes are no text, so that opening one would fail."""
    put(tmp_path, "x86.model", b'CONFIG_A "B"\n')
    for i in range(5):
        put(tmp_path, f"bad{i}.model", b"\xff\xfe\xff\n")
    one = D.read_documents(spark, str(tmp_path), ".model", ["x86", "none"])
    assert [r["line"] for r in one.collect()] == ['CONFIG_A "B"'] and one.rdd.getNumPartitions() == 1
    rows = D.read_documents(spark, str(tmp_path), ".model")
    assert rows.rdd.getNumPartitions() == 6
    assert [tuple(r) for r in S.read_model(spark, str(tmp_path), "META", archs=["x86"]).collect()] == [("x86", "CONFIG_A", "B")]
    with pytest.raises(Exception, match="decode"):
        rows.count()


def test_one_document_over_many_tasks_keeps_its_order(spark, tmp_path):
    rows = spark.range(5000).select((F.col("id") % 3).alias("doc"), "id", F.concat(F.lit("line "), "id").alias("line"))
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        D.write_documents(rows, str(tmp_path / "out"), "doc", ["id"], suffix=".txt.d")
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert len(list((tmp_path / "out" / "1.txt.d").iterdir())) > 1 and (tmp_path / "out" / "_SUCCESS").exists()
    back = D.read_documents(spark, str(tmp_path / "out"), ".txt.d").orderBy("part", "at").collect()
    for doc in range(3):
        assert [r["line"] for r in back if r["name"] == str(doc)] == [f"line {i}" for i in range(doc, 5000, 3)]


def test_odd_names(spark, tmp_path):
    rows = spark.createDataFrame([("a/b", 1, "x"), ("ü %", 2, ""), ("", 3, "z"), ("%", 4, "p"), ("_x", 5, "u"), (".y", 6, "d"), ("part-000001.txt", 7, "q")], "n string, i int, line string")
    D.write_documents(rows, str(tmp_path / "out"), "n", ["i"], suffix=".d")
    assert {(r["name"], r["line"]) for r in D.read_documents(spark, str(tmp_path / "out"), ".d").collect()} == {(r["n"], r["line"]) for r in rows.collect()}


def lossy():
    """A source whose writers are lost after writing, for the first ``times`` attempts of each task."""

    class FailsAfterWriting(D._Writer):
        def write(self, batches):
            done = super().write(batches)
            if TaskContext.get().attemptNumber() < self.times:
                raise RuntimeError("lost after writing")
            return done

    class Lossy(D.LineDocuments):
        @classmethod
        def name(cls):
            return "lossy_documents"

        def writer(self, schema, overwrite):
            writer = FailsAfterWriting(self.options, overwrite)
            writer.times = int(self.options["times"])
            return writer

    return Lossy, FailsAfterWriting


def attempts(writer_class, folder, times, tasks=3):
    """What Spark does with a writer: each task's attempts in turn, then commit, or abort if one has none left."""
    import pyarrow as pa

    writer = writer_class({"path": str(folder), "suffix": ""}, False)
    messages = []
    for task in range(tasks):
        for attempt in range(4):
            context = TaskContext()
            context._partitionId, context._attemptNumber, context._taskAttemptId = task, attempt, 10 * task + attempt
            TaskContext._taskContext, before = context, TaskContext._taskContext
            try:
                writer.times = times
                batch = pa.RecordBatch.from_pydict({"name": ["doc"] * 2, "line": [f"{task} a", f"{task} b"]})
                messages.append(writer.write(iter([batch])))
                break
            except RuntimeError:
                pass
            finally:
                TaskContext._taskContext = before
        else:
            writer.abort(messages)
            return False
    writer.commit(messages)
    return True


def test_repeated_tasks_leave_no_second_file(spark, tmp_path):
    fails = lossy()[1]
    assert attempts(fails, tmp_path / "again", times=2)
    assert sorted(str(p.relative_to(tmp_path / "again")) for p in (tmp_path / "again").rglob("*") if p.is_file()) == ["_SUCCESS", *(f"doc/part-{i:06d}.txt" for i in range(3))]
    rows = D.read_documents(spark, str(tmp_path / "again")).orderBy("part", "at").collect()
    assert [r["line"] for r in rows] == [f"{t} {x}" for t in range(3) for x in "ab"]
    assert not attempts(fails, tmp_path / "gone", times=4)
    assert not [p for p in (tmp_path / "gone").rglob("*") if p.is_file()]


def test_a_failed_write_leaves_nothing(spark, tmp_path):
    """Through Spark: the job fails, abort removes the drafts."""
    spark.dataSource.register(lossy()[0])
    rows = spark.range(10).select(F.lit("doc").alias("name"), F.col("id").cast("string").alias("line"))
    with pytest.raises(Exception, match="lost after writing"):
        rows.write.format("lossy_documents").option("times", "9").mode("append").save(str(tmp_path / "out"))
    assert not [p for p in (tmp_path / "out").rglob("*") if p.is_file()]
