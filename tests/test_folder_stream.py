import os

from pyspark.sql import functions as F

from lorekeep.streaming import folder, watch


def test_folder_events(spark, tmp_path):
    root, seen = tmp_path / "in", []
    (root / "sub/deep").mkdir(parents=True)
    for name in ("a.txt", "b.txt", "sub/c.txt", "sub/deep/d.txt", "index.md", "same.txt"):
        (root / name).write_text(f"text of {name}")
    found = folder.events(folder.listings(spark, [str(root)], tasks=2), verify_ms=6_000)
    q = found.writeStream.option("checkpointLocation", str(tmp_path / "cp")).trigger(processingTime="1 second").foreachBatch(lambda df, i: seen.extend((os.path.relpath(r.path, root), r.change) for r in df.collect())).start()

    def until(n):
        for _ in range(90):
            if len(seen) >= n or q.awaitTermination(1):
                break

    try:
        until(5)
        assert sorted(seen) == [(n, "added") for n in ("a.txt", "b.txt", "same.txt", "sub/c.txt", "sub/deep/d.txt")]
        seen.clear()
        before = os.stat(root / "same.txt")
        (root / "a.txt").write_text("another text")
        os.utime(root / "b.txt", (1, 1))  # touched only
        (root / "same.txt").write_text("TEXT OF same.txt")
        os.utime(root / "same.txt", ns=(before.st_atime_ns, before.st_mtime_ns))  # neither size nor time tells
        (root / "sub/c.txt").unlink()
        (root / "sub/new.txt").write_text("new")
        until(4)
        assert sorted(seen) == [("a.txt", "updated"), ("same.txt", "updated"), ("sub/c.txt", "removed"), ("sub/new.txt", "added")]
        seen.clear()
        (root / "sub/c.txt").write_text("text of sub/c.txt")  # back again
        until(1)
        assert seen == [("sub/c.txt", "added")]
    finally:
        q.stop()


def test_a_folder_that_is_gone_is_no_deletion(spark, tmp_path):
    root, seen = tmp_path / "in", []
    root.mkdir()
    (root / "a.txt").write_text("a")
    q = folder.events(folder.listings(spark, [str(root)])).writeStream.option("checkpointLocation", str(tmp_path / "cp")).trigger(processingTime="1 second").foreachBatch(lambda df, i: seen.extend(r.change for r in df.collect())).start()
    try:
        for _ in range(60):
            if seen or q.awaitTermination(1):
                break
        root.rename(tmp_path / "away")
        stopped = False
        for _ in range(60):
            try:
                if q.awaitTermination(1):
                    break
            except Exception:
                stopped = True
                break
        assert stopped and seen == ["added"]
    finally:
        q.stop()


def test_states_resume_from_the_checkpoint(spark, tmp_path):
    kind = "path string, size long, mtime_ns long, ms long, sha256 string"
    runs = [
        [("x", 1, 1, 10, "a"), ("y", 1, 1, 10, "b"), ("z", None, 1, 10, "c"), ("x", 1, 2, 10, "a2")],
        [("x", 1, 2, 20, "ignored"), ("y", 2, 1, 20, "b2"), ("n", 1, 1, 20, None)],
        [],
        [("x", 1, 2, 400_000, "a3"), ("n", 1, 1, 400_000, "d")],
    ]
    got = []
    for k, rows in enumerate(runs):
        spark.createDataFrame(rows, kind).filter("size is not null").write.mode("append").parquet(str(tmp_path / "in"))
        q = folder.events(spark.readStream.schema(kind).parquet(str(tmp_path / "in"))).writeStream.option("checkpointLocation", str(tmp_path / "cp")).format("parquet").option("path", str(tmp_path / "out")).trigger(availableNow=True).start()
        q.awaitTermination()
        got.append({(r.path, r.change, r.sha256) for r in spark.read.schema(folder.EVENT).parquet(str(tmp_path / "out")).collect()} - set().union(*got))
    assert got[0] == {("x", "added", "a2"), ("y", "added", "b")}
    assert got[1] == {("y", "updated", "b2")}
    assert got[2] | got[3] == {("y", "removed", "b2"), ("x", "updated", "a3"), ("n", "added", "d")}


def test_watch_calls_only_on_changes(spark, tmp_path):
    root, calls = tmp_path / "in", []
    root.mkdir()
    (root / "a.txt").write_text("a")
    q = watch.watch(spark, [str(root)], lambda changes, i: calls.append(sorted((r.change, r.sha256) for r in changes.collect())), str(tmp_path / "cp"), every="1 second")
    try:
        for k in range(60):
            if len(calls) == 1 and k and not (root / "b.txt").exists():
                (root / "b.txt").write_text("b")
            if len(calls) == 2 or q.awaitTermination(1):
                break
    finally:
        q.stop()
    one = lambda s: spark.range(1).select(F.sha2(F.lit(s), 256)).first()[0]
    assert calls == [[("added", one("a"))], [("added", one("b"))]]


def test_paths_of_a_bucket_keep_their_own_states(spark, tmp_path):
    """All paths in two buckets: those that go while others stay, go later, come back, or can't be read."""
    kind = "path string, size long, mtime_ns long, ms long, sha256 string"
    runs = [
        [(f"p{k}", 1, 1, 10, f"a{k}") for k in range(8)],
        [(f"p{k}", 1, 2, 20, f"b{k}") for k in range(6)] + [("p6", 2, 2, 20, None)],
        [(f"p{k}", 1, 2, 30, "not read") for k in range(4)] + [("p6", 2, 2, 30, None), ("p7", 1, 1, 30, "a7")],
        [(f"p{k}", 1, 2, 40, "not read") for k in range(4)],
    ]
    got: list[set] = []
    for rows in runs:
        spark.createDataFrame(rows, kind).write.mode("append").parquet(str(tmp_path / "in"))
        found = folder.events(spark.readStream.schema(kind).parquet(str(tmp_path / "in")), buckets=2)
        q = found.writeStream.option("checkpointLocation", str(tmp_path / "cp")).format("parquet").option("path", str(tmp_path / "out")).trigger(availableNow=True).start()
        q.awaitTermination()
        got.append({(r.path, r.change, r.sha256) for r in spark.read.schema(folder.EVENT).parquet(str(tmp_path / "out")).collect()} - set().union(*got))
    assert got[0] == {(f"p{k}", "added", f"a{k}") for k in range(8)}
    assert got[1] == {(f"p{k}", "updated", f"b{k}") for k in range(6)} | {("p7", "removed", "a7")}
    assert got[2] == {("p4", "removed", "b4"), ("p5", "removed", "b5")}  # p7 is back with what it had
    assert got[3] == {("p6", "removed", "a6"), ("p7", "removed", "a7")} - got[1]
