import io
import tarfile

from pyspark.sql import functions as F

from codelode.operators import embedding as emb
from codelode.plans.ingest import ingest
from codelode.sources import archives, trees


def pack(*entries, links=(), special=()):
    buffer = io.BytesIO()
    with tarfile.open(fileobj=buffer, mode="w:gz") as tar:
        for name, data in entries:
            info = tarfile.TarInfo(name)
            if data is None:
                info.type = tarfile.DIRTYPE
                tar.addfile(info)
            else:
                info.size = len(data)
                tar.addfile(info, io.BytesIO(data))
        for name, target in links:
            info = tarfile.TarInfo(name)
            info.type, info.linkname = tarfile.SYMTYPE, target
            tar.addfile(info)
        for name in special:
            info = tarfile.TarInfo(name)
            info.type = tarfile.FIFOTYPE
            tar.addfile(info)
    return buffer.getvalue()


def expand(spark, payloads, **limits):
    df = spark.createDataFrame([(k, v) for k, v in payloads.items()], "archive string, content binary")
    files, errors = archives.expand_archives(df, **limits)
    return (
        {(r.archive, r.path): (bytes(r.content), r.commit_sha) for r in files.collect()},
        {r.archive: r.error_class for r in errors.collect()},
    )


def test_good_archives(spark):
    files, errors = expand(spark, {
        "rooted": pack(("octocat-hello-world-A1B2C3D/", None), ("octocat-hello-world-A1B2C3D/src/a.py", b"x"), ("octocat-hello-world-A1B2C3D/r.md", b"y")),
        "flat": pack(("a.py", b"1"), ("b/c.py", b"2")),
        "single": pack(("only-abcdef1", b"z")),
        "linked": pack(("root/a.py", b"q"), links=[("root/l", "a.py")]),
    })
    assert errors == {}
    assert files == {
        ("rooted", "src/a.py"): (b"x", "a1b2c3d"), ("rooted", "r.md"): (b"y", "a1b2c3d"),
        ("flat", "a.py"): (b"1", None), ("flat", "b/c.py"): (b"2", None),
        ("single", "only-abcdef1"): (b"z", None), ("linked", "a.py"): (b"q", None),
    }


def test_one_bad_member_rejects_the_archive(spark):
    good = ("r/ok.py", b"x")
    files, errors = expand(spark, {
        "up": pack(good, ("../evil.txt", b"e")), "abs": pack(good, ("/etc/passwd", b"e")), "empty": b"", "noise": b"not-a-tarball",
        "link": pack(good, links=[("r/l", "../../x")]), "fifo": pack(good, special=["r/p"]),
        "cut": pack(*[(f"r/{i}", bytes(range(256)) * 40) for i in range(20)])[:-400],
    })
    assert files == {}
    assert errors == {"up": "path_traversal", "abs": "path_traversal", "empty": "empty", "noise": "corrupt", "link": "unsafe_link",
                      "fifo": "special_file", "cut": "corrupt"}


def test_limits(spark):
    big, many = pack(("r/a", b"x" * 500)), pack(*[(f"r/{i}", b"x") for i in range(10)])
    _files, errors = expand(spark, {"big": big, "many": many}, max_bytes=200, max_files=5)
    assert errors == {"big": "size_limit", "many": "file_limit"}


def test_trees_and_archive_files(spark, tmp_path):
    (tmp_path / "src").mkdir()
    (tmp_path / "src" / "a.py").write_bytes(b"x = 1")
    (tmp_path / "b.md").write_bytes(b"# b")
    tree = trees.read_source_tree(spark, str(tmp_path))
    assert {r.path: r.length for r in tree.collect()} == {"src/a.py": 5, "b.md": 3}
    (tmp_path / "t.tar.gz").write_bytes(pack(("r/a.py", b"x")))
    files, _errors = archives.read_archives(spark, str(tmp_path / "*.tar.gz"))
    assert [r.path for r in files.collect()] == ["a.py"]


def test_ingest_gives_one_run_per_archive(spark):
    rows = [
        (1, 11, pack(("o-r-abcdef0/a.py", b"def f():\n    pass\n"), ("o-r-abcdef0/.env", b"K=1"))),
        (2, 12, pack(("../x", b"e"))),
        (3, 13, pack(*[(f"r/{i}.py", b"x") for i in range(4)])),
        (4, 14, pack(("r/.env", b"K=1"))),
    ]
    df = spark.createDataFrame(rows, "repository_id int, ingestion_id int, content binary")
    done = ingest(df, emb.hash_embedding(8), F.lit("2026-01-01").cast("timestamp"), max_files=3)
    runs = {r.repository_id: r for r in done.runs.collect()}
    assert {k: r.status for k, r in runs.items()} == {1: "completed", 2: "failed", 3: "failed", 4: "completed"}
    assert (runs[1].commit_sha, runs[1].file_count, runs[4].file_count) == ("abcdef0", 1, 0)
    chunks = done.chunks.collect()
    assert [(c.repository_id, c.name, len(c.embedding)) for c in chunks] == [(1, "f", 8)]


def test_runs_of_one_repository_stay_apart(spark):
    rows = [(1, 11, pack(("r/a.py", b"x = 1\n"))), (1, 12, pack(("r/b.py", b"y = 2\n"), ("r/c.py", b"z = 3\n")))]
    df = spark.createDataFrame(rows, "repository_id int, ingestion_id int, content binary")
    done = ingest(df, None, F.lit("2026-01-01").cast("timestamp"))
    assert {r.id: r.file_count for r in done.runs.collect()} == {11: 1, 12: 2}
    assert {(r.ingestion_id, r.path) for r in done.files.collect()} == {(11, "a.py"), (12, "b.py"), (12, "c.py")}
    assert sorted((r.ingestion_id, r.file_path) for r in done.chunks.collect()) == [(11, "a.py"), (12, "b.py"), (12, "c.py")]


def test_profile_limits_fail_a_run_without_hiding_it(spark):
    df = spark.createDataFrame([(1, 11, pack(("r/a.py", b"x"), ("r/b.py", b"y")))], "repository_id int, ingestion_id int, content binary")
    done = ingest(df, None, F.lit("2026-01-01").cast("timestamp"), profile_files=1)
    run = done.runs.first()
    assert (run.status, run.file_count, done.files.count(), done.chunks.count()) == ("failed", 2, 2, 0)


def test_packing(spark):
    def packed(tokens, **limits):
        rows = spark.createDataFrame([(1, i, t) for i, t in enumerate(tokens)], "k int, position long, tokens long")
        return [r.batch for r in emb.pack_slices(rows, ["k"], **limits).orderBy("position").collect()]

    assert packed([6, 6, 6], most_tokens=10) == [0, 1, 2]
    assert packed([1, 1, 1], most_texts=2) == [0, 0, 1]
    assert packed([50, 1, 1, 50, 9], most_tokens=10) == [0, 1, 1, 2, 3]
    assert packed([1] * 5, slice_rows=2) == [0, 0, 0, 0, 0]


def test_spend_guard_lets_one_batch_cross(spark):
    rows = spark.createDataFrame([(1, i, 40) for i in range(5)], "run int, batch int, tokens int")
    got = emb.spend_guard(rows, ["run"], ["batch"], cap=100).orderBy("batch").collect()
    assert [r.allowed for r in got] == [True, True, True, False, False]


def test_hash_embedding_is_stable_and_of_unit_length(spark):
    fn = emb.hash_embedding(16)
    a, b = fn(["x", "y"])
    assert a == fn(["x"])[0] != b and abs(sum(v * v for v in a) - 1) < 1e-12
    rows = emb.embed(spark.createDataFrame([("x",), ("y",)], "t string"), "t", fn, batch=1).collect()
    assert {r.t: round(r.embedding[0], 5) for r in rows} == {"x": round(a[0], 5), "y": round(b[0], 5)}


def test_embedding_calls_are_bounded(spark):
    def fn(texts):
        assert len(texts) <= 3
        return [[float(len(texts))] for _ in texts]

    rows = emb.embed(spark.createDataFrame([(str(i),) for i in range(10)], "t string").coalesce(1), "t", fn, batch=3).collect()
    assert max(r.embedding[0] for r in rows) == 3.0
