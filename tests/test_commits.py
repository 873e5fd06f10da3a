"""The commit log: all or nothing, tombstones, compaction, and ingest into it."""

import io
import tarfile

import pytest
from pyspark.sql import functions as F

from codelode.operators import inverted, keyword
from codelode.plans.ingest import ingest_into
from codelode.sources import commits
from codelode.sources.commits import CommitLog

now = lambda: F.lit("2026-01-01 00:00:00").cast("timestamp")


def rows(df, *columns):
    return sorted(map(tuple, df.select(*columns).collect()))


def chunk_rows(spark, items):
    return spark.createDataFrame(items, "repository_id string, ingestion_id int, chunk_text string")


def run_rows(spark, items):
    return spark.createDataFrame(items, "id int, repository_id string, status string")


def first_state(spark, path):
    log = CommitLog(spark, path)
    log.commit({
        "runs": run_rows(spark, [(1, "a", "completed"), (2, "b", "completed"), (3, "007", "ingesting")]),
        "chunks": chunk_rows(spark, [("a", 1, "x"), ("a", 1, "y"), ("b", 2, "z"), ("007", 3, "w")]),
    })
    return log


def state(log):
    return rows(log.current("runs"), "id", "repository_id", "status"), rows(log.current("chunks"), "repository_id", "ingestion_id", "chunk_text")


def test_a_commit_changes_several_tables_and_repositories(spark, tmp_path):
    log = first_state(spark, str(tmp_path))
    log.commit({
        "runs": run_rows(spark, [(3, "007", "failed"), (4, "a", "completed")]),
        "chunks": chunk_rows(spark, [("a", 4, "new")]),
    })
    assert state(log) == (
        [(1, "a", "completed"), (2, "b", "completed"), (3, "007", "failed"), (4, "a", "completed")],
        [("007", 3, "w"), ("a", 4, "new"), ("b", 2, "z")],
    )
    log.commit({"chunks": chunk_rows(spark, [])})  # a run without chunks replaces nothing
    assert len(state(log)[1]) == 3


@pytest.mark.parametrize("fails_at", range(5))
def test_a_crash_between_any_two_writes_leaves_the_old_state(spark, tmp_path, monkeypatch, fails_at):
    log = first_state(spark, str(tmp_path))
    before, write, done = state(log), commits._write, []

    def broken(df, path, mode="errorifexists"):
        if len(done) == fails_at:
            raise OSError("lost the machine")
        done.append(path)
        write(df, path, mode)

    monkeypatch.setattr(commits, "_write", broken)
    change = {"runs": run_rows(spark, [(9, "a", "failed")]), "chunks": chunk_rows(spark, [("b", 9, "half")])}
    with pytest.raises(OSError):
        log.commit(change, gone=spark.createDataFrame([("a",)], "repository_id string"))
    assert state(log) == before
    monkeypatch.setattr(commits, "_write", write)
    log.commit(change)  # and the same commit goes through afterwards
    assert (9, "a", "failed") in state(log)[0] and ("b", 9, "half") in state(log)[1]


def test_tombstones_end_with_later_rows(spark, tmp_path):
    log = first_state(spark, str(tmp_path))
    log.commit({
        "conversations": spark.createDataFrame([(10, "a"), (11, "b")], "id int, repository_id string"),
        "messages": spark.createDataFrame([(1, 10), (2, 11), (3, 99)], "id int, conversation_id int"),
    })
    log.commit({}, gone=spark.createDataFrame([("a",), ("zz",)], "repository_id string"))
    assert state(log) == ([(2, "b", "completed"), (3, "007", "ingesting")], [("007", 3, "w"), ("b", 2, "z")])
    assert rows(log.current("conversations"), "id") == [(11,)] and rows(log.current("messages"), "id") == [(2,), (3,)]
    log.commit({"runs": run_rows(spark, [(5, "a", "completed")]), "chunks": chunk_rows(spark, [("a", 5, "back")])})
    assert (5, "a", "completed") in state(log)[0] and (1, "a", "completed") not in state(log)[0]
    assert ("a", 5, "back") in state(log)[1]


def test_compaction_keeps_the_state_and_reads_its_own_folders_only(spark, tmp_path):
    log = first_state(spark, str(tmp_path))
    log.commit({"chunks": chunk_rows(spark, [("a", 4, "new")])})
    log.commit({}, gone=spark.createDataFrame([("b",)], "repository_id string"))
    before = state(log)
    log.compact()
    assert len(log.visible()) == 1 and state(log) == before
    files = log.current("chunks").inputFiles()
    assert len({f.split("/chunks/")[1].split("/")[0] for f in files}) == 1
    log.commit({"chunks": chunk_rows(spark, [("a", 6, "newer")])})
    assert ("a", 6, "newer") in state(log)[1] and ("a", 4, "new") not in state(log)[1]


def test_nothing_committed(spark, tmp_path):
    with pytest.raises(LookupError):
        CommitLog(spark, str(tmp_path / "none")).current("chunks")


def tar(files):
    payload = io.BytesIO()
    with tarfile.open(fileobj=payload, mode="w:gz") as out:
        for name, data in files.items():
            info = tarfile.TarInfo(name)
            info.size = len(data)
            out.addfile(info, io.BytesIO(data))
    return bytearray(payload.getvalue())


def archives(spark, items):
    return spark.createDataFrame(items, "repository_id string, ingestion_id int, content binary")


def picky_embedder():
    def picky(texts):
        if any("unlucky" in t for t in texts):
            raise RuntimeError("no vector for this")
        return [[float(len(t)), 1.0] for t in texts]

    return picky


def test_a_failed_embedding_leaves_the_run_completed_without_chunks(spark, tmp_path):
    log = CommitLog(spark, str(tmp_path))
    first = [("a", 1, tar({"m.txt": b"alpha one"})), ("b", 2, tar({"m.txt": b"beta two"})), ("c", 3, bytearray(b"no archive"))]
    assert ingest_into(log, archives(spark, first), picky_embedder(), now()).collect() == []
    assert rows(log.current("repository_status"), "repository_id", "status") == [("a", "ready"), ("b", "ready"), ("c", "failed")]
    second = [("a", 4, tar({"m.txt": b"an unlucky text"})), ("b", 5, tar({"m.txt": b"beta three"}))]
    failed = ingest_into(log, archives(spark, second).repartition(2, "repository_id"), picky_embedder(), now()).collect()
    assert ("a", 4, "RuntimeError: no vector for this") in [tuple(r) for r in failed]
    done = {r["id"]: r["status"] for r in log.current("runs").collect()}
    assert done == {1: "completed", 2: "completed", 3: "failed", 4: "completed", 5: "completed"}
    kept = rows(log.current("chunks"), "repository_id", "ingestion_id", "chunk_text")
    assert ("a", 1, "alpha one") in kept and ("a", 4, "an unlucky text") not in kept
    if len(failed) == 1:
        assert ("b", 5, "beta three") in kept and ("b", 2, "beta two") not in kept


def test_ingest_keeps_the_index_up_to_date(spark, tmp_path):
    log = CommitLog(spark, str(tmp_path))
    ingest_into(log, archives(spark, [("a", 1, tar({"m.txt": b"alpha words"})), ("b", 2, tar({"m.txt": b"beta words"}))]), None, now())
    ingest_into(log, archives(spark, [("a", 3, tar({"m.txt": b"gamma words", "n.txt": b"gamma gamma alpha"}))]), None, now())
    chunks = log.current("chunks")
    asked = spark.createDataFrame(
        [(1, "a", 3, "alpha gamma"), (2, "b", 2, "words"), (3, "a", 1, "alpha")], "query_id long, repository_id string, ingestion_id int, query string"
    ).select("*", F.lit(10).alias("candidate_k"), F.lit(None).cast("array<string>").alias("file_extensions"), F.lit(None).cast("array<string>").alias("file_paths"))
    order = lambda df: sorted(map(tuple, df.collect()))
    found = order(keyword.keyword_search(asked, chunks.withColumn("chunk_text", F.lit("")), index=log.current("postings")))
    assert found == order(keyword.keyword_search(asked, chunks)) and {q for q, *_ in found} == {1, 2}
    assert log.current("postings").select("repository_id", "ingestion_id").distinct().count() == 2
    assert inverted.SCOPE == keyword.SCOPE
