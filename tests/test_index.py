"""The stored posting lists: coded together, joined to lists before the shuffle."""

import io
import tarfile

import numpy as np
import pytest
from pyspark.sql import functions as F

from codelode.operators import inverted, keyword
from codelode.plans.ingest import ingest_into
from codelode.sources import commits
from codelode.sources.commits import CommitLog

CHUNK = "repository_id string, ingestion_id int, chunk_id long, file_path string, name string, chunk_text string"


def test_ids_further_apart_than_2_to_the_63_come_back():
    lists = [[-(2**63), 2**63 - 1], [-5, 3], [7], [], [-(2**63) + 1, 0, 2**62], list(range(0, 90_000, 300)), [0, 2**40]]
    for ids in lists:
        assert inverted.PostingList(*inverted.encode(np.array(ids, np.int64))).ids().tolist() == ids
    flat, ends = np.array([i for ids in lists for i in ids], np.int64), np.append(0, np.cumsum([len(ids) for ids in lists]))
    for ids, blocks, directory in zip(lists, *[c.to_pylist() for c in inverted.encode_lists(flat, ends)], strict=True):
        assert (blocks, directory) == inverted.encode(np.array(ids, np.int64))


def tar(files):
    payload = io.BytesIO()
    with tarfile.open(fileobj=payload, mode="w:gz") as out:
        for name, data in files.items():
            info = tarfile.TarInfo(name)
            info.size = len(data)
            out.addfile(info, io.BytesIO(data))
    return bytearray(payload.getvalue())


def chunks(spark):
    words = ["image", "images", "a/b.py", "naïve", "été", "log", "v1.2", "re-use", "end."]
    rows = [
        (f"r{i % 3}", i % 2, (i * 0x9E3779B97F4A7C15 + 2**63) % 2**64 - 2**63, f"d{i % 5}/f.py", None, " ".join(words[(i * j) % 9] for j in range(1, 8)))
        for i in range(200)
    ]
    rows += rows[:30] + [(None, 1, 1, "f.py", None, "lost"), ("r0", 1, None, "f.py", None, "log")]  # copies, no run, no id
    return spark.createDataFrame(rows, CHUNK).repartition(5)


@pytest.mark.parametrize("part", [2, 4_096])
def test_lists_hold_every_posting_once(spark, monkeypatch, part):
    monkeypatch.setattr(inverted, "PART", part)
    monkeypatch.setattr(inverted, "SHARD", 20)
    df = chunks(spark)
    rows = keyword.build_postings(df).where("chunk_id IS NOT NULL AND repository_id IS NOT NULL")
    sizes = df.groupBy(*inverted.SCOPE).agg(F.count(F.lit(1)).alias("n"))
    rows = rows.join(sizes, inverted.SCOPE).withColumn("shard", inverted.shard_of("chunk_id", "n"))
    columns = [*inverted.SCOPE, "match_key", "token", "shard"]
    wanted = {tuple(r[:-1]): sorted(r[-1]) for r in rows.groupBy(*columns).agg(F.collect_set("chunk_id")).collect()}
    for postings in (keyword.build_postings(df, by_chunk=True), keyword.build_postings(df)):
        found = inverted.posting_lists(postings, df).collect()
        assert len(found) == len(wanted) and all(r.n == len(wanted[tuple(r[:5])]) for r in found)
        assert {tuple(r[:5]): inverted.PostingList(r.blocks, r.directory).ids().tolist() for r in found} == wanted


def test_no_posting_is_a_row_of_the_shuffle(spark):
    df = chunks(spark)
    plan = inverted.posting_lists(keyword.build_postings(df, by_chunk=True), df)._jdf.queryExecution().executedPlan().toString()
    assert "Generate" not in plan and "collect_set" not in plan


def test_a_commit_reads_archives_once_and_chunks_as_written(spark, tmp_path):
    reads = spark.sparkContext.accumulator(0)

    def seen(batches):
        for batch in batches:
            reads.add(batch.num_rows)
            yield batch

    items = [("a", 1, tar({"m.txt": b"alpha one"})), ("b", 2, bytearray(b"no archive")), ("c", 3, tar({})), ("a", 4, tar({"x/m.txt": b"beta", "x/n.txt": b"two"}))]
    schema = "repository_id string, ingestion_id int, content binary"
    rows = spark.createDataFrame(items, schema).mapInArrow(seen, schema)
    log = CommitLog(spark, str(tmp_path))
    now = F.lit("2026-01-01 00:00:00").cast("timestamp")
    assert ingest_into(log, rows, None, now).collect() == []
    assert reads.value == len(items)
    runs = sorted(map(tuple, log.current("runs").select("id", "repository_id", "status", "file_count").collect()))
    assert runs == [(1, "a", "completed", 1), (2, "b", "failed", None), (3, "c", "completed", 0), (4, "a", "completed", 2)]
    chunks, lists = log.current("chunks"), log.current("postings")
    ids = {r.chunk_id for r in chunks.collect()}
    found = lists.collect()
    assert len(ids) == 3 and {i for r in found for i in inverted.PostingList(r.blocks, r.directory).ids().tolist()} == ids
    log.compact()
    assert sorted(map(str, log.current("postings").collect())) == sorted(map(str, found))


def test_compaction_shuffles_no_rows(spark, tmp_path, monkeypatch):
    log, plans = CommitLog(spark, str(tmp_path)), []
    rows = spark.createDataFrame([("a", 1, "x"), ("b", 2, "z")], "repository_id string, ingestion_id int, chunk_text string")
    log.commit({"chunks": rows})
    log.commit({"chunks": rows.where("repository_id = 'a'")}, gone=rows.where("repository_id = 'b'"))
    write = commits._write

    def noted(df, path, mode="errorifexists"):
        if "/data/chunks/" in path:
            plans.append(df._jdf.queryExecution().optimizedPlan().toString())
        write(df, path, mode)

    monkeypatch.setattr(commits, "_write", noted)
    log.compact()
    assert len(plans) == 1 and "Rebalance" not in plans[0] and [tuple(r) for r in log.current("chunks").collect()] == [("a", 1, "x")]
