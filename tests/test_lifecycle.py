from datetime import datetime as dt

from pyspark.sql import functions as F

from codelode import fixed
from codelode.operators import conversations, lifecycle
from codelode.sources import metadata, sinks
from codelode.streaming.index_stream import index_stream, read_index
from codelode.streaming.status_stream import run_status_stream

def now():
    return F.lit("2026-01-01").cast("timestamp")


def test_register(spark):
    known = spark.createDataFrame([(1, "https://github.com/a/b")], "owner_id int, github_url string")
    new = spark.createDataFrame(
        [(1, 1, "n", "https://github.com/a/b.git"), (2, 2, "n", "https://github.com/a/b/"), (3, 2, "n", "https://github.com/a/b"),
         (4, 1, "n", "https://example.com/a/b")],
        "request_id int, owner_id int, name string, github_url string",
    )
    accepted, rejected = lifecycle.register(known, new)
    assert [(r.request_id, r.full_name, r.status) for r in accepted.collect()] == [(2, "a/b", "pending")]
    assert {r.request_id: r.reason for r in rejected.collect()} == {1: "already_registered", 3: "already_registered", 4: "host"}


def test_sweep(spark):
    runs = spark.createDataFrame(
        [(1, 10, "ingesting", None), (2, 20, "completed", None), (3, 30, "ingesting", None), (4, 40, "failed", fixed.MSG_SWEPT)],
        "id int, repository_id int, status string, error_message string",
    )
    repos = spark.createDataFrame([(10, "analyzing"), (20, "analyzing"), (30, "ready"), (40, "analyzing")], "id int, status string")
    swept = lifecycle.sweep_runs(runs, now())
    assert {r.id: r.status for r in swept.collect()} == {1: "failed", 2: "completed", 3: "failed", 4: "failed"}
    assert lifecycle.sweep_count(swept).first().swept_count == 2
    got = {r.id: r.status for r in lifecycle.sweep_repositories(repos, swept).collect()}
    assert got == {10: "failed", 20: "analyzing", 30: "ready", 40: "failed"}
    calm = lifecycle.sweep_runs(runs.where("id in (2, 4)"), now())
    assert {r.id: r.status for r in lifecycle.sweep_repositories(repos, calm).collect()}[40] == "analyzing"


def test_sync(spark):
    schema = (
        "id int, github_repository_id long, github_owner string, name string, full_name string, github_url string, description string, "
        "primary_language string, status string, default_branch string, stars int, forks int, open_issues int, github_updated_at timestamp, last_synced_at timestamp"
    )
    row = lambda i: (i, None, None, "old", "o/old", "https://github.com/o/r.git", "d", "C", "pending", None, 1, 1, 1, None, None)
    repos = spark.createDataFrame([row(1), row(2), row(3)], schema)
    texts = spark.createDataFrame(
        [(1, '{"id": 5, "owner": {"login": "o"}, "name": "r", "full_name": "o/r", "default_branch": "main", "stargazers_count": 9}'), (2, "{broken")],
        "id int, body string",
    )
    got = {r.id: r for r in lifecycle.sync(repos, metadata.parse_repo_metadata(texts, "body"), now()).collect()}
    assert (got[1].status, got[1].name, got[1].stars, got[1].forks, got[1].primary_language) == ("ready", "r", 9, 0, None)
    assert got[1].github_url == "https://github.com/o/r" and got[1].last_synced_at is not None
    assert (got[2].status, got[2].name, got[2].stars) == ("failed", "old", 1)
    assert (got[3].status, got[3].last_synced_at) == ("pending", None)


def test_patch_never_clears(spark):
    repos = spark.createDataFrame([(1, "a", "d"), (2, "b", "e")], "id int, name string, description string")
    updates = spark.createDataFrame([(1, None, "new")], "id int, name string, description string")
    assert sorted(tuple(r) for r in lifecycle.patch(repos, updates).collect()) == [(1, "a", "new"), (2, "b", "e")]


def test_record_turns_and_touch(spark):
    evidence = "array<struct<chunk_id:int,file_path:string,start_line:int,end_line:int,language:string,name:string,score:double,chunk_text:string>>"
    answers = spark.createDataFrame(
        [(1, "q", "a", [(1, "f", 1, 2, None, None, 0.5, "t" * 900)], "m", 3, 4), (2, "q2", None, None, None, None, None)],
        f"conversation_id int, user_content string, answer string, evidence {evidence}, model string, input_tokens int, output_tokens int",
    )
    user, reply = conversations.record_turns(answers, now()).orderBy("position").collect()
    assert (user.role, user.content, user.evidence) == ("user", "q", None)
    assert (reply.role, reply.content, reply.model) == ("assistant", "a", "m") and len(reply.evidence[0].snippet) == 500
    talks = spark.createDataFrame([(1, None), (2, None)], "id int, updated_at timestamp")
    assert {r.id: r.updated_at for r in conversations.touch_conversations(talks, answers, now()).collect()} == {1: dt(2026, 1, 1), 2: None}


def test_replace_chunks(spark, tmp_path):
    target = str(tmp_path / "chunks")
    row = lambda repo, run, name: (repo, run, name)
    schema = "repository_id int, ingestion_id int, name string"
    sinks.replace_chunks(spark.createDataFrame([row(1, 1, "v1_func"), row(2, 1, "other")], schema), target)
    sinks.replace_chunks(spark.createDataFrame([row(1, 2, "v2_func"), row(1, 2, "helper")], schema), target)
    sinks.replace_chunks(spark.createDataFrame([], schema), target)
    assert {(r.repository_id, r.name) for r in spark.read.parquet(target).collect()} == {(1, "v2_func"), (1, "helper"), (2, "other")}


def test_run_log(spark, tmp_path):
    target = str(tmp_path / "runs")
    schema = "id int, repository_id int, status string, updated_at int"
    sinks.append_rows(spark.createDataFrame([(1, 1, "ingesting", 1), (2, 1, "ingesting", 1)], schema), target)
    sinks.append_rows(spark.createDataFrame([(1, 1, "completed", 2)], schema), target)
    assert {r.id: r.status for r in sinks.current_runs(spark, target).collect()} == {1: "completed", 2: "ingesting"}


def test_cascade_delete(spark):
    table = lambda rows, schema: spark.createDataFrame(rows, schema)
    kept = sinks.cascade_delete(
        table([(1,)], "repository_id int"), table([(1,), (2,)], "id int"), table([(5, 1), (6, 2)], "id int, repository_id int"),
        table([(1,), (2,)], "repository_id int"), table([(7, 1), (8, 2)], "id int, repository_id int"),
        table([(7,), (8,), (8,)], "conversation_id int"),
    )
    assert {k: v.count() for k, v in kept.items()} == {"repositories": 1, "runs": 1, "chunks": 1, "conversations": 1, "messages": 2}


def test_index_stream_keeps_all_batches_of_the_newest_run(spark, tmp_path):
    source, target, state = str(tmp_path / "in"), str(tmp_path / "out"), str(tmp_path / "state")
    schema = "repository_id int, ingestion_id int, file_path string, language string, text string"

    def arrive(*rows):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(source)
        stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(source)
        index_stream(stream, target, state).awaitTermination()
        return sorted((r.repository_id, r.ingestion_id, r.name) for r in read_index(spark, target).collect())

    assert arrive((1, 1, "a.md", "Markdown", "# A"), (2, 1, "x.md", "Markdown", "# X")) == [(1, 1, "A"), (2, 1, "X")]
    assert arrive((1, 1, "b.md", "Markdown", "# B")) == [(1, 1, "A"), (1, 1, "B"), (2, 1, "X")]
    assert arrive((1, 2, "a.md", "Markdown", "# C")) == [(1, 2, "C"), (2, 1, "X")]
    assert arrive((1, 2, "b.md", "Markdown", "# D")) == [(1, 2, "C"), (1, 2, "D"), (2, 1, "X")]
    # A stream that starts over replays its batches into the same folders.
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(source)
    index_stream(stream, target, state + "-again").awaitTermination()
    assert sorted(r.name for r in read_index(spark, target).where("repository_id = 1").collect()) == ["C", "D"]


def test_status_stream_equals_batch(spark, tmp_path):
    runs = spark.createDataFrame([(i, i % 3, "completed" if i % 4 else "failed", i // 2) for i in range(40)],
                                 "id int, repository_id int, status string, created_at int")
    source = str(tmp_path / "runs")
    runs.repartition(3).write.parquet(source)
    stream = spark.readStream.schema(runs.schema).option("maxFilesPerTrigger", 1).parquet(source)
    query = run_status_stream(stream).writeStream.outputMode("complete").format("memory").queryName("seen").trigger(availableNow=True).start()
    query.awaitTermination()
    key = lambda df: sorted(tuple(r) for r in df.collect())
    assert key(spark.table("seen")) == key(run_status_stream(runs))
