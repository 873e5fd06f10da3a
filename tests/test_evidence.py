from pyspark.sql import functions as F

from codelode.operators import evidence as ev, ranking

RESULT = (
    "query_id int, chunk_id int, file_path string, start_line int, end_line int, language string, name string, chunk_text string, "
    "score double"
)
MESSAGE = "id int, conversation_id int, role string, content string, created_at int"


def result(chunk, score, text="code", query=1, name=None):
    return (query, chunk, f"f{chunk}.py", 1, 5, "Python", name, text, score)


def build(spark, results, question="Why?", messages=None, required=True, **options):
    rows = spark.createDataFrame(results, RESULT)
    asked = spark.createDataFrame([(1, question, 7, required)], "query_id int, question string, conversation_id int, requires_evidence boolean")
    said = None if messages is None else spark.createDataFrame(messages, MESSAGE)
    return ev.build_context(rows, asked, said, system_text="Be exact.", **options).first()


def test_selection_filters_dedups_and_orders(spark):
    rows = [result(3, 0.5), result(1, 0.5), result(2, 0.1), result(4, 0.9, " \n"), result(1, 0.7), result(5, 0.11)]
    got = ev.select_evidence(spark.createDataFrame(rows, RESULT)).orderBy("evidence_rank").collect()
    assert [(r.chunk_id, r.score, r.evidence_rank) for r in got] == [(1, 0.7, 1), (3, 0.5, 2), (5, 0.11, 3)]


def test_context_text(spark):
    row = build(spark, [result(1, 0.5, "x = 1", name="f"), result(2, 0.25, "y")])
    assert [m.role for m in row.messages] == ["system", "user"]
    assert row.messages[1].content == (
        "Repository evidence:\n\n[Source 1: f1.py:1-5, language=Python, symbol=f, score=0.50]\nx = 1\n\n"
        "[Source 2: f2.py:1-5, language=Python, score=0.25]\ny\n\n---\n\nQuestion: Why?"
    )


def test_budget_stops_at_the_first_overflow(spark):
    row = build(spark, [result(1, 0.9, "small"), result(2, 0.8, "z" * 4000), result(3, 0.7, "small")], budget=200)
    assert row.status == "ready" and [e.chunk_id for e in row.evidence] == [1]
    assert build(spark, [result(2, 0.8, "z" * 4000)], budget=200).status == "insufficient_evidence"


def test_status_order(spark):
    assert build(spark, [result(1, 0.05)], question="q" * 9000, budget=100).status == "insufficient_evidence"
    assert build(spark, [result(1, 0.5)], question="q" * 9000, budget=100).status == "context_overflow"
    free = build(spark, [result(1, 0.05)], required=False)
    assert free.status == "ready" and free.messages[-1].content == "Question: Why?"


def test_history_keeps_the_newest_in_reading_order(spark):
    said = [(i, 7, "user" if i % 2 else "assistant", f"m{i}", i // 2) for i in range(1, 5)]
    row = build(spark, [result(1, 0.5)], messages=said, most_history=2)
    assert [m.content for m in row.messages[1:-1]] == ["m3", "m4"]
    assert row.history_used == 2
    assert build(spark, [result(1, 0.5)], messages=said, most_history=0).history_used == 0


def test_history_gives_way_to_the_budget(spark):
    said = [(1, 7, "user", "old", 1), (2, 7, "assistant", "n" * 400, 2), (3, 7, "user", "new", 3)]
    row = build(spark, [result(1, 0.5)], messages=said, budget=90)
    assert [m.content for m in row.messages[1:-1]] == ["new"]


def test_running_total_over_a_hot_key(spark):
    rows = spark.range(3000).select(
        F.when(F.col("id") % 3 == 0, F.col("id") % 50).otherwise(-1).alias("k"), "id", (F.col("id") * 7 % 11).alias("v")
    )
    got = ranking.running_total(rows, ["k"], ["id"], F.col("v"), "before").orderBy("id").collect()
    spent = {}
    for r in got:
        assert r.before == spent.get(r.k, 0)
        spent[r.k] = r.before + r.v
    places = ranking.position(rows, ["k"], ["id"]).where("k = -1").orderBy("id").collect()
    assert [r.position for r in places] == list(range(2000))


def test_recent_runs(spark):
    runs = spark.createDataFrame([(i, 1, i // 2) for i in range(8)] + [(9, 2, 1)], "id int, repository_id int, created_at int")
    got = ranking.recent_runs(runs).orderBy("repository_id", "rank").collect()
    assert [(r.repository_id, r.id, r.hidden_count) for r in got] == [(1, 7, 3), (1, 6, 3), (1, 5, 3), (1, 4, 3), (1, 3, 3), (2, 9, 0)]


def test_snapshot_is_bounded(spark):
    rows = spark.createDataFrame([result(1, 0.5, "x" * 5000)], RESULT)
    one = F.struct("chunk_id", *ev.CHUNK_COLUMNS)
    stored = rows.select(ev.evidence_snapshot(F.array(one)).alias("e")).first().e[0]
    assert len(stored.snippet) == 500 and stored.chunk_id == 1


def test_evidence_view(spark):
    live = spark.createDataFrame([result(1, 0.5)], RESULT).withColumn("retrieval_sources", F.array(F.lit("semantic")))
    stored = spark.createDataFrame([result(2, 0.4)], RESULT).withColumn("snippet", F.lit("cut"))
    got = {r.chunk_id: (r.text, r.retrieval_sources) for r in ev.evidence_view(live, stored).collect()}
    assert got == {1: ("code", ["semantic"]), 2: ("cut", None)}
