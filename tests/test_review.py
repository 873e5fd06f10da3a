import json

from codelode.operators import review


def parse(spark, *texts):
    df = spark.createDataFrame(list(enumerate(texts)), "query_id int, text string")
    return review.parse_review(df)


def test_fences_and_fallbacks(spark):
    good = json.dumps({"summary": "Fine", "findings": []})
    texts = [f"```json\n{good}\n```", f"  {good} ", f"```\n{good}\n```", " not json ", "[1]", '{"summary": 3}', '{"summary": "  "}', "null"]
    got = [r.summary for r in parse(spark, *texts).orderBy("query_id").collect()]
    assert got == ["Fine", "Fine", "Fine", "not json", "[1]", '{"summary": 3}', '{"summary": "  "}', "null"]


def test_findings_are_type_strict(spark):
    body = {
        "findings": [
            {"title": "A", "severity": 3, "category": "bug", "start_line": 5, "end_line": "6", "evidence_sources": [2, 1, 0, 9, True, "1", 1.5]},
            {"title": ""}, {"title": 4}, "x", None, {"severity": "low"},
            {"title": "B", "start_line": True, "end_line": 2.5, "explanation": " ", "evidence_sources": "1"},
        ]
    }
    rows = review.explode_findings(parse(spark, json.dumps(body))).orderBy("item").collect()
    assert [r.title for r in rows] == ["A", "B"]
    a, b = rows
    assert (a.severity, a.category, a.start_line, a.end_line, a.evidence_sources) == (None, "bug", 5, None, [2, 1, 0, 9])
    assert (b.start_line, b.end_line, b.explanation, b.evidence_sources) == (None, None, None, [])


def test_cards_cite_in_the_order_given(spark):
    body = {"findings": [{"title": "A", "file_path": "a.py", "start_line": 2, "end_line": 2, "evidence_sources": [2, 1, 7]}, {"title": "B"}]}
    evidence = spark.createDataFrame(
        [(0, 1, 11, "x.py", 1, 2), (0, 2, 22, "y.py", 3, 4)],
        "query_id int, evidence_rank int, chunk_id int, file_path string, start_line int, end_line int",
    )
    found = review.explode_findings(parse(spark, json.dumps(body)))
    a, b = review.finding_cards(found, evidence).orderBy("item").collect()
    assert a.location == "a.py:2" and a.evidence_chunk_ids == ["22", "11"] and a.supported_by == ["y.py:3-4", "x.py:1-2"]
    assert b.location is None and b.supported_by == []


def test_findings_that_are_no_list(spark):
    assert review.explode_findings(parse(spark, '{"findings": {"title": "x"}}', '{"summary": "s"}', "prose")).count() == 0
