"""The pipeline's stages, each against what its operator says of its input."""

from collections import Counter

import corpus_pipeline
import pytest
from helpers import SF
from tokenizers import Tokenizer

from codelode.llm import lines, mixing, queries, simhash, toxicity


@pytest.fixture(scope="module")
def stages(spark, tmp_path_factory):
    folder = tmp_path_factory.mktemp("stages")
    docs = [spark.read.parquet(f"{SF}/documents.parquet")]
    for name, stage in corpus_pipeline.STAGES:
        stage(spark, docs[-1], SF).write.parquet(f"{folder}/{name}")
        docs.append(spark.read.parquet(f"{folder}/{name}"))
    return docs


def texts(df):
    return {r["doc_id"]: r["text"] for r in df.collect()}


def test_near_copies_broadcast_no_keys(spark, monkeypatch):
    """A few MB of fingerprints become 64 times as many keys, which the driver could not build a broadcast of."""
    plans, components = [], simhash.components

    def seen(edges):
        found = components(edges)
        plans.append(edges._jdf.queryExecution().executedPlan().toString())
        return found

    monkeypatch.setattr(simhash, "components", seen)
    corpus_pipeline.drop_near_copies(spark, spark.read.parquet(f"{SF}/documents.parquet"), SF).collect()
    assert len(plans) == 1 and "Generate explode" in plans[0] and "Broadcast" not in plans[0]


def test_toxic_documents_go(spark, stages):
    scores = toxicity.score_documents(stages[0], spark.read.parquet(f"{SF}/labels.parquet")).collect()
    assert texts(stages[1]).keys() == {r["doc_id"] for r in scores if not r["predicted"]}
    assert stages[1].columns == stages[0].columns == stages[2].columns == stages[3].columns == stages[4].columns


def test_lines_go(stages):
    found = {r["doc_id"]: r for r in lines.dedup_lines(stages[1]).collect()}
    kept = texts(stages[2])
    assert all(found[d]["text"] == t for d, t in kept.items())
    assert all(found[d]["n_kept"] < found[d]["n_lines"] and not found[d]["text"].strip() for d in found.keys() - kept.keys())
    assert all(r["n_chars"] == len(r["text"]) for r in stages[2].collect())


def test_one_of_a_group_stays(stages):
    rows = simhash.near_duplicates(stages[2]).collect()
    assert texts(stages[3]).keys() == {r["component_id"] for r in rows}


def test_mix(stages):
    want = {r["doc_id"]: r["copies"] for r in mixing.mix(stages[3]).collect()}
    assert Counter(r["doc_id"] for r in stages[4].collect()) == +Counter(want)


def test_ids(stages):
    library = Tokenizer.from_file(queries.tokenizer_file())
    want = Counter((r["doc_id"], tuple(library.encode(r["text"], add_special_tokens=False).ids)) for r in stages[4].collect())
    assert Counter((r["doc_id"], tuple(r["ids"])) for r in stages[5].collect()) == want


def test_run(spark, stages):
    assert Counter(map(str, corpus_pipeline.run(spark, SF).collect())) == Counter(map(str, stages[5].collect()))
