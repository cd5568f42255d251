"""Each stage of the pipeline on its own input, against brute force."""

import re

import corpus_pipeline
from tests.llm.test_operators import SF, brute_components, rows
from tiepoints.llm import secrets


def test_stages(spark, tmp_path):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns, kept = docs.columns, {}
    for i, (name, stage) in enumerate(corpus_pipeline.STAGES):
        before = rows(docs)
        stage(spark, docs, SF).write.parquet(str(tmp_path / str(i)))
        docs = spark.read.parquet(str(tmp_path / str(i)))
        kept[name] = (before, rows(docs))
        if i < len(corpus_pipeline.STAGES) - 1:
            assert docs.columns == columns

    before, after = kept["toxicity"]
    toxic = {r["doc_id"] for r in spark.read.parquet(f"{SF}/labels.parquet").where("toxic = 1").collect()}
    assert 0 < len(after) < len(before) and not toxic & set(after)

    before, after = kept["near-duplicates"]
    expected = brute_components({d: r["text"] for d, r in before.items()}, 5, 80, 100)
    assert set(after) == {d for d, (_, top) in expected.items() if top == d}

    before, after = kept["decontamination"]
    word = re.compile(r"[^\W_]+")
    grams = lambda t: {tuple(w[i : i + 5]) for w in [word.findall(t.lower())] for i in range(len(w) - 4)}
    items = [grams(r["text"]) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    dirty = {d for d, r in before.items() if any(5 * len(grams(r["text"]) & x) >= 4 * len(x) > 0 for x in items)}
    assert dirty and set(after) == set(before) - dirty

    before, after = kept["secrets"]
    assert set(after) == set(before)
    for d, r in after.items():
        found = secrets.spans_of(before[d]["text"])
        assert (r["text"] != before[d]["text"]) == bool(found) and not secrets.spans_of(r["text"])
        assert r["n_chars"] == (len(r["text"]) if found else before[d]["n_chars"])

    before, after = kept["bpe"]
    assert set(after) == set(before) and all(r["n_tokens"] > 0 for r in after.values())
