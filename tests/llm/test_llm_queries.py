"""Every registered query of the subpackage at the smallest size, and the pipeline against brute force."""

import pytest

import corpus_pipeline
from spindrift.llm import language_id, quality, queries
from spindrift.llm.tokens import default_path

from ..oracle import by_spark, by_sql
from .test_duplicates import brute_groups

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(queries.QUERIES))
def test_query(spark, name):
    got = by_spark(queries.QUERIES[name](spark, SF))
    assert got[1]
    if name in queries.ORACLES:
        assert got == by_sql(queries.ORACLES[name], SF)


def test_registered_in_the_entry():
    import __spark_entry__ as entry

    assert {*queries.QUERIES, "pipeline"} <= set(entry.queries())
    assert set(queries.ORACLES) <= set(entry.oracle_sql())


def test_pipeline_against_brute_force(spark):
    """Each stage is held against its meaning on its own input, in plain Python."""
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns = docs.columns
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    current = docs
    kept = {}
    for name, stage in corpus_pipeline.STAGES:
        before = {r["doc_id"]: r for r in current.collect()}
        out = stage(spark, current, SF)
        rows = out.collect()
        if name == "quality":
            model = quality.train(current, labels, 5, 0)
            expected = {i for i, r in before.items() if round(float(model.scores([r["text"] or ""])[0]), 6) >= quality.THRESHOLD}
        elif name == "language":
            model = language_id.train(current, 3, 1)
            expected = set()
            for i, r in before.items():
                score = model.scores([r["text"]]).clip(0, 1)[0] if any(c.isalpha() for c in r["text"] or "") else None
                if score is not None and round(score.max() / max(score.sum(), 1e-300), 6) >= corpus_pipeline.LEAST_LANGUAGE:
                    expected.add(i)
        elif name == "near_duplicates":
            ids = sorted(before)
            expected = {c for _, _, c in brute_groups(ids, [before[i]["text"] for i in ids])}
        else:
            from tokenizers import Tokenizer

            library = Tokenizer.from_file(default_path("word_bpe_49k.json"))
            lengths = {i: len(library.encode(r["text"] or "", add_special_tokens=False).ids) + 1 for i, r in before.items()}
            got = {}
            for r in rows:
                got[r["doc_id"]] = got.get(r["doc_id"], 0) + r["length"]
            assert got == lengths
            continue
        assert out.columns == columns
        assert {r["doc_id"] for r in rows} == expected
        kept[name] = len(rows)
        current = out
    assert kept["near_duplicates"] < kept["language"] <= kept["quality"] < len(docs.collect())


def test_run_applies_the_stages(spark):
    rows = corpus_pipeline.run(spark, SF).collect()
    assert rows and {"sequence_id", "offset", "doc_id"} <= set(rows[0].asDict())


def test_stages_take_empty_and_odd_tables(spark, tmp_path):
    from .fixtures import documents, empty

    spark.createDataFrame([(5, 1, 0), (6, 0, 0), (None, 1, 0)], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    for docs in (empty(spark), documents(spark)):
        for name, stage in corpus_pipeline.STAGES:
            docs = stage(spark, docs, str(tmp_path)) if name != "packing" else docs
        assert corpus_pipeline.STAGES[-1][1](spark, docs, str(tmp_path)).count() >= 0


def test_stages_keep_columns_with_names_of_their_own(spark):
    """Values of columns named as the stages name theirs come through all stages but the last unchanged."""
    names = ("score", "lang_pred", "_id", "_n", "_maybe", "_kept", "component_id", "n_shingles", "column_0")
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    docs = docs.withColumns({c: (docs["doc_id"] * (i + 2)).cast("string") for i, c in enumerate(names)})
    for _, stage in corpus_pipeline.STAGES[:3]:
        docs = stage(spark, docs, SF)
    rows = docs.collect()
    assert rows and docs.columns[-len(names) :] == list(names)
    assert all(r[c] == str(r["doc_id"] * (i + 2)) for r in rows for i, c in enumerate(names))
    assert corpus_pipeline.STAGES[3][1](spark, docs, SF).count() >= len(rows)
