from __future__ import annotations

import duckdb
import pytest
import sentencepiece

import corpus_pipeline
from logtide.llm.queries import ORACLE, QUERIES, tokenizer_file

FOLDER = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_same_rows_as_sql(spark, name):
    con = duckdb.connect()
    for table in ("documents", "benchmark", "labels", "embeddings"):
        con.execute(f"CREATE VIEW {table} AS SELECT * FROM '{FOLDER}/{table}.parquet'")
    result = con.execute(ORACLE[name])
    columns = [c[0] for c in result.description]
    mine = QUERIES[name](spark, FOLDER)
    assert sorted(columns) == sorted(mine.columns)
    assert sorted(map(tuple, mine.select(columns).collect())) == sorted(result.fetchall())


def test_registered_names():
    assert sorted(int(name[2:].split("_")[0]) for name in QUERIES) == list(range(1, 14))


@pytest.fixture(scope="module")
def stages(spark, tmp_path_factory):
    """Every stage's input and output, written and read again."""
    docs, out = spark.read.parquet(f"{FOLDER}/documents.parquet"), []
    for name, stage in corpus_pipeline.STAGES:
        path = str(tmp_path_factory.mktemp("stage") / name)
        stage(spark, docs, FOLDER).write.parquet(path)
        after = spark.read.parquet(path)
        out.append((name, docs, after))
        docs = after
    return out


def test_all_but_the_last_return_the_columns_of_documents(stages):
    assert [name for name, _, _ in stages] == ["toxicity", "line_dedup", "near_dedup", "decontaminate", "tokenize"]
    for _, before, after in stages[:-1]:
        assert [(f.name, f.dataType) for f in after.schema] == [(f.name, f.dataType) for f in before.schema]


def test_stages_against_brute_force(spark, stages):
    from llm.test_decontaminate import brute as contaminated
    from llm.test_jaccard import groups
    from llm.test_line_dedup_short import brute as cleaned

    rows = {name: ({r.doc_id: r for r in before.collect()}, {r.doc_id: r for r in after.collect()}) for name, before, after in stages}
    labels = {r.doc_id: r.toxic for r in spark.read.parquet(f"{FOLDER}/labels.parquet").collect()}
    before, after = rows["toxicity"]
    assert set(after) <= set(before) and all(after[i] == before[i] for i in after)
    clean = [i for i in before if labels.get(i) == 0]
    assert len([i for i in clean if i in after]) > 0.95 * len(clean)

    before, after = rows["line_dedup"]
    assert {i: r.text for i, r in after.items()} == cleaned([(i, r.text) for i, r in before.items()])

    before, after = rows["near_dedup"]
    kept = set(groups({i: r.text for i, r in before.items()}).values())
    assert set(after) == kept and all(after[i] == before[i] for i in after)

    before, after = rows["decontaminate"]
    items = [tuple(r) for r in spark.read.parquet(f"{FOLDER}/benchmark.parquet").select("item_id", "text").collect()]
    hit = contaminated([(i, r.text) for i, r in before.items()], items)
    assert set(after) == {i for i in before if not hit[i][4]} and all(after[i] == before[i] for i in after)

    before, after = rows["tokenize"]
    library = sentencepiece.SentencePieceProcessor(model_proto=tokenizer_file())
    assert {i: list(r.ids) for i, r in after.items()} == {i: library.encode(r.text or "") for i, r in before.items()}


def test_run_applies_all_stages(spark, stages):
    last = stages[-1][2]
    assert sorted(map(tuple, corpus_pipeline.run(spark, FOLDER).collect())) == sorted(map(tuple, last.collect()))


def test_stages_take_odd_rows(spark, make_docs):
    docs = make_docs([(1, None), (2, ""), (3, "x " * 20_000), (4, "to\nbe\nor\nnot"), (5, "to\nbe\nor\nnot"), (None, None)])
    for _, stage in corpus_pipeline.STAGES:
        for table in (docs, docs.limit(0)):
            stage(spark, table, FOLDER).collect()
