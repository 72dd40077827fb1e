"""The pipeline's stages, each on what the one before kept, and the queries' registration."""

import random

import pytest
from pyspark.sql import functions as F

import __spark_entry__
import corpus_pipeline
from chronolith.llm import queries
from tests.llm.test_operators import covered, prose


@pytest.fixture(scope="module")
def stages(spark, tmp_path_factory):
    rng = random.Random(21)
    passage = prose(rng, 70, 3000)
    rows = [(i, prose(rng, 150, 3000), "en", f"s{i % 3}", 0) for i in range(60)]
    rows += [(100 + i, prose(rng, 90, 3000) + "\n" + passage + "\n" + prose(rng, 90, 3000), "en", "s0", 0) for i in range(5)]
    rows += [(200, rows[0][1], "en", "s1", 0), (201, rows[1][1].replace(rows[1][1].split()[40], "new", 1), "en", "s1", 0)]
    rows += [(300, "too short", "en", "s0", 0), (301, "again and again " * 60, "en", "s0", 0), (302, None, None, None, None), (None, prose(rng, 100, 3000), "en", None, 5), (0, rows[0][1], "en", "s0", 0)]
    root = tmp_path_factory.mktemp("pipeline")
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(str(root / "documents.parquet"))
    frames = [spark.read.parquet(str(root / "documents.parquet"))]
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, frames[-1], str(root)).write.parquet(str(root / str(k)))
        frames.append(spark.read.parquet(str(root / str(k))))
    return [f.collect() for f in frames], [f.columns for f in frames], root


def test_stages(stages):
    (docs, good, alone, rest, mixed, packed), columns, _ = stages
    assert all(c == list(corpus_pipeline.COLUMNS) for c in columns[:-1])
    ids = lambda rows: {r["doc_id"] for r in rows}
    assert ids(docs) - ids(good) == {300, 301, 302}
    assert ids(good) - ids(alone) == {200, 201} and len(alone) == len(ids(alone))
    want = covered([r["text"].encode() for r in sorted(alone, key=lambda r: (r["doc_id"] is None, r["doc_id"] or 0))], 100)
    kept = sorted(rest, key=lambda r: (r["doc_id"] is None, r["doc_id"] or 0))
    assert [len(r["text"].encode()) for r in kept] == [len(g) - sum(g) for g in want] and sum(map(sum, want)) > 1000
    texts = {(r["doc_id"], r["text"]) for r in rest}
    assert {(r["doc_id"], r["text"]) for r in mixed} <= texts and len(mixed) > 0
    assert ids(packed) == ids(mixed)


def test_run_is_the_stages_in_turn(spark, stages):
    frames, _, root = stages
    got = corpus_pipeline.run(spark, str(root))
    assert got.count() == len(frames[-1]) and got.agg(F.sum("length")).first()[0] == sum(r["length"] for r in frames[-1])


def test_stages_on_odd_tables(spark, tmp_path):
    """Each stage on an empty table, and on one with nulls, a very long text, a U+FFFD of its own, ties and columns with clashing names."""
    rng = random.Random(5)
    passage = "é" * 130 + prose(rng, 20, 3000)
    rows = [(i, prose(rng, 120, 3000), "en", "s", 0) for i in range(8)] + [(20, prose(rng, 20_000, 9000), None, None, None), (21, "\ufffd " + prose(rng, 80, 3000), "en", "s", 1)]
    rows += [(30 + i, prose(rng, 60, 3000) + "ab"[i] + passage, "en", "s", 0) for i in range(2)] + [(None, None, None, None, None), (0, "a", "en", "s", 0), (7, prose(rng, 90, 3000), "en", "s", 0)]
    names = ["tie", "rank", "kept", "grp", "marks", "label", "node", "size", "bucket", "copy", "nth"]
    schema = "doc_id long, text string, lang string, source string, n_chars long, " + ", ".join(f"{n} string" for n in names)
    for k, table in enumerate((rows, [])):
        docs = raw = spark.createDataFrame([(*r, *names) for r in table], schema)
        for j, (_, stage) in enumerate(corpus_pipeline.STAGES):
            path = str(tmp_path / f"{k}-{j}")
            stage(spark, docs, str(tmp_path)).write.parquet(path)
            docs = spark.read.parquet(path)
            assert (docs.count() > 0) == bool(table)
            if j < len(corpus_pipeline.STAGES) - 1:
                assert tuple(docs.columns) == corpus_pipeline.COLUMNS
        if table:
            text = {r["doc_id"]: r["text"] for r in corpus_pipeline.repeated_passages(spark, raw, "").collect()}
            assert text[21].startswith("\ufffd ") and "\ufffd" not in text[31] and len(text[20].split()) == 20_000 and len(text[31]) < len(text[30])


def test_registered():
    names = __spark_entry__.queries()
    assert [sum(n.startswith(f"op{k}_") for n in names) for k in range(1, 11)] == [1] * 10 and "pipeline" in names
    assert set(__spark_entry__.oracle_sql()) <= set(names) and set(queries.ORACLE_SQL) <= set(queries.QUERIES)
