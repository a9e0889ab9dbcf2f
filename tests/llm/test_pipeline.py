"""The pipeline stage by stage on planted documents, and the queries on the smallest tables."""

import random
from pathlib import Path

import duckdb
import pytest

import __spark_entry__ as entry
import corpus_pipeline
from check import compare
from riskweave.llm import registry

FOLDER = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for f in Path(FOLDER).glob("*.parquet"):
        c.execute(f"CREATE VIEW {f.stem} AS SELECT * FROM read_parquet('{f}')")
    return c


@pytest.mark.parametrize("name", sorted(registry.oracle_sql()))
def test_matches_sql(spark, con, name):
    assert compare(spark, FOLDER, con, name).startswith("ok")


def test_registered():
    names = set(registry.queries())
    assert {f"op{n}" for n in range(1, 14)} == {n.split("_")[0] for n in names if n != "pipeline"} and "pipeline" in names
    assert names <= set(entry.queries())
    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "exact_dedup", "simhash_near_dedup", "mixing", "byte_bpe"]


def test_planted_documents(spark, tmp_path):
    rng = random.Random(8)
    words = ["".join(rng.choices("abcdefghijklmnop", k=7)) for _ in range(4000)]
    texts = [" ".join(rng.choices(words, k=80)) for _ in range(240)]
    toxic = set(range(0, 60))
    texts = [f"idiot moron {t} idiot" if i in toxic else t for i, t in enumerate(texts)]
    texts[100] = texts[99].replace(" ", "\n\t")  # an exact copy but for white space
    texts[120:130] = [texts[119]] * 10
    long = " ".join(rng.choices(words, k=5000))
    texts[150], texts[151] = long, long.replace(words[0], "changed")
    texts[160], texts[161] = None, ""
    rows = [(i, t, "en", f"s{i % 3}" if i % 50 else None, len(t or "")) for i, t in enumerate(texts)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").repartition(3).write.parquet(f"{tmp_path}/documents.parquet")
    marks = [(i, 1, int(i in toxic)) for i in range(0, 240, 2)]
    spark.createDataFrame(marks, "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")

    docs, kept = spark.read.parquet(f"{tmp_path}/documents.parquet"), []
    for name, stage in corpus_pipeline.STAGES[:4]:
        out = stage(spark, docs, str(tmp_path))
        assert out.columns == docs.columns
        out.write.parquet(f"{tmp_path}/{name}")
        docs = spark.read.parquet(f"{tmp_path}/{name}")
        kept.append([r.doc_id for r in docs.select("doc_id").collect()])
    want = [i for i in range(240) if i not in toxic]
    assert sorted(kept[0]) == want
    want = [i for i in want if i not in {100, 161, *range(120, 130)}]
    assert sorted(kept[1]) == want
    want.remove(151)
    assert sorted(kept[2]) == want
    assert set(kept[3]) <= set(want)

    rows = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert sorted(r.doc_id for r in rows) == sorted(kept[3])
    assert all(r.round_trip and r.n_tokens == len(r.ids) for r in rows)
