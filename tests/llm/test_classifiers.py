"""Classifiers by held-out accuracy and by hand-made chains; neighbours against brute force."""

import inspect
import random

import numpy as np
import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from riskweave.llm import neighbours, quality, toxicity
from riskweave.llm.common import numbered
from riskweave.llm.queries import op2_quality
from riskweave.llm.training import labelled_sample

WORDS = ["".join(random.Random(i).choices("abcdefghijklmnop", k=6)) for i in range(300)]


def labels(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, quality int, toxic int")


def prose(rng, n=60):
    return " ".join(rng.choices(WORDS, k=n)).capitalize() + "."


def test_quality_ranks_held_out_rows(spark, docs):
    rng = random.Random(1)
    texts, marks = [], []
    for i in range(160):
        bad = i % 4 == 0
        text = prose(rng)
        texts.append(rng.choice([text.upper() + "!!", " ".join(w + "###" for w in text.split()), (text.split()[0] + " ") * 60]) if bad else text)
        marks.append((i, int(not bad), 0))
    model = quality.fit(labelled_sample(docs(texts), labels(spark, marks), "doc_id", "text", "quality", where=F.col("doc_id") < 100))
    scores = {r.doc_id: r.s for r in docs([*texts, None, ""]).select("doc_id", model.score("text").alias("s")).collect()}
    held = [(scores[i] >= 0.5) == bool(q) for i, q, _ in marks if i >= 100]
    assert np.mean(held) > 0.95 and all(0 <= s <= 1 for s in scores.values())
    assert scores[160] == scores[161]


@pytest.mark.parametrize("marks", [[], [(0, 1, 0), (1, 1, 0)], [(None, 1, 0), (0, None, None), (1, 5, 7)]])
def test_quality_without_two_labels(spark, docs, marks):
    model = quality.fit(labelled_sample(docs(["a", "b", None]), labels(spark, marks), "doc_id", "text", "quality"))
    assert {r.s for r in docs(["a", None]).select(model.score("text").alias("s")).collect()} == {0.5}


def test_sample_is_bounded_and_clean(spark, docs):
    marks = [(i, i % 2, 0) for i in range(50)] + [(1, 0, 0), (None, 1, 1)]
    rows = labelled_sample(docs([None] * 50), labels(spark, marks), "doc_id", "text", "quality", rows=20).collect()
    assert len(rows) == len({r.key for r in rows}) == 20 and {r.text for r in rows} == {""}
    assert all(r.label == (0 if r.key == 1 else r.key % 2) for r in rows)


def test_quality_query_learns_from_all_labelled_rows(spark, docs, monkeypatch, tmp_path):
    """However few rows a sample may hold."""
    from riskweave.llm import training

    monkeypatch.setattr(training.labelled_sample, "__defaults__", (10, None))
    docs(["a b c"] * 30).drop("ids").write.parquet(str(tmp_path / "documents.parquet"))
    labels(spark, [(i, i % 2, 0) for i in range(30)]).write.parquet(str(tmp_path / "labels.parquet"))
    seen = []
    monkeypatch.setattr(quality, "fit", lambda rows: seen.append(rows.count()) or quality.Ranking((0.0,) * quality.WIDTH, 0.0))
    rows = op2_quality(spark, str(tmp_path)).collect()
    assert len(rows) == 30 and seen == [sum(not r.held_out for r in rows)] and seen[0] > 10


def test_places_in_a_global_order(spark):
    rows = spark.range(1000).select("id", (F.col("id") * 7919 % 1000).alias("v"))
    got = numbered(rows.repartition(7), "i", "v").collect()
    assert len(got) == 1000 and all(r.i == r.v for r in got)
    assert numbered(rows.where("id < 0"), "i", "v").count() == 0


@pytest.fixture(scope="module")
def chain_rows():
    rng = random.Random(3)
    rows = []
    for i in range(600):
        text = prose(rng, 30)
        toxic = i % 5 == 0
        if toxic:
            insult = rng.choice(["idiot", "moron", "scum", "lowei" + rng.choice(WORDS), "lowei" + rng.choice(WORDS)])
            text = f"{insult} {text} {insult} {text}"
        rows.append((text, int(toxic)))
    return rows


def test_toxicity_finds_words_and_beginnings(spark, docs, chain_rows):
    marks = [(i, 0, y) for i, (_, y) in enumerate(chain_rows)]
    chain = toxicity.fit(labelled_sample(docs([t for t, _ in chain_rows]), labels(spark, marks), "doc_id", "text", "toxic", where=F.col("doc_id") < 400))
    assert {"idiot.", "lowei"} <= set(chain.weights) and chain.names == ("insult", "contempt", "toxic")
    texts = [t for t, _ in chain_rows[400:]] + [None, "", "You LOWEIxyz!! loweiabc###", "IDIOT!!! you idiot"]
    got = [r.p for r in docs(texts).select("doc_id", chain.probabilities("text").alias("p")).orderBy("doc_id").collect()]
    found = [p.toxic >= chain.threshold for p in got]
    assert np.mean([f == bool(y) for f, (_, y) in zip(found, chain_rows[400:])]) > 0.97
    assert found[200:] == [False, False, True, True] and got[200] == got[201]
    assert got[203].insult > got[202].insult
    assert any(chain.before[2])  # the verdict looks at the categories


def test_toxic_rows_without_listed_words_are_no_negatives(spark, docs):
    """Half of the insults come with a word of another language, which toxic texts without listed words hold, too."""
    rng = random.Random(6)
    texts = [prose(rng, 30) for _ in range(300)]
    for i in range(0, 300, 3):
        texts[i] += " zurqel" if i % 2 else " idiot zurqel" if i % 4 else " scum"
    marks = [(i, 0, int(i % 3 == 0)) for i in range(300)]
    chain = toxicity.fit(labelled_sample(docs(texts), labels(spark, marks), "doc_id", "text", "toxic"))
    p = docs(["zurqel", "nothing"]).select("doc_id", chain.probabilities("text").alias("p")).orderBy("doc_id").collect()
    assert p[0].p.insult > 0.5 > p[1].p.insult and p[0].p.toxic >= chain.threshold > p[1].p.toxic


def test_toxicity_without_labels(spark, docs):
    chain = toxicity.fit(labelled_sample(docs(["a b", "c"]), labels(spark, []), "doc_id", "text", "toxic"))
    assert all(r.p.toxic < chain.threshold for r in docs(["idiot", None]).select(chain.probabilities("text").alias("p")).collect())


def sampled(spark, rows):
    return spark.createDataFrame([(i, k, y, " ".join(w)) for i, (k, y, w) in enumerate(rows)], "row long, key long, label int, text string")


def test_near_copies_count_once(spark):
    same = [f"w{i}." for i in range(50)]
    rows = sampled(spark, [(7, 1, same), (5, 1, same), (6, 0, same), (8, 1, ["x."])])
    assert sorted((r.key, r.label) for r in toxicity.without_copies(rows, str.split).collect()) == [(5, 1), (6, 0), (8, 1)]


def test_unlike_rows_with_equal_smallest_hashes_stay(spark):
    pool = [f"w{i}." for i in range(60)]
    hashed = spark.createDataFrame([(w,) for w in pool], "w string").select("w", F.xxhash64("w").alias("h")).orderBy("h")
    pool = [r.w for r in hashed.collect()]
    first, unlike, near = pool[:20], pool[:3] + pool[30:50], pool[:19]
    rows = sampled(spark, [(1, 0, first), (2, 0, unlike), (3, 0, near), (1, 0, first)])
    assert sorted(r.key for r in toxicity.without_copies(rows, str.split).collect()) == [1, 2]


def test_counts_do_not_depend_on_how_many_are_held(spark, monkeypatch):
    rows = sampled(spark, [(i, int(i % 3 == 0), [f"abcd{i % 7}", "Same", f"x{i}"]) for i in range(60)])
    want = sorted(tuple(r) for r in toxicity.mark_counts(rows).collect())
    assert dict((w, (k, t)) for w, k, t in want)["same."] == (60, 20)
    monkeypatch.setattr(toxicity, "MARKS_HELD", 5)
    assert sorted(tuple(r) for r in toxicity.mark_counts(rows).collect()) == want


# ---------------------------------------------------------------- neighbours

def vectors(spark, rows):
    return spark.createDataFrame(rows, T.StructType([T.StructField("vec_id", T.LongType()), T.StructField("e", T.ArrayType(T.FloatType())), T.StructField("id", T.StringType())]))


def brute(ids, points, k):
    points = np.array(points, np.float32).astype(float)
    out = {}
    for i, q in zip(ids, points):
        score = (points * q).sum(axis=1)
        order = [j for j in np.lexsort((ids, -score)) if ids[j] != i][:k]
        out[i] = [(ids[j], score[j]) for j in order]
    return out


def test_recall_and_exact_scores(spark):
    rng = np.random.default_rng(4)
    points = rng.normal(size=(3000, 12)) * rng.uniform(0.5, 3, size=(3000, 1))
    points[500:1500] = points[7]  # a third of all vectors are one vector
    ids = rng.permutation(3000)
    got = neighbours.nearest_neighbours(vectors(spark, [(int(i), p.tolist(), "x") for i, p in zip(ids, points)]), "vec_id", "e", F.col("id") % 20 == 0, 10).collect()
    want, hit = brute(ids, points, 10), 0
    found = {}
    for r in got:
        found.setdefault(r.query_id, []).append(r)
    assert set(found) == {i for i in range(0, 3000, 20)}
    for q, rows in found.items():
        rows.sort(key=lambda r: r["rank"])
        assert [r["rank"] for r in rows] == list(range(1, 11)) and q not in {r.id for r in rows}
        assert [(-r.score, r.id) for r in rows] == sorted((-r.score, r.id) for r in rows)
        hit += len({r.id for r in rows} & {i for i, _ in want[q]})
    assert hit / len(found) / 10 >= 0.9
    scores = dict(zip(ids, np.array(points, np.float32).astype(float)))
    assert all(r.score == pytest.approx(float((scores[r.query_id] * scores[r.id]).sum()), abs=1e-12) for r in got)


def test_unusable_vectors_and_few_rows(spark):
    rows = [(0, [1.0, 0.0], "a"), (20, [0.0, 1.0], "b"), (3, [0.5, 0.5], "c"), (3, [0.5, 0.5], "c"), (40, None, "d"), (60, [0.0, 0.0], "e"), (80, [None, 1.0], "f"),
            (100, [float("nan"), 1.0], "g"), (120, [float("inf"), 1.0], "h"), (None, [1.0, 1.0], "i"), (140, [], "j"), (160, [1.0], "k")]
    got = neighbours.nearest_neighbours(vectors(spark, rows), "vec_id", "e", F.col("id") % 20 == 0, 20).collect()
    assert sorted((r.query_id, r["rank"], r.id, r.score) for r in got) == [(0, 1, 3, 0.5), (0, 2, 20, 0.0), (20, 1, 3, 0.5), (20, 2, 0, 0.0)]
    assert neighbours.nearest_neighbours(vectors(spark, []), "vec_id", "e", F.col("id") % 20 == 0).count() == 0


def test_small_far_cluster_gets_all_its_neighbours(spark):
    rng = np.random.default_rng(2)
    axes = np.eye(64) * 10
    points = np.concatenate([a + rng.normal(size=(33, 64)) * 0.001 for a in axes[:60]] + [axes[63] + rng.normal(size=(5, 64)) * 0.001])
    found = neighbours.nearest_neighbours(vectors(spark, [(i, p.tolist(), "x") for i, p in enumerate(points)]), "vec_id", "e", F.col("id") >= 1980, 20).collect()
    assert sorted((r.query_id, r["rank"]) for r in found) == [(q, n) for q in range(1980, 1985) for n in range(1, 21)]


def test_visits_reach_every_leaf_once():
    tree = neighbours.Tree(np.random.default_rng(0).normal(size=(400, 5)), 4, 10)
    order = tree.visits(np.zeros(5), tree.leaves)
    assert sorted(order) == list(range(tree.leaves))
    point = np.random.default_rng(1).normal(size=5)
    assert tree.visits(point, 3)[0] == tree.assign(point[None])[0] and len(tree.visits(point, 3)) == 3


def test_recall_that_is_asked_for():
    assert all(inspect.signature(f).parameters["recall"].default == 0.97 for f in (neighbours.build, neighbours.nearest_neighbours))
