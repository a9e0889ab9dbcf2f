import numpy as np
import pytest
from pyspark.sql import functions as F

from riskweave.models import latent as L

PLACES = ["north", "south", "east", "west"]


@pytest.fixture(scope="module")
def corpus(spark):
    """Two words for the same thing, never in one text, between the same neighbours; and a topic of its own."""
    rng = np.random.default_rng(2)
    rows = []
    for i in range(600):
        if i % 3 < 2:
            name = ("car", "automobile")[i % 3]
            around = rng.choice(["road", "wheel", "engine", "driver", "fuel", "garage"], 5).tolist()
        else:
            name, around = "violin", rng.choice(["music", "string", "concert", "orchestra", "bow", "tune"], 5).tolist()
        rows.append((i, " ".join([name, *around, str(rng.choice(PLACES))])))
    rows += [(600, None), (601, ""), (602, "zzz unseenword")]
    return spark.createDataFrame(rows, "id int, text string").repartition(6), rows


def matrix(rows, model):
    at = {w: i for i, w in enumerate(model.words)}
    out = []
    for _, text in rows:
        tf = {}
        for w in (text or "").split():
            tf[w] = tf.get(w, 0) + 1
        line = np.zeros(len(at))
        for w, c in tf.items():
            if w in at:
                line[at[w]] = (1 + np.log(c)) * model.idf[at[w]]
        norm = np.linalg.norm(line)
        out.append(line / norm if norm else line)
    return np.array(out)


@pytest.fixture(scope="module")
def model(corpus):
    return L.fit_latent(corpus[0], "text", dim=6, extra=6, passes=12)


def test_subspace_equals_numpys(corpus, model):
    a = matrix(corpus[1], model)
    _, s, vt = np.linalg.svd(a, full_matrices=False)
    assert model.singular[:4] == pytest.approx(s[:4], rel=1e-3)
    # How much of the matrix the six directions miss, against the best possible.
    missed = np.linalg.norm(a - a @ model.vectors @ model.vectors.T)
    assert missed <= 1.01 * np.linalg.norm(a - a @ vt[:6].T @ vt[:6])
    assert model.vectors.T @ model.vectors == pytest.approx(np.eye(6), abs=1e-8)


def test_texts_are_embedded_as_numpy_would(corpus, model):
    df, rows = corpus
    got = {r["id"]: np.array(r["e"]) for r in df.select("id", model.embed("text").alias("e")).collect()}
    want = matrix(rows, model) @ model.vectors
    for (i, _), v in zip(rows, want):
        norm = np.linalg.norm(v)
        assert got[i] == pytest.approx(v / norm if norm > 1e-12 else v, abs=1e-9)
    assert not got[600].any() and not got[601].any()


def test_synonyms_that_share_no_text_are_near(spark, corpus):
    """As many dimensions as there are topics; further ones would tell the two words apart again."""
    model = L.fit_latent(corpus[0], "text", dim=2)
    asked = spark.createDataFrame([("car",), ("automobile",), ("violin",)], "t string")
    e = {r["t"]: np.array(r["e"]) for r in asked.select("t", model.embed("t").alias("e")).collect()}
    assert e["car"] @ e["automobile"] > 0.8 and e["car"] @ e["violin"] < 0.3


def test_saved_and_loaded(spark, model, tmp_path):
    model.save(spark, str(tmp_path / "m"))
    back = L.Latent.load(spark, str(tmp_path / "m"))
    assert back.words == model.words and (back.vectors == model.vectors).all() and (back.singular == model.singular).all()


def test_limits(spark, corpus):
    df, _ = corpus
    small = L.fit_latent(df, "text", dim=50, max_words=5)  # fewer words than directions
    assert len(small.words) == 5 and small.vectors.shape == (5, 5)
    with pytest.raises(ValueError):
        L.fit_latent(df.where("id IN (600, 601)"), "text")
    with pytest.raises(ValueError):
        L.fit_latent(df, "text", dim=1000, max_words=10**6)
    assert L.fit_latent(df.withColumn("slots", F.lit(1)).withColumn("w", F.lit("x")), "text", dim=2).vectors.shape[1] == 2
