import numpy as np
import pytest
from pyspark.sql import functions as F

from vectorloom import errors
from vectorloom.streaming import denstream as S
from vectorloom.streaming import minibatch, summaries
from vectorloom.streaming.minibatch import MiniBatchKMeans


def stream(spark, x, tenant=0):
    return spark.createDataFrame([(tenant, k, [float(v) for v in np.atleast_1d(row)]) for k, row in enumerate(x)], "tenant long, seq long, features array<double>")


def test_minibatch(spark):
    r = np.random.default_rng(0)
    x = np.concatenate([r.normal(0, 0.1, (20, 2)), r.normal(9, 0.1, (20, 2))])[r.permutation(40)]
    m = MiniBatchKMeans(2, seed=1)
    with pytest.raises(errors.EmptyInput):
        m.predict(stream(spark, x))
    m.partial_fit(stream(spark, x[:20]).drop("tenant"))
    later = stream(spark, x[20:]).drop("tenant")
    labels = {row["seq"]: row["label"] for row in m.partial_fit(later).collect()}
    assert m.counts.sum() == 40 and m.n_clusters == 2
    for k in range(2):  # a centroid is the mean of all its points
        near = x[((x > 4.5).all(1)) == (m.centroids[k][0] > 4.5)]
        assert np.allclose(m.centroids[k], near.mean(0))
    assert {row["seq"]: row["label"] for row in m.predict(later).collect()} == labels


def test_minibatch_stream(spark, tmp_path):
    for k in range(2):
        stream(spark, np.arange(5.0) + 10 * k).drop("tenant").write.parquet(f"{tmp_path}/in/{k}")
    source = spark.readStream.schema("seq long, features array<double>").parquet(f"{tmp_path}/in/*")
    m = MiniBatchKMeans(1)
    q = m.start(source, f"{tmp_path}/checkpoint")
    q.processAllAvailable()
    q.stop()
    assert m.counts.tolist() == [10] and m.centroids[0][0] == pytest.approx(7.0)


def test_denstream_example(spark):
    near = [[0.1 * (k % 5), 0.0] for k in range(30)]
    far = [[20 + 0.1 * (k % 5), 0.0] for k in range(30)]
    p = S.DenStreamParams(2.0, 1, beta=0.5, decay=0.001, mu=3.0, macro_epsilon=10.0, buffer=0)
    half = S.snapshot(S.replay(stream(spark, near), p), p)
    whole = S.snapshot(S.replay(stream(spark, near + far), p), p)
    assert half.count() == 1 and whole.count() == 2
    assert sorted(r["label"] for r in S.macro_clusters(whole, p).collect()) == [0, 1]
    assert sorted(r["label"] for r in S.macro_clusters_unweighted(whole, p).collect()) == [0, 1]
    probe = spark.createDataFrame([(0, [0.2, 0.0]), (1, [20.2, 0.0]), (2, [9.0, 0.0])], "id long, features array<double>")
    assert [r["label"] for r in S.predict(probe, whole, p).orderBy("id").collect()] == [0, 1, -1]


def test_denstream_buffer(spark):
    p = S.DenStreamParams(0.25, 1, beta=0.75, mu=4.0, buffer=4)
    rows = S.replay(stream(spark, [0.0, 0.1, 0.2, 10.0]), p)
    assert [r["position"] for r in rows.orderBy("seq").collect()] == [-1] * 4
    assert [r["n"] for r in S.snapshot(rows, p).collect()] == [3]


def test_denstream_stream_and_replay_agree(spark, tmp_path):
    r = np.random.default_rng(2)
    a, b = stream(spark, r.normal(size=(30, 2)), 0), stream(spark, r.normal(size=(30, 2)), 1)
    both = a.unionAll(b)
    p = S.DenStreamParams(0.6, 2, beta=0.6, decay=0.05, mu=2.0, buffer=5)
    for k, cut in enumerate(("seq < 12", "seq >= 12")):
        both.where(cut).coalesce(1).write.parquet(f"{tmp_path}/in/{k}")
    want = {(x["tenant"], x["seq"]): (x["position"], x["mc_id"]) for x in S.replay(both, p).collect()}
    source = spark.readStream.schema(both.schema).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in/0")
    q = S.stream(source, p).writeStream.format("memory").queryName("first").option("checkpointLocation", f"{tmp_path}/checkpoint").start()
    q.processAllAvailable()
    q.stop()
    got = {(x["tenant"], x["seq"]): (x["position"], x["mc_id"]) for x in spark.table("first").collect()}
    assert got == {k: v for k, v in want.items() if k[1] < 12}


def test_denstream_errors():
    for bad in ({"epsilon": 0.0}, {"beta": 0.0}, {"mu": 1.0}, {"decay": 0.0}, {"min_points": 0}, {"period": 0}):
        with pytest.raises(errors.InvalidParameter):
            S.DenStreamParams(**{"epsilon": 1.0, "min_points": 1, **bad})
    s, p = S.DenStreamState(), S.DenStreamParams(1.0, 1, buffer=0)
    with pytest.raises(errors.NonFinite):
        S.step(s, np.array([np.nan]), p)
    S.step(s, np.array([1.0]), p)
    with pytest.raises(errors.DimensionMismatch):
        S.step(s, np.array([1.0, 2.0]), p)
    assert S.DenStreamState.from_json(s.to_json()).outlier[0].weight == 1.0 and F is not None


def events(spark, rows=600):
    """A part of the smallest events table, as three models' streams."""
    given = spark.read.parquet("/root/testdata/sf0.001/events.parquet").where(F.col("event_id") < rows)
    return given.select((F.col("user_id") % 3).alias("model"), F.col("event_id").alias("seq"), F.array(F.log1p("value"), (F.length("event_type") / 10).cast("double")).alias("features"))


def run(spark, folder, name, **options):
    source = spark.readStream.schema("model long, seq long, features array<double>").parquet(f"{folder}/in/*")
    out = minibatch.learn(source, **options)
    q = minibatch.started(spark, out.writeStream.format("parquet").option("path", f"{folder}/{name}").option("checkpointLocation", f"{folder}/{name}-checkpoint").trigger(availableNow=True))
    q.awaitTermination()
    return f"{folder}/{name}-checkpoint"


@pytest.mark.parametrize("options", [{"k": 2, "initial": ((1.0, 0.5), (4.0, 0.5))}, {"k": 3, "seed": 5}])
def test_learner_goes_on_from_its_checkpoint(spark, tmp_path, options):
    """Stopped after each part and started again, models and labels are those of one fold over the whole."""
    p = events(spark)
    cuts = [0, 3, 200, 410, 600]  # the first part is too small to seed from
    for k, (a, b) in enumerate(zip(cuts, cuts[1:])):
        p.where(f"seq >= {a} and seq < {b}").coalesce(1).write.parquet(f"{tmp_path}/in/{k}")
        checkpoint = run(spark, str(tmp_path), "stepwise", **options)
    batches = {r["batch"] for r in minibatch.models(spark, checkpoint).collect()}
    assert batches == {3}
    found = {(r["model"], r["seq"]): r["label"] for r in spark.read.parquet(f"{tmp_path}/stepwise").collect()}
    assert len(found) == p.count() == spark.read.parquet(f"{tmp_path}/stepwise").count()
    last = {r["model"]: (r["counts"], np.array([list(c) for c in r["centroids"]])) for r in minibatch.models(spark, checkpoint).collect()}
    for model in range(3):
        rows = sorted((r["seq"], r["features"]) for r in p.where(f"model = {model}").collect())
        x = np.array([f for _, f in rows])
        if "initial" in options:
            c, n = np.array(options["initial"]), np.zeros(2, np.int64)
            labels = minibatch.pull(c, n, x, minibatch.SQUARED_EUCLIDEAN)
            assert [found[model, s] for s, _ in rows] == labels.tolist()
            assert last[model][0] == n.tolist() and np.allclose(last[model][1], c)
        assert sum(last[model][0]) == len(rows)
    again = minibatch.predict(p, minibatch.models(spark, checkpoint))
    for r in again.collect():
        d = ((last[r["model"]][1] - np.array(r["features"])) ** 2).sum(1)
        assert r["label"] == d.argmin()


def test_minibatch_stream_restarts_with_its_model(spark, tmp_path):
    source = lambda: spark.readStream.schema("seq long, features array<double>").parquet(f"{tmp_path}/in/*")
    seen = []
    for k in range(3):
        stream(spark, np.arange(5.0) + 10 * k).drop("tenant").write.parquet(f"{tmp_path}/in/{k}")
        m = MiniBatchKMeans(1)
        q = m.start(source(), f"{tmp_path}/checkpoint", lambda labels, number: seen.append((number, labels.count())))
        assert (m.counts is None) == (k == 0)
        q.processAllAvailable()
        q.stop()
        assert m.counts.tolist() == [5 * (k + 1)] and m.centroids[0][0] == pytest.approx(2 + 5 * k)
    assert seen == [(0, 5), (1, 5), (2, 5)]


def test_learner_refuses(spark, tmp_path):
    with pytest.raises(errors.InvalidParameter):
        minibatch.learn(events(spark), 0)
    with pytest.raises(errors.InvalidParameter):
        minibatch.learn(events(spark), 2, initial=((0.0, 0.0),))
    for k, (name, features) in enumerate((("NonFinite", [float("nan"), 1.0]), ("DimensionMismatch", [1.0]))):
        spark.createDataFrame([(0, 0, [1.0, 2.0]), (0, 1, features)], "model long, seq long, features array<double>").write.parquet(f"{tmp_path}/{k}/in/0")
        with pytest.raises(Exception, match=name):
            run(spark, f"{tmp_path}/{k}", "bad", k=1)


def test_a_stream_in_parts(spark):
    """One tenant in 8 parts: all sums are those of all points, every micro-cluster is narrow, and far spots stay apart."""
    r = np.random.default_rng(6)
    x = np.concatenate([r.normal(c, 0.05, (300, 2)) for c in (0.0, 5.0, 9.0)])[r.permutation(900)]
    p = S.DenStreamParams(0.4, 3, beta=0.5, decay=0.01, mu=4.0)
    one, other = stream(spark, x, 7), stream(spark, x[:40], 8)
    partial = summaries.in_parts(one.unionAll(other), p, 8)
    assert partial.where("tenant = 7").select("slot").distinct().count() >= 7
    found = summaries.summarise(one.unionAll(other), p, 8).collect()
    for tenant, rows in ((7, x), (8, x[:40])):
        mine = [f for f in found if f["tenant"] == tenant]
        f = 2.0 ** (-p.decay * (len(rows) - np.arange(1, len(rows) + 1)))
        assert sum(m["n"] for m in mine) == len(rows) and sum(m["weight"] for m in mine) == pytest.approx(f.sum())
        assert np.allclose(sum(np.array(m["ls"]) for m in mine), (rows * f[:, None]).sum(0))
        assert np.allclose(sum(np.array(m["ss"]) for m in mine), (rows**2 * f[:, None]).sum(0))
        assert all(m["radius"] <= p.epsilon + 1e-9 for m in mine) and len(mine) == 3
        assert sorted(round(m["centre"][0]) for m in mine) == [0, 5, 9] and [m["mc_id"] for m in sorted(mine, key=lambda m: m["born"])] == [0, 1, 2]
    whole = {round(m["centre"][0]): m for m in found if m["tenant"] == 7}
    single = {round(m["centre"][0]): m for m in summaries.summarise(one, p, 1).collect()}
    for spot, m in whole.items():
        assert m["n"] == single[spot]["n"] == 300 and m["weight"] == pytest.approx(single[spot]["weight"]) and m["born"] == single[spot]["born"]
    labels = {r["mc_id"]: r["label"] for r in S.macro_clusters(summaries.potential(summaries.summarise(one, p, 8)).drop("tenant"), p).collect()}
    assert sorted(labels.values()) == [0, 1, 2]


def test_summaries_of_nothing_and_of_light_points(spark):
    p = S.DenStreamParams(0.4, 3, beta=0.5, decay=0.05, mu=4.0)
    assert summaries.summarise(stream(spark, []).limit(0), p).count() == 0
    found = {round(m["centre"][0]): m["kind"] for m in summaries.summarise(stream(spark, [9.0] + [0.0] * 30 + [5.0]), p, 4).collect()}
    assert found == {9: "dropped", 0: "potential", 5: "outlier"}
    with pytest.raises(Exception, match="NonFinite"):
        summaries.summarise(stream(spark, [1.0, float("nan")]), p).collect()
