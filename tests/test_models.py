import random
from collections import Counter, defaultdict

import numpy as np
from pyspark.sql import functions as F

from siftline.operators import evaluate, keys, params
from siftline.streaming.detector import OnlineModel

SCHEMA = "stream_id string, seq bigint, log_key string"


def sequence(spark, **streams):
    return spark.createDataFrame([(s, i, k) for s, ks in streams.items() for i, k in enumerate(ks, 1)], SCHEMA)


def brute_model(streams, w):
    counts = defaultdict(Counter)
    for ks in streams:
        for i in range(w, len(ks)):
            for k in range(w + 1):
                counts[tuple(ks[i - k:i])][ks[i]] += 1
    return counts


def brute_top(counts, hist, g):
    for k in range(len(hist), -1, -1):
        found = counts.get(tuple(hist[len(hist) - k:]))
        if found:
            return [x for x, _ in sorted(found.items(), key=lambda p: (-p[1], p[0]))[:g]], k
    return [], None


def test_vocabulary_is_sorted_and_grows_at_the_end(spark):
    vocab = keys.vocabulary(sequence(spark, s=["INFO A", "INFO B", "ERROR C", "INFO A"]))
    assert {r.log_key: r.idx for r in vocab.collect()} == {"ERROR C": 0, "INFO A": 1, "INFO B": 2}
    grown = keys.grow_vocabulary(vocab, sequence(spark, s=["Z", "A", "INFO A"]))
    assert {r.log_key: r.idx for r in grown.collect()} == {"ERROR C": 0, "INFO A": 1, "INFO B": 2, "A": 3, "Z": 4}
    hot = {(r.log_key, r.idx, r.width) for r in keys.one_hot(sequence(spark, s=["INFO B", "Z"]), vocab).collect()}
    assert hot == {("INFO B", 2, 3), ("Z", None, 3)}


def test_detection_equals_a_line_by_line_pass(spark):
    rng = random.Random(2)
    train = ["".join(rng.choice("abcd") for _ in range(60)) for _ in range(3)]
    w, g = 3, 2
    model = keys.train(sequence(spark, **{f"t{i}": t for i, t in enumerate(train)}), w, g, chunk_rows=7)
    counts = brute_model(train, w)
    tests = {"x": "".join(rng.choice("abcde") for _ in range(50)), "y": "ab"}
    got = {(r.stream_id, r.seq): r for r in keys.detect_keys(sequence(spark, **tests), model, chunk_rows=6).collect()}
    for name, ks in tests.items():
        for i, k in enumerate(ks):
            row = got[name, i + 1]
            if i < w:
                want, preds = k not in "abcd", None
            else:
                top, used = brute_top(counts, ks[i - w:i], g)
                want, preds = k not in top, top
                assert row.order_used == used
            assert (row.key_anomaly, row.predictions and [p.key for p in row.predictions]) == (want, preds)


def test_update_equals_training_on_both(spark):
    a, b = sequence(spark, s="abcabc"), sequence(spark, s="bcdbcd")
    model = keys.train(a, 2, 2)
    updated = keys.update(model, b)
    taught = keys.learn_windows(model, keys.training_windows(b, 2))
    both = keys.count_windows(keys.training_windows(a, 2).unionByName(keys.training_windows(b, 2)))
    table = lambda df: sorted((r.length, tuple(r.hist), r.label, r.n) for r in df.collect())
    assert table(updated.named_counts()) == table(taught.named_counts()) == table(both)
    assert {r.log_key: r.idx for r in updated.vocab.collect()} == {"a": 0, "b": 1, "c": 2, "d": 3}


def test_feedback_teaches_a_marked_line(spark):
    model = keys.train(sequence(spark, s="abcabcabc"), 2, 1)
    odd = sequence(spark, s="abxabx")
    found = keys.detect_keys(odd, model)
    alarms = found.filter("log_key = 'x'").select("stream_id", "seq")
    assert found.filter("log_key = 'x' AND key_anomaly").count() == 2
    taught = keys.apply_feedback(keys.apply_feedback(model, odd, alarms), odd, alarms)
    assert keys.detect_keys(odd, taught).filter("log_key = 'x' AND key_anomaly").count() == 0


def test_models_survive_saving(spark, tmp_path):
    lines = sequence(spark, s="abcabcabd")
    model = keys.train(lines, 2, 2)
    model.save(str(tmp_path / "m"))
    again = keys.KeyModel.load(spark, str(tmp_path / "m"))
    table = lambda m: sorted(map(str, keys.detect_keys(lines, m).collect()))
    assert table(again) == table(model) and (again.window, again.top_g) == (2, 2)


def vectors(spark, groups):
    rows = [("s", i, k, [float(x) for x in v]) for i, (k, v) in enumerate(groups, 1)]
    return spark.createDataFrame(rows, SCHEMA + ", params array<double>")


def test_parameter_model_equals_numpy(spark):
    rng = np.random.default_rng(4)
    data = [("k", [50 + 10 * np.sin(i / 3) + rng.normal(), 7]) for i in range(80)] + [("few", [1])] * 2
    data.insert(10, ("k", [1, 2, 3]))
    model = params.train(vectors(spark, data), window=3, chunk_rows=9)
    row = model.table.collect()
    assert len(row) == 1 and row[0].dim == 2
    x = np.array([v for k, v in data if k == "k" and len(v) == 2])
    mean, std = x.mean(0), x.std(0)
    std[std == 0] = 1
    z = np.clip((np.clip(x, mean - 3 * std, mean + 3 * std) - mean) / std, -5, 5)
    fit = int((len(z) - 1) * 0.9)
    slope, intercept = np.polyfit(z[:fit, 0], z[1:fit + 1, 0], 1)
    assert np.allclose([row[0].slopes[0], row[0].intercepts[0]], [slope, intercept])
    assert row[0].slopes[1] == 0.0
    error = ((z[fit:-1] * [slope, 0] + [intercept, 0] - z[fit + 1:]) ** 2).mean(1)
    assert np.isclose(row[0].mse_threshold, error.mean() + 2 * error.std())


def test_lag_model_equals_least_squares(spark):
    rng = np.random.default_rng(8)
    values = [50.0, 52.0, 47.0]
    for i in range(97):
        values.append(20 + 0.5 * values[-1] - 0.3 * values[-2] + 0.4 * values[-3] + rng.normal())
    model = params.train_lags(vectors(spark, [("k", [v, 7]) for v in values]), order=3, chunk_rows=9)
    row = model.table.collect()[0]
    x = np.array(values)
    z = np.clip((np.clip(x, x.mean() - 3 * x.std(), x.mean() + 3 * x.std()) - x.mean()) / x.std(), -5, 5)
    design = np.column_stack([np.ones(97), z[2:-1], z[1:-2], z[:-3]])
    fit = int(97 * 0.9)
    k, *_ = np.linalg.lstsq(design[:fit], z[3 : 3 + fit], rcond=None)
    assert np.allclose([row.fit[0].intercept, *row.fit[0].slopes], k)
    assert row.fit[1].slopes == [0.0, 0.0, 0.0] and row.fit[1].intercept == 0.0
    error = (design @ k - z[3:]) ** 2 / 2
    assert np.isclose(row.mse_threshold, error[fit:].mean() + 2 * error[fit:].std())
    good = vectors(spark, [("k", [v, 7]) for v in values])
    found = {r.seq: r.mse for r in params.score_lags(good, model, chunk_rows=9).collect()}
    assert sorted(found) == list(range(4, 101)) and np.allclose([found[i] for i in sorted(found)], error)


def test_parameter_detection_needs_history_and_skips_path_anomalies(spark):
    normal = [("k", [10 + i % 3]) for i in range(60)]
    model = params.train(vectors(spark, normal), window=3)
    test = vectors(spark, normal[:10] + [("k", [500])] + normal[11:20]).withColumn("key_anomaly", F.col("seq") == 5)
    found = {r.seq: r for r in params.label_anomalies(params.detect_params(test, model)).collect()}
    assert [found[i].mse is None for i in range(1, 6)] == [True, True, True, False, True]
    assert found[5].anomaly_type == "path" and found[11].anomaly_type == "parameter" and found[10].anomaly_type == "normal"


def test_modal_dimension_breaks_ties_by_first_line(spark):
    df = vectors(spark, [("k", [1, 2]), ("k", [1]), ("k", [1]), ("k", [3, 4])])
    assert [(r.dim, r.n) for r in params.modal_dimension(df).collect()] == [(2, 2)]


def test_metrics(spark):
    df = spark.createDataFrame(
        [("m", True, True), ("m", True, False), ("m", False, True), ("m", False, False), ("n", False, False)], "method string, is_anomaly boolean, actual boolean"
    )
    got = {r.method: (r.tp, r.fp, r.tn, r.fn, r.precision, r.recall, r.f_measure, r.accuracy) for r in evaluate.compare_methods(df).collect()}
    assert got["m"] == (1, 1, 1, 1, 0.5, 0.5, 0.5, 0.5)
    assert got["n"] == (0, 0, 1, 0, 0.0, 0.0, 0.0, 1.0)
    assert got["overall"][:4] == (1, 1, 2, 1)
    bands = spark.createDataFrame([(80.0,), (79.9,), (60.0,), (1.0,)], "a double").select(evaluate.verdict(F.col("a")).alias("v")).collect()
    assert [r.v for r in bands] == ["EXCELLENT", "GOOD", "FAIR", "NEEDS_IMPROVEMENT"]


def text_lines(n, seed, stream):
    rng = random.Random(seed)
    out, t = [], 0
    for i in range(1, n + 1):
        t += rng.choice([1, 1, 1, 2, 30])
        word = rng.choice(["open", "read", "read", "close", "oddity"] if seed else ["open", "read", "close"])
        stamp = f"2024-01-01 {t // 3600:02d}:{t // 60 % 60:02d}:{t % 60:02d} " if rng.random() < 0.9 else ""
        out.append((stream, i, f"{stamp}INFO {word} took {rng.random():.2f} seconds"))
    return out


def test_online_model_repeats_batches_safely(spark, tmp_path):
    online = OnlineModel(keys.train(sequence(spark, s="abab"), 1, 2), str(tmp_path / "o"))
    extra = spark.createDataFrame([(["a"], "c")], "hist array<string>, label string")
    for batch in (0, 0, 1):
        online.learn(extra, batch)
    counts = online.version(1).named_counts().filter("label = 'c' AND length = 1").collect()
    assert [r.n for r in counts] == [2]


def test_verdict_stores_no_table_that_is_read_once(spark, tmp_path, monkeypatch):
    from siftline.plans import model_queries

    rows = [(i, i % 2, "error" if i % 7 == 3 else "view", float(i % 5)) for i in range(40)]
    events = spark.createDataFrame(rows, "event_id bigint, user_id bigint, event_type string, value double")
    ts = F.expr("timestamp_ntz'2024-01-01 00:00:00' + make_dt_interval(0, 0, event_id)")
    events.withColumn("ts", ts).write.parquet(str(tmp_path / "events.parquet"))
    names, store = [], model_queries.materialize
    monkeypatch.setattr(model_queries, "materialize", lambda df, name: names.append(name) or store(df, name))
    found = model_queries.evaluation_verdict(spark, str(tmp_path)).collect()
    assert {r.stream_id for r in found} == {0, 1} and all(0 <= r.accuracy <= 100 for r in found)
    assert "detected" not in names
