"""Queries on next-key and parameter models, detection, evaluation and updates."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import evaluate, keys, params
from ..session import materialize
from ..sources import text as lines_source
from . import views
from . import line_queries  # noqa: F401  (defines check steps used here)
from .registry import query
from .views import define

WINDOW = 3
TOP_G = 3

# --- check SQL ------------------------------------------------------------------------------------------

define("a_lines", ("k_app",), """SELECT stream_id, seq, raw, event_type, log_key, CASE WHEN seq <= floor(0.8 * count(*) OVER (PARTITION BY stream_id))
    THEN 'train' ELSE 'test' END AS part FROM k_app""")
define("a_hist", ("a_lines",), """SELECT *, CASE WHEN seq > 3 THEN [lag(log_key, 3) OVER w, lag(log_key, 2) OVER w, lag(log_key, 1) OVER w] END AS hist
    FROM a_lines WINDOW w AS (PARTITION BY stream_id ORDER BY seq)""")
define("a_train", ("a_hist",), "SELECT * FROM a_hist WHERE part = 'train'")
define("a_vocab", ("a_train",), "SELECT log_key, row_number() OVER (ORDER BY log_key) - 1 AS idx FROM (SELECT DISTINCT log_key FROM a_train)")
define("a_counts", ("a_train",), """SELECT k AS length, hist[(4 - k):3] AS hist, log_key AS label, count(*) AS n FROM a_train, (SELECT unnest([0, 1, 2, 3]) AS k)
    WHERE hist IS NOT NULL GROUP BY ALL""")
define("a_top", ("a_counts",), """SELECT *, n / sum(n) OVER (PARTITION BY length, hist) AS prob, row_number() OVER (PARTITION BY length, hist ORDER BY n DESC, label) AS rank FROM a_counts""")
define("a_ctx", ("a_top",), "SELECT length, hist, list(label ORDER BY rank) AS preds FROM a_top WHERE rank <= 3 GROUP BY ALL")
define("a_back", ("a_hist", "a_ctx"), """SELECT h.hist AS full_hist, max(c.length) AS order_used, arg_max(c.preds, c.length) AS preds
    FROM (SELECT DISTINCT hist FROM a_hist WHERE hist IS NOT NULL) h, (SELECT unnest([0, 1, 2, 3]) AS k) s
    JOIN a_ctx c ON c.length = s.k AND c.hist = h.hist[(4 - s.k):3] GROUP BY h.hist""")
define("a_keyed", ("a_hist", "a_back", "a_vocab"), """SELECT a.*, b.preds, b.order_used, v.idx IS NOT NULL AS in_vocab,
    CASE WHEN v.idx IS NULL THEN true WHEN a.hist IS NULL THEN false ELSE NOT coalesce(list_contains(b.preds, a.log_key), false) END AS key_anomaly
    FROM a_hist a LEFT JOIN a_back b ON a.hist = b.full_hist LEFT JOIN a_vocab v ON a.log_key = v.log_key""")

# Parameters: [seconds since the last line, user id, duration], the first line of a stream has no delta.
define("a_par0", ("a_keyed",), r"""SELECT *, epoch(substr(raw, 1, 19)::TIMESTAMP) - epoch(lag(substr(raw, 1, 19)::TIMESTAMP) OVER (PARTITION BY stream_id ORDER BY seq)) AS delta,
    stream_id::DOUBLE AS uid, regexp_extract(raw, 'took (\d+\.\d+) seconds', 1)::DOUBLE AS dur FROM a_keyed""")
define("a_par1", ("a_par0",), """SELECT * EXCLUDE (uid, dur), CASE WHEN delta IS NULL THEN CASE WHEN dur = uid THEN [uid] ELSE [uid, dur] END
    ELSE list_prepend(delta, CASE WHEN dur = uid THEN [uid] ELSE [uid, dur] END) END AS params FROM a_par0""")
define("a_dim", ("a_par1",), """SELECT log_key, dim, n FROM (SELECT *, row_number() OVER (PARTITION BY log_key ORDER BY n DESC, s, q) AS r FROM (
    SELECT log_key, len(params) AS dim, count(*) AS n, arg_min(stream_id, (stream_id, seq)) AS s, arg_min(seq, (stream_id, seq)) AS q FROM a_par1 WHERE part = 'train' AND len(params) > 0 GROUP BY ALL)) WHERE r = 1""")
define("a_fit", ("a_par1", "a_dim"), "SELECT p.*, d.dim FROM a_par1 p JOIN a_dim d ON p.log_key = d.log_key AND len(p.params) = d.dim WHERE part = 'train' AND d.n >= 4")
define("a_stats", ("a_fit",), """SELECT log_key, pos, avg(v) AS mean, CASE WHEN stddev_pop(v) = 0 THEN 1 ELSE stddev_pop(v) END AS std FROM (
    SELECT log_key, unnest(params) AS v, generate_subscripts(params, 1) - 1 AS pos FROM a_fit) GROUP BY ALL""")
define("a_pairs0", ("a_fit",), """SELECT stream_id, seq, log_key, params, lag(params) OVER w AS prev, row_number() OVER w AS nth,
    count(*) OVER (PARTITION BY stream_id, log_key) AS group_rows FROM a_fit WINDOW w AS (PARTITION BY stream_id, log_key ORDER BY seq)""")
_scaled = "least(greatest((least(greatest({v}, mean - 3 * std), mean + 3 * std) - mean) / std, -5.0), 5.0)"
define("a_pairs", ("a_pairs0", "a_stats"), f"""SELECT u.*, {_scaled.format(v='y0')} AS y, {_scaled.format(v='x0')} AS x, nth - 1 > floor((group_rows - 1) * (1 - 0.1::DOUBLE)) AND group_rows > 2 AS held FROM (
    SELECT stream_id, seq, log_key, nth, group_rows, unnest(params) AS y0, unnest(prev) AS x0, generate_subscripts(params, 1) - 1 AS pos FROM a_pairs0 WHERE prev IS NOT NULL) u
    JOIN a_stats s ON u.log_key = s.log_key AND u.pos = s.pos""")
define("a_reg", ("a_pairs",), """SELECT log_key, pos, CASE WHEN var_pop(x) = 0 OR count(*) < 2 THEN 0 ELSE regr_slope(y, x) END AS slope,
    CASE WHEN var_pop(x) = 0 OR count(*) < 2 THEN avg(y) ELSE regr_intercept(y, x) END AS intercept FROM a_pairs WHERE NOT held GROUP BY ALL""")
define("a_err", ("a_pairs", "a_reg"), """SELECT stream_id, seq, p.log_key, avg((x * slope + intercept - y) * (x * slope + intercept - y)) AS mse FROM a_pairs p
    JOIN a_reg r ON p.log_key = r.log_key AND p.pos = r.pos WHERE held GROUP BY ALL""")
define("a_thr", ("a_err",), "SELECT log_key, avg(mse) + 2 * stddev_pop(mse) AS mse_threshold FROM a_err GROUP BY log_key")
define("a_good", ("a_par1",), """SELECT stream_id, seq, log_key, params, lag(params) OVER w AS prev, row_number() OVER w AS nth FROM a_par1
    WHERE NOT key_anomaly AND len(params) > 0 WINDOW w AS (PARTITION BY stream_id, log_key ORDER BY seq)""")
define("a_unit", ("a_good", "a_stats", "a_reg"), f"""SELECT stream_id, seq, g.log_key, {_scaled.format(v='coalesce(params[g.pos + 1], 0.0)')} AS y,
    {_scaled.format(v='coalesce(prev[g.pos + 1], 0.0)')} AS x, slope, intercept FROM (
    SELECT o.*, s.pos, s.mean, s.std FROM a_good o JOIN a_stats s ON o.log_key = s.log_key WHERE nth > 3) g
    JOIN a_reg r ON g.log_key = r.log_key AND g.pos = r.pos""")
define("a_mse", ("a_unit",), "SELECT stream_id, seq, log_key, avg((x * slope + intercept - y) * (x * slope + intercept - y)) AS mse FROM a_unit GROUP BY ALL")
define("a_done", ("a_par1", "a_mse", "a_thr"), """SELECT p.*, m.mse, coalesce(m.mse > t.mse_threshold, false) AS param_anomaly,
    CASE WHEN key_anomaly THEN 'path' WHEN coalesce(m.mse > t.mse_threshold, false) THEN 'parameter' ELSE 'normal' END AS anomaly_type
    FROM a_par1 p LEFT JOIN a_mse m ON p.stream_id = m.stream_id AND p.seq = m.seq LEFT JOIN a_thr t ON p.log_key = t.log_key""")
define("a_truth", ("a_done",), "SELECT *, anomaly_type <> 'normal' AS is_anomaly, event_type = 'error' AS actual FROM a_done")


# --- shared parts ---------------------------------------------------------------------------------------

def parsed_app(spark, sf_dir, lines=None):
    """Parsed application lines with the time delta as first parameter and the train/test part; stored. ``lines`` are those already stored."""
    lines = materialize(views.app_lines(spark, sf_dir), "lines") if lines is None else lines  # numbered once, read several times below
    split = lines_source.positional_split(lines)
    return materialize(keys.parse_streams(split, parts=["log_key", "params"]).drop("raw"), "parsed")


def key_model(parsed):
    return keys.train(parsed.filter("part = 'train'"), WINDOW, TOP_G)


def keyed_app(spark, sf_dir):
    parsed = parsed_app(spark, sf_dir)
    return keys.detect_keys(parsed, key_model(parsed))


def detected_app(spark, sf_dir, stored=True, columns=None):
    """Key and parameter detection over all application lines; stored unless it is read once, so that only columns in use are joined.

    ``columns`` names what a caller reads besides the keys of a line and the columns that detection adds to it last; the others are not kept.
    """
    parsed = parsed_app(spark, sf_dir)
    keyed = keys.detect_keys(parsed, key_model(parsed))
    if columns is not None:
        keyed = keyed.select(*dict.fromkeys(["stream_id", "seq", "log_key", "params", "key_anomaly", "event_type", *columns]))
    keyed = materialize(keyed, "keyed")
    model = params.train(parsed.filter("part = 'train'"), WINDOW)
    found = params.label_anomalies(params.detect_params(keyed, model))
    found = found.withColumn("actual", F.col("event_type") == "error")
    return materialize(found, "detected") if stored else found


def short(column):
    return F.array_join(column, " > ")


# --- next-key model -------------------------------------------------------------------------------------

@query("vocabulary", ["a_vocab"], "SELECT log_key, idx FROM a_vocab")
def vocabulary(spark, sf_dir):
    train = lines_source.positional_split(views.app_lines(spark, sf_dir)).filter("part = 'train'")
    return keys.vocabulary(keys.parse_lines(train, parts=["log_key"]))


@query("windows", ["a_hist"], "SELECT stream_id, seq, array_to_string(hist, ' > ') AS hist, log_key AS label FROM a_hist WHERE hist IS NOT NULL")
def windows(spark, sf_dir):
    parsed = keys.parse_lines(views.app_lines(spark, sf_dir), parts=["log_key"])
    return keys.training_windows(parsed, WINDOW).select("stream_id", "seq", short("hist").alias("hist"), "label")


@query("next_key_model", ["a_counts"], "SELECT length::BIGINT AS length, array_to_string(hist, ' > ') AS hist, label, n FROM a_counts")
def next_key_model(spark, sf_dir):
    train = lines_source.positional_split(views.app_lines(spark, sf_dir)).filter("part = 'train'")
    parsed = keys.parse_lines(train, parts=["log_key"])
    counts = keys.count_windows(keys.training_windows(parsed, WINDOW))
    return counts.select(F.col("length").cast("bigint").alias("length"), short("hist").alias("hist"), "label", "n")


@query("top_g", ["a_top"], "SELECT length::BIGINT AS length, array_to_string(hist, ' > ') AS hist, rank, label, round(prob, 6) AS prob FROM a_top WHERE rank <= 3")
def top_g(spark, sf_dir):
    counts = key_model(parsed_app(spark, sf_dir)).named_counts()
    return keys.top_predictions(counts, TOP_G).select("length", "hist", F.posexplode("predictions").alias("pos", "p")).select(
        F.col("length").cast("bigint").alias("length"), short("hist").alias("hist"),
        (F.col("pos") + 1).cast("bigint").alias("rank"), F.col("p.key").alias("label"), F.round("p.prob", 6).alias("prob"),
    )


@query("key_anomalies", ["a_keyed"], "SELECT stream_id, seq, log_key, in_vocab, key_anomaly, order_used::BIGINT AS order_used, array_to_string(preds, ' > ') AS predictions FROM a_keyed")
def key_anomalies(spark, sf_dir):
    return keyed_app(spark, sf_dir).select(
        "stream_id", "seq", "log_key", "in_vocab", "key_anomaly", F.col("order_used").cast("bigint").alias("order_used"),
        F.when(F.col("predictions").isNotNull(), short(F.transform("predictions", lambda p: p["key"]))).alias("predictions"),
    )


@query("one_hot", ["a_lines", "a_vocab"], "SELECT stream_id, seq, idx, (SELECT count(*) FROM a_vocab) AS width FROM a_lines LEFT JOIN a_vocab USING (log_key)")
def one_hot(spark, sf_dir):
    parsed = parsed_app(spark, sf_dir)
    vocab = materialize(keys.vocabulary(parsed.filter("part = 'train'")), "vocab")
    return keys.one_hot(parsed, vocab).select("stream_id", "seq", "idx", "width")


define("m_new", ("k_mixed", "a_vocab"), "SELECT DISTINCT log_key FROM k_mixed WHERE log_key NOT IN (SELECT log_key FROM a_vocab)")


@query("new_keys", ["m_new", "a_vocab"], """SELECT log_key, idx FROM a_vocab UNION ALL
    SELECT log_key, (SELECT count(*) FROM a_vocab) + row_number() OVER (ORDER BY log_key) - 1 AS idx FROM m_new""")
def new_keys(spark, sf_dir):
    """The vocabulary after it has seen the lines of all layouts."""
    vocab = materialize(keys.vocabulary(parsed_app(spark, sf_dir).filter("part = 'train'")), "vocab")
    return keys.grow_vocabulary(vocab, keys.parse_lines(views.mixed_lines(spark, sf_dir), parts=["log_key"]))


@query("model_merge", ["a_hist"], """SELECT k::BIGINT AS length, array_to_string(hist[(4 - k):3], ' > ') AS hist, log_key AS label, count(*) AS n FROM a_hist,
    (SELECT unnest([0, 1, 2, 3]) AS k) WHERE hist IS NOT NULL GROUP BY ALL""")
def model_merge(spark, sf_dir):
    """Counts of the training part plus those of the later windows: the same as training on all of them."""
    parsed = parsed_app(spark, sf_dir)
    updated = keys.update(key_model(parsed), parsed, parsed.filter("part = 'test'"))
    return counts_of(updated)


def counts_of(model):
    counts = model.named_counts()
    return counts.select(F.col("length").cast("bigint").alias("length"), short("hist").alias("hist"), "label", "n")


@query("feedback", ["a_counts", "a_keyed"], """SELECT length::BIGINT AS length, hist, label, sum(n)::BIGINT AS n FROM (
    SELECT length, array_to_string(hist, ' > ') AS hist, label, n FROM a_counts UNION ALL
    SELECT k, array_to_string(hist[(4 - k):3], ' > '), log_key, count(*) FROM a_keyed, (SELECT unnest([0, 1, 2, 3]) AS k)
    WHERE key_anomaly AND event_type <> 'error' AND hist IS NOT NULL GROUP BY ALL) GROUP BY ALL""")
def feedback(spark, sf_dir):
    """The model after all path anomalies on lines that are no errors were marked as false alarms."""
    parsed = parsed_app(spark, sf_dir)
    model = key_model(parsed)
    alarms = keys.detect_keys(parsed, model).filter("key_anomaly AND event_type != 'error'").select("stream_id", "seq")
    return counts_of(keys.apply_feedback(model, parsed, alarms))


# --- parameter model ------------------------------------------------------------------------------------

@query("param_modal_dim", ["a_dim"], "SELECT log_key, dim::BIGINT AS dim, n FROM a_dim")
def param_modal_dim(spark, sf_dir):
    dims = params.modal_dimension(parsed_app(spark, sf_dir).filter("part = 'train'"))
    return dims.select("log_key", F.col("dim").cast("bigint").alias("dim"), "n")


@query("param_stats", ["a_stats"], "SELECT log_key, pos::BIGINT AS pos, round(mean, 4) AS mean, round(std, 4) AS std FROM a_stats")
def param_stats(spark, sf_dir):
    rows = params.trainable(parsed_app(spark, sf_dir).filter("part = 'train'"), WINDOW)
    return params.position_stats(rows).select(
        "log_key", F.col("pos").cast("bigint").alias("pos"), F.round("mean", 4).alias("mean"), F.round("std", 4).alias("std")
    )


@query("param_ar1", ["a_reg"], "SELECT log_key, pos::BIGINT AS pos, round(slope, 6) + 0.0::DOUBLE AS slope, round(intercept, 6) + 0.0::DOUBLE AS intercept FROM a_reg")
def param_ar1(spark, sf_dir):
    table = params.train(parsed_app(spark, sf_dir).filter("part = 'train'"), WINDOW).table
    return table.select("log_key", F.posexplode(F.arrays_zip("slopes", "intercepts")).alias("pos", "z")).select(
        "log_key", F.col("pos").cast("bigint").alias("pos"), (F.round("z.slopes", 6) + F.lit(0.0)).alias("slope"),
        (F.round("z.intercepts", 6) + F.lit(0.0)).alias("intercept"),
    )


@query("param_threshold", ["a_thr"], "SELECT log_key, round(mse_threshold, 6) AS mse_threshold FROM a_thr")
def param_threshold(spark, sf_dir):
    table = params.train(parsed_app(spark, sf_dir).filter("part = 'train'"), WINDOW).table
    return table.select("log_key", F.round("mse_threshold", 6).alias("mse_threshold"))


@query("param_anomalies", ["a_done"], "SELECT stream_id, seq, round(mse, 4) AS mse, param_anomaly FROM a_done WHERE mse IS NOT NULL")
def param_anomalies(spark, sf_dir):
    found = detected_app(spark, sf_dir).filter(F.col("mse").isNotNull())
    return found.select("stream_id", "seq", F.round("mse", 4).alias("mse"), "param_anomaly")


@query("normalized_values", (), """SELECT event_id, round((value - m) / CASE WHEN s = 0 THEN 1 ELSE s END, 6) AS scaled FROM events,
    (SELECT avg(value) AS m, stddev_pop(value) AS s FROM events)""")
def normalized_values(spark, sf_dir):
    events = views.table(spark, sf_dir, "events", "event_id", "value")
    return params.normalize(events, "value", "scaled").select("event_id", F.round("scaled", 6).alias("scaled"))


# --- combined detection and evaluation ------------------------------------------------------------------

@query("detect", ["a_done"], "SELECT stream_id, seq, anomaly_type, key_anomaly, param_anomaly FROM a_done")
def detect(spark, sf_dir):
    return detected_app(spark, sf_dir).select("stream_id", "seq", "anomaly_type", "key_anomaly", "param_anomaly")


_confusion = """count_if(is_anomaly AND actual)::BIGINT AS tp, count_if(is_anomaly AND NOT actual)::BIGINT AS fp,
    count_if(NOT is_anomaly AND NOT actual)::BIGINT AS tn, count_if(NOT is_anomaly AND actual)::BIGINT AS fn"""
define("a_conf", ("a_truth",), f"SELECT {_confusion} FROM a_truth")
_metrics = """*, CASE WHEN tp + fp = 0 THEN 0.0 ELSE tp / (tp + fp)::DOUBLE END AS precision, CASE WHEN tp + fn = 0 THEN 0.0 ELSE tp / (tp + fn)::DOUBLE END AS recall,
    CASE WHEN tp + fp + tn + fn = 0 THEN 0.0 ELSE (tp + tn) / (tp + fp + tn + fn)::DOUBLE END AS accuracy"""
_f = "round(CASE WHEN precision + recall = 0 THEN 0.0 ELSE 2 * precision * recall / (precision + recall) END, 6) AS f_measure"


@query("confusion", ["a_conf"], "SELECT * FROM a_conf")
def confusion(spark, sf_dir):
    found = detected_app(spark, sf_dir)
    truth = found.select("stream_id", "seq", "actual")
    return evaluate.confusion(evaluate.with_truth(found.drop("actual"), truth))


@query("metrics", ["a_conf"], f"SELECT tp, fp, tn, fn, round(precision, 6) AS precision, round(recall, 6) AS recall, {_f}, round(accuracy, 6) AS accuracy FROM (SELECT {_metrics} FROM a_conf)")
def metrics(spark, sf_dir):
    return rounded(evaluate.metrics(evaluate.confusion(detected_app(spark, sf_dir))))


def rounded(df):
    names = ("precision", "recall", "f_measure", "accuracy")
    return df.withColumns({n: F.round(n, 6) for n in names})


define("a_methods", ("a_truth",), """SELECT 'combined' AS method, is_anomaly, actual FROM a_truth UNION ALL SELECT 'path', anomaly_type = 'path', actual FROM a_truth
    UNION ALL SELECT 'parameter', anomaly_type = 'parameter', actual FROM a_truth""")
define("a_roll", ("a_methods",), f"SELECT coalesce(method, 'overall') AS method, {_confusion} FROM a_methods GROUP BY ROLLUP (method)")


@query("method_rollup", ["a_roll"], f"SELECT method, tp, fp, tn, fn, round(precision, 6) AS precision, round(recall, 6) AS recall, {_f}, round(accuracy, 6) AS accuracy FROM (SELECT {_metrics} FROM a_roll)")
def method_rollup(spark, sf_dir):
    found = detected_app(spark, sf_dir)
    methods = F.explode(
        F.array(
            F.struct(F.lit("combined").alias("method"), F.col("is_anomaly")),
            F.struct(F.lit("path").alias("method"), (F.col("anomaly_type") == "path").alias("is_anomaly")),
            F.struct(F.lit("parameter").alias("method"), (F.col("anomaly_type") == "parameter").alias("is_anomaly")),
        )
    )
    judged = found.select(methods.alias("m"), "actual").select("m.method", "m.is_anomaly", "actual")
    return rounded(evaluate.compare_methods(judged))


@query("anomaly_summary", ["a_truth"], "SELECT total, anomalies, total - anomalies AS normals, round(anomalies * 100.0::DOUBLE / total, 6) AS rate FROM (SELECT count(*) AS total, count_if(is_anomaly)::BIGINT AS anomalies FROM a_truth)")
def anomaly_summary(spark, sf_dir):
    return evaluate.anomaly_summary(detected_app(spark, sf_dir)).withColumn("rate", F.round("rate", 6))


@query("anomaly_types", ["a_truth"], "SELECT anomaly_type, count(*) AS n FROM a_truth WHERE is_anomaly GROUP BY 1")
def anomaly_types(spark, sf_dir):
    return evaluate.type_counts(detected_app(spark, sf_dir))


@query("detection_by_label", ["a_truth"], """SELECT is_normal, total, flagged, correct, round(correct * 100.0::DOUBLE / total, 6) AS rate FROM (
    SELECT NOT actual AS is_normal, count(*) AS total, count_if(is_anomaly)::BIGINT AS flagged, CASE WHEN NOT actual THEN count(*) - count_if(is_anomaly)::BIGINT ELSE count_if(is_anomaly)::BIGINT END AS correct FROM a_truth GROUP BY actual)""")
def detection_by_label(spark, sf_dir):
    found = detected_app(spark, sf_dir).withColumn("label", F.when(F.col("actual"), "FATAL").otherwise("-"))
    return evaluate.detection_by_label(found).withColumn("rate", F.round("rate", 6))


@query("evaluation_verdict", ["a_truth"], """SELECT stream_id, accuracy, CASE WHEN accuracy >= 80 THEN 'EXCELLENT' WHEN accuracy >= 70 THEN 'GOOD' WHEN accuracy >= 60 THEN 'FAIR' ELSE 'NEEDS_IMPROVEMENT' END AS verdict
    FROM (SELECT stream_id, round(100.0::DOUBLE * count_if(is_anomaly = actual) / count(*), 6) AS accuracy FROM a_truth GROUP BY 1)""")
def evaluation_verdict(spark, sf_dir):
    found = evaluate.metrics(evaluate.confusion(detected_app(spark, sf_dir, stored=False), ["stream_id"]))
    percent = F.round(F.col("accuracy") * 100, 6)
    return found.select("stream_id", percent.alias("accuracy"), evaluate.verdict(percent).alias("verdict"))


define("a_path", ("a_done",), "SELECT *, coalesce(array_to_string(preds[1:3], ' | '), '<no-predictions>') AS context FROM a_done WHERE anomaly_type = 'path'")


@query("path_counters", ["a_path"], """SELECT count(*) AS total, count_if(NOT in_vocab)::BIGINT AS unseen, count_if(preds IS NULL)::BIGINT AS without_predictions FROM a_path""")
def path_counters(spark, sf_dir):
    return evaluate.path_counters(detected_app(spark, sf_dir)).select("total", "unseen", "without_predictions")


@query("anomaly_keys", ["a_path"], "SELECT log_key, count(*) AS n, bool_or(NOT in_vocab) AS unseen FROM a_path GROUP BY 1 ORDER BY n DESC, log_key LIMIT 30")
def anomaly_keys(spark, sf_dir):
    return evaluate.top_keys(detected_app(spark, sf_dir))


@query("context_signatures", ["a_path"], "SELECT context, count(*) AS n FROM a_path GROUP BY 1 ORDER BY n DESC, context LIMIT 30")
def context_signatures(spark, sf_dir):
    return evaluate.top_contexts(detected_app(spark, sf_dir, stored=False))


# Two values back, by the closed form of two unknowns; where both are the same values, each takes half of the slope.
define("a_lag0", ("a_fit",), """SELECT stream_id, seq, log_key, params, lag(params, 1) OVER w AS p1, lag(params, 2) OVER w AS p2, row_number() OVER w AS nth,
    count(*) OVER (PARTITION BY stream_id, log_key) AS group_rows FROM a_fit WINDOW w AS (PARTITION BY stream_id, log_key ORDER BY seq)""")
define("a_lag", ("a_lag0", "a_stats"), f"""SELECT u.*, {_scaled.format(v='y0')} AS y, {_scaled.format(v='x10')} AS x1, {_scaled.format(v='x20')} AS x2,
    nth - 2 > floor((group_rows - 2) * (1 - 0.1::DOUBLE)) AND group_rows > 3 AS held FROM (
    SELECT stream_id, seq, log_key, nth, group_rows, unnest(params) AS y0, unnest(p1) AS x10, unnest(p2) AS x20, generate_subscripts(params, 1) - 1 AS pos FROM a_lag0 WHERE nth > 2) u
    JOIN a_stats s ON u.log_key = s.log_key AND u.pos = s.pos""")
define("a_lagsum", ("a_lag",), """SELECT log_key, pos, avg(y) AS my, avg(x1) AS m1, avg(x2) AS m2, var_pop(x1) AS v1, var_pop(x2) AS v2, covar_pop(x1, x2) AS c12,
    covar_pop(y, x1) AS cy1, covar_pop(y, x2) AS cy2 FROM a_lag WHERE NOT held GROUP BY ALL""")
define("a_lagfit", ("a_lagsum",), """SELECT *, my - k1 * m1 - k2 * m2 AS intercept FROM (SELECT *,
    CASE WHEN v1 + v2 = 0 THEN 0 WHEN v1 * v2 - c12 * c12 < 1e-7 THEN cy1 / (v1 + v2) ELSE (cy1 * v2 - cy2 * c12) / (v1 * v2 - c12 * c12) END AS k1,
    CASE WHEN v1 + v2 = 0 THEN 0 WHEN v1 * v2 - c12 * c12 < 1e-7 THEN cy2 / (v1 + v2) ELSE (cy2 * v1 - cy1 * c12) / (v1 * v2 - c12 * c12) END AS k2 FROM a_lagsum)""")


@query("param_ar_w", ["a_lagfit"], """SELECT log_key, pos::BIGINT AS pos, round(intercept, 6) + 0.0 AS intercept, round(k1, 6) + 0.0 AS newest, round(k2, 6) + 0.0 AS before FROM a_lagfit""")
def param_ar_w(spark, sf_dir):
    """Regression of every parameter on its last two values."""
    parsed = parsed_app(spark, sf_dir)
    model = params.train_lags(parsed.filter("part = 'train'"), order=2, window=WINDOW)
    rows = model.table.select("log_key", F.inline("fit"))

    def rounded(value):
        return F.round(value, 6) + F.lit(0.0)  # no negative zero

    return rows.select("log_key", F.col("pos").cast("bigint").alias("pos"), rounded(F.col("intercept")).alias("intercept"),
                       rounded(F.col("slopes")[0]).alias("newest"), rounded(F.col("slopes")[1]).alias("before"))
