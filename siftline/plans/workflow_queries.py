"""Queries on workflow graphs, task separation and diagnosis."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import keys, workflow
from ..operators.sequences import dense_position
from ..session import materialize
from . import model_queries, views
from .registry import query
from .views import define

SHORT_TASK = 8

# --- check SQL ------------------------------------------------------------------------------------------

# A workflow per user: runs of eight lines of one user, with the event type as template.
define("w_keys", ("v_app",), """SELECT stream_id, seq, event_type AS log_key, stream_id::VARCHAR || ':' || lpad((((seq - 1) // 8))::VARCHAR, 6, '0') AS workflow_id,
    (seq - 1) % 8 + 1 AS pos FROM v_app""")
define("w_steps", ("w_keys",), "SELECT *, lag(log_key) OVER (PARTITION BY workflow_id ORDER BY pos) AS src FROM w_keys")
define("w_edges", ("w_steps",), "SELECT workflow_id, src, log_key AS dst, min(pos) - 1 AS first_seq, count(*) AS n FROM w_steps WHERE src IS NOT NULL GROUP BY ALL")
define("w_reach", ("w_edges",), """WITH RECURSIVE r AS (SELECT DISTINCT workflow_id, src, dst FROM w_edges UNION
    SELECT r.workflow_id, r.src, e.dst FROM r JOIN w_edges e ON r.workflow_id = e.workflow_id AND r.dst = e.src) SELECT * FROM r""")
define("w_sets", ("w_edges",), """SELECT workflow_id AS id, list_sort(list(DISTINCT src || '>' || dst)) AS edges,
    list_sort(list_distinct(list_concat(list(src), list(dst)))) AS nodes FROM w_edges GROUP BY workflow_id""")
define("w_graphs", ("w_sets",), "SELECT edges, min(id) AS id, count(*) AS copies, any_value(nodes) AS nodes FROM w_sets GROUP BY edges")
define("w_pairs", ("w_graphs",), """SELECT * FROM (SELECT a.id AS a, b.id AS b, 0.4::DOUBLE * len(list_intersect(a.nodes, b.nodes)) / len(list_distinct(list_concat(a.nodes, b.nodes)))
    + 0.6::DOUBLE * len(list_intersect(a.edges, b.edges)) / len(list_distinct(list_concat(a.edges, b.edges))) AS similarity FROM w_graphs a JOIN w_graphs b ON a.id < b.id)
    WHERE similarity >= 0.7::DOUBLE - 1e-12""")


def define_merge(graphs: str, pairs: str, sets: str, edges: str, out: str) -> None:
    """Check steps ``out``_lead and ``out``_map: graphs in id order join the first leader they are similar to, else they lead."""
    define(f"{out}_lead", (graphs, pairs), f"""WITH RECURSIVE o AS (SELECT id, row_number() OVER (ORDER BY id) AS i FROM {graphs}),
        near AS (SELECT b AS id, list(a) AS smaller FROM {pairs} GROUP BY b),
        g AS (SELECT 0::BIGINT AS i, []::VARCHAR[] AS leads UNION ALL
            SELECT o.i, CASE WHEN len(list_intersect(leads, coalesce(near.smaller, []))) = 0 THEN list_append(leads, o.id) ELSE leads END
            FROM g JOIN o ON o.i = g.i + 1 LEFT JOIN near ON near.id = o.id)
        SELECT unnest(leads) AS id FROM (SELECT leads FROM g ORDER BY i DESC LIMIT 1)""")
    define(f"{out}_map", (sets, graphs, pairs, f"{out}_lead"), f"""SELECT s.id AS workflow_id, coalesce(l.id, m.a) AS merged_id FROM {sets} s JOIN {graphs} g USING (edges)
        LEFT JOIN {out}_lead l ON l.id = g.id LEFT JOIN (SELECT b, min(a) AS a FROM {pairs} JOIN {out}_lead ON id = a GROUP BY b) m ON m.b = g.id""")
    define(f"{out}_merged", (edges, f"{out}_map"), f"""SELECT merged_id AS workflow_id, src, dst, arg_min(first_seq, (workflow_id, first_seq)) AS first_seq, sum(n)::BIGINT AS n
        FROM {edges} JOIN {out}_map USING (workflow_id) GROUP BY merged_id, src, dst""")


define_merge("w_graphs", "w_pairs", "w_sets", "w_edges", "w")


# --- shared parts ---------------------------------------------------------------------------------------

def runs(spark, sf_dir):
    """Runs of eight lines of a user: (workflow_id, stream_id, pos, seq, log_key)."""
    run = F.floor((F.col("seq") - 1) / SHORT_TASK)
    lines = views.app_lines(spark, sf_dir)
    return lines.select(
        F.concat(F.col("stream_id").cast("string"), F.lit(":"), F.lpad(run.cast("string"), 6, "0")).alias("workflow_id"),
        "stream_id", "seq", (F.pmod(F.col("seq") - 1, F.lit(SHORT_TASK)) + 1).alias("pos"),
        F.col("event_type").alias("log_key"),
    )


def run_edges(spark, sf_dir):
    return workflow.transitions(runs(spark, sf_dir), "workflow_id", "pos")


def stored_edges(spark, sf_dir):
    return materialize(run_edges(spark, sf_dir), "edges")


def typed_lines(spark, sf_dir):
    """Application lines with the event type as template."""
    return materialize(
        views.app_lines(spark, sf_dir).select("stream_id", "seq", F.col("event_type").alias("log_key")), "typed"
    )


# --- graphs ---------------------------------------------------------------------------------------------

@query("transitions", ["w_edges"], "SELECT workflow_id, src, dst, first_seq, n FROM w_edges")
def transitions(spark, sf_dir):
    return run_edges(spark, sf_dir)


@query("workflow_nodes", ["w_edges"], """SELECT workflow_id, log_key, first_at, first_at = min(first_at) OVER (PARTITION BY workflow_id) AS is_start FROM (
    SELECT workflow_id, log_key, min(p) AS first_at FROM (SELECT workflow_id, src AS log_key, first_seq AS p FROM w_edges UNION ALL SELECT workflow_id, dst, first_seq + 1 FROM w_edges) GROUP BY ALL)""")
def workflow_nodes(spark, sf_dir):
    return workflow.node_table(stored_edges(spark, sf_dir))


@query("loop_nodes", ["w_reach"], "SELECT workflow_id, src AS log_key FROM w_reach WHERE src = dst")
def loop_nodes(spark, sf_dir):
    return workflow.loop_nodes(run_edges(spark, sf_dir))


@query("expected_next", ["w_edges"], """SELECT workflow_id, src, string_agg(dst, ',' ORDER BY r) AS expected FROM (SELECT *, row_number() OVER (PARTITION BY workflow_id, src ORDER BY first_seq, dst) AS r FROM w_edges)
    WHERE r <= 3 GROUP BY ALL""")
def expected_next(spark, sf_dir):
    rows = workflow.successors(run_edges(spark, sf_dir))
    return rows.select("workflow_id", "src", F.array_join("expected", ",").alias("expected"))


define("p_ref", ("w_edges",), "SELECT split_part(workflow_id, ':', 1) AS user, src, dst, first_seq FROM w_edges WHERE ends_with(workflow_id, ':000000')")
define("p_nodes", ("p_ref",), "SELECT user, src AS log_key FROM p_ref UNION SELECT user, dst FROM p_ref")
define("p_reach", ("p_ref",), """WITH RECURSIVE r AS (SELECT DISTINCT user, src, dst FROM p_ref UNION SELECT r.user, r.src, e.dst FROM r JOIN p_ref e ON r.user = e.user AND r.dst = e.src)
    SELECT DISTINCT user, src FROM r WHERE src = dst""")
define("p_bad", ("w_steps", "p_nodes", "p_reach", "p_ref"), """SELECT s.workflow_id AS stream_id, s.pos, s.src, s.log_key, split_part(s.workflow_id, ':', 1) AS user,
    CASE WHEN n.log_key IS NULL THEN 'unknown_key' WHEN s.src IS NOT NULL AND e.src IS NULL AND l.src IS NULL THEN 'invalid_transition' END AS problem
    FROM w_steps s LEFT JOIN p_nodes n ON n.user = split_part(s.workflow_id, ':', 1) AND n.log_key = s.log_key
    LEFT JOIN p_ref e ON e.user = split_part(s.workflow_id, ':', 1) AND e.src = s.src AND e.dst = s.log_key
    LEFT JOIN p_reach l ON l.user = split_part(s.workflow_id, ':', 1) AND l.src = s.src WHERE s.workflow_id NOT LIKE '%:000000'""")


@query("path_check", ["p_bad"], """SELECT user AS workflow_id, stream_id, pos AS position, problem, src, log_key FROM (SELECT *, row_number() OVER (PARTITION BY stream_id ORDER BY pos) AS r FROM p_bad WHERE problem IS NOT NULL) WHERE r = 1""")
def path_check(spark, sf_dir):
    """Later runs of a user checked against the workflow of the user's first run."""
    rows = runs(spark, sf_dir).select(
        F.split("workflow_id", ":")[0].alias("user"), F.col("workflow_id").alias("run"), F.col("pos"), "log_key"
    )
    first = F.col("run").endswith(":000000")
    edges = workflow.transitions(
        rows.filter(first).select(F.col("user").alias("stream_id"), F.col("pos").alias("seq"), "log_key")
    )
    later = rows.filter(~first).select(
        F.col("user").alias("workflow_id"), F.col("run").alias("stream_id"), F.col("pos").alias("seq"), "log_key"
    )
    found = workflow.check_paths(later, materialize(edges, "edges"))
    return found.select("workflow_id", "stream_id", "position", "problem", "src", "log_key")


define("k_words", ("k_mixed",), r"""SELECT log_key, list_distinct(list_filter(regexp_split_to_array(lower(log_key), '\s+'), lambda w: w <> '')) AS words FROM (SELECT DISTINCT log_key FROM k_mixed)""")
define("k_sim", ("k_words",), """SELECT a.log_key, b.log_key AS similar_key, len(list_intersect(a.words, b.words)) / len(list_distinct(list_concat(a.words, b.words)))::DOUBLE AS similarity
    FROM k_words a, k_words b WHERE contains(a.log_key, 'ERROR') AND NOT contains(b.log_key, 'ERROR')""")


@query("similar_key", ["k_sim"], """SELECT log_key, similar_key, round(similarity, 6) AS similarity FROM (SELECT *, row_number() OVER (PARTITION BY log_key ORDER BY similarity DESC, similar_key) AS r FROM k_sim WHERE similarity >= 0.3)
    WHERE r = 1""")
def similar_key(spark, sf_dir):
    """The error templates, each with the most similar other template."""
    parsed = keys.parse_lines(views.mixed_lines(spark, sf_dir), parts=["log_key"])
    distinct = materialize(parsed.select("log_key").distinct(), "templates")
    error = F.col("log_key").contains("ERROR")
    found = workflow.similar_keys(distinct.filter(error), distinct.filter(~error))
    return found.withColumn("similarity", F.round("similarity", 6))


@query("workflow_similarity", ["w_pairs"], "SELECT a, b, round(similarity, 6) AS similarity FROM w_pairs")
def workflow_similarity(spark, sf_dir):
    sets = materialize(workflow.graph_sets(run_edges(spark, sf_dir)), "graphs")
    return workflow.similar_workflows(sets).withColumn("similarity", F.round("similarity", 6))


@query("workflow_merge", ["w_merged"], "SELECT workflow_id, src, dst, first_seq, n FROM w_merged")
def workflow_merge(spark, sf_dir):
    merged, _ = workflow.merge_workflows(stored_edges(spark, sf_dir))
    return merged


# --- tasks ----------------------------------------------------------------------------------------------

define("c_after", ("v_app",), """SELECT log_key AS a, unnest([lead(log_key, 1) OVER w, lead(log_key, 2) OVER w]) AS b FROM (SELECT stream_id, seq, event_type AS log_key FROM v_app)
    WINDOW w AS (PARTITION BY stream_id ORDER BY seq)""")


@query("cooccurrence", ["c_after"], """SELECT a, b, n, n_a, round(n / (n_a * 2)::DOUBLE, 6) AS p FROM (SELECT a, b, count(*) AS n FROM c_after WHERE b IS NOT NULL GROUP BY ALL)
    JOIN (SELECT event_type AS a, count(*) AS n_a FROM v_app GROUP BY 1) USING (a)""")
def cooccurrence(spark, sf_dir):
    return workflow.cooccurrence(typed_lines(spark, sf_dir), 2).withColumn("p", F.round("p", 6))


define("t_flag", ("a_hist", "a_ctx", "a_back"), """SELECT h.stream_id, h.seq, h.log_key, coalesce(b.preds IS NOT NULL AND h.nxt IS NOT NULL AND NOT list_contains(b.preds, h.log_key) AND NOT list_contains(b.preds, h.nxt), false) AS diverges
    FROM (SELECT *, lead(log_key) OVER (PARTITION BY stream_id ORDER BY seq) AS nxt FROM a_hist) h LEFT JOIN a_back b ON h.hist = b.full_hist""")


def flagged(spark, sf_dir):
    """Divergences of the application lines from the model of their first part; stored."""
    parsed = model_queries.parsed_app(spark, sf_dir)
    model = model_queries.key_model(parsed)
    return materialize(workflow.divergences(parsed, model), "flagged"), model.window


@query("divergences", ["t_flag"], "SELECT stream_id, seq, diverges FROM t_flag")
def divergences(spark, sf_dir):
    return flagged(spark, sf_dir)[0].select("stream_id", "seq", "diverges")


@query("divergence_tasks", ["t_flag"], "SELECT stream_id, seq, (sum(diverges::INT) OVER (PARTITION BY stream_id ORDER BY seq))::BIGINT AS task_id FROM t_flag")
def divergence_tasks(spark, sf_dir):
    return workflow.tasks_without_reset(flagged(spark, sf_dir)[0]).select("stream_id", "seq", "task_id")


define("t_numbered", ("t_flag",), "SELECT stream_id, seq, diverges, row_number() OVER (PARTITION BY stream_id ORDER BY seq) AS i FROM t_flag WHERE diverges")
define("t_starts", ("t_numbered",), """WITH RECURSIVE s AS (SELECT stream_id, min(seq) AS seq FROM t_numbered GROUP BY 1 UNION ALL
    SELECT s.stream_id, (SELECT min(d.seq) FROM t_numbered d WHERE d.stream_id = s.stream_id AND d.seq >= s.seq + 3) FROM s WHERE s.seq IS NOT NULL) SELECT * FROM s WHERE seq IS NOT NULL""")


@query("tasks_model", ["t_flag", "t_starts"], """SELECT f.stream_id, f.seq, (sum(CASE WHEN s.seq IS NULL THEN 0 ELSE 1 END) OVER (PARTITION BY f.stream_id ORDER BY f.seq))::BIGINT AS task_id
    FROM t_flag f LEFT JOIN t_starts s ON f.stream_id = s.stream_id AND f.seq = s.seq""")
def tasks_model(spark, sf_dir):
    """Tasks with history reset."""
    rows, window = flagged(spark, sf_dir)
    return workflow.tasks_by_model(rows, window).select("stream_id", "seq", "task_id")


# One line of every stream per round, with what waits for a template: (template, task) pairs.
define("c_lines", ("v_app",), """SELECT stream_id, seq, CASE WHEN (seq * seq + stream_id) % 17 = 0 THEN 'retry' ELSE 'kind ' || k || ' step ' || (seq - 1) % 4 END AS log_key
    FROM (SELECT *, (((seq - 1) // 4) * ((seq - 1) // 4) + stream_id) % 3 AS k FROM v_app)""")
define("c_links", ("c_lines",), """SELECT stream_id, a, b FROM (SELECT stream_id, log_key AS a, b, count(*) AS n, sum(count(*)) OVER (PARTITION BY stream_id, log_key) AS n_a
    FROM (SELECT *, lead(log_key) OVER (PARTITION BY stream_id ORDER BY seq) AS b FROM c_lines) GROUP BY stream_id, log_key, b) WHERE b IS NOT NULL AND n / n_a > 0.9""")
define("c_marked", ("c_lines", "c_links"), """SELECT l.*, k.b AS next FROM c_lines l LEFT JOIN c_links k ON k.stream_id = l.stream_id AND k.a = l.log_key""")
define("c_tasks", ("c_marked",), """WITH RECURSIVE served AS (
    SELECT stream_id, 0::BIGINT AS seq, 0::BIGINT AS task_id, []::STRUCT(t VARCHAR, task BIGINT)[] AS waiting FROM c_marked GROUP BY stream_id
    UNION ALL
    SELECT stream_id, seq, task_id, list_concat(list_filter(waiting, lambda w: NOT (w.t = log_key AND w.task = task_id)),
           CASE WHEN next IS NULL THEN [] ELSE [{'t': next, 'task': task_id}] END)
    FROM (SELECT m.*, s.waiting, coalesce(list_min(list_transform(list_filter(s.waiting, lambda w: w.t = m.log_key), lambda w: w.task)), m.seq) AS task_id
          FROM served s JOIN c_marked m ON m.stream_id = s.stream_id AND m.seq = s.seq + 1))
    SELECT stream_id, seq, task_id FROM served WHERE seq > 0""")


@query("tasks_cooccurrence", ["c_lines", "c_tasks"], "SELECT stream_id, seq, log_key, task_id FROM c_tasks JOIN c_lines USING (stream_id, seq)")
def tasks_cooccurrence(spark, sf_dir):
    """Tasks linked by direct succession over runs of three kinds of four steps, with some steps replaced."""
    run = F.floor((F.col("seq") - 1) / 4)
    kind = F.pmod(run * run + F.col("stream_id"), F.lit(3)).cast("string")
    step = F.concat(F.lit("kind "), kind, F.lit(" step "), F.pmod(F.col("seq") - 1, F.lit(4)).cast("string"))
    retry = (F.col("seq") * F.col("seq") + F.col("stream_id")) % 17 == 0
    lines = views.app_lines(spark, sf_dir).select(
        "stream_id", "seq", F.when(retry, "retry").otherwise(step).alias("log_key")
    )
    return workflow.tasks_by_cooccurrence(materialize(lines, "steps")).select("stream_id", "seq", "log_key", "task_id")


define("t_tasks", ("t_flag", "t_starts"), """SELECT f.stream_id, f.seq, f.log_key, (sum(CASE WHEN s.seq IS NULL THEN 0 ELSE 1 END) OVER (PARTITION BY f.stream_id ORDER BY f.seq))::BIGINT AS task_id
    FROM t_flag f LEFT JOIN t_starts s ON f.stream_id = s.stream_id AND f.seq = s.seq""")
define("t_steps", ("t_tasks",), """SELECT stream_id, seq, task_id, lag(log_key) OVER w AS src, log_key AS dst, lag(task_id) OVER w AS before
    FROM t_tasks WINDOW w AS (PARTITION BY stream_id ORDER BY seq)""")
define("t_edges", ("t_steps",), "SELECT stream_id, task_id, src, dst, min(seq) - 1 AS first_seq, count(*) AS n FROM t_steps WHERE before = task_id GROUP BY ALL")
define("b_edges", ("t_edges",), "SELECT stream_id::VARCHAR || ':' || lpad(task_id::VARCHAR, 9, '0') AS workflow_id, src, dst, first_seq, n FROM t_edges")
define("b_sets", ("b_edges",), """SELECT workflow_id AS id, list_sort(list(DISTINCT src || '>' || dst)) AS edges,
    list_sort(list_distinct(list_concat(list(src), list(dst)))) AS nodes FROM b_edges GROUP BY workflow_id""")
define("b_graphs", ("b_sets",), "SELECT edges, min(id) AS id, any_value(nodes) AS nodes FROM b_sets GROUP BY edges")
define("b_pairs", ("b_graphs",), """SELECT * FROM (SELECT a.id AS a, b.id AS b, 0.4::DOUBLE * len(list_intersect(a.nodes, b.nodes)) / len(list_distinct(list_concat(a.nodes, b.nodes)))
    + 0.6::DOUBLE * len(list_intersect(a.edges, b.edges)) / len(list_distinct(list_concat(a.edges, b.edges))) AS similarity FROM b_graphs a JOIN b_graphs b ON a.id < b.id)
    WHERE similarity >= 0.7::DOUBLE - 1e-12""")
define_merge("b_graphs", "b_pairs", "b_sets", "b_edges", "b")
define("b_all", ("t_tasks", "b_map"), """SELECT workflow_id, coalesce(merged_id, workflow_id) AS merged_id, lines FROM (SELECT stream_id::VARCHAR || ':' || lpad(task_id::VARCHAR, 9, '0') AS workflow_id, count(*) AS lines
    FROM t_tasks GROUP BY ALL) LEFT JOIN b_map USING (workflow_id)""")


@query("build_workflows", ["b_all", "b_merged"], """SELECT merged_id AS workflow_id, count(*) AS tasks, sum(lines)::BIGINT AS lines, (SELECT count(*) FROM b_merged m WHERE m.workflow_id = merged_id) AS edges
    FROM b_all GROUP BY merged_id""")
def build_workflows(spark, sf_dir):
    """From lines to merged workflows in one call: size of every workflow, those of one line included."""
    rows, window = flagged(spark, sf_dir)
    merged, workflows = workflow.build_workflows(rows, lambda lines: workflow.tasks_by_model(lines, window))
    sizes = workflows.groupBy(F.col("merged_id").alias("workflow_id")).agg(
        F.count(F.lit(1)).alias("tasks"), F.sum("lines").alias("lines")
    )
    edges = merged.groupBy("workflow_id").agg(F.count(F.lit(1)).alias("edges"))
    return sizes.join(edges, "workflow_id", "left").withColumn("edges", F.coalesce("edges", F.lit(0)).cast("bigint"))


@query("task_workflows", ["t_edges"], "SELECT stream_id, task_id, src, dst, first_seq, n FROM t_edges")
def task_workflows(spark, sf_dir):
    """Edges of the workflow of every task."""
    rows, window = flagged(spark, sf_dir)
    edges = workflow.task_workflows(workflow.tasks_by_model(rows, window))
    return edges.select("workflow_id.stream_id", "workflow_id.task_id", "src", "dst", "first_seq", "n")


# --- diagnosis ------------------------------------------------------------------------------------------



define("g_step", ("a_done",), "SELECT *, lag(log_key) OVER (PARTITION BY stream_id ORDER BY seq) AS prev FROM a_done")
define("g_edges", ("g_step",), "SELECT stream_id AS wf, prev AS src, log_key AS dst, min(seq) - 1 AS first_seq FROM g_step WHERE part = 'train' AND prev IS NOT NULL GROUP BY ALL")
define("g_nodes", ("g_edges",), "SELECT wf, k, min(p) AS p FROM (SELECT wf, src AS k, first_seq AS p FROM g_edges UNION ALL SELECT wf, dst, first_seq + 1 FROM g_edges) GROUP BY ALL")
define("g_size", ("g_nodes",), "SELECT wf, count(*) AS steps, arg_min(k, p) AS start FROM g_nodes GROUP BY wf")
define("g_home", ("g_nodes",), "SELECT k, min(wf) AS home FROM g_nodes GROUP BY k")
define("g_loop", ("g_edges",), """WITH RECURSIVE r AS (SELECT wf, src, dst FROM g_edges UNION SELECT r.wf, r.src, e.dst FROM r JOIN g_edges e ON r.wf = e.wf AND r.dst = e.src)
    SELECT DISTINCT wf, src FROM r WHERE src = dst""")
define("g_succ", ("g_edges",), """SELECT wf, src, string_agg(substr(dst, 1, 50), ', ' ORDER BY r) AS e FROM (SELECT *, row_number() OVER (PARTITION BY wf, src ORDER BY first_seq, dst) AS r FROM g_edges)
    WHERE r <= 3 GROUP BY ALL""")
define("g_found", ("g_step", "g_home", "g_edges", "g_loop"), """SELECT s.stream_id, s.seq, s.log_key, s.prev, h.home AS wf, CASE WHEN s.prev IS NOT NULL AND e.src IS NULL AND l.src IS NULL THEN 'invalid_transition' END AS problem
    FROM g_step s JOIN g_home h ON h.k = s.log_key LEFT JOIN g_edges e ON e.wf = h.home AND e.src = s.prev AND e.dst = s.log_key LEFT JOIN g_loop l ON l.wf = h.home AND l.src = s.prev
    WHERE s.anomaly_type <> 'normal'""")


@query("diagnosis", ["g_found", "g_size", "g_succ"], """SELECT f.stream_id, f.seq, f.wf AS workflow_id, f.problem, concat_ws(' | ',
    CASE WHEN problem IS NOT NULL THEN 'invalid step: ' || substr(prev, 1, 50) || ' -> ' || substr(log_key, 1, 50) END,
    'expected next: ' || CASE WHEN problem IS NULL THEN a.e ELSE coalesce(b.e, c.e) END, 'workflow with ' || steps::VARCHAR || ' steps') AS diagnosis
    FROM g_found f JOIN g_size z USING (wf) LEFT JOIN g_succ a ON a.wf = f.wf AND a.src = f.log_key LEFT JOIN g_succ b ON b.wf = f.wf AND b.src = f.prev
    LEFT JOIN g_succ c ON c.wf = f.wf AND c.src = z.start""")
def diagnosis(spark, sf_dir):
    """Anomalies explained by the workflows of the users' training lines."""
    found = model_queries.detected_app(spark, sf_dir, stored=False, columns=["log_key", "part"])
    steps = materialize(workflow.with_previous_key(found.select("stream_id", "seq", "log_key", "is_anomaly", "part")), "steps")
    # the training lines are the first ones of a stream, so the line before a training line is one
    edges = materialize(workflow.transitions(steps.filter("part = 'train'"), previous_key="prev_key"), "edges")
    return workflow.diagnose(steps.filter("is_anomaly"), edges)


@query("run_positions", ["w_keys"], "SELECT workflow_id, seq, pos FROM w_keys")
def run_positions(spark, sf_dir):
    rows = runs(spark, sf_dir).select("workflow_id", "seq")
    return dense_position(rows, ["workflow_id"], ["seq"], F.lit(0), "pos")
