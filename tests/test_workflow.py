import random

import pytest
from pyspark.sql import functions as F

from siftline.operators import keys, workflow
from siftline.plans import views

SCHEMA = "stream_id string, seq bigint, log_key string"


def sequence(spark, *streams):
    rows = [(f"s{n}", i, k) for n, ks in enumerate(streams) for i, k in enumerate(ks, 1)]
    return spark.createDataFrame(rows, SCHEMA)


def brute_tasks(ks, share):
    """The greedy pass over one stream, task by task."""
    count, pairs = {}, {}
    for k in ks:
        count[k] = count.get(k, 0) + 1
    for a, b in zip(ks, ks[1:]):
        pairs[a, b] = pairs.get((a, b), 0) + 1
    link = {a: b for (a, b), n in pairs.items() if n / count[a] > share}
    task, used = {}, set()
    for i in range(len(ks)):
        if i in used:
            continue
        chain = [i]
        while ks[chain[-1]] in link:
            want = link[ks[chain[-1]]]
            nxt = next((j for j in range(chain[-1] + 1, len(ks)) if ks[j] == want and j not in used), None)
            if nxt is None:
                break
            chain.append(nxt)
        if len(chain) > 1:
            used.update(chain)
            for j in chain:
                task[j] = i
    return {i + 1: task.get(i, i) + 1 for i in range(len(ks))}


def noisy_run(rng, steps, length, noise):
    out = []
    while len(out) < length:
        for s in rng.choice(steps):
            out.append("noise" + str(rng.randrange(3)) if rng.random() < noise else s)
    return out[:length]


@pytest.mark.parametrize(
    "steps",
    [
        [["a", "b", "c", "d"], ["x", "y"], ["p", "q", "r"]],      # plain paths
        [["a", "m", "n"], ["b", "m", "n"], ["c", "b", "m", "n"]],  # several sources
        [["a", "b", "a", "b", "a", "b", "a", "b", "c"]],           # a loop
        [["s", "s", "s", "s", "s", "s", "s", "s", "t"], ["u", "s"]],
    ],
)
def test_cooccurrence_tasks_equal_greedy_pass(spark, steps):
    rng = random.Random(7)
    streams = [noisy_run(rng, steps, 90, noise) for noise in (0.0, 0.1, 0.2)]
    for share in (0.9, 0.55):
        got = workflow.tasks_by_cooccurrence(sequence(spark, *streams), share, chunk_rows=16)
        found = {}
        for r in got.collect():
            found.setdefault(r.stream_id, {})[r.seq] = r.task_id
        for n, ks in enumerate(streams):
            assert found[f"s{n}"] == brute_tasks(ks, share), (share, n)


def test_an_older_task_that_comes_later_goes_first(spark):
    ks = list("sabcxsabcxxx") * 4 + ["s", "b", "n", "a", "b", "c"]
    got = {r.seq: r.task_id for r in workflow.tasks_by_cooccurrence(sequence(spark, ks), 0.6, chunk_rows=8).collect()}
    assert got == brute_tasks(ks, 0.6) and got[54] == 49 and got[50] == 50


def test_tasks_by_model_equal_sequential_pass(spark):
    rng = random.Random(3)
    flags = [[rng.random() < p for _ in range(300)] for p in (0.05, 0.4, 0.9)]
    window = 3
    rows = [(f"s{n}", i, "k", f and i > window) for n, fs in enumerate(flags) for i, f in enumerate(fs, 1)]
    flagged = spark.createDataFrame(rows, SCHEMA + ", diverges boolean")
    got = {}
    for r in workflow.tasks_by_model(flagged, window, chunk_rows=11).collect():
        got.setdefault(r.stream_id, {})[r.seq] = r.task_id
    for n, fs in enumerate(flags):
        task, filled, want = 0, 0, {}
        for i, f in enumerate(fs, 1):
            if filled >= window and f and i > window:
                task, filled = task + 1, 0
            filled += 1
            want[i] = task
        assert got[f"s{n}"] == want


def test_task_starts_make_no_python_group_per_stream(spark, monkeypatch):
    rows = [(n, i, "k", i % 5 == 4) for n in range(40) for i in range(1, 12)] + [(None, 1, "k", True)]
    flagged = spark.createDataFrame(rows, "stream_id bigint, seq bigint, log_key string, diverges boolean")
    plans, store = [], workflow.materialize

    def stored(df, name):
        plans.append(df._jdf.queryExecution().executedPlan().toString())
        return store(df, name)

    monkeypatch.setattr(workflow, "materialize", stored)
    got = {(r.stream_id, r.seq): r.task_id for r in workflow.tasks_by_model(flagged, 6, chunk_rows=8).collect()}
    assert got == {(n, i): int(i >= 4) for n in range(40) for i in range(1, 12)}
    assert plans and not any("FlatMapGroups" in plan for plan in plans)


def test_leaders_equal_greedy_pass(spark):
    rng = random.Random(5)
    ids = [f"w{i:03d}" for i in range(60)]
    pairs = [(a, b) for i, a in enumerate(ids) for b in ids[i + 1:] if rng.random() < 0.08]
    leader, used = {}, set()
    similar = set(pairs)
    for i, a in enumerate(ids):
        if a in used:
            continue
        leader[a] = a
        for b in ids[i + 1:]:
            if b not in used and (a, b) in similar:
                leader[b] = a
                used.add(b)
    got = workflow.leaders(
        spark.createDataFrame([(i,) for i in ids], "id string"), spark.createDataFrame(pairs, "a string, b string")
    )
    assert {r.id: r.leader for r in got.collect()} == leader


def test_similar_workflows_equal_all_pairs(spark):
    rng = random.Random(11)
    graphs = {}
    for w in range(40):
        walk = [rng.choice("abcdef") for _ in range(rng.randrange(2, 9))]
        graphs[f"w{w:02d}"] = list(zip(walk, walk[1:]))
    rows = [(w, a, b, i, 1) for w, es in graphs.items() for i, (a, b) in enumerate(es, 1)]
    edges = spark.createDataFrame(rows, "workflow_id string, src string, dst string, first_seq bigint, n bigint")
    edges = edges.groupBy("workflow_id", "src", "dst").agg(F.min("first_seq").alias("first_seq"), F.sum("n").alias("n"))
    sets = workflow.graph_sets(edges)
    got = {(r.a, r.b): round(r.similarity, 9) for r in workflow.similar_workflows(sets).collect()}
    first = {}
    for w, es in sorted(graphs.items()):
        first.setdefault(frozenset(es), w)
    want = {}
    shapes = sorted((w, es) for es, w in first.items())
    for i, (a, ea) in enumerate(shapes):
        for b, eb in shapes[i + 1:]:
            na, nb = {x for e in ea for x in e}, {x for e in eb for x in e}
            s = 0.4 * len(na & nb) / len(na | nb) + 0.6 * len(ea & eb) / len(ea | eb)
            if s >= 0.7 - 1e-12:
                want[a, b] = round(s, 9)
    assert got == want and want


@pytest.mark.parametrize("letters, length", [("abcde", 8), ("abcdefghijklmnop", 14)])
def test_hardly_more_pairs_are_compared_than_are_similar(spark, letters, length):
    rng = random.Random(13)
    walks = {f"w{w:03d}": [rng.choice(letters) for _ in range(length)] for w in range(150)}
    walks |= {f"x{w}": [*walks[f"w{w:03d}"][:-2], *rng.sample(letters, 2)] for w in range(100, 150)}
    rows = [(w, a, b) for w, steps in walks.items() for a, b in sorted(set(zip(steps, steps[1:])))]
    edges = spark.createDataFrame(rows, "workflow_id string, src string, dst string")
    sets = workflow.graph_sets(edges).cache()
    want = {}
    shapes = sorted((r.id, {tuple(e) for e in r.edges}, set(r.nodes)) for r in sets.collect())
    for i, (a, ea, na) in enumerate(shapes):
        for b, eb, nb in shapes[i + 1:]:
            s = 0.4 * len(na & nb) / len(na | nb) + 0.6 * len(ea & eb) / len(ea | eb)
            if s >= 0.7 - 1e-12:
                want[a, b] = round(s, 9)
    assert {(r.a, r.b): round(r.similarity, 9) for r in workflow.similar_workflows(sets).collect()} == want and want
    numbered = workflow.numbered_sets(sets)
    tried = workflow._near(numbered, numbered, 0.7).filter("left_id < right_id").count()
    assert tried <= 1.1 * len(want) if letters == "abcde" else tried <= 3 * len(want), (tried, len(want))


def test_loops_and_paths(spark):
    edges = workflow.transitions(sequence(spark, list("abcbd"), list("xyz")))
    loops = {(r.workflow_id, r.log_key) for r in workflow.loop_nodes(edges).collect()}
    assert loops == {("s0", "b"), ("s0", "c")}
    runs = spark.createDataFrame(
        [("s1", "ok", 1, "x"), ("s1", "ok", 2, "y"), ("s1", "bad", 1, "y"), ("s1", "bad", 2, "x"), ("s1", "new", 1, "x"),
         ("s1", "new", 2, "q"), ("s0", "loop", 1, "c"), ("s0", "loop", 2, "d")],
        "workflow_id string, stream_id string, seq bigint, log_key string",
    )
    found = {r.stream_id: (r.position, r.problem, r.expected) for r in workflow.check_paths(runs, edges).collect()}
    assert found == {"bad": (2, "invalid_transition", ["z"]), "new": (2, "unknown_key", ["y"])}


def test_no_edges_for_short_sequences(spark):
    assert workflow.transitions(sequence(spark, ["a"])).count() == 0


def test_similar_key_needs_common_words(spark):
    known = spark.createDataFrame([("INFO open file *",), ("INFO close file *",), ("other",)], "log_key string")
    unknown = spark.createDataFrame([("INFO open the file *",), ("nothing alike",)], "log_key string")
    got = workflow.similar_keys(unknown, known).collect()
    assert [(r.log_key, r.similar_key, round(r.similarity, 2)) for r in got] == [("INFO open the file *", "INFO open file *", 0.8)]


def test_similar_key_equals_brute_force_and_tries_few_pairs(spark, monkeypatch):
    rng = random.Random(5)
    common = [f"c{i}" for i in range(12)]

    def template(tag):
        return " ".join(["INFO", *rng.sample(common, rng.randrange(1, 7)), *(f"{tag}{rng.randrange(60)}" for _ in range(rng.randrange(1, 5)))])

    known = {template(rng.choice("xy")) for _ in range(400)} | {"", " "}
    unknown = {template("x") for _ in range(60)} | {" ".join([*k.split()[:-1], "new"]) for k in sorted(known)[:80]} | {"", "nothing alike"}
    want = {}
    for u in unknown:
        a = set(u.lower().split())
        scores = {k: len(a & b) / len(a | b) for k in known if (b := set(k.lower().split())) and a}
        if scores and (most := max(scores.values())) >= 0.3:
            want[u] = (min(k for k in scores if scores[k] == most), round(most, 9))
    tried = []
    plain = workflow._prefix_pairs

    def counted(*sides):
        tried.append((pairs := plain(*sides)).count())
        return pairs

    monkeypatch.setattr(workflow, "_prefix_pairs", counted)
    as_rows = lambda keys: spark.createDataFrame([(k,) for k in sorted(keys)], "log_key string")
    got = {r.log_key: (r.similar_key, round(r.similarity, 9)) for r in workflow.similar_keys(as_rows(unknown), as_rows(known)).collect()}
    assert got == want
    sets = [as_rows(k).select(F.col("log_key").alias("id"), workflow.tokens("log_key").alias("items")) for k in (unknown, known)]
    assert sum(tried) * 4 < workflow._pruned_pairs(*sets, "word", 0.3).count(), tried


def test_diagnosis_names_problem_and_expected_steps(spark):
    edges = workflow.transitions(sequence(spark, ["INFO start", "INFO work on *", "INFO stop"]))
    anomalies = spark.createDataFrame(
        [("t", 5, "INFO work at *", "INFO start"), ("t", 6, "INFO stop", "INFO start"), ("t", 7, "INFO work on *", "INFO start")],
        "stream_id string, seq bigint, log_key string, prev_key string",
    )
    got = {r.seq: (r.problem, r.diagnosis) for r in workflow.diagnose(anomalies, edges).collect()}
    assert got[5] == (
        "unknown_key",
        "unknown template: INFO work at *, most similar: INFO work on * | expected next: INFO work on * | workflow with 3 steps",
    )
    assert got[6][0] == "invalid_transition" and "INFO start -> INFO stop" in got[6][1]
    assert got[7] == (None, "expected next: INFO stop | workflow with 3 steps")


def test_diagnosis_takes_only_the_workflows_that_explain(spark, monkeypatch):
    edges = workflow.transitions(sequence(spark, list("abc"), list("abca"), list("bcxb"), list("cab")))
    anomalies = spark.createDataFrame(
        [("t", 1, "x", "b"), ("t", 2, "a", None), ("t", 3, "zz", "a"), ("t", 4, None, "a"), ("t", 5, "x", "x")],
        "stream_id string, seq bigint, log_key string, prev_key string",
    )
    asked, real = [], workflow.loop_nodes
    monkeypatch.setattr(workflow, "loop_nodes", lambda e: asked.extend(r.workflow_id for r in e.collect()) or real(e))
    got = {r.seq: (r.workflow_id, r.problem, r.diagnosis) for r in workflow.diagnose(anomalies, edges).collect()}
    assert set(asked) == {"s0", "s2"}
    assert got == {
        1: ("s2", None, "expected next: b | workflow with 3 steps"),  # b lies on a loop of s2
        2: ("s0", None, "expected next: b | workflow with 3 steps"),
        3: ("s0", "unknown_key", "unknown template: zz | expected next: b | workflow with 3 steps"),
        4: ("s0", "unknown_key", "expected next: b | workflow with 3 steps"),
        5: ("s2", None, "expected next: b | workflow with 3 steps"),
    }


def test_transitions_of_lines_that_know_the_one_before(spark):
    rows = sequence(spark, list("abcab"), list("x"), list("aab"))
    known = workflow.transitions(workflow.with_previous_key(rows, chunk_rows=2), previous_key="prev_key")
    assert sorted(known.collect()) == sorted(workflow.transitions(rows).collect())


def test_app_lines_number_long_and_short_users_alike(spark, tmp_path, monkeypatch):
    times = ["10:00:05", "10:00:05", "10:25:00", "10:01:00", "11:59:59", "23:00:00"]
    rows = [(i, f"2024-01-02 {t}", user) for i, t in enumerate(times) for user in (1, 2)][:-2] + [(90, None, 1), (91, "2024-01-02 00:00:00", None), (92, None, 3), (93, "2024-01-01 00:00:00", 3)]
    events = spark.createDataFrame(rows, "event_id bigint, ts string, user_id bigint").selectExpr(
        "event_id", "ts::timestamp_ntz AS ts", "user_id", "'view' AS event_type", "1.5D AS value")
    events.filter("event_id <> 4 OR user_id = 1").write.parquet(f"{tmp_path}/events.parquet")
    monkeypatch.setattr(views, "CHUNK_ROWS", 4)
    got = sorted((r.stream_id, r.seq, r.raw[11:19]) for r in views.app_lines(spark, str(tmp_path)).collect())
    short = ["10:00:05", "10:00:05", "10:01:00", "10:25:00"]
    assert got == [(1, i + 2, t) for i, t in enumerate([*short, "11:59:59"])] + [(2, i + 1, t) for i, t in enumerate(short)] + [(3, 2, "00:00:00")]


def test_merge_keeps_distinct_edges_under_the_leader(spark):
    edges = workflow.transitions(sequence(spark, list("abcd"), list("abcd"), list("abcde"), list("xyz")))
    merged, mapping = workflow.merge_workflows(edges)
    assert {r.workflow_id: r.merged_id for r in mapping.collect()} == {"s0": "s0", "s1": "s0", "s2": "s0", "s3": "s3"}
    assert {(r.workflow_id, r.src, r.dst, r.n) for r in merged.collect()} == {
        ("s0", "a", "b", 3), ("s0", "b", "c", 3), ("s0", "c", "d", 3), ("s0", "d", "e", 1), ("s3", "x", "y", 1), ("s3", "y", "z", 1),
    }


def test_task_workflows_stay_inside_tasks(spark):
    tasks = sequence(spark, list("abcab")).withColumn("task_id", F.when(F.col("seq") < 4, 0).otherwise(1).cast("bigint"))
    got = {(r.workflow_id.task_id, r.src, r.dst) for r in workflow.task_workflows(tasks, chunk_rows=2).collect()}
    assert got == {(0, "a", "b"), (0, "b", "c"), (1, "a", "b")}


def test_divergence_looks_at_this_and_the_next_template(spark):
    # After an unknown history the most frequent template, c, is predicted.
    model = keys.train(sequence(spark, list("abcabcabcabc")), window=2, top_g=1)
    got = workflow.divergences(sequence(spark, list("abcxyabc")), model, top=1, chunk_rows=3)
    assert [r.seq for r in got.filter("diverges").orderBy("seq").collect()] == [4, 5, 6]


def reach(edges):
    out = set(edges)
    while True:
        more = {(a, d) for a, b in out for c, d in edges if b == c} - out
        if not more:
            return out
        out |= more


def test_loop_nodes_and_components_equal_closure(spark):
    rng = random.Random(17)
    graphs = {"ring": [(f"r{i:02d}", f"r{(i + 1) % 40:02d}") for i in range(40)], "own": [("a", "a"), ("a", "b")]}
    graphs["path between loops"] = [("a", "b"), ("b", "a"), ("b", "p1"), ("p1", "p2"), ("p2", "c"), ("c", "d"), ("d", "c")]
    graphs["back by a chain"] = [("a", "x"), ("x", "y"), ("y", "a"), ("a", "z"), ("z", "a"), ("a", "end")]
    for n in range(25):
        names = [f"n{i}" for i in range(rng.randrange(2, 9))]
        graphs[f"g{n}"] = list({(rng.choice(names), rng.choice(names)) for _ in range(rng.randrange(1, 14))})
    rows = [(w, a, b, 1, 1) for w, es in graphs.items() for a, b in es]
    edges = spark.createDataFrame(rows, "workflow_id string, src string, dst string, first_seq bigint, n bigint")
    want, parts = set(), set()
    for w, es in graphs.items():
        far = reach(es)
        want |= {(w, a) for a, b in far if a == b}
        for node in {x for e in es for x in e}:
            parts.add((w, frozenset([node] + [b for a, b in far if a == node and (b, a) in far])))
    assert {(r.workflow_id, r.log_key) for r in workflow.loop_nodes(edges).collect()} == want
    found = {}
    for r in workflow.strong_components(edges).collect():
        found.setdefault((r.workflow_id, r.component), []).append(r.log_key)
    assert {(w, frozenset(x)) for (w, _), x in found.items()} == parts
    assert workflow.loop_nodes(edges.limit(0)).count() == 0


@pytest.mark.parametrize("small", [0, 3])
def test_loop_nodes_send_no_table_through_the_driver(spark, monkeypatch, small):
    rng = random.Random(31)
    graphs = {n: {(rng.choice("abcdef"), rng.choice("abcdef")) for _ in range(rng.randrange(1, 9))} for n in range(12)}
    rows = [(w, a, b) for w, es in graphs.items() for a, b in es] + [(None, "a", "a"), (1, None, "a"), (1, "a", None)]
    edges = spark.createDataFrame(rows, "workflow_id bigint, src string, dst string")
    plans, store = [], workflow.materialize

    def stored(df, name):
        plans.append(df._jdf.queryExecution().executedPlan().toString())
        return store(df, name)

    monkeypatch.setattr(workflow, "materialize", stored)
    monkeypatch.setattr(workflow, "SMALL_GRAPH", small)
    got = sorted((r.workflow_id, r.log_key) for r in store(workflow.loop_nodes(edges), "found").collect())
    assert got == sorted({(w, a) for w, es in graphs.items() for a, b in reach(es) if a == b})
    assert len(plans) > 2 and not any("Broadcast" in plan for plan in plans)


def test_loops_of_small_graphs_need_no_rounds(spark, monkeypatch):
    edges = spark.createDataFrame([("w", "a", "b"), ("w", "b", "a"), ("w", "b", "c"), ("v", "a", "b")], "workflow_id string, src string, dst string")
    stored, store = [], workflow.materialize
    monkeypatch.setattr(workflow, "materialize", lambda df, name: stored.append(name) or store(df, name))
    assert {(r.workflow_id, r.log_key) for r in workflow.loop_nodes(edges).collect()} == {("w", "a"), ("w", "b")}
    assert len(stored) <= 2


def test_leaders_by_rounds_equal_greedy_pass(spark):
    rng = random.Random(23)
    graphs = {}
    for w in range(36):
        base = "abcde" if w < 12 else "vwxyz" if w > 27 else "abcdefghij"
        walk = [rng.choice(base) for _ in range(rng.randrange(3, 8))]
        graphs[f"w{w:02d}"] = list(zip(walk, walk[1:]))
    rows = [(w, a, b, i, 1) for w, es in graphs.items() for i, (a, b) in enumerate(es, 1)]
    sets = workflow.graph_sets(spark.createDataFrame(rows, "workflow_id string, src string, dst string, first_seq bigint, n bigint"))
    for threshold in (0.5,):
        alike = {(r.a, r.b) for r in workflow.similar_workflows(sets, threshold).collect()}
        want = {}
        for i in sorted(r.id for r in sets.collect()):
            want[i] = next((a for a in sorted(want) if want[a] == a and (a, i) in alike), i)
        assert 3 < len(set(want.values())) < len(want)
        got = {r.id: r.leader for r in workflow.greedy_leaders(sets, threshold, first_block=8).collect()}
        assert got == want
