import ast
import pathlib

import public_tokenizers
import tiktoken

import corpus_pipeline
from siftline.llm.bpe import read_ranks

from . import edge
from .test_jaccard import brute as near_groups
from .test_quality import brute as stats
from .test_substring import brute as repeats

SF = "/root/testdata/sf0.001"


def test_each_stage_against_brute_force(spark, tmp_path):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns = docs.columns
    rows = {r.doc_id: r.text for r in docs.collect()}
    for number, (name, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, docs, SF).write.parquet(str(tmp_path / str(number)))
        docs = spark.read.parquet(str(tmp_path / str(number)))
        found = {r.doc_id: r for r in docs.collect()}
        assert len(found) == docs.count()
        if number < 4:
            assert docs.columns == columns
            texts = {i: r.text for i, r in found.items()}
        if number == 0:
            passed = {i for i, t in rows.items() if (s := stats(t))[0] >= 50 and 2 * s[4] <= s[0]}
            labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}
            assert set(texts) <= passed and all(texts[i] == rows[i] for i in texts)
            assert {i for i in passed if labels.get(i) == 1} <= set(texts)
            assert not {i for i in texts if labels.get(i) == 0}
        elif number == 1:
            assert set(texts) == {c for _, _, c in near_groups(list(rows.items()))} and all(texts[i] == rows[i] for i in texts)
        elif number == 2:
            want = {i: (k, t) for i, _, k, t in repeats(list(rows.items()), 50)}
            assert set(texts) == set(rows)
            for i, t in texts.items():
                assert t == (want[i][1] if want[i][0] else rows[i]) and found[i].n_chars == len(t)
        elif number == 3:
            items = [r.text for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
            held = {i for i, t in rows.items() if any(x in t for x in items)}
            assert not held & set(texts) and len(set(rows) - held - set(texts)) <= 2
        else:
            ranks = read_ranks(public_tokenizers.path("byte_bpe_50k.tiktoken"))
            peer = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
            assert set(found) == set(rows) and all(r.round_trip and r.n_tokens == len(peer.encode_ordinary(rows[i])) for i, r in found.items())
        rows = texts
    assert len(rows) > 50


def test_stages_bear_edges(spark):
    wide = "doc_id bigint, text string, lang string, source string, n_chars bigint"
    for docs in (edge.documents(spark).select(*[f.split(" ")[0] for f in wide.split(", ")]), spark.createDataFrame([], wide)):
        for _, stage in corpus_pipeline.STAGES:
            assert stage(spark, docs, SF).count() <= docs.count()


def test_nothing_else_imports_this_subpackage():
    root = pathlib.Path(corpus_pipeline.__file__).parent
    for path in [*root.glob("siftline/**/*.py"), *root.glob("tests/*.py"), root / "bench.py"]:
        if "llm" in path.relative_to(root).parts:
            continue
        for node in ast.walk(ast.parse(path.read_text())):
            names = [a.name for a in node.names] if isinstance(node, ast.Import) else [node.module or ""] if isinstance(node, ast.ImportFrom) else []
            assert not any("llm" in n.split(".") or n == "corpus_pipeline" for n in names), path
