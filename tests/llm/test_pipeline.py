"""The pipeline's stages one after another on a small corpus, and what the driver's contract asks of the entry."""

import random

import pytest

corpus_pipeline = pytest.importorskip("corpus_pipeline")

import __spark_entry__ as entry_points

from tests.llm.test_operators import WORDS, prose
from tools.check import compare, connect

SF = "/root/testdata/sf0.001"


def test_stages(spark, tmp_path):
    rnd = random.Random(20)
    good = [prose(rnd, 90) for _ in range(30)]
    near = [" ".join(g.split()[:-1] + [rnd.choice(WORDS)]) for g in good[:5]]
    lines = "\n".join(prose(rnd, 12) for _ in range(6))
    texts = good + near + [lines + "\n" + prose(rnd, 60) for _ in range(2)] + ["too short", "go " * 80, None]
    rows = [(i, t, "en", None, len(t or ""), "more") for i, t in enumerate(texts)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, _id string")
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(i, 1, 0) for i in range(0, 30, 2)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    now, kept = spark.read.parquet(f"{tmp_path}/documents.parquet"), []
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, now, str(tmp_path)).write.parquet(f"{tmp_path}/{k}")
        now = spark.read.parquet(f"{tmp_path}/{k}")
        kept.append({r.doc_id: r for r in now.collect()})
        assert k == 4 or now.columns == docs.columns, name
    assert set(kept[0]) == set(range(37))
    assert set(kept[1]) == set(kept[0]) and "\n" not in kept[1][36].text and kept[1][36].n_chars == len(kept[1][36].text) and kept[1][35].text == texts[35]
    assert set(kept[2]) == set(kept[0]) - set(range(30, 35))
    assert set(kept[3]) == set(kept[2])  # all clean
    assert set(kept[4]) == set(kept[3]) and all(r.n_tokens > 0 for r in kept[4].values())
    ran = corpus_pipeline.run(spark, str(tmp_path))
    assert sorted(map(tuple, ran.collect())) == sorted(map(tuple, now.collect()))
    nothing = docs.filter("false")
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, nothing, str(tmp_path)).count() == 0


SQL = ["op1_quality_rules", "op3_warc", "op4_suffix_dedup", "op7_exact_dedup", "op8_line_dedup", "op9_jaccard_join", "op13_conversation_repair"]


@pytest.mark.parametrize("name", SQL)
def test_query_matches_sql(spark, name):
    line, ok = compare(spark, connect(SF), SF, name)
    assert ok, line


def test_queries_without_sql():
    ours = {q for q in entry_points.queries() if q == "pipeline" or q.startswith("op")}
    assert ours - set(entry_points.oracle_sql()) == {"op2_secret_scan", "op5_bpe", "op6_source_mixing", "op10_substring_dedup", "op11_embedding_whitening", "pipeline"}


def test_queries_are_registered():
    names = list(entry_points.queries())
    assert "pipeline" in names and [n for k in range(1, 14) for n in names if n.startswith(f"op{k}_")] == [n for n in names if n.startswith("op")]
