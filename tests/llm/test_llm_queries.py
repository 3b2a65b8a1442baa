"""The registered queries: against SQL, and those without SQL against plain Python."""

import sys
import zlib
from pathlib import Path

import brute
import duckdb
import numpy as np
import pytest

sys.path.insert(0, str(Path(__file__).resolve().parents[2]))

import __spark_entry__ as entry  # noqa: E402
import compare  # noqa: E402
import corpus_pipeline  # noqa: E402

FOLDER = "/root/testdata/sf0.001"

pytestmark = pytest.mark.skipif(not Path(FOLDER).exists(), reason="test tables are not here")


@pytest.fixture(scope="module")
def database():
    connection = duckdb.connect()
    for name in compare.TABLES:
        connection.execute(f"create view {name} as select * from read_parquet('{FOLDER}/{name}.parquet')")
    return connection


def rows(spark, name):
    return [tuple(r) for r in entry.queries()[name](spark, FOLDER).collect()]


def test_each_operator_has_a_query():
    numbers = sorted(int(n[2:].split("_")[0]) for n in entry.LLM_QUERIES if n.startswith("op"))
    assert numbers == list(range(1, 14)) and "pipeline" in entry.LLM_QUERIES


@pytest.mark.parametrize("name", sorted(entry.LLM_ORACLES))
def test_query_agrees_with_sql(spark, database, name):
    assert compare.compare(spark, database, FOLDER, name) is None


def test_quality_rules_run_without_python(spark):
    plan = entry.queries()["op9_host_rules"](spark, FOLDER)._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Cartesian" not in plan


def test_simhash(spark, database):
    ids, texts = zip(*database.execute("select doc_id, text from documents").fetchall())
    assert sorted(rows(spark, "op3_simhash")) == sorted(brute.simhash(ids, texts))


def test_bpe_and_token_files(spark, database):
    docs = database.execute("select doc_id, text from documents order by doc_id").fetchall()
    coder = brute.tokenizer("byte_bpe_50k.json")
    assert sorted(rows(spark, "op8_bpe")) == [(i, *brute.bpe(coder, t)) for i, t in docs]
    coder, at, want = brute.tokenizer("word_bpe_49k.json"), 0, []
    for i, t in docs:
        ids = np.array([*coder.encode(t or "", add_special_tokens=False).ids, 1], "<u4")
        want.append((i, at, len(ids), zlib.crc32(ids.tobytes())))
        at += len(ids)
    assert sorted(rows(spark, "op10_token_files")) == want


def test_embeddings(spark, database):
    table = database.execute("select vec_id, embedding, label from embeddings").fetchall()
    x, label = np.array([r[1] for r in table], float), np.array([r[2] for r in table])
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    near = (x @ x.T >= 0.93) & (label[:, None] == label)
    np.fill_diagonal(near, False)
    ids = [r[0] for r in table]
    part = brute.least_id(ids, brute.groups(len(ids), np.argwhere(near).tolist()))
    want = [(i, int(n), c, i == c) for i, n, c in zip(ids, near.sum(axis=1), part)]
    assert sorted(rows(spark, "op5_embedding_dedup")) == sorted(want)


def test_language_model(spark, database):
    from cartshift.llm.katz import good_turing

    ids, texts = zip(*database.execute("select doc_id, text from documents").fetchall())
    want, *_ = brute.katz(ids, texts, 1, good_turing)
    got = sorted(rows(spark, "op7_katz"))
    for a, b in zip(got, sorted(want), strict=True):
        assert a[:5] == b[:5] and a[5] == pytest.approx(b[5], rel=1e-9)
    held = [r for r in got if r[1]]
    assert sum(r[6] for r in held) > sum(r[5] for r in held)


def test_language_model_scores(spark, database):
    from cartshift.llm.katz import good_turing

    ids, texts = zip(*database.execute("select doc_id, text from documents").fetchall())
    want, *_ = brute.katz(ids, texts, 2, good_turing)
    for a, b in zip(sorted(rows(spark, "op7_katz")), sorted(want), strict=True):
        assert a[:5] == b[:5] and a[5:7] == pytest.approx(b[5:7], rel=1e-9)


def test_pipeline_is_its_stages(spark, database):
    """Each stage held against the rules in plain Python, on what the stage before kept."""
    import collections

    from cartshift.llm.common import stored

    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    kept = {r[0] for r in database.execute(entry.oracle_sql()["op9_host_rules"]).fetchall() if r[5] is not None} and {
        r["doc_id"] for r in entry.queries()["op9_host_rules"](spark, FOLDER).where("kept").collect()
    }
    frames = []
    for _, stage in corpus_pipeline.STAGES:
        docs = stored(stage(spark, docs, FOLDER))
        frames.append(docs)
    tables = [f.collect() for f in frames]
    assert {r["doc_id"] for r in tables[0]} == kept
    where = collections.defaultdict(set)
    clean = lambda line: brute.lower(line.strip(" \t\n\x0b\f\r"))
    for r in tables[0]:
        for line in r["text"].split("\n"):
            where[clean(line)].add(r["doc_id"])
    want = {r["doc_id"]: "\n".join(x for x in r["text"].split("\n") if not clean(x) or len(where[clean(x)]) < 10) for r in tables[0]}
    assert {r["doc_id"]: r["text"] for r in tables[1]} == want
    assert all(r["n_chars"] == len(r["text"]) for r in tables[1])
    first = {c for _, _, c in brute.simhash(*zip(*want.items()))}
    assert {r["doc_id"] for r in tables[2]} == first and len(tables[2]) == len(first)
    words = collections.Counter()
    for r in tables[3]:
        words[r["source"]] += len(brute.WORD.findall(r["text"]))
    assert {r["doc_id"] for r in tables[3]} <= first
    assert max(collections.Counter(r["doc_id"] for r in tables[3]).values()) <= 3
    coder = brute.tokenizer("byte_bpe_50k.json")
    assert sorted(map(tuple, tables[4])) == sorted((r["doc_id"], *brute.bpe(coder, r["text"])) for r in tables[3])
    assert sorted(map(tuple, corpus_pipeline.run(spark, FOLDER).collect())) == sorted(map(tuple, tables[4]))
