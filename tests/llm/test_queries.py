"""The registered queries against their SQL, and the pipeline against brute force of its stages."""

import os
import re

import duckdb
import pytest

import corpus_pipeline
from stratalog.llm import queries
from stratalog.llm.common import stored

SIZE = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SIZE), reason="no test data")
WORD = re.compile(r"[^\x20\x09-\x0D]+")


def rows(table):
    names = sorted(table.column_names)
    return sorted(map(repr, zip(*(table.column(n).to_pylist() for n in names)))), names


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_matches_sql(spark, name):
    con = duckdb.connect()
    for t in ("documents", "conversations", "benchmark"):
        con.execute(f"create view {t} as select * from '{SIZE}/{t}.parquet'")
    assert rows(queries.queries()[name](spark, SIZE).toArrow()) == rows(con.execute(queries.oracle_sql()[name]).to_arrow_table())


def test_pipeline_stages(spark):
    docs = spark.read.parquet(f"{SIZE}/documents.parquet")
    items = [r.text for r in spark.read.parquet(f"{SIZE}/benchmark.parquet").collect()]
    kept = {}
    for name, stage in corpus_pipeline.STAGES:
        before, columns = {r.doc_id: r.text for r in docs.collect()}, docs.columns
        docs = stored(stage(spark, docs, SIZE), name)
        kept[name] = (before, docs)
        if name != "mixing":
            assert docs.columns == columns
    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "near_dedup", "substring_dedup", "decontamination", "mixing"]

    before, after = kept["near_dedup"]
    left = {r.doc_id for r in after.collect()}
    sets = {}
    for i, t in before.items():
        w = WORD.findall(t.lower())
        sets[i] = {tuple(w[j : j + 5]) for j in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)}
    similar = lambda a, b: len(sets[a] & sets[b]) * 100 >= 80 * len(sets[a] | sets[b])
    assert not any(similar(a, b) for a in left for b in left if a < b)
    assert all(any(similar(i, j) for j in before if j != i) for i in set(before) - left)

    before, after = kept["substring_dedup"]
    texts = {r.doc_id: r.text for r in after.collect()}
    assert set(texts) == set(before)
    first = {}
    for i in sorted(before):
        w = WORD.findall(before[i])
        gone = set()
        for s in range(len(w) - 19):
            if first.setdefault(tuple(w[s : s + 20]), (i, s)) != (i, s):
                gone.update(range(s, s + 20))
        assert WORD.findall(texts[i]) == [x for j, x in enumerate(w) if j not in gone]

    before, after = kept["decontamination"]

    def shingles(t):
        w = re.findall(r"[^\x00-\x2f\x3a-\x40\x5b-\x60\x7b-\x7f]+", t.lower())
        return {tuple(w[i : i + 5]) for i in range(len(w) - 4)}

    known = [shingles(t) for t in items]
    held = {i: shingles(t) for i, t in before.items()}
    clean = {i for i, x in held.items() if not any(s and len(s & x) >= 0.8 * len(s) for s in known)}
    assert {r.doc_id for r in after.collect()} == clean

    before, after = kept["mixing"]
    assert all(r.taken > 0 and r["size"] == len(WORD.findall(before[r.doc_id])) for r in after.collect())
