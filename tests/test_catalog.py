"""Registered queries against their SQL, on the smallest tables, and the entry points."""

import os

import duckdb
import pytest

import __spark_entry__ as entry
from siltscan.plans import catalog

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no tables")


def values(frame):
    frame = frame[sorted(frame.columns)].astype(object)
    frame = frame.where(frame.notna(), None)
    return sorted(str([int(x) if isinstance(x, float) and x == int(x) else x for x in r]) for r in frame.values.tolist())


@pytest.mark.parametrize("name", sorted(catalog.queries()))
def test_query(spark, name):
    got = catalog.queries()[name](spark, SF).toPandas()
    sql = catalog.oracle_sql().get(name)
    if sql is None:
        assert len(got.columns) > 0
        return
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    want = con.sql(sql).df()
    assert sorted(got.columns) == sorted(want.columns) and values(got) == values(want)


def test_entry(spark):
    assert entry.entry(spark).count() > 100
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_decode_layers_reads_whole_texts(spark, tmp_path):
    """Against a plain decoder of quoted base64; the inner layer begins behind character 300."""
    import base64

    def b64(t):
        return base64.b64encode(t.encode()).decode()

    inner = "only a plain sentence with some more words in it."
    texts = {1: "one word after another " * 60 + f" x = '{b64(inner)}'; tail", 2: "a short text of a few plain words", 3: "line of prose\n" * 3000, 4: None}

    def plain(text, depth=1):
        out, parts = [], text.replace('"', "'").split("'")
        for p in parts[1:-1]:
            if len(p) >= 16 and all(c.isalnum() or c in "+/=" for c in p):
                out += [(depth, base64.b64decode(p).decode()), *plain(base64.b64decode(p).decode(), depth + 1)]
        return out

    spark.createDataFrame([*texts.items()], "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = [(r.path, r.depth, r.decoded) for r in catalog.queries()["decode_layers"](spark, str(tmp_path)).collect()]
    want = [(f"/srv/f{i}", *x) for i, t in texts.items() if t for x in plain(f"eval('{b64(t)}');")]
    assert sorted(got) == sorted(want) and max(d for _, d, _ in want) == 2 and any(len(x) > 40_000 for *_, x in got)
