import importlib.util

import duckdb
import pytest

from sayplace.llm.oracles import ORACLES
from sayplace.llm.queries import QUERIES

#: Left out with the folder: the pipeline's file at the top.
corpus_pipeline = pytest.importorskip("corpus_pipeline") if importlib.util.find_spec("corpus_pipeline") else None


@pytest.fixture(scope="module")
def results(spark, data):
    return {name: query(spark, data).collect() for name, query in QUERIES.items()}


def test_all_queries(results):
    assert sorted(int(n[2:].split("_")[0]) for n in QUERIES) == list(range(1, 11))
    assert all(results[n] for n in QUERIES)


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_sql(results, data, name):
    con = duckdb.connect()
    for t in ("documents", "benchmark", "conversations", "pages", "labels"):
        con.sql(f"create view {t} as select * from '{data}/{t}.parquet'")
    found = con.sql(ORACLES[name])
    columns = [d[0] for d in found.description]
    rows = results[name]
    assert sorted(rows[0].asDict()) == sorted(columns)
    assert sorted(str([r[c] for c in sorted(columns)]) for r in rows) == sorted(str([v for _, v in sorted(zip(columns, x))]) for x in found.fetchall())


@pytest.fixture(scope="module")
def stages(spark, data, tmp_path_factory):
    folder = tmp_path_factory.mktemp("stages")
    docs, out = spark.read.parquet(f"{data}/documents.parquet"), []
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, docs, data).write.parquet(f"{folder}/{k}")
        docs = spark.read.parquet(f"{folder}/{k}")
        out.append(docs)
    return out


def test_stages(spark, data, stages):
    """Each stage against its own input, by the plain definition of what it drops."""
    from test_decontaminate import brute as hits
    from test_exact_dedup import brute as copies
    from test_near_dedup import brute as near

    before = spark.read.parquet(f"{data}/documents.parquet")
    kept = [{r.doc_id: r for r in df.collect()} for df in (before, *stages[:-1])]
    assert all(df.columns == before.columns for df in stages[:-1])
    assert all(set(b) <= set(a) and all(b[k] == a[k] for k in b) for a, b in zip(kept, kept[1:]))
    labels = {r.doc_id: r.toxic for r in spark.read.parquet(f"{data}/labels.parquet").collect()}
    gone = set(kept[0]) - set(kept[1])
    assert sum(labels.get(k, 1) for k in gone) >= 0.9 * len(gone)
    assert set(kept[2]) == {i for i, _, _, stays, _ in copies([(k, r.text) for k, r in kept[1].items()]) if stays}
    assert set(kept[3]) == {i for i, root in near([(k, r.text) for k, r in kept[2].items()], 5).items() if i == root}
    items = [tuple(r) for r in spark.read.parquet(f"{data}/benchmark.parquet").select("item_id", "text").collect()]
    assert set(kept[4]) == {k for k, r in kept[3].items() if not hits(r.text, items)[1]}
    assert {r.doc_id for r in stages[-1].collect()} == set(kept[4])


def test_run(spark, data, stages):
    rows = sorted(map(tuple, corpus_pipeline.run(spark, data).collect()))
    assert [r[:5] for r in rows] == [r[:5] for r in sorted(map(tuple, stages[-1].collect()))]


def test_odd_rows(spark, data, odd_documents, no_documents):
    extra = odd_documents.withColumnsRenamed({"value": "n_chars", "_bucket": "source"}).select("doc_id", "text", "lang", "source", "n_chars")
    for docs in (extra, extra.limit(0)):
        for _, stage in corpus_pipeline.STAGES[:-1]:
            assert stage(spark, docs, data).columns == docs.columns
            assert stage(spark, docs, data).count() <= docs.count()


def test_rows_that_share_an_id(spark, data, odd_documents):
    """An id with a good and a bad row keeps the good one alone."""
    item = next(r.text for r in spark.read.parquet(f"{data}/benchmark.parquet").collect() if len((r.text or "").split()) > 20)
    plain = "a plain sentence about the weather of the day, number"
    rows = [(1, f"{plain} one"), (1, f"{plain} one. {item}"), (2, f"{plain} two two"), (2, "Same text"), (3, "same TEXT"), (None, f"{plain} three"), (None, "same text")]
    docs = spark.createDataFrame([(k, t, "en", "s", 1) for k, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    stages = dict(corpus_pipeline.STAGES)
    texts = lambda df: sorted((str(r.doc_id), r.text) for r in df.collect())
    assert texts(stages["benchmark"](spark, docs, data)) == sorted((str(k), t) for k, t in rows if item not in t)
    gone = {(2, "Same text"), (None, "same text")}
    assert texts(stages["exact"](spark, docs, data)) == sorted((str(k), t) for k, t in rows if (k, t) not in gone)
