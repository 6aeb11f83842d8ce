import corpus_pipeline
import pytest

from .common import TEXTS, documents
from .test_text import ITEM, brute_components, near_copies, toxic_corpus


@pytest.fixture
def folder(spark, tmp_path):
    rows = [(i, t) for i, t, _ in toxic_corpus()] + [(1000 + i, t) for i, t in near_copies(3, 4, 5)] + [(2000, f"see {ITEM} there"), *TEXTS]
    docs = documents(spark, rows, extra=False)
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(i, 1, y) for i, _, y in toxic_corpus()], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([(1, ITEM)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    return str(tmp_path), docs, rows


def test_stages(spark, folder):
    path, docs, rows = folder
    stages = dict(corpus_pipeline.STAGES)
    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "near_duplicates", "decontamination", "token_ids"]
    kept = stages["toxicity"](spark, docs, path)
    assert kept.columns == docs.columns
    ids = {r["doc_id"] for r in kept.collect()}
    toxic = {i for i, _, y in toxic_corpus() if y}
    assert len(ids & toxic) <= 0.1 * len(toxic) and {2000, 3, 5} <= ids
    once = stages["near_duplicates"](spark, docs, path)
    assert once.columns == docs.columns
    # ids are null and repeated here, so each row counts as a document of its own
    roots = brute_components(list(enumerate(t for _, t in rows)), 5, 4, 5)
    least = {}
    for k, root in roots.items():
        least.setdefault(root, []).append(rows[k][0])
    least = [min(ids, key=lambda i: (i is None, i or 0)) for ids in least.values()]
    assert sorted(least, key=str) == sorted((r["doc_id"] for r in once.collect()), key=str)
    unique = docs.filter("doc_id is not null").dropDuplicates(["doc_id"])
    found = brute_components([(r["doc_id"], r["text"]) for r in unique.collect()], 5, 4, 5)
    assert sorted(r["doc_id"] for r in stages["near_duplicates"](spark, unique, path).collect()) == sorted(set(found.values()))
    clean = stages["decontamination"](spark, docs, path)
    assert clean.columns == docs.columns and clean.count() == len(rows) - 1 and clean.filter("doc_id = 2000").isEmpty()
    tokens = stages["token_ids"](spark, docs, path)
    assert tokens.count() == len(rows) and tokens.filter("not round_trip").isEmpty()
    for stage in stages.values():
        assert stage(spark, docs.limit(0), path).count() == 0


def test_run(spark, folder):
    path, docs, rows = folder
    got = {r["doc_id"] for r in corpus_pipeline.run(spark, path).collect()}
    assert 2000 not in got and {3, 5, 7} <= got and got <= {i for i, _ in rows}


def test_executors_collect_garbage_before_token_ids(spark):
    """Workers of the last stage need the room that the heap of earlier ones has taken."""
    counts = lambda: sum(x.getCollectionCount() for x in spark.sparkContext._jvm.java.lang.management.ManagementFactory.getGarbageCollectorMXBeans() if "Young" not in x.getName())
    before = counts()
    got = corpus_pipeline.token_ids(spark, spark.createDataFrame([(1, "a text"), (2, None)], "doc_id long, text string"), "")
    assert counts() > before
    assert sorted((r["doc_id"], r["n_tokens"] > 0, r["round_trip"]) for r in got.collect()) == [(1, True, True), (2, False, True)]
