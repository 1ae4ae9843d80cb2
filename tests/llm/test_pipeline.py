import zlib

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from tests.llm.test_decontaminate import slow
from tests.llm.test_packing import _ids
from tests.llm.test_simhash import slow_components, slow_print

from framesieve.llm import pii, toxicity
from framesieve.llm.common import stored


@pytest.fixture(scope="module")
def odd(spark, sf, tmp_path_factory):
    """A folder of tables: odd rows beside ordinary ones, and extra columns with names that the stages use themselves."""
    path = tmp_path_factory.mktemp("odd")
    texts = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text", "lang", "source", "n_chars")
    item = " ".join(f"item{i}" for i in range(12))
    rows = [
        (9001, None, "en", "s", None), (9002, "", "en", None, 0), (9003, " \n", None, "s", 2),
        (None, "a text without an id, " + " ".join(f"none{i}" for i in range(30)), "en", "s", 9),
        (9004, "mail a.b@c.de " + " ".join(f"w{i}" for i in range(60)), "en", "s", 9),
        (9004, "mail a.b@c.de " + " ".join(f"w{i}" for i in range(60)), "en", "s", 9),
        (9005, "long " + " ".join(f"v{i}" for i in range(30_000)), "en", "s", 9),
        (9006, "leaked " + item + " passage", "en", "s", 9),
    ]
    docs = texts.union(spark.createDataFrame(rows, texts.schema))
    names = ["score", "_score", "_toxicity", "fp", "component_id", "_gone_id", "contaminated", "ids", "part", "base", "_row"]
    docs = docs.withColumns({n: F.lit(i) for i, n in enumerate(names)})
    docs.write.parquet(f"{path}/documents.parquet")
    spark.read.parquet(f"{sf}/labels.parquet").write.parquet(f"{path}/labels.parquet")
    bench = spark.createDataFrame([(1, item), (2, None), (3, "")], "item_id long, text string")
    bench.write.parquet(f"{path}/benchmark.parquet")
    return str(path)


def test_odd_rows(spark, odd):
    first = spark.read.parquet(f"{odd}/documents.parquet")
    now, kept = first, {}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        now = stored(stage(spark, now, odd), f"odd-{name}")
        assert now.columns == first.columns and now.dtypes == first.dtypes
        kept[name] = now.where("doc_id > 9000 OR doc_id IS NULL").collect()
    pieces = corpus_pipeline.STAGES[-1][1](spark, now, odd).collect()

    def ids(name):
        return sorted((-1 if r.doc_id is None else r.doc_id) for r in kept[name])

    assert ids("toxicity") == [-1, 9001, 9002, 9003, 9004, 9004, 9005, 9006]
    # No word: a fingerprint of zero, which the given documents' empty texts have too.
    assert {9002, 9003}.isdisjoint(ids("near_duplicates"))
    assert [i for i in ids("near_duplicates") if i != 9001] == [-1, 9004, 9004, 9005, 9006]
    assert [i for i in ids("decontamination") if i != 9001] == [-1, 9004, 9004, 9005]
    for r in kept["personal_data"]:
        if r.doc_id == 9004:
            assert r.text.startswith("mail <EMAIL> w0") and r.n_chars == len(r.text)
    assert {r.doc_id for r in pieces} == {r.doc_id for r in now.select("doc_id").collect()}
    assert sum(r.doc_id == 9004 and r.start == 0 for r in pieces) == 2


def test_empty_tables(spark, odd, tmp_path):
    for name in ("documents", "labels", "benchmark"):
        spark.read.parquet(f"{odd}/{name}.parquet").limit(0).write.parquet(f"{tmp_path}/{name}.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).collect() == []


def test_stages_and_run(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    labels = spark.read.parquet(f"{sf}/labels.parquet")
    bench = [(r.item_id, r.text) for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()]
    now = docs
    kept = {}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, now, sf)
        assert out.columns == docs.columns and out.dtypes == docs.dtypes
        now = spark.createDataFrame(out.collect(), docs.schema)
        kept[name] = {r.doc_id: r.text for r in now.collect()}
    texts = {r.doc_id: r.text for r in docs.collect()}

    model = toxicity.train(docs, labels)
    # The scores themselves are held to the model's definition in test_toxicity.
    scores = {r.doc_id: r.score for r in toxicity.scored(docs, model).collect()}
    want = {i: t for i, t in texts.items() if scores[i] < 0.3}
    assert len(want) < len(texts)
    assert kept["toxicity"] == want
    least = slow_components({i: slow_print(t) for i, t in want.items()})
    want = {i: t for i, t in want.items() if least[i] == i}
    assert kept["near_duplicates"] == want
    bad = {r[0] for r in slow(want.items(), bench) if r[5]}
    want = {i: t for i, t in want.items() if i not in bad}
    assert kept["decontamination"] == want and bad
    got = kept["personal_data"]
    assert got.keys() == want.keys()
    assert any(got[i] != want[i] for i in want)
    assert all(got[i] == want[i] for i in want if not pii._TRIGGER.search(want[i]))
    assert not any(pii.base_spans(t) for t in got.values())

    pieces = corpus_pipeline.run(spark, sf).collect()
    assert {r.doc_id for r in pieces} == got.keys()
    ids = {i: _ids(t) for i, t in got.items()}
    for r in pieces:
        assert r.ids_crc32 == zlib.crc32(ids[r.doc_id][r.start : r.start + r.length].tobytes())
    assert sum(r.length for r in pieces) == sum(map(len, ids.values()))
