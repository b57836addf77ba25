import pytest
from pyspark.sql import functions as F

from voxloom.operators import joins, labels, store
from voxloom.sources import tables


@pytest.fixture
def texts(spark):
    return spark.createDataFrame([("a", "one"), ("b", "two"), ("c", "one")], ["sample_id", "transcript"])


def test_dedup_resume_and_index(spark, texts, tmp_path):
    path = str(tmp_path / "store")
    first = store.materialize_embeddings(texts, "transcript", path, "c1", 8)
    assert (first["selected"], first["processed"], first["calls_saved"], first["skipped"]) == (3, 2, 1, 0)
    again = store.materialize_embeddings(texts, "transcript", path, "c1", 8)
    assert (again["processed"], again["skipped"]) == (0, 2)
    more = texts.unionByName(spark.createDataFrame([("d", "three")], ["sample_id", "transcript"]))
    assert store.materialize_embeddings(more, "transcript", path, "c1", 8)["processed"] == 1
    assert store.materialize_embeddings(texts, "transcript", path, "c2", 8)["processed"] == 2
    stored = tables.read_embeddings(spark, path, "text", "c1")
    index = {r.sample_id: r for r in store.cache_index(texts, "transcript", stored).collect()}
    assert index["a"].key_hash == index["c"].key_hash and index["b"].embedding_dimension == 8
    missing = spark.createDataFrame([("z", "never")], ["sample_id", "transcript"])
    with pytest.raises(Exception, match="no stored vector for z"):
        store.cache_index(missing, "transcript", stored).collect()


def test_caller_supplied_encoder_and_its_checks(spark, texts, tmp_path):
    encode = store.pandas_encoder(lambda batch: [[float(len(t)), 1.0] for t in batch])
    path = str(tmp_path / "ok")
    assert store.materialize_embeddings(texts, "transcript", path, "c", 2, encoder=encode)["processed"] == 2
    assert {tuple(r.embedding) for r in tables.read_embeddings(spark, path, "text", "c").collect()} == {(3.0, 1.0)}
    for bad in (lambda b: [[1.0] for _ in b], lambda b: [[float("nan"), 1.0] for _ in b]):
        broken = str(tmp_path / f"bad{id(bad)}")
        with pytest.raises(Exception, match="invalid vector"):
            store.materialize_embeddings(texts, "transcript", broken, "c", 2, encoder=store.pandas_encoder(bad))
        assert tables.read_embeddings(spark, broken, "text", "c").count() == 0


def test_a_vector_of_the_wrong_size_is_encoded_again(spark):
    rows = [("h1", [1.0, 2.0], "c"), ("h2", [1.0], "c"), ("h3", [float("inf"), 0.0], "c"), ("h4", [1.0, 1.0], "old")]
    stored = spark.createDataFrame(rows, ["key_hash", "embedding", "contract_sha256"])
    todo = spark.createDataFrame([(f"h{i}",) for i in range(1, 6)], ["key_hash"])
    got = {r.key_hash for r in store.resume_pending(todo, stored, "c", 2).collect()}
    assert got == {"h2", "h3", "h4", "h5"}


def test_contract_hash_ignores_column_order_and_keeps_nulls(spark):
    a = store.settings_hash(spark, {"b": 1, "a": None})
    assert a == store.settings_hash(spark, {"a": None, "b": 1}) != store.settings_hash(spark, {"b": 1})


def test_guards(spark):
    facts, dim = spark.createDataFrame([(1,), (2,)], ["k"]), spark.createDataFrame([(1, "x")], ["k", "v"])
    with pytest.raises(Exception, match="absent from the dimension: 2"):
        joins.dim_join(facts, dim, "k").collect()
    with pytest.raises(Exception, match="unsupported label: dog"):
        labels.label_index(spark.createDataFrame([("dog",)], ["l"]), "l", {"cat": 0}, "i").collect()
    with pytest.raises(ValueError):
        labels.check_vocabulary({"a": 0, "b": 2})
    with pytest.raises(Exception, match="empty class: b"):
        labels.class_weights(spark.createDataFrame([("a",)], ["l"]), "l", ["a", "b"]).collect()


def test_tolerance(spark):
    a = spark.createDataFrame([(1, 1.0), (2, 1.0), (3, 1.0)], ["k", "declared"])
    b = spark.createDataFrame([(1, 1.05), (2, 1.2)], ["k", "measured"])
    got = {r.k: r.ok for r in joins.tolerance_reconcile(a, b, "k", 0.1).collect()}
    assert got == {1: True, 2: False, 3: False}


def test_pairing_reports_repeats(spark):
    left, right = spark.createDataFrame([(1,), (2,)], ["k"]), spark.createDataFrame([(1,), (1,), (3,)], ["k"])
    got = {r.k: r.status for r in joins.pairing_check(left, right, "k").collect()}
    assert got == {1: "repeated", 2: "missing_media", 3: "orphan_media"}


def test_class_weights_are_balanced(spark):
    df = spark.createDataFrame([("a",)] * 3 + [("b",)], ["l"])
    got = {r.l: r.weight for r in labels.class_weights(df, "l", ["a", "b"]).collect()}
    assert got == {"a": pytest.approx(4 / 6), "b": pytest.approx(2.0)}
    assert df.select(F.col("l")).count() == 4


def test_contract_documents(spark, tmp_path):
    import json

    good = {"modality": "visual", "cache_dtype": "float32", "embedding_dimension": 2, "manifest_sha256": "m", "frames_per_clip": 8}
    cases = {
        "a": (good, {}, []), "b": ({**good, "cache_dtype": "float16", "modality": "audio"}, {}, ["modality", "cache_dtype"]),
        "c": ({**good, "embedding_dimension": 3, "frames_per_clip": 0}, {}, ["dimension", "frames_per_clip"]),
        "d": ({**good, "manifest_sha256": None}, {}, ["manifest"]), "e": ({**good, "manifest_sha256": None}, {"summary_sha256": "m"}, []),
        "f": (good, {"tensor_key": "frame_embeddings"}, ["tensor_key"]),
        "g": ({**good, "stores_frame_embeddings": True}, {"tensor_key": "frame_embeddings"}, []),
    }
    for name, (document, options, want) in cases.items():
        path = tmp_path / f"{name}.json"
        path.write_text(json.dumps(document, indent=1))
        got = tables.contract_problems(tables.read_contracts(spark, str(path)), "visual", 2, "m", **options).first()
        assert got.problems == want, name


def test_contracts_query_writes_no_file_per_row(spark, sf_dir, tmp_path, monkeypatch):
    from voxloom.plans import corpus

    monkeypatch.setattr(corpus, "new_folder", lambda *_: str(tmp_path / "contracts"))
    found = corpus.contract_problems(spark, sf_dir).count()
    assert found == spark.read.parquet(f"{sf_dir}/supplier.parquet").count() > 8
    assert len(list((tmp_path / "contracts").glob("part-*"))) <= 8
    lines = tables.read_contracts(spark, str(tmp_path / "contracts"), one_document_per_file=False)
    assert lines.where("model_identifier is null").count() == 0
