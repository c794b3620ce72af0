import hashlib

import corpus_pipeline as pipeline
from test_similar import brute

from quire.llm import bpe, queries
from quire.llm.common import stored

SF = "/root/testdata/sf0.001"


def test_stages(spark):
    """Each stage on its own input: what it keeps, and that its decisions take effect."""
    assert [n for n, _ in pipeline.STAGES] == ["toxicity", "simhash", "secrets", "mixing", "bpe"]
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    kept = stored(pipeline.drop_toxic(spark, docs, SF))
    toxic = {r.doc_id for r in queries.op1_toxicity(spark, SF).where("toxic").collect()}
    assert kept.columns == docs.columns and {r.doc_id for r in kept.collect()} == {r.doc_id for r in docs.collect()} - toxic
    single = stored(pipeline.drop_copies(spark, kept, SF))
    components = set(brute([(r.doc_id, r.text) for r in kept.collect()]))  # five words and a similarity of 0.8, by comparing all pairs
    assert sorted(r.doc_id for r in single.collect()) == sorted(components)
    planted = spark.createDataFrame([(10**6, "the password=xK9fQ2mN7p of", "en", "src0", 26)], single.schema)  # this table holds no secret
    single = single.unionByName(planted)
    components.add(10**6)
    masked = stored(pipeline.mask_secrets(spark, single, SF))
    assert masked.columns == docs.columns and sorted(r.doc_id for r in masked.collect()) == sorted(components)
    assert masked.where("doc_id = 1000000").first().text == "the <SECRET> of"
    before = {r.doc_id: r.text for r in single.collect()}
    changed = [r for r in masked.collect() if r.text != before[r.doc_id]]
    assert changed and all("<SECRET>" in r.text or "<EXAMPLE>" in r.text for r in changed) and all(r.n_chars == len(r.text) for r in changed)
    mixed = stored(pipeline.mix(spark, masked, SF))
    assert mixed.columns == docs.columns and {r.doc_id for r in mixed.collect()} <= components
    tok, texts = bpe.tokenizer(queries.tokenizer_path()), {r.doc_id: r.text for r in mixed.collect()}
    got = pipeline.encode(spark, mixed, SF).collect()
    assert len(got) == mixed.count()
    for r in got[:50]:
        assert list(r.ids) == tok.encode(texts[r.doc_id]) and r.ids_sha256 == hashlib.sha256(" ".join(map(str, r.ids)).encode()).hexdigest()


def test_run(spark):
    assert pipeline.run(spark, SF).count() > 0


def test_rerun_agrees(spark):
    one, two = ({(r.doc_id, r.ids_sha256) for r in pipeline.run(spark, SF).collect()} for _ in range(2))
    assert one == two
