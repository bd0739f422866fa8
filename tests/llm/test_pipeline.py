import corpus_pipeline as c
from tidemark.llm import minhash_dedup, mixing, pii, quality_rules
from tidemark.llm.common import stage


def test_stages_take_effect(spark, docs):
    # each stage is written and read again, as run() does
    docs = docs.drop("n").withColumn("n_chars", docs["size"])
    kept = stage(c.quality(spark, docs, ""), "kept")
    assert kept.columns == docs.columns
    # a column, not a filter: a filter is pushed down with every measurement written out in it, which takes minutes
    verdicts = quality_rules.ledger(docs).select(quality_rules.passes().alias("passes")).collect()
    assert kept.count() == sum(bool(r["passes"]) for r in verdicts)
    one = stage(c.near_duplicates(spark, kept, ""), "one")
    assert one.count() == minhash_dedup.keep_one(kept).count() < kept.count()
    clean = stage(c.personal_data(spark, one, ""), "clean")
    assert clean.columns == docs.columns and clean.count() == one.count()
    assert pii.scan(clean).filter("n_email + n_ip + n_card + n_phone > 0").count() == 0
    mixed = stage(c.mix(spark, clean, ""), "mixed")
    assert mixed.columns == docs.columns and mixed.count() == mixing.mix(clean).count()
    packed = c.pack(spark, mixed, "")
    assert {r[0] for r in packed.select("doc_id").distinct().collect()} == {r[0] for r in mixed.select("doc_id").distinct().collect()}


def test_names():
    assert [n for n, _ in c.STAGES] == ["quality_rules", "minhash_dedup", "pii", "mixing", "packing"]
