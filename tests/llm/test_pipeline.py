import sys
from pathlib import Path

sys.path.insert(0, str(Path(__file__).parents[2]))

import corpus_pipeline  # noqa: E402
from loomgraph.llm import jaccard, mixing, quality, secrets  # noqa: E402
from loomgraph.runtime import saved, table  # noqa: E402

DIR = "/root/testdata/sf0.001"


def test_each_stage_does_its_work(spark):
    docs = table(spark, DIR, "documents")
    columns = docs.columns
    seen = []
    for name, stage in corpus_pipeline.STAGES:
        out = saved(stage(spark, docs, DIR), "stage")
        seen.append((name, docs, out))
        docs = out
    (_, raw, good), (_, _, one), (_, _, clean), (_, _, mixed), (_, _, packed) = seen
    assert all(x.columns == columns for x in (good, one, clean, mixed))
    trusted = table(spark, DIR, "labels").where("quality = 1")
    kept = {r["doc_id"] for r in quality.judge(raw, trusted).where("kept").collect()}
    assert {r["doc_id"] for r in good.collect()} == kept
    bad = {r["doc_id"] for r in table(spark, DIR, "labels").where("quality = 0").collect()}
    assert not kept & bad
    classes = {r["class_id"] for r in jaccard.link_classes(good).collect()}
    assert sorted(r["doc_id"] for r in one.collect()) == sorted(classes)
    assert clean.count() == one.count() and secrets.scan(clean).where("exists(secret_spans, s -> s.kind <> 'hex')").count() == 0
    wanted = mixing.mix(clean).agg({"taken": "sum"}).first()[0]
    assert sum(len((r["text"] or "").encode().split()) for r in mixed.collect()) == wanted
    assert packed.agg({"length": "max"}).first()[0] <= 4096 and packed.where("piece = 0").count() == mixed.count()


def test_all_registered_queries_are_known():
    from loomgraph.llm import entry

    assert {f"op{n}_" for n in range(1, 11)} == {q.split("_")[0] + "_" for q in entry.QUERIES}


def test_stages_take_empty_tables_nulls_repeats_and_other_columns(spark):
    from pyspark.sql import functions as F

    raw = table(spark, DIR, "documents").limit(40)
    odd = spark.createDataFrame([(None, None, None, None, None), (900001, "", "en", "src1", 0), (900002, " \n", "en", None, 2)], raw.schema)
    docs = raw.unionByName(odd).unionByName(raw.where("doc_id % 9 = 0")).withColumn("row", F.lit(1)).withColumn("turn", F.lit("x"))
    for start in (docs, docs.limit(0)):
        now = start
        for name, stage in corpus_pipeline.STAGES:
            now = saved(stage(spark, now, DIR), "odd")
            assert name == "best-fit packing" or now.columns == docs.columns
        assert start is docs or now.count() == 0


def test_the_driver_hands_back_what_it_has_freed(spark):
    """Native memory that one stage has freed is not kept through the next ones."""
    from loomgraph.runtime import tidy

    jvm = spark._jvm
    status = f"/proc/{jvm.java.lang.ProcessHandle.current().pid()}/status"

    def resident() -> int:
        with open(status) as f:
            return next(int(x.split()[1]) for x in f if x.startswith("VmRSS"))

    tidy(spark)
    made = [jvm.java.util.zip.Deflater(9) for _ in range(2000)]  # about 80 kB resident each, outside the heap
    for x in made[:-1]:
        x.end()
    for _ in range(2):
        jvm.System.gc()
    held = resident()
    tidy(spark)
    made[-1].end()
    assert held - resident() > 80_000
