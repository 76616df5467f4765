"""Queries of this subpackage, each applying one operator to its whole table, and the SQL of those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..runtime import ship, table
from . import jaccard, licenses, mixing, neardup, packing, quality, secrets, substrings, suffixtree, toxicity


def _tokenizer(name: str = "word_bpe_49k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    ship(spark)
    return packing.pack(table(spark, sf_dir, "documents"), _tokenizer())


def op2_embedding_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    ship(spark)
    return neardup.link_vectors(table(spark, sf_dir, "embeddings"))


def op3_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    trusted = table(spark, sf_dir, "labels").where("quality = 1")
    return quality.judge(table(spark, sf_dir, "documents"), trusted)


def op4_suffix_tree_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    ship(spark)
    return suffixtree.score(table(spark, sf_dir, "documents"))


def op5_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    ship(spark)
    return licenses.scan(table(spark, sf_dir, "documents")).select(
        "doc_id",
        F.size("matches").cast("long").alias("n_matches"),
        F.array_join(F.array_sort(F.array_distinct(F.transform("matches", lambda m: m["template"]))), ",").alias("licenses"),
        F.array_join(F.transform("matches", lambda m: F.concat_ws(":", m["template"], m["start"].cast("string"), m["end"].cast("string"), F.round(m["coverage"], 4).cast("string"))), ",").alias("spans"),
    )


def op6_toxicity_chain(spark: SparkSession, sf_dir: str) -> DataFrame:
    ship(spark)
    labels = table(spark, sf_dir, "labels").select("doc_id", (1 - F.col("quality")).alias("low_quality"), "toxic")
    return toxicity.classify(table(spark, sf_dir, "documents"), labels, ("low_quality", "toxic"))


def op7_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    ship(spark)
    return substrings.remove_repeats(table(spark, sf_dir, "documents"))


def op8_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    ship(spark)
    return mixing.mix(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")


def op9_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = secrets.scan(table(spark, sf_dir, "documents").select("doc_id", "text"))
    spans = F.col("secret_spans")
    count = lambda kind: F.size(F.filter(spans, lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")
    return found.select(
        F.col("doc_id").cast("long").alias("doc_id"),
        count("assign"),
        count("access"),
        count("hex"),
        F.sha2(secrets.digest(F.filter(spans, lambda s: s["kind"] != "entropy")), 256).alias("base_sha256"),
        secrets.digest(spans).alias("spans"),
    )


def op10_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    ship(spark)
    linked = jaccard.link_classes(table(spark, sf_dir, "documents"))
    return linked.select("doc_id", "class_id", "n_links", F.col("doc_id").eqNullSafe(F.col("class_id")).alias("kept"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_best_fit_packing": op1_best_fit_packing,
    "op2_embedding_near_dedup": op2_embedding_near_dedup,
    "op3_quality_rules": op3_quality_rules,
    "op4_suffix_tree_scores": op4_suffix_tree_scores,
    "op5_license_scan": op5_license_scan,
    "op6_toxicity_chain": op6_toxicity_chain,
    "op7_substring_dedup": op7_substring_dedup,
    "op8_mixing": op8_mixing,
    "op9_secret_scan": op9_secret_scan,
    "op10_ngram_jaccard_join": op10_ngram_jaccard_join,
}
_WORDS = r"regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')"
#: DuckDB SQL of the queries that SQL can express; the others need a tokenizer, a model or a hash that it has not.
SQL: dict[str, str] = {
    "op2_embedding_near_dedup": """with recursive v as (select vec_id, embedding::double[] e from embeddings where len(embedding) > 0
          and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0 and len(list_filter(embedding, lambda x: x <> 0)) > 0),
        l as (select a.vec_id a, b.vec_id b from v a join v b on a.vec_id <> b.vec_id and len(a.e) = len(b.e) where list_cosine_similarity(a.e, b.e) >= 0.9),
        r(n, c) as (select vec_id, vec_id from embeddings union select l.b, r.c from r join l on l.a = r.n),
        k as (select n, min(c) c from r group by n), d as (select a, count(*) n from l group by a)
        select e.vec_id, coalesce(d.n, 0) n_links, k.c component_id, e.vec_id = k.c kept from embeddings e join k on k.n = e.vec_id left join d on d.a = e.vec_id""",
    "op7_substring_dedup": f"""with d as (select doc_id, {_WORDS} w from documents),
        x as (select doc_id, w, unnest(range(1, len(w) - 33)) i from d), y as (select doc_id, i, array_to_string(w[i:i+34], ' ') s from x),
        z as (select s from y group by s having count(*) > 1), c as (select distinct doc_id, unnest(range(i, i + 35)) p from y where s in (select s from z)),
        t as (select doc_id, unnest(w) o, unnest(range(1, len(w) + 1)) p from d),
        k as (select doc_id, string_agg(o, ' ' order by p) s, count(*) n from t anti join c using (doc_id, p) group by doc_id)
        select d.doc_id, len(w)::bigint n_words, len(w) - coalesce(k.n, 0) n_removed, sha256(coalesce(k.s, '')) kept_sha256 from d left join k using (doc_id)""",
    "op10_ngram_jaccard_join": f"""with recursive d as (select doc_id, coalesce(text, '') t, {_WORDS} w from documents), x as (select doc_id, w, unnest(range(1, len(w) - 3)) i from d where len(w) >= 5),
        s as (select distinct doc_id, array_to_string(w[i:i+4], ' ') h from x union all select doc_id, array_to_string(w, ' ') from d where len(w) between 1 and 4),
        n as (select doc_id, count(*) n from s group by 1), c as (select a.doc_id a, b.doc_id b, count(*) k from s a join s b on a.h = b.h and a.doc_id <> b.doc_id group by 1, 2),
        l as (select a, b from c join n p on p.doc_id = a join n q on q.doc_id = b where 9 * k >= 4 * (p.n + q.n) union select a.doc_id, b.doc_id from d a join d b on a.t = b.t and a.doc_id <> b.doc_id),
        r(n, c) as (select doc_id, doc_id from d union select l.b, r.c from r join l on l.a = r.n), k as (select n, min(c) c from r group by n), g as (select a, count(*) n from l group by a)
        select d.doc_id, k.c class_id, coalesce(g.n, 0) n_links, d.doc_id = k.c kept from d join k on k.n = d.doc_id left join g on g.a = d.doc_id""",
}
