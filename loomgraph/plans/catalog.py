"""Registered queries of the engine over the supplied tables, and the SQL each must equal."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import claims, dedup, graphops, history, search, traverse
from ..runtime import saved, table
from ..sources import adapter
from ..streaming import flows
from .lowering import run

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}

# the adapter's graph in SQL
NODES = """nodes as (
 select 'customer:'||c_custkey id, c_name label, 'customer' file_type, 'customer/'||c_mktsegment source_file, c_custkey::int line from customer
 union all select 'order:'||o_orderkey, 'Order#'||o_orderkey, 'order', 'order/'||o_orderpriority, o_orderkey::int from orders
 union all select 'part:'||p_partkey, p_name, 'part', 'part/'||p_brand, p_partkey::int from part
 union all select 'supplier:'||s_suppkey, s_name, 'supplier', 'supplier/'||s_nationkey, s_suppkey::int from supplier
 union all select 'nation:'||n_nationkey, n_name, 'nation', 'nation/'||n_regionkey, n_nationkey::int from nation
 union all select 'region:'||r_regionkey, r_name, 'region', 'region/all', r_regionkey::int from region)"""
EDGES = """edges as (
 select 'customer:'||o_custkey src, 'order:'||o_orderkey dst, 'placed' relation, 'EXTRACTED' confidence, 1 line from orders
 union all select 'order:'||l_orderkey, 'part:'||l_partkey, 'contains', case when l_returnflag='R' then 'INFERRED' else 'EXTRACTED' end, l_linenumber from lineitem
 union all select distinct 'part:'||l_partkey, 'supplier:'||l_suppkey, 'supplied_by', 'EXTRACTED', 1 from lineitem
 union all select 'customer:'||c_custkey, 'nation:'||c_nationkey, 'located_in', 'EXTRACTED', 1 from customer
 union all select 'supplier:'||s_suppkey, 'nation:'||s_nationkey, 'located_in', 'EXTRACTED', 1 from supplier
 union all select 'nation:'||n_nationkey, 'region:'||n_regionkey, 'in_region', 'EXTRACTED', 1 from nation)"""
LINES = """lines as (select doc_id::varchar file, i line, l[i] as text from (select doc_id, string_split(coalesce(text,''), chr(10)) l from documents) d, lateral (select unnest(range(1, len(l)+1)) i) r)"""
#: Tokens of a lower-cased text by the one pattern that Java and RE2 read alike.
TOK = "regexp_extract_all(lower({0}), '[a-z0-9]+')"


def query(sql: str | None = None) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


def matched(text: str, relations: tuple[str, ...]) -> Query:
    return lambda spark, d: run(adapter.graph(spark, d, relations), text)


def match_query(name: str, text: str, relations: tuple[str, ...], sql: str) -> None:
    QUERIES[name], SQL[name] = matched(text, relations), sql


# -- the pattern language ------------------------------------------------------------------------------------------------

match_query(
    "match_count_group",
    "match (c:customer)-[placed]->(o:order) where o.name ~ '7$' return c, count(o), count(*)",
    ("placed",),
    """select 'customer:'||o_custkey c, count(distinct o_orderkey) count_o, count(*) count, count(*) bindings, 'strong_inference' status
       from orders join customer on c_custkey=o_custkey where regexp_matches('Order#'||o_orderkey, '7$') group by o_custkey""",
)
match_query(
    "match_one_hop",
    "match (o:order)-[contains]->(p:part) where p.line <= 20 and o.name glob '*1' return o.name, p.label",
    ("contains",),
    """select 'Order#'||l_orderkey o_name, p_name p_label, count(distinct l_partkey) bindings,
         case when min(inf)=1 then 'weak_inference' else 'strong_inference' end status
       from (select l_orderkey, l_partkey, min(case when l_returnflag='R' then 1 else 0 end) inf from lineitem group by 1,2) l
       join part on p_partkey=l_partkey join orders on o_orderkey=l_orderkey
       where p_partkey<=20 and l_orderkey%10=1 group by l_orderkey, p_name""",
)
match_query(
    "match_field_compare",
    "match (c:customer)-[located_in]->(n:nation)<-[located_in]-(s:supplier) where c.line = s.line return c, s, n.name",
    ("located_in",),
    """select 'customer:'||c_custkey c, 'supplier:'||s_suppkey s, n_name, 1::bigint bindings, 'strong_inference' status
       from customer join nation on c_nationkey=n_nationkey join supplier on s_nationkey=n_nationkey where c_custkey=s_suppkey""",
)
match_query(
    "match_two_patterns",
    "match (o:order)-[contains]->(p:part), (p)-[supplied_by]->(s:supplier) where s.line <= 3 return s.name, count(o), count(p)",
    ("contains", "supplied_by"),
    """with l as (select l_orderkey, l_partkey, min(case when l_returnflag='R' then 1 else 0 end) inf from lineitem group by 1,2),
         ps as (select distinct l_partkey, l_suppkey from lineitem where l_suppkey<=3)
       select s_name, count(distinct l_orderkey) count_o, count(distinct l.l_partkey) count_p, count(*) bindings,
         case when max(inf)=1 then 'weak_inference' else 'strong_inference' end status
       from l join orders on o_orderkey=l_orderkey join ps on ps.l_partkey=l.l_partkey join part on p_partkey=l.l_partkey join supplier on s_suppkey=ps.l_suppkey group by s_name""",
)
match_query(
    "match_either_way",
    "match (n:nation)-[located_in|in_region]-(x:customer|supplier|region) return n.name, count(x)",
    ("located_in", "in_region"),
    """select n_name, count(*) count_x, count(*) bindings, 'strong_inference' status from nation join
       (select c_nationkey k from customer union all select s_nationkey from supplier union all select n_nationkey from nation join region on r_regionkey=n_regionkey) x on k=n_nationkey group by n_name""",
)
match_query(
    "match_exists",
    "match (c:customer) where exists (c)-[placed]->(:order)-[contains]->(p:part) and c.line < 500 return c",
    ("placed", "contains"),
    """select distinct 'customer:'||c_custkey c, 1::bigint bindings, 'strong_inference' status from customer
       where c_custkey<500 and exists (select 1 from orders join lineitem on l_orderkey=o_orderkey join part on p_partkey=l_partkey where o_custkey=c_custkey)""",
)
match_query(
    "match_not_exists",
    "match (c:customer) where not exists (c)-[placed]->(:order) or c.name ~ '[379]$' return c",
    ("placed",),
    """select 'customer:'||c_custkey c, 1::bigint bindings, 'strong_inference' status from customer
       where not exists (select 1 from orders where o_custkey=c_custkey) or regexp_matches(c_name, '[379]$')""",
)
match_query(
    "match_returns_fields",
    "match (n:nation)-[in_region]->(r:region) where n.label != r.label and not (n.line >= 20 or r.name = 'x') return n.name, n.file, r.label, r.line limit 12",
    ("in_region",),
    """select n_name, 'nation/'||n_regionkey n_file, r_name r_label, r_regionkey::int r_line, 1::bigint bindings, 'strong_inference' status
       from nation join region on n_regionkey=r_regionkey where n_name<>r_name and n_nationkey<20 order by n_name, n_file, r_label, r_line limit 12""",
)


@query(
    f"""with {EDGES}, one as (select src, dst, min(case when confidence='EXTRACTED' then 0 else 1 end) inf from edges group by 1,2),
 p1 as (select src s, dst e, 1 d, inf from one where src like 'customer:%' and regexp_matches(src, ':[0-9]$')),
 a2 as (select s, o.dst e, 2 d, min(greatest(p.inf,o.inf)) inf from p1 p join one o on o.src=p.e group by 1,2),
 p2 as (select * from a2 where not exists (select 1 from p1 where p1.s=a2.s and p1.e=a2.e)),
 a3 as (select s, o.dst e, 3 d, min(greatest(p.inf,o.inf)) inf from p2 p join one o on o.src=p.e group by 1,2),
 p3 as (select * from a3 where not exists (select 1 from p1 where p1.s=a3.s and p1.e=a3.e) and not exists (select 1 from p2 where p2.s=a3.s and p2.e=a3.e)),
 a4 as (select s, o.dst e, 4 d, min(greatest(p.inf,o.inf)) inf from p3 p join one o on o.src=p.e group by 1,2),
 p4 as (select * from a4 where not exists (select 1 from p1 where p1.s=a4.s and p1.e=a4.e) and not exists (select 1 from p2 where p2.s=a4.s and p2.e=a4.e) and not exists (select 1 from p3 where p3.s=a4.s and p3.e=a4.e))
 select s "start", e "end", d::int depth, inf=1 inferred from (select * from p1 union all select * from p2 union all select * from p3 union all select * from p4)"""
)
def path_bounded_1_4(spark: SparkSession, d: str) -> DataFrame:
    g = adapter.graph(spark, d)
    starts = g.nodes.where("id rlike '^customer:[0-9]$'")
    return traverse.bounded_paths(starts, traverse.oriented(g.edges), 1, 4).select("start", "end", "depth", "inferred")


match_query(
    "path_status",
    "match (c:customer)-[placed|contains*2..2]->(p:part) where c.line <= 40 return c, count(p)",
    ("placed", "contains"),
    """with b as (select o_custkey k, l_partkey p, min(inf) inf from orders join (select l_orderkey, l_partkey, min(case when l_returnflag='R' then 1 else 0 end) inf from lineitem group by 1,2) l on l_orderkey=o_orderkey
         join customer on c_custkey=o_custkey join part on p_partkey=l_partkey where c_custkey<=40 group by 1,2)
       select 'customer:'||k c, count(*) count_p, count(*) bindings, case when max(inf)=1 then 'weak_inference' else 'strong_inference' end status from b group by k""",
)


@query(
    f"""with recursive {EDGES}, r(id, distance) as (select 'nation:3', 0 union all select e.src, r.distance+1 from r join edges e on e.dst=r.id where r.distance<3)
 select id, min(distance)::int distance from r where id<>'nation:3' group by id"""
)
def reach_impact(spark: SparkSession, d: str) -> DataFrame:
    """What depends on a nation, three hops back."""
    e = adapter.edges(spark, d)
    return graphops.impact(e, spark.createDataFrame([("nation:3",)], "id string"), 3, adapter.RELATIONS).select("id", F.col("distance").cast("int").alias("distance"))


@query(
    f"""with recursive {NODES}, {EDGES}, r(id) as (select id from nodes where id like 'customer:%' and line<=100 union select e.dst from r join edges e on e.src=r.id)
 select id, label from nodes where id not in (select id from r)"""
)
def dead_nodes(spark: SparkSession, d: str) -> DataFrame:
    """Nodes that the first hundred customers do not reach."""
    g = adapter.graph(spark, d)
    return graphops.unreached(g.nodes, g.edges, g.nodes.where("id like 'customer:%' and line <= 100")).select("id", "label")


@query(
    f"""with recursive {EDGES}, r(id, distance) as (select 'customer:7', 0 union all select e.dst, r.distance+1 from (select distinct id, distance from r) r join edges e on e.src=r.id where r.distance<5)
 select 'customer:7' "start", id "end", min(distance)::int depth from r where id like 'region:%' group by id"""
)
def shortest_path_len(spark: SparkSession, d: str) -> DataFrame:
    g = adapter.graph(spark, d)
    found = traverse.shortest_path(g.nodes.where("id = 'customer:7'"), g.nodes.where("id like 'region:%'"), traverse.oriented(g.edges), 5)
    return found.select("start", "end", "depth")


@query(
    f"""with {NODES}, {EDGES}, ends as (select src id from edges union all select dst from edges),
 deg as (select n.id, count(e.id) degree from nodes n left join ends e on e.id=n.id group by n.id),
 k as (select degree from deg order by degree offset (select floor(count(*)*0.99)::bigint from deg) limit 1),
 calm as (select id from deg where degree < (select greatest(50, degree) from k)),
 both_ways as (select distinct * from (select src u, dst v from edges union all select dst, src from edges)),
 l0 as (select 'supplier:1' id), l1 as (select distinct v id from both_ways where u='supplier:1' and v<>'supplier:1'),
 l2 as (select distinct v id from both_ways join l1 on u=l1.id where u in (select id from calm) and v not in (select id from l1) and v<>'supplier:1')
 select id, 0 distance from l0 union all select id, 1 from l1 union all select id, 2 from l2"""
)
def bfs_hub_guard(spark: SparkSession, d: str) -> DataFrame:
    g = adapter.graph(spark, d)
    return traverse.guarded_bfs(g.nodes, g.edges, g.nodes.where("id = 'supplier:1'"), 2).select("id", F.col("distance").cast("int").alias("distance"))


# -- graph tables ----------------------------------------------------------------------------------------------------------


@query(
    f"""with {NODES}, {EDGES}, ends as (select src id from edges union all select dst from edges)
 select n.id, label, count(e.id) degree from nodes n left join ends e on e.id=n.id group by n.id, label order by degree desc, n.id limit 25"""
)
def degree_god_nodes(spark: SparkSession, d: str) -> DataFrame:
    g = adapter.graph(spark, d)
    return graphops.top_degrees(g.nodes, g.edges, 25)


@query(
    f"""with {NODES}, {EDGES}, ends as (select src id from edges union all select dst from edges),
 deg as (select n.id, label, count(e.id) degree from nodes n left join ends e on e.id=n.id group by n.id, label),
 k as (select degree from deg order by degree offset (select greatest(0, (count(*)*95/100)::bigint-1) from deg) limit 1)
 select * from deg where degree <= (select degree from k) order by degree desc, id limit 10"""
)
def degree_without_hubs(spark: SparkSession, d: str) -> DataFrame:
    g = adapter.graph(spark, d)
    return graphops.top_degrees(g.nodes, g.edges, 10, 95)


@query(
    f"""with {NODES}, {EDGES}, e as (select * from edges where relation in ('placed','located_in','in_region')), o as (select src, count(*) t from e group by src),
 l as (select e.src, e.dst, count(*)*1.0/any_value(t) p from e join o on o.src=e.src group by 1,2), n as (select id, (select count(*) from nodes) c from nodes),
 r0 as (select id, 1.0/c r, c from n),
 r1 as (select n.id, 0.15/n.c + 0.85*coalesce((select sum(r0.r*l.p) from l join r0 on r0.id=l.src where l.dst=n.id),0) r, n.c from n),
 r2 as (select n.id, 0.15/n.c + 0.85*coalesce((select sum(r1.r*l.p) from l join r1 on r1.id=l.src where l.dst=n.id),0) r, n.c from n),
 r3 as (select n.id, 0.15/n.c + 0.85*coalesce((select sum(r2.r*l.p) from l join r2 on r2.id=l.src where l.dst=n.id),0) r, n.c from n)
 select id, round(r*1e6, 3) rank from r3 where id like 'nation:%' or id like 'region:%'"""
)
def pagerank_fixed(spark: SparkSession, d: str) -> DataFrame:
    n, e = adapter.nodes(spark, d), adapter.edges(spark, d, ("placed", "located_in", "in_region"))
    ranks = graphops.pagerank_unrolled(n, e, 3)
    return ranks.where("id like 'nation:%' or id like 'region:%'").select("id", F.round(F.col("rank") * 1e6, 3).alias("rank"))


@query(
    """with o as (select o_orderkey k from orders where o_orderpriority<>'1-URGENT'), n as (select o_orderkey k from orders where o_orderkey%3<>0)
 select 'order:'||k id, 'added' change from n where k not in (select k from o) union all select 'order:'||k, 'removed' from o where k not in (select k from n)"""
)
def graph_diff(spark: SparkSession, d: str) -> DataFrame:
    n = adapter.nodes(spark, d).where("file_type = 'order'")
    return graphops.diff(n.where("source_file <> 'order/1-URGENT'"), n.where("line % 3 <> 0"), ["id"])


@query(
    f"""with {NODES} select id, label, source_file from nodes where file_type='part' and source_file not in (select source_file from nodes where file_type='part' and line<=3) and source_file<>'part/Brand#11'
 union all select id, 'new '||label, source_file from nodes where file_type='part' and line<=3"""
)
def graph_merge_prune(spark: SparkSession, d: str) -> DataFrame:
    n = adapter.nodes(spark, d).where("file_type = 'part'").select("id", "label", "source_file", "line")
    new = n.where("line <= 3").select("id", F.concat(F.lit("new "), F.col("label")).alias("label"), "source_file")
    return graphops.merge(n.select("id", "label", "source_file"), new, ["part/Brand#11"])


@query(
    """with e as (select c_nationkey a, s_nationkey b, 'trades' relation, 1 g, c_custkey::bigint o from customer join supplier on s_suppkey=c_custkey%10+1
   union all select s_nationkey, c_nationkey, 'references', 2, 1000000::bigint+c_custkey from customer join supplier on s_suppkey=c_custkey%7+1),
 r as (select *, row_number() over (partition by least(a,b), greatest(a,b) order by (relation='references')::int, o, a, b, relation) k from e)
 select a src, b dst, relation from r where k=1"""
)
def edge_collapse(spark: SparkSession, d: str) -> DataFrame:
    c, s = table(spark, d, "customer"), table(spark, d, "supplier")
    one = c.join(s, F.col("s_suppkey") == F.col("c_custkey") % 10 + 1).select(F.col("c_nationkey").alias("src"), F.col("s_nationkey").alias("dst"), F.lit("trades").alias("relation"), F.col("c_custkey").alias("o"))
    two = c.join(s, F.col("s_suppkey") == F.col("c_custkey") % 7 + 1).select(F.col("s_nationkey").alias("src"), F.col("c_nationkey").alias("dst"), F.lit("references").alias("relation"), (F.col("c_custkey") + 1000000).alias("o"))
    return graphops.collapse(one.unionByName(two), F.col("o"))


@query("select l_orderkey src, l_partkey dst, 'contains' relation, min(l_linenumber) line from lineitem group by 1,2")
def edge_dedupe_first(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "lineitem").select(F.col("l_orderkey").alias("src"), F.col("l_partkey").alias("dst"), F.lit("contains").alias("relation"), F.col("l_linenumber").alias("line"))
    return graphops.dedupe_edges(e, F.col("line"))


@query("select user_id id, min(event_id) ordinal, arg_max(event_type, event_id) label from events group by user_id")
def node_dedupe_last(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "events").select(F.col("user_id").alias("id"), F.col("event_id").alias("ordinal"), F.col("event_type").alias("label"))
    return graphops.dedupe_nodes(e, "ordinal")


@query(
    f"with {NODES}, {EDGES} select split_part(a.source_file,'/',1) group_from, split_part(b.source_file,'/',1) group_to, count(*) refs from edges e join nodes a on a.id=e.src join nodes b on b.id=e.dst group by 1,2"
)
def dsm_cells(spark: SparkSession, d: str) -> DataFrame:
    g = adapter.graph(spark, d)
    return graphops.group_matrix(g.nodes, g.edges, T.folder(F.col("source_file"), 1))


@query(
    f"with {NODES}, {EDGES} select a.source_file group_from, b.source_file group_to, count(*) refs from edges e join nodes a on a.id=e.src join nodes b on b.id=e.dst where a.source_file<>b.source_file group by 1,2"
)
def file_dependencies(spark: SparkSession, d: str) -> DataFrame:
    g = adapter.graph(spark, d)
    return graphops.file_dependencies(g.nodes, g.edges)


@query(f"with {NODES} select split_part(source_file,'/',1) folder, source_file, count(*) symbols from nodes group by rollup(folder, source_file)")
def hierarchy_rollup(spark: SparkSession, d: str) -> DataFrame:
    return graphops.hierarchy(adapter.nodes(spark, d))


_TRADE = "select distinct c_nationkey src, s_nationkey dst from customer join supplier on s_suppkey=c_custkey%10+1"


def _trade(spark: SparkSession, d: str) -> DataFrame:
    c, s = table(spark, d, "customer"), table(spark, d, "supplier")
    return c.join(s, F.col("s_suppkey") == F.col("c_custkey") % 10 + 1).select(F.col("c_nationkey").alias("src"), F.col("s_nationkey").alias("dst")).distinct()


@query(
    f"""with h as ({_TRADE}) select src::varchar cycle, 1 length from h where src=dst
 union all select a.src||'|'||a.dst, 2 from h a join h b on b.src=a.dst and b.dst=a.src where a.src<a.dst
 union all select a.src||'|'||a.dst||'|'||b.dst, 3 from h a join h b on b.src=a.dst join h c on c.src=b.dst and c.dst=a.src where a.src<a.dst and a.src<b.dst and b.dst<>a.dst"""
)
def import_cycles_3(spark: SparkSession, d: str) -> DataFrame:
    found = graphops.bounded_cycles(_trade(spark, d), 3, 100_000)
    return found.select(F.array_join("cycle", "|").alias("cycle"), F.col("length").cast("int").alias("length"))


@query()
def feedback_edges(spark: SparkSession, d: str) -> DataFrame:
    t = _trade(spark, d)
    n = t.select(F.col("src").alias("id")).union(t.select("dst")).distinct()
    return graphops.feedback_edges(t, saved(graphops.strong_components(n, t), "scc"))


@query(
    f"""with h as (select distinct least(src,dst) a, greatest(src,dst) b from ({_TRADE}) where src<>dst), m as (select n_nationkey id, n_regionkey community from nation),
 i as (select x.community, count(*) n from h join m x on x.id=a join m y on y.id=b where x.community=y.community group by 1)
 select m.community, count(*) n, coalesce(any_value(i.n),0) "inner", round(case when count(*)<=1 then 1 else coalesce(any_value(i.n),0)/(count(*)*(count(*)-1)/2.0) end, 6) cohesion from m left join i on i.community=m.community group by 1"""
)
def community_cohesion(spark: SparkSession, d: str) -> DataFrame:
    m = table(spark, d, "nation").select(F.col("n_nationkey").alias("id"), F.col("n_regionkey").alias("community"))
    return graphops.cohesion(m, _trade(spark, d)).withColumn("cohesion", F.round("cohesion", 6))


@query(
    """select n_regionkey community, left(sha256(string_agg(n_name||chr(0), '' order by n_name)), 16) fingerprint, count(*) n from nation group by 1"""
)
def community_fingerprint(spark: SparkSession, d: str) -> DataFrame:
    m = table(spark, d, "nation").select(F.col("n_name").alias("id"), F.col("n_regionkey").alias("community"))
    return graphops.fingerprints(m).join(m.groupBy("community").agg(F.count("*").alias("n")), "community")


@query(
    f"""with {NODES}, {EDGES} select rule, e.src, e.dst, case when confidence='EXTRACTED' then 'VIOLATED' else 'POSSIBLE' end verdict from edges e join nodes a on a.id=src join nodes b on b.id=dst
 join (values ('no-order-part','order','part'), ('no-nation-region','nation','region')) r(rule,f,t) on f=a.file_type and t=b.file_type"""
)
def guard_violations(spark: SparkSession, d: str) -> DataFrame:
    g = adapter.graph(spark, d, ("contains", "in_region"))
    rules = spark.createDataFrame([("no-order-part", "order", "part"), ("no-nation-region", "nation", "region")], "rule string, from_group string, to_group string")
    return graphops.checked_guards(g.nodes, g.edges, rules, F.col("file_type"))


@query(
    """with clean as (select l_orderkey o, l_partkey p from lineitem where l_partkey%5<>0),
 c as (select distinct o_custkey s, p from orders join clean on o=o_orderkey where o_custkey<=20), ps as (select distinct l_partkey, l_suppkey from lineitem)
 select distinct 'customer:'||s "start", 'supplier:'||l_suppkey "end", 3 depth from c join ps on l_partkey=p where l_suppkey<=5"""
)
def taint_paths(spark: SparkSession, d: str) -> DataFrame:
    """From the first customers to the first suppliers, past the parts that count as sanitizers."""
    g = adapter.graph(spark, d, ("placed", "contains", "supplied_by"))
    found = graphops.taint(g.edges, g.nodes.where("file_type = 'customer' and line <= 20"), g.nodes.where("file_type = 'supplier' and line <= 5"), g.nodes.where("file_type = 'part' and line % 5 = 0"), 3)
    return found.select("start", "end", F.col("depth").cast("int").alias("depth"))


@query(
    """with e as (select l_orderkey o, l_partkey p from lineitem where l_orderkey<=2000),
 b as (select distinct 'part:'||p id, 1 distance from e where o=1 union all select 'x',0 where false)
 select 'callees' side, id, distance from b union all select 'callers', 'customer:'||o_custkey, 1 from orders where o_orderkey=1"""
)
def butterfly(spark: SparkSession, d: str) -> DataFrame:
    e = adapter.edges(spark, d, ("placed", "contains"))
    return graphops.butterfly(e, spark.createDataFrame([("order:1",)], "id string"), 1, ("placed", "contains")).withColumn("distance", F.col("distance").cast("int"))


@query(f"with {NODES} select id, 'unknown file_type' problem from nodes where file_type='region' union all select id, 'missing label' from nodes where label is null")
def graph_validation(spark: SparkSession, d: str) -> DataFrame:
    n = adapter.nodes(spark, d).withColumn("file_type", F.when(F.col("file_type") == "region", "odd").otherwise("code"))
    e = adapter.edges(spark, d, ("in_region",)).withColumn("source_file", F.lit("f"))
    return graphops.validate(n, e).select(F.col("item").alias("id"), "problem")


# -- histories ----------------------------------------------------------------------------------------------------------


@query(
    """with b as (select distinct l_orderkey c, l_partkey p from lineitem), t as (select p, count(*) n from b group by 1),
 k as (select a.p target, z.p other, count(*) shared from b a join b z on a.c=z.c and a.p<>z.p group by 1,2 having count(*)>=2)
 select target, other, shared, round(shared*1.0/n,6) degree from k join t on t.p=target where shared*1.0/n>=0.05"""
)
def cochange_pairs(spark: SparkSession, d: str) -> DataFrame:
    c = table(spark, d, "lineitem").select(F.col("l_orderkey").alias("commit"), F.col("l_partkey").alias("path"))
    return history.co_changes(c, shared=2, degree=0.05).withColumn("degree", F.round("degree", 6))


@query(
    """select l_partkey path, count(distinct l_orderkey) changes, any_value(p_size)::bigint complexity, count(distinct l_orderkey)*any_value(p_size)::bigint score
 from lineitem join part on p_partkey=l_partkey group by l_partkey order by score desc, path limit 50"""
)
def hotspot_rank(spark: SparkSession, d: str) -> DataFrame:
    c = table(spark, d, "lineitem").select(F.col("l_orderkey").alias("commit"), F.col("l_partkey").alias("path"))
    return history.hotspots(c, table(spark, d, "part").select(F.col("p_partkey").alias("path"), F.col("p_size").alias("complexity")), 50)


_BLAME = "b as (select l_partkey file, l_suppkey author, sum(l_quantity)::bigint lines, max(l_shipdate) last from lineitem group by 1,2)"


@query(f"with {_BLAME} select file, author, lines, floor(lines::double/(sum(lines) over (partition by file))::double*1e6)::bigint share_ppm, row_number() over (partition by file order by lines desc, author)::int place from b")
def ownership_share(spark: SparkSession, d: str) -> DataFrame:
    return history.ownership(adapter.blame(spark, d)).withColumn("share_ppm", F.floor(F.col("share") * 1e6)).drop("share")


@query(
    f"""with {_BLAME}, r as (select *, sum(lines) over (partition by file order by lines desc, author rows unbounded preceding) u, sum(lines) over (partition by file) t, row_number() over (partition by file order by lines desc, author) k from b)
 select file, min(k) bus_factor from r where u*2>t group by file"""
)
def bus_factor(spark: SparkSession, d: str) -> DataFrame:
    return history.bus_factor(adapter.blame(spark, d))


@query(
    f"""with {_BLAME}, s as (select author, max(last) seen from b group by 1)
 select file, sum(case when seen < (select max(last) from b) - interval 3 day then lines else 0 end)::bigint lost, sum(lines)::bigint total from b join s using(author) group by file"""
)
def knowledge_loss(spark: SparkSession, d: str) -> DataFrame:
    return history.knowledge_loss(adapter.blame(spark, d), 3)


_RUNS = "r as (select event_id seq, user_id test, strftime(ts,'%Y-%m-%d') tree, case when value>=50 then 'pass' else 'fail' end outcome from events)"


@query(f"with {_RUNS}, p as (select test, tree from r group by 1,2 having count(distinct outcome)=2) select test, count(*) trees from p group by 1")
def flaky_tests(spark: SparkSession, d: str) -> DataFrame:
    return history.flaky(adapter.runs(spark, d))


@query(
    f"""with {_RUNS}, l as (select test, max(seq) f from r where outcome='fail' group by 1), bad as (select distinct test, tree from r where outcome='fail'),
 a as (select r.test, count(*) n, max((bad.test is not null)::int) b from r join l on l.test=r.test left join bad on bad.test=r.test and bad.tree=r.tree where seq>f group by 1)
 select l.test, coalesce(n,0) passes, coalesce(n,0)>=2 and coalesce(b,0)=0 held from l left join a on a.test=l.test"""
)
def held_fix(spark: SparkSession, d: str) -> DataFrame:
    return history.held_fixes(adapter.runs(spark, d), 2)


@query("select user_id claim_id, arg_max(event_type, (ts, event_id)) status from events where ts <= timestamp '2024-01-15 12:00:00' group by 1")
def asof_status(spark: SparkSession, d: str) -> DataFrame:
    return history.status_at(adapter.transitions(spark, d), F.lit("2024-01-15 12:00:00").cast("timestamp"))


@query("select * exclude(k) from (select user_id, event_id, event_type, row_number() over (partition by user_id order by ts desc, event_id desc) k from events) where k=1")
def latest_row(spark: SparkSession, d: str) -> DataFrame:
    return history.latest(table(spark, d, "events"), ["user_id"], ["ts", "event_id"]).select("user_id", "event_id", "event_type")


@query("select status, count(*) n from (select arg_max(event_type, (ts, event_id)) status from events group by user_id) group by 1")
def claim_statistics(spark: SparkSession, d: str) -> DataFrame:
    return history.latest(adapter.transitions(spark, d), ["claim_id"], ["ts", "seq"]).groupBy("status").agg(F.count("*").alias("n"))


@query(
    """with s as (select o_custkey f, o_orderkey sym, o_orderkey%97 a, o_orderkey%97+o_orderkey%13 b from orders), h as (select user_id f, (event_id%110)::bigint line, value>=50 hit from events),
 j as (select h.*, sym, row_number() over (partition by h.f, line, hit, rid order by b-a, -a, sym) k from (select *, row_number() over () rid from h) h left join s on s.f=h.f and line between a and b)
 select f file, sym symbol, count(*) filter (where hit) covered, count(*) measured from j where k=1 group by 1,2"""
)
def coverage_interval(spark: SparkSession, d: str) -> DataFrame:
    o = table(spark, d, "orders")
    spans = o.select(F.col("o_custkey").alias("file"), F.col("o_orderkey").alias("symbol"), (F.col("o_orderkey") % 97).alias("start"), (F.col("o_orderkey") % 97 + F.col("o_orderkey") % 13).alias("end"))
    hits = table(spark, d, "events").select(F.col("user_id").alias("file"), (F.col("event_id") % 110).alias("line"), (F.col("value") >= 50).cast("int").alias("hits"))
    return history.coverage_by_symbol(hits, spans)


@query(
    """with p as (select distinct 'src/'||lower(replace(p_brand,'#',''))||'/t'||p_size path from part)
 select path, case when regexp_matches(path,'^src/brand2[0-9]/t1[^/]*($|/)') then 'ops' when regexp_matches(path,'^src/brand1[0-9]/') then 'core' when regexp_matches(path,'(^|/)t4[0-9]($|/)') then 'forty' else 'all' end as owner from p"""
)
def codeowners_last_match(spark: SparkSession, d: str) -> DataFrame:
    paths = table(spark, d, "part").select(F.expr("concat('src/', lower(replace(p_brand, '#', '')), '/t', p_size)").alias("path")).distinct()
    rules = [(n, history.owner_regex(g), o) for n, (g, o) in enumerate([("*", "all"), ("t4[0-9]", "forty"), ("src/brand1[0-9]/", "core"), ("src/brand2[0-9]/t1*", "ops")])]
    return history.code_owners(paths, spark.createDataFrame(rules, "line int, regex string, owner string"))


@query(
    """with recursive pk as (select n_nationkey p, 'r'||n_regionkey||'/n'||n_nationkey root from nation union all select 100+r_regionkey, 'r'||r_regionkey from region),
 ch as (select 'r'||n_regionkey||'/n'||n_nationkey||'/x/f' path from nation where n_nationkey%6=0 union all select 'r'||r_regionkey||'/f' from region where r_regionkey=2),
 own as (select path, arg_max(p, length(root)) p from ch join pk on starts_with(path, root||'/') group by 1),
 dep as (select n_nationkey p, (n_nationkey+7)%25 needs from nation), r(p, d) as (select distinct p, 0 from own union all select dep.p, d+1 from r join dep on dep.needs=r.p where d<30)
 select p package, min(d)::int distance from r group by 1"""
)
def affected_packages(spark: SparkSession, d: str) -> DataFrame:
    n, r = table(spark, d, "nation"), table(spark, d, "region")
    packages = n.select(F.col("n_nationkey").alias("package"), F.expr("concat('r', n_regionkey, '/n', n_nationkey)").alias("root")).union(r.select(F.col("r_regionkey") + 100, F.expr("concat('r', r_regionkey)")))
    changed = n.where("n_nationkey % 6 = 0").select(F.expr("concat('r', n_regionkey, '/n', n_nationkey, '/x/f')").alias("path")).union(r.where("r_regionkey = 2").select(F.expr("concat('r', r_regionkey, '/f')")))
    depends = n.select(F.col("n_nationkey").alias("package"), ((F.col("n_nationkey") + 7) % 25).alias("needs"))
    return history.affected_packages(changed, packages, depends).withColumn("distance", F.col("distance").cast("int"))


@query("select json_extract_string(props,'$.k')::int % 5 surface, event_type name, count(*) calls, round(sum(value),3) as \"seconds\" from events group by rollup(surface, name)")
def usage_rollup(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "events")
    log = e.select((F.get_json_object("props", "$.k").cast("int") % 5).alias("surface"), F.col("event_type").alias("name"), F.col("value").alias("seconds"))
    return history.usage_totals(log).withColumn("seconds", F.round("seconds", 3))


@query(
    """with f as (select p_partkey name, p_size*3 lines, p_size%40 complexity, p_size%8 depth, p_partkey%9 params from part),
 s as (select name, greatest(1, 10-((lines>60)::int+(lines>120)::int+(complexity>10)::int+(complexity>20)::int+(complexity>30)::int+(depth>4)::int+(depth>6)::int+(params>6)::int)) score from f)
 select name, score::int score, case when score>=8 then 'healthy' when score>=5 then 'warning' else 'alert' end band from s"""
)
def code_health(spark: SparkSession, d: str) -> DataFrame:
    p = table(spark, d, "part")
    f = p.select(F.col("p_partkey").alias("name"), (F.col("p_size") * 3).alias("lines"), (F.col("p_size") % 40).alias("complexity"), (F.col("p_size") % 8).alias("depth"), (F.col("p_partkey") % 9).alias("params"))
    return history.health(f)


@query(
    """with a as (select user_id s, event_id seq, event_type g, strftime(ts,'%d')::int t from events),
 w as (select *, lag(g,1) over (partition by s order by seq) s1, lag(g,2) over (partition by s order by seq) s2, lag(t) over (partition by s order by seq) bt from a)
 select s "session", seq, 'a_b_a' signal from w where g=s2 and g<>s1"""
)
def loop_signals(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "events").select(F.col("user_id").alias("session"), F.col("event_id").alias("seq"), F.col("event_type").alias("signature"), F.dayofmonth("ts").alias("tree"))
    return history.loop_signals(e).where("signal = 'a_b_a'")


@query(
    """with g as (select doc_id::varchar q, quality f, doc_id%50 a from labels), c as (select doc_id::varchar q, n_chars%60 l from documents)
 select g.q question, count(*) facts, sum((l between a and a+20)::int)::bigint found from g join c on c.q=g.q group by 1"""
)
def benchmark_scores(spark: SparkSession, d: str) -> DataFrame:
    g = table(spark, d, "labels").select(F.col("doc_id").cast("string").alias("question"), F.col("quality").alias("fact"), F.lit("f").alias("file"), (F.col("doc_id") % 50).alias("a"), (F.col("doc_id") % 50 + 20).alias("b"))
    a = table(spark, d, "documents").select(F.col("doc_id").cast("string").alias("question"), F.lit("f").alias("file"), (F.col("n_chars") % 60).alias("line"))
    return history.benchmark_scores(g, a)


@query(
    """with l as (select o_custkey f, row_number() over (partition by o_custkey order by o_orderkey) line from orders),
 h as (select c_custkey f, 5 s, 2 ol, 4 nl from customer union all select c_custkey, 10, 3, 0 from customer)
 select f file, line, (case when line<5 then line when line<7 then null when line<10 then line+2 when line<13 then null else line-1 end)::bigint new_line from l"""
)
def carried_lines(spark: SparkSession, d: str) -> DataFrame:
    o = table(spark, d, "orders")
    lines = o.select(F.col("o_custkey").alias("file"), F.row_number().over(Window.partitionBy("o_custkey").orderBy("o_orderkey")).cast("long").alias("line"))
    c = table(spark, d, "customer").select(F.col("c_custkey").alias("file"))
    hunks = c.select("file", F.lit(5).alias("old_start"), F.lit(2).alias("old_len"), F.lit(4).alias("new_len")).union(c.select("file", F.lit(10), F.lit(3), F.lit(0)))
    return history.carried_lines(lines, hunks)


# -- text -----------------------------------------------------------------------------------------------------------------


@query(
    """with c as (select doc_id::varchar file, source, len(regexp_extract_all(text, 'the ')) the_n, len(regexp_extract_all(text, 'and ')) and_n from documents)
 select source grp, count(*) units, sum(the_n)::bigint the_n, sum(and_n)::bigint and_n from c where the_n>=3 and not (and_n>the_n) group by 1"""
)
def inventory_pivot(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "documents").select("doc_id", "source", "text")
    return search.inventory(docs, {"the_n": "the ", "and_n": "and "}, "the_n >= 3 and not and_n > the_n", "doc_id", F.col("source"))


@query(
    f"""with {LINES}, m as (select file, trim(regexp_replace(text,'[ \\t\\r\\n]+',' ','g')) as text from lines where regexp_matches(text,'MIT|token')),
 b as (select file, trim(regexp_replace(text,'[ \\t\\r\\n]+',' ','g')) as text from lines where file::bigint%2=0 and regexp_matches(text,'MIT|token')), n as (select file, text, count(*) k from m group by all), o as (select file, text, count(*) k from b group by all)
 select n.file, n.text, n.k-coalesce(o.k,0) n from n left join o on o.file=n.file and o.text=n.text where n.k>coalesce(o.k,0)"""
)
def monitor_new_matches(spark: SparkSession, d: str) -> DataFrame:
    lines = adapter.lines(spark, d)
    return search.new_matches(lines, lines.where("file % 2 = 0 and text rlike 'MIT|token'").select("file", "text"), "MIT|token")


@query(f"with {LINES} select file, line::int line, left(text,300) as text, len(regexp_extract_all(text,'[Ll]icense[a-z]*|token')) hits from lines where regexp_matches(text,'[Ll]icense[a-z]*|token')")
def regex_search_lines(spark: SparkSession, d: str) -> DataFrame:
    files = table(spark, d, "documents").select(F.col("doc_id").cast("string").alias("file"), F.coalesce("text", F.lit("")).alias("text"))
    return search.regex_search(files, "[Ll]icense[a-z]*|token")


@query(f"with {LINES} select file, line::int line, left(text,300) as text, len(regexp_extract_all(text,'licensed under the [A-Z]+')) hits from lines where regexp_matches(text,'licensed under the [A-Z]+')")
def regex_search_indexed(spark: SparkSession, d: str) -> DataFrame:
    """The same search through trigram postings of what every match must hold."""
    files = table(spark, d, "documents").select(F.col("doc_id").cast("string").alias("file"), F.coalesce("text", F.lit("")).alias("text"))
    return search.regex_search(files, "licensed under the [A-Z]+", search.postings(files))


@query("select t tri, count(*) files from (select item_id, unnest(list_distinct(list_transform(range(1,length(text)-1), lambda i: substring(lower(text), i, 3)))) t from benchmark where length(text)>=3) group by 1")
def trigram_postings(spark: SparkSession, d: str) -> DataFrame:
    b = table(spark, d, "benchmark").select(F.col("item_id").alias("file"), "text")
    return search.postings(b).groupBy("tri").agg(F.count("*").alias("files"))


@query(
    """select doc_id from (select doc_id, lower(source||'/'||lang||'.py') f, text from documents) where (starts_with(f,'src1') or contains(f,'/src1')) and not regexp_matches(text,'[A-Z]{6,}') and (contains(lower(text),'the') or f like '%de.py')"""
)
def filter_expression(spark: SparkSession, d: str) -> DataFrame:
    _, tree = search.parse_filters('path:src1 -/[A-Z]{6,}/ ("the" OR path:*de.py) lang:python')
    docs = table(spark, d, "documents").select("doc_id", F.lower(F.concat("source", F.lit("/"), "lang", F.lit(".py"))).alias("file"), "text", F.lit("").alias("name"), F.lit("").alias("qual"))
    return docs.where(search.filter_column(tree)).select("doc_id")


@query(f"with t as (select doc_id, unnest(list_distinct({TOK.format('text')})) term from documents) select term, count(*) df, round(ln(1+(((select count(*) from documents)-count(*)+0.5)/(count(*)+0.5))),6) idf from t group by 1")
def tokens_idf(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "documents")
    post = docs.select("doc_id", F.explode(F.array_distinct(T.tokens(F.col("text")))).alias("term"))
    return search.document_frequencies(post, docs.count()).withColumn("idf", F.round("idf", 6))


@query(
    f"""with u as (select doc_id uid, {TOK.format('text')} b, {TOK.format('source')} n, {TOK.format('lang')} p from documents),
 c as (select uid, len(b) l, len(n) nl, len(list_filter(b,lambda x: x='moron')) b0, len(list_filter(n,lambda x: x='moron')) n0, len(list_filter(p,lambda x: x='moron')) p0, len(list_filter(b,lambda x: x='license')) b1, len(list_filter(n,lambda x: x='license')) n1, len(list_filter(p,lambda x: x='license')) p1, len(list_filter(b,lambda x: x='src7')) b2, len(list_filter(n,lambda x: x='src7')) n2, len(list_filter(p,lambda x: x='src7')) p2 from u),
 s as (select count(*) t, avg(l) al, avg(nl) an, count(*) filter (where b0+n0+p0>0) d0, count(*) filter (where b1+n1+p1>0) d1, count(*) filter (where b2+n2+p2>0) d2 from c),
 f as (select c.*, s.*, b0/(0.25+0.75*l/al)+3.0*n0/(0.7+0.3*nl/an)+0.5*p0 t0, b1/(0.25+0.75*l/al)+3.0*n1/(0.7+0.3*nl/an)+0.5*p1 t1, b2/(0.25+0.75*l/al)+3.0*n2/(0.7+0.3*nl/an)+0.5*p2 t2 from c, s where b0+n0+p0+b1+n1+p1+b2+n2+p2>0),
 g as (select uid, ln(1+(t-d0+0.5)/(d0+0.5))*t0/(1.2+t0) + 0.5*ln(1+(t-d1+0.5)/(d1+0.5))*t1/(1.2+t1) + 0.25*ln(1+(t-d2+0.5)/(d2+0.5))*t2/(1.2+t2) score from f)
 select uid, round(score,6) score, round(score/(select max(score) from g),6) share from g order by round(score,9) desc, uid limit 40"""
)
def bm25_topk(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "documents").select(F.col("doc_id").alias("uid"), F.col("text").alias("body"), F.col("source").alias("name"), F.col("lang").alias("path"))
    best = search.top_scores(search.bm25f(docs, {"moron": 1.0, "license": 0.5, "src7": 0.25}), 40)
    return best.select("uid", F.round("score", 6).alias("score"), F.round("share", 6).alias("share"))


@query(
    f"""with p as (select doc_id, unnest(range(len(k))) i, unnest(k) t from (select doc_id, {TOK.format('text')} k from documents))
 select a.doc_id, count(*) n from p a join p b on a.doc_id=b.doc_id and abs(a.i-b.i)<=3 and a.i<>b.i where a.t='the' and b.t='this' group by 1"""
)
def proximity_pairs(spark: SparkSession, d: str) -> DataFrame:
    return search.near_pairs(table(spark, d, "documents"), "doc_id", F.col("text"), "the", "this")


@query(
    """with n as (select doc_id file, len(string_split(coalesce(text,''),chr(10)))::int n from documents)
 select file, (s+1)::int a, least(s+12, n)::int b from (select file, n, unnest(case when n<=12 then [0] else range(0, n-6, 6) end) s from n)"""
)
def passage_windows(spark: SparkSession, d: str) -> DataFrame:
    files = table(spark, d, "documents").select(F.col("doc_id").alias("file"), F.size(F.split(F.coalesce("text", F.lit("")), "\n", -1)).alias("n"))
    return search.windows(files)


@query("select sha256(replace(text, chr(13)||chr(10), chr(10))) sha, min(doc_id) canonical, count(*) copies from documents group by 1 having count(*)>1")
def exact_copies(spark: SparkSession, d: str) -> DataFrame:
    return dedup.exact_copies(table(spark, d, "documents").select(F.col("doc_id").alias("file"), "text"))


@query(
    f"""with s as (select item_id k, list_distinct({TOK.format('text')}) t from benchmark)
 select a.k a, b.k b, round(len(list_intersect(a.t,b.t))*1.0/(len(a.t)+len(b.t)-len(list_intersect(a.t,b.t))),6) jaccard from s a join s b on a.k<b.k where len(list_intersect(a.t,b.t))*1.0/(len(a.t)+len(b.t)-len(list_intersect(a.t,b.t)))>=0.2"""
)
def near_dup_jaccard(spark: SparkSession, d: str) -> DataFrame:
    return dedup.exact_jaccard_pairs(table(spark, d, "benchmark"), "item_id", T.tokens(F.col("text")), 0.2).withColumn("jaccard", F.round("jaccard", 6))


@query(
    """with c as (select p_partkey, unnest(string_split(p_name,'')) ch from part), n as (select p_partkey, ch, count(*) k from c where ch<>'' group by 1,2)
 select p_partkey, round(-sum(k*1.0/t*log2(k*1.0/t)),6) bits from (select *, sum(k) over (partition by p_partkey) t from n) group by 1"""
)
def label_entropy(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "part").select("p_partkey", F.round(T.entropy(F.col("p_name")), 6).alias("bits"))


@query("select p_partkey, trim(regexp_replace(lower(p_name||' '||p_brand),'[^a-z0-9]+',' ','g')) label from part")
def norm_label(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "part").select("p_partkey", T.norm_label(F.concat_ws(" ", "p_name", "p_brand")).alias("label"))


@query("select o_orderkey, lower(o_orderpriority) folded, list_transform(regexp_extract_all(replace(o_clerk,'#','_'), '[A-Za-z]+|[0-9]+'), lambda x: lower(x)) parts from (select o_orderkey, o_orderpriority, 'Order_item'||o_orderkey o_clerk from orders)")
def split_identifier(spark: SparkSession, d: str) -> DataFrame:
    o = table(spark, d, "orders")
    return o.select("o_orderkey", T.fold_tr(F.lower("o_orderpriority")).alias("folded"), T.split_identifier(F.concat(F.lit("Order_item"), F.col("o_orderkey").cast("string"))).alias("parts"))


@query("select o_custkey, o_orderkey, running from (select o_custkey, o_orderkey, sum(ceil(o_totalprice/1000)::bigint) over (partition by o_custkey order by o_orderkey rows unbounded preceding)::bigint running from orders) where running<=600")
def budget_prefix(spark: SparkSession, d: str) -> DataFrame:
    o = table(spark, d, "orders")
    return search.budget_prefix(o, F.ceil(F.col("o_totalprice") / 1000).cast("long"), [F.col("o_orderkey")], 600, ["o_custkey"]).select("o_custkey", "o_orderkey", "running")


@query(f"with {NODES} select id, case when lower(source_file)='part/brand#12' then 0 when lower(label)='part/brand#12' then 1 when starts_with(lower(label),'part/brand#12') then 2 else 3 end tier from nodes where lower(source_file)='part/brand#12' or contains(lower(label),'part/brand#12')")
def label_tiers(spark: SparkSession, d: str) -> DataFrame:
    return search.label_tiers(adapter.nodes(spark, d), "part/Brand#12").withColumn("tier", F.col("tier").cast("int"))


@query(
    r"""select doc_id, list_sort(list_distinct(list_transform(regexp_extract_all(t, '(?i)\b(?:from|join|into|update|table)\s+([a-z_][a-z0-9_.]*)', 1), lambda x: lower(x)))) tables
 from (select doc_id, regexp_replace(regexp_replace(text, '[^ -~\n]', ' ', 'g'), '''[^'']*''|-{2}[^\n]*|(?s:/[*].*?[*]/)', ' ', 'g') t from documents where text is not null)"""
)
def schema_lineage(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "documents").where("text is not null").select("doc_id", F.regexp_replace("text", "[^ -~\\n]", " ").alias("text"))
    return docs.select("doc_id", F.sort_array(T.sql_tables(F.col("text"))).alias("tables"))


@query("select page_id, unnest(regexp_extract_all(html, 'href=\"([^\"]+)\"', 1)) href from pages")
def html_links(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "pages").select("page_id", F.explode(F.regexp_extract_all("html", F.lit('href="([^"]+)"'), F.lit(1))).alias("href"))


@query(
    r"""select doc_id, md5(regexp_replace(regexp_replace(regexp_replace(text, '[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}', '[email]', 'g'), '(?i)bearer\s+[A-Za-z0-9._-]{16,}', 'Bearer [secret]', 'g'),
 '(?i)((?:password|secret|token|api_?key)["'']?\s*[:=]\s*["'']?)[A-Za-z0-9+/_.=-]{12,}', '\1[secret]', 'g')) digest from documents where text is not null"""
)
def scrub_pii(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").where("text is not null").select("doc_id", F.md5(T.redact(F.col("text"))).alias("digest"))


# -- claims and change --------------------------------------------------------------------------------------------------


@query("select user_id claim_id, case max(case event_type when 'purchase' then 0 when 'view' then 1 when 'click' then 2 else 3 end) when 0 then 'statically_verified' when 1 then 'strong_inference' when 2 then 'weak_inference' else 'unknown' end status from events group by 1")
def claim_status_weakest(spark: SparkSession, d: str) -> DataFrame:
    grade = F.when(F.col("event_type") == "purchase", "statically_verified").when(F.col("event_type") == "view", "strong_inference").when(F.col("event_type") == "click", "weak_inference").otherwise("unknown")
    return claims.weakest(table(spark, d, "events").select(F.col("user_id").alias("claim_id"), grade.alias("status")), ["claim_id"])


@query("select c_nationkey claim_key, count(*) n, case when count(distinct c_mktsegment)=1 then 'fold' else 'conflict' end verdict from customer group by 1 having count(*)>1")
def claim_duplicates(spark: SparkSession, d: str) -> DataFrame:
    return claims.duplicates(table(spark, d, "customer").select(F.col("c_nationkey").alias("claim_key"), F.col("c_mktsegment").alias("status")))


@query(
    """with d as (select distinct l_orderkey claim_id, l_partkey dep, l_suppkey%3 fp, l_partkey%10 file from lineitem), f as (select p_partkey dep, p_partkey%3 fp from part where p_partkey%11<>0)
 select d.claim_id, case when max((f.fp is null or f.fp<>d.fp)::int)=1 then 'stale' else 'rebound' end verdict from d left join f on f.dep=d.dep group by 1 having max((f.fp is null or f.fp<>d.fp)::int)=1 or max((file<3)::int)=1"""
)
def stale_claims(spark: SparkSession, d: str) -> DataFrame:
    li = table(spark, d, "lineitem")
    deps = li.select(F.col("l_orderkey").alias("claim_id"), F.col("l_partkey").alias("dep_key"), (F.col("l_suppkey") % 3).alias("fp"), (F.col("l_partkey") % 10).alias("file")).distinct()
    own = deps.select("claim_id").distinct().withColumn("status", F.lit("active"))
    facets = table(spark, d, "part").where("p_partkey % 11 <> 0").select(F.col("p_partkey").alias("dep_key"), (F.col("p_partkey") % 3).alias("fp"))
    return claims.invalidate(own, deps, facets, spark.range(3).select(F.col("id").alias("file")))


@query(
    """with v as (select o_custkey k, o_orderkey line, row_number() over (partition by o_custkey order by o_orderkey) n from orders), b as (select o_custkey k, count(*) n from orders where o_orderkey%2=0 group by 1)
 select v.k "key", line, v.n::int occurrence from v left join b on b.k=v.k where v.n>coalesce(b.n,0)"""
)
def baseline_except(spark: SparkSession, d: str) -> DataFrame:
    o = table(spark, d, "orders").select(F.col("o_custkey").alias("key"), F.col("o_orderkey").alias("line"))
    return claims.except_baseline(o, o.where("line % 2 = 0"), ["key"]).select("key", "line", "occurrence")


@query(
    f"""with {NODES}, {EDGES} select 'callers_of' question, 'nation:4' subject, count(distinct src)::varchar answer from edges where dst='nation:4'
 union all select 'exists_edge', 'supplier:1', (count(*)>0)::varchar from edges where src='supplier:1' and relation='located_in'
 union all select 'count_kind', 'part', count(*)::varchar from nodes where file_type='part'"""
)
def tq_batch(spark: SparkSession, d: str) -> DataFrame:
    """Typed questions as one batch: each is a template that gives (question, subject, answer)."""
    from .questions import ask

    return ask(adapter.graph(spark, d), [("callers_of", "nation:4"), ("exists_edge", "supplier:1", "located_in"), ("count_kind", "part")])


@query(
    """with e as (select user_id, ts, case when ts - lag(ts) over (partition by user_id order by ts) < interval 6 hour then 0 else 1 end b from events),
 s as (select *, sum(b) over (partition by user_id order by ts rows unbounded preceding) k from e)
 select user_id, min(ts) "start", max(ts)+interval 6 hour "end", count(*) n from s group by user_id, k"""
)
def session_debounce(spark: SparkSession, d: str) -> DataFrame:
    return flows.debounced(table(spark, d, "events"), "user_id", "6 hours")


def _stream_folder(spark: SparkSession, d: str) -> DataFrame:
    """The events table as a stream; the file source takes folders, so the parts of the table are matched by a pattern."""
    schema = table(spark, d, "events").schema
    return spark.readStream.schema(schema).option("pathGlobFilter", "*.parquet").parquet(f"{d}/events*.parquet")


@query("select user_id claim_id, arg_max(event_type, (ts, event_id)) status, arg_max(event_id, (ts, event_id)) seq from events group by 1")
def stream_stateful_status(spark: SparkSession, d: str) -> DataFrame:
    """The status of each claim kept by a stateful operator; the newest row a claim has is the answer."""
    from ..runtime import shared_dir
    import uuid

    root = f"{shared_dir(spark)}/loomgraph/stream-{uuid.uuid4().hex}"
    events = _stream_folder(spark, d).select(F.col("user_id").alias("claim_id"), F.col("event_id").alias("seq"), "ts", F.col("event_type").alias("status"))
    stream = flows.last_status(events)
    flows.run_once(stream, lambda df, n: df.withColumn("batch", F.lit(n)).write.mode("append").parquet(f"{root}/out"), f"{root}/state", "update")
    return history.latest(spark.read.parquet(f"{root}/out"), ["claim_id"], ["batch"]).select("claim_id", "status", "seq")


from . import catalog_more  # noqa: E402, F401  registers its queries here
