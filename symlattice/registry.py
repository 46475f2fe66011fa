"""Queries of the library over the star-schema tables, and DuckDB SQL that gives the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from symlattice.functions import paths as P
from symlattice.functions import text as X
from symlattice.operators import banner, changes, components, derive, fold, freshness, graph, lookup, resolve, routes, scope, search
from symlattice.plans import intent
from symlattice.plans.fixtures import duck, table, view
from symlattice.plans.prefix import ordered_cumsum
from symlattice.plans.scratch import scratch
from symlattice.streaming import watch

Query = Callable[[SparkSession, str], DataFrame]
_queries: dict[str, Query] = {}
_oracle: dict[str, str] = {}


def query(sql: str | None = None, needs: tuple[str, ...] = (), recursive: bool = False):
    def keep(f: Query) -> Query:
        _queries[f.__name__] = f
        if sql is not None:
            _oracle[f.__name__] = duck(list(needs), sql, recursive)
        return f

    return keep


def queries() -> dict[str, Query]:
    return dict(_queries)


def oracle_sql() -> dict[str, str]:
    return dict(_oracle)


def _long(*names: str):
    return [F.col(n).cast("long").alias(n) for n in names]


def stored(spark: SparkSession, sf: str, name: str) -> DataFrame:
    """A view as a table: what an iterative operator reads again in each round, as the graph store's tables are."""
    return scratch(view(spark, sf, name))


# -- traversal ------------------------------------------------------------------------------------------------


def _levels(seeds: str, depth: int = 4) -> str:
    """Levels of a breadth-first search with ranks as lists, in SQL."""
    out = [f"l0 as (select id as src_id, [seed_seq] as rank from {seeds}), s0 as (select src_id from l0)"]
    for d in range(1, depth + 1):
        out.append(
            f"l{d} as (select src_id, rank, file_path, line, conf, reason from (select c.src_id, list_append(p.rank, c.edge_id) as rank, c.file_path, c.line, c.conf, c.reason, row_number() over (partition by c.src_id order by list_append(p.rank, c.edge_id)) as rn"
            f" from fx_calls c join l{d - 1} p on c.dst_id = p.src_id where c.src_id not in (select src_id from s{d - 1})) where rn = 1), s{d} as (select src_id from s{d - 1} union select src_id from l{d})"
        )
    return "with " + ", ".join(out)


def _hop_rows(depth: int = 4) -> str:
    return " union all ".join(f"select {d} as depth, src_id, file_path, line, conf, reason, rank from l{d}" for d in range(1, depth + 1))


@query(f"{_levels('fx_seed')} select cast(depth as bigint) as depth, cast(row_number() over (partition by depth order by rank) as bigint) as place, src_id, file_path, line, conf, reason from ({_hop_rows()})", ("fx_calls", "fx_seed"))
def blast_hops(spark: SparkSession, sf: str) -> DataFrame:
    from pyspark.sql import Window

    hops = graph.blast_hops(stored(spark, sf, "fx_calls"), view(spark, sf, "fx_seed"))
    place = F.row_number().over(Window.partitionBy("depth").orderBy("rank")).cast("long")
    return hops.select(*_long("depth"), place.alias("place"), "src_id", "file_path", "line", "conf", "reason")


@query(f"{_levels('fx_seeds')} select cast(depth as bigint) as depth, src_id, file_path, line, conf, reason from ({_hop_rows()})", ("fx_calls", "fx_seeds"))
def blast_multi_seed(spark: SparkSession, sf: str) -> DataFrame:
    return graph.blast_hops(stored(spark, sf, "fx_calls"), view(spark, sf, "fx_seeds")).select(*_long("depth"), "src_id", "file_path", "line", "conf", "reason")


@query(
    "with reach(id, depth) as (select id, 0 from fx_seed union select c.src_id, r.depth + 1 from reach r join fx_calls c on c.dst_id = r.id where r.depth < 4), least as (select id, min(depth) as depth from reach group by id)"
    " select cast(depth as bigint) as depth, count(*) as n, cast(sum(id) as bigint) as id_sum from least where depth > 0 group by depth",
    ("fx_calls", "fx_seed"),
    recursive=True,
)
def blast_depths(spark: SparkSession, sf: str) -> DataFrame:
    hops = graph.blast_hops(stored(spark, sf, "fx_calls"), view(spark, sf, "fx_seed"))
    return hops.groupBy("depth").agg(F.count(F.lit(1)).alias("n"), F.sum("src_id").alias("id_sum")).select(*_long("depth"), "n", "id_sum")


@query(
    f"{_levels('fx_seed')}, h as ({_hop_rows()}) select cast(depth as bigint) as depth, string_agg(n.qualified_name || '  ' || h.file_path || ':' || cast(line as string) || '  [' || reason || ']' || case when conf = 'weak' then '  ⟨weak⟩' else '' end, chr(10) order by rank) as listing from h join fx_nodes n on n.id = h.src_id group by depth",
    ("fx_calls", "fx_seed", "fx_nodes"),
)
def blast_by_depth(spark: SparkSession, sf: str) -> DataFrame:
    hops = graph.with_nodes(graph.blast_hops(stored(spark, sf, "fx_calls"), view(spark, sf, "fx_seed")), view(spark, sf, "fx_nodes"))
    return graph.blast_depths(hops).select(*_long("depth"), F.array_join("rows", "\n").alias("listing"))


@query(f"{_levels('fx_seeds')} select coalesce(sum(case when depth = 1 then 1 else 0 end), 0)::bigint as direct, coalesce(sum(case when depth > 1 then 1 else 0 end), 0)::bigint as deeper from ({_hop_rows()})", ("fx_calls", "fx_seeds"))
def direct_callers(spark: SparkSession, sf: str) -> DataFrame:
    return graph.direct_and_deeper(graph.blast_hops(stored(spark, sf, "fx_calls"), view(spark, sf, "fx_seeds")))


def _spine_sql() -> str:
    out = [
        "f as (select src_id, dst_id, raw_name, resolved from (select *, row_number() over (partition by src_id order by line, edge_id) as rn from fx_open where kind = 'calls') where rn = 1)",
        "st as (select f.src_id as cur, f.dst_id as nxt, coalesce(n.qualified_name, f.raw_name) || '  `' || f.raw_name || '`' as text, case when f.dst_id is null or not f.resolved or coalesce(n.qualified_name, f.raw_name) like '<%' then 1 else 0 end as u from f left join fx_nodes n on n.id = f.dst_id)",
        "h0 as (select id, id as cur, [id] as passed, cast([] as varchar[]) as path, 0 as blanks from fx_nodes)",
    ]
    for k in range(1, 5):
        took, on = "(st.text is not null and blanks + u <= 1)", "(st.text is not null and blanks + u <= 1 and nxt is not null and not list_contains(passed, nxt))"
        out.append(f"h{k} as (select id, case when {on} then nxt end as cur, case when {on} then list_append(passed, nxt) else passed end as passed, case when {took} then list_append(path, st.text) else path end as path, case when {took} then blanks + u else blanks end as blanks from h{k - 1} h left join st on st.cur = h.cur)")
    return "with " + ", ".join(out) + " select h4.id, n.qualified_name || ' → ' || array_to_string(path, ' → ') as spine, len(path) as n_hops from h4 join fx_nodes n on n.id = h4.id where len(path) > 0"


@query(_spine_sql(), ("fx_open", "fx_nodes"))
def spine(spark: SparkSession, sf: str) -> DataFrame:
    nodes = view(spark, sf, "fx_nodes")
    return graph.spine(view(spark, sf, "fx_open"), nodes, nodes.select("id"))


_contains_sql = "select m.id as member_id, c.id as id, m.name, m.kind, m.start_line from fx_nodes m join fx_nodes c on c.id = m.id - m.id % 10 where m.kind = 'method'"


@query(_contains_sql, ("fx_nodes",))
def members(spark: SparkSession, sf: str) -> DataFrame:
    nodes = view(spark, sf, "fx_nodes")
    edges = nodes.where("kind = 'method'").select((F.col("id") - F.col("id") % 10).alias("src_id"), F.col("id").alias("dst_id"), F.lit("contains").alias("kind"))
    return graph.members(edges, nodes, nodes.where("kind = 'class'").select("id"))


@query(
    "select e.src_id as id, e.edge_id, coalesce(n.qualified_name, e.raw_name) as label, e.reason, case when not e.resolved then 'unresolved' when e.conf = 'weak' then 'weak' else '' end as mark, e.file_path, e.line from fx_open e left join fx_nodes n on n.id = e.dst_id where e.kind = 'calls'",
    ("fx_open", "fx_nodes"),
)
def callees(spark: SparkSession, sf: str) -> DataFrame:
    nodes = view(spark, sf, "fx_nodes")
    return graph.callees(view(spark, sf, "fx_open"), nodes, nodes.select("id"))


@query("select e.src_id as id, e.kind, coalesce(n.qualified_name, e.raw_name) as label, e.resolved, e.line from fx_open e left join fx_nodes n on n.id = e.dst_id where e.kind in ('extends', 'implements')", ("fx_open", "fx_nodes"))
def heritage(spark: SparkSession, sf: str) -> DataFrame:
    nodes = view(spark, sf, "fx_nodes")
    return graph.heritage(view(spark, sf, "fx_open"), nodes, nodes.select("id"))


@query("select e.dst_id as id, coalesce(n.qualified_name, '<module>') as user, e.file_path, e.line from fx_open e left join (select * from fx_nodes where id % 7 <> 0) n on n.id = e.src_id where e.kind = 'references' and e.dst_id is not null", ("fx_open", "fx_nodes"))
def uses(spark: SparkSession, sf: str) -> DataFrame:
    nodes = view(spark, sf, "fx_nodes")
    return graph.uses(view(spark, sf, "fx_open"), nodes.where("id % 7 <> 0"), nodes.select("id"))


@query(
    "with s as (select * from fx_open where kind in ('handles_route', 'step_in', 'member_of')), b as (select src_id as id, kind, dst_id as peer from s union select dst_id, kind, src_id from s where dst_id is not null)"
    " select distinct b.id, b.kind, n.name, n.qualified_name from b join fx_nodes n on n.id = b.peer",
    ("fx_open", "fx_nodes"),
)
def routes_touching(spark: SparkSession, sf: str) -> DataFrame:
    nodes = view(spark, sf, "fx_nodes")
    return graph.routes_touching(view(spark, sf, "fx_open"), nodes, nodes.select("id"))


# -- lookup and text --------------------------------------------------------------------------------------------


@query("select name, id, same_name from (select name, id, row_number() over (partition by name order by exported desc, start_line, node_seq) as rn, count(*) over (partition by name) as same_name from fx_nodes) where rn = 1", ("fx_nodes",))
def pick_symbols(spark: SparkSession, sf: str) -> DataFrame:
    nodes = view(spark, sf, "fx_nodes")
    return lookup.pick_symbols(nodes, nodes.select("name"))


@query("select id, kind, file_path, start_line, exported from fx_nodes where name = 'u25' order by exported desc, start_line, node_seq limit 1", ("fx_nodes",))
def pick_symbol(spark: SparkSession, sf: str) -> DataFrame:
    return lookup.pick_symbol(view(spark, sf, "fx_nodes"), "u25").select("id", "kind", "file_path", "start_line", "exported")


_NAME = "(select case when id % 3 = 0 then 'thing' else name end as name, id, kind, qualified_name, cast(id % 150 as string) as file_path, start_line, end_line, exported, signature, node_seq from fx_nodes)"


def _thing_nodes(spark: SparkSession, sf: str) -> DataFrame:
    return view(spark, sf, "fx_nodes").withColumn("name", F.when(F.col("id") % 3 == 0, "thing").otherwise(F.col("name"))).withColumn("file_path", (F.col("id") % 150).cast("string"))


@query(f"select id, file_path, start_line from {_NAME} where name = 'thing' and id <> (select id from {_NAME} where name = 'thing' order by exported desc, start_line, node_seq limit 1)", ("fx_nodes",))
def same_name(spark: SparkSession, sf: str) -> DataFrame:
    return lookup.same_name(_thing_nodes(spark, sf), "thing").select("id", "file_path", "start_line")


_THE = r"regexp_matches(line, '(^|[^\p{L}\p{N}_$])the([^\p{L}\p{N}_$]|$)')"


@query(f"select path, min(line_no) as first_line, count(*) as n_lines from fx_lines where {_THE} group by path", ("fx_lines",))
def word_mentions(spark: SparkSession, sf: str) -> DataFrame:
    return lookup.word_mentions(view(spark, sf, "fx_lines"), "the")


def _the_nodes(spark: SparkSession, sf: str) -> DataFrame:
    return _thing_nodes(spark, sf).withColumn("name", F.when(F.col("id") % 40 == 1, "the").otherwise(F.col("name")))


_THE_NODES = "tn as (select id, case when id % 40 = 1 then 'the' else name end as name, cast(id % 150 as string) as file_path from fx_nodes)"
_THE_EDGES = "te as (select dst_id, kind, resolved, cast(src_id % 200 as string) as file_path from fx_open)"
_TEXT_ONLY = f"with {_THE_NODES}, {_THE_EDGES}, lk as (select file_path as path from tn where name = 'the' union select e.file_path from te e join tn n on n.id = e.dst_id where n.name = 'the' and e.kind in ('calls', 'references') and e.resolved), m as (select path, min(line_no) as first_line, count(*) as n_lines from fx_lines where {_THE} group by path having path not in (select path from lk))"


def _the_edges(spark: SparkSession, sf: str) -> DataFrame:
    return view(spark, sf, "fx_open").withColumn("file_path", (F.col("src_id") % 200).cast("string"))


@query(_TEXT_ONLY + " select path, first_line, n_lines, path || ':' || cast(first_line as string) || case when n_lines > 1 then '  (+' || cast(n_lines - 1 as string) || ' lines)' else '' end as mention from m", ("fx_lines", "fx_nodes", "fx_open"))
def text_only_mentions(spark: SparkSession, sf: str) -> DataFrame:
    return lookup.text_only_mentions(view(spark, sf, "fx_lines"), _the_nodes(spark, sf), _the_edges(spark, sf), "the")


@query(_TEXT_ONLY + ", c as (select (select count(*) from tn where name = 'the') as n_same_name, (select count(*) from m) as n_text_only) select n_same_name, n_text_only, case when n_same_name > 6 then 'same-name' when n_text_only > 12 then 'text-only' end as gap from c", ("fx_lines", "fx_nodes", "fx_open"))
def grep_gap(spark: SparkSession, sf: str) -> DataFrame:
    return lookup.grep_gap(view(spark, sf, "fx_lines"), _the_nodes(spark, sf), _the_edges(spark, sf), "the")


# -- banners ----------------------------------------------------------------------------------------------------


@query("select (select count(*) from fx_files) as files, (select count(*) from fx_nodes) as nodes, (select count(*) from fx_open) as edges", ("fx_files", "fx_nodes", "fx_open"))
def banner_counts(spark: SparkSession, sf: str) -> DataFrame:
    return banner.counts(*(view(spark, sf, v) for v in ("fx_files", "fx_nodes", "fx_open")))


@query(
    "with m as (select member, case when member % 6 = 0 then 0 else files end as files, case when member % 5 = 0 then 'rebuilding' else 'idle' end as state, case when member % 4 <> 0 then 'c' || cast(member % 3 as string) end as a, case when member % 7 <> 0 then 'c' || cast(member % 2 as string) end as b from fx_banners)"
    " select member, case when files = 0 then 'missing' when state = 'rebuilding' then 'rebuilding' when a is not null and b is not null and a <> b then 'stale' when a is not null and b is not null then 'fresh' when b is not null then 'stale' else 'fresh' end as trust from m",
    ("fx_banners",),
)
def trust_axis(spark: SparkSession, sf: str) -> DataFrame:
    m = F.col("member")
    head = lambda by, mod: F.when(m % by != 0, F.concat(F.lit("c"), (m % mod).cast("string")))
    t = banner.trust(F.when(m % 6 == 0, 0).otherwise(F.col("files")), F.when(m % 5 == 0, "rebuilding").otherwise("idle"), head(4, 3), head(7, 2))
    return view(spark, sf, "fx_banners").select("member", t.alias("trust"))


@query(
    "with e as (select * from fx_open o where kind in ('calls', 'extends', 'implements') and (reason in ('import-binding', 'same-file', 'unique-global') or (reason = 'unresolved' and exists (select 1 from fx_nodes n where n.name = o.raw_name))))"
    " select count(*) as considered, coalesce(sum(case when resolved then 1 else 0 end), 0)::bigint as resolved, case when count(*) = 0 or sum(case when resolved then 1 else 0 end) >= 0.6 * count(*) then 'ok' else 'partial' end as quality from e",
    ("fx_open", "fx_nodes"),
)
def resolve_quality(spark: SparkSession, sf: str) -> DataFrame:
    return banner.resolve_quality(view(spark, sf, "fx_open"), view(spark, sf, "fx_nodes"))


@query(
    "select grp, case max(case trust when 'fresh' then 0 when 'stale' then 1 when 'rebuilding' then 2 else 3 end) when 0 then 'fresh' when 1 then 'stale' when 2 then 'rebuilding' else 'missing' end as trust, case when bool_or(coverage = 'sampled') then 'sampled' else 'exhaustive' end as coverage,"
    " case when bool_or(resolve = 'partial') then 'partial' else 'ok' end as resolve, sum(files)::bigint as files, sum(nodes)::bigint as nodes, sum(edges)::bigint as edges from fx_banners group by grp",
    ("fx_banners",),
)
def banner_merge(spark: SparkSession, sf: str) -> DataFrame:
    return banner.merge(view(spark, sf, "fx_banners"), "grp")


@query(
    "select n_nationkey as member, coalesce(trust, 'missing') as trust, coalesce(coverage, 'exhaustive') as coverage, coalesce(resolve, 'ok') as resolve, coalesce(files, 0) as files, coalesce(nodes, 0) as nodes, coalesce(edges, 0) as edges from nation left join (select * from fx_banners where member % 4 <> 1) b on b.member = n_nationkey",
    ("fx_banners",),
)
def banner_members(spark: SparkSession, sf: str) -> DataFrame:
    nation = table(spark, sf, "nation").select(F.col("n_nationkey").alias("member"))
    return banner.with_members(nation, view(spark, sf, "fx_banners").where("member % 4 <> 1").drop("grp"), "member")


# -- search -----------------------------------------------------------------------------------------------------

_DOC = "name || ' ' || qualified_name || ' ' || signature || ' ' || file_path"
_TOKENS = r"list_filter(string_split_regex(lower(regexp_replace(%s, '([\p{Ll}\p{N}])(\p{Lu})', '\1 \2', 'g')), '[^\p{L}\p{N}]+'), lambda t: t <> '')"
_TRI = r"(case when len(w) >= 3 then list_transform(range(1, len(w) - 1), lambda i: substr(w, i, 3)) else [] end)"


@query(f"select id, array_to_string({_TOKENS % _DOC}, ' ') as tokens from fx_nodes", ("fx_nodes",))
def tokens(spark: SparkSession, sf: str) -> DataFrame:
    doc = X.document(*(F.col(c) for c in ("name", "qualified_name", "signature", "file_path")))
    return view(spark, sf, "fx_nodes").select("id", F.array_join(X.tokens(doc), " ").alias("tokens"))


_W = r"(select *, lower(regexp_replace(string_split(name, ' ')[1], '[^\p{L}\p{N}]', '', 'g')) as w from fx_nodes)"


@query(f"select id, array_to_string({_TRI}, ' ') as trigrams from {_W}", ("fx_nodes",))
def trigrams(spark: SparkSession, sf: str) -> DataFrame:
    return view(spark, sf, "fx_nodes").select("id", F.array_join(X.trigrams(F.col("name")), " ").alias("trigrams"))


_BUCKET = "list_reduce(list_transform(range(1, len(t) + 1), lambda i: ascii(substr(t, i, 1))), lambda h, b: (xor(h, b) * 179) & 255, 37)"


@query(f"select distinct t as token, {_BUCKET}::bigint as bucket from (select unnest({_TOKENS % _DOC}) as t from fx_nodes)", ("fx_nodes",))
def fnv_buckets(spark: SparkSession, sf: str) -> DataFrame:
    doc = X.document(*(F.col(c) for c in ("name", "qualified_name", "signature", "file_path")))
    return view(spark, sf, "fx_nodes").select(F.explode(X.tokens(doc)).alias("token")).distinct().select("token", X.fnv_bucket(F.col("token")).cast("long").alias("bucket"))


_BAG = f"bag as (select id, node_seq, unnest(list_concat({_TOKENS % _DOC}, {_TRI})) as t from {_W} where kind in ('function', 'class', 'method'))"
_VEC = f"vec as (select id, node_seq, {_BUCKET} as bucket, count(*) * case when {_BUCKET} % 2 = 0 then 1 else -1 end as weight from bag group by id, node_seq, bucket)"
_QUERY = "small bolt user"
_QVEC = (
    f"qb as (select unnest(list_concat({_TOKENS % repr(_QUERY)}, ['sma', 'mal', 'all'])) as t), q as (select {_BUCKET} as bucket, count(*) * case when {_BUCKET} % 2 = 0 then 1 else -1 end as qw from qb group by bucket)"
)
_COS = "cos as (select v.id, v.node_seq, coalesce(sum(v.weight * q.qw), 0) / (sqrt(sum(v.weight * v.weight)) * (select sqrt(sum(qw * qw)) from q)) as score from vec v left join q on q.bucket = v.bucket group by v.id, v.node_seq), top as (select id, cast(row_number() over (order by score desc, node_seq) as bigint) as rank, score from cos order by score desc, node_seq limit 50)"


@query(f"with {_BAG}, {_VEC} select id, bucket::bigint as bucket, weight::bigint as weight from vec", ("fx_nodes",))
def hash_vectors(spark: SparkSession, sf: str) -> DataFrame:
    return search.hash_vectors(view(spark, sf, "fx_nodes")).select("id", *_long("bucket", "weight"))


@query(f"with {_BAG}, {_VEC}, {_QVEC}, {_COS} select id, rank, round(score, 6) as score from top", ("fx_nodes",))
def cosine_topk(spark: SparkSession, sf: str) -> DataFrame:
    nodes = view(spark, sf, "fx_nodes")
    top = search.cosine_topk(search.hash_vectors(nodes), search.query_vector(spark, _QUERY))
    return top.select("id", *_long("rank"), F.round("score", 6).alias("score"))


@query(
    "with q as (select embedding::double[] as v from embeddings order by vec_id limit 1), s as (select vec_id as id, list_dot_product(embedding::double[], q.v) / sqrt(list_dot_product(embedding::double[], embedding::double[])) / sqrt(list_dot_product(q.v, q.v)) as score from embeddings, q)"
    " select id, cast(row_number() over (order by score desc, id) as bigint) as rank, round(score, 6) as score from s order by score desc, id limit 20"
)
def dense_cosine_topk(spark: SparkSession, sf: str) -> DataFrame:
    e = table(spark, sf, "embeddings")
    return search.array_cosine_topk(e, e.orderBy("vec_id").limit(1), 20).select("id", *_long("rank"), F.round("score", 6).alias("score"))


_INDEX = r"ix as (select id, node_seq, unnest(list_distinct(list_filter(string_split_regex(lower(name || ' ' || qualified_name || ' ' || file_path), '[^\p{L}\p{N}]+'), lambda t: t <> ''))) as token from fx_nodes)"
_FTS = "fts as (select id, cast(row_number() over (order by node_seq) as bigint) as rank from (select id, node_seq from ix where token in (%s) group by id, node_seq having count(distinct token) = %d) order by node_seq limit 25)"


@query(f"with {_INDEX}, {_FTS % (repr('src') + ', ' + repr('bolt'), 2)} select id, rank from fts", ("fx_nodes",))
def fts_match(spark: SparkSession, sf: str) -> DataFrame:
    return search.fts_match(search.token_index(view(spark, sf, "fx_nodes")), "src AND BOLT", 25).select("id", *_long("rank"))


@query("select id, cast(row_number() over (order by node_seq) as bigint) as rank from fx_nodes where contains(lower(name), 'u1') order by node_seq limit 25", ("fx_nodes",))
def like_fallback(spark: SparkSession, sf: str) -> DataFrame:
    return search.text_ranked(view(spark, sf, "fx_nodes"), "U_1%", 25).select("id", *_long("rank"))


_RRF = "fused as (select id, sum(1.0 / (60 + rank)) as score, min(list * 1000000 + rank) as first from (select id, rank, 0 as list from fts union all select id, rank, 1 from top) group by id), done as (select id, cast(row_number() over (order by round(score, 12) desc, first) as bigint) as rank, score from fused order by round(score, 12) desc, first limit 25)"


@query(f"with {_INDEX}, {_FTS % (repr('bolt'), 1)}, {_BAG}, {_VEC}, {_QVEC}, {_COS}, {_RRF} select id, rank, round(score, 6) as score from done", ("fx_nodes",))
def rrf_fusion(spark: SparkSession, sf: str) -> DataFrame:
    nodes = view(spark, sf, "fx_nodes")
    lists = [search.fts_match(search.token_index(nodes), "bolt", 25), search.cosine_topk(search.hash_vectors(nodes), search.query_vector(spark, _QUERY))]
    return search.rrf(lists).select("id", *_long("rank"), F.round("score", 6).alias("score"))


_QVEC1 = f"qb as (select unnest(['bolt', 'bol', 'olt']) as t), q as (select {_BUCKET} as bucket, count(*) * case when {_BUCKET} % 2 = 0 then 1 else -1 end as qw from qb group by bucket)"


@query(f"with {_INDEX}, {_FTS % (repr('bolt'), 1)}, {_BAG}, {_VEC}, {_QVEC1}, {_COS}, {_RRF} select d.id, d.rank, round(d.score, 6) as score, n.name, n.kind, n.exported from done d join fx_nodes n on n.id = d.id", ("fx_nodes",))
def hybrid_search(spark: SparkSession, sf: str) -> DataFrame:
    nodes = view(spark, sf, "fx_nodes")
    found = search.search_rows(nodes, search.hybrid_search(nodes, "bolt"))
    return found.select("id", *_long("rank"), F.round("score", 6).alias("score"), "name", "kind", "exported")


# -- derived graph ------------------------------------------------------------------------------------------------


@query("select distinct src_id as id from fx_calls where src_id not in (select dst_id from fx_calls)", ("fx_calls",))
def flow_entrypoints(spark: SparkSession, sf: str) -> DataFrame:
    return derive.entrypoints(view(spark, sf, "fx_calls"))


def _flow_sql() -> str:
    out = ["o as (select distinct src_id, dst_id, conf from fx_calls)", "w0 as (select id, [id] as steps, cast([] as varchar[]) as confs, id as cur from (select distinct src_id as id from fx_calls where src_id not in (select dst_id from fx_calls)) order by id limit 50)"]
    for k in range(1, 8):
        out.append(
            f"b{k} as (select id, dst_id, conf from (select w.id, o.dst_id, o.conf, row_number() over (partition by w.id order by o.dst_id, o.conf) as rn from w{k - 1} w join o on o.src_id = w.cur where not list_contains(w.steps, o.dst_id)) where rn = 1)"
        )
        out.append(f"w{k} as (select w.id, case when b.id is null then steps else list_append(steps, b.dst_id) end as steps, case when b.id is null then confs else list_append(confs, b.conf) end as confs, b.dst_id as cur from w{k - 1} w left join b{k} b on b.id = w.id)")
    return "with " + ", ".join(out) + " select cast(row_number() over (order by id) - 1 as bigint) as number, id, array_to_string(steps, '>') as steps, case when list_contains(confs, 'weak') then 'weak' else 'strong' end as conf from w7 where len(steps) >= 2"


@query(_flow_sql(), ("fx_calls",))
def flows(spark: SparkSession, sf: str) -> DataFrame:
    return derive.flows(stored(spark, sf, "fx_calls")).select(*_long("number"), "id", F.array_join(F.transform("steps", lambda x: x.cast("string")), ">").alias("steps"), "conf")


@query("select src_id as id, case when bool_and(conf = 'strong') then 'strong' else 'weak' end as conf from fx_calls group by src_id", ("fx_calls",))
def aggregate_conf(spark: SparkSession, sf: str) -> DataFrame:
    return view(spark, sf, "fx_calls").groupBy(F.col("src_id").alias("id")).agg(derive.aggregate_conf().alias("conf"))


def _component_sql(rounds: int = 16) -> str:
    """Least labels handed on along edges, round by round: enough where no two symbols of a component are further apart."""
    out = ["p as (select distinct least(src_id, dst_id) as a, greatest(src_id, dst_id) as b from fx_calls)", "e as materialized (select a, b from p union select b, a from p)", "c0 as (select a as node, a as label from e group by a)"]
    for k in range(1, rounds + 1):
        out.append(f"c{k} as materialized (select c.node, least(min(c.label), min(d.label)) as label from c{k - 1} c join e on e.a = c.node join c{k - 1} d on d.node = e.b group by c.node)")
    return "with " + ", ".join(out) + f" select node, label as component from c{rounds}"


@query(_component_sql(), ("fx_calls",))
def connected_components(spark: SparkSession, sf: str) -> DataFrame:
    return components.connected_components(stored(spark, sf, "fx_calls"), "src_id", "dst_id")


@query()
def communities(spark: SparkSession, sf: str) -> DataFrame:
    nodes = view(spark, sf, "fx_nodes")
    clusters, found = derive.communities(derive.derive_input(nodes, stored(spark, sf, "fx_calls"))[1], nodes)
    return found.groupBy("number").agg(F.count(F.lit(1)).alias("n"), F.min("id").alias("first")).join(clusters, "number")


@query()
def derived_graph(spark: SparkSession, sf: str) -> DataFrame:
    return derive.derived_rows(view(spark, sf, "fx_nodes"), stored(spark, sf, "fx_calls"))[1]


# -- changes ------------------------------------------------------------------------------------------------------

_HUNKS = (
    r"h as (select *, last_value(case when line like '+++ %' then ord end ignore nulls) over (order by ord rows unbounded preceding) as file_ord from fx_diff), f as (select file_ord, max(case when ord = file_ord then substr(line, 7) end) as file_path from h group by file_ord),"
    r" g as (select h.file_ord, f.file_path, cast(regexp_extract(line, '\+(\d+)', 1) as bigint) as s, coalesce(try_cast(nullif(regexp_extract(line, '\+\d+,(\d+)', 1), '') as bigint), 1) as n from h join f on f.file_ord = h.file_ord where line like '@@%')"
)
_CHANGED = "ch as (select distinct n.id, n.node_seq as seed_seq from fx_nodes n join g on g.file_path = n.file_path where g.n > 0 and n.start_line <= g.s + g.n - 1 and g.s <= n.end_line)"


@query(f"with {_HUNKS} select file_path, file_ord, case when n > 0 then s end as start, case when n > 0 then s + n - 1 end as \"end\", false as unmappable from g", ("fx_diff",))
def parse_hunks(spark: SparkSession, sf: str) -> DataFrame:
    return changes.parse_hunks(view(spark, sf, "fx_diff"))


@query(f"with {_HUNKS}, {_CHANGED} select n.id, n.kind, n.file_path, n.start_line from ch join fx_nodes n on n.id = ch.id", ("fx_diff", "fx_nodes"))
def changed_symbols(spark: SparkSession, sf: str) -> DataFrame:
    hunks = changes.parse_hunks(view(spark, sf, "fx_diff"))
    return changes.overlapping_symbols(view(spark, sf, "fx_nodes"), hunks).select("id", "kind", "file_path", "start_line")


@query(f"with {_HUNKS}, {_CHANGED}, {_levels('ch')[5:]} select cast(depth as bigint) as depth, n.id, n.file_path, n.start_line from ({_hop_rows()}) x join fx_nodes n on n.id = x.src_id", ("fx_diff", "fx_nodes", "fx_calls"))
def affected(spark: SparkSession, sf: str) -> DataFrame:
    nodes = view(spark, sf, "fx_nodes")
    _, hit, _ = changes.impact(nodes, stored(spark, sf, "fx_calls"), changes.parse_hunks(view(spark, sf, "fx_diff")))
    return hit.select(*_long("depth"), "id", "file_path", "start_line")


@query(
    f"with {_HUNKS}, t as (select f.file_ord, bool_or(coalesce(x.hit, false)) as hit from f left join (select distinct n.file_path, true as hit from fx_nodes n join g on g.file_path = n.file_path where g.n > 0 and n.start_line <= g.s + g.n - 1 and g.s <= n.end_line) x on x.file_path = f.file_path group by f.file_ord)"
    " select count(*) as n_files, coalesce(sum(case when hit then 0 else 1 end), 0)::bigint as n_unmapped, coalesce(sum(case when hit then 0 else 1 end), 0) > 0 as partial from t",
    ("fx_diff", "fx_nodes"),
)
def partial_files(spark: SparkSession, sf: str) -> DataFrame:
    return changes.is_partial(view(spark, sf, "fx_nodes"), changes.parse_hunks(view(spark, sf, "fx_diff")))


# -- folding ------------------------------------------------------------------------------------------------------

_HITS = f"raw as (select cast(row_number() over (order by cast(path as bigint), line_no) as bigint) as ord, 'd/' || path || ':' || cast(line_no as string) || ':' || line as raw from fx_lines where {_THE}), hits as (select ord, regexp_extract(raw, '^(.+?):([0-9]+):', 1) as path, cast(regexp_extract(raw, '^(.+?):([0-9]+):', 2) as bigint) as line, substr(raw, len(regexp_extract(raw, '^(.+?):([0-9]+):')) + 1) as text from raw)"
_SPANS = "spans as (select 'd/' || path as path, line_no as span_seq, case when line_no = 1 then 'class' else 'function' end as kind, 's' || cast(line_no as string) as name, case when line_no = 1 then 1 else line_no end as start, case when line_no = 1 then 9 else line_no + 2 end as \"end\" from fx_lines where line_no % 3 = 1 and cast(path as bigint) % 4 <> 0)"
_OWNED = "owned as (select h.*, h.path in (select path from spans) as in_graph, o.span_seq, o.kind, o.name, o.start, o.\"end\" from hits h left join (select * from (select h.ord, s.*, row_number() over (partition by h.ord order by s.\"end\" - s.start, -s.start, s.span_seq) as rn from hits h join spans s on s.path = h.path and s.start <= h.line and h.line <= s.\"end\") where rn = 1) o on o.ord = h.ord)"


def _hits(spark: SparkSession, sf: str) -> DataFrame:
    lines = view(spark, sf, "fx_lines").where(X.has_word(F.col("line"), "the")).select(F.col("path").cast("long").alias("file"), "path", "line_no", "line", F.lit(1).alias("one"))
    numbered = ordered_cumsum(lines, ["file", "line_no"], "one", "before")
    return numbered.select((F.col("before") + 1).alias("ord"), F.concat(F.lit("d/"), "path", F.lit(":"), F.col("line_no").cast("string"), F.lit(":"), "line").alias("raw"))


def _span_table(spark: SparkSession, sf: str) -> DataFrame:
    first = F.col("line_no") == 1
    some = view(spark, sf, "fx_lines").where("line_no % 3 = 1 and cast(path as bigint) % 4 <> 0")
    return some.select(F.concat(F.lit("d/"), "path").alias("path"), F.col("line_no").alias("span_seq"), F.when(first, "class").otherwise("function").alias("kind"), F.concat(F.lit("s"), F.col("line_no").cast("string")).alias("name"), F.col("line_no").alias("start"), F.when(first, 9).otherwise(F.col("line_no") + 2).alias("end"))


def _owned(spark: SparkSession, sf: str) -> DataFrame:
    return fold.enclosing(fold.parse_hits(_hits(spark, sf)), _span_table(spark, sf))


@query(f"with {_HITS} select ord, path, line, text, true as parsed from hits", ("fx_lines",))
def parse_hits(spark: SparkSession, sf: str) -> DataFrame:
    return fold.parse_hits(_hits(spark, sf))


@query(f"with {_HITS}, {_SPANS}, {_OWNED} select ord, path, line, in_graph, kind, name, start, \"end\" from owned", ("fx_lines",))
def enclosing_symbol(spark: SparkSession, sf: str) -> DataFrame:
    return _owned(spark, sf).select("ord", "path", "line", "in_graph", "owner.kind", "owner.name", "owner.start", "owner.end")


@query(f"with {_HITS}, {_SPANS}, {_OWNED} select path, name, count(*) as n, string_agg(cast(line as string), ',' order by ord) as lines, arg_min(text, ord) as text, min(ord) as first_ord from owned where in_graph group by path, span_seq, name", ("fx_lines",))
def fold_groups(spark: SparkSession, sf: str) -> DataFrame:
    g = fold.fold_groups(_owned(spark, sf))
    return g.select("path", "owner.name", "n", F.array_join(F.transform("lines", lambda x: x.cast("string")), ",").alias("lines"), "text", "first_ord")


@query(f"with {_HITS}, {_SPANS}, {_OWNED} select path, ord, line, cast(place as bigint) as place, n from (select *, row_number() over (partition by path order by ord) as place, count(*) over (partition by path) as n from owned where not in_graph) where place <= 3", ("fx_lines",))
def fold_loose(spark: SparkSession, sf: str) -> DataFrame:
    return fold.loose_lines(_owned(spark, sf)).select("path", "ord", "line", *_long("place"), "n")


@query(
    f"with {_HITS}, {_SPANS}, {_OWNED}, rws as (select path, true as in_graph, min(ord) as row_ord from owned where in_graph group by path, span_seq union all select path, false, ord from (select *, row_number() over (partition by path order by ord) as place from owned where not in_graph) where place <= 3),"
    " pl as (select r.*, row_number() over (order by f.file_ord, r.row_ord) as \"at\" from rws r join (select path, min(ord) as file_ord from owned group by path) f on f.path = r.path),"
    " sh as (select *, case when in_graph then \"at\" <= 40 else min(\"at\") over (partition by path) <= 40 end as shown from pl) select path, row_ord, cast(\"at\" as bigint) as \"at\", in_graph, shown from sh",
    ("fx_lines",),
)
def fold_cap(spark: SparkSession, sf: str) -> DataFrame:
    return fold.fold_cap(fold.fold_rows(_owned(spark, sf))).select("path", "row_ord", *_long("at"), "in_graph", "shown")


@query("select path, line_no, substr(line, 1, 3) || substr(line, 6, 1) || substr(line, 10) as line from fx_lines", ("fx_lines",))
def tail_cut(spark: SparkSession, sf: str) -> DataFrame:
    ranges = fold.parse_cut("-3,2,6,10-")
    return view(spark, sf, "fx_lines").select("path", "line_no", fold.keep_chars(F.col("line"), ranges).alias("line"))


# -- resolution -----------------------------------------------------------------------------------------------------

_MODULES = "md as (select distinct b.file_path, b.source_module, f.path as target from fx_bindings b left join fx_files f on b.source_module like '../../%' and f.path = substr(b.source_module, 7) || '.ts')"
_FIRST = "fs as (select file_path, name, arg_min(id, seq) as id from fx_symbols group by file_path, name)"
_IMPORT = f"{_MODULES}, {_FIRST}, im as (select b.file_path, b.local_name, m.target is not null as in_tree, left(b.source_module, 1) = '.' as relative, fs.id as import_id from fx_bindings b join md m on m.file_path = b.file_path and m.source_module = b.source_module left join fs on fs.file_path = m.target and fs.name = b.imported_name)"
_VALUES = "vs as (select * from fx_symbols where kind not in ('interface', 'type', 'enum')), hr as (select file_path, name, min(id) as here_id from vs where kind <> 'method' group by file_path, name having count(*) = 1), an as (select name, min(id) as only_id from vs group by name having count(*) = 1)"
_CASCADE_JOIN = "from fx_rawcalls c left join im on im.file_path = c.file_path and im.local_name = c.name left join hr on hr.file_path = c.file_path and hr.name = c.name left join an on an.name = c.name"
_BOUND = "not c.member and im.local_name is not null"


def _facts(spark: SparkSession, sf: str):
    symbols, bindings, files = (view(spark, sf, v) for v in ("fx_symbols", "fx_bindings", "fx_files"))
    return symbols, bindings, resolve.resolve_modules(bindings, files)


@query(f"with {_MODULES} select * from md", ("fx_bindings", "fx_files"))
def resolve_modules(spark: SparkSession, sf: str) -> DataFrame:
    return resolve.resolve_modules(view(spark, sf, "fx_bindings"), view(spark, sf, "fx_files"))


@query(
    f"with {_IMPORT}, {_VALUES} select c.call_seq as edge, c.from_id as src_id, case when {_BOUND} and import_id is not null then import_id when {_BOUND} and not in_tree and not relative then null when here_id is not null then here_id when c.member then only_id else only_id end as dst_id, c.name as raw_name,"
    f" case when {_BOUND} and import_id is not null then 'import-binding' when {_BOUND} and not in_tree and not relative then 'external-import' when here_id is not null then 'same-file' when c.member then 'receiver-unknown' when only_id is not null then 'unique-global' else 'unresolved' end as reason,"
    f" case when ({_BOUND} and (import_id is not null or (not in_tree and not relative))) or here_id is not null then 'strong' else 'weak' end as conf {_CASCADE_JOIN}",
    ("fx_rawcalls", "fx_bindings", "fx_symbols", "fx_files"),
)
def resolve_calls(spark: SparkSession, sf: str) -> DataFrame:
    symbols, bindings, modules = _facts(spark, sf)
    e = resolve.resolve_calls(view(spark, sf, "fx_rawcalls"), symbols, bindings, modules)
    return e.select(F.col("order").alias("edge"), "src_id", "dst_id", "raw_name", "reason", "conf")


@query(
    f"with {_IMPORT}, an as (select name, min(id) as only_id from fx_symbols group by name having count(*) = 1), h as (select *, string_split(raw_name, '.')[-1] as last_name from fx_heritage)"
    " select h.seq as edge, h.src_id, case when r.import_id is not null then r.import_id when r.local_name is null and l.import_id is not null then l.import_id when (r.local_name is not null and not r.in_tree and not r.relative) or (r.local_name is null and l.local_name is not null and not l.in_tree and not l.relative) then null when only_id is not null then only_id else fs.id end as dst_id,"
    " case when r.import_id is not null or (r.local_name is null and l.import_id is not null) then 'import-binding' when (r.local_name is not null and not r.in_tree and not r.relative) or (r.local_name is null and l.local_name is not null and not l.in_tree and not l.relative) then 'external-import' when only_id is not null then 'unique-global' when fs.id is not null then 'same-file' else 'unresolved' end as reason"
    " from h left join im r on r.file_path = h.file_path and r.local_name = h.raw_name left join im l on l.file_path = h.file_path and l.local_name = h.last_name left join an on an.name = h.last_name left join fs on fs.file_path = h.file_path and fs.name = h.last_name",
    ("fx_heritage", "fx_bindings", "fx_symbols", "fx_files"),
)
def resolve_heritage(spark: SparkSession, sf: str) -> DataFrame:
    symbols, bindings, modules = _facts(spark, sf)
    e = resolve.resolve_heritage(view(spark, sf, "fx_heritage"), symbols, bindings, modules)
    return e.select(F.col("order").alias("edge"), "src_id", "dst_id", "reason")


@query(
    f"with {_IMPORT}, nm as (select file_path, name, arg_min(id, seq) as id from fx_symbols where kind <> 'method' group by file_path, name), j as (select r.*, coalesce(im.import_id, nm.id) as dst_id, case when im.import_id is not null then 'import-binding' else 'same-file' end as reason from fx_refs r left join im on im.file_path = r.file_path and im.local_name = r.name left join nm on nm.file_path = r.file_path and nm.name = r.name)"
    " select from_id as src_id, dst_id, line, arg_min(name, ref_seq) as raw_name, arg_min(reason, ref_seq) as reason from j where dst_id is not null and dst_id <> from_id group by from_id, dst_id, line",
    ("fx_refs", "fx_bindings", "fx_symbols", "fx_files"),
)
def resolve_refs(spark: SparkSession, sf: str) -> DataFrame:
    symbols, bindings, modules = _facts(spark, sf)
    return resolve.resolve_refs(view(spark, sf, "fx_refs"), symbols, bindings, modules).select("src_id", "dst_id", "line", "raw_name", "reason")


@query(
    "with cl as (select file_path, name, arg_min(id, seq) as id from fx_symbols where kind = 'class' group by file_path, name), m as (select id, name, file_path, start_line, seq, string_split(qualified_name, '.')[1] as c from (select id, name, file_path, start_line, seq, kind, case when kind = 'method' then (select name from cl where cl.file_path = s.file_path order by name limit 1) || '.' || name end as qualified_name from fx_symbols s) where qualified_name is not null)"
    " select cl.id as src_id, m.id as dst_id, m.name as raw_name, m.start_line as line from m join cl on cl.file_path = m.file_path and cl.name = m.c",
    ("fx_symbols",),
)
def contains_edges(spark: SparkSession, sf: str) -> DataFrame:
    symbols = view(spark, sf, "fx_symbols")
    owner = symbols.where("kind = 'class'").groupBy("file_path").agg(F.min("name").alias("owner"))
    named = symbols.join(owner, "file_path", "left").withColumn("qualified_name", F.when(F.col("kind") == "method", F.concat("owner", F.lit("."), "name")).otherwise(F.col("name")))
    return resolve.contains_edges(named).select("src_id", "dst_id", "raw_name", "line")


@query(
    "with md as (select b.file_path, b.bind_seq, f.path as target from fx_barrels b join fx_files f on f.path = 'src/' || substr(b.source_module, 3) || '.ts'), fs as (select file_path, name, arg_min(id, seq) as id from fx_symbols where name <> 'default' group by file_path, name),"
    " rq as (select distinct 'src/all' || cast(seq % 5 as string) || '.ts' as file_path, name from fx_symbols)"
    " select rq.file_path as file, rq.name as want, arg_min(fs.id, md.bind_seq) as id from rq join md on md.file_path = rq.file_path join fs on fs.file_path = md.target and fs.name = rq.name group by rq.file_path, rq.name",
    ("fx_barrels", "fx_files", "fx_symbols"),
)
def barrels(spark: SparkSession, sf: str) -> DataFrame:
    symbols, bindings, files = (stored(spark, sf, v) for v in ("fx_symbols", "fx_barrels", "fx_files"))
    modules = resolve.resolve_modules(bindings, files)
    asked = symbols.select(F.concat(F.lit("src/all"), (F.col("seq") % 5).cast("string"), F.lit(".ts")).alias("file"), F.col("name").alias("want"))
    return resolve.resolve_exports(asked, symbols, bindings, modules)


# -- routes and dispatch ----------------------------------------------------------------------------------------------


def _call_route_sql() -> str:
    at = lambda m: f"case when strpos(t, '.{m}(') > 1 and regexp_matches(substr(t, strpos(t, '.{m}(') - 1, 1), '[A-Za-z0-9_)]') then '{m}' end"
    verb = "coalesce(" + ", ".join(at(m) for m in routes.CALL_METHODS) + ")"
    return (
        f"with t as (select path, line_no, ltrim(line) as t from fx_route_lines), v as (select *, {verb} as m from t), r as (select *, ltrim(substr(t, strpos(t, '.' || m || '(') + len(m) + 2)) as rest from v where m is not null), q as (select *, substr(rest, 1, 1) as q from r where substr(rest, 1, 1) in ('''', '\"', '`')),"
        " p as (select *, strpos(substr(rest, 2), q) as e from q), s as (select *, substr(rest, 2, e - 1) as route, ltrim(substr(rest, e + 2)) as a from p where e > 0), u as (select *, ltrim(case when left(a, 1) = ',' then substr(a, 2) else a end) as b from s)"
        " select path, line_no, upper(m) as method, route, case when starts_with(b, 'async ') or starts_with(b, 'function') or starts_with(b, '(') or regexp_extract(b, '^[A-Za-z0-9_.]*') = '' then '<anon>' else string_split(regexp_extract(b, '^[A-Za-z0-9_.]*'), '.')[-1] end as handler from u"
    )


@query(_call_route_sql(), ("fx_route_lines",))
def routes_call_style(spark: SparkSession, sf: str) -> DataFrame:
    return routes.call_style_routes(view(spark, sf, "fx_route_lines"))


_VERB = "line like '%export async function {v}%' or line like '%export function {v}%' or line like '%export const {v}%'"


@query(
    "with r as (select *, case when strpos(path, '/app/') > 0 then substr(path, strpos(path, '/app/') + 5) when starts_with(path, 'app/') then substr(path, 5) end as rest from fx_app_lines), n as (select *, string_split(rest, '/')[-1] as f, string_split(regexp_extract(rest, '^(.*)/[^/]*$', 1), '/') as d from r where rest is not null),"
    " k as (select path, line_no, line, f, '/' || array_to_string(list_transform(list_filter(d, lambda s: s <> '' and s <> 'app' and not (left(s, 1) = '(' and right(s, 1) = ')') and left(s, 1) <> '@'), lambda s: case when starts_with(s, '[...') and right(s, 1) = ']' then ':' || substr(s, 5, len(s) - 5) || '*' when left(s, 1) = '[' and right(s, 1) = ']' then ':' || substr(s, 2, len(s) - 2) else s end), '/') as route from n where starts_with(f, 'page.') or starts_with(f, 'route.')),"
    " x as (" + " union all ".join(f"select path, line_no, '{v}' as method, route, '{v}' as handler from k where contains(path, '/route.') and ({_VERB.format(v=v)})" for v in routes.FILE_VERBS) + "),"
    " g as (select path, route, line_no, case " + " ".join(f"when contains(line, 'function {n}') or contains(line, 'const {n}') or contains(line, 'export default') then '{n}'" for n in routes.HANDLER_GUESSES) + " end as h from k where not contains(path, '/route.'))"
    " select path, line_no, method, route, handler from x union all select path, 1, 'GET', route, coalesce(arg_min(h, line_no) filter (where h is not null), '<module>') from g group by path, route",
    ("fx_app_lines",),
)
def routes_file_convention(spark: SparkSession, sf: str) -> DataFrame:
    return routes.file_convention_routes(view(spark, sf, "fx_app_lines")).select("path", "line_no", "method", "route", "handler")


def _event_sql(call: str) -> str:
    return f"regexp_extract(line, '{call}\\s*[''\"`]([^''\"`]*)[''\"`]', 1)"


@query(
    f"with h as (select path, {_event_sql('[.]on[(]')} as event from fx_route_lines union select path, {_event_sql('[.]addEventListener[(]')} from fx_route_lines), s as (select path, line_no, {_event_sql('[.]emit[(]')} as event from fx_route_lines)"
    " select path, line_no, event from s where event <> '' and exists (select 1 from h where h.path = s.path and h.event = s.event)",
    ("fx_route_lines",),
)
def emit_on_pairs(spark: SparkSession, sf: str) -> DataFrame:
    return routes.emit_on_edges(view(spark, sf, "fx_route_lines"))


@query("with fs as (select file_path, name, arg_min(id, seq) as id from fx_symbols group by file_path, name) select c.call_seq, c.from_id as src_id, fs.id as dst_id, c.name as raw_name, c.file_path, c.line from fx_rawcalls c join fs on fs.file_path = c.file_path and fs.name = c.name where not c.member and c.from_id <> fs.id", ("fx_rawcalls", "fx_symbols"))
def callback_dispatch(spark: SparkSession, sf: str) -> DataFrame:
    return routes.callback_edges(view(spark, sf, "fx_rawcalls"), view(spark, sf, "fx_symbols"))


@query(
    "with s as (select case when kind = 'method' and seq % 2 = 1 then 'render' else name end as name, kind, id, file_path, seq from fx_symbols), c as (select call_seq, from_id, case line % 4 when 0 then 'setState' when 1 then 'setName' when 2 then 'set' else name end as name, file_path, line from fx_rawcalls), r as (select file_path, arg_min(id, seq) as id from s where name = 'render' and kind = 'method' group by file_path)"
    " select c.call_seq, c.from_id as src_id, r.id as dst_id, c.name as raw_name, c.file_path, c.line from c join r on r.file_path = c.file_path where c.name = 'setState' or (c.name like 'set%' and len(c.name) > 3)",
    ("fx_rawcalls", "fx_symbols"),
)
def setstate_render(spark: SparkSession, sf: str) -> DataFrame:
    symbols = view(spark, sf, "fx_symbols").withColumn("name", F.when((F.col("kind") == "method") & (F.col("seq") % 2 == 1), "render").otherwise(F.col("name")))
    line = F.col("line") % 4
    calls = view(spark, sf, "fx_rawcalls").withColumn("name", F.when(line == 0, "setState").when(line == 1, "setName").when(line == 2, "set").otherwise(F.col("name")))
    return routes.setstate_edges(calls, symbols)


@query(
    "with p as (select l.path, l.line_no from fx_route_lines l), s as (select id, file_path, seq, 'src/r' || cast(seq % 50 as string) || '.js' as path, seq % 400 as a, seq % 400 + 3000 as b from fx_symbols)"
    " select p.path, p.line_no, coalesce((select arg_max(s.id, s.a * 1000000 + s.seq) from s where s.path = p.path and s.a <= p.line_no and p.line_no <= s.b), p.path || '#<module>') as id from (select distinct * from p) p",
    ("fx_route_lines", "fx_symbols"),
)
def enclosing_owner(spark: SparkSession, sf: str) -> DataFrame:
    seq = F.col("seq")
    symbols = view(spark, sf, "fx_symbols").select("id", F.concat(F.lit("src/r"), (seq % 50).cast("string"), F.lit(".js")).alias("file_path"), (seq % 400).alias("start_line"), (seq % 400 + 3000).alias("end_line"), "seq")
    return routes.enclosing_at(view(spark, sf, "fx_route_lines"), symbols)


# -- sources, freshness, scope ----------------------------------------------------------------------------------------

_LANG = r"case when regexp_matches(lower(path), '[.](ts|mts|cts)$') then 'ts' when regexp_matches(lower(path), '[.]tsx$') then 'tsx' when regexp_matches(lower(path), '[.](js|jsx|mjs|cjs)$') then 'js' when regexp_matches(lower(path), '[.]py$') then 'py' end"


@query(f"select id, path, {_LANG} as lang from fx_paths", ("fx_paths",))
def lang_classify(spark: SparkSession, sf: str) -> DataFrame:
    return view(spark, sf, "fx_paths").withColumn("lang", P.lang_of(F.col("path")))


@query(f"select id, path from fx_paths where {_LANG} is not null and not contains('/' || path || '/', '/.git/') and not contains('/' || path || '/', '/.symlattice/')", ("fx_paths",))
def tracked_files(spark: SparkSession, sf: str) -> DataFrame:
    return view(spark, sf, "fx_paths").where(P.tracked(F.col("path")))


@query(
    "select count(*) filter (where o.path is null) as added, count(*) filter (where n.path is null) as removed, count(*) filter (where o.path is not null and n.path is not null and (o.mtime_ms <> n.mtime_ms or o.size <> n.size)) as modified,"
    " count(*) filter (where o.path is null or n.path is null or o.mtime_ms <> n.mtime_ms or o.size <> n.size) > 0 as dirty from fx_files_old o full join fx_files_new n on n.path = o.path",
    ("fx_files_old", "fx_files_new"),
)
def dirty_gate(spark: SparkSession, sf: str) -> DataFrame:
    return freshness.dirty(view(spark, sf, "fx_files_old"), view(spark, sf, "fx_files_new"))


@query("select event_id, n_paths > 0 and (elapsed_ms >= 2000 or (n_paths <= 2 and elapsed_ms >= 300)) as flush from fx_batches", ("fx_batches",))
def should_flush(spark: SparkSession, sf: str) -> DataFrame:
    return view(spark, sf, "fx_batches").select("event_id", watch.should_flush(F.col("n_paths"), F.col("elapsed_ms")).alias("flush"))


@query(
    "with recursive e as materialized (select distinct cast(user_id % 40 as varchar) as root, event_type as path, epoch_us(ts) // 60000 as ms from events), s as materialized (select distinct root, ms from e),"
    " d as materialized (select s.root, s.ms, s.ms + case when count(distinct e.path) > 2 then 2000 else 300 end as due from s join e on e.root = s.root and e.ms >= s.ms and e.ms < s.ms + 300 group by s.root, s.ms),"
    " nx as materialized (select d.root, d.ms, d.due, s.ms as after from d asof left join s on s.root = d.root and d.due <= s.ms),"
    " w(root, ms) as (select root, min(ms) from s group by root union all select nx.root, nx.after from w join nx on nx.root = w.root and nx.ms = w.ms where nx.after is not null)"
    " select w.root, count(distinct e.path) as n_paths, w.ms as first_ms, nx.due as flush_ms from w join nx on nx.root = w.root and nx.ms = w.ms join e on e.root = w.root and e.ms >= w.ms and e.ms < nx.due group by w.root, w.ms, nx.due"
)
def debounce_batches(spark: SparkSession, sf: str) -> DataFrame:
    ms = F.expr("timestampdiff(MICROSECOND, timestamp_ntz'1970-01-01 00:00:00', cast(ts as timestamp_ntz)) div 60000")
    return watch.debounce_batches(table(spark, sf, "events").select((F.col("user_id") % 40).cast("string").alias("root"), F.col("event_type").alias("path"), ms.alias("ms")))


@query(
    "with pr as (select grp, min(regexp_replace(root, '/[^/]*$', '')) as lo, max(regexp_replace(root, '/[^/]*$', '')) as hi from fx_groups group by grp), ab as (select lo as root, count(*) as n, min(grp) as grp from pr where lo = hi group by lo)"
    " select r.root, case when r.root not in (select root from fx_groups) then ab.grp end as grp from fx_roots r left join ab on ab.root = r.root and ab.n = 1",
    ("fx_groups", "fx_roots"),
)
def group_infer(spark: SparkSession, sf: str) -> DataFrame:
    return scope.infer_groups(view(spark, sf, "fx_groups"), view(spark, sf, "fx_roots"))


_REPO = "(select cast(id % 7 as string) as repo, * from fx_nodes)"


@query(rf"select repo, cast(rank as bigint) as rank, id from (select repo, id, row_number() over (partition by repo order by node_seq) as rank from {_REPO} where list_contains(string_split_regex(lower(name || ' ' || qualified_name || ' ' || file_path), '[^\p{{L}}\p{{N}}]+'), 'bolt')) where rank <= 25", ("fx_nodes",))
def fan_out_search(spark: SparkSession, sf: str) -> DataFrame:
    nodes = view(spark, sf, "fx_nodes").withColumn("repo", (F.col("id") % 7).cast("string"))
    return scope.fan_out_search(nodes, "bolt").select("repo", *_long("rank"), "id")


@query(
    f"with tn as (select cast(id % 7 as string) as repo, id, case when id % 40 = 1 and id % 7 <> 3 then 'the' else name end as name, cast(id % 150 as string) as file_path from fx_nodes), tl as (select cast(cast(path as bigint) % 7 as string) as repo, path, line_no, line from fx_lines), te as (select cast(dst_id % 7 as string) as repo, dst_id, kind, resolved, cast(src_id % 200 as string) as file_path from fx_open),"
    f" sn as (select repo, count(*) as c from tn where name = 'the' group by repo), lk as (select repo, file_path as path from tn where name = 'the' union select e.repo, e.file_path from te e join tn n on n.repo = e.repo and n.id = e.dst_id where n.name = 'the' and e.kind in ('calls', 'references') and e.resolved),"
    f" tx as (select repo, count(*) as c from (select distinct repo, path from tl where {_THE} except select repo, path from lk) group by repo), ea as (select sn.c as s, tx.c as t from sn full join tx on sn.repo = tx.repo),"
    " tt as (select coalesce(max(s), 0) as same_name, coalesce(max(case when s is not null then t end), 0) as text_only, coalesce(sum(case when s is null then t end), 0)::bigint as stray from ea) select *, same_name > 6 or text_only > 12 or stray > 12 as refused from tt",
    ("fx_nodes", "fx_lines", "fx_open"),
)
def group_refusal(spark: SparkSession, sf: str) -> DataFrame:
    nodes = _thing_nodes(spark, sf).withColumn("repo", (F.col("id") % 7).cast("string"))
    nodes = nodes.withColumn("name", F.when((F.col("id") % 40 == 1) & (F.col("id") % 7 != 3), "the").otherwise(F.when(F.col("name") == "thing", F.lit("x")).otherwise(F.col("name"))))
    lines = view(spark, sf, "fx_lines").withColumn("repo", (F.col("path").cast("long") % 7).cast("string"))
    edges = _the_edges(spark, sf).withColumn("repo", (F.col("dst_id") % 7).cast("string"))
    return scope.group_refusal(nodes, lines, edges, "the")


# -- search intent and extraction -----------------------------------------------------------------------------------------



@query(
    r"""with p as (select item_id as id, regexp_extract(text, '^\s*(\S+)', 1) as w from benchmark), d as (select id, case id % 7 when 0 then w when 1 then 'export const ' || w when 2 then '^' || w || '(' when 3 then w || '|' || 'other' || cast(id as string) when 4 then 'TODO' when 5 then w || '.*' else 'a|b|c|d|' || w end as pattern from p),
    b as (select id, pattern, unnest(string_split_regex(pattern, '\\?\|')) as br, generate_subscripts(string_split_regex(pattern, '\\?\|'), 1) as pos from d),
    n as (select id, pattern, pos, regexp_replace(regexp_replace(regexp_replace(trim(br), '^(\^|\\b|\\<|\\?\()+', ''), '^(export\s+)?(default\s+)?(async\s+)?(function\*?|const|let|var|class|type|interface|enum)\s+', ''), '(\\b|\\>|\\s[*+]?|\s|\\?[()]|=)+$', '') as name from b),
    u as (select id, pattern, name, min(pos) as pos from n group by id, pattern, name)
    select id, pattern, case when bool_and(regexp_matches(name, '^[A-Za-z_][A-Za-z0-9_]*$') and upper(name) not in ('TODO', 'FIXME', 'HACK', 'XXX')) and count(*) <= 4 then string_agg(name, ',' order by pos) end as names from u group by id, pattern"""
)
def intent_symbols(spark: SparkSession, sf: str) -> DataFrame:
    word = F.regexp_extract("text", r"^\s*(\S+)", 1)
    k, number = F.col("item_id") % 7, F.col("item_id").cast("string")
    dressed = (
        F.when(k == 0, word).when(k == 1, F.concat(F.lit("export const "), word)).when(k == 2, F.concat(F.lit("^"), word, F.lit("(")))
        .when(k == 3, F.concat(word, F.lit("|other"), number)).when(k == 4, "TODO").when(k == 5, F.concat(word, F.lit(".*"))).otherwise(F.concat(F.lit("a|b|c|d|"), word))
    )
    rows = table(spark, sf, "benchmark").select(F.col("item_id").alias("id"), dressed.alias("pattern"))
    return rows.withColumn("names", F.array_join(intent.names_column(F.col("pattern")), ","))


def _sources(spark: SparkSession, sf: str, template: str, end: str) -> DataFrame:
    """One small source file for each part."""
    fill = lambda c: F.regexp_replace(c, "K", F.col("p_partkey").cast("string"))
    return table(spark, sf, "part").select(F.concat(F.lit("src/f"), F.col("p_partkey").cast("string"), F.lit(f".{end}")).alias("path"), F.lit(end).alias("language"), F.encode(fill(F.lit(template)), "UTF-8").alias("content"))


def _symbol_rows(files: DataFrame) -> DataFrame:
    from symlattice.sources.facts import extract_facts

    facts = extract_facts(files)
    return facts.select("path", F.inline("symbols"), F.size("calls").alias("n_calls"), F.size("bindings").alias("n_bindings"), F.size("heritage").alias("n_bases"))


_PY = "from .baseK import BaseK\n\nclass ThingK(BaseK):\n    def run(self):\n        return helperK()\n\ndef helperK():\n    return 1\n"
_TS = 'import { BaseK } from "./baseK";\nexport class ThingK extends BaseK {\n  run() { return helperK(); }\n}\nexport const helperK = () => 1;\n'
_EXTRACTED = "select 'src/f' || k || '.{end}' as path, 'src/f' || k || '.{end}#' || name || '@' || cast(start_line as string) as id, kind, name, qualified_name, start_line, end_line, exported, n_calls, n_bindings, n_bases from (select cast(p_partkey as string) as k from part) p, lateral (values {rows}) v(kind, name, qualified_name, start_line, end_line, exported, n_calls, n_bindings, n_bases)"


@query(_EXTRACTED.format(end="py", rows="('class', 'Thing' || k, 'Thing' || k, 3, 5, true, 1, 1, 1), ('method', 'run', 'Thing' || k || '.run', 4, 5, false, 1, 1, 1), ('function', 'helper' || k, 'helper' || k, 7, 8, true, 1, 1, 1)"))
def py_extract(spark: SparkSession, sf: str) -> DataFrame:
    return _symbol_rows(_sources(spark, sf, _PY, "py")).drop("signature")


@query(_EXTRACTED.format(end="ts", rows="('class', 'Thing' || k, 'Thing' || k, 2, 4, true, 1, 1, 1), ('method', 'run', 'Thing' || k || '.run', 3, 3, false, 1, 1, 1), ('function', 'helper' || k, 'helper' || k, 5, 5, true, 1, 1, 1)"))
def ts_extract(spark: SparkSession, sf: str) -> DataFrame:
    return _symbol_rows(_sources(spark, sf, _TS, "ts")).drop("signature")
