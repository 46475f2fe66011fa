"""Graph-shaped views of the star-schema tables, in SQL that Spark and DuckDB both read.

The registry's queries and their SQL counterparts start from the same views. ``LINES`` is the one view whose text differs.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "embeddings", "pages", "benchmark")

#: name -> (tables and views that it reads, SQL)
VIEWS: dict[str, tuple[tuple[str, ...], str]] = {
    "fx_nodes": (
        ("part",),
        """select p_partkey as id,
          case when p_partkey % 10 = 0 then 'class' when p_partkey % 10 in (1, 2, 3) then 'method' when p_partkey % 10 = 4 then 'const' when p_partkey % 10 = 5 then 'type' else 'function' end as kind,
          case when p_partkey % 5 <> 0 then p_name else 'u' || cast(p_partkey as string) end as name,
          case when p_partkey % 10 in (1, 2, 3) then replace(p_brand, '#', '') || '.' else '' end || case when p_partkey % 5 <> 0 then p_name else 'u' || cast(p_partkey as string) end as qualified_name,
          'src/' || p_type || '/' || replace(p_brand, '#', '') || '.ts' as file_path,
          p_partkey % 1000 + 1 as start_line, p_partkey % 1000 + 1 + p_size as end_line, p_size % 2 = 0 as exported,
          case when p_partkey % 5 <> 0 then p_name else 'u' || cast(p_partkey as string) end || '(' || p_type || ')' as signature, p_partkey as node_seq
        from part""",
    ),
    "fx_chain": (
        ("lineitem",),
        """select l_orderkey * 101 + row_number() over (partition by l_orderkey order by l_linenumber, l_partkey, l_suppkey, l_extendedprice) as edge_id, l_partkey as src_id,
          lead(l_partkey - (l_partkey - 1) % 4) over (partition by l_orderkey order by l_linenumber, l_partkey, l_suppkey, l_extendedprice) as dst_id,
          l_quantity, l_tax, cast(l_linenumber as bigint) as line, case when l_returnflag = 'R' then 'weak' else 'strong' end as conf,
          case when l_linestatus = 'O' then 'same-file' else 'import-binding' end as reason
        from lineitem""",
    ),
    "fx_calls": (
        ("fx_chain", "fx_nodes"),
        """select c.edge_id, c.src_id, c.dst_id, 'calls' as kind, t.name as raw_name, true as resolved, c.conf, c.reason, s.file_path, c.line
        from fx_chain c join fx_nodes s on s.id = c.src_id join fx_nodes t on t.id = c.dst_id""",
    ),
    "fx_open": (
        ("fx_chain", "fx_nodes"),
        """select c.edge_id, c.src_id, case when c.l_tax < 0.07 then c.dst_id end as dst_id,
          case c.edge_id % 8 when 0 then 'references' when 1 then 'extends' when 2 then 'implements' when 3 then 'handles_route' when 4 then 'step_in' when 5 then 'member_of' else 'calls' end as kind,
          case when c.l_tax < 0.07 or c.edge_id % 3 = 0 then t.name else 'gone' end as raw_name, c.l_tax < 0.07 as resolved, c.conf,
          case when c.l_tax < 0.07 then c.reason else 'unresolved' end as reason, s.file_path, c.line
        from fx_chain c join fx_nodes s on s.id = c.src_id join fx_nodes t on t.id = c.dst_id""",
    ),
    "fx_seed": (("fx_calls",), "select dst_id as id, cast(1 as bigint) as seed_seq from fx_calls group by dst_id order by count(*) desc, dst_id limit 1"),
    "fx_seeds": (("fx_calls",), "select distinct dst_id as id, dst_id as seed_seq from fx_calls where dst_id % 97 = 5"),
    "fx_symbols": (("fx_nodes",), "select cast(id as string) as id, kind, name, qualified_name, file_path, start_line, end_line, exported, signature, node_seq as seq from fx_nodes"),
    "fx_rawcalls": (("fx_calls",), "select edge_id as call_seq, cast(src_id as string) as from_id, raw_name as name, line % 3 = 0 as member, line, file_path, dst_id from fx_calls"),
    "fx_bindings": (
        ("fx_rawcalls", "fx_nodes"),
        """select row_number() over (partition by b.file_path order by b.name) as bind_seq, b.file_path, b.name as local_name,
          case when b.dst % 32 = 1 then '../../' || replace(n.file_path, '.ts', '') else 'ext-lib' end as source_module, b.name as imported_name, 'named' as kind
        from (select file_path, name, min(dst_id) as dst from fx_rawcalls group by file_path, name) b join fx_nodes n on n.id = b.dst where b.dst % 16 = 1""",
    ),
    "fx_files": (("fx_nodes",), "select distinct file_path as path from fx_nodes"),
    "fx_heritage": (("fx_open",), "select edge_id as seq, cast(src_id as string) as src_id, kind, case when edge_id % 2 = 0 then 'ns.' || raw_name else raw_name end as raw_name, file_path, line from fx_open where kind in ('extends', 'implements')"),
    "fx_refs": (("fx_open",), "select edge_id as ref_seq, cast(src_id as string) as from_id, raw_name as name, line, file_path from fx_open where kind = 'references'"),
    "fx_barrels": (
        ("fx_files",),
        """select row_number() over (order by path) as bind_seq, 'src/all' || cast(n % 5 as string) || '.ts' as file_path, '*' as local_name, './' || replace(substr(path, 5), '.ts', '') as source_module, '*' as imported_name, 'star-reexport' as kind
        from (select path, row_number() over (order by path) as n from fx_files) f""",
    ),
    "fx_diff": (
        ("orders", "fx_nodes"),
        """select o_orderkey * 2 as ord, '+++ b/' || n.file_path as line from orders o join fx_nodes n on n.id = o_orderkey % 150 + 1
        union all select o_orderkey * 2 + 1, '@@ -1 +' || cast(o_orderkey % 1000 + 1 as string) || case when o_custkey % 5 = 1 then '' else ',' || cast(o_custkey % 5 as string) end || ' @@' from orders""",
    ),
    "fx_files_old": (("part",), "select cast(p_partkey as string) as path, cast(p_retailprice * 100 as bigint) as mtime_ms, cast(p_size as bigint) as size from part"),
    "fx_files_new": (("part",), "select cast(case when p_partkey % 101 = 0 then p_partkey + 1000000 else p_partkey end as string) as path, cast(p_retailprice * 100 as bigint) + case when p_partkey % 97 = 0 then 1 else 0 end as mtime_ms, cast(p_size as bigint) as size from part where p_partkey % 89 <> 0"),
    "fx_banners": (
        ("customer", "nation"),
        """select n_regionkey as grp, n_nationkey as member, case count(*) % 4 when 0 then 'fresh' when 1 then 'stale' when 2 then 'rebuilding' else 'missing' end as trust,
          case when count(*) % 3 = 0 then 'sampled' else 'exhaustive' end as coverage, case when avg(c_acctbal) < 4500 then 'partial' else 'ok' end as resolve,
          count(*) as files, count(*) * 3 as nodes, count(*) * 7 as edges
        from nation left join customer on c_nationkey = n_nationkey group by n_regionkey, n_nationkey""",
    ),
    "fx_groups": (("supplier", "nation"), "select n_name as grp, '/ws/' || cast(s_nationkey % 20 as string) || '/' || s_name as root from supplier join nation on n_nationkey = s_nationkey"),
    "fx_roots": (("fx_groups",), "select distinct root from fx_groups union select distinct regexp_replace(root, '/[^/]*$', '') from fx_groups union select '/elsewhere'"),
    "fx_route_lines": (
        ("events",),
        """select 'src/r' || cast(user_id % 50 as string) || case when user_id % 3 = 0 then '.ts' else '.js' end as path, event_id as line_no,
          case event_id % 9 when 0 then '  app.get(''/a/' || cast(user_id as string) || ''', list)' when 1 then 'router.post("/b", async (req) => {})' when 2 then 'x.use(`/c`, auth.check)' when 3 then 'cache.get(key)'
          when 4 then 'bus.on(''' || event_type || ''', fn)' when 5 then 'bus.emit("' || event_type || '")' when 6 then 'el.addEventListener("click", f)' when 7 then 'call().delete("/d")' else 'a.all("/e", ) // b.get(''/f'', g)' end as line
        from events""",
    ),
    "fx_app_lines": (
        ("events",),
        """select case event_id % 4 when 0 then 'app/' when 1 then 'src/app/(site)/' when 2 then 'web/app/@side/' else 'lib/' end || 'u' || cast(user_id % 30 as string) || case user_id % 3 when 0 then '/[id]' when 1 then '/[...rest]' else '' end || case event_id % 3 when 0 then '/page.tsx' when 1 then '/route.ts' else '/view.tsx' end as path,
          event_id as line_no, case event_id % 5 when 0 then 'export async function GET(req) {' when 1 then 'export default function Page() {' when 2 then 'export const POST = handler' when 3 then 'const Page = 1' else 'let x = 2' end as line
        from events""",
    ),
    "fx_paths": (("pages", "part"), "select page_id as id, url as path from pages union all select p_partkey + 1000000, 'src/' || p_name || case p_partkey % 9 when 0 then '.ts' when 1 then '.TSX' when 2 then '.mjs' when 3 then '.py' when 4 then '.d.mts' when 5 then '.rs' when 6 then '/.git/x.ts' when 7 then '.jsx' else '' end from part"),
    "fx_batches": (("events",), "select event_id, user_id % 6 as n_paths, event_id % 2500 as elapsed_ms from events"),
}

LINES = {
    "spark": "select cast(doc_id as string) as path, cast(at + 1 as bigint) as line_no, line from (select doc_id, posexplode(split(text, '\\n')) as (at, line) from documents) t",
    "duckdb": "select cast(doc_id as varchar) as path, i as line_no, l[i] as line from (select doc_id, string_split(text, chr(10)) as l from documents) d, unnest(range(1, len(l) + 1)) t(i)",
}


def _order(names: list[str]) -> list[str]:
    out: list[str] = []

    def add(name: str) -> None:
        if name in VIEWS and name not in out:
            for need in VIEWS[name][0]:
                add(need)
            out.append(name)

    for n in names:
        add(n)
    return out


def view(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A view as a DataFrame. It reads only the tables that it needs; names are inlined, so nothing is registered in the session."""
    if name == "fx_lines":
        text, needs = LINES["spark"], ["documents"]
    else:
        needs, text = [t for v in _order([name]) for t in VIEWS[v][0] if t in TABLES], f"select * from {name}"
    plain = lambda sql: sql.replace("{", "{{").replace("}", "}}")  # noqa: E731  braces are no fields
    with_ = [f"{v} as ({plain(VIEWS[v][1])})" for v in _order([name])]
    tables = {t: spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in dict.fromkeys(needs)}
    for t in tables:
        with_.insert(0, f"{t} as (select * from {{{t}}})")
    body = ("with " + ", ".join(with_) + " " if with_ else "") + text
    return spark.sql(body, **tables)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def duck(names: list[str], body: str, recursive: bool = False) -> str:
    """DuckDB SQL with the views that ``body`` needs in front."""
    with_ = [f"{v} as ({VIEWS[v][1]})" for v in _order(names)]
    if "fx_lines" in names:
        with_.append(f"fx_lines as ({LINES['duckdb']})")
    head = "with " + ("recursive " if recursive else "")
    body = body.strip()
    if body.startswith("with "):
        return head + ", ".join(with_) + (", " if with_ else "") + body[5:]
    return (head + ", ".join(with_) + " " if with_ else "") + body
