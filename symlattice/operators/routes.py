"""Routes and dispatch edges read from source lines by patterns. Lines: (path, line_no, line); symbols as for resolution."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Methods of call-style routes in the order in which they are tried, and verbs a route file may export.
CALL_METHODS = ("get", "post", "put", "patch", "delete", "options", "head", "all", "use")
FILE_VERBS = ("GET", "POST", "PUT", "PATCH", "DELETE", "HEAD", "OPTIONS")
HANDLER_GUESSES = ("default", "Page", "GET", "POST")
_QUOTED = r"\s*(?:'([^']*)'|\"([^\"]*)\"|`([^`]*)`)"


def call_style_routes(lines: DataFrame) -> DataFrame:
    """(path, line_no, method, route, handler) of lines such as ``app.get("/x", handler)``, whatever the receiver.

    Of the methods, in their fixed order, the first whose first occurrence follows an identifier or a parenthesis counts. An inline
    handler, or none, is ``<anon>``.
    """
    # one small expression for all methods, looked through in their order
    text = lines.select("path", "line_no", F.ltrim(F.translate("line", "\t", " ")).alias("text"))
    places = F.transform(F.array(*[F.lit(m) for m in CALL_METHODS]), lambda m: F.struct(m.alias("method"), F.call_function("instr", F.col("text"), F.concat(F.lit("."), m, F.lit("("))).alias("at")))
    fits = lambda p: (p.at > 1) & F.substring(F.col("text"), p.at - 1, F.lit(1)).rlike(r"[A-Za-z0-9_)]")
    first = text.withColumn("first", F.get(F.filter(places, fits), F.lit(0))).where("first is not null")
    rest = F.substring(F.col("text"), F.col("first.at") + F.length("first.method") + 2, F.length("text"))
    found = first.select("path", "line_no", F.col("first.method").alias("method"), rest.alias("rest")).where(F.col("rest").rlike("^" + _QUOTED))
    parts = [F.regexp_extract("rest", "^" + _QUOTED, i) for i in (1, 2, 3)]
    after = F.ltrim(F.regexp_replace(F.ltrim(F.regexp_replace("rest", "^" + _QUOTED, "")), "^,", ""))
    name = F.regexp_extract(after, r"^([A-Za-z0-9_.]*)", 1)
    inline = after.startswith("async ") | after.startswith("function") | after.startswith("(") | (name == "")
    return found.select("path", "line_no", F.upper("method").alias("method"), F.concat(*parts).alias("route"), F.when(inline, "<anon>").otherwise(F.element_at(F.split(name, r"\."), -1)).alias("handler"))


def _under_app(path: Column) -> Column:
    """What follows ``app/`` in a path; null elsewhere."""
    p = F.translate(path, "\\", "/")
    at = F.instr(p, "/app/")
    return F.when(at > 0, F.substring(p, at + 5, F.length(p))).when(p.startswith("app/"), F.substring(p, 5, F.length(p)))


def file_route(path: Column) -> Column:
    """The route that a page or route file stands for by its place; null for other files."""
    rest = _under_app(path)
    name = F.element_at(F.split(rest, "/"), -1)
    folders = F.filter(F.split(F.regexp_extract(rest, r"^(.*)/[^/]*$", 1), "/"), lambda s: (s != "") & (s != "app") & ~s.rlike(r"^\(.*\)$") & ~s.startswith("@"))
    segment = lambda s: F.when(s.rlike(r"^\[\.\.\..*\]$"), F.concat(F.lit(":"), F.regexp_extract(s, r"^\[\.\.\.(.*)\]$", 1), F.lit("*"))).when(s.rlike(r"^\[.*\]$"), F.concat(F.lit(":"), F.regexp_extract(s, r"^\[(.*)\]$", 1))).otherwise(s)
    return F.when(name.rlike(r"^(page|route)\."), F.concat(F.lit("/"), F.array_join(F.transform(folders, segment), "/")))


def file_convention_routes(lines: DataFrame) -> DataFrame:
    """(path, line_no, method, route, handler, handler_line) of page files (GET) and of the verbs that route files export."""
    tagged = lines.withColumn("route", file_route(F.col("path"))).where("route is not null")
    is_route = F.col("path").contains("/route.")
    verbs = F.filter(F.array(*[F.when(_exports(v), F.lit(v)) for v in FILE_VERBS]), lambda v: v.isNotNull())
    exported = tagged.where(is_route).select("path", "line_no", F.explode(verbs).alias("method"), "route").select("path", "line_no", "method", "route", F.col("method").alias("handler"), F.col("line_no").alias("handler_line"))
    line = F.col("line")
    guess = F.coalesce(*[F.when(line.contains(f"function {n}") | line.contains(f"const {n}") | line.contains("export default"), F.lit(n)) for n in HANDLER_GUESSES])
    pages = tagged.where(~is_route).select("path", "route", "line_no", guess.alias("guess"))
    first = pages.groupBy("path", "route").agg(F.min(F.when(F.col("guess").isNotNull(), F.struct("line_no", "guess"))).alias("g"))
    page = first.select("path", F.lit(1).cast("long").alias("line_no"), F.lit("GET").alias("method"), "route", F.coalesce("g.guess", F.lit("<module>")).alias("handler"), F.col("g.line_no").alias("handler_line"))
    return exported.select("path", F.col("line_no").cast("long").alias("line_no"), "method", "route", "handler", F.col("handler_line").cast("long").alias("handler_line")).unionByName(page.withColumn("handler_line", F.col("handler_line").cast("long")))


def _exports(verb: str) -> Column:
    line = F.col("line")
    return line.contains(f"export async function {verb}") | line.contains(f"export function {verb}") | line.contains(f"export const {verb}")


def all_routes(lines: DataFrame) -> DataFrame:
    """Routes of both styles; (path, line_no, method, route, handler, handler_id)."""
    calls = call_style_routes(lines).withColumn("handler_line", F.col("line_no").cast("long"))
    both = calls.select("path", F.col("line_no").cast("long").alias("line_no"), "method", "route", "handler", "handler_line").unionByName(file_convention_routes(lines))
    made = F.when(F.col("handler_line").isNull(), F.concat("path", F.lit("#<module>"))).otherwise(F.concat("path", F.lit("#"), "handler", F.lit("@"), F.col("handler_line").cast("string")))
    return both.withColumn("handler_id", made).drop("handler_line")


def bind_handlers(routes: DataFrame, symbols: DataFrame) -> DataFrame:
    """Routes whose handler_id is that of the file's first symbol of the handler's name, where there is one."""
    first = symbols.groupBy(F.col("file_path").alias("path"), F.col("name").alias("handler")).agg(F.min_by("id", "seq").alias("bound"))
    return routes.join(first, ["path", "handler"], "left").withColumn("handler_id", F.coalesce("bound", "handler_id")).drop("bound")


def route_nodes(routes: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Nodes, ``handles_route`` edges and attributes (method, path) of routes."""
    node_id = F.concat("path", F.lit("#route:"), "method", F.lit(":"), "route")
    label = F.concat("method", F.lit(" "), "route")
    nodes = routes.select(node_id.alias("id"), F.lit("route").alias("kind"), F.col("route").alias("name"), label.alias("qualified_name"), F.col("path").alias("file_path"), F.col("line_no").alias("start_line"), F.col("line_no").alias("end_line"), F.lit(True).alias("exported"), label.alias("signature"))
    edges = routes.select(F.col("line_no").alias("order"), F.col("handler_id").alias("src_id"), node_id.alias("dst_id"), F.lit("handles_route").alias("kind"), F.col("route").alias("raw_name"), F.lit(True).alias("resolved"), F.lit("strong").alias("conf"), F.lit("route-plugin").alias("reason"), F.lit("ast").alias("provenance"), F.col("path").alias("file_path"), F.col("line_no").alias("line"))
    attrs = routes.select(node_id.alias("node_id"), F.explode(F.map_from_arrays(F.array(F.lit("method"), F.lit("path")), F.array("method", "route"))).alias("key", "value"))
    return nodes, edges, attrs


def _event(line: Column, call: str) -> Column:
    """The quoted event right after the first ``call`` of a line; null if there is none or it is empty."""
    at = F.instr(line, call)
    rest = F.substring(line, at + len(call), F.length(line))
    text = F.concat(*[F.regexp_extract(rest, "^" + _QUOTED, i) for i in (1, 2, 3)])
    return F.when((at > 0) & rest.rlike("^" + _QUOTED) & (text != ""), text)


def emit_on_edges(lines: DataFrame, owners: DataFrame | None = None) -> DataFrame:
    """(path, line_no, event): a line that emits an event which the same file listens to.

    With ``owners`` (path, line_no, id; see ``enclosing_at``) also src_id, the symbol around it.
    """
    line = F.col("line")
    heard = lines.select("path", F.explode(F.array(_event(line, ".on("), _event(line, ".addEventListener("))).alias("event")).where("event is not null").distinct()
    sent = lines.select("path", "line_no", _event(line, ".emit(").alias("event")).where("event is not null")
    met = sent.join(heard, ["path", "event"], "left_semi").select("path", "line_no", "event")
    if owners is None:
        return met
    own = met.join(owners, ["path", "line_no"], "left").withColumn("src_id", F.coalesce("id", F.concat("path", F.lit("#<module>")))).drop("id")
    return own


def enclosing_at(points: DataFrame, symbols: DataFrame) -> DataFrame:
    """(path, line_no, id): the symbol around a line that starts last, of equals the last; else the module."""
    spans = symbols.select(F.col("file_path").alias("path"), "id", "start_line", "end_line", "seq")
    inside = points.select("path", "line_no").distinct().join(spans, "path").where("start_line <= line_no and line_no <= end_line")
    best = inside.groupBy("path", "line_no").agg(F.max_by("id", F.struct("start_line", "seq")).alias("id"))
    return points.select("path", "line_no").distinct().join(best, ["path", "line_no"], "left").withColumn("id", F.coalesce("id", F.concat("path", F.lit("#<module>"))))


def callback_edges(calls: DataFrame, symbols: DataFrame) -> DataFrame:
    """(call_seq, src_id, dst_id, raw_name, file_path, line): plain calls of a name that the file declares, from elsewhere than its first symbol."""
    first = symbols.groupBy("file_path", "name").agg(F.min_by("id", "seq").alias("dst_id"))
    met = calls.where("not member").select("call_seq", "from_id", "name", "file_path", "line").join(first, ["file_path", "name"]).where("from_id <> dst_id")
    return met.select("call_seq", F.col("from_id").alias("src_id"), "dst_id", F.col("name").alias("raw_name"), "file_path", "line")


def setstate_edges(calls: DataFrame, symbols: DataFrame) -> DataFrame:
    """(call_seq, src_id, dst_id, raw_name, file_path, line): calls that set state, to the file's first method ``render``."""
    first = symbols.where("name = 'render' and kind = 'method'").groupBy("file_path").agg(F.min_by("id", "seq").alias("dst_id"))
    sets = (F.col("name") == "setState") | (F.col("name").startswith("set") & (F.octet_length("name") > 3))
    return calls.where(sets).select("call_seq", "from_id", "name", "file_path", "line").join(first, "file_path").select("call_seq", F.col("from_id").alias("src_id"), "dst_id", F.col("name").alias("raw_name"), "file_path", "line")


def dispatch_edges(lines: DataFrame, calls: DataFrame, symbols: DataFrame) -> DataFrame:
    """All heuristic edges in one shape: weak, kind ``dispatches``."""
    tail = lambda df, resolved, why: df.select("order", "src_id", "dst_id", F.lit("dispatches").alias("kind"), "raw_name", F.lit(resolved).alias("resolved"), F.lit("weak").alias("conf"), F.lit(why).alias("reason"), F.lit("heuristic").alias("provenance"), "file_path", "line")
    events = emit_on_edges(lines, enclosing_at(emit_on_edges(lines), symbols))
    events = events.select(F.col("line_no").cast("long").alias("order"), "src_id", F.lit(None).cast("string").alias("dst_id"), F.concat(F.lit("emit:"), "event").alias("raw_name"), F.col("path").alias("file_path"), F.col("line_no").alias("line"))
    order = lambda df: df.withColumn("order", F.col("call_seq").cast("long"))
    return tail(order(callback_edges(calls, symbols)), True, "callback-arg").unionByName(tail(events, False, "event-emit-on")).unionByName(tail(order(setstate_edges(calls, symbols)), True, "setState-render"))
