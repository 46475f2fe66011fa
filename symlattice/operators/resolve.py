"""Name resolution: cascades of joins from raw facts to edges with a confidence.

Facts: symbols (id, kind, name, qualified_name, file_path, start_line, exported, seq), calls (call_seq, from_id, name, member, line,
file_path), refs (ref_seq, from_id, name, line, file_path), heritage (seq, src_id, kind, raw_name, file_path, line), bindings
(bind_seq, file_path, local_name, source_module, imported_name, kind) and files (path).
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from symlattice.functions.paths import dirname, module_candidates, normalize, strip_dot
from symlattice.plans.scratch import scratch

EXPORT_DEPTH = 6
#: Kinds that name types alone, and what an import of a bare package may mean.
TYPE_KINDS = ("interface", "type", "enum")
PACKAGE_ENTRIES = ("src/index", "index", "dist/index", "lib/index")
EDGE = ("src_id", "dst_id", "kind", "raw_name", "resolved", "conf", "reason", "provenance", "file_path", "line")


@dataclass
class ResolveConfig:
    """Path aliases (pattern -> targets), the base of bare paths, and workspace packages (name -> folder)."""

    paths: dict[str, list[str]] = field(default_factory=dict)
    base_url: str | None = None
    packages: dict[str, str] = field(default_factory=dict)


def _in_base(path: str, base: str | None) -> str:
    base = (base or "").rstrip("/")
    return path if base in ("", ".") or path.startswith("/") else f"{base}/{path}"


def alias_rules(spark: SparkSession, cfg: ResolveConfig) -> DataFrame:
    """(prio, star, prefix, target): a row for each alias target, the longest pattern first. As many as the project's configuration has."""
    rows, prio = [], 0
    for pattern in sorted(cfg.paths, key=lambda p: -len(p)):
        star = pattern.endswith("/*")
        for target in cfg.paths[pattern]:
            if star:
                target = target[:-2] if target.endswith("/*") else target[:-1] if target.endswith("*") else target
            while target.startswith("./"):
                target = target[2:]
            rows.append((prio, star, pattern[:-1] if star else pattern, _in_base(target.rstrip("/"), cfg.base_url)))
            prio += 1
    return spark.createDataFrame(rows, "prio int, star boolean, prefix string, target string")


def resolve_modules(requests: DataFrame, files: DataFrame, cfg: ResolveConfig | None = None) -> DataFrame:
    """(file_path, source_module, target) of distinct requests (file_path, source_module); target null: not in the tree.

    Tried in order: relative path, aliases, base folder, workspace package; each with its extensions and index files. All
    candidates are exploded with their order and joined to the files at once; the first that exists wins.
    """
    spark, cfg = requests.sparkSession, cfg or ResolveConfig()
    spec, asked = F.col("source_module"), requests.select("file_path", "source_module").distinct()
    near = asked.where(spec.startswith(".") | spec.startswith("/"))
    bare = asked.where(~(spec.startswith(".") | spec.startswith("/")))
    folder = dirname(F.col("file_path"))
    paths = [near.select("file_path", "source_module", F.lit(0).alias("way"), normalize(F.when(folder == "", strip_dot(spec)).otherwise(F.concat(folder, F.lit("/"), spec))).alias("path"))]
    if cfg.paths:
        # a row for each alias of the configuration: proven small
        met = bare.join(F.broadcast(alias_rules(spark, cfg)), F.when(F.col("star"), spec.startswith(F.col("prefix"))).otherwise((spec == F.col("prefix")) | spec.startswith(F.concat("prefix", F.lit("/")))))
        rest = F.substring(spec, F.length("prefix") + F.when(F.col("star"), 1).otherwise(2), F.length(spec))
        joined = F.when(rest == "", F.col("target")).when(F.col("target") == "", rest).otherwise(F.concat("target", F.lit("/"), rest))
        paths.append(met.select("file_path", "source_module", (F.col("prio") + 1).alias("way"), joined.alias("path")))
    if cfg.base_url is not None:
        base = cfg.base_url.rstrip("/")
        paths.append(bare.select("file_path", "source_module", F.lit(1 << 20).alias("way"), (spec if base in ("", ".") else F.concat(F.lit(f"{base}/"), spec)).alias("path")))
    if cfg.packages:
        scoped = F.regexp_extract(spec, r"^(@[^/]*/[^/]*|[^@/][^/]*)(?:/(.*))?$", 1), F.regexp_extract(spec, r"^(@[^/]*/[^/]*|[^@/][^/]*)(?:/(.*))?$", 2)
        known = spark.createDataFrame(list(cfg.packages.items()), "package string, dir string")
        inside = bare.withColumn("package", scoped[0]).withColumn("sub", scoped[1]).join(F.broadcast(known), "package")  # a row for each workspace package
        tails = F.when(F.col("sub") == "", F.array(*map(F.lit, PACKAGE_ENTRIES))).otherwise(F.array("sub"))
        spread = inside.select("file_path", "source_module", "dir", F.posexplode(tails).alias("i", "tail"))
        paths.append(spread.select("file_path", "source_module", ((1 << 21) + F.col("i")).alias("way"), F.when(F.col("dir") == ".", F.col("tail")).otherwise(F.concat("dir", F.lit("/"), "tail")).alias("path")))
    every = paths[0]
    for p in paths[1:]:
        every = every.unionByName(p)
    tried = every.select("file_path", "source_module", "way", F.posexplode(module_candidates(F.col("path"))).alias("nth", "path"))
    hit = tried.join(files.select("path").distinct(), "path").groupBy("file_path", "source_module").agg(F.min_by("path", F.struct("way", "nth")).alias("target"))
    return asked.join(hit, ["file_path", "source_module"], "left")


def _first(df: DataFrame, by: list[str], value: str, order: str = "seq") -> DataFrame:
    return df.groupBy(*by).agg(F.min_by(value, order).alias(value), F.count(F.lit(1)).alias("n"))


def in_file(symbols: DataFrame) -> DataFrame:
    """(file_path, name, id, id_seq): what a file offers under each name, the first symbol of it; and under ``default``.

    ``default`` is the file's only exported function or class, else a symbol of that very name.
    """
    named = symbols.groupBy("file_path", "name").agg(F.min(F.struct("seq", "id")).alias("s")).select("file_path", "name", F.col("s.id").alias("id"))
    sole = symbols.where("exported and kind in ('function', 'class')").groupBy("file_path").agg(F.count(F.lit(1)).alias("n"), F.min("id").alias("sole")).where("n = 1").select("file_path", "sole")
    other = named.where("name <> 'default'")
    literal = named.where("name = 'default'").select("file_path", F.col("id").alias("literal"))
    default = sole.join(literal, "file_path", "full").select("file_path", F.lit("default").alias("name"), F.coalesce("sole", "literal").alias("id"))
    return other.unionByName(default)


def resolve_exports(requests: DataFrame, symbols: DataFrame, bindings: DataFrame, modules: DataFrame, max_depth: int = EXPORT_DEPTH) -> DataFrame:
    """(file, want, id) of the distinct requests (file, want) that lead to a symbol, through up to ``max_depth`` re-exports.

    Level by level: requests that a file answers itself are done, the rest goes on along named re-exports, then
    imports handed on, then star re-exports. A path's steps (rule, binding) are kept as an array, and the least array wins, which is
    the order of a depth-first search: an answer at a step comes before all that follows below or behind it.
    """
    offer = in_file(symbols).select(F.col("file_path").alias("at"), F.col("name").alias("name"), "id")
    to = bindings.join(modules, ["file_path", "source_module"]).where("target is not null")
    rule = F.when(F.col("kind") == "named-reexport", 1).when(F.col("kind").isin("named", "default"), 2).when(F.col("kind") == "star-reexport", 3)
    steps = to.select(F.col("file_path").alias("at"), rule.alias("rule"), "bind_seq", "local_name", "imported_name", "target").where("rule is not null")
    frontier = requests.select("file", "want").distinct().select("file", "want", F.col("file").alias("at"), F.col("want").alias("name"), F.array().cast("array<bigint>").alias("way"))
    found = None
    for depth in range(max_depth + 1):
        joined = scratch(frontier.join(offer, ["at", "name"], "left"))
        done = joined.where("id is not null").select("file", "want", "way", "id")
        found = done if found is None else found.union(done)
        if depth == max_depth:
            break
        open_ = joined.where("id is null").drop("id")
        if not open_.limit(1).count():
            break
        fits = F.when(F.col("rule") == 1, (F.col("local_name") == F.col("name")) | (F.col("imported_name") == F.col("name"))).when(F.col("rule") == 2, F.col("local_name") == F.col("name")).otherwise(True)
        ahead = open_.join(steps, "at").where(fits)
        frontier = ahead.select("file", "want", F.col("target").alias("at"), F.when(F.col("rule") == 3, F.col("name")).otherwise(F.col("imported_name")).alias("name"), F.concat("way", F.array(F.col("rule").cast("bigint"), F.col("bind_seq").cast("bigint"))).alias("way"))
        # of the ways to one place for one request only the first can win
        frontier = frontier.groupBy("file", "want", "at", "name").agg(F.min("way").alias("way"))
    return found.groupBy("file", "want").agg(F.min_by("id", "way").alias("id"))


def last_bindings(bindings: DataFrame) -> DataFrame:
    """(file_path, local_name, source_module, imported_name): of the bindings of a name in a file the last counts."""
    last = bindings.groupBy("file_path", "local_name").agg(F.max_by(F.struct("source_module", "imported_name"), "bind_seq").alias("b"))
    return last.select("file_path", "local_name", "b.source_module", "b.imported_name")


def imported(bindings: DataFrame, symbols: DataFrame, modules: DataFrame) -> DataFrame:
    """(file_path, local_name, in_tree, relative, import_id): where each bound name leads."""
    bound = last_bindings(bindings).join(modules, ["file_path", "source_module"], "left")
    asked = bound.where("target is not null").select(F.col("target").alias("file"), F.col("imported_name").alias("want"))
    answers = resolve_exports(asked, symbols, bindings, modules).select(F.col("file").alias("target"), F.col("want").alias("imported_name"), F.col("id").alias("import_id"))
    joined = bound.join(answers, ["target", "imported_name"], "left")
    return joined.select("file_path", "local_name", F.col("target").isNotNull().alias("in_tree"), F.col("source_module").startswith(".").alias("relative"), "import_id")


def contains_edges(symbols: DataFrame) -> DataFrame:
    """Class to method, by the first class of the qualified name's first part in the same file."""
    methods = symbols.where("kind = 'method' and qualified_name like '%.%'").withColumn("class_name", F.substring_index("qualified_name", ".", 1))
    classes = symbols.where("kind = 'class'").groupBy("file_path", F.col("name").alias("class_name")).agg(F.min_by("id", "seq").alias("class_id"))
    met = methods.join(classes, ["file_path", "class_name"])
    return met.select(F.col("seq").alias("order"), *_edge("class_id", "id", "contains", F.col("name"), F.lit(True), "strong", "same-file", F.col("start_line")))


def _edge(src, dst, kind, raw: Column, resolved: Column, conf, reason, line: Column, provenance: str = "ast") -> list[Column]:
    as_col = lambda x: F.col(x) if isinstance(x, str) and x in ("class_id", "id", "from_id", "src_id", "dst_id", "conf", "reason", "kind", "target_id") else F.lit(x) if isinstance(x, str) else x
    return [as_col(src).alias("src_id"), as_col(dst).alias("dst_id"), as_col(kind).alias("kind"), raw.alias("raw_name"), resolved.alias("resolved"), as_col(conf).alias("conf"), as_col(reason).alias("reason"), F.lit(provenance).alias("provenance"), F.col("file_path"), line.alias("line")]


def resolve_calls(calls: DataFrame, symbols: DataFrame, bindings: DataFrame, modules: DataFrame) -> DataFrame:
    """A call edge for each call, by the first rule that applies.

    A plain call of a bound name: the import's symbol, or external if a bare module isn't in the tree. Then the only symbol of the name in the
    file that is neither method nor type (for member calls, too). Then, for member calls, an unknown receiver, bound if the name is
    unique; for plain ones the only symbol of the name anywhere. Else unresolved.
    """
    values = symbols.where(~F.col("kind").isin(*TYPE_KINDS))
    here = _first(values.where("kind <> 'method'"), ["file_path", "name"], "id").where("n = 1").select("file_path", "name", F.col("id").alias("here_id"))
    anywhere = _first(values, ["name"], "id").where("n = 1").select("name", F.col("id").alias("only_id"))
    bound = imported(bindings, symbols, modules).withColumnRenamed("local_name", "name").withColumn("bound", F.lit(True))
    j = calls.join(bound, ["file_path", "name"], "left").join(here, ["file_path", "name"], "left").join(anywhere, "name", "left")
    plain = ~F.col("member") & F.col("bound").isNotNull()
    ladder = [
        (plain & F.col("import_id").isNotNull(), F.col("import_id"), "strong", "import-binding"),
        (plain & ~F.col("in_tree") & ~F.col("relative"), F.lit(None), "strong", "external-import"),
        (F.col("here_id").isNotNull(), F.col("here_id"), "strong", "same-file"),
        (F.col("member"), F.col("only_id"), "weak", "receiver-unknown"),
        (F.col("only_id").isNotNull(), F.col("only_id"), "weak", "unique-global"),
        (F.lit(True), F.lit(None), "weak", "unresolved"),
    ]
    picked = _ladder(ladder)
    j = j.withColumn("pick", picked)
    return j.select(F.col("call_seq").alias("order"), *_edge("from_id", F.col("pick.target"), "calls", F.col("name"), F.col("pick.target").isNotNull(), F.col("pick.conf"), F.col("pick.reason"), F.col("line")))


def _ladder(rules: list[tuple]) -> Column:
    out = None
    for condition, target, conf, reason in rules:
        value = F.struct(target.alias("target"), F.lit(conf).alias("conf"), F.lit(reason).alias("reason"))
        out = F.when(condition, value) if out is None else out.when(condition, value)
    return out


def resolve_heritage(heritage: DataFrame, symbols: DataFrame, bindings: DataFrame, modules: DataFrame) -> DataFrame:
    """Edges to base classes and interfaces: import (the name as it stands, then its last part), external, unique (weak), the file's first (strong), unresolved."""
    bound = imported(bindings, symbols, modules)
    by = lambda tag, key: bound.select("file_path", F.col("local_name").alias(key), F.lit(True).alias(f"{tag}_bound"), F.col("in_tree").alias(f"{tag}_tree"), F.col("relative").alias(f"{tag}_rel"), F.col("import_id").alias(f"{tag}_id"))
    anywhere = _first(symbols, ["name"], "id").where("n = 1").select(F.col("name").alias("last_name"), F.col("id").alias("only_id"))
    here = _first(symbols, ["file_path", "name"], "id").select("file_path", F.col("name").alias("last_name"), F.col("id").alias("here_id"))
    j = heritage.withColumn("last_name", F.element_at(F.split("raw_name", r"\."), -1))
    j = j.join(by("raw", "raw_name"), ["file_path", "raw_name"], "left").join(by("last", "last_name"), ["file_path", "last_name"], "left").join(anywhere, "last_name", "left").join(here, ["file_path", "last_name"], "left")
    outside = lambda t: F.col(f"{t}_bound").isNotNull() & ~F.col(f"{t}_tree") & ~F.col(f"{t}_rel")
    picked = _ladder(
        [
            (F.col("raw_id").isNotNull(), F.col("raw_id"), "strong", "import-binding"),
            (F.col("raw_bound").isNull() & F.col("last_id").isNotNull(), F.col("last_id"), "strong", "import-binding"),
            (outside("raw") | (F.col("raw_bound").isNull() & outside("last")), F.lit(None), "strong", "external-import"),
            (F.col("only_id").isNotNull(), F.col("only_id"), "weak", "unique-global"),
            (F.col("here_id").isNotNull(), F.col("here_id"), "strong", "same-file"),
            (F.lit(True), F.lit(None), "weak", "unresolved"),
        ]
    )
    j = j.withColumn("pick", picked)
    return j.select(F.col("seq").alias("order"), *_edge("src_id", F.col("pick.target"), "kind", F.col("raw_name"), F.col("pick.target").isNotNull(), F.col("pick.conf"), F.col("pick.reason"), F.col("line")))


def resolve_refs(refs: DataFrame, symbols: DataFrame, bindings: DataFrame, modules: DataFrame) -> DataFrame:
    """Strong edges to what a name refers to by import or in the same file (its first symbol that is no method); none otherwise.

    A symbol's use of itself is left out; of the same user, target and line one edge stays.
    """
    bound = imported(bindings, symbols, modules).withColumnRenamed("local_name", "name").select("file_path", "name", "import_id")
    here = _first(symbols.where("kind <> 'method'"), ["file_path", "name"], "id").select("file_path", "name", F.col("id").alias("here_id"))
    j = refs.join(bound, ["file_path", "name"], "left").join(here, ["file_path", "name"], "left")
    j = j.withColumn("target_id", F.coalesce("import_id", "here_id")).withColumn("reason", F.when(F.col("import_id").isNotNull(), "import-binding").otherwise("same-file"))
    j = j.where("target_id is not null and target_id <> from_id")
    first = j.groupBy("from_id", "target_id", "line").agg(F.min_by(F.struct("name", "reason", "file_path", "ref_seq"), "ref_seq").alias("r")).select("from_id", "target_id", "line", "r.*")
    return first.select(F.col("ref_seq").alias("order"), *_edge("from_id", "target_id", "references", F.col("name"), F.lit(True), "strong", "reason", F.col("line")))


def all_edges(sections: list[DataFrame]) -> DataFrame:
    """Edge sections, one after the other, with edge_id: their order within the graph."""
    from symlattice.plans.prefix import ordered_cumsum

    every = None
    for i, part in enumerate(sections):
        tagged = part.select(F.lit(i).alias("section"), F.col("order").cast("long").alias("order"), *EDGE)
        every = tagged if every is None else every.unionByName(tagged)
    counted = ordered_cumsum(every.withColumn("one", F.lit(1)), ["section", "order", "src_id", "raw_name", "line"], "one", "edge_id")
    return counted.select("edge_id", *EDGE)
