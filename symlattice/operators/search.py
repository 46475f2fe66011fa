"""Search: an inverted index, hashed vectors, and the fusion of their rankings."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from symlattice.functions.text import bag, document, fnv_bucket, sign

RRF_K, VECTOR_TOP, SEARCH_LIMIT, FTS_LEAST = 60, 50, 25, 25
#: Node kinds that get a vector.
VECTOR_KINDS = ("function", "class", "method")
#: Words that the full-text language takes as operators.
FTS_OPERATORS = ("AND", "OR", "NOT")


def token_index(nodes: DataFrame) -> DataFrame:
    """(token, id, node_seq): which symbols have a token in name, qualified name or path, once each."""
    text = F.concat_ws(" ", "name", "qualified_name", "file_path")
    words = F.array_distinct(F.filter(F.split(F.lower(text), r"[^\p{IsAlphabetic}\p{N}]+"), lambda t: t != ""))
    return nodes.select("id", "node_seq", F.explode(words).alias("token"))


def query_words(query: str) -> list[str]:
    """Distinct lower-cased words of a query; operators are no words."""
    clean = "".join(c if c.isalnum() else " " for c in query).split()
    return list(dict.fromkeys(w.lower() for w in clean if w not in FTS_OPERATORS))


def fts_match(index: DataFrame, query: str, limit: int) -> DataFrame:
    """(id, rank): symbols that have all words, in node order."""
    words = query_words(query)
    if not words:
        return index.select("id", F.lit(0).alias("rank")).where("false")
    hits = index.where(F.col("token").isin(*words)).groupBy("id", "node_seq").agg(F.count_distinct("token").alias("n")).where(F.col("n") == len(words))
    first = hits.orderBy("node_seq").limit(limit)
    return first.select("id", F.row_number().over(Window.orderBy("node_seq")).alias("rank"))  # at most ``limit`` rows


def like_match(nodes: DataFrame, query: str, limit: int) -> DataFrame:
    """(id, rank): symbols whose name contains the query (``%`` and ``_`` left out), ASCII case aside, in node order."""
    part = query.replace("%", "").replace("_", "")
    first = nodes.where(F.lower("name").contains(part.lower())).orderBy("node_seq").limit(limit)
    return first.select("id", F.row_number().over(Window.orderBy("node_seq")).alias("rank"))


def text_ranked(nodes: DataFrame, query: str, limit: int) -> DataFrame:
    """Full-text matches; names that contain the query where there are none."""
    found = fts_match(token_index(nodes), query, limit).withColumn("way", F.lit(0))
    instead = like_match(nodes, query, limit).withColumn("way", F.lit(1))
    both = found.unionByName(instead)
    best = both.agg(F.min("way").alias("best"))
    return both.join(F.broadcast(best), F.col("way") == F.col("best")).select("id", "rank")  # one row


def hash_vectors(nodes: DataFrame, kinds: tuple[str, ...] = VECTOR_KINDS) -> DataFrame:
    """Sparse signed counts (id, node_seq, bucket, weight) of each symbol's token bag."""
    doc = document(F.col("name"), F.col("qualified_name"), F.col("signature"), F.col("file_path"))
    some = nodes.where(F.col("kind").isin(*kinds))
    return some.select("id", "node_seq", F.explode(bag(doc)).alias("token")).groupBy("id", "node_seq", fnv_bucket(F.col("token")).alias("bucket")).agg(F.count(F.lit(1)).alias("n")).select("id", "node_seq", "bucket", (F.col("n") * sign(F.col("bucket"))).alias("weight"))


def dense_vectors(sparse: DataFrame, dim: int = 256) -> DataFrame:
    """(id, vec): normalised vectors as arrays of floats."""
    grouped = sparse.groupBy("id").agg(F.map_from_entries(F.collect_list(F.struct("bucket", "weight"))).alias("m"), F.sqrt(F.sum(F.col("weight") * F.col("weight"))).alias("norm"))  # at most 256 entries
    return grouped.select("id", F.transform(F.sequence(F.lit(0), F.lit(dim - 1)), lambda i: (F.coalesce(F.try_element_at("m", i), F.lit(0)) / F.col("norm")).cast("float")).alias("vec"))


def query_vector(spark: SparkSession, query: str) -> DataFrame:
    """(bucket, weight) of a query's bag: at most 256 rows."""
    one = spark.range(1).select(F.lit(query).alias("q"))
    return one.select(F.explode(bag(F.col("q"))).alias("token")).groupBy(fnv_bucket(F.col("token")).alias("bucket")).agg(F.count(F.lit(1)).alias("n")).select("bucket", (F.col("n") * sign(F.col("bucket"))).alias("weight"))


def cosine_topk(sparse: DataFrame, query: DataFrame, k: int = VECTOR_TOP) -> DataFrame:
    """(id, rank, score): the symbols most similar to a query's sparse vector; ties in node order, no threshold."""
    q = query.select("bucket", F.col("weight").alias("qw"))
    norm = query.agg(F.sqrt(F.sum(F.col("weight") * F.col("weight"))).alias("qn"))
    # the query has at most 256 buckets: proven small, so vectors aren't shuffled for it
    dots = sparse.join(F.broadcast(q), "bucket", "left").groupBy("id", "node_seq").agg(F.coalesce(F.sum(F.col("weight") * F.col("qw")), F.lit(0)).alias("dot"), F.sqrt(F.sum(F.col("weight") * F.col("weight"))).alias("n"))
    score = F.when((F.col("qn") > 0) & (F.col("n") > 0), F.col("dot") / (F.col("qn") * F.col("n"))).otherwise(0.0)
    top = dots.crossJoin(F.broadcast(norm)).select("id", "node_seq", score.alias("score")).orderBy(F.desc("score"), "node_seq").limit(k)
    return top.select("id", F.row_number().over(Window.orderBy(F.desc("score"), "node_seq")).alias("rank"), "score")


def array_cosine_topk(vectors: DataFrame, query: DataFrame, k: int, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """(id, rank, score) by cosine over dense arrays, against the one row of ``query``; ties by id."""
    dot = lambda a, b: F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)
    q = query.limit(1).select(F.col(vector_col).alias("q"))
    v = F.col(vector_col)
    scored = vectors.crossJoin(F.broadcast(q)).select(F.col(id_col).alias("id"), (dot(v, F.col("q")) / F.sqrt(dot(v, v)) / F.sqrt(dot(F.col("q"), F.col("q")))).alias("score"))
    top = scored.orderBy(F.desc("score"), "id").limit(k)
    return top.select("id", F.row_number().over(Window.orderBy(F.desc("score"), "id")).alias("rank"), "score")


def rrf(lists: list[DataFrame], limit: int = SEARCH_LIMIT, k: int = RRF_K) -> DataFrame:
    """(id, rank, score): reciprocal rank fusion of (id, rank) lists; ties by where an id is seen first, list by list."""
    tagged = None
    for i, ranked in enumerate(lists):
        part = ranked.select("id", "rank", F.lit(i).alias("list"))
        tagged = part if tagged is None else tagged.union(part)
    fused = tagged.groupBy("id").agg(F.sum(1.0 / (k + F.col("rank"))).alias("score"), F.min(F.struct("list", "rank")).alias("first"))
    top = fused.withColumn("score", F.round("score", 12)).orderBy(F.desc("score"), "first").limit(limit)
    return top.select("id", F.row_number().over(Window.orderBy(F.desc("score"), "first")).alias("rank"), "score")


def hybrid_search(nodes: DataFrame, query: str, limit: int = SEARCH_LIMIT, vectors: DataFrame | None = None) -> DataFrame:
    """(id, rank, score): full-text and vector rankings, fused. Without any vector the text ranking alone counts."""
    spark = nodes.sparkSession
    sparse = hash_vectors(nodes) if vectors is None else vectors
    return rrf([text_ranked(nodes, query, max(limit, FTS_LEAST)), cosine_topk(sparse, query_vector(spark, query))], limit)


def search_rows(nodes: DataFrame, ranked: DataFrame) -> DataFrame:
    """Ranked ids with their symbol, one row each: the last of nodes that repeat an id."""
    last = nodes.groupBy("id").agg(F.max_by(F.struct("name", "kind", "qualified_name", "file_path", "start_line", "exported"), "node_seq").alias("n"))
    return ranked.join(last, "id").select("rank", "id", "score", "n.*")
