"""The registered queries over the driver's tables, and the same as DuckDB SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from papyrine.functions import labels as B
from papyrine.functions import text as X
from papyrine.functions import vectors as V
from papyrine.operators import changes, hybrid, lexical, semantic, store
from papyrine.plans.query import candidate_limit, parse_query
from papyrine.schema import LENGTHS, POSTINGS
from papyrine.session import shared_folder, small_batches
from papyrine.sources.library import SQL, load
from papyrine.sources.parsers import html_text, json_depths
from papyrine.streaming import events as E

Tables = dict[str, DataFrame]
QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}

#: DuckDB's tokens; on the tables' texts accents are the only marks.
TOKENS = "list_transform(regexp_extract_all(lower({c}), '[\\p{{L}}\\p{{N}}]+'), lambda x: strip_accents(x))"
TOK = f"SELECT document_id, {TOKENS.format(c='title')} AS tt, {TOKENS.format(c='body')} AS bt FROM docs"
META = "SELECT d.document_id, d.source_path_display, d.title, f.file_name, f.extension, f.file_type, f.size_bytes, f.modified_at, f.created_at, f.accessed_at FROM docs d LEFT JOIN files f ON d.source_path_display = f.path_display"
ASCII = "translate({c}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
LIMIT = 100


def with_tables(sql: str, **more: str) -> str:
    """SQL with the model's tables as common table expressions."""
    own = dict(SQL) | more
    return "WITH " + ", ".join(f"{n} AS ({s})" for n, s in own.items()) + " " + sql


def register(name: str, sql: str | None = None, **more: str):
    def keep(f: Callable[[Tables], DataFrame]):
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            spark.conf.set("spark.sql.session.timeZone", "UTC")
            small_batches(spark)
            return f(load(spark, sf_dir) | {"spark": spark, "dir": sf_dir})

        QUERIES[name] = run
        if sql is not None:
            ORACLES[name] = with_tables(sql, **more)
        return f

    return keep


def hits_sql(tokens: str, phrase: list[str]) -> str:
    if len(phrase) == 1:
        return f"len(list_filter({tokens}, lambda x: x = '{phrase[0]}'))"
    wanted = "[" + ", ".join(f"'{w}'" for w in phrase) + "]"
    return f"len(list_filter(range(1, len({tokens}) + 1), lambda i: {tokens}[i:i + {len(phrase) - 1}] = {wanted}))"


def bm25_sql(phrases: list[list[str]]) -> dict[str, str]:
    """Common table expressions that end in ``scored`` (document_id, relevance)."""
    hits = ", ".join(f"5.0 * {hits_sql('tt', p)} + 1.0 * {hits_sql('bt', p)} AS h{i}" for i, p in enumerate(phrases))
    stats = ", ".join(f"count(*) FILTER (h{i} > 0) AS df{i}" for i in range(len(phrases)))
    score = " + ".join(f"(CASE WHEN ln((n - df{i} + 0.5) / (df{i} + 0.5)) > 0 THEN ln((n - df{i} + 0.5) / (df{i} + 0.5)) ELSE 1e-6 END) * h{i} * 2.2 / (h{i} + 1.2 * (0.25 + 0.75 * dl / avgdl))" for i in range(len(phrases)))
    held = " AND ".join(f"h{i} > 0" for i in range(len(phrases)))
    return {"tok": TOK, "hit": f"SELECT document_id, len(tt) + len(bt) AS dl, {hits} FROM tok", "st": f"SELECT count(*) AS n, avg(dl) AS avgdl, {stats} FROM hit", "scored": f"SELECT document_id, round({score}, 6) AS relevance FROM hit, st WHERE {held}"}


def filter_sql(where: str) -> str:
    return f"SELECT document_id FROM ({META}) WHERE {where}"


_INDEXES: dict[tuple[str, str], lexical.Index] = {}


def _stored(spark: SparkSession, what: str, df: DataFrame, schema: T.StructType) -> DataFrame:
    """Rows written once to the shared folder and read from there."""
    folder = shared_folder(spark, what)
    df.write.options(**lexical.PLAIN).parquet(folder)
    return spark.read.schema(schema).parquet(folder)


def kept_index(t: Tables) -> lexical.Index:
    """The full-text index of a data set, built and stored by the first query that needs it and kept for the
    session, as a Library keeps its own with its tables."""
    spark, docs = t["spark"], t["docs"]
    key = (spark.sparkContext.applicationId, t["dir"])
    if key not in _INDEXES:
        postings = _stored(spark, "postings", lexical.index_postings(docs, 0), POSTINGS)
        lengths = _stored(spark, "lengths", lexical.lengths_of_postings(docs, postings, 0), LENGTHS)
        _INDEXES[key] = lexical.Index(postings, lengths, **lexical.corpus_size(lengths))
    return _INDEXES[key]


# -- filters

def _filter(name: str, query: str, where: str) -> None:
    from papyrine.plans.filters import apply_filters, with_metadata

    register(name, filter_sql(where))(lambda t: apply_filters(with_metadata(t["docs"].drop("body"), t["files"]), parse_query(query)).select("document_id"))


_filter("filter_filename", "filename:DOC-EN-1", f"contains({ASCII.format(c='coalesce(file_name, source_path_display)')}, 'doc-en-1')")
_filter("filter_path", "path:/src1/", f"contains({ASCII.format(c='source_path_display')}, '/src1/')")
_filter("filter_ext", "ext:.MD", "extension = 'md'")
_filter("filter_type", "type:text/plain", "file_type = 'text/plain'")
_filter("filter_date_eq", "modified:2024-02-01", "modified_at >= 1706745600000 AND modified_at < 1706832000000")
_filter("filter_date_range", "created:>=2024-03-01 created:<=2024-04-30 accessed>=2024-01-01", "created_at >= 1709251200000 AND created_at < 1714521600000 AND accessed_at >= 1704067200000")
_filter("filter_all", "filename:doc ext:txt date>=2024-01-10", f"contains({ASCII.format(c='coalesce(file_name, source_path_display)')}, 'doc') AND extension = 'txt' AND modified_at >= 1704844800000")


@register("filter_only_search", f"SELECT *, CAST(NULL AS DOUBLE) AS relevance FROM ({META}) WHERE extension = 'md' ORDER BY document_id LIMIT {LIMIT}")
def _(t):
    return lexical.search(t["docs"], t["files"], "ext:md", LIMIT)


@register("left_join_metadata", f"SELECT document_id, file_name, size_bytes, accessed_at FROM ({META})")
def _(t):
    from papyrine.plans.filters import with_metadata

    return with_metadata(t["docs"].drop("body"), t["files"]).select("document_id", "file_name", "size_bytes", "accessed_at")


# -- full text

@register("tokenize_counts", "SELECT document_id, len(tt) AS title_tokens, len(bt) AS body_tokens, len(list_distinct(bt)) AS body_terms FROM tok", tok=TOK)
def _(t):
    k = lexical.tokenized(t["docs"])
    return k.select("document_id", F.size("title_tokens").alias("title_tokens"), F.size("body_tokens").alias("body_tokens"), F.size(F.array_distinct("body_tokens")).alias("body_terms"))


@register("corpus_stats", "SELECT count(*) AS n_docs, CAST(sum(len(tt) + len(bt)) AS BIGINT) AS n_tokens, round(avg(len(tt) + len(bt)), 6) AS avgdl FROM tok", tok=TOK)
def _(t):
    return lexical.corpus_statistics(t["docs"]).withColumn("avgdl", F.round("avgdl", 6))


@register("document_frequency", "SELECT term, count(*) AS df FROM (SELECT unnest(list_distinct(list_concat(tt, bt))) AS term FROM tok) GROUP BY term", tok=TOK)
def _(t):
    return lexical.document_frequency(t["docs"])


@register("postings", "SELECT w AS term, document_id, field, CAST(p - 1 AS INTEGER) AS pos FROM (SELECT document_id, 'title' AS field, unnest(tt) AS w, generate_subscripts(tt, 1) AS p FROM tok UNION ALL SELECT document_id, 'body', unnest(bt), generate_subscripts(bt, 1) FROM tok)", tok=TOK)
def _(t):
    return lexical.postings(t["docs"])


def _bm25(name: str, query: str, kept: bool = True) -> None:
    parsed = parse_query(query)
    phrases = lexical.phrase_lists(parsed)
    where = "extension = 'md'" if parsed.values else "TRUE"
    sql = f"SELECT m.*, s.relevance FROM scored s JOIN ({META}) m USING (document_id) WHERE {where} ORDER BY s.relevance DESC, document_id LIMIT {LIMIT}"

    # Ties go by id after rounding, so that both engines cut the same rows.
    register(name, sql, **bm25_sql(phrases))(lambda t: lexical.search(t["docs"], t["files"], query, LIMIT, index=kept_index(t) if kept else None, decimals=6))


_bm25("bm25_single", "worthless")
_bm25("bm25_multi", "the with")
_bm25("bm25_phrase", '"of the"')
_bm25("bm25_filtered", "worthless ext:md")
_bm25("search_topk", 'the "of the" and-or')
_bm25("bm25_scan", "the with", kept=False)


@register("phrase_match", f"SELECT document_id, {hits_sql('tt', ['doc', 'en'])} + 0 AS title_hits, {hits_sql('bt', ['of', 'the'])} AS body_hits FROM tok WHERE {hits_sql('bt', ['of', 'the'])} > 0", tok=TOK)
def _(t):
    k = lexical.tokenized(t["docs"]).select("document_id", X.phrase_hits(F.col("title_tokens"), ["doc", "en"]).alias("title_hits"), X.phrase_hits(F.col("body_tokens"), ["of", "the"]).alias("body_hits"))
    return k.filter("body_hits > 0")


@register("multi_term_and", "SELECT document_id FROM tok WHERE list_contains(list_concat(tt, bt), 'the') AND list_contains(list_concat(tt, bt), 'der')", tok=TOK)
def _(t):
    return lexical.scored(t["docs"], [["the"], ["der"]]).select("document_id")


@register("search_by_postings", "SELECT document_id, relevance FROM scored", **bm25_sql([["worthless"], ["of", "the"]]))
def _(t):
    return lexical.scored_by_index(kept_index(t), [["worthless"], ["of", "the"]]).select("document_id", F.round("relevance", 6).alias("relevance"))


AFTER = {"docs": SQL["docs"] + " WHERE doc_id % 7 <> 0"}


@register("index_maintenance", "SELECT document_id, relevance FROM scored", **(AFTER | bm25_sql([["worthless"], ["of", "the"]])))
def _(t):
    """An index of other texts, brought up to date by a segment: a fifth of the documents written anew, a
    seventh removed."""
    docs, number = t["docs"], F.substring("document_id", 5, 10).cast("long")
    stale = docs.withColumn("body", F.when(number % 5 == 0, "worthless of the past").otherwise(F.col("body")))
    written, removed = docs.filter((number % 5 == 0) & (number % 7 != 0)), docs.filter(number % 7 == 0)
    old = _stored(t["spark"], "postings", lexical.index_postings(stale, 0), POSTINGS)
    new = _stored(t["spark"], "postings", lexical.index_postings(written, 1), POSTINGS)
    lengths = lexical.changed_lengths(lexical.lengths_of_postings(stale, old, 0), written, removed, 1)
    lengths, postings = _stored(t["spark"], "lengths", lengths, LENGTHS), old.unionByName(new)
    index = lexical.Index(postings, lengths, **lexical.corpus_size(lengths))
    return lexical.scored_by_index(index, [["worthless"], ["of", "the"]]).select("document_id", F.round("relevance", 6).alias("relevance"))


# -- lookups

@register("keyset_page", "SELECT document_id, title FROM docs WHERE document_id > 'doc:0000000123' ORDER BY document_id LIMIT 50")
def _(t):
    return store.list_batch(t["docs"], "doc:0000000123", 50).select("document_id", "title")


@register("get_document", "SELECT document_id, title, length(body) AS n FROM docs WHERE document_id = 'doc:0000000042'")
def _(t):
    return store.get_document(t["docs"], "doc:0000000042").select("document_id", "title", F.length("body").cast("long").alias("n"))


@register("list_for_path", "SELECT document_id FROM docs WHERE source_path_display = (SELECT source_path_display FROM docs WHERE document_id = 'doc:0000000007') ORDER BY document_id")
def _(t):
    path = store.get_by_key(t["docs"], "document_id", "doc:0000000007").select("source_path_display").first()[0]
    return store.list_for_path(t["docs"], path).select("document_id")


@register("index_statistics", "SELECT (SELECT count(*) FROM files) AS files_indexed, (SELECT count(*) FROM docs) AS documents_indexed")
def _(t):
    return store.index_statistics(t["files"], t["docs"])


# -- vectors

EMB = "SELECT vec_id, CAST(embedding AS DOUBLE[]) AS v, label FROM embeddings"
QUERY_VECTOR = "SELECT v AS q FROM emb WHERE vec_id = 0"


def _vectors(t: Tables) -> DataFrame:
    return t["spark"].read.parquet(f"{t['dir']}/embeddings.parquet").select("vec_id", F.col("embedding").cast("array<double>").alias("v"), "label")


def _first(t: Tables) -> list[float]:
    return _vectors(t).filter("vec_id = 0").first()["v"]


@register("cosine_knn", "SELECT vec_id, round(list_cosine_similarity(v, q), 6) AS similarity FROM emb, qv ORDER BY similarity DESC, vec_id LIMIT 50", emb=EMB, qv=QUERY_VECTOR)
def _(t):
    return semantic.nearest(_vectors(t).withColumn("id", F.col("vec_id")), _first(t), 50, id_column="id", vector_column="v").select("vec_id", F.round("similarity", 6).alias("similarity"))


@register("cosine_knn_filtered", "SELECT vec_id, label, round(list_cosine_similarity(v, q), 6) AS similarity FROM emb, qv WHERE label IN (1, 3) ORDER BY similarity DESC, vec_id LIMIT 20", emb=EMB, qv=QUERY_VECTOR)
def _(t):
    return semantic.nearest(_vectors(t).filter("label in (1, 3)"), _first(t), 20, id_column="vec_id", vector_column="v").select("vec_id", "label", F.round("similarity", 6).alias("similarity"))


@register("embedding_semi_guard", "SELECT vec_id, label FROM emb WHERE EXISTS (SELECT 1 FROM labels WHERE doc_id = vec_id)", emb=EMB)
def _(t):
    labels = t["spark"].read.parquet(f"{t['dir']}/labels.parquet")
    return semantic.guarded(_vectors(t).withColumnRenamed("vec_id", "document_id"), labels.withColumnRenamed("doc_id", "document_id")).select(F.col("document_id").alias("vec_id"), "label")


#: The feature hash in SQL: words and their runs of three characters, folded byte by byte.
FEATURES = """SELECT document_id, unnest(f) AS f FROM (
 SELECT document_id, list_concat(
  list_transform(w, lambda x: {'s': x, 'wt': 2.0}),
  flatten(list_transform(list_filter(w, lambda x: length(x) >= 3), lambda x: list_transform(range(1, length(x) - 1), lambda i: {'s': substr(x, i, 3), 'wt': 1.0})))) AS f
 FROM (SELECT document_id, regexp_extract_all(lower(title), '[\\p{L}\\p{N}_]+') AS w FROM docs))"""
HASHED = """SELECT document_id, wt, list_reduce(list_prepend(37, b), lambda h, x: (xor(h, x) * 179) & 255) AS bucket, list_reduce(list_prepend(1, list_transform(b, lambda x: x & 1)), lambda p, x: xor(p, x)) AS parity
 FROM (SELECT document_id, f.wt AS wt, list_transform(range(1, CAST(strlen(f.s) AS BIGINT) + 1), lambda i: CAST(ascii(f.s[i]) AS BIGINT)) AS b FROM feat)"""


@register("feature_hash_embedding", "SELECT document_id, bucket, CAST(sum(CASE WHEN parity = 0 THEN wt ELSE -wt END) AS DOUBLE) AS weight FROM hashed GROUP BY 1, 2", feat=FEATURES, hashed=HASHED)
def _(t):
    found = t["docs"].select("document_id", F.explode(V.features(F.col("title"), 2.0)).alias("f")).select("document_id", "f.feature", "f.weight")
    at = found.withColumn("at", V._bucket_and_sign(F.col("feature")))
    return at.groupBy("document_id", F.col("at.bucket").cast("long").alias("bucket")).agg(F.sum(F.col("at.sign") * F.col("weight")).alias("weight"))


# -- hybrid

def _hybrid_parts(t: Tables) -> tuple[DataFrame, DataFrame]:
    found = lexical.scored_by_index(kept_index(t), [["the"], ["with"]]).select("document_id", F.round("relevance", 6).alias("relevance"))
    top = found.orderBy(F.col("relevance").desc(), "document_id").limit(candidate_limit(20))
    left = hybrid.ranked(top, "lexical_rank", F.col("relevance").desc(), "document_id")
    ids = _vectors(t).select(F.concat(F.lit("doc:"), F.lpad(F.col("vec_id").cast("string"), 10, "0")).alias("document_id"), "v")
    near = semantic.nearest(ids.join(t["docs"].select("document_id"), "document_id", "left_semi").withColumn("similarity", F.lit(0.0)), _first(t), 1000, vector_column="v")
    near = near.withColumn("similarity", F.round("similarity", 6)).orderBy(F.col("similarity").desc(), "document_id").limit(candidate_limit(20))
    return left, hybrid.ranked(near, "semantic_rank", F.col("similarity").desc(), "document_id")


HYBRID = bm25_sql([["the"], ["with"]]) | {
    "emb": EMB,
    "qv": QUERY_VECTOR,
    "lexr": "SELECT document_id, row_number() OVER (ORDER BY relevance DESC, document_id) AS lexical_rank FROM (SELECT * FROM scored ORDER BY relevance DESC, document_id LIMIT 100)",
    "sem": "SELECT concat('doc:', lpad(CAST(vec_id AS VARCHAR), 10, '0')) AS document_id, round(list_cosine_similarity(v, q), 6) AS similarity FROM emb, qv WHERE concat('doc:', lpad(CAST(vec_id AS VARCHAR), 10, '0')) IN (SELECT document_id FROM docs)",
    "semr": "SELECT document_id, similarity, row_number() OVER (ORDER BY similarity DESC, document_id) AS semantic_rank FROM (SELECT * FROM sem ORDER BY similarity DESC, document_id LIMIT 100)",
}
FUSED = "SELECT coalesce(l.document_id, s.document_id) AS document_id, CAST(lexical_rank AS INTEGER) AS lexical_rank, CAST(semantic_rank AS INTEGER) AS semantic_rank, similarity AS semantic_similarity, round(coalesce(1.0 / (60 + CAST(lexical_rank AS DOUBLE)), 0) + coalesce(1.0 / (60 + CAST(semantic_rank AS DOUBLE)), 0), 9) AS fusion_score FROM lexr l FULL OUTER JOIN semr s ON l.document_id = s.document_id"


@register("rrf_fusion", f"SELECT * FROM ({FUSED}) ORDER BY fusion_score DESC, document_id LIMIT 20", **HYBRID)
def _(t):
    left, right = _hybrid_parts(t)
    return hybrid.fuse(left.drop("relevance"), right, 20).withColumn("fusion_score", F.round("fusion_score", 9))


@register("hybrid_search", f"SELECT document_id, title, file_name, lexical_rank, semantic_rank, fusion_score FROM (SELECT * FROM ({FUSED}) ORDER BY fusion_score DESC, document_id LIMIT 20) JOIN ({META}) USING (document_id)", **HYBRID)
def _(t):
    models = t["spark"].createDataFrame([("test", "1", "test", 64)], MODELS_DDL)
    ids = _vectors(t).select(F.concat(F.lit("doc:"), F.lpad(F.col("vec_id").cast("string"), 10, "0")).alias("document_id"), F.col("v").alias("vector"))
    found = hybrid.hybrid_search(t["docs"], t["files"], ids, models, "the with", _first(t), "test", "1", 20, index=kept_index(t), decimals=6)
    return found.select("document_id", "title", "file_name", "lexical_rank", "semantic_rank", F.round("fusion_score", 9).alias("fusion_score"))


MODELS_DDL = "model_id string, model_version string, provider_kind string, dimensions long"


@register("hybrid_fallback", f"SELECT document_id, lexical_rank, round(1.0 / (60 + lexical_rank), 9) AS fusion_score FROM (SELECT document_id, CAST(row_number() OVER (ORDER BY document_id) AS INTEGER) AS lexical_rank FROM ({META}) WHERE extension = 'md' ORDER BY document_id LIMIT 100) ORDER BY lexical_rank LIMIT 20")
def _(t):
    spark = t["spark"]
    models = spark.createDataFrame([], MODELS_DDL)
    found = hybrid.hybrid_search(t["docs"], t["files"], spark.createDataFrame([], "document_id string, vector array<float>"), models, "ext:md", None, "m", "1", 20)
    return found.select("document_id", "lexical_rank", F.round("fusion_score", 9).alias("fusion_score"))


# -- snapshots and writes

@register("snapshot_diff", "SELECT coalesce(p.path, s.path) AS path, CASE WHEN p.path IS NULL THEN 'added' WHEN s.path IS NULL THEN 'removed' WHEN p.size_bytes = s.size_bytes AND coalesce(p.modified_at = s.modified_at, FALSE) THEN 'unchanged' ELSE 'modified' END AS change FROM previous p FULL OUTER JOIN snapshot s ON p.path = s.path")
def _(t):
    return changes.ordered_changes(t["previous"], t["snapshot"])


@register("path_scope", "SELECT path_display FROM files WHERE path_display = '/library/src1' OR starts_with(path_display, '/library/src1/')")
def _(t):
    return t["files"].filter(X.in_scope(F.col("path_display"), F.lit("/library/src1/"))).select("path_display")


SEEN = "SELECT path_display AS path FROM lib WHERE doc_id % 3 = 0"
PROTECTED = "SELECT '/library/src2' AS path UNION ALL SELECT '/library/src3/'"


def _scan(t: Tables) -> tuple[DataFrame, DataFrame]:
    return t["lib"].filter("doc_id % 3 = 0").select(F.col("path_display").alias("path")), t["spark"].sql(PROTECTED)


@register("rescan_stale_files", "SELECT path_display FROM files f WHERE NOT EXISTS (SELECT 1 FROM seen WHERE seen.path = f.path_display) AND NOT starts_with(path_display, '/library/src2/') AND NOT starts_with(path_display, '/library/src3/')", seen=SEEN)
def _(t):
    return store.stale_files(t["files"], "/library", *_scan(t)).select("path_display")


@register("rescan_stale_documents", "SELECT document_id FROM docs d WHERE NOT EXISTS (SELECT 1 FROM files f WHERE f.path_display = d.source_path_display) AND NOT starts_with(source_path_display, '/library/src2/') AND NOT starts_with(source_path_display, '/library/src3/')")
def _(t):
    return store.stale_documents(t["docs"], t["files"], "/library", _scan(t)[1]).select("document_id")


@register("upsert_overlay", "SELECT path_display, size_bytes FROM files WHERE path_display NOT IN (SELECT path_display FROM lib WHERE doc_id % 7 = 0) UNION ALL SELECT path_display, size_bytes + 1000 FROM lib WHERE doc_id % 7 = 0")
def _(t):
    new = t["lib"].filter("doc_id % 7 = 0").withColumn("size_bytes", F.col("size_bytes") + 1000).select(t["files"].columns)
    return store.upsert_files(t["files"], new)[0].select("path_display", "size_bytes")


@register("mutation_batch", "SELECT path_display FROM files WHERE NOT starts_with(path_display, '/library/src4/') AND path_display NOT IN (SELECT path_display FROM lib WHERE doc_id % 9 = 0) UNION ALL SELECT path_display FROM lib WHERE doc_id % 9 = 0")
def _(t):
    own = t["lib"].filter("doc_id % 9 = 0")
    full = lambda d: d.withColumns({"line_start": F.lit(None).cast("long"), "line_end": F.lit(None).cast("long")})
    new_docs = full(own.select("document_id", F.lit("local_file").alias("source_kind"), F.col("path_display").alias("source_path_display"), F.col("file_name").alias("title"), "body"))
    removed = t["spark"].sql("SELECT '/library/src4/' AS path")
    return store.apply_mutations(t["files"], full(t["docs"]), own.select(t["files"].columns), new_docs, removed)[0].select("path_display")


@register("file_type_map", "SELECT path_display, file_type FROM files")
def _(t):
    return t["files"].select("path_display", X.file_type(X.extension(X.file_name(F.col("path_display")))).alias("file_type"))


# -- events

@register("last_op_wins", "SELECT root, path, arg_max(kind, seq) AS kind, max(seq) AS seq FROM file_events GROUP BY root, path")
def _(t):
    return changes.last_operations(t["file_events"])


@register(
    "session_coalesce",
    "SELECT root, count(*) AS n_events, count(DISTINCT path) AS n_paths, min(ts) AS first_ts, max(ts) AS last_ts FROM (SELECT *, sum(fresh) OVER (PARTITION BY root ORDER BY ts, seq ROWS UNBOUNDED PRECEDING) AS s FROM (SELECT *, CASE WHEN ts - lag(ts) OVER (PARTITION BY root ORDER BY ts, seq) > INTERVAL 1 HOUR OR lag(ts) OVER (PARTITION BY root ORDER BY ts, seq) IS NULL THEN 1 ELSE 0 END AS fresh FROM file_events)) GROUP BY root, s",
)
def _(t):
    return E.sessions(t["file_events"], "1 hour")


RAW = "SELECT seq, root, CASE seq % 5 WHEN 0 THEN 'rename_from' WHEN 1 THEN 'rename_to' ELSE kind END AS kind, path FROM file_events"


@register(
    "rename_pairing",
    "SELECT seq, root, CASE WHEN kind = 'rename_from' THEN 'removed' WHEN kind = 'rename_to' AND before = 'rename_from' THEN 'renamed' WHEN kind = 'rename_to' THEN 'created' ELSE kind END AS kind, CASE WHEN kind = 'rename_to' AND before = 'rename_from' THEN from_path ELSE path END AS path, CASE WHEN kind = 'rename_to' AND before = 'rename_from' THEN path END AS path_to FROM (SELECT *, lag(kind) OVER w AS before, lag(path) OVER w AS from_path, lead(kind) OVER w AS after FROM raw WINDOW w AS (PARTITION BY root ORDER BY seq)) WHERE NOT (kind = 'rename_from' AND coalesce(after, '') = 'rename_to')",
    raw=RAW,
)
def _(t):
    kind = F.when(F.col("seq") % 5 == 0, "rename_from").when(F.col("seq") % 5 == 1, "rename_to").otherwise(F.col("kind"))
    return E.pair_renames(E.normalise(t["file_events"].withColumn("kind", kind))).select("seq", "root", "kind", "path", "path_to")


# -- evaluation and health

@register(
    "recall_at_k",
    "SELECT query, CAST(count(*) FILTER (r.document_id IS NOT NULL) AS DOUBLE) / count(*) AS recall FROM (SELECT lang AS query, document_id FROM lib WHERE doc_id % 20 = 0) g LEFT JOIN (SELECT lang AS query, document_id, row_number() OVER (PARTITION BY lang ORDER BY size_bytes DESC, document_id) AS rank FROM lib) r USING (query, document_id) WHERE TRUE GROUP BY query".replace("AS rank FROM lib) r", "AS rank FROM lib QUALIFY rank <= 40) r"),
)
def _(t):
    relevant = t["lib"].filter("doc_id % 20 = 0").select(F.col("lang").alias("query"), "document_id")
    results = t["lib"].select(F.col("lang").alias("query"), "document_id", F.row_number().over(Window.partitionBy("lang").orderBy(F.col("size_bytes").desc(), "document_id")).alias("rank"))
    return changes.recall_at_k(results, relevant, 40)


HEALTH = "SELECT a.v AS source_configured, b.v AS running, c.v AS last_status, d.v AS incomplete, e.v AS watch_running FROM (VALUES (true), (false)) a(v), (VALUES (true), (false)) b(v), (VALUES ('completed'), ('failed'), ('cancelled'), (NULL)) c(v), (VALUES (true), (false)) d(v), (VALUES (true), (false)) e(v)"


@register("index_health", "SELECT *, CASE WHEN running THEN 'indexing' WHEN last_status = 'failed' THEN 'failed' WHEN last_status = 'cancelled' THEN 'cancelled' WHEN NOT source_configured THEN 'not-configured' WHEN last_status IS NOT NULL AND incomplete THEN 'degraded' WHEN NOT watch_running THEN 'degraded' ELSE 'ready' END AS state FROM health", health=HEALTH)
def _(t):
    return t["spark"].sql(HEALTH).withColumn("state", changes.index_health())


# -- documents, embeddings and summaries

def _whole(df: DataFrame) -> DataFrame:
    """Documents with the columns of a location."""
    none = F.lit(None).cast("long")
    return df.withColumns({"line_start": none, "line_end": none})


def _own(t: Tables, divisor: int) -> DataFrame:
    """New documents for every so many rows of the library."""
    own = t["lib"].filter(F.col("doc_id") % divisor == 0)
    return _whole(own.select("document_id", F.lit("local_file").alias("source_kind"), F.col("path_display").alias("source_path_display"), F.upper("file_name").alias("title"), "body"))


@register("mutation_batch_documents", "SELECT document_id, file_name AS title FROM lib WHERE doc_id % 9 <> 0 AND source <> 'src4' UNION ALL SELECT document_id, upper(file_name) FROM lib WHERE doc_id % 9 = 0")
def _(t):
    files = t["lib"].filter("doc_id % 9 = 0").select(t["files"].columns)
    removed = t["spark"].sql("SELECT '/library/src4/' AS path")
    return store.apply_mutations(t["files"], _whole(t["docs"]), files, _own(t, 9), removed)[1].select("document_id", "title")


@register("upsert_documents", "SELECT document_id, CASE WHEN doc_id % 6 = 0 THEN upper(file_name) ELSE file_name END AS title FROM lib")
def _(t):
    return store.upsert_documents(_whole(t["docs"]), _own(t, 6)).select("document_id", "title")


@register("delete_document", "SELECT document_id FROM docs WHERE document_id <> 'doc:0000000042'")
def _(t):
    return store.delete_document(t["docs"], "doc:0000000042")[0].select("document_id")


@register("upsert_summary", "SELECT count(*) AS received, count(*) FILTER (doc_id % 10 <> 3) AS written, count(*) FILTER (doc_id % 10 = 3) AS failed, CAST(ceil(count(*) FILTER (doc_id % 10 <> 3) / 128.0) AS BIGINT) AS batches FROM lib")
def _(t):
    new = t["lib"].withColumn("size_bytes", F.when(F.col("doc_id") % 10 == 3, -1).otherwise(F.col("size_bytes")))
    return store.upsert_files(t["files"], new.select(t["files"].columns), 128)[1]


def _stored_vectors(t: Tables) -> DataFrame:
    ids = F.concat(F.lit("doc:"), F.lpad(F.col("vec_id").cast("string"), 10, "0")).alias("document_id")
    vectors = _vectors(t).select(ids, F.lit("test").alias("model_id"), F.lit("1").alias("model_version"), F.lit(64).cast("long").alias("dimensions"), F.unhex(F.lit("00" * 16)).alias("source_fingerprint"), F.col("v").cast("array<float>").alias("vector"))
    return semantic.guarded(vectors, t["docs"])


IDS = "SELECT concat('doc:', lpad(CAST(vec_id AS VARCHAR), 10, '0')) AS document_id, vec_id, embedding FROM embeddings WHERE concat('doc:', lpad(CAST(vec_id AS VARCHAR), 10, '0')) IN (SELECT document_id FROM docs)"


@register("get_embedding", "SELECT CAST(generate_subscripts(embedding, 1) - 1 AS INTEGER) AS pos, unnest(embedding) AS value FROM ids WHERE document_id = 'doc:0000000007'", ids=IDS)
def _(t):
    found = semantic.get_embedding(_stored_vectors(t), "doc:0000000007", "test", "1") or []
    return t["spark"].createDataFrame(list(enumerate(found)), "pos int, value float")


@register("embedding_upsert", "SELECT document_id, CASE WHEN vec_id % 4 = 0 THEN -embedding[1] ELSE embedding[1] END AS first FROM ids", ids=IDS)
def _(t):
    held = _stored_vectors(t)
    new = held.filter(F.substring("document_id", 5, 10).cast("long") % 4 == 0).withColumn("vector", F.transform("vector", lambda x: -x))
    return semantic.upsert_embeddings(held, new, t["docs"], 64).select("document_id", F.get("vector", 0).alias("first"))


@register("embedding_invalidate", "SELECT document_id FROM ids WHERE vec_id % 3 <> 0", ids=IDS)
def _(t):
    touched = t["docs"].filter(F.substring("document_id", 5, 10).cast("long") % 3 == 0)
    return semantic.invalidate(_stored_vectors(t), touched).select("document_id")


@register("embedding_refresh", "SELECT document_id, CAST(256 AS BIGINT) AS dimensions FROM docs WHERE starts_with(source_path_display, '/library/src2/')")
def _(t):
    paths = t["docs"].filter(F.col("source_path_display").startswith("/library/src2/")).select("source_path_display")
    return semantic.refresh(t["docs"], paths.unionByName(paths), "local-feature-hash", "1")[0].select("document_id", "dimensions")


#: Bytes of a text as numbers, and the hash of a list of them from a start, modulo 2 ** 64.
BYTES = "list_transform(regexp_extract_all(hex(encode({c})), '..'), lambda h: CAST('0x' || h AS HUGEINT))"
FNV = "list_reduce(list_prepend(CAST({start} AS HUGEINT), {b}), lambda h, x: (xor(h, x) * 1099511628211) % 18446744073709551616)"
LITTLE = "array_to_string(list_reverse(regexp_extract_all(lpad(hex({h}), 16, '0'), '..')), '')"


def _fnv(column: str, start: str) -> str:
    return FNV.format(start=start, b=BYTES.format(c=column))


def _print(seed: int) -> str:
    step = f"({_fnv('title', str(seed))} * 1099511628211) % 18446744073709551616"
    return LITTLE.format(h=_fnv("body", step))


@register("document_id_fnv", f"SELECT path_display, concat('file:', lower(lpad(hex({_fnv('path_display', str(V.FNV_SEED))}), 16, '0'))) AS document_id FROM files")
def _(t):
    return t["files"].select("path_display", V.path_document_id(F.col("path_display")).alias("document_id"))


@register("fingerprint", f"SELECT document_id, concat({_print(V.FNV_SEED)}, {_print(V.SECOND_SEED)}) AS fingerprint FROM docs")
def _(t):
    return t["docs"].select("document_id", F.hex(V.fingerprint("title", "body")).alias("fingerprint"))


OPENED = "length(regexp_replace(substr(props, 1, i), '[^{\\[]', '', 'g')) - length(regexp_replace(substr(props, 1, i), '[^}\\]]', '', 'g'))"


@register("json_depth", f"SELECT event_id, CAST(list_max(list_transform(range(1, length(props) + 1), lambda i: {OPENED})) AS INTEGER) AS depth FROM events")
def _(t):
    return t["spark"].read.parquet(f"{t['dir']}/events.parquet").select("event_id", json_depths("props").alias("depth"))


#: The engine's vectors over title and body: words and runs of three characters, hashed byte by byte.
GRAMS = """SELECT document_id, unnest(list_concat(list_transform(w, lambda x: {{'s': x, 'wt': {wt}}}),
 flatten(list_transform(list_filter(w, lambda x: length(x) >= 3), lambda x: list_transform(range(1, length(x) - 1), lambda i: {{'s': substr(x, i, 3), 'wt': {wt} / 2}}))))) AS f
 FROM (SELECT document_id, regexp_extract_all(lower({c}), '[\\p{{L}}\\p{{N}}_]+') AS w FROM docs)"""
COUNTED = f"SELECT document_id, f.s AS s, sum(f.wt) AS wt FROM ({GRAMS.format(c='title', wt='2.0')} UNION ALL {GRAMS.format(c='body', wt='1.0')}) GROUP BY 1, 2"
DISTINCT = f"SELECT s, list_reduce(list_prepend(37, b), lambda h, x: (xor(h, x) * 179) & 255) AS bucket, list_reduce(list_prepend(1, list_transform(b, lambda x: x & 1)), lambda p, x: xor(p, x)) AS parity FROM (SELECT s, list_transform({BYTES.format(c='s')}, lambda x: CAST(x AS BIGINT)) AS b FROM (SELECT DISTINCT s FROM counted))"
SUMMED = "SELECT document_id, bucket, sum(CASE WHEN parity = 0 THEN wt ELSE -wt END) AS v FROM counted JOIN distinct_grams USING (s) GROUP BY 1, 2"


@register("embedding_weights", "SELECT document_id, CAST(bucket AS INTEGER) AS bucket, CAST(v / sqrt(sum(v * v) OVER (PARTITION BY document_id)) AS FLOAT) AS weight FROM summed WHERE v <> 0", counted=COUNTED, distinct_grams=DISTINCT, summed=SUMMED)
def _(t):
    made = semantic.embed(t["docs"], "local-feature-hash", "1")[0]
    return made.select("document_id", F.posexplode("vector").alias("bucket", "weight")).filter("weight <> 0")


@register("out_of_root_events", "SELECT count(*) FILTER (path IS NULL OR seq % 4 = 0) AS dropped, count(*) FILTER (path IS NOT NULL AND seq % 4 <> 0) AS kept FROM (SELECT seq, CASE WHEN seq % 9 = 0 THEN NULL ELSE path END AS path FROM file_events)")
def _(t):
    lost = F.when(F.col("seq") % 4 == 0, F.concat(F.lit("/else"), "path")).otherwise(F.col("path"))
    raw = t["file_events"].withColumn("path", F.when(F.col("seq") % 9 == 0, F.lit(None)).otherwise(lost))
    normal = E.normalise(raw)
    return normal.agg(F.count_if(E.is_outside()).alias("dropped"), F.count_if(~E.is_outside()).alias("kept"))


OPERATED = "SELECT root, seq, ts, path, CASE kind WHEN 'removed' THEN 'remove' ELSE 'upsert' END AS op FROM file_events"
SESSIONS = "SELECT *, sum(fresh) OVER (PARTITION BY root ORDER BY seq ROWS UNBOUNDED PRECEDING) AS s FROM (SELECT *, CASE WHEN ts - lag(running) OVER (PARTITION BY root ORDER BY seq) >= INTERVAL 1 HOUR THEN 1 ELSE 0 END AS fresh FROM (SELECT *, max(ts) OVER (PARTITION BY root ORDER BY seq ROWS UNBOUNDED PRECEDING) AS running FROM operated))"


@register("coalesced_batches", "SELECT root, CAST(s AS BIGINT) AS number, path, arg_max(op, seq) AS op FROM sess GROUP BY root, s, path", operated=OPERATED, sess=SESSIONS)
def _(t):
    return E.coalesce(E.operations(E.pair_renames(E.normalise(t["file_events"]))), "1 hour", 1 << 30).select("root", "number", "path", "op")


@register("flushed_batches")
def _(t):
    paired = E.pair_renames(E.normalise(t["file_events"].withColumn("root", F.lit("/watch"))))
    return E.coalesce(E.operations(paired), "30 days")


@register(
    "retrieval_quality",
    "SELECT count(*) AS queries, round(avg(recall), 9) AS macro_recall, count(*) FILTER (top1) AS top1_hits FROM (SELECT query, CAST(count(*) FILTER (rank <= 40) AS DOUBLE) / count(*) AS recall, bool_or(rank = 1) AS top1 FROM (SELECT lang AS query, document_id FROM lib WHERE doc_id % 20 = 0) g LEFT JOIN (SELECT lang AS query, document_id, row_number() OVER (PARTITION BY lang ORDER BY size_bytes DESC, document_id) AS rank FROM lib) r USING (query, document_id) GROUP BY query)",
)
def _(t):
    relevant = t["lib"].filter("doc_id % 20 = 0").select(F.col("lang").alias("query"), "document_id")
    order = Window.partitionBy("lang").orderBy(F.col("size_bytes").desc(), "document_id")
    results = t["lib"].select(F.col("lang").alias("query"), "document_id", F.row_number().over(order).alias("rank"))
    return changes.retrieval_quality(results, relevant, 40).withColumn("macro_recall", F.round("macro_recall", 9))


LABELS = " ".join(f"WHEN '{e}' THEN '{label}'" for e, label in B.TYPES.items())


@register("result_labels", f"SELECT document_id, CASE ltrim(lower(extension), '.') {LABELS} ELSE CASE WHEN starts_with(file_type, 'text/') THEN '{B.TEXT}' ELSE '{B.OTHER}' END END AS type_label, coalesce('{B.CHANGED}' || strftime(make_timestamp(modified_at * 1000), '%Y/%m/%d'), '{B.UNKNOWN_DATE}') AS date_label FROM (SELECT document_id, extension, file_type, CASE WHEN document_id LIKE '%5' THEN NULL ELSE modified_at END AS modified_at FROM ({META}))")
def _(t):
    found = lexical.with_metadata(t["docs"].drop("body"), t["files"])
    modified = F.when(~F.col("document_id").endswith("5"), F.col("modified_at"))
    return found.select("document_id", B.type_label(F.col("extension"), F.col("file_type")).alias("type_label"), B.date_label(modified).alias("date_label"))


# -- rows only: no SQL for these

@register("snippet")
def _(t):
    return lexical.search(t["docs"], t["files"], "worthless", LIMIT, snippets=True).select("document_id", "snippet")


@register("html_text")
def _(t):
    return t["spark"].read.parquet(f"{t['dir']}/pages.parquet").select("page_id", html_text("html").alias("text"))


@register("document_embeddings")
def _(t):
    return semantic.embed(t["docs"], "local-feature-hash", "1")[0].select("document_id", "dimensions", "vector")
