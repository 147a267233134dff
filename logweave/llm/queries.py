"""Queries of the ten operators over the test tables, and SQL that gives the same rows where there is some."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def register(function: Callable[[SparkSession, str], DataFrame]):
        QUERIES[name] = function
        if sql is not None:
            SQL[name] = sql
        return function

    return register


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder.rstrip('/')}/{name}.parquet")


def _classes_sql(size: int, columns: str) -> str:
    """Near-duplicate classes by word n-grams: every pair that shares one, then all that is reachable."""
    return rf"""
    WITH RECURSIVE w AS (
        SELECT doc_id, row, list_filter(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+'), lambda x: x <> '') AS words
        FROM (SELECT doc_id, text, row_number() OVER () AS row FROM documents)
    ), g AS (
        SELECT DISTINCT row, md5(unnest(CASE WHEN len(words) = 0 THEN [] WHEN len(words) < {size} THEN [array_to_string(words, ' ')]
            ELSE list_transform(range(1, len(words) - {size} + 2), lambda i: array_to_string(words[i:i + {size} - 1], ' ')) END)) AS gram
        FROM w WHERE words IS NOT NULL
    ), n AS (SELECT row, count(*)::BIGINT AS n FROM g GROUP BY row),
    p AS (SELECT a.row AS x, b.row AS y, count(*) AS m FROM g a JOIN g b ON a.gram = b.gram AND a.row < b.row GROUP BY a.row, b.row),
    l AS (
        SELECT d.doc_id AS a, e.doc_id AS b FROM p JOIN n u ON u.row = x JOIN n v ON v.row = y JOIN w d ON d.row = x JOIN w e ON e.row = y
        WHERE 100 * m >= 85 * (u.n + v.n - m)
    ), e AS (SELECT a, b FROM l UNION SELECT b, a FROM l),
    r AS (SELECT a AS node, a AS seen FROM e UNION SELECT r.node, e.b FROM r JOIN e ON e.a = r.seen),
    c AS (SELECT node, min(seen) AS component FROM r GROUP BY node)
    SELECT w.doc_id, coalesce(n.n, 0)::BIGINT AS n_shingles, coalesce(c.component, w.doc_id) AS component_id{columns}
    FROM w LEFT JOIN n ON n.row = w.row LEFT JOIN c ON c.node = w.doc_id
    """


@query("op2_minhash_near_dedup", _classes_sql(5, ", w.doc_id = coalesce(c.component, w.doc_id) AS kept"))
def op2(spark: SparkSession, folder: str) -> DataFrame:
    from logweave.llm.neardup import near_duplicate_classes

    return near_duplicate_classes(table(spark, folder, "documents"), percent=85)


@query("op6_quality_divergence")
def op6(spark: SparkSession, folder: str) -> DataFrame:
    from logweave.llm.quality import quality

    judged = quality(table(spark, folder, "documents"))
    names = ("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "class_distance", "word_distance")
    return judged.select(*names)


@query("op4_line_dedup")
def op4(spark: SparkSession, folder: str) -> DataFrame:
    from logweave.llm.lines import drop_repeated_lines

    return drop_repeated_lines(table(spark, folder, "documents")).select("doc_id", "n_lines", "n_removed", "text")


@query("op8_secret_scan")
def op8(spark: SparkSession, folder: str) -> DataFrame:
    from logweave.llm.secrets import KINDS, secret_spans, written_spans

    found = secret_spans(table(spark, folder, "documents"))

    def count(kind: str):
        return F.size(F.filter("base_spans", lambda s: s["kind"] == KINDS.index(kind))).cast("bigint").alias(f"n_{kind}")

    counts = [count(kind) for kind in KINDS[:3]]
    return found.select("doc_id", *counts, F.sha2(written_spans("base_spans"), 256).alias("base_sha256"), written_spans("secret_spans").alias("spans"))


def tokenizer_path(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


@query("op5_best_fit_packing")
def op5(spark: SparkSession, folder: str) -> DataFrame:
    from logweave.llm.packing import pack_documents

    return pack_documents(table(spark, folder, "documents").select("doc_id", "text"), tokenizer_path("byte_bpe_50k.json"), special_as_text=False)


@query("op1_chat_format")
def op1(spark: SparkSession, folder: str) -> DataFrame:
    from logweave.llm.chat import format_chats

    return format_chats(table(spark, folder, "conversations"))


@query("op9_license_scan")
def op9(spark: SparkSession, folder: str) -> DataFrame:
    from logweave.llm.licenses import known_licenses, license_matches

    return license_matches(table(spark, folder, "documents"), known_licenses(spark))


@query(
    "op10_exact_top_k",
    """
    WITH v AS (
        SELECT vec_id, list_transform(embedding, lambda x: floor(64 * x::DOUBLE)::BIGINT) AS e FROM embeddings
        WHERE embedding IS NOT NULL AND len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
    ), s AS (
        SELECT q.vec_id AS query_id, c.vec_id, list_dot_product(q.e::DOUBLE[], c.e::DOUBLE[])::BIGINT AS score
        FROM v q JOIN v c ON c.vec_id <> q.vec_id WHERE q.vec_id % 20 = 0
    ), r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INTEGER AS rank FROM s)
    SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 20
    """,
)
def op10(spark: SparkSession, folder: str) -> DataFrame:
    from logweave.llm.topk import quantized, top_k

    vectors = quantized(table(spark, folder, "embeddings"))
    return top_k(vectors, vectors.where("id % 20 = 0"), 20)


@query("op3_cross_parsing_language")
def op3(spark: SparkSession, folder: str) -> DataFrame:
    from logweave.llm.langid import identify, learn

    docs = table(spark, folder, "documents")
    held_out = F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 4 == 2, F.lit(False))
    samples = learn(docs, ~held_out)
    return identify(docs.select("doc_id", held_out.alias("held_out"), "text"), samples).select("doc_id", "held_out", "lang_pred", "score")


@query("op7_gumbel_segmentation")
def op7(spark: SparkSession, folder: str) -> DataFrame:
    from logweave.llm.subword import decode, encode_samples

    model = tokenizer_path("piece_bpe_32k.model")
    drawn = encode_samples(table(spark, folder, "documents").select("doc_id", "text"), model, samples=2)
    # The outer form, as the inner one would draw all samples a second time to see which texts have none.
    each = drawn.select("doc_id", "text", F.posexplode_outer("samples").alias("sample", "s")).where("sample IS NOT NULL")
    rows = each.select("doc_id", "text", "sample", "s.*")
    read = decode(rows, "ids", model)
    ids = F.size("ids").cast("bigint").alias("n_ids"), F.xxhash64("ids").alias("ids_hash"), (F.col("decoded") == F.col("text")).alias("round_trip")
    return read.select("doc_id", "sample", *ids, "log_prob", "perturbed", "log_inclusion")


@query(
    "op13_treap_search",
    r"""
    WITH t AS (
        SELECT doc_id, row, term, count(*) AS tf FROM (
            SELECT doc_id, row, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term
            FROM (SELECT doc_id, text, row_number() OVER () AS row FROM documents)
        ) GROUP BY doc_id, row, term
    ), d AS (SELECT row, sum(tf)::BIGINT AS n FROM t GROUP BY row),
    c AS (SELECT count(*)::BIGINT AS docs, sum(n)::BIGINT AS l FROM d),
    w AS (
        SELECT term, floor(1000 * ln((2 * docs + 2)::DOUBLE / (2 * df + 1)::DOUBLE))::BIGINT AS w
        FROM (SELECT term, count(*)::BIGINT AS df FROM t GROUP BY term), c
    ), i AS (
        SELECT DISTINCT item, item_id, term FROM (
            SELECT item, item_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term
            FROM (SELECT item_id, text, row_number() OVER () AS item FROM benchmark)
        )
    ), s AS (
        SELECT item, item_id, doc_id, row, sum(w * ((1000000000 * tf) // (1000 * tf + 20 * (50 + (50 * n * docs) // l))))::BIGINT AS score
        FROM i JOIN w USING (term) JOIN t USING (term) JOIN d USING (row), c GROUP BY item, item_id, doc_id, row
    ), r AS (
        SELECT *, row_number() OVER (PARTITION BY item ORDER BY score DESC, doc_id NULLS LAST)::INTEGER AS rank FROM s WHERE score > 0
    )
    SELECT item_id, rank, doc_id, score FROM r WHERE rank <= 50
    """,
)
def op13(spark: SparkSession, folder: str) -> DataFrame:
    from logweave.llm.lexical import index, search

    return search(index(table(spark, folder, "documents")), table(spark, folder, "benchmark"), k=50)


@query("op11_token_alignment")
def op11(spark: SparkSession, folder: str) -> DataFrame:
    from logweave.llm.alignment import align

    return align(table(spark, folder, "documents"), tokenizer_path("byte_bpe_50k.json"), tokenizer_path("piece_bpe_32k.model"))


@query("op12_ngram_jaccard", _classes_sql(4, ""))
def op12(spark: SparkSession, folder: str) -> DataFrame:
    from logweave.llm.ngramjoin import similar_classes

    return similar_classes(table(spark, folder, "documents"), size=4, percent=85)


@query("pipeline")
def pipeline(spark: SparkSession, folder: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, folder)
