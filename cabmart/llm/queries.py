"""The registered queries of this subpackage: one per operator, over whole tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from . import (ann_search, bloom_lm, byte_bpe, collocations, exact_search, html_text, line_dedup, ngram_join, packing, prefix_trie,
               quality, toxicity, warc)
from .common import labelled_fold, scratch_path, table


def vocabulary(name: str) -> str:
    import public_tokenizers
    return public_tokenizers.path(name)


def op1_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    machine = toxicity.fit(docs, labels, held_out=labelled_fold(F.col("doc_id"), 5, 0))
    scored = toxicity.classify(docs.select("doc_id", "text"), machine)
    return scored.select("doc_id", labelled_fold(F.col("doc_id"), 5, 0).alias("held_out"), "score", "predicted")


def op2_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = vocabulary("byte_bpe_50k.tiktoken")
    coded = byte_bpe.encode(table(spark, sf_dir, "documents").select("doc_id", "text"), path)
    back = byte_bpe.decode(coded.select("doc_id", "bpe_n_tokens", "bpe_n_split", "bpe_ids"), path, text=False)
    return back.select("doc_id", F.col("bpe_n_tokens").alias("n_tokens"),
                       F.col("decoded_ids_sha256").alias("ids_sha256"),
                       F.sha2("decoded_bytes", 256).alias("decoded_sha256"),
                       F.col("bpe_n_split").alias("n_split"))


def op3_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    model = quality.fit(docs, labels, held_out=labelled_fold(F.col("doc_id"), 3, 1))
    scored = quality.classify(docs.select("doc_id", "text"), model)
    return scored.select("doc_id", labelled_fold(F.col("doc_id"), 3, 1).alias("held_out"), "score", "predicted")


def op4_exact_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_search.search(table(spark, sf_dir, "embeddings"), k=20, every=20, scale=64)


def op5_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = warc.write_archives(table(spark, sf_dir, "pages"), scratch_path(spark, "warc"))
    return warc.read_archives(spark, path, payload=False).select(
        "page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op6_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    packed = packing.pack(table(spark, sf_dir, "documents"), vocabulary("byte_bpe_50k.json"), capacity=1024, end_id=2)
    return packed.select("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset")


def op7_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return line_dedup.dedup(docs, percent=80)


def op8_ann_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ann_search.search(table(spark, sf_dir, "embeddings"), k=5, every=50)


def op9_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages").select("page_id", "url", "html")
    return html_text.extract(pages, html_text.fit(pages)).select("page_id", "url", "text", "n_chars")


def op10_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.join(table(spark, sf_dir, "documents"), n=4, percent=85)


def op11_bloom_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, held_out = table(spark, sf_dir, "documents"), labelled_fold(F.col("doc_id"), 10, 0)
    scored = bloom_lm.score(docs, bloom_lm.fit(docs, train=~held_out))
    return scored.select("doc_id", held_out.alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score")


def op12_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    convs = prefix_trie.conversations(table(spark, sf_dir, "conversations"))
    first = F.crc32(F.col("conv_id").cast("string").cast("binary")) % 6
    return prefix_trie.trie(prefix_trie.with_shared_heads(convs, block=100, n_first=first, most=5))


def op13_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations.collocations(table(spark, sf_dir, "documents"), support=10, longest=3, percent=50, top=2000)


QUERIES = {
    "op1_toxicity": op1_toxicity,
    "op2_byte_bpe": op2_byte_bpe,
    "op3_quality": op3_quality,
    "op4_exact_search": op4_exact_search,
    "op5_warc": op5_warc,
    "op6_packing": op6_packing,
    "op7_line_dedup": op7_line_dedup,
    "op8_ann_search": op8_ann_search,
    "op9_html_text": op9_html_text,
    "op10_ngram_join": op10_ngram_join,
    "op11_bloom_lm": op11_bloom_lm,
    "op12_prefix_trie": op12_prefix_trie,
    "op13_collocations": op13_collocations,
}

ORACLE: dict[str, str] = {
    "op4_exact_search": """
        WITH v AS (
            SELECT vec_id, list_transform(embedding, lambda x: floor(64 * x::DOUBLE)) AS vec FROM embeddings
            WHERE vec_id IS NOT NULL AND len(embedding) > 0 AND len(list_filter(embedding, lambda x:
                  x IS NULL OR NOT isfinite(x))) = 0),
        scored AS (
            SELECT q.vec_id AS query_id, c.vec_id, list_inner_product(q.vec, c.vec)::BIGINT AS score
            FROM v q JOIN v c ON q.vec_id % 20 = 0 AND c.vec_id <> q.vec_id),
        ranked AS (
            SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS place FROM scored)
        SELECT query_id, place::INTEGER AS rank, vec_id, score FROM ranked WHERE place <= 20""",
    "op5_warc": """
        WITH p AS (
            SELECT page_id, sha256(coalesce(html, '')) AS digest, strlen(coalesce(html, '')) AS bytes FROM pages),
        g AS (SELECT digest, min(page_id) AS first_id FROM p WHERE bytes >= 100 GROUP BY digest)
        SELECT p.page_id, p.bytes::BIGINT AS payload_bytes, p.digest AS payload_digest,
               CASE WHEN first_id IS NULL OR p.page_id = first_id THEN 'response' ELSE 'revisit' END AS record_type,
               CASE WHEN p.page_id <> first_id THEN first_id END AS refers_to
        FROM p LEFT JOIN g USING (digest)""",
    # CRC-32, a bit at a time: DuckDB has no function for it.
    "op12_prefix_trie": """
        WITH t AS (
            SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
            WHERE conv_id IS NOT NULL),
        own AS (
            SELECT conv_id, list({'step': md5(length(role) || ':' || role || text), 'chars': length(text)}
                                 ORDER BY turn NULLS FIRST, md5(length(role) || ':' || role || text)) AS steps
            FROM t GROUP BY conv_id),
        numbered AS (
            SELECT *, (xor(list_reduce(list_concat([4294967295::BIGINT],
                list_transform(string_split(conv_id::VARCHAR, ''), lambda x: ascii(x)::BIGINT)), lambda crc, byte:
                list_reduce(list_concat([xor(crc, byte)], range(8)), lambda x, i:
                    CASE WHEN x & 1 = 1 THEN xor(x >> 1, 3988292384::BIGINT) ELSE x >> 1 END)), 4294967295::BIGINT)) % 6 AS h
            FROM own),
        rebuilt AS (
            SELECT c.conv_id, list_concat(coalesce(b.steps, [])[1:c.h], c.steps[c.h + 1:]) AS steps
            FROM numbered c LEFT JOIN own b ON b.conv_id = c.conv_id - c.conv_id % 100),
        member AS (
            SELECT conv_id, d, list_transform(steps[1:d], lambda s: s.step) AS path, list_transform(steps[1:d - 1], lambda s: s.step) AS up,
                   CASE WHEN d > 0 THEN steps[d].chars ELSE 0 END AS chars, len(steps) = d AS ends
            FROM (SELECT *, unnest(range(len(steps) + 1)) AS d FROM rebuilt)),
        node AS (
            SELECT path, d AS depth, first(up) AS up, min(conv_id) AS conv_id, count(*) AS n_convs, first(chars) AS chars,
                   sha256(coalesce(string_agg(conv_id::VARCHAR, ',' ORDER BY conv_id) FILTER (ends), '')) AS ends_sha256
            FROM member GROUP BY path, d),
        family AS (
            SELECT n.*, p.conv_id AS parent_conv_id FROM node n
            LEFT JOIN node p ON n.depth > 0 AND p.depth = n.depth - 1 AND p.path = n.up),
        children AS (SELECT up, depth - 1 AS depth, count(*) AS n FROM node WHERE depth > 0 GROUP BY ALL),
        sized AS (
            SELECT f.*, coalesce(c.n, 0) AS n_children FROM family f LEFT JOIN children c ON c.up = f.path AND c.depth = f.depth),
        under AS (
            SELECT path[1:k] AS path, k AS depth, sum((n_children = 0)::BIGINT) AS n_leaves, sum((n_convs - 1) * chars) AS saved
            FROM (SELECT *, unnest(range(depth + 1)) AS k FROM sized) GROUP BY ALL)
        SELECT s.conv_id, s.depth::BIGINT AS depth, s.parent_conv_id, s.n_convs::BIGINT AS n_convs,
               s.n_children::BIGINT AS n_children, u.n_leaves::BIGINT AS n_leaves, u.saved::BIGINT AS saved_tokens, s.ends_sha256
        FROM sized s JOIN under u ON u.path = s.path AND u.depth = s.depth""",
    "op13_collocations": """
        WITH pieces AS (
            SELECT coalesce(lang, 'und') AS lang, unnest(regexp_split_to_array(
                translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                '[.,;:!?\x0A-\x0D]')) AS piece FROM documents),
        split AS (
            SELECT lang, list_filter(regexp_split_to_array(piece, '[\x20\x09]'), lambda w: w <> '') AS words FROM pieces),
        placed AS (SELECT lang, words, unnest(range(1, len(words) + 1)) AS i FROM split),
        grams AS (
            SELECT lang, 1 AS w, words[i] AS phrase FROM placed
            UNION ALL SELECT lang, 2, words[i] || ' ' || words[i + 1] FROM placed WHERE i + 1 <= len(words)
            UNION ALL SELECT lang, 3, words[i] || ' ' || words[i + 1] || ' ' || words[i + 2] FROM placed WHERE i + 2 <= len(words)),
        counted AS (SELECT lang, w, phrase, count(*) AS f FROM grams GROUP BY ALL),
        sizes AS (SELECT lang, sum(f) AS n FROM counted WHERE w = 1 GROUP BY lang),
        cand AS (SELECT *, string_split(phrase, ' ') AS p FROM counted WHERE w > 1 AND f >= 10),
        cuts AS (
            SELECT lang, phrase, f AS a, 1 AS k, p[1] AS x, array_to_string(p[2:], ' ') AS y FROM cand
            UNION ALL SELECT lang, phrase, f, 2, p[1] || ' ' || p[2], p[3] FROM cand WHERE w = 3),
        scored AS (
            SELECT c.lang, c.phrase, c.a, c.k, x.f AS l, y.f AS r, (1000000::HUGEINT * c.a * c.a) // (x.f::HUGEINT * y.f) AS score
            FROM cuts c JOIN counted x ON x.lang = c.lang AND x.phrase = c.x JOIN counted y ON y.lang = c.lang AND y.phrase = c.y),
        weakest AS (SELECT * FROM scored QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) = 1),
        longer AS (
            SELECT lang, phrase, max(f) AS f FROM (
                SELECT lang, p[1] || ' ' || p[2] AS phrase, f FROM cand WHERE w = 3
                UNION ALL SELECT lang, p[2] || ' ' || p[3], f FROM cand WHERE w = 3) GROUP BY ALL),
        kept AS (
            SELECT w.* FROM weakest w LEFT JOIN longer g ON g.lang = w.lang AND g.phrase = w.phrase
            WHERE g.f IS NULL OR 100 * g.f < 50 * w.a),
        ranked AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank FROM kept)
        SELECT r.lang, r.rank::BIGINT AS rank, r.phrase, r.a::BIGINT AS a, r.l::BIGINT AS l, r.r::BIGINT AS r, s.n::BIGINT AS n,
               r.score::BIGINT AS score
        FROM ranked r JOIN sizes s ON s.lang = r.lang WHERE r.rank <= 2000""",
}
