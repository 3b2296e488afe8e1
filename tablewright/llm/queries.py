"""The operators applied to whole tables, and SQL for the same rows where SQL can express it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tablewright.llm import (
    exact_dedup,
    merkle,
    mixing,
    neighbour_graph,
    periodic_runs,
    quality_ranking,
    quality_rules,
    sentencepiece_bpe,
    sharding,
    simhash,
    toxicity,
    url_filter,
    warc,
)


SHARDS = 40
URL_RULES = [
    ("com", "/", "allow"),
    ("example.com", "/en/", "block"),
    ("www.example.com", "/en/", "allow"),
    ("net", "/es/", "block"),
    ("net", "/fr/", "block"),
]


def tokenizer_path() -> str:
    import public_tokenizers

    return str(public_tokenizers.path("piece_bpe_32k.model"))


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def op1_mixing(spark: SparkSession, folder: str) -> DataFrame:
    return mixing.mix(table(spark, folder, "documents"), weights=(5, 2, 1), share=1.5, max_epochs=2)


def op2_quality_ranking(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents")
    return quality_ranking.score(docs, quality_ranking.train(docs, table(spark, folder, "labels")))


def op3_sentencepiece(spark: SparkSession, folder: str) -> DataFrame:
    encoded = sentencepiece_bpe.encode_and_decode(table(spark, folder, "documents"), tokenizer_path())
    return sentencepiece_bpe.digests(encoded)


def op4_toxicity(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents")
    return toxicity.score(docs, toxicity.train(docs, table(spark, folder, "labels")))


def op5_url_filter(spark: SparkSession, folder: str) -> DataFrame:
    rules = spark.createDataFrame(URL_RULES, "host string, path string, verdict string")
    return url_filter.judge(table(spark, folder, "pages"), rules)


def op6_simhash(spark: SparkSession, folder: str) -> DataFrame:
    found = simhash.near_duplicates(table(spark, folder, "documents"), shingle=3, max_bits=2)
    return found.select("doc_id", "fingerprint", "component_id")


def op7_sharding(spark: SparkSession, folder: str) -> DataFrame:
    placed = sharding.assign(table(spark, folder, "documents"), shards=SHARDS)
    return placed.withColumns({"law": F.lit("rows"), "grown_shard": F.lit(None).cast("int")})


def op8_exact_dedup(spark: SparkSession, folder: str) -> DataFrame:
    return exact_dedup.exact_dedup(table(spark, folder, "documents"), keep="largest")


def op9_quality_rules(spark: SparkSession, folder: str) -> DataFrame:
    return quality_rules.with_stripped_digest(table(spark, folder, "documents")).select(
        "doc_id",
        "n_words",
        "word_chars",
        "n_symbols",
        "n_dup_lines",
        "n_repeat_words",
        "removed_words",
        "base_failed",
        "kept",
        "stripped_sha256",
    )


def op10_warc(spark: SparkSession, folder: str) -> DataFrame:
    read = warc.archive_and_read(table(spark, folder, "pages"), revisit_from=0)
    return read.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "valid")


def op11_neighbour_graph(spark: SparkSession, folder: str) -> DataFrame:
    return neighbour_graph.neighbours(table(spark, folder, "embeddings"), every=100, k=10)


def op12_periodic_runs(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents").select("doc_id", "text")
    repeating = docs.withColumn("text", periodic_runs.planted(F.col("text"), F.col("doc_id")))
    return periodic_runs.digests(periodic_runs.detect(repeating, shortest=6, exponent=4))


def op13_merkle(spark: SparkSession, folder: str) -> DataFrame:
    every_third = F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 3 == 0, F.lit(False))
    return merkle.manifest(table(spark, folder, "documents"), tampered=every_third).drop("copies")


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_mixing": op1_mixing,
    "op2_quality_ranking": op2_quality_ranking,
    "op3_sentencepiece": op3_sentencepiece,
    "op4_toxicity": op4_toxicity,
    "op5_url_filter": op5_url_filter,
    "op6_simhash": op6_simhash,
    "op7_sharding": op7_sharding,
    "op8_exact_dedup": op8_exact_dedup,
    "op9_quality_rules": op9_quality_rules,
    "op10_warc": op10_warc,
    "op11_neighbour_graph": op11_neighbour_graph,
    "op12_periodic_runs": op12_periodic_runs,
    "op13_merkle": op13_merkle,
}



def merkle_sql(group_levels: int = 8, upper_levels: int = 4) -> str:
    """The tree level by level, for groups of up to ``8 ** group_levels`` rows; an entry per level and leaf."""
    field = "CASE WHEN {0} IS NULL THEN '-' ELSE strlen({0}::VARCHAR) || ':' || {0}::VARCHAR END"
    fields = " || ".join(field.format(name) for name in ("doc_id", "source", "lang", "n_chars"))
    small = "translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
    bits = "list_transform(string_split(doc_id::VARCHAR, ''), lambda c: [ascii(c)::BIGINT, -1, -1, -1, -1, -1, -1, -1, -1])"
    shift = "CASE WHEN x >= 0 THEN xor(crc, x) ELSE xor(crc >> 1, 3988292384 * (crc & 1)) END"
    parts = [
        f"""t AS (
            SELECT *, xor(list_reduce(list_prepend(4294967295, flatten({bits})), lambda crc, x: {shift}), 4294967295) AS crc,
                   {fields} AS told, {field.format("text")} AS body, {field.format(small)} AS small
            FROM documents
        )""",
        """e AS (
            SELECT doc_id, lang, sha256(told || body) AS leaf,
                   CASE WHEN crc % 3 = 0 THEN sha256(told || small) ELSE sha256(told || body) END AS changed
            FROM t
        )""",
        """e0 AS (
            SELECT *, dense_rank() OVER (ORDER BY lang NULLS FIRST) - 1 AS g,
                   row_number() OVER (PARTITION BY lang ORDER BY doc_id NULLS FIRST, leaf) - 1 AS i, changed AS folded, '' AS proof
            FROM e
        )""",
        "n0 AS (SELECT g, i, leaf AS h, count(*) OVER (PARTITION BY g) AS n FROM e0)",
    ]

    def climb(levels: int, at: int) -> int:
        for k in range(at, at + levels):
            run = "PARTITION BY g, i // 8 ORDER BY i ROWS BETWEEN"
            parts.append(
                f"""s{k} AS (
                    SELECT *, coalesce(string_agg(h, '') OVER ({run} UNBOUNDED PRECEDING AND 1 PRECEDING), '') AS before,
                           coalesce(string_agg(h, '') OVER ({run} 1 FOLLOWING AND UNBOUNDED FOLLOWING), '') AS after
                    FROM n{k}
                )"""
            )
            parts.append(
                f"""n{k + 1} AS (
                    SELECT g, i // 8 AS i, CASE WHEN n = 1 THEN min(h) ELSE sha256(string_agg(h, '' ORDER BY i)) END AS h,
                           (n + 7) // 8 AS n
                    FROM n{k} GROUP BY g, i // 8, n
                )"""
            )
            parts.append(
                f"""e{k + 1} AS (
                    SELECT e{k}.* REPLACE (
                        i // 8 AS i, proof || before || after AS proof,
                        CASE WHEN n = 1 THEN folded ELSE sha256(before || folded || after) END AS folded
                    )
                    FROM e{k} JOIN (SELECT g, i, before, after, n FROM s{k}) USING (g, i)
                )"""
            )
        return at + levels

    top = climb(group_levels, 0)
    parts += [
        f"n{top + 1} AS (SELECT 0 AS g, g AS i, h, count(*) OVER () AS n FROM n{top})",
        f"e{top + 1} AS (SELECT e.* REPLACE (0 AS g, e.g AS i), h AS subroot FROM e{top} AS e JOIN n{top} USING (g))",
    ]
    last = climb(upper_levels, top + 1)
    return f"""WITH {", ".join(parts)}
        SELECT doc_id, leaf, subroot, h AS root, sha256(proof) AS proof_sha256, folded AS folded_root, folded = h AS verified
        FROM e{last} JOIN (SELECT h FROM n{last}) ON true"""


SQL: dict[str, str] = {
    "op13_merkle": merkle_sql(),
    "op8_exact_dedup": """
        WITH n AS (
            SELECT doc_id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS t
            FROM documents
        )
        SELECT doc_id,
               max(doc_id) OVER (PARTITION BY t) AS keep_id,
               count(*) OVER (PARTITION BY t) AS group_size,
               row_number() OVER (PARTITION BY t ORDER BY doc_id DESC NULLS LAST) = 1 AS kept,
               sha256(t) AS text_sha256
        FROM n
    """,
    "op9_quality_rules": r"""
        WITH d AS (
            SELECT row_number() OVER () AS r, doc_id, coalesce(source, chr(0)) AS host, coalesce(text, '') AS t FROM documents
        ), w AS (
            SELECT r, regexp_extract_all(t, '[^\x20\x09-\x0D]+') AS ws FROM d
        ), win AS (
            SELECT r, i, (ws[i], ws[i + 1], ws[i + 2]) AS g FROM w, unnest(range(1, len(ws) - 1)) AS u(i)
        ), rep AS (
            SELECT r, i FROM win QUALIFY count(*) OVER (PARTITION BY r, g) > 1
        ), cov AS (
            SELECT r, count(DISTINCT i + k) AS n FROM rep, range(3) AS o(k) GROUP BY r
        ), l AS (
            SELECT r, host, md5(t) AS th, line,
                   trim(regexp_replace(translate(line, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                       '[\x20\x09-\x0D]+', ' ', 'g'), ' ') AS norm
            FROM d, unnest(string_split(t, chr(10))) AS u(line)
            WHERE regexp_matches(line, '[^\x20\x09-\x0D]')
        ), dup AS (
            SELECT r, count(*) - count(DISTINCT line) AS n FROM l GROUP BY r
        ), frequent AS (
            SELECT host, norm FROM l JOIN (SELECT host, count(DISTINCT md5(t)) AS all_texts FROM d GROUP BY host) USING (host)
            GROUP BY host, norm, all_texts
            HAVING count(DISTINCT th) > 100 OR (count(DISTINCT th) > 5 AND count(DISTINCT th) > 0.02 * all_texts)
        ), s AS (
            SELECT r, host, i, parts[i] AS line,
                   trim(regexp_replace(translate(parts[i], 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                       '[\x20\x09-\x0D]+', ' ', 'g'), ' ') AS norm
            FROM (SELECT r, host, string_split(t, chr(10)) AS parts FROM d), unnest(range(1, len(parts) + 1)) AS u(i)
        ), stripped AS (
            SELECT r, string_agg(line, chr(10) ORDER BY i) AS t FROM s ANTI JOIN frequent USING (host, norm) GROUP BY r
        ), rem AS (
            SELECT r, sum(len(string_split(norm, ' '))) AS n FROM l JOIN frequent USING (host, norm) GROUP BY r
        ), f AS (
            SELECT d.doc_id, len(ws) AS n_words, length(array_to_string(ws, '')) AS word_chars,
                   length(d.t) - length(regexp_replace(d.t, '[#*$%&|<>]', '', 'g')) AS n_symbols,
                   coalesce(dup.n, 0) AS n_dup_lines, coalesce(cov.n, 0) AS n_repeat_words,
                   coalesce(rem.n, 0)::BIGINT AS removed_words, sha256(coalesce(stripped.t, '')) AS stripped_sha256
            FROM d JOIN w USING (r) LEFT JOIN dup USING (r) LEFT JOIN cov USING (r) LEFT JOIN rem USING (r)
            LEFT JOIN stripped USING (r)
        )
        SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed,
               NOT (n_words < 50 OR 100 * n_repeat_words > 50 * n_words)
               AND n_words - removed_words >= 0.3 * n_words AS kept
        FROM f
    """,
    "op5_url_filter": r"""
        WITH s AS (
            SELECT page_id, CASE WHEN contains(url, '://') THEN substr(url, instr(url, '://') + 3) ELSE '' END AS rest FROM pages
        ), p AS (
            SELECT row_number() OVER () AS r, page_id,
                   translate(regexp_extract(rest, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
                   regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path
            FROM s
        ), rules(h, f, v) AS (
            VALUES ('com', '/', 'allow'), ('example.com', '/en/', 'block'), ('www.example.com', '/en/', 'allow'),
                   ('net', '/es/', 'block'), ('net', '/fr/', 'block')
        ), best AS (
            SELECT r, h || f AS rule, v FROM p JOIN rules ON (host = h OR ends_with(host, '.' || h)) AND starts_with(path, f)
            QUALIFY row_number() OVER (PARTITION BY r ORDER BY length(h || f) DESC, length(h) DESC) = 1
        )
        SELECT page_id, host, path, rule, coalesce(v, 'allow') AS verdict FROM p LEFT JOIN best USING (r)
    """,
    "op10_warc": """
        WITH p AS (
            SELECT page_id, octet_length(encode(coalesce(html, ''))) AS n, sha1(coalesce(html, '')) AS hex, coalesce(html, '') AS body
            FROM pages
        ), d AS (
            SELECT *, max(page_id) OVER (PARTITION BY body) AS first_id,
                   row_number() OVER (PARTITION BY body ORDER BY page_id DESC NULLS LAST) = 1 AS first,
                   list_transform(range(8), lambda g: ('0x' || substr(hex, (g * 5 + 1)::INT, 5))::INT) AS parts
            FROM p
        )
        SELECT page_id, n::BIGINT AS payload_bytes,
               array_to_string(list_transform(range(32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
                   ((parts[(i // 4 + 1)::INT] >> (15 - 5 * (i % 4))::INT) & 31) + 1, 1)), '') AS payload_digest,
               CASE WHEN first THEN 'response' ELSE 'revisit' END AS record_type,
               CASE WHEN first THEN NULL ELSE first_id END AS refers_to, true AS valid
        FROM d
    """,
}
