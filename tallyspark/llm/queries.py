"""The registered queries of this subpackage and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bpe_codec, collocations, decontaminate, line_dedup, merkle, mixing, near_dedup, quality_classifier, quality_rules, secret_scan, suffix_dedup, token_files, url_filter


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filter.judge_urls(table(spark, sf_dir, "pages"))


def op2_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = suffix_dedup.remove_repeats(table(spark, sf_dir, "documents"), 100)
    n_removed = F.aggregate("spans", F.lit(0).cast("long"), lambda n, x: n + x["end"] - x["start"])
    return found.select("doc_id", "n_bytes", n_removed.alias("n_removed"), F.size("spans").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"))


def op3_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dedup.near_groups(table(spark, sf_dir, "documents"), size=3, percent=85)


def tokenizer_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def op4_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    manifest = token_files.write_tokens(table(spark, sf_dir, "documents"), tokenizer_path(), end_id=2)
    read = token_files.read_tokens(manifest, tokenizer_path())
    return read.select("doc_id", "start", "n_tokens", F.crc32("ids").alias("ids_crc32"))


def op5_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = line_dedup.drop_repeated_lines(table(spark, sf_dir, "documents"), least=10)
    return found.select("doc_id", "n_lines", "n_dropped", F.sha2(F.col("kept").cast("binary"), 256).alias("kept_sha256"))


def op6_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    held_out = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 == 1
    return quality_classifier.quality_scores(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"), held_out)


def op7_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = mixing.mix_sources(table(spark, sf_dir, "documents"), copies=True)
    return found.select("doc_id", "size", "source_size", "target", "taken")


def op8_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules.quality_verdicts(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")).drop("reasons")


def op9_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """`documents` name one owner, their source; each document counts as a repository."""
    found = secret_scan.scan_secrets(table(spark, sf_dir, "documents"))
    kinds = F.transform("base", lambda x: x["kind"])
    n = [F.size(F.array_remove(F.array_remove(kinds, (k + 1) % 3), (k + 2) % 3)).cast("long").alias(f"n_{name}") for k, name in enumerate(secret_scan.KINDS[:3])]
    classes = [F.size(F.filter("candidates", lambda x: x["class"] == name)).cast("long").alias(f"n_{name}") for name in ("live", "example")]  # noqa: B023
    base = secret_scan.joined(F.col("base"))
    return found.select("doc_id", *n, F.sha2(base.cast("binary"), 256).alias("base_sha256"), secret_scan.joined(F.concat("base", "added")).alias("spans"), *classes)


def op10_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontaminate.find_contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    items = F.array_join("items", ",")
    return found.select("doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"), F.sha2(items.cast("binary"), 256).alias("items_sha256"), "contaminated")


def op11_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The manifest, and each leaf folded to the root again: half of the texts without their line feeds."""
    head, text = [F.col(c) for c in ("doc_id", "source", "lang", "n_chars")], F.col("text")
    tampered = (F.crc32(F.col("doc_id").cast("string").cast("binary")) % 2 == 0) & F.contains(text, F.lit("\n"))
    forged = F.when(tampered, merkle.leaf_digest(*head, F.replace(text, F.lit("\n"), F.lit(""))))
    leaves = table(spark, sf_dir, "documents").select("doc_id", "source", merkle.leaf_digest(*head, text).alias("leaf"), forged.alias("forged"))
    found = merkle.merkle_manifest(leaves, "source", "doc_id")
    proof = F.array_join(F.zip_with("before", "after", lambda b, a: F.concat(b, a)), "")
    folded = merkle.fold(F.coalesce("forged", "leaf"), F.col("before"), F.col("after"))
    out = found.select("doc_id", "leaf", "subroot", "root", F.sha2(proof.cast("binary"), 256).alias("proof_sha256"), folded.alias("folded_root"))
    return out.withColumn("verified", F.col("folded_root") == F.col("root"))


def op12_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations.mine_collocations(table(spark, sf_dir, "documents"), least=30, longest=4, held=80, top=2000)


def op13_bpe_codec(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    ranks, pattern = public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN
    decoded = bpe_codec.decode_ids(bpe_codec.encode_texts(table(spark, sf_dir, "documents"), ranks, pattern), ranks, pattern)
    ids = F.array_join(F.col("ids").cast("array<string>"), " ")
    return decoded.select("doc_id", F.size("ids").cast("long").alias("n_tokens"), F.sha2(ids.cast("binary"), 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {"op1_url_filters": op1_url_filters, "op2_suffix_dedup": op2_suffix_dedup, "op3_near_dedup": op3_near_dedup, "op4_token_files": op4_token_files, "op5_line_dedup": op5_line_dedup, "op6_quality_classifier": op6_quality_classifier, "op7_mixing": op7_mixing, "op8_quality_rules": op8_quality_rules, "op9_secret_scan": op9_secret_scan, "op10_decontamination": op10_decontamination, "op11_merkle_manifest": op11_merkle_manifest, "op12_collocations": op12_collocations, "op13_bpe_codec": op13_bpe_codec}

_WORDS = "|".join(url_filter.LISTED_WORDS)
SQL: dict[str, str] = {
    "op1_url_filters": rf"""
        WITH p AS (
            SELECT page_id, CASE WHEN instr(url, '://') > 0 THEN substr(url, instr(url, '://') + 3) END AS rest FROM pages
        ), h AS (
            SELECT page_id,
                   translate(coalesce(regexp_extract(rest, '^[^/?#]*'), ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
                   coalesce(regexp_extract(rest, '^[^/?#]*([^?#]*)', 1), '') AS path
            FROM p
        ), r(rh, rp, v) AS (
            VALUES ('com', '/', 'allow'), ('example.com', '/en/', 'block'), ('www.example.com', '/en/', 'allow'), ('net', '/es/', 'block'), ('net', '/fr/', 'block')
        ), m AS (
            SELECT page_id, host, path, max_by(rh || rp, length(rh || rp)) AS rule, max_by(v, length(rh || rp)) AS v
            FROM h LEFT JOIN r ON (host = rh OR ends_with(host, '.' || rh)) AND starts_with(path, rp)
            GROUP BY ALL
        )
        SELECT page_id, host, path, rule, regexp_matches(host, '(^|[.-])({_WORDS})($|[.-])') AS listed,
               coalesce(v, CASE WHEN regexp_matches(host, '(^|[.-])({_WORDS})($|[.-])') THEN 'block' ELSE 'allow' END) AS verdict
        FROM m
    """,
    "op5_line_dedup": r"""
        WITH l AS (
            SELECT doc_id, i, line, translate(regexp_replace(line, '^[\x20\x09-\x0D]+|[\x20\x09-\x0D]+$', '', 'g'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key
            FROM (SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line, generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS i FROM documents)
        ), d AS (
            SELECT key, min(doc_id) AS first FROM l WHERE length(key) >= 10 GROUP BY key HAVING count(DISTINCT doc_id) > 1
        ), j AS (
            SELECT l.*, coalesce(l.doc_id > d.first, false) AS gone FROM l LEFT JOIN d USING (key)
        )
        SELECT doc_id, count(*) AS n_lines, count(*) FILTER (gone) AS n_dropped,
               sha256(coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (NOT gone), '')) AS kept_sha256
        FROM j GROUP BY doc_id
    """,
    "op11_merkle_manifest": r"""
        WITH RECURSIVE crc AS (
            SELECT list_transform(range(256), lambda i: list_reduce([i, 0, 0, 0, 0, 0, 0, 0, 0], lambda c, z: CASE WHEN c % 2 = 1 THEN xor(c // 2, 3988292384) ELSE c // 2 END)) AS codes
        ), marked AS (
            SELECT *, list_reduce(list_prepend(4294967295, list_transform(string_split(CAST(doc_id AS VARCHAR), ''), lambda x: CAST(ascii(x) AS BIGINT))),
                                  lambda c, x: xor(c // 256, codes[xor(c % 256, x) + 1])) % 2 = 1 AS tampered FROM documents, crc
        ), fields AS (
            SELECT doc_id, source, concat(coalesce(strlen(CAST(doc_id AS VARCHAR)) || ':' || doc_id, '-'), coalesce(strlen(source) || ':' || source, '-'),
                                          coalesce(strlen(lang) || ':' || lang, '-'), coalesce(strlen(CAST(n_chars AS VARCHAR)) || ':' || n_chars, '-')) AS head,
                   text, CASE WHEN tampered THEN replace(text, chr(10), '') ELSE text END AS given FROM marked
        ), l AS (
            SELECT doc_id, source AS g, sha256(head || coalesce(strlen(text) || ':' || text, '-')) AS leaf, sha256(head || coalesce(strlen(given) || ':' || given, '-')) AS given,
                   row_number() OVER (PARTITION BY source ORDER BY doc_id NULLS FIRST) - 1 AS p, count(*) OVER (PARTITION BY source) AS n FROM fields
        ), t(g, lv, i, d, n) AS (
            SELECT g, 0, p, leaf, n FROM l
            UNION ALL SELECT g, lv + 1, i // 3, sha256(string_agg(d, '' ORDER BY i)), (n + 2) // 3 FROM t WHERE n > 1 GROUP BY g, lv, i // 3, n
        ), r AS (
            SELECT g, d AS subroot, row_number() OVER (ORDER BY g NULLS FIRST) - 1 AS p, count(*) OVER () AS n FROM t WHERE n = 1
        ), s(lv, i, d, n) AS (
            SELECT 0, p, subroot, n FROM r
            UNION ALL SELECT lv + 1, i // 3, sha256(string_agg(d, '' ORDER BY i)), (n + 2) // 3 FROM s WHERE n > 1 GROUP BY lv, i // 3, n
        ), beside AS (
            SELECT doc_id, lv, coalesce(string_agg(d, '' ORDER BY i) FILTER (i < p // power), '') AS before, coalesce(string_agg(d, '' ORDER BY i) FILTER (i > p // power), '') AS after
            FROM (SELECT *, CAST(pow(3, lv) AS BIGINT) AS power FROM t WHERE n > 1) t JOIN l ON l.g IS NOT DISTINCT FROM t.g AND t.i // 3 = l.p // (3 * power) GROUP BY ALL
            UNION ALL
            SELECT doc_id, 100 + lv, coalesce(string_agg(d, '' ORDER BY i) FILTER (i < r.p // power), ''), coalesce(string_agg(d, '' ORDER BY i) FILTER (i > r.p // power), '')
            FROM (SELECT *, CAST(pow(3, lv) AS BIGINT) AS power FROM s WHERE n > 1) s JOIN r ON s.i // 3 = r.p // (3 * power) JOIN l ON l.g IS NOT DISTINCT FROM r.g GROUP BY ALL
        ), path AS (
            SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY lv) AS k FROM beside
        ), fold(doc_id, k, d) AS (
            SELECT doc_id, CAST(0 AS BIGINT), given FROM l
            UNION ALL SELECT fold.doc_id, path.k, sha256(before || d || after) FROM fold JOIN path ON path.doc_id = fold.doc_id AND path.k = fold.k + 1
        ), folded AS (
            SELECT doc_id, arg_max(d, k) AS folded_root FROM fold GROUP BY 1
        ), proof AS (
            SELECT doc_id, sha256(string_agg(before || after, '' ORDER BY k)) AS proof_sha256 FROM path GROUP BY 1
        )
        SELECT doc_id, leaf, subroot, root, coalesce(proof_sha256, sha256('')) AS proof_sha256, folded_root, folded_root = root AS verified
        FROM l JOIN r ON l.g IS NOT DISTINCT FROM r.g JOIN folded USING (doc_id) LEFT JOIN proof USING (doc_id), (SELECT d AS root FROM s WHERE n = 1)
    """,
    "op12_collocations": r"""
        WITH p AS (
            SELECT coalesce(lang, 'und') AS lang, unnest(regexp_split_to_array(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS piece FROM documents
        ), w AS (
            SELECT lang, list_filter(regexp_split_to_array(piece, '[\x20\x09]+'), lambda x: x <> '') AS w FROM p
        ), f AS (
            SELECT lang, m, array_to_string(list_slice(w, i, i + m - 1), ' ') AS phrase, count(*) AS f
            FROM (SELECT lang, w, m, unnest(generate_series(1, len(w) - m + 1)) AS i FROM w, (VALUES (1), (2), (3), (4)) s(m) WHERE len(w) >= m) GROUP BY ALL
        ), n AS (
            SELECT lang, CAST(sum(f) AS BIGINT) AS n FROM f WHERE m = 1 GROUP BY lang
        ), c AS (
            SELECT lang, m, phrase, string_split(phrase, ' ') AS w, f AS a FROM f WHERE m > 1 AND f >= 30
        ), k AS (
            SELECT lang, m, phrase, a, k, array_to_string(w[1:k], ' ') AS x, array_to_string(w[k + 1:m], ' ') AS y FROM (SELECT *, unnest(generate_series(1, m - 1)) AS k FROM c)
        ), s AS (
            SELECT k.*, l.f AS l, r.f AS r, CAST((2000000 * CAST(a AS HUGEINT)) // (CAST(l.f AS HUGEINT) + r.f) AS BIGINT) AS score
            FROM k JOIN f l ON l.lang = k.lang AND l.phrase = x JOIN f r ON r.lang = k.lang AND r.phrase = y
        ), b AS (
            SELECT * FROM s QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) = 1
        ), o AS (
            SELECT lang, array_to_string(w[i:i + z - 1], ' ') AS phrase, max(a) AS a
            FROM (SELECT *, unnest(generate_series(1, m - z + 1)) AS i FROM (SELECT *, unnest(generate_series(2, m - 1)) AS z FROM c WHERE m > 2)) GROUP BY ALL
        )
        SELECT b.lang, row_number() OVER (PARTITION BY b.lang ORDER BY score DESC, b.a DESC, b.phrase) AS rank, b.phrase, b.a, l, r, n, score
        FROM b JOIN n ON n.lang = b.lang LEFT JOIN o ON o.lang = b.lang AND o.phrase = b.phrase
        WHERE o.a IS NULL OR 100 * CAST(o.a AS HUGEINT) < 80 * CAST(b.a AS HUGEINT) QUALIFY rank <= 2000
    """,
    "op10_decontamination": r"""
        WITH dw AS (
            SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '') AS w FROM documents
        ), iw AS (
            SELECT CAST(item_id AS VARCHAR) AS item, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '') AS w FROM benchmark
        ), ig AS (
            SELECT DISTINCT item, least(len(w), 13) AS m, array_to_string(list_slice(w, i, i + least(len(w), 13) - 1), ' ') AS g
            FROM (SELECT item, w, unnest(generate_series(1, greatest(len(w) - 12, 1))) AS i FROM iw WHERE len(w) > 0)
        ), dg AS (
            SELECT doc_id, m, i, array_to_string(list_slice(w, i, i + m - 1), ' ') AS g
            FROM (SELECT doc_id, w, m, unnest(generate_series(1, len(w) - m + 1)) AS i FROM dw, (SELECT DISTINCT m FROM ig) WHERE len(w) >= m)
        ), h AS (
            SELECT doc_id, i, dg.m, item FROM dg JOIN ig ON dg.g = ig.g AND dg.m = ig.m
        ), c AS (
            SELECT doc_id, count(DISTINCT k) AS n_hit FROM (SELECT doc_id, unnest(generate_series(i, i + m - 1)) AS k FROM h) GROUP BY 1
        ), s AS (
            SELECT doc_id, count(DISTINCT item) AS n_items, array_to_string(list_sort(list(DISTINCT item)), ',') AS items FROM h GROUP BY 1
        )
        SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
               sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated
        FROM dw LEFT JOIN c USING (doc_id) LEFT JOIN s USING (doc_id)
    """,
}
