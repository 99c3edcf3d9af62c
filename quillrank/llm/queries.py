"""The queries op1 to op13 and their SQL. Each applies its operator to the whole table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillrank.llm import exact_dedup, filter_audit, html_text, mixing, near_dedup, packing, pii, piece_tokens, quality_classifier, quality_rules, secrets, substring_dedup, vector_codes
from quillrank.session import table


def op1_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = secrets.secret_rows(table(spark, sf_dir, "documents"))
    return rows.select("doc_id", "n_assign", "n_access", "n_hex", F.sha2("base", 256).alias("base_sha256"), "spans", "n_entropy")


def op2_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.personal_data(table(spark, sf_dir, "documents"))


def op3_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules.judge(table(spark, sf_dir, "documents"))


def op4_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_text.extract(table(spark, sf_dir, "pages"))


def tokenizer_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def op5_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.packed(table(spark, sf_dir, "documents"), tokenizer_path())


def op6_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring_dedup.without_repeats(table(spark, sf_dir, "documents"))


def op7_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mixture_per_document(table(spark, sf_dir, "documents"))


def op8_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dedup.near_duplicates(table(spark, sf_dir, "documents"))


def op9_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_classifier.scores(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op10_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.exact_groups(table(spark, sf_dir, "documents")).drop("copy")


def op11_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vector_codes.codes(table(spark, sf_dir, "embeddings"))


def piece_model_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


def op12_piece_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The digests the contract asks for, and the last source byte that the pieces' spans reach."""
    rows = piece_tokens.encoded(table(spark, sf_dir, "documents"), piece_model_path())
    last = F.hex(F.substring("ends", -4, 4))
    reached = F.conv(F.concat(*[F.substring(last, k, 2) for k in (7, 5, 3, 1)]), 16, 10).cast("long")
    return rows.select("doc_id", (F.length("ids") / 4).cast("long").alias("n_tokens"), F.sha2("ids", 256).alias("ids_sha256"), F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"), reached.alias("bytes_spanned"))


def op13_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filter_audit.audit(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


QUERIES = {f.__name__: f for f in (op1_secrets, op2_pii, op3_quality_rules, op4_html_text, op5_packing, op6_substring_dedup, op7_mixing, op8_near_dedup, op9_quality_classifier, op10_exact_dedup, op11_vector_codes, op12_piece_tokens, op13_filter_audit)}

_LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

_BLANK = "concat(' ', chr(9), chr(10), chr(11), chr(12), chr(13))"
_BOILERPLATE = quality_rules.BOILERPLATE.replace("'", "''")


def _count_of(text: str, characters: str) -> str:
    return f"(length({text}) - length(translate({text}, '{characters}', '')))"


def _vector_codes_sql(parts: int = vector_codes.PARTS, entries: int = vector_codes.ENTRIES, rounds: int = vector_codes.ROUNDS) -> str:
    """Full searches, a named table for each round. Products of doubles below 2**53 are exact."""
    nearest = "SELECT vec_id, part, arg_min(entry, d * 1024 + entry) AS entry, min(d) AS d FROM (SELECT vec_id, part, entry, list_inner_product(v, v) + list_inner_product(c, c) - 2 * list_inner_product(v, c) AS d FROM k JOIN {book} USING (part)) GROUP BY ALL"
    steps = [
        "i AS (SELECT vec_id, label, list_transform(embedding, lambda x: floor(1024 * CAST(x AS DOUBLE))) AS v FROM embeddings WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0)",
        f"k AS MATERIALIZED (SELECT vec_id, part, list_slice(v, part * len(v) // {parts} + 1, (part + 1) * len(v) // {parts}) AS v FROM i CROSS JOIN (SELECT unnest(range({parts})) AS part))",
        f"b0 AS MATERIALIZED (SELECT part, row_number() OVER (PARTITION BY part ORDER BY vec_id) - 1 AS entry, v AS c FROM k QUALIFY entry < {entries})",
    ]
    for r in range(rounds + 1):
        steps.append(f"a{r} AS MATERIALIZED ({nearest.format(book=f'b{r}')})")
        if r < rounds:
            steps.append(
                f"s{r} AS (SELECT part, entry, j, floor(sum(x) / count(*)) AS m FROM (SELECT part, entry, generate_subscripts(v, 1) AS j, unnest(v) AS x FROM k JOIN a{r} USING (vec_id, part)) GROUP BY ALL), "
                f"b{r + 1} AS MATERIALIZED (SELECT part, entry, coalesce(m.c, b.c) AS c FROM b{r} b LEFT JOIN (SELECT part, entry, list(m ORDER BY j) AS c FROM s{r} GROUP BY ALL) m USING (part, entry))"
            )
    return f"""
        WITH {", ".join(steps)},
        e AS (SELECT vec_id, string_agg(lower(lpad(to_hex(entry), 2, '0')), '' ORDER BY part) AS code, CAST(sum(d) AS BIGINT) AS error FROM a{rounds} GROUP BY vec_id),
        h AS (SELECT sha256(string_agg(CAST(CAST(x AS BIGINT) AS VARCHAR), ',' ORDER BY part, entry, j)) AS codebooks_sha256 FROM (SELECT part, entry, generate_subscripts(c, 1) AS j, unnest(c) AS x FROM b{rounds}))
        SELECT vec_id, code, error, CAST(sum(error) OVER (PARTITION BY label) AS BIGINT) AS label_error, codebooks_sha256 FROM e JOIN i USING (vec_id) CROSS JOIN h"""


ORACLES = {
    "op3_quality_rules": f"""
        WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
        w AS (SELECT doc_id, t, regexp_extract_all(t, '[^\\x20\\x09-\\x0D]+') AS ws, list_filter(string_split(t, chr(10)), lambda x: trim(x, {_BLANK}) <> '') AS ls FROM d),
        h AS (SELECT doc_id, ws, unnest(range(1, len(ws) - 1)) AS i FROM w WHERE len(ws) > 2),
        r AS (SELECT doc_id, i FROM h QUALIFY count(*) OVER (PARTITION BY doc_id, ws[i], ws[i + 1], ws[i + 2]) > 1),
        n AS (SELECT doc_id, count(DISTINCT i + k) AS n FROM r CROSS JOIN (SELECT unnest([0, 1, 2]) AS k) GROUP BY doc_id),
        l AS (SELECT doc_id, line, trim(line, {_BLANK}) AS b FROM (SELECT doc_id, unnest(ls) AS line FROM w)),
        c AS (SELECT *, length(b) - length(replace(b, ' ', '')) + 1 AS words, {_count_of("b", "#*$%&<>")} AS symbols, {_count_of("b", "|")} AS pipes, {_count_of("b", "!")} AS shouts FROM l),
        f AS (SELECT doc_id, count(*) AS failed, sum(length(regexp_replace(line, '[\\x20\\x09-\\x0D]+', '', 'g'))) AS lost FROM c
              WHERE symbols > 0.5 * words OR (pipes > 0.25 * words AND pipes >= 2) OR (shouts > 0.68 * words AND words >= 3) OR (words >= 20 AND len(list_distinct(string_split(b, ' '))) < 0.2 * words) OR regexp_matches(b, '{_BOILERPLATE}') GROUP BY doc_id),
        a AS (SELECT doc_id, len(ws) AS n_words, length(array_to_string(ws, '')) AS word_chars, {_count_of("t", quality_rules.SYMBOLS)} AS n_symbols, len(ls) - len(list_distinct(ls)) AS n_dup_lines, coalesce(n, 0) AS n_repeat_words,
                     len(ls) AS n_lines, coalesce(failed, 0) AS n_failed_lines, CAST(coalesce(lost, 0) AS BIGINT) AS lost_chars FROM w LEFT JOIN n USING (doc_id) LEFT JOIN f USING (doc_id))
        SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed, NOT (n_words < 50 OR 100 * n_repeat_words > 50 * n_words) AND lost_chars <= 0.5 * word_chars AS kept FROM a""",
    "op8_near_dedup": f"""
        WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all({_LOWER}, '[^\\x20\\x09-\\x0D]+') AS ws FROM documents),
        s AS (SELECT doc_id, CASE WHEN len(ws) = 0 THEN [] WHEN len(ws) < 5 THEN [array_to_string(ws, ' ')]
                  ELSE list_distinct(list_transform(range(1, len(ws) - 3), lambda i: array_to_string(ws[i:i+4], ' '))) END AS sh FROM w),
        n AS (SELECT doc_id, len(sh) AS n_shingles FROM s),
        e AS (SELECT doc_id, unnest(sh) AS g FROM s),
        p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS common FROM e a JOIN e b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY 1, 2),
        l AS (SELECT a, b FROM p JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * common >= 75 * (x.n_shingles + y.n_shingles - common)),
        arcs AS (SELECT a, b FROM l UNION SELECT b, a FROM l),
        r AS (SELECT a AS doc_id, b AS other FROM arcs UNION SELECT r.doc_id, arcs.b FROM r JOIN arcs ON arcs.a = r.other),
        c AS (SELECT doc_id, min(other) AS low FROM r GROUP BY 1)
        SELECT n.doc_id, n_shingles, least(n.doc_id, coalesce(low, n.doc_id)) AS component_id, n.doc_id <= coalesce(low, n.doc_id) AS kept
        FROM n LEFT JOIN c USING (doc_id)""",
    "op10_exact_dedup": f"""
        SELECT doc_id, max(doc_id) OVER (PARTITION BY h) AS keep_id, count(*) OVER (PARTITION BY h) AS group_size,
               doc_id = max(doc_id) OVER (PARTITION BY h) AS kept, h AS text_sha256
        FROM (SELECT doc_id, sha256({_LOWER}) AS h FROM documents)""",
    "op11_vector_codes": _vector_codes_sql(),
    "op13_filter_audit": """
        WITH w AS (SELECT doc_id, coalesce(text, '') AS t, coalesce(source, '') AS part, regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+') AS ws FROM documents),
        l AS (SELECT doc_id, bool_or(coalesce(quality = 1, false)) AS good, bool_or(coalesce(toxic = 1, false)) AS toxic FROM labels GROUP BY doc_id),
        f AS (SELECT part, coalesce(good, false) AS good, coalesce(toxic, false) AS toxic,
                     [len(ws) < 50, 100 * len(list_distinct(ws)) < 65 * len(ws), 100 * length(regexp_replace(t, '[^A-Z]+', '', 'g')) > 5 * length(t), regexp_matches(t, '[#$%&*|]'), coalesce(doc_id > min(doc_id) OVER (PARTITION BY t), false)] AS fails
              FROM w LEFT JOIN l USING (doc_id)),
        m AS (SELECT part, fails, count(*) AS n, count(*) FILTER (good) AS g, count(*) FILTER (toxic) AS x FROM f GROUP BY ALL),
        c AS (SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS c),
        o AS (SELECT concat(p.c, q.c, r.c, s.c, u.c) AS filter_order FROM c p, c q, c r, c s, c u WHERE len(list_distinct([p.c, q.c, r.c, s.c, u.c])) = 5),
        s AS (SELECT filter_order, step, ascii(substr(filter_order, step, 1)) - 64 AS f, list_transform(range(1, step), lambda i: ascii(substr(filter_order, i, 1)) - 64) AS before FROM o CROSS JOIN (SELECT CAST(unnest(range(1, 6)) AS INTEGER) AS step)),
        j AS (SELECT part, filter_order, step, f, n, g, x, fails[f] AS failed, len(list_filter(before, lambda i: fails[i])) > 0 AS gone, len(list_filter(fails, lambda y: y)) = 1 AS single FROM m CROSS JOIN s),
        a AS (SELECT part, filter_order, step, f, coalesce(sum(n) FILTER (NOT failed AND NOT gone), 0) AS kept, coalesce(sum(n) FILTER (failed AND NOT gone), 0) AS removed, coalesce(sum(n) FILTER (failed AND gone), 0) AS redundant,
                     coalesce(sum(n) FILTER (failed AND single), 0) AS unique_fails, coalesce(sum(g) FILTER (failed AND NOT gone), 0) AS good_lost, coalesce(sum(x) FILTER (failed AND NOT gone), 0) AS toxic_lost FROM j GROUP BY ALL)
        SELECT part, filter_order, step, CAST(kept AS BIGINT) AS kept, CAST(removed AS BIGINT) AS removed, CAST(redundant AS BIGINT) AS redundant, CAST(unique_fails AS BIGINT) AS unique_fails,
               CAST(good_lost AS BIGINT) AS good_lost, CAST(toxic_lost AS BIGINT) AS toxic_lost, CAST(sum(removed) OVER (PARTITION BY part, f) AS BIGINT) AS shapley FROM a""",
}
