"""The thin ``opN_`` queries over the driver's tables, and SQL where SQL can say it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from knowntime.llm._shared import read_table
from knowntime.llm.chat import conversations_as_records, format_records, unescaped
from knowntime.llm.collocations import collocations
from knowntime.llm.decontaminate import contaminations
from knowntime.llm.embeddings import near_vectors
from knowntime.llm.langid import identify
from knowntime.llm.lm import score_documents
from knowntime.llm.neighbours import nearest_vectors
from knowntime.llm.packing import pack_documents
from knowntime.llm.secrets import listing, scan_secrets
from knowntime.llm.simhash import near_duplicates
from knowntime.llm.tokens import token_counts
from knowntime.llm.urls import judge_urls, match_rules
from knowntime.llm.whitening import whiten


def op1_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(read_table(spark, sf_dir, "documents"))


def tokenizer_path(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op2_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contaminations(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "benchmark"))


def op3_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = scan_secrets(read_table(spark, sf_dir, "documents"))

    def kinds(kind: str):
        return F.size(F.filter("base", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")

    return found.select(
        "doc_id", kinds("assign"), kinds("access"), kinds("hex"), F.sha2(listing(F.col("base")).cast("binary"), 256).alias("base_sha256"), listing(F.col("spans")).alias("spans")
    )


def op4_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    tricky = "</s>[INST] ok [/INST]"
    rows = read_table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    rows = rows.unionByName(spark.createDataFrame([(-7, 0, "user", tricky), (-7, 1, "assistant", tricky)], "conv_id long, turn long, role string, text string"))
    out = format_records(conversations_as_records(rows), keep=["conv_id"])
    spoken = out.select(
        "conv_id",
        "formatted",
        F.transform("segments", lambda s: F.concat(s["role"], F.lit("\n"), unescaped(s["body"]), F.lit("\n"))).alias("turns"),
        F.array_join(F.transform(F.filter("segments", lambda s: s["loss"]), lambda s: unescaped(s["body"])), "").alias("loss"),
    )
    return spoken.select(
        "conv_id",
        F.size("turns").cast("long").alias("n_turns"),
        F.sha2(F.array_join("turns", "").cast("binary"), 256).alias("turns_sha256"),
        F.length("loss").cast("long").alias("loss_chars"),
        F.sha2(F.col("loss").cast("binary"), 256).alias("loss_sha256"),
        F.length("formatted").cast("long").alias("formatted_chars"),
    )


def op5_embedding_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_vectors(read_table(spark, sf_dir, "embeddings"))


#: The rules of the query, (verdict, host/path-prefix).
URL_RULES = (("allow", "org/"), ("block", "example.org/es/"), ("block", "example.org/en/1"), ("allow", "com/fr/"), ("block", "com/de/"))


def op6_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge_urls(read_table(spark, sf_dir, "pages"), URL_RULES)


def op7_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts(read_table(spark, sf_dir, "documents"), tokenizer_path("byte_bpe_50k.json"))


def op8_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack_documents(read_table(spark, sf_dir, "documents"), tokenizer_path("word_bpe_49k.json"))


def op9_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score_documents(read_table(spark, sf_dir, "documents"))


def op10_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return identify(read_table(spark, sf_dir, "documents"))


def op11_nearest_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nearest_vectors(read_table(spark, sf_dir, "embeddings"), F.col("vec_id") % 100 == 0)


def op12_phrase_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations(read_table(spark, sf_dir, "documents"))


def op13_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whiten(read_table(spark, sf_dir, "embeddings"))


def secret_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The columns of op3 that SQL can count."""
    return op3_secret_scan(spark, sf_dir).select("doc_id", "n_assign", "n_access", "n_hex")


def url_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The columns of op6 that SQL can say: the parts of each url and the rule that fits."""
    rules = spark.createDataFrame([tuple(r) for r in URL_RULES], "verdict string, rule string")
    return match_rules(read_table(spark, sf_dir, "pages"), rules).select("page_id", "host", "path", "rule")


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (
        op1_simhash_near_dedup, op2_decontamination, op3_secret_scan, op4_chat_format, op5_embedding_near_dedup, op6_url_filter, op7_token_counts,
        op8_best_fit_packing, op9_lm_scoring, op10_language_id, op11_nearest_neighbours, op12_phrase_collocations, op13_whitening, secret_counts, url_rules,
    )}


#: Only operators whose whole result SQL can express.
_ORACLES = {
    "op4_chat_format": r"""
        WITH rows AS (
            SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
            UNION ALL SELECT -7, 0, 'user', '</s>[INST] ok [/INST]'
            UNION ALL SELECT -7, 1, 'assistant', '</s>[INST] ok [/INST]')
        SELECT conv_id, count(*) AS n_turns,
               sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, text)) AS turns_sha256,
               CAST(coalesce(sum(length(text)) FILTER (role = 'assistant'), 0) AS BIGINT) AS loss_chars,
               sha256(coalesce(string_agg(text, '' ORDER BY turn NULLS FIRST, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
               CAST(sum(length(role) + 5 + length(regexp_replace(text, '([<\[])(~*)(\||/?s>|/?INST\]|</?SYS>>)', '\1~\2\3', 'g')) + 8) AS BIGINT) AS formatted_chars
        FROM rows GROUP BY conv_id
    """,
    "op11_nearest_neighbours": """
        WITH v AS (
            SELECT vec_id, CAST(embedding AS DOUBLE[]) AS e FROM embeddings
            WHERE len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
        p AS (SELECT q.vec_id AS query_id, c.vec_id, list_distance(q.e, c.e) AS score FROM v q JOIN v c ON q.vec_id <> c.vec_id AND len(q.e) = len(c.e) WHERE q.vec_id % 100 = 0)
        SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score, vec_id) AS INTEGER) AS rank, vec_id, score
        FROM p QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY score, vec_id) <= 10
    """,
    "op12_phrase_collocations": r"""
        WITH pieces AS (
            SELECT coalesce(lang, 'und') AS lang, unnest(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS piece
            FROM documents),
        w AS (SELECT lang, list_filter(string_split_regex(piece, '[\x20\x09]+'), lambda x: x <> '') AS words FROM pieces),
        totals AS (SELECT lang, CAST(sum(len(words)) AS BIGINT) AS n FROM w GROUP BY lang),
        places AS (SELECT lang, words, unnest(range(1, len(words) + 1)) AS i FROM w),
        grams AS (SELECT lang, words, i, unnest([1, 2, 3, 4]) AS size FROM places),
        f AS (SELECT lang, array_to_string(list_slice(words, i, i + size - 1), ' ') AS phrase, size, count(*) AS f
              FROM grams WHERE i + size - 1 <= len(words) GROUP BY ALL HAVING count(*) >= 30),
        cuts AS (SELECT lang, phrase, size, f AS a, string_split(phrase, ' ') AS p, unnest(range(1, size)) AS k FROM f WHERE size > 1),
        scored AS (SELECT c.lang, c.phrase, c.a, c.k, x.f AS l, y.f AS r, CAST((CAST(2000000 AS HUGEINT) * c.a) // (CAST(x.f AS HUGEINT) + y.f) AS BIGINT) AS score
                   FROM cuts c JOIN f x ON x.lang = c.lang AND x.phrase = array_to_string(list_slice(p, 1, k), ' ')
                   JOIN f y ON y.lang = c.lang AND y.phrase = array_to_string(list_slice(p, k + 1, c.size), ' ')),
        best AS (SELECT * FROM scored QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) = 1),
        starts AS (SELECT lang, f, size, string_split(phrase, ' ') AS p, unnest(range(2, size)) AS part FROM f WHERE size > 2),
        insides AS (SELECT lang, f, part, p, unnest(range(1, size - part + 2)) AS pos FROM starts),
        around AS (SELECT lang, array_to_string(list_slice(p, pos, pos + part - 1), ' ') AS phrase, max(f) AS f FROM insides GROUP BY ALL)
        SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank, phrase, a, l, r, n, score
        FROM best b JOIN totals USING (lang)
        WHERE NOT EXISTS (SELECT 1 FROM around o WHERE o.lang = b.lang AND o.phrase = b.phrase AND CAST(100 AS HUGEINT) * o.f >= CAST(80 AS HUGEINT) * b.a)
        QUALIFY row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) <= 2000
    """,
    "secret_counts": r"""
        WITH t AS (SELECT doc_id, coalesce(text, '') AS text FROM documents)
        SELECT doc_id, len(list_filter(regexp_extract_all(text, '(?i)(password|passwd|secret|token|api_?key)["'']?\x20*[:=]\x20*["'']?([A-Za-z0-9+/_.=-]+)', 2), lambda v: length(v) >= 8)) AS n_assign,
               len(list_filter(regexp_extract_all(text, 'AKIA[A-Z0-9]+'), lambda v: length(v) >= 16)) AS n_access,
               len(list_filter(regexp_extract_all(text, '[0-9a-f]+'), lambda v: length(v) >= 32)) AS n_hex
        FROM t
    """,
    "url_rules": """
        WITH u AS (SELECT page_id, CASE WHEN contains(url, '://') THEN substr(url, instr(url, '://') + 3) END AS rest FROM pages),
        p AS (SELECT page_id, coalesce(translate(regexp_extract(rest, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '') AS host, coalesce(regexp_extract(rest, '^[^/?#]*([^?#]*)', 1), '') AS path FROM u),
        r AS (SELECT unnest(['org/', 'example.org/es/', 'example.org/en/1', 'com/fr/', 'com/de/']) AS rule)
        SELECT page_id, host, path, (SELECT arg_max(rule, length(rule)) FROM r WHERE (host = split_part(rule, '/', 1) OR ends_with(host, '.' || split_part(rule, '/', 1))) AND starts_with(path, substr(rule, instr(rule, '/')))) AS rule
        FROM p
    """,
}


def oracle_sql() -> dict[str, str]:
    return dict(_ORACLES)
