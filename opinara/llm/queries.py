"""The operators of this subpackage bound to the test tables, and their DuckDB SQL."""

from __future__ import annotations

from collections.abc import Callable
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from opinara.llm import (
    bpe,
    chat_format,
    decontamination,
    fill_middle,
    html_text,
    lexical_search,
    quality_knn,
    quality_rules,
    secrets_crf,
    toxicity,
    url_filter,
    warc,
)
from opinara.llm.jaccard_join import jaccard_components
from opinara.session import shared_dir

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def registered(name: str, sql: str | None = None):
    """Register a query; workers of a local session started elsewhere also find this package."""

    def wrap(f: Callable[[SparkSession, str], DataFrame]):
        def query(spark: SparkSession, sf_dir: str) -> DataFrame:
            spark.sparkContext.environment.setdefault(
                "PYTHONPATH", str(Path(__file__).resolve().parents[2])
            )
            return f(spark, sf_dir)

        QUERIES[name] = query
        if sql:
            ORACLE[name] = sql
        return query

    return wrap


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


@registered("op9_ngram_jaccard_join")
def op9(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_components(table(spark, sf_dir, "documents"))


# The rules to apply, host, path and verdict.
URL_RULES = [
    ("org", "/", "allow"),
    ("example.org", "/es/", "block"),
    ("example.org", "/en/1", "block"),
    ("com", "/fr/", "allow"),
    ("com", "/de/", "block"),
]

_PARTS = """
    SELECT page_id,
        translate(coalesce(regexp_extract(url, '^.*?://([^/?#]*)', 1, 's'), ''),
            'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
        coalesce(regexp_extract(url, '^.*?://[^/?#]*([^?#]*)', 1, 's'), '') AS path
    FROM pages
"""


@registered(
    "op2_url_filters",
    f"""
    WITH rules(rule_host, rule_path, rule_verdict) AS (VALUES
        {", ".join(map(str, URL_RULES))}
    ), parts AS ({_PARTS})
    SELECT page_id, host, path, rule, coalesce(verdict, 'allow') AS verdict
    FROM parts LEFT JOIN LATERAL (
        SELECT rule_host || rule_path AS rule, rule_verdict AS verdict FROM rules
        WHERE (host = rule_host OR ends_with(host, '.' || rule_host))
            AND starts_with(path, rule_path)
        ORDER BY length(rule_host || rule_path) DESC, length(rule_host) DESC LIMIT 1
    ) ON true
    """,
)
def op2(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages").select(F.col("page_id").alias("id"), "url")
    rules = spark.createDataFrame(URL_RULES, "host string, path string, verdict string")
    return url_filter.filter_urls(pages, rules).withColumnRenamed("id", "page_id")


def tokenizer_path(name: str = "byte_bpe_50k.json") -> str:
    import public_tokenizers

    return str(public_tokenizers.path(name))


@registered("op4_bpe")
def op4(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.encode_digest(table(spark, sf_dir, "documents"), tokenizer_path())


@registered("op10_quality_rules")
def op10(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules.judge(table(spark, sf_dir, "documents"))


@registered(
    "op5_warc",
    """
    WITH p AS (
        SELECT page_id, strlen(coalesce(html, '')) AS payload_bytes,
            sha1(coalesce(html, '')) AS payload_digest
        FROM pages
    ), g AS (
        SELECT payload_digest, payload_bytes, max(page_id) AS first FROM p
        WHERE payload_bytes >= 1000 GROUP BY ALL
    )
    SELECT page_id, payload_bytes, payload_digest,
        CASE WHEN first <> page_id THEN 'revisit' ELSE 'response' END AS record_type,
        CASE WHEN first <> page_id THEN first END AS refers_to
    FROM p LEFT JOIN g USING (payload_digest, payload_bytes)
    """,
)
def op5(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = shared_dir(spark, "warc")
    warc.write(table(spark, sf_dir, "pages"), path)
    return warc.read(spark, path)


@registered("op8_html_extraction")
def op8(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_text.extract(table(spark, sf_dir, "pages"))


@registered("op3_quality_classifier")
def op3(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_knn.classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


@registered("op7_toxicity")
def op7(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


@registered("op6_secret_scans")
def op6(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return secrets_crf.scan(docs, secrets_crf.fit(docs))


@registered("op1_benchmark_decontamination")
def op1(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontamination.contaminated(
        table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")
    )


@registered(
    "op11_fill_in_middle",
    """
    WITH d AS (
        SELECT doc_id, coalesce(text, '') AS text, sha256('1:' || doc_id) AS h FROM documents
    ), u AS (
        SELECT doc_id, text, regexp_extract_all(text, '[A-Za-z]+|[^A-Za-z]') AS t,
            CAST('0x' || substr(h, 1, 8) AS BIGINT) AS h1, CAST('0x' || substr(h, 9, 8) AS BIGINT) AS h2,
            CAST('0x' || substr(h, 17, 8) AS BIGINT) AS h3, CAST('0x' || substr(h, 25, 8) AS BIGINT) AS h4
        FROM d
    ), c AS (
        SELECT *, len(t) AS n, least(h1 % (len(t) + 1), h2 % (len(t) + 1)) AS one,
            greatest(h1 % (len(t) + 1), h2 % (len(t) + 1)) AS two,
            CASE WHEN text = '' OR contains(text, '<P>') OR contains(text, '<S>')
                OR contains(text, '<M>') OR h3 % 100 >= 90 THEN 'plain'
                WHEN h4 % 100 < 20 THEN 'spm' ELSE 'psm' END AS form
        FROM u
    ), p AS (
        SELECT *, array_to_string(list_slice(t, 1, one), '') AS pre,
            array_to_string(list_slice(t, one + 1, two), '') AS mid,
            array_to_string(list_slice(t, two + 1, n), '') AS suf
        FROM c
    )
    SELECT doc_id, n, form,
        CASE WHEN form <> 'plain' THEN length(pre) END AS prefix_chars,
        CASE WHEN form <> 'plain' THEN length(mid) END AS middle_chars,
        sha256(CASE form WHEN 'plain' THEN text
            WHEN 'psm' THEN '<P>' || pre || '<S>' || suf || '<M>' || mid
            ELSE '<S>' || suf || '<P>' || pre || '<M>' || mid END) AS output_sha256,
        sha256(text) AS restored_sha256
    FROM p
    """,
)
def op11(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fill_middle.digest(table(spark, sf_dir, "documents"))


CONTROL_TEXT = "</s>[INST] ok [/INST]"


@registered(
    "op12_chat_formatting",
    r"""
    WITH t AS (
        SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text
        FROM conversations
        UNION ALL SELECT -1, 0, 'user', '</s>[INST] ok [/INST]'
        UNION ALL SELECT -1, 1, 'assistant', '</s>[INST] ok [/INST]'
    ), e AS (
        SELECT *, length(regexp_replace(text, p, '\1\\\2', 'g')) AS text_chars,
            length(regexp_replace(role, p, '\1\\\2', 'g')) AS role_chars
        FROM t, (SELECT '([<\[])(\\*/?(s>|INST\]|TURN\]|BODY\]))' AS p)
    )
    SELECT conv_id, count(*) AS n_turns,
        sha256(string_agg(role || chr(10) || text || chr(10), ''
            ORDER BY turn NULLS FIRST, role, text)) AS turns_sha256,
        CAST(coalesce(sum(length(text)) FILTER (role = 'assistant'), 0) AS BIGINT) AS loss_chars,
        sha256(coalesce(string_agg(text, '' ORDER BY turn NULLS FIRST, role, text)
            FILTER (role = 'assistant'), '')) AS loss_sha256,
        CAST(sum(text_chars + CASE role WHEN 'user' THEN 13 WHEN 'assistant' THEN 7
            ELSE 19 + role_chars END) AS BIGINT) AS formatted_chars
    FROM e GROUP BY conv_id
    """,
)
def op12(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    control = spark.createDataFrame(
        [(-1, 0, "user", CONTROL_TEXT), (-1, 1, "assistant", CONTROL_TEXT)], turns.schema
    )
    return chat_format.digest(chat_format.format_conversations(turns.unionByName(control)))


@registered(
    "op13_lexical_search",
    r"""
    WITH words AS (
        SELECT doc_id, unnest(regexp_extract_all(
            translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), p)) AS term
        FROM documents, (SELECT '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+' AS p)
    ), size AS (
        SELECT doc_id, count(*) AS n FROM words GROUP BY doc_id
    ), whole AS (
        SELECT count(*) AS docs, CAST(sum(n) AS BIGINT) AS total FROM size
    ), asked AS (
        SELECT DISTINCT item_id, unnest(regexp_extract_all(
            translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), p)) AS term
        FROM benchmark, (SELECT '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+' AS p)
    ), posting AS (
        SELECT doc_id, term, count(*) AS tf FROM words
        WHERE term IN (SELECT term FROM asked) GROUP BY ALL
    ), weight AS (
        SELECT term, CAST(floor(1000 * ln((2 * docs + 2)::DOUBLE / (2 * count(*) + 1))) AS BIGINT) AS w
        FROM posting, whole GROUP BY term, docs
    ), impact AS (
        SELECT doc_id, term,
            w * ((1000000000 * tf) // (1000 * tf + 20 * (50 + (50 * n * docs) // total))) AS x
        FROM posting JOIN weight USING (term) JOIN size USING (doc_id), whole
    ), scored AS (
        SELECT item_id, doc_id, CAST(sum(x) AS BIGINT) AS score
        FROM asked JOIN impact USING (term) GROUP BY item_id, doc_id HAVING sum(x) > 0
    )
    SELECT item_id, CAST(row_number() OVER (
            PARTITION BY item_id ORDER BY score DESC, doc_id) AS INTEGER) AS rank, doc_id, score
    FROM scored
    QUALIFY row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) <= 50
    """,
)
def op13(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lexical_search.ranked(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
