"""The operators of this subpackage as named queries over whole tables, and their SQL twins."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from ledgerloom.llm import benchmarks, chat, collocations, divergence, language, licenses, mixing, personal, simhash, tokens, urls, vectors, warc
from ledgerloom.llm.common import table


def op1_license_scan(spark: SparkSession, folder: str) -> DataFrame:
    """Licence phrases and labels of every document."""
    return licenses.scanned(table(spark, folder, "documents"), ["doc_id"])


def op2_benchmark_decontamination(spark: SparkSession, folder: str) -> DataFrame:
    """Every benchmark item found in a document, with its place and similarity."""
    return benchmarks.contaminated(table(spark, folder, "documents"), table(spark, folder, "benchmark"), ["doc_id"])


def op3_language_id(spark: SparkSession, folder: str) -> DataFrame:
    """Predicted language of every document."""
    return language.identified(table(spark, folder, "documents"))


def op4_embedding_near_dedup(spark: SparkSession, folder: str) -> DataFrame:
    """Links and near-duplicate group of every vector."""
    return vectors.near_duplicates(table(spark, folder, "embeddings"))


def op5_chat_formatting(spark: SparkSession, folder: str) -> DataFrame:
    """Every conversation, and one made of the template's control strings, formatted and
    read back from the formatted text and its loss mask."""
    rows = table(spark, folder, "conversations").select("conv_id", "turn", "role", "text")
    hard = spark.sql(
        r"""SELECT -7L AS conv_id, turn, role, r'\### Assistant: </turn> ok' AS text
            FROM VALUES (0L, 'user'), (1L, 'assistant') AS t(turn, role)"""
    )
    out = chat.formatted_paths(chat.linear_messages(rows.unionByName(hard)))
    read = out.select(
        F.col("tree").alias("conv_id"),
        chat.read_turns(F.col("formatted")).alias("turns"),
        chat.read_masked(F.col("formatted"), F.col("loss_spans")).alias("masked"),
        F.char_length("formatted").cast("bigint").alias("formatted_chars"),
    )
    said = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return read.select(
        "conv_id",
        F.size("turns").cast("bigint").alias("n_turns"),
        F.sha2(said, 256).alias("turns_sha256"),
        F.char_length("masked").cast("bigint").alias("loss_chars"),
        F.sha2("masked", 256).alias("loss_sha256"),
        "formatted_chars",
    )


OP5_SQL = r"""
WITH rows AS (
    SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
    UNION ALL
    SELECT -7, t.turn, t.role, '\### Assistant: </turn> ok' FROM (VALUES (0, 'user'), (1, 'assistant')) AS t(turn, role)
), sized AS (
    SELECT *, length(role) + length(text)
        + length(regexp_replace(role, '[^\\<#:]', '', 'g')) + length(regexp_replace(text, '[^\\<#:]', '', 'g'))
        + length('### ' || ': ' || ' </turn>' || chr(10)) AS chars
    FROM rows
)
SELECT conv_id, count(*) AS n_turns,
    sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, text)) AS turns_sha256,
    CAST(coalesce(sum(length(text)) FILTER (role = 'assistant'), 0) AS BIGINT) AS loss_chars,
    sha256(coalesce(string_agg(text, '' ORDER BY turn NULLS FIRST, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
    CAST(sum(chars) AS BIGINT) AS formatted_chars
FROM sized GROUP BY conv_id
"""


def op6_source_mixing(spark: SparkSession, folder: str) -> DataFrame:
    """Words taken from every document so that sources meet their target weights."""
    items = mixing.sized_items(table(spark, folder, "documents"))
    rows = mixing.spread(mixing.mixed(items))
    return rows.select("doc_id", "size", "source_size", "target", (F.col("copies") * F.col("size")).alias("taken"))


def op7_simhash_near_dedup(spark: SparkSession, folder: str) -> DataFrame:
    """SimHash fingerprint and near-duplicate group of every document."""
    groups = simhash.near_duplicates(table(spark, folder, "documents"), ["doc_id"])
    return groups.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def op8_url_filter(spark: SparkSession, folder: str) -> DataFrame:
    """Verdict on every page's URL by the longest rule, else by the language models."""
    return urls.judged(table(spark, folder, "pages"))


def op9_warc_archive(spark: SparkSession, folder: str) -> DataFrame:
    """Every page written to WARC archives and read back through their index."""
    return warc.archived(table(spark, folder, "pages")).drop("url")


OP9_SQL = """
WITH hashed AS (
    SELECT page_id, coalesce(html, '') AS html, sha1(coalesce(html, '')) AS sha FROM pages
), firsts AS (
    SELECT *, min(page_id) OVER (PARTITION BY sha) AS first FROM hashed
), digests AS (
    SELECT page_id, octet_length(encode(html)) AS payload_bytes, first,
        list_reduce(list_transform(range(0, 32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
            1 + CAST('0b' || substr(bits, 1 + 5 * i, 5) AS INTEGER), 1)), lambda a, b: a || b) AS payload_digest
    FROM (SELECT *, CAST(CAST(unhex(sha) AS BIT) AS VARCHAR) AS bits FROM firsts)
)
SELECT page_id, payload_bytes, payload_digest,
    CASE WHEN page_id = first THEN 'response' ELSE 'revisit' END AS record_type,
    CASE WHEN page_id <> first THEN first END AS refers_to
FROM digests
"""


def op10_personal_data(spark: SparkSession, folder: str) -> DataFrame:
    """Personal data found in every document."""
    found = personal.found(table(spark, folder, "documents"), ["doc_id"])
    return found.select("doc_id", "n_email", "n_ip", "n_card", "n_phone", F.sha2("base", 256).alias("base_sha256"), "spans")


def op11_source_divergence_audit(spark: SparkSession, folder: str) -> DataFrame:
    """How far the sources of each language differ, and the terms each of them over-uses."""
    return divergence.audited(table(spark, folder, "documents"))


OP11_SQL = r"""
WITH docs AS (
    SELECT row_number() OVER () AS doc, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
        regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
            '[^\x00-\x40\x5B-\x60\x7B-\x7F]+') AS terms
    FROM documents
), terms AS (
    SELECT doc, lang, source, unnest(terms) AS term FROM docs
), kept AS (
    SELECT lang, term FROM terms GROUP BY lang, term HAVING count(DISTINCT doc) >= 10
), counts AS (
    SELECT lang, source, term, count(*) AS n FROM terms SEMI JOIN kept USING (lang, term) GROUP BY ALL
), sizes AS (
    SELECT lang, count(*) AS v FROM kept GROUP BY lang
), groups AS (
    SELECT g.lang, g.source, CAST(coalesce(sum(n), 0) AS HUGEINT) AS total
    FROM (SELECT DISTINCT lang, source FROM docs) g LEFT JOIN counts USING (lang, source) GROUP BY ALL
), own AS (
    SELECT g.lang, g.source, k.term, coalesce(c.n, 0) AS n,
        CAST(1 + (1000000000 * (coalesce(c.n, 0) + 2)) // (g.total + 2 * v) AS HUGEINT) AS p
    FROM groups g JOIN kept k USING (lang) JOIN sizes USING (lang) LEFT JOIN counts c ON (g.lang, g.source, k.term) = (c.lang, c.source, c.term)
), whole AS (
    SELECT lang, term, CAST(1 + (1000000000 * (sum(n) + 2)) // (any_value(total) + 2 * any_value(v)) AS HUGEINT) AS q
    FROM counts JOIN (SELECT lang, sum(total) AS total FROM groups GROUP BY lang) USING (lang) JOIN sizes USING (lang) GROUP BY lang, term
), pairs AS (
    SELECT a.lang, a.source, 'pair' AS part, b.source AS item, coalesce(f.value, 0) AS value
    FROM groups a JOIN groups b ON a.lang = b.lang AND a.source <> b.source
    LEFT JOIN (
        SELECT x.lang, x.source, y.source AS other, sum(((x.p - y.p) * (x.p - y.p)) // (x.p + y.p)) AS value
        FROM own x JOIN own y ON x.lang = y.lang AND x.term = y.term AND x.source <> y.source GROUP BY ALL
    ) f ON (a.lang, a.source, b.source) = (f.lang, f.source, f.other)
), terms_over AS (
    SELECT lang, source, 'term' AS part, term AS item, ((p - q) * (p - q)) // (p + q) AS value
    FROM own JOIN whole USING (lang, term) WHERE n > 0 AND p > q
), ranked AS (
    SELECT *, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) AS rank
    FROM (SELECT * FROM pairs UNION ALL SELECT * FROM terms_over)
)
SELECT lang, source, part, item, CAST(value AS BIGINT) AS value, CAST(rank AS INTEGER) AS rank
FROM ranked WHERE part = 'pair' OR rank <= 10
"""


def op12_phrase_collocations(spark: SparkSession, folder: str) -> DataFrame:
    """The strongest collocations of each language."""
    return collocations.mined(table(spark, folder, "documents"))


OP12_SQL = r"""
WITH docs AS (
    SELECT row_number() OVER () AS doc, coalesce(lang, 'und') AS lang,
        regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]') AS pieces
    FROM documents
), pieces AS (
    SELECT lang, regexp_extract_all(unnest(pieces), '[^\x20\x09]+') AS words FROM docs
), windows AS (
    SELECT lang, words[j:j + 3] AS words FROM (SELECT lang, words, unnest(range(1, len(words) + 1)) AS j FROM pieces)
), sizes AS (
    SELECT lang, sum(len(words)) AS n FROM pieces GROUP BY lang
), grams AS (
    SELECT lang, k, words[1:k] AS words, count(*) AS f
    FROM windows CROSS JOIN (VALUES (1), (2), (3), (4)) AS t(k) WHERE k <= len(words) GROUP BY ALL HAVING count(*) >= 30
), counts AS (
    SELECT lang, k, words, array_to_string(words, ' ') AS phrase, f FROM grams
), cuts AS (
    SELECT lang, k, words, phrase, f AS a, unnest(range(1, k)) AS cut FROM counts WHERE k > 1
), parts AS (
    SELECT *, array_to_string(words[1:cut], ' ') AS head, array_to_string(words[cut + 1:k], ' ') AS rest FROM cuts
), valued AS (
    SELECT p.lang, p.phrase, p.a, p.cut, x.f AS l, y.f AS r, (CAST(2000000 AS HUGEINT) * p.a) // (x.f + y.f) AS score
    FROM parts p JOIN counts x ON x.lang = p.lang AND x.phrase = p.head JOIN counts y ON y.lang = p.lang AND y.phrase = p.rest
), scored AS (
    SELECT * FROM valued QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, cut) = 1
), firsts AS (
    SELECT lang, words, k, f, unnest(range(1, k)) AS i FROM counts WHERE k > 2
), inside AS (
    SELECT lang, array_to_string(words[i:i + m - 1], ' ') AS phrase, max(f) AS longer
    FROM (SELECT *, unnest(range(2, k)) AS m FROM firsts) WHERE i + m - 1 <= k GROUP BY ALL
), kept AS (
    SELECT s.* FROM scored s LEFT JOIN inside USING (lang, phrase)
    WHERE coalesce(100 * CAST(longer AS HUGEINT) < 80 * CAST(a AS HUGEINT), true)
)
SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank,
    phrase, a, l, r, CAST(n AS BIGINT) AS n, CAST(score AS BIGINT) AS score
FROM kept JOIN sizes USING (lang) QUALIFY rank <= 2000
"""


def op13_token_ids(spark: SparkSession, folder: str) -> DataFrame:
    """Token ids of every document, written to files and read back."""
    return tokens.round_trip(table(spark, folder, "documents"))


BUILDERS = {
    "op1_license_scan": op1_license_scan,
    "op2_benchmark_decontamination": op2_benchmark_decontamination,
    "op3_language_id": op3_language_id,
    "op4_embedding_near_dedup": op4_embedding_near_dedup,
    "op5_chat_formatting": op5_chat_formatting,
    "op6_source_mixing": op6_source_mixing,
    "op7_simhash_near_dedup": op7_simhash_near_dedup,
    "op8_url_filter": op8_url_filter,
    "op9_warc_archive": op9_warc_archive,
    "op10_personal_data": op10_personal_data,
    "op11_source_divergence_audit": op11_source_divergence_audit,
    "op12_phrase_collocations": op12_phrase_collocations,
    "op13_token_ids": op13_token_ids,
}
SQL = {
    "op5_chat_formatting": OP5_SQL,
    "op9_warc_archive": OP9_SQL,
    "op11_source_divergence_audit": OP11_SQL,
    "op12_phrase_collocations": OP12_SQL,
}
