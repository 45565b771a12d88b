"""The registered queries of the text operators, and their SQL where SQL can express them."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from foretally.llm import bpe, decontam, html, lexical, periods, pii, quality, repeats, simhash, topk, toxicity, urls, warc
from foretally.llm.common import table


def op1_toxicity(spark: SparkSession, folder: str) -> DataFrame:
    return toxicity.judged(table(spark, folder, "documents"), table(spark, folder, "labels"))


def op2_pii(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents")
    return pii.detect(docs, pii.fit(docs))


def op3_url_filter(spark: SparkSession, folder: str) -> DataFrame:
    return urls.judge_urls(table(spark, folder, "pages"))


def op4_decontaminate(spark: SparkSession, folder: str) -> DataFrame:
    return decontam.judged(table(spark, folder, "documents"), table(spark, folder, "benchmark"))


def op5_top_k(spark: SparkSession, folder: str) -> DataFrame:
    vectors = table(spark, folder, "embeddings")
    return topk.top_k(vectors, vectors.where(F.col("vec_id") % 50 == 0))


def op6_warc(spark: SparkSession, folder: str) -> DataFrame:
    return warc.round_trip(table(spark, folder, "pages"), spark)


def op7_html_text(spark: SparkSession, folder: str) -> DataFrame:
    return html.main_texts(table(spark, folder, "pages"))


def op8_quality(spark: SparkSession, folder: str) -> DataFrame:
    return quality.judged(table(spark, folder, "documents"), table(spark, folder, "labels"))


def op9_simhash(spark: SparkSession, folder: str) -> DataFrame:
    found = simhash.near_duplicates(table(spark, folder, "documents"))
    return found.select("doc_id", simhash.hex_digits(F.col("print")).alias("fingerprint"), "component_id")


def op10_bpe(spark: SparkSession, folder: str) -> DataFrame:
    return bpe.encoded(table(spark, folder, "documents"), public_tokenizers.path("byte_bpe_50k.json"))


def op11_periodic_runs(spark: SparkSession, folder: str) -> DataFrame:
    return periods.digests(periods.collapsed(table(spark, folder, "documents"), periods.planted))


def op12_ranked_search(spark: SparkSession, folder: str) -> DataFrame:
    return lexical.ranked_search(table(spark, folder, "documents"), table(spark, folder, "benchmark"))


def op13_repeated_passages(spark: SparkSession, folder: str) -> DataFrame:
    cut = repeats.deduplicated(table(spark, folder, "documents"))
    return cut.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))


def queries() -> dict:
    import corpus_pipeline  # which imports this package itself

    named = (
        op1_toxicity,
        op2_pii,
        op3_url_filter,
        op4_decontaminate,
        op5_top_k,
        op6_warc,
        op7_html_text,
        op8_quality,
        op9_simhash,
        op10_bpe,
        op11_periodic_runs,
        op12_ranked_search,
        op13_repeated_passages,
    )
    return {query.__name__: query for query in named} | {"pipeline": corpus_pipeline.run}


# Each statement computes its query's rows over the whole table by a plain path of its own.
_TERM_EDGE = "[^a-z0-9]"


def _url_sql() -> str:
    def hit(term: str) -> str:
        return f"regexp_matches(low, '(^|{_TERM_EDGE}){term}($|{_TERM_EDGE})')::INT"

    fits = [
        (f"(host = '{host}' OR ends_with(host, '.{host}')) AND starts_with(path, '{path}')", host + path, action)
        for host, path, action in urls.RULES
    ]
    found = ", ".join(
        f"CASE WHEN {fit} THEN {{'n': {len(name)}, 'rule': '{name}', 'action': '{action}'}} END" for fit, name, action in fits
    )
    strict, soft = (" + ".join(hit(term) for term in terms) for terms in (urls.STRICT_TERMS, urls.SOFT_TERMS))
    return f"""
        WITH parts AS (
            SELECT page_id,
                   translate(coalesce(url, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS low,
                   translate(regexp_extract(coalesce(url, ''), '(?s)^.*?://([^/?#]*)', 1),
                             'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
                   regexp_extract(coalesce(url, ''), '(?s)^.*?://[^/?#]*([^?#]*)', 1) AS path
            FROM pages
        ), judged AS (
            SELECT page_id, host, path, list_max(list_filter([{found}], lambda x: x IS NOT NULL)) AS best,
                   {strict} AS n_strict, {soft} AS n_soft
            FROM parts
        )
        SELECT page_id, host, path, best.rule AS rule,
               coalesce(best.action, CASE WHEN n_strict > 0 OR n_soft >= {urls.SOFT_HITS} THEN 'block' ELSE 'allow' END) AS verdict,
               n_strict, n_soft
        FROM judged
    """


_TOP_K_SQL = """
    WITH usable AS (
        SELECT vec_id, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)::BIGINT) AS parts
        FROM embeddings
        WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
    ), scored AS (
        SELECT q.vec_id AS query_id, c.vec_id, list_sum(list_transform(list_zip(q.parts, c.parts), lambda p: p[1] * p[2]))::BIGINT AS score
        FROM usable q JOIN usable c ON q.vec_id % 50 = 0 AND q.vec_id <> c.vec_id AND len(q.parts) = len(c.parts)
    )
    SELECT query_id, row_number() OVER best AS rank, vec_id, score
    FROM scored
    WINDOW best AS (PARTITION BY query_id ORDER BY score DESC, vec_id)
    QUALIFY rank <= 5
"""

_WARC_SQL = """
    WITH payloads AS (
        SELECT page_id, strlen(coalesce(html, '')) AS payload_bytes, coalesce(html, '') AS payload,
               max(page_id) OVER (PARTITION BY coalesce(html, '')) AS keep
        FROM pages
    )
    SELECT page_id, payload_bytes, sha1(payload) AS payload_digest,
           CASE WHEN payload_bytes >= 1000 AND page_id <> keep THEN 'revisit' ELSE 'response' END AS record_type,
           CASE WHEN payload_bytes >= 1000 AND page_id <> keep THEN keep END AS refers_to
    FROM payloads
"""

# crc32 has no function there: eight shifts for each byte of the decimal id
_CRC32 = """xor(4294967295, list_reduce(
    list_prepend(4294967295::BIGINT, list_transform(range(1, len(doc_id::VARCHAR) + 1), lambda i: ascii(substring(doc_id::VARCHAR, i, 1))::BIGINT)),
    lambda c, b: list_reduce(list_prepend(xor(c, b), range(8)), lambda x, k: CASE WHEN x % 2 = 1 THEN xor(x // 2, 3988292384) ELSE x // 2 END)))"""

_RUNS_SQL = rf"""
    WITH given AS (
        SELECT row_number() OVER () AS row, doc_id, {_CRC32} AS h,
               regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS words
        FROM documents
    ), tails AS (
        SELECT row, doc_id, words, len(words) AS n, (h // 10) % len(words) AS a, h,
               1 + (len(words) - (h // 10) % len(words)) // (3 + (h // 10) % 8) AS p
        FROM given WHERE len(words) > 0
    ), placed AS (
        SELECT row, n, unnest(words) AS own, unnest(range(n)) AS i, a, p, h % 10 = 0 AND h IS NOT NULL AS tail FROM tails
    ), words AS MATERIALIZED (
        SELECT w.row, w.n, w.i, o.own AS word
        FROM placed w JOIN placed o ON w.row = o.row AND o.i = CASE WHEN w.tail AND w.i >= w.a THEN w.a + (w.i - w.a) % w.p ELSE w.i END
    ), equal AS (
        SELECT a.row, a.i, b.i - a.i AS period
        FROM words a JOIN words b ON a.row = b.row AND a.word = b.word AND b.i > a.i AND b.i - a.i <= a.n // 4
    ), stretches AS (
        SELECT row, period, min(i) AS start, count(*) + period AS length
        FROM (SELECT row, period, i, i - row_number() OVER (PARTITION BY row, period ORDER BY i) AS island FROM equal)
        GROUP BY row, period, island
        HAVING count(*) + period >= greatest(6, 4 * period)
    ), runs AS (
        SELECT row, start, length, min(period) AS period FROM stretches GROUP BY row, start, length
    ), dropped AS (
        SELECT DISTINCT row, unnest(range(start + period, start + length)) AS i FROM runs
    ), listed AS (
        SELECT row, count(*) AS n_runs, first({{'start': start, 'length': length, 'period': period}} ORDER BY length DESC, start, period) AS best,
               string_agg(start || ',' || length || ',' || period || chr(10), '' ORDER BY start, period) AS lines
        FROM runs GROUP BY row
    ), kept AS (
        SELECT row, string_agg(word, ' ' ORDER BY i) AS text FROM words ANTI JOIN dropped USING (row, i) GROUP BY row
    )
    SELECT doc_id, coalesce(n_runs, 0) AS n_runs, best.start AS start, best.length AS length, best.period AS period,
           (1000 * best.length) // best.period AS exponent_milli,
           sha256(coalesce(lines, '')) AS runs_sha256, sha256(coalesce(kept.text, '')) AS collapsed_sha256
    FROM given LEFT JOIN listed USING (row) LEFT JOIN kept USING (row)
"""

_RANKED_SQL = r"""
    WITH words AS (
        SELECT row_number() OVER () AS row, doc_id, regexp_extract_all(
            translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS terms
        FROM documents
    ), documents_ AS (
        SELECT row, doc_id, terms, len(terms) AS n FROM words WHERE len(terms) > 0
    ), total AS (
        SELECT count(*) AS docs, sum(n)::BIGINT AS length FROM documents_
    ), frequency AS (
        SELECT row, doc_id, n, term, count(*) AS tf FROM (SELECT row, doc_id, n, unnest(terms) AS term FROM documents_) GROUP BY ALL
    ), asked AS (
        SELECT item_id, term, count(*) AS n FROM (
            SELECT item_id, unnest(regexp_extract_all(
                translate(min(text), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term
            FROM benchmark WHERE item_id IS NOT NULL GROUP BY item_id)
        GROUP BY ALL
    ), weight AS (
        SELECT term, floor(1000 * ln((2 * any_value(docs) + 2)::DOUBLE / (2 * count(*) + 1)::DOUBLE))::BIGINT AS w
        FROM frequency, total GROUP BY term
    ), scored AS (
        SELECT item_id, row, doc_id, sum(a.n * w * ((1000000000 * tf) // (1000 * tf + 12 * (100 - 25 + (25 * f.n * docs) // length))))::BIGINT AS score
        FROM asked a JOIN frequency f USING (term) JOIN weight USING (term), total
        WHERE doc_id IS NOT NULL
        GROUP BY item_id, row, doc_id
    )
    SELECT item_id, row_number() OVER best AS rank, doc_id, score
    FROM scored WHERE score > 0
    WINDOW best AS (PARTITION BY item_id ORDER BY score DESC, doc_id)
    QUALIFY rank <= 20
"""

_REPEATS_SQL = """
    WITH texts AS (
        SELECT row_number() OVER () AS row, doc_id, hex(encode(coalesce(text, ''))) AS digits FROM documents
    ), blocks AS (  -- blocks of the strings that start in 400 bytes: a substring costs what stands before it
        SELECT row, doc_id, base, substring(digits, 2 * base + 1, 898) AS part
        FROM (SELECT row, doc_id, digits, unnest(range(0, len(digits) // 2 - 49, 400)) AS base FROM texts)
    ), strings AS (
        SELECT row, doc_id, base + place AS start, md5(substring(part, 2 * place + 1, 100)) AS string
        FROM (SELECT row, doc_id, base, part, unnest(range(len(part) // 2 - 49)) AS place FROM blocks)
    ), firsts AS (
        SELECT string, min(doc_id) AS least FROM strings GROUP BY string
    ), repeated AS (
        SELECT row, start, lag(start) OVER (PARTITION BY row ORDER BY start) AS before
        FROM strings JOIN firsts USING (string) WHERE doc_id > least
    ), spans AS (
        SELECT row, min(start) AS start, max(start) + 50 AS stop
        FROM (SELECT row, start, count(*) FILTER (WHERE before IS NULL OR before + 50 < start) OVER (PARTITION BY row ORDER BY start) AS span
              FROM repeated)
        GROUP BY row, span
    ), cut AS (
        SELECT row, sum(stop - start)::BIGINT AS n_removed, count(*) AS n_spans,
               list_prepend(0, list(stop ORDER BY start)) AS begins, list(start ORDER BY start) AS ends
        FROM spans GROUP BY row
    )
    SELECT doc_id, len(digits) // 2 AS n_bytes, coalesce(n_removed, 0) AS n_removed, coalesce(n_spans, 0) AS n_spans,
           sha256(unhex(CASE WHEN begins IS NULL THEN digits ELSE array_to_string(list_transform(
               list_zip(begins, list_append(ends, len(digits) // 2)),
               lambda p: substring(digits, 2 * p[1] + 1, 2 * (p[2] - p[1]))), '') END)) AS kept_sha256
    FROM texts LEFT JOIN cut USING (row)
"""


def oracle_sql() -> dict[str, str]:
    return {"op3_url_filter": _url_sql(), "op5_top_k": _TOP_K_SQL, "op6_warc": _WARC_SQL, "op11_periodic_runs": _RUNS_SQL, "op12_ranked_search": _RANKED_SQL, "op13_repeated_passages": _REPEATS_SQL}
