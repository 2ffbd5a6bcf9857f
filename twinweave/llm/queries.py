"""The operators as registered queries with production parameters."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from twinweave.llm.collocations import collocations
from twinweave.llm.exact_dedup import exact_dedup
from twinweave.llm.html_extraction import extract
from twinweave.llm.language_id import identify, train
from twinweave.llm.line_dedup import MIN_WORDS, line_dedup
from twinweave.llm.mixing import mix
from twinweave.llm.ngram_join import jaccard_components
from twinweave.llm.packing import pack
from twinweave.llm.ranked_search import ranked_search
from twinweave.llm.secret_scan import secret_digest, secret_scan
from twinweave.llm.token_counts import token_counts
from twinweave.llm.topk import exact_top_k
from twinweave.llm.url_filter import ASIDE, url_filter
from twinweave.runtime import table


def tokenizer_path(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts(table(spark, sf_dir, "documents"), tokenizer_path("byte_bpe_50k.json"))


def op2_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix(table(spark, sf_dir, "documents"))


def op3_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract(table(spark, sf_dir, "pages"))


def op4_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_dedup(table(spark, sf_dir, "documents"))


def op5_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup(table(spark, sf_dir, "documents"))


def op6_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filter(table(spark, sf_dir, "pages"))


def op7_exact_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_top_k(table(spark, sf_dir, "embeddings"))


def op8_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(table(spark, sf_dir, "documents"), tokenizer_path("word_bpe_49k.json"))


def op9_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_components(table(spark, sf_dir, "documents"))


def op10_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return identify(docs, train(docs))


def op11_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations(table(spark, sf_dir, "documents"))


def op12_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secret_digest(secret_scan(table(spark, sf_dir, "documents")))


def op13_ranked_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ranked_search(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


QUERIES = {
    f.__name__: f
    for f in (op1_token_counts, op2_mixing, op3_html_extraction, op4_line_dedup, op5_exact_dedup, op6_url_filter, op7_exact_top_k, op8_packing, op9_ngram_join, op10_language_id, op11_collocations, op12_secret_scan, op13_ranked_search)
}

_ABC, _abc = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

ORACLE_SQL = {
    "op4_line_dedup": rf"""
        WITH lines AS (
            SELECT doc_id, k - 1 AS line, l, trim(l, E' \t\n\v\f\r') AS s, len(regexp_extract_all(l, '[^\x20\x09-\x0D]+')) AS words
            FROM (SELECT doc_id, unnest(string_split(text, E'\n')) AS l, generate_subscripts(string_split(text, E'\n'), 1) AS k FROM documents)
        ), filled AS (
            SELECT *, row_number() OVER w AS p, coalesce(sum(words) OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before
            FROM lines WHERE s <> '' WINDOW w AS (PARTITION BY doc_id ORDER BY line)
        ), runs AS (  -- the shortest runs from each line on, and to each line: every longer run is made of them
            SELECT doc_id, p, count(*) OVER w AS m, sum(words) OVER w AS n, list(s) OVER w AS run FROM filled
            WINDOW w AS (PARTITION BY doc_id ORDER BY before RANGE BETWEEN CURRENT ROW AND {MIN_WORDS - 1} FOLLOWING)
            UNION
            SELECT doc_id, p - count(*) OVER w + 1, count(*) OVER w, sum(words) OVER w, list(s) OVER w FROM filled
            WINDOW w AS (PARTITION BY doc_id ORDER BY before + words RANGE BETWEEN {MIN_WORDS - 1} PRECEDING AND CURRENT ROW)
        ), later AS (
            SELECT doc_id, p, m FROM (SELECT *, row_number() OVER (PARTITION BY run ORDER BY doc_id, p) AS k FROM runs WHERE n >= {MIN_WORDS}) WHERE k > 1
        ), gone AS (
            SELECT DISTINCT f.doc_id, f.line FROM (SELECT doc_id, unnest(range(p, p + m)) AS p FROM later) g JOIN filled f ON f.doc_id = g.doc_id AND f.p = g.p
        ), kept AS (
            SELECT l.doc_id, string_agg(l.l, E'\n' ORDER BY l.line) FILTER (g.line IS NULL) AS text, count(g.line) AS lines_removed
            FROM lines l LEFT JOIN gone g ON g.doc_id = l.doc_id AND g.line = l.line GROUP BY l.doc_id
        )
        SELECT d.doc_id, CASE WHEN d.text IS NULL THEN NULL ELSE coalesce(k.text, '') END AS text, coalesce(k.lines_removed, 0) AS lines_removed FROM documents d LEFT JOIN kept k ON k.doc_id = d.doc_id
    """,
    "op6_url_filter": rf"""
        WITH RECURSIVE u AS (
            SELECT page_id, CASE WHEN instr(url, '://') > 0 THEN substring(url, instr(url, '://') + 3) ELSE '' END AS rest, coalesce(html, '') AS html FROM pages
        ), p AS (
            SELECT page_id, translate(regexp_extract(rest, '^[^/?#]*'), '{_ABC}', '{_abc}') AS host, regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path,
                   regexp_extract(regexp_extract(regexp_replace(html, '{ASIDE}', ' ', 'g'), '(?is)<link\b[^>]*\brel\s*=\s*["'']?\s*canonical\b[^>]*>'), '(?is)href\s*=\s*["'']?[a-z]+://([^"''\s>]*)', 1) AS target FROM u
        ), e AS (
            SELECT host || path AS a, translate(regexp_extract(target, '^[^/?#]*'), '{_ABC}', '{_abc}') || regexp_extract(target, '^[^/?#]*([^?#]*)', 1) AS b FROM p WHERE target <> ''
        ), both_ways AS (SELECT a, b FROM e UNION SELECT b, a FROM e), reach AS (
            SELECT a AS node, a AS other FROM both_ways UNION SELECT r.node, x.b FROM reach r JOIN both_ways x ON x.a = r.other
        ), rules(h, q, v) AS (VALUES ('net', '/', 'block'), ('example.net', '/en/', 'allow'), ('example.com', '/de/', 'block'), ('org', '/fr/', 'allow')
        ), judged AS (
            SELECT page_id, host, path, (SELECT struct_pack(r := h || q, v := v) FROM rules WHERE (host = h OR ends_with(host, '.' || h)) AND starts_with(path, q) ORDER BY length(h || q) DESC LIMIT 1) AS x FROM p
        ), spread AS (
            SELECT r.node, bool_or(j.x.v = 'allow') AS allowed, bool_or(j.x.v = 'block') AS blocked FROM reach r JOIN judged j ON j.host || j.path = r.other GROUP BY r.node
        )
        SELECT j.page_id, j.host, j.path, j.x.r AS rule, coalesce(j.x.v, CASE WHEN s.allowed THEN 'allow' WHEN s.blocked THEN 'block' END, 'allow') AS verdict
        FROM judged j LEFT JOIN spread s ON s.node = j.host || j.path
    """,
    "op9_ngram_join": rf"""
        WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), '{_ABC}', '{_abc}'), '[^\x20\x09-\x0D]+') AS w FROM documents),
        s AS (
            SELECT DISTINCT doc_id, md5(s) AS s FROM (
                SELECT doc_id, unnest(CASE WHEN len(w) >= 5 THEN list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' ')) WHEN len(w) > 0 THEN [array_to_string(w, ' ')] ELSE [] END) AS s FROM w)
        ), n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
        l AS (
            SELECT x.a, x.b FROM (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS c FROM s x JOIN s y ON x.s = y.s AND x.doc_id < y.doc_id GROUP BY 1, 2) x
            JOIN n p ON p.doc_id = x.a JOIN n q ON q.doc_id = x.b WHERE 100 * x.c >= 80 * (p.n + q.n - x.c)
        ), both_ways AS (SELECT a, b FROM l UNION ALL SELECT b, a FROM l),
        reach AS (SELECT a AS node, b AS other FROM both_ways UNION SELECT r.node, x.b FROM reach r JOIN both_ways x ON x.a = r.other)
        SELECT w.doc_id, coalesce(n.n, 0) AS n_shingles, least(w.doc_id, coalesce((SELECT min(other) FROM reach WHERE node = w.doc_id), w.doc_id)) AS component_id
        FROM w LEFT JOIN n ON n.doc_id = w.doc_id
    """,
    "op5_exact_dedup": r"""
        WITH n AS (SELECT doc_id, length(coalesce(text, '')) AS c, sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g')) AS h FROM documents)
        SELECT doc_id, first_value(doc_id) OVER w AS keep_id, count(*) OVER (PARTITION BY h) AS group_size,
               row_number() OVER w = 1 AS kept, h AS text_sha256
        FROM n WINDOW w AS (PARTITION BY h ORDER BY c DESC, doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING)
    """,
    "op11_collocations": rf"""
        WITH x AS (
            SELECT row_number() OVER () AS piece, lang, regexp_extract_all(piece, '[^\x20\x09]+') AS w FROM (
                SELECT coalesce(lang, 'und') AS lang, unnest(regexp_split_to_array(translate(coalesce(text, ''), '{_ABC}', '{_abc}'), '[.,;:!?\x0A-\x0D]')) AS piece FROM documents)
        ), t AS (
            SELECT lang, w AS x, lead(w) OVER p AS y, lead(w, 2) OVER p AS z FROM (SELECT piece, lang, unnest(w) AS w, generate_subscripts(w, 1) AS k FROM x) WINDOW p AS (PARTITION BY piece ORDER BY k)
        ), f1 AS (SELECT lang, x, count(*) AS f FROM t GROUP BY ALL),
        n AS (SELECT lang, sum(f)::BIGINT AS n FROM f1 GROUP BY lang),
        f2 AS (SELECT lang, x, y, count(*) AS f FROM t WHERE y IS NOT NULL GROUP BY ALL HAVING count(*) >= 10),
        f3 AS (SELECT lang, x, y, z, count(*) AS f FROM t WHERE z IS NOT NULL GROUP BY ALL HAVING count(*) >= 10),
        cut AS (
            SELECT c.lang, c.x || ' ' || c.y AS phrase, c.f AS a, l.f AS l, r.f AS r, 1 AS k FROM f2 c JOIN f1 l ON l.lang = c.lang AND l.x = c.x JOIN f1 r ON r.lang = c.lang AND r.x = c.y
            UNION ALL SELECT c.lang, concat_ws(' ', c.x, c.y, c.z), c.f, l.f, r.f, 1 FROM f3 c JOIN f1 l ON l.lang = c.lang AND l.x = c.x JOIN f2 r ON r.lang = c.lang AND r.x = c.y AND r.y = c.z
            UNION ALL SELECT c.lang, concat_ws(' ', c.x, c.y, c.z), c.f, l.f, r.f, 2 FROM f3 c JOIN f2 l ON l.lang = c.lang AND l.x = c.x AND l.y = c.y JOIN f1 r ON r.lang = c.lang AND r.x = c.z
        ), best AS (
            SELECT *, ((1000000::HUGEINT * a * a) // (l::HUGEINT * r))::BIGINT AS score FROM cut QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) = 1
        ), cover AS (
            SELECT lang, phrase, max(f) AS f FROM (SELECT lang, x || ' ' || y AS phrase, f FROM f3 UNION ALL SELECT lang, y || ' ' || z, f FROM f3) GROUP BY ALL
        ), kept AS (SELECT b.* FROM best b LEFT JOIN cover c ON c.lang = b.lang AND c.phrase = b.phrase WHERE c.f IS NULL OR 100 * c.f < 50 * b.a)
        SELECT lang, rank, phrase, a, l, r, n, score FROM (
            SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, encode(phrase)) AS rank FROM kept
        ) JOIN n USING (lang) WHERE rank <= 2000
    """,
    "op13_ranked_search": rf"""
        WITH t AS (
            SELECT doc_id, unnest(regexp_extract_all(translate(coalesce(text, ''), '{_ABC}', '{_abc}'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM documents
        ), p AS (SELECT doc_id, term, count(*) AS tf FROM t GROUP BY ALL),
        d AS (SELECT doc_id, sum(tf)::BIGINT AS n FROM p GROUP BY doc_id), c AS (SELECT count(*) AS n, sum(n)::BIGINT AS l FROM d),
        q AS (SELECT DISTINCT item_id, unnest(regexp_extract_all(translate(coalesce(text, ''), '{_ABC}', '{_abc}'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM benchmark),
        w AS (SELECT term, floor(1000 * ln((2 * c.n + 2) / (2 * count(*) + 1)::DOUBLE))::BIGINT AS w FROM p, c WHERE term IN (SELECT term FROM q) GROUP BY term, c.n),
        s AS (
            SELECT q.item_id, p.doc_id, sum(w.w * ((1000000000 * p.tf) // (1000 * p.tf + 20 * (50 + (50 * d.n * c.n) // c.l))))::BIGINT AS score
            FROM q JOIN p USING (term) JOIN w USING (term) JOIN d USING (doc_id), c GROUP BY ALL
        )
        SELECT item_id, rank, doc_id, score FROM (
            SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id)::INTEGER AS rank FROM s WHERE score > 0
        ) WHERE rank <= 50
    """,
    "op7_exact_top_k": r"""
        WITH v AS (
            SELECT vec_id, list_transform(embedding::DOUBLE[], lambda x: floor(x * 1024)::BIGINT) AS x FROM embeddings
            WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
        ), s AS (
            SELECT q.vec_id AS query_id, c.vec_id AS vec_id, list_sum(list_transform(list_zip(q.x, c.x), lambda p: p[1] * p[2]))::BIGINT AS score
            FROM v q JOIN v c ON q.vec_id <> c.vec_id WHERE q.vec_id % 100 = 0
        )
        SELECT query_id, rank, vec_id, score FROM (
            SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INTEGER AS rank FROM s
        ) WHERE rank <= 10
    """,
}
