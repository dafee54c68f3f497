"""Named queries of this package, one an operator, over whole tables; and the SQL twins that exist."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fairload.llm import (
    decontaminate,
    jaccard_join,
    licenses,
    line_dedup,
    lz_fingerprint,
    merkle,
    mixing,
    quality_gam,
    ranked_search,
    secrets_dfa,
    simhash,
    toxicity,
    warc,
)
from fairload.llm.common import table
from fairload.session import fresh_dir

Query = Callable[[SparkSession, str], DataFrame]


#: Target shares of expected tokens by text domain.
TARGETS = {"en": 0.45, "de": 0.18, "fr": 0.18, "es": 0.17, "junk": 0.02}


def op1_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan_licenses(table(spark, sf_dir, "documents"))


def op2_mix_to_targets(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    labelled = mixing.text_domains(docs, table(spark, sf_dir, "labels"))
    return mixing.mix(docs, labelled, TARGETS, keep=["doc_id", "source", "lang"])


def op3_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    # the rule of the SQL twin: copies of lines of five words and more, near lines one word apart
    return line_dedup.line_report(table(spark, sf_dir, "documents"), least_words=5, one_edit=True)


def op4_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(table(spark, sf_dir, "documents"), shingle=3, max_bits=3)


def op5_warc_archive(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages")
    records = pages.select(F.col("page_id").alias("record_id"), "url", F.col("html").alias("payload"))
    archive = warc.write_archive(records, fresh_dir(spark, "warc"))
    return warc.read_archive(spark, archive).select(
        F.col("record_id").alias("page_id"),
        F.octet_length("payload").cast("long").alias("payload_bytes"),
        F.sha2("payload", 256).alias("payload_digest"),
        "record_type",
        "refers_to",
    )


def op6_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.find_items(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op7_lz_fingerprint(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lz_fingerprint.edited_pairs(table(spark, sf_dir, "documents"))


def op8_quality_gam(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_gam.classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op9_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets_dfa.scan_secrets(table(spark, sf_dir, "documents"))


def op10_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op11_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    hit = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 7 == 0
    return merkle.proofs(table(spark, sf_dir, "documents"), hit, F.col("n_chars") + 1)


def op12_ranked_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ranked_search.rank_documents(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), k=20)


def op13_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_join.similar_documents(table(spark, sf_dir, "documents"), shingle=4, percent=85)


QUERIES: dict[str, Query] = {
    f.__name__: f
    for f in (
        op1_license_scan,
        op2_mix_to_targets,
        op3_line_dedup,
        op4_simhash_near_dedup,
        op5_warc_archive,
        op6_decontaminate,
        op7_lz_fingerprint,
        op8_quality_gam,
        op9_secret_scan,
        op10_toxicity,
        op11_merkle_manifest,
        op12_ranked_search,
        op13_jaccard_join,
    )
}

ORACLE: dict[str, str] = {
    "op3_line_dedup": r"""
        WITH split AS (
            SELECT doc_id, unnest(string_split(text, chr(10))) AS line,
                   unnest(range(len(string_split(text, chr(10))))) AS line_no
            FROM documents
        ), lines AS (
            SELECT doc_id, line_no, line, list_filter(string_split_regex(line, '[\t-\r ]+'), lambda w: w <> '') AS words
            FROM split
        ), firsts AS (
            SELECT array_to_string(words, ' ') AS line_key, any_value(words) AS words, min((doc_id, line_no)) AS spot
            FROM lines WHERE len(words) >= 5 GROUP BY 1
        ), long AS (SELECT * FROM firsts WHERE len(words) >= 10
        ), variants AS (
            SELECT line_key, spot, place, array_to_string(list_concat(words[:place], words[place + 2:]), ' ') AS variant
            FROM (SELECT *, unnest(range(len(words))) AS place FROM long)
        ), near AS (
            SELECT v.line_key FROM variants v
            JOIN (SELECT variant, place, min(spot) AS least FROM variants GROUP BY 1, 2) USING (variant, place)
            WHERE v.spot > least
            UNION
            SELECT l.line_key FROM long l JOIN (SELECT variant, min(spot) AS least FROM variants GROUP BY 1) v
              ON v.variant = l.line_key WHERE l.spot > least
            UNION
            SELECT v.line_key FROM variants v JOIN long l ON v.variant = l.line_key WHERE v.spot > l.spot
        ), judged AS (
            SELECT l.doc_id, l.line_no, l.line, n.line_key IS NOT NULL AS is_near,
                   n.line_key IS NULL AND len(l.words) >= 5 AND f.spot <> (l.doc_id, l.line_no) AS is_copy
            FROM lines l LEFT JOIN firsts f ON f.line_key = array_to_string(l.words, ' ')
            LEFT JOIN near n ON n.line_key = f.line_key
        )
        SELECT doc_id, coalesce(n_lines, 0) AS n_lines, coalesce(n_copies, 0) AS n_copies, coalesce(n_near, 0) AS n_near,
               CASE WHEN text IS NOT NULL THEN sha256(coalesce(rest, '')) END AS rest_sha256
        FROM documents LEFT JOIN (
            SELECT doc_id, count(*) AS n_lines, count(*) FILTER (is_copy) AS n_copies, count(*) FILTER (is_near) AS n_near,
                   string_agg(line, chr(10) ORDER BY line_no) FILTER (NOT is_near AND NOT coalesce(is_copy, false)) AS rest
            FROM judged GROUP BY 1
        ) USING (doc_id)
    """,
    "op5_warc_archive": """
        WITH p AS (
            SELECT page_id, octet_length(encode(coalesce(html, ''))) AS payload_bytes,
                   sha256(coalesce(html, '')) AS payload_digest
            FROM pages
        ), f AS (SELECT payload_digest, min(page_id) AS first_id FROM p GROUP BY ALL)
        SELECT page_id, payload_bytes, payload_digest,
               CASE WHEN later THEN 'revisit' ELSE 'response' END AS record_type,
               CASE WHEN later THEN first_id END AS refers_to
        FROM (SELECT *, payload_bytes >= 100 AND page_id <> first_id AS later
              FROM p JOIN f USING (payload_digest))
    """,
    "op11_merkle_manifest": """
        WITH RECURSIVE leaves AS (
            SELECT doc_id, CASE WHEN lang IS NULL THEN '-' ELSE 'x' || lang END AS tree,
                   row_number() OVER (PARTITION BY lang ORDER BY doc_id) - 1 AS pos,
                   count(*) OVER (PARTITION BY lang) AS n, head || mark(n_chars) || mark(text) AS plain,
                   head || mark(CASE WHEN hit THEN n_chars + 1 ELSE n_chars END) || mark(text) AS other
            FROM (SELECT *, mark(doc_id) || mark(source) || mark(lang) AS head, crc(doc_id) % 7 = 0 AS hit FROM documents)
        ), grown AS (
            SELECT tree, n, 0 AS level, pos, sha256(plain) AS digest FROM leaves
            UNION ALL
            SELECT tree, (n + 1) // 2, level + 1, pos // 2, sha256(string_agg(digest, '' ORDER BY pos))
            FROM grown WHERE n > 1 GROUP BY tree, n, level, pos // 2
        ), subroots AS (
            SELECT tree, digest, row_number() OVER (ORDER BY tree <> '-', encode(tree)) - 1 AS pos, count(*) OVER () AS n
            FROM grown WHERE n = 1
        ), upper AS (
            SELECT n, 0 AS level, pos, digest FROM subroots
            UNION ALL
            SELECT (n + 1) // 2, level + 1, pos // 2, sha256(string_agg(digest, '' ORDER BY pos))
            FROM upper WHERE n > 1 GROUP BY n, level, pos // 2
        ), steps AS (
            SELECT l.tree, l.pos, g.level, max(s.digest) AS sibling, any_value(xor(g.pos, 1) < g.pos) AS is_left
            FROM leaves l JOIN grown g ON g.tree = l.tree AND g.pos = l.pos >> g.level AND g.n > 1
            LEFT JOIN grown s ON s.tree = g.tree AND s.level = g.level AND s.pos = xor(g.pos, 1)
            GROUP BY ALL
            UNION ALL
            SELECT l.tree, l.pos, 1000 + g.level, max(s.digest), any_value(xor(g.pos, 1) < g.pos)
            FROM leaves l JOIN subroots t ON t.tree = l.tree JOIN upper g ON g.pos = t.pos >> g.level AND g.n > 1
            LEFT JOIN upper s ON s.level = g.level AND s.pos = xor(g.pos, 1)
            GROUP BY ALL
        ), proofs AS (
            SELECT tree, pos, list(CASE WHEN sibling IS NULL THEN 'n' WHEN is_left THEN 'l' || sibling ELSE 'r' || sibling END
                                   ORDER BY level) AS way
            FROM steps GROUP BY ALL
        ), folded AS (
            SELECT doc_id, sha256(plain) AS leaf, t.digest AS subroot, (SELECT digest FROM upper WHERE n = 1) AS root,
                   sha256(array_to_string(list_transform(coalesce(way, []), lambda s: s[2:]), '')) AS proof_sha256,
                   list_reduce([sha256(other)] || coalesce(way, []), lambda seen, s:
                       sha256(CASE WHEN s[1] = 'l' THEN s[2:] || seen ELSE seen || s[2:] END)) AS folded_root
            FROM leaves l JOIN subroots t ON t.tree = l.tree LEFT JOIN proofs p ON p.tree = l.tree AND p.pos = l.pos
        )
        SELECT *, folded_root = root AS verified FROM folded
    """,
    "op12_ranked_search": r"""
        WITH words AS (
            SELECT doc_id, regexp_extract_all(lowered(text), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS terms FROM documents
        ), sized AS (SELECT doc_id, terms, len(terms) AS n FROM words WHERE len(terms) > 0
        ), corpus AS (SELECT count(*) AS docs, sum(n)::BIGINT AS length FROM sized
        ), held AS (
            SELECT doc_id, n, term, count(*) AS tf FROM (SELECT doc_id, n, unnest(terms) AS term FROM sized) GROUP BY ALL
        ), wanted AS (
            SELECT item_id, term, count(*) AS times FROM (
                SELECT item_id, unnest(regexp_extract_all(lowered(text), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term
                FROM benchmark
            ) GROUP BY ALL
        ), weight AS (
            SELECT term, floor(1000 * ln((2 * docs + 2)::DOUBLE / (2 * df + 1)::DOUBLE))::BIGINT AS w
            FROM (SELECT term, count(*) AS df FROM held GROUP BY 1), corpus
        ), scored AS (
            SELECT item_id, doc_id, sum(times * w * ((1000000000 * tf) // (1000 * tf + 12 * (100 - 25 + (25 * n * docs) // length))))::BIGINT AS score
            FROM wanted JOIN held USING (term) JOIN weight USING (term), corpus GROUP BY 1, 2
        )
        SELECT item_id, rank::INTEGER AS rank, doc_id, score
        FROM (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS rank FROM scored WHERE score > 0)
        WHERE rank <= 20
    """,
    "op13_jaccard_join": r"""
        WITH RECURSIVE words AS (
            SELECT doc_id, regexp_extract_all(lowered(coalesce(text, '')), '[^\x20\x09-\x0D]+') AS w FROM documents
        ), sets AS (
            SELECT doc_id, list_distinct(list_transform(range(greatest(len(w) - 3, least(len(w), 1))),
                                                        lambda i: array_to_string(w[i + 1 : i + 4], ' '))) AS shingles
            FROM words
        ), held AS (SELECT doc_id, len(shingles) AS n, unnest(shingles) AS shingle FROM sets
        ), links AS (
            SELECT a.doc_id AS src, b.doc_id AS dst FROM held a JOIN held b ON a.shingle = b.shingle AND a.doc_id <> b.doc_id
            GROUP BY a.doc_id, b.doc_id, a.n, b.n HAVING 100 * count(*) >= 85 * (a.n + b.n - count(*))
        ), reached AS (
            SELECT src, dst FROM links UNION SELECT r.src, l.dst FROM reached r JOIN links l ON l.src = r.dst
        ), least AS (SELECT src AS doc_id, min(dst) AS low FROM reached GROUP BY 1)
        SELECT doc_id, len(shingles)::BIGINT AS n_shingles, least(doc_id, coalesce(low, doc_id)) AS component_id
        FROM sets LEFT JOIN least USING (doc_id)
    """,
}

# expressions that the twins share, written out in place
_MARK = "CASE WHEN {0} IS NULL THEN '-' ELSE strlen({0}::VARCHAR) || ':' || {0} END"
_LOWERED = "translate({0}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_CRC = """xor(list_reduce([4294967295] || list_transform(string_split({0}::VARCHAR, ''), lambda c: ord(c)::BIGINT),
    lambda seen, b: list_reduce([xor(seen, b)] || [0, 0, 0, 0, 0, 0, 0, 0],
        lambda s, z: CASE WHEN s % 2 = 1 THEN xor(s >> 1, 3988292384) ELSE s >> 1 END)), 4294967295)"""


def _written_out(sql: str) -> str:
    """Replace mark(x), lowered(x) and crc(x) by their expressions; x may hold parentheses."""
    for name, body in (("mark", _MARK), ("lowered", _LOWERED), ("crc", _CRC)):
        while (at := sql.find(f"{name}(")) >= 0:
            depth, end = 1, at + len(name) + 1
            while depth:
                depth += {"(": 1, ")": -1}.get(sql[end], 0)
                end += 1
            sql = sql[:at] + "(" + body.format(sql[at + len(name) + 1 : end - 1]) + ")" + sql[end:]
    return sql


ORACLE |= {name: _written_out(ORACLE[name]) for name in ("op11_merkle_manifest", "op12_ranked_search", "op13_jaccard_join")}
