"""The queries of this subpackage, each over its whole table, and their SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import chat, html_text, langid, lexical_rank, mixing, packing, quality_model, quality_rules, secret_scan, simhash, sketch, target_rates, warc
from ._shared import table

Query = Callable[[SparkSession, str], DataFrame]
VOCABULARY = "word_bpe_49k.json"


def tokenizer_path(name: str = VOCABULARY) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(table(spark, sf_dir, "documents"))


def op2_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_text.extract(table(spark, sf_dir, "pages"))


def op3_quality_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return quality_model.score(docs, quality_model.fit(docs, table(spark, sf_dir, "labels")))


def op4_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules.judge(table(spark, sf_dir, "documents"))


def op5_sketch(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sketch.edited_neighbours(table(spark, sf_dir, "documents"))


def op6_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chat.perspectives(table(spark, sf_dir, "conversations"))


def op7_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"), tokenizer_path())


def op8_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = warc.round_trip(table(spark, sf_dir, "pages"))
    return found.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "n_segments")


def op9_langid(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return langid.identify(docs, langid.fit(docs))


def op10_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(table(spark, sf_dir, "documents"))


def op11_target_rates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return target_rates.shop_rates(*[table(spark, sf_dir, name) for name in ("sale_lines", "sales", "items", "vendors", "clients")])


def op12_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secret_scan.report(table(spark, sf_dir, "documents"))


def op13_lexical_rank(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lexical_rank.rank(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def queries() -> dict[str, Query]:
    own = [op1_simhash, op2_html_text, op3_quality_model, op4_quality_rules, op5_sketch, op6_chat, op7_packing, op8_warc, op9_langid, op10_mixing, op11_target_rates, op12_secret_scan, op13_lexical_rank]
    return {f.__name__: f for f in own}


#: The rest of the queries can't be said in SQL, or not at the size of whole tables; tests hold them against brute force.
OP6_SQL = r"""
WITH said AS (
  SELECT conv_id, turn, coalesce(role, 'unknown') AS speaker, coalesce(text, '') AS text FROM conversations
), escaped AS (
  SELECT conv_id, turn, speaker, md5(text || '/' || speaker) AS digest,
         regexp_replace(regexp_replace(text, '<(\\*)\|', '<\\\1|', 'g'), '\|(\\*)>', '|\\\1>', 'g') AS text,
         regexp_replace(regexp_replace(speaker, '<(\\*)\|', '<\\\1|', 'g'), '\|(\\*)>', '|\\\1>', 'g') AS name
  FROM said
), parties AS (
  SELECT DISTINCT conv_id, speaker AS perspective FROM said WHERE speaker <> 'system'
), seen AS (
  SELECT s.*, p.perspective,
         CASE WHEN s.speaker = 'system' THEN 'system' WHEN s.speaker = p.perspective THEN 'assistant' ELSE 'user' END AS role
  FROM escaped s JOIN parties p ON s.conv_id IS NOT DISTINCT FROM p.conv_id
), headed AS (
  SELECT *, '<|' || CASE WHEN role = 'user' THEN 'user name=' || name ELSE role END || '|>' || chr(10) AS header FROM seen
), rendered AS (
  SELECT *, header || text || chr(10) || '<|end|>' || chr(10) AS rendered FROM headed
), placed AS (
  SELECT *, row_number() OVER w - 1 AS position,
         coalesce(sum(length(rendered)) OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS start
  FROM rendered WINDOW w AS (PARTITION BY conv_id, perspective ORDER BY turn NULLS LAST, digest, speaker)
)
SELECT conv_id, perspective, CAST(position AS BIGINT) AS position, speaker, role, rendered, CAST(start AS BIGINT) AS start,
       CAST(CASE WHEN role = 'assistant' THEN start + length(header) ELSE start + length(rendered) END AS BIGINT) AS mask_start,
       CAST(start + length(rendered) AS BIGINT) AS mask_end
FROM placed
"""

OP8_SQL = """
WITH paid AS (
  SELECT page_id, url, encode(coalesce(html, '')) AS payload FROM pages
), first AS (
  SELECT payload, min(page_id) AS first FROM paid GROUP BY payload
)
SELECT p.page_id, CAST(octet_length(p.payload) AS BIGINT) AS payload_bytes,
       list_aggregate(list_transform(range(32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
         CAST(1 + list_sum(list_transform(range(5), lambda b: (1 << (4 - b)) *
           CAST(substr(bits, CAST(1 + 5 * i + b AS INTEGER), 1) AS INTEGER))) AS INTEGER), 1)), 'string_agg', '') AS payload_digest,
       CASE WHEN p.page_id = f.first THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN p.page_id = f.first THEN NULL ELSE f.first END AS refers_to,
       CASE WHEN p.page_id = f.first THEN CAST(ceil(block / 4096.0) AS BIGINT) ELSE 1 END AS n_segments
FROM (
  SELECT *, CAST(CAST(unhex(sha1(payload)) AS BIT) AS VARCHAR) AS bits,
         -- The response's head, then the payload, from 2048 bytes on in chunks of 1024, each with its size in hex and two
         -- line ends, and a last one of size 0.
         CASE WHEN size < 2048 THEN 77 + length(CAST(size AS VARCHAR)) + size
              ELSE 87 + size + (size // 1024) * (3 + 4) + CASE WHEN size % 1024 > 0 THEN length(printf('%x', size % 1024)) + 4 ELSE 0 END + 5 END AS block
  FROM (SELECT *, octet_length(payload) AS size FROM paid)
) p
JOIN first f USING (payload)
"""


OP11_SQL = """
WITH sold AS (
  SELECT sale_id, sold_at, coalesce(client_id, -1) AS client_id FROM sales WHERE sold_at IS NOT NULL
), folded AS (  -- crc32 bit by bit over the digits
  SELECT sale_id, sold_at, client_id,
         xor(list_reduce(list_prepend(4294967295, flatten(list_transform(string_split(CAST(sale_id AS VARCHAR), ''), lambda c: [ascii(c), 0, 0, 0, 0, 0, 0, 0, 0]))),
             lambda a, x: CASE WHEN x > 0 THEN xor(a, x) ELSE xor(a >> 1, 3988292384 * (a & 1)) END), 4294967295) % 5 AS fold
  FROM sold
), own AS (
  SELECT l.sale_id, coalesce(l.item_id, -1) AS item_id, l.vendor_id, s.client_id, s.sold_at AS t, s.fold,
         count(*) AS n, count(*) FILTER (l.flag = 'returned') AS s
  FROM sale_lines l JOIN folded s USING (sale_id) GROUP BY ALL
), labelled AS (
  SELECT o.*, i.kind, v.nation_id, c.segment FROM own o
  LEFT JOIN items i USING (item_id) LEFT JOIN vendors v USING (vendor_id) LEFT JOIN clients c USING (client_id)
), counted AS (
  SELECT *,
         HISTORIES
  FROM labelled
), whole AS (
  SELECT *, CASE WHEN n_all < 1 THEN 500000 ELSE (1000000 * s_all + 50 * 500000) // (n_all + 50) END AS p FROM counted
), shared AS (
  SELECT *, CASE WHEN n_kind < 1 THEN p ELSE (1000000 * s_kind + 50 * p) // (n_kind + 50) END AS p_item,
         CASE WHEN n_nation < 1 THEN p ELSE (1000000 * s_nation + 50 * p) // (n_nation + 50) END AS p_vendor,
         CASE WHEN n_segment < 1 THEN p ELSE (1000000 * s_segment + 50 * p) // (n_segment + 50) END AS p_client
  FROM whole
)
SELECT sale_id, item_id, vendor_id, n AS n_lines, s AS n_returned,
       n_item AS item_n, CAST(CASE WHEN n_item < 1 THEN p_item ELSE (1000000 * s_item + 50 * p_item) // (n_item + 50) END AS BIGINT) AS item_rate,
       n_vendor AS vendor_n, CAST(CASE WHEN n_vendor < 1 THEN p_vendor ELSE (1000000 * s_vendor + 50 * p_vendor) // (n_vendor + 50) END AS BIGINT) AS vendor_rate,
       n_client AS client_n, CAST(CASE WHEN n_client < 1 THEN p_client ELSE (1000000 * s_client + 50 * p_client) // (n_client + 50) END AS BIGINT) AS client_rate
FROM shared
""".replace(
    "HISTORIES",
    ",\n         ".join(
        f"CAST(coalesce(sum({m}) OVER ({over} ORDER BY t {frame}), 0) - coalesce(sum({m}) OVER ({over}{', ' if over else 'PARTITION BY '}fold ORDER BY t {frame}), 0) AS BIGINT) AS {m}_{name}"
        for name, over in {"item": "PARTITION BY item_id", "kind": "PARTITION BY kind", "vendor": "PARTITION BY vendor_id", "nation": "PARTITION BY nation_id", "client": "PARTITION BY client_id", "segment": "PARTITION BY segment", "all": ""}.items()
        for m in ("n", "s")
        for frame in ["RANGE BETWEEN UNBOUNDED PRECEDING AND INTERVAL 1 MICROSECOND PRECEDING"]
    ),
)


#: The rules of the scan with their last repeat as group 1, and the least of its length.  Every run of hex digits is a match
#: there, so only the long ones need be listed here.
SECRETS = [
    ("assign", r"""(?i:password|passwd|secret|token|api_?key)["\']?\x20*[:=]\x20*["\']?([A-Za-z0-9+/_.=-]+)""", 6),
    ("access", "AKIA([A-Z0-9]+)", 16),
    ("hex", "([0-9a-f]{24,})", 24),
    ("github", "gh[pousr]_([A-Za-z0-9]+)", 20),
    ("slack", "xox[abeoprs]-([A-Za-z0-9-]+)", 16),
    ("private_key", "(-----BEGIN (?:[A-Z]+ )*PRIVATE KEY-----)", 1),
]


def _secret_spans(place: int, kind: str, pattern: str, least: int) -> str:
    """SQL of a rule's spans: what a text splits into at the matches, and the matches, add up to their places."""
    pattern = pattern.replace("\\'", "'").replace("'", "''")
    return f"""
  SELECT doc_id, row, {place} AS place, '{kind}' AS kind, length(m[i]) AS size,
         coalesce(list_sum(list_transform(p[1:i], lambda x: length(x))), 0) + coalesce(list_sum(list_transform(m[1:i - 1], lambda x: length(x))), 0) AS start
  FROM (SELECT *, unnest(range(1, len(m) + 1)) AS i FROM (SELECT doc_id, row, regexp_extract_all(text, '{pattern}') AS m, regexp_split_to_array(text, '{pattern}') AS p FROM texts))
  WHERE length(regexp_extract(m[i], '{pattern}', 1)) >= {least}"""


OP12_SQL = (
    """
WITH texts AS (
  SELECT doc_id, row_number() OVER () AS row, coalesce(text, '') AS text FROM documents
), spans AS ("""
    + "\n  UNION ALL".join(_secret_spans(k, *rule) for k, rule in enumerate(SECRETS))
    + """
), told AS (
  SELECT row, count(*) FILTER (kind = 'assign') AS n_assign, count(*) FILTER (kind = 'access') AS n_access, count(*) FILTER (kind = 'hex') AS n_hex,
         string_agg(said, ',' ORDER BY start, place) FILTER (kind IN ('assign', 'access', 'hex')) AS base, string_agg(said, ',' ORDER BY start, place) AS spans
  FROM (SELECT *, kind || ':' || CAST(CAST(start AS BIGINT) AS VARCHAR) || ':' || CAST(CAST(start + size AS BIGINT) AS VARCHAR) AS said FROM spans) GROUP BY row
)
SELECT doc_id, coalesce(n_assign, 0) AS n_assign, coalesce(n_access, 0) AS n_access, coalesce(n_hex, 0) AS n_hex,
       sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans
FROM texts LEFT JOIN told USING (row)
"""
)


OP13_SQL = r"""
WITH said AS (
  SELECT row, doc_id, unnest(regexp_extract_all(lower_ascii, '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term
  FROM (SELECT row_number() OVER () AS row, doc_id, translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS lower_ascii FROM documents)
), asked AS (
  SELECT DISTINCT item_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM benchmark
), sized AS (
  SELECT row, doc_id, count(*) AS n FROM said GROUP BY row, doc_id
), whole AS (
  SELECT count(*) AS docs, CAST(sum(n) AS BIGINT) AS terms FROM sized
), counted AS (
  SELECT row, term, count(*) AS tf FROM said WHERE term IN (SELECT term FROM asked) GROUP BY row, term
), weighed AS (
  SELECT term, CAST(floor(1000 * ln((2 * docs + 2) / (2 * df + 1))) AS BIGINT) AS w
  FROM (SELECT term, count(*) AS df FROM counted GROUP BY term), whole
), scored AS (
  SELECT a.item_id, c.row, CAST(sum(w.w * ((1000000000 * c.tf) // (1000 * c.tf + 8 * (100 - 90 + (90 * s.n * docs) // terms)))) AS BIGINT) AS score
  FROM asked a JOIN counted c USING (term) JOIN weighed w USING (term) JOIN sized s USING (row), whole GROUP BY a.item_id, c.row
), ranked AS (
  SELECT item_id, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id NULLS LAST) AS rank, doc_id, score FROM scored JOIN sized USING (row) WHERE score > 0
)
SELECT item_id, CAST(rank AS INTEGER) AS rank, doc_id, score FROM ranked WHERE rank <= 10
"""


def oracle_sql() -> dict[str, str]:
    return {"op6_chat": OP6_SQL, "op8_warc": OP8_SQL, "op11_target_rates": OP11_SQL, "op12_secret_scan": OP12_SQL, "op13_lexical_rank": OP13_SQL}
