"""For every registered query the same result as plain SQL over the source tables.

Written against DuckDB, independently of the library's expressions.
"""

from __future__ import annotations

L = """WITH l AS (
  SELECT *, sha256(concat_ws('|', CAST(epoch_ms(CAST(date AS TIMESTAMP)) AS VARCHAR),
                   CAST(units AS VARCHAR), direction, lower(description), rid)) AS id
  FROM (
    SELECT o_orderkey, CAST(o_orderdate AS DATE) AS date,
      CAST(round(o_totalprice * 100) AS BIGINT) AS units,
      CASE WHEN o_orderstatus = 'F' THEN 'in' ELSE 'out' END AS direction,
      o_orderpriority || ' ' || CAST(o_orderkey AS VARCHAR) AS description,
      c_name AS counterparty, c_mktsegment AS bank, c_nationkey,
      'row-' || CAST(o_orderkey AS VARCHAR) AS rid
    FROM orders JOIN customer ON o_custkey = c_custkey))
"""

V = """WITH v AS (
  SELECT event_id, CAST(ts AS DATE) AS date, CAST(round(value * 100) AS BIGINT) AS units,
    CASE WHEN event_type IN ('signup', 'purchase') THEN 'in' ELSE 'out' END AS direction,
    event_type, event_type || ' user ' || CAST(user_id AS VARCHAR) AS description,
    'row-' || CAST(event_id AS VARCHAR) AS rid
  FROM events WHERE round(value * 100) > 0)
"""

IDENTITY = """concat_ws('|', CAST(epoch_ms(CAST(date AS TIMESTAMP)) AS VARCHAR),
  CAST(units AS VARCHAR), direction, lower(description), rid)"""

MONTH = "CAST(date_trunc('month', date) AS DATE)"


def _cluster(text: str) -> str:
    return rf"""trim(regexp_replace(regexp_replace(regexp_replace(lower(strip_accents({text})),
      '[\x{{1F000}}-\x{{1FFFF}}\x{{2600}}-\x{{27BF}}]', '', 'g'), '\b\d{{3,}}\b', '', 'g'),
      '[^a-z0-9]+', ' ', 'g'))"""


def _party(text: str) -> str:
    words = (
        "pix recebido|pix enviado|pix|transferencia|transf|pagamento|recebimento|ted|doc"
    )
    return rf"""nullif(trim(regexp_replace(regexp_replace(trim(regexp_replace(
      lower(strip_accents({text})), '[^a-z0-9]+', ' ', 'g')),
      '\b({words})\b', ' ', 'g'), ' +', ' ', 'g')), '')"""


def _in_out(prefix: str = "") -> str:
    return f"""CAST(coalesce(sum(units) FILTER (direction = 'in'), 0) AS BIGINT) AS in_units,
      CAST(coalesce(sum(units) FILTER (direction = 'out'), 0) AS BIGINT) AS out_units{prefix}"""


IMPORTED = """WITH e AS (
  SELECT CAST(ts AS DATE) AS date, CAST(round(value * 100) AS BIGINT)
    * CASE WHEN event_type IN ('signup', 'purchase') THEN 1 ELSE -1 END AS signed FROM events),
i AS (
  SELECT CAST(o_orderdate AS DATE) AS date, 'inter' AS source,
    CASE WHEN o_orderstatus = 'F' THEN 'in' ELSE 'out' END AS direction,
    CAST(round(o_totalprice * 100) AS BIGINT) AS units FROM orders
  UNION ALL
  SELECT date, 'nubank', CASE WHEN signed < 0 THEN 'out' ELSE 'in' END, abs(signed) FROM e WHERE signed IS NOT NULL)
"""

IMPORTED_MONTHLY = IMPORTED + f"""
SELECT {MONTH} AS month, source, direction, count(*) AS transactions,
  CAST(sum(units) AS BIGINT) AS units
FROM i WHERE units > 0 GROUP BY 1, 2, 3"""

OFFERED_TWICE = IMPORTED + """
SELECT source, status, count(*) AS offered,
  count(*) FILTER (status = 'ok' AND units > 0) AS accepted, CAST(0 AS BIGINT) AS duplicates,
  count(*) FILTER (status = 'err' OR units = 0) AS rejected
FROM i, (VALUES ('ok'), ('err')) AS s(status) GROUP BY 1, 2"""

RANKING = L + f"""
SELECT *, CAST(dense_rank() OVER (ORDER BY volume_units DESC) AS INTEGER) AS rank FROM (
  SELECT *, in_units - out_units AS net_units, in_units + out_units AS volume_units FROM (
    SELECT lower(replace(counterparty, '#', ' ')) AS counterparty_normalized,
      count(*) AS transactions, {_in_out()}
    FROM l GROUP BY 1))"""

BALANCES = """WITH b AS (
  SELECT c_custkey, CAST(c_custkey // 5 AS VARCHAR) AS file_path,
    CAST(round(c_acctbal * 100) AS BIGINT) AS units FROM customer)
"""

AFRICA_GONE = L + """
SELECT CAST(c_nationkey AS VARCHAR) AS nation, count(*) AS transactions,
  CAST(sum(units) AS BIGINT) AS units{more}
FROM l JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey
WHERE r_name <> 'AFRICA' GROUP BY 1"""

ORACLES: dict[str, str] = {
    "summary_cards": L + f"""
SELECT count(*) AS transactions, CAST(sum(units) AS BIGINT) AS volume_units, {_in_out()},
  (SELECT count(DISTINCT c_nationkey) FROM customer) AS files FROM l""",
    "monthly_totals": L + f"""
SELECT {MONTH} AS month, count(*) AS transactions, {_in_out()} FROM l GROUP BY 1""",
    "filtered_view": L + """
SELECT id, date AS data, 'saida' AS tipo, counterparty AS destinatario, description AS descricao,
  CAST(-units / 100.0 AS DOUBLE) AS valor, bank AS banco_origem, false AS propria
FROM l WHERE bank = 'BUILDING' AND direction = 'out' AND units >= 150050
  AND (contains(lower(counterparty), 'urgent') OR contains(lower(description), 'urgent'))""",
    "filtered_totals": L + f"""
SELECT count(*) AS transactions, CAST(coalesce(sum(units), 0) AS BIGINT) AS volume_units,
  {_in_out()}, greatest(1, CAST(ceil(count(*) / 200.0) AS BIGINT)) AS pages
FROM l WHERE direction = 'in' AND (contains(lower(counterparty), 'customer#0000')
  OR contains(lower(description), 'customer#0000'))""",
    "table_page": L + """
SELECT id, date AS data, units AS amount_in_units FROM l
ORDER BY units DESC, date DESC, id DESC LIMIT 200 OFFSET 600""",
    "table_page_by_date": L + """
SELECT id, date AS data, units AS amount_in_units FROM l ORDER BY date, id DESC LIMIT 200""",
    "table_page_after": L + """
SELECT id, date AS data, units AS amount_in_units FROM l
ORDER BY date DESC, id DESC LIMIT 200 OFFSET 200""",
    "table_page_of_range": L + """
SELECT id, date AS data, units AS amount_in_units FROM l
ORDER BY units, date DESC, id DESC LIMIT 200 OFFSET 12200""",
    "newest_first": L + """
SELECT id, date AS data, CASE WHEN direction = 'in' THEN 'entrada' ELSE 'saida' END AS tipo,
  counterparty AS destinatario, bank AS banco_origem FROM l ORDER BY date DESC, id DESC""",
    "file_overview": L + """
SELECT CAST(c_nationkey AS VARCHAR) AS id, 'extrato-' || CAST(c_nationkey AS VARCHAR) || '.csv' AS nome,
  CASE WHEN c_nationkey < 8 THEN 'Inter' WHEN c_nationkey < 16 THEN 'Nubank' ELSE 'Genérico' END
    || ' · ' || CAST(count(*) FILTER (units >= 100000) AS VARCHAR)
    || CASE WHEN count(*) FILTER (units >= 100000) = 1 THEN ' transação' ELSE ' transações' END
    AS meta,
  CASE WHEN count(*) FILTER (units < 100000) > 0 THEN 'warn' ELSE 'ok' END AS status
FROM l GROUP BY c_nationkey""",
    "currency_totals": L + """
SELECT CASE r_name WHEN 'AMERICA' THEN 'USD' WHEN 'EUROPE' THEN 'EUR' ELSE 'BRL' END AS currency,
  CAST(2 AS INTEGER) AS precision, count(*) AS transactions,
  CAST(sum(units) AS BIGINT) AS volume_units,
  CAST(sum(CASE WHEN direction = 'in' THEN units ELSE -units END) AS BIGINT) AS net_units
FROM l JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey
GROUP BY 1""",
    "money_display": L + """
SELECT rid AS source_row_id, format('{}.{:02d}', units // 100, units % 100) AS display,
  'R$' || chr(160) || replace(format('{:,}', units // 100), ',', '.')
    || format(',{:02d}', units % 100) AS local,
  'R$ ' || replace(format('{:,}', units // 100), ',', '.') || format(',{:02d}', units % 100)
    AS shown,
  strftime(date, '%d/%m/%Y') AS shown_date FROM l""",
    "money_parse_formats": """
SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, style,
  CAST(round(l_extendedprice * 100) AS BIGINT) AS units,
  CASE WHEN style IN ('pt', 'en') THEN 'in' ELSE 'out' END AS direction
FROM lineitem CROSS JOIN (VALUES ('pt'), ('en'), ('paren'), ('minus')) s(style)""",
    "date_parse_formats": """
SELECT o_orderkey, d AS br, d AS us, d AS iso, d AS moment, CAST(NULL AS DATE) AS ambiguous,
  try_cast(strftime(d, '%Y-%m-31') AS DATE) AS day_31,
  epoch_ms(CAST(d AS TIMESTAMP)) AS millis
FROM (SELECT o_orderkey, CAST(o_orderdate AS DATE) AS d FROM orders)""",
    "event_days": """
SELECT event_id, CAST(ts AS DATE) AS day,
  epoch_ms(CAST(CAST(ts AS DATE) AS TIMESTAMP)) AS day_ms FROM events""",
    "identity_texts": r"""
SELECT doc_id, trim(regexp_replace(lower(strip_accents(text)),
  '[\s\x{0B}\x{00A0}\x{FEFF}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]+',
  ' ', 'g')) AS key FROM documents""",
    "cluster_keys": f"SELECT doc_id, {_cluster('text')} AS key FROM documents",
    "text_safety": f"""
SELECT page_id, {_cluster('html')} AS key, {_party('html')} AS party, false AS unsafe
FROM pages""",
    "counterparty_keys": f"""
SELECT o_orderkey, name, {_party('name')} AS key, {_party('raw')} AS raw_key FROM (
  SELECT o_orderkey,
    CASE WHEN o_orderstatus IN ('F', 'O') THEN c_name ELSE c_name || ' Ltda' END AS name,
    CASE o_orderstatus
      WHEN 'F' THEN 'Transferência recebida pelo Pix - ' || c_name || ' - 000.000 - BCO '
        || CAST(c_nationkey AS VARCHAR)
      WHEN 'O' THEN 'PIX enviado - ' || c_name || ' (Transferência enviada)'
      ELSE 'Compra no débito ' || c_name || ' Ltda' END AS raw
  FROM orders JOIN customer ON o_custkey = c_custkey)""",
    "own_transfer_flag": """
SELECT o_orderkey, CASE WHEN o_orderpriority IN ('5-LOW', '1-URGENT') THEN true END AS own
FROM orders""",
    "row_identity": V + f"""
SELECT rid AS source_row_id, sha256({IDENTITY}) AS id,
  sha256(concat_ws('|', CAST(epoch_ms(CAST(date AS TIMESTAMP)) AS VARCHAR),
    CAST(units AS VARCHAR), direction)) AS possible_duplicate_key FROM v""",
    "row_identity_fnv": V + f"""
SELECT rid AS source_row_id, 'fp_' || lpad(lower(to_hex(list_reduce(
    list_transform(string_split(s, ''), lambda c: CAST(ord(c) AS BIGINT)),
    lambda h, c: (xor(h, c) * 16777619) & 4294967295, CAST(2166136261 AS BIGINT)))), 8, '0')
  AS fingerprint
FROM (SELECT rid, {IDENTITY} AS s FROM v)""",
    "inter_line_roundtrip": """
SELECT o_orderkey AS record_index, CAST(o_orderdate AS DATE) AS date,
  CAST(round(o_totalprice * 100) AS BIGINT) AS amount_in_units,
  CASE WHEN o_orderstatus = 'F' THEN 'in' ELSE 'out' END AS direction,
  'Pix ' || o_orderpriority || ' ' || CAST(o_orderkey AS VARCHAR) AS description,
  'Inter' AS bank_name, CAST(NULL AS VARCHAR) AS error FROM orders""",
    "nubank_line_roundtrip": """
SELECT event_id AS record_index, CAST(ts AS DATE) AS date,
  nullif(CAST(round(value * 100) AS BIGINT), 0) AS amount_in_units,
  CASE WHEN event_type IN ('signup', 'purchase') OR round(value * 100) = 0 THEN 'in' ELSE 'out' END
    AS direction,
  'Compra, "' || event_type || '"' || chr(10) || 'user ' || CAST(user_id AS VARCHAR) AS description,
  CASE WHEN round(value * 100) = 0 THEN 'amount_zero' END AS error FROM events""",
    "generic_line_roundtrip": """
SELECT l_orderkey * 10 + l_linenumber AS record_index, CAST(l_shipdate AS DATE) AS date,
  CAST(l_partkey AS VARCHAR) AS description,
  CASE WHEN l_returnflag = 'R' THEN 'in' ELSE 'out' END AS direction,
  CAST(NULL AS VARCHAR) AS error,
  CAST(sum(CAST(round(l_extendedprice * 100) AS BIGINT)) AS BIGINT) AS units, count(*) AS lines
FROM lineitem GROUP BY 1, 2, 3, 4""",
    "detect_dialect": r"""
WITH f AS (
  SELECT doc_id, lang, regexp_replace(regexp_extract(
    CASE lang WHEN 'en' THEN 'Data,Valor,Identificador,Descrição'
              WHEN 'fr' THEN 'DATA LANÇAMENTO;Valor'
              ELSE replace(text, chr(13), '') END,
    '^(?: *\n)*([^\n]*)', 1), '"[^"]*"', '', 'g') AS line FROM documents),
c AS (
  SELECT *, length(line) - length(replace(line, ',', '')) AS commas,
    length(line) - length(replace(line, ';', '')) AS semicolons,
    length(line) - length(replace(line, chr(9), '')) AS tabs FROM f)
SELECT CAST(doc_id AS VARCHAR) AS file_path,
  CASE lang WHEN 'en' THEN 'nubank' WHEN 'fr' THEN 'inter' ELSE 'unknown' END AS source_type,
  CAST(CASE lang WHEN 'en' THEN 1.0 WHEN 'fr' THEN 0.5 ELSE 0.0 END AS DOUBLE) AS confidence,
  CASE greatest(commas, semicolons, tabs)
    WHEN commas THEN ',' WHEN semicolons THEN ';' ELSE chr(9) END AS delimiter
FROM c""",
    "file_preview": r"""
WITH lines AS (
  SELECT doc_id, unnest(string_split(replace(text, chr(13), ''), chr(10))) AS line,
    generate_subscripts(string_split(replace(text, chr(13), ''), chr(10)), 1) AS n
  FROM documents),
kept AS (
  SELECT doc_id, line, row_number() OVER (PARTITION BY doc_id ORDER BY n) - 1 AS record_index
  FROM lines WHERE regexp_matches(line,
    '[^\s\x{0B}\x{00A0}\x{FEFF}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]'))
SELECT CAST(doc_id AS VARCHAR) AS file_path, record_index, line FROM kept WHERE record_index < 3""",
    "encoding_fallback": "SELECT doc_id, sha256(text) AS hash FROM documents",
    "dedup_reimport": V + f"""
, r AS (SELECT event_type, units, sha256({IDENTITY}) AS id FROM v),
s AS (SELECT id FROM r WHERE event_type IN ('purchase', 'error')),
n AS (SELECT event_type, count(*) AS c, sum(units) AS u FROM r
      WHERE NOT EXISTS (SELECT 1 FROM s WHERE s.id = r.id) GROUP BY 1)
SELECT r.event_type AS file_id, 2 * count(*) AS total_count,
  coalesce(any_value(n.c), 0) AS new_count, CAST(coalesce(any_value(n.u), 0) AS BIGINT) AS new_units,
  2 * count(*) - coalesce(any_value(n.c), 0) AS duplicate_count
FROM r LEFT JOIN n ON n.event_type = r.event_type GROUP BY 1""",
    "blocked_rows": V + f"""
, r AS (SELECT event_type, units, sha256({IDENTITY}) AS id FROM v),
s AS (SELECT id FROM r WHERE event_type IN ('purchase', 'error')),
n AS (SELECT event_type, count(*) AS c, sum(units) AS u FROM r
      WHERE NOT EXISTS (SELECT 1 FROM s WHERE s.id = r.id) GROUP BY 1)
SELECT r.event_type AS file_id, 2 * count(*) - coalesce(any_value(n.c), 0) AS blocked_count,
  CAST(2 * sum(r.units) - coalesce(any_value(n.u), 0) AS BIGINT) AS blocked_units
FROM r LEFT JOIN n ON n.event_type = r.event_type GROUP BY 1""",
    "file_hash_guard": """
WITH d AS (SELECT CAST(doc_id AS VARCHAR) AS file_path, lang,
  sha256(replace(text, chr(13), '')) AS file_hash FROM documents)
SELECT min(file_path) AS file_path, file_hash FROM d
WHERE lang <> 'fr' AND file_hash NOT IN (SELECT file_hash FROM d WHERE lang = 'fr')
GROUP BY file_hash""",
    "reject_file_on_error": BALANCES + """
SELECT CAST(c_custkey AS VARCHAR) AS source_row_id, file_path, units AS amount_in_units FROM b
WHERE file_path NOT IN (SELECT file_path FROM b WHERE units <= 0)""",
    "row_errors": BALANCES + """
SELECT file_path, count(*) AS row_count, count(*) FILTER (units <= 0) AS error_count,
  CASE WHEN count(*) FILTER (units = 0) > 0 THEN 'amount_zero'
       WHEN count(*) FILTER (units < 0) > 0 THEN 'amount_sign_conflict' END AS row_error,
  DATE '2024-03-15' AS first_day, DATE '2024-03-15' AS last_day
FROM b GROUP BY file_path""",
    "occurrence_identity": """
WITH r AS (
  SELECT event_type AS file_path, CAST(ts AS DATE) AS date, event_id,
    CAST(floor(CAST(value AS DECIMAL(18, 2))) * 100 + 1 AS BIGINT) AS amount_in_units FROM events)
SELECT file_path, date, amount_in_units, event_id, CAST(1 AS BIGINT) AS rows,
  'occ-' || CAST(row_number() OVER (PARTITION BY file_path, date, amount_in_units
    ORDER BY event_id) - 1 AS VARCHAR) AS source_row_id
FROM r""",
    "suspected_duplicates": V + """
SELECT date, units AS amount_in_units, direction, count(*) AS transactions,
  count(DISTINCT event_type) AS files
FROM v GROUP BY 1, 2, 3 HAVING count(*) > 1""",
    "suspected_rows": V + """
SELECT rid AS source_row_id, date, units AS amount_in_units, direction FROM v
WHERE (date, units, direction) IN
  (SELECT (date, units, direction) FROM v GROUP BY date, units, direction HAVING count(*) > 1)""",
    "monthly_rollup": L + f"""
SELECT month, direction, bank, CAST(grouping_id(month, direction, bank) AS INTEGER) AS level,
  count(*) AS transactions, CAST(sum(units) AS BIGINT) AS units
FROM (SELECT {MONTH} AS month, direction, bank, units FROM l)
GROUP BY ROLLUP (month, direction, bank)""",
    "counterparty_ranking": RANKING,
    "counterparty_ranking_by_ranges": RANKING,
    "spending_clusters": L + f"""
SELECT {_cluster('description')} AS description_normalized, count(*) AS transactions,
  CAST(sum(units) AS BIGINT) AS units, min(date) AS first_day, max(date) AS last_day,
  min(description) AS sample, sum(units) / count(*) AS mean_units
FROM l GROUP BY 1 HAVING {_cluster('description')} <> ''""",
    "recurring_patterns": V + f"""
, d AS (SELECT {_cluster('description')} AS k, direction, date, count(*) AS n, sum(units) AS u,
          min(units) AS low, max(units) AS high FROM v GROUP BY 1, 2, 3),
g AS (SELECT *, date - lag(date) OVER (PARTITION BY k, direction ORDER BY date) AS gap FROM d)
SELECT k AS description_normalized, direction, CAST(sum(n) AS BIGINT) AS transactions,
  count(*) AS days, avg(gap) AS mean_gap, CAST(min(gap) AS INTEGER) AS min_gap,
  CAST(max(gap) AS INTEGER) AS max_gap, CAST(sum(u) AS BIGINT) / CAST(sum(n) AS BIGINT) AS mean_units,
  max(high) - min(low) AS spread_units
FROM g WHERE k <> '' GROUP BY 1, 2 HAVING count(*) >= 3""",
    "import_statements": IMPORTED_MONTHLY,
    "import_large_files": IMPORTED_MONTHLY,
    "import_stream": IMPORTED_MONTHLY,
    "import_across_sizes": OFFERED_TWICE,
    "import_again": OFFERED_TWICE,
    "import_defects": """
WITH e AS (
  SELECT event_type AS file, event_type = 'view' AS short, event_type = 'click' OR value IS NULL AS blank,
    round(value * 100) <> 0 AS counts FROM events),
n AS (
  SELECT file, count(*) AS lines, count(*) FILTER (short OR blank) AS flawed,
    count(*) FILTER (NOT short AND NOT blank) AS total, count(*) FILTER (NOT short AND NOT blank AND counts) AS new
  FROM e GROUP BY 1
  UNION ALL
  SELECT o_orderstatus, count(*), count(*) FILTER (o_orderstatus <> 'F'), count(*) FILTER (o_orderstatus = 'F'),
    count(*) FILTER (o_orderstatus = 'F') FROM orders GROUP BY 1),
d AS (
  SELECT file, CASE file WHEN 'view' THEN 'too_few_cells' WHEN 'click' THEN 'cell_empty'
      WHEN 'O' THEN 'amount_not_a_number' WHEN 'P' THEN 'date_blank' END AS defect, flawed AS n, lines - 1 AS last
  FROM n WHERE file IN ('view', 'click', 'O', 'P')
  UNION ALL SELECT 'error', 'too_few_cells', 1, lines FROM n WHERE file = 'error'
  UNION ALL SELECT 'error', 'MissingQuotes', 1, NULL)
SELECT n.file, total AS total_count, new AS new_count,
  coalesce((SELECT sum(n) FROM d WHERE d.file = n.file), 0)::BIGINT AS defect_count,
  CASE WHEN total = 0 THEN 'nenhuma transação encontrada no arquivo' END AS error, defect,
  d.n::BIGINT AS lines, last::BIGINT AS last_record
FROM n LEFT JOIN d ON d.file = n.file""",
    "own_transfers_view": L + """
SELECT date AS data, description AS descricao, false AS propria, units AS amount_in_units FROM l
WHERE NOT starts_with(description, '5-LOW')""",
    "detect_header_lines": r"""
SELECT CAST(doc_id AS VARCHAR) AS file_path,
  CASE lang WHEN 'en' THEN 'nubank' WHEN 'fr' THEN 'inter' WHEN 'de' THEN 'nubank' ELSE 'unknown' END AS source_type,
  CAST(CASE lang WHEN 'fr' THEN 2 + length(text) - length(replace(text, chr(10), '')) ELSE 0 END AS BIGINT) AS header_line,
  CASE WHEN lang NOT IN ('en', 'fr', 'de') THEN 'formato não reconhecido (esperado Inter ou Nubank CSV)' END AS file_error
FROM documents""",
    "byte_order_marks": "SELECT doc_id, sha256(replace(text, chr(13), '')) AS hash FROM documents",
    "blank_files": r"""
SELECT doc_id, NOT regexp_matches(
  CASE lang WHEN 'en' THEN regexp_replace(text, '[\x{21}-\x{24F}]', ' ', 'g') ELSE text END,
  '[^\s\x{0B}\x{00A0}\x{FEFF}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]') AS is_empty
FROM documents""",
    "direction_guard": """
SELECT event_type AS file_path, count(*) AS rows, CASE WHEN round(value * 100) = 0 THEN 'amount_zero'
  WHEN event_type IN ('view', 'click') THEN 'direction_invalid' WHEN event_type = 'signup' THEN 'amount_sign_conflict' END AS error
FROM events GROUP BY 1, 3""",
    "replayed_batch": AFRICA_GONE.format(more=""),
    "packed_ledger": AFRICA_GONE.format(more=", CAST(1 AS BIGINT) AS folders"),
    "cleared_ledger": L + """
SELECT CAST(c_nationkey AS VARCHAR) AS nation, count(*) AS transactions, CAST(sum(units) AS BIGINT) AS units,
  CAST(0 AS BIGINT) AS rows_when_cleared FROM l GROUP BY 1""",
    "import_by_key_index": L + """, n AS (
  SELECT c_nationkey, count(*) AS total, count(*) FILTER (direction = 'in') AS settled,
    any_value(r_name) = 'AFRICA' AS gone
  FROM l JOIN nation ON n_nationkey = c_nationkey JOIN region ON r_regionkey = n_regionkey GROUP BY 1)
SELECT 'settled' AS batch, CAST(c_nationkey AS VARCHAR) AS nation, settled AS new_count,
  CAST(0 AS BIGINT) AS duplicate_count FROM n WHERE settled > 0
UNION ALL SELECT 'every', CAST(c_nationkey AS VARCHAR), total - settled, settled FROM n
UNION ALL SELECT 'again', CAST(c_nationkey AS VARCHAR), CASE WHEN gone THEN total ELSE 0 END,
  CASE WHEN gone THEN 0 ELSE total END FROM n""",
    "ledger_of_days": L + """
SELECT date, count(*) AS transactions, CAST(sum(units) AS BIGINT) AS units FROM l
WHERE date IN (SELECT CAST(o_orderdate AS DATE) FROM orders WHERE o_orderstatus = 'P' AND o_orderpriority = '1-URGENT')
GROUP BY 1""",
    "rows_of_file": L + """
SELECT rid AS source_row_id, date, units AS amount_in_units, direction FROM l WHERE c_nationkey = 7""",
    "cascade_delete": AFRICA_GONE.format(more=""),
    "export_roundtrip": L + """
SELECT description, format('{}.{:02d}', units // 100, units % 100) AS amount, direction,
  counterparty, 'BRL' AS currency FROM l""",
}
