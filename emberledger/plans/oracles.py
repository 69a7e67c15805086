"""SQL counterparts of the registered queries, for DuckDB over the same tables.

Each oracle restates its query in plain SQL from the test tables up: factor matching is a
ranked join of every activity with every version, ledger checks are self joins, and so on.
Decimals come out as doubles, dates as text and integers as bigint, as on the Spark side.
"""

from __future__ import annotations

import re
from decimal import Decimal

from emberledger import messages as m
from emberledger.constants import (
    BILL_UNITS,
    CONFIDENCE_THRESHOLD,
    DEFAULT_SCOPE_RULE,
    HEADER_SYNONYMS,
    KNOWN_UTILITIES,
    LEVERS,
    REQUIRED_FIELDS,
    SCOPE_RULES,
    TAXONOMY,
    UNIT_RATIOS,
    US_STATES,
)
from emberledger.plans.testbed import ACTIVITY_OF_PART, FACTORS, PLACES


def _q(text) -> str:
    return "NULL" if text is None else "'" + str(text).replace("'", "''") + "'"


def _say(template: str, **columns: str) -> str:
    """Message template as a SQL concatenation."""
    parts = re.split(r"\{(\w+)\}", template)
    return "(" + " || ".join(
        f"CAST({columns[p]} AS VARCHAR)" if n % 2 else _q(p) for n, p in enumerate(parts) if p
    ) + ")"


def _fixed(x: str, digits: int) -> str:
    return f"format('{{:.{digits}f}}', CAST({x} AS DOUBLE))"


def _money(x: str) -> str:
    return f"format('{{:,.2f}}', CAST({x} AS DOUBLE))"


def _values(rows) -> str:
    return "(VALUES " + ", ".join("(" + ", ".join(_q(v) for v in r) + ")" for r in rows) + ")"


_LINE_ID = (
    "concat(l_orderkey, '-', l_linenumber, '-', l_partkey, '-', l_suppkey, '-', "
    "strftime(l_shipdate, '%Y%m%d'))"
)


def _unit_case() -> str:
    arms = []
    for part, (_a, units) in ACTIVITY_OF_PART.items():
        arms.append(
            f"WHEN p_type = '{part}' THEN CASE l_linenumber % 3 WHEN 0 THEN {_q(units[0])} "
            f"WHEN 1 THEN {_q(units[1])} ELSE {_q(units[2])} END"
        )
    return "CASE WHEN l_linenumber = 7 THEN 'kg' " + " ".join(arms) + " END"


def _multipliers() -> list[tuple]:
    """(factor, unit, ratio, numerator ratio, tonnes per unit) by 28-digit arithmetic."""
    direct = {(a, b): r for a, b, r in UNIT_RATIOS}
    units = sorted({x for a, b, _ in UNIT_RATIOS for x in (a, b)} | {"usd"})
    out = []
    for f in FACTORS:
        value, (num, den) = Decimal(f[6]), f[7].split("/")
        to_tonnes = {"kgCO2e": Decimal("0.001")}[num]
        den_norm = den.lower()
        for u in {*units, den_norm}:
            if u == den_norm:
                ratio = Decimal(1)
            elif (u, den_norm) in direct:
                ratio = direct[(u, den_norm)]
            elif (den_norm, u) in direct:
                ratio = Decimal(1) / direct[(den_norm, u)]
            else:
                continue
            out.append((f[0], u, format(ratio, "f"), to_tonnes, format(ratio * value * to_tonnes, "f"),
                        den))
    return out


def _rule_case(position: int) -> str:
    arms = []
    for keywords, *outcome in SCOPE_RULES:
        hit = " OR ".join(f"contains(txt, {_q(k)})" for k in keywords)
        arms.append(f"WHEN {hit} THEN {_q(outcome[position])}")
    return "CASE " + " ".join(arms) + f" ELSE {_q(DEFAULT_SCOPE_RULE[position])} END"


_PLACE_CASE = "CASE s_nationkey % 5 " + " ".join(
    f"WHEN {n} THEN '{p}'" for n, p in enumerate(PLACES)
) + " END"

_CTES: dict[str, tuple[tuple[str, ...], str]] = {
    "act": ((), f"""
        SELECT {_LINE_ID} AS activity_id, 'doc-' || o_custkey AS source_document_id,
          'L-' || l_linenumber AS raw_line_ref, c_mktsegment AS entity_id,
          CASE p_type {' '.join(f"WHEN '{p}' THEN '{a}'" for p, (a, _u) in ACTIVITY_OF_PART.items())}
          END AS activity_type,
          CAST(l_quantity AS DECIMAL(20,6)) AS quantity, {_unit_case()} AS unit,
          {_PLACE_CASE} AS geography, CAST(l_shipdate AS DATE) AS period_start,
          CAST(l_shipdate AS DATE) + 29 AS period_end,
          'TOKEN_SUPP_' || upper(substr(sha256(lower(s_name)), 1, 10)) AS supplier_ref,
          l_shipdate AS created_at, l_returnflag AS return_flag, l_linestatus AS line_status,
          l_discount, l_tax, l_linenumber
        FROM lineitem JOIN orders ON l_orderkey = o_orderkey
          JOIN customer ON o_custkey = c_custkey
          JOIN part ON l_partkey = p_partkey JOIN supplier ON l_suppkey = s_suppkey"""),
    "cls": (("act",), f"""
        SELECT * EXCLUDE (txt), CASE WHEN classification_confidence >= {CONFIDENCE_THRESHOLD}
            THEN 'classified' ELSE 'pending_review' END AS status
        FROM (SELECT *, CAST({_rule_case(0)} AS INTEGER) AS scope,
            {_rule_case(1)} AS ghg_category,
            CAST({_rule_case(2)} AS DOUBLE) AS classification_confidence,
            {_rule_case(3)} AS reasoning
          FROM (SELECT *, lower(replace(activity_type || ' ' || unit || ' ' || raw_line_ref,
                '_', ' ')) AS txt FROM act))"""),
    "fac": ((), f"""
        SELECT f_id AS factor_id, f_source, f_version, f_type, f_geo,
          CAST(f_value AS DECIMAL(20,8)) AS factor_value, f_unit AS factor_unit,
          CAST(f_pub AS DATE) AS f_pub, CAST(f_from AS DATE) AS f_from, CAST(f_to AS DATE) AS f_to
        FROM {_values(FACTORS)} AS v(f_id, f_source, f_version, f_type, f_geo, f_u, f_value,
          f_unit, f_pub, f_from, f_to)"""),
    "mul": ((), f"""
        SELECT m_id, m_unit, CAST(ratio AS DECIMAL(28,22)) AS unit_ratio,
          CAST(num AS DECIMAL(12,11)) AS numerator_ratio, CAST(mul AS DECIMAL(28,22)) AS multiplier,
          denominator
        FROM {_values(_multipliers())} AS v(m_id, m_unit, ratio, num, mul, denominator)"""),
    "matched": (("cls", "fac"), """
        SELECT a.*, f.* EXCLUDE (activity_id), COALESCE(f.lvl_name, 'none') AS fallback_level
        FROM cls a LEFT JOIN (
          SELECT DISTINCT activity_id, factor_id, f_source, f_version, factor_value, factor_unit,
            CASE lvl WHEN 1 THEN 'exact' WHEN 2 THEN 'national_fallback'
              ELSE 'global_fallback' END AS lvl_name
          FROM (
            SELECT c.activity_id, fac.*,
              CASE WHEN f_geo = geography THEN 1
                WHEN f_geo = split_part(geography, '-', 1) THEN 2 ELSE 3 END AS lvl,
              row_number() OVER (PARTITION BY c.activity_id ORDER BY
                CASE WHEN f_geo = geography THEN 1
                  WHEN f_geo = split_part(geography, '-', 1) THEN 2 ELSE 3 END,
                f_pub DESC, f_from DESC, f_source DESC, f_version DESC, factor_id DESC) AS rn
            FROM (SELECT DISTINCT activity_id, activity_type, geography, period_start FROM cls) c
              JOIN fac ON f_type = activity_type AND f_from <= period_start
                AND (f_to IS NULL OR f_to >= period_start)
                AND f_geo IN (geography, split_part(geography, '-', 1), 'GLO'))
          WHERE rn = 1) f ON a.activity_id = f.activity_id"""),
    "calc": (("matched", "mul"), """
        SELECT *, CASE WHEN factor_id IS NULL THEN 'pending_factor'
            WHEN multiplier IS NULL THEN 'calculation_error' ELSE 'computed' END AS calc_status,
          CAST(round(CAST(quantity AS DECIMAL(10,0)) * multiplier, 8) AS DECIMAL(20,8))
            AS result_tco2e,
          md5(activity_id || '|' || factor_id) AS calculation_id
        FROM matched LEFT JOIN mul ON factor_id = m_id AND lower(unit) = m_unit"""),
    "led": (("calc",), """
        SELECT *, year(period_start) AS yr FROM calc WHERE calc_status = 'computed'"""),
    "tam": (("led",), """
        SELECT * REPLACE (CAST(result_tco2e * CASE
            WHEN entity_id = 'BUILDING' AND yr = 1998 AND scope = 3 THEN 0.2
            WHEN entity_id = 'MACHINERY' AND yr = 1997 AND scope = 2 THEN 4.0
            WHEN l_discount >= 0.095 AND l_tax >= 0.075 AND l_linenumber = 1 THEN 40.0
            ELSE 1.0 END AS DECIMAL(20,8)) AS result_tco2e)
        FROM led WHERE NOT (entity_id = 'FURNITURE' AND scope = 1
          AND (yr = 1999 OR year(period_end) = 1999))"""),
    "spread": (("tam",), """
        SELECT * REPLACE (y AS yr) FROM (SELECT *, unnest(list_distinct([year(period_start),
          year(period_end)])) AS y FROM tam)"""),
    "yearly": (("spread",), """
        SELECT entity_id, yr, scope, sum(result_tco2e) AS t, sum(quantity) AS q, count(*) AS n
        FROM spread GROUP BY ALL"""),
    "pairs": (("yearly",), """
        SELECT DISTINCT c.entity_id, c.yr FROM yearly c JOIN yearly p
          ON c.entity_id = p.entity_id AND p.yr = c.yr - 1"""),
    "yoy": (("pairs",), f"""
        SELECT entity_id, CAST(yr AS VARCHAR) AS reporting_period,
          CASE WHEN pct <= -50 THEN 'YOY_DROP' ELSE 'YOY_SPIKE' END AS flag_type,
          CASE WHEN pct <= -70 THEN 'CRITICAL' ELSE 'WARNING' END AS severity,
          CASE WHEN pct <= -50
            THEN {_say(m.DROP_TITLE, size=_fixed('abs(pct)', 1), scope='scope')}
            ELSE {_say(m.SURGE_TITLE, size=_fixed('abs(pct)', 1), scope='scope')} END AS title,
          CASE WHEN pct <= -50
            THEN {_say(m.DROP_TEXT, size=_fixed('abs(pct)', 1), scope='scope',
                       activity=_fixed('act', 1), prior=_fixed('t', 2), current=_fixed('ct', 2))}
            ELSE {_say(m.SURGE_TEXT, size=_fixed('abs(pct)', 1), scope='scope',
                       activity=_fixed('act', 1))} END AS description,
          'OPEN' AS status, 'scope-' || scope AS subject_id, round(pct, 6) AS metric
        FROM (
          SELECT b.entity_id, b.yr + 1 AS yr, b.scope, b.t, COALESCE(c.t, 0) AS ct,
            CAST(COALESCE(c.t, 0) - b.t AS DOUBLE) / CAST(b.t AS DOUBLE) * 100 AS pct,
            CASE WHEN b.q > 0 THEN CAST(COALESCE(c.q, 0) - b.q AS DOUBLE) / CAST(b.q AS DOUBLE) * 100
              ELSE 0 END AS act
          FROM yearly b JOIN pairs p ON p.entity_id = b.entity_id AND p.yr = b.yr + 1
            LEFT JOIN yearly c ON c.entity_id = b.entity_id AND c.yr = b.yr + 1
              AND c.scope = b.scope
          WHERE b.t > 0)
        WHERE (pct <= -50 AND act > pct / 2) OR (pct > -50 AND pct >= 100 AND act < pct / 2)"""),
    "omi": (("pairs",), f"""
        SELECT b.entity_id, CAST(b.yr + 1 AS VARCHAR) AS reporting_period,
          'SCOPE_INCOMPLETENESS' AS flag_type, 'CRITICAL' AS severity,
          {_say(m.OMISSION_TITLE, scope='b.scope')} AS title,
          {_say(m.OMISSION_TEXT, scope='b.scope', baseline='b.yr', prior=_fixed('b.t', 2),
                year='b.yr + 1')} AS description,
          'OPEN' AS status, 'scope-' || b.scope AS subject_id, CAST(b.t AS DOUBLE) AS metric
        FROM yearly b JOIN pairs p ON p.entity_id = b.entity_id AND p.yr = b.yr + 1
        WHERE NOT EXISTS (SELECT 1 FROM yearly c WHERE c.entity_id = b.entity_id
          AND c.yr = b.yr + 1 AND c.scope = b.scope)"""),
    "zsc": (("spread",), """
        SELECT *, abs(x - mu) / sd AS z FROM (
          SELECT *, CAST(result_tco2e AS DOUBLE) / CAST(quantity AS DOUBLE) AS x,
            avg(CAST(result_tco2e AS DOUBLE) / CAST(quantity AS DOUBLE)) OVER w AS mu,
            stddev_samp(CAST(result_tco2e AS DOUBLE) / CAST(quantity AS DOUBLE)) OVER w AS sd,
            count(*) OVER w AS n,
            count(*) OVER (PARTITION BY entity_id, yr) AS period_n
          FROM spread
          WINDOW w AS (PARTITION BY entity_id, yr, activity_type, unit))
        WHERE n >= 3 AND period_n >= 3 AND sd > abs(mu) * 0.001 AND abs(x - mu) / sd >= 3"""),
    "out": (("zsc",), f"""
        SELECT entity_id, CAST(yr AS VARCHAR) AS reporting_period,
          'INTENSITY_OUTLIER' AS flag_type,
          CASE WHEN z >= 5 THEN 'CRITICAL' ELSE 'WARNING' END AS severity,
          {_say(m.OUTLIER_TITLE, activity_type='activity_type', z=_fixed('z', 2))} AS title,
          {_say(m.OUTLIER_TEXT, intensity=_fixed('x', 6), unit='unit', z=_fixed('z', 2),
                mean=_fixed('round(mu, 12)', 6))} AS description,
          'OPEN' AS status, calculation_id AS subject_id, round(z, 6) AS metric
        FROM zsc"""),
    "flags": (("yoy", "omi", "out"), """
        SELECT md5(entity_id || '|' || reporting_period || '|' || flag_type || '|' || subject_id)
          AS flag_id, * FROM (SELECT * FROM yoy UNION ALL SELECT * FROM omi
            UNION ALL SELECT * FROM out)"""),
    "inv": (("led",), """
        SELECT entity_id, yr, scope, ghg_category, sum(result_tco2e) AS t, count(*) AS n
        FROM led GROUP BY ALL"""),
    "dlines": (("led",), """
        SELECT md5(entity_id || '|GHG_PROTOCOL|' || yr) AS disclosure_id, calculation_id,
          scope, result_tco2e
        FROM led WHERE line_status = 'F'"""),
    "docs": ((), """
        SELECT 'doc-' || c_custkey AS document_id, c_mktsegment AS entity_id,
          lower(c_name) || '.csv' AS filename,
          CASE WHEN c_acctbal < 0 THEN 'failed' ELSE 'completed' END AS status
        FROM customer"""),
    "decisions": (("act",), """
        SELECT activity_id, CASE WHEN activity_type = 'office_supplies' THEN 3 ELSE 1 END AS n_scope,
          'mobile_combustion' AS n_category, 'rev-' || substr(supplier_ref, 12, 4) AS reviewer_id
        FROM act WHERE return_flag = 'A'
          AND activity_type IN ('mobile_combustion_gasoline', 'office_supplies')"""),
    "prof": ((), """
        SELECT c_name AS entity_id, abs(CAST(c_acctbal AS DECIMAL(14,2))) * 200000 AS rev,
          c_nationkey % 3 = 0 AS ca, abs(CAST(c_acctbal AS DECIMAL(14,2))) * 30000 AS turn,
          abs(CAST(c_acctbal AS DECIMAL(14,2))) * 5000 AS bal, c_custkey % 500 AS emp,
          c_nationkey % 2 = 0 AS eu
        FROM customer"""),
    "elig": (("prof",), f"""
        SELECT entity_id, 'CA_SB253' AS framework, rev > 1000000000 AND ca AS is_eligible,
          CASE WHEN rev > 1000000000 AND ca THEN {_say(m.SB253_YES, revenue=_money('rev'))}
            ELSE concat_ws('; ', CASE WHEN NOT rev > 1000000000 THEN
                {_say(m.SB253_REVENUE, revenue=_money('rev'))} END,
              CASE WHEN NOT ca THEN {_q(m.SB253_NEXUS)} END) || '.' END AS reason,
          CASE WHEN rev > 1000000000 AND ca THEN {_q(m.SB253_NOTES)}
            ELSE {_q(m.INELIGIBLE_NOTES)} END AS reporting_deadline_notes
        FROM prof
        UNION ALL
        SELECT entity_id, 'CSRD_ESRS_E1', CASE WHEN eu THEN met >= 2 ELSE turn > 150000000 END,
          CASE WHEN eu AND met >= 2 THEN {_say(m.CSRD_YES, met='met', employees='emp',
                turnover=_money('turn'), balance=_money('bal'))}
            WHEN eu THEN {_say(m.CSRD_NO, met='met')}
            WHEN turn > 150000000 THEN {_say(m.CSRD_FOREIGN_YES, turnover=_money('turn'))}
            ELSE {_say(m.CSRD_FOREIGN_NO, turnover=_money('turn'))} END,
          CASE WHEN eu AND met >= 2 THEN {_q(m.CSRD_NOTES)}
            WHEN NOT eu AND turn > 150000000 THEN {_q(m.CSRD_FOREIGN_NOTES)}
            ELSE {_q(m.INELIGIBLE_NOTES)} END
        FROM (SELECT *, CAST(emp > 250 AS INT) + CAST(turn > 50000000 AS INT)
          + CAST(bal > 25000000 AS INT) AS met FROM prof)
        UNION ALL
        SELECT entity_id, 'GHG_PROTOCOL', TRUE, {_q(m.GHG_PROTOCOL_YES)},
          {_q(m.GHG_PROTOCOL_NOTES)} FROM prof"""),
}


def _with(body: str, *names: str) -> str:
    needed: list[str] = []

    def add(name: str) -> None:
        for dep in _CTES[name][0]:
            add(dep)
        if name not in needed:
            needed.append(name)

    for n in names:
        add(n)
    ctes = ", ".join(f"{n} AS MATERIALIZED ({_CTES[n][1]})" for n in needed)
    return f"WITH {ctes} {body}" if needed else body


_SQL: dict[str, str] = {}


def _oracle(name: str, body: str, *ctes: str) -> None:
    _SQL[name] = _with(body, *ctes)


def oracles() -> dict[str, str]:
    return dict(_SQL)


# -- sources ---------------------------------------------------------------------------

_oracle("q_factor_load", """
    SELECT source, source_version, activity_type, geography,
      CAST(factor_value AS DOUBLE) AS factor_value, file_order
    FROM (
      SELECT 'CATALOGUE' AS source, p_brand AS source_version, lower(p_type) AS activity_type,
        'SIZE-' || (p_size % 3) AS geography, CAST(p_retailprice AS DECIMAL(20,8)) AS factor_value,
        p_partkey AS file_order,
        row_number() OVER (PARTITION BY p_brand, p_type, p_size % 3 ORDER BY p_partkey) AS rn
      FROM part)
    WHERE rn = 1 AND NOT (activity_type = 'economy' AND geography = 'SIZE-0'
      AND source_version IN (SELECT p_brand FROM part WHERE p_retailprice < 950))""")

_oracle("q_document_registry", """
    SELECT entity_id, filename, file_type, file_size_bytes, file_hash_sha256,
      'documents/' || entity_id || '/' || file_hash_sha256 || '/in_' || base AS storage_path,
      'pending' AS status
    FROM (
      SELECT source AS entity_id, '../in/' || lang || '_' || doc_id || ext AS filename,
        lang || '_' || doc_id || ext AS base,
        CASE WHEN ext IN ('.PDF', '.csv', '.xlsx') THEN lower(substr(ext, 2)) END AS file_type,
        CAST(strlen(text) AS BIGINT) AS file_size_bytes, sha256(text) AS file_hash_sha256
      FROM (SELECT *, CASE doc_id % 4 WHEN 0 THEN '.PDF' WHEN 1 THEN '.csv' WHEN 2 THEN '.xlsx'
          ELSE '.txt' END AS ext FROM documents))
    QUALIFY row_number() OVER (PARTITION BY entity_id, file_hash_sha256 ORDER BY filename) = 1""")

# -- cleansing -------------------------------------------------------------------------

_SYN_SQL = "CASE target " + " ".join(
    f"WHEN '{t}' THEN [{', '.join(_q(s) for s in syns)}][n % {len(syns)} + 1]"
    for t, syns in HEADER_SYNONYMS.items()
) + " END"
_oracle("q_header_mapping", f"""
    WITH syn AS (SELECT target, synonym, CAST(rnk AS INT) AS rnk FROM {_values(
        [(t, s, n) for t, syns in HEADER_SYNONYMS.items() for n, s in enumerate(syns)])}
        AS v(target, synonym, rnk)),
    hdr AS (
      SELECT file_id, pos, CASE WHEN target = 'unit' AND n % 5 = 0 THEN 'Comment'
          WHEN n % 3 = 0 THEN array_to_string([upper(w[1]) || substr(w, 2)
            FOR w IN string_split(name, ' ')], ' ')
          WHEN n % 3 = 1 THEN replace(upper(name), ' ', '_') ELSE '  ' || name || ' ' END AS header
      FROM (SELECT c_custkey AS file_id, c_custkey AS n, CAST(p AS INT) AS pos, target,
          {_SYN_SQL} AS name
        FROM customer, {_values([(t, n) for n, t in enumerate(
            [x for x in HEADER_SYNONYMS if x != "unit"] + ["unit"])])} AS v(target, p))),
    hit AS (
      SELECT file_id, target AS target_field, trim(header) AS header, CAST(pos AS BIGINT) AS pos
      FROM (SELECT *, regexp_replace(lower(trim(header)), '[\\s\\-_]+', ' ', 'g') AS norm FROM hdr)
        JOIN syn ON norm = synonym
      QUALIFY row_number() OVER (PARTITION BY file_id, target ORDER BY rnk, pos DESC) = 1)
    SELECT hit.*, COALESCE((SELECT string_agg(f, ', ' ORDER BY f) FROM {_values(
        [(f,) for f in REQUIRED_FIELDS])} AS r(f) WHERE f NOT IN (SELECT target_field FROM hit h
        WHERE h.file_id = hit.file_id)), '') AS missing_fields
    FROM hit""")

_RAW_LINES = f"""
    SELECT {_LINE_ID} AS line_id,
      CASE l_linenumber WHEN 1 THEN CAST(price AS VARCHAR)
        WHEN 2 THEN '$' || grouped WHEN 3 THEN '(' || grouped || ')' WHEN 4 THEN '€ ' || grouped
        WHEN 5 THEN '-' || CAST(price AS VARCHAR) WHEN 6 THEN ' usd ' || grouped || ' '
        ELSE 'approx. ' || CAST(price AS VARCHAR) END AS raw_quantity,
      CASE l_linenumber WHEN 3 THEN -price WHEN 5 THEN -price WHEN 7 THEN NULL ELSE price END AS qty,
      CASE l_orderkey % 8 WHEN 0 THEN strftime(l_shipdate, '%Y-%m-%d')
        WHEN 1 THEN strftime(l_shipdate, '%m/%d/%Y') WHEN 2 THEN strftime(l_shipdate, '%b %-d, %Y')
        WHEN 3 THEN strftime(l_shipdate, '%-d %B %Y') WHEN 4 THEN strftime(l_shipdate, '%Y/%-m/%-d')
        WHEN 5 THEN CAST(date_diff('day', DATE '1899-12-30', CAST(l_shipdate AS DATE)) AS VARCHAR)
        WHEN 6 THEN strftime(l_shipdate, '%Y-%m-%d') || 'T00:00:00Z'
        ELSE 'week ' || dayofyear(l_shipdate) END AS raw_date,
      CASE WHEN l_orderkey % 8 < 7 THEN strftime(l_shipdate, '%Y-%m-%d') END AS clean_date
    FROM (SELECT *, CAST(l_extendedprice AS DECIMAL(14,2)) AS price,
      format('{{:,.2f}}', CAST(CAST(l_extendedprice AS DECIMAL(14,2)) AS DOUBLE)) AS grouped
      FROM lineitem)"""
_oracle("q_clean_quantity", f"""
    SELECT line_id, raw_quantity, CAST(qty AS DOUBLE) AS quantity FROM ({_RAW_LINES})""")
_oracle("q_clean_date", f"SELECT line_id, raw_date, clean_date FROM ({_RAW_LINES})")

_oracle("q_activity_validate", f"""
    SELECT {_LINE_ID} AS line_id,
      CASE WHEN l_tax > 0.075 THEN NULL ELSE 'electricity_purchase' END AS activity_type,
      CASE WHEN l_linenumber = 7 THEN NULL ELSE l_quantity END AS quantity,
      CASE WHEN l_discount > 0.095 THEN NULL ELSE 'kWh' END AS unit,
      CASE WHEN l_returnflag = 'A' THEN 'GB' ELSE 'US' END AS geography,
      strftime(l_shipdate, '%Y-%m-%d') AS period_start,
      CASE WHEN l_returnflag = 'N' THEN NULL ELSE strftime(l_shipdate, '%Y-%m-%d') END AS period_end,
      'TOKEN_SUPP_' || upper(substr(sha256('supplier ' || l_suppkey), 1, 10)) AS supplier_ref,
      'row:' || l_linenumber AS raw_line_ref,
      concat_ws('; ', CASE WHEN l_tax > 0.075 THEN 'activity_type cannot be empty' END,
        CASE WHEN l_linenumber = 7 THEN 'invalid quantity value' END,
        CASE WHEN l_discount > 0.095 THEN 'unit cannot be empty' END,
        CASE WHEN l_returnflag = 'N' THEN 'invalid period_end date' END) AS row_errors
    FROM lineitem""")

_oracle("q_tokenize_supplier", """
    SELECT s_suppkey, CASE s_suppkey % 10 WHEN 0 THEN 'TOKEN_SUPP_UNKNOWN'
      WHEN 1 THEN 'TOKEN_SUPP_ABC' ELSE 'TOKEN_SUPP_' ||
        upper(substr(sha256(lower(s_name) || ' müller co'), 1, 10)) END AS token
    FROM supplier""")
_oracle("q_tokenize_account", """
    SELECT c_custkey, CASE WHEN c_custkey % 10 IN (0, 1) THEN 'TOKEN_ACCT_UNKNOWN'
      ELSE 'TOKEN_ACCT_' || upper(substr(sha256('ACCT' || c_custkey || c_nationkey), 1, 10)) END
      AS token
    FROM customer""")

# -- privacy and bills -----------------------------------------------------------------


def _acct(x: str) -> str:
    return f"'TOKEN_ACCT_' || upper(substr(sha256({x}), 1, 10))"


def _supp(name: str) -> str:
    return f"'TOKEN_SUPP_' || upper(substr(sha256({_q(name.lower())}), 1, 10))"


_oracle("q_redact_text", f"""
    SELECT doc_id, text || chr(10) || 'Paid to ' || {_supp('Regional Fuel Depot')} || ' and '
      || {_supp('Regional Fuel')} || '. Account Number: ' || {_acct("'98' || doc_id || '1104'")}
      || ', ref ' || {_acct("'ACCT77' || doc_id")} || '. Meter No: ' || {_acct("'MTR55' || doc_id")}
      || '. Tax ID: ' || {_acct("'1234' || doc_id")} || '. Again '
      || {_acct("'98' || doc_id || '1104'")} || ' and 98' || doc_id || '-11040 kWh.' AS redacted_text
    FROM documents""")
_oracle("q_token_map", f"""
    SELECT doc_id, kind, CASE kind WHEN 'supplier' THEN
        'TOKEN_SUPP_' || upper(substr(sha256(lower(raw_value)), 1, 10))
        ELSE {_acct("replace(raw_value, '-', '')")} END AS token, raw_value
    FROM (SELECT doc_id, unnest([
        {{'kind': 'supplier', 'raw_value': 'Regional Fuel Depot'}},
        {{'kind': 'supplier', 'raw_value': 'Regional Fuel'}},
        {{'kind': 'account', 'raw_value': '98' || doc_id || '-1104'}},
        {{'kind': 'account', 'raw_value': 'ACCT-77-' || doc_id}},
        {{'kind': 'account', 'raw_value': 'MTR-55' || doc_id}},
        {{'kind': 'account', 'raw_value': '12-34' || doc_id}}], recursive := true)
      FROM documents)""")
_oracle("q_redact_dictionary", """
    WITH named AS (
      SELECT doc_id, unnest(['supplier#' || lpad(CAST(doc_id % 97 AS VARCHAR), 9, '0'),
        'supplier#' || lpad(CAST(doc_id % 31 AS VARCHAR), 9, '0'),
        'supplier#' || lpad(CAST(doc_id % 13 AS VARCHAR), 9, '0')]) AS name FROM documents)
    SELECT doc_id, count(DISTINCT CASE WHEN s_name IS NOT NULL THEN name END) AS n_found,
      count(s_name) AS n_tokens, count(s_name) < count(*) AS leaks
    FROM named LEFT JOIN supplier ON lower(s_name) = name GROUP BY doc_id""")

_BILL = f"""
    SELECT doc_id, text, doc_id % 12 + 1 AS mon,
      CASE WHEN doc_id % 7 = 0 THEN NULL
        ELSE [{', '.join(_q(u) for u in KNOWN_UTILITIES)}][doc_id % {len(KNOWN_UTILITIES)} + 1]
        END AS named
    FROM documents"""
_PROVIDER = f"""
    SELECT b.doc_id, COALESCE(
        (SELECT u FROM {_values([(u, n) for n, u in enumerate(KNOWN_UTILITIES)])} AS v(u, o)
          WHERE regexp_matches(COALESCE(named, '') || chr(10) || text,
            '(?i)\\b' || replace(u, '&', '\\&') || '\\b')
          ORDER BY length(u) DESC, CAST(o AS INT) LIMIT 1),
        'Regional Fuel Depot ' || doc_id || chr(10) || 'Account Number') AS provider
    FROM ({_BILL}) b"""
_PROVIDER_TOKEN = (
    "'TOKEN_SUPP_' || upper(substr(sha256(lower(replace(provider, chr(10), ' '))), 1, 10))"
)
_GEO = "CASE doc_id % 3 WHEN 0 THEN 'CA' WHEN 1 THEN 'US-TX' ELSE 'US' END"
_oracle("q_geo_detect", f"SELECT doc_id, {_GEO} AS geography FROM documents")
_UNIT_ACTIVITY = {u: a for _s, u, a in BILL_UNITS}

# -- classification --------------------------------------------------------------------

_oracle("q_classify", """
    SELECT activity_id, activity_type, CAST(scope AS BIGINT) AS scope, ghg_category,
      classification_confidence, status FROM cls""", "cls")
_oracle("q_classify_summary", f"""
    SELECT entity_id, count(*) AS total_processed,
      count(*) FILTER (status = 'classified') AS classified_count,
      count(*) FILTER (status = 'pending_review') AS pending_review_count,
      count(*) FILTER (classification_confidence < {CONFIDENCE_THRESHOLD}) AS low_confidence_count
    FROM cls GROUP BY entity_id""", "cls")
_oracle("q_classify_audit", """
    SELECT 'ActivityData' AS entity_type, activity_id AS entity_id, 'CLASSIFY' AS action,
      'system:scope_classifier' AS actor, strftime(created_at, '%Y-%m-%d %H:%M:%S') AS event_ts,
      CAST(scope AS BIGINT) AS scope, ghg_category, status, reasoning FROM cls""", "cls")

_FOREIGN = f"""
    SELECT {_LINE_ID} AS line_id, CAST(l_linenumber AS BIGINT) AS scope,
      CASE l_returnflag WHEN 'A' THEN 'business_travel' WHEN 'N' THEN 'purchased_steam'
        ELSE 'unknown_category' END AS ghg_category,
      l_discount * 30 - 1 AS confidence
    FROM lineitem"""
_TAX = _values([(s, c, n) for s, cats in TAXONOMY.items() for n, c in enumerate(cats)])
_oracle("q_classification_normalize", f"""
    WITH tax AS (SELECT CAST(s AS BIGINT) AS s, c, CAST(n AS INT) AS n FROM {_TAX} AS v(s, c, n))
    SELECT line_id, scope, COALESCE(
        CASE WHEN EXISTS (SELECT 1 FROM tax WHERE s = scope AND c = ghg_category)
          THEN ghg_category END,
        (SELECT c FROM tax WHERE s = scope AND n = 0), ghg_category) AS ghg_category,
      greatest(0.0, least(1.0, confidence)) AS classification_confidence
    FROM ({_FOREIGN})""")
_oracle("q_taxonomy_violations", f"""
    WITH tax AS (SELECT CAST(s AS BIGINT) AS s, c FROM {_TAX} AS v(s, c, n))
    SELECT line_id, scope, ghg_category, scope IN (1, 2, 3) AS valid_scope,
      ghg_category IN (SELECT c FROM tax) AS valid_category
    FROM ({_FOREIGN}) f
    WHERE NOT EXISTS (SELECT 1 FROM tax WHERE s = f.scope AND c = f.ghg_category)""")

_oracle("q_review_apply", """
    SELECT c.activity_id, CAST(COALESCE(n_scope, scope) AS BIGINT) AS scope,
      COALESCE(n_category, ghg_category) AS ghg_category,
      CASE WHEN n_scope IS NULL THEN classification_confidence ELSE 1.0 END
        AS classification_confidence,
      CASE WHEN n_scope IS NULL THEN status ELSE 'classified' END AS status,
      n_scope IS NOT NULL AS reviewed,
      CAST(CASE WHEN n_scope IS NOT NULL THEN scope END AS BIGINT) AS old_scope,
      CASE WHEN n_scope IS NOT NULL THEN ghg_category END AS old_ghg_category,
      CASE WHEN n_scope IS NOT NULL THEN status END AS old_status, reviewer_id
    FROM cls c LEFT JOIN (SELECT * FROM decisions WHERE n_scope = 1) d
      ON c.activity_id = d.activity_id""", "cls", "decisions")
_oracle("q_review_rejected", f"""
    SELECT activity_id, reviewer_id,
      {_say(m.INVALID_CATEGORY, category='n_category', scope='n_scope')} AS error
    FROM decisions WHERE n_scope = 3""", "decisions")
_oracle("q_review_queue", """
    SELECT activity_id, entity_id, activity_type, classification_confidence,
      strftime(created_at, '%Y-%m-%d %H:%M:%S') AS created_at
    FROM cls WHERE status = 'pending_review'
    ORDER BY cls.created_at DESC, activity_id LIMIT 50 OFFSET 50""", "cls")
_oracle("q_classify_accuracy", f"""
    WITH lab AS (SELECT {_LINE_ID} AS activity_id,
        CASE p_type WHEN 'ECONOMY' THEN 2 WHEN 'LARGE' THEN 1 WHEN 'MEDIUM' THEN 1 ELSE 3 END AS es,
        CASE p_type WHEN 'ECONOMY' THEN 'purchased_electricity'
          WHEN 'LARGE' THEN 'stationary_combustion' WHEN 'MEDIUM' THEN 'mobile_combustion'
          WHEN 'PROMO' THEN 'business_travel'
          WHEN 'SMALL' THEN 'upstream_transportation_distribution'
          ELSE 'purchased_goods_services' END AS ec
      FROM lineitem JOIN part ON l_partkey = p_partkey),
    """ + _with("", "cls")[5:] + """
    SELECT CAST(es AS BIGINT) AS expected_scope, count(*) AS items,
      round(avg(CAST(scope = es AS INT)), 6) AS scope_accuracy,
      round(avg(CAST(ghg_category = ec AS INT)), 6) AS category_accuracy,
      count(*) FILTER (scope = 1) AS predicted_scope_1,
      count(*) FILTER (scope = 2) AS predicted_scope_2,
      count(*) FILTER (scope = 3) AS predicted_scope_3
    FROM cls JOIN lab ON cls.activity_id = lab.activity_id GROUP BY es""")

# -- factors and emissions -------------------------------------------------------------

_oracle("q_factor_match", """
    SELECT activity_id, factor_id, f_source AS factor_source, f_version AS factor_version,
      fallback_level FROM matched""", "matched")
_SQL["q_factor_match_merged"] = _SQL["q_factor_match"].replace(
    _PLACE_CASE, f"CASE WHEN l_quantity <= 45 THEN 'US-CA' ELSE {_PLACE_CASE} END")
_oracle("q_recalculated", """
    SELECT activity_id, factor_id, calc_status, CASE WHEN calc_status = 'computed'
      THEN CAST(result_tco2e AS DOUBLE) END AS result_tco2e
    FROM calc WHERE factor_id IN ('EL-US-2', 'GA-US-1')""", "calc")
_oracle("q_pending_factor", f"""
    SELECT activity_id, activity_type, geography, CAST(period_start AS VARCHAR) AS period_start,
      active AS has_active_factor,
      CASE WHEN active THEN {_say(m.NO_FACTOR_FOR_PLACE, geography='geography',
                                  activity_type='activity_type')}
        ELSE {_say(m.NO_ACTIVE_FACTOR, activity_type='activity_type', date='period_start')} END
        AS reason
    FROM (SELECT *, EXISTS (SELECT 1 FROM fac WHERE f_type = activity_type
        AND f_from <= period_start AND (f_to IS NULL OR f_to >= period_start)) AS active
      FROM matched WHERE factor_id IS NULL)""", "matched", "fac")
_oracle("q_unit_convert", """
    SELECT activity_id, unit, denominator, CAST(round(unit_ratio, 12) AS DOUBLE) AS unit_ratio,
      CAST(CAST(CAST(quantity AS DECIMAL(10,0)) * unit_ratio AS DECIMAL(24,9)) AS DOUBLE)
        AS converted_quantity
    FROM led""", "led")
_oracle("q_unit_errors", f"""
    SELECT activity_id, unit, factor_id, {_say(m.INCOMPATIBLE_UNITS, unit='unit',
        denominator="split_part(factor_unit, '/', 2)")} AS error
    FROM calc WHERE calc_status = 'calculation_error'""", "calc")
_oracle("q_factor_unit_parse", """
    SELECT p_partkey, factor_unit, numerator, denominator,
      replace(lower(trim(factor_unit)), ' ', '') AS normalized,
      CASE WHEN bare IN ('tco2e', 'mtco2e') THEN 1.0 WHEN bare LIKE '%kg%' THEN 0.001
        WHEN bare LIKE '%g%' THEN 0.000001 WHEN bare LIKE '%lb%' THEN 0.00045359237
        ELSE 1.0 END::DOUBLE AS numerator_ratio
    FROM (SELECT *, regexp_replace(lower(numerator), '[_\\s\\-]', '', 'g') AS bare
      FROM (SELECT *, CASE WHEN len(string_split(factor_unit, '/')) = 2
            THEN trim(split_part(factor_unit, '/', 1)) ELSE trim(factor_unit) END AS numerator,
          CASE WHEN len(string_split(factor_unit, '/')) = 2
            THEN trim(split_part(factor_unit, '/', 2)) ELSE 'unit' END AS denominator
        FROM (SELECT p_partkey, CASE p_size % 8 WHEN 0 THEN 'kgCO2e/' || p_type
            WHEN 1 THEN ' g_CO2e / ' || p_type WHEN 2 THEN 'tCO2e/' || p_type
            WHEN 3 THEN 'lb CO2e/' || p_type WHEN 4 THEN 'MtCO2e/' || p_type WHEN 5 THEN 'kgCO2e'
            WHEN 6 THEN 'kg/' || p_type || '/year' ELSE 'tonne-CO2e/' || p_type END AS factor_unit
          FROM part)))""")
_oracle("q_emissions", """
    SELECT calculation_id, activity_id, factor_id, CAST(scope AS BIGINT) AS scope, ghg_category,
      CAST(result_tco2e AS DOUBLE) AS result_tco2e FROM led""", "led")
_TRIM = "rtrim(rtrim(CAST({} AS VARCHAR), '0'), '.')"
_oracle("q_formula", f"""
    SELECT activity_id, CAST(CAST(quantity AS BIGINT) AS VARCHAR) || ' ' || unit ||
      CASE WHEN unit_ratio <> 1 THEN ' [converted: ' || {_TRIM.format(
          'CAST(round(CAST(quantity AS DECIMAL(10,0)) * unit_ratio, 15) AS DECIMAL(32,15))')}
        || ' ' || denominator || ']' ELSE '' END ||
      ' * ' || {_TRIM.format('factor_value')} || ' ' || factor_unit || ' / 1000 [kg to t] = ' ||
      CAST(result_tco2e AS VARCHAR) || ' tCO2e' AS formula_applied
    FROM led""", "led")
_oracle("q_calc_status", "SELECT activity_id, fallback_level, calc_status FROM calc", "calc")
_oracle("q_calc_summary", """
    SELECT source_document_id, count(*) FILTER (calc_status = 'computed') AS computed_count,
      count(*) FILTER (calc_status = 'pending_factor') AS pending_factor_count,
      count(*) FILTER (calc_status = 'calculation_error') AS error_count
    FROM calc GROUP BY source_document_id""", "calc")
_oracle("q_calc_audit", f"""
    SELECT 'activity_data' AS entity_type, activity_id AS entity_id,
      CASE calc_status WHEN 'computed' THEN 'CALCULATE'
        WHEN 'pending_factor' THEN 'CALCULATE_FAILED_MISSING_FACTOR'
        ELSE 'CALCULATE_FAILED_INCOMPATIBLE_UNITS' END AS action, 'api_batch' AS actor,
      strftime(created_at, '%Y-%m-%d %H:%M:%S') AS event_ts,
      CASE WHEN calc_status = 'computed' THEN factor_id END AS emission_factor_id,
      CASE WHEN calc_status = 'computed' THEN fallback_level END AS fallback_level,
      CASE WHEN calc_status = 'computed' THEN CAST(result_tco2e AS VARCHAR) END AS result_tco2e,
      CASE WHEN calc_status <> 'pending_factor' THEN NULL
        WHEN EXISTS (SELECT 1 FROM fac WHERE f_type = activity_type AND f_from <= period_start
          AND (f_to IS NULL OR f_to >= period_start))
        THEN {_say(m.NO_FACTOR_FOR_PLACE, geography='geography', activity_type='activity_type')}
        ELSE {_say(m.NO_ACTIVE_FACTOR, activity_type='activity_type', date='period_start')} END
        AS reason,
      CASE WHEN calc_status = 'calculation_error' THEN {_say(m.INCOMPATIBLE_UNITS, unit='unit',
        denominator="split_part(factor_unit, '/', 2)")} END AS error
    FROM calc""", "calc", "fac")
_oracle("q_latest_calculation", """
    SELECT activity_id, md5(calculation_id || '|2') AS calculation_id, 'rerun' AS computed_by,
      strftime(max(created_at) + INTERVAL 1 DAY, '%Y-%m-%d %H:%M:%S') AS computed_at
    FROM led GROUP BY activity_id, calculation_id""", "led")

# -- inventory -------------------------------------------------------------------------


def _sum_scope(s: int) -> str:
    return f"COALESCE(sum(t) FILTER (scope = {s}), 0)"


_oracle("q_scope_totals", f"""
    SELECT entity_id, yr AS reporting_year, CAST(gross AS DOUBLE) AS gross_tco2e,
      CAST(n AS BIGINT) AS total_calculations, CAST(s AS BIGINT) AS scope,
      CAST(v AS DOUBLE) AS total_tco2e,
      CASE WHEN gross > 0 THEN round(CAST(v AS DOUBLE) / CAST(gross AS DOUBLE) * 100, 2)
        ELSE 0 END AS share_percentage
    FROM (SELECT *, unnest([1, 2, 3]) AS s, unnest([s1, s2, s3]) AS v
      FROM (SELECT entity_id, yr, sum(t) AS gross, sum(n) AS n, {_sum_scope(1)} AS s1,
          {_sum_scope(2)} AS s2, {_sum_scope(3)} AS s3 FROM inv GROUP BY ALL))""", "inv")
_oracle("q_hotspots", """
    SELECT entity_id, yr AS reporting_year, rk AS hotspot_rank, ghg_category,
      CAST(sc AS BIGINT) AS scope, CAST(t AS DOUBLE) AS total_tco2e,
      round(CAST(t AS DOUBLE) / CAST(gross AS DOUBLE) * 100, 2) AS share_percentage,
      CAST(n AS BIGINT) AS activity_count
    FROM (SELECT *, row_number() OVER (PARTITION BY entity_id, yr ORDER BY t DESC, ghg_category)
          AS rk, sum(t) OVER (PARTITION BY entity_id, yr) AS gross
      FROM (SELECT entity_id, yr, ghg_category, max(scope) AS sc, sum(t) AS t, sum(n) AS n
        FROM inv GROUP BY ALL))
    WHERE rk <= 5""", "inv")
_SQL["q_hotspots_kept"] = _SQL["q_hotspots"]
_oracle("q_trend", f"""
    SELECT entity_id, yr AS reporting_year,
      {', '.join(f'CAST({_sum_scope(s)} AS DOUBLE) AS scope{s}_tco2e' for s in (1, 2, 3))},
      CAST(sum(t) AS DOUBLE) AS total_tco2e
    FROM inv GROUP BY ALL""", "inv")
_oracle("q_open_flags", """
    SELECT entity_id, count(*) AS open_anomalies_count,
      count(*) FILTER (severity = 'CRITICAL') AS critical_anomalies_count
    FROM flags GROUP BY entity_id""", "flags")
_oracle("q_dashboard", f"""
    WITH {_with("", "tam", "flags")[5:]},
    ti AS (SELECT entity_id, year(period_start) AS yr, scope, ghg_category,
        sum(result_tco2e) AS t, count(*) AS n FROM tam GROUP BY ALL),
    yr_tot AS (SELECT entity_id, yr, sum(t) AS gross, sum(n) AS n, {_sum_scope(1)} AS s1,
        {_sum_scope(2)} AS s2, {_sum_scope(3)} AS s3 FROM ti GROUP BY ALL),
    cat AS (SELECT entity_id, yr, ghg_category, sum(t) AS t FROM ti GROUP BY ALL),
    fl AS (SELECT entity_id, count(*) AS o, count(*) FILTER (severity = 'CRITICAL') AS c
      FROM flags GROUP BY entity_id)
    SELECT y.entity_id, y.yr AS reporting_year, CAST(gross AS DOUBLE) AS gross_tco2e,
      CAST(s1 AS DOUBLE) AS scope1_tco2e, CAST(s2 AS DOUBLE) AS scope2_tco2e,
      CAST(s3 AS DOUBLE) AS scope3_tco2e, CAST(n AS BIGINT) AS total_calculations,
      (SELECT least(count(*), 5) FROM cat WHERE cat.entity_id = y.entity_id AND cat.yr = y.yr)
        AS hotspot_count,
      (SELECT ghg_category FROM cat WHERE cat.entity_id = y.entity_id AND cat.yr = y.yr
        ORDER BY t DESC, ghg_category LIMIT 1) AS top_category,
      (SELECT CAST(max(t) AS DOUBLE) FROM cat WHERE cat.entity_id = y.entity_id AND cat.yr = y.yr)
        AS top_category_tco2e,
      CASE WHEN gross > 0 THEN round(CAST(s3 AS DOUBLE) / CAST(gross AS DOUBLE) * 100, 2)
        ELSE 0 END AS scope3_share,
      (SELECT count(*) FROM yr_tot z WHERE z.entity_id = y.entity_id) AS trend_points,
      (SELECT CAST(arg_max(gross, yr) AS DOUBLE) FROM yr_tot z WHERE z.entity_id = y.entity_id)
        AS latest_total_tco2e,
      COALESCE(o, 0) AS open_anomalies_count, COALESCE(c, 0) AS critical_anomalies_count
    FROM yr_tot y LEFT JOIN fl ON fl.entity_id = y.entity_id""")
_oracle("q_period_filter", f"""
    WITH {_with("", "led")[5:]},
    req AS (SELECT DISTINCT c_mktsegment AS entity_id, p AS reporting_period,
        substr(p, 1, 4) AS py FROM customer, (VALUES ('1998'), ('1999-Q2'), ('2050')) AS v(p)),
    hits AS (SELECT r.entity_id, reporting_period, result_tco2e,
        py = CAST(yr AS VARCHAR) AS in_start,
        reporting_period = CAST(yr AS VARCHAR)
          OR reporting_period = CAST(year(period_end) AS VARCHAR) AS in_overlap,
        reporting_period = CAST(yr AS VARCHAR)
          OR reporting_period = yr || '-Q' || quarter(period_start) AS in_quarter
      FROM req r JOIN led ON led.entity_id = r.entity_id),
    ans AS (SELECT *, bool_or(in_start) OVER (PARTITION BY entity_id, reporting_period) AS answered
      FROM hits),
    pick AS (
      SELECT *, 'overlap_year' AS mode, FALSE AS fallback_all, FALSE AS fb FROM ans WHERE in_overlap
      UNION ALL SELECT *, 'start_year', FALSE, FALSE FROM ans WHERE in_start
      UNION ALL SELECT *, 'start_year', TRUE, NOT answered FROM ans WHERE in_start OR NOT answered
      UNION ALL SELECT *, 'quarter', FALSE, FALSE FROM ans WHERE in_quarter)
    SELECT entity_id, reporting_period, fb AS is_fallback, count(*) AS n_rows,
      CAST(sum(result_tco2e) AS DOUBLE) AS tco2e, mode, fallback_all
    FROM pick GROUP BY ALL""")

# -- disclosures -----------------------------------------------------------------------

_oracle("q_disclosure_rollup", f"""
    WITH {_with("", "led")[5:]},
    r AS (SELECT entity_id, yr, scope, ghg_category, sum(result_tco2e) AS t, count(*) AS n,
        2 - grouping(scope) - grouping(ghg_category) AS lvl
      FROM led GROUP BY GROUPING SETS ((entity_id, yr), (entity_id, yr, scope),
        (entity_id, yr, scope, ghg_category)))
    SELECT entity_id, yr AS reporting_year, CAST(scope AS BIGINT) AS scope, ghg_category,
      CAST(t AS DOUBLE) AS total_tco2e, n AS line_item_count, CAST(lvl AS BIGINT) AS level,
      round(CAST(t AS DOUBLE) / CAST(max(t) FILTER (lvl = 0) OVER (PARTITION BY entity_id, yr)
        AS DOUBLE) * 100, 1) AS proportion_pct
    FROM r""")
_oracle("q_citations", """
    SELECT entity_id, yr AS reporting_year, CAST(scope AS BIGINT) AS scope, ghg_category,
      count(*) AS line_item_count,
      array_to_string([substr(x, 1, 8) || '...' FOR x IN
        list_slice(list(calculation_id ORDER BY calculation_id), 1, 3)], ', ')
      || CASE WHEN count(*) > 3 THEN ' (+' || (count(*) - 3) || ' more)' ELSE '' END
        AS citation_text
    FROM led GROUP BY ALL""", "led")
_oracle("q_eligibility", """
    SELECT entity_id, framework, is_eligible, reason, reporting_deadline_notes FROM elig""",
        "elig")
_oracle("q_disclosure_gate", f"""
    SELECT r.entity_id, r.framework, '1999' AS reporting_period,
      CASE WHEN NOT COALESCE(e.is_eligible, TRUE)
        THEN {_say(m.GATE_REJECTION, framework='r.framework', reason='e.reason')} END AS rejection
    FROM (SELECT CASE WHEN c_acctbal < 0 THEN 'No profile ' || c_name ELSE c_name END AS entity_id,
        unnest(['CA_SB253', 'CSRD_ESRS_E1', 'GHG_PROTOCOL']) AS framework FROM customer) r
      LEFT JOIN elig e ON e.entity_id = r.entity_id AND e.framework = r.framework""", "elig")
_FRAMEWORK_TITLE = (
    "CASE framework WHEN 'CA_SB253' THEN 'California Senate Bill 253 (Climate Corporate Data "
    "Accountability Act)' ELSE 'GHG Protocol Corporate Accounting and Reporting Standard' END"
)
_oracle("q_disclosures", f"""
    WITH {_with("", "led", "act")[5:]},
    ok AS (SELECT c_mktsegment AS entity_id,
        sum(abs(CAST(c_acctbal AS DECIMAL(14,2)))) * 1000 > 1000000000
          AND count(*) FILTER (c_nationkey = 0) % 2 = 0 AS sb FROM customer GROUP BY 1),
    req AS (SELECT DISTINCT a.entity_id, framework, CAST(year(period_start) AS VARCHAR) AS p
      FROM act a JOIN ok ON ok.entity_id = a.entity_id,
        (VALUES ('CA_SB253'), ('GHG_PROTOCOL')) AS v(framework)
      WHERE framework = 'GHG_PROTOCOL' OR sb),
    ans AS (SELECT req.*, EXISTS (SELECT 1 FROM led WHERE led.entity_id = req.entity_id
        AND CAST(led.yr AS VARCHAR) = p) AS answered FROM req)
    SELECT md5(r.entity_id || '|' || framework || '|' || p) AS disclosure_id, r.entity_id, framework,
      p AS reporting_period, 'draft' AS status,
      'disclosures/' || r.entity_id || '/' || framework || '_' || p || '.pdf'
        AS generated_document_ref,
      {_FRAMEWORK_TITLE} AS framework_title,
      CAST(COALESCE(sum(result_tco2e), 0) AS DOUBLE) AS total_tco2e,
      {', '.join(f'CAST(COALESCE(sum(result_tco2e) FILTER (scope = {s}), 0) AS DOUBLE) AS scope_{s}_tco2e'
                 for s in (1, 2, 3))},
      count(result_tco2e) AS line_item_count
    FROM ans r LEFT JOIN led ON led.entity_id = r.entity_id
      AND (CAST(led.yr AS VARCHAR) = p OR NOT answered)
    GROUP BY r.entity_id, framework, p""")
_oracle("q_disclosure_links", """
    SELECT calculation_id, md5(entity_id || '|GHG_PROTOCOL|' || yr) AS disclosure_id,
      'GHG_PROTOCOL' AS framework, CAST(yr AS VARCHAR) AS reporting_period, 'draft' AS status
    FROM (SELECT DISTINCT calculation_id, entity_id, yr FROM led WHERE line_status = 'F')""", "led")
_oracle("q_disclosure_totals", f"""
    SELECT disclosure_id, CAST(sum(result_tco2e) AS DOUBLE) AS total_tco2e,
      {', '.join(f'CAST(COALESCE(sum(result_tco2e) FILTER (scope = {s}), 0) AS DOUBLE) AS scope_{s}_tco2e'
                 for s in (1, 2, 3))},
      count(*) AS line_item_count
    FROM dlines GROUP BY disclosure_id""", "dlines")

# -- lineage ---------------------------------------------------------------------------

_oracle("q_trace", """
    SELECT calculation_id, CAST(result_tco2e AS DOUBLE) AS result_tco2e, activity_type,
      CAST(quantity AS DOUBLE) AS quantity, unit, f_source AS factor_source,
      CAST(factor_value AS DOUBLE) AS factor_value, filename, d.status AS document_status,
      e.subject_kind, e.action, e.actor, strftime(e.ts, '%Y-%m-%d %H:%M:%S') AS event_ts
    FROM led LEFT JOIN docs d ON d.document_id = led.source_document_id
      JOIN (
        SELECT 'activity' AS subject_kind, activity_id AS sid, 'CLASSIFY' AS action,
          'system:scope_classifier' AS actor, created_at AS ts FROM cls
        UNION ALL SELECT 'document', 'doc-' || event_id, upper(event_type), 'user-' || user_id, ts
          FROM events) e
      ON (e.subject_kind = 'activity' AND e.sid = led.activity_id)
        OR (e.subject_kind = 'document' AND e.sid = d.document_id)""", "led", "docs", "cls")
_oracle("q_calc_deletable", f"""
    SELECT calculation_id, CAST(line_status = 'F' AS BIGINT) AS blocking_count,
      line_status <> 'F' AS can_delete,
      CASE WHEN line_status = 'F' THEN {_say(m.CALCULATION_BLOCKED, id='calculation_id',
                                             count='1')} END AS reason
    FROM led""", "led")
_oracle("q_factor_deletable", f"""
    SELECT factor_id, n AS calculation_count, n = 0 AS can_delete,
      CASE WHEN n > 0 THEN {_say(m.FACTOR_BLOCKED, id='factor_id', count='n')} END AS reason
    FROM (SELECT fac.factor_id, (SELECT count(*) FROM led WHERE led.factor_id = fac.factor_id) AS n
      FROM fac)""", "fac", "led")
_oracle("q_guarded_delete", f"""
    SELECT calculation_id, CASE WHEN line_status = 'F' THEN 'blocked' ELSE 'deleted' END AS outcome,
      CASE WHEN line_status = 'F' THEN {_say(m.CALCULATION_BLOCKED, id='calculation_id',
                                             count='1')} END AS reason
    FROM led WHERE return_flag = 'R'
    UNION ALL SELECT DISTINCT 'missing-' || entity_id, 'not_found', NULL FROM led""", "led")
_oracle("q_audit_query", """
    SELECT 'doc-' || event_id AS entity_id, upper(event_type) AS action,
      'user-' || user_id AS actor, strftime(ts, '%Y-%m-%d %H:%M:%S') AS event_ts, props AS detail,
      event_id
    FROM events WHERE event_type = 'purchase' ORDER BY ts DESC, event_id DESC LIMIT 100 OFFSET 100""")
_oracle("q_document_detail", """
    SELECT document_id, docs.entity_id, filename, docs.status, activity_id, raw_line_ref,
      activity_type, CAST(quantity AS DOUBLE) AS quantity, unit, cls.status AS activity_status
    FROM docs LEFT JOIN cls ON source_document_id = document_id""", "docs", "cls")

# -- anomalies and narratives ----------------------------------------------------------

_oracle("q_yoy", "SELECT * FROM yoy", "yoy")
_oracle("q_scope_omission", "SELECT * FROM omi", "omi")
_oracle("q_intensity_outliers", """
    SELECT calculation_id, activity_id, entity_id, yr AS reporting_year, activity_type, unit,
      n AS cohort_size, round(x, 9) AS intensity, round(round(mu, 12), 9) AS cohort_mean,
      round(z, 6) AS z_score FROM zsc""", "zsc")
_SQL["q_intensity_kept"] = _SQL["q_intensity_outliers"]
_oracle("q_anomaly_scan", "SELECT * REPLACE (round(metric, 6) AS metric) FROM flags", "flags")
_oracle("q_anomaly_list", """
    SELECT flag_id, entity_id, reporting_period, flag_type, title FROM flags
    WHERE severity = 'CRITICAL' ORDER BY reporting_period DESC, flag_id LIMIT 50""", "flags")
_oracle("q_flag_resolution", """
    SELECT flag_id, flag_type, severity,
      CASE WHEN NOT decided THEN 'OPEN' WHEN severity = 'CRITICAL' THEN 'CONFIRMED'
        ELSE 'DISMISSED' END AS status,
      CASE WHEN decided THEN 'reviewed ' || subject_id END AS resolution_notes,
      CASE WHEN decided THEN 'auditor of ' || entity_id END AS resolved_by
    FROM (SELECT *, reporting_period < '2000' AND flag_type <> 'YOY_SPIKE' AS decided FROM flags)""",
        "flags")

_CONTEXT = f"""
    SELECT entity_id, yr AS reporting_year, t, t1, t2, t3, b, b1, b2, b3,
      CASE WHEN b > 0 THEN CAST(t - b AS DOUBLE) / CAST(b AS DOUBLE) * 100 END AS pct
    FROM (SELECT c.entity_id, c.yr, c.t, c.t1, c.t2, c.t3, COALESCE(p.t, 0) AS b,
        COALESCE(p.t1, 0) AS b1, COALESCE(p.t2, 0) AS b2, COALESCE(p.t3, 0) AS b3
      FROM tot c LEFT JOIN tot p ON p.entity_id = c.entity_id AND p.yr = c.yr - 1)"""
_TOT = f"""tot AS (SELECT entity_id, yr, sum(t) AS t, {_sum_scope(1)} AS t1, {_sum_scope(2)} AS t2,
      {_sum_scope(3)} AS t3 FROM yearly GROUP BY ALL)"""
_PCT = "COALESCE(format('{:+.2f}', pct) || '%', 'N/A')"
_oracle("q_ledger_context", f"""
    WITH {_with("", "yearly")[5:]}, {_TOT}
    SELECT entity_id, reporting_year, CAST(t AS DOUBLE) AS total_tco2e,
      CAST(t1 AS DOUBLE) AS scope1_tco2e, CAST(t2 AS DOUBLE) AS scope2_tco2e,
      CAST(t3 AS DOUBLE) AS scope3_tco2e, CAST(b AS DOUBLE) AS base_total_tco2e,
      CAST(b1 AS DOUBLE) AS base_scope1_tco2e, CAST(b2 AS DOUBLE) AS base_scope2_tco2e,
      CAST(b3 AS DOUBLE) AS base_scope3_tco2e, round(pct, 6) AS ledger_pct_change,
      {_say(m.CONTEXT_CURRENT, year='reporting_year', total=_fixed('t', 2), s1=_fixed('t1', 2),
            s2=_fixed('t2', 2), s3=_fixed('t3', 2))} || chr(10) ||
      {_say(m.CONTEXT_BASELINE, year='reporting_year - 1', total=_fixed('b', 2),
            s1=_fixed('b1', 2), s2=_fixed('b2', 2), s3=_fixed('b3', 2), change=_PCT)} AS data_context
    FROM ({_CONTEXT})""")
_CLAIM = r"(?i)((\d+(?:\.\d+)?)%\s*(?:reduction|decrease|cut))"
_oracle("q_narrative_claims", f"""
    WITH {_with("", "yearly")[5:]}, {_TOT}, ctx AS ({_CONTEXT}),
    nar AS (SELECT doc_id AS narrative_id,
        ['AUTOMOBILE', 'BUILDING', 'FURNITURE', 'HOUSEHOLD', 'MACHINERY'][doc_id % 5 + 1]
          AS entity_id, doc_id % 6 + 1996 AS reporting_year,
        text || chr(10) || 'In the past year we achieved a ' || (doc_id % 60)
          || '% reduction of our footprint.' AS narrative FROM documents),
    cl AS (SELECT *, regexp_extract(narrative, {_q(_CLAIM)}, 1) AS claim_text,
        CAST(regexp_extract(narrative, {_q(_CLAIM)}, 2) AS DOUBLE) AS claimed_pct FROM nar)
    SELECT narrative_id, cl.entity_id, CAST(cl.reporting_year AS BIGINT) AS reporting_year,
      claim_text, claimed_pct,
      CASE WHEN claimed_pct > 20 THEN 'POTENTIAL_GREENWASHING' ELSE 'SUPPORTED' END AS verdict,
      CASE WHEN claimed_pct > 20 THEN 'FLAGGED' ELSE 'CLEAN' END AS overall_status,
      {_PCT} AS actual_metric
    FROM cl LEFT JOIN ctx ON ctx.entity_id = cl.entity_id
      AND ctx.reporting_year = cl.reporting_year""")

_CHOSEN = """cmp AS (SELECT DISTINCT entity_id, year(period_start) AS yr,
      CASE year(period_start) % 3 WHEN 1 THEN year(period_start) - 2 WHEN 2 THEN 1995 END AS base
    FROM tam)"""
_BOTH = """both_years AS (
      SELECT c.entity_id, c.yr, c.base, b.scope, b.t, COALESCE(n.t, 0) AS ct, n.t IS NULL AS gone,
        CAST(COALESCE(n.t, 0) - b.t AS DOUBLE) / CAST(b.t AS DOUBLE) * 100 AS pct,
        CASE WHEN b.q > 0 THEN CAST(COALESCE(n.q, 0) - b.q AS DOUBLE) / CAST(b.q AS DOUBLE) * 100
          ELSE 0 END AS act
      FROM cmp c JOIN yearly b ON b.entity_id = c.entity_id AND b.yr = c.base
        LEFT JOIN yearly n ON n.entity_id = c.entity_id AND n.yr = c.yr AND n.scope = b.scope
      WHERE b.t > 0 AND EXISTS (SELECT 1 FROM yearly z WHERE z.entity_id = c.entity_id
        AND z.yr = c.yr)),
    varied AS (SELECT * FROM both_years WHERE (pct <= -50 AND act > pct / 2)
      OR (pct > -50 AND pct >= 100 AND act < pct / 2))"""
_oracle("q_yoy_chosen", f"""
    WITH {_with("", "tam", "yearly")[5:]}, {_CHOSEN}, {_BOTH}
    SELECT entity_id, CAST(yr AS VARCHAR) AS reporting_period,
      CASE WHEN pct <= -50 THEN 'YOY_DROP' ELSE 'YOY_SPIKE' END AS flag_type,
      'scope-' || scope AS subject_id,
      CASE WHEN pct <= -70 THEN 'CRITICAL' ELSE 'WARNING' END AS severity,
      CASE WHEN pct <= -50
        THEN {_say(m.DROP_TEXT, size=_fixed('abs(pct)', 1), scope='scope',
                   activity=_fixed('act', 1), prior=_fixed('t', 2), current=_fixed('ct', 2))}
        ELSE {_say(m.SURGE_TEXT, size=_fixed('abs(pct)', 1), scope='scope',
                   activity=_fixed('act', 1))} END AS description,
      CAST(base AS VARCHAR) AS baseline_period, CAST(t AS DOUBLE) AS prior_tco2e,
      CAST(ct AS DOUBLE) AS current_tco2e
    FROM varied
    UNION ALL SELECT entity_id, CAST(yr AS VARCHAR), 'SCOPE_INCOMPLETENESS', 'scope-' || scope,
      'CRITICAL', {_say(m.OMISSION_TEXT, scope='scope', baseline='base', prior=_fixed('t', 2),
                        year='yr')}, CAST(base AS VARCHAR), CAST(t AS DOUBLE), 0
    FROM both_years WHERE gone""")
_oracle("q_scan_audit", f"""
    WITH {_with("", "tam", "yearly", "out")[5:]}, {_CHOSEN}, {_BOTH},
    found AS (SELECT entity_id, CAST(yr AS VARCHAR) AS p FROM varied
      UNION ALL SELECT entity_id, CAST(yr AS VARCHAR) FROM both_years WHERE gone
      UNION ALL SELECT entity_id, reporting_period FROM out)
    SELECT 'anomaly_scan' AS entity_type, entity_id, 'ANOMALY_SCAN' AS action,
      'system:anomaly_detector' AS actor, CAST(yr AS VARCHAR) AS current_period,
      CAST(base AS VARCHAR) AS baseline_period,
      (SELECT count(*) FROM found f WHERE f.entity_id = c.entity_id AND p = CAST(c.yr AS VARCHAR))
        AS flags_generated
    FROM cmp c""")
_oracle("q_context_chosen", f"""
    WITH {_with("", "tam", "yearly")[5:]}, {_CHOSEN}, {_TOT},
    ctx AS (SELECT c.entity_id, c.yr, c.base, n.t, n.t1, n.t2, n.t3, COALESCE(p.t, 0) AS b,
        COALESCE(p.t1, 0) AS b1, COALESCE(p.t2, 0) AS b2, COALESCE(p.t3, 0) AS b3,
        CASE WHEN p.t > 0 THEN CAST(n.t - p.t AS DOUBLE) / CAST(p.t AS DOUBLE) * 100 END AS pct
      FROM cmp c JOIN tot n ON n.entity_id = c.entity_id AND n.yr = c.yr
        LEFT JOIN tot p ON p.entity_id = c.entity_id AND p.yr = c.base)
    SELECT entity_id, CAST(yr AS BIGINT) AS reporting_year, CAST(base AS BIGINT) AS baseline_year,
      {_say(m.CONTEXT_CURRENT, year='yr', total=_fixed('t', 2), s1=_fixed('t1', 2),
            s2=_fixed('t2', 2), s3=_fixed('t3', 2))} ||
      CASE WHEN base IS NULL THEN '' ELSE chr(10) ||
      {_say(m.CONTEXT_BASELINE, year='base', total=_fixed('b', 2), s1=_fixed('b1', 2),
            s2=_fixed('b2', 2), s3=_fixed('b3', 2), change=_PCT)} END AS data_context
    FROM ctx""")
_oracle("q_narrative_flags", """
    SELECT CAST(doc_id AS VARCHAR) AS subject_id,
      ['AUTOMOBILE', 'BUILDING', 'FURNITURE', 'HOUSEHOLD', 'MACHINERY'][doc_id % 5 + 1]
        AS entity_id, CAST(doc_id % 6 + 1996 AS VARCHAR) AS reporting_period,
      CASE WHEN claim > 20 THEN 'NARRATIVE_INCONSISTENCY' WHEN claim IS NULL THEN 'NO_CLAIM'
        ELSE 'SUPPORTED' END AS flag_type,
      CASE WHEN claim > 20 THEN 'CRITICAL' ELSE 'NONE' END AS severity,
      CASE WHEN claim > 20 THEN 'OPEN' ELSE 'CLEAN' END AS status, claim AS metric
    FROM (SELECT doc_id, CASE WHEN doc_id % 3 > 0 THEN CAST(doc_id % 60 AS DOUBLE) END AS claim
      FROM documents)""")

# -- streaming -------------------------------------------------------------------------

_oracle("q_stream_scope_totals", """
    SELECT entity_id, yr AS reporting_year, CAST(scope AS BIGINT) AS scope,
      CAST(sum(t) AS DOUBLE) AS total_tco2e, CAST(sum(n) AS BIGINT) AS activity_count
    FROM inv GROUP BY ALL""", "inv")

_AGAIN = "CASE WHEN return_flag = 'R' THEN 1 ELSE 0 END"
_oracle("q_stream_net_totals", f"""
    SELECT entity_id, yr + {_AGAIN} AS reporting_year, CAST(scope AS BIGINT) AS scope,
      CAST(sum(result_tco2e * (1 + {_AGAIN})) AS DOUBLE) AS total_tco2e,
      count(*) AS activity_count
    FROM led GROUP BY ALL""", "led")
_oracle("q_ledger_versions", f"""
    SELECT CAST(v AS BIGINT) AS version, entity_id,
      yr + CASE v WHEN 2 THEN {_AGAIN} ELSE 0 END AS reporting_year,
      CAST(sum(result_tco2e * (1 + CASE v WHEN 2 THEN {_AGAIN} ELSE 0 END)) AS DOUBLE)
        AS total_tco2e, count(*) AS activity_count
    FROM led, (VALUES (1), (2)) AS versions(v) GROUP BY ALL""", "led")

# -- scenarios and suppliers -----------------------------------------------------------

_SCENARIO = f"""
    sc AS (
      SELECT 'sc-' || n AS scenario_id, entity_id,
        CASE n % 5 WHEN 4 THEN '2050' WHEN 3 THEN '1999-Q3' ELSE CAST(n % 5 + 1996 AS VARCHAR) END
          AS reporting_period, CAST(idx AS INT) AS request_idx, lever_id,
        CAST((n % 4 + 1) * 0.25 AS DECIMAL(7,6)) AS rate,
        CASE WHEN idx = '1' THEN CAST(richest AS DECIMAL(20,4)) ELSE CAST(capex AS DECIMAL(20,4)) END
          AS capex,
        CASE WHEN idx = '2' THEN 500 ELSE CAST(opex AS DECIMAL(20,4)) END AS opex,
        title, CAST(tscope AS INT) AS tscope, kw, CAST(abatement AS DECIMAL(4,2)) AS abatement
      FROM (SELECT c_mktsegment AS entity_id, c_nationkey AS n, max(c_acctbal) AS richest
          FROM customer GROUP BY ALL),
        {_values([("SOLAR_PPA_GRID_ELEC", 0), ("HEAT_PUMP_RETROFIT", 1),
                  ("BUSINESS_TRAVEL_MODAL_SHIFT", 2), ("SUPPLY_CHAIN_ENGAGEMENT", 3),
                  ("EV_FLEET_TRANSITION", 4), ("NO_SUCH_LEVER", 5)])} AS a(lever_id, idx)
        JOIN {_values(LEVERS)} AS l(l_id, title, tscope, kw, capex, opex, abatement)
          ON l_id = lever_id),
    agg AS (SELECT entity_id, yr, activity_type, ghg_category, scope, sum(result_tco2e) AS t
      FROM led GROUP BY ALL),
    req AS (SELECT DISTINCT entity_id, reporting_period FROM sc),
    cur AS (SELECT r.reporting_period, a.* FROM req r JOIN agg a ON a.entity_id = r.entity_id
      WHERE CAST(a.yr AS VARCHAR) = substr(r.reporting_period, 1, 4)
        OR NOT EXISTS (SELECT 1 FROM agg z WHERE z.entity_id = r.entity_id
          AND CAST(z.yr AS VARCHAR) = substr(r.reporting_period, 1, 4))),
    kwhit AS (SELECT DISTINCT c.entity_id, c.reporting_period, kw FROM cur c JOIN sc s
      ON s.entity_id = c.entity_id AND s.reporting_period = c.reporting_period
      WHERE contains(activity_type, kw)),
    imp AS (
      SELECT s.scenario_id, s.entity_id, s.reporting_period, s.request_idx, s.lever_id, s.title,
        s.tscope, max(s.rate) AS rate, max(s.abatement) AS abatement,
        max(s.capex) * 0.1 + max(s.opex) AS cost, sum(c.t) AS gross,
        COALESCE(sum(c.t) FILTER (contains(activity_type, s.kw) OR contains(ghg_category, s.kw)
          OR (c.scope = s.tscope AND k.kw IS NULL)), 0) AS base
      FROM sc s LEFT JOIN cur c ON c.entity_id = s.entity_id
          AND c.reporting_period = s.reporting_period
        LEFT JOIN kwhit k ON k.entity_id = s.entity_id
          AND k.reporting_period = s.reporting_period AND k.kw = s.kw
      GROUP BY ALL),
    res AS (SELECT *, CAST(base AS DOUBLE) * CAST(rate AS DOUBLE) * CAST(abatement AS DOUBLE) AS red,
        CAST(base AS DECIMAL(24,8)) * CAST(rate * abatement AS DECIMAL(8,6)) AS red_exact FROM imp)"""
_MAC = "CASE WHEN red > 0 THEN round(CAST(cost AS DOUBLE) / red, 2) ELSE 0 END"
_oracle("q_macc", f"""
    WITH {_with("", "led")[5:]}, {_SCENARIO}
    SELECT scenario_id, entity_id, reporting_period, CAST(request_idx AS BIGINT) AS request_idx,
      lever_id, title, CAST(tscope AS BIGINT) AS scope, CAST(gross AS DOUBLE) AS baseline_gross_tco2e,
      CAST(base AS DOUBLE) AS baseline_emissions_tco2e,
      CAST(CAST(base - red_exact AS DECIMAL(32,12)) AS DOUBLE) AS simulated_emissions_tco2e,
      CAST(CAST(red_exact AS DECIMAL(32,12)) AS DOUBLE) AS reduction_tco2e,
      CASE WHEN base > 0 THEN round(red / CAST(base AS DOUBLE) * 100, 2) ELSE 0 END
        AS reduction_percent,
      CAST(cost AS DOUBLE) AS annualized_net_cost_usd, {_MAC} AS mac_usd_per_tco2e,
      row_number() OVER (PARTITION BY scenario_id, entity_id, reporting_period
        ORDER BY {_MAC}, request_idx) AS roi_rank
    FROM res""")
_oracle("q_scenario_total", f"""
    WITH {_with("", "led")[5:]}, {_SCENARIO}
    SELECT scenario_id, entity_id, reporting_period, CAST(g AS DOUBLE) AS baseline_gross_tco2e,
      CAST(CAST(g - r AS DECIMAL(32,12)) AS DOUBLE) AS simulated_gross_tco2e,
      CAST(CAST(r AS DECIMAL(32,12)) AS DOUBLE) AS total_reduction_tco2e,
      CASE WHEN g > 0 THEN round(CAST(r AS DOUBLE) / CAST(g AS DOUBLE) * 100, 2) ELSE 0 END
        AS total_reduction_percent,
      CAST(c AS DOUBLE) AS net_annual_cost_usd,
      CASE WHEN g > 0 THEN CAST(r AS DOUBLE) / CAST(g AS DOUBLE) * 100 ELSE 0 END >= 20 AS target_met
    FROM (SELECT scenario_id, entity_id, reporting_period, max(gross) AS g, sum(red_exact) AS r,
        sum(cost) AS c FROM res GROUP BY ALL)""")
_GAPS = """
    SELECT entity_id, CAST(yr AS VARCHAR) AS reporting_period, supplier_ref, activity_type,
      max(f_source) AS current_factor_source, sum(result_tco2e) AS t, count(*) AS line_item_count
    FROM led WHERE scope = 3 GROUP BY ALL"""
_oracle("q_supplier_gaps", f"""
    SELECT * EXCLUDE (t), CAST(t AS DOUBLE) AS estimated_tco2e FROM ({_GAPS})""", "led")


def _letter(part: int) -> str:
    words = {"year": "reporting_period", "name": "name", "activity": "activity_type"}
    *special, default = m.OUTREACH_TEMPLATES
    arms = " ".join(
        f"WHEN template_type = '{k}' THEN {_say(m.OUTREACH_TEMPLATES[k][part], **words)}"
        for k in special
    )
    return f"CASE {arms} ELSE {_say(m.OUTREACH_TEMPLATES[default][part], **words)} END"


_oracle("q_outreach_drafts", f"""
    SELECT md5(entity_id || '|' || reporting_period || '|' || supplier_ref || '|' || activity_type
        || '|' || template_type) AS outreach_id, entity_id, reporting_period, supplier_ref,
      activity_type, supplier_name, template_type,
      CASE WHEN line_item_count > 3 THEN 'Urgent: ' || supplier_ref ELSE {_letter(0)} END AS subject,
      {_letter(1)} AS body, 'DRAFT' AS status
    FROM (SELECT *, COALESCE(supplier_name, supplier_ref) AS name
      FROM (SELECT *, CASE WHEN line_item_count > 1 THEN 'Supplier ' || supplier_ref END
          AS supplier_name,
        CASE WHEN activity_type = 'freight_road' THEN 'REDUCTION_PLEDGE'
          WHEN reporting_period < '1998' THEN 'ACTIVITY_DATA_VERIFICATION'
          ELSE 'PRIMARY_EMISSION_FACTOR' END AS template_type
      FROM ({_GAPS})))""", "led")
_oracle("q_outreach_state", """
    WITH a AS (SELECT *, CASE event_type WHEN 'purchase' THEN 'RECEIVED' WHEN 'click' THEN 'SENT'
        WHEN 'view' THEN 'SENT' ELSE 'DRAFT' END AS st,
      row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS rn,
      row_number() OVER (PARTITION BY user_id, event_type = 'purchase'
        ORDER BY ts DESC, event_id DESC) AS rp
      FROM events)
    SELECT 'out-' || user_id AS outreach_id, max(st) FILTER (rn = 1) AS status,
      strftime(max(ts) FILTER (st = 'SENT'), '%Y-%m-%d %H:%M:%S') AS sent_at,
      strftime(max(ts) FILTER (st = 'RECEIVED'), '%Y-%m-%d %H:%M:%S') AS responded_at,
      count(*) AS action_count,
      max(value) FILTER (st = 'RECEIVED' AND rp = 1) AS primary_factor_value,
      max('kgCO2e/kg') FILTER (st = 'RECEIVED' AND rp = 1) AS primary_factor_unit,
      max(CAST(json_extract_string(props, '$.k') AS DOUBLE)) FILTER (st = 'RECEIVED' AND rp = 1)
        AS verified_quantity,
      max(props) FILTER (st = 'RECEIVED' AND rp = 1) AS response_notes
    FROM a GROUP BY user_id""")

_oracle("q_provider_detect", f"""
    SELECT doc_id, provider, {_PROVIDER_TOKEN} AS supplier_ref FROM ({_PROVIDER})""")
_oracle("q_bill_lines", f"""
    WITH p AS ({_PROVIDER}),
    b AS (SELECT p.*, {_GEO} AS geography, doc_id % 12 + 1 AS mon FROM p)
    SELECT doc_id, raw_line_ref, CAST(reading_no AS BIGINT) AS reading_no, activity_type, quantity,
      unit, geography,
      CASE doc_id % 4 WHEN 2 THEN format('2025-{{:02d}}-15', mon) WHEN 3 THEN '2025-12-31'
        ELSE format('2025-{{:02d}}-01', mon) END AS period_start,
      CASE doc_id % 4 WHEN 2 THEN format('2025-{{:02d}}-15', mon) WHEN 3 THEN '2025-12-31'
        ELSE format('2025-{{:02d}}-28', mon) END AS period_end,
      {_PROVIDER_TOKEN} AS supplier_ref, {_acct("'98' || doc_id || '1104'")} AS account_ref
    FROM (SELECT *, unnest([
        {{'raw_line_ref': 'page:1,line:5', 'reading_no': 1, 'activity_type': 'electricity_purchase',
          'quantity': CAST(1000.5 + doc_id % 1000 AS DOUBLE), 'unit': 'kWh'}},
        {{'raw_line_ref': 'page:1,line:6', 'reading_no': 1,
          'activity_type': 'natural_gas_combustion',
          'quantity': CAST(doc_id % 90 + 5.25 AS DOUBLE), 'unit': 'therms'}},
        {{'raw_line_ref': 'page:1,line:7', 'reading_no': 1, 'activity_type': 'freight_road',
          'quantity': CAST(doc_id % 50 + 1 AS DOUBLE), 'unit': 'gallons'}},
        {{'raw_line_ref': 'page:1,line:7', 'reading_no': 2, 'activity_type': 'freight_road',
          'quantity': CAST(doc_id % 70 + 2 AS DOUBLE), 'unit': 'tonne.km'}}], recursive := true)
      FROM b)""")

_oracle("q_outreach_audit", f"""
    WITH {_with("", "led")[5:]},
    d AS (SELECT *, md5(entity_id || '|' || reporting_period || '|' || supplier_ref || '|'
        || activity_type || '|REDUCTION_PLEDGE') AS outreach_id, 'Desk of ' || entity_id AS contact
      FROM ({_GAPS}))
    SELECT 'supplier_outreach' AS entity_type, outreach_id AS entity_id,
      'CREATE_SUPPLIER_OUTREACH' AS action, 'outreach_agent' AS actor,
      '2025-03-01 08:00:00' AS event_ts, '{{"supplier_ref":"' || supplier_ref
        || '","supplier_email":"esg@' || lower(supplier_ref)
        || '.example","template_type":"REDUCTION_PLEDGE"}}' AS detail, contact AS contact_name FROM d
    UNION ALL SELECT 'supplier_outreach', outreach_id, 'DISPATCH_SUPPLIER_OUTREACH',
      'outreach_agent', '2025-03-02 08:00:00', '{{"sent_at":"2025-03-02T08:00:00"}}', contact FROM d
    UNION ALL SELECT 'supplier_outreach', outreach_id, 'RECORD_SUPPLIER_PRIMARY_DATA',
      'outreach_agent', '2025-03-03 08:00:00', '{{"primary_factor_value":"0.25","primary_factor_unit":'
        || '"kgCO2e/kg","verified_quantity":"100","response_notes":"audited","recorded_at":'
        || '"2025-03-03T08:00:00"}}', contact FROM d WHERE entity_id = 'BUILDING'""")
_oracle("q_trace_whole", """
    SELECT calculation_id, activity_id, f_source AS factor_source, filename,
      d.status AS document_status, COALESCE(n, 0) AS event_count,
      strftime(ts, '%Y-%m-%d %H:%M:%S') AS last_event_ts,
      CAST(line_status = 'F' AS BIGINT) AS disclosure_count,
      CASE WHEN line_status = 'F' THEN md5(led.entity_id || '|GHG_PROTOCOL|' || yr) END
        AS first_disclosure_id
    FROM led LEFT JOIN docs d ON d.document_id = led.source_document_id
      LEFT JOIN (SELECT 'doc-' || event_id AS id, count(*) AS n, max(ts) AS ts FROM events
        GROUP BY 1) e ON e.id = d.document_id""", "led", "docs")
_SQL["q_trace_indexed"] = _SQL["q_trace_whole"]
_oracle("q_stored_ledger", """
    SELECT calculation_id, activity_id, factor_id, f_source AS factor_source, entity_id,
      CAST(scope AS BIGINT) AS scope, ghg_category, CAST(result_tco2e AS DOUBLE) AS result_tco2e
    FROM led""", "led")
_oracle("q_pending_activities", """
    SELECT activity_id, entity_id, status FROM cls WHERE status = 'pending_review'""", "cls")

_oracle("q_emissions_range", f"""
    WITH r AS (SELECT {_LINE_ID} AS activity_id, l_linenumber = 7 AS odd,
        CAST(CAST(l_quantity AS DECIMAL(5,2)) * 100 AS HUGEINT)
          * CASE l_linenumber % 3 WHEN 0 THEN 1 WHEN 1 THEN 1000000000 ELSE 1800000000000 END
          * 12345678901 AS digits FROM lineitem),
    e AS (SELECT activity_id, odd, digits // 100000 + CAST(digits % 100000 >= 50000 AS INT) AS p
      FROM r)
    SELECT activity_id, CASE WHEN odd OR p >= 100000000000000000000 THEN 'calculation_error'
        ELSE 'computed' END AS calc_status,
      CASE WHEN NOT odd AND p < 100000000000000000000 THEN (p // 100000000) || '.'
        || lpad(CAST(p % 100000000 AS VARCHAR), 8, '0') END AS result_text,
      CASE WHEN odd THEN 'Cannot convert' WHEN p >= 100000000000000000000 THEN 'The result doe' END
        AS reason
    FROM e""")
_oracle("q_redact_names", """
    SELECT doc_id, 'From TOKEN_SUPP_' || upper(substr(sha256('depot 00' || n || ' north'), 1, 10))
      || ' TOKEN_SUPP_' || upper(substr(sha256('&&'), 1, 10)) || ' to '
      || CASE WHEN n < 9 THEN 'TOKEN_SUPP_' || upper(substr(sha256('depot 10' || n), 1, 10))
        ELSE 'depot 109' END || '.' AS redacted_text,
      CASE WHEN n < 9 THEN '&&|Depot 00' || n || ' North|Depot 10' || n
        ELSE '&&|Depot 00' || n || ' North' END AS names
    FROM (SELECT doc_id, doc_id % 10 AS n FROM documents)""")
_oracle("q_spelled_dates", f"""
    SELECT {_LINE_ID} AS line_id, CASE l_linenumber % 7 WHEN 0 THEN strftime(l_shipdate, '%d-%b-%y')
        WHEN 1 THEN strftime(l_shipdate, '%d/%b/%Y') WHEN 2 THEN strftime(l_shipdate, '%b %-d, %y')
        WHEN 3 THEN strftime(l_shipdate, '%Y%m%d') || 'T1000'
        WHEN 4 THEN strftime(l_shipdate, '%Y %b %-d')
        WHEN 5 THEN strftime(l_shipdate, '%a, %-d %b %Y') || ' 10:00:00 GMT'
        ELSE strftime(l_shipdate, '%b %Y') END AS raw_date,
      CASE WHEN l_linenumber % 7 < 6 THEN strftime(l_shipdate, '%Y-%m-%d') END AS clean_date
    FROM lineitem""")
_oracle("q_exports", """
    SELECT strftime(l_shipdate, '%Y-%m-%d') AS period_start, 'TOKEN_SUPP_' || upper(substr(sha256(
        CASE WHEN l_suppkey % 2 = 0 THEN 'firm "' || l_suppkey || '" and sons'
          ELSE 'firm ' || l_suppkey END), 1, 10)) AS supplier_ref,
      count(*) AS n_rows, count(*) AS n_ids, CAST(0 AS BIGINT) AS n_errors
    FROM lineitem GROUP BY ALL""")
