"""ANSI SQL counterparts of the registered queries, written independently for DuckDB."""

from __future__ import annotations

from panelgraph.fixed_values import LAGS, WHITE_SPACE, WINDOWS
from panelgraph.operators.panel import EVENT_METRICS
from panelgraph.plans.views import BASE_SECONDS, BULK_SCENARIOS, CATEGORIES, GOVERNMENTS, LANGUAGES, SCENARIOS, TERMS, WORDS


def r(expression: str, name: str | None = None, digits: int = 9) -> str:
    return f"round({expression}, {digits}) + 0.0 AS {name or expression}"


def code(column: str) -> str:
    return f"'N' || lpad(split_part({column}, '_', 2), 2, '0')"


def q(text: object) -> str:
    if text is None:
        return "NULL"
    if isinstance(text, str):
        return "'" + text.replace("'", "''") + "'"
    return str(text)


# --- events -------------------------------------------------------------------------------

RAW = """raw AS (
  SELECT l_orderkey AS id, year(l_shipdate) AS yr, n_nationkey, n_name, r_name, c_mktsegment,
    'Government of ' || n_name AS side_a, o_orderpriority AS side_b, CAST(l_shipdate AS DATE) AS shipped,
    l_returnflag, l_linestatus, l_extendedprice, l_quantity, c_acctbal, o_totalprice, l_linenumber, l_shipdate
  FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey
  JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey),
coded AS (
  SELECT *, CASE WHEN c_mktsegment <> 'MACHINERY' OR r_name <> 'ASIA' THEN """ + code("n_name") + """ END AS country_iso3,
    CASE WHEN side_b = '4-NOT SPECIFIED' THEN make_date(yr, 1, 1) ELSE shipped END AS event_date
  FROM raw)"""

CLEANED = RAW + """, cleaned AS (
  SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY l_linenumber, l_shipdate, l_extendedprice,
      l_quantity, l_returnflag, l_linestatus) AS rn FROM coded WHERE country_iso3 IS NOT NULL) WHERE rn = 1),
tidy AS (
  SELECT id, country_iso3, ' ' || n_name AS country,
    CASE WHEN c_mktsegment <> 'MACHINERY' THEN CAST(n_nationkey AS DOUBLE) END AS country_id, r_name AS region,
    event_date, CASE l_returnflag WHEN 'A' THEN 1 WHEN 'N' THEN 2 ELSE 0 END AS kind, c_mktsegment AS conflict_name,
    side_a, side_b, l_extendedprice AS best, CASE WHEN l_linestatus = 'O' THEN 0.0 ELSE l_quantity END AS high,
    CASE WHEN l_linestatus = 'O' THEN 0.0 ELSE l_quantity END AS low, greatest(c_acctbal, 0.0) AS deaths_civilians,
    CASE WHEN c_acctbal / 100 BETWEEN -90 AND 90 AND o_totalprice / 2000 BETWEEN -180 AND 180 THEN c_acctbal / 100 END AS latitude,
    CASE WHEN c_acctbal / 100 BETWEEN -90 AND 90 AND o_totalprice / 2000 BETWEEN -180 AND 180 THEN o_totalprice / 2000 END AS longitude
  FROM cleaned)"""

ORDER_EVENTS = {
    "nation": "ev AS (SELECT o_orderkey AS id, " + code("n_name") + """ AS ent, CAST(date_trunc('month', o_orderdate) AS DATE) AS m,
  o_orderstatus AS st, floor(o_totalprice / 1000) AS p, floor(o_totalprice / 2000) AS p2, floor(o_totalprice / 500) AS p3, floor(o_totalprice / 4000) AS p4 FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey)""",
    "customer": """ev AS (SELECT o_orderkey AS id, o_custkey AS ent, CAST(date_trunc('month', o_orderdate) AS DATE) AS m,
  o_orderstatus AS st, floor(o_totalprice / 1000) AS p, floor(o_totalprice / 2000) AS p2, floor(o_totalprice / 500) AS p3, floor(o_totalprice / 4000) AS p4 FROM orders)""",
}
TOTALS = """agg AS (
  SELECT ent, m, count(*) AS events_total, sum(p) AS fatalities_best_total, sum(p2) AS fatalities_low_total,
    sum(p3) AS fatalities_high_total, sum(p4) AS fatalities_civilian_total,
    count(*) FILTER (st = 'F') AS events_state_based, sum(p) FILTER (st = 'F') AS fatalities_state_based,
    count(*) FILTER (st = 'O') AS events_non_state, sum(p) FILTER (st = 'O') AS fatalities_non_state,
    count(*) FILTER (st = 'P') AS events_one_sided, sum(p) FILTER (st = 'P') AS fatalities_one_sided
  FROM ev GROUP BY ent, m)"""
EVENT_COUNTS = ["events_total", "events_state_based", "events_non_state", "events_one_sided"]
EVENT_SUMS = [
    "fatalities_best_total", "fatalities_low_total", "fatalities_high_total", "fatalities_civilian_total",
    "fatalities_state_based", "fatalities_non_state", "fatalities_one_sided",
]
PERIOD = "CAST(m AS VARCHAR) AS month_start, year(m) AS year, month(m) AS month, strftime(m, '%Y-%m') AS year_month"


def panel_ctes(entity: str = "nation", low: int = 1989, high: int = 2025) -> str:
    values = [f"coalesce({c}, 0) AS {c}" for c in EVENT_COUNTS] + [f"coalesce({c}, 0.0) AS {c}" for c in EVENT_SUMS]
    return f"""{ORDER_EVENTS[entity]}, {TOTALS},
b AS (SELECT greatest({low}, min(year(m))) AS lo, least({high}, max(year(m))) AS hi FROM ev),
months AS (SELECT CAST(unnest(generate_series(make_date(lo, 1, 1), make_date(hi, 12, 1), INTERVAL 1 MONTH)) AS DATE) AS m FROM b),
ents AS (SELECT DISTINCT ent FROM ev),
panel AS (SELECT g.ent, g.m, {', '.join(values)} FROM (SELECT ent, m FROM ents, months) g LEFT JOIN agg USING (ent, m))"""


PANEL_OUT = ", ".join(
    ["ent AS country_iso3", PERIOD, *EVENT_COUNTS, *[r(c) for c in EVENT_SUMS],
     "CAST(events_total > 0 AS BIGINT) AS has_conflict_event"]
)


def event_feature_sql(entity: str) -> str:
    w = "PARTITION BY ent ORDER BY m"
    both = {"fatalities": "fatalities_best_total", "events": "events_total"}
    out = ["ent AS country_iso3", PERIOD, *EVENT_COUNTS, *[r(c) for c in EVENT_SUMS],
           "CAST(events_total > 0 AS BIGINT) AS has_conflict_event"]

    def shown(expression: str, kind: str, name: str) -> str:
        return r(expression, name) if kind == "fatalities" else f"CAST({expression} AS BIGINT) AS {name}"

    for kind, c in both.items():
        for k in LAGS:
            out.append(shown(f"coalesce(lag({c}, {k}) OVER ({w}), 0)", kind, f"{kind}_lag_{k}m"))
        for n in WINDOWS:
            out.append(shown(f"coalesce(sum({c}) OVER ({w} ROWS BETWEEN {n} PRECEDING AND 1 PRECEDING), 0)", kind, f"{kind}_prior_sum_{n}m"))
            out.append(shown(f"sum({c}) OVER ({w} ROWS BETWEEN {n - 1} PRECEDING AND CURRENT ROW)", kind, f"{kind}_rolling_sum_{n}m"))
        p = f"coalesce(lag({c}) OVER ({w}), 0)"
        out.append(shown(f"{c} - {p}", kind, f"delta_{kind}_1m"))
        out.append(r(f"least(greatest(({c} - {p}) / greatest({p}, 1.0::DOUBLE), -10.0), 10.0)", f"growth_rate_{kind}_1m"))
        out.append(r(f"ln(1 + {c}::DOUBLE) - ln(1 + {p}::DOUBLE)", f"momentum_{kind}_log_1m"))
    for n in WINDOWS:
        out.append(r(f"avg(fatalities_best_total) OVER ({w} ROWS BETWEEN {n - 1} PRECEDING AND CURRENT ROW)", f"fatalities_rolling_mean_{n}m"))
    out.append(f"CAST(sum(fatalities_best_total) OVER ({w} ROWS BETWEEN 11 PRECEDING AND CURRENT ROW) >= 25 AS BIGINT) AS project_active_conflict_indicator")
    return f"WITH {panel_ctes(entity)} SELECT {', '.join(out)} FROM panel"


# --- articles -----------------------------------------------------------------------------

_country = "CASE {c} " + " ".join(f"WHEN {q(k)} THEN {q(v)}" for k, v in LANGUAGES.items()) + " END"
_space = q(WHITE_SPACE)
_lang = r"regexp_extract(url, 'example\.[a-z]+/([a-z]+)/', 1)"
ARTICLES = f"""pages_at AS (
  SELECT *, make_timestamp(CAST({BASE_SECONDS} + page_id * 7919 % 40000 * 1000 AS BIGINT) * 1000000) AS seen_at,
    regexp_extract(url, '^https?://([^/?#]+)', 1) AS host, {_lang} AS lg FROM pages),
raw AS (
  SELECT 0 AS kind, page_id AS number, url || chr(10) AS url, regexp_extract(html, '<title>([^<]*)</title>', 1) AS title,
    CASE WHEN contains(url, 'utm_') THEN 'soon' ELSE CASE page_id % 5 WHEN 0 THEN strftime(seen_at, '%Y%m%dT%H%M%SZ')
      WHEN 1 THEN strftime(seen_at, '%Y%m%d%H%M%S') WHEN 2 THEN strftime(seen_at, '%Y%m%d') WHEN 3 THEN strftime(seen_at, '%Y-%m-%d %H:%M:%S')
      ELSE strftime(seen_at, '%Y-%m-%d') END END AS seen,
    CASE WHEN url LIKE 'https%' THEN 'WWW.' || host ELSE host END AS domain,
    CASE WHEN lg <> 'en' THEN lg END AS lang, {_country.format(c='lg')} AS sc FROM pages_at
  UNION ALL
  SELECT 1, doc_id, 'http://' || source || '/' || lang || '/' || n_chars, text,
    strftime(make_timestamp(CAST({BASE_SECONDS} + n_chars * 6151 % 40000 * 1000 AS BIGINT) * 1000000), '%Y%m%dT%H%M%SZ'),
    'www.' || source, lang, {_country.format(c='lang')} FROM documents),
usable AS (
  SELECT kind, number, trim(url, {_space}) AS url, trim(coalesce(title, ''), {_space}) AS title,
    coalesce(try_strptime(seen, '%Y%m%dT%H%M%SZ'), try_strptime(seen, '%Y%m%d%H%M%S'), try_strptime(seen, '%Y%m%d'),
      try_strptime(seen, '%Y-%m-%d %H:%M:%S'), try_strptime(seen, '%Y-%m-%d')) AS seen_at,
    regexp_replace(lower(trim(domain, {_space})), '^www\\.', '') AS domain, coalesce(lang, 'English') AS language,
    trim(coalesce(sc, ''), {_space}) AS raw_sourcecountry FROM raw),
keyed AS (
  SELECT *, substr(sha256(lower(url) || '::' || lower(title)), 1, 16) AS article_id FROM usable
  WHERE url <> '' AND title <> '' AND seen_at IS NOT NULL),
first_id AS (SELECT * FROM keyed QUALIFY row_number() OVER (PARTITION BY article_id ORDER BY kind, number) = 1),
first_day AS (SELECT * FROM first_id QUALIFY row_number() OVER (PARTITION BY CAST(seen_at AS DATE), title ORDER BY kind, number) = 1)"""

# Letters, digits and marks outside a-z and 0-9 become 0, so that the ASCII word boundary is the Unicode one.
_plain = (
    r"regexp_replace(regexp_replace(regexp_replace(lower(title), '[^\P{L}a-z]', '0', 'g'), '[^\P{Nd}0-9]', '0', 'g'), '\p{M}', '0', 'g')"
)
_ranked = [t for t in TERMS if " " not in t[0] and len(t[0]) > 3] + [t for t in TERMS if " " not in t[0] and len(t[0]) <= 3]


def _target(what: str) -> str:
    branches = [
        f"WHEN contains(lower(title), {q(t)}) THEN " + (q(c) if what == "code" else "0.95") for t, c in TERMS if " " in t
    ]
    for t, c in _ranked:
        branches.append(f"WHEN list_contains(words, {q(t)}) THEN " + (q(c) if what == "code" else "0.9" if len(t) > 3 else "0.75"))
    return f"CASE {' '.join(branches)} ELSE {'NULL' if what == 'code' else '0.0'} END"


def normalized_ctes(source: str = "first_day") -> str:
    return ARTICLES + f""",
tokened AS (SELECT *, regexp_extract_all(plain, '\\b[a-z\\-]+\\b') AS words FROM (SELECT *, {_plain} AS plain FROM {source})),
normal AS (SELECT *, {_target('code')} AS target_country_iso3, {_target('confidence')} AS target_country_confidence,
  CASE lower(raw_sourcecountry) WHEN 'united kingdom' THEN 'GBR' WHEN 'france' THEN 'FRA' WHEN 'germany' THEN 'DEU' END AS source_country_iso3
  FROM tokened)"""


def _hits(category: str) -> str:
    return " + ".join(f"CAST(regexp_matches(plain, '\\b{w}\\b') AS BIGINT)" for w in CATEGORIES[category])


_names = list(CATEGORIES)
_primary = "CASE WHEN total = 0 THEN 'none' " + " ".join(
    f"WHEN h_{n} = greatest({', '.join(f'h_{x}' for x in _names)}) THEN '{n}'" for n in _names
) + " END"
_value = "CASE x " + " ".join(f"WHEN {q(k)} THEN {v}::DOUBLE" for k, v in WORDS.items()) + " END"


def scored_ctes(source: str = "first_day") -> str:
    return normalized_ctes(source) + f""",
hit AS (SELECT *, {', '.join(f'{_hits(n)} AS h_{n}' for n in _names)},
  list_filter(list_transform(words, lambda x: {_value}), lambda x: x IS NOT NULL) AS vals,
  len(list_filter(regexp_split_to_array(title, '[\\s\\x0B\\x{{85}}\\x{{A0}}\\x{{1680}}\\x{{2000}}-\\x{{200A}}\\x{{2028}}\\x{{2029}}\\x{{202F}}\\x{{205F}}\\x{{3000}}]+'), lambda x: x <> '')) AS n_words
  FROM normal),
summed AS (SELECT *, {' + '.join(f'h_{n}' for n in _names)} AS total,
  CASE WHEN len(vals) = 0 THEN 0.0 ELSE list_sum(vals) / len(vals) END AS tone FROM hit),
scored AS (SELECT *, total > 0 AS is_conflict_relevant, total AS conflict_category_count, {_primary} AS primary_conflict_category,
  {', '.join(f'h_{n} > 0 AS cat_{n}' for n in _names)}, tone AS tone_score, tone < -0.2 AS is_negative_tone,
  abs(tone) >= 0.6 AS is_extreme_tone, least(total / greatest(n_words, 1), 1.0) AS conflict_intensity FROM summed)"""


NEWS_AGG = """nagg AS (
  SELECT ent, CAST(date_trunc('month', seen_at) AS DATE) AS m, count(*) AS news_count_total, count(DISTINCT domain) AS unique_domains_count,
    avg(tone_score) AS avg_tone, count(*) FILTER (is_negative_tone) AS negative_tone_count,
    count(*) FILTER (is_extreme_tone) AS extreme_tone_count, count(*) FILTER (is_conflict_relevant) AS conflict_news_count,
    avg(tone_score) FILTER (is_conflict_relevant) AS conflict_news_avg_tone,
    count(*) FILTER (is_conflict_relevant AND cat_military_escalation) AS military_escalation_count,
    count(*) FILTER (is_conflict_relevant AND cat_armed_conflict) AS armed_conflict_count,
    count(*) FILTER (is_conflict_relevant AND cat_ceasefire_peace) AS ceasefire_peace_count,
    count(*) FILTER (is_conflict_relevant AND cat_sanctions_economic) AS sanctions_count
  FROM na GROUP BY 1, 2)"""
NEWS_COUNTS = [
    "news_count_total", "unique_domains_count", "negative_tone_count", "extreme_tone_count", "conflict_news_count",
    "military_escalation_count", "armed_conflict_count", "ceasefire_peace_count", "sanctions_count",
]


def news_panel_ctes(articles: str, extra: str = "") -> str:
    """``articles``: CTEs that define na(ent, seen_at, ...)."""
    counts = ", ".join(f"coalesce({c}, 0) AS {c}" for c in NEWS_COUNTS)
    return f"""{articles}, {NEWS_AGG},
nb AS (SELECT min(seen_at) AS first_at, max(seen_at) AS last_at FROM na),
nmonths AS (SELECT CAST(unnest(generate_series(CAST(date_trunc('month', first_at) AS DATE), CAST(date_trunc('month', last_at) AS DATE), INTERVAL 1 MONTH)) AS DATE) AS m FROM nb),
nents AS (SELECT DISTINCT ent FROM na {extra}),
nfill AS (SELECT g.ent, g.m, {counts}, coalesce(avg_tone, 0.0) AS avg_tone, coalesce(conflict_news_avg_tone, 0.0) AS conflict_news_avg_tone
  FROM (SELECT ent, m FROM nents, nmonths) g LEFT JOIN nagg USING (ent, m)),
nratio AS (SELECT *, conflict_news_count / greatest(news_count_total, 1) AS conflict_news_ratio,
  negative_tone_count / greatest(news_count_total, 1) AS negative_tone_share,
  unique_domains_count / greatest(news_count_total, 1) AS source_diversity,
  military_escalation_count / greatest(news_count_total, 1) AS military_ratio FROM nfill),
npanel AS (SELECT nratio.*, least(greatest(0.4 * conflict_news_ratio + 0.3 * negative_tone_share + 0.3 * military_ratio, 0.0), 1.0) AS escalation_signal,
  (m = date_trunc('month', first_at) AND first_at > m + INTERVAL 1 DAY)
  OR (m = date_trunc('month', last_at) AND last_at < m + INTERVAL 1 MONTH - INTERVAL 1 SECOND - INTERVAL 1 DAY) AS is_partial_month
  FROM nratio, nb)"""


NEWS_OUT = ", ".join(
    ["ent AS country_iso3", PERIOD, *NEWS_COUNTS, "is_partial_month",
     *[r(c) for c in ("avg_tone", "conflict_news_avg_tone", "conflict_news_ratio", "negative_tone_share", "source_diversity", "escalation_signal")]]
)

REPORTS = f"""rep AS (
  SELECT l_orderkey || '-' || l_linenumber AS article_id, l_shipdate AS seen_at, {code('sn.n_name')} AS src, {code('cn.n_name')} AS dst,
    strftime(l_shipdate, '%Y-%m') AS ym, 1 - 20 * l_discount AS tone_score, 1 - 20 * l_discount < -0.2 AS is_negative_tone,
    abs(1 - 20 * l_discount) >= 0.6 AS is_extreme_tone, l_returnflag = 'R' AS is_conflict_relevant, l_returnflag = 'R' AS cat_military_escalation,
    l_linenumber = 1 AS cat_armed_conflict, l_linenumber = 2 AS cat_ceasefire_peace, l_linenumber = 3 AS cat_sanctions_economic
  FROM lineitem JOIN supplier ON l_suppkey = s_suppkey JOIN nation sn ON s_nationkey = sn.n_nationkey
  JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey JOIN nation cn ON c_nationkey = cn.n_nationkey)"""
REPORT_NA = REPORTS + ", na AS (SELECT dst AS ent, src AS domain, * FROM rep)"
PUBLISHER_NA = REPORTS + ", na AS (SELECT src AS ent, src AS domain, * FROM rep)"


def news_feature_sql() -> str:
    w = "PARTITION BY ent ORDER BY m"
    out = [NEWS_OUT]
    named = {"conflict_news": "conflict_news_count", "conflict_news_ratio": "conflict_news_ratio", "avg_tone": "avg_tone", "escalation_signal": "escalation_signal"}
    for k in LAGS:
        for name, c in named.items():
            out.append(r(f"CAST(lag({c}, {k}) OVER ({w}) AS DOUBLE)", f"{name}_lag_{k}m"))

    def full(c: str, how: str, n: int, frame: str) -> str:
        return f"CASE WHEN count(*) OVER ({w} {frame}) = {n} THEN CAST({how}({c}) OVER ({w} {frame}) AS DOUBLE) END"

    for n in WINDOWS:
        prior = f"ROWS BETWEEN {n} PRECEDING AND 1 PRECEDING"
        upto = f"ROWS BETWEEN {n - 1} PRECEDING AND CURRENT ROW"
        out.append(r(full("conflict_news_count", "sum", n, prior), f"conflict_news_prior_sum_{n}m"))
        out.append(r(full("avg_tone", "avg", n, prior), f"avg_tone_prior_mean_{n}m"))
        out.append(r(full("escalation_signal", "avg", n, prior), f"escalation_signal_prior_mean_{n}m"))
        out.append(r(full("conflict_news_count", "sum", n, upto), f"conflict_news_rolling_sum_{n}m"))
        out.append(r(full("avg_tone", "avg", n, upto), f"avg_tone_rolling_mean_{n}m"))
    c, p = "conflict_news_count", f"lag(conflict_news_count) OVER ({w})"
    out.append(r(f"CAST({c} - {p} AS DOUBLE)", "delta_conflict_news_1m"))
    out.append(r(f"CASE WHEN {p} IS NOT NULL THEN least(greatest(({c} - {p}) / greatest({p}, 1), -10.0), 10.0) END", "safe_conflict_news_growth_rate_1m"))
    out.append(r(f"ln(1 + {c}::DOUBLE) - ln(1 + ({p})::DOUBLE)", "momentum_conflict_news_log_1m"))
    return f"WITH {news_panel_ctes(REPORT_NA)} SELECT {', '.join(out)} FROM npanel"


# --- pairs --------------------------------------------------------------------------------

_known = ", ".join(f"({q(n)}, {q(c)})" for n, c in GOVERNMENTS)
SIDED = f"""gov(name, iso) AS (VALUES {_known}),
bside AS (SELECT DISTINCT l_orderkey, n_name FROM lineitem JOIN supplier ON l_suppkey = s_suppkey JOIN nation ON s_nationkey = n_nationkey WHERE l_returnflag = 'R'),
sided AS (SELECT o_orderkey AS id, n_name AS a_name, strftime(o_orderdate, '%Y-%m') AS ym, CAST(o_orderdate AS DATE) AS event_date,
  floor(o_totalprice / 50000) AS best, floor(o_totalprice / 100000) AS low, floor(o_totalprice / 25000) AS high, floor(o_totalprice / 200000) AS civ, o_orderpriority AS conflict_name
  FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey),
pe AS (SELECT id, least(ga.iso, gb.iso) AS a, greatest(ga.iso, gb.iso) AS b, ym, event_date, best, low, high, civ, conflict_name
  FROM sided JOIN gov ga ON a_name = ga.name JOIN bside ON id = l_orderkey JOIN gov gb ON bside.n_name = gb.name WHERE ga.iso <> gb.iso)"""


def tension(f: str, e: str, n: str, t: str, c: str) -> str:
    conflict = f"CASE WHEN {f} > 0 THEN least(1.0, ln(1 + {f}) / ln(1001.0::DOUBLE)) ELSE 0.25 END"
    news = f"least(greatest(0.5 * greatest(0.0, -coalesce({t}, 0.0)) + 0.5 * {c} / greatest({n}, 1), 0.0), 1.0)"
    return (f"CASE WHEN ({e} > 0 OR {f} > 0) AND {n} > 0 THEN 0.6 * ({conflict}) + 0.4 * {news} "
            f"WHEN {e} > 0 OR {f} > 0 THEN {conflict} WHEN {n} > 0 THEN {news} ELSE 0.0 END")


def nature(conflict: str, news: str) -> str:
    return f"CASE WHEN {conflict} AND {news} THEN 'hybrid' WHEN {news} THEN 'directed_news' ELSE 'undirected_conflict' END"


NEWS_MONTHS = REPORTS + """,
nm AS (SELECT src, dst, ym, count(*) AS n, avg(tone_score) AS tone, count(*) FILTER (is_negative_tone) AS neg,
  count(*) FILTER (is_conflict_relevant) AS con FROM rep WHERE src <> dst GROUP BY 1, 2, 3)"""
NEWS_TOTAL = NEWS_MONTHS + """,
nt AS (SELECT src, dst, CAST(sum(n) AS BIGINT) AS n, avg(tone) AS tone, sum(tone * n) / sum(n) AS wtone,
  CAST(sum(neg) AS BIGINT) AS neg, CAST(sum(con) AS BIGINT) AS con FROM nm GROUP BY 1, 2)"""
CONFLICT_TOTAL = SIDED + """,
ct AS (SELECT a, b, count(*) AS events, sum(best) AS best, sum(low) AS low, sum(high) AS high, sum(civ) AS civ FROM pe GROUP BY 1, 2)"""
DYADS = f"""{CONFLICT_TOTAL}, {NEWS_TOTAL},
dy0 AS (SELECT src, dst, ct.events, best, low, high, civ, n, tone, neg, con FROM nt LEFT JOIN ct ON a = least(src, dst) AND b = greatest(src, dst)
  UNION ALL SELECT a, b, events, best, low, high, civ, NULL, NULL, NULL, NULL FROM ct
  WHERE NOT EXISTS (SELECT 1 FROM nt WHERE least(src, dst) = a AND greatest(src, dst) = b)),
dy AS (SELECT src, dst, n IS NOT NULL AS is_directed, {nature('events IS NOT NULL', 'n IS NOT NULL')} AS nat, events IS NOT NULL AS has_conflict,
  coalesce(events, 0) AS events, coalesce(best, 0.0) AS best, coalesce(low, 0.0) AS low, coalesce(high, 0.0) AS high, coalesce(civ, 0.0) AS civ,
  coalesce(n, 0) AS n, tone, coalesce(neg, 0) AS neg, coalesce(con, 0) AS con FROM dy0),
d AS (SELECT *, {tension('best', 'events', 'n', 'tone', 'con')} AS w FROM dy)"""

# --- graph --------------------------------------------------------------------------------

NODES = f"nodes AS (SELECT {code('n_name')} AS c FROM nation)"
HALVES = f"""{NODES}, {DYADS},
ed AS (SELECT *, CASE WHEN best > 0 THEN w ELSE 0.5 * w END AS back FROM d),
half AS (
  SELECT src AS c, dst AS o, CASE WHEN nat = 'directed_news' THEN 0 ELSE 1 END AS i, 1 AS u,
    CASE nat WHEN 'undirected_conflict' THEN w WHEN 'hybrid' THEN back ELSE 0.0 END AS wi, w AS wo, NULL AS ti,
    CASE WHEN nat <> 'undirected_conflict' THEN tone END AS tu, w FROM ed
  UNION ALL
  SELECT dst, src, 1, CASE WHEN nat = 'directed_news' THEN 0 ELSE 1 END, w,
    CASE nat WHEN 'undirected_conflict' THEN w WHEN 'hybrid' THEN back ELSE 0.0 END,
    CASE WHEN nat <> 'undirected_conflict' THEN tone END, NULL, w FROM ed),
adv AS (SELECT c, count(DISTINCT o) AS k FROM (SELECT src AS c, dst AS o FROM d WHERE has_conflict UNION ALL SELECT dst, src FROM d WHERE has_conflict) GROUP BY c),
deg AS (SELECT c, CAST(sum(i) AS BIGINT) AS i, CAST(sum(u) AS BIGINT) AS u, count(DISTINCT o) AS o, sum(wi) AS wi, sum(wo) AS wo, avg(ti) AS ti, avg(tu) AS tu, avg(w) AS w
  FROM half WHERE c IN (SELECT c FROM nodes) AND o IN (SELECT c FROM nodes) GROUP BY c),
met AS (SELECT nodes.c, coalesce(i, 0) AS in_degree, coalesce(u, 0) AS out_degree, coalesce(o, 0) AS total_degree, coalesce(wi, 0.0) AS weighted_in,
  coalesce(wo, 0.0) AS weighted_out, coalesce(k, 0) AS adversaries, ti, tu, coalesce(w, 0.0) AS mean_tension FROM nodes LEFT JOIN deg USING (c) LEFT JOIN adv USING (c))"""


def rank_ctes(steps: str, nodes: str, key: str = "", prefix: str = "r") -> str:
    """Power iteration until the ranks of a graph move by less than 1e-6. ``steps``(key, s, t, w), ``nodes``(key, c)."""
    k, by = (f"{key}, ", f"GROUP BY {key}") if key else ("", "")
    own = lambda x: f"{x}.{key}, " if key else ""
    same = lambda x, y: f" AND {x}.{key} = {y}.{key}" if key else ""
    join = f"USING ({key})" if key else "ON true"
    both = f"USING ({k}c)"
    part = f"PARTITION BY {key}" if key else ""
    x = f"{prefix}x"
    return f"""{prefix}m AS MATERIALIZED (SELECT {k}s, t, sum(w) AS w FROM {steps} WHERE w > 0 GROUP BY {k}s, t),
{prefix}o AS MATERIALIZED (SELECT {k}s AS c, sum(w) AS o FROM {prefix}m GROUP BY {k}s),
{prefix}n AS MATERIALIZED (SELECT {k}count(*) AS n FROM {nodes} {by}),
{x} AS (
  SELECT {k}c, 1.0::DOUBLE / n AS p, NULL::DOUBLE AS moved, 0 AS step FROM {nodes} JOIN {prefix}n {join}
  UNION ALL
  SELECT {k}c, q, sum(abs(q - p)) OVER ({part}), step + 1 FROM (
    SELECT {own('y')}y.c, y.p, y.step, 0.85 * (coalesce(g, 0.0) + l / n) + 0.15 / n AS q
    FROM {x} y JOIN {prefix}n {join}
    JOIN (SELECT {k}coalesce(sum(p) FILTER (o IS NULL), 0.0) AS l FROM {x} LEFT JOIN {prefix}o {both} {by}) lost {join}
    LEFT JOIN (SELECT {own('m')}m.t AS c, sum(v.p * m.w / z.o) AS g FROM {x} v JOIN {prefix}m m ON m.s = v.c{same('m', 'v')}
      JOIN {prefix}o z ON z.c = v.c{same('z', 'v')} GROUP BY {own('m')}m.t) given {both}
    WHERE (y.moved IS NULL OR y.moved >= 1e-6) AND y.step < 100)),
{prefix} AS (SELECT {k}c, p / sum(p) OVER ({part}) AS p FROM (SELECT * FROM {x} QUALIFY step = max(step) OVER ({part})))"""


PAIR_STEPS = """steps AS (
  SELECT src AS s, dst AS t, w FROM ed UNION ALL
  SELECT dst, src, CASE nat WHEN 'hybrid' THEN back ELSE w END FROM ed WHERE nat <> 'directed_news')"""

# --- what-if ------------------------------------------------------------------------------

_rows = ", ".join("(" + ", ".join(q(v) if not isinstance(v, bool) else str(v).lower() for v in row) + ")" for row in SCENARIOS)
SCENARIO = f"""sc0(id, target, da, db, tone_delta, mult, tension_delta, sever, depth, decay) AS (VALUES {_rows}),
sc1 AS (SELECT id, target, da, db, tone_delta::DOUBLE AS tone_delta, mult::DOUBLE AS mult, tension_delta::DOUBLE AS tension_delta, sever, depth, decay::DOUBLE AS decay FROM sc0)"""
CHECKED = f"""{NODES}, {DYADS}, {SCENARIO},
chk AS (SELECT *, list_filter([
  CASE WHEN target NOT IN (SELECT c FROM nodes) THEN 'unknown target' END,
  CASE WHEN (da IS NULL) <> (db IS NULL) THEN 'pair needs two codes' END,
  CASE WHEN da = db THEN 'pair of one country' END,
  CASE WHEN da <> db AND (da NOT IN (SELECT c FROM nodes) OR db NOT IN (SELECT c FROM nodes)) THEN 'unknown country in pair' END,
  CASE WHEN tension_delta IS NOT NULL AND (da IS NULL OR db IS NULL) THEN 'tension change without pair' END,
  CASE WHEN sever AND (da IS NULL OR db IS NULL) THEN 'severance without pair' END,
  CASE WHEN sever AND da IS NOT NULL AND db IS NOT NULL AND NOT EXISTS (SELECT 1 FROM d WHERE least(src, dst) = least(da, db) AND greatest(src, dst) = greatest(da, db)) THEN 'severance of a missing edge' END,
  CASE WHEN mult < 0 THEN 'negative multiplier' END, CASE WHEN depth < 0 THEN 'negative depth' END,
  CASE WHEN decay NOT BETWEEN 0 AND 1 THEN 'decay outside 0..1' END], lambda x: x IS NOT NULL) AS reasons,
  EXISTS (SELECT 1 FROM d WHERE (src = da AND dst = db) OR (NOT is_directed AND src = db AND dst = da)) AS edge_matched FROM sc1)"""
VALID = CHECKED + """,
sc AS (SELECT *, coalesce(tension_delta, -0.5 * tone_delta + 0.2 * (mult - 1)) AS seed FROM chk WHERE len(reasons) = 0),
hit AS (SELECT sc.id, src, dst, sever, CASE WHEN sever THEN 0.0 WHEN tension_delta IS NOT NULL THEN least(greatest(w + tension_delta, 0.0), 1.0) ELSE w END AS direct
  FROM sc JOIN d ON (src = da AND dst = db) OR (NOT is_directed AND src = db AND dst = da))"""
# Every path of one and two steps on its own; no step into the target or into a first-hop node.
SPREAD = VALID + """,
way0 AS (SELECT src AS a, dst AS b, w, src, dst FROM d UNION ALL
  SELECT dst, src, CASE nat WHEN 'hybrid' THEN 0.5 * w ELSE w END, src, dst FROM d WHERE nat <> 'directed_news'),
way AS (SELECT sc.id, way0.*, w / sum(w) OVER (PARTITION BY sc.id, a) AS part FROM sc, way0
  WHERE NOT EXISTS (SELECT 1 FROM hit WHERE hit.id = sc.id AND sever AND hit.src = way0.src AND hit.dst = way0.dst)),
hop1 AS (SELECT sc.id, b AS c, seed * decay * part AS delta, src, dst, decay, depth, target FROM sc JOIN way ON way.id = sc.id AND a = target
  WHERE depth >= 1 AND abs(seed) > 1e-4 AND b <> target),
hop2 AS (SELECT hop1.id, b AS c, delta * decay * part AS delta, way.src, way.dst FROM hop1 JOIN way ON way.id = hop1.id AND a = hop1.c
  WHERE depth >= 2 AND b <> target AND NOT EXISTS (SELECT 1 FROM hop1 z WHERE z.id = hop1.id AND z.c = way.b)),
arr AS (SELECT id, c, delta, src, dst, 1 AS hop FROM hop1 UNION ALL SELECT id, c, delta, src, dst, 2 FROM hop2),
narr AS (SELECT id, c, sum(-sign(delta) * least(0.4, abs(delta))) AS shift, min(hop) AS hop FROM arr GROUP BY 1, 2),
earr AS (SELECT id, src, dst, sum(delta) AS shift FROM arr GROUP BY 1, 2, 3),
cf AS (SELECT sc.id, d.*, coalesce(hit.sever, false) AS is_severed, hit.id IS NOT NULL AS is_direct, hit.id IS NULL AND earr.id IS NOT NULL AS is_ripple,
  CASE WHEN hit.id IS NOT NULL THEN direct WHEN earr.id IS NOT NULL THEN least(greatest(w + shift, 0.0), 1.0) ELSE w END AS w2
  FROM sc CROSS JOIN d LEFT JOIN hit ON hit.id = sc.id AND hit.src = d.src AND hit.dst = d.dst
  LEFT JOIN earr ON earr.id = sc.id AND earr.src = d.src AND earr.dst = d.dst)"""


def deep_ctes(hops: int = 4) -> str:
    """Arrivals over several hops of the bulk graph, one CTE a hop; every arrival by itself."""
    sc = ", ".join(f"({q(i)}, {q(t)}, {tone}::DOUBLE, {m}::DOUBLE, {'NULL' if x is None else x}::DOUBLE, {depth}, {decay}::DOUBLE)" for i, t, _, _, tone, m, x, _, depth, decay in BULK_SCENARIOS)
    out = f"""sc AS (SELECT *, coalesce(given, -0.5 * tone_delta + 0.2 * (mult - 1)) AS seed FROM (VALUES {sc}) v(id, target, tone_delta, mult, given, depth, decay)),
e AS (SELECT 'S' || l_suppkey AS src, 'C' || o_custkey AS dst, min(l_returnflag) AS kind, (1 + max(round(l_discount * 100))) / 20 AS w
  FROM lineitem JOIN orders ON l_orderkey = o_orderkey WHERE l_quantity >= 49 GROUP BY 1, 2),
way0 AS (SELECT src AS a, dst AS b, w FROM e UNION ALL SELECT dst, src, CASE kind WHEN 'A' THEN 0.5 * w ELSE w END FROM e WHERE kind <> 'R'),
way AS (SELECT *, w / sum(w) OVER (PARTITION BY a) AS part FROM way0),
seen0 AS (SELECT id, target AS c FROM sc), hop0 AS (SELECT id, target AS c, seed AS delta FROM sc)"""
    for k in range(1, hops + 1):
        out += f""",
hop{k} AS (SELECT h.id, b AS c, h.delta * decay * part AS delta FROM hop{k - 1} h JOIN sc USING (id) JOIN way ON a = h.c
  WHERE depth >= {k} AND NOT EXISTS (SELECT 1 FROM seen{k - 1} z WHERE z.id = h.id AND z.c = b)),
seen{k} AS (SELECT * FROM seen{k - 1} UNION SELECT id, c FROM hop{k})"""
    return out + ", arr AS (" + " UNION ALL ".join(f"SELECT *, {k} AS hop FROM hop{k}" for k in range(1, hops + 1)) + ")"


_base = """bm AS (SELECT ent AS c, avg_tone, conflict_news_count, escalation_signal FROM npanel WHERE m = DATE '1998-06-01'),
bn AS (SELECT nodes.c, coalesce(avg_tone, 0.0) AS tone, coalesce(conflict_news_count, 0) AS news, coalesce(escalation_signal, 0.0) AS esc FROM nodes LEFT JOIN bm USING (c))"""
_na = "na AS (SELECT dst AS ent, src AS domain, * FROM rep)"


def with_news(ctes: str) -> str:
    """Add the report panel and the baseline state to CTEs that already hold ``rep``."""
    return news_panel_ctes(f"{ctes}, {_na}") + f", {_base}"


TARGETS = """tg AS (SELECT id, c, least(greatest(tone + tone_delta, -1.0), 1.0) AS tone2, CAST(greatest(0, round_even(news * mult, 0)) AS BIGINT) AS news2,
  least(greatest(esc + 0.2 * (mult - 1) + 0.3 * greatest(0.0, -tone_delta), 0.0), 1.0) AS esc2 FROM sc JOIN bn ON c = target)"""
AFTER = """live AS (SELECT * FROM cf WHERE NOT is_severed AND w2 > 0),
hh AS (SELECT id, src AS c, dst AS o, CASE WHEN nat = 'directed_news' THEN 0 ELSE 1 END AS i, 1 AS u,
    CASE nat WHEN 'undirected_conflict' THEN w2 WHEN 'hybrid' THEN 0.7 * w2 ELSE 0.0 END AS wi, w2 AS wo FROM live
  UNION ALL SELECT id, dst, src, 1, CASE WHEN nat = 'directed_news' THEN 0 ELSE 1 END, w2,
    CASE nat WHEN 'undirected_conflict' THEN w2 WHEN 'hybrid' THEN 0.7 * w2 ELSE 0.0 END FROM live),
dg AS (SELECT id, c, CAST(sum(i) AS BIGINT) AS i, CAST(sum(u) AS BIGINT) AS u, count(DISTINCT o) AS o, sum(wi) AS wi, sum(wo) AS wo FROM hh GROUP BY 1, 2),
cst AS (SELECT id, src AS s, dst AS t, w2 AS w FROM live UNION ALL SELECT id, dst, src, CASE nat WHEN 'hybrid' THEN 0.7 * w2 ELSE w2 END FROM live WHERE nat <> 'directed_news'),
cn AS (SELECT id, c FROM sc, nodes)"""

HALF_EDGES = HALVES.removeprefix(f"{NODES}, {DYADS},").split("adv AS (")[0].rstrip().rstrip(",")
#: Baseline and counterfactual ranks per scenario and node.
RANKED = f"""{HALF_EDGES}, {PAIR_STEPS}, {rank_ctes('steps', 'nodes', prefix='br')}, {rank_ctes('cst', 'cn', 'id')},
rk AS (SELECT id, c, round(br.p, 9) AS p1, round(r.p, 9) AS p2, round(round(r.p, 9) - round(br.p, 9), 6) AS delta FROM r JOIN br USING (c))"""

# --- scoring ------------------------------------------------------------------------------

BASES = DYADS + ", pb AS (SELECT least(src, dst) AS pair_a, greatest(src, dst) AS pair_b, floor(100 * max(w) + 0.5) AS base FROM d GROUP BY 1, 2)"
DOMAIN_ROWS = "dm(domain, part, lo, hi) AS (VALUES ('escalation', 1.0, 20, 96), ('conflict', 0.8, 18, 98), ('economy', 0.6, 15, 95), ('energy', 0.7, 15, 95), ('global_impact', 0.9, 20, 97))"
HORIZON_ROWS = "hz(horizon_days, f) AS (VALUES (30, -3.0), (90, 2.0), (180, 6.0), (365, 9.0))"
OUTLOOK = f"{BASES}, {DOMAIN_ROWS}, {HORIZON_ROWS}, ol AS (SELECT pair_a, pair_b, CAST(horizon_days AS BIGINT) AS horizon_days, domain, greatest(lo, least(hi, base + floor(CAST(f AS DOUBLE) * part::DOUBLE + 0.5)))::DOUBLE AS score FROM pb, hz, dm)"
STATUS = """CASE domain
  WHEN 'conflict' THEN CASE WHEN score >= 80 THEN 'Critical' WHEN score >= 65 THEN 'Elevated' WHEN score >= 45 THEN 'Moderate' ELSE 'Guarded' END
  WHEN 'economy' THEN CASE WHEN score >= 75 THEN 'High Volatility' WHEN score >= 50 THEN 'Moderate Exposure' ELSE 'Stable' END
  WHEN 'energy' THEN CASE WHEN score >= 75 THEN 'Acute Disruption' WHEN score >= 50 THEN 'Tight Supply' ELSE 'Resilient' END
  WHEN 'global_impact' THEN CASE WHEN score >= 75 THEN 'Systemic Risk' WHEN score >= 55 THEN 'Regional Spillover' ELSE 'Localized' END
  WHEN 'overview' THEN CASE WHEN score >= 75 THEN 'high' WHEN score >= 55 THEN 'medium' ELSE 'low' END
  WHEN 'hotspot' THEN CASE WHEN score >= 85 THEN 'critical' WHEN score >= 75 THEN 'elevated' ELSE 'normal' END END"""

LINK = "src AS source_country_iso3, dst AS target_country_iso3"
SHOWN_DYADS = f"""{LINK}, is_directed, nat AS relationship_nature, 'cumulative_historical' AS period_type, has_conflict AS has_historical_conflict,
  events AS conflict_events_total, {r('best', 'fatalities_best_total')}, {r('low', 'fatalities_low_total')}, {r('high', 'fatalities_high_total')},
  {r('civ', 'deaths_civilians_total')}, n AS news_article_count, {r('tone', 'news_avg_tone')}, neg AS news_negative_tone_count,
  {r('neg / greatest(n, 1)', 'news_negative_tone_share')}, con AS news_conflict_article_count, {r('con / greatest(n, 1)', 'news_conflict_ratio')},
  {r('w', 'composite_tension_index')}"""
TARGET_FACTS = f"""{r('neg / n', 'news_negative_tone_share')}, {r('con / n', 'news_conflict_ratio')}, n AS news_article_count, neg AS news_negative_tone_count, con AS news_conflict_article_count"""

_days = f"""sd AS (SELECT CAST(seen_at AS DATE) AS day, target_country_iso3, count(*) AS news_count_total, sum(tone_score) AS tone_sum,
  count(*) FILTER (is_negative_tone) AS negative_tone_count, count(*) FILTER (is_extreme_tone) AS extreme_tone_count,
  count(*) FILTER (is_conflict_relevant) AS conflict_news_count, count(DISTINCT domain) AS unique_domains FROM scored WHERE target_country_iso3 IS NOT NULL GROUP BY 1, 2)"""
_unique = """live_id AS (SELECT * FROM keyed QUALIFY row_number() OVER (PARTITION BY article_id ORDER BY seen_at) = 1),
live_day AS (SELECT * FROM live_id QUALIFY row_number() OVER (PARTITION BY CAST(seen_at AS DATE), title ORDER BY seen_at, article_id) = 1)"""


#: Columns of the event panel in order.
PANEL_COLUMNS = ["country_iso3", "month_start", "year", "month", "year_month", *EVENT_METRICS, "has_conflict_event"]
CLASSIFIED = """tot AS (SELECT o_custkey AS country, count(*) AS events, sum(o_totalprice / 40000) AS f FROM orders GROUP BY 1),
cls AS (SELECT *, CAST(f > 50 AS BIGINT) AS escalation_warning, CAST('0x' || substr(md5('42:' || country), 1, 8) AS BIGINT) % 100 < 80 AS is_train FROM tot)"""


def live_ctes() -> str:
    """Scored articles of the stream: each id once, each title once a day."""
    return scored_ctes("live_day").replace(ARTICLES, f"{ARTICLES}, {_unique}")


def rule(name: str, count: str, source: str, passed: str | None = None) -> str:
    return f"SELECT '{name}' AS rule, {passed or f'{count} = 0'} AS passed, CAST({count} AS DOUBLE) AS observed FROM {source}"


ORACLES: dict[str, str] = {
    "events_clean": f"""WITH {CLEANED} SELECT id, country_iso3, country, country_id, region, CAST(event_date AS VARCHAR) AS event_date,
      year(event_date) AS event_year, month(event_date) AS event_month, strftime(event_date, '%Y-%m') AS year_month, CAST(kind AS BIGINT) AS type_of_violence,
      CASE kind WHEN 1 THEN 'state_based' WHEN 2 THEN 'non_state' ELSE 'unknown' END AS violence_type_label, conflict_name, side_a, side_b,
      {r('best')}, {r('high')}, {r('low')}, {r('deaths_civilians')}, {r('latitude')}, {r('longitude')} FROM tidy""",
    "events_unmapped": f"WITH {RAW} SELECT ' ' || n_name AS country, count(*) AS records FROM coded WHERE country_iso3 IS NULL GROUP BY 1",
    "event_monthly_totals": f"WITH {ORDER_EVENTS['nation']}, {TOTALS} SELECT ent AS country_iso3, CAST(m AS VARCHAR) AS month_start, {', '.join(EVENT_COUNTS)}, {', '.join(r(c) for c in EVENT_SUMS)} FROM agg",
    "event_panel": f"WITH {panel_ctes()} SELECT {PANEL_OUT} FROM panel",
    "event_panel_years": f"WITH {panel_ctes(low=1997, high=1999)} SELECT {PANEL_OUT} FROM panel",
    "event_features": event_feature_sql("nation"),
    "event_features_customer": event_feature_sql("customer"),
    "event_panel_metadata": f"WITH {panel_ctes()} SELECT count(*) AS total_rows, count(DISTINCT ent) AS unique_entities, min(strftime(m, '%Y-%m')) AS start_year_month, max(strftime(m, '%Y-%m')) AS end_year_month, '{','.join(PANEL_COLUMNS)}' AS feature_columns FROM panel",
    "articles_normalized": f"""WITH {normalized_ctes()} SELECT article_id, strftime(seen_at, '%Y-%m-%d %H:%M:%S') AS published_at_utc, year(seen_at) AS year, month(seen_at) AS month,
      strftime(seen_at, '%Y-%m') AS year_month, domain, language, raw_sourcecountry, source_country_iso3, target_country_iso3, {r('CAST(target_country_confidence AS DOUBLE)', 'target_country_confidence')} FROM normal""",
    "articles_targets_joined": f"WITH {normalized_ctes()} SELECT article_id, target_country_iso3, {r('CAST(target_country_confidence AS DOUBLE)', 'target_country_confidence')} FROM normal",
    "articles_scored": f"""WITH {scored_ctes()} SELECT article_id, target_country_iso3, is_conflict_relevant, conflict_category_count, primary_conflict_category,
      {', '.join(f'cat_{n}' for n in _names)}, {r('tone_score')}, is_negative_tone, is_extreme_tone, {r('conflict_intensity')} FROM scored""",
    "articles_relevance": f"WITH {scored_ctes()} SELECT count(*) AS articles, count(*) FILTER (is_conflict_relevant) AS relevant, {r('count(*) FILTER (is_conflict_relevant) / count(*)', 'relevant_share')} FROM scored",
    "news_panel": f"WITH {news_panel_ctes(scored_ctes() + ', na AS (SELECT target_country_iso3 AS ent, * FROM scored WHERE target_country_iso3 IS NOT NULL)', 'UNION SELECT ' + code('n_name') + ' FROM nation')} SELECT {NEWS_OUT} FROM npanel",
    "news_features": news_feature_sql(),
    "news_panel_by_publisher": f"WITH {news_panel_ctes(PUBLISHER_NA)} SELECT {NEWS_OUT} FROM npanel",
    "panels_joinable": f"WITH {panel_ctes()}, {news_panel_ctes(REPORT_NA)} SELECT count(*) AS overlapping_keys FROM panel JOIN npanel USING (ent, m)",
    "state_pairs": f"""WITH {SIDED} SELECT id AS event_id, a AS country_a_iso3, b AS country_b_iso3, a AS source_country_iso3, b AS target_country_iso3, false AS is_directed,
      'undirected_conflict' AS relationship_nature, ym AS year_month, CAST(event_date AS VARCHAR) AS event_date, {r('best', 'fatalities_best')}, {r('low', 'fatalities_low')},
      {r('high', 'fatalities_high')}, {r('civ', 'deaths_civilians')}, conflict_name FROM pe""",
    "pair_exclusions": f"""WITH {SIDED}, f AS (SELECT id, id IN (SELECT l_orderkey FROM bside) AS cand, (SELECT count(*) FROM pe WHERE pe.id = sided.id) AS k FROM sided)
      SELECT count(*) AS total_events_processed, count(*) FILTER (cand) AS bilateral_candidate_events, count(*) FILTER (k > 0) AS bilateral_events_retained,
      CAST(sum(k) AS BIGINT) AS bilateral_dyad_observations_extracted, count(*) FILTER (NOT cand) AS intrastate_civil_events_excluded,
      count(*) FILTER (cand AND k = 0) AS unmapped_events_excluded, count(*) FILTER (k = 0) AS total_excluded_records FROM f""",
    "news_pairs_monthly": f"WITH {NEWS_MONTHS} SELECT {LINK}, ym AS year_month, true AS is_directed, 'directed_news' AS relationship_nature, {r('tone', 'news_avg_tone')}, {TARGET_FACTS} FROM nm",
    "news_pairs_total": f"WITH {NEWS_TOTAL} SELECT {LINK}, {r('tone', 'news_avg_tone')}, {TARGET_FACTS} FROM nt",
    "news_pairs_weighted": f"WITH {NEWS_TOTAL} SELECT {LINK}, {r('wtone', 'news_avg_tone')}, {TARGET_FACTS} FROM nt",
    "conflict_pairs_total": f"WITH {CONFLICT_TOTAL} SELECT a AS pair_a, b AS pair_b, events AS conflict_events_total, {r('best', 'fatalities_best_total')}, {r('low', 'fatalities_low_total')}, {r('high', 'fatalities_high_total')}, {r('civ', 'deaths_civilians_total')} FROM ct",
    "dyads_cumulative": f"WITH {DYADS} SELECT {SHOWN_DYADS} FROM d",
    "dyads_by_supplier": f"""WITH m AS (SELECT 'S' || l_suppkey AS src, 'N' || c_nationkey AS dst, strftime(l_shipdate, '%Y-%m') AS ym, count(*) AS n, avg(1 - 20 * l_discount) AS tone,
      count(*) FILTER (l_returnflag = 'R') AS con FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey GROUP BY 1, 2, 3),
      s AS (SELECT src, dst, CAST(sum(n) AS BIGINT) AS n, avg(tone) AS tone, sum(con) AS con FROM m GROUP BY 1, 2)
      SELECT {LINK}, 'directed_news' AS relationship_nature, n AS news_article_count, {r('tone', 'news_avg_tone')},
      {r('least(0.5 * greatest(0.0, -tone) + 0.5 * con / n, 1.0)', 'composite_tension_index')} FROM s""",
    "dyads_strongest": f"WITH {DYADS} SELECT {LINK}, {r('w', 'composite_tension_index')} FROM d ORDER BY round(w, 9) DESC, src, dst LIMIT 10",
    "dyads_monthly": f"""WITH {SIDED}, {NEWS_MONTHS}, cm AS (SELECT a, b, ym, count(*) AS events, sum(best) AS best FROM pe GROUP BY 1, 2, 3),
      j AS (SELECT coalesce(a, src) AS src, coalesce(b, dst) AS dst, coalesce(cm.ym, nm.ym) AS ym, {nature('events IS NOT NULL', 'n IS NOT NULL')} AS nat, n IS NOT NULL AS is_directed,
        coalesce(events, 0) AS events, coalesce(best, 0.0) AS best, coalesce(n, 0) AS n, tone, coalesce(con, 0) AS con FROM cm FULL JOIN nm ON a = src AND b = dst AND cm.ym = nm.ym),
      t AS (SELECT *, {tension('best', 'events', 'n', 'tone', 'con')} AS w FROM j)
      SELECT {LINK}, is_directed, nat AS relationship_nature, ym AS year_month, events AS conflict_events_monthly, {r('best', 'fatalities_best_monthly')}, n AS news_article_count_monthly,
      {r('tone', 'news_avg_tone_monthly')}, con AS news_conflict_count_monthly, {r('w', 'monthly_tension_index')}, {r('lag(w) OVER x', 'monthly_tension_lag_1m')},
      {r('CAST(lag(events) OVER x AS DOUBLE)', 'conflict_events_lag_1m')}, {r('CAST(lag(n) OVER x AS DOUBLE)', 'news_count_lag_1m')},
      CASE WHEN count(*) OVER (PARTITION BY src, dst ORDER BY ym ROWS BETWEEN 3 PRECEDING AND 1 PRECEDING) = 3 THEN CAST(sum(events) OVER (PARTITION BY src, dst ORDER BY ym ROWS BETWEEN 3 PRECEDING AND 1 PRECEDING) AS DOUBLE) END AS conflict_events_prior_sum_3m
      FROM t WINDOW x AS (PARTITION BY src, dst ORDER BY ym)""",
    "node_degrees": f"""WITH {HALVES} SELECT c AS country_iso3, c AS country_name, in_degree, out_degree, total_degree, {r('weighted_in', 'weighted_in_degree')}, {r('weighted_out', 'weighted_out_degree')},
      adversaries AS conflict_adversary_count, {r('ti', 'mean_incoming_tone')}, {r('tu', 'mean_outgoing_tone')}, {r('mean_tension', 'mean_dyadic_tension')}, total_degree > 0 AS has_active_edges FROM met""",
    "node_ranks": f"WITH RECURSIVE {HALVES}, {PAIR_STEPS}, {rank_ctes('steps', 'nodes')} SELECT c AS country_iso3, {r('p', 'pagerank')} FROM r",
    "node_ranks_converged": f"WITH RECURSIVE {HALVES}, {PAIR_STEPS}, {rank_ctes('steps', 'nodes')} SELECT c AS country_iso3, {r('p * (SELECT count(*) FROM nodes)', 'pagerank_centrality', 8)} FROM r",
    "trade_ranks": f"""WITH RECURSIVE nodes AS (SELECT 'C' || c_custkey AS c FROM customer UNION ALL SELECT 'S' || s_suppkey FROM supplier),
      steps AS (SELECT 'S' || l_suppkey AS s, 'C' || o_custkey AS t, l_quantity AS w FROM lineitem JOIN orders ON l_orderkey = o_orderkey
        UNION ALL SELECT 'C' || o_custkey, 'S' || l_suppkey, 1.0 FROM lineitem JOIN orders ON l_orderkey = o_orderkey WHERE l_returnflag = 'R'),
      {rank_ctes('steps', 'nodes')} SELECT c AS country_iso3, {r('p', 'pagerank')} FROM r""",
    "graph_links": f"""WITH {DYADS} SELECT src AS source, dst AS target, is_directed, nat AS relationship_nature, events AS conflict_events, {r('best', 'fatalities')}, n AS news_articles,
      {r('tone', 'avg_tone')}, {r('w', 'tension_index')}, has_conflict FROM d""",
    "graph_nodes": f"""WITH RECURSIVE {HALVES}, {PAIR_STEPS}, {rank_ctes('steps', 'nodes')} SELECT c AS id, c AS label, in_degree, out_degree, total_degree, adversaries AS conflict_adversaries, {r('p', 'pagerank')},
      {r('mean_tension', 'mean_dyadic_tension')}, total_degree > 0 AS has_active_edges FROM met JOIN r USING (c)""",
    "graph_summary": f"""WITH {HALVES} SELECT (SELECT count(*) FROM met) AS total_reference_nodes, (SELECT count(*) FROM met WHERE total_degree > 0) AS active_nodes_with_edges,
      count(*) AS total_directed_dyads, count(*) FILTER (has_conflict) AS bilateral_conflict_dyads, count(*) FILTER (n > 0) AS directed_news_dyads, {r('max(w)', 'max_tension_index')} FROM d""",
    "scenarios_checked": f"WITH {CHECKED} SELECT id AS scenario_id, array_to_string(reasons, '; ') AS reasons, edge_matched FROM chk",
    "news_baseline_month": f"""WITH {news_panel_ctes(REPORT_NA)} SELECT ent AS country_iso3, strftime(m, '%Y-%m') AS year_month, news_count_total, {r('avg_tone')}, {r('escalation_signal')}
      FROM npanel WHERE m = (SELECT max(m) FROM npanel)""",
    "impact_targets": f"WITH {with_news(VALID)}, {TARGETS} SELECT id AS scenario_id, c AS country_iso3, {r('tone2', 'shocked_tone')}, news2 AS shocked_news, {r('esc2', 'shocked_escalation')} FROM tg",
    "impact_shocked_edges": f"WITH {VALID} SELECT id AS scenario_id, {LINK}, sever AS is_severed, {r('direct', 'direct_tension')} FROM hit",
    "impact_node_arrivals": f"WITH {SPREAD} SELECT id AS scenario_id, c AS node, {r('shift', 'tone_shift')}, CAST(hop AS BIGINT) AS hop FROM narr",
    "impact_deep_arrivals": f"WITH {deep_ctes()} SELECT id AS scenario_id, c AS node, {r('sum(-sign(delta) * least(0.4, abs(delta)))', 'tone_shift')}, CAST(min(hop) AS BIGINT) AS hop FROM arr GROUP BY 1, 2",
    "impact_dyads": f"""WITH {SPREAD} SELECT id AS scenario_id, {LINK}, is_directed, nat AS relationship_nature, {r('w', 'baseline_tension_index')}, {r('w2', 'counterfactual_tension_index')},
      is_severed, is_direct AS is_directly_shocked, is_ripple AS is_ripple_affected, has_conflict AS has_historical_conflict, {r('best', 'fatalities_best_total')}, {r('tone', 'news_avg_tone')}, {r('round(w2 - w, 4)', 'delta_tension_index')} FROM cf""",
    "impact_countries": f"""WITH RECURSIVE {with_news(SPREAD)}, {TARGETS}, {AFTER}, {RANKED}, mt AS (SELECT * FROM (
        SELECT c, CAST(sum(CASE WHEN nat = 'directed_news' THEN e = 1 ELSE true END::INT) AS BIGINT) AS bi, CAST(sum(CASE WHEN nat = 'directed_news' THEN e = 0 ELSE true END::INT) AS BIGINT) AS bo, count(DISTINCT o) AS bt
        FROM (SELECT src AS c, dst AS o, nat, 0 AS e FROM d UNION ALL SELECT dst, src, nat, 1 FROM d) GROUP BY c)),
      bw AS (SELECT c, sum(wi) AS wi, sum(wo) AS wo FROM half WHERE c IN (SELECT c FROM nodes) AND o IN (SELECT c FROM nodes) GROUP BY c)
      SELECT cn.id AS scenario_id, cn.c AS country_iso3, tg.id IS NOT NULL AS is_direct_target, CAST(CASE WHEN tg.id IS NOT NULL THEN 0 ELSE coalesce(hop, -1) END AS BIGINT) AS ripple_hop,
      {r('CASE WHEN tg.id IS NOT NULL THEN tone2 ELSE least(greatest(tone + coalesce(shift, 0.0), -1.0), 1.0) END', 'counterfactual_tone')},
      coalesce(news2, news) AS counterfactual_conflict_news_count, {r('coalesce(esc2, esc)', 'counterfactual_escalation_signal')}, {r('p2', 'counterfactual_pagerank')},
      coalesce(i, 0) AS counterfactual_in_degree, coalesce(u, 0) AS counterfactual_out_degree, coalesce(o, 0) AS counterfactual_total_degree,
      {r('coalesce(dg.wi, 0.0)', 'counterfactual_weighted_in')}, {r('coalesce(dg.wo, 0.0)', 'counterfactual_weighted_out')},
      coalesce(news2, news) - news AS delta_conflict_news_count, coalesce(i, 0) - coalesce(bi, 0) AS delta_in_degree, coalesce(u, 0) - coalesce(bo, 0) AS delta_out_degree, coalesce(o, 0) - coalesce(bt, 0) AS delta_total_degree,
      {r('p1', 'baseline_pagerank')}, {r('delta', 'delta_pagerank')},
      {r('round(CASE WHEN tg.id IS NOT NULL THEN tone2 ELSE least(greatest(tone + coalesce(shift, 0.0), -1.0), 1.0) END - tone, 4)', 'delta_tone')},
      {r('round(coalesce(esc2, esc) - esc, 4)', 'delta_escalation_signal')},
      {r('round(round(coalesce(dg.wi, 0.0), 9) - round(coalesce(bw.wi, 0.0), 9), 4)', 'delta_weighted_in')}, {r('round(round(coalesce(dg.wo, 0.0), 9) - round(coalesce(bw.wo, 0.0), 9), 4)', 'delta_weighted_out')}
      FROM cn JOIN bn USING (c) LEFT JOIN tg USING (id, c) LEFT JOIN narr USING (id, c) LEFT JOIN dg USING (id, c) LEFT JOIN rk USING (id, c) LEFT JOIN mt USING (c) LEFT JOIN bw USING (c)""",
    "impact_summary": f"""WITH RECURSIVE {SPREAD}, {AFTER}, {RANKED}, ext AS (SELECT id, arg_min(c, (-delta, c)) AS up_c, max(delta) AS up, arg_min(c, (delta, c)) AS down_c, min(delta) AS down FROM rk GROUP BY id), reach AS (SELECT sc.id, sc.target, count(narr.c) AS k FROM sc LEFT JOIN narr USING (id) GROUP BY 1, 2)
      SELECT id AS scenario_id, target AS target_country_iso3, (SELECT count(*) FROM nodes) AS total_reference_countries, 1::BIGINT AS directly_shocked_countries, k AS ripple_affected_countries_count,
      k + 1 AS total_affected_countries_count, (SELECT count(*) FROM nodes) - k - 1 AS unaffected_countries_count, (SELECT count(*) FROM d) AS total_dyads_simulated,
      (SELECT count(*) FROM hit WHERE hit.id = reach.id AND sever) AS severed_dyads_count,
      up_c AS max_pagerank_increase_country, {r('up', 'max_pagerank_increase')}, down_c AS max_pagerank_decrease_country, {r('down', 'max_pagerank_decrease')} FROM reach JOIN ext USING (id)""",
    "quality_events": "WITH " + CLEANED + " " + " UNION ALL ".join([
        rule("not empty", "count(*)", "tidy", "count(*) > 0"),
        rule("no nulls in country_iso3", "count(*) FILTER (country_iso3 IS NULL)", "tidy"),
        rule("no nulls in latitude", "count(*) FILTER (latitude IS NULL)", "tidy"),
        *[rule(f"finite {c}", f"count(*) FILTER ({c} IS NULL OR isnan({c}) OR isinf({c}))", "tidy") for c in ("best", "high", "low", "deaths_civilians")],
        rule("latitude in [-90, 90]", "count(*) FILTER (latitude NOT BETWEEN -90 AND 90)", "tidy"),
        rule("longitude in [-180, 180]", "count(*) FILTER (longitude NOT BETWEEN -180 AND 180)", "tidy"),
    ]),
    "quality_graph": f"WITH RECURSIVE {HALVES}, {PAIR_STEPS}, {rank_ctes('steps', 'nodes')} " + " UNION ALL ".join([
        "SELECT 'has composite_tension_index' AS rule, true AS passed, 1.0::DOUBLE AS observed", "SELECT 'has gone', false, 0.0::DOUBLE",
        rule("no self loops", "count(*) FILTER (src = dst)", "d"),
        rule("composite_tension_index in [0.0, 1.0]", "count(*) FILTER (w NOT BETWEEN 0 AND 1)", "d"),
        rule("news_avg_tone in [-1.0, 1.0]", "count(*) FILTER (tone NOT BETWEEN -1 AND 1)", "d"),
        rule("same keys country_iso3", "(SELECT count(*) FROM ((SELECT DISTINCT src FROM d EXCEPT SELECT c FROM nodes) UNION ALL (SELECT c FROM nodes EXCEPT SELECT src FROM d)))", "(SELECT 1)"),
        rule("as many pairs as nodes", "((SELECT count(*) FROM d) - (SELECT count(*) FROM nodes))", "(SELECT 1)"),
        f"SELECT 'sum of pagerank_centrality is 1.0', abs(sum(p) - 1.0) < 1e-3, {r('sum(p)').split(' AS ')[0]} FROM r",
    ]),
    "quality_news": f"""WITH {panel_ctes()}, {news_panel_ctes(REPORT_NA)}, lagged AS (SELECT *, lag(conflict_news_count, 3) OVER w AS conflict_lag, lag(avg_tone, 12) OVER w AS tone_lag,
      lag(avg_tone) OVER w AS last_tone, date_diff('month', min(m) OVER (), m) AS age FROM npanel WINDOW w AS (PARTITION BY ent ORDER BY m))
      SELECT 'is_partial_month is boolean' AS rule, true AS passed, NULL::DOUBLE AS observed UNION ALL SELECT 'year is boolean', false, NULL
      UNION ALL SELECT 'conflict_news_lag_3m missing before month 4', count(*) FILTER (age < 3 AND conflict_lag IS NOT NULL) = 0, CAST(count(*) FILTER (age < 3 AND conflict_lag IS NOT NULL) AS DOUBLE) FROM lagged
      UNION ALL SELECT 'avg_tone_lag_12m missing before month 13', count(*) FILTER (age < 12 AND tone_lag IS NOT NULL) = 0, CAST(count(*) FILTER (age < 12 AND tone_lag IS NOT NULL) AS DOUBLE) FROM lagged
      UNION ALL SELECT 'joinable on country_iso3, year_month', count(*) > 0, CAST(count(*) AS DOUBLE) FROM panel JOIN npanel USING (ent, m)
      UNION ALL SELECT 'finite avg_tone', count(*) FILTER (isnan(avg_tone) OR isinf(avg_tone)) = 0, CAST(count(*) FILTER (isnan(avg_tone) OR isinf(avg_tone)) AS DOUBLE) FROM lagged
      UNION ALL SELECT 'finite avg_tone_lag_1m', count(*) FILTER (isnan(last_tone) OR isinf(last_tone)) = 0, CAST(count(*) FILTER (isnan(last_tone) OR isinf(last_tone)) AS DOUBLE) FROM lagged""",
    "entity_totals": f"""WITH s AS (SELECT c_mktsegment AS country, c_acctbal AS f FROM customer UNION ALL SELECT p_brand, p_size FROM part UNION ALL SELECT s_name, NULL FROM supplier)
      SELECT country, count(*) AS recent_events, {r('sum(coalesce(f, 0.0))', 'conflict_intensity', 4)}, CAST(sum(coalesce(f, 0.0)) > 50 AS BIGINT) AS escalation_warning FROM s GROUP BY country""",
    "classifier_split": f"""WITH {CLASSIFIED} SELECT is_train, escalation_warning, count(*) AS entities, CAST(sum(events) AS BIGINT) AS events FROM cls GROUP BY 1, 2""",
    "pair_status": f"WITH {DYADS}, x AS (SELECT {LINK}, round(100 * w, 4) + 0.0 AS score, unnest(['conflict', 'economy', 'energy', 'global_impact', 'overview', 'hotspot']) AS domain FROM d) SELECT *, {STATUS} AS status FROM x",
    "pair_sub_scores": f"WITH {BASES} SELECT pair_a, pair_b, base AS score, signal, least(95.0, base - k)::DOUBLE AS sub_score FROM pb, (VALUES ('political', 6), ('border', 12), ('cyber', 18)) v(signal, k)",
    "contribution_split": f"""WITH {panel_ctes()}, x AS (SELECT ent, fatalities_best_total - coalesce(lag(fatalities_best_total) OVER (PARTITION BY ent ORDER BY m), 0) AS d FROM panel)
      SELECT ent AS country_iso3, CASE WHEN d > 0 THEN 'up' ELSE 'down' END AS direction, count(*) AS months, {r('sum(d)', 'total')} FROM x WHERE d <> 0 GROUP BY 1, 2""",
    "risk_outlook": f"WITH {OUTLOOK} SELECT *, {STATUS} AS status FROM ol",
    "risk_outlook_fan": f"""WITH {OUTLOOK}, st(step, horizon, f) AS (VALUES (0, 'Now', 0.0), (1, '30D', 0.25), (2, '60D', 0.5), (3, '90D', 0.75), (4, '180D', 1.0), (5, '365D', 1.25)),
      k AS (SELECT pair_a, pair_b, horizon_days, CAST(step AS BIGINT) AS step, horizon, CAST(floor(least(98.0, greatest(20.0, score + f::DOUBLE * 8)) + 0.5) AS BIGINT) AS risk FROM ol, st WHERE domain = 'escalation')
      SELECT *, least(100, risk + 7 + 2 * step) AS upper, greatest(10, risk - 6 - 2 * step) AS lower, greatest(25, risk - 12) AS baseline FROM k""",
    "risk_outlook_drivers": f"WITH {OUTLOOK} SELECT *, CASE WHEN score >= 70 THEN 'high' ELSE 'medium' END AS impact FROM ol WHERE domain IN ('conflict', 'energy')",
    "factor_stress": f"""WITH {panel_ctes()}, g AS (SELECT ent, m, fatalities_best_total AS f, CAST(events_total AS DOUBLE) AS e, coalesce(lag(fatalities_best_total) OVER x, 0) AS pf, CAST(coalesce(lag(events_total) OVER x, 0) AS DOUBLE) AS pe
        FROM panel WINDOW x AS (PARTITION BY ent ORDER BY m)),
      h AS (SELECT ent, m, round(least(greatest((f - pf) / greatest(pf, 1.0), -10.0), 10.0), 4) * 100.0 AS gpr0, round(least(greatest((e - pe) / greatest(pe, 1.0), -10.0), 10.0), 4) * 10.0 AS oil0,
        round(ln(1 + f) - ln(1 + pf), 4) * 5.0 AS gold0, round(ln(1 + e) - ln(1 + pe), 4) AS fx0 FROM g),
      k AS (SELECT ent, m, least(greatest(gpr0, -100.0), 100.0) AS gpr, least(greatest(oil0, -100.0), 100.0) AS oil, least(greatest(gold0, -100.0), 100.0) AS gold, least(greatest(fx0, -100.0), 100.0) AS fx FROM h),
      z AS (SELECT *, 0.68::DOUBLE - 0.0018::DOUBLE * gpr - 0.095::DOUBLE * oil - 0.04::DOUBLE * gold - 0.22::DOUBLE * fx AS net,
        least(95.0::DOUBLE, greatest(8.0::DOUBLE, 41.6::DOUBLE + 0.15::DOUBLE * gpr + 1.25::DOUBLE * oil + 0.75::DOUBLE * gold + 2.8::DOUBLE * fx)) AS down FROM k)
      SELECT ent AS country_iso3, strftime(m, '%Y-%m') AS year_month, {r('round(net, 2)', 'net_return_forecast', 2)}, {r('round(down, 1)', 'downside_probability', 2)}, {r('round(100 - down, 1)', 'upside_probability', 2)},
      CAST(floor(25014.60::DOUBLE * (1 + net / 100) + 0.5) AS BIGINT) AS projected_level,
      CAST(floor(25014.60::DOUBLE * (1 + net / 100) - 25014.60::DOUBLE + 0.5) AS BIGINT) AS point_change,
      {r('round(-0.0018::DOUBLE * gpr, 2)', 'gpr_impact', 2)}, {r('round(-0.095::DOUBLE * oil, 2)', 'oil_impact', 2)}, {r('round(-0.04::DOUBLE * gold, 2)', 'gold_impact', 2)}, {r('round(-0.22::DOUBLE * fx, 2)', 'fx_impact', 2)} FROM z""",
    "stream_daily_counts": f"WITH {live_ctes()}, {_days} SELECT CAST(day AS VARCHAR) AS day, target_country_iso3, news_count_total, {r('tone_sum')}, negative_tone_count, extreme_tone_count, conflict_news_count, unique_domains FROM sd",
    "stream_monthly_counts": f"""WITH {live_ctes()}, {_days} SELECT target_country_iso3, CAST(CAST(date_trunc('month', day) AS DATE) AS VARCHAR) AS month_start, CAST(sum(news_count_total) AS BIGINT) AS news_count_total,
      CAST(sum(negative_tone_count) AS BIGINT) AS negative_tone_count, CAST(sum(extreme_tone_count) AS BIGINT) AS extreme_tone_count, CAST(sum(conflict_news_count) AS BIGINT) AS conflict_news_count,
      {r('sum(tone_sum) / sum(news_count_total)', 'avg_tone')}, any_value(md.unique_domains) AS unique_domains
      FROM sd JOIN (SELECT target_country_iso3 AS t, date_trunc('month', seen_at) AS m, count(DISTINCT domain) AS unique_domains FROM scored GROUP BY 1, 2) md
      ON md.t = target_country_iso3 AND md.m = date_trunc('month', day) GROUP BY 1, 2""",
    "stream_unique_articles": f"WITH {ARTICLES}, {_unique} SELECT article_id FROM live_day",
}
