"""DuckDB SQL for the named queries, written independently of the Spark plans.

``VIEWS`` are named subqueries over the test tables, each using only earlier
ones. ``ORACLE`` selects from them; doubles are rounded as in the catalog.
"""

from __future__ import annotations

import re

VIEWS: dict[str, str] = {
    "listing_info": """
        SELECT o_custkey AS user_id, o_orderkey AS listing_id,
               CAST(o_orderdate AS DATE) AS auditing_date,
               CAST(3 * (o_orderkey % 4 + 1) AS INTEGER) AS term,
               CAST(70 + 5 * (o_orderkey % 6) AS DOUBLE) / 10 AS rate,
               CAST(500 + 50 * ((37 * o_orderkey) % 120) AS INTEGER) AS principal
        FROM orders""",
    "loans": """
        SELECT user_id, listing_id, auditing_date, m,
               auditing_date + m AS due_date,
               CAST(principal AS DOUBLE) / term AS due_amt
        FROM (SELECT *, CAST(CASE WHEN month(auditing_date) = 2 THEN 28
                             ELSE day(last_day(auditing_date)) END AS INTEGER) AS m
              FROM listing_info)""",
    "train": r"""
        SELECT user_id, listing_id, auditing_date, due_date, due_amt,
               CASE WHEN k >= 33 THEN '\N'
                    ELSE CAST(due_date - LEAST(k, m) AS VARCHAR) END AS repay_date,
               CASE WHEN k >= 33 THEN '\N' ELSE CAST(due_amt AS VARCHAR) END AS repay_amt
        FROM (SELECT *, CAST((7 * listing_id + user_id) % 36 AS INTEGER) AS k FROM loans)
        WHERE auditing_date < DATE '2000-01-01'""",
    "test": """
        SELECT user_id, listing_id, auditing_date, due_date, due_amt
        FROM loans WHERE auditing_date >= DATE '2000-01-01'""",
    "repay_log": """
        SELECT user_id, listing_id, order_id, due_date, due_amt,
               CASE WHEN k >= 36 THEN DATE '2200-01-01'
                    WHEN k >= 31 THEN due_date + (k - 30)
                    ELSE due_date - k END AS repay_date,
               CASE WHEN k >= 36 THEN NULL ELSE 10000.0::DOUBLE * floor(due_amt / 10000) END AS repay_amt
        FROM (SELECT o_custkey AS user_id, l_orderkey AS listing_id, l_linenumber AS order_id,
                     CAST(o_orderdate AS DATE) + CAST(30 * l_linenumber AS INTEGER) AS due_date,
                     l_extendedprice AS due_amt,
                     CAST((7 * l_partkey + 3 * l_suppkey + l_linenumber) % 40 AS INTEGER) AS k
              FROM lineitem JOIN orders ON l_orderkey = o_orderkey)""",
    "user_info": r"""
        SELECT c_custkey AS user_id,
               DATE '2016-01-01' + CAST(31 * (c_custkey % 24) AS INTEGER) AS reg_mon,
               CASE WHEN c_custkey % 3 = 0 THEN ' 男' ELSE '女' END AS gender,
               'p' || (c_nationkey % 5) AS cell_province,
               'p' || (c_custkey % 5) AS id_province,
               CASE WHEN c_custkey % 10 = 0 THEN '\N'
                    ELSE 'c' || (1 + (c_custkey * c_custkey) % 37) END AS id_city,
               DATE '2018-01-01' + CAST(c_custkey % 300 AS INTEGER) AS insertdate
        FROM customer
        UNION ALL
        SELECT c_custkey, DATE '2016-01-01' + CAST(31 * (c_custkey % 24) AS INTEGER),
               '女', 'p0', 'p0', 'c1',
               DATE '2018-01-01' + CAST(c_custkey % 300 AS INTEGER) + 30
        FROM customer WHERE c_custkey % 20 = 0""",
    "user_tags": """
        SELECT DISTINCT o_custkey AS user_id, t.tag AS tag
        FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN part ON l_partkey = p_partkey,
             LATERAL (SELECT p_type AS tag
                      UNION ALL SELECT p_brand WHERE l_returnflag = 'R'
                      UNION ALL SELECT 'size' || p_size WHERE l_returnflag = 'R') t""",
    "user_taglist": """
        SELECT user_id, string_agg(tag, '|' ORDER BY tag) AS taglist,
               DATE '2018-01-01' + CAST(user_id % 300 AS INTEGER) AS tag_insert_date
        FROM user_tags GROUP BY user_id""",
    "behaviour": """
        SELECT user_id, behavior_time, behavior_type,
               CAST(isodow(behavior_time) - 1 AS INTEGER) AS weekday,
               CAST(month(behavior_time) AS INTEGER) AS month,
               CAST(year(behavior_time) AS INTEGER) AS year,
               CAST(hour(behavior_time) AS INTEGER) AS hour
        FROM (SELECT user_id, ts AS behavior_time,
                     CASE WHEN event_type IN ('click', 'signup') THEN 1 WHEN event_type = 'view' THEN 2
                          WHEN event_type IN ('purchase', 'error') THEN 3 END AS behavior_type
              FROM events)""",
    "decoded": r"""
        SELECT listing_id, user_id, auditing_date, due_date, due_amt,
               CASE WHEN repay_date = '\N' THEN due_date + 1 ELSE TRY_CAST(repay_date AS DATE) END AS repay_date,
               CASE WHEN repay_date = '\N' THEN due_date ELSE TRY_CAST(repay_date AS DATE) END AS repay_date_0,
               CASE WHEN repay_amt = '\N' THEN 0.0::DOUBLE ELSE TRY_CAST(repay_amt AS DOUBLE) END AS repay_amt
        FROM train""",
    "labelled": """
        SELECT *, CAST(CASE WHEN repay_amt = 0 THEN 32 WHEN auditing_date = repay_date THEN 31
                            ELSE date_diff('day', repay_date, due_date) END AS INTEGER) AS label
        FROM decoded""",
    "fact": """
        SELECT *, CAST(month(due_date) AS INTEGER) AS due_month,
               CAST(isodow(due_date) AS INTEGER) AS due_weekday,
               CAST(isodow(repay_date) AS INTEGER) AS repay_weekday
        FROM (SELECT user_id, listing_id, auditing_date, due_date, due_amt, repay_date, repay_amt, label,
                     TRUE AS is_train FROM labelled
              UNION ALL
              SELECT user_id, listing_id, auditing_date, due_date, due_amt, NULL, NULL, NULL, FALSE FROM test)""",
    "listing": """
        SELECT *, CAST(month(auditing_date) AS INTEGER) AS auditing_date_month,
               CAST(CASE month(auditing_date) WHEN 2 THEN 28 WHEN 4 THEN 30 WHEN 6 THEN 30
                         WHEN 9 THEN 30 WHEN 11 THEN 30 ELSE 31 END AS INTEGER) AS auditing_date_days,
               CAST(principal AS DOUBLE) / term AS principal_per_term,
               rate / term AS "TermRate",
               CAST(CASE WHEN principal IS NULL THEN NULL WHEN principal <= 1170 THEN 6
                         WHEN principal <= 2260 THEN 5 WHEN principal <= 3350 THEN 4
                         WHEN principal <= 3910 THEN 3 WHEN principal <= 5540 THEN 2
                         ELSE 1 END AS INTEGER) AS principal_class
        FROM listing_info""",
    "loan_stats": """
        SELECT user_id, count(*) AS loan_times, avg(principal) AS mean_principal,
               coalesce(stddev_samp(principal), 0) AS std_principal,
               CAST(CASE WHEN count(*) <= 1 THEN 1 WHEN count(*) = 2 THEN 2 WHEN count(*) <= 4 THEN 3
                         WHEN count(*) <= 8 THEN 4 ELSE 5 END AS INTEGER) AS loan_times_type
        FROM listing_info GROUP BY user_id""",
    "newest": """
        SELECT * EXCLUDE rn FROM (
            SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY insertdate DESC) AS rn FROM user_info)
        WHERE rn = 1""",
    "profiles": r"""
        SELECT user_id, reg_mon, CASE WHEN trim(gender) = '男' THEN 1 ELSE 0 END AS gender,
               cell_province, id_province, replace(id_city, '\N', 'c0') AS id_city,
               insertdate AS info_insert_date,
               CASE WHEN cell_province = id_province THEN 1 ELSE 0 END AS remote_boolean
        FROM newest""",
    "cities": """
        SELECT id_city, n_users,
               CAST(CASE WHEN id_city = 'c0' THEN 0
                         ELSE LEAST(6, (n_users - low) // GREATEST(1, (high - low) // 5)) + 1
                    END AS INTEGER) AS class
        FROM (SELECT *, min(n_users) OVER () AS low, max(n_users) OVER () AS high
              FROM (SELECT id_city, count(*) AS n_users FROM profiles GROUP BY id_city))""",
    "profile_features": """
        SELECT p.*, c.class, CAST(year(reg_mon) AS INTEGER) AS reg_mon_y,
               CAST(month(reg_mon) AS INTEGER) AS reg_mon_m
        FROM profiles p LEFT JOIN cities c ON p.id_city = c.id_city""",
    "log_all": """
        SELECT *, CASE WHEN repay_date <> DATE '2200-01-01' THEN 1 ELSE 0 END AS repay,
               CAST(CASE WHEN date_diff('day', repay_date, due_date) >= 0
                         THEN date_diff('day', repay_date, due_date) ELSE -1 END AS INTEGER) AS early
        FROM repay_log""",
    "log1": """
        SELECT *, CAST(month(due_date) AS INTEGER) AS due_month, CAST(day(due_date) AS INTEGER) AS due_day,
               CAST(isodow(due_date) AS INTEGER) AS due_weekday,
               CAST(isodow(repay_date) AS INTEGER) AS repay_weekday
        FROM log_all WHERE order_id = 1""",
    "log1_rate": """
        SELECT l.*, i.rate FROM log1 l
        LEFT JOIN listing_info i ON l.user_id = i.user_id AND l.listing_id = i.listing_id""",
    "early_modes": """
        SELECT user_id, early AS mode_value FROM (
            SELECT user_id, early, row_number() OVER (PARTITION BY user_id ORDER BY count(*) DESC, early) AS rn
            FROM log1 GROUP BY user_id, early) WHERE rn = 1""",
    "weekday_modes": """
        SELECT user_id, due_weekday AS mode_value FROM (
            SELECT user_id, due_weekday,
                   row_number() OVER (PARTITION BY user_id ORDER BY count(*) DESC, due_weekday) AS rn
            FROM log1 GROUP BY user_id, due_weekday) WHERE rn = 1""",
    "user_log_stats": """
        SELECT s.*, e.mode_value AS u_early_repay_days_mode, w.mode_value AS u_repay_due_weekday_mode
        FROM (SELECT user_id, max(early) AS u_early_repay_days_max, min(early) AS u_early_repay_days_min,
                     avg(early) AS u_early_repay_days_mean,
                     coalesce(stddev_samp(early), 0) AS u_early_repay_days_std,
                     avg(due_weekday) AS u_repay_due_weekday_mean,
                     coalesce(stddev_samp(due_weekday), 0) AS u_repay_due_weekday_std,
                     avg(repay_weekday) AS u_repay_weekday_mean,
                     coalesce(stddev_samp(repay_weekday), 0) AS u_repay_weekday_std,
                     avg(repay) AS u_repay_mean, coalesce(stddev_samp(repay), 0) AS u_repay_std
              FROM log1 GROUP BY user_id) s
        JOIN early_modes e ON s.user_id = e.user_id
        JOIN weekday_modes w ON s.user_id = w.user_id""",
}


def _grain(source: str, key: str, prefix: str) -> str:
    return f"""
        SELECT user_id, {key}, avg(repay) AS {prefix}_repay_mean,
               coalesce(stddev_samp(repay), 0) AS {prefix}_repay_std,
               avg(early) AS {prefix}_early_repay_days_mean,
               coalesce(stddev_samp(early), 0) AS {prefix}_early_repay_days_std
        FROM {source} WHERE {key} IS NOT NULL GROUP BY user_id, {key}"""


def _distribution(source: str, suffix: str) -> str:
    return f"""
        SELECT user_id, avg(repay) AS repay_mean{suffix},
               max(early) AS early_repay_days_max{suffix},
               median(early) AS early_repay_days_median{suffix},
               CAST(sum(early) AS BIGINT) AS early_repay_days_sum{suffix},
               avg(early) AS early_repay_days_mean{suffix},
               stddev_samp(early) AS early_repay_days_std{suffix},
               max(due_amt) AS due_amt_max{suffix}, min(due_amt) AS due_amt_min{suffix},
               median(due_amt) AS due_amt_median{suffix},
               avg(due_amt) AS due_amt_mean{suffix},
               sum(due_amt) AS due_amt_sum{suffix}, stddev_samp(due_amt) AS due_amt_std{suffix},
               CASE WHEN count(*) < 3 THEN NULL WHEN max(due_amt) = min(due_amt) THEN 0
                    ELSE skewness(due_amt) END AS due_amt_skew{suffix},
               CASE WHEN max(due_amt) = min(due_amt) THEN -3
                    ELSE kurtosis_pop(due_amt) END AS due_amt_kurt{suffix},
               max(due_amt) - min(due_amt) AS due_amt_ptp{suffix}
        FROM {source} GROUP BY user_id"""


def _tiers(low: str, high: str) -> str:
    return f"""
        SELECT user_id, freq,
               CASE WHEN freq >= {high} THEN 1 ELSE 0 END AS most_freq,
               CASE WHEN freq >= {low} AND freq < {high} THEN 1 ELSE 0 END AS median_freq,
               CASE WHEN freq < {low} THEN 1 ELSE 0 END AS lower_freq,
               CASE WHEN freq >= {high} THEN 'most' WHEN freq >= {low} THEN 'median' ELSE 'lower' END AS tier
        FROM (SELECT user_id, count(*) AS freq FROM log1 GROUP BY user_id) CROSS JOIN freq_bounds"""


def _tier_amounts(source: str) -> str:
    return f"""
        SELECT tier, repay_amt, avg(early) AS freq_early_repay_days_mean,
               stddev_samp(early) AS freq_early_repay_days_std
        FROM log1 l JOIN {source} t ON l.user_id = t.user_id
        WHERE repay_amt IS NOT NULL GROUP BY tier, repay_amt"""


def _dense_share(column: str, low: int, high: int) -> str:
    return f"""
        SELECT d.behavior_type, d.{column}, coalesce(c.n, 0) AS n,
               coalesce(coalesce(c.n, 0) / nullif(sum(coalesce(c.n, 0)) OVER (PARTITION BY d.behavior_type), 0), 0)
                   AS share
        FROM (SELECT CAST(t.i AS INTEGER) AS behavior_type, CAST(x.j AS INTEGER) AS {column}
              FROM range(1, 4) t(i), range({low}, {high + 1}) x(j)) d
        LEFT JOIN (SELECT behavior_type, {column}, count(*) AS n FROM behaviour GROUP BY ALL) c
          ON c.behavior_type = d.behavior_type AND c.{column} = d.{column}"""


def _describe(group: str, columns: list[str], source: str = "behaviour") -> str:
    return " UNION ALL ".join(
        f"""
        SELECT {group}, '{c}' AS "column", count({c}) AS "count", avg({c}) AS "mean",
               stddev_samp({c}) AS "std", CAST(min({c}) AS DOUBLE) AS "min",
               CAST(max({c}) AS DOUBLE) AS "max",
               CAST(quantile_cont({c}, 0.25) AS DOUBLE) AS p25,
               CAST(quantile_cont({c}, 0.5) AS DOUBLE) AS p50,
               CAST(quantile_cont({c}, 0.75) AS DOUBLE) AS p75
        FROM {source} GROUP BY {group}"""
        for c in columns
    )


VIEWS |= {
    "month_stats": _grain("log1", "due_month", "u_dm"),
    "weekday_stats": _grain("log1", "due_weekday", "u_dw"),
    "rate_stats": _grain("log1_rate", "rate", "u_r"),
    "amount_stats": _grain("log1", "repay_amt", "u_ra"),
    "distribution_first": _distribution("log1", ""),
    "distribution_all": _distribution("log_all", "_all_order"),
    "freq_bounds": """
        SELECT quantile_cont(freq, 0.25) AS low, quantile_cont(freq, 0.75) AS high
        FROM (SELECT user_id, count(*) AS freq FROM log1 GROUP BY user_id)""",
    "tiers_quantile": _tiers("low", "high"),
    "tiers_fixed": _tiers("10", "20"),
    "tier_stats": """
        SELECT tier, count(*) AS n, avg(early) AS tier_early_mean, var_samp(early) AS tier_early_var
        FROM log1 l JOIN tiers_quantile t ON l.user_id = t.user_id GROUP BY tier""",
    "tier_features": """
        SELECT t.*, s.tier_early_mean, s.tier_early_var
        FROM tiers_quantile t JOIN tier_stats s ON t.tier = s.tier""",
    "tier_amounts": _tier_amounts("tiers_quantile"),
    "tier_amounts_fixed": _tier_amounts("tiers_fixed"),
    "tag_counts": """
        SELECT tag, count(*) AS n,
               round(count(*) / (SELECT CAST(count(*) AS DOUBLE) FROM user_taglist), 5) AS share
        FROM (SELECT unnest(string_split(taglist, '|')) AS tag FROM user_taglist) GROUP BY tag""",
    "words": r"""
        SELECT user_id, word, count(*) AS n
        FROM (SELECT user_id, unnest(regexp_extract_all(lower(taglist), '[\p{L}\p{N}_]{2,}')) AS word
              FROM user_taglist) GROUP BY user_id, word""",
    "bag": """
        SELECT w.user_id, w.word, w.n, d.n_documents
        FROM words w JOIN (SELECT word, count(*) AS n_documents FROM words GROUP BY word) d ON w.word = d.word
        WHERE d.n_documents >= 10
          AND d.n_documents <= 0.9 * (SELECT count(*) FROM user_taglist)""",
    "weighted_words": """
        SELECT *, n * (ln((1.0::DOUBLE + (SELECT count(*) FROM user_taglist)) / (1 + n_documents)) + 1) AS w
        FROM bag""",
    "indicators": """
        SELECT p.user_id, category, value
        FROM (UNPIVOT (SELECT user_id, cell_province, id_province, id_city FROM profiles)
              ON cell_province, id_province, id_city INTO NAME category VALUE value) p""",
    "place_codes": """
        SELECT user_id, cell_province, id_province, id_city,
               CAST(dense_rank() OVER (ORDER BY cell_first) - 1 AS INTEGER) AS cell_province_code,
               CAST(dense_rank() OVER (ORDER BY id_first) - 1 AS INTEGER) AS id_province_code,
               CAST(dense_rank() OVER (ORDER BY city_first) - 1 AS INTEGER) AS id_city_code
        FROM (SELECT *, min(user_id) OVER (PARTITION BY cell_province) AS cell_first,
                     min(user_id) OVER (PARTITION BY id_province) AS id_first,
                     min(user_id) OVER (PARTITION BY id_city) AS city_first FROM profiles)""",
    "integration_label": """
        SELECT listing_id, CAST(CASE WHEN repay_amt = 0 THEN 32
               ELSE date_diff('day', repay_date_0, due_date) END AS INTEGER) AS label FROM labelled""",
    "sparse_names": """
        SELECT 0 AS block, 'number' AS kind, 'mean_principal' AS name
        UNION ALL SELECT 1, 'number', 'std_principal'
        UNION ALL SELECT DISTINCT 2, category, value FROM indicators
        UNION ALL SELECT DISTINCT 3, 'word', word FROM bag""",
    "sparse_columns": """
        SELECT kind, name, row_number() OVER (ORDER BY block, kind, name) - 1 AS position FROM sparse_names""",
    "sparse_cells": """
        SELECT user_id, CAST(0 AS BIGINT) AS position, mean_principal AS value FROM loan_stats
        UNION ALL SELECT user_id, CAST(1 AS BIGINT), std_principal FROM loan_stats
        UNION ALL
        SELECT i.user_id, c.position, 1.0
        FROM indicators i JOIN sparse_columns c ON c.kind = i.category AND c.name = i.value
        JOIN loan_stats s ON s.user_id = i.user_id
        UNION ALL
        SELECT b.user_id, c.position, CAST(b.n AS DOUBLE)
        FROM bag b JOIN sparse_columns c ON c.kind = 'word' AND c.name = b.word
        JOIN loan_stats s ON s.user_id = b.user_id""",
    "folded": """
        SELECT *, CAST((row_number() OVER (PARTITION BY label
                          ORDER BY md5('2019:' || listing_id), listing_id) - 1) % 5 AS INTEGER) AS fold
        FROM labelled""",
    "scored": """
        SELECT listing_id, fold, label, due_amt, repay_amt, w, total,
               w[label + 1] / total AS label_probability,
               list_position(w, list_max(w)) - 1 AS predicted
        FROM (SELECT *, list_sum(w) AS total
              FROM (SELECT *, list_transform(range(0, 33),
                                lambda i: CAST(1 + (listing_id * (i + 3)) % 17 AS DOUBLE)) AS w
                    FROM folded))""",
    "score_errors": """
        SELECT fold, due_amt * label_probability - repay_amt AS error,
               -ln(label_probability) AS loss, CASE WHEN predicted = label THEN 1.0 ELSE 0.0 END AS hit
        FROM scored""",
    "test_probabilities": """
        SELECT *, list_sum(w) AS total
        FROM (SELECT *, list_transform(range(0, 33),
                          lambda i: CAST(1 + (listing_id * (i + 3)) % 17 AS DOUBLE)) AS w FROM test)""",
    "test_due": """
        SELECT listing_id, auditing_date,
               auditing_date + CAST(CASE month(auditing_date) WHEN 2 THEN 28 WHEN 3 THEN 31 WHEN 4 THEN 30
                                    ELSE 0 END AS INTEGER) AS due_date
        FROM test""",
    "calendar_grid": """
        SELECT listing_id, due_date, CAST(unnest(generate_series(CAST(auditing_date AS TIMESTAMP),
               CAST(due_date AS TIMESTAMP), INTERVAL 1 DAY)) AS DATE) AS repay_date,
               month(auditing_date) AS audit_month
        FROM test_due""",
}

_PROBABILITIES = ", ".join(f"round(w[{i + 1}] / total, 6) AS prob_{i}" for i in range(33))
_PROVINCES = [f"p{i}" for i in range(5)]
_CITIES = ["c0", *[f"c{r}" for r in sorted({1 + k * k % 37 for k in range(37)})]]


def _parts(column: str, alias: str | None = None, year: bool = False, day: bool = False) -> str:
    name = alias or column
    out = []
    if year:
        out.append(f"CAST(year({column}) AS INTEGER) AS {name}_year")
    out.append(f"CAST(month({column}) AS INTEGER) AS {name}_month")
    if day:
        out.append(f"CAST(day({column}) AS INTEGER) AS {name}_day")
        out.append(f"CAST(isodow({column}) - 1 AS INTEGER) AS {name}_dayofweek")
    return ", ".join(out)


def _sql(body: str) -> str:
    """Prefix a query with the views it needs, found by name."""
    needed: set[str] = set()
    frontier = [body]
    while frontier:
        words = set(re.findall(r"\w+", frontier.pop()))
        for name in words & VIEWS.keys() - needed:
            needed.add(name)
            frontier.append(VIEWS[name])
    ctes = ",\n".join(f"{name} AS ({VIEWS[name]})" for name in VIEWS if name in needed)
    own = body.strip()
    if own.startswith("WITH "):
        return f"WITH {ctes},\n{own.removeprefix('WITH ')}"
    return f"WITH {ctes}\n{own}"


def _round(source: str, *columns: str, exclude: str = "") -> str:
    """All columns of a view, the named doubles rounded."""
    dropped = f" EXCLUDE ({exclude})" if exclude else ""
    replaced = ", ".join(f'round("{c}", 6) AS "{c}"' for c in columns)
    return f"SELECT *{dropped} REPLACE ({replaced}) FROM {source}"


def _stat(*prefixes: str) -> list[str]:
    return [f"{p}_{s}" for p in prefixes for s in ("mean", "std")]


def _distribution_doubles(suffix: str) -> list[str]:
    days = [f"early_repay_days_{s}{suffix}" for s in ("median", "mean", "std")]
    amounts = ("max", "min", "median", "mean", "sum", "std", "skew", "kurt", "ptp")
    return [f"repay_mean{suffix}", *days, *[f"due_amt_{s}{suffix}" for s in amounts]]


_HOUR_BUCKET = "CAST(floor(round((a - a % 0.01::DOUBLE) / 0.01::DOUBLE) / 100) AS INTEGER)"
_DESCRIBED = ["mean", "std", "min", "max", "p25", "p50", "p75"]
# Column of the rated log: its source here and its type there.
_LOG_COLUMNS = {
    "user_id": ("user_id", "bigint"),
    "listing_id": ("listing_id", "bigint"),
    "order_id": ("order_id", "int"),
    "due_date": ("due_date", "date"),
    "due_amt": ("due_amt", "double"),
    "repay_date": ("repay_date", "date"),
    "repay_amt": ("repay_amt", "double"),
    "repay": ("repay", "int"),
    "due_month": ("due_month", "int"),
    "due_day": ("due_day", "int"),
    "due_weekday": ("due_weekday", "int"),
    "repay_weekday": ("repay_weekday", "int"),
    "rate": ("rate", "decimal(12,4)"),
    "early_repay_days": ("early", "int"),
    "early_month": ("due_day", "int"),
    "median_month": ("due_day", "int"),
    "last_month": ("due_day", "int"),
}
_HISTORY_DOUBLES = _stat("u_early_repay_days", "u_repay_due_weekday", "u_repay_weekday", "u_repay")
_GRAIN_DOUBLES = {p: _stat(f"{p}_repay", f"{p}_early_repay_days") for p in ("u_dm", "u_dw", "u_r", "u_ra")}


def _r(alias: str, columns: list[str]) -> str:
    return ", ".join(f"round({alias}.{c}, 6) AS {c}" for c in columns)


_FEATURES = f"""
SELECT f.user_id, f.listing_id, f.is_train, f.label, round(f.repay_amt, 6) AS repay_amt,
       round(f.due_amt, 6) AS due_amt, f.due_month, f.due_weekday, f.repay_weekday,
       i.term, round(i.rate, 6) AS rate, i.principal, i.auditing_date_days,
       round(i.principal_per_term, 6) AS principal_per_term, i.principal_class,
       round(i."TermRate", 6) AS "TermRate",
       {_r("n", ["mean_principal", "std_principal"])}, n.loan_times_type,
       p.gender, p.remote_boolean, p.class, p.reg_mon_y, p.reg_mon_m,
       t.freq, t.most_freq, t.median_freq, t.lower_freq,
       round(coalesce(t.tier_early_mean, 0), 6) AS tier_early_mean,
       round(coalesce(t.tier_early_var, 0), 6) AS tier_early_var,
       u.u_early_repay_days_max, u.u_early_repay_days_mode, u.u_early_repay_days_min,
       u.u_repay_due_weekday_mode, {_r("u", _HISTORY_DOUBLES)},
       {_r("d", _distribution_doubles("_all_order"))},
       d.early_repay_days_max_all_order, d.early_repay_days_sum_all_order,
       {_r("gm", _GRAIN_DOUBLES["u_dm"])}, {_r("gw", _GRAIN_DOUBLES["u_dw"])},
       {_r("gr", _GRAIN_DOUBLES["u_r"])},
       round(f.due_amt / nullif(date_diff('day', f.auditing_date, f.due_date), 0), 6) AS due_amt_per_days,
       CASE WHEN t.freq IS NULL THEN 1 ELSE 0 END AS new_user,
       {_parts("f.auditing_date", "auditing_date", day=True)}, {_parts("f.due_date", "due_date", day=True)},
       {_parts("p.info_insert_date", "info_insert_date", year=True, day=True)},
       {_parts("g.tag_insert_date", "tag_insert_date", year=True, day=True)}
FROM fact f
LEFT JOIN listing i ON f.user_id = i.user_id AND f.listing_id = i.listing_id AND f.auditing_date = i.auditing_date
LEFT JOIN loan_stats n ON f.user_id = n.user_id
LEFT JOIN profile_features p ON f.user_id = p.user_id
LEFT JOIN user_taglist g ON f.user_id = g.user_id
LEFT JOIN tier_features t ON f.user_id = t.user_id
LEFT JOIN user_log_stats u ON f.user_id = u.user_id
LEFT JOIN distribution_all d ON f.user_id = d.user_id
LEFT JOIN month_stats gm ON f.user_id = gm.user_id AND f.due_month = gm.due_month
LEFT JOIN weekday_stats gw ON f.user_id = gw.user_id AND f.due_weekday = gw.due_weekday
LEFT JOIN rate_stats gr ON f.user_id = gr.user_id AND i.rate = gr.rate"""

_SORTED_FORECAST = """
SELECT g.listing_id, g.repay_date,
       round(p.due_amt * p.w[date_diff('day', g.repay_date, g.due_date) + 1] / p.total, 6) AS repay_amt,
       row_number() OVER (ORDER BY g.listing_id, g.repay_date) - 1 AS position
FROM calendar_grid g JOIN test_probabilities p ON g.listing_id = p.listing_id"""

_BODIES: dict[str, str] = {
    "label_days_early": "SELECT listing_id, repay_date, round(repay_amt, 6) AS repay_amt, label FROM labelled",
    "label_variants": """
        SELECT listing_id, label AS label_canonical,
               CAST(CASE WHEN repay_amt = 0 THEN 32
                         ELSE date_diff('day', repay_date_0, due_date) END AS INTEGER) AS label_integration,
               CAST(CASE WHEN auditing_date = repay_date THEN 31
                         ELSE date_diff('day', repay_date, due_date) END AS INTEGER) AS label_feature_only,
               CAST(CASE WHEN auditing_date = repay_date THEN 32
                         ELSE date_diff('day', repay_date, due_date) END AS INTEGER) AS label_exploration
        FROM labelled""",
    "label_distribution": "SELECT label, count(*) AS n FROM labelled GROUP BY label",
    "label_count_histogram": """
        WITH counts AS (SELECT label, count(*) AS n FROM labelled GROUP BY label),
        bounds AS (SELECT CAST(min(n) AS DOUBLE) AS low, CAST(max(n) AS DOUBLE) AS high FROM counts),
        placed AS (SELECT LEAST(31, CAST(floor((n - low) / nullif(high - low, 0) * 32) AS INTEGER)) AS bin
                   FROM counts, bounds)
        SELECT CAST(b.i AS INTEGER) AS bin, count(p.bin) AS n
        FROM range(0, 32) b(i) LEFT JOIN placed p ON p.bin = b.i GROUP BY b.i""",
    "train_test_union": _round("fact", "due_amt", "repay_amt"),
    "train_test_split_counts": "SELECT is_train, count(*) AS n FROM fact GROUP BY is_train",
    "calendar_parts": f"""
        SELECT listing_id, due_weekday, repay_weekday, {_parts("auditing_date", day=True)},
               {_parts("due_date", day=True)} FROM fact""",
    "user_date_parts": f"""
        SELECT user_id, {_parts("reg_mon", year=True)}, {_parts("insertdate", year=True, day=True)} FROM newest""",
    "month_third_flags": """
        SELECT user_id, listing_id, due_month, due_day, due_weekday, repay_weekday,
               CASE WHEN due_day < 10 THEN 1 ELSE 0 END AS early_month,
               CASE WHEN due_day >= 10 AND due_day < 20 THEN 1 ELSE 0 END AS median_month,
               CASE WHEN due_day >= 20 THEN 1 ELSE 0 END AS last_month
        FROM log1""",
    "fixed_month_days": "SELECT listing_id, auditing_date_days FROM listing",
    "amount_per_loan_day": """
        SELECT listing_id, is_train,
               round(due_amt / nullif(date_diff('day', auditing_date, due_date), 0), 6) AS due_amt_per_days
        FROM fact""",
    "listing_ratios": """
        SELECT listing_id, round(principal_per_term, 6) AS principal_per_term,
               round("TermRate", 6) AS "TermRate" FROM listing""",
    "principal_class": """
        SELECT principal, principal_class, count(*) AS n FROM listing GROUP BY principal, principal_class""",
    "loan_times_class": "SELECT user_id, loan_times, loan_times_type FROM loan_stats",
    "listing_features": """
        SELECT f.listing_id, f.is_train, term, round(rate, 6) AS rate, principal, auditing_date_month,
               auditing_date_days, round(principal_per_term, 6) AS principal_per_term, principal_class,
               round("TermRate", 6) AS "TermRate"
        FROM fact f LEFT JOIN listing i ON f.user_id = i.user_id AND f.listing_id = i.listing_id
             AND f.auditing_date = i.auditing_date""",
    "user_principal_stats": """
        SELECT user_id, round(mean_principal, 6) AS mean_principal, round(std_principal, 6) AS std_principal
        FROM loan_stats""",
    "user_latest": "SELECT * FROM newest",
    "city_class": "SELECT * FROM cities",
    "user_profile_features": "SELECT * FROM profile_features",
    "user_repay_stats": f"""
        SELECT user_id, u_early_repay_days_max, u_early_repay_days_mode, u_early_repay_days_min,
               {_r("s", _stat("u_early_repay_days"))} FROM user_log_stats s""",
    "user_due_weekday_stats": f"""
        SELECT user_id, u_repay_due_weekday_mode, {_r("s", _stat("u_repay_due_weekday"))}
        FROM user_log_stats s""",
    "user_repay_weekday_stats": f"SELECT user_id, {_r('s', _stat('u_repay_weekday'))} FROM user_log_stats s",
    "user_repay_rate": f"SELECT user_id, {_r('s', _stat('u_repay'))} FROM user_log_stats s",
    "user_month_stats": _round("month_stats", *_GRAIN_DOUBLES["u_dm"]),
    "user_weekday_stats": _round("weekday_stats", *_GRAIN_DOUBLES["u_dw"]),
    "user_rate_stats": _round("rate_stats", *_GRAIN_DOUBLES["u_r"]),
    "user_amount_stats": _round("amount_stats", *_GRAIN_DOUBLES["u_ra"]),
    "first_order_distribution": _round("distribution_first", *_distribution_doubles("")),
    "all_order_distribution": _round("distribution_all", *_distribution_doubles("_all_order")),
    "repay_log_after_date": "SELECT * FROM repay_log WHERE due_date > DATE '1999-03-01'",
    "repay_log_late_repaid": """
        SELECT * FROM repay_log
        WHERE repay_date >= DATE '2001-04-01' AND repay_date <> DATE '2200-01-01'""",
    "repay_log_never_repaid": "SELECT * FROM repay_log WHERE repay_date = DATE '2200-01-01'",
    "repay_log_order_counts": """
        SELECT order_id, count(*) AS n FROM repay_log WHERE repay_date > DATE '1999-03-01' GROUP BY order_id""",
    "date_ranges": """
        SELECT 'train_auditing' AS source, min(auditing_date) AS first_date, max(auditing_date) AS last_date FROM train
        UNION ALL SELECT 'test_auditing', min(auditing_date), max(auditing_date) FROM test
        UNION ALL SELECT 'listing_auditing', min(auditing_date), max(auditing_date) FROM listing_info
        UNION ALL SELECT 'log_due', min(due_date), max(due_date) FROM repay_log""",
    "weekday_counts": """
        SELECT 'due_weekday' AS date, due_weekday AS weekday, count(*) AS n FROM fact WHERE is_train GROUP BY ALL
        UNION ALL
        SELECT 'repay_weekday', repay_weekday, count(*) FROM fact WHERE is_train GROUP BY ALL""",
    "listing_slice": """
        SELECT *, row_number() OVER (ORDER BY listing_id) - 1 AS position FROM listing_info
        QUALIFY position >= 1 AND position < 100000""",
    "repay_log_slice": """
        SELECT *, row_number() OVER (ORDER BY listing_id, order_id, r.due_date, due_amt, r.repay_date,
                                     repay_amt NULLS FIRST) - 1 AS position FROM repay_log r
        QUALIFY position >= 1 AND position < 100000""",
    "user_lookup": """
        WITH wanted AS (SELECT min(user_id) AS u FROM test)
        SELECT 'listing' AS source, user_id, listing_id FROM listing_info, wanted WHERE user_id = u
        UNION ALL SELECT 'log', user_id, listing_id FROM repay_log, wanted WHERE user_id = u
        UNION ALL SELECT 'test', user_id, listing_id FROM test, wanted WHERE user_id = u""",
    "users_in_listing": """
        SELECT DISTINCT user_id, CASE WHEN user_id IN (SELECT user_id FROM listing_info) THEN 1 ELSE 0 END AS in_listing
        FROM user_info""",
    "log_non_null_shares": """
        SELECT *, round(non_null / sum(non_null) OVER (PARTITION BY "column"), 6) AS share
        FROM (UNPIVOT (SELECT order_id, count(*) AS rows, count(user_id) AS user_id, count(listing_id) AS listing_id,
                              count(due_date) AS due_date, count(due_amt) AS due_amt, count(repay_date) AS repay_date,
                              count(repay_amt) AS repay_amt FROM repay_log GROUP BY order_id)
              ON user_id, listing_id, due_date, due_amt, repay_date, repay_amt INTO NAME "column" VALUE non_null)""",
    "label_ranking": """
        SELECT label, count(*) AS n, row_number() OVER (ORDER BY count(*) DESC, label) - 1 AS position
        FROM labelled WHERE label IS NOT NULL GROUP BY label""",
    "column_profile": " UNION ALL ".join(
        f"SELECT count(*) AS rows, '{name}' AS column_name, '{kind}' AS column_type, count({source}) AS non_null "
        "FROM log1_rate"
        for name, (source, kind) in _LOG_COLUMNS.items()
    ),
    "csv_round_trip": " UNION ALL ".join(
        f"SELECT '{name}' AS name, count(*) AS written, count(*) AS read, CAST(0 AS BIGINT) AS rejected, "
        f"CAST(0 AS BIGINT) AS different FROM {view}"
        for name, view in {
            "train": "train", "test": "test", "listing_info": "listing_info", "user_info": "user_info",
            "user_repay_logs": "repay_log",
        }.items()
    ),
    "sorted_forecast": _SORTED_FORECAST,
    "forecast_preview": f"SELECT * FROM ({_SORTED_FORECAST}) WHERE position < 20",
    "frequency_tiers_quantile": "SELECT user_id, freq, most_freq, median_freq, lower_freq FROM tiers_quantile",
    "frequency_tiers_fixed": "SELECT user_id, freq, most_freq, median_freq, lower_freq FROM tiers_fixed",
    "tier_stats": _round("tier_stats", "tier_early_mean", "tier_early_var"),
    "tier_amount_stats": _round("tier_amounts", "freq_early_repay_days_mean", "freq_early_repay_days_std"),
    "tier_amount_stats_fixed": _round(
        "tier_amounts_fixed", "freq_early_repay_days_mean", "freq_early_repay_days_std"
    ),
    "tier_feature_on_fact": """
        SELECT f.listing_id, t.freq, t.most_freq, t.median_freq, t.lower_freq,
               round(coalesce(t.tier_early_mean, 0), 6) AS tier_early_mean,
               round(coalesce(t.tier_early_var, 0), 6) AS tier_early_var
        FROM fact f LEFT JOIN tier_features t ON f.user_id = t.user_id""",
    "new_user_flag": """
        SELECT listing_id, is_train,
               CASE WHEN user_id IN (SELECT user_id FROM log1) THEN 0 ELSE 1 END AS new_user FROM fact""",
    "behaviour_weekday_share": f"SELECT * REPLACE (round(share, 6) AS share) FROM ({_dense_share('weekday', 0, 6)})",
    "behaviour_month_share": f"SELECT * REPLACE (round(share, 6) AS share) FROM ({_dense_share('month', 1, 12)})",
    "behaviour_year_describe": _round(
        f"({_describe('year', ['user_id', 'behavior_type', 'weekday', 'month'])})", *_DESCRIBED
    ),
    "behaviour_type_describe": _round(
        f"({_describe('behavior_type', ['weekday', 'month', 'year', 'hour'])})", *_DESCRIBED
    ),
    "behaviour_hour_histogram": """
        SELECT CAST(h.i AS INTEGER) AS hour, count(b.hour) AS n
        FROM range(0, 24) h(i) LEFT JOIN behaviour b ON b.hour = h.i GROUP BY h.i""",
    "user_mean_hours": "SELECT user_id, round(avg(hour), 6) AS hour_mean FROM behaviour GROUP BY user_id",
    "user_mean_hour_histogram": """
        WITH means AS (SELECT user_id, avg(hour) + .00501::DOUBLE AS a FROM behaviour GROUP BY user_id),
        buckets AS (SELECT """
    + _HOUR_BUCKET
    + """ AS hour FROM means)
        SELECT CAST(h.i AS INTEGER) AS hour, count(b.hour) AS n
        FROM range(0, 24) h(i) LEFT JOIN buckets b ON b.hour = h.i GROUP BY h.i""",
    "user_mean_hour_describe": _round(
        "({})".format(
            _describe(
                "source",
                ["hour_mean", "hour_bucket"],
                f"""(SELECT 'all' AS source, hour_mean, {_HOUR_BUCKET} AS hour_bucket
                     FROM (SELECT avg(hour) AS hour_mean, avg(hour) + .00501::DOUBLE AS a
                           FROM behaviour GROUP BY user_id))""",
            )
        ),
        *_DESCRIBED,
        exclude="source",
    ),
    "behaviour_describe": _round(
        "({})".format(
            _describe(
                "source",
                ["user_id", "behavior_type", "weekday", "month", "year", "hour"],
                "(SELECT 'all' AS source, * FROM behaviour)",
            )
        ),
        *_DESCRIBED,
        exclude="source",
    ),
    "behaviour_users_per_row": """
        SELECT count(DISTINCT user_id) AS users, count(*) AS rows,
               round(count(DISTINCT user_id) / CAST(count(*) AS DOUBLE), 6) AS users_per_row FROM behaviour""",
    "log_slice": """
        SELECT user_id, strftime(behavior_time, '%Y-%m-%d %H:%M:%S.%f') AS behavior_time, behavior_type,
               row_number() OVER (ORDER BY b.behavior_time, user_id, behavior_type) - 1 AS position
        FROM behaviour b QUALIFY position >= 100 AND position < 40100""",
    "tag_frequency": "SELECT * FROM tag_counts",
    "tag_top150": "SELECT * FROM tag_counts ORDER BY n DESC, tag LIMIT 150",
    "important_tags": "SELECT * FROM tag_counts WHERE share > 0.3 AND share < 0.8",
    "distinct_tags": "SELECT count(DISTINCT tag) AS n_tags, count(*) AS n_occurrences FROM user_tags",
    "tag_tokens": """
        SELECT user_id, CAST(len(string_split(taglist, '|')) AS INTEGER) AS n_tokens, replace(taglist, '|', ' ') AS text
        FROM user_taglist""",
    "tag_bag_of_words": "SELECT * FROM bag",
    "tag_tfidf": """
        SELECT user_id, word, round(w / sqrt(sum(w * w) OVER (PARTITION BY user_id)), 6) AS tfidf
        FROM weighted_words""",
    "tag_feature_vectors": """
        SELECT user_id, CAST(0 AS BIGINT) AS position, round(mean_principal, 6) AS value FROM loan_stats
        UNION ALL
        SELECT user_id, CAST(1 AS BIGINT), round(std_principal, 6) FROM loan_stats
        UNION ALL
        SELECT b.user_id, 2 + p.place, CAST(b.n AS DOUBLE)
        FROM bag b
        JOIN (SELECT word, row_number() OVER (ORDER BY md5(word), word) - 1 AS place
              FROM (SELECT DISTINCT word FROM bag)) p ON p.word = b.word
        JOIN loan_stats s ON s.user_id = b.user_id""",
    "sparse_matrix": "SELECT user_id, position, round(value, 6) AS value FROM sparse_cells",
    "sparse_matrix_columns": "SELECT * FROM sparse_columns",
    "sparse_matrix_audit": """
        SELECT count(DISTINCT user_id) AS n, count(DISTINCT user_id) AS ids,
               CAST((SELECT count(*) FROM sparse_columns) AS INTEGER) AS least_size,
               CAST((SELECT count(*) FROM sparse_columns) AS INTEGER) AS greatest_size,
               count(*) AS entries, CAST(0 AS BIGINT) AS faults FROM sparse_cells""",
    "category_codes": "SELECT * FROM place_codes",
    "category_one_hot": """
        SELECT user_id, category, value, CAST(1 AS INTEGER) AS indicator
        FROM (UNPIVOT (SELECT user_id, cell_province, id_province, id_city FROM profiles)
              ON cell_province, id_province, id_city INTO NAME category VALUE value)""",
    "stratified_folds": "SELECT listing_id, label, fold FROM folded",
    "fold_label_balance": "SELECT label, fold, count(*) AS n FROM folded GROUP BY label, fold",
    "feature_table": _FEATURES,
    "integration_table": f"""
        SELECT f.user_id, f.listing_id, f.is_train, l.label, round(f.due_amt, 6) AS due_amt, i.term,
               round(i.rate, 6) AS rate, i.principal, p.gender,
               c.cell_province_code, c.id_province_code, c.id_city_code,
               round(f.due_amt / nullif(date_diff('day', f.auditing_date, f.due_date), 0), 6) AS due_amt_per_days,
               {_r("d", _distribution_doubles(""))}, d.early_repay_days_max, d.early_repay_days_sum,
               {_r("a", _distribution_doubles("_all_order"))},
               a.early_repay_days_max_all_order, a.early_repay_days_sum_all_order,
               {_parts("f.auditing_date", "auditing_date", day=True)}, {_parts("f.due_date", "due_date", day=True)},
               {_parts("p.reg_mon", "reg_mon", year=True)},
               {_parts("p.info_insert_date", "info_insert_date", year=True, day=True)},
               {_parts("g.tag_insert_date", "tag_insert_date", year=True, day=True)}
        FROM fact f
        LEFT JOIN integration_label l ON f.listing_id = l.listing_id
        LEFT JOIN listing_info i ON f.user_id = i.user_id AND f.listing_id = i.listing_id
        LEFT JOIN profiles p ON f.user_id = p.user_id
        LEFT JOIN place_codes c ON f.user_id = c.user_id
        LEFT JOIN user_taglist g ON f.user_id = g.user_id
        LEFT JOIN distribution_first d ON f.user_id = d.user_id
        LEFT JOIN distribution_all a ON f.user_id = a.user_id""",
    "integration_indicators": """
        SELECT f.listing_id, category, CAST(code AS VARCHAR) AS value, CAST(1 AS INTEGER) AS indicator
        FROM fact f JOIN (UNPIVOT (SELECT user_id, cell_province_code AS cell_province, id_province_code AS id_province,
                                          id_city_code AS id_city FROM place_codes)
                          ON cell_province, id_province, id_city INTO NAME category VALUE code) p ON p.user_id = f.user_id""",
    "model_audit": """
        SELECT fold, count(*) AS n, count(DISTINCT listing_id) AS listings, CAST(33 AS INTEGER) AS fewest,
               CAST(33 AS INTEGER) AS most, CAST(0 AS BIGINT) AS wrong_sums FROM folded GROUP BY fold""",
    "prediction_metrics": """
        SELECT CASE WHEN grouping(fold) = 1 THEN -1 ELSE fold END AS fold, count(*) AS n,
               round(sqrt(avg(error * error)), 6) AS rmse, round(avg(abs(error)), 6) AS mae,
               round(avg(loss), 6) AS logloss, round(avg(hit), 6) AS accuracy
        FROM score_errors GROUP BY ROLLUP (fold)""",
    "expected_amounts": """
        SELECT listing_id, label, round(label_probability, 6) AS label_probability,
               round(due_amt * label_probability, 6) AS expected_amt FROM scored""",
    "probability_table": f"SELECT listing_id, {_PROBABILITIES} FROM test_probabilities",
    "test_due_date": "SELECT * FROM test_due",
    "submission_calendar": "SELECT listing_id, repay_date FROM calendar_grid",
    "daily_forecast": """
        SELECT g.listing_id, g.repay_date,
               round(p.due_amt * p.w[date_diff('day', g.repay_date, g.due_date) + 1] / p.total, 6) AS repay_amt
        FROM calendar_grid g JOIN test_probabilities p ON g.listing_id = p.listing_id""",
}

# Dates and times are shown as text and integers with missing values as doubles, as in the catalog.
_DOUBLE_COLUMNS = {
    "train_test_union": ["label", "repay_weekday"],
    "calendar_parts": ["repay_weekday"],
    "tier_feature_on_fact": ["freq", "most_freq", "median_freq", "lower_freq"],
    "integration_table": ["label"],
    "feature_table": [
        "label",
        "repay_weekday",
        "freq",
        "most_freq",
        "median_freq",
        "lower_freq",
        "u_early_repay_days_max",
        "u_early_repay_days_mode",
        "u_early_repay_days_min",
        "u_repay_due_weekday_mode",
    ],
}
_TEXT_COLUMNS = {
    "label_days_early": ["repay_date"],
    "train_test_union": ["auditing_date", "due_date", "repay_date"],
    "user_latest": ["reg_mon", "insertdate"],
    "user_profile_features": ["reg_mon", "info_insert_date"],
    "repay_log_after_date": ["due_date", "repay_date"],
    "repay_log_late_repaid": ["due_date", "repay_date"],
    "repay_log_never_repaid": ["due_date", "repay_date"],
    "date_ranges": ["first_date", "last_date"],
    "listing_slice": ["auditing_date"],
    "repay_log_slice": ["due_date", "repay_date"],
    "test_due_date": ["auditing_date", "due_date"],
    "submission_calendar": ["repay_date"],
    "daily_forecast": ["repay_date"],
    "sorted_forecast": ["repay_date"],
    "forecast_preview": ["repay_date"],
}
for _type, _listed in (("VARCHAR", _TEXT_COLUMNS), ("DOUBLE", _DOUBLE_COLUMNS)):
    for _name, _columns in _listed.items():
        _shown = ", ".join(f"CAST({c} AS {_type}) AS {c}" for c in _columns)
        _BODIES[_name] = f"SELECT * REPLACE ({_shown}) FROM ({_BODIES[_name]})"

ORACLE: dict[str, str] = {name: _sql(body) for name, body in _BODIES.items()}
