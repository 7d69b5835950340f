"""SQL that recomputes every registered query, written apart from the library."""

from eraframe.plans.partials import REPORTS
from oracle.jobs import job_sql
from oracle.reports import report_sql


def all_sql() -> dict[str, str]:
    sql = {**report_sql(), **job_sql()}
    sql["stored_star_trends"] = sql["industry_baseline_trends_crisis"]
    sql["bucketed_genre_baselines"] = sql["genre_baselines"]
    sql["partials_stored_runtime"] = sql["runtime_paradox"]
    sql["film_csv_scan_split"] = sql["film_csv_scan"]
    sql["clean_funnel_written"] = sql["clean_funnel"]
    for name in REPORTS:
        for suffix in ("", "_crisis"):
            if name + suffix in sql:
                sql[f"partials_{name}{suffix}"] = sql[name + suffix]
    return sql
