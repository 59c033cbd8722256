"""All named queries."""

from importlib import import_module

from hawkframe.catalog.registry import QUERIES, SQL

MODULES = ["event_queries", "feature_queries", "alert_queries", "report_queries", "model_queries"]


def _load() -> None:
    for name in MODULES:
        import_module(f"hawkframe.catalog.{name}")


def all_queries() -> dict:
    _load()
    return dict(QUERIES)


def all_sql() -> dict:
    _load()
    return dict(SQL)
