"""Registered queries over the driver's tables."""

from importlib import import_module

MODULES = ("log_queries", "contest_queries", "history_queries", "eval_queries", "odds_queries", "schedule_queries", "model_queries", "stream_queries", "storage_queries")


def load_all() -> None:
    """Import every query module so that its queries are registered."""
    for name in MODULES:
        import_module(f"{__name__}.{name}")
