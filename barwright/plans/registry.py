"""Named queries of the engine and the SQL DuckDB runs beside them."""

from importlib import import_module

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None):
    """Register a function (spark, sf_dir) -> DataFrame under its name, with its SQL."""

    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


for _name in ("bars", "joins", "book", "stats", "tape", "streams", "mechanism", "scalar", "engine", "parsing", "snapshot", "session", "evaluation", "fusion", "relations", "ledger", "fits", "digests", "paths", "resampled", "identity"):
    import_module(f"barwright.plans.{_name}_queries")
