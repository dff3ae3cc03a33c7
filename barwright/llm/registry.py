"""All queries of this subpackage and the SQL that DuckDB runs for those SQL can express."""

from importlib import import_module

MODULES = [
    "q01_warc", "q02_secrets", "q03_simhash", "q04_mixing", "q05_urllists", "q06_idstore", "q07_quality", "q08_langid", "q09_ann", "q10_packing", "q11_resampling", "q12_audit", "q13_lmscore",
]

QUERIES: dict = {}
ORACLES: dict = {}
for _name in MODULES:
    _module = import_module(f"{__package__}.{_name}")
    QUERIES.update(_module.QUERIES)
    ORACLES.update(_module.ORACLES)
