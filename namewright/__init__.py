"""Content-addressed entity matching over call graphs, expressed as Spark plans.

Programs are DataFrames of functions, blocks, call edges and data references.
Fingerprints and graph-neighbour constraints are built-in SQL expressions and
joins; the name database is a grouped aggregate; naming is a fixpoint of joins.
"""

__version__ = "0.1.0"

import sys

from pyspark import cloudpickle

# Executors then need no copy of this package: what they run is sent to them.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

#: What users need most, by the module that holds it; loaded when first asked for.
_NAMES = {
    "Analyzer": "plans.pipeline", "AnalysisOptions": "plans.pipeline", "AnalysisResult": "plans.pipeline", "DatabaseBuilder": "plans.pipeline", "Build": "plans.pipeline",
    "Progress": "plans.progress", "Silent": "plans.progress", "Text": "plans.progress", "Bar": "plans.progress",
    "FoldSource": "sources.fold", "match": "operators.matching", "key_quantiles": "operators.skew",
}
__all__ = list(_NAMES)


def __getattr__(name: str):
    if name not in _NAMES:
        raise AttributeError(f"module {__name__!r} has no attribute {name!r}")
    from importlib import import_module

    return getattr(import_module(f"{__name__}.{_NAMES[name]}"), name)
