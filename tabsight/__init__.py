"""tabsight: classification data preparation, modelling and monitoring on Spark.

The main entry points, re-exported for convenience::

    from tabsight import rank_target_candidates, summarize_quality, train_tabular, predict_batch

They are loaded on first use: a Python worker that unpickles a function of one
module does not import the others.
"""

from importlib import import_module

_EXPORTS = {
    "tabsight.errors": ["InputError"],
    "tabsight.operators.evaluate": ["confusion_matrix", "core_metrics", "optimize_threshold", "roc_curve"],
    "tabsight.operators.prep": ["fit_preprocess"],
    "tabsight.operators.profile": ["profile_columns", "rank_target_candidates", "resolve_target"],
    "tabsight.operators.quality": ["quality_warnings", "summarize_quality"],
    "tabsight.operators.split": ["assign_folds", "sample_n", "stratified_holdout"],
    "tabsight.plans.train": ["FittedRun", "FittedTextRun", "predict_batch", "predict_text", "train_tabular", "train_text"],
    "tabsight.session": ["get_spark"],
    "tabsight.sources.tabular": ["detect_dataset_type", "read_tabular"],
}
_HOME = {name: module for module, names in _EXPORTS.items() for name in names}

__all__ = sorted(_HOME)


def __getattr__(name: str):
    if name not in _HOME:
        raise AttributeError(f"module 'tabsight' has no attribute '{name}'")
    return getattr(import_module(_HOME[name]), name)
