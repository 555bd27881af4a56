"""Content-monitoring pipelines as Spark DataFrame operators."""

from importlib import import_module

#: What the package offers by name, and where it is; imported when asked for, so that tasks load only what they use.
_OFFERED = {
    "run": "plans.pipeline", "crawl": "plans.pipeline", "crawl_boards": "plans.pipeline", "analyse": "plans.pipeline", "publish": "plans.pipeline", "Analyst": "plans.pipeline", "Writer": "plans.pipeline",
    "Store": "sources.store", "TaskRunning": "sources.store", "Fetcher": "sources.pages", "http_get": "sources.pages", "TargetNotFound": "sources.catalog",
}
__all__ = list(_OFFERED)


def __getattr__(name: str) -> object:
    if name not in _OFFERED:
        raise AttributeError(name)
    return getattr(import_module(f"millrace.{_OFFERED[name]}"), name)
