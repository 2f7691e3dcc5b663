from importlib import import_module

_MODULES = ("grids", "timelines", "contexts", "prices", "evaluation", "models", "feeds", "news", "streams")


def load_all() -> None:
    """Import every module that registers queries."""
    for name in _MODULES:
        import_module(f"matchlab.catalog.{name}")
