"""Named queries over the test tables, each with its SQL twin where SQL can say it."""

from importlib import import_module

MODULES = ("dashboards", "windows", "scalars", "joins", "risk", "audit", "models", "pipelines", "streams")


def load() -> None:
    """Import every catalogue module once so that its queries register."""
    for name in MODULES:
        import_module(f"{__name__}.{name}")
