"""Named queries over the given tables."""

from importlib import import_module

MODULES = ("scalars", "catalogs", "selections", "matches", "associations", "populations", "series", "detectors", "scoring", "vetting", "live")


def load_all() -> None:
    for name in MODULES:
        import_module(f"skysift.plans.{name}")
