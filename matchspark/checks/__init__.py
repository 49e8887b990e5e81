"""Registered queries by area. Importing a module registers its queries."""

from importlib import import_module

AREAS = ["matching", "people", "cleaning", "ranking", "serving", "texts", "models", "streams"]


def load() -> None:
    for area in AREAS:
        import_module(f"matchspark.checks.{area}")
