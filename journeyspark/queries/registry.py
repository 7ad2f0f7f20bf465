"""Every query of the engine, by name, and its SQL where there is one."""

from . import journeys, profiles, vectors

_ALL = journeys.Q | profiles.Q | vectors.Q


def queries() -> dict:
    return {name: f for name, (f, _) in _ALL.items()}


def oracle_sql() -> dict[str, str]:
    return {name: sql for name, (_, sql) in _ALL.items() if sql}
