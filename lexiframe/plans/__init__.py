"""Registered queries over the given tables, each with its check in SQL where there is one."""


def all_queries():
    """``(queries, checks)`` by name."""
    from lexiframe.plans import grids, ledgers, models, registry, streams, text  # noqa: F401

    return registry.QUERIES, registry.CHECKS
