"""Queries over the given tables, each with equivalent SQL where it exists."""

from gridwave.workload import algebra, complex_algebra, distributions, grids, registry, transforms, walks  # noqa: F401 - importing registers the queries


def all_queries() -> dict[str, registry.Query]:
    return dict(registry.QUERIES)


def all_oracles() -> dict[str, str]:
    return dict(registry.ORACLES)
