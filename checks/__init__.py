"""Fixtures, registered queries and their SQL oracles."""


def all_queries():
    """Every registered query and oracle."""
    from checks import q_energy, q_grid, q_heating, q_house, q_offset, q_recorded, q_sources, q_whole  # noqa: F401
    from checks.registry import ORACLES, QUERIES

    return QUERIES, ORACLES
