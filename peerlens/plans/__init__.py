from . import catalogue, extended  # noqa: F401  both register their queries
