"""How queries are declared: a name, a function of (spark, sf_dir), and DuckDB SQL where SQL can express it."""

from __future__ import annotations

from mnemoloom.sources import memory

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def query(name: str, oracle: str | None = None):
    """Register a function (load) -> DataFrame; ``load`` gives a table of the memory model by name."""

    def declare(f):
        def run(spark, sf_dir):
            return f(lambda table: memory.load(spark, sf_dir, table))

        run.__name__, run.__doc__ = name, f.__doc__
        QUERIES[name] = run
        if oracle:
            ORACLES[name] = memory.sql(oracle)
        return f

    return declare
