"""The query catalogue: every operator run over the given tables, with its SQL twin."""

from tidewater.plans import (  # noqa: F401
    bronze, gate, gold, lineage, products, quality, schema, silver, streams, telemetry, upkeep,
)
