"""The registered queries over the driver's tables: customers are records, orders their objects, line items the persons."""

from . import delivery, ingest, scores, texts  # noqa: F401
