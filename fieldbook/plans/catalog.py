"""All registered queries; importing the query modules fills the registry."""

from fieldbook.plans import engine_queries, evidence_queries, forecast_queries, function_queries, namespace_queries, relational_queries  # noqa: F401
from fieldbook.plans.registry import QUERIES, SQL  # noqa: F401

FLAGSHIP = "wn01_latest_per_key"
