"""All registered queries: importing the modules fills the registry."""

from docquery.plans import aggregate, entities, jobs, search, text  # noqa: F401
from docquery.plans.registry import ORACLES, QUERIES  # noqa: F401
