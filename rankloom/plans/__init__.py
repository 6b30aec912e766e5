"""Named queries over the sample tables."""

from rankloom.plans import corpora, evaluations, reports, retrievals  # noqa: F401
from rankloom.plans.catalogue import PLANS, SQL

__all__ = ["PLANS", "SQL"]
