"""All registered queries."""

from voxloom.plans import audits, corpus, evaluation, media, vectors  # noqa: F401
from voxloom.plans.registry import ORACLES, QUERIES  # noqa: F401
