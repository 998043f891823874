"""All registered queries."""
from screenloom.plans.registry import ORACLES, QUERIES  # noqa: F401
from screenloom.plans import build, scoring, quality, inference, pairing, modelling, streams, stored  # noqa: F401
from screenloom.plans.build import flagship  # noqa: F401
