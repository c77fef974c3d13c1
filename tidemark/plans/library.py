"""All queries of the library; importing the modules fills the registry."""

from tidemark.plans import bars_and_flow, composite, context, controls, intake, joining, lifecycles, locations, measures, reports, research, schedules, signalling, storage, streams, tidies  # noqa: F401
from tidemark.plans.catalog import ORACLES, QUERIES  # noqa: F401
