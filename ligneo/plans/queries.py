"""All registered queries; importing the modules fills the registry."""

from ligneo.plans import checks, files, identity, learning, privacy, records, sources, structure  # noqa: F401
from ligneo.plans.registry import ORACLES, QUERIES  # noqa: F401
