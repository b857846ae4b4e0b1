"""All registered queries of this subpackage; importing the modules fills the registry."""

from ligneo.llm import (  # noqa: F401
    collocations, kneser, mixing, packing, passages, pathjoin, periodic, pqdedup, sharding, squares, tiles, tokenfile, warc,
)
from ligneo.llm.registry import ORACLES, QUERIES  # noqa: F401
