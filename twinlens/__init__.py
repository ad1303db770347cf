"""twinlens: how good is a synthetic table, and how to make one, as Spark jobs."""

from twinlens.pair import Pair
from twinlens.session import local_session

__all__ = ["Pair", "local_session"]
