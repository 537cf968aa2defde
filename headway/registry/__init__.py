"""Registered queries and the SQL each is compared with."""

from headway.registry import features, lake, realtime, serving, static, streams  # noqa: F401
from headway.registry.base import ORACLES, QUERIES  # noqa: F401
