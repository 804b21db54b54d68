"""Imports every module that registers queries."""

from chronolex.plans import aggregates, corpus, extensions, joins, numbers, scans, selection, texts  # noqa: F401
from chronolex.plans.registry import ORACLES, QUERIES  # noqa: F401
