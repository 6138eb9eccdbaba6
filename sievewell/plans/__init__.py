"""Registered queries: a Spark callable and, where SQL can say it, its SQL twin."""

from sievewell.plans.base import oracles, plans  # noqa: F401
