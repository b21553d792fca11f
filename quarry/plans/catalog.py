"""Importing this module registers every query."""

from quarry.plans import click  # noqa: F401
from quarry.plans import booking  # noqa: F401
from quarry.plans import text  # noqa: F401
from quarry.plans import mlio  # noqa: F401
