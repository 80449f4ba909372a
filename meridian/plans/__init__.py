"""Fixtures and registered queries; importing this package registers them all."""

from . import catalog, live  # noqa: F401
