"""Scans, sinks and the stand-in raw roles."""

from . import schemas, files, tables, standins
from .standins import Tables

__all__ = ["schemas", "files", "tables", "standins", "Tables"]
