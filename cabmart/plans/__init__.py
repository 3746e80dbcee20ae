"""Models (ODS, datamart), the star builder, reports and chart-ready frames."""

from . import ods, mart, star, reports, charts

__all__ = ["ods", "mart", "star", "reports", "charts"]
