"""lendframe: data quality, feature preparation and decision analytics for
loan-style tables, written as Spark DataFrame jobs."""

from lendframe.session import get_session

__all__ = ["get_session"]
__version__ = "0.1.0"
