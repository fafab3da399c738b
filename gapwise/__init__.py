"""Gap-aware analytics for hourly sensor panels on Spark."""

from gapwise.spec import PanelSpec

__all__ = ["PanelSpec"]
