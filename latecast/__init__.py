"""Reporting-delay analytics on Spark: week buckets, delay triangles, nowcasts, trends."""

from latecast.plans.nowcast import NowcastResult, nowcast

__all__ = ["NowcastResult", "nowcast"]
