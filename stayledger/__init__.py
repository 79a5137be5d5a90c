"""Reconcile a roster of stays with daily booking exports, on Spark DataFrames."""

from .plans.reconcile import Reconciliation, reconcile
from .settings import ArrivalsLayout, BookingsLayout, Settings, Unit, configure

__all__ = ["ArrivalsLayout", "BookingsLayout", "Reconciliation", "Settings", "Unit",
           "configure", "reconcile"]
