"""A semantic layer on Spark: immutable models with attributes, measures, relations and event analytics."""

from metricframe import functions as func
from metricframe.functions.intervals import timeinterval
from metricframe.keys import attr, msr, rel
from metricframe.model import Model, column
from metricframe.sources import Connection

__all__ = ["Connection", "Model", "attr", "column", "func", "msr", "rel", "timeinterval"]
