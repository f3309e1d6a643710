"""roadspeed: road-speed analytics as Spark DataFrame jobs.

Every public operator is a function ``DataFrame -> DataFrame`` (or a
``Column`` expression) so that Catalyst can prune, push down and fuse the
whole plan. See README.md for the module map.
"""

__version__ = "0.1.0"
