"""cinelytics — recommendation analytics as Spark DataFrame operators.

Every public operator takes DataFrames (plus plain parameters) and returns a
DataFrame built from Spark SQL expressions, so Catalyst plans the whole job:
scans are pruned and filtered at the source, aggregations are partial before
the shuffle, and the few dimension-side joins go through a size-checked join
helper (``cinelytics.plans.joins``) that broadcasts only below a row bound and
otherwise salts the hot keys.
"""

__version__ = "0.1.0"
