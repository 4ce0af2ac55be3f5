"""rolltally: Spark-native analytics over sampled model answers ("rollouts").

Every operator is ``DataFrame -> DataFrame`` or ``Column -> Column`` and is built from
Spark's own functions, so Catalyst plans it and nothing passes through the driver.
"""

__version__ = "0.1.0"
