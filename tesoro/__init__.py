"""tesoro: small-business finance marts, tax rules and analytics on Spark.

Every operator is a DataFrame-in / DataFrame-out function; see README.md and the
modules below for the SURVEY operator ids each one implements.

    from tesoro.operators import staging, marts, review, tax, quality, forecast, anomaly
    from tesoro.sources import driver_tables, feed
    from tesoro.plans import daily, tax_cycle
    from tesoro.streaming import feed_stream
"""

__version__ = "0.1.0"
