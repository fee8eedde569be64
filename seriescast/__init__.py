"""seriescast: site-by-time measurement series on Spark.

Everything is a ``DataFrame -> DataFrame`` function over a long-form table
``(site, param, ts, value)``.  Sub-packages:

* ``sources``   – raw readers, the calendar generator, sinks, derived test series
* ``functions`` – column expressions (calendar, physics, errors, grade bands)
* ``operators`` – windowed and aggregate operators (fill, rolling, EWM, spells,
                  seasonal means, quantiles, metrics, variance breakdown,
                  scaling, folds, blends, learners)
* ``plans``     – tier configurations and the end-to-end train / evaluate /
                  forecast / variance-analysis plans
* ``streaming`` – the same cleaning and scoring expressed on Structured Streaming
"""

from seriescast.operators.series import Series

__all__ = ["Series"]
