"""metricloom: data cataloguing and metric quality on Spark.

Profile tables, find dimensions, build metrics and facts, evaluate them on the
full data, measure coverage, refine, serve by name and compare catalogues.
Every public function takes and returns DataFrames.
"""

__version__ = "0.1.0"
