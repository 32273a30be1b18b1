"""mensura: a PySpark-native engine for scientific and statistical data processing.

Every operator is a function that takes DataFrames and returns a lazy DataFrame;
nothing here owns a SparkSession or a cluster setting.
"""

__version__ = "0.1.0"
