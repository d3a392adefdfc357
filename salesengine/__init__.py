"""salesengine: a Spark-native retail sales analytics engine.

Every public function takes DataFrames (usually a ``Tables`` mapping of the
warehouse) and returns a lazy DataFrame.  Nothing is collected to the driver
except bounded metadata (a date bound, per-partition row counts).
"""

from salesengine.session import get_spark, storage_root
from salesengine.sources.warehouse import Tables, load_tables

__all__ = ["Tables", "get_spark", "load_tables", "storage_root"]
