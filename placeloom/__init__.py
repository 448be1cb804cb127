"""Analytics over social posts and places, and data preparation, on PySpark."""
